"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut to windows of ``WINDOW`` bytes. In each direction a gated recurrent
unit reads the window; at every byte a softmax over both states labels the position, and the
document's probabilities are the mean over all its bytes. The units use softsign for tanh and
(1 + softsign) / 2 for the sigmoid. Weights are trained in numpy by backpropagation through time.

Training reads a bounded sample: ``sample`` documents (drawn without regard to order, each
language with equal weight) and ``per_document`` windows of each, from one slice of ``slice_chars``
code points at a drawn place. Prediction reads every whole text, in bounded blocks of windows.

Defined cases: null text or text without a letter is ``und`` with score 0; with no labelled row
every text is ``und``; a null doc_id is never held out; labels are any strings; among languages of
equal probability the first by code point is given; repeated rows are drawn together and each is
labelled; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import tokens

UNKNOWN = "und"
WINDOW = 64
HIDDEN = 6
BLOCK = 4096


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 5 == 0, F.lit(False))


def _threshold(counts: list[int], expected: float) -> float:
    """Where ``turn`` must lie below so that about ``expected`` rows do, of all languages alike."""
    low, high = 0.0, 64.0 * max(counts)
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(n * -math.expm1(-middle / n) for n in counts) < expected else (low, middle)
    return high


def training_sample(docs: DataFrame, sample: int, slice_chars: int) -> list[tuple[str, str]]:
    """(lang, slice of text) of at most ``sample`` documents that are not held out. One count for
    each language comes to the driver, then the rows whose turn is below a threshold at which few
    less than ``sample`` rows are expected, so that what the driver gets doesn't grow with tasks."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    count = F.create_map(*[F.lit(x) for pair in sorted(counts.items()) for x in pair])[F.col("lang")]
    drawn = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.xxhash64("text"), F.lit("sample"))
    unit = (F.shiftrightunsigned(drawn, 11) + 1) / F.lit(float((1 << 53) + 1))
    place = F.pmod(F.shiftright(drawn, 7), F.greatest(F.char_length("text") - slice_chars, F.lit(0)) + 1) + 1
    piece = F.col("text").substr(place.cast("int"), F.lit(slice_chars))
    turn = -F.log(unit) * count
    if sum(counts.values()) > sample:
        rows = rows.where(turn < _threshold(list(counts.values()), max(sample / 2, sample - 4 * math.sqrt(sample))))
    rows = rows.select("doc_id", "lang", piece.alias("piece"), turn.alias("turn"))
    return [(r["lang"], r["piece"]) for r in rows.orderBy("turn", "doc_id", "piece").limit(sample).collect()]


def to_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (windows x WINDOW, zero behind the end), bytes in each window, and its text."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts)), -(-length // WINDOW))
    first = np.r_[0, np.cumsum(length)[:-1]] if len(texts) else length
    nth = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(-(-length // WINDOW))[:-1]] if len(texts) else length, -(-length // WINDOW))
    start, left = first[of] + nth * WINDOW, np.minimum(length[of] - nth * WINDOW, WINDOW)
    data = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    out = data[start[:, None] + np.arange(WINDOW)]
    out[np.arange(WINDOW) >= left[:, None]] = 0
    return out, left, of


def _squash(x: np.ndarray) -> np.ndarray:
    down = np.abs(x)
    down += 1
    return x / down


class Network:
    """Weights by name; ``f`` and ``b`` are the directions."""

    def __init__(self, langs: list[str], seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.langs = langs
        self.weights: dict[str, np.ndarray] = {}
        for d in "fb":
            self.weights[f"bytes_{d}"] = draw.normal(0, 0.3, (3 * HIDDEN, 256)).astype("f4")
            self.weights[f"state_{d}"] = draw.normal(0, 0.4, (3 * HIDDEN, HIDDEN)).astype("f4")
        self.weights["out"] = draw.normal(0, 0.3, (len(langs), 2 * HIDDEN)).astype("f4")
        self.weights["bias"] = np.zeros((len(langs), 1), "f4")

    def states(self, x: np.ndarray, d: str, keep: bool = False):
        """States (WINDOW, HIDDEN, windows) of one direction over time-major bytes."""
        table, turn = self.weights[f"bytes_{d}"], self.weights[f"state_{d}"]
        steps = range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
        h = np.zeros((HIDDEN, x.shape[1]), "f4")
        out, tape = np.empty((WINDOW, HIDDEN, x.shape[1]), "f4"), []
        for t in steps:
            given, own = table.take(x[t], axis=1), turn @ h
            gates = given[: 2 * HIDDEN]
            gates += own[: 2 * HIDDEN]
            gates = _squash(gates)
            gates *= 0.5
            gates += 0.5
            old, reset = gates[:HIDDEN], gates[HIDDEN:]
            new = reset * own[2 * HIDDEN :]
            new += given[2 * HIDDEN :]
            new = _squash(new)
            if keep:
                tape.append((t, h, own[2 * HIDDEN :], old, reset, new))
            h = h - new
            h *= old
            h += new
            out[t] = h
        return out, tape

    def label(self, x: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Probabilities (langs, ...) at every position."""
        p = self.weights["out"] @ both + self.weights["bias"]
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        return p

    def pool(self, windows: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each window of the positions' probabilities: (windows, langs)."""
        x = np.ascontiguousarray(windows.T)
        forward, back = self.states(x, "f")[0], self.states(x, "b")[0]
        sums = np.zeros((len(self.langs), x.shape[1]), "f4")
        for t in range(WINDOW):
            sums += self.label(x, np.concatenate([forward[t], back[t]])) * (left > t)
        return sums.T.astype("f8")

    def gradients(self, windows: np.ndarray, left: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over positions, by backpropagation through time."""
        x, w, n = np.ascontiguousarray(windows.T), self.weights, windows.shape[0]
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        runs = {d: self.states(x, d, keep=True) for d in "fb"}
        into = {d: np.empty((WINDOW, HIDDEN, n), "f4") for d in "fb"}
        scale = np.float32(1 / max(1, left.sum()))
        for t in range(WINDOW):
            both = np.concatenate([runs["f"][0][t], runs["b"][0][t]])
            error = self.label(x, both)
            error[truth, np.arange(n)] -= 1
            error *= (left > t) * scale
            grads["out"] += error @ both.T
            grads["bias"] += error.sum(1, keepdims=True)
            back = w["out"].T @ error
            into["f"][t], into["b"][t] = back[:HIDDEN], back[HIDDEN:]
        for d in "fb":
            turn, tape = w[f"state_{d}"], runs[d][1]
            flow = np.zeros((HIDDEN, n), "f4")
            for t, h, own, old, reset, new in reversed(tape):
                flow = flow + into[d][t]
                d_new = flow * (1 - old) * (1 - np.abs(new)) ** 2
                d_old = flow * (h - new) * _gate_slope(old)
                d_reset = d_new * own * _gate_slope(reset)
                d_own = np.concatenate([d_old, d_reset, d_new * reset])
                grads[f"state_{d}"] += d_own @ h.T
                d_given = np.concatenate([d_old, d_reset, d_new])
                for k in range(3 * HIDDEN):
                    grads[f"bytes_{d}"][k] += np.bincount(x[t], d_given[k], 256).astype("f4")
                flow = flow * old + turn.T @ d_own
        return grads


def _gate_slope(gate: np.ndarray) -> np.ndarray:
    """Slope of (1 + softsign) / 2 from its value."""
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


def train(rows: list[tuple[str, str]], per_document: int = 4, epochs: int = 3, batch: int = 192, rate: float = 0.015, seed: int = 11) -> Network | None:
    """A network fitted to (lang, text) rows; None without rows."""
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    net, draw = Network(langs), np.random.default_rng(seed)
    windows, left, of = to_windows([text.encode("utf-8", "replace") for _, text in rows])
    order = draw.permutation(len(of))
    nth = np.zeros(len(of), np.int64)  # how many windows of the same text come before in this order
    by_text = order[np.argsort(of[order], kind="stable")]
    begin = np.flatnonzero(np.r_[True, of[by_text][1:] != of[by_text][:-1]])
    nth[by_text] = np.arange(len(of)) - np.repeat(begin, np.diff(np.r_[begin, len(of)]))
    use = np.flatnonzero(nth < per_document)
    truth = np.array([langs.index(lang) for lang, _ in rows])[of]
    first, second = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
    steps = max(240, epochs * -(-len(use) // batch))
    for step in range(1, steps + 1):
        pick = draw.choice(use, min(batch, len(use)), replace=False)
        slope = rate * (1 - step / (steps + 1)) + 1e-4
        for k, g in net.gradients(windows[pick], left[pick], truth[pick]).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.weights[k] -= (slope * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return net


def predict(net: Network, texts: Iterable[str], count: int) -> tuple[list[str], list[float]]:
    """Language and its pooled probability for each of ``count`` texts; blocks of windows bound the memory."""
    sums = np.zeros((count, len(net.langs)))
    held: list[bytes] = []
    rows: list[int] = []
    size = 0

    def run() -> None:
        windows, left, of = to_windows(held)
        for k in range(0, len(of), BLOCK):
            np.add.at(sums, np.array(rows)[of[k : k + BLOCK]], net.pool(windows[k : k + BLOCK], left[k : k + BLOCK]))

    for row, text in enumerate(texts):
        held.append(text.encode("utf-8", "replace"))
        rows.append(row)
        size += len(held[-1])
        if size >= WINDOW * BLOCK * 4:
            run()
            held, rows, size = [], [], 0
    if held:
        run()
    best = sums.argmax(1)
    whole = sums.sum(1)
    return [net.langs[k] for k in best], [float(s[k] / w) if w else 0.0 for s, k, w in zip(sums, best, whole, strict=True)]


def annotate(docs: DataFrame, lang: str, score: str, sample: int = 2400, per_document: int = 4, slice_chars: int = 1024) -> DataFrame:
    """``docs`` (doc_id, text, lang) with the predicted language and its score in two further
    columns, so named. The network is learned from the rows that are not held out; see the module."""
    tokens.small_batches(docs.sparkSession)
    net = train(training_sample(docs, sample, slice_chars), per_document)
    readable = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0)})

    @F.arrow_udf("lang string, score double")
    def labelled(text: pa.Array) -> pa.Array:
        langs, scores = predict(net, (t.as_py() or "" for t in text), len(text))
        tokens.release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    # Not said to be deterministic, so that a filter on the result never evaluates it twice.
    said = docs.withColumn(lang, labelled.asNondeterministic()(F.col("text").cast("string")))
    known = F.when(readable, F.col(lang)["lang"]).otherwise(UNKNOWN)
    sure = F.when(readable, F.least(F.col(lang)["score"], F.lit(1.0))).otherwise(0.0)
    return said.withColumns({lang: known, score: sure})


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score; ``bounds`` as of ``annotate``."""
    rows = annotate(docs.select("doc_id", "text", "lang"), "lang_pred", "score", **bounds)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

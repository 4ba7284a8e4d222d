"""Toxicity grades by cumulative-link ordinal regression over sparse word features.

Features are words (runs of letters, digits and bytes above 0x7F, A-Z lowered), by 64-bit hash;
a feature's value is log(1 + its count in the text). Grades: 0 for labelled clean documents; the
labelled toxic ones are split at the median of their evidence per word, the mean log-odds of the
chosen features in them, into 1 (mild) and 2 (severe). One weight vector is shared by the ordered
thresholds: P(grade > k) = sigmoid(w x - threshold_k). Output: the expected grade.

Training reads a bounded sample: ``sample`` labelled texts, half of them toxic where there are as many,
weighted back to the true shares, whole, and keeps ``features`` words. The bound is on texts: an id that
many rows share gives as many different texts as others would. Scoring counts the words of every whole text. The labels have two classes; that
there are two grades of toxic ones is this operator's own reading of their evidence.

Defined cases: null or empty text has only the thresholds' probabilities; several labels of one
document count as toxic if one is; null labels and labels without document are left out; with
only one class among the labels, or no word whose share differs surely, every document gets the
share of toxic labels as its probability, without a model; rows that share an id are judged each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import tokens

RESULT = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"
GRADES = 3
#: Standard deviations by which a word's document share must differ between the classes to be a feature.
SURE = 4.0


def _separators() -> np.ndarray:
    out = np.ones(256, bool)
    out[128:] = out[48:58] = out[65:91] = out[97:123] = False
    return out


def _words(text_column):
    """(first row, rows, hashes, row of each) by chunk."""
    values, separators = tokens.byte_values(True), _separators()
    data, starts = tokens.utf8(text_column)
    for row, part, offsets in tokens.chunks(data, starts):
        first, behind, doc = tokens.word_spans(part, offsets, separators)
        yield row, len(offsets) - 1, tokens.word_hashes(values, part, first, behind), doc


def _bags(batches):
    """Distinct words and counts of each document, as bytes."""
    for batch in batches:
        words, counts = [], []
        for _, rows, h, doc in _words(batch.column(1)):
            cuts = np.searchsorted(doc, np.arange(rows + 1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                w, n = np.unique(h[a:b], return_counts=True)
                words.append(w.tobytes()), counts.append(n.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), pa.array(counts, pa.binary())], ["toxic", "words", "counts"])


def labelled_bags(docs: DataFrame, labels: DataFrame, sample: int):
    """Bags of at most ``sample`` labelled texts, half of them of each mark, and the share of all labels
    that is toxic. Of rows that share an id every different text may be one; equal rows are one."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = marks.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    half = sample // 2
    first = lambda df, k, *order: df.where(F.col("toxic") == k).orderBy(*order).limit(half)
    both = lambda df, *order: first(df, 0, *order).unionByName(first(df, 1, *order))
    some = both(marks.withColumn("turn", F.xxhash64("doc_id", F.lit("labels"))), "turn", "doc_id").select("doc_id", "toxic")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("own", F.xxhash64("text"))
    # At most ``sample`` ids of 12 bytes, then as many texts by id and hash.
    texts = rows.select("doc_id", "own").join(F.broadcast(some), "doc_id").distinct()
    chosen = both(texts, F.xxhash64("doc_id", "own"), "doc_id", "own")
    kept = rows.join(F.broadcast(chosen), ["doc_id", "own"]).groupBy("doc_id", "own").agg(F.any_value("toxic").alias("toxic"), F.any_value("text").alias("text"))
    return kept.select("toxic", "text").mapInArrow(_bags, "toxic int, words binary, counts binary").collect(), share


class Grader:
    """Chosen words, shared weights and thresholds."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.words, self.weights, self.thresholds = words, weights, thresholds

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1: (texts, 2)."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -30, 30)))

    def score(self, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """w x of each text from its words' hashes."""
        at = np.searchsorted(self.words, h)
        at[at == len(self.words)] = 0
        hit = np.flatnonzero(self.words[at] == h)
        cell, n = np.unique(row[hit] * len(self.words) + at[hit], return_counts=True)
        return np.bincount(cell // len(self.words), np.log1p(n) * self.weights[cell % len(self.words)], rows)


def objective(x: np.ndarray, grade: np.ndarray, case: np.ndarray, w: np.ndarray, cut: np.ndarray, shrink: float = 1e-4):
    """Weighted loss of weights and thresholds (cut[0], and cut[0] + exp(cut[1])), and its gradient."""
    thresholds = np.array([cut[0], cut[0] + np.exp(cut[1])])
    above = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - thresholds, -30, 30)))
    p = np.stack([1 - above[:, 0], above[:, 0] - above[:, 1], above[:, 1]], 1)
    own = np.maximum(p[np.arange(len(x)), grade], 1e-9)
    slope = above * (1 - above)
    # d log p(grade) / d score at each threshold: + where it is the lower bound, - where the upper.
    low = np.where((np.arange(GRADES - 1) + 1) == grade[:, None], slope, 0) / own[:, None]
    high = np.where(np.arange(GRADES - 1) == grade[:, None], slope, 0) / own[:, None]
    each = (high - low) * case[:, None]
    gradient = np.concatenate([x.T @ each.sum(1) + shrink * w, [-each.sum(), -(each[:, 1]).sum() * np.exp(cut[1])]])
    return -(case * np.log(own)).sum() + shrink / 2 * (w * w).sum(), gradient


def fit(bags, share: float, features: int = 1024, rounds: int = 400) -> Grader | None:
    toxic = np.array([b["toxic"] for b in bags], np.int64)
    if len(set(toxic.tolist())) < 2:
        return None
    order = np.lexsort(([len(b["words"]) for b in bags], [bytes(b["words"][:64]) for b in bags], toxic))  # whatever order Spark gave
    bags, toxic = [bags[k] for k in order], toxic[order]
    words = [np.frombuffer(b["words"], np.uint64) for b in bags]
    counts = [np.frombuffer(b["counts"], "<u4") for b in bags]
    row = np.repeat(np.arange(len(bags)), [len(w) for w in words])
    names, of = np.unique(np.concatenate(words), return_inverse=True)
    n = np.concatenate(counts)
    in_toxic = np.bincount(of, toxic[row], len(names))
    in_clean = np.bincount(of, 1 - toxic[row], len(names))
    odds = np.log((in_toxic + 0.5) / (toxic.sum() + 1)) - np.log((in_clean + 0.5) / ((1 - toxic).sum() + 1))
    a, b = toxic.sum(), (1 - toxic).sum()
    both = (in_toxic + in_clean) / len(bags)
    deviation = np.abs(in_toxic / a - in_clean / b) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / a + 1 / b))
    weight = np.where((in_toxic + in_clean >= 3) & (deviation >= SURE), deviation, 0)
    chosen = np.sort(np.argsort(-weight, kind="stable")[:features])
    chosen = chosen[weight[chosen] > 0]
    if not len(chosen):
        return None
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    hit = place[of] >= 0
    x = np.zeros((len(bags), len(chosen)))
    x[row[hit], place[of[hit]]] = np.log1p(n[hit])
    size = np.bincount(row, n, len(bags))
    evidence = (x > 0) @ np.maximum(odds[chosen], 0) / np.sqrt(np.maximum(size, 1))
    grade = toxic * (1 + (evidence > np.median(evidence[toxic == 1])))
    rate = toxic.mean()
    case = np.where(toxic == 1, share / rate, (1 - share) / (1 - rate)) / len(bags)
    w, cut = np.zeros(len(chosen)), np.array([0.0, 1.0])  # second threshold: first + exp(cut[1])
    m, v = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    for step in range(1, rounds + 1):
        g = objective(x, grade, case, w, cut)[1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, cut = w - move[:-2], cut - move[-2:]
    return Grader(names[chosen], w, np.array([cut[0], cut[0] + np.exp(cut[1])]))


def _graded(grader: Grader | None, share: float):
    def run(batches):
        for batch in batches:
            if grader is None:
                above = np.tile(np.array([[float(share), 0.0]]), (batch.num_rows, 1))
            else:
                scores = [grader.score(h, doc, rows) for _, rows, h, doc in _words(batch.column(1))]
                above = grader.above(np.concatenate(scores) if scores else np.empty(0))
            p = np.stack([1 - above[:, 0], above[:, 0] - above[:, 1], above[:, 1]], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(p.argmax(1), pa.int32()), pa.array(above[:, 0] >= 0.5)],
                [c.split()[0] for c in RESULT.split(", ")],
            )

    return run


def grade(docs: DataFrame, labels: DataFrame, sample: int = 4000, features: int = 1024) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, severity (expected grade, 0 to 2), p_toxic
    (P(grade > 0)), grade (likeliest) and toxic (p_toxic of at least one half), from a model
    fitted to ``labels`` (doc_id, toxic). See the module."""
    tokens.small_batches(docs.sparkSession)
    bags, share = labelled_bags(docs, labels, sample)
    share = share or 0.0
    grader = fit(bags, share, features) if bags else None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_graded(grader, share), RESULT)

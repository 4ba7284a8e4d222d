"""Lempel-Ziv phrase fingerprints and compression-like similarity.

A text's code points, white space included, are parsed as LZ78 does: the next phrase is the longest
phrase seen before in this text, with one code point more. The set of phrases, each hashed as a
polynomial modulo the prime 2**61 - 1, is reduced to a signature of ``MINIMA`` minimum hashes of 16
bits. The likeness of two texts is the share of equal minima, an estimate of the Jaccard similarity
of their phrase sets with a standard deviation of at most 0.045, at every length of the texts: a minimum
of many values is small, so its bits are spread before 16 of them are kept.

``with_neighbours`` also fingerprints each text's edited version, whose last quarter comes from the
next document. Its parse goes on from where the last quarter begins, so that a text's head is parsed
once. Documents are dealt by ranges of (doc_id, text hash) whose bounds are drawn from the rows, and
the document at a bound goes to both ranges, so each text moves once.

Defined cases: null text is empty; the empty text has the empty set, whose likeness is 1 to another
empty set and 0 to any other; equal texts have equal fingerprints; a null doc_id comes first; rows
that share a doc_id are ordered by their text's hash; a lone document is its own next; an empty
table gives no rows; other columns are ignored. A very long text is parsed in slices; its phrases,
of which there are fewer than code points, are held by one task.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import tokens
from quarry.scratch import groups_for

MINIMA = 128
#: Code points that are parsed, and phrases that are reduced, at once.
SLICE, ROWS = 1 << 16, 1 << 11
#: Rows that the bounds of ranges are drawn from: so many a range, so many at most.
DRAWN, MOST_DRAWN = 20, 1 << 20
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FIRST = -(1 << 63)
_BASE = tokens.ONE[1]
_SEEDS = tokens.mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
_FACTORS = tokens.mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_CODE = 21  # bits of a code point
_NONE = ~np.uint64(0)


class Parse:
    """An LZ78 parse that goes on with more text, and can be taken back to an earlier point."""

    def __init__(self) -> None:
        self.below: dict[int, int] = {}  # phrase << _CODE | code point to the longer phrase << _CODE
        self.hashes = [0]  # of every phrase, from the empty one
        self.at = 0  # the phrase begun, << _CODE

    def read(self, text: str) -> list[int]:
        """Go on with ``text``; the keys of the phrases that are new, in order."""
        below, hashes, at, new = self.below, self.hashes, self.at, []
        get, add, prime, base = below.get, hashes.append, tokens.PRIME, _BASE
        for k in range(0, len(text), SLICE):
            for code in np.frombuffer(text[k : k + SLICE].encode("utf-32-le", "surrogatepass"), "<u4").tolist():
                key = at | code
                then = get(key)
                if then is None:
                    below[key] = len(hashes) << _CODE
                    add((hashes[at >> _CODE] * base + code + 1) % prime)
                    new.append(key)
                    at = 0
                else:
                    at = then
        self.at = at
        return new

    def forget(self, new: list[int], at: int) -> None:
        """Take back the last phrases, those of the keys ``new``, and stand at ``at`` again."""
        for key in new:
            del self.below[key]
        if new:
            del self.hashes[-len(new) :]
        self.at = at


def minima(hashes: list[int]) -> np.ndarray:
    """The least value of every permutation over the phrases."""
    out = np.full(MINIMA, _NONE)
    mixed = tokens.mix(np.array(hashes, np.uint64))
    for k in range(0, len(mixed), ROWS):
        np.minimum(out, ((mixed[k : k + ROWS, None] ^ _SEEDS) * _FACTORS).min(0), out=out)
    return out


class Print:
    """A text's signature, and that of the text with its last quarter replaced."""

    def __init__(self, text: str) -> None:
        n = len(text)
        self.head = text[: n - n // 4]
        self.parse = Parse()
        self.parse.read(self.head)
        self.cut = self.parse.at
        self.least = minima(self.parse.hashes[1:])
        self.own = self._signature(text[n - n // 4 :])

    def _signature(self, tail: str) -> np.ndarray:
        new = self.parse.read(tail)
        least = np.minimum(self.least, minima(self.parse.hashes[len(self.parse.hashes) - len(new) :]))
        phrases = len(self.parse.hashes) - 1
        self.parse.forget(new, self.cut)
        return (tokens.mix(least) & np.uint64(0xFFFF)).astype(np.int32) if phrases else np.full(MINIMA, -1, np.int32)

    def edited(self, tail: str) -> np.ndarray:
        return self._signature(tail)


def signature(text: str) -> np.ndarray:
    """MINIMA values of 16 bits, or -1 if there is no phrase."""
    return Print(text).own


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(signature: np.ndarray) -> str:
    return "" if signature[0] < 0 else signature.astype(">u2").tobytes().hex()


def _ranges(batches):
    """Rows (part, doc_id, text, extra) sorted within parts; a part's first extra row ends it."""
    held = None  # the row that waits for its next
    out: list = []

    def finish(row, text, print_):
        doc, whole, own = row
        n = len(whole)
        tail = text[: n // 4]
        edited = own.head + tail
        other = own.own if edited == whole else own.edited(tail)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((doc, n, sha, as_text(own.own), as_text(other), likeness(own.own, other), likeness(own.own, print_)))

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = [c.split()[0] for c in RESULT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    at = None
    for batch in batches:
        for part, doc, text, extra in zip(*(batch.column(i) for i in range(4)), strict=True):
            part, extra = part.as_py(), extra.as_py()
            if at != part:
                at, held = part, None
            elif extra and held is None:
                continue  # a further copy of the row at the bound
            text = text.as_py() or ""
            own = Print(text)
            if held is not None:
                finish(held, text, own.own)
            held = None if extra else (doc.as_py(), text, own)
            if len(out) >= 1000:
                yield batch_of(out)
                out.clear()
        del batch
        tokens.release()
    if out:
        yield batch_of(out)


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) the columns of RESULT. See the module."""
    tokens.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = groups_for(rows, 16, 2)
    keyed = rows.withColumns({"key": F.coalesce("doc_id", F.lit(FIRST)), "own": F.xxhash64(F.coalesce("text", F.lit("")))})
    n, least = keyed.agg(F.count("*"), F.min(F.struct("key", "own"))).first()
    share = min(1.0, min(DRAWN * parts, MOST_DRAWN) / max(n, 1))
    turn = F.pmod(F.xxhash64("key", "own", F.lit("bound")), F.lit(1 << 40))
    some = sorted({(r["key"], r["own"]) for r in keyed.select("key", "own").where(turn < int(share * (1 << 40))).limit(2 * MOST_DRAWN).collect()})
    step = max(1, -(-len(some) // parts))
    bounds = sorted({tuple(least), *some[::step]}) if n else [(0, 0)]
    # Each bound is a row that occurs; part k begins with bound k.
    shared = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("array<int>")
    def part_of(key: pa.Array, own: pa.Array) -> pa.Array:
        bounds = shared.value
        keys = np.array([b[0] for b in bounds], np.int64)
        keys_of = key.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, keys_of) - 1
        out = [[k] for k in at.tolist()]
        for row in np.flatnonzero(np.searchsorted(keys, keys_of, side="right") - 1 > at).tolist():  # ids that bounds have, too
            mine = (key[row].as_py(), own[row].as_py())
            k = bisect.bisect_right(bounds, mine) - 1
            out[row] = [k, (k - 1) % len(bounds)] if bounds[k] == mine else [k]
        return pa.array(out, pa.list_(pa.int32()))

    dealt = keyed.withColumn("parts", part_of("key", "own")).select("doc_id", "key", "own", "text", F.posexplode("parts").alias("extra", "part"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "extra", "key", "own", F.coalesce("text", F.lit("")))
    return dealt.select("part", "doc_id", "text", (F.col("extra") > 0).alias("extra")).mapInArrow(_ranges, RESULT)

"""Substring dedup: words covered by a window of words that occurred earlier are removed.

Every window of ``width`` consecutive words gets a Rabin-Karp hash. Hashes are dealt to
buckets in packed blocks, a bucket finds the hashes that repeat, and all starts but the first
(smallest doc_id, then smallest position) come back to their document, where the windows
merge into maximal removal intervals. Windows are judged on the input.

Skew: a task sends a hash once, with its earliest place; later places in the same task are
marked at once. So a window that stands in a third of all documents costs its bucket one entry
a task. The bucket comes from a second hash, whose word hashes and base are independent of the
first's, so that two different windows are taken as equal only if 61 bits and the bucket collide:
61 bits and the logarithm of the buckets, whose number grows with the input.

Rows are told apart by (doc_id, text): where an id stands for several texts, the text's hash is
part of the place, and orders the rows of the id.

Defined cases: null text is an empty text; fewer words than ``width`` lose nothing; rows that
share a doc_id but not the text are documents of their own; equal rows (id and text) are one
document, so that its windows at the same place are no repetition; a null doc_id counts as the
smallest; a very long text is read by one task, its windows leave it by the million; an empty table
gives no rows. Other columns of the input are ignored unless carried.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import tokens
from quarry.scratch import groups_for, materialize

NULL_ID = -(1 << 63)
FLUSH = 1 << 20
#: Beyond so many buckets windows are dealt in two steps, as a task has too few for each bucket: first
#: to parts of ``FINE`` buckets, then, each part in a stream of its own, to the buckets.
COARSE, FINE = 8192, 256
#: Up to so many ids that stand for several texts are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
PACKED = "key int, kind int, block binary"
RESULT = "kept_text string, n_words long, n_removed long, removed array<struct<first:long,behind:long>>"


def _pack(*columns: np.ndarray) -> bytes:
    """Sorted places (doc, nth, at) as differences, compressed; a column of hashes is kept as it is."""
    n = len(columns[0])
    small = zstandard.compress(b"".join(np.diff(c, prepend=c.dtype.type(0)).tobytes() for c in columns[:3]), 1)
    return np.array([n, len(small)], np.int64).tobytes() + small + b"".join(c.tobytes() for c in columns[3:])


def _unpack(block: bytes, hashes: bool) -> tuple[np.ndarray, ...]:
    n, size = np.frombuffer(block, np.int64, 2)
    small = zstandard.decompress(block[16 : 16 + size])
    out = tuple(np.cumsum(np.frombuffer(small, np.int64, n, 8 * k * n)) for k in range(3))
    return (*out, np.frombuffer(block, np.uint64, n, 16 + size)) if hashes else out


def _deal(key: np.ndarray, kind: int, columns):
    """Rows of PACKED, one for each key; ``columns`` gives the columns of some entries."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.diff(key, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
        yield int(key[a]), kind, _pack(*columns(order[a:b]))


def _home(doc: np.ndarray, nth: np.ndarray, homes: int) -> np.ndarray:
    """The home of a document, as Spark's pmod(xxhash64(doc_id, nth), homes)."""
    return tokens.hash_long(nth, tokens.hash_long(doc)) % np.int64(homes)


def _first_of_equal(h: np.ndarray, places) -> np.ndarray:
    """Which entries are the earliest of their hash; entries come in any order. ``places`` gives the
    (doc, nth, at) of some: only those whose hash another entry has, which are few, are compared."""
    order = np.argsort(h)
    equal = h[order]
    equal = equal[1:] == equal[:-1]
    out = np.ones(len(h), bool)
    out[order[1:][equal]] = False
    out[order[:-1][equal]] = False
    del order, equal
    several = np.flatnonzero(~out)
    doc, nth, at = places(several)
    order = np.lexsort((at, nth, doc, h[several]))
    several, doc, nth, at = several[order], doc[order], nth[order], at[order]
    fresh = np.ones(len(several), bool)
    fresh[1:] = h[several[1:]] != h[several[:-1]]
    top = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    out[several] = (doc == doc[top]) & (nth == nth[top]) & (at == at[top])
    return out


def _windows(width: int, homes: int, buckets: int):
    """Blocks of windows by bucket and of later places by their document's home."""

    def run(batches):
        (one, base), (two, other), separators = tokens.ONE, tokens.TWO, tokens.white_space()
        one, two = tokens.byte_values(False, one), tokens.byte_values(False, two)
        held: list = []  # by chunk of windows: row, start, hash, bucket
        rows: list = []  # by batch: ids and what tells rows of an id apart
        size = n_rows = 0

        def flush():
            row, at, h, key = (np.concatenate(x) for x in zip(*held, strict=True))
            ids, several = (np.concatenate(x) for x in zip(*rows, strict=True))
            held.clear()
            places = lambda i: (ids[row[i]], several[row[i]], at[i].astype(np.int64))
            first = _first_of_equal(h, places)
            later = np.flatnonzero(~first)
            if len(later):
                later = places(later)
                yield from _deal(_home(*later[:2], homes), 1, lambda i: tuple(x[i] for x in later))
            first = np.flatnonzero(first)
            yield from _deal(key[first], 0, lambda i: (*places(first[i]), h[first[i]]))

        def out(blocks):
            blocks = list(blocks)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in blocks], t) for i, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.binary()))], ["key", "kind", "block"])

        for batch in batches:
            rows.append((batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            data, starts = tokens.utf8(batch.column(2))
            for row, part, offsets in tokens.chunks(data, starts):
                first, behind, doc = tokens.word_spans(part, offsets, separators)
                at, h = tokens.window_hashes(tokens.word_hashes(one, part, first, behind), doc, width, base)
                if len(h):
                    key = tokens.window_hashes(tokens.word_hashes(two, part, first, behind), doc, width, other)[1] % np.uint64(buckets)
                    where = doc[at]
                    begin = np.searchsorted(doc, where)
                    held.append(((n_rows + row + where).astype(np.int32), (at - begin).astype(np.int32), h, key.astype(np.int32)))
                    size += len(h)
                if size >= FLUSH:
                    yield out(flush())
                    del rows[:-1]
                    size = n_rows = 0
            n_rows += batch.num_rows
            del data, starts, batch
        if size:
            yield out(flush())
        tokens.release()

    return run


def _deal_again(batches):
    """Blocks of windows of parts of FINE buckets (part, kind, block), a part's together, as blocks of
    buckets: the part and eight bits of the hash. Other blocks pass through with a kind of their own."""
    at, held, size = None, [], 0

    def flush():
        doc, nth, place, h = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        for fine, _, block in _deal(((h >> np.uint64(8)) % np.uint64(FINE)).astype(np.int64), 0, lambda i: tuple(x[np.sort(i)] for x in (doc, nth, place, h))):
            yield at * FINE + fine, 0, block

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.binary()))], ["key", "kind", "block"])

    for batch in batches:
        for part, kind, block in zip(*(batch.column(i) for i in range(3)), strict=True):
            part, kind = part.as_py(), kind.as_py()
            if held and (part != at or kind == 1 or size >= FLUSH):
                yield out(list(flush()))
                size = 0
            if kind == 1:
                yield out([(-1 - part, 1, block.as_py())])
                continue
            at = part
            held.append(_unpack(block.as_py(), True))
            size += len(held[-1][0])
    if held:
        yield out(list(flush()))
    tokens.release()


def _count(homes: int):
    def run(table: pa.Table) -> pa.Table:
        rows = []
        kinds, blocks = table.column("kind").to_pylist(), table.column("block")
        places = [_unpack(b.as_py(), True) for k, b in zip(kinds, blocks, strict=True) if k == 0]
        if places:
            doc, nth, at, h = (np.concatenate(x) for x in zip(*places, strict=True))
            places.clear()
            later = np.flatnonzero(~_first_of_equal(h, lambda i: (doc[i], nth[i], at[i])))
            if len(later):
                later = later[np.lexsort((at[later], nth[later], doc[later]))]
                doc, nth, at = doc[later], nth[later], at[later]
                rows = [(k, b) for k, _, b in _deal(_home(doc, nth, homes), 1, lambda i: (doc[i], nth[i], at[i]))]
        marked = [_unpack(b.as_py(), False) for k, b in zip(kinds, blocks, strict=True) if k == 1]
        if marked:  # their key is their documents' group
            key = table.column("key")[0].as_py()
            rows.append((key if key >= 0 else -1 - key, _pack(*(np.concatenate(x) for x in zip(*marked, strict=True)))))
        del places, marked
        tokens.release()
        return pa.table({"home": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _removed(starts: np.ndarray, width: int, n: int) -> list[tuple[int, int]]:
    """Maximal intervals of words that the windows cover."""
    starts = np.unique(starts)
    starts = starts[starts + width <= n]
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width) + 1
    return [(int(a), int(b) + width) for a, b in zip(starts[np.r_[0, cut]], starts[np.r_[cut - 1, len(starts) - 1]], strict=True)]


def _remove(width: int, untouched: bool):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        places = [_unpack(b.as_py(), False) for b in marks.column("block")]
        of: dict[tuple[int, int], tuple[int, int]] = {}
        at = np.empty(0, np.int64)
        if places:
            doc, nth, at = (np.concatenate(x) for x in zip(*places, strict=True))
            places.clear()
            order = np.lexsort((nth, doc))
            doc, nth, at = doc[order], nth[order], at[order]
            cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1]), True])
            of = dict(zip(zip(doc[cuts[:-1]].tolist(), nth[cuts[:-1]].tolist(), strict=True), zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), strict=True))
        keys = zip((NULL_ID if i is None else i for i in docs.column("doc_id").to_pylist()), docs.column("nth").to_pylist(), strict=True)
        kept, n_words, n_removed, spans = [], [], [], []
        for text, key in zip(docs.column("text"), keys, strict=True):
            whole = (text.as_py() or "").encode("utf-8", "surrogatepass")
            words = whole.split()
            a, b = of.get(key, (0, 0))
            gone = _removed(at[a:b], width, len(words)) if b > a else []
            n_words.append(len(words))
            n_removed.append(sum(y - x for x, y in gone))
            spans.append([{"first": x, "behind": y} for x, y in gone])
            if gone:
                edges = [0, *itertools.chain.from_iterable(gone), len(words)]
                words = [w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]]
            kept.append(None if untouched and not gone else b" ".join(words))
        left = pa.array(kept, pa.binary()).cast(pa.string())
        if untouched:
            left = pc.coalesce(left, docs.column("text").combine_chunks(), pa.scalar(""))
        del kept, of, at
        tokens.release()
        own = {name: docs.column(name) for name in docs.column_names if name not in ("text", "home", "nth")}
        return pa.table(own | {
            "kept_text": left, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))),
        })

    return run


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, ...) with ``nth``: 0, or the hash of the text if rows of the id differ in it."""
    key, own = F.coalesce("doc_id", F.lit(NULL_ID)), F.xxhash64("text")
    spread = rows.groupBy(key.alias("several")).agg(F.min(own).alias("least"), F.max(own).alias("most"))
    several = materialize(spread.where("least <> most").select("several"))
    n = several.count()
    if n == 0:
        return rows.withColumn("nth", F.lit(0).cast("long"))
    met = rows.join(F.broadcast(several) if n <= BROADCAST_IDS else several, key == F.col("several"), "left")
    return met.withColumn("nth", F.when(F.col("several").isNotNull(), own).otherwise(F.lit(0))).drop("several")


def substring_dedup(docs: DataFrame, width: int = 20, carry: tuple[str, ...] = (), untouched: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, the columns named in ``carry`` as
    ``carry_<name>``, then the text without the words that repeated windows cover (kept words
    joined by one space; with ``untouched`` a text that loses no word stays as it is), the counts,
    and the removed intervals of word positions. See the module for the method and the defined cases."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    tokens.small_batches(docs.sparkSession)
    # A bucket sends one block to each home at most, so homes are fewer and larger than buckets.
    groups, homes = groups_for(rows.select("doc_id", "text")), groups_for(rows.select("doc_id", "text"), 32, 1)
    rows = _told_apart(rows)
    coarse = groups if groups <= COARSE else -(-groups // FINE)
    blocks = rows.select("doc_id", "nth", "text").mapInArrow(_windows(width, homes, coarse), PACKED)
    if groups > COARSE:
        blocks = blocks.repartition(min(coarse, COARSE), "key", "kind").sortWithinPartitions("kind", "key").mapInArrow(_deal_again, PACKED)
    marks = blocks.groupBy("key").applyInArrow(_count(homes), "home int, block binary")
    home = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(NULL_ID)), "nth"), F.lit(homes)).cast("int")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name not in ("text", "nth")}
    result = ", ".join([*(f"`{name}` {kind}" for name, kind in kinds.items()), RESULT])
    return rows.withColumn("home", home).groupBy("home").cogroup(marks.groupBy("home")).applyInArrow(_remove(width, untouched), result)

"""Hard negatives of anchors by a full sort of each anchor's scores, block by block.

A row's score for an anchor is the inner product of their whole-number vectors (``vectors``), exactly.
Rows are dealt to blocks by a hash of all they hold, anchors to slots of at most about ``SLOT``; every
pair of a block and a slot is one group, which scores the block for each anchor of the slot and
sorts (lexsort) by falling score and rising id. A first pass reads each anchor's first rows of the
same label: the best ``positives`` over all blocks are its positives. A second pass sorts the rows of
other labels; a binary search finds where the scores fall to a positive's upper limit, and the
next ``negatives`` entries not below the lower limit are read. As the first few of a union are among the
first few of its parts, merging the blocks' lists gives the whole table's. Lists are merged in two steps, so
that no task gathers what all blocks say of one anchor at once.

The work is anchors times rows, as asked; a group is bounded whatever the table, and nothing but numbers of
rows goes to the driver. Sums of products below 2**53 are exact as doubles; larger ones are Python's.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no
part; an empty vector neither; only vectors of the anchor's length are candidates. Rows equal in id, label
and vector are one row; rows that share an id but differ are rows, and anchors, of their own, and "other"
rows then are all but the row itself. An anchor without others of its label gives no rows, nor does a
positive without a row within its limits (as when its score is negative). A score beyond a long is left out of
all lists. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import vectors
from quarry.scratch import materialize, passing, shuffle_partitions

#: Rows of a block and anchors of a slot, about; scores that are sorted at once.
BLOCK, SLOT, AT_ONCE = 16_384, 8_192, 1 << 21
#: Parts in which an anchor's lists are merged first.
PARTS = 32
#: The default limits of a negative's score, in hundredths of the positive's.
LOW, HIGH = 80, 100


def _packed(batches):
    for batch in batches:
        fit, packed = vectors.pack(batch.column(2))
        ids, labels = (batch.column(k).filter(pa.array(fit)) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([ids, labels, packed], ["vec_id", "label", "packed"])


def inner(x: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products, exactly: rows of anchors, columns of x. As objects, if they may pass 2**63."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * x.shape[1]
    if most < 1 << 53:
        return (anchors.astype(float) @ x.T.astype(float)).astype(np.int64)
    if most < 1 << 63:
        return anchors @ x.T
    return anchors.astype(object) @ x.T.astype(object)


def _sorted(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``rows`` by falling score, then rising id; without scores beyond a long."""
    if scores.dtype == object:
        rows = rows[[-(1 << 63) < s < 1 << 63 for s in scores[rows]]]
    mine = scores[rows].astype(np.int64)
    return rows[np.lexsort((ids[rows], ~mine))]


def _blocks(held: pa.Table):
    """A block's different rows by length: ids, labels, vectors as bytes, matrix."""
    rows = sorted(set(zip(*(held.column(c).to_pylist() for c in ("vec_id", "label", "packed")), strict=True)))
    for length, (places, x) in vectors.unpack([r[2] for r in rows]).items():
        yield length, np.array([rows[p][0] for p in places], np.int64), np.array([rows[p][1] for p in places], np.int64), [rows[p][2] for p in places], x


def _each(asked: pa.Table, held: pa.Table):
    """For each anchor of a slot its place in ``asked``, and of a block: scores, ids, labels, and the own row."""
    if not asked.num_rows or not held.num_rows:
        return
    raw, own_id, own_label = (asked.column(c).to_pylist() for c in ("packed", "vec_id", "label"))
    anchors = vectors.unpack(raw)
    for length, ids, labels, packed, x in _blocks(held):
        places, a = anchors.get(length, ((), None))
        step = max(1, AT_ONCE // len(x))
        for k in range(0, len(places), step):
            for place, scores in zip(places[k : k + step].tolist(), inner(x, a[k : k + step]), strict=True):
                same = np.flatnonzero((ids == own_id[place]) & (labels == own_label[place]))
                own = next((j for j in same.tolist() if packed[j] == raw[place]), -1)
                yield place, scores, ids, labels, own


ANCHOR = ("vec_id", "label", "packed")


def _merged(found: DataFrame, key: list[str], most: int) -> DataFrame:
    """``key`` and ``best``: the first ``most`` of (score, other) by falling score and rising id."""
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "other"))), 1, most)
    some = found.withColumn("part", F.pmod("block", F.lit(PARTS))).groupBy(*key, "part").agg(first.alias("best"))
    return some.groupBy(*key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, most).alias("best"))


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = LOW, high: int = HIGH) -> DataFrame:
    """For each row of ``rows`` (vec_id, label, embedding) whose id is divisible by ``every``, and each of
    its positives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, for
    the first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high *
    positive_score. See the module."""
    spark = rows.sparkSession
    with passing(spark) as keep:
        plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and label is not null and size(v) > 0")
        held = materialize(plain.mapInArrow(_packed, "vec_id long, label long, packed binary"))
        asked = materialize(held.where(F.pmod("vec_id", F.lit(every)) == 0).distinct())
        n, n_asked = held.count(), asked.count()
        blocks, slots = max(shuffle_partitions(spark), -(-n // BLOCK)), max(1, -(-n_asked // SLOT))
        place = lambda of, seed: F.pmod(F.xxhash64(*ANCHOR, F.lit(seed)), F.lit(of)).cast("int")
        every_one = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
        dealt = held.select(*ANCHOR, place(blocks, "block").alias("block"), every_one(slots).alias("slot"))

        def first_rows(keys, asked: pa.Table, held: pa.Table) -> pa.Table:
            out_at, out_score, out_other = [], [], []
            for at, scores, ids, labels, own in _each(asked, held):
                own_label = asked.column("label")[at].as_py()
                rows = np.flatnonzero(labels == own_label)
                best = _sorted(scores, ids, rows[rows != own])[:positives]
                out_at += [at] * len(best)
                out_score += scores[best].tolist()
                out_other += ids[best].tolist()
            return _told(asked, out_at, [keys[0].as_py()] * len(out_at), out_score, out_other)

        def between(keys, asked: pa.Table, held: pa.Table) -> pa.Table:
            limits = asked.column("positives").to_pylist()
            out_at, out_limit, out_score, out_other = [], [], [], []
            for at, scores, ids, labels, _ in _each(asked, held):
                order = _sorted(scores, ids, np.flatnonzero(labels != asked.column("label")[at].as_py()))
                falling = scores[order].astype(np.int64)
                for p in set(limits[at]):
                    top, least = high * p // 100, -(-low * p // 100)
                    begin = np.searchsorted(~falling, ~np.int64(max(min(top, (1 << 63) - 1), -(1 << 63))))
                    best = order[begin : begin + negatives]
                    best = best[falling[begin : begin + negatives] >= least]
                    out_at += [at] * len(best)
                    out_limit += [p] * len(best)
                    out_score += scores[best].tolist()
                    out_other += ids[best].tolist()
            return _told(asked, out_at, [keys[0].as_py()] * len(out_at), out_score, out_other, out_limit)

        def met(asked: DataFrame, f, schema: str) -> DataFrame:
            many = asked.withColumn("slot", place(slots, "slot")).withColumn("block", every_one(blocks))
            return many.groupBy("block", "slot").cogroup(dealt.groupBy("block", "slot")).applyInArrow(f, schema)

        told = "vec_id long, label long, packed binary, block int, score long, other long"
        of_anchor = materialize(_merged(met(asked, first_rows, told), [*ANCHOR], positives))
        limits = of_anchor.select(*ANCHOR, F.transform("best", lambda b: -b["far"]).alias("positives"))
        found = _merged(met(limits, between, told + ", limit long"), [*ANCHOR, "limit"], negatives).withColumnRenamed("best", "hard")
        pairs = of_anchor.select(*ANCHOR, F.explode("best").alias("p")).select(*ANCHOR, F.col("p.other").alias("positive_id"), (-F.col("p.far")).alias("limit"))
        out = pairs.join(found, [*ANCHOR, "limit"]).select("vec_id", "positive_id", "limit", F.posexplode("hard").alias("at", "h"))
        return keep(out.select(F.col("vec_id").alias("anchor_id"), "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.other").alias("negative_id"), F.col("limit").alias("positive_score"), (-F.col("h.far")).alias("negative_score")))


def _told(asked: pa.Table, at: list, block: list, score: list, other: list, limit: list | None = None) -> pa.Table:
    of = asked.select(list(ANCHOR)).take(pa.array(at, pa.int64()))
    out = of.append_column("block", pa.array(block, pa.int32())).append_column("score", pa.array(score, pa.int64())).append_column("other", pa.array(other, pa.int64()))
    return out if limit is None else out.append_column("limit", pa.array(limit, pa.int64()))

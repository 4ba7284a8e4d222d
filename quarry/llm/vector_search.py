"""Exact nearest neighbours by an inverted multi-index.

Vectors are scaled to length 1 and cut in two halves, each quantised by its own codebook of
``centroids`` points (k-means on a bounded sample of ``sample`` vectors). A vector is an entry of
the cell of its two nearest centroids. A query walks the pairs of centroids in ascending sum of
distances with a heap until the cells it met hold ``reach`` of all entries, which are reranked by
the exact cosine in double precision. The k-th score so found bounds the distance of any better
neighbour; a second round reranks every other cell that may hold one: by the triangle inequality,
a cell is out only if the least and the greatest distances of its entries from its centroids
leave none so near. So ``reach`` sets the cost, not the result, at every size of the input.

Skew: equal vectors are one entry with its ``k + 1`` smallest ids, which is all that any result
can hold; a cell with more than ``block`` entries is dealt to as many parts as it needs, and a
query visits every part. Only the codebooks and the cells' counts and distances (5 * centroids**2 numbers) go to the
driver and the executors, both of fixed size.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows with null id; vectors are scaled by a power of two first, so that no finite one
overflows or vanishes. Vectors of each length are searched among themselves. Every row is a candidate
of its own: rows that share an id may each be found, equal rows (id and vector) are one. A query id
with several vectors asks with the smallest by (length, bytes), and none of the rows with its id is
found. Fewer candidates than k give fewer rows; ties of score go to the smaller id; an empty table
gives no rows. Other columns are ignored. A vector is held whole by one task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scratch import groups_for, materialize, passing

FOUND = "query_id long, vec_id long, score double"
#: Far above what rounding adds to a squared distance of unit vectors.
SLACK = 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = x[draw.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.square(centres).sum(1) - 2 * x @ centres.T).argmin(1)


def walk(near: np.ndarray, far: np.ndarray, counts: np.ndarray, enough: int):
    """Pairs (a, b) of centroids by ascending near[a] + far[b], until ``enough`` entries were met."""
    rows, cols = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    heap, seen, met = [(near[rows[0]] + far[cols[0]], 0, 0)], {(0, 0)}, 0
    while heap and met < enough:
        _, i, j = heapq.heappop(heap)
        a, b = int(rows[i]), int(cols[j])
        if counts[a, b]:
            met += int(counts[a, b])
            yield a, b
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(rows) and v < len(cols) and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (near[rows[u]] + far[cols[v]], u, v))


def may_hold(near: np.ndarray, far: np.ndarray, counts: np.ndarray, ranges: np.ndarray, edge: float | None, met: list) -> list:
    """Cells not in ``met`` that may hold an entry of score ``edge`` or more; all, without an edge."""
    one, two = np.sqrt(near)[:, None], np.sqrt(far)[None, :]
    gap = np.square(np.maximum(0, np.maximum(one - ranges[1], ranges[0] - one)))
    gap += np.square(np.maximum(0, np.maximum(two - ranges[3], ranges[2] - two)))
    left = (counts > 0) & (gap <= (4 if edge is None else 2 - 2 * edge) + SLACK)
    for a, b in met:
        left[a, b] = False
    return [(int(a), int(b)) for a, b in zip(*left.nonzero(), strict=True)]


def _unit(vectors) -> np.ndarray:
    x = np.array([np.frombuffer(v, "<f8") for v in vectors])
    return x / np.sqrt(np.square(x).sum(1))[:, None]


def _clean(batches):
    """(vec_id, vector as bytes of doubles, its length) of the rows that take part, each scaled by
    the power of two that brings its largest component to between 1/2 and 1."""
    for batch in batches:
        column, ids = batch.column(1), batch.column(0)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # null is not a number here
        some = np.flatnonzero(sizes)
        most = np.zeros(len(sizes))
        if len(some):
            with np.errstate(invalid="ignore"):
                most[some] = np.maximum.reduceat(np.abs(flat), (np.cumsum(sizes) - sizes)[some])
        fit = (most > 0) & np.isfinite(most) & ~ids.is_null().to_numpy(zero_copy_only=False)
        flat = np.ldexp(flat[np.repeat(fit, sizes)], -np.repeat(np.frexp(most[fit])[1], sizes[fit]))
        sizes = sizes[fit]
        data = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes) * 8].astype("<i8").tobytes()), pa.py_buffer(flat.tobytes())])
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(fit)), data.cast(pa.binary()), pa.array(sizes, pa.int32())], ["vec_id", "vector", "length"])


def _fewest(k: int):
    """Per task and vector the k smallest ids, so that copies of one vector stay few."""

    def run(batches):
        held: dict[bytes, list[int]] = {}

        def out():
            pairs = [(v, i) for v, ids in held.items() for i in ids]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.int64())], ["vector", "vec_id"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = held.setdefault(v, [])
                ids.append(i)
                if len(ids) > 4 * k:
                    ids[:] = sorted(set(ids))[:k]
            if len(held) > 50_000:
                held = {v: sorted(set(ids))[:k] for v, ids in held.items()}
                yield out()
                held = {}
        held = {v: sorted(set(ids))[:k] for v, ids in held.items()}
        if held:
            yield out()

    return run


def search(vectors: DataFrame, every: int = 50, k: int = 5, centroids: int = 48, sample: int = 20_000, reach: float = 0.45, block: int = 20_000) -> DataFrame:
    """For every row of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``: its k
    nearest other rows by cosine: query_id, rank (from 1), vec_id, score. See the module."""
    spark = vectors.sparkSession
    with passing(spark) as keep:
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
        rows = materialize(rows.mapInArrow(_clean, "vec_id long, vector binary, length int"))
        asked = rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
        queries = materialize(asked.groupBy("vec_id").agg(F.min(F.struct("length", "vector")).alias("own")).select("vec_id", "own.*"))
        found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        for length in sorted(r["length"] for r in queries.select("length").distinct().collect()):  # as a rule, one
            of_length = F.col("length") == length
            found = found.unionByName(_search(rows.where(of_length).select("vec_id", "vector"), queries.where(of_length).select("vec_id", "vector"), k, centroids, sample, reach, block))
        return keep(found)


def _search(rows: DataFrame, queries: DataFrame, k: int, centroids: int, sample: int, reach: float, block: int) -> DataFrame:
    """``search`` among vectors of one length, given what takes part."""
    spark = rows.sparkSession
    entries = rows.mapInArrow(_fewest(k + 1), "vector binary, vec_id long").groupBy("vector").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))

    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x = _unit([r["vector"] for r in some])
    half = max(1, x.shape[1] // 2)
    books = kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids) if x.shape[1] > half else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast(books)
    width = len(books[1])

    @F.pandas_udf("cell int, one double, two double")
    def placed(column: pd.Series) -> pd.DataFrame:
        if not len(column):
            return pd.DataFrame({"cell": np.zeros(0, np.int32), "one": np.zeros(0), "two": np.zeros(0)})
        x, (one, two) = _unit(column), shared.value
        a, b = nearest(x[:, :half], one), nearest(x[:, half:], two)
        away = (np.sqrt(np.square(y - c).sum(1)) for y, c in ((x[:, :half], one[a]), (x[:, half:], two[b])))
        return pd.DataFrame(dict(zip(("cell", "one", "two"), ((a * len(two) + b).astype(np.int32), *away), strict=True)))

    entries = materialize(entries.withColumn("at", placed("vector")).select("vector", "ids", "at.*"))
    counts, spans = np.zeros(len(books[0]) * width, np.int64), np.zeros((4, len(books[0]) * width))
    spread = (F.min("one").alias("one_least"), F.max("one").alias("one_most"), F.min("two").alias("two_least"), F.max("two").alias("two_most"))
    for r in entries.groupBy("cell").agg(F.count("*").alias("n"), *spread).collect():  # at most centroids**2 rows
        counts[r["cell"]] = r["n"]
        spans[:, r["cell"]] = r["one_least"], r["one_most"], r["two_least"], r["two_most"]
    enough = int(np.ceil(reach * counts.sum()))
    sizes = spark.sparkContext.broadcast(counts.reshape(-1, width))
    ranges = spark.sparkContext.broadcast(spans.reshape(4, -1, width))
    parts = groups_for(entries, 16, 1)

    def visits(batches):
        """The first round's cells of (vec_id, vector); the second round's of (vec_id, vector, k-th score)."""
        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            edges = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            out_id, out_vector, out_cell, out_part, out_edge = [], [], [], [], []
            (one, two), counts = shared.value, sizes.value
            for at, (i, v) in enumerate(zip(ids, raw, strict=True)):
                u = _unit([v])[0]
                near = np.square(one - u[:half]).sum(1)
                far = np.square(two - u[half:]).sum(1)
                cells: dict[int, list[int]] = {}
                met = list(walk(near, far, counts, enough))
                if edges is not None:
                    met = may_hold(near, far, counts, ranges.value, edges[at], met)
                for a, b in met:
                    c = a * len(two) + b
                    for sub in range(-(-int(counts[a, b]) // block)):
                        cells.setdefault((c * 31 + sub) % parts, []).append(c)
                for part, c in cells.items():
                    out_id.append(i), out_vector.append(v), out_cell.append(np.unique(np.array(c, "<i4")).tobytes()), out_part.append(part), out_edge.append(edges[at] if edges else None)
            yield pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array(out_id, pa.int64()), pa.array(out_vector, pa.binary()), pa.array(out_cell, pa.binary()), pa.array(out_edge, pa.float64())], ["part", "query_id", "vector", "cells", "edge"])

    def rerank(keys, visitors: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if visitors.num_rows and held.num_rows:
            cells = held.column("cell").to_numpy()
            order = np.argsort(cells, kind="stable")
            cells = cells[order]
            raw, ids = held.column("vector"), held.column("ids")
            x = np.array([np.frombuffer(raw[int(j)].as_py(), "<f8") for j in order])
            ids = [ids[int(j)].as_py() for j in order]
            size = np.sqrt(np.square(x).sum(1))
            for i, v, wanted, least in zip(*(visitors.column(c).to_pylist() for c in ("query_id", "vector", "cells", "edge")), strict=True):
                wanted = np.frombuffer(wanted, "<i4")
                low, high = np.searchsorted(cells, wanted), np.searchsorted(cells, wanted, side="right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
                if not len(at):
                    continue
                q = np.frombuffer(v, "<f8")
                score = (x[at] * q).sum(1) / (size[at] * np.sqrt(np.square(q).sum()))
                if least is not None:  # what scores less than the k-th of the first round is no result
                    keep = score >= least - SLACK
                    at, score = at[keep], score[keep]
                if len(at) > k + 1:
                    edge = np.partition(score, len(at) - k - 1)[len(at) - k - 1]
                    keep = score >= edge
                    at, score = at[keep], score[keep]
                best = sorted((-s, j) for s, where in zip(score.tolist(), at.tolist(), strict=True) for j in ids[where] if j != i)[:k]
                out += [(i, j, -s) for s, j in best]
        return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[2] for r in out], pa.float64())})

    @F.pandas_udf("int")
    def dealt(cell: pd.Series, turn: pd.Series) -> pd.Series:
        c = cell.to_numpy().astype(np.int64)
        split = -(-sizes.value.reshape(-1)[c] // block)
        return pd.Series((c * 31 + turn.to_numpy() % np.maximum(split, 1)) % parts).astype("int32")

    turn = F.pmod(F.xxhash64("vector"), F.lit(1 << 30))
    held = entries.withColumn("part", dealt("cell", turn)).select("part", "cell", "vector", "ids")
    visit = "part int, query_id long, vector binary, cells binary, edge double"
    rerun = lambda asked: materialize(asked.mapInArrow(visits, visit).groupBy("part").cogroup(held.groupBy("part")).applyInArrow(rerank, FOUND))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k)
    found = rerun(queries)
    edges = found.groupBy("query_id").agg(best.alias("best")).select(F.col("query_id").alias("vec_id"), F.when(F.size("best") == k, -F.element_at("best", -1)["far"]).alias("edge"))
    found = found.unionByName(rerun(queries.join(materialize(edges), "vec_id", "left").select("vec_id", "vector", "edge")))
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))

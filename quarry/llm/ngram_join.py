"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct shingles of ``width`` words (A-Z lowered), as 64-bit hashes.
Documents link when 100 * intersection >= percent * union; the result is the connected components.

1. Equal sets are one set. A count sketch of fixed size (``1 << SKETCH`` counters) estimates in
   how many documents a shingle occurs; shingles are ordered from rare to frequent by it.
2. Two linked sets of n shingles share at least m shingles within their first
   n - ceil(percent * n / 100) + m. Each set chooses its own m: longer prefixes where the sketch
   expects more candidates for each shingle, and correspondingly more shared shingles needed.
3. Sets that share fewer prefix shingles with all others together than any partner could need
   are out; that is repeated once without them. What is left meets at its shared prefix shingles:
   all sets of a shingle form a family with the smallest set there. A set gives up families that
   it meets at few shingles, fewer in all than half of what a link needs.
4. A family's sets are compared by parity bitmaps of one to two bits a shingle: bit k says whether
   an odd number of shingles hash to k, so that two bitmaps differ in at most as many bits as the
   sets in shingles. Pairs that differ in more bits than a link allows are out; nothing else is.
   The connected components of what is left hold every link within one component.
5. A component's whole sets, each sent once, are compared exactly.

Steps 4 and 5 work in blocks of ``BLOCK`` sets. A group of several blocks first compares each block
with itself and with the group's smallest set; only sets outside the group's largest component so
found are then compared with all other blocks. So a large group of near copies costs about its
size, and no link between components is missed.

Skew: copies collapse in each task before they are sent; a shingle that the sketch finds in many
documents is dealt to several parts; a family is split into blocks; hot keys meet only one-row-a-key tables. Nothing but the sketch (a byte for each counter) is collected.
Two different shingles are taken as equal only if their words' 64-bit hashes or the polynomials
modulo a 61-bit prime over them collide, two sets only if a 64-bit hash of all their shingles does.

Defined cases: null text, or text without words, has the empty set, its own component and no
link; a very long text is hashed by one task, its set is sent once; an empty table gives no rows;
other columns are ignored; fewer words than ``width`` are one shingle; rows that share a doc_id are documents of their
own with one id; a null doc_id is never a component's id unless all its members have none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import tokens
from quarry.llm.components import components
from quarry.scratch import free, groups_for, materialize, passing

SKETCH = 22
SKETCH_BLOCK = 1 << 13
#: Sketches of so many tasks are summed at once.
FAN = 64
#: A shingle that stands in more documents is dealt to several parts, of about so many each.
HOT = 128
BLOCK = 96
BLOCK_TOKENS = 1 << 19
#: The shortest bitmap: small sets differ in few shingles, of which few may fall together by chance.
LEAST_PLACES = 256
#: Up to so many representatives are broadcast (8 bytes each) when their texts are looked up.
BROADCAST_IDS = 1_000_000


class Shingler:
    """Distinct shingles of every row of an Arrow column, by chunk."""

    def __init__(self, width: int) -> None:
        self.width, self.base = width, tokens.ONE[1]
        self.values, self.separators = tokens.byte_values(True), tokens.white_space()

    def sets(self, column, classes: np.ndarray | None = None):
        """(first row, rows, hashes, row of each), sorted by row, then class if given, then hash."""
        data, starts = tokens.utf8(column)
        for row, part, offsets in tokens.chunks(data, starts):
            rows = len(offsets) - 1
            first, behind, doc = tokens.word_spans(part, offsets, self.separators)
            words = tokens.word_hashes(self.values, part, first, behind)
            at, h = tokens.window_hashes(words, doc, self.width, self.base)
            n_words = np.bincount(doc, minlength=rows)
            hashes, of = [h], [doc[at]]
            for short in range(1, self.width):  # a text of fewer words is one shingle
                few = np.flatnonzero(n_words[doc] == short)
                if len(few):
                    at, h = tokens.window_hashes(words[few], doc[few], short, self.base)
                    hashes.append(h), of.append(doc[few][at])
            h, of = np.concatenate(hashes), np.concatenate(of)
            order = np.argsort(h)
            if classes is not None:
                order = order[np.argsort(classes[slots(h[order])], kind="stable")]
            order = order[np.argsort(of[order].astype(np.uint16) if rows < 1 << 16 else of[order], kind="stable")]
            h, of = h[order], of[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            yield row, rows, h[new], of[new]


def bitmap(h: np.ndarray) -> bytes:
    """Parity of the number of hashes at each place of a power of two of places, at least their number."""
    places = max(LEAST_PLACES, 1 << (len(h) - 1).bit_length())
    counts = np.bincount((h & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(bits: int, places: int, to: int) -> int:
    """The parity bitmap that the same set has with fewer places."""
    while places > to:
        places >>= 1
        bits = (bits >> places) ^ (bits & ((1 << places) - 1))
    return bits


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH)).astype(np.int64)


def set_ids(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id of each row's set, whatever its order, and its size."""
    cuts = np.searchsorted(row, np.arange(rows + 1))
    sums = np.zeros((2, len(h) + 1), np.uint64)
    np.cumsum(tokens.mix(h), out=sums[0, 1:])
    np.cumsum(tokens.mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
    one, two = (s[cuts[1:]] - s[cuts[:-1]] for s in sums)
    return tokens.mix(one ^ tokens.mix(two)).view(np.int64), np.diff(cuts)


def _survey(width: int):
    """Rows (doc_id, key, set_id, n, bits) of documents, bits once a set and task, then (block,
    counts) of the task's sketch, with the task's number as n."""

    def run(batches):
        shingler, counts = Shingler(width), np.zeros(1 << SKETCH, np.uint32)
        names = ["doc_id", "key", "set_id", "n", "bits", "block", "counts"]
        seen: set[int] = set()
        for batch in batches:
            ids, sizes, bits = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
            for _, rows, h, of in shingler.sets(batch.column(2)):
                np.add.at(counts, slots(h), np.uint32(1))
                i, n = set_ids(h, of, rows)
                ids.append(i), sizes.append(n)
                cuts = np.r_[0, np.cumsum(n)].tolist()
                for k, set_id in enumerate(i.tolist()):
                    if set_id in seen or cuts[k] == cuts[k + 1]:
                        bits.append(None)
                        continue
                    seen.add(set_id)
                    bits.append(bitmap(h[cuts[k] : cuts[k + 1]]))
                if len(seen) > 2_000_000:
                    seen.clear()
            none = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)), pa.array(bits, pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names)
        blocks = [(k, zstandard.compress(c.astype(np.uint64).tobytes(), 1)) for k, c in enumerate(counts.reshape(-1, SKETCH_BLOCK)) if c.any()]
        none = len(blocks)
        del seen, counts
        tokens.release()
        task = pa.array([TaskContext.get().partitionId()] * none, pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.nulls(none, pa.int64()) for _ in range(3)), task, pa.nulls(none, pa.binary()), pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.binary())], names)

    return run


def _total(table: pa.Table) -> np.ndarray:
    total = np.zeros(SKETCH_BLOCK, np.uint64)
    for counts in table.column("counts"):
        total += np.frombuffer(zstandard.decompress(counts.as_py()), np.uint64)
    return total


def _sum(table: pa.Table) -> pa.Table:
    return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([zstandard.compress(_total(table).tobytes(), 1)], pa.binary()), "task": table.column("task").slice(0, 1)})


def _add_up(table: pa.Table) -> pa.Table:
    classes = np.floor(2 * np.log2(_total(table).astype(np.float64) + 1)).astype(np.uint8)
    return pa.table({"block": table.column("block").slice(0, 1), "classes": pa.array([classes.tobytes()], pa.binary())})


def matches(n: np.ndarray, percent: int, expected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many shared prefix shingles sets of n shingles ask for, and how long their prefix is.
    ``expected``: mean sketch class of the shortest prefix above the sketch's own noise."""
    least = -(-percent * n // 100)
    short = n - least + 1
    m = 2 + np.ceil(short * np.minimum(0.6 + 0.05 * expected, 1.0)).astype(np.int64)
    m = np.clip(m, 1, np.maximum(least, 1))
    return m, n - least + m


def _prefixes(width: int, percent: int, classes):
    def run(batches):
        shingler, table = Shingler(width), classes.value
        noise = float(np.median(table))
        # Into how many parts a shingle of each sketch class is dealt, by what it has above the noise.
        counts = np.exp2(np.arange(256) / 2)
        parts_of = 1 + np.floor(np.maximum(counts - 2 ** (noise / 2), 0) / max(HOT, 8 * 2 ** (noise / 2))).astype(np.int64)
        seen: set[int] = set()
        for batch in batches:
            for _, rows, h, of in shingler.sets(batch.column(0), table):
                ids, n = set_ids(h, of, rows)
                cuts = np.r_[0, np.cumsum(n)]
                rank = np.arange(len(h)) - cuts[of]
                short = n - -(-percent * n // 100) + 1
                over = np.maximum(table[slots(h)] - noise, 0) * (rank < short[of])
                m, length = matches(n, percent, np.bincount(of, over, rows) / np.maximum(short, 1))
                fresh = np.zeros(rows, bool)
                for k, i in enumerate(ids.tolist()):
                    if n[k] and i not in seen:
                        seen.add(i)
                        fresh[k] = True
                if len(seen) > 2_000_000:
                    seen.clear()
                keep = fresh[of] & (rank < length[of])
                o, salts = of[keep], parts_of[table[slots(h[keep])]]
                salt = np.where(salts > 1, (tokens.mix(ids[o].view(np.uint64)) % salts.astype(np.uint64)).view(np.int64), -1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h[keep].view(np.int64), salt.astype(np.int32), ids[o], n[o], m[o])], ["token", "salt", "set_id", "n", "m"])
        tokens.release()

    return run


def _whole_sets(width: int):
    def run(batches):
        shingler = Shingler(width)
        for batch in batches:
            for row, rows, h, of in shingler.sets(batch.column(1)):
                ids, n = set_ids(h, of, rows)
                cuts = np.r_[0, np.cumsum(n)]
                sets = [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                wanted = batch.column(0).slice(row, rows)
                same = ids == wanted.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([wanted, pa.array(sets, pa.binary())], ["set_id", "data"]).filter(pa.array(same))
        tokens.release()

    return run


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Intersection sizes of the first ``left`` sets with all sets."""
    count = len(sets)
    token = np.concatenate(sets)
    row = np.repeat(np.arange(count), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")  # rows ascend within a token
    token, row = token[order], row[order]
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    size = np.diff(np.r_[begin, len(token)])
    shared = size > 1
    column = np.repeat(np.cumsum(shared) - 1, size)[np.repeat(shared, size)]
    row = row[np.repeat(shared, size)]
    columns = int(shared.sum())
    both = np.zeros((left, count), np.float32)
    step = max(1, (1 << 22) // count)
    for low in range(0, columns, step):
        a, b = np.searchsorted(column, [low, low + step])
        x = np.zeros((count, min(step, columns - low)), np.float32)
        x[row[a:b], column[a:b] - low] = 1
        both += x[:left] @ x.T
    return both.astype(np.int64)


def _blocks(table: pa.Table, last: str):
    """Rows of each block, (order, cuts), a block's rows sorted by the column ``last``."""
    keys = np.stack([table.column(c).to_numpy() for c in ("family", "left", "right")])
    order = np.lexsort((table.column("set_id").to_numpy(), table.column(last).to_numpy(zero_copy_only=False), *keys))
    keys = keys[:, order]
    cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0), True]) if len(order) else np.zeros(1, np.int64)
    return order, cuts.tolist()


def _edge_table(edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def _close(percent: int):
    """Edges that connect the sets of each block whose bitmaps differ in no more bits than linked
    sets may differ in shingles. A block is (family, left, right); rows with ``asks`` are compared
    with all rows of the block that are of another component."""

    def run(table: pa.Table) -> pa.Table:
        order, cuts = _blocks(table, "n")
        ids, sizes, asks, roots = (table.column(c).to_numpy(zero_copy_only=False)[order].tolist() for c in ("set_id", "n", "asks", "root"))
        raw, order = table.column("data").combine_chunks(), order.tolist()
        known: dict[int, tuple[int, int]] = {}

        def bits(k: int) -> tuple[int, int]:
            if ids[k] not in known:
                data = raw[order[k]].as_py()
                known[ids[k]] = int.from_bytes(data, "little"), 8 * len(data)
            return known[ids[k]]

        edges: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            above = list(range(a, b))

            def top(k: int) -> int:
                while above[k - a] != k:
                    above[k - a] = k = above[above[k - a] - a]
                return k

            for i in range(a, b):
                most = 100 * sizes[i] // percent
                for j in range(i + 1, b):
                    if sizes[j] > most:
                        break
                    if not (asks[i] or asks[j]) or roots[i] == roots[j] or top(i) == top(j):
                        continue
                    (x, places), (y, others) = bits(i), bits(j)
                    to, both = min(places, others), sizes[i] + sizes[j]
                    if (fold(x, places, to) ^ fold(y, others, to)).bit_count() <= both - 2 * -(-percent * both // (100 + percent)):
                        above[top(j) - a] = top(i)
                        edges.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        known.clear()
        tokens.release()
        return _edge_table([e for e in edges if e[0] != e[1]])

    return run


def _compare(percent: int):
    """Edges between linked sets of each block: one from every set to the smallest set that links
    within the block reach. Blocks and ``asks`` are those of _close."""

    def run(table: pa.Table) -> pa.Table:
        table = table.append_column("asked", pa.array(~table.column("asks").to_numpy(zero_copy_only=False)))
        order, cuts = _blocks(table, "asked")
        ids, asks, roots = (table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("set_id", "asks", "root"))
        raw = table.column("data").combine_chunks()
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, new = ids[a:b], {}
            keep = [k for k in range(b - a) if new.setdefault(int(own[k]), k) == k]  # a set may both ask and be asked
            own, root = own[keep], roots[a:b][keep]
            left = int(asks[a:b][keep].sum())
            if left == 0 or len(keep) < 2:
                continue
            sets = [np.frombuffer(raw[int(order[a + k])].as_py(), np.uint64) for k in keep]
            n = np.array([len(s) for s in sets])
            both = overlaps(sets, left)
            linked = (100 * both >= percent * (n[:left, None] + n[None, :] - both)) & (root[:left, None] != root[None, :])
            linked[np.arange(left), np.arange(left)] = False
            out += _forest(linked, own)
        tokens.release()
        return _edge_table(out)

    return run


def _forest(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links (asking rows x all rows) connect, one less than members."""
    left, count = linked.shape
    free, out = np.ones(count, bool), []
    for start in range(left):
        if not free[start] or not linked[start].any():
            continue
        group = np.zeros(count, bool)
        front = np.zeros(count, bool)
        front[start] = True
        while front.any():
            group |= front
            near = linked[front[:left].nonzero()[0]].any(0)
            near[:left] |= linked[:, front].any(1)
            front = near & ~group
        free &= ~group
        members = np.sort(ids[group])
        out += [(int(x), int(members[0])) for x in members[1:]]
    return out


def _edges(rows: DataFrame, compare, groups: int) -> DataFrame:
    """``rows``: (family, left, right, set_id, n, asks, root, data), dealt to ``groups`` groups of whole blocks."""
    bucket = F.pmod(F.xxhash64("family", "left", "right"), F.lit(groups)).cast("int")
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(compare, "a long, b long").distinct()


def _linked(members: DataFrame, payload: DataFrame, compare, groups: int) -> DataFrame:
    """``members`` (family, set_id, n), a family named by its smallest set, and ``payload`` (set_id,
    data) to (node, root): the components of the edges that ``compare`` finds within families."""
    columns = ("family", "left", "right", "set_id", "n", "asks", "root")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    families = materialize(members.groupBy("family").agg(blocks.alias("blocks")))
    sized = members.join(families, "family").withColumn("own", F.pmod(F.xxhash64("set_id", F.lit("block")), F.col("blocks")).cast("int"))
    first = F.when(F.col("set_id") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = sized.withColumns({"left": F.explode(first), "right": F.lit(-1), "asks": F.lit(True), "root": F.col("set_id")}).select(*columns)
    edges = materialize(_edges(first.join(payload, "set_id"), compare, groups))
    roots = components(edges)
    if families.where("blocks > 1").isEmpty():
        return roots

    large = sized.where("blocks > 1").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    large = materialize(large.withColumn("root", F.coalesce("root", "set_id")))
    per_root = large.groupBy("family", "root").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    most = per_root.groupBy("family").agg(F.max_by("root", F.struct("members", "root")).alias("most"), F.sum("members").alias("all"), F.sum("n").alias("all_n"), F.max(F.struct("members", "root", "n")).alias("top"))
    rest, rest_n = F.col("all") - F.col("top.members"), F.col("all_n") - F.col("top.n")
    most = most.select("family", "most", F.greatest(F.ceil(rest / BLOCK), F.ceil(rest_n / BLOCK_TOKENS)).cast("int").alias("askers")).where("askers > 0")
    second = large.join(materialize(most), "family")
    asking = second.where("root <> most").withColumn("left", F.pmod(F.xxhash64("set_id", F.lit("ask")), F.col("askers")).cast("int"))
    asking = asking.withColumn("right", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    asked = second.withColumn("left", F.explode(F.sequence(F.lit(0), F.col("askers") - 1))).withColumn("right", F.col("own")).withColumn("asks", F.lit(False))
    more = materialize(_edges(asking.select(*columns).unionByName(asked.select(*columns)).join(payload, "set_id"), compare, groups))
    return roots if more.isEmpty() else components(edges.unionByName(more))


def _met(rows: DataFrame) -> DataFrame:
    """Of (token, salt, set_id, n, m) the rows whose token several sets have, with the token's smallest
    set (family) and m (least_m). A token with a salt is dealt to parts by it; what its parts find
    is put together and told to each part by a row of its own, so that no task gets the whole token."""
    own = Window.partitionBy("token", "salt")
    part = rows.withColumns({"sets": F.count("*").over(own), "family": F.min("set_id").over(own), "least_m": F.min("m").over(own)})
    held = materialize(part.where("sets > 1 or salt >= 0").drop("sets"))
    hot = held.where("salt >= 0")
    if hot.isEmpty():
        return held
    whole = hot.groupBy("token").agg(F.count("*").alias("sets"), F.min("family").alias("family"), F.min("least_m").alias("least_m"), F.max("salt").alias("last")).where("sets > 1")
    told = whole.select("token", F.explode(F.sequence(F.lit(0), "last")).alias("salt"), "family", "least_m")
    met = hot.drop("family", "least_m").unionByName(told, allowMissingColumns=True)
    met = met.withColumns({c: F.max(c).over(own) for c in ("family", "least_m")}).where("set_id is not null and family is not null")
    return held.where("salt < 0").unionByName(materialize(met.select(*held.columns)))


def _memberships(held: DataFrame) -> DataFrame:
    """(family, set_id, n), families of one set included. A set leaves the families that it meets at the fewest shingles, as long
    as it gives up at most (m - 1) / 2 of them: two linked sets share m, so that at least one
    shingle's family keeps both."""
    own = Window.partitionBy("set_id")
    rows = held.groupBy("family", "set_id").agg(F.first("n").alias("n"), F.count("*").alias("hits"), F.min(F.least("m", "least_m")).alias("least"))
    given_up = F.sum("hits").over(own.orderBy("hits", "family"))
    rows = rows.withColumns({"given_up": given_up, "m": F.min("least").over(own)})
    return rows.where("given_up > floor((m - 1) / 2)").select("family", "set_id", "n")


def row_key() -> Column:
    """A key for equal rows (doc_id, text) only, ids null or not."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def join_components(docs: DataFrame, width: int = 3, percent: int = 90, keys: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id
    that links reach); with ``keys`` also key, the row's ``row_key``, and component_key, the key of
    the component's first row by (doc_id, key), null where no row has an id or the set is empty.
    See the module for the method and the defined cases."""
    with passing(docs.sparkSession) as keep:
        return keep(_components_of(docs, width, percent, keys))


def _merged(sketches: DataFrame, tasks: int) -> DataFrame:
    """(block, counts) of every task summed by a tree of FAN tasks' counts at a time to (block, classes)."""
    rows = sketches.select("block", "counts", F.col("task"))
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        rows = rows.withColumn("task", F.pmod("task", F.lit(tasks)).cast("int")).groupBy("block", "task").applyInArrow(_sum, "block int, counts binary, task int")
    return rows.groupBy("block").applyInArrow(_add_up, "block int, classes binary")


def _components_of(docs: DataFrame, width: int, percent: int, keys: bool) -> DataFrame:
    tokens.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select("doc_id", row_key().alias("key"), "text")
    survey = materialize(texts.mapInArrow(_survey(width), "doc_id long, key long, set_id long, n long, bits binary, block int, counts binary"))
    known = survey.where("block is null").select("doc_id", "key", "set_id", "n")
    classes = np.zeros(1 << SKETCH, np.uint8)
    sketches = survey.where("block is not null").select("block", "counts", F.col("n").cast("int").alias("task"))
    tasks = (sketches.agg(F.max("task")).first()[0] or 0) + 1
    for r in _merged(sketches, tasks).toLocalIterator():
        classes[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["classes"], np.uint8)
    shared = spark.sparkContext.broadcast(classes)

    parts, groups = groups_for(texts, 4, 1), groups_for(texts)
    prefixes = texts.select("text").mapInArrow(_prefixes(width, percent, shared), "token long, salt int, set_id long, n long, m long").repartition(parts, "token", "salt")
    held = _met(prefixes.groupBy("token", "salt", "set_id").agg(F.first("n").alias("n"), F.first("m").alias("m")))
    free(spark)
    for _ in range(2):
        enough = held.groupBy("set_id").agg(F.count("*").alias("hits"), F.min(F.least("m", "least_m")).alias("needs")).where("hits >= needs")
        held = _met(held.join(materialize(enough.select("set_id")), "set_id", "left_semi").select("token", "salt", "set_id", "n", "m"))
        free(spark)
    members = materialize(_memberships(held))
    several = members.groupBy("family").count().where("count > 1").select("family")
    members = materialize(members.join(several, "family", "left_semi"))
    free(spark)

    wanted = members.select("set_id").distinct()
    bits = survey.where("bits is not null").select("set_id", F.col("bits").alias("data"))
    bits = materialize(bits.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"]))
    close = _linked(members, bits, _close(percent), groups)
    free(spark)

    of_set = known.where("n > 0").groupBy("set_id").agg(F.min("key").alias("key"), F.first("n").alias("n"))
    chosen = materialize(of_set.join(close.select(F.col("node").alias("set_id"), F.col("root").alias("family")), "set_id"))
    near = chosen.select("set_id", "key")
    near = F.broadcast(near) if chosen.count() <= BROADCAST_IDS else near
    sets = texts.join(near, "key").select("set_id", "text").mapInArrow(_whole_sets(width), "set_id long, data binary")
    sets = materialize(sets.dropDuplicates(["set_id"]))
    roots = _linked(chosen.select("family", "set_id", "n"), sets, _compare(percent), groups)

    own, first = ["key"] * keys, F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key")))["key"].alias("component_key") if keys else None
    rooted = known.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "set_id")).alias("root"), *own)
    least = materialize(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), *([first] if keys else [])))
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *own, *(["component_key"] * keys))

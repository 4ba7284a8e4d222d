"""Mixing sources to target weights, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words;
a target stops at ``cap`` times its source's size and the excess is shared by weight among the
others, which is one water level found from sums over the sorted sources.

Schedule: slot k of the mix is the point frac(k * golden ratio). Where the point falls among the
cumulative target shares names the slot's source. The slots of a source are ranked, and slot r
of a source takes block r of its words: ``block`` consecutive words of the source's documents in
shuffled order, repeated as often as needed, up to ``cap`` times. So the points decide how many blocks a source
gives and where they stand: its words are its target within the points' discrepancy, a few blocks. Sources
whose target isn't ``LEAST`` blocks are scheduled among themselves in blocks that are ``STEP`` times
smaller, and so on down to blocks of one word, so that a few blocks are few words for them, too, and no such
source has more than ``LEAST`` times ``STEP`` blocks.

A source may hold any share of the rows: positions are sums over hash ranges of a source, whose
number grows with the input, and then within them; slots are ranked within ranges of slots. Sources
are few against rows: their table, one row each, is ordered in one task.

Defined cases: null text has size 0; a size-0 document takes 0; without any word all targets
are 0; equal rows stand one behind the other; texts of any length are cut to blocks; an empty table
gives no rows; other columns are ignored. Reruns give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.scratch import groups_for, materialize

GOLDEN = 0.6180339887498949
BLOCK = 1024
#: Blocks that a source's target has at least, unless they are of one word; how much smaller the next blocks are.
LEAST, STEP = 64, 4
#: Up to so many sources their table is broadcast (about 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Per source: source_no, source_size, weight, target, and the share of the mix below it."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("source_no", F.row_number().over(ordered).cast("long"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    by_ratio = Window.orderBy("ratio", "source_no")
    behind, everywhere = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing), Window.partitionBy()
    per = per.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    per = per.withColumns({
        "total": F.sum("source_size").over(everywhere).cast("double"),
        "below": F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weight_left": F.sum("weight").over(behind),
    })
    # The level if this source and all behind it are uncapped; the first that its own cap allows holds.
    level = (F.col("total") - F.col("below")) / F.col("weight_left")
    first = F.min(F.when(level <= F.col("ratio"), F.struct("ratio", "source_no", level.alias("level")))).over(everywhere)
    per = per.withColumn("level", first["level"])
    per = per.withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
    return per.select("source", "source_no", "source_size", "weight", "target", (F.round("target").cast("long")).alias("words"))


def sizes_of_blocks(block: int) -> list[int]:
    out = [block]
    while out[-1] > 1:
        out.append(max(1, out[-1] // STEP))
    return out


def block_of(words: int, block: int) -> int:
    """The block of a source that is to give ``words``."""
    return next((b for b in sizes_of_blocks(block) if words >= b * LEAST), 1)


def schedule(sources: DataFrame, n_sources: int, slots: int, own: int) -> DataFrame:
    """Rows (source_no, rank, slot): of ``slots`` slots, each a block of ``own`` words, which stands where
    in the mix (as a share of it), and is which one of its source's."""
    spark = sources.sparkSession
    span = max(256, int(slots**0.5))
    grid = max(4096, 4 * n_sources)
    # Cumulative shares by cell of a fixed grid, so that a point meets only the sources near it.
    by_number = Window.orderBy("source_no")
    whole = F.sum("target").over(Window.partitionBy())
    upto = F.sum("target").over(by_number.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / whole
    ranges = sources.where("words > 0").withColumn("high", upto)
    ranges = ranges.withColumn("low", F.coalesce(F.lag("high").over(by_number), F.lit(0.0)))
    last = F.lead("high").over(by_number).isNull()
    ranges = ranges.select("source_no", "low", F.when(last, F.lit(1.0)).otherwise(F.col("high")).alias("high"))
    cell = lambda x: F.least(F.floor(x * grid), F.lit(grid - 1))
    cells = ranges.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    point = F.col("slot") * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point - F.floor(point)).withColumn("cell", cell(F.col("point")))
    met = points.join(_small(cells, n_sources + grid), "cell").where("point >= low and point < high").select("slot", "source_no", F.floor(F.col("slot") / span).alias("span"))
    per_span = met.groupBy("source_no", "span").count()
    earlier = F.sum("count").over(Window.partitionBy("source_no").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    per_span = per_span.select("source_no", "span", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("source_no", "span").orderBy("slot"))
    ranked = met.withColumn("within", within - 1).join(per_span, ["source_no", "span"])
    return ranked.select("source_no", (F.col("earlier") + F.col("within")).alias("rank"), (F.col("slot") / F.lit(float(slots))).alias("slot"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, block: int = BLOCK, key: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target,
    taken: the words that the mix takes of it, repeats counted, at most ``cap`` times its size
    (``cap`` should be whole for that), n_slots: the blocks that hold some of them, first_slot: where the
    first of these stands, as a share of the mix. ``key`` names a column of unique longs that is returned too;
    rows are then told apart by their text, with null or repeated ids as well. See the module for
    the method and the defined cases."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("own"), *([F.col(key)] if key else []))
    parts = max(16, groups_for(docs.select("text"), 64))
    # By id and text, so that rows of a null or much repeated id are dealt to all parts.
    rows = rows.withColumn("mixed", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "own", F.lit("mix")))
    keys, told = ([key], ["own", key]) if key else ([], ["own"])
    sizes = materialize(rows.withColumn("part", F.pmod(F.shiftright("mixed", 20), F.lit(parts)).cast("int")))
    own = F.lit(1)
    for size in sizes_of_blocks(block)[::-1]:
        own = F.when(F.col("words") >= size * LEAST, F.lit(size)).otherwise(own)
    per = materialize(targets(sizes, weights, cap).withColumn("block", own.cast("long")))
    plans = []
    for r in per.where("words > 0").groupBy("block").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect():  # the sizes of blocks
        plans.append(schedule(per.where(F.col("block") == r["block"]), r["n"], -(-r["words"] // r["block"]), r["block"]))
    n_sources = per.count()
    plan = reduce(DataFrame.unionByName, plans) if plans else spark.createDataFrame([], "source_no long, rank long, slot double")
    plan = materialize(plan)
    most = F.least(F.coalesce("blocks", F.lit(0)) * F.col("block"), F.floor(F.lit(cap) * F.col("source_size")))
    per = per.join(_small(plan.groupBy("source_no").agg(F.count("*").alias("blocks")), n_sources), "source_no", "left").withColumn("words", most).drop("blocks")

    sizes = sizes.join(_small(per.withColumnRenamed("source", "of"), n_sources), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    by_part = sizes.groupBy("source_no", "part").agg(F.sum("size").alias("part_size"))
    begin = F.sum("part_size").over(Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    by_part = by_part.select("source_no", "part", F.coalesce(begin, F.lit(0)).alias("part_begin"))
    within = F.sum("size").over(Window.partitionBy("source_no", "part").orderBy("mixed", "doc_id", "size", *told).rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.withColumn("within", F.coalesce(within, F.lit(0))).join(by_part, ["source_no", "part"])
    placed = placed.withColumn("begin", F.col("part_begin") + F.col("within")).drop("part_begin", "within", "part", "mixed", "weight")

    rounds = F.sequence(F.lit(0), F.floor((F.col("words") - 1) / F.col("source_size")))
    pieces = placed.where("size > 0 and words > 0").withColumn("round", F.explode(rounds))
    pieces = pieces.withColumn("from", F.col("begin") + F.col("round") * F.col("source_size")).where("`from` < words")
    pieces = pieces.withColumn("to", F.least(F.col("from") + F.col("size"), "words"))
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / F.col("block")), F.floor((F.col("to") - 1) / F.col("block")))))
    overlap = F.least(F.col("to"), (F.col("rank") + 1) * F.col("block")) - F.greatest(F.col("from"), F.col("rank") * F.col("block"))
    taken = pieces.join(plan, ["source_no", "rank"]).groupBy("source_no", "begin").agg(F.sum(overlap).alias("got"), F.count("*").alias("met"), F.min("slot").alias("at"))
    some = placed.where("size > 0").join(taken, ["source_no", "begin"], "left")
    none = placed.where("size = 0").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("got", "long"), ("met", "long"), ("at", "double"))])  # they share their place
    out = some.unionByName(none)
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), F.coalesce("met", F.lit(0)).alias("n_slots"), F.col("at").alias("first_slot"), *keys)

"""The store on disk: tables in hash buckets of their key, of which an upsert rewrites what it touches.

A table is a folder of parquet files partitioned by ``bucket``. New rows replace those of the same key; only the
buckets of their keys are read and written, by dynamic partition overwrite, so the cost of a batch
follows the batch and not the table (with many more keys than buckets, choose more buckets). Upserts and
removals may be run again after a failure: they give the same table. Buckets are written with a rebalance
hint, so that a large one is several files by several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.extract import CANDIDATE, PAYLOAD
from quarry.operators.signals import SIGNAL
from quarry.scratch import _fs

BUCKETS = 64
#: Tables of a store and the key of their rows.
TABLES = {"signals": ("kind", "key"), "members": ("key", "what", "value"), "evidence": ("id",), "quarantine": ("id",), "views": ("view_id",)}
_LONGS, _KINDS = ("first_ms", "last_ms", "support", "published_ms"), {"trust": "int", "confidence": "double"}
_of = lambda names: ", ".join(f"`{c}` {'long' if c in _LONGS else _KINDS.get(c, 'string')}" for c in names)
SCHEMAS = {
    "signals": _of((*SIGNAL, "published_ms")), "members": _of(("key", "what", "value")),
    "evidence": _of(("id", "source_kind", "label", "project", "content", "content_hash", "trust", "observed")),
    "quarantine": _of((*(c for c in CANDIDATE if c in ("kind", "id", "evidence_id", "project", "confidence", "trust", "fingerprint", "key", *PAYLOAD)), "decision", "issues")),
    "views": _of(("view_id", "markdown")) + ", items long, ids array<string>",
}


def schema_of(spark: SparkSession, schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    """No rows of a schema, as the optimizer sees, so that joins with them are no work."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema_of(spark, schema).fields]).where("false")


def bucket_of(key: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")


def _names(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of each bucket folder."""
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        return {}
    folders = [s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith("bucket=")]
    return {f.getName(): sorted(s.getPath().getName() for s in fs.listStatus(f)) for f in folders}


def read(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """A table, or those of its buckets; empty where nothing was written."""
    whole = schema_of(spark, schema)
    if not _names(spark, path):
        return empty(spark, whole)
    rows = spark.read.schema(StructType(list(whole.fields)).add("bucket", "integer")).parquet(path)
    return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select(*whole.names)


def _write(rows: DataFrame, path: str, key: tuple[str, ...], buckets: int, touched: list[int]) -> None:
    spark, before = rows.sparkSession, _names(rows.sparkSession, path)
    dealt = rows.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    after, (fs, _) = _names(spark, path), _fs(spark, path)
    for k in touched:  # a bucket that no row is left of isn't written
        name = f"bucket={k}"
        if name in before and before[name] == after.get(name):
            fs.delete(_fs(spark, f"{path}/{name}")[1], True)


def upsert(path: str, new: DataFrame, schema: str, key: tuple[str, ...], gone: DataFrame | None = None, buckets: int = BUCKETS) -> list[int]:
    """Put the rows ``new`` (one of each key) in the place of those with their keys, and take out the keys of
    ``gone``. The buckets that were touched."""
    spark = new.sparkSession
    keys = new.select(*key)
    if gone is not None:
        keys = keys.unionByName(gone.select(*key))
    touched = sorted(r["bucket"] for r in keys.select(bucket_of(key, buckets)).distinct().collect())  # at most ``buckets``
    if touched:
        # Keys are compared null-safe, so that a null part of a key replaces a null.
        mine = keys.distinct().select(*[F.col(c).alias(f"_{c}") for c in key])
        same = F.lit(True)
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        left = read(spark, path, schema, touched).join(mine, same, "left_anti")
        _write(left.unionByName(new.select(*left.columns)), path, key, buckets, touched)
    return touched


class Store:
    """The tables of ``TABLES`` under one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def read(self, table: str) -> DataFrame:
        return read(self.spark, f"{self.path}/{table}", SCHEMAS[table])

    def upsert(self, table: str, new: DataFrame, gone: DataFrame | None = None) -> list[int]:
        whole = schema_of(self.spark, SCHEMAS[table])
        rows = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole.fields])
        return upsert(f"{self.path}/{table}", rows, SCHEMAS[table], TABLES[table], gone, self.buckets)

    def replace_kind(self, kind: str, new: DataFrame) -> list[int]:
        """The signals ``new`` instead of all of the kind."""
        old = self.read("signals").where(F.col("kind") == kind)
        return self.upsert("signals", new, old.join(new.select("key"), "key", "left_anti"))

    def publish(self, view: str, document: DataFrame, now_ms: Column) -> list[int]:
        """Put a view's document (markdown, ids) in the manifest, and on its signals when they were published.
        ``document`` has one row; its ids are as many as the view has items."""
        ids = document.select(F.explode("ids").alias("id")).distinct()
        shown = self.read("signals").join(F.broadcast(ids), "id", "left_semi").withColumn("published_ms", now_ms)
        self.upsert("views", document.select(F.lit(view).alias("view_id"), "markdown", F.size("ids").cast("long").alias("items"), "ids"))
        return self.upsert("signals", shown)

    def merged(self, kind: str, candidates: DataFrame, now_ms: Column) -> tuple[DataFrame, DataFrame]:
        """(signals, members) that a merge of ``candidates`` of a kind changes in the store."""
        from quarry.operators.signals import merge

        old, members = self.read("signals").where(F.col("kind") == kind), self.read("members")
        new, held = merge(candidates, kind, now_ms, old.drop("published_ms"), members)
        new = new.join(old.select("key", "published_ms"), "key", "left")
        same = old.select(*new.columns).exceptAll(old.select(*new.columns).exceptAll(new))
        changed = new.join(same.select("key"), "key", "left_anti")
        return changed, held.join(members, ["key", "what", "value"], "left_anti")

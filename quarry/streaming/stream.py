"""Incremental upkeep by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import store


def run_once(stream: DataFrame, path: str, each, mode: str = "append") -> None:
    """Process what is there in micro-batches, then stop; ``path`` keeps the offsets."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start().awaitTermination()


def upsert_available(spark: SparkSession, source: str, key: str, order: list[str], path: str) -> DataFrame:
    """The latest row of each key of a growing folder of files. State and offsets are under ``path``, so
    that the next call reads new files only and goes on from the state. The state is a bucketed table, of which a
    batch reads and rewrites the buckets of its keys; one that is run again after a failure changes nothing more."""
    schema = spark.read.parquet(source).schema
    best = F.max_by(F.struct(*schema.names), F.struct(*order)).alias("row")
    latest = lambda rows: rows.groupBy(key).agg(best).select("row.*")

    def each(batch: DataFrame, number: int) -> None:
        new = latest(batch).persist()
        touched = [r["bucket"] for r in new.select(store.bucket_of((key,), store.BUCKETS)).distinct().collect()]  # at most so many
        old = store.read(batch.sparkSession, f"{path}/state", schema, touched)
        store.upsert(f"{path}/state", latest(new.unionByName(old.join(new.select(key), key, "left_semi"))), schema, (key,))
        new.unpersist()

    run_once(spark.readStream.schema(schema).parquet(source), path, each)
    return store.read(spark, f"{path}/state", schema)


def windowed_activity(stream: DataFrame, time: str, key: str, late: str = "1 day", width: str = "7 days", step: str = "1 day") -> DataFrame:
    """Events by key in sliding windows, with late data allowed for; on a batch the same windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, step).alias("w"), key).agg(F.count("*").alias("n"))

"""State between runs: versioned tables, marks of how far sources were read, and finished stages.

A version is a folder that is complete once Spark has written its success file. A later version
replaces an earlier one, which is kept until the next is complete; a version that can't be read is set
aside under a name with ``corrupt``, and the one before it, or an empty table, is the state.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
    done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    return sorted(n for n in done if fs.exists(_fs(spark, f"{path}/v{n}/_SUCCESS")[1]))


def save(rows: DataFrame, path: str, number: int | None = None) -> int:
    """Write a version, the next one or ``number``; older ones than the one before it go."""
    spark = rows.sparkSession
    have = versions(spark, path)
    number = number if number is not None else (have[-1] + 1 if have else 0)
    rows.write.mode("overwrite").parquet(f"{path}/v{number}")
    for old in [n for n in have if n < number][:-1]:
        fs, place = _fs(spark, f"{path}/v{old}")
        fs.delete(place, True)
    return number


def load(spark: SparkSession, path: str, schema, below: int | None = None) -> DataFrame:
    """The latest version (less than ``below``, if given) that can be read; an empty table without one."""
    for number in reversed([n for n in versions(spark, path) if below is None or n < below]):
        try:
            rows = spark.read.parquet(f"{path}/v{number}")
            wanted = spark.createDataFrame([], schema).schema
            if set(wanted.names) <= set(rows.columns):
                rows.select(*wanted.names).limit(1).collect()
                return spark.read.schema(wanted).parquet(f"{path}/v{number}")
        except (PySparkException, Py4JJavaError):
            pass
        fs, place = _fs(spark, f"{path}/v{number}")
        fs.rename(place, _fs(spark, f"{path}/corrupt-v{number}")[1])
    return spark.createDataFrame([], schema)


def advanced(old: DataFrame, seen: DataFrame) -> DataFrame:
    """How far each source was read, (source, ms): never back, and kept for sources that say nothing."""
    return old.unionByName(seen).groupBy("source").agg(F.max("ms").alias("ms"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, hash, state) of two sets of (id, hash): same, changed, new, or gone, whose outputs go, too."""
    met = old.withColumnRenamed("hash", "old_hash").join(new, "id", "full")
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("hash").isNull(), "gone").when(F.col("hash") == F.col("old_hash"), "same").otherwise("changed")
    return met.select("id", F.coalesce("hash", "old_hash").alias("hash"), state.alias("state"))


def staged(spark: SparkSession, path: str, stage: str, rows) -> DataFrame:
    """The table of a finished stage, or what the function ``rows`` gives, written as it; so a run that
    stopped goes on behind its last finished stage."""
    place = f"{path}/{stage}"
    if not versions(spark, place):
        save(rows(), place, 0)
    return spark.read.parquet(f"{place}/v{versions(spark, place)[-1]}")

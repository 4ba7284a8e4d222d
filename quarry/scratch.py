"""Intermediate tables in the folder that all executors share.

A table written here cuts lineage: it survives the loss of any executor and is read back
instead of being computed again. The folder is ``spark.checkpoint.dir``; only on one machine
(master ``local``) and where that is unset, a folder of this session is made and set. What a ``passing``
block wrote goes at its end, all else when the session ends.
"""

from __future__ import annotations

import gc
import math
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_UNKNOWN = 1 << 60
#: By thread, the paths written in each of its open ``passing`` blocks, the innermost last.
_open: dict[int, tuple[list[str], ...]] = {}
_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one, which goes when its driver ends."""
    path = f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}"
    if path not in _folders:
        fs, place = _fs(spark, path)
        fs.mkdirs(place)
        fs.deleteOnExit(place)
        _folders.add(path)
    return path


def new_path(spark: SparkSession) -> str:
    """A path that nothing was written to, on the list of the innermost open block."""
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    if blocks := _open.get(threading.get_ident()):
        blocks[-1].append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a reader of what was written."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def free(spark: SparkSession) -> None:
    """Let the files of shuffles go whose results have been written: the driver drops them when it
    collects what nothing refers to any more, which it may put off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialize`` writes in this block are deleted at its end. The function given
    writes a result that stays (for the block around this one, if there is one)."""
    own: list[str] = []
    thread = threading.get_ident()
    outer = _open.get(thread, ())
    _open[thread] = (*outer, own)

    def keep(df: DataFrame) -> DataFrame:
        inner = _open.get(thread, ())
        _open[thread] = outer
        try:
            return materialize(df)
        finally:
            _open[thread] = inner

    try:
        yield keep
    finally:
        if outer:
            _open[thread] = outer
        else:
            _open.pop(thread, None)
        for path in own:
            delete(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def groups_for(df: DataFrame, mb: int = 16, per_partition: int = 4) -> int:
    """Into how many groups an operator should deal ``df``: a group holds about ``mb`` MB by the
    optimizer's size estimate, and every shuffle partition gets several groups, so that chance
    does not load one partition much above the mean. Grows with the input without bound."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = 0 if size >= _UNKNOWN else math.ceil(size / (mb << 20))
    return max(per_partition * shuffle_partitions(df.sparkSession), by_size)

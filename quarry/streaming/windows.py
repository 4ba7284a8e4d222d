"""Counts in sliding windows of a stream, with windows that close and events that come too late.

A key's state holds the counts of its open windows. The engine's watermark, the latest time of earlier batches
less ``late``, closes a window whose end it has passed: a timer puts its count out for good and its
state goes, so that state holds the windows of about ``late`` and ``width`` only, however long the stream.
An event counts in those of its windows that are still open; one whose windows are all closed is late and is
counted as such. In update mode open windows that changed are put out, too.

A batch's open windows replace what earlier batches said of them in a bucketed table, of which only the
buckets of changed windows are rewritten; a batch that is run again says the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators import store
from quarry.streaming.merge import stateful

OUT = "what string, key string, begin_ms long, n long"
WINDOWS, LATE = "key string, begin_ms long, n long, what string", "key string, batch long, n long"


class Windows(StatefulProcessor):
    """The open windows of one key."""

    def __init__(self, width_ms: int, step_ms: int) -> None:
        self.width, self.step = width_ms, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.counts = handle, handle.getMapState("counts", "begin_ms long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() or -(1 << 62)  # 0 before the first batch
        late, new = 0, {}
        for frame in rows:
            at = frame["ms"].to_numpy(np.int64)
            first = at - at % self.step
            late += int((first + self.width <= passed).sum())
            for back in range(0, self.width, self.step):
                begin = first - back
                begin, n = np.unique(begin[(begin + self.width > at) & (begin + self.width > passed)], return_counts=True)
                for b, k in zip(begin.tolist(), n.tolist(), strict=True):
                    new[b] = new.get(b, 0) + k
        out = []
        for begin, n in sorted(new.items()):
            place = (begin,)
            if self.counts.containsKey(place):
                n += self.counts.getValue(place)[0]
            else:
                self.handle.registerTimer(begin + self.width)
            self.counts.updateValue(place, (n,))
            out.append(("open", key[0], begin, n))
        if late:
            out.append(("late", key[0], None, late))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"begin_ms": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begin = expiredTimerInfo.getExpiryTimeInMs() - self.width
        if self.counts.containsKey((begin,)):
            n = self.counts.getValue((begin,))[0]
            self.counts.removeKey((begin,))
            yield pd.DataFrame([("closed", key[0], begin, n)], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def counted(stream: DataFrame, time: str, key: str, late: str, width_ms: int, step_ms: int) -> DataFrame:
    """The rows of OUT that a stream gives; rows without a time or key are in no window."""
    rows = stream.withWatermark(time, late).where(F.col(time).isNotNull() & F.col(key).isNotNull())
    # Milliseconds without the time's mark: late rows are counted by the operator instead of being dropped before it.
    rows = rows.select(F.col(key).cast("string").alias("key"), F.unix_millis(time).alias("ms"))
    return rows.groupBy("key").transformWithStateInPandas(Windows(width_ms, step_ms), OUT, "update", "EventTime")


def windows_available(spark: SparkSession, source: str, time: str, key: str, path: str, late: str = "1 day", width_ms: int = 7 * 86_400_000, step_ms: int = 86_400_000, files: int | None = None, partitions: int | None = None) -> tuple[DataFrame, DataFrame, list[int]]:
    """Count what is new in a growing folder of files and stop: (windows, late, state): windows
    (key, begin_ms, n, what: open or closed), late events (key, batch, n), and how many rows of state each batch left.
    ``files``: so many files a batch at most. ``partitions``: of the state, when the stream begins."""
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    rows = reader.parquet(source).withColumn(time, F.col(time).cast("timestamp"))

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        # A window that closes in the batch in which it also grew is closed.
        last = held.where("what <> 'late'").groupBy("key", "begin_ms").agg(F.min_by(F.struct("n", "what"), F.col("what")).alias("w")).select("key", "begin_ms", "w.*")
        store.upsert(f"{path}/windows", last, WINDOWS, ("key", "begin_ms"))
        tardy = held.where("what = 'late'").groupBy("key").agg(F.sum("n").alias("n")).withColumn("batch", F.lit(number).cast("long"))
        store.upsert(f"{path}/late", tardy, LATE, ("key", "batch"))
        held.unpersist()

    with stateful(spark, partitions):
        query = counted(rows, time, key, late, width_ms, step_ms).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()
    held = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]
    return store.read(spark, f"{path}/windows", WINDOWS), store.read(spark, f"{path}/late", LATE), held

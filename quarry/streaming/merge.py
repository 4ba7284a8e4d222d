"""Merge of a stream of candidates into signals, one state for each canonical key.

An event is a candidate with ``op`` 'add' or 'retract'. A key's state holds its members by id, how many
members rest on each evidence, and the signal that they give. An added member moves the
signal by itself; members are gone through again only when one is taken back that the signal
may owe something to. An event that was seen before changes nothing, so batches may be repeated.
Within a batch retractions come last; what is added again after one is a member again.
Signals that an event changed are put out; a key without members puts out a row with ``gone``.

State is in RocksDB on the executors and in the checkpoint folder: a restart goes on behind the last
finished batch, and a batch that is run again gives the same rows, which the store takes twice
without harm. A hot key's events are one task's, as any state's, but cost the same each.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quarry.operators import signals
from quarry.operators.extract import PAYLOAD
from quarry.operators.store import SCHEMAS, TABLES, read, upsert

EVENT = ("op", "kind", "key", "id", *PAYLOAD, "trust", "confidence", "ms", "evidence_id", "project")
#: What a member may lend its signal.
MEMBER = ", ".join([*(f"{c} string" for c in PAYLOAD), "trust int", "confidence double", "ms long", "evidence_id string", "project string"])
STATE = "kind string, id string, " + ", ".join(f"{c} string" for c in PAYLOAD) + ", best_trust int, best_confidence double, best_ms long, trust int, confidence double, first_ms long, last_ms long, project string, members long, support long"
OUT = "kind string, key string, id string, " + ", ".join(f"{c} string" for c in PAYLOAD) + ", trust int, confidence double, first_ms long, last_ms long, support long, project string, gone boolean"
_MEMBER = [c.split()[0] for c in MEMBER.split(", ")]
_STATE = [c.split()[0] for c in STATE.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rank(trust: int, confidence: float, ms: int, id_: str):
    return (-trust, -confidence, -ms, id_)


def _taken(signal: dict | None, kind: str, id_: str, member: dict) -> dict:
    """The signal with one member more."""
    own = _rank(member["trust"], member["confidence"], member["ms"], id_)
    if signal is None:
        signal = {"members": 0, "support": 0, "trust": member["trust"], "confidence": member["confidence"], "first_ms": member["ms"], "last_ms": member["ms"], "project": member["project"]}
    out = dict(signal, members=signal["members"] + 1)
    if "id" not in signal or own < _rank(signal["best_trust"], signal["best_confidence"], signal["best_ms"], signal["id"]):
        out |= {"kind": kind, "id": id_, **{c: member[c] for c in PAYLOAD}, "best_trust": member["trust"], "best_confidence": member["confidence"], "best_ms": member["ms"]}
    projects = [p for p in (signal["project"], member["project"]) if p is not None]
    return out | {
        "trust": max(signal["trust"], member["trust"]), "confidence": max(signal["confidence"], member["confidence"]), "first_ms": min(signal["first_ms"], member["ms"]),
        "last_ms": max(signal["last_ms"], member["ms"]), "project": min(projects) if projects else None,
    }


class Merger(StatefulProcessor):
    """A key's members, evidence and signal."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.signal = handle.getValueState("signal", STATE)
        self.members = handle.getMapState("members", "id string", MEMBER)
        self.evidence = handle.getMapState("evidence", "evidence_id string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = dict(zip(_STATE, self.signal.get(), strict=True)) if self.signal.exists() else None
        now, again, back = before, False, []
        for frame in rows:
            for event in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                if event["op"] == "retract":
                    back.append(event["id"])
                elif not self.members.containsKey((event["id"],)):
                    member = {c: event[c] for c in _MEMBER}
                    self.members.updateValue((event["id"],), tuple(member.values()))
                    now = _taken(now, event["kind"], event["id"], member)
                    now["support"] += self._rests(member["evidence_id"], 1)
        for id_ in back:
            if self.members.containsKey((id_,)):
                had = dict(zip(_MEMBER, self.members.getValue((id_,)), strict=True))
                self.members.removeKey((id_,))
                again = again or self._owes(now, id_, had)
                now = dict(now, members=now["members"] - 1, support=now["support"] - self._rests(had["evidence_id"], -1))
        if now is not None and again and now["members"]:
            support, kind, now = now["support"], now["kind"], None
            for (id_,), held in self.members.iterator():
                now = _taken(now, kind, id_, dict(zip(_MEMBER, held, strict=True)))
            now["support"] = support
        if now == before:
            return
        gone = not now["members"]
        if gone:
            self.signal.clear()
        else:
            self.signal.update(tuple(now[c] for c in _STATE))
        yield pd.DataFrame([[now["kind"], key[0], now["id"], *(now[c] for c in PAYLOAD), now["trust"], now["confidence"], now["first_ms"], now["last_ms"], now["support"], now["project"], gone]], columns=[c.split()[0] for c in OUT.split(", ")])

    @staticmethod
    def _owes(signal: dict, id_: str, member: dict) -> bool:
        return id_ == signal["id"] or any(member[c] == signal[c] for c in ("trust", "confidence", "project")) or member["ms"] in (signal["first_ms"], signal["last_ms"])

    def _rests(self, evidence_id: str | None, more: int) -> int:
        """Count a member for its evidence; 1 if it is the first, or was the last, to rest on it."""
        if evidence_id is None:
            return 0
        place = (evidence_id,)
        n = (self.evidence.getValue(place)[0] if self.evidence.containsKey(place) else 0) + more
        if n:
            self.evidence.updateValue(place, (n,))
        else:
            self.evidence.removeKey(place)
        return int(n == (1 if more > 0 else 0))

    def close(self) -> None:
        pass


@contextmanager
def stateful(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams that begin in this block keep their state in RocksDB, as stateful operators need, and write its
    changes, not whole copies, with each batch. ``partitions``: of their state, for as long as they live."""
    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    own |= {} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)}
    given = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in given.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def events(candidates: DataFrame, now_ms: Column, op: str = "add") -> DataFrame:
    """Candidates as events of the stream."""
    ms = signals.seen_ms(F.col("observed"), now_ms).alias("ms")
    return candidates.select(F.lit(op).alias("op"), *[ms if c == "ms" else F.col(c) for c in EVENT[1:]])


def merge_available(spark: SparkSession, source: str, path: str, buckets: int = 64, partitions: int | None = None) -> DataFrame:
    """Merge what is new in the folder ``source`` of events (parquet) into the signals under ``path``, and stop:
    the signals of all kinds. Each batch rewrites only the buckets of the store that its signals are in. ``partitions``:
    of the state, when the stream begins."""
    schema = StructType([f for f in spark.read.parquet(source).schema.fields if f.name in EVENT])
    stream = spark.readStream.schema(schema).parquet(source).where("key is not null and id is not null")
    with stateful(spark, partitions):
        changed = stream.groupBy("key").transformWithStateInPandas(Merger(), OUT, "update", "none")

        def each(batch: DataFrame, number: int) -> None:
            rows = batch.persist()
            new = rows.where("not gone").withColumns({"summary": signals.summary(F.col("kind")), "status": F.lit("active"), "published_ms": F.lit(None).cast("long")})
            upsert(f"{path}/signals", new, SCHEMAS["signals"], TABLES["signals"], rows.where("gone"), buckets)
            rows.unpersist()

        changed.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start().awaitTermination()
    return read(spark, f"{path}/signals", SCHEMAS["signals"])

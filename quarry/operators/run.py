"""A run: stages whose tables, marks and store become visible together, or not at all.

A run works in a folder of its own. Each stage's table is written there once, so that a run that was broken
goes on behind its last finished stage. What the run changes in the store and in the state (marks, processed ids, hashes
of notes) is written there, too, as tables of upserts and removals. One small file, made by a rename, commits
the run. Only then is it applied; applying is idempotent, and whoever opens the state first applies a
committed run that isn't marked as done. A run without the file leaves no trace but its folder, which the
next attempt goes on from.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import state, store
from quarry.scratch import _fs, delete

#: Tables of the state beside the store's, and their keys.
STATE = {"marks": ("source",), "processed": ("id",), "hashes": ("id",)}
SCHEMAS = {"marks": "source string, ms long", "processed": "id string", "hashes": "id string, hash string"}
ALL = {**{k: (store.SCHEMAS[k], key) for k, key in store.TABLES.items()}, **{k: (SCHEMAS[k], key) for k, key in STATE.items()}}


@dataclass
class Run:
    """One attempt: the stages done so far and what it is to change."""

    spark: SparkSession
    root: str
    number: int
    changes: list[str] = field(default_factory=list)

    @property
    def path(self) -> str:
        return f"{self.root}/runs/{self.number}"

    def stage(self, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table: of an attempt before this one, if it finished it, else of ``rows``, which is written."""
        return state.staged(self.spark, f"{self.path}/stages", name, rows)

    def change(self, table: str, new: Callable[[], DataFrame], gone: Callable[[], DataFrame] | None = None) -> None:
        """Rows to put in a table of ``ALL``, and rows whose keys are to go, when the run is committed."""
        schema, key = ALL[table]
        whole = store.schema_of(self.spark, schema)

        def cut() -> DataFrame:
            rows = new()
            return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole.fields])

        self.stage(f"put-{table}", cut)
        self.stage(f"gone-{table}", lambda: (gone() if gone is not None else store.empty(self.spark, schema)).select(*key))
        self.changes.append(table)

    def commit(self) -> None:
        """All changes at once: after this the run is part of the state, whatever happens."""
        fs, place = _fs(self.spark, f"{self.path}/committed")
        made = _fs(self.spark, f"{self.path}/committed-{self.number}-new")[1]
        out = fs.create(made, True)
        out.write(bytearray("\n".join(self.changes).encode()))
        out.close()
        if not fs.rename(made, place):
            raise RuntimeError(f"run {self.number} was committed by another")
        recover(self.spark, self.root)


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, place = _fs(spark, f"{root}/runs")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(place)) if fs.exists(place) else []


def _there(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def _apply(spark: SparkSession, root: str, number: int, buckets: int) -> None:
    path = f"{root}/runs/{number}"
    names = [r["value"] for r in spark.read.text(f"{path}/committed").collect() if r["value"]]
    for table in names:  # at most the tables of ALL
        schema, key = ALL[table]
        put, gone = (spark.read.parquet(f"{path}/stages/{kind}-{table}/v0") for kind in ("put", "gone"))
        store.upsert(f"{root}/{table}", put, schema, key, gone, buckets)
    fs, place = _fs(spark, f"{path}/applied")
    fs.create(place, True).close()


def recover(spark: SparkSession, root: str, buckets: int = store.BUCKETS) -> list[int]:
    """Apply runs that are committed but not applied, in order; the folders of earlier ones go."""
    done = []
    numbers = _numbers(spark, root)
    for number in numbers:
        path = f"{root}/runs/{number}"
        if _there(spark, f"{path}/committed") and not _there(spark, f"{path}/applied"):
            _apply(spark, root, number, buckets)
            done.append(number)
        if _there(spark, f"{path}/applied") and number != numbers[-1]:
            delete(spark, path)
    return done


def begin(spark: SparkSession, root: str) -> Run:
    """The run to go on with: one that was begun and not committed, else a new one."""
    recover(spark, root)
    numbers = _numbers(spark, root)
    open_ = [n for n in numbers if not _there(spark, f"{root}/runs/{n}/committed")]
    return Run(spark, root, open_[0] if open_ else (numbers[-1] + 1 if numbers else 0))


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table as of the last committed run."""
    recover(spark, root)
    return store.read(spark, f"{root}/{table}", ALL[table][0])

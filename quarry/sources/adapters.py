"""Adapters: sources of sessions behind one set of schemas, and a registry that reads all that are there.

An adapter says whether its source exists and gives projects, sessions, messages and open todos as tables of
fixed columns, later than a mark if one is given. What a mark leaves out isn't read: files of logs
by their time of writing, before they are opened, rows of tables by a filter that reaches their scan. Files
are read by Spark's own readers, in any store that Spark reads.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import readers

PROJECTS = "source string, project_id string, name string, path string"
SESSIONS = "source string, project_id string, session_id string, title string, ts_ms long, messages long"
MESSAGES = "source string, session_id string, idx long, role string, content string"
TODOS = "source string, session_id string, content string, status string"
Marks = dict[str, int]


def shaped(rows: DataFrame, source: str, schema: str) -> DataFrame:
    """``rows`` with the columns of a schema, in its types; missing ones are null."""
    columns = [c.split() for c in schema.split(", ")]
    return rows.withColumn("source", F.lit(source)).select(*[(F.col(c) if c in (*rows.columns, "source") else F.lit(None)).cast(t).alias(c) for c, t in columns])


class LogAdapter:
    """Session logs in a folder. Its mark is the time that files were written, so that a session that
    goes on is read again, whole. ``options``: as of ``readers.read_lines``."""

    def __init__(self, spark: SparkSession, name: str, path: str, **options) -> None:
        self.spark, self.name, self.path, self.options = spark, name, path, options

    def detect(self) -> bool:
        return readers.exists(self.spark, self.path)

    def _summaries(self, since_ms: int | None) -> DataFrame:
        return readers.summarise_logs(self.spark, self.path, since_ms=since_ms, **self.options).where("session_id is not null")

    def projects(self) -> DataFrame:
        own = readers.projects_of(self._summaries(None))
        return shaped(own.select("project_id", F.col("project").alias("name"), F.col("project_path").alias("path")), self.name, PROJECTS)

    def sessions(self, since_ms: int | None = None) -> DataFrame:
        return shaped(self._summaries(since_ms).withColumn("ts_ms", F.col("first_ms")), self.name, SESSIONS)

    def messages(self, since_ms: int | None = None) -> DataFrame:
        rows = readers.read_session_logs(self.spark, self.path, since_ms=since_ms, **self.options)
        return shaped(rows.where("session_id is not null"), self.name, MESSAGES)

    def todos(self) -> DataFrame:
        return self.spark.createDataFrame([], TODOS)

    def mark(self) -> int | None:
        """The latest time at which a file was written."""
        lines = readers.read_lines(self.spark, self.path, **self.options)
        return lines.agg(F.max(F.unix_millis("modified"))).first()[0]


class TableAdapter:
    """Tables of a relational source, each by a function that gives its rows: ``projects`` (id, worktree,
    name), ``sessions`` (project_id, session_id, title, ts_ms), ``messages`` (session, message, data, ts_ms), ``parts``
    (message, data, part_ms, part), ``todos`` (session, content, status)."""

    def __init__(self, spark: SparkSession, name: str, tables: dict[str, Callable[[], DataFrame]], there: Callable[[], bool] = lambda: True) -> None:
        self.spark, self.name, self.tables, self.there = spark, name, tables, there

    def detect(self) -> bool:
        return self.there()

    def projects(self) -> DataFrame:
        return shaped(readers.projects(self.tables["projects"]()).withColumnRenamed("id", "project_id"), self.name, PROJECTS)

    def _since(self, since_ms: int | None) -> DataFrame:
        rows = self.tables["sessions"]()
        return rows if since_ms is None else rows.where(F.col("ts_ms") > since_ms)

    def sessions(self, since_ms: int | None = None) -> DataFrame:
        counts = self.tables["messages"]().groupBy(F.col("session").alias("session_id")).agg(F.count("*").alias("messages"))
        rows = self._since(since_ms).join(counts, "session_id", "left")
        return shaped(rows.withColumn("messages", F.coalesce("messages", F.lit(0))), self.name, SESSIONS)

    def messages(self, since_ms: int | None = None) -> DataFrame:
        messages, parts = self.tables["messages"](), self.tables["parts"]()
        if since_ms is not None:
            messages = messages.join(self._since(since_ms).select(F.col("session_id").alias("session")), "session", "left_semi")
            parts = parts.join(messages.select("message"), "message", "left_semi")
        rows = readers.assembled(messages, parts)
        listed = rows.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "message", "role", "content"))).alias("all"))
        return shaped(listed.select(F.col("session").alias("session_id"), F.posexplode("all").alias("idx", "m")).select("session_id", "idx", "m.role", "m.content"), self.name, MESSAGES)

    def todos(self) -> DataFrame:
        return shaped(self.tables["todos"]().where("status in ('pending', 'in_progress')").withColumnRenamed("session", "session_id"), self.name, TODOS)

    def mark(self) -> int | None:
        return self.tables["sessions"]().agg(F.max("ts_ms")).first()[0]


class Registry:
    """The adapters that are registered, of which those whose source is there are read together."""

    def __init__(self, spark: SparkSession, labels: dict[str, str] | None = None) -> None:
        self.spark, self.labels, self.adapters = spark, labels, []

    def register(self, adapter) -> Registry:
        if any(a.name == adapter.name for a in self.adapters):
            raise ValueError(f"two adapters of the name {adapter.name}")
        self.adapters.append(adapter)
        return self

    def active(self) -> list:
        return [a for a in self.adapters if a.detect()]

    def _all(self, schema: str, rows) -> DataFrame:
        return reduce(DataFrame.unionByName, map(rows, self.active()), self.spark.createDataFrame([], schema))

    def projects(self) -> DataFrame:
        return self._all(PROJECTS, lambda a: a.projects())

    def merged_projects(self) -> DataFrame:
        """Projects by path: named as the first adapter's, with the sources that have it."""
        place = F.array_position(F.array(*[F.lit(a.name) for a in self.adapters]), F.col("source"))
        rows = self.projects().withColumn("place", place)
        per = rows.groupBy("path").agg(F.min_by("name", F.struct("place", "project_id")).alias("name"), F.array_sort(F.collect_set(F.struct("place", "source", "project_id"))).alias("all"))
        return per.select("path", "name", F.transform("all", lambda x: F.struct(x["source"].alias("source"), x["project_id"].alias("project_id"))).alias("sources"))

    def sessions(self, marks: Marks | None = None) -> DataFrame:
        rows = self._all(SESSIONS, lambda a: a.sessions((marks or {}).get(a.name)))
        return rows.withColumn("label", readers.source_label(F.col("source"), self.labels))

    def messages(self, marks: Marks | None = None) -> DataFrame:
        return self._all(MESSAGES, lambda a: a.messages((marks or {}).get(a.name)))

    def todos(self) -> DataFrame:
        return self._all(TODOS, lambda a: a.todos())

    def marks(self, old: Marks | None = None) -> Marks:
        """How far each source goes now: never back, and kept for sources that are silent or gone."""
        new = {a.name: a.mark() for a in self.active()}
        return {k: max(x for x in ((old or {}).get(k), new.get(k)) if x is not None) for k in {*(old or {}), *new} if (old or {}).get(k) is not None or new.get(k) is not None}

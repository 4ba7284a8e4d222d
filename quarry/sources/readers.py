"""Sources: tables bound to sessions, messages and projects, and readers of logs, todos and notes.

A missing source is an empty table of the same schema. Logs are read line by line, so that one file
may be split; a line's place is the start of its split and its number there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.sources import yaml

LINES = "session_id string, dir string, place struct<block:long,at:long>, line string, modified timestamp"
EVENT = "type string, timestamp string, durationMs long, summary string, content string, message struct<role:string,content:string>"
BLOCKS = "array<struct<type:string,text:string>>"
TODO = "array<struct<content:string,status:string,priority:string>>"
#: The labels of known sources; others are shown in upper case.
SOURCE_LABELS = {"opencode": "OC", "claude-code": "CC"}
UNTITLED_SESSION, TITLE_CHARS, NOTE_BYTES = "(untitled session)", 80, 1 << 20


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a source is there; any file system that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(ts):
    return F.unix_millis(ts.cast("timestamp"))


def source_label(source: Column, labels: dict[str, str] | None = None) -> Column:
    """The configured label of a source, whose key may have _ for -, or its name in upper case."""
    out = F
    for key, label in (SOURCE_LABELS if labels is None else {k.replace("_", "-"): v for k, v in labels.items()}).items():
        out = out.when(source == key, label)
    return out.otherwise(F.upper(source)) if out is not F else F.upper(source)


# --- relational source -------------------------------------------------------------------------------


def projects(rows: DataFrame) -> DataFrame:
    """Of (id, worktree, name): projects, named by the last part of their path if they have no name."""
    return rows.select("id", F.coalesce("name", text.path_title(F.col("worktree"))).alias("name"), F.col("worktree").alias("path"))


def with_churn(rows: DataFrame) -> DataFrame:
    """Sessions with ``churn`` (additions, deletions, files), null if none of the three is known, missing ones 0."""
    parts = ("additions", "deletions", "files")
    known = F.coalesce(*[F.col(f"summary_{p}") for p in parts]).isNotNull()
    return rows.withColumn("churn", F.when(known, F.struct(*[F.coalesce(f"summary_{p}", F.lit(0)).alias(p) for p in parts])))


def sessions_since(rows: DataFrame, messages: DataFrame, since_ms: Column) -> DataFrame:
    """Sessions (session, project, ts_ms) later than the mark of their source, with their number of messages."""
    counts = messages.groupBy("session").agg(F.count("*").alias("messages"))
    return rows.where(F.col("ts_ms") > since_ms).join(counts, "session", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def part_text(data: Column) -> Column:
    """Text of a message part: a JSON string, or the ``text`` of an object if it isn't empty; else null."""
    plain = F.from_json(F.concat(F.lit("["), data, F.lit("]")), "array<string>")
    return F.when(data.startswith('"'), F.try_element_at(plain, F.lit(1))).otherwise(F.nullif(F.get_json_object(data, "$.text"), F.lit("")))


def assembled(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(session, message, role, content, ts_ms) of (session, message, data, ts_ms) and parts (message,
    data, part_ms, part): texts by (time, part), joined by newlines (ties by text); a role that is no ``assistant``, or
    broken JSON, is the user's; a message without text is empty."""
    said = parts.withColumn("said", part_text(F.col("data"))).where("said is not null")
    texts = said.groupBy("message").agg(F.array_sort(F.collect_list(F.struct("part_ms", "part", "said"))).alias("all"))
    role = F.when(F.get_json_object("data", "$.role") == "assistant", "assistant").otherwise("user")
    content = F.coalesce(F.array_join(F.transform("all", lambda x: x["said"]), "\n"), F.lit(""))
    return messages.withColumn("role", role).join(texts, "message", "left").select("session", "message", "role", content.alias("content"), "ts_ms")


def todos_with_time(todos: DataFrame, sessions: DataFrame) -> DataFrame:
    """Open todos (session, content, status) with their session's time, null if there is no such session."""
    return todos.where("status in ('pending', 'in_progress')").join(sessions.select("session", "ts_ms"), "session", "left")


def of_projects(sessions: DataFrame, bridge: DataFrame) -> DataFrame:
    """Sessions (source, project_id, ...) of merged projects, by bridge (path, source, project_id)."""
    return sessions.join(bridge, ["source", "project_id"])


# --- session logs --------------------------------------------------------------------------------------


def block_text(s):
    """Text of a JSON string or of the text blocks of a JSON array, joined by newlines."""
    blocks = F.from_json(s, BLOCKS)
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(s.startswith("["), F.array_join(texts, "\n")).otherwise(s)


def read_lines(spark: SparkSession, path: str, files: str = "*.jsonl", session: str = r"([^/]+)\.jsonl$", since_ms: int | None = None) -> DataFrame:
    """Lines of session logs, one file a session, in folders named by their project's path. ``session``:
    what of a file's path names the session, or, from a $ on, the field of a line that does, where a file holds many
    sessions. Of files that were last written before ``since_ms``, to the second, none is opened."""
    if not exists(spark, path):
        return spark.createDataFrame([], LINES)
    reader = spark.read.option("pathGlobFilter", files).option("recursiveFileLookup", "true")
    if since_ms is not None:
        after = datetime.fromtimestamp(since_ms // 1000 - 1, UTC)
        reader = reader.option("modifiedAfter", after.strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    lines = reader.text(path)
    name = F.col("_metadata.file_path")
    own = F.get_json_object("value", session) if session.startswith("$") else F.regexp_extract(name, session, 1)
    rows = lines.select(
        own.alias("session_id"), F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("dir"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"), F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("modified"),
    )
    return rows.where(F.trim("line") != "")


def corrupt_lines(lines: DataFrame) -> DataFrame:
    """By session how many lines there are, and how many of them are no JSON object."""
    ok = F.col("line").rlike(r"^\s*\{") & F.try_parse_json("line").isNotNull()
    return lines.groupBy("session_id").agg(F.count("*").alias("lines"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("corrupt"))


def events(lines: DataFrame) -> DataFrame:
    """Events of the lines that are JSON objects with a type."""
    return lines.withColumn("e", F.from_json("line", EVENT)).where("e.type is not null").drop("line")


def read_session_logs(spark: SparkSession, path: str, **files) -> DataFrame:
    """Messages: user events take a string, or the nested message; assistant events also text blocks at
    the top. Events without either are no messages. ``idx`` counts a session's messages from 0.
    ``files``: as of ``read_lines``."""
    from pyspark.sql import Window

    rows = events(read_lines(spark, path, **files))
    role = F.when(F.col("e.type").isin("human", "user"), "user").when(F.col("e.type") == "assistant", "assistant")
    own, nested = F.col("e.content"), F.col("e.message.content")
    said = F.when(role == "user", F.when(own.startswith("["), None).otherwise(own)).otherwise(block_text(own))
    content = F.coalesce(said, block_text(nested))
    at = F.unix_millis(F.try_to_timestamp(F.col("e.timestamp")))
    rows = rows.where(role.isNotNull()).select("session_id", "place", role.alias("role"), content.alias("content"), F.coalesce(at, F.lit(0)).alias("ts_ms")).where("content is not null")
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("session_id").orderBy("place")) - 1).drop("place")


def summarise_logs(spark: SparkSession, path: str, **files) -> DataFrame:
    """Sessions: project (path of the folder's name, every - a /), first time (else the file's), end by
    the duration that the log states or its last time if another, messages, and title: of the last
    summary, else of the folder's index, else the first message of the user, else a constant."""
    lines = read_lines(spark, path, **files)
    rows = events(lines)
    own, nested = F.col("e.content"), F.col("e.message.content")
    at = F.unix_millis(F.try_to_timestamp(F.col("e.timestamp")))
    user, either = F.col("e.type").isin("human", "user"), F.col("e.type").isin("human", "user", "assistant")
    said = F.coalesce(F.when(own.startswith("["), None).otherwise(own), block_text(nested))
    first = lambda value, keep: F.min_by(value, F.when(keep, F.col("place")))
    last = lambda value, keep: F.max_by(value, F.when(keep, F.col("place")))
    per = rows.groupBy("session_id", "dir").agg(
        first(at, at.isNotNull()).alias("first_at"), last(at, at.isNotNull()).alias("last_at"), F.max(F.unix_millis("modified")).alias("modified"), F.count_if(either).alias("messages"),
        first(said, user).alias("first_user"), last(F.when(~own.startswith("["), own), F.col("e.type") == "summary").alias("summary"), last(F.col("e.durationMs"), (F.col("e.type") == "session_end") & (F.col("e.durationMs") > 0)).alias("lasted"),
    )
    per = per.join(session_index(spark, path), ["session_id", "dir"], "left")
    head = F.concat(F.regexp_replace(F.substring("first_user", 1, TITLE_CHARS), r"\n", " "), F.when(F.char_length("first_user") > TITLE_CHARS, "...").otherwise(""))
    some = lambda c: F.nullif(c, F.lit(""))
    begin = F.coalesce("first_at", "modified")
    end = F.coalesce(begin + F.col("lasted"), F.when(F.col("last_at") != begin, F.col("last_at")))
    place = project_path(F.col("dir"))
    return per.select("session_id", F.concat(F.lit("cc:"), "dir").alias("project_id"), place.alias("project_path"), project_name(place).alias("project"), begin.alias("first_ms"), end.alias("last_ms"), "messages", "first_user", F.coalesce(some(F.col("summary")), some(F.col("index_title")), some(head), F.lit(UNTITLED_SESSION)).alias("title"))


def project_path(folder: Column) -> Column:
    return F.translate(folder, "-", "/")


def project_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(-1)), F.lit("(global)"))


def projects_of(sessions: DataFrame) -> DataFrame:
    """Projects with the time of their earliest session."""
    return sessions.groupBy("project_id", "project_path", "project").agg(F.min("first_ms").alias("first_ms"), F.count("*").alias("sessions"))


def session_index(spark: SparkSession, path: str) -> DataFrame:
    """Titles of the ``sessions-index.json`` beside the logs, if it is a list; others are left out."""
    empty = spark.createDataFrame([], "session_id string, dir string, index_title string")
    if not exists(spark, path):
        return empty
    files = spark.read.option("pathGlobFilter", "sessions-index.json").option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("dir"), F.explode(F.from_json("value", "array<struct<id:string,summary:string>>")).alias("x"))
    return rows.where("x.id <> '' and x.summary <> ''").groupBy(F.col("x.id").alias("session_id"), "dir").agg(F.max("x.summary").alias("index_title"))


def read_todos(spark: SparkSession, path: str, sessions: DataFrame | None = None) -> DataFrame:
    """Open todos of JSON files that hold a list, or one under ``todos`` or ``items``, with their session's
    time, if ``sessions`` (session_id, first_ms) has it, else the file's."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("session_id"), F.col("value"), F.unix_millis("_metadata.file_modification_time").alias("modified"))
    listed = F.when(F.ltrim("value").startswith("["), F.col("value"))
    held = F.from_json(F.coalesce(listed, F.get_json_object("value", "$.todos"), F.get_json_object("value", "$.items")), TODO)
    rows = files.select("session_id", "modified", F.posexplode(held).alias("position", "t")).where("t is not null and t.content <> ''")
    rows = rows.select("session_id", "position", "t.content", F.coalesce("t.status", F.lit("pending")).alias("status"), "t.priority", "modified").where("status in ('pending', 'in_progress')")
    if sessions is not None:
        rows = rows.join(sessions.select("session_id", "first_ms"), "session_id", "left").withColumn("modified", F.coalesce("first_ms", "modified")).drop("first_ms")
    return rows.withColumnRenamed("modified", "ts_ms")


# --- notes ---------------------------------------------------------------------------------------------


def read_notes(spark: SparkSession, path: str, most_bytes: int = NOTE_BYTES) -> DataFrame:
    """Markdown notes of at most ``most_bytes``, without the index file and blank ones: path, content,
    stable_id, content_hash, modified, and what ``notes.parsed`` reads from the front matter."""
    from quarry.operators.notes import parsed

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    rows = files.where((F.col("length") <= most_bytes) & ~F.col("path").endswith("/MEMORY.md")).select("path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))
    rows = rows.where(F.col("content").rlike(r"\S")).withColumns({"stable_id": text.stable_id(F.regexp_replace("path", "^[a-z]+:/*", "/")), "content_hash": text.content_hash(F.col("content"))})
    return parsed(rows)


# --- configuration -------------------------------------------------------------------------------------


@dataclass
class Config:
    """Settings with their defaults; see ``read_config``."""

    source_labels: dict = field(default_factory=lambda: dict(SOURCE_LABELS))
    exclude_projects: list = field(default_factory=list)
    include_projects: list = field(default_factory=list)
    noise_project_human_threshold: int | None = None
    min_score: int = 3
    max_sessions: int = 500
    batch_size: int = 30
    long_context_threshold: int = 250_000
    output_dir: str = "."


def read_config(spark: SparkSession, folder: str) -> Config:
    """``config.yaml``, or else ``config.yml``, of a folder; defaults for what it doesn't say, for all if
    there is none or it can't be read."""
    for name in ("config.yaml", "config.yml"):
        if not exists(spark, f"{folder}/{name}"):
            continue
        try:
            said = yaml.parse(spark.read.text(f"{folder}/{name}", wholetext=True).first()[0])
            said = said if isinstance(said, dict) else {}
        except (ValueError, TypeError):
            return Config()
        flat = {k: v for part in [*(v for v in said.values() if isinstance(v, dict)), said] for k, v in part.items()}
        return Config(**{k: v for k, v in flat.items() if k in Config.__dataclass_fields__ and v is not None})
    return Config()

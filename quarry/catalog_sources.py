"""Queries of sources, state, streams and language-model stages over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import bindings
from quarry.bindings import bound
from quarry.catalog import query
from quarry.functions import text
from quarry.operators import completion, state
from quarry.scratch import materialize, new_path
from quarry.sources import adapters, readers
from quarry.sources.readers import ms, table
from quarry.streaming import stream, windows

SESS = f"WITH {bindings.cte('sess')}"


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_name END, 'c' || c_custkey) AS name, '/w/' || c_mktsegment || '/c' || c_custkey AS path FROM customer")
def source_projects(spark, sf_dir):
    """Projects, every fifth of them without a name of its own."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key.alias("id"), F.concat(F.lit("/w/"), "c_mktsegment", F.lit("/c"), key.cast("string")).alias("worktree"), F.when(key % 5 != 0, F.col("c_name")).alias("name"))
    return readers.projects(rows)


@query(f"{SESS} SELECT source, CASE source WHEN 'opencode' THEN 'OC' ELSE 'CC' END AS label, upper(source) AS plain, CASE source WHEN 'claude-code' THEN 'mine' ELSE upper(source) END AS own, count(*) AS n FROM sess GROUP BY source")
def source_labels(spark, sf_dir):
    source = F.col("source")
    rows = bound(spark, sf_dir, "sess").groupBy("source").agg(F.count("*").alias("n"))
    return rows.select("source", readers.source_label(source).alias("label"), readers.source_label(source, {}).alias("plain"), readers.source_label(source, {"claude_code": "mine"}).alias("own"), "n")


_CHURN = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 50 END AS a, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 7 END AS d, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 3 END AS f FROM orders"


@query(f"SELECT id, CASE WHEN coalesce(a, d, f) IS NULL THEN 'none' ELSE coalesce(a, 0) || '|' || coalesce(d, 0) || '|' || coalesce(f, 0) END AS churn FROM ({_CHURN})")
def session_churn(spark, sf_dir):
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 3 == 0, other % 50).alias("summary_additions"), F.when(key % 4 == 0, other % 7).alias("summary_deletions"), F.when(key % 5 == 0, other % 3).alias("summary_files"))
    return readers.with_churn(rows).select("id", F.coalesce(F.concat_ws("|", *[F.col(f"churn.{c}").cast("string") for c in ("additions", "deletions", "files")]), F.lit("")).alias("c"), F.col("churn").isNull().alias("no")).select("id", F.when(F.col("no"), "none").otherwise(F.col("c")).alias("churn"))


_SINCE = "(SELECT epoch_us(max(o_orderdate)) // 1000 - 200 * 86400000::BIGINT FROM orders)"


@query(f"SELECT o_custkey AS project, o_orderkey AS session, epoch_us(o_orderdate) // 1000 AS ts_ms, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS messages FROM orders WHERE epoch_us(o_orderdate) // 1000 > {_SINCE}")
def sessions_since(spark, sf_dir):
    """Sessions of the last 200 days, with their messages."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("session"), ms(F.col("o_orderdate")).alias("ts_ms"))
    last = rows.agg(F.max("ts_ms")).first()[0] or 0
    return readers.sessions_since(rows, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session")), F.lit(last - 200 * 86_400_000).cast("long"))


_PARTS = "SELECT l_orderkey AS message, l_linenumber AS part, epoch_us(l_shipdate) // 1000 AS part_ms, CASE l_linenumber % 4 WHEN 0 THEN '\"' || l_returnflag || '\"' WHEN 1 THEN '{\"type\":\"text\",\"text\":\"' || l_linestatus || l_partkey || '\"}' WHEN 2 THEN '{\"type\":\"tool\"}' ELSE '{broken' END AS data, CASE l_linenumber % 4 WHEN 0 THEN l_returnflag WHEN 1 THEN l_linestatus || l_partkey END AS said FROM lineitem"


@query(f"WITH parts AS ({_PARTS}), t AS (SELECT message, string_agg(said, chr(10) ORDER BY part_ms, part, said) AS content FROM parts WHERE said IS NOT NULL GROUP BY message) SELECT o_custkey AS session, o_orderkey AS message, CASE o_orderkey % 3 WHEN 0 THEN 'assistant' ELSE 'user' END AS role, coalesce(content, '') AS content FROM orders LEFT JOIN t ON message = o_orderkey")
def message_parts(spark, sf_dir):
    """Messages with their parts: strings, objects with and without text, broken JSON."""
    key = F.col("o_orderkey")
    said = F.when(key % 3 == 0, '{"role":"assistant"}').when(key % 3 == 1, '{"role":"tool"}').otherwise("{role")
    messages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), key.alias("message"), said.alias("data"), ms(F.col("o_orderdate")).alias("ts_ms"))
    n = F.col("l_linenumber") % 4
    data = F.when(n == 0, F.concat(F.lit('"'), "l_returnflag", F.lit('"'))).when(n == 1, F.concat(F.lit('{"type":"text","text":"'), "l_linestatus", F.col("l_partkey").cast("string"), F.lit('"}'))).when(n == 2, '{"type":"tool"}').otherwise("{broken")
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message"), F.col("l_linenumber").alias("part"), ms(F.col("l_shipdate")).alias("part_ms"), data.alias("data"))
    return readers.assembled(messages, parts).drop("ts_ms")


@query("SELECT o_orderkey AS session, o_orderpriority AS content, CASE WHEN o_custkey % 4 <> 0 THEN epoch_us(o_orderdate) // 1000 END AS ts_ms FROM orders WHERE o_orderstatus IN ('O', 'P')")
def todos_with_time(spark, sf_dir):
    """Open todos, also those whose session isn't known."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed")
    todos = orders.select(F.col("o_orderkey").alias("session"), F.col("o_orderpriority").alias("content"), status.alias("status"))
    known = orders.where("o_custkey % 4 <> 0").select(F.col("o_orderkey").alias("session"), ms(F.col("o_orderdate")).alias("ts_ms"))
    return readers.todos_with_time(todos, known).drop("status")


@query(f"{SESS}, bridge AS (SELECT DISTINCT 'path' || (length(project) % 2) AS path, source, project AS project_id FROM sess WHERE project <> 'p3') SELECT path, count(*) AS sessions, count(DISTINCT sess.source || project_id) AS sources FROM sess JOIN bridge ON sess.source = bridge.source AND project = project_id GROUP BY path")
def sessions_of_merged_projects(spark, sf_dir):
    """Sessions by merged project, through the bridge of sources."""
    sess = bound(spark, sf_dir, "sess").withColumnRenamed("project", "project_id")
    bridge = sess.where("project_id <> 'p3'").select(F.concat(F.lit("path"), (F.char_length("project_id") % 2).cast("string")).alias("path"), "source", "project_id").distinct()
    rows = readers.of_projects(sess, bridge)
    return rows.groupBy("path").agg(F.count("*").alias("sessions"), F.count_distinct(F.concat("source", "project_id")).alias("sources"))


@query("WITH m AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')) SELECT 's' || conv_id AS session_id, role, text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS idx FROM m")
def session_logs(spark, sf_dir):
    """Conversations written as session logs, a file each, and read back from them; every log begins
    with a broken line and a summary."""
    said = F.to_json(F.struct(F.col("role").alias("type"), F.col("text").alias("content")))
    rows = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").select("conv_id", "turn", "text", said.alias("line"))
    lines = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    folder = new_path(spark)
    texts = lines.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session"), F.concat(F.lit('{broken\n{"type":"summary","content":"all"}\n'), "lines").alias("value"))
    texts.write.partitionBy("session").text(folder)
    logs = readers.read_session_logs(spark, folder, files="*.txt", session="session=([^/]+)")
    return logs.select("session_id", "role", "content", F.col("idx").cast("long").alias("idx"))


@query("WITH m AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')), s AS (SELECT conv_id, count(*) AS messages FROM m GROUP BY conv_id), o AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS ms, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS messages FROM orders), r AS (SELECT unnest([1, 2]) AS run) SELECT run, 'claude-code' AS source, 'CC' AS label, count(*) AS sessions, sum(messages)::BIGINT AS messages FROM s, r WHERE run = 1 OR conv_id % 5 = 0 GROUP BY run UNION ALL SELECT run, 'opencode', 'OC', count(*), sum(messages)::BIGINT FROM o, r WHERE run = 1 OR ms > (SELECT max(ms) - 86400000::BIGINT * 100 FROM o) GROUP BY run")
def adapters_incremental(spark, sf_dir):
    """Sessions of two adapters, logs and tables, in a first run and a second one behind its marks, which opens
    only the log that was written since. A log holds many sessions, and its lines name them."""
    place, key = new_path(spark), F.col("o_orderkey").cast("string")
    said = F.to_json(F.struct(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"), F.col("role").alias("type"), F.col("text").alias("content")))
    rows = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").withColumn("value", said)
    logs = lambda df, name: df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text").select("value").write.text(f"{place}/{name}")
    orders = table(spark, sf_dir, "orders").select(key.alias("session_id"), F.col("o_custkey").cast("string").alias("project_id"), ms(F.col("o_orderdate")).alias("ts_ms"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("session"))
    two = adapters.Registry(spark).register(adapters.LogAdapter(spark, "claude-code", place, files="*.txt", session="$.sessionId")).register(adapters.TableAdapter(spark, "opencode", {"sessions": lambda: orders, "messages": lambda: lines}))
    told = lambda rows, run: materialize(rows.groupBy("source", "label").agg(F.count("*").alias("sessions"), F.sum("messages").alias("messages")).withColumn("run", F.lit(run)))
    logs(rows, "old")
    _aged(spark, f"{place}/old", 3_600_000)
    marks = two.marks()
    first = told(two.sessions(), 1)
    logs(rows.where("conv_id % 5 = 0"), "new")
    last = marks["opencode"] - 100 * 86_400_000
    return first.unionByName(told(two.sessions(marks | {"claude-code": marks["claude-code"] + 60_000, "opencode": last}), 2))


def _aged(spark, folder: str, by_ms: int) -> None:
    """Say that the files of a folder were written earlier."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for file in fs.listStatus(place):
        fs.setTimes(file.getPath(), file.getModificationTime() - by_ms, -1)


_HASHED = "SELECT doc_id AS id, left(sha256(text), 16) AS hash FROM documents"


@query(f"WITH h AS ({_HASHED}), old AS (SELECT id, CASE WHEN id % 5 = 0 THEN left(sha256(hash), 16) ELSE hash END AS hash FROM h WHERE id % 7 <> 0), new AS (SELECT id, hash FROM h WHERE id % 3 <> 0) SELECT coalesce(new.id, old.id) AS id, coalesce(new.hash, old.hash) AS hash, CASE WHEN old.id IS NULL THEN 'new' WHEN new.id IS NULL THEN 'gone' WHEN old.hash = new.hash THEN 'same' ELSE 'changed' END AS state FROM old FULL JOIN new ON old.id = new.id")
def memory_incremental_diff(spark, sf_dir):
    """Two snapshots of notes by id and content hash: what is the same, changed, new or gone."""
    hashed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.content_hash(F.col("text")).alias("hash"))
    old = hashed.where("id % 7 <> 0").withColumn("hash", F.when(F.col("id") % 5 == 0, text.content_hash(F.col("hash"))).otherwise(F.col("hash")))
    return state.changes(old, hashed.where("id % 3 <> 0"))


@query("WITH e AS (SELECT CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source, epoch_us(ts) // 1000 AS ms, event_id FROM events) SELECT source, max(CASE WHEN event_id % 2 = 0 OR source <> 'c' THEN ms END) AS ms FROM e GROUP BY source")
def high_water_marks(spark, sf_dir):
    """How far sources were read after a second run, in which one of them was silent."""
    n = F.col("event_id") % 3
    rows = table(spark, sf_dir, "events").select(F.when(n == 0, "a").when(n == 1, "b").otherwise("c").alias("source"), ms(F.col("ts")).alias("ms"), "event_id")
    first = rows.where("event_id % 2 = 0").groupBy("source").agg(F.max("ms").alias("ms"))
    return state.advanced(first, rows.where("event_id % 2 = 1 and source <> 'c'").select("source", "ms"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stream_upsert_availablenow(spark, sf_dir):
    """The latest event of each user, from a stream of files into state that a second run goes on from."""
    place = new_path(spark)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", ms(F.col("ts")).alias("ms"))
    rows.where("event_id % 3 <> 0").write.parquet(f"{place}/in")
    stream.upsert_available(spark, f"{place}/in", "user_id", ["ms", "event_id"], f"{place}/own")
    rows.where("event_id % 3 = 0").write.mode("append").parquet(f"{place}/in")
    return stream.upsert_available(spark, f"{place}/in", "user_id", ["ms", "event_id"], f"{place}/own").select("user_id", "event_id", "value")


@query("WITH e AS (SELECT event_type, epoch_us(ts) // 86400000000 AS day FROM events) SELECT (day - k) * 86400000 AS begin_ms, event_type, count(*) AS n FROM e, range(7) t(k) GROUP BY 1, 2")
def stream_windowed_activity(spark, sf_dir):
    """Events by type in windows of seven days that begin each day, open and closed."""
    place = new_path(spark)
    table(spark, sf_dir, "events").select("ts", "event_type").write.parquet(f"{place}/in")
    rows = windows.windows_available(spark, f"{place}/in", "ts", "event_type", f"{place}/own", partitions=4)[0]
    return rows.select("begin_ms", F.col("key").alias("event_type"), "n")


_BATCHED = "b AS (SELECT event_type, epoch_ms(ts) AS ms, CASE WHEN event_id % 50 = 0 THEN 9 ELSE least(9, (day(ts) - 1) // 3) END AS batch FROM events)"
_MARKS = "marks AS (SELECT t.batch, coalesce((SELECT max(ms) FROM b WHERE b.batch < t.batch) - 86400000, -1) AS passed FROM range(10) t(batch))"
_WINDOWED = "w AS (SELECT event_type, (ms // 86400000 - k) * 86400000 AS begin_ms, passed FROM b JOIN marks USING (batch), range(7) t(k)), counted AS (SELECT event_type, begin_ms, count(*) AS n FROM w WHERE begin_ms + 7 * 86400000::BIGINT > passed GROUP BY ALL)"


def in_ten_batches(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[int]]:
    """Events in ten files, a batch each, of three days; every fiftieth event comes with the last one."""
    place = new_path(spark)
    rows = table(spark, sf_dir, "events").withColumn("batch", F.when(F.col("event_id") % 50 == 0, 9).otherwise(F.least(F.lit(9), F.floor((F.dayofmonth("ts") - 1) / 3))))
    for k in range(10):
        rows.where(F.col("batch") == k).select("ts", "event_type").coalesce(1).write.mode("append").parquet(f"{place}/in")
    return windows.windows_available(spark, f"{place}/in", "ts", "event_type", f"{place}/own", files=1, partitions=4)


@query(f"WITH {_BATCHED}, {_MARKS}, {_WINDOWED} SELECT event_type, begin_ms, n FROM counted WHERE begin_ms + 7 * 86400000::BIGINT <= (SELECT max(ms) - 86400000 FROM b)")
def stream_closed_windows(spark, sf_dir):
    """Windows that the watermark has closed after ten batches, without what came too late for them."""
    rows = in_ten_batches(spark, sf_dir)[0].where("what = 'closed'")
    return rows.select(F.col("key").alias("event_type"), "begin_ms", "n")


@query(f"WITH {_BATCHED}, {_MARKS} SELECT event_type, count(*) AS n FROM b JOIN marks USING (batch) WHERE (ms // 86400000 + 7) * 86400000 <= passed GROUP BY event_type")
def stream_late_events(spark, sf_dir):
    """Events that came when all their windows were closed."""
    rows = in_ten_batches(spark, sf_dir)[1]
    return rows.groupBy(F.col("key").alias("event_type")).agg(F.sum("n").alias("n"))


# --- language-model stages -----------------------------------------------------------------------------

CONTENT = "SELECT conv_id AS session, string_agg(left(text, 2000), chr(10) ORDER BY n) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n <= 20 GROUP BY conv_id"
HEAD = "trim(left(string_split(trim(content), chr(10))[1], 80))"


def contents(spark, sf_dir) -> DataFrame:
    from quarry.catalog import message_assembly

    return message_assembly(spark, sf_dir).select(F.col("conv_id").alias("session"), "content")


@query(f"WITH c AS ({CONTENT}), q AS (SELECT unnest(['decisions', 'pain_points', 'preferences']) AS question) SELECT session, question, 'short' AS model, (trim(content, E' \\t\\n\\r') <> '')::INT AS n, 0 AS failed FROM c, q")
def llm_extract_stub(spark, sf_dir):
    """Three questions about each conversation, answered by the stub."""
    rows = completion.ask_sessions(contents(spark, sf_dir), {"short": completion.stub, "long": completion.stub}, pause=0)
    return rows.select("session", "question", "model", "n", F.col("error").isNotNull().cast("int").alias("failed"))


def _refusing(prompts: list[str]) -> list[str]:
    if any("a" not in p for p in prompts):
        raise completion.Refused(400)
    return [str(len(p)) for p in prompts]


@query(f"WITH {bindings.cte('titles')} SELECT id, CASE WHEN contains(title, 'a') THEN length(title)::VARCHAR END AS answer, CASE WHEN NOT contains(title, 'a') THEN 'Refused: status 400' END AS error FROM titles")
def llm_answers_resumed(spark, sf_dir):
    """Prompts asked in waves, in two runs, of which the second asks what the first has no answer to; some are refused."""
    rows, place = bound(spark, sf_dir, "titles").select("id", F.col("title").alias("prompt")), new_path(spark)
    completion.ask_resumable(rows.where("id % 2 = 0"), _refusing, place, waves=2, batch=1, pause=0)
    return completion.ask_resumable(rows, _refusing, place, waves=2, batch=1, pause=0).select("id", "answer", "error")


@query(f"WITH c AS ({CONTENT}) SELECT count(*) AS sessions FROM c")
def llm_processed_sessions(spark, sf_dir):
    answers = completion.ask_sessions(contents(spark, sf_dir), {"short": completion.stub, "long": completion.stub}, pause=0)
    return completion.processed(answers).agg(F.count("*").alias("sessions"))


@query(f"WITH {bindings.cte('claims')}, r AS (SELECT project, claim, row_number() OVER (PARTITION BY project ORDER BY '{{\"claim\":' || claim || '}}') AS k FROM claims), g AS (SELECT project, (k - 1) // 150 AS chunk, count(*) AS n FROM r GROUP BY 1, 2) SELECT project, chunk, CASE WHEN n <= 3 THEN n ELSE 1 END AS n FROM g")
def llm_consolidate_stub(spark, sf_dir):
    """Claims of each project in chunks, of which a stub keeps the first; up to three stay as they are."""
    record = F.to_json(F.struct("claim"))
    rows = bound(spark, sf_dir, "claims").select("project", record.alias("record"))
    return completion.consolidate(rows, "project", "record", _first_only, completion.KEEP_DECISIONS, pause=0).select("project", "chunk", "n")


def _first_only(prompts: list[str]) -> list[str]:
    import json

    return [json.dumps(json.loads(p)[:1]) for p in prompts]


def _louder(drafts: list[str]) -> list[str | None]:
    return [None if d.startswith("n") else d.upper() for d in drafts]


@query(f"WITH {bindings.cte('titles')} SELECT id AS section, CASE WHEN id % 3 = 0 THEN 'cached' WHEN title LIKE 'n%' THEN title ELSE upper(title) END AS polished, (id % 3 = 0)::INT AS hit FROM (SELECT max(id) AS id, title FROM titles GROUP BY title)")
def llm_polish_stub(spark, sf_dir):
    """Sections from a cache, from a stub that has no answer for some, or as they are."""
    rows = bound(spark, sf_dir, "titles").groupBy(F.col("title").alias("draft")).agg(F.max("id").alias("section"))
    cache = rows.where("section % 3 = 0").select(F.sha2("draft", 256).alias("key"), F.lit("cached").alias("polished"))
    return completion.polish(rows, cache, _louder, pause=0)[0]

"""Queries over the driver's tables, each with SQL that another engine runs to the same rows.

Bindings: sessions are ``events`` (project user_id, title event_type) or ``orders`` (project
o_custkey); messages are ``conversations`` without system turns; evidence and claims are
``documents`` with trust from ``labels``; projects are customers, sources their regions; todos are
open orders; technologies are parts. "Now" is the latest time of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import bindings, oracle
from quarry.functions import dictionaries as rules
from quarry.functions import text
from quarry.operators import gate, sessions, signals, views
from quarry.sources.readers import ms, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("session"), F.col("event_type").alias("title"), ms(F.col("ts")).alias("ts_ms"), "value")


def messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")


def d6(c: Column) -> Column:
    return F.round(c, 6)


EV = "ev AS (SELECT user_id AS project, event_id AS session, event_type AS title, (epoch_us(ts) // 1000) AS ts_ms, value FROM events)"
MSG = "msg AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant'))"
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[\\p{{P}}\\p{{S}}]+', ' ', 'g'), '\\s+', ' ', 'g'))"
COLLAPSE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
MEDIAN = "list_sort(list({0}))[len(list({0})) // 2 + 1]"


@query(f"WITH {EV} SELECT h AS hour, count(session)::BIGINT AS n FROM range(24) t(h) LEFT JOIN ev ON (ts_ms // 3600000) % 24 = h GROUP BY h")
def hour_histogram(spark, sf_dir):
    return sessions.hour_histogram(events(spark, sf_dir))


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) n FROM conversations WHERE role = 'user') WHERE n = 1")
def first_user_message(spark, sf_dir):
    return messages(spark, sf_dir).where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("first")).select("conv_id", "first.*")


@query(f"WITH {MSG} SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, round(avg((role = 'user')::INT), 6) AS user_ratio, (count(*) FILTER (role = 'user') > 5)::INT AS many FROM msg GROUP BY conv_id")
def message_stats(spark, sf_dir):
    user = F.count_if(F.col("role") == "user")
    return messages(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("messages"), user.alias("user_messages"), d6(user / F.count("*")).alias("user_ratio"), (user > 5).cast("int").alias("many"))


@query(f"WITH {EV} SELECT project, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share FROM ev GROUP BY project")
def project_session_share(spark, sf_dir):
    rows = events(spark, sf_dir)
    total = F.lit(max(rows.count(), 1))
    return rows.groupBy("project").agg(F.count("*").alias("n")).withColumn("share", d6(F.col("n") * 100.0 / total))


GAPS = f"WITH {EV}, g AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY project ORDER BY ts_ms, session) AS gap_ms FROM ev)"


@query(f"{GAPS} SELECT project, {MEDIAN.format('gap_ms')} AS median FROM g WHERE gap_ms > 0 GROUP BY project")
def upper_median_gap(spark, sf_dir):
    return sessions.upper_median_by(sessions.gaps(events(spark, sf_dir)).where("gap_ms > 0"), "project", "gap_ms")


@query("SELECT source, count(*) AS n, count(DISTINCT trim(left(text, 200))) AS firsts, round(count(DISTINCT trim(left(text, 200))) / count(*), 6) AS ratio FROM documents WHERE trim(left(text, 200)) <> '' GROUP BY source")
def first_message_uniqueness(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.trim(F.substring("text", 1, 200)).alias("first")).where("first <> ''")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("first").alias("firsts")).withColumn("ratio", d6(F.col("firsts") / F.col("n")))


SIGNALS = f"""{GAPS},
hh AS (SELECT p.project, t.hour, (SELECT count(*) FROM ev WHERE ev.project = p.project AND (ts_ms // 3600000) % 24 = t.hour) AS n FROM (SELECT DISTINCT project FROM ev) p CROSS JOIN range(24) t(hour)),
v AS (SELECT project, (24 * sum(n * n) - sum(n) * sum(n))::DOUBLE / (sum(n) * sum(n))::DOUBLE AS hour_variance FROM hh GROUP BY project),
m AS (SELECT project, {MEDIAN.format('gap_ms')} AS median_ms FROM g WHERE gap_ms > 0 GROUP BY project),
s AS (SELECT project, count(*) AS sessions, count(DISTINCT title) / count(*) AS title_ratio, count(*) * 100.0 / sum(count(*)) OVER () AS share, count(*) FILTER (value > 90) / count(*) AS user_ratio FROM ev GROUP BY project),
sig AS (SELECT project, sessions, hour_variance, title_ratio, coalesce(median_ms, 0) AS median_ms, share, user_ratio FROM s JOIN v USING (project) LEFT JOIN m USING (project)),
marked AS (SELECT *, (hour_variance < 0.5 AND sessions > {{least}})::INT AS flat_hours, (title_ratio < 0.3)::INT AS same_titles, (median_ms > 0 AND median_ms < 60000)::INT AS short_gaps, (share > 70)::INT AS most_sessions, (user_ratio < 0.2)::INT AS few_user_messages FROM sig),
r AS (SELECT *, flat_hours + same_titles + short_gaps + most_sessions + few_user_messages AS broken FROM marked)"""


def noise(spark, sf_dir) -> DataFrame:
    """Noise signals of projects; an event above 90 stands for a user's message."""
    rows = events(spark, sf_dir)
    user = rows.groupBy("project").agg((F.count_if(F.col("value") > 90) / F.count("*")).alias("user_ratio"))
    return sessions.noise_signals(rows).join(user, "project")


@query(f"{SIGNALS.format(least=100)} SELECT project, sessions, hour_variance, round(title_ratio, 6) AS title_ratio, median_ms, round(share, 6) AS share, round(user_ratio, 6) AS user_ratio FROM sig")
def noise_signals(spark, sf_dir):
    return noise(spark, sf_dir).withColumns({c: d6(F.col(c)) for c in ("title_ratio", "share", "user_ratio")})


_BROKEN = ("project", "flat_hours", "same_titles", "short_gaps", "most_sessions", "few_user_messages", "broken", "is_noise")
for _name, _least in (("noise_rules", 100), ("noise_rules_of_60_sessions", 60)):
    QUERIES[_name] = lambda spark, sf_dir, least=_least: sessions.noise_rules(noise(spark, sf_dir), least_sessions=least).select(*_BROKEN)
    SQL[_name] = f"{SIGNALS.format(least=_least)} SELECT {', '.join(_BROKEN[:-1])}, (broken >= 2)::INT AS is_noise FROM r"


REPORT = f"{SIGNALS.format(least=60)}, p AS (SELECT project, sessions, CASE WHEN project % 10 = 1 THEN 0 WHEN project % 10 = 2 THEN 1 ELSE (broken >= 2)::INT END AS is_noise, CASE project % 3 WHEN 0 THEN 'opencode' ELSE 'claude-code' END AS source FROM r)"


@query(f"{REPORT} SELECT CASE WHEN grouping(is_noise) = 1 THEN 'total' WHEN is_noise = 1 THEN 'filtered' ELSE 'retained' END AS part, coalesce(source, 'total') AS source, count(*) AS projects, sum(sessions)::BIGINT AS sessions FROM p GROUP BY GROUPING SETS ((is_noise, source), (is_noise), ())")
def noise_report(spark, sf_dir):
    """Projects and sessions that are filtered and retained, by source and in all; listed projects
    are always in (id ends with 1) or always out (2), whatever the rules say."""
    rows = sessions.noise_rules(noise(spark, sf_dir), least_sessions=60).withColumn("source", F.when(F.col("project") % 3 == 0, "opencode").otherwise("claude-code"))
    rows = rows.withColumn("is_noise", sessions.overridden(F.col("is_noise"), F.col("project") % 10 == 1, F.col("project") % 10 == 2))
    out = sessions.report(rows)
    return out.select("part", "source", "projects", "sessions")


@query(f"WITH {EV}, h AS (SELECT project, CASE session % 2 WHEN 0 THEN 'opencode' ELSE 'claude-code' END AS source, (ts_ms // 3600000) % 24 AS hour, count(*) AS n FROM ev GROUP BY 1, 2, 3), per AS (SELECT project, CASE session % 2 WHEN 0 THEN 'opencode' ELSE 'claude-code' END AS source, count(DISTINCT title) / count(*) AS ratio, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY CASE session % 2 WHEN 0 THEN 'opencode' ELSE 'claude-code' END) AS share FROM ev GROUP BY 1, 2), m AS (SELECT project, round(min(ratio), 6) AS ratio, round(max(share), 6) AS share FROM per GROUP BY project), s AS (SELECT project, string_agg(n::VARCHAR, ',' ORDER BY hour) AS hours FROM (SELECT p.project, t.hour, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT DISTINCT project FROM ev) p CROSS JOIN range(24) t(hour) LEFT JOIN h ON h.project = p.project AND h.hour = t.hour GROUP BY 1, 2) GROUP BY project) SELECT * FROM m JOIN s USING (project)")
def noise_merge_of_sources(spark, sf_dir):
    """Signals of the sources of a project as one: hours add up, the least ratio, the greatest share."""
    rows = events(spark, sf_dir).withColumn("source", F.when(F.col("session") % 2 == 0, "opencode").otherwise("claude-code"))
    merged = sessions.merged_sources(sessions.source_signals(rows))
    return merged.select("project", d6(F.col("ratio")).alias("ratio"), d6(F.col("share")).alias("share"), F.array_join(F.transform("hours", lambda x: x.cast("string")), ",").alias("hours"))


NEAR = f"WITH {EV} SELECT a.project, a.session, count(b.session) AS near FROM ev a LEFT JOIN ev b ON a.project = b.project AND a.session <> b.session AND abs(a.ts_ms - b.ts_ms) < 86400000 GROUP BY a.project, a.session"


@query(NEAR)
def neighbor_sessions_24h(spark, sf_dir):
    return sessions.neighbours(events(spark, sf_dir)).select("project", "session", "near")


@query(NEAR)
def neighbor_sessions_join(spark, sf_dir):
    return sessions.neighbours_by_join(events(spark, sf_dir)).select("project", "session", "near")


def _orders(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(F.sum("l_quantity").alias("churn"), F.count("*").alias("messages"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("session"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), ms(F.col("o_orderdate")).alias("ts_ms"))
    return rows.join(parts, "session", "left").withColumns({"churn": F.coalesce("churn", F.lit(0.0)), "messages": F.coalesce("messages", F.lit(0))})


SCORED = """WITH parts AS (SELECT l_orderkey AS session, sum(l_quantity) AS churn, count(*) AS messages FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey AS project, o_orderkey AS session, o_orderpriority AS title, o_orderstatus AS status, (epoch_us(o_orderdate) // 1000) AS ts_ms, coalesce(churn, 0) AS churn, coalesce(messages, 0) AS messages FROM orders LEFT JOIN parts ON o_orderkey = session),
n AS (SELECT a.session, count(b.session) AS near FROM o a LEFT JOIN o b ON a.project = b.project AND a.session <> b.session AND abs(a.ts_ms - b.ts_ms) < 86400000 GROUP BY 1),
scored AS (SELECT o.*, (CASE WHEN title LIKE '%URGENT%' THEN 3 ELSE 0 END + CASE WHEN churn > 100 THEN 2 ELSE 0 END + CASE WHEN near >= 1 THEN 2 ELSE 0 END + CASE WHEN messages > 5 THEN 1 ELSE 0 END)::BIGINT AS score FROM o JOIN n USING (session))"""


def _scored(spark, sf_dir, **limits):
    rows = sessions.neighbours(_orders(spark, sf_dir))
    return rows.withColumn("score", sessions.score(F.col("title").contains("URGENT"), F.col("churn"), F.col("near"), F.col("messages"), **limits).cast("long"))


@query(f"{SCORED} SELECT project, session, score FROM scored")
def session_score(spark, sf_dir):
    return _scored(spark, sf_dir, churn_above=100, messages_above=5).select("project", "session", "score")


@query(f"{SCORED.replace('churn > 100', 'churn > 500').replace('messages > 5', 'messages > 15')} SELECT project, session, score FROM scored")
def session_score_default(spark, sf_dir):
    return _scored(spark, sf_dir).select("project", "session", "score")


@query(f"{SCORED} SELECT project, session, score FROM scored WHERE score >= 3 AND status <> 'F' AND session NOT IN (SELECT event_id FROM events WHERE value > 50) ORDER BY score DESC, ts_ms, session LIMIT 500")
def high_value_sessions(spark, sf_dir):
    done = table(spark, sf_dir, "events").where("value > 50").select(F.col("event_id").alias("session"))
    rows = _scored(spark, sf_dir, churn_above=100, messages_above=5).where("score >= 3 and status <> 'F'").join(done, "session", "left_anti")
    return rows.orderBy(F.desc("score"), "ts_ms", "session").limit(500).select("project", "session", "score")


@query(f"WITH {MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM msg) SELECT conv_id, string_agg(left(text, 2000), chr(10) ORDER BY n) AS content FROM r WHERE n <= 20 GROUP BY conv_id")
def message_assembly(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    rows = messages(spark, sf_dir).withColumn("n", n).where("n <= 20").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", F.substring("text", 1, 2000).alias("t")))).alias("all"))
    return rows.select("conv_id", F.array_join(F.transform("all", lambda x: x["t"]), "\n").alias("content"))


TODO = "todo AS (SELECT o_orderkey, o_custkey, c_name, n_name, upper(r_name) AS label, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' END AS status, o_orderpriority, o_totalprice, (epoch_us(o_orderdate) // 1000) AS ts_ms FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus IN ('O', 'P'))"


def projects(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("c_custkey", "c_name", "n_name", F.col("r_name").alias("source"), F.upper("r_name").alias("label"))


def todos(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus in ('O', 'P')").join(projects(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return rows.withColumn("status", F.when(F.col("o_orderstatus") == "O", "open").otherwise("in_progress")).withColumn("ts_ms", ms(F.col("o_orderdate")))


@query(f"WITH {TODO} SELECT o_orderkey, c_name, n_name, label, status FROM todo")
def todo_context(spark, sf_dir):
    return todos(spark, sf_dir).select("o_orderkey", "c_name", "n_name", "label", "status")


@query(f"WITH {TODO} SELECT c_name, count(*) AS todos, count(*) FILTER (status = 'in_progress') AS running FROM todo GROUP BY c_name")
def open_todos_by_project(spark, sf_dir):
    return todos(spark, sf_dir).groupBy("c_name").agg(F.count("*").alias("todos"), F.count_if(F.col("status") == "in_progress").alias("running"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_open_projects(spark, sf_dir):
    running = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(running, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 50000)")
def anti_unprocessed(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 50000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("WITH u AS (SELECT n_name AS path, 'customer' AS source, 0 AS rank, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, 'supplier', 1, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT path, min_by(name, (rank, name)) AS name, count(*) AS members, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM u GROUP BY path")
def merged_projects(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    own = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("path"), F.lit("customer").alias("source"), F.lit(0).alias("rank"), F.col("c_name").alias("name"))
    other = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("path"), F.lit("supplier").alias("source"), F.lit(1).alias("rank"), F.col("s_name").alias("name"))
    return own.unionByName(other).groupBy("path").agg(F.min_by("name", F.struct("rank", "name")).alias("name"), F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("WITH p AS (SELECT r_name AS source, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT string_agg(source || '(' || n || ' sessions)', ' + ' ORDER BY source) AS summary FROM p")
def source_summary(spark, sf_dir):
    per = projects(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("source", F.concat("source", F.lit("("), "n", F.lit(" sessions)")).alias("part"))))
    return per.agg(F.array_join(F.transform(parts, lambda x: x["part"]), " + ").alias("summary"))


@query("SELECT r_name AS source, max((epoch_us(o_orderdate) // 1000)) AS latest_ms, min((epoch_us(o_orderdate) // 1000)) AS earliest_ms FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def latest_per_source(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(projects(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("source").agg(F.max(ms(F.col("o_orderdate"))).alias("latest_ms"), F.min(ms(F.col("o_orderdate"))).alias("earliest_ms"))


@query("SELECT coalesce(r_name, 'total') AS source, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)")
def sessions_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(projects(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return rows.rollup("source").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("total")).alias("source"), "n")


@query("SELECT o_custkey AS project, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS sessions FROM orders GROUP BY 1, 2")
def timeline_days(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return rows.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("sessions"))


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _scalar(name: str, column, sql: str):
    """``column`` maps the text column to the result."""
    QUERIES[name] = lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", column(F.col("text")).alias("out"))
    SQL[name] = f"SELECT doc_id, {sql} AS out FROM documents"


_scalar("normalize_text", lambda T: text.normalize(T), NORM.format("text"))
_scalar("content_hash", lambda T: text.content_hash(T), "left(sha256(text), 16)")
_scalar("fingerprint", lambda T: text.fingerprint("decision", F.col("source"), T), f"sha256('decision:' || {NORM.format('source')} || chr(1) || {NORM.format('text')})")
_scalar("canonical_key", lambda T: text.canonical_key((F.col("source"), None), (T, 30)), f"{NORM.format('source')} || ':' || {NORM.format('left(text, 30)')}")
for _n in (20, 120, 320):
    _scalar(f"clamp_text_{_n}", lambda T, n=_n: text.clamp(T, n), oracle.clamp("text", _n))
_scalar("shorten_text", lambda T: text.shorten(T, 80), oracle.shorten("text", 80))
_scalar("sanitize_line", lambda T: text.sanitize_line(T), oracle.sanitize("text"))
_scalar("markdown_echo", lambda T: T.rlike(gate.MARKDOWN).cast("int"), f"{oracle.rx('text', gate.MARKDOWN)}::INT")
_scalar("heading_summary", lambda T: text.first_sentence(T), oracle.first_sentence("text"))
_scalar("paragraph_blocks", lambda T: F.concat_ws("|", F.size(text.paragraphs(T)).cast("string"), F.size(text.blocks(T)).cast("string"), text.relevant_paragraph(T, "(?i:licen[sc]e|copyright)")), f"concat_ws('|', len({oracle.paragraphs('text')})::VARCHAR, len({oracle.blocks('text')})::VARCHAR, {oracle.relevant('text', '(?i:licen[sc]e|copyright)')})")
_scalar("relevance_class", lambda T: text.relevance(T, F.col("source"), rules), oracle.relevance("text", "source"))
_scalar("stance", lambda T: text.first_match(T, rules.STANCES, "conditional"), oracle.case("text", rules.STANCES, "conditional"))
_scalar("event_type_class", lambda T: text.first_match(T, rules.EVENT_TYPES, "milestone"), oracle.case("text", rules.EVENT_TYPES, "milestone"))
_scalar("line_counts", lambda T: F.concat_ws(",", text.line_breaks(T).cast("string"), text.bullets(T).cast("string")), "concat_ws(',', len(regexp_extract_all(text, '\\n'))::VARCHAR, len(regexp_extract_all(text, '(?m)^\\s*[-*+]\\s+'))::VARCHAR)")
_scalar("stable_id", lambda T: text.stable_id(F.concat(F.lit("/a//b/./"), "source", F.lit("/"))), "left(sha256(regexp_replace(regexp_replace(regexp_replace('/a//b/./' || source || '/', '/(\\./)+', '/', 'g'), '/+', '/', 'g'), '(.)/\\z', '\\1', 'g')), 16)")
_scalar("dedupe_key", lambda T: text.dedupe_key(T), oracle.norm(oracle.clean_view("text")))


@query(f"SELECT page_id, {oracle.clean_view('html')} AS out FROM pages")
def clean_view_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_view(F.col("html")).alias("out"))


@query(f"SELECT page_id, {oracle.clean_evidence('html', 80)} AS out FROM pages")
def clean_evidence(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_evidence(F.col("html")).alias("out"))


@query(f"WITH d AS (SELECT doc_id, left(text, 30) AS p, {NORM.format('text')} AS n FROM documents) SELECT a.doc_id AS a, b.doc_id AS b, round(CASE WHEN a.n = '' OR b.n = '' THEN 0 WHEN a.n = b.n THEN 1 WHEN contains(a.n, b.n) OR contains(b.n, a.n) THEN least(length(a.n), length(b.n)) / greatest(length(a.n), length(b.n)) ELSE 0 END, 6) AS ratio FROM d a JOIN d b ON a.p = b.p AND b.doc_id = (SELECT max(doc_id) FROM d c WHERE c.p = a.p AND c.doc_id < a.doc_id)")
def overlap_ratio(spark, sf_dir):
    """Each document against the one before it with the same first 30 characters."""
    before = Window.partitionBy(F.substring("text", 1, 30)).orderBy("doc_id")
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("a"), F.lag("doc_id").over(before).alias("b"), "text", F.lag("text").over(before).alias("other")).where("b is not null")
    return rows.select("a", "b", d6(text.overlap_ratio(F.col("text"), F.col("other"))).alias("ratio"))


PAIRS = "d AS (SELECT doc_id, left(text, 30) AS p, text FROM documents), pairs AS (SELECT * FROM (SELECT doc_id AS a, lag(doc_id) OVER w AS b, text, lag(text) OVER w AS other FROM d WINDOW w AS (PARTITION BY p ORDER BY doc_id)) WHERE b IS NOT NULL)"


@query(f"WITH {PAIRS}, k AS (SELECT a, b, {oracle.norm(oracle.clean_view('text'))} AS x, {oracle.norm(oracle.clean_view('other'))} AS y FROM pairs) SELECT a, b, (x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)))::INT AS same FROM k")
def near_duplicates(spark, sf_dir):
    """Each document against the one before it with the same first 30 characters, by words."""
    before = Window.partitionBy(F.substring("text", 1, 30)).orderBy("doc_id")
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("a"), F.lag("doc_id").over(before).alias("b"), "text", F.lag("text").over(before).alias("other")).where("b is not null")
    return rows.select("a", "b", text.near_duplicates(F.col("text"), F.col("other")).cast("int").alias("same"))


@query(f"WITH {bindings.cte('sess')}, k AS (SELECT session, title, {oracle.case('title', rules.TASK_TYPES, '其他')} AS task, length({oracle.collapse('title')}) >= 10 AND NOT {oracle.rx(oracle.collapse('title'), rules.EXAMPLE_NOISE)} AS good FROM sess) SELECT task, count(*) AS n, floor(count(*) * 100.0 / sum(count(*)) OVER () + 0.5)::BIGINT AS percent, min_by(title, session) FILTER (good) AS example FROM k GROUP BY task")
def task_types(spark, sf_dir):
    """Task types of session titles, with the first title that is a good example."""
    title = F.col("title")
    good = (F.char_length(text.collapse(title)) >= 10) & ~text.collapse(title).rlike(rules.EXAMPLE_NOISE)
    rows = bindings.bound(spark, sf_dir, "sess").select("session", "title", text.first_match(title, rules.TASK_TYPES, "其他").alias("task"), good.alias("good"))
    per = rows.groupBy("task").agg(F.count("*").alias("n"), F.min_by("title", F.when(F.col("good"), F.col("session"))).alias("example"))
    return per.withColumn("percent", F.floor(F.col("n") * 100.0 / F.lit(max(rows.count(), 1)) + 0.5).cast("long"))


_FIRST = rules.FIRST_MESSAGES
_FIRST_SQL = f"CASE WHEN {oracle.rx('trim(text)', _FIRST[0][1])} THEN {oracle.q(_FIRST[0][0])} WHEN length(text) > 500 OR {oracle.rx('text', _FIRST[1][1])} THEN {oracle.q(_FIRST[1][0])} WHEN {oracle.rx('trim(text)', _FIRST[2][1])} THEN {oracle.q(_FIRST[2][0])} WHEN {oracle.rx('text', _FIRST[3][1])} THEN {oracle.q(_FIRST[3][0])} ELSE '其他' END"


def first_message_kind(message: Column) -> Column:
    (order, by_order), (document, by_document), (question, by_question), (link, by_link) = rules.FIRST_MESSAGES
    return F.when(F.trim(message).rlike(by_order), order).when((F.char_length(message) > 500) | message.rlike(by_document), document).when(F.trim(message).rlike(by_question), question).when(message.rlike(by_link), link).otherwise("其他")


@query(f"WITH f AS (SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) n FROM conversations WHERE role = 'user') WHERE n = 1 UNION ALL SELECT -session, first_user FROM ({bindings.SESSIONS.replace('{orders}', 'orders')})), c AS (SELECT conv_id, text, {_FIRST_SQL} AS pattern FROM f) SELECT pattern, count(*) AS n, min_by(left(text, 80), conv_id) AS example FROM c GROUP BY pattern")
def first_message_patterns(spark, sf_dir):
    first = first_user_message(spark, sf_dir).select("conv_id", "text").unionByName(bindings.bound(spark, sf_dir, "sess").select((-F.col("session")).alias("conv_id"), F.col("first_user").alias("text")))
    return first.groupBy(first_message_kind(F.col("text")).alias("pattern")).agg(F.count("*").alias("n"), F.min_by(F.substring("text", 1, 80), "conv_id").alias("example"))


def _mentions(name: str, dictionary):
    arms = " UNION ALL ".join(f"SELECT '{n}' AS name, doc_id, source FROM documents WHERE regexp_matches(text, '{p}')" for n, p in dictionary)
    SQL[name] = f"SELECT name, count(*) AS documents, count(DISTINCT source) AS projects FROM ({arms}) GROUP BY name"
    QUERIES[name] = lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", "source", F.explode(text.all_matches(F.col("text"), dictionary)).alias("name")).groupBy("name").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("projects"))


_mentions("prose_terms", rules.PROSE_TERMS)


@query("WITH c AS (SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS kind, count(*) AS n, count(*) FILTER (props IS NOT NULL AND json_valid(props)) AS valid FROM events GROUP BY ROLLUP (event_type)) SELECT * FROM c")
def json_coercion(spark, sf_dir):
    ok = F.col("props").isNotNull() & F.try_parse_json("props").isNotNull()
    per = table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"), F.grouping("event_type").alias("g"))
    return per.select(F.when(F.col("g") == 1, "all").otherwise(F.col("event_type")).alias("kind"), "n", "valid")


KNOWN = "known AS (SELECT text FROM benchmark UNION ALL SELECT text FROM documents WHERE doc_id % 3 = 0)"


def known_texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("text").unionByName(docs(spark, sf_dir).where("doc_id % 3 = 0").select("text"))


@query(f"WITH {KNOWN} SELECT doc_id FROM documents WHERE left(sha256(text), 16) NOT IN (SELECT left(sha256(text), 16) FROM known WHERE text IS NOT NULL)")
def memory_hash_antijoin(spark, sf_dir):
    """Documents whose text isn't known yet, by content hash."""
    known = known_texts(spark, sf_dir).select(text.content_hash(F.col("text")).alias("hash"))
    return docs(spark, sf_dir).withColumn("hash", text.content_hash(F.col("text"))).join(known, "hash", "left_anti").select("doc_id")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def store_upsert_latest(spark, sf_dir):
    return signals.latest(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT kind, count(*) AS n FROM (SELECT o_orderstatus AS kind FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'P' FROM orders WHERE o_totalprice > 100000) GROUP BY kind")
def replace_kind(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind"), "o_totalprice")
    new = rows.where("o_totalprice > 100000").withColumn("kind", F.lit("P"))
    return signals.replace_kind(rows, new, "P").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {EV}, now AS (SELECT max(ts_ms) AS t FROM ev) SELECT project, count(*) AS n FROM ev, now WHERE t - ts_ms <= 30 * 86400000::BIGINT GROUP BY project ORDER BY n DESC, project LIMIT 5")
def active_projects_30d(spark, sf_dir):
    rows = events(spark, sf_dir)
    now = rows.agg(F.max("ts_ms")).first()[0] or 0
    return rows.where(F.col("ts_ms") >= now - 30 * sessions.DAY_MS).groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(5)


@query("WITH p AS (SELECT lower(p_brand) AS technology, CASE WHEN p_size < 15 THEN 'avoid' WHEN p_size < 40 THEN 'prefer' ELSE 'conditional' END AS stance, p_partkey, p_type, p_retailprice FROM part) SELECT technology, count(*) AS support, count(DISTINCT p_type) AS projects, CASE WHEN bool_or(stance = 'prefer') AND bool_or(stance = 'avoid') THEN 'mixed' WHEN bool_or(stance = 'prefer') THEN 'prefer' WHEN bool_or(stance = 'avoid') THEN 'avoid' ELSE 'conditional' END AS stance, min(p_partkey) FILTER (p_retailprice = m) AS representative FROM (SELECT *, max(p_retailprice) OVER (PARTITION BY technology) AS m FROM p) GROUP BY technology")
def tech_preference_rollup(spark, sf_dir):
    stance = F.when(F.col("p_size") < 15, "avoid").when(F.col("p_size") < 40, "prefer").otherwise("conditional")
    rows = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("technology"), stance.alias("s"), "p_partkey", "p_type", "p_retailprice")
    has = lambda name: F.bool_or(F.col("s") == name)
    return rows.groupBy("technology").agg(
        F.count("*").alias("support"), F.count_distinct("p_type").alias("projects"), F.when(has("prefer") & has("avoid"), "mixed").when(has("prefer"), "prefer").when(has("avoid"), "avoid").otherwise("conditional").alias("stance"),
        F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("representative"),
    )


@query(f"WITH {TODO}, now AS (SELECT max((epoch_us(o_orderdate) // 1000)) AS t FROM orders), w AS (SELECT todo.*, CASE status WHEN 'in_progress' THEN 0 ELSE 1 END AS rank FROM todo, now WHERE t - ts_ms <= 60 * 86400000::BIGINT AND o_custkey IN (SELECT o_custkey FROM orders, now WHERE t - (epoch_us(o_orderdate) // 1000) <= 90 * 86400000::BIGINT)), r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY ts_ms DESC, o_orderkey) AS item_rank FROM w) SELECT row_number() OVER (ORDER BY rank, item_rank) AS place, status, o_orderkey FROM r WHERE item_rank <= 12 ORDER BY place LIMIT 30")
def weekly_focus_items(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("at", ms(F.col("o_orderdate")))
    now = orders.agg(F.max("at")).first()[0] or 0
    active = orders.where(F.col("at") >= now - 90 * sessions.DAY_MS).select("o_custkey")
    rows = todos(spark, sf_dir).where(F.col("ts_ms") >= now - 60 * sessions.DAY_MS).join(active, "o_custkey", "left_semi").withColumn("rank", F.when(F.col("status") == "in_progress", 0).otherwise(1))
    rows = views.capped(rows, "status", [F.desc("ts_ms"), F.asc("o_orderkey")], 12)
    return views.item_budget(rows, [F.asc("rank"), F.asc("item_rank")], 30).select("place", "status", "o_orderkey")


@query(f"WITH c AS (SELECT sha256(text) AS key, 'c' || left(sha256(text), 6) AS section FROM ({KNOWN.split('(', 1)[1][:-1]}) GROUP BY text) SELECT doc_id, (section IS NOT NULL)::INT AS hit, coalesce(section, 'draft') AS section FROM documents LEFT JOIN c ON sha256(documents.text) = c.key")
def polish_cache_hits(spark, sf_dir):
    """Sections by the hash of their draft: the cached text, or the draft where there is none."""
    key = F.sha2("text", 256)
    cache = known_texts(spark, sf_dir).groupBy(key.alias("key")).agg(F.lit(1).alias("hit"))
    rows = docs(spark, sf_dir).select("doc_id", key.alias("key")).join(cache, "key", "left")
    return rows.select("doc_id", F.coalesce("hit", F.lit(0)).alias("hit"), F.when(F.col("hit") == 1, F.concat(F.lit("c"), F.substring("key", 1, 6))).otherwise("draft").alias("section"))

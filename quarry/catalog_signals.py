"""Queries of the signal pipeline with their SQL: notes, filters, candidates, gate, merge, store, views.

Candidates of all kinds come from the bound tables of ``bindings``. A candidate's evidence is looked
up by id; every eleventh evidence row is left out here, so that missing evidence occurs, and every
fifth candidate also names the evidence of another one. "Now" is the day after the last session.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import bindings
from quarry.bindings import bound
from quarry.catalog import QUERIES, SQL, query
from quarry.functions import dictionaries as rules
from quarry.functions import text
from quarry.operators import extract, gate, notes, profile, publish, signals, views
from quarry.operators.extract import CLAMPS, KINDS, PAYLOAD
from quarry.oracle import (
    blocks, case, clamp, clean_evidence, clean_project, clean_title, clean_view, did, every, first_sentence, fingerprint, let, noise, norm, operational, overlap, preference, q, relevance, relevant, rep, rx, sanitize, stack, strip, technologies, tidy,
)
from quarry.scratch import materialize, new_path
from quarry.sources.readers import table

NOW = "(SELECT (epoch_us(max(o_orderdate)) // 1000) + 86400000 FROM orders)"


def now_ms(spark, sf_dir) -> Column:
    last = table(spark, sf_dir, "orders").agg(F.max(F.unix_millis(F.col("o_orderdate").cast("timestamp")))).first()[0]
    return F.lit((last or 0) + views.DAY_MS).cast("long")


def _ints(**columns: Column) -> list[Column]:
    return [c.cast("int").alias(name) for name, c in columns.items()]


# --- filters of lines, claims and titles ---------------------------------------------------------

TITLES_SQL = f"WITH {bindings.cte('titles')}"


@query(f"{TITLES_SQL}, t AS (SELECT id, title, {clean_title('title')} AS cleaned FROM titles) SELECT id, cleaned, {clean_project('title')} AS project, {clean_evidence('title', 40)} AS evidence, ({noise('title')})::INT AS noise, ({rx('cleaned', rules.LOW_VALUE_TITLES)})::INT AS low_value, ({rx('title', rules.COMPLETION)})::INT AS completes, ({let('n_', norm('title'), f'n_ = {q(str())} OR ' + rx('n_', text.MEANINGLESS))})::INT AS meaningless FROM t")
def title_filters(spark, sf_dir):
    title = F.col("title")
    rows = bound(spark, sf_dir, "titles").withColumn("cleaned", text.clean_title(title))
    return rows.select("id", "cleaned", text.clean_project(title).alias("project"), text.clean_evidence(title, 40).alias("evidence"), *_ints(noise=text.is_noise(title), low_value=F.col("cleaned").rlike(rules.LOW_VALUE_TITLES), completes=title.rlike(rules.COMPLETION), meaningless=text.is_meaningless(title)))


QUERIES["clean_title"] = lambda spark, sf_dir: bound(spark, sf_dir, "titles").select("id", text.clean_title(F.col("title")).alias("out"))
SQL["clean_title"] = f"{TITLES_SQL} SELECT id, {clean_title('title')} AS out FROM titles"

SESS = f"WITH {bindings.cte('sess')}"
SUBAGENT = r"\(@[A-Za-z0-9_]+|(?i:subagent\))"


@query(f"{SESS}, s AS (SELECT *, {sanitize('title')} AS line FROM sess), f AS (SELECT *, {technologies('line')} AS found FROM s) SELECT session, line, {operational('title', 'line')}::INT AS operational, {rx('line', rules.PROMPT_LIKE)}::INT AS prompt_like, {preference('line')}::INT AS preference, {stack('line', 'found')}::INT AS stack, {case('line', rules.STANCES, 'conditional')} AS stance, {relevance('line', 'title')} AS relevance, {rx('title', SUBAGENT)}::INT AS subagent, array_to_string(list_transform(found, lambda x: x.category || '/' || x.name), ',') AS technologies FROM f")
def line_filters(spark, sf_dir):
    from quarry.operators.sessions import is_subagent

    title, line = F.col("title"), F.col("line")
    rows = bound(spark, sf_dir, "sess").withColumn("line", text.sanitize_line(title)).withColumn("found", extract.technologies(line))
    flags = _ints(operational=extract.is_operational(title, line), prompt_like=line.rlike(rules.PROMPT_LIKE), preference=extract.says_preference(line), stack=extract.declares_stack(line, F.col("found")), subagent=is_subagent(title))
    return rows.select("session", "line", *flags, text.first_match(line, rules.STANCES, "conditional").alias("stance"), text.relevance(line, title, rules).alias("relevance"), F.array_join(F.transform("found", lambda x: F.concat(x["category"], F.lit("/"), x["name"])), ",").alias("technologies"))


CLAIMS_SQL = f"WITH {bindings.cte('claims')}"
REJECTED = lambda e: f"({rx(e, rules.PROJECT_DESCRIPTION)} OR {rx(e, rules.FOCUS_LEAD_IN)} OR {rx(e, rules.LONG_SENTENCE)})"
SKIPPED = f"(trim(what) = '' OR {rx('trim(what)', rules.STATUS_WORDS)} OR {rx('trim(what)', rules.META_COMMENTARY)})"
ROLE_TITLE = lambda e: f"({e} <> '' AND length({e}) <= {rules.ROLE_TITLE_CHARS} AND NOT {rx(e, rules.ROLE_SENTENCE)} AND NOT {rx(e, '[，,。:：；]')})"
RAW_CHAT = lambda e: f"(length({e}) > {rules.RAW_TEXT_CHARS} OR {rx(e, rules.MARKDOWN_NOISE)})"
DIMENSION = "CASE lower(trim(category)) " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rules.DIMENSIONS.items()) + " ELSE trim(category) END"
MISC = f"({rx('trim(category)', rules.MISC_CATEGORY)} AND NOT {rx('observation', rules.BEHAVIOUR_VERBS)})"


@query(f"{CLAIMS_SQL} SELECT claim, {SKIPPED}::INT AS skipped, (length(trim(problem)) < {extract.LEAST_PROBLEM_CHARS})::INT AS short_problem, {RAW_CHAT('observation')}::INT AS raw_chat, {rx('observation', rules.INSTRUCTION)}::INT AS instruction, {MISC}::INT AS misc, {rx('observation', rules.AI_BEHAVIOUR)}::INT AS about_ai, {REJECTED('observation')}::INT AS rejected, {ROLE_TITLE('what')}::INT AS role_title, {DIMENSION} AS dimension, CASE WHEN lower(recurring) IN ('true', 'yes', '1') THEN 1 ELSE 0 END AS recurring, CASE WHEN lower(recurring) IN ('true', 'yes', '1') THEN 'high' WHEN lower(recurring) IN ('false', 'no', '0') THEN 'low' ELSE 'medium' END AS recurrence, {case('observation', rules.PROFILE_CATEGORIES, rules.OTHER_CATEGORY)} AS category FROM claims")
def claim_filters(spark, sf_dir):
    seen = F.col("observation")
    flags = _ints(skipped=extract.is_skippable(F.col("what")), short_problem=F.char_length(F.trim("problem")) < extract.LEAST_PROBLEM_CHARS, raw_chat=extract.is_raw_chat(seen), instruction=seen.rlike(rules.INSTRUCTION), misc=extract.is_misc(F.col("category"), seen), about_ai=seen.rlike(rules.AI_BEHAVIOUR), rejected=extract.is_rejected_sentence(seen), role_title=extract.is_role_title(F.col("what")), recurring=text.as_boolean(F.col("recurring")))
    flag = F.when(text.as_boolean(F.col("recurring")), True).when(~text.as_boolean(F.col("recurring"), True), False)
    return bound(spark, sf_dir, "claims").select("claim", *flags, extract.dimension(F.col("category")).alias("dimension"), extract.recurrence(flag).alias("recurrence"), notes.profile_category(seen).alias("category"))


@query("SELECT o_orderkey AS id, CASE WHEN q > 0 OR d > 0 THEN CASE WHEN n > 0 THEN ' (+' || q || '/-' || d || ', ' || n || ' files)' ELSE ' (+' || q || '/-' || d || ')' END WHEN n > 0 THEN ' (' || n || ' files)' ELSE '' END AS churn, CASE WHEN a.t IS NULL THEN 'unknown' WHEN h < 1 THEN greatest(1, m) || 'm ago' WHEN h < 24 THEN h || 'h ago' WHEN d2 < 30 THEN d2 || 'd ago' WHEN d2 < 365 THEN (d2 // 30) || 'mo ago' ELSE (d2 // 365) || 'y ago' END AS age, CASE WHEN year(o_orderdate) = 1995 THEN strftime(o_orderdate, '%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS label, CASE WHEN days > 30 THEN '搁置 30+ 天' WHEN days > 14 THEN '搁置 2+ 周' WHEN days > 7 THEN '搁置 1+ 周' END AS stale, CASE WHEN o_orderstatus = 'O' THEN '待处理' WHEN o_orderstatus = 'P' THEN '进行中' ELSE o_orderstatus END AS status, (CASE WHEN o_custkey % 5 >= 4 THEN '高' WHEN o_custkey % 5 >= 3 THEN '中' ELSE '低' END) || '（' || (o_custkey % 7) || ' 条证据）' AS trust, repeat('█', round(o_custkey % 11 / 10.0 * 10)::INT) AS bar FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 40 END AS q, o_custkey % 2 AS d, o_custkey % 4 AS n, t - ms AS gap, (t - ms) // 60000 AS m, (t - ms) // 3600000 AS h, (t - ms) // 86400000 AS d2, (t - ms) / 86400000 AS days FROM (SELECT *, epoch_us(o_orderdate) // 1000 AS ms, (SELECT max(epoch_us(o_orderdate)) // 1000 + 1800000 FROM orders) AS t FROM orders) x) a")
def shown_values(spark, sf_dir):
    """Churn, age, date, staleness, status, trust and bars as views show them."""
    rows = table(spark, sf_dir, "orders").withColumn("ms", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    now = F.lit((rows.agg(F.max("ms")).first()[0] or 0) + 1_800_000)
    key = F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise(F.col("o_orderstatus"))
    return rows.select(
        F.col("o_orderkey").alias("id"), text.churn_text(F.when(key % 3 == 0, 0).otherwise(key % 40), key % 2, key % 4).alias("churn"), text.age(F.col("ms"), now).alias("age"), text.date_label(F.col("o_orderdate"), F.to_timestamp(F.lit("1995-06-01"))).alias("label"),
        text.staleness(F.col("ms"), now).alias("stale"), text.shown(status, text.STATUS_SHOWN).alias("status"), text.trust_shown(key % 5, key % 7).alias("trust"), text.bar(key % 11, F.lit(10)).alias("bar"),
    )


# --- notes -----------------------------------------------------------------------------------------

_FRONT = notes.FRONT


def _field(name: str) -> str:
    value = f"regexp_extract(block, {q(f'(?m)^{name}[ ' + chr(9) + ']*:[ ' + chr(9) + ']*([^' + chr(13) + chr(10) + ']*)')}, 1)"
    quotes = "^[\"']|[\"']\\s*\\z"
    return f"nullif(trim(regexp_replace({value}, {q(quotes)}, '', 'g')), '')"


_DAY = lambda e: f"strftime(try_cast({e} AS TIMESTAMP), '%Y-%m-%d')"
_BODY = strip(rep("content", _FRONT))
NOTES_SQL = f"""{bindings.cte('notes')},
fronts AS (SELECT *, CASE WHEN {rx('content', _FRONT)} THEN regexp_extract(content, {q(_FRONT)}, 1) END AS block FROM notes),
parsed AS (SELECT * EXCLUDE (block), block IS NOT NULL AS has_front, {_field('type')} AS memory_type, CASE WHEN {_field('created')} IS NOT NULL THEN {_DAY(_field('created'))} ELSE {_DAY(_field('updated'))} END AS date, list_filter(list_transform(string_split_regex(coalesce({_field('paths')}, ''), '[,\\n]'), lambda x: trim(x)), lambda x: x <> '') AS paths, {_BODY} AS body FROM fronts),
routed AS (SELECT *, CASE WHEN kind = 'rule' THEN 'rule' WHEN NOT has_front THEN 'no front matter' WHEN memory_type IS NULL THEN 'no type' WHEN memory_type IN ('project', 'feedback', 'user', 'reference') THEN memory_type ELSE 'unknown type' END AS goes,
CASE WHEN project_path IS NULL THEN '(global)' ELSE regexp_extract(project_path, '([^/]+)/*\\z', 1) END AS project_name FROM parsed)"""


def routed(spark, sf_dir) -> DataFrame:
    return notes.route(notes.parsed(bound(spark, sf_dir, "notes")))


@query(f"WITH {NOTES_SQL} SELECT note, has_front::INT AS has_front, memory_type, date, array_to_string(paths, '|') AS paths, left(sha256(body), 16) AS body_hash FROM parsed")
def front_matter_items(spark, sf_dir):
    rows = notes.parsed(bound(spark, sf_dir, "notes"))
    return rows.select("note", F.col("has_front").cast("int"), "memory_type", "date", F.array_join("paths", "|").alias("paths"), text.content_hash(F.col("body")).alias("body_hash"))


@query(f"WITH {NOTES_SQL} SELECT goes, kind, count(*) AS n FROM routed GROUP BY goes, kind")
def memory_routing(spark, sf_dir):
    return routed(spark, sf_dir).groupBy("goes", "kind").agg(F.count("*").alias("n"))


DECIDED = f"SELECT note::VARCHAR AS place, project_name AS project, label, {first_sentence('body')} AS what, {relevant('body', rules.BECAUSE)} AS why, NULL AS alternatives, NULL AS trigger_text, date FROM routed WHERE goes = 'project'"
PAINED = f"SELECT note::VARCHAR AS place, project_name AS project, label, {first_sentence('body')} AS problem, {relevant('body', rules.DIAGNOSIS)} AS diagnosis, {relevant('body', rules.SOLUTION)} AS solution, {rx('body', rules.RECURRING)} AS recurring FROM routed WHERE goes = 'feedback'"
_KEPT = f"list_filter({blocks('body')}, lambda b: {rx('b', notes.RULE_PREFERENCE)} AND NOT {rx('b', notes.OPERATIONAL_RULES)} AND NOT {rx('b', notes.AI_INSTRUCTIONS)})"
PROFILED = f"""SELECT left(sha256(note || ':' || (CASE WHEN goes = 'rule' THEN 'rule-profile' ELSE 'profile' END) || ':' || at_), 16) AS place, label, {case('observation', rules.PROFILE_CATEGORIES, rules.OTHER_CATEGORY)} AS category, observation, NULL::VARCHAR AS evidence
FROM (SELECT note, label, goes, at_, {tidy(rep('block', '^[-*+]' + chr(92) + 's+'))} AS observation FROM (SELECT note, label, goes, unnest(kept) AS block, unnest(range(0, len(kept))) AS at_ FROM (SELECT note, label, goes, CASE WHEN goes = 'rule' THEN {_KEPT} ELSE {blocks('body')} END AS kept FROM routed WHERE goes = 'user' OR (goes = 'rule' AND scope = 'user')))) WHERE observation <> ''"""


@query(f"WITH {NOTES_SQL}, d AS ({DECIDED}) SELECT place, project, label, what, why, date FROM d")
def memory_decisions(spark, sf_dir):
    return notes.decisions(routed(spark, sf_dir)).select("place", "project", "label", "what", "why", "date")


@query(f"WITH {NOTES_SQL}, d AS ({PAINED}) SELECT place, project, label, problem, diagnosis, solution, recurring::INT AS recurring FROM d")
def memory_pain_points(spark, sf_dir):
    return notes.pain_points(routed(spark, sf_dir)).withColumn("recurring", F.col("recurring").cast("int"))


@query(f"WITH {NOTES_SQL}, d AS ({PROFILED}) SELECT place, label, category, observation FROM d")
def memory_profiles(spark, sf_dir):
    return notes.profiles(routed(spark, sf_dir)).drop("evidence")


_TECH_ARMS = ", ".join(f"CASE WHEN {rx('body', p)} THEN {{'at': {k}, 'category': {q(c)}, 'name': {q(n)}, 'said': coalesce({relevant('body', p)}, {first_sentence('body')})}} END" for k, (c, n, p) in enumerate(rules.TECHNOLOGIES))


@query(f"WITH {NOTES_SQL}, t AS (SELECT note, label, project_path, project_name, paths, unnest(list_filter([{_TECH_ARMS}], lambda x: x IS NOT NULL)) AS t FROM routed WHERE goes IN ('rule', 'reference')) SELECT left(sha256(note || ':tech:' || t.at), 16) AS place, label, t.category AS category, t.name AS name, t.said || CASE WHEN len(paths) > 0 THEN ' (paths: ' || array_to_string(paths, ', ') || ')' ELSE '' END AS description, CASE WHEN project_path IS NOT NULL THEN project_name END AS project FROM t")
def memory_technologies(spark, sf_dir):
    return notes.technologies(routed(spark, sf_dir))


# --- candidates ------------------------------------------------------------------------------------


def _key(kind: str) -> str:
    place = lambda other: norm(f"coalesce(project, {q(other)})")
    if kind == "tech_preference":
        return f"{place('global')} || ':' || {norm('subject')} || ':' || detail"
    if kind in ("work_style", "profile_fact"):
        return f"{norm('subject')} || ':' || {norm('left(body, 20)')}"
    if kind == "timeline_event":
        return f"{place('global')} || ':' || {norm('detail')} || ':' || {norm('left(reason, 20)')}"
    return f"{place('cross_project' if kind == 'decision' else 'global')} || ':' || {norm('left(subject, 30)')}"


def _candidates(kind: str, select: str) -> str:
    return f"SELECT {q(kind)} AS kind, *, {fingerprint(kind, PAYLOAD)} AS fingerprint, {_key(kind)} AS key FROM ({select})"


def _memory(label: str) -> str:
    return f"CASE WHEN {label} = 'rule' THEN 5 ELSE 4 END"


_NONE = "NULL::VARCHAR"
_EVENTS = f"SELECT {did('timeline-candidate', 'project', 'day', 'session')} AS id, {did('timeline', 'project', 'day', 'session')} AS evidence_id, 'session_message' AS source_kind, source AS label, project, 0.9 AS confidence, 2 AS trust, day::VARCHAR AS observed, subject AS raw_text, subject, {case('subject', rules.EVENT_TYPES, 'milestone')} AS body, day::VARCHAR AS detail, subject AS reason, {_NONE} AS extra, {_NONE} AS trigger FROM (SELECT *, {clamp('title', 120, False)} AS subject FROM sess) WHERE subject NOT IN ('', '(untitled)')"
_THREADS = f"SELECT {did('open-thread-candidate', 'project', 'title')} AS id, {did('open-thread', 'project', 'session', 'title')} AS evidence_id, 'session_todo' AS source_kind, source AS label, project, 0.8 AS confidence, 2 AS trust, strftime(to_timestamp({NOW} / 1000.0) AT TIME ZONE 'UTC', '%Y-%m-%d') AS observed, subject AS raw_text, subject, CASE status WHEN 'in_progress' THEN 'in_progress' WHEN 'pending' THEN 'open' END AS body, 'todo' AS detail, {_NONE} AS reason, {_NONE} AS extra, {_NONE} AS trigger FROM (SELECT *, {clamp('title', 120, False)} AS subject FROM sess) WHERE subject <> '' AND status IN ('in_progress', 'pending')"
_NOTE_LINES = f"""lines AS (SELECT note, path, project_path, kind, label, title, at_, raw, {sanitize('raw')} AS line FROM (SELECT note, path, project_path, kind, label, regexp_extract(path, '([^/]+)/*\\z', 1) AS title, unnest(rows) AS raw, unnest(range(0, len(rows))) AS at_ FROM (SELECT *, string_split_regex(content, '\\r?\\n') AS rows FROM routed WHERE kind = 'rule' OR (kind = 'auto-memory' AND memory_type = 'reference')))),
told AS (SELECT *, {technologies('line')} AS found FROM lines WHERE NOT {operational('raw', 'line')} AND {relevance('line', 'title')} NOT IN ('noise', 'generic_execution')),
note_tech AS (SELECT *, CASE WHEN explicit THEN {case('line', rules.STANCES, 'conditional')} ELSE 'prefer' END AS stance FROM (SELECT *, unnest(found) AS t FROM (SELECT *, {preference('line')} AS explicit, {stack('line', 'found')} AS stacked FROM told WHERE len(found) > 0)) WHERE explicit OR stacked)"""
_TECH_NOTES = f"""SELECT {did('tech', 'evidence_id', 't.category', 't.name', 'stance')} AS id, evidence_id, CASE WHEN kind = 'rule' THEN 'rule_file' ELSE 'memory_file' END AS source_kind, label, project_path AS project, CASE WHEN kind = 'rule' THEN 0.95 ELSE 0.85 END AS confidence, CASE WHEN kind = 'rule' THEN 5 ELSE 4 END AS trust, {_NONE} AS observed, line AS raw_text, t.name AS subject, t.category AS body, stance AS detail,
{clamp("CASE WHEN NOT explicit THEN '技术栈中使用 ' || t.name ELSE line END", 120)} AS reason, CASE WHEN stance = 'conditional' AND {rx('line', rules.CONDITIONAL)} THEN coalesce(nullif({clamp('line', 80)}, ''), 'context-dependent') END AS extra, {_NONE} AS trigger FROM (SELECT *, {did('note-tech', 'note', 'path', 'at_', 't.name')} AS evidence_id FROM note_tech)"""
_MENTIONS = f"""snippets AS (SELECT *, {sanitize("CASE WHEN trim(coalesce(title, '')) <> '' THEN title ELSE first_user END")} AS snippet FROM sess),
spoken AS (SELECT *, {technologies('snippet')} AS found FROM snippets WHERE snippet <> '' AND NOT {operational('snippet', 'snippet')} AND NOT {rx('snippet', rules.PROMPT_LIKE)} AND length(snippet) <= 220 AND {relevance('snippet', 'title')} = 'preference_rich'),
mentions AS (SELECT project, source, session, day, snippet, t.category AS category, t.name AS name, CASE WHEN explicit THEN {case('snippet', rules.STANCES, 'conditional')} ELSE 'prefer' END AS stance, stacked FROM (SELECT *, unnest(found) AS t FROM (SELECT *, {preference('snippet')} AS explicit, {stack('snippet', 'found')} AS stacked FROM spoken WHERE len(found) > 0)) WHERE explicit OR stacked),
gathered AS (SELECT project, category, name, count(*) AS n, count(*) FILTER (stance = 'prefer') AS prefer, count(*) FILTER (stance = 'avoid') AS avoid, count(*) FILTER (stacked) AS stack, max(day) AS latest, arg_min(snippet, (-length(snippet), day, session)) AS sample, arg_min(source, (day, session)) AS label FROM mentions GROUP BY project, category, name)"""
_TECH_SESSIONS = f"""SELECT {did('tech', 'evidence_id', 'category', 'name', 'stance')} AS id, evidence_id, 'session_message' AS source_kind, label, project, CASE WHEN n >= 8 THEN 0.75 WHEN n >= 4 THEN 0.6 ELSE 0.45 END AS confidence, 2 AS trust, latest::VARCHAR AS observed, sample AS raw_text, name AS subject, category AS body, stance AS detail, {clamp("CASE WHEN prefer > 0 OR avoid > 0 THEN sample ELSE '在 ' || project || ' 中反复作为技术栈使用（' || n || ' 条证据）' END", 120)} AS reason, {_NONE} AS extra, {_NONE} AS trigger
FROM (SELECT *, CASE WHEN avoid > prefer THEN 'avoid' ELSE 'prefer' END AS stance, {did('session-tech', 'project', 'name')} AS evidence_id FROM gathered WHERE n >= 2 AND (prefer > 0 OR avoid > 0 OR stack >= 2))"""


def _decision(source: str, memory: bool) -> str:
    prefix, kind = ("memory-decision", "memory_file") if memory else ("layer3-decision", "session_message")
    return f"SELECT {did('decision', 'evidence_id', 'subject', 'body')} AS id, evidence_id, {q(kind)} AS source_kind, label, project, {0.8 if memory else 0.6} AS confidence, {_memory('label') if memory else 3} AS trust, date AS observed, what || CASE WHEN why <> '' THEN ' — ' || why ELSE '' END AS raw_text, subject, body, CASE WHEN trim(coalesce(project, '')) <> '' THEN 'project' ELSE 'cross_project' END AS detail, {clamp('trim(why)', CLAMPS['decision rationale'])} AS reason, nullif(alternatives, '') AS extra, nullif(trim(trigger_text), '') AS trigger FROM (SELECT *, {clamp('what', CLAMPS['topic'])} AS subject, {clamp('what', CLAMPS['decision'])} AS body, {did(prefix, 'place', 'what')} AS evidence_id FROM (SELECT * REPLACE (coalesce(what, '') AS what, coalesce(why, '') AS why) FROM ({source})) WHERE NOT {SKIPPED} AND NOT {rx('trim(why)', rules.META_COMMENTARY)})"


def _pain(source: str, memory: bool) -> str:
    prefix, kind = ("memory-painpoint", "memory_file") if memory else ("layer3-painpoint", "session_message")
    some = lambda c, n: f"CASE WHEN trim({c}) <> '' THEN {clamp(c, CLAMPS[n])} END"
    return f"SELECT {did('pain_point', 'evidence_id', 'subject')} AS id, evidence_id, {q(kind)} AS source_kind, label, project, {0.8 if memory else 0.6} AS confidence, {_memory('label') if memory else 3} AS trust, {_NONE} AS observed, problem || CASE WHEN coalesce(diagnosis, '') <> '' THEN ' — ' || diagnosis ELSE '' END AS raw_text, subject, {some('diagnosis', 'diagnosis')} AS body, CASE WHEN recurring THEN 'high' WHEN NOT recurring THEN 'low' ELSE 'medium' END AS detail, {some('solution', 'workaround')} AS reason, {_NONE} AS extra, {_NONE} AS trigger FROM (SELECT *, {clamp('problem', CLAMPS['problem'])} AS subject, {did(prefix, 'place', 'problem')} AS evidence_id FROM ({source}) WHERE length(trim(problem)) >= {extract.LEAST_PROBLEM_CHARS})"


def _work(source: str, memory: bool) -> str:
    prefix, kind = ("memory-profile", "memory_file") if memory else ("layer3-pref", "session_message")
    own = ("place", "category", "observation") if memory else ("category", "observation")
    raw = "" if memory else f" AND NOT {RAW_CHAT('evidence')}"
    return f"SELECT * FROM (SELECT {did('ws', 'evidence_id', 'subject', 'body')} AS id, evidence_id, {q(kind)} AS source_kind, label, {_NONE} AS project, {0.8 if memory else 0.7} AS confidence, {_memory('label') if memory else 3} AS trust, {_NONE} AS observed, observation || CASE WHEN evidence <> '' THEN ' — ' || evidence ELSE '' END AS raw_text, subject, body, {q('habitual' if memory else 'repeated')} AS detail, CASE WHEN evidence <> '' AND evidence <> observation THEN {clamp('evidence', CLAMPS['work rationale'])} END AS reason, {_NONE} AS extra, {_NONE} AS trigger FROM (SELECT *, {DIMENSION} AS subject, {clamp('observation', CLAMPS['work claim'])} AS body, {did(prefix, *own)} AS evidence_id FROM (SELECT place, label, trim(coalesce(category, '')) AS category, trim(coalesce(observation, '')) AS observation, trim(coalesce(evidence, '')) AS evidence FROM ({source})) WHERE observation <> '' AND category <> '' AND NOT {RAW_CHAT('observation')} AND NOT {rx('observation', rules.INSTRUCTION)} AND NOT {MISC} AND NOT {rx('observation', rules.AI_BEHAVIOUR)}{raw}))"


CLAIM_DECISIONS = "SELECT session::VARCHAR AS place, project, 'layer3-ai' AS label, what, why, alternatives, trigger_text, date FROM claims"
CLAIM_PAINS = "SELECT session::VARCHAR AS place, project, 'layer3-ai' AS label, problem, diagnosis, solution, CASE WHEN lower(recurring) IN ('true', 'yes', '1') THEN true WHEN lower(recurring) IN ('false', 'no', '0') THEN false END AS recurring FROM claims"
CLAIM_STYLES = "SELECT session::VARCHAR AS place, 'layer3-ai' AS label, category, observation, evidence FROM claims"
ALL_DECISIONS = f"both_decisions AS (SELECT project, what, why, trigger_text FROM ({CLAIM_DECISIONS}) UNION ALL SELECT project, what, why, trigger_text FROM memory_decided), texts AS (SELECT concat_ws(' ', coalesce(what, ''), coalesce(why, ''), coalesce(trigger_text, '')) AS s FROM both_decisions)"


def _fact(prefix: str, select: str) -> str:
    """``select``: evidence_key, claim_dimension, claim, scope, why, content, label, project, origin, trust, confidence."""
    return f"SELECT {did('pf', 'evidence_id', 'claim_dimension', 'body')} AS id, evidence_id, origin AS source_kind, label, project, confidence, trust, {_NONE} AS observed, content AS raw_text, claim_dimension AS subject, body, scope AS detail, CASE WHEN why IS NOT NULL THEN {clamp('why', CLAMPS['profile rationale'])} END AS reason, {_NONE} AS extra, {_NONE} AS trigger FROM (SELECT *, {did(prefix, 'evidence_key')} AS evidence_id, {clamp('claim', CLAMPS['profile claim'])} AS body FROM ({select}))"


_ENTRIES = "entries AS (SELECT place, label, observation FROM profiled UNION ALL SELECT session::VARCHAR, 'rule', what FROM claims)"
_FACT_KINDS = f"list_filter([CASE WHEN {rx('claim', rules.ROLE_WORDS)} AND {ROLE_TITLE('claim')} THEN 'role' END, CASE WHEN {rx('claim', rules.RESPONSIBILITY_WORDS)} THEN 'responsibility' END, CASE WHEN {rx('claim', rules.FOCUS_WORDS)} THEN 'focus_area' END], lambda x: x IS NOT NULL)"
_MEMORY_FACTS = f"SELECT concat_ws(':', claim_dimension, place, claim) AS evidence_key, claim_dimension, claim, 'global' AS scope, {_NONE} AS why, claim AS content, label, {_NONE} AS project, 'memory_file' AS origin, {_memory('label')} AS trust, CASE WHEN claim_dimension = 'role' THEN 0.85 ELSE 0.8 END AS confidence FROM (SELECT place, label, claim, unnest({_FACT_KINDS}) AS claim_dimension FROM (SELECT place, label, trim(coalesce(observation, '')) AS claim FROM entries) WHERE claim <> '' AND NOT {RAW_CHAT('claim')} AND NOT {rx('claim', rules.AI_BEHAVIOUR)} AND NOT {REJECTED('claim')})"
_SHARES = "shares AS (SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER ({rx('s', p)}) AS n{k}" for k, (_, _, p) in enumerate(rules.ROLE_PARTS)) + " FROM texts)"
_PARTS = "concat_ws('兼', " + ", ".join(f"CASE WHEN n{k} / total >= {least} THEN {q(name)} END" for k, (name, least, _) in enumerate(rules.ROLE_PARTS)) + ")"
_ROLE = f"SELECT claim AS evidence_key, 'role' AS claim_dimension, claim, 'global' AS scope, why, why AS content, 'layer3-ai' AS label, {_NONE} AS project, 'derived_note' AS origin, 3 AS trust, 0.65 AS confidence FROM (SELECT {_PARTS} AS claim, '基于' || total || '条决策记录推断：产品' || n0 || '条、技术' || n1 || '条、量化' || n2 || '条、AI' || n3 || '条' AS why FROM shares WHERE total >= 3) WHERE claim <> ''"
_THEMES = f"""busy AS (SELECT project, count(*) AS n FROM (SELECT trim(project) AS project FROM both_decisions) WHERE project <> '' GROUP BY project HAVING count(*) >= 3 ORDER BY n DESC, project LIMIT 3),
short AS (SELECT project, what FROM (SELECT trim(project) AS project, trim(what) AS what FROM both_decisions) JOIN busy USING (project) WHERE what <> '' AND length(what) <= 80),
hits AS (SELECT project, theme, count(*) AS n FROM (SELECT project, unnest({every('what', rules.THEMES)}) AS theme FROM short) GROUP BY project, theme),
themed AS (SELECT busy.project, busy.n, coalesce((SELECT arg_min(theme, (-n, theme)) FROM hits WHERE hits.project = busy.project), (SELECT min(what) FROM short WHERE short.project = busy.project AND length(what) <= 24 AND NOT {REJECTED('what')})) AS theme FROM busy)"""
_RESP = f"SELECT project || ':' || n AS evidence_key, 'responsibility' AS claim_dimension, project || ' ' || theme AS claim, 'project' AS scope, project || '项目中有' || n || '条相关决策记录' AS why, project || ': ' || n || ' decisions' AS content, 'layer3-ai' AS label, project, 'derived_note' AS origin, 3 AS trust, 0.6 AS confidence FROM themed WHERE theme IS NOT NULL"
_FOCUS_HITS = f"focus_hits AS (SELECT domain, count(*) AS n FROM (SELECT unnest({every('s', rules.FOCUS_DOMAINS)}) AS domain FROM texts) GROUP BY domain)"
_FOCUS = f"SELECT domain || ':' || n AS evidence_key, 'focus_area' AS claim_dimension, domain AS claim, 'global' AS scope, '在' || n || '条决策/记录中出现相关主题' AS why, 'focus area: ' || domain || ' (' || n || ' occurrences)' AS content, 'layer3-ai' AS label, {_NONE} AS project, 'derived_note' AS origin, 3 AS trust, 0.65 AS confidence FROM (SELECT * FROM focus_hits WHERE n >= 2 ORDER BY n DESC, domain LIMIT 5)"

SOURCES = f"{bindings.cte('sess', 'claims')},\n{NOTES_SQL},\nmemory_decided AS ({DECIDED}),\nmemory_pained AS ({PAINED}),\nprofiled AS ({PROFILED}),\n{ALL_DECISIONS},\n{_NOTE_LINES},\n{_MENTIONS},\n{_ENTRIES},\n{_SHARES},\n{_THEMES},\n{_FOCUS_HITS}"
PARTS = {
    "timeline_event": [_EVENTS], "open_thread": [f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY evidence_id) AS nth FROM ({_THREADS})) WHERE nth = 1"], "tech_preference": [_TECH_NOTES, _TECH_SESSIONS], "decision": [_decision(CLAIM_DECISIONS, False), _decision("SELECT * FROM memory_decided", True)],
    "pain_point": [_pain(CLAIM_PAINS, False), _pain("SELECT * FROM memory_pained", True)], "work_style": [_work(CLAIM_STYLES, False), _work("SELECT * FROM profiled", True)],
    "profile_fact": [_fact("memory-profile", _MEMORY_FACTS), _fact("layer3-decision-role", _ROLE), _fact("layer3-decision-resp", _RESP), _fact("layer3-focus", _FOCUS)],
}
_TIES = ("project", "observed", "body", "detail", "reason", "extra", "trigger")
_COLUMNS = ("id", "evidence_id", "source_kind", "label", "project", "confidence", "trust", "observed", "raw_text", *PAYLOAD)


def cand_sql(kind: str, name: str = "cand") -> str:
    parts = " UNION ALL ".join(f"SELECT {', '.join(_COLUMNS).replace('confidence', 'confidence::DOUBLE AS confidence')} FROM ({p})" for p in PARTS[kind])
    ties = ", ".join(f"coalesce({c}, '')" for c in _TIES)
    one = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY evidence_id, raw_text, trust DESC, {ties}) AS copy FROM ({parts})) WHERE copy = 1"
    return f"{name} AS ({_candidates(kind, f'SELECT * EXCLUDE (copy) FROM ({one})')})"


def decided(spark, sf_dir) -> DataFrame:
    """What models decided of sessions: (place, project, label, what, why, alternatives, trigger_text, date)."""
    columns = ("session", "project", "what", "why", "alternatives", "trigger_text", "date")
    return bound(spark, sf_dir, "claims", *columns).select(F.col("session").cast("string").alias("place"), "project", F.lit("layer3-ai").alias("label"), "what", "why", "alternatives", "trigger_text", "date")


def all_decisions(spark, sf_dir) -> DataFrame:
    columns = ("project", "what", "why", "trigger_text")
    return decided(spark, sf_dir).select(*columns).unionByName(notes.decisions(routed(spark, sf_dir)).select(*columns))


def candidates(spark, sf_dir, kind: str, since: Column | None = None) -> DataFrame:
    """All candidates of a kind from the bound tables, one row an id; of timeline events, if said, those since ``since``."""
    claims = functools.partial(bound, spark, sf_dir, "claims", "session")
    if kind == "timeline_event":
        return extract.timeline_events(bound(spark, sf_dir, "sess", "session", "project", "source", "title", "day", where=None if since is None else extract.of_days_since(since)))
    if kind == "open_thread":
        todos = bound(spark, sf_dir, "sess", "session", "project", "source", "title", "status").withColumnRenamed("title", "content")
        return extract.open_threads(todos, F.date_format(F.timestamp_millis(now_ms(spark, sf_dir)), "yyyy-MM-dd"))
    if kind == "tech_preference":
        parts = [extract.technologies_of_notes(routed(spark, sf_dir)), extract.technologies_of_sessions(bound(spark, sf_dir, "sess"))]
    elif kind == "decision":
        parts = [extract.decisions(decided(spark, sf_dir), False), extract.decisions(notes.decisions(routed(spark, sf_dir)), True)]
    elif kind == "pain_point":
        recurring = F.when(text.as_boolean(F.col("recurring")), True).when(~text.as_boolean(F.col("recurring"), True), False)
        told = claims("project", "problem", "diagnosis", "solution", "recurring").select(F.col("session").cast("string").alias("place"), "project", F.lit("layer3-ai").alias("label"), "problem", "diagnosis", "solution", recurring.alias("recurring"))
        parts = [extract.pain_points(told, False), extract.pain_points(notes.pain_points(routed(spark, sf_dir)), True)]
    elif kind == "work_style":
        told = claims("category", "observation", "evidence").select(F.col("session").cast("string").alias("place"), F.lit("layer3-ai").alias("label"), "category", "observation", "evidence")
        parts = [extract.work_styles(told, False), extract.work_styles(notes.profiles(routed(spark, sf_dir)), True)]
    else:
        entries = notes.profiles(routed(spark, sf_dir)).select("place", "label", "observation")
        entries = entries.unionByName(claims("what").select(F.col("session").cast("string").alias("place"), F.lit("rule").alias("label"), F.col("what").alias("observation")))
        both = materialize(all_decisions(spark, sf_dir))  # roles, themes and focus areas all read it
        parts = [extract.facts_of_memory(entries), extract.role_of_decisions(both), extract.responsibilities_of_decisions(both), extract.focus_of_decisions(both)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return extract.first_by(rows, ["id"], [F.asc("evidence_id"), F.asc("raw_text"), F.desc("trust"), *[F.coalesce(c, F.lit("")) for c in _TIES]])


for _kind in KINDS:
    _shown = ("id", "evidence_id", "source_kind", "project", "confidence", "trust", "observed", "raw_text", *PAYLOAD, "fingerprint", "key")
    QUERIES[f"candidates_{_kind}"] = lambda spark, sf_dir, kind=_kind, shown=_shown: candidates(spark, sf_dir, kind).select(*shown)
    SQL[f"candidates_{_kind}"] = f"WITH {SOURCES},\n{cand_sql(_kind)} SELECT {', '.join(_shown)} FROM cand"


@query(f"WITH {SOURCES} SELECT project, category, name, n, prefer, avoid, stack, latest::VARCHAR AS latest, sample, label FROM gathered")
def session_tech_accumulator(spark, sf_dir):
    rows = extract.accumulate(extract.session_mentions(bound(spark, sf_dir, "sess")))
    return rows.withColumn("latest", F.col("latest").cast("string"))


@query(f"WITH {SOURCES}, t AS (SELECT t.category AS category, t.name AS name, project, session FROM (SELECT project, session, unnest({technologies('title')}) AS t FROM sess)) SELECT category, name, count(*) AS sessions, count(DISTINCT project) AS projects FROM t GROUP BY category, name HAVING count(*) >= 2")
def tech_mentions(spark, sf_dir):
    rows = bound(spark, sf_dir, "sess").select("project", "session", F.explode(extract.technologies(F.col("title"))).alias("t"))
    return rows.groupBy(F.col("t.category").alias("category"), F.col("t.name").alias("name")).agg(F.count("*").alias("sessions"), F.count_distinct("project").alias("projects")).where("sessions >= 2")


@query(f"WITH {SOURCES} SELECT total, n0, n1, n2, n3, {_PARTS} AS role FROM shares")
def role_inference(spark, sf_dir):
    shares = extract.role_shares(all_decisions(spark, sf_dir))
    role = F.concat_ws(rules.ROLE_JOIN, *[F.when(F.col(f"n{k}") / F.col("total") >= least, name) for k, (name, least, _) in enumerate(rules.ROLE_PARTS)])
    return shares.withColumn("role", role)


@query(f"WITH {SOURCES} SELECT project, n, theme FROM themed WHERE theme IS NOT NULL")
def responsibility_theme(spark, sf_dir):
    return extract.themes(all_decisions(spark, sf_dir))


@query(f"WITH {SOURCES} SELECT domain, n FROM focus_hits")
def focus_domains(spark, sf_dir):
    return extract.focus_hits(all_decisions(spark, sf_dir))


@query(f"WITH {SOURCES}, top AS (SELECT * FROM focus_hits ORDER BY n DESC, domain LIMIT 8) SELECT coalesce(sum(n), 0)::BIGINT AS total, coalesce(sum(n) FILTER ({rx('domain', rules.AI_FOCUS)}), 0)::BIGINT AS ai, CASE WHEN sum(n) > 0 THEN floor(coalesce(sum(n) FILTER ({rx('domain', rules.AI_FOCUS)}), 0) * 100 / sum(n) + 0.5)::BIGINT END AS percent FROM top")
def focus_ai_share(spark, sf_dir):
    return extract.ai_share(extract.focus_hits(all_decisions(spark, sf_dir)))


@query(f"{CLAIMS_SQL} SELECT {DIMENSION} AS dimension, count(*) AS n FROM claims GROUP BY 1")
def dimension_map(spark, sf_dir):
    return bound(spark, sf_dir, "claims").groupBy(extract.dimension(F.col("category")).alias("dimension")).agg(F.count("*").alias("n"))


@query(f"WITH {NOTES_SQL}, p AS ({PROFILED}) SELECT category, count(*) AS n FROM p GROUP BY category")
def profile_category(spark, sf_dir):
    return notes.profiles(routed(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))


# --- gate ------------------------------------------------------------------------------------------

_EV = "own AS (SELECT id, evidence_id AS of_ FROM cand UNION ALL SELECT id, other FROM (SELECT id, min(evidence_id) OVER (PARTITION BY left(sha256(id), 2)) AS other FROM cand) WHERE ascii(right(id, 1)) % 5 = 0 AND other IS NOT NULL), ev AS (SELECT DISTINCT ON (id) evidence_id AS id, trust, source_kind FROM cand WHERE ascii(right(evidence_id, 1)) % 11 <> 0 ORDER BY id, trust DESC, source_kind), facts AS (SELECT own.id, count(*) AS n, count(DISTINCT own.of_) AS different, max(trust) AS most_trust, min((source_kind = 'session_message')::INT) AS sessions_only FROM own JOIN ev ON own.of_ = ev.id GROUP BY own.id), met AS (SELECT cand.*, coalesce(n, 0) AS n, coalesce(different, 0) AS different, coalesce(most_trust, 0) AS most_trust, coalesce(sessions_only, 0) AS sessions_only FROM cand LEFT JOIN facts USING (id))"


def _tests(kind: str) -> list[tuple[str, str]]:
    t = lambda c: f"trim(coalesce({c}, ''))"
    subject, body, reason, raw, detail = t("subject"), t("body"), t("reason"), t("raw_text"), "coalesce(detail, '')"
    formatted = lambda e: f"(len(regexp_extract_all({e}, '\\n')) > 2 OR len(regexp_extract_all({e}, '(?m)^\\s*[-*+]\\s+')) > 3)"
    echo = lambda e: f"(length({raw}) > length({e}) + 20 AND {overlap(e, raw)} >= 0.85)"
    weak, low = ("weak_evidence", "n = 0"), ("single_occurrence_low_trust", "n = 1 AND most_trust <= 2 AND confidence < 0.6")
    if kind == "tech_preference":
        name = norm(subject)
        return [
            ("missing_required", f"{subject} = '' OR {body} = '' OR trim({detail}) = ''"), ("missing_rationale", f"{reason} = ''"), ("missing_required", f"{detail} = 'conditional' AND {t('extra')} = ''"),
            ("too_long", f"contains(coalesce(subject, ''), chr(10)) OR length(coalesce(subject, '')) > 60 OR len(string_split({name}, ' ')) > 4"), ("too_long", f"length({reason}) > 150"), ("too_vague", f"length({name}) < 2 OR length({reason}) < 8"),
            ("echo_raw_text", f"{formatted(reason)} OR {rx(reason, gate.MARKDOWN)} OR {echo(reason)}"), weak, low, ("no_actionability", f"n > 0 AND sessions_only = 1 AND ({rx(reason, rules.GATE_PROMPT_LIKE)} OR {rx(raw, rules.GATE_PROMPT_LIKE)})"),
        ]
    if kind == "work_style":
        return [("missing_required", f"{subject} = ''"), ("missing_required", f"{body} = ''"), ("too_vague", f"{body} <> '' AND length({body}) < 8"), ("too_long", f"length({body}) > 150"), ("echo_raw_text", f"length({reason}) > 150"), ("echo_raw_text", formatted(body)), ("no_actionability", rx(body, rules.AI_SUBJECT)), ("single_occurrence_low_trust", f"{detail} = 'once' AND n <= 1"), weak, ("echo_raw_text", f"{raw} <> '' AND {echo(body)}")]
    if kind == "profile_fact":
        return [
            ("missing_required", "coalesce(subject, '') NOT IN ('role', 'responsibility', 'focus_area')"), ("missing_required", f"{body} = ''"), ("too_vague", f"{body} <> '' AND length({body}) < CASE WHEN subject = 'role' THEN 4 ELSE 2 END"), ("too_long", f"length({body}) > 100"), ("echo_raw_text", f"length({reason}) > 150"),
            ("echo_raw_text", formatted(body)), ("echo_raw_text", rx(body, gate.MARKDOWN)), ("echo_raw_text", f"{raw} <> '' AND {echo(body)}"), ("no_actionability", f"{detail} = 'global' AND {rx(body, rules.EXECUTION_DETAIL)}"), ("weak_evidence", "most_trust < 4 AND different < 2"), weak,
        ]
    if kind == "decision":
        meta = lambda e: rx(e, rules.META_COMMENTARY)
        return [
            ("missing_required", f"{subject} = ''"), ("missing_required", f"{body} = ''"), ("meta_commentary", f"{meta(body)} OR {meta(reason)}"), ("no_actionability", rx(body, rules.STATUS_WORDS)), ("too_vague", rx(body, rules.GENERIC_DECISION)), ("too_vague", f"{body} <> '' AND length({body}) < 8"), ("too_long", f"length({body}) > 200"),
            ("missing_rationale", f"{reason} = ''"), ("too_long", f"length({reason}) > 150"), ("echo_raw_text", formatted(reason)), ("weak_evidence", f"most_trust < 4 AND n < 2 AND NOT ({t('extra')} <> '' OR (length({reason}) >= 20 AND length({body}) >= 15))"), weak,
        ]
    if kind == "pain_point":
        return [("missing_required", f"{subject} = ''"), ("too_vague", f"{subject} <> '' AND length({subject}) < 10"), ("too_long", f"length({subject}) > 200"), ("too_vague", rx(subject, rules.VAGUE_PROBLEM)), ("missing_required", f"{body} = '' AND {reason} = ''"), ("too_long", f"length({body}) > 150"), ("too_long", f"length({reason}) > 150"), ("echo_raw_text", formatted(subject)), low, weak]
    if kind == "timeline_event":
        return [("missing_required", f"{subject} = ''"), ("invalid_date", f"NOT {rx(detail, '^' + chr(92) + 'd{4}-' + chr(92) + 'd{2}-' + chr(92) + 'd{2}' + chr(92) + 'z')} OR try_cast({detail} AS TIMESTAMP) IS NULL"), weak]
    return [("missing_required", f"{subject} = ''"), ("too_vague", rx(subject, rules.VAGUE_THREAD)), ("missing_required", "coalesce(body, '') NOT IN ('open', 'in_progress', 'blocked')"), weak]


def gate_sql(kind: str) -> str:
    listed = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(code)} END" for code, c in _tests(kind)) + "], lambda x: x IS NOT NULL)"
    among = lambda codes: "(" + ", ".join(map(q, codes)) + ")"
    has = lambda codes: f"len(list_filter(issues, lambda x: x IN {among(codes)})) > 0"
    cost = f"CASE WHEN x IN {among(gate.MIDDLE_CODES)} THEN 45 WHEN x IN {among(gate.HEAVY_CODES[kind])} THEN 60 WHEN x IN {among(gate.LIGHT_CODES[kind])} THEN 20 ELSE 10 END"
    return f"""{_EV}, gated AS (SELECT *, {listed} AS issues FROM met),
judged AS (SELECT *, greatest(0, 100 - coalesce(list_sum(list_transform(issues, lambda x: {cost})), 0))::BIGINT AS score, CASE WHEN {has(gate.REJECT[kind])} THEN 'reject' WHEN {has(gate.MIDDLE_CODES)} THEN 'quarantine' WHEN {has(gate.LIGHT_CODES[kind])} THEN 'needs_merge' ELSE 'accept' END AS decision FROM gated)"""


def judged(spark, sf_dir, kind: str) -> DataFrame:
    """Candidates of a kind with evidence, issues, score and decision. The candidates are written
    first, so that no filter on the outcome repeats their extraction."""
    rows = materialize(candidates(spark, sf_dir, kind))
    rows = rows.withColumn("deal", F.substring(F.sha2("id", 256), 1, 2))
    other = rows.groupBy("deal").agg(F.min("evidence_id").alias("other"))  # 256 rows at most; in this binding only
    rows = rows.join(F.broadcast(other), "deal", "left").withColumn("evidence_ids", F.when((F.ascii(F.substring("id", -1, 1)) % 5 == 0) & F.col("other").isNotNull(), F.array("evidence_id", "other")).otherwise(F.array("evidence_id"))).drop("deal")
    held = extract.first_by(rows.select(F.col("evidence_id").alias("id"), "trust", "source_kind"), ["id"], [F.desc("trust"), F.asc("source_kind")]).where(F.ascii(F.substring("id", -1, 1)) % 11 != 0)
    return gate.judge(gate.with_evidence(rows, held), kind)


for _kind in KINDS:
    QUERIES[f"gate_{_kind}"] = lambda spark, sf_dir, kind=_kind: judged(spark, sf_dir, kind).select("id", "n", F.array_join("issues", ",").alias("issues"), F.col("score").cast("long").alias("score"), "decision")
    SQL[f"gate_{_kind}"] = f"WITH {SOURCES},\n{cand_sql(_kind)}, {gate_sql(_kind)} SELECT id, n, array_to_string(issues, ',') AS issues, score, decision FROM judged"


@query(f"WITH {SOURCES},\n{cand_sql('decision')}, {gate_sql('decision')} SELECT code, count(*) AS n, count(DISTINCT id) AS candidates FROM (SELECT id, unnest(issues) AS code FROM judged WHERE decision IN ('reject', 'quarantine')) GROUP BY code")
def quarantine_reasons(spark, sf_dir):
    rows = judged(spark, sf_dir, "decision").where("decision in ('reject', 'quarantine')")
    return rows.select("id", F.explode("issues").alias("code")).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("id").alias("candidates"))


# --- merge and store -------------------------------------------------------------------------------

_T12 = "(-trust, -confidence, -last_ms, id)"


def merge_sql(accepted: str, out: str, old: str | None = None) -> str:
    """CTEs ``out`` (signals) and ``out``_members from the rows of ``accepted`` and, if named, the store ``old``."""
    payload = ", ".join(PAYLOAD)
    known = f"LEFT JOIN (SELECT value, min(key) AS known FROM {old}_members WHERE what = 'fingerprint' GROUP BY value) k ON k.value = a.fingerprint" if old else ""
    key = "coalesce(known, a.key)" if old else "a.key"
    prior = f" UNION ALL SELECT kind, key, id, {payload}, trust, confidence, first_ms, last_ms, project, true FROM {old}" if old else ""
    held = f" UNION SELECT key, what, value FROM {old}_members" if old else ""
    best = ", ".join(f"arg_min({c}, {_T12})" if c == "id" else f"arg_min({{'v': {c}}}, {_T12}).v AS {c}" for c in PAYLOAD)
    return f"""{out}_new AS (SELECT a.* REPLACE ({key} AS key), coalesce(epoch_ms(try_cast(observed AS TIMESTAMP)), {NOW}) AS seen FROM {accepted} a {known}),
{out}_rows AS (SELECT kind, key, id, {payload}, trust, confidence, seen AS first_ms, seen AS last_ms, project, false AS old FROM {out}_new{prior}),
{out}_members AS (SELECT key, 'evidence' AS what, evidence_id AS value FROM {out}_new UNION SELECT key, 'fingerprint', fingerprint FROM {out}_new UNION SELECT key, 'label', label FROM {out}_new UNION SELECT key, 'project', project FROM {out}_new WHERE project IS NOT NULL UNION SELECT key, 'merged', id FROM {out}_new{held}),
{out} AS (SELECT kind, r.key, coalesce(arg_min(id, (first_ms, id)) FILTER (old), arg_min(id, {_T12})) AS id, {best}, max(trust) AS trust, max(confidence) AS confidence, min(first_ms) AS first_ms, max(last_ms) AS last_ms, any_value(support) AS support, min(project) AS project FROM {out}_rows r JOIN (SELECT key, count(*) AS support FROM {out}_members WHERE what = 'evidence' GROUP BY key) s ON s.key = r.key GROUP BY kind, r.key)"""


def accepted(spark, sf_dir, kind: str, since: Column | None = None) -> DataFrame:
    """Candidates that the gate lets pass, written once: a merge reads them for its signals and for their members.
    Evidence is looked up only for kinds in which it decides what passes. ``since``: as of ``candidates``."""
    if kind in gate.DECIDED_BY_TEXT:
        return materialize(gate.passing(candidates(spark, sf_dir, kind, since), kind))
    return materialize(judged(spark, sf_dir, kind).where("decision in ('accept', 'needs_merge')"))


def merged(spark, sf_dir, kind: str) -> tuple[DataFrame, DataFrame]:
    """(signals, members) of one kind, written once."""
    rows, members = signals.merge(accepted(spark, sf_dir, kind), kind, now_ms(spark, sf_dir))
    return materialize(rows), members


def signals_for(spark, sf_dir, kinds: tuple[str, ...], now: Column, days: int | None) -> DataFrame:
    """Signals of the kinds, each written once; timeline events of the last ``days``, if the reader uses no others."""
    since = None if days is None else now - days * views.DAY_MS
    rows = [materialize(signals.merge(accepted(spark, sf_dir, kind, since if kind == "timeline_event" else None), kind, now)[0]) for kind in kinds]
    return functools.reduce(DataFrame.unionByName, rows)


def signals_of(spark, sf_dir, *kinds: str) -> DataFrame:
    """Signals of the kinds for one reader: not written, so that only what it reads of them is merged."""
    rows = [signals.merge(accepted(spark, sf_dir, kind), kind, now_ms(spark, sf_dir))[0] for kind in kinds]
    return functools.reduce(DataFrame.unionByName, rows)


def chain_sql(kind: str) -> str:
    """All up to the CTE signals of a kind, and signals_members."""
    return f"WITH {SOURCES},\n{cand_sql(kind)}, {gate_sql(kind)}, taken AS (SELECT * FROM judged WHERE decision IN ('accept', 'needs_merge')),\n{merge_sql('taken', 'signals')}"


_SIGNAL = ("key", "id", "subject", "body", "detail", "reason", "trust", "confidence", "first_ms", "last_ms", "support", "project")
for _kind in KINDS:
    QUERIES[f"merge_{_kind}"] = lambda spark, sf_dir, kind=_kind: signals.merge(accepted(spark, sf_dir, kind), kind, now_ms(spark, sf_dir))[0].select(*_SIGNAL)
    SQL[f"merge_{_kind}"] = f"{chain_sql(_kind)} SELECT {', '.join(_SIGNAL)} FROM signals"
_SUMMARY = {"tech_preference": "subject || ' (' || detail || '): ' || reason", "decision": "concat_ws(': ', subject, body)", "work_style": "body", "profile_fact": "body", "timeline_event": "concat_ws(' ', detail, subject)"}


@query(f"{chain_sql('decision')} SELECT key, id, {_SUMMARY['decision']} AS summary, trust, confidence, support FROM signals")
def merge_signals(spark, sf_dir):
    """Decisions from extraction to signals, the whole way."""
    return signals.merge(accepted(spark, sf_dir, "decision"), "decision", now_ms(spark, sf_dir))[0].select("key", "id", "summary", "trust", "confidence", "support")


@query(f"{chain_sql('decision')} SELECT what, count(*) AS n, count(DISTINCT key) AS keys FROM signals_members GROUP BY what")
def signal_members(spark, sf_dir):
    return merged(spark, sf_dir, "decision")[1].groupBy("what").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


FIRST_HALF = "right(id, 1) < '8'"


@query(f"WITH {SOURCES},\n{cand_sql('decision')}, {gate_sql('decision')}, early AS (SELECT * FROM judged WHERE decision IN ('accept', 'needs_merge') AND {FIRST_HALF}), late AS (SELECT * FROM judged WHERE decision IN ('accept', 'needs_merge') AND NOT {FIRST_HALF}),\n{merge_sql('early', 'before')},\n{merge_sql('late', 'signals', 'before')} SELECT {', '.join(_SIGNAL)} FROM signals")
def merge_incremental(spark, sf_dir):
    """A second batch into the store that the first one gave; the second run of it changes nothing."""
    rows = accepted(spark, sf_dir, "decision")
    now = now_ms(spark, sf_dir)
    half = F.substring("id", -1, 1) < "8"
    before, members = map(materialize, signals.merge(rows.where(half), "decision", now))
    return signals.merge(rows.where(~half), "decision", now, before, members)[0].select(*_SIGNAL)


_TAKEN_BACK = "right(id, 1) IN ('3', 'e')"


@query(f"WITH {SOURCES},\n{cand_sql('decision')}, {gate_sql('decision')}, taken AS (SELECT * FROM judged WHERE decision IN ('accept', 'needs_merge') AND NOT {_TAKEN_BACK}),\n{merge_sql('taken', 'signals')} SELECT {', '.join(_SIGNAL)} FROM signals")
def stream_merge_signals(spark, sf_dir):
    """The merge as a stream: candidates in three runs, the second of which brings some of the first again,
    the third takes some back. Each run goes on from the state of the one before."""
    from quarry.streaming import merge

    rows, now, place = accepted(spark, sf_dir, "decision"), now_ms(spark, sf_dir), new_path(spark)
    last = F.substring("id", -1, 1)
    batches = (merge.events(rows.where(last < "6"), now), merge.events(rows.where((last >= "4") & (last < "b")), now), merge.events(rows.where(last >= "b"), now).unionByName(merge.events(rows.where(last.isin("3", "e")), now, "retract")))
    for batch in batches:
        batch.write.mode("append").parquet(f"{place}/in")
        out = merge.merge_available(spark, f"{place}/in", f"{place}/own", partitions=4)
    return out.select(*_SIGNAL)


_MARKED = "marks AS (SELECT kind, id, 'k:' || key AS mark FROM signals UNION SELECT s.kind, s.id, 'f:' || m.value FROM signals s JOIN signals_members m ON m.key = s.key AND m.what = 'fingerprint'), links AS (SELECT DISTINCT a.id AS a, b.id AS b FROM marks a JOIN marks b ON a.kind = b.kind AND a.mark = b.mark), reach AS (SELECT id AS a, id AS b FROM signals UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a), roots AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a)"


@query(f"{chain_sql('pain_point').replace('WITH ', 'WITH RECURSIVE ', 1)}, {_MARKED}, u AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY trust DESC, confidence DESC, last_ms DESC, id) AS n FROM signals JOIN roots USING (id)), f AS (SELECT root, count(*) AS signals, max(trust) AS trust, min(first_ms) AS first_ms, max(last_ms) AS last_ms FROM u GROUP BY root), e AS (SELECT root, count(DISTINCT value) AS support FROM u JOIN signals_members m ON m.key = u.key AND m.what = 'evidence' GROUP BY root) SELECT key, id, subject, f.trust, f.first_ms, f.last_ms, e.support, f.signals FROM u JOIN f USING (root) JOIN e USING (root) WHERE n = 1")
def signals_united(spark, sf_dir):
    """Signals that share fingerprints, in chains, as one."""
    rows, members = merged(spark, sf_dir, "pain_point")
    one, held = signals.unite(rows, members)
    others = held.where("what = 'merged-signal'").groupBy("key").agg(F.count("*").alias("others"))
    return one.join(others, "key", "left").select("key", "id", "subject", "trust", "first_ms", "last_ms", "support", (F.coalesce("others", F.lit(0)) + 1).alias("signals"))


@query()
def merge_sequential(spark, sf_dir):
    """The same candidates folded in the order of their ids."""
    rows = accepted(spark, sf_dir, "decision").withColumn("arrival", F.col("id")).withColumn("ms", signals.seen_ms(F.col("observed"), now_ms(spark, sf_dir)))
    return signals.fold(rows)


@query(f"WITH {SOURCES},\n{cand_sql('decision', 'd')}, {cand_sql('pain_point', 'p')} SELECT kind, count(*) AS n FROM (SELECT kind FROM p UNION ALL SELECT kind FROM d) WHERE kind <> 'decision' GROUP BY kind")
def wrong_kind_quarantine(spark, sf_dir):
    rows = candidates(spark, sf_dir, "decision").unionByName(candidates(spark, sf_dir, "pain_point"))
    return signals.wrong_kind(rows, "decision").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 0::BIGINT AS problems")
def store_consistency(spark, sf_dir):
    rows, members = merged(spark, sf_dir, "pain_point")
    return signals.consistent(rows, members).agg(F.count("*").alias("problems"))


# --- views -----------------------------------------------------------------------------------------


def view(spark, sf_dir, name: str, kinds: tuple[str, ...]) -> DataFrame:
    now = now_ms(spark, sf_dir)
    return views.VIEWS[name](signals_for(spark, sf_dir, kinds, now, views.EVENT_DAYS.get(name)), now)


_UTC = lambda ms: f"(make_timestamp(({ms}) * 1000))"
_DAY_OF = lambda ms: f"strftime({_UTC(ms)}, '%Y-%m-%d')"
_LABEL = lambda ts: f"coalesce(CASE WHEN year({ts}) = year({_UTC(NOW)}) THEN strftime({ts}, '%m-%d') ELSE strftime({ts}, '%Y-%m-%d') END, '')"
_TL_MS = "coalesce(epoch_ms(try_cast(detail AS TIMESTAMP)), last_ms)"
_EFFECTIVE = f"coalesce(nullif(regexp_extract(coalesce(trigger, ''), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), {_DAY_OF('last_ms')})"
_RANK = lambda c, ranks, other: f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in ranks.items()) + f" ELSE {other} END"
_FULL = ("weekly_focus", "open_threads", "decisions", "pain_points", "tech_preferences")


def _each(kinds: tuple[str, ...]) -> str:
    """Signals of several kinds, each by its own chain."""
    parts = [f"{cand_sql(k, 'cand')}, {gate_sql(k)}, taken AS (SELECT * FROM judged WHERE decision IN ('accept', 'needs_merge')),\n{merge_sql('taken', 'signals')}" for k in kinds]
    return f"WITH {SOURCES},\n" + ",\n".join(f"of_{k} AS (WITH {part} SELECT * FROM signals)" for k, part in zip(kinds, parts, strict=True)) + ",\nsignals AS (" + " UNION ALL ".join(f"SELECT * FROM of_{k}" for k in kinds) + ")"


_W = ("open_thread", "timeline_event", "decision")
_TRUST = "(CASE WHEN trust >= 4 THEN '高' WHEN trust >= 3 THEN '中' ELSE '低' END || '（' || support || ' 条证据）')"
_SINCE = f"{NOW} - 7 * 86400000::BIGINT"
VIEW_SQL = {
    "weekly_focus": (_W, f"""named AS (SELECT * FROM signals WHERE coalesce(project, '') <> ''), moved AS (SELECT * FROM named WHERE kind = 'timeline_event' AND {_TL_MS} >= {_SINCE}),
secs AS (SELECT 0 AS section_rank, '进行中' AS section, * FROM named WHERE kind = 'open_thread' AND first_ms >= {_SINCE} AND project IN (SELECT project FROM moved) UNION ALL SELECT 1, '已完成', * FROM moved WHERE body = 'delivery' OR {rx('subject', rules.COMPLETION)} UNION ALL SELECT 2, '关键决策', * FROM named WHERE kind = 'decision' AND last_ms >= {_SINCE}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY trust DESC, support DESC, last_ms DESC, id) AS item_rank FROM secs), placed AS (SELECT *, row_number() OVER (ORDER BY section_rank, item_rank) AS place FROM ranked WHERE item_rank <= 12),
said AS (SELECT *, {clean_title('subject')} AS title_, {clean_view('reason')} AS why_, CASE kind WHEN 'timeline_event' THEN try_cast(detail AS TIMESTAMP) WHEN 'decision' THEN try_cast(coalesce(trigger, {_DAY_OF('last_ms')}) AS TIMESTAMP) ELSE {_UTC('last_ms')} END AS at_ FROM placed WHERE place <= 30)
SELECT place, section, id, '- [' || {clean_project('project')} || '] ' || {_LABEL('at_')} || ' · ' || CASE WHEN kind = 'decision' THEN '决定：' || title_ || CASE WHEN why_ = '' OR why_ = title_ THEN '' ELSE '；原因：' || why_ END ELSE title_ END AS line FROM said"""),
    "open_threads": (("open_thread",), f"""s AS (SELECT *, {clean_project('project')} AS section, {_RANK('body', views.STATUS_RANK, 9)} AS status_rank FROM signals WHERE body IN ('in_progress', 'blocked', 'open')),
ranked AS (SELECT *, max(last_ms) OVER (PARTITION BY section) AS latest, row_number() OVER (PARTITION BY section ORDER BY status_rank, last_ms DESC, trust DESC, support DESC, id) AS item_rank FROM s), placed AS (SELECT *, row_number() OVER (ORDER BY latest DESC, section, item_rank) AS place FROM ranked WHERE item_rank <= 10)
SELECT place, section, id, '- ' || {_LABEL(_UTC('last_ms'))} || ' · ' || {clean_title('subject')} || coalesce('（' || CASE WHEN ({NOW} - last_ms) / 86400000 > 30 THEN '搁置 30+ 天' WHEN ({NOW} - last_ms) / 86400000 > 14 THEN '搁置 2+ 周' WHEN ({NOW} - last_ms) / 86400000 > 7 THEN '搁置 1+ 周' END || '）', '') AS line FROM placed WHERE place <= 60"""),
    "decisions": (("decision",), f"""s AS (SELECT *, {clean_project('project')} AS section, {_EFFECTIVE} AS day FROM signals), d AS (SELECT *, row_number() OVER (PARTITION BY section, day, same ORDER BY trust DESC, support DESC, confidence DESC, last_ms DESC, id) AS nth FROM (SELECT *, {norm(clean_title('body'))} AS same FROM s)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY day DESC, trust DESC, support DESC, confidence DESC, last_ms DESC, id) AS item_rank FROM d WHERE nth = 1), placed AS (SELECT *, row_number() OVER (ORDER BY section, item_rank) AS place FROM ranked WHERE item_rank <= 50),
said AS (SELECT *, {clean_title('subject')} AS topic, {clean_title('body')} AS decided, {clean_evidence('reason', 250)} AS why, {clean_evidence('extra', 120)} AS others FROM placed WHERE place <= 50),
keyed AS (SELECT *, {norm(clean_view('topic'))} AS x, {norm(clean_view('decided'))} AS y FROM said)
SELECT place, section, id, '### ' || day || CASE WHEN x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)) THEN '' ELSE chr(10) || '- **主题**: ' || topic END || chr(10) || '- **决定**: ' || decided || CASE WHEN why <> '' AND why <> decided THEN chr(10) || '- **理由**: ' || why ELSE '' END || CASE WHEN others <> '' THEN chr(10) || '- **替代方案**: ' || others ELSE '' END || chr(10) || '- **依据强度**: ' || {_TRUST} AS line FROM keyed"""),
    "pain_points": (("pain_point",), f"""d AS (SELECT *, {clean_evidence('body', 250)} AS diagnosed, {clean_evidence('reason', 250)} AS solved FROM signals), s AS (SELECT *, row_number() OVER (ORDER BY {_RANK('detail', views.RECURRENCE_RANK, 0)} DESC, trust DESC, support DESC, confidence DESC, last_ms DESC, id) AS place FROM d WHERE diagnosed <> '' OR solved <> '')
SELECT place, '' AS section, id, concat_ws(chr(10), '## ' || {clean_title('subject')}, CASE WHEN diagnosed <> '' THEN '- **诊断**: ' || diagnosed END, CASE WHEN solved <> '' THEN '- **解决方式**: ' || solved END, '- **复发频率**: ' || CASE detail WHEN 'high' THEN '高频' WHEN 'medium' THEN '中频' WHEN 'low' THEN '低频' ELSE detail END, '- **依据强度**: ' || {_TRUST}) AS line FROM s WHERE place <= 35"""),
    "tech_preferences": (("tech_preference",), f"""g AS (SELECT lower(subject) AS technology, arg_min({{'id': id, 'subject': subject, 'section': body, 'reason': reason, 'trust': trust}}, (-trust, -support, -confidence, -({_RANK('detail', views.STANCE_RANK, 0)}), -last_ms, id)) AS b, sum(support)::BIGINT AS support, count(DISTINCT project) AS projects, CASE WHEN bool_or(detail = 'prefer') AND bool_or(detail = 'avoid') THEN '视场景而定' WHEN bool_or(detail = 'prefer') THEN '偏好' WHEN bool_or(detail = 'avoid') THEN '避免' ELSE '视场景而定' END AS stance FROM signals GROUP BY 1),
f AS (SELECT b.id AS id, b.subject AS subject, b.section AS section, b.reason AS reason, b.trust AS trust, support, projects, stance, coalesce(nullif(list_position(['前端', '后端', 'AI', '工具', '部署'], b.section), 0), 99) AS section_rank FROM g),
ranked AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY subject, id) AS item_rank, dense_rank() OVER (ORDER BY section_rank, section) AS nth_section FROM f), placed AS (SELECT *, row_number() OVER (ORDER BY section_rank, section, item_rank) AS place FROM ranked WHERE item_rank <= 10 AND nth_section <= 5),
shown AS (SELECT *, {clean_evidence(sanitize('reason'), 100)} AS why_ FROM placed WHERE place <= 40)
SELECT place, section, id, '- **' || subject || '** (' || stance || ')' || CASE WHEN why_ <> '' THEN ': ' || why_ ELSE '' END || ' — *' || support || ' 条证据' || CASE WHEN projects > 1 THEN ', ' || projects || ' 个项目' ELSE '' END || ', 信任度 ' || trust || '*' AS line FROM shown"""),
}
VIEW_KINDS = {name: kinds for name, (kinds, _) in VIEW_SQL.items()} | {"timeline": ("timeline_event",), "work_profile": ("work_style",)}
for _name, _kinds in VIEW_KINDS.items():
    QUERIES[f"view_{_name}_items"] = lambda spark, sf_dir, name=_name, kinds=_kinds: view(spark, sf_dir, name, kinds).select(F.col("place").cast("long").alias("place"), "section", "id", "line")
    if _name in VIEW_SQL:
        SQL[f"view_{_name}_items"] = f"{_each(_kinds)},\n{VIEW_SQL[_name][1]}"

_LOW = f"({rx('title_', rules.LOW_VALUE_TITLES)} OR (length(title_) > 80 AND {rx('title_', '[，。！？、；：' + chr(34) + chr(39) + '【】（）…]{2,}')} AND {rx('title_', '(https?://|resume|面试|简历)')}))"
_BEST = "at_ DESC, trust DESC, support DESC, last_ms DESC, id"
SQL["view_timeline_items"] = f"""{_each(('timeline_event',))},
s AS (SELECT *, {_LOW} AS low FROM (SELECT *, {clean_title('subject')} AS title_, {clean_project('project')} AS section, {_TL_MS} AS at_ FROM signals WHERE NOT {noise('subject')})),
n AS (SELECT *, bool_or(NOT low) OVER (PARTITION BY section) AS valued, row_number() OVER (PARTITION BY section, low ORDER BY {_BEST}) AS nth FROM s), k AS (SELECT * FROM n WHERE valued AND (NOT low OR nth = 1)),
p AS (SELECT *, row_number() OVER (ORDER BY latest DESC, size DESC, section) AS place, count(*) OVER () AS all_ FROM (SELECT section, count(*) AS size, max(at_) AS latest FROM k GROUP BY section)),
b AS (SELECT section, place AS section_rank, greatest(1, 80 // least(all_, 81)) AS share FROM p WHERE place <= 81),
r AS (SELECT k.*, section_rank, share, row_number() OVER (PARTITION BY k.section ORDER BY detail DESC, low, {_BEST}) AS item_rank FROM k JOIN b ON b.section = k.section), placed AS (SELECT *, row_number() OVER (ORDER BY section_rank, item_rank) AS place FROM r WHERE item_rank <= share)
SELECT place, section, id, '- ' || title_ AS line FROM placed WHERE place <= 80"""


@query()
def timeline_budget_split(spark, sf_dir):
    """80 items among the market segments, by how many customers each has; tested against a plain loop."""
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("project")).agg(F.count("*").alias("size"))
    return views.shares(views.item_budget(sizes, [F.desc("size"), F.asc("project")], 81).select("project", "size", "place"), 80)


_RANKED = f"{chain_sql('work_style')}, placed AS (SELECT id, body, row_number() OVER (ORDER BY trust DESC, support DESC, confidence DESC, last_ms DESC, id) AS place FROM signals)"


def ranked_claims(spark, sf_dir, most: int) -> DataFrame:
    return views.item_budget(views.active(merged(spark, sf_dir, "work_style")[0], "work_style"), views.ORDERS["work_style"](), most).select("place", "id", "body")


@query(f"{_RANKED}, used AS (SELECT *, sum(length(body) + 1) OVER (ORDER BY place) AS used FROM placed WHERE place <= 50) SELECT place, id, used::BIGINT AS used FROM used WHERE used <= 2000")
def view_char_budget_prefix(spark, sf_dir):
    return views.char_budget(ranked_claims(spark, sf_dir, 50), "body", 2000).select("place", "id", F.col("used").cast("long").alias("used"))


@query(f"{_RANKED}, RECURSIVE_ AS (SELECT 1) SELECT place, id FROM placed WHERE false".replace(", RECURSIVE_ AS (SELECT 1) SELECT place, id FROM placed WHERE false", ", few AS (SELECT place, id, length(body) + 1 AS size FROM placed WHERE place <= 50), kept AS (SELECT list_reduce([{'left': 1000::BIGINT, 'keep': []::BIGINT[]}] || list({'left': size::BIGINT, 'keep': [place]} ORDER BY place), lambda a, x: CASE WHEN x['left'] <= a['left'] THEN {'left': a['left'] - x['left'], 'keep': list_concat(a['keep'], x['keep'])} ELSE a END) AS k FROM few) SELECT place, id FROM few WHERE list_contains((SELECT k['keep'] FROM kept), place)"))
def view_char_budget_skip(spark, sf_dir):
    return views.skip_budget(ranked_claims(spark, sf_dir, 50), "body", 1000).select(F.col("place").cast("long").alias("place"), "id")


@query()
def greedy_containment_dedup(spark, sf_dir):
    return views.greedy_distinct(ranked_claims(spark, sf_dir, 200).withColumn("same", text.dedupe_key(F.col("body"))), "same")


@query()
def chunk_by_chars(spark, sf_dir):
    return views.chunk_by_chars(ranked_claims(spark, sf_dir, 200), "body", 400).select("place", "id", "chunk")


for _name, _kinds in VIEW_KINDS.items():
    QUERIES[f"render_markdown_{_name}"] = lambda spark, sf_dir, name=_name, kinds=_kinds: views.markdown(view(spark, sf_dir, name, kinds), name, "section", "line").select(views.finalize(F.lit(""), F.col("markdown"), views.BUDGETS[name][0]).alias("markdown"))


# --- published views -------------------------------------------------------------------------------

#: How a view's items look at more than its budget in SQL, and what is told of each item.
_LOOKS = {"decisions": ("place <= 50", "place <= 1000"), "tech_preferences": ("place <= 40", "place <= 80")}
_SUBS = {"timeline": "'### ' || detail", "open_threads": "'### ' || CASE body WHEN 'in_progress' THEN '进行中' WHEN 'blocked' THEN '阻塞' ELSE '待处理' END"}
_IDS = {"tech_preferences": "(SELECT list(o.id ORDER BY o.id) FROM signals o WHERE lower(o.subject) = lower(g.subject))"}
NOTES = "<!-- user notes -->\nkeep these\n<!-- /user notes -->"
_Q = lambda text_: q(text_).replace("\n", "' || chr(10) || '")


def published_sql(view_: str, budget: publish.Budget, notes_: str) -> str:
    """The document and its sections by a recursive walk over the items, for budgets that no finished document exceeds."""
    kinds, items = VIEW_SQL[view_] if view_ in VIEW_SQL else (("timeline_event",), TIMELINE_SQL)
    items = items.replace(*_LOOKS.get(view_, ("", "")))
    rule, weekly, own_head = publish.RULES[view_], view_ == "weekly_focus", view_ == "pain_points"
    around = f"(SELECT length(head || chr(10) || meta || note) + {0 if weekly else 1} FROM frame)"
    fits = "room" if rule == "none" else f"room AND {around} + {1 if weekly else 2} + done_ + 2 * secs_ + own_ <= {budget.chars}"
    shut = "(shut OR (room AND NOT fits))" if rule in ("section", "all") else "false"
    return f"""{_each(kinds).replace('WITH ', 'WITH RECURSIVE ', 1)},
frame AS (SELECT '# {publish.TITLES[view_]}' || chr(10) AS head, '<!-- generated: ' || strftime({_UTC(NOW)}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z | sources: two of them -->' || chr(10) AS meta, {_Q('' if weekly else notes_)} AS note),
v AS (WITH {items}),
it AS MATERIALIZED (SELECT row_number() OVER (ORDER BY place) AS place, {"format('{:09d}', place)" if own_head else 'v.section'} AS section, {"''" if own_head else "'## ' || v.section"} AS heading, coalesce({_SUBS.get(view_, 'NULL')}, '') AS sub, line, {_IDS.get(view_, '[v.id]')} AS ids FROM v JOIN signals g ON g.id = v.id),
rec AS (SELECT 0::BIGINT AS place, 0::BIGINT AS done, 0::BIGINT AS secs, NULL::VARCHAR AS section, '' AS sub, 0::BIGINT AS own, 0::BIGINT AS n, 0::BIGINT AS total, false AS shut, false AS kept
UNION ALL SELECT place, done_, secs_, section, CASE WHEN fits THEN isub WHEN fresh THEN '' ELSE sub END, CASE WHEN fits THEN own_ WHEN n_ > 0 THEN own ELSE 0 END, n_ + fits::INT, total + fits::INT, {shut}, fits FROM (
  SELECT *, ({fits}) AS fits FROM (
  SELECT *, CASE WHEN n_ > 0 THEN own WHEN head > 0 THEN head ELSE -1 END + CASE WHEN isub <> '' AND (fresh OR n_ = 0 OR sub <> isub) THEN length(isub) + 1 ELSE 0 END + size + 1 AS own_, NOT shut AND n_ < {budget.per_section} AND total < {budget.items} AS room FROM (
  SELECT i.place, i.section, i.sub AS isub, length(i.heading) AS head, length(i.line) AS size, r.section IS NULL OR r.section <> i.section AS fresh, r.own, r.sub, r.total, {'r.shut' if rule == 'all' else 'CASE WHEN r.section IS NULL OR r.section <> i.section THEN false ELSE r.shut END'} AS shut,
    r.done + CASE WHEN r.section <> i.section AND r.n > 0 THEN r.own ELSE 0 END AS done_, r.secs + CASE WHEN r.section <> i.section AND r.n > 0 THEN 1 ELSE 0 END AS secs_, CASE WHEN r.section = i.section THEN r.n ELSE 0 END AS n_
  FROM rec r JOIN it i ON i.place = r.place + 1)))),
k AS (SELECT it.*, coalesce(lag(it.sub) OVER (PARTITION BY it.section ORDER BY it.place), '') AS above FROM rec JOIN it ON it.place = rec.place WHERE rec.kept),
secs AS (SELECT row_number() OVER (ORDER BY min(place)) AS n, section AS title, CASE WHEN min(heading) <> '' THEN min(heading) || chr(10) ELSE '' END || string_agg(CASE WHEN sub <> above THEN sub || chr(10) ELSE '' END || line, chr(10) ORDER BY place) AS text, flatten(list(ids ORDER BY place)) AS ids FROM k GROUP BY section)
SELECT n, title, text, array_to_string(ids, ',') AS ids FROM secs
UNION ALL SELECT 0, '{publish.TITLES[view_]}', head || chr(10) || coalesce((SELECT string_agg(text, chr(10) || chr(10) ORDER BY n) FROM secs) || {'chr(10)' if weekly else 'chr(10) || chr(10)'}, '') || meta || {'note' if weekly else 'note || chr(10)'}, coalesce((SELECT array_to_string(flatten(list(ids ORDER BY n)), ',') FROM secs), '') FROM frame"""


def publish_view(spark, sf_dir, name: str, previous: str | None = None, **changes: int) -> DataFrame:
    kinds = VIEW_KINDS[name] + (("profile_fact", "timeline_event") if name == "work_profile" else ())
    now = now_ms(spark, sf_dir)
    rows = signals_for(spark, sf_dir, kinds, now, views.EVENT_DAYS.get(name))
    found, _ = publish.published(name, rows, now, "two of them", previous, publish.Budget.of(name, **changes))
    return found.select("n", "title", "text", F.array_join("ids", ",").alias("ids"))


TIMELINE_SQL = SQL["view_timeline_items"][len(_each(("timeline_event",))) + 2 :]
#: Budgets that force each case: the view's own, few characters, few items.
_BUDGETS = {"": {}, "_few_chars": {"chars": 1200}, "_few_items": {"items": 7, "per_section": 3}}
for _name in VIEW_KINDS:
    for _case, _changes in _BUDGETS.items():
        if _case and _name not in ("decisions", "pain_points", "tech_preferences"):
            continue
        QUERIES[f"published_{_name}{_case}"] = lambda spark, sf_dir, name=_name, case=_case, changes=_changes: publish_view(spark, sf_dir, name, f"old\n{NOTES}\n" if case else None, **changes)
        if _name != "work_profile":
            SQL[f"published_{_name}{_case}"] = published_sql(_name, publish.Budget.of(_name, **_changes), NOTES if _case else publish.DEFAULT_NOTES)


@query()
def core_profile(spark, sf_dir):
    now = now_ms(spark, sf_dir)
    return views.core_profile(signals_for(spark, sf_dir, ("profile_fact", "timeline_event"), now, views.EVENT_DAYS["work_profile"]), now)


@query(f"{_each(('timeline_event', 'decision'))}, t AS (SELECT project, subject, last_ms, row_number() OVER (PARTITION BY project, kind ORDER BY last_ms DESC, id) AS n, kind FROM (SELECT *, row_number() OVER (PARTITION BY project, kind, subject ORDER BY last_ms DESC, id) AS copy FROM signals WHERE project IS NOT NULL) WHERE copy = 1) SELECT project, coalesce(string_agg(subject, '|' ORDER BY n) FILTER (kind = 'timeline_event' AND n <= 10), '') AS titles, coalesce(string_agg(subject, '|' ORDER BY n) FILTER (kind = 'decision' AND n <= 5), '') AS topics FROM t GROUP BY project")
def project_contexts(spark, sf_dir):
    """By project the latest ten different titles and five different topics."""
    rows = signals_of(spark, sf_dir, "timeline_event", "decision").where("project is not null")
    recent = [F.desc("last_ms"), F.asc("id")]
    rows = extract.first_by(rows, ["project", "kind", "subject"], recent)
    rows = views.capped(rows.withColumn("own", F.concat_ws("|", "project", "kind")), "own", recent, 10)
    listed = lambda kind, most: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("item_rank") <= most), F.struct("item_rank", "subject")))), lambda x: x["subject"]), "|")
    return rows.groupBy("project").agg(listed("timeline_event", 10).alias("titles"), listed("decision", 5).alias("topics"))


@query(f"{CLAIMS_SQL}, g AS (SELECT left(problem, 50) AS head, project, count(*) AS n FROM claims WHERE problem IS NOT NULL GROUP BY 1, 2) SELECT head, sum(n)::BIGINT AS n, string_agg(project || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END, ', ' ORDER BY project) AS projects FROM g GROUP BY head")
def pain_points_by_head(spark, sf_dir):
    """Problems by their first 50 characters, with how often each project has them."""
    per = bound(spark, sf_dir, "claims").where("problem is not null").groupBy(F.substring("problem", 1, 50).alias("head"), "project").agg(F.count("*").alias("n"))
    shown = F.concat("project", F.when(F.col("n") > 1, F.concat(F.lit(" ×"), F.col("n").cast("string"))).otherwise(""))
    rows = per.groupBy("head").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("project", shown.alias("shown")))).alias("all"))
    return rows.select("head", "n", F.array_join(F.transform("all", lambda x: x["shown"]), ", ").alias("projects"))


@query(f"{CLAIMS_SQL}, k AS (SELECT *, CASE WHEN {rx('lower(trim(category))', '交互|interaction')} THEN '交互风格' WHEN {rx('lower(trim(category))', '语言|沟通|language')} THEN '语言偏好' WHEN {rx('lower(trim(category))', '节奏|rhythm')} THEN '工作节奏' WHEN trim(category) = '' THEN '其他' ELSE trim(category) END AS legacy FROM claims) SELECT claim, legacy, observation FROM (SELECT *, row_number() OVER (PARTITION BY legacy, left(observation, 50) ORDER BY claim) AS n FROM k) WHERE n = 1")
def preferences_by_head(spark, sf_dir):
    """The first preference of each first 50 characters within its broad category."""
    key = F.lower(F.trim("category"))
    legacy = F.when(key.rlike("交互|interaction"), "交互风格").when(key.rlike("语言|沟通|language"), "语言偏好").when(key.rlike("节奏|rhythm"), "工作节奏").when(F.trim("category") == "", "其他").otherwise(F.trim("category"))
    rows = bound(spark, sf_dir, "claims").withColumns({"legacy": legacy, "head": F.substring("observation", 1, 50)})
    return extract.first_by(rows, ["legacy", "head"], [F.asc("claim")]).select("claim", "legacy", "observation")


@query(f"{CLAIMS_SQL}, o AS (SELECT DISTINCT replace(lower(observation), ' ', '') AS same, min(claim) OVER (PARTITION BY replace(lower(observation), ' ', '')) AS claim FROM claims) SELECT claim, same FROM o ORDER BY claim LIMIT 10")
def focus_dedup(spark, sf_dir):
    """The first ten different focus areas, by their text without spaces and case."""
    rows = bound(spark, sf_dir, "claims").groupBy(F.regexp_replace(F.lower("observation"), " ", "").alias("same")).agg(F.min("claim").alias("claim"))
    return rows.orderBy("claim").limit(10)


@query(f"{CLAIMS_SQL} SELECT project, (n - 1) // 150 AS chunk, count(*) AS claims, min(claim) AS first FROM (SELECT project, claim, row_number() OVER (PARTITION BY project ORDER BY claim) AS n FROM claims) GROUP BY 1, 2")
def chunks_for_models(spark, sf_dir):
    """Claims of a project in chunks of 150 for a model."""
    from quarry.operators.completion import chunked

    rows = chunked(bound(spark, sf_dir, "claims"), "project", [F.asc("claim")], 150)
    return rows.groupBy("project", "chunk").agg(F.count("*").alias("claims"), F.min("claim").alias("first"))


# --- profile and projects ----------------------------------------------------------------------------

NAMES = ["hot bolt", "Old Gear", "ab"]
_TOKEN = lambda e: f"regexp_replace(lower({e}), '\\s+', '', 'g')"
_NAMED = lambda e: f"(contains({_TOKEN(e)}, 'hotbolt') OR contains({_TOKEN(e)}, 'oldgear'))"


@query(f"{CLAIMS_SQL} SELECT claim, (length(what) > 0 AND length(what) <= 30 AND NOT {rx('what', rules.either(rules.LONG_SENTENCE, rules.PROJECT_DESCRIPTION, profile.TASK_VERBS))} AND NOT {_NAMED('what')} AND NOT {rx('trim(what)', profile.GENERIC_ROLES)})::INT AS role, (length(what) > 0 AND length(what) <= 30 AND NOT {rx('what', rules.LONG_SENTENCE)} AND NOT {_NAMED('what')})::INT AS responsibility, (length(observation) > 0 AND length(observation) <= 15 AND NOT {rx('observation', rules.LONG_SENTENCE)})::INT AS focus FROM claims")
def profile_validators(spark, sf_dir):
    what = F.col("what")
    return bound(spark, sf_dir, "claims").select("claim", *_ints(role=profile.valid_role(what, NAMES), responsibility=profile.valid_responsibility(what, NAMES), focus=profile.valid_focus(F.col("observation"))))


_SUMMARY_OF = "CASE claim % 4 WHEN 0 THEN project || '系统' WHEN 1 THEN '用于管理' || claim WHEN 2 THEN 'a/b 工具' ELSE what END"


@query(f"{CLAIMS_SQL}, s AS (SELECT claim, project, trim({_SUMMARY_OF}) AS said FROM claims) SELECT claim, (length(said) BETWEEN 5 AND 40 AND NOT contains(said, '/') AND {_TOKEN('said')} <> {_TOKEN('project')} AND NOT (length({_TOKEN('project')}) >= 3 AND contains({_TOKEN('said')}, {_TOKEN('project')})) AND {rx('said', profile.SUMMARY_WORDS)})::INT AS valid FROM s")
def summary_validator(spark, sf_dir):
    key = F.col("claim")
    said = F.when(key % 4 == 0, F.concat("project", F.lit("系统"))).when(key % 4 == 1, F.concat(F.lit("用于管理"), key.cast("string"))).when(key % 4 == 2, "a/b 工具").otherwise(F.col("what"))
    return bound(spark, sf_dir, "claims").select("claim", profile.valid_summary(F.col("project"), said).cast("int").alias("valid"))


_HITS = f"label_hits AS (SELECT label, sum(n)::BIGINT AS n FROM (SELECT trim(body) AS label, support AS n FROM signals WHERE kind = 'profile_fact' AND subject = 'focus_area' AND trim(body) <> '' UNION ALL SELECT unnest({every('s', rules.FOCUS_DOMAINS)}), 1 FROM (SELECT unnest([coalesce(subject, ''), coalesce(body, ''), coalesce(reason, '')]) AS s FROM signals WHERE kind = 'decision')) GROUP BY label)"


def _facts_and_decisions(spark, sf_dir) -> DataFrame:
    return signals_of(spark, sf_dir, "profile_fact", "decision")


@query(f"{_each(('profile_fact', 'decision'))}, {_HITS} SELECT label, n FROM label_hits")
def focus_hit_map(spark, sf_dir):
    return profile.focus_hits(_facts_and_decisions(spark, sf_dir))


@query(f"{_each(('profile_fact', 'decision'))}, {_HITS} SELECT label, n FROM label_hits WHERE n >= 2 AND length(label) > 0 AND length(label) <= 15 AND NOT {rx('label', rules.LONG_SENTENCE)} AND lower(trim(label)) NOT IN ('知识库', 'defi')")
def focus_supplement(spark, sf_dir):
    said = spark.createDataFrame([("知识库",), (" DeFi ",)], "area string")
    return profile.supplement(profile.focus_hits(_facts_and_decisions(spark, sf_dir)), said)


@query(f"{SESS}, p AS (SELECT DISTINCT project FROM sess) SELECT project, CASE WHEN right(project, 1) = '7' THEN '(unknown)' ELSE '用于管理数据的系统' END AS description FROM p")
def project_descriptions(spark, sf_dir):
    """A description of each project by a stub, which has none for some."""
    contexts = bound(spark, sf_dir, "sess").groupBy("project").agg(F.min("title").alias("titles"), F.max("title").alias("topics"))
    return profile.describe(contexts, profile.stub, pause=0)


@query()
def work_patterns(spark, sf_dir):
    from quarry import catalog

    return profile.work_patterns(catalog.task_types(spark, sf_dir), catalog.hour_histogram(spark, sf_dir), catalog.first_message_patterns(spark, sf_dir))


@query(f"{_each(('decision', 'pain_point'))} SELECT 'legacy' AS view_id, 1 AS items UNION ALL SELECT kind, count(*) FROM signals GROUP BY kind")
def store_manifest(spark, sf_dir):
    """The views' manifest: one row a view, replaced where a view was compiled again."""
    old = spark.createDataFrame([("legacy", 1), ("decision", 0)], "view_id string, items long")
    rows = merged(spark, sf_dir, "decision")[0].unionByName(merged(spark, sf_dir, "pain_point")[0])
    return signals.upsert(old, rows.groupBy(F.col("kind").alias("view_id")).agg(F.count("*").alias("items")), "view_id")


# --- the run ---------------------------------------------------------------------------------------------


class Broken(Exception):
    """Stands for a lost driver."""


def extraction_run(spark, root: str, rows: DataFrame, now, notes_: DataFrame, break_at: str | None = None) -> None:
    """One run over ``rows`` (accepted candidates of decisions) and ``notes_`` (id, hash): candidates of sessions that
    were processed before are left out, signals merged, those that rest only on notes that are gone or changed
    taken out first. ``break_at``: where the driver is lost."""
    from quarry.operators import run, state, store

    def reached(name: str) -> None:
        if break_at == name:
            raise Broken(name)

    this = run.begin(spark, root)
    held = store.Store(spark, root)
    diff = this.stage("diff", lambda: state.changes(run.read(spark, root, "hashes"), notes_))
    reached("diff")
    new = this.stage("new", lambda: rows.join(run.read(spark, root, "processed"), "id", "left_anti"))
    reached("new")
    stale = diff.where("state in ('gone', 'changed')").select(F.col("id").alias("value"))

    def lost() -> DataFrame:  # signals all of whose evidence is gone
        if stale.isEmpty():
            return store.empty(spark, store.SCHEMAS["signals"])
        rests = held.read("members").where("what = 'evidence'").join(stale.withColumn("stale", F.lit(1)), "value", "left")
        return held.read("signals").join(rests.groupBy("key").agg(F.min(F.coalesce("stale", F.lit(0))).alias("all")).where("all = 1"), "key", "left_semi")

    gone = this.stage("lost", lambda: lost().select("kind", "key"))
    changed = this.stage("signals", lambda: held.merged("decision", new, now)[0])
    reached("signals")
    this.change("signals", lambda: changed.join(gone, ["kind", "key"], "left_anti"), lambda: gone.join(changed.select("key"), "key", "left_anti"))
    this.change("members", lambda: held.merged("decision", new, now)[1], lambda: held.read("members").join(gone, "key", "left_semi"))
    this.change("processed", lambda: new.select("id"))
    this.change("hashes", lambda: diff.where("state <> 'gone'"), lambda: diff.where("state = 'gone'"))
    this.change("marks", lambda: new.agg(F.max(signals.seen_ms(F.col("observed"), now)).alias("ms")).select(F.lit("claims").alias("source"), "ms").where("ms is not null"))
    reached("commit")
    this.commit()



@query(f"WITH {SOURCES},\n{cand_sql('decision')}, {gate_sql('decision')}, early AS (SELECT * FROM judged WHERE decision IN ('accept', 'needs_merge') AND {FIRST_HALF}), late AS (SELECT * FROM judged WHERE decision IN ('accept', 'needs_merge') AND NOT {FIRST_HALF}),\n{merge_sql('early', 'before')},\n{merge_sql('late', 'signals', 'before')} SELECT {', '.join(_SIGNAL)} FROM signals")
def run_of_stages(spark, sf_dir):
    """Two runs, of which the second is broken twice and begun again; a third has nothing new."""
    from quarry.operators import run, store

    rows, now, root = accepted(spark, sf_dir, "decision"), now_ms(spark, sf_dir), new_path(spark)
    half, none = F.substring("id", -1, 1) < "8", store.empty(spark, "id string, hash string")
    extraction_run(spark, root, rows.where(half), now, none)
    for break_at in ("new", "commit", None, None):
        try:
            extraction_run(spark, root, rows, now, none, break_at)
        except Broken:
            pass
    return run.read(spark, root, "signals").select(*_SIGNAL)

"""Sessions, notes, claims and raw titles as bound to the driver's tables.

The driver's tables hold no conversation logs, so each of these is said once as SQL that Spark and
other engines read alike: a short text by a row's key, from lists that exercise every rule, with
values of the row. Notes carry whole texts of ``documents`` behind such a head.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.readers import table


def pick(key: str, texts: list[str]) -> str:
    """The text of the list that the key names; {} in it stands for a value of the row."""
    quote = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    arms = " ".join(f"WHEN {k} THEN " + " || ".join(x if i % 2 else quote(x) for i, x in enumerate(t.replace("{", "\0").replace("}", "\0").split("\0")) if i % 2 or x or t == "") for k, t in enumerate(texts))
    return f"CASE ({key}) % {len(texts)} {arms} END"


_N = "CAST(o_custkey % 9 AS STRING)"
TITLES = [
    f"Deploy release {{{_N}}}", f"Fix bug {{{_N}}} in the importer", f"Refactor module {{{_N}}}", f"Review of milestone {{{_N}}} merged", f"Explore archive {{{_N}}}",
    f"We always prefer TypeScript for module {{{_N}}}", f"Avoid Docker when testing part {{{_N}}}", f"Stack {{{_N}}}: React + Tailwind, Vite should do", "", "test", "hello", f"Task: create page {{{_N}}} with React",
    f"never ssh into Docker host {{{_N}}}", "Prefer SQLite for small tools, always. " * 4 + f"{{{_N}}}", "(untitled)", f"(@explore subagent) look at {{{_N}}}", f"[OC] src/app.ts: handle: done {{{_N}}}",
    f"[INFO] started {{{_N}}}", f"版本 {{{_N}}} 完成并上线", f"Choose design {{{_N}}} instead of the old architecture", f"Stack: Vue, Nuxt and Node.js must be {{{_N}}}", f"I'm building prompt {{{_N}}} for docker command",
]
FIRST_MESSAGES = ["I prefer Vue for this", "请修复 React 报错", "# PRD of the new page\nIt should list all items.", "what is the plan?", "see https://example.org/a.png", "thanks", "fix the build", "avoid Prisma, never again"]
SESSIONS = f"""SELECT o_orderkey AS session, 'p' || CAST(o_custkey % 37 AS STRING) AS project, CASE o_custkey % 3 WHEN 0 THEN 'opencode' ELSE 'claude-code' END AS source, {pick("o_orderkey + o_custkey", TITLES)} AS title,
{pick("o_orderkey", FIRST_MESSAGES)} AS first_user, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'in_progress' ELSE 'completed' END AS status FROM {{orders}}"""

HEADS = [
    "Prefer TypeScript over plain scripts, always.", "Avoid Prisma because it is slow.\n\nUse Drizzle instead.", "# Stack\n\n前端: React + Tailwind", "- keep replies short, avoid noise\n- 偏好简洁的风格\n- run tests before commit",
    "The build broke again.\n\nThe root cause was a stale cache.\n\nThe fix is to clear it.", "ssh to port 22, never use Docker there", "engineer lead", "负责量化交易平台落地", "涉及很多很多很多很多内容", "Only use PostgreSQL if the data grows.", "design with React and ui in mind", "中文 replies", "@base-ui/react should be avoided",
]
FRONTS = ["---\ntype: project\ncreated: 2024-03-05\n---\n", "---\ntype: feedback\n---\n", "---\ntype: user\nupdated: 2024-04-01\n---\n", "---\ntype: reference\npaths: src/a, src/b\n---\n", "---\ntype: other\n---\n", "", "---\ntitle: untyped\n---\n"]
NOTES = f"""SELECT doc_id AS note, '/home/u/' || coalesce(source, 'x') || '/memory/' || coalesce(lang, 'y') || '-' || CAST(doc_id AS STRING) || '.md' AS path, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE '/home/u/' || coalesce(source, 'x') END AS project_path,
CASE doc_id % 4 WHEN 0 THEN 'rule' ELSE 'auto-memory' END AS kind, CASE doc_id % 8 WHEN 0 THEN 'user' ELSE 'project' END AS scope, CASE doc_id % 4 WHEN 0 THEN 'rule' ELSE 'memory' END AS label, {pick("doc_id", FRONTS)} || {pick("doc_id", HEADS)} || chr(10) || chr(10) || coalesce(text, '') AS content FROM {{documents}}"""

_P = "p_name"
CLAIMS = f"""SELECT p_partkey AS claim, p_brand AS project, p_partkey % 97 AS session,
{pick("p_partkey", [f"Use {{{_P}}} for the queue instead of polling", "TODO", "no explicit decision found here", f"Choose {{{_P}}}", "改了", "Bug", f"Keep {{{_P}}}: " + "the long road is the safe one, " * 9, f"Adopt the 知识库 with {{{_P}}} for funding rate trading", f"Plan the roadmap of {{{_P}}} and its API schema", ""])} AS what,
{pick("(p_partkey - p_partkey % 3) / 3", ["it is simpler and proven", "", "- a\n- b\n- c\n- d\nand more", "insufficient context", "short", "因为 prompt 工具链更稳定, with an agent and MCP"])} AS why,
{pick("(p_partkey - p_partkey % 5) / 5", ["polling, cron", "", ""])} AS alternatives, {pick("(p_partkey - p_partkey % 7) / 7", ["2024-05-01 review", "", "a remark"])} AS trigger_text, '2024-0' || CAST(p_partkey % 9 + 1 AS STRING) || '-1' || CAST(p_partkey % 7 AS STRING) AS date,
{pick("p_partkey", [f"{{{_P}}} times out under load", "有个问题", "short", f"The cache of {{{_P}}} is stale after each deploy", "x" * 230, "It breaks\n- a\n- b\n- c\n- d\n- e now"])} AS problem,
{pick("(p_partkey - p_partkey % 2) / 2", ["the pool is too small", "", "因为" + "很长的原因" * 40])} AS diagnosis, {pick("(p_partkey - p_partkey % 3) / 3", ["", "raise the limit", "y " * 90])} AS solution, {pick("p_partkey", ["true", "no", "1", "maybe", "FALSE"])} AS recurring,
{pick("p_partkey", ["交互方式", "Interaction Style", "其他", "other", " 沟通风格 ", "Rhythm", "质量标准"])} AS category,
{pick("p_partkey", [f"prefers short answers on {{{_P}}}", "用户习惯使用中文", "Claude is slow", "Task: do it", "once", f"always checks {{{_P}}} twice before merging, and then once more after that, so that nothing is left to chance at the end of the day or of the week", "| a | b |", "nothing special"])} AS observation,
{pick("(p_partkey - p_partkey % 4) / 4", ["said so twice", "", "seen in reviews"])} AS evidence FROM {{part}}"""

RAW_TITLES = f"""SELECT p_partkey AS id, {pick("p_partkey", [f"Fix {{{_P}}} now", f"Look (@explore subagent) at {{{_P}}}", f"Look at {{{_P}}} (@expl…", f"[OC] {{{_P}}}", f"[记录] {{{_P}}}", f"src/app/main.ts: {{{_P}}}", f"tool_name: {{{_P}}}", f"<local-command-caveat>{{{_P}}}</local-command-caveat>", f"<b>{{{_P}}}</b>", f"[INFO] {{{_P}}}", f"[in_progress] {{{_P}}}...", f"{{{_P}}}……", "n/a", " ", "test", f"sources: {{{_P}}}\nKeep this", f"<!-- generated: now -->{{{_P}}}", f"sourceLabel: x\n{{{_P}}}", "!!??", f"PATH: {{{_P}}}\n当前值 4\n{{{_P}}} stays, and the rest of this line goes on, beyond eighty characters: yes", "Check the logs", "[x-y] name: a type: b", f"Oracle {{{_P}}} review", "Deploy — done", "[TEAM_STATUS] up"])} AS title FROM {{part}}"""

TABLES = {"sess": (SESSIONS, "orders"), "notes": (NOTES, "documents"), "claims": (CLAIMS, "part"), "titles": (RAW_TITLES, "part")}
#: The key by which a source's rows are dealt to tasks, and how many a task gets.
DEALT = {"orders": ("o_orderkey", 1 << 16), "documents": ("doc_id", 1 << 12), "part": ("p_partkey", 1 << 15)}


def dealt(rows: DataFrame, key: str, per_task: int) -> DataFrame:
    """``rows`` by the hash of ``key``, about ``per_task`` a task: a bound row is many times what its file holds of
    it, so that a split of a small file, or a row group as large as a table, would be far more than a task should get."""
    parts = -(-rows.count() // per_task)  # reads footers only
    return rows.repartition(parts, key) if parts > 1 else rows


def bound(spark: SparkSession, sf_dir: str, name: str, *columns: str, where: Column | None = None) -> DataFrame:
    """The table ``name``, or ``columns`` of it. As a generator's output it keeps filters, which the rules make costly, from
    being pushed below the exchange into the tasks that read the files, and makes all of its columns; ``where``, a cheap filter, is pushed there."""
    sql, source = TABLES[name]
    rows = spark.sql(sql, **{source: dealt(table(spark, sf_dir, source), *DEALT[source])})
    rows = rows if where is None else rows.where(where)
    return rows.select(F.inline(F.array(F.struct(*(columns or rows.columns)))))


def cte(*names: str) -> str:
    """The same tables as common table expressions."""
    return ",\n".join(f"{name} AS ({TABLES[name][0].replace('{' + TABLES[name][1] + '}', TABLES[name][1])})" for name in names)

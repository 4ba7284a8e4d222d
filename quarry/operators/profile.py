"""The user's profile and projects' descriptions: what a model may say of them, and what is added to it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import dictionaries as rules
from quarry.functions import text
from quarry.operators.completion import PAUSE, Model, _ask, parse_json

#: Lengths, task verbs and generic titles of what a model says of a user.
ROLE_CHARS, RESPONSIBILITY_CHARS, FOCUS_CHARS, NAME_CHARS = 30, 30, 15, 3
TASK_VERBS = "验证|修复|处理|跟进|推进|上线"
GENERIC_ROLES = r"(?i:^(产品经理|开发者|工程师|设计师|PM|engineer|developer)\z)"
#: A project's description.
SUMMARY_CHARS, LEAST_SUMMARY_CHARS, UNKNOWN = 40, 5, "(unknown)"
SUMMARY_WORDS = "用于|帮助|面向|服务|支持|提供|实现|连接|驱动|管理|分析|监控|记录|整理|检索|执行|优化|回测|交易|系统|平台|工具|助手"


def token(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), r"\s+", "")


def names_project(s: Column, projects: list[str]) -> Column:
    """Whether a text holds one of the names, of ``NAME_CHARS`` at least, whatever the spaces and case."""
    named = [p for p in ("".join(p.lower().split()) for p in projects) if len(p) >= NAME_CHARS]
    return F.when(F.lit(bool(named)), F.exists(F.array(*map(F.lit, named or [""])), lambda p: F.contains(token(s), p))).otherwise(False)


def valid_role(s: Column, projects: list[str]) -> Column:
    size = F.char_length(s)
    return (size > 0) & (size <= ROLE_CHARS) & ~s.rlike(rules.either(rules.LONG_SENTENCE, rules.PROJECT_DESCRIPTION, TASK_VERBS)) & ~names_project(s, projects) & ~F.trim(s).rlike(GENERIC_ROLES)


def valid_responsibility(s: Column, projects: list[str]) -> Column:
    return (F.char_length(s) > 0) & (F.char_length(s) <= RESPONSIBILITY_CHARS) & ~s.rlike(rules.LONG_SENTENCE) & ~names_project(s, projects)


def valid_focus(s: Column) -> Column:
    return (F.char_length(s) > 0) & (F.char_length(s) <= FOCUS_CHARS) & ~s.rlike(rules.LONG_SENTENCE)


def valid_summary(project: Column, summary: Column) -> Column:
    """Whether a description says what a project is for, and not its name or a path."""
    said, name = F.trim(summary), token(project)
    plain = token(said)
    return (F.char_length(said).between(LEAST_SUMMARY_CHARS, SUMMARY_CHARS)) & ~said.contains("/") & (plain != name) & ~((F.char_length(name) >= NAME_CHARS) & F.contains(plain, name)) & said.rlike(SUMMARY_WORDS)


def focus_hits(signals: DataFrame) -> DataFrame:
    """(label, n): the support of focus areas, and once for each text of a decision that touches the domain."""
    facts = signals.where("kind = 'profile_fact' and subject = 'focus_area'").select(F.trim("body").alias("label"), F.col("support").alias("n")).where("label <> ''")
    said = signals.where("kind = 'decision'").select(F.explode(F.array(*[F.coalesce(c, F.lit("")) for c in ("subject", "body", "reason")])).alias("s"))
    touched = said.select(F.explode(text.all_matches(F.col("s"), rules.FOCUS_DOMAINS)).alias("label"), F.lit(1).cast("long").alias("n"))
    return facts.unionByName(touched).groupBy("label").agg(F.sum("n").alias("n"))


def supplement(hits: DataFrame, said: DataFrame, least: int = 2) -> DataFrame:
    """Labels of (label, n) with ``least`` hits that a model's focus areas (area) don't have yet."""
    known = said.select(F.lower(F.trim("area")).alias("key"))
    return hits.where(F.col("n") >= least).where(valid_focus(F.col("label"))).withColumn("key", F.lower(F.trim("label"))).join(known, "key", "left_anti").drop("key")


def describe(contexts: DataFrame, model: Model, pause: float = PAUSE) -> DataFrame:
    """(project, description) of (project, titles, topics): what the model says, in batches, if it is
    valid, else ``UNKNOWN``, so that every project has one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = "\n".join(f"{k + 1}. {p}\n   - {t}\n   - {d}" for k, (p, t, d) in enumerate(zip(frame["project"], frame["titles"], frame["topics"], strict=True)))
            found = parse_json(_ask(model, [asked], pause)[0][0])
            found = [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []
            yield pd.DataFrame({"project": [str(x.get("project") or "") for x in found], "summary": [str(x.get("summary") or "") for x in found]}, dtype=str)

    said = contexts.select("project", "titles", "topics").mapInPandas(run, "project string, summary string")
    said = said.where(valid_summary(F.col("project"), F.col("summary"))).groupBy("project").agg(F.min("summary").alias("summary"))
    return contexts.select("project").join(said, "project", "left").select("project", F.coalesce("summary", F.lit(UNKNOWN)).alias("description"))


def facts_of_model(answer: DataFrame, projects: list[str]) -> DataFrame:
    """Valid facts of a model's profile, (answer) one JSON text a row: (dimension, claim, confidence).
    At most three responsibilities and eight focus areas are read."""
    profile = F.from_json("answer", "role string, responsibilities array<string>, focus_areas array<string>")
    rows = answer.select(profile.alias("p"))
    some = lambda c, n: F.slice(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, n)
    each = lambda c, n, dimension, confidence: F.transform(some(c, n), lambda x: F.struct(F.lit(dimension).alias("dimension"), x.alias("claim"), F.lit(confidence).alias("confidence")))
    rows = rows.select(F.explode(F.concat(each(F.array("p.role"), 1, "role", 0.9), each(F.col("p.responsibilities"), 3, "responsibility", 0.85), each(F.col("p.focus_areas"), 8, "focus_area", 0.85))).alias("f")).select("f.*")
    claim = F.col("claim")
    ok = F.when(F.col("dimension") == "role", valid_role(claim, projects)).when(F.col("dimension") == "responsibility", valid_responsibility(claim, projects)).otherwise(valid_focus(claim))
    return rows.where(ok)


def stub(prompts: list[str]) -> list[str]:
    """Descriptions by rule: of every project whose name doesn't end with 7."""
    out = []
    for prompt in prompts:
        names = [line.split(". ", 1)[1] for line in prompt.split("\n") if line[:1].isdigit() and ". " in line]
        out.append(json.dumps([{"project": n, "summary": "用于管理数据的系统"} for n in names if not n.endswith("7")], ensure_ascii=False))
    return out


def work_patterns(tasks: DataFrame, hours: DataFrame, firsts: DataFrame) -> DataFrame:
    """One row, ``markdown``: tables of task types (task, n, percent, example), hours (hour, n) and first
    messages (pattern, n, example), the most frequent first; all are a few rows."""
    cell = lambda c: F.when(F.col(c).isNull(), "—").otherwise(F.concat(F.lit('"'), text.table_cell(F.substring(text.clean_title(F.col(c)), 1, 40)), F.lit('"')))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    number = F.col("n").cast("string")
    listed = lambda rows, line, order: rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n").alias("t"))
    most = [(-F.col("n")).alias("k")]
    one = listed(tasks, row(text.table_cell(F.col("task")), number, F.concat(F.col("percent").cast("string"), F.lit("%")), cell("example")), [*most, F.col("task")])
    top = hours.agg(F.max("n").alias("top"))
    hour = F.lpad(F.col("hour").cast("string"), 2, "0")
    two = listed(hours.where("n > 0").crossJoin(top), row(F.concat(hour, F.lit(":00-"), hour, F.lit(":59")), F.concat(text.bar(F.col("n"), F.col("top")), F.lit(" "), number, F.lit(" sessions"))), [F.col("hour")])
    three = listed(firsts, row(text.table_cell(F.col("pattern")), number, cell("example")), [*most, F.col("pattern")])
    parts = one.withColumnRenamed("t", "a").crossJoin(two.withColumnRenamed("t", "b")).crossJoin(three.withColumnRenamed("t", "c"))  # one row each
    return parts.select(F.concat(F.lit("# 工作模式\n\n## 高频任务类型\n\n| 类型 | 频次 | 占比 | 典型 session |\n|---|---|---|---|\n"), "a", F.lit("\n\n## 时段分布\n\n| 时段 | 活跃度 |\n|---|---|\n"), "b", F.lit("\n\n## 首条消息模式\n\n| 模式 | 频次 | 示例 |\n|---|---|---|\n"), "c", F.lit("\n")).alias("markdown"))

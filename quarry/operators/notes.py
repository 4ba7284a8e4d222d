"""Memory notes: front matter, routing by type, and the records that each type gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import dictionaries as rules
from quarry.functions import text

FRONT = r"(?s)^---\s*\r?\n(.*?)\r?\n---\s*(?:\r?\n|\z)"
TYPES = ("project", "feedback", "user", "reference")
#: Rules about tools rather than about the user.
RULE_PREFERENCE = rules.either(rules.word("prefer", "avoid", "always", "never"), "偏好|禁止|总是|不要")
OPERATIONAL_RULES = rules.either(
    r"(?i:(^|[^A-Za-z0-9_])(run|execute|npm|yarn|pnpm)\s+(test|build|lint|check)([^A-Za-z0-9_]|\z))", "提交前", r"(?i:(^|[^A-Za-z0-9_])before\s+(commit|push|merge)([^A-Za-z0-9_]|\z))",
    r"(?i:(^|[^A-Za-z0-9_])ci([^A-Za-z0-9_]|[^A-Za-z0-9_][^\n]*[^A-Za-z0-9_])pipeline([^A-Za-z0-9_]|\z))", rules.word("pre-commit"),
)
AI_INSTRUCTIONS = rules.either(rules.word("in chat replies", "when the user says", r"github\s+(issues?|comments?|pr)", r"commit\s+message", r"git\s+(stash|rebase|pull|push)", "prlctl", "docker(file)?", r"npm\s+publish", "tmux", "Multi-agent safety", r"release\s+(flow|guardrail)"), r"(?i:(^|[^A-Za-z0-9_])plugin)", rules.word("Mintlify", r"Carbon\s+dependency"))


def front_block(content: Column) -> Column:
    """The lines between the marks at the top; null without them. A byte order mark is ignored."""
    plain = F.regexp_replace(content, "^﻿", "")
    return F.when(plain.rlike(FRONT), F.regexp_extract(plain, FRONT, 1))


def field(block: Column, name: str) -> Column:
    """The value of a flat ``name: value`` line, without quotes; null without one."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?m)^{name}[ \t]*:[ \t]*([^\r\n]*)", 1), r"""^["']|["']\s*\z""", "")), F.lit(""))


def parsed(notes: DataFrame) -> DataFrame:
    """``notes`` (content, ...) with has_front, memory_type, date, paths and body."""
    rows = notes.withColumn("block", front_block(F.col("content")))
    block = F.col("block")
    day = lambda name: F.date_format(F.try_to_timestamp(field(block, name)), "yyyy-MM-dd")
    listed = F.regexp_replace(F.coalesce(field(block, "paths"), F.regexp_replace(F.regexp_extract(block, r"(?m)^paths[ \t]*:[ \t]*((?:\r?\n[ \t]*-[ \t][^\r\n]*)+)", 1), r"(?m)^[ \t]*-[ \t]*", "")), r"^\[|\]\s*\z", "")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", "^﻿", ""), FRONT, ""), r"^\s+|\s+\z", "")
    return rows.withColumns({
        "has_front": block.isNotNull(), "memory_type": field(block, "type"), "date": F.when(field(block, "created").isNotNull(), day("created")).otherwise(day("updated")),
        "paths": F.coalesce(text.string_list(listed), F.array().cast("array<string>")), "body": body,
    }).drop("block")


def route(notes: DataFrame) -> DataFrame:
    """``parsed`` notes with ``goes``: rule, a memory type, or why a note is left out."""
    goes = F.when(F.col("kind") == "rule", "rule").when(~F.col("has_front"), "no front matter").when(F.col("memory_type").isNull(), "no type")
    return notes.withColumn("goes", goes.when(F.col("memory_type").isin(*TYPES), F.col("memory_type")).otherwise("unknown type"))


def project_name(path: Column) -> Column:
    return F.when(path.isNull(), "(global)").otherwise(text.path_title(path))


def profile_category(observation: Column) -> Column:
    return text.first_match(observation, rules.PROFILE_CATEGORIES, rules.OTHER_CATEGORY)


def decisions(notes: DataFrame) -> DataFrame:
    """Of routed notes, what project memories decide."""
    body = F.col("body")
    return notes.where("goes = 'project'").select(F.col("note").cast("string").alias("place"), project_name(F.col("project_path")).alias("project"), "label", text.first_sentence(body).alias("what"), text.relevant_paragraph(body, rules.BECAUSE).alias("why"), F.lit(None).cast("string").alias("alternatives"), F.lit(None).cast("string").alias("trigger_text"), "date")


def pain_points(notes: DataFrame) -> DataFrame:
    """Of routed notes, the problems that feedback tells."""
    body = F.col("body")
    return notes.where("goes = 'feedback'").select(F.col("note").cast("string").alias("place"), project_name(F.col("project_path")).alias("project"), "label", text.first_sentence(body).alias("problem"), text.relevant_paragraph(body, rules.DIAGNOSIS).alias("diagnosis"), text.relevant_paragraph(body, rules.SOLUTION).alias("solution"), body.rlike(rules.RECURRING).alias("recurring"))


def profiles(notes: DataFrame) -> DataFrame:
    """Of routed notes, the blocks of user memories, and of a user's rules those that state preferences."""
    rows = notes.where("goes = 'user' or (goes = 'rule' and scope = 'user')").select("note", "label", "goes", text.blocks(F.col("body")).alias("all"))
    kept = F.when(F.col("goes") == "rule", F.filter("all", lambda b: b.rlike(RULE_PREFERENCE) & ~b.rlike(OPERATIONAL_RULES) & ~b.rlike(AI_INSTRUCTIONS))).otherwise(F.col("all"))
    rows = rows.select("note", "label", "goes", F.posexplode(kept).alias("at", "block")).withColumn("observation", text.tidy(F.regexp_replace("block", r"^[-*+]\s+", ""))).where("observation <> ''")
    prefix = F.when(F.col("goes") == "rule", "rule-profile").otherwise("profile")
    return rows.select(text.derived_id(F.col("note").cast("string"), prefix, F.col("at").cast("string")).alias("place"), "label", profile_category(F.col("observation")).alias("category"), "observation", F.lit(None).cast("string").alias("evidence"))


def technologies(notes: DataFrame) -> DataFrame:
    """Of routed notes, the technologies that rules and references name anywhere, each with its first paragraph."""
    rows = notes.where("goes in ('rule', 'reference')")
    body = F.col("body")
    rows = text.settled(rows, parts=text.paragraphs(body), first=text.first_sentence(body))
    found = F.filter(F.array(*[F.when(body.rlike(pattern), F.struct(F.lit(k).alias("at"), F.lit(category).alias("category"), F.lit(name).alias("name"), F.coalesce(text.first_relevant(F.col("parts"), pattern), F.col("first")).alias("said"))) for k, (category, name, pattern) in enumerate(rules.TECHNOLOGIES)]), lambda x: x.isNotNull())
    rows = rows.select("note", "label", "project_path", "paths", F.explode(found).alias("t"))
    of_paths = F.when(F.size("paths") > 0, F.concat(F.lit(" (paths: "), F.array_join("paths", ", "), F.lit(")"))).otherwise("")
    return rows.select(text.derived_id(F.col("note").cast("string"), F.lit("tech"), F.col("t.at").cast("string")).alias("place"), "label", "t.category", "t.name", F.concat("t.said", of_paths).alias("description"), F.when(F.col("project_path").isNotNull(), text.path_title(F.col("project_path"))).alias("project"))

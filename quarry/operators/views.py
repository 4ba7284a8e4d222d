"""Ranked views under item and character budgets.

Items are rows (section, id, line, ...) with a place; a view keeps a bounded number of them, so that
its last windows run over rows that per-section caps and a global top-k have already bounded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import dictionaries as rules
from quarry.functions import text
from quarry.scratch import materialize

DAY_MS = 86_400_000
#: Characters, items, items of a section, sections.
BUDGETS = {"weekly_focus": (6000, 30, 12, 3), "timeline": (18_000, 80, 80, 80), "open_threads": (12_000, 60, 10, 60), "decisions": (16_000, 50, 50, 50), "pain_points": (12_000, 35, 35, 1), "tech_preferences": (12_000, 40, 10, 5), "work_profile": (10_000, 30, 30, 4)}
#: Sections of the weekly view, ranks of statuses, recurrences and stances.
WEEKLY = ("进行中", "已完成", "关键决策")
STATUS_RANK, RECURRENCE_RANK, STANCE_RANK = {"in_progress": 0, "blocked": 1, "open": 2}, {"high": 2, "medium": 1, "low": 0}, {"prefer": 2, "avoid": 1, "conditional": 0}
DIMENSION_ORDER = ("交互风格", "语言偏好", "技术审美", "工作节奏")
LEAST_PER_PROJECT = 3
#: Of how many last days views read timeline events, those of all time if they aren't named.
EVENT_DAYS = {"weekly_focus": 7, "work_profile": 30}
PLACEHOLDER = "(待提取)"


def rank_of(c: str, ranks: dict[str, int], other: int) -> Column:
    out = F
    for name, n in ranks.items():
        out = out.when(F.col(c) == name, n)
    return out.otherwise(other)


def timeline_ms() -> Column:
    return F.coalesce(F.unix_millis(F.try_to_timestamp("detail")), F.col("last_ms"))


def effective_date() -> Column:
    """The date that a decision's trigger begins with, else the day it was last seen."""
    return F.coalesce(F.nullif(F.regexp_extract("trigger", r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.date_format(F.timestamp_millis("last_ms"), "yyyy-MM-dd"))


def _desc(*columns) -> list[Column]:
    return [F.desc(c) if isinstance(c, str) else c.desc() for c in columns] + [F.asc("id")]


#: How each kind's signals are ranked, best first.
ORDERS = {
    "weekly": lambda: _desc("trust", "support", "last_ms"), "timeline_event": lambda: _desc(timeline_ms(), "trust", "support", "last_ms"),
    "open_thread": lambda: [rank_of("body", STATUS_RANK, 9).asc(), *_desc("last_ms", "trust", "support")], "decision": lambda: _desc(effective_date(), "trust", "support", "confidence", "last_ms"),
    "pain_point": lambda: _desc(rank_of("detail", RECURRENCE_RANK, 0), "trust", "support", "confidence", "last_ms"), "tech_preference": lambda: _desc("trust", "support", "confidence", rank_of("detail", STANCE_RANK, 0), "last_ms"),
    "work_style": lambda: _desc("trust", "support", "confidence", "last_ms"), "profile_fact": lambda: _desc("trust", "support", "confidence", "last_ms"),
}


def active(signals: DataFrame, kind: str) -> DataFrame:
    return signals.where((F.col("status") == "active") & (F.col("kind") == kind))


def capped(rows: DataFrame, section: str, order: list[Column], per_section: int) -> DataFrame:
    """The first ``per_section`` rows of every section, numbered."""
    n = F.row_number().over(Window.partitionBy(section).orderBy(*order))
    return rows.withColumn("item_rank", n).where(F.col("item_rank") <= per_section)


def item_budget(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of the whole view, with their place."""
    top = rows.orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def char_budget(rows: DataFrame, line: str, most_chars: int) -> DataFrame:
    """Rows up to the first that would exceed the characters (a line break each); rows have ``place``."""
    used = F.sum(F.char_length(line) + 1).over(Window.orderBy("place"))
    return rows.withColumn("used", used).where(F.col("used") <= most_chars)


def _whole(rows: DataFrame, fold) -> DataFrame:
    """A sequential fold over all rows of a bounded view."""
    return rows.withColumn("_view", F.lit(0)).groupBy("_view").applyInPandas(lambda pdf: fold(pdf).drop(columns="_view"), rows.schema)


def skip_budget(rows: DataFrame, line: str, most_chars: int) -> DataFrame:
    """Rows taken in order, leaving out those that no longer fit, for a bounded view."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = most_chars, []
        for size in pdf.sort_values("place")[line].str.len() + 1:
            keep.append(size <= left)
            left -= size if keep[-1] else 0
        return pdf.sort_values("place")[keep]

    return _whole(rows, fold)


def within(texts: list[str]) -> list[list[int]]:
    """For each of different texts those of them that it contains, itself left out, by one automaton of all of them."""
    import ahocorasick

    words = ahocorasick.Automaton()
    for k, s in enumerate(texts):
        words.add_word(s, k)
    words.make_automaton()
    return [sorted({k for _, k in words.iter(s)} - {n}) for n, s in enumerate(texts)]


def greedy_distinct(rows: DataFrame, line: str, section: str | None = None) -> DataFrame:
    """Rows in order, without those whose text contains or is contained in an earlier kept one of
    their section (of the whole view, if none is named). Blank texts go. Sections are dealt to tasks; in one, texts
    meet those that they contain through an Aho-Corasick automaton, not each other."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        names = [s for s in dict.fromkeys(pdf[line]) if s]
        place = {s: k for k, s in enumerate(names)}
        inside = within(names) if names else []
        around: list[list[int]] = [[] for _ in names]
        for k, parts in enumerate(inside):
            for part in parts:
                around[part].append(k)
        kept, keep = [False] * len(names), []
        for s in pdf[line]:
            k = place.get(s)
            keep.append(k is not None and not kept[k] and not any(kept[o] for o in inside[k]) and not any(kept[o] for o in around[k]))
            if keep[-1]:
                kept[k] = True
        return pdf[keep]

    if section is None:
        return _whole(rows, fold)
    return rows.groupBy(section).applyInPandas(fold, rows.schema)


def chunk_by_chars(rows: DataFrame, line: str, most_chars: int) -> DataFrame:
    """Rows of a bounded view in chunks, in order: a chunk ends before the row with which its text and
    a separator of one character a row would pass ``most_chars``; a longer row stands alone."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        chunk, used, out = 0, 0, []
        for size in pdf[line].str.len() + 1:
            if used and used + size > most_chars:
                chunk, used = chunk + 1, 0
            used += size
            out.append(chunk)
        return pdf.assign(chunk=out)

    schema = rows.withColumn("chunk", F.lit(0)).schema
    return rows.withColumn("chunk", F.lit(0)).withColumn("_view", F.lit(0)).groupBy("_view").applyInPandas(lambda pdf: fold(pdf).drop(columns="_view"), schema)


def weekly_focus(signals: DataFrame, now_ms: Column, days: int = EVENT_DAYS["weekly_focus"], look: int = 1) -> DataFrame:
    """Open threads begun within the days in projects whose timeline moved, what was completed, and decisions."""
    chars, items, per_section, _ = BUDGETS["weekly_focus"]
    since, named = now_ms - days * DAY_MS, signals.where("status = 'active' and coalesce(project, '') <> ''")
    moved = named.where("kind = 'timeline_event'").where(timeline_ms() >= since)
    threads = named.where("kind = 'open_thread'").where(F.col("first_ms") >= since).join(moved.select("project").distinct(), "project", "left_semi")
    done = moved.where((F.col("body") == "delivery") | F.col("subject").rlike(rules.COMPLETION))
    decided = named.where("kind = 'decision'").where(F.col("last_ms") >= since)
    columns = ("id", "kind", "project", *[c for c in ("subject", "detail", "reason", "trigger", "trust", "support", "last_ms")])
    rows = [part.select(F.lit(k).alias("section_rank"), F.lit(name).alias("section"), *columns) for k, (name, part) in enumerate(zip(WEEKLY, (threads, done, decided), strict=True))]
    rows = capped(rows[0].unionByName(rows[1]).unionByName(rows[2]), "section", ORDERS["weekly"](), per_section)
    at = F.when(F.col("kind") == "timeline_event", F.try_to_timestamp("detail")).when(F.col("kind") == "decision", F.try_to_timestamp(F.coalesce("trigger", F.date_format(F.timestamp_millis("last_ms"), "yyyy-MM-dd")))).otherwise(F.timestamp_millis("last_ms"))
    title = text.clean_title(F.col("subject"))
    why = text.clean_view(F.col("reason"))
    said = F.when(F.col("kind") == "decision", F.concat(F.lit("决定："), title, F.when((why == "") | (why == title), "").otherwise(F.concat(F.lit("；原因："), why)))).otherwise(title)
    line = F.concat(F.lit("- ["), text.clean_project(F.col("project")), F.lit("] "), text.date_label(at, F.timestamp_millis(now_ms)), F.lit(" · "), said)
    return item_budget(rows, [F.asc("section_rank"), F.asc("item_rank")], items).withColumn("line", line)


def shares(projects: DataFrame, most: int, least: int = LEAST_PER_PROJECT) -> DataFrame:
    """How many of ``most`` items each project gets: ``projects`` (project, size, place from 1 in the
    view's order). If ``least`` for each fit, they get these, then in order a share of what is left by
    size, then in order what they can still use; else all the same number."""
    n, total = F.count("*").over(Window.partitionBy()), F.sum("size").over(Window.partitionBy())
    top = projects.orderBy("place").limit(most + 1).withColumns({"all": n, "total": total})

    def first(a: Column, x: Column) -> Column:
        extra = F.greatest(F.lit(0), F.least(F.floor(x["size"] / x["total"] * a["left"]).cast("long"), x["size"] - least, a["left"]))
        return F.struct((a["left"] - extra).alias("left"), F.concat(a["out"], F.array(F.struct(x["project"].alias("project"), x["size"].alias("size"), (extra + least).alias("share")))).alias("out"))

    def second(a: Column, x: Column) -> Column:
        extra = F.greatest(F.lit(0), F.least(x["size"] - x["share"], a["left"]))
        return F.struct((a["left"] - extra).alias("left"), F.concat(a["out"], F.array(F.struct(x["project"].alias("project"), x["size"].alias("size"), (x["share"] + extra).alias("share")))).alias("out"))

    kind = "array<struct<project:string,size:bigint,share:bigint>>"
    rows = top.groupBy("all").agg(F.array_sort(F.collect_list(F.struct("place", "project", F.col("size").cast("long").alias("size"), F.col("total").cast("long").alias("total")))).alias("p"))
    start = lambda left: F.struct(left.cast("long").alias("left"), F.array().cast(kind).alias("out"))
    rows = rows.withColumn("a", F.aggregate("p", start(F.lit(most) - F.col("all") * least), first))
    rows = rows.withColumn("b", F.aggregate("a.out", start(F.col("a.left")), second))
    same = F.transform("p", lambda x: F.struct(x["project"].alias("project"), x["size"].alias("size"), F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("all"))).cast("long").alias("share")))
    return rows.select(F.explode(F.when(F.col("all") * least <= most, F.col("b.out")).otherwise(same)).alias("s")).select("s.project", "s.share")


def timeline(signals: DataFrame, now_ms: Column, look: int = 1) -> DataFrame:
    """Events by project, the latest project first; titles of little value only beside others, one a project."""
    _, items, _, _ = BUDGETS["timeline"]
    rows = active(signals, "timeline_event").where(~text.is_noise(F.col("subject")))
    rows = rows.select("id", F.col("project").alias("of"), "subject", "detail", "trust", "support", "last_ms", timeline_ms().alias("at"))
    rows = text.settled(rows, section=text.clean_project(F.col("of")), title=text.clean_title(F.col("subject"))).drop("of", "subject")
    rows = rows.withColumn("low", F.col("title").rlike(rules.LOW_VALUE_TITLES) | ((F.char_length("title") > 80) & F.col("title").rlike("[，。！？、；：\"'【】（）…]{2,}") & F.col("title").rlike("(https?://|resume|面试|简历)")))
    rows = materialize(rows)  # the projects' shares and the items both read it
    best = [F.desc("at"), F.desc("trust"), F.desc("support"), F.desc("last_ms"), F.asc("id")]
    valued = F.max((~F.col("low")).cast("int")).over(Window.partitionBy("section"))
    rows = rows.withColumns({"valued": valued, "nth": F.row_number().over(Window.partitionBy("section", "low").orderBy(*best))}).where("valued = 1 and (not low or nth = 1)")
    projects = rows.groupBy(F.col("section").alias("project")).agg(F.count("*").alias("size"), F.max("at").alias("latest"))
    projects = item_budget(projects, [F.desc("latest"), F.desc("size"), F.asc("project")], items + 1)
    budget = projects.select("project", "size", "place").join(shares(projects, items), "project").select(F.col("project").alias("section"), F.col("place").alias("section_rank"), "share")
    shown = [F.asc("low"), *best]
    kept = rows.join(F.broadcast(budget), "section").withColumn("item_rank", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("detail"), *shown))).where("item_rank <= share")
    return item_budget(kept, [F.asc("section_rank"), F.asc("item_rank")], items).withColumn("line", F.concat(F.lit("- "), "title"))


def open_threads(signals: DataFrame, now_ms: Column, look: int = 1) -> DataFrame:
    """Threads by project, the latest project first, then by status; idle ones say since when."""
    _, items, per_section, _ = BUDGETS["open_threads"]
    rows = active(signals, "open_thread").where(F.col("body").isin(*STATUS_RANK)).withColumn("section", text.clean_project(F.col("project")))
    rows = rows.withColumn("latest", F.max("last_ms").over(Window.partitionBy("section")))
    rows = capped(rows, "section", ORDERS["open_thread"](), per_section)
    rows = item_budget(rows, [F.desc("latest"), F.asc("section"), F.asc("item_rank")], items)
    idle = text.staleness(F.col("last_ms"), now_ms)
    return rows.withColumn("line", F.concat(F.lit("- "), text.date_label(F.timestamp_millis("last_ms"), F.timestamp_millis(now_ms)), F.lit(" · "), text.clean_title(F.col("subject")), F.coalesce(F.concat(F.lit("（"), idle, F.lit("）")), F.lit(""))))


def decisions(signals: DataFrame, now_ms: Column, look: int = 1) -> DataFrame:
    """Decisions by project; of those of one day that say the same, the one of most trust and support."""
    _, items, _, _ = BUDGETS["decisions"]
    rows = active(signals, "decision").withColumns({"section": text.clean_project(F.col("project")), "day": effective_date(), "same": text.normalize(text.clean_title(F.col("body")))})
    best = [F.desc("trust"), F.desc("support"), F.desc("confidence"), F.desc("last_ms"), F.asc("id")]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("section", "day", "same").orderBy(*best))).where("nth = 1")
    rows = capped(rows, "section", ORDERS["decision"](), items)
    rows = text.settled(item_budget(rows, [F.asc("section"), F.asc("item_rank")], look * items), topic=text.clean_title(F.col("subject")), decided=text.clean_title(F.col("body")), why=text.clean_evidence(F.col("reason"), 250), others=text.clean_evidence(F.col("extra"), 120))
    point = lambda name, c, shown: F.when(shown, F.concat(F.lit(f"- **{name}**: "), c))
    decided = F.col("decided")
    parts = (F.concat(F.lit("### "), "day"), point("主题", "topic", ~text.near_duplicates(F.col("topic"), decided)), point("决定", "decided", F.lit(True)), point("理由", "why", (F.col("why") != "") & (F.col("why") != decided)), point("替代方案", "others", F.col("others") != ""), point("依据强度", text.trust_shown(F.col("trust"), F.col("support")), F.lit(True)))
    return rows.withColumn("line", F.concat_ws("\n", *parts))


def pain_points(signals: DataFrame, now_ms: Column, look: int = 1) -> DataFrame:
    """Problems that come with a diagnosis or a workaround, the most frequent first."""
    _, items, _, _ = BUDGETS["pain_points"]
    rows = text.settled(active(signals, "pain_point").withColumn("section", F.lit("")), diagnosed=text.clean_evidence(F.col("body"), 250), solved=text.clean_evidence(F.col("reason"), 250)).where("diagnosed <> '' or solved <> ''")
    rows = item_budget(rows, ORDERS["pain_point"](), items)
    point = lambda name, c: F.when(c != "", F.concat(F.lit(f"- **{name}**: "), c))
    parts = (F.concat(F.lit("## "), text.clean_title(F.col("subject"))), point("诊断", F.col("diagnosed")), point("解决方式", F.col("solved")), point("复发频率", text.shown(F.col("detail"), text.RECURRENCE_SHOWN, lower=True)), point("依据强度", text.trust_shown(F.col("trust"), F.col("support"))))
    return rows.withColumn("line", F.concat_ws("\n", *parts))


def tech_groups(signals: DataFrame) -> DataFrame:
    """Signals by technology, whatever its case: the best one, support in all, projects, joint stance."""
    rows = active(signals, "tech_preference").withColumn("technology", F.lower("subject"))
    has = lambda s: F.bool_or(F.col("detail") == s)
    stance = F.when(has("prefer") & has("avoid"), "conditional").when(has("prefer"), "prefer").when(has("avoid"), "avoid").otherwise("conditional")
    rank = F.struct((-F.col("trust")).alias("t"), (-F.col("support")).alias("s"), (-F.col("confidence")).alias("c"), (-rank_of("detail", STANCE_RANK, 0)).alias("r"), (-F.col("last_ms")).alias("m"), "id")
    groups = rows.groupBy("technology").agg(F.min_by(F.struct("id", "subject", "body", "reason", "trust"), rank).alias("best"), F.sum("support").alias("support"), F.count_distinct("project").alias("projects"), stance.alias("stance"))
    return groups.select("technology", "best.id", "best.subject", F.col("best.body").alias("section"), "best.reason", "best.trust", "support", "projects", "stance")


def tech_preferences(signals: DataFrame, now_ms: Column, look: int = 1) -> DataFrame:
    """Technologies by category in the fixed order, by name within."""
    _, items, per_section, sections = BUDGETS["tech_preferences"]
    place = F.when(F.array_position(F.array(*map(F.lit, rules.TECH_CATEGORIES)), F.col("section")) > 0, F.array_position(F.array(*map(F.lit, rules.TECH_CATEGORIES)), F.col("section"))).otherwise(99)
    rows = capped(tech_groups(signals).withColumn("section_rank", place), "section", [F.asc("subject"), F.asc("id")], per_section)
    chosen = rows.select("section", "section_rank").distinct().orderBy("section_rank", "section").limit(sections)
    rows = rows.join(F.broadcast(chosen.select("section")), "section", "left_semi")
    why = text.clean_evidence(text.sanitize_line(F.col("reason")), 100)
    more = F.when(F.col("projects") > 1, F.concat(F.lit(", "), F.col("projects").cast("string"), F.lit(" 个项目"))).otherwise("")
    line = F.concat(F.lit("- **"), "subject", F.lit("** ("), text.shown(F.col("stance"), text.STANCE_SHOWN, lower=True), F.lit(")"), F.when(why != "", F.concat(F.lit(": "), why)).otherwise(""), F.lit(" — *"), F.col("support").cast("string"), F.lit(" 条证据"), more, F.lit(", 信任度 "), F.col("trust").cast("string"), F.lit("*"))
    return item_budget(rows, [F.asc("section_rank"), F.asc("section"), F.asc("item_rank")], look * items).withColumn("line", line)


def work_styles(signals: DataFrame, look: int = 4) -> DataFrame:
    """(place, section, id, same, line) of claims by dimension; ``same`` is what tells repeated ones."""
    _, items, per_section, sections = BUDGETS["work_profile"]
    rows = active(signals, "work_style").withColumns({"section": F.col("subject"), "section_rank": rank_of("subject", {d: k for k, d in enumerate(DIMENSION_ORDER)}, 99)})
    chosen = rows.select("section", "section_rank").distinct().orderBy("section_rank", "section").limit(sections)
    rows = capped(rows.join(F.broadcast(chosen.select("section")), "section", "left_semi"), "section", ORDERS["work_style"](), look * per_section)
    rows = item_budget(rows, [F.asc("section_rank"), F.asc("section"), F.asc("item_rank")], look * items)
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    rows = text.settled(rows, why=text.sanitize_line(F.coalesce("reason", F.lit(""))))
    why = F.col("why")
    rows = text.settled(rows, told=text.clean_evidence(why, 70))
    shown = F.when((why != "") & (plain(why) != plain(F.col("body"))), F.concat(F.lit(" — *"), "told", F.lit("*"))).otherwise("")
    line = F.concat(F.lit("- "), "body", shown, F.lit(" ("), F.col("support").cast("string"), F.lit(" 条证据, 信任度 "), F.col("trust").cast("string"), F.lit(")"))
    return rows.select("place", "section", "id", text.dedupe_key(F.col("body")).alias("same"), line.alias("line"))


def work_profile(signals: DataFrame, now_ms: Column, look: int = 1) -> DataFrame:
    """Claims by dimension, without those that say what an earlier one does; what doesn't fit is left out."""
    chars, items, _, _ = BUDGETS["work_profile"]
    rows = greedy_distinct(work_styles(signals), "same", "section").select("place", "section", "id", "line")
    return item_budget(skip_budget(rows, "line", chars).withColumnRenamed("place", "ranked"), [F.asc("ranked")], items)


def core_profile(signals: DataFrame, now_ms: Column, days: int = EVENT_DAYS["work_profile"]) -> DataFrame:
    """One row of the facts of global scope: role, main and further responsibilities, focus areas; and the
    busiest projects of the days."""
    facts = active(signals, "profile_fact").where("detail = 'global'").withColumn("n", F.row_number().over(Window.partitionBy("subject").orderBy(*ORDERS["profile_fact"]()))).where("n <= 15")
    focus = facts.where("subject = 'focus_area'").withColumn("same", F.lower(F.regexp_replace("body", r"\s+", "")))
    focus = focus.withColumn("k", F.row_number().over(Window.partitionBy("same").orderBy("n"))).where("k = 1").orderBy("n").limit(10)
    listed = lambda df, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]), sep)
    said = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(PLACEHOLDER))
    one = facts.agg(
        said(F.min(F.when((F.col("subject") == "role") & (F.col("n") == 1), F.col("body")))).alias("role"),
        said(F.concat_ws("，", F.max(F.when((F.col("subject") == "responsibility") & (F.col("n") == 1), F.col("body"))), F.max(F.when((F.col("subject") == "responsibility") & (F.col("n") == 2), F.col("body"))))).alias("main"),
        said(F.concat_ws("，", F.max(F.when((F.col("subject") == "responsibility") & (F.col("n") == 3), F.col("body"))), F.max(F.when((F.col("subject") == "responsibility") & (F.col("n") == 4), F.col("body"))))).alias("further"),
    )
    busy = active_projects(signals, now_ms, days).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "project")))
    projects = busy.agg(said(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "project"))), lambda x: x["project"]), ", ")).alias("projects"))
    return one.crossJoin(focus.agg(said(listed(focus, ", ")).alias("focus"))).crossJoin(projects)  # three rows of one each


def active_projects(signals: DataFrame, now_ms: Column, days: int = 30, most: int = 5) -> DataFrame:
    """The projects with most signals seen within the days: (project, n)."""
    rows = signals.where((F.col("status") == "active") & F.col("project").isNotNull() & (F.col("last_ms") >= now_ms - days * DAY_MS))
    return rows.groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(most)


VIEWS = {"weekly_focus": weekly_focus, "timeline": timeline, "open_threads": open_threads, "decisions": decisions, "pain_points": pain_points, "tech_preferences": tech_preferences, "work_profile": work_profile}


def markdown(rows: DataFrame, title: str, section: str, line: str) -> DataFrame:
    """One row with the text of a view whose rows are bounded and have ``place``."""
    sections = rows.groupBy(section).agg(F.min("place").alias("at"), F.array_sort(F.collect_list(F.struct("place", F.col(line).alias("line")))).alias("items"))
    body = F.concat(F.lit("## "), F.col(section), F.lit("\n"), F.array_join(F.transform("items", lambda x: x["line"]), "\n"))
    parts = F.array_sort(F.collect_list(F.struct("at", body.alias("body"))))
    return sections.agg(parts.alias("parts")).select(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("parts", lambda x: x["body"]), "\n\n"), F.lit("\n")).alias("markdown"))


def finalize(header: Column, body: Column, most: int) -> Column:
    """Header and body within ``most`` characters: as many leading paragraphs as fit, or if none does
    lines, or if none does sentences, or the header alone."""
    size, whole = F.char_length, F.concat(header, body)

    def fitting(parts: Column, between: str, tail: str) -> Column:
        def take(a: Column, part: Column) -> Column:
            longer = F.when(a["n"] == 0, part).otherwise(F.concat(a["out"], F.lit(between), part))
            fits = a["on"] & (size(header) + size(longer) + len(tail) <= most)
            return F.struct(F.when(fits, longer).otherwise(a["out"]).alias("out"), (a["n"] + fits.cast("int")).alias("n"), fits.alias("on"))

        got = F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(True).alias("on")), take)
        return F.when(got["n"] > 0, F.concat(header, got["out"], F.lit(tail)))

    plain = F.regexp_replace(body, r"^\s+|\s+\z", "")
    sentences = F.regexp_extract_all(plain, F.lit(r"([^。.!！？]+[。.!！？]?)"), F.lit(1))
    cut = F.coalesce(fitting(F.split(plain, "\n\n+"), "\n\n", "\n"), fitting(F.split(plain, "\n"), "\n", "\n"), fitting(sentences, "", "\n"), header)
    return F.when(size(whole) <= most, whole).when((size(header) > most) | (plain == ""), header).otherwise(cut)

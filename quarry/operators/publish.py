"""Published views: ranked items packed to a document under a budget of characters and items.

A document is a header, sections of a heading and lines, metadata and the reader's own notes. Items come
in order; each is tested against the length of the whole document that it would make. What an overflow
ends is a view's own rule:

- ``section``: the section of the item; later sections are tried (decisions, technologies);
- ``all``: the view (pain points, where every item is a section);
- ``item``: the item only (work profile);
- ``none``: nothing is tested, the document is cut at last (weekly focus, timeline, open threads).

Polished sections may be longer than their drafts. Trailing sections are then dropped until the document
fits, and their signals' ids leave its source ids with them. The packing is one walk over the array of the
items that a view looks at, of bounded length; ranking, dates and texts before it are the work of all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import views
from quarry.operators.completion import PAUSE, Model, polish_packed

#: Titles of the views, and the notes of a document that has none of its reader's yet.
TITLES = {"weekly_focus": "本周重点", "timeline": "项目时间线", "open_threads": "未完成线索", "decisions": "决策日志", "pain_points": "反复痛点", "tech_preferences": "技术偏好", "work_profile": "工作画像"}
DEFAULT_NOTES = "<!-- user notes -->\n<!-- 在此处添加个人备注，全量重建时不会被覆盖 -->\n<!-- /user notes -->"
CORE_TITLE = "核心画像"
RULES = {"weekly_focus": "none", "timeline": "none", "open_threads": "none", "decisions": "section", "pain_points": "all", "tech_preferences": "section", "work_profile": "item"}
#: How many times its item budget a view looks at: items that are skipped make room for later ones.
LOOK = {"decisions": 20, "tech_preferences": 2, "work_profile": 4}


@dataclass(frozen=True)
class Budget:
    """Characters, items in all and in a section."""

    chars: int
    items: int
    per_section: int

    @staticmethod
    def of(view: str, **changes: int) -> Budget:
        chars, items, per_section, _ = views.BUDGETS[view]
        return Budget(**({"chars": chars, "items": items, "per_section": per_section} | changes))


@dataclass(frozen=True)
class Frame:
    """What surrounds the sections: columns of one value each."""

    title: str
    metadata: Column
    notes: Column | None  # None: the view keeps none
    lead: Column | None = None  # stands before the sections

    @property
    def header(self) -> Column:
        return F.lit(f"# {self.title}\n")

    def body(self, sections: Column) -> Column:
        """What follows the header, with the joined sections."""
        some, lead = sections != "", self.lead if self.lead is not None else F.lit("")
        if self.notes is None:
            return F.concat(F.lit("\n"), F.when(some, F.concat(sections, F.lit("\n"))).otherwise(""), self.metadata)
        lead = F.when(lead != "", F.concat(F.lit("\n"), lead, F.lit("\n"))).otherwise("")
        return F.concat(lead, F.lit("\n"), F.when(some, F.concat(sections, F.lit("\n\n"))).otherwise(""), self.metadata, self.notes, F.lit("\n"))

    def around(self) -> Column:
        """Characters of the document without sections."""
        return F.char_length(F.concat(self.header, self.body(F.lit(""))))

    @property
    def more(self) -> int:
        """Characters that come with the first section, besides its own."""
        return 1 if self.notes is None else 2


def metadata(now_ms: Column, sources: str) -> Column:
    at = F.date_format(F.timestamp_millis(now_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat(F.lit("<!-- generated: "), at, F.lit(f" | sources: {sources} -->\n"))


def notes_of(previous: str | None) -> Column:
    """The reader's notes in the document published before, else the default ones."""
    return F.coalesce(text.user_notes(F.lit(previous).cast("string")), F.lit(DEFAULT_NOTES))


def pack(items: DataFrame, frame: Frame, budget: Budget, rule: str) -> DataFrame:
    """The items that the document holds, with ``nth`` (from 1, of those). ``items``: place, section,
    heading ('' where the item has its own), sub (a line above the first item of its kind in a section, or null), line,
    same (null, or what an item says: one that contains, or is contained in, what the section says already is left out)."""
    size = F.char_length
    columns = ("place", "section", size("heading").alias("head"), F.coalesce("sub", F.lit("")).alias("sub"), size("line").alias("size"), "same")
    whole = items.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("all")).withColumn("around", frame.around())
    more = frame.more

    @F.pandas_udf("array<long>")
    def held(alls: pd.Series, around: pd.Series) -> pd.Series:
        return pd.Series([_held(rows, base + more, budget, rule) for rows, base in zip(alls, around, strict=True)])

    kept = whole.select(F.posexplode(held("all", "around")).alias("k", "place"))
    return items.join(F.broadcast(kept.select("place", (F.col("k") + 1).alias("nth"))), "place")


def _held(items, base: int, budget: Budget, rule: str) -> list[int]:
    """Places of the items that are packed, by one walk over those that the view looks at; ``base`` is what the
    document measures besides its sections, once it has one."""
    keep: list[int] = []
    done, section, sub, own, n, shut, said = base, None, "", 0, 0, False, []
    for x in items:
        if x["section"] != section:  # a section that nothing was written of leaves no trace
            done += own + 2 if n else 0
            section, sub, own, n, said = x["section"], "", 0, 0, []
            shut = shut and rule == "all"
        same = x["same"]
        if shut or n >= budget.per_section or len(keep) >= budget.items or (same is not None and (not same or any(same in s or s in same for s in said))):
            continue
        longer = (own if n else x["head"] or -1) + (len(x["sub"]) + 1 if x["sub"] and x["sub"] != sub else 0) + x["size"] + 1
        if rule == "none" or done + longer <= budget.chars:
            own, n, sub = longer, n + 1, x["sub"]
            said += [same] if same is not None else []
            keep.append(x["place"])
        else:
            shut = rule in ("section", "all")
    return keep


def sections_of(packed: DataFrame) -> DataFrame:
    """(n, title, draft, ids) of the sections of packed items (with ``ids``, an array), in order."""
    line = lambda x: F.concat(F.when(x["new"], F.concat(x["sub"], F.lit("\n"))).otherwise(""), x["line"])
    per = packed.groupBy("section").agg(F.min("nth").alias("at"), F.min("heading").alias("heading"), F.array_sort(F.collect_list(F.struct("nth", F.coalesce("sub", F.lit("")).alias("sub"), "line", "ids"))).alias("items"), F.max("tail").alias("tail"))
    marked = F.transform("items", lambda x, k: F.struct(((x["sub"] != "") & ((k == 0) | (F.get("items", k - 1)["sub"] != x["sub"]))).alias("new"), x["sub"].alias("sub"), x["line"].alias("line")))
    lines = F.array_join(F.transform(marked, line), "\n")
    draft = F.concat(F.when(F.col("heading") != "", F.concat("heading", F.lit("\n"))).otherwise(""), lines, F.when(F.col("tail").isNotNull(), F.concat(F.lit("\n"), "tail")).otherwise(""))
    ids = F.flatten(F.transform("items", lambda x: x["ids"]))
    rows = per.select("at", F.col("section").alias("title"), draft.alias("draft"), ids.alias("ids"))
    numbered = rows.agg(F.array_sort(F.collect_list(F.struct("at", "title", "draft", "ids"))).alias("all")).select(F.posexplode("all").alias("k", "s"))
    return numbered.select((F.col("k") + 1).cast("long").alias("n"), "s.title", "s.draft", "s.ids")


def document(sections: DataFrame, frame: Frame, budget: Budget, more: DataFrame | None = None) -> DataFrame:
    """(n, title, text, ids): as many leading ``sections`` (n, title, text, ids) as the document can hold, and as row 0 the document.
    ``more``: one row with the ids behind what stands before the sections."""
    listed = F.array_sort(F.collect_list(F.struct("n", "title", "text", "ids")))
    whole = sections.agg(listed.alias("all")).withColumn("around", frame.around().cast("long"))
    whole = whole.crossJoin(more.toDF("facts")) if more is not None else whole.withColumn("facts", F.array().cast("array<string>"))  # one row of one
    joined = lambda k: F.array_join(F.transform(F.slice("all", 1, k), lambda s: s["text"]), "\n\n")
    fits = lambda k: F.when(k == 0, F.col("around")).otherwise(F.col("around") + frame.more + F.char_length(joined(k))) <= budget.chars
    held = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.size("all")), fits)), F.lit(0))
    rows = text.settled(whole, held=held)
    rows = text.settled(rows, bare=F.col("around") > budget.chars, kept=F.slice("all", 1, F.col("held")), body=frame.body(joined(F.col("held"))))
    rows = text.settled(rows, said=views.finalize(frame.header, F.col("body"), budget.chars))
    said = F.col("said")
    own = F.flatten(F.transform("kept", lambda s: s["ids"]))
    ids = F.array_distinct(F.concat("facts", own))
    one = F.struct(F.lit(0).cast("long").alias("n"), F.lit(frame.title).alias("title"), F.when(said.endswith("\n"), said).otherwise(F.concat(said, F.lit("\n"))).alias("text"), F.when(F.col("bare"), F.array().cast("array<string>")).otherwise(ids).alias("ids"))
    rows = rows.select(F.explode(F.concat(F.array(one), "kept")).alias("s"))
    return rows.select("s.n", "s.title", "s.text", "s.ids")


def items_of(view: str, signals: DataFrame, now_ms: Column) -> DataFrame:
    """What a view looks at, ready to be packed, with the ids of the signals behind each item."""
    rows = views.work_styles(signals, LOOK[view]) if view == "work_profile" else views.VIEWS[view](signals, now_ms, look=LOOK.get(view, 1)).withColumn("same", F.lit(None).cast("string"))
    heading = F.concat(F.lit("## "), "section")
    columns = {"heading": heading, "sub": F.lit(None).cast("string"), "tail": F.lit(None).cast("string"), "ids": F.array("id")}
    if view == "pain_points":
        columns |= {"heading": F.lit(""), "section": F.format_string("%09d", "place")}
    if view == "timeline":
        columns["sub"] = F.concat(F.lit("### "), "detail")
    if view == "open_threads":
        columns["sub"] = F.concat(F.lit("### "), text.shown(F.col("body"), text.STATUS_SHOWN))
    if view == "tech_preferences":
        one = views.active(signals, "tech_preference").withColumn("technology", F.lower("subject"))
        behind = one.join(F.broadcast(rows.select("technology")), "technology", "left_semi").groupBy("technology").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        rows, columns = rows.join(behind, "technology"), {k: v for k, v in columns.items() if k != "ids"}
    return rows.withColumns(columns).select("place", "section", "heading", "sub", "line", "same", "ids", "tail")


def core_text() -> Column:
    """The core profile (role, main, further, focus, projects) as a section."""
    points = (("角色", "role"), ("主要职责", "main"), ("副线", "further"), ("关注领域", "focus"), ("活跃项目", "projects"))
    return F.concat_ws("\n", F.lit(f"## {CORE_TITLE}"), *[F.concat(F.lit(f"- {name}: "), c) for name, c in points])


def published(view: str, signals: DataFrame, now_ms: Column, sources: str, previous: str | None = None, budget: Budget | None = None, cache: DataFrame | None = None, model: Model | None = None, pause: float = PAUSE) -> tuple[DataFrame, DataFrame | None]:
    """The document of a view and its sections (n, title, text, ids; n = 0 is the document), and what the cache of
    polished sections gains. ``previous``: the document as it was published before, whose notes stay. Without a
    ``model`` the drafts are published."""
    budget = budget or Budget.of(view)
    items, lead, facts = items_of(view, signals, now_ms), None, None
    if view == "work_profile":  # the core profile stands before the sections
        core = views.core_profile(signals, now_ms).select(core_text().alias("lead")).first()["lead"]
        facts = views.capped(views.active(signals, "profile_fact").where("detail = 'global'"), "subject", views.ORDERS["profile_fact"](), 15).agg(F.array_sort(F.collect_list("id")).alias("facts"))
        lead = F.lit(core)
    frame = Frame(TITLES[view], metadata(now_ms, sources), None if view == "weekly_focus" else notes_of(previous), lead)
    packed = pack(items, frame, budget, RULES[view])
    drafts, gained = sections_of(packed), None
    if model is None:
        rows = drafts.withColumnRenamed("draft", "text")
    else:
        rows, gained = polish_packed(drafts, cache, model, view, TITLES[view], pause)
    return document(rows, frame, budget, facts), gained

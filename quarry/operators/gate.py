"""The quality gate: issues of a candidate by its kind, a score, and what becomes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import dictionaries as rules
from quarry.functions import text
from quarry.operators.extract import is_meta

#: Markup that tells a pasted text.
MARKDOWN = r"(?m)(^\s*[-*+]\s+)|(\|[^\n]*\|)|(^#{1,6}\s)|(```)|(\*\*[^\n]+?\*\*)"
#: Least and greatest lengths, by kind.
TECH = {"name": 60, "words": 4, "least name": 2, "least rationale": 8, "rationale": 150}
WORK = {"least claim": 8, "claim": 150, "rationale": 150}
PROFILE = {"least claim": 2, "least role": 4, "claim": 100, "rationale": 150}
DECISION = {"least": 8, "decision": 200, "rationale": 150, "clear rationale": 20, "clear decision": 15}
PAIN = {"least": 10, "problem": 200, "diagnosis": 150, "workaround": 150}
ECHO_MORE, ECHO_OVERLAP, LINE_BREAKS, BULLETS = 20, 0.85, 2, 3
DIMENSIONS, STATUSES = ("role", "responsibility", "focus_area"), ("open", "in_progress", "blocked")
#: Points that an issue costs, and the issues that reject, quarantine or wait for more.
HEAVY, MIDDLE, LIGHT, OTHER = 60, 45, 20, 10
MIDDLE_CODES = ("echo_raw_text", "too_long")
HEAVY_CODES = {
    "tech_preference": ("too_vague", "missing_required", "missing_rationale"), "work_style": ("missing_required", "too_vague", "no_actionability", "single_occurrence_low_trust"), "profile_fact": ("missing_required", "too_vague", "no_actionability"),
    "decision": ("missing_required", "too_vague", "missing_rationale", "no_actionability", "meta_commentary"), "pain_point": ("missing_required", "too_vague", "single_occurrence_low_trust"), "timeline_event": ("missing_required", "invalid_date"), "open_thread": ("missing_required", "too_vague"),
}
LIGHT_CODES = {kind: ("weak_evidence", "single_occurrence_low_trust") if kind == "tech_preference" else ("weak_evidence",) for kind in HEAVY_CODES}
REJECT = {kind: (*codes, "no_actionability") if kind == "tech_preference" else codes for kind, codes in HEAVY_CODES.items()}


def with_evidence(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """``candidates`` (id, evidence_ids), one row an id, with what is known of their evidence (id, trust, source_kind),
    one row an id, too: n, the number of different ones, the greatest trust, and whether all is from session messages.
    Ids without evidence are left out; a candidate without any has n = 0."""
    times = lambda x: F.size(F.filter("evidence_ids", lambda y: y == x))  # noqa: E731  # so that no aggregate needs distinct rows
    own = candidates.select("id", F.inline(F.transform(F.array_distinct("evidence_ids"), lambda x: F.struct(x.alias("of"), times(x).cast("long").alias("times")))))
    facts = own.join(evidence.select(F.col("id").alias("of"), "trust", "source_kind"), "of").groupBy("id").agg(
        F.sum("times").alias("n"), F.count("*").alias("different"), F.max("trust").alias("most_trust"), F.min((F.col("source_kind") == "session_message").cast("int")).alias("sessions_only"))
    rows = candidates.join(facts, "id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "different", "most_trust", "sessions_only")})


def issues(kind: str) -> list[tuple[str, Column]]:
    """(code, condition) in the order in which a candidate's issues are listed; a code may come twice."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    subject, body, reason, raw = blank("subject"), blank("body"), blank("reason"), blank("raw_text")
    detail, size = F.coalesce("detail", F.lit("")), F.char_length
    echoes = lambda s: (size(raw) > size(s) + ECHO_MORE) & (text.overlap_ratio(s, raw) >= ECHO_OVERLAP)
    formatted = lambda s: (text.line_breaks(s) > LINE_BREAKS) | (text.bullets(s) > BULLETS)
    nothing, low = ("weak_evidence", F.col("n") == 0), ("single_occurrence_low_trust", (F.col("n") == 1) & (F.col("most_trust") <= 2) & (F.col("confidence") < 0.6))
    if kind == "tech_preference":
        name = text.normalize(subject)
        return [
            ("missing_required", (subject == "") | (body == "") | (F.trim(detail) == "")), ("missing_rationale", reason == ""), ("missing_required", (detail == "conditional") & (blank("extra") == "")),
            ("too_long", F.coalesce("subject", F.lit("")).contains("\n") | (size(F.coalesce("subject", F.lit(""))) > TECH["name"]) | (F.size(F.split(name, " ")) > TECH["words"])), ("too_long", size(reason) > TECH["rationale"]),
            ("too_vague", (size(name) < TECH["least name"]) | (size(reason) < TECH["least rationale"])), ("echo_raw_text", formatted(reason) | reason.rlike(MARKDOWN) | echoes(reason)), nothing, low,
            ("no_actionability", (F.col("n") > 0) & (F.col("sessions_only") == 1) & (reason.rlike(rules.GATE_PROMPT_LIKE) | raw.rlike(rules.GATE_PROMPT_LIKE))),
        ]
    if kind in ("work_style", "profile_fact"):
        own = WORK if kind == "work_style" else PROFILE
        least = F.lit(own["least claim"]) if kind == "work_style" else F.when(F.col("subject") == "role", own["least role"]).otherwise(own["least claim"])
        valid = (subject == "") if kind == "work_style" else ~F.coalesce("subject", F.lit("")).isin(*DIMENSIONS)
        common = [("missing_required", valid), ("missing_required", body == ""), ("too_vague", (body != "") & (size(body) < least)), ("too_long", size(body) > own["claim"]), ("echo_raw_text", size(reason) > own["rationale"]), ("echo_raw_text", formatted(body))]
        echo = ("echo_raw_text", (raw != "") & echoes(body))
        if kind == "work_style":
            return [*common, ("no_actionability", body.rlike(rules.AI_SUBJECT)), ("single_occurrence_low_trust", (detail == "once") & (F.col("n") <= 1)), nothing, echo]
        return [*common, ("echo_raw_text", body.rlike(MARKDOWN)), echo, ("no_actionability", (detail == "global") & body.rlike(rules.EXECUTION_DETAIL)), ("weak_evidence", (F.col("most_trust") < 4) & (F.col("different") < 2)), nothing]
    if kind == "decision":
        clear = (blank("extra") != "") | ((size(reason) >= DECISION["clear rationale"]) & (size(body) >= DECISION["clear decision"]))
        return [
            ("missing_required", subject == ""), ("missing_required", body == ""), ("meta_commentary", is_meta(body) | is_meta(reason)), ("no_actionability", body.rlike(rules.STATUS_WORDS)), ("too_vague", body.rlike(rules.GENERIC_DECISION)),
            ("too_vague", (body != "") & (size(body) < DECISION["least"])), ("too_long", size(body) > DECISION["decision"]), ("missing_rationale", reason == ""), ("too_long", size(reason) > DECISION["rationale"]),
            ("echo_raw_text", formatted(reason)), ("weak_evidence", (F.col("most_trust") < 4) & (F.col("n") < 2) & ~clear), nothing,
        ]
    if kind == "pain_point":
        return [
            ("missing_required", subject == ""), ("too_vague", (subject != "") & (size(subject) < PAIN["least"])), ("too_long", size(subject) > PAIN["problem"]), ("too_vague", subject.rlike(rules.VAGUE_PROBLEM)),
            ("missing_required", (body == "") & (reason == "")), ("too_long", size(body) > PAIN["diagnosis"]), ("too_long", size(reason) > PAIN["workaround"]), ("echo_raw_text", formatted(subject)), low, nothing,
        ]
    if kind == "timeline_event":
        return [("missing_required", subject == ""), ("invalid_date", ~detail.rlike(r"^\d{4}-\d{2}-\d{2}\z") | F.try_to_timestamp(detail).isNull()), nothing]
    return [("missing_required", subject == ""), ("too_vague", subject.rlike(rules.VAGUE_THREAD)), ("missing_required", ~F.coalesce("body", F.lit("")).isin(*STATUSES)), nothing]


#: Kinds in which evidence tells only an accepted candidate from one that waits for more.
DECIDED_BY_TEXT = ("timeline_event", "open_thread", "decision", "profile_fact")


def passing(candidates: DataFrame, kind: str) -> DataFrame:
    """The candidates of a kind of ``DECIDED_BY_TEXT`` that ``judge`` accepts or lets wait, without their evidence: no
    code that an issue about evidence gives rejects them or sends them to quarantine."""
    if kind not in DECIDED_BY_TEXT:
        raise ValueError(f"evidence decides which candidates of {kind} pass")
    stops = [condition for code, condition in issues(kind) if code in REJECT[kind] + MIDDLE_CODES]
    stopped = F.lit(False)
    for condition in stops:
        stopped = stopped | F.coalesce(condition, F.lit(False))
    return candidates.where(~stopped)


def judge(candidates: DataFrame, kind: str) -> DataFrame:
    """``candidates`` of one kind, with their evidence known, and issues (array of codes), score, decision."""
    found = F.filter(F.array(*[F.when(condition, code) for code, condition in issues(kind)]), lambda x: x.isNotNull())
    cost = lambda code: F.when(code.isin(*MIDDLE_CODES), MIDDLE).when(code.isin(*HEAVY_CODES[kind]), HEAVY).when(code.isin(*LIGHT_CODES[kind]), LIGHT).otherwise(OTHER)
    some = lambda codes: F.exists("issues", lambda x: x.isin(*codes))
    rows = candidates.withColumn("issues", found)
    score = F.greatest(F.lit(0), F.lit(100) - F.aggregate(F.transform("issues", cost), F.lit(0), lambda a, b: a + b))
    decision = F.when(some(REJECT[kind]), "reject").when(some(MIDDLE_CODES), "quarantine").when(some(LIGHT_CODES[kind]), "needs_merge").otherwise("accept")
    return rows.withColumns({"score": score, "decision": decision})

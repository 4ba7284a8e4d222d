"""Candidates of the seven kinds of signals, each with its evidence.

A candidate is one row of CANDIDATE. Its payload has the same six texts for all kinds:

| kind | subject | body | detail | reason | extra | trigger |
|-|-|-|-|-|-|-|
| tech_preference | technology | category | stance | rationale | conditions | |
| work_style, profile_fact | dimension | claim | frequency or scope | rationale | | |
| decision | topic | decision | scope | rationale | alternatives | trigger |
| pain_point | problem | diagnosis | recurrence | workaround | | |
| timeline_event | title | event type | date | summary | | |
| open_thread | title | status | thread type | | | |

Ids are hashes of what a candidate says and where it was found, so that reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import dictionaries as rules
from quarry.functions import text
from quarry.scratch import materialize

PAYLOAD = ("subject", "body", "detail", "reason", "extra", "trigger")
CANDIDATE = ("kind", "id", "evidence_id", "source_kind", "label", "project", "confidence", "trust", "observed", "raw_text", *PAYLOAD, "fingerprint", "key")
KINDS = ("timeline_event", "open_thread", "tech_preference", "decision", "pain_point", "work_style", "profile_fact")
#: How much of a payload's texts an extractor keeps.
CLAMPS = {"title": 120, "tech rationale": 120, "topic": 120, "decision": 320, "decision rationale": 280, "problem": 240, "diagnosis": 280, "workaround": 280, "work claim": 160, "work rationale": 220, "profile claim": 120, "profile rationale": 180, "condition": 80}
#: Trust and confidence by origin.
MEMORY_TRUST, RULE_TRUST, MODEL_TRUST, SESSION_TRUST = 4, 5, 3, 2
SNIPPET_CHARS, LEAST_PROBLEM_CHARS, SHORT_THEME_CHARS, THEME_SOURCE_CHARS = 220, 10, 24, 80


def key_of(kind: str) -> Column:
    """The canonical key: what is cut is cut before it is normalised."""
    place = lambda other: F.coalesce("project", F.lit(other))
    subject, body, detail, reason = (F.col(c) for c in PAYLOAD[:4])
    if kind == "tech_preference":
        return F.concat_ws(":", text.normalize(place("global")), text.normalize(subject), detail)
    if kind in ("work_style", "profile_fact"):
        return text.canonical_key((subject, None), (body, 20))
    if kind == "timeline_event":
        return text.canonical_key((place("global"), None), (detail, None), (reason, 20))
    return text.canonical_key((place("cross_project" if kind == "decision" else "global"), None), (subject, 30))


def candidates(rows: DataFrame, kind: str, **known: Column) -> DataFrame:
    """``rows`` with all columns of CANDIDATE but the last two and ``kind``; missing ones are null. ``known``: the last
    two of a kind whose texts were normalised before."""
    kinds = {"confidence": "double", "trust": "int"}
    have = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in CANDIDATE[1:-2]]
    rows = rows.select(F.lit(kind).alias("kind"), *have, *[c.alias(name) for name, c in known.items()])
    if known:
        return rows
    return rows.withColumns({"fingerprint": text.fingerprint(kind, *map(F.col, PAYLOAD)), "key": key_of(kind)})


def evidence(rows: DataFrame) -> DataFrame:
    """What candidates rest on: (id, source_kind, label, project, content, content_hash, trust, observed);
    of candidates with the same evidence, that of the most trusted, then by text."""
    rows = rows.select(F.col("evidence_id").alias("id"), "source_kind", "label", "project", F.col("raw_text").alias("content"), text.content_hash(F.col("raw_text")).alias("content_hash"), "trust", "observed")
    return first_by(rows, ["id"], [F.desc("trust"), F.asc("content")])


def _id(prefix: str, *parts: Column) -> Column:
    return text.derived_id(F.lit(prefix), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def with_texts(rows: DataFrame, column: str, where: str, subject: Column, **columns: Column) -> DataFrame:
    """``rows`` with the ``subject`` of their text ``column``, of those where it passes ``where``, and ``columns`` made of it.
    Texts repeat, so the rules read each of them once; they are written, so that they are joined by their true size."""
    texts = text.settled(rows.select(column).where(F.col(column).isNotNull()).distinct(), subject=subject).where(where)
    return rows.join(materialize(texts.withColumns(columns)), column)


def of_days_since(ms: Column) -> Column:
    """Whether a session's ``day`` begins at or after ``ms``. The key of a timeline event holds its day, which is also when
    it was seen, so that sessions since then give the events since then, merged with all that shares their keys."""
    return F.unix_millis(F.col("day").cast("timestamp")) >= ms


def timeline_events(sessions: DataFrame) -> DataFrame:
    """Of (session, project, source, title, day), one row an id; sessions without a title give none."""
    subject = F.col("subject")
    rows = with_texts(sessions.select("session", "project", "source", "title", "day"), "title", "subject not in ('', '(untitled)')", text.clamp(F.col("title"), CLAMPS["title"], whole=False), body=text.first_match(subject, rules.EVENT_TYPES, "milestone"), plain=text.normalize(subject), head=text.normalize(F.substring(subject, 1, 20)))
    rows = rows.select(_id("timeline-candidate", F.col("project"), F.col("day"), F.col("session")).alias("id"), *rows.columns)
    rows = first_by(rows, ["id"], [F.asc("subject"), F.asc(F.coalesce("project", F.lit(""))), F.asc(F.coalesce(F.col("day").cast("string"), F.lit("")))])
    day, body, plain, head = F.col("day").cast("string"), *(F.col(c) for c in ("body", "plain", "head"))
    return candidates(rows.select(
        "id", _id("timeline", F.col("project"), F.col("day"), F.col("session")).alias("evidence_id"), F.lit("session_message").alias("source_kind"), F.col("source").alias("label"), "project", F.lit(0.9).alias("confidence"),
        F.lit(SESSION_TRUST).alias("trust"), day.alias("observed"), subject.alias("raw_text"), "subject", "body", day.alias("detail"), subject.alias("reason"), "plain", "head",
    ), "timeline_event", fingerprint=text.fingerprint_of_plain("timeline_event", plain, body, text.normalize(F.col("detail")), plain, *map(F.col, PAYLOAD[4:])), key=F.concat_ws(":", text.normalize(F.coalesce("project", F.lit("global"))), text.normalize(F.col("detail")), head))


def open_threads(todos: DataFrame, today: Column) -> DataFrame:
    """Of (session, project, source, content, status), one row an id; ``today`` is when they were seen. As ids don't name
    sessions, the row of an id is found before anything is derived from it."""
    status = F.when(F.col("status") == "in_progress", "in_progress").when(F.col("status") == "pending", "open")
    rows = todos.select("session", "project", "source", "content", status.alias("body")).where("body is not null")
    rows = with_texts(rows, "content", "subject <> ''", text.clamp(F.col("content"), CLAMPS["title"], whole=False))
    evidence_id = _id("open-thread", F.col("project"), F.coalesce(F.col("session").cast("string"), F.lit("no-session")), F.col("content"))
    rows = rows.select("content", evidence_id.alias("evidence_id"), "project", "source", "subject", "body")
    rows = first_by(rows, ["project", "content"], [F.asc("evidence_id"), F.asc("body")])
    rows = rows.select(_id("open-thread-candidate", F.col("project"), F.col("content")).alias("id"), "evidence_id", "project", "source", "subject", "body")
    rows = first_by(rows, ["id"], [F.asc("evidence_id"), F.asc("subject"), F.asc(F.coalesce("project", F.lit(""))), F.asc("body")])
    return candidates(rows.select(
        "id", "evidence_id", F.lit("session_todo").alias("source_kind"), F.col("source").alias("label"), "project", F.lit(0.8).alias("confidence"), F.lit(SESSION_TRUST).alias("trust"), today.cast("string").alias("observed"),
        F.col("subject").alias("raw_text"), "subject", "body", F.lit("todo").alias("detail"),
    ), "open_thread")


def technologies(line: Column) -> Column:
    """(category, name) of all technologies that a line names, but for the exceptions."""
    found = [F.when(line.rlike(pattern) & ~(line.rlike(rules.TECH_EXCEPTIONS[name]) if name in rules.TECH_EXCEPTIONS else F.lit(False)), F.struct(F.lit(category).alias("category"), F.lit(name).alias("name"))) for category, name, pattern in rules.TECHNOLOGIES]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def is_operational(raw: Column, line: Column) -> Column:
    """Whether a line (``raw``, and without markup) is about running things, or no sentence at all."""
    return (line == "") | line.rlike(r"^---\z") | line.rlike("^[#>]") | line.rlike("^<!--") | F.trim(raw).rlike(r"^\|[^\n]+\|\z") | line.rlike(rules.OPERATIONAL)


def says_preference(line: Column) -> Column:
    return line.rlike(rules.either(rules.POSITIVE, rules.NEGATIVE, rules.CONDITIONAL))


def declares_stack(line: Column, found: Column) -> Column:
    """A label, a colon, and several technologies or signs of a list."""
    return (F.size(found) > 0) & line.rlike(rules.STACK_LABELS) & line.rlike("[:：]") & ((F.size(found) > 1) | line.rlike("[+,/]"))


def conditions(line: Column) -> Column:
    """What a conditional line says; null if it has no condition."""
    return F.when(line.rlike(rules.CONDITIONAL), F.coalesce(F.nullif(text.clamp(line, CLAMPS["condition"]), F.lit("")), F.lit("context-dependent")))


def _stance(line: Column) -> Column:
    return F.when(says_preference(line), text.first_match(line, rules.STANCES, "conditional")).otherwise("prefer")


def technologies_of_notes(notes: DataFrame) -> DataFrame:
    """Preferences by line and technology of (note, path, project_path, kind, memory_type, label,
    content): rules, and memories that are references."""
    rows = notes.where("kind = 'rule' or (kind = 'auto-memory' and memory_type = 'reference')").withColumn("title", text.path_title(F.col("path")))
    rows = rows.select("note", "path", "project_path", "kind", "label", "title", F.posexplode(F.split("content", r"\r?\n")).alias("at", "raw"))
    rows = text.settled(rows, line=text.sanitize_line(F.col("raw")))
    rows = rows.where(~is_operational(F.col("raw"), F.col("line"))).where(~text.relevance(F.col("line"), F.col("title"), rules).isin("noise", "generic_execution"))
    rows = text.settled(rows, found=technologies(F.col("line"))).where(F.size("found") > 0)
    line = F.col("line")
    rows = text.settled(rows, explicit=says_preference(line), stack=declares_stack(line, F.col("found"))).where("explicit or stack").withColumn("t", F.explode("found"))
    rows = rows.withColumn("stance", F.when(F.col("explicit"), text.first_match(line, rules.STANCES, "conditional")).otherwise("prefer"))
    rationale = F.when(~F.col("explicit"), F.concat(F.lit("技术栈中使用 "), F.col("t.name"))).otherwise(line)
    rule = F.col("kind") == "rule"
    rows = rows.withColumn("evidence_id", _id("note-tech", F.col("note"), F.col("path"), F.col("at"), F.col("t.name")))
    return candidates(rows.select(
        _id("tech", F.col("evidence_id"), F.col("t.category"), F.col("t.name"), F.col("stance")).alias("id"), "evidence_id", F.when(rule, "rule_file").otherwise("memory_file").alias("source_kind"), "label", F.col("project_path").alias("project"),
        F.when(rule, 0.95).otherwise(0.85).alias("confidence"), F.when(rule, RULE_TRUST).otherwise(MEMORY_TRUST).alias("trust"), F.lit(None).alias("observed"), line.alias("raw_text"), F.col("t.name").alias("subject"), F.col("t.category").alias("body"), F.col("stance").alias("detail"),
        text.clamp(rationale, CLAMPS["tech rationale"]).alias("reason"), F.when(F.col("stance") == "conditional", conditions(line)).alias("extra"),
    ), "tech_preference")


def sayings(sessions: DataFrame) -> DataFrame:
    """What the sessions of each project say, by its title, or by its first message without one: (project, title,
    said, n sessions, latest day, and of the first by (day, session) these and its source). As sessions repeat
    what others say, the rules then read each text of a project once."""
    titled = F.trim(F.coalesce("title", F.lit(""))) != ""
    rows = sessions.withColumn("said", F.when(titled, F.col("title")).otherwise(F.col("first_user"))).where(F.trim("said") != "")
    return rows.groupBy("project", "title", "said").agg(F.count("*").alias("n"), F.max("day").alias("latest"), F.min(F.struct("day", "session", "source")).alias("first")).select("project", "title", "said", "n", "latest", "first.*")


def session_mentions(sessions: DataFrame) -> DataFrame:
    """Technologies that sessions prefer, avoid or declare, a row for all of a project's that say the same:
    (project, source, session, day, latest, n, snippet, category, name, stance, stack); see ``sayings``."""
    rows = text.settled(sayings(sessions), snippet=text.sanitize_line(F.col("said")))
    snippet = F.col("snippet")
    rows = rows.where(~is_operational(snippet, snippet) & ~snippet.rlike(rules.PROMPT_LIKE) & (F.char_length(snippet) <= SNIPPET_CHARS)).where(text.relevance(snippet, F.col("title"), rules) == "preference_rich")
    rows = text.settled(rows, found=technologies(snippet)).where(F.size("found") > 0)
    rows = text.settled(rows, explicit=says_preference(snippet), stack=declares_stack(snippet, F.col("found"))).where("explicit or stack")
    rows = rows.withColumn("stance", F.when(F.col("explicit"), text.first_match(snippet, rules.STANCES, "conditional")).otherwise("prefer"))
    own = ("project", "source", "session", "day", "latest", "n", "snippet", "stance", "stack")
    return rows.select(*own, F.explode("found").alias("t")).select(*own[:-2], "t.category", "t.name", "stance", "stack")


def accumulate(mentions: DataFrame) -> DataFrame:
    """Mentions by project and technology: n, prefer, avoid, stack, latest, the longest snippet (ties:
    the earliest, then the smaller session) and the first session's source."""
    order = F.struct("day", "session")
    longest = F.min_by("snippet", F.struct((-F.char_length("snippet")).alias("n"), order.alias("o")))
    of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return mentions.groupBy("project", "category", "name").agg(
        F.sum("n").alias("n"), of(F.col("stance") == "prefer").alias("prefer"), of(F.col("stance") == "avoid").alias("avoid"), of(F.col("stack")).alias("stack"),
        F.max("latest").alias("latest"), longest.alias("sample"), F.min_by("source", order).alias("label"),
    )


def technologies_of_sessions(sessions: DataFrame) -> DataFrame:
    """Preferences by project of what several sessions say; see ``session_mentions``."""
    rows = accumulate(session_mentions(sessions)).where("n >= 2 and (prefer > 0 or avoid > 0 or stack >= 2)")
    stance = F.when(F.col("avoid") > F.col("prefer"), "avoid").otherwise("prefer")
    used = F.concat(F.lit("在 "), "project", F.lit(" 中反复作为技术栈使用（"), F.col("n").cast("string"), F.lit(" 条证据）"))
    rows = rows.withColumns({"stance": stance, "evidence_id": _id("session-tech", F.col("project"), F.col("name")), "why": F.when((F.col("prefer") > 0) | (F.col("avoid") > 0), F.col("sample")).otherwise(used)})
    return candidates(rows.select(
        _id("tech", F.col("evidence_id"), F.col("category"), F.col("name"), F.col("stance")).alias("id"), "evidence_id", F.lit("session_message").alias("source_kind"), "label", "project", F.when(F.col("n") >= 8, 0.75).when(F.col("n") >= 4, 0.6).otherwise(0.45).alias("confidence"),
        F.lit(SESSION_TRUST).alias("trust"), F.col("latest").cast("string").alias("observed"), F.col("sample").alias("raw_text"), F.col("name").alias("subject"), F.col("category").alias("body"), F.col("stance").alias("detail"), text.clamp(F.col("why"), CLAMPS["tech rationale"]).alias("reason"),
    ), "tech_preference")


def is_meta(s: Column) -> Column:
    return F.trim(s).rlike(rules.META_COMMENTARY)


def is_skippable(what: Column) -> Column:
    """Blank, a status word, or a remark that there is no decision."""
    return (F.trim(what) == "") | F.trim(what).rlike(rules.STATUS_WORDS) | is_meta(what)


def _memory_trust(label: Column) -> Column:
    return F.when(label == "rule", RULE_TRUST).otherwise(MEMORY_TRUST)


def decisions(rows: DataFrame, memory: bool) -> DataFrame:
    """Of (place, project, label, what, why, alternatives, trigger_text, date); ``place`` is the session
    or the note. Of those that say the same at one place, the first in the order in which ids are settled."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    rows = rows.withColumns({"what": empty("what"), "why": empty("why")})
    rows = first_by(rows, ["place", "what", "why"], [*([F.desc(_memory_trust(F.col("label")))] if memory else []), *[F.asc(empty(c)) for c in ("project", "date", "alternatives")], F.asc(F.trim(empty("trigger_text")))])
    rows = text.settled(rows, says=~is_skippable(F.col("what")) & ~is_meta(F.col("why"))).where("says")
    content = F.concat("what", F.when(F.col("why") != "", F.concat(F.lit(" — "), "why")).otherwise(""))
    rows = rows.withColumns({"subject": text.clamp(F.col("what"), CLAMPS["topic"]), "body": text.clamp(F.col("what"), CLAMPS["decision"]), "evidence_id": _id("memory-decision" if memory else "layer3-decision", F.col("place"), F.col("what"))})
    return candidates(rows.select(
        _id("decision", F.col("evidence_id"), F.col("subject"), F.col("body")).alias("id"), "evidence_id", F.lit("memory_file" if memory else "session_message").alias("source_kind"), "label", "project",
        F.lit(0.8 if memory else 0.6).alias("confidence"), (_memory_trust(F.col("label")) if memory else F.lit(MODEL_TRUST)).alias("trust"), F.col("date").alias("observed"), content.alias("raw_text"), "subject", "body",
        F.when(F.trim(empty("project")) != "", "project").otherwise("cross_project").alias("detail"), text.clamp(F.trim("why"), CLAMPS["decision rationale"]).alias("reason"), F.nullif("alternatives", F.lit("")).alias("extra"), F.nullif(F.trim("trigger_text"), F.lit("")).alias("trigger"),
    ), "decision")


def recurrence(flag: Column) -> Column:
    return F.when(flag, "high").when(~flag, "low").otherwise("medium")


def pain_points(rows: DataFrame, memory: bool) -> DataFrame:
    """Of (place, project, label, problem, diagnosis, solution, recurring boolean)."""
    rows = rows.where(F.char_length(F.trim("problem")) >= LEAST_PROBLEM_CHARS)
    some = lambda c, n: F.when(F.trim(c) != "", text.clamp(F.col(c), CLAMPS[n]))
    content = F.concat("problem", F.when(F.coalesce("diagnosis", F.lit("")) != "", F.concat(F.lit(" — "), "diagnosis")).otherwise(""))
    rows = rows.withColumns({"subject": text.clamp(F.col("problem"), CLAMPS["problem"]), "evidence_id": _id("memory-painpoint" if memory else "layer3-painpoint", F.col("place"), F.col("problem"))})
    return candidates(rows.select(
        _id("pain_point", F.col("evidence_id"), F.col("subject")).alias("id"), "evidence_id", F.lit("memory_file" if memory else "session_message").alias("source_kind"), "label", "project",
        F.lit(0.8 if memory else 0.6).alias("confidence"), (_memory_trust(F.col("label")) if memory else F.lit(MODEL_TRUST)).alias("trust"), content.alias("raw_text"), "subject",
        some("diagnosis", "diagnosis").alias("body"), recurrence(F.col("recurring")).alias("detail"), some("solution", "workaround").alias("reason"),
    ), "pain_point")


def is_raw_chat(s: Column) -> Column:
    return (F.char_length(s) > rules.RAW_TEXT_CHARS) | s.rlike(rules.MARKDOWN_NOISE)


def dimension(category: Column) -> Column:
    key, out = F.lower(F.trim(category)), F
    for name, canonical in rules.DIMENSIONS.items():
        out = out.when(key == name, canonical)
    return out.otherwise(F.trim(category))


def is_misc(category: Column, observation: Column) -> Column:
    return F.trim(category).rlike(rules.MISC_CATEGORY) & ~observation.rlike(rules.BEHAVIOUR_VERBS)


def work_styles(rows: DataFrame, memory: bool) -> DataFrame:
    """Of (place, label, category, observation, evidence). Equal rows, of sessions wherever they stand, give the same
    candidate, so the rules read one of them."""
    rows = rows.select(*(["place"] if memory else []), "label", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("category", "observation", "evidence")]).distinct()
    seen, other = F.col("observation"), F.col("evidence")
    says = (seen != "") & (F.col("category") != "") & ~is_raw_chat(seen) & ~seen.rlike(rules.INSTRUCTION) & ~is_misc(F.col("category"), seen) & ~seen.rlike(rules.AI_BEHAVIOUR)
    rows = text.settled(rows, says=says if memory else says & ~is_raw_chat(other)).where("says")
    own = (F.col("place"), F.col("category"), seen) if memory else (F.col("category"), seen)
    rows = rows.withColumns({"subject": dimension(F.col("category")), "body": text.clamp(seen, CLAMPS["work claim"]), "evidence_id": _id("memory-profile" if memory else "layer3-pref", *own)})
    return candidates(rows.select(
        _id("ws", F.col("evidence_id"), F.col("subject"), F.col("body")).alias("id"), "evidence_id", F.lit("memory_file" if memory else "session_message").alias("source_kind"), "label", F.lit(0.8 if memory else 0.7).alias("confidence"),
        (_memory_trust(F.col("label")) if memory else F.lit(MODEL_TRUST)).alias("trust"), F.concat(seen, F.when(other != "", F.concat(F.lit(" — "), other)).otherwise("")).alias("raw_text"), "subject", "body",
        F.lit("habitual" if memory else "repeated").alias("detail"), F.when((other != "") & (other != seen), text.clamp(other, CLAMPS["work rationale"])).alias("reason"),
    ), "work_style")


def is_rejected_sentence(s: Column) -> Column:
    return s.rlike(rules.PROJECT_DESCRIPTION) | s.rlike(rules.FOCUS_LEAD_IN) | s.rlike(rules.LONG_SENTENCE)


def is_role_title(s: Column) -> Column:
    return (s != "") & (F.char_length(s) <= rules.ROLE_TITLE_CHARS) & ~s.rlike(rules.ROLE_SENTENCE) & ~s.rlike("[，,。:：；]")


def _facts(rows: DataFrame, prefix: str) -> DataFrame:
    """Of (evidence_key, claim_dimension, claim, scope, why, content, label, project, origin, trust, confidence)."""
    rows = rows.withColumns({"evidence_id": _id(prefix, F.col("evidence_key")), "body": text.clamp(F.col("claim"), CLAMPS["profile claim"])})
    return candidates(rows.select(
        _id("pf", F.col("evidence_id"), F.col("claim_dimension"), F.col("body")).alias("id"), "evidence_id", F.col("origin").alias("source_kind"), "label", "project", "confidence", "trust", F.col("content").alias("raw_text"),
        F.col("claim_dimension").alias("subject"), "body", F.col("scope").alias("detail"), F.when(F.col("why").isNotNull(), text.clamp(F.col("why"), CLAMPS["profile rationale"])).alias("reason"),
    ), "profile_fact")


def facts_of_memory(entries: DataFrame) -> DataFrame:
    """Roles, responsibilities and focus areas that memory entries (place, label, observation) state; equal
    entries give the same facts, so the rules read one of them."""
    rows = text.settled(entries.select("place", "label", "observation").distinct(), claim=F.trim(F.coalesce("observation", F.lit("")))).where("claim <> ''")
    claim = F.col("claim")
    rows = rows.where(~is_raw_chat(claim) & ~claim.rlike(rules.AI_BEHAVIOUR) & ~is_rejected_sentence(claim))
    kinds = {"role": claim.rlike(rules.ROLE_WORDS) & is_role_title(claim), "responsibility": claim.rlike(rules.RESPONSIBILITY_WORDS), "focus_area": claim.rlike(rules.FOCUS_WORDS)}
    rows = rows.withColumn("claim_dimension", F.explode(F.filter(F.array(*[F.when(c, k) for k, c in kinds.items()]), lambda x: x.isNotNull())))
    confidence = F.when(F.col("claim_dimension") == "role", 0.85).otherwise(0.8)
    return _facts(rows.select(F.concat_ws(":", "claim_dimension", F.col("place").cast("string"), "claim").alias("evidence_key"), "claim_dimension", "claim", F.lit("global").alias("scope"), F.lit(None).cast("string").alias("why"), F.col("claim").alias("content"), "label", F.lit(None).cast("string").alias("project"), F.lit("memory_file").alias("origin"), _memory_trust(F.col("label")).alias("trust"), confidence.alias("confidence")), "memory-profile")


def _said(rows: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("what", "why", "trigger_text")])


def _told(rows: DataFrame) -> DataFrame:
    """(said, n): what decisions say and how many do, so that the rules read each text once."""
    return rows.groupBy(_said(rows).alias("said")).agg(F.count("*").alias("n"))


def role_shares(rows: DataFrame) -> DataFrame:
    """One row: how many decisions (what, why, trigger_text) there are, and of each role's domain."""
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    return _told(rows).agg(total(F.col("n")).alias("total"), *[total(F.when(F.col("said").rlike(pattern), F.col("n"))).alias(f"n{k}") for k, (_, _, pattern) in enumerate(rules.ROLE_PARTS)])


def role_of_decisions(rows: DataFrame) -> DataFrame:
    """The role that three decisions or more suggest: parts whose domain has its share, joined."""
    shares = role_shares(rows).where("total >= 3")
    parts = F.concat_ws(rules.ROLE_JOIN, *[F.when(F.col(f"n{k}") / F.col("total") >= least, name) for k, (name, least, _) in enumerate(rules.ROLE_PARTS)])
    counts = F.concat(F.lit("基于"), F.col("total").cast("string"), F.lit("条决策记录推断：产品"), "n0", F.lit("条、技术"), "n1", F.lit("条、量化"), "n2", F.lit("条、AI"), "n3", F.lit("条"))
    shares = shares.select(parts.alias("claim"), counts.alias("why"), "total").where("claim <> ''")
    return _facts(shares.select(F.col("claim").alias("evidence_key"), F.lit("role").alias("claim_dimension"), "claim", F.lit("global").alias("scope"), "why", F.col("why").alias("content"), F.lit("layer3-ai").alias("label"), F.lit(None).cast("string").alias("project"), F.lit("derived_note").alias("origin"), F.lit(MODEL_TRUST).alias("trust"), F.lit(0.65).alias("confidence")), "layer3-decision-role")


def themes(rows: DataFrame, projects: int = 3, least: int = 3) -> DataFrame:
    """The busiest projects of decisions (project, what) and the theme that most of their short texts
    have (ties by name), or else their first short text: (project, n, theme)."""
    rows = rows.select(F.trim("project").alias("project"), F.trim("what").alias("what")).where("project <> ''")
    rows = rows.groupBy("project", "what").agg(F.count("*").alias("times"))  # the rules read each text of a project once
    top = rows.groupBy("project").agg(F.sum("times").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "project").limit(projects)
    short = rows.join(F.broadcast(top), "project").where("what <> '' and char_length(what) <= %d" % THEME_SOURCE_CHARS)
    found = F.filter(F.array(*[F.when(F.col("what").rlike(pattern), name) for name, pattern in rules.THEMES]), lambda x: x.isNotNull())
    hits = short.select("project", "times", F.explode(found).alias("theme")).groupBy("project", "theme").agg(F.sum("times").alias("count"))
    best = hits.groupBy("project").agg(F.min_by("theme", F.struct((-F.col("count")).alias("n"), "theme")).alias("best"))
    plain = F.when((F.char_length("what") <= SHORT_THEME_CHARS) & ~is_rejected_sentence(F.col("what")), F.col("what"))
    plain = short.groupBy("project").agg(F.min(plain).alias("plain"))
    return top.join(best, "project", "left").join(plain, "project", "left").select("project", "n", F.coalesce("best", "plain").alias("theme")).where("theme is not null")


def responsibilities_of_decisions(rows: DataFrame) -> DataFrame:
    found = themes(rows)
    why = F.concat("project", F.lit("项目中有"), F.col("n").cast("string"), F.lit("条相关决策记录"))
    return _facts(found.select(F.concat_ws(":", "project", F.col("n").cast("string")).alias("evidence_key"), F.lit("responsibility").alias("claim_dimension"), F.concat_ws(" ", "project", "theme").alias("claim"), F.lit("project").alias("scope"), why.alias("why"), F.concat("project", F.lit(": "), F.col("n").cast("string"), F.lit(" decisions")).alias("content"), F.lit("layer3-ai").alias("label"), "project", F.lit("derived_note").alias("origin"), F.lit(MODEL_TRUST).alias("trust"), F.lit(0.6).alias("confidence")), "layer3-decision-resp")


def focus_hits(rows: DataFrame) -> DataFrame:
    """How many decisions (what, why, trigger_text) touch each focus domain: (domain, n)."""
    return _told(rows).select(F.explode(text.all_matches(F.col("said"), rules.FOCUS_DOMAINS)).alias("domain"), "n").groupBy("domain").agg(F.sum("n").alias("n"))


def focus_of_decisions(rows: DataFrame, most: int = 5, least: int = 2) -> DataFrame:
    found = focus_hits(rows).where(F.col("n") >= least).orderBy(F.desc("n"), "domain").limit(most)
    n = F.col("n").cast("string")
    return _facts(found.select(F.concat_ws(":", "domain", n).alias("evidence_key"), F.lit("focus_area").alias("claim_dimension"), F.col("domain").alias("claim"), F.lit("global").alias("scope"), F.concat(F.lit("在"), n, F.lit("条决策/记录中出现相关主题")).alias("why"), F.concat(F.lit("focus area: "), "domain", F.lit(" ("), n, F.lit(" occurrences)")).alias("content"), F.lit("layer3-ai").alias("label"), F.lit(None).cast("string").alias("project"), F.lit("derived_note").alias("origin"), F.lit(MODEL_TRUST).alias("trust"), F.lit(0.65).alias("confidence")), "layer3-focus")


def ai_share(hits: DataFrame, top: int = 8) -> DataFrame:
    """Of the ``top`` domains of (domain, n): hits in all, hits in domains about AI, and their percent."""
    best = hits.orderBy(F.desc("n"), "domain").limit(top)
    ai = F.coalesce(F.sum(F.when(F.col("domain").rlike(rules.AI_FOCUS), F.col("n"))), F.lit(0))
    rows = best.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), ai.alias("ai"))
    return rows.withColumn("percent", F.when(F.col("total") > 0, F.floor(F.col("ai") * 100 / F.col("total") + 0.5)))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")

"""Text scalars as Column expressions. Lengths are code points; order is binary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks that end a clause, hard and soft, in the order in which they are tried.
HARD_MARKS = "。！？.!?；;"
SOFT_MARKS = "，,、：:"
ELLIPSIS = "…"
#: Where a line is shortened, behind a mark or before a separator.
SHORTEN_MARKS = "。！？.!?;；，,、"
SEPARATORS = (" — ", " - ", ": ", "：", " / ", " · ")
#: What leaks from files into views, and what titles begin with, in the order of removal.
LEAKS = (r"(?is)<!--\s*desc:.*?-->", r"(?is)<!--\s*generated:.*?-->", r"(?is)<!--\s*sources:.*?-->", r"(?im)^\s*sources?:\s*.+$", r"(?im)^\s*generated:\s*.+$", r"(?i)\bsourceLabel\s*:\s*[^\n]+")
TITLE_STRIPS = (
    (r"(?i)\s*\(@(?:[^\n]|\n)*?subagent(?:[^\n]|\n)*?\)\s*", " "), (r"(?i)\s*\(@\S[^\n]*?…?\s*\z", ""), (r"(?i)^\s*\[(?:OC|CC)\]\s*", ""), (r"(?i)^\s*\[记录\]\s*", ""),
    (r"(?i)^\s*(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.(?:tsx|ts|jsx|js|py|go|rs|java|kt|swift|md):\s*", ""), (r"^\s*[a-z_][a-z0-9_]*:\s*", ""), (r"(?i)</?local-command-caveat>", " "), (r"</?[A-Za-z0-9_-]+>", " "),
    (r"(?im)^\s*\[(?:INFO|DEBUG|WARN(?:ING)?|ERROR|TRACE)\][^\n]*$", " "), (r"(?i)^\s*\[(?:in_progress|open|blocked)\]\s*", " "),
)
UNTITLED, NO_PROJECT = "未命名事项", "未归类项目"
MEANINGLESS = r"(?i)^(unknown|n a|na|null|undefined|none|todo)\z"
ENV_LEAK = r"(^|[^A-Za-z0-9_])[A-Z][A-Z0-9_]+\s*(?:—|:)"


def word(*terms: str) -> str:
    """A case-insensitive pattern for terms between ASCII word boundaries, whatever the letters around."""
    return r"(?i:(^|[^A-Za-z0-9_])(" + "|".join(terms) + r")([^A-Za-z0-9_]|\z))"


def any_of(*terms: str) -> str:
    return "(?i:" + "|".join(terms) + ")"


def between(*terms: str) -> str:
    """Terms of other letters that stand between ASCII letters or digits."""
    return "[A-Za-z0-9_](" + "|".join(terms) + ")[A-Za-z0-9_]"


def starts(*terms: str, whole: bool = False) -> str:
    """Terms at the start, if ``whole`` up to an ASCII word boundary."""
    return "(?i:^(" + "|".join(terms) + ")" + (r"([^A-Za-z0-9_]|\z))" if whole else ")")


def either(*patterns: str) -> str:
    return "|".join(patterns)


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def normalize(s: Column, most: int | None = None) -> Column:
    """Lower case; punctuation and symbols become spaces; white space collapses; optional cut."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[\p{P}\p{S}]+", " "), r"\s+", " "))
    return F.trim(F.substring(out, 1, most)) if most else out


def content_hash(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, 16)


def fingerprint(kind: str, *leaves: Column) -> Column:
    """Hash of the kind and the normalised leaves of a payload, in fixed order."""
    return fingerprint_of_plain(kind, *map(normalize, leaves))


def fingerprint_of_plain(kind: str, *leaves: Column) -> Column:
    """``fingerprint`` of leaves that are normalised already."""
    return F.sha2(F.concat(F.lit(kind + ":"), F.concat_ws("\u0001", *[F.coalesce(x, F.lit("")) for x in leaves])), 256)


def canonical_key(*parts: tuple[Column, int | None]) -> Column:
    """Parts cut to their length, then normalised, joined by colons."""
    return F.concat_ws(":", *[normalize(F.substring(p, 1, n) if n else p) for p, n in parts])


def _last_index(s: Column, mark: str, most: int) -> Column:
    """Where ``mark`` stands last in ``s`` at or before position ``most``, from 0; -1 if nowhere."""
    head = F.substring(s, 1, most + len(mark))
    at = F.instr(F.reverse(head), mark[::-1])
    return F.when(at > 0, F.char_length(head) - at - (len(mark) - 1)).otherwise(-1)


def _behind_last(s: Column, marks: str, most: int) -> Column:
    """Behind the last of ``marks``, tried in order: a mark right behind the best so far doesn't move it."""
    return F.aggregate(F.array(*[_last_index(s, m, most) for m in marks]), F.lit(-1), lambda best, at: F.when(at > best, at + 1).otherwise(best))


def clamp(s: Column, n: int, whole: bool = True) -> Column:
    """At most n code points (n + 1 where a mark stands there): cut behind the last hard mark, else
    the last soft mark, else at the last space, if that is past n / 2; else hard, with an ellipsis.
    White space is collapsed first, or, if not ``whole``, only trimmed."""

    def cut(t: Column) -> Column:
        hard, soft, space = _behind_last(t, HARD_MARKS, n), _behind_last(t, SOFT_MARKS, n), _last_index(t, " ", n)
        past = F.when(hard > n // 2, hard).when(soft > n // 2, soft).when(space > n // 2, space)
        short = F.trim(F.substring(t, F.lit(1), past))
        return F.when(F.char_length(t) <= n, t).otherwise(F.coalesce(short, F.concat(F.trim(F.substring(t, 1, n - 1)), F.lit(ELLIPSIS))))

    return once(collapse(s) if whole else F.trim(s), cut)


def once(s: Column, use) -> Column:
    """``use`` of ``s``, which is evaluated once however often it occurs there."""
    return F.transform(F.array(s), use)[0]


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are evaluated once: as a generator's output, they are not written out
    again in each filter and column that uses them, nor are such filters pushed below them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def shorten(s: Column, n: int) -> Column:
    """At most n code points: up to the last boundary of any kind if past 0.55 n, else hard; trimmed.
    Where a mark at n makes it one longer, the last word goes if a space past 0.55 n is before it."""
    least = n * 55 // 100

    def cut(t: Column) -> Column:
        marks = [_last_index(t, m, n) + F.when(_last_index(t, m, n) >= 0, 1).otherwise(0) for m in SHORTEN_MARKS]
        boundary = F.greatest(*marks, *[_last_index(t, x, n) for x in (*SEPARATORS, " ")])
        part = F.when(boundary > least, F.substring(t, F.lit(1), boundary)).otherwise(F.substring(t, 1, n))
        word_off = lambda p: F.trim(F.when((F.char_length(p) > n) & (_last_index(p, " ", n + 1) > least), F.regexp_replace(p, r"\s+\S*\z", "")).otherwise(p))
        return F.when(F.char_length(t) <= n, t).otherwise(once(part, word_off))

    return once(s, cut)


#: Markup of a line and what stays of it.
LINE_MARKUP = ((r"^[-*+]\s+", ""), (r"^\d+\.\s+", ""), (r"\*\*([^\n]*?)\*\*", "$1"), (r"`([^`]+)`", "$1"), (r"\[([^\n]*?)\]\([^\n]*?\)", "$1"), (r"\|", " "))


def sanitize_line(s: Column) -> Column:
    """Without bullet, numbering, bold, code, link and pipe markup."""
    for pattern, put in LINE_MARKUP:
        s = F.regexp_replace(s, pattern, put)
    return collapse(s)


def collapse_lines(s: Column) -> Column:
    """Spaces and tabs become one space, none beside line ends, at most one blank line; trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[\t\r\f\x0B ]+", " "), " *\n *", "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def clean_view(s: Column) -> Column:
    """Without leaked metadata (comments, source and generated lines); at most one blank line. Null is empty."""
    s = F.coalesce(s, F.lit(""))
    for pattern in LEAKS:
        s = F.regexp_replace(s, pattern, " ")
    return collapse_lines(s)


def is_meaningless(s: Column) -> Column:
    return once(normalize(s), lambda n: (n == "") | n.rlike(MEANINGLESS))


def clean_title(s: Column) -> Column:
    """A view text without what tools put in front of titles; a constant if nothing is left."""
    s = clean_view(s)
    for pattern, put in TITLE_STRIPS:
        s = F.regexp_replace(s, pattern, put)
    value = F.trim(F.regexp_replace(collapse_lines(s), r"[….]{2,}\z", ""))
    return once(value, lambda v: F.when(is_meaningless(v), UNTITLED).otherwise(v))


def clean_project(s: Column, other: str = NO_PROJECT) -> Column:
    return once(clean_view(s), lambda v: F.when((v == "") | v.rlike(r"(?i)^(unknown|\(unknown\)|cross_project)\z"), other).otherwise(v))


def clean_evidence(s: Column, n: int = 80) -> Column:
    """The lines that leak neither settings nor current values, joined and shortened."""
    lines = F.filter(F.transform(F.split(clean_view(s), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(ENV_LEAK) & ~x.contains("当前值"))
    return shorten(collapse_lines(F.array_join(lines, " ")), n)


def dedupe_key(s: Column) -> Column:
    """A view text by its words only."""
    return normalize(clean_view(s))


def near_duplicates(a: Column, b: Column) -> Column:
    """Whether one holds the other, by words only; never if one has none."""
    return F.transform(F.array(F.struct(dedupe_key(a).alias("x"), dedupe_key(b).alias("y"))), lambda p: (p["x"] != "") & (p["y"] != "") & (F.contains(p["x"], p["y"]) | F.contains(p["y"], p["x"])))[0]


def is_noise(s: Column) -> Column:
    """Whether views hide the text: blank, a log line, a greeting, too short, or mostly symbols."""
    raw = F.trim(F.coalesce(s, F.lit("")))

    def judged(title: Column) -> Column:
        letters = F.regexp_count(title, F.lit(r"[\p{L}\p{N}]"))
        return (title == UNTITLED) | (F.char_length(title) < 5) | (letters == 0) | (F.char_length(title) - letters > letters * 2)

    marks = raw.rlike(TITLE_STRIPS[8][0]) | raw.rlike(TITLE_STRIPS[6][0]) | raw.rlike(r"(?i)^\[[A-Za-z0-9_-]+\]\s*name:\s*\S+\s+type:\s*") | raw.rlike(r"(?i)^\s*(?:hello|hi|test|测试|pong|ping)\s*\z")
    return (raw == "") | marks | (F.trim(F.regexp_replace(raw, r"<[^>]+>", "")) == "") | once(clean_title(raw), judged)


def overlap_ratio(a: Column, b: Column) -> Column:
    """1 if equal after normalising, the length ratio if one contains the other, else 0."""
    x, y = normalize(a), normalize(b)
    short, long = F.least(F.char_length(x), F.char_length(y)), F.greatest(F.char_length(x), F.char_length(y))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), short / long).otherwise(0.0)


def tidy(s: Column) -> Column:
    """Line ends are \\n, runs of spaces and tabs one space; trimmed."""
    return F.regexp_replace(F.regexp_replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), r"[ \t]+", " "), r"^\s+|\s+\z", "")


def heading(s: Column) -> Column:
    return F.nullif(tidy(F.regexp_extract(s, r"(?m)^#{1,6}[ \t]+([^\r\n]+)", 1)), F.lit(""))


def first_sentence(s: Column) -> Column:
    """The first heading, else the first sentence, else the first line, else a constant."""

    def said(t: Column) -> Column:
        sentence = F.nullif(F.trim(F.regexp_extract(t, r"^([^\n]+?[。！？.!?])(?:\s|\z)", 1)), F.lit(""))
        return F.coalesce(sentence, F.nullif(F.trim(F.regexp_extract(t, r"^([^\n]*)", 1)), F.lit("")), F.lit("(untitled memory)"))

    return F.coalesce(heading(s), once(tidy(F.regexp_replace(s, r"(?m)^#{1,6}[ \t]+", "")), said))


def paragraphs(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+\z", "")), lambda p: p != "")


def first_relevant(parts: Column, pattern: str) -> Column:
    """The first of some paragraphs in which the pattern occurs; null if none."""
    return tidy(F.try_element_at(F.filter(parts, lambda p: p.rlike(pattern)), F.lit(1)))


def relevant_paragraph(s: Column, pattern: str) -> Column:
    """The first paragraph in which the pattern occurs; null if none."""
    return first_relevant(paragraphs(s), pattern)


def blocks(s: Column) -> Column:
    """The bullet lines without their bullets, or, if there are none, the paragraphs."""
    lines = F.transform(F.split(s, r"\r?\n"), lambda x: F.trim(x))
    bullets = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(r"^[-*+]\s+")), lambda x: F.trim(F.regexp_replace(x, r"^[-*+]\s+", ""))), lambda x: x != "")
    return F.when(F.size(bullets) > 0, bullets).otherwise(paragraphs(s))


def line_breaks(s: Column) -> Column:
    return F.regexp_count(s, F.lit("\n"))


def bullets(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"(?m)^\s*[-*+]\s+"))


def path_title(path: Column) -> Column:
    """The last part of a path, or the path."""
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(-1)), path)


def stable_id(path: Column) -> Column:
    """The hash of a path without doubled slashes, dots and a slash at the end."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), "/+", "/"), r"(.)/\z", "$1")
    return content_hash(clean)


def derived_id(*parts: Column) -> Column:
    return content_hash(F.concat_ws(":", *parts))


def string_list(s: Column) -> Column:
    """Parts between commas and line ends, without blank ones."""
    return F.filter(F.transform(F.split(s, r"[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def as_boolean(s: Column, other: bool = False) -> Column:
    low = F.lower(s)
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False).otherwise(other)


def churn_text(additions: Column, deletions: Column, files: Column) -> Column:
    """`` (+a/-d, n files)``, without parts that are all zero; empty if nothing is left."""
    edits = F.when((additions > 0) | (deletions > 0), F.concat(F.lit("+"), additions.cast("string"), F.lit("/-"), deletions.cast("string")))
    parts = F.concat_ws(", ", edits, F.when(files > 0, F.concat(files.cast("string"), F.lit(" files"))))
    return F.when(parts == "", "").otherwise(F.concat(F.lit(" ("), parts, F.lit(")")))


def age(ms: Column, now: Column) -> Column:
    """Time since, in the largest of minutes, hours, days, months of 30 days and years of 365."""
    gap = now - ms
    minutes, hours, days = (F.floor(gap / unit) for unit in (60_000, 3_600_000, 86_400_000))
    shown = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    said = F.when(hours < 1, shown(F.greatest(F.lit(1), minutes), "m")).when(hours < 24, shown(hours, "h")).when(days < 30, shown(days, "d"))
    return F.when(ms.isNull(), "unknown").otherwise(said.when(days < 365, shown(F.floor(days / 30), "mo")).otherwise(shown(F.floor(days / 365), "y")))


def date_label(ts: Column, now: Column) -> Column:
    """Month and day, with the year in front if it isn't the present one; empty for null."""
    return F.coalesce(F.when(F.year(ts) == F.year(now), F.date_format(ts, "MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd")), F.lit(""))


def staleness(ms: Column, now: Column) -> Column:
    """How long a thread lies idle: over 30, 14 or 7 days; else null."""
    days = (now - ms) / 86_400_000
    return F.when(days > 30, "搁置 30+ 天").when(days > 14, "搁置 2+ 周").when(days > 7, "搁置 1+ 周")


#: The words that views show for values.
STATUS_SHOWN = {"": "待处理", "in_progress": "进行中", "blocked": "阻塞", "open": "待处理"}
RECURRENCE_SHOWN = {"high": "高频", "medium": "中频", "low": "低频"}
STANCE_SHOWN = {"prefer": "偏好", "avoid": "避免", "conditional": "视场景而定"}
TRUST_SHOWN = ((4, "高"), (3, "中"), (0, "低"))


def shown(s: Column, words: dict[str, str], lower: bool = False) -> Column:
    """The word for a value, or the value."""

    def told(v: Column) -> Column:
        key, out = F.lower(v) if lower else v, F
        for value, word_ in words.items():
            out = out.when(key == value, word_)
        return out.otherwise(v)

    return once(clean_view(s), told)


def trust_shown(trust: Column, support: Column) -> Column:
    out = F
    for least, word_ in TRUST_SHOWN:
        out = out.when(trust >= least, word_)
    return F.concat(out, F.lit("（"), support.cast("string"), F.lit(" 条证据）"))


def bar(count: Column, most: Column) -> Column:
    return F.repeat(F.lit("█"), F.when(most > 0, F.round(count / most * 10)).otherwise(0).cast("int"))


def table_cell(s: Column) -> Column:
    return F.replace(s, F.lit("|"), F.lit("\\|"))


def user_notes(content: Column) -> Column:
    """The block of notes that a user keeps in a view; both of its marks are needed."""
    return F.nullif(F.regexp_extract(content, r"(?s)(<!-- user notes -->.*?<!-- /user notes -->)", 1), F.lit(""))


def relevance(s: Column, title: Column, dictionary) -> Column:
    """Class of a text with its title: noise by the title, then what the title and the head of the
    text say, then what all of it says."""
    head = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(s, 1, dictionary.RELEVANCE_HEAD_CHARS))
    whole = F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), s))

    def judged(p: Column) -> Column:
        out = F.when(F.coalesce(title, F.lit("")).rlike(dictionary.NOISE_TITLES) | (F.trim(p["head"]) == ""), "noise")
        for name, pattern in dictionary.RELEVANCE_HEAD:
            out = out.when(p["head"].rlike(pattern), name)
        for name, pattern in dictionary.RELEVANCE_WHOLE:
            out = out.when(p["whole"].rlike(pattern), name)
        return out.otherwise("generic_execution")

    return once(F.struct(head.alias("head"), whole.alias("whole")), judged)


def first_match(s: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """Class of the first rule whose pattern occurs."""
    out = F
    for name, pattern in rules:
        out = out.when(s.rlike(pattern), name)
    return out.otherwise(other)


def all_matches(s: Column, rules: list[tuple[str, str]]) -> Column:
    """Classes of all rules whose patterns occur."""
    return F.filter(F.array(*[F.when(s.rlike(pattern), F.lit(name)) for name, pattern in rules]), lambda x: x.isNotNull())


def duck(s: str, rules: list[tuple[str, str]], other: str) -> str:
    """The same first-match rules as SQL text."""
    quote = lambda x: x.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({s}, '{quote(p)}') THEN '{quote(n)}'" for n, p in rules) + f" ELSE '{quote(other)}' END"

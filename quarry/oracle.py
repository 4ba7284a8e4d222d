"""The text functions and rules as SQL for another engine, to state what queries must return."""

from __future__ import annotations

from quarry.functions import dictionaries as rules
from quarry.functions import text


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {q(pattern)})"


def rep(e: str, pattern: str, put: str = "") -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(put.replace('$', chr(92)))}, 'g')"


def let(name: str, e: str, out: str) -> str:
    """``out``, which uses ``name`` for ``e``."""
    return f"(SELECT {out} FROM (SELECT {e} AS {name}))"


def collapse(e: str) -> str:
    return f"trim({rep(e, chr(92) + 's+', ' ')})"


def norm(e: str) -> str:
    return f"trim({rep(rep(f'lower({e})', r'[\p{P}\p{S}]+', ' '), chr(92) + 's+', ' ')})"


def hash16(e: str) -> str:
    return f"left(sha256({e}), 16)"


def last(t: str, mark: str, n: int) -> str:
    head = f"left({t}, {n + len(mark)})"
    at = f"instr(reverse({head}), {q(mark[::-1])})"
    return f"CASE WHEN {at} > 0 THEN length({head}) - {at} - {len(mark) - 1} ELSE -1 END"


def behind(t: str, marks: str, n: int) -> str:
    return f"list_reduce([-1, {', '.join(last(t, m, n) for m in marks)}], lambda b, i: CASE WHEN i > b THEN i + 1 ELSE b END)"


def clamp(e: str, n: int, whole: bool = True) -> str:
    half = n // 2
    inner = f"SELECT t_, {behind('t_', text.HARD_MARKS, n)} AS h_, {behind('t_', text.SOFT_MARKS, n)} AS s_, {last('t_', ' ', n)} AS b_ FROM (SELECT {collapse(e) if whole else f'trim({e})'} AS t_)"
    return f"(SELECT CASE WHEN length(t_) <= {n} THEN t_ WHEN h_ > {half} THEN trim(left(t_, h_)) WHEN s_ > {half} THEN trim(left(t_, s_)) WHEN b_ > {half} THEN trim(left(t_, b_)) ELSE trim(left(t_, {n - 1})) || '…' END FROM ({inner}))"


def shorten(e: str, n: int) -> str:
    least = n * 55 // 100
    ends = [f"(SELECT CASE WHEN i_ >= 0 THEN i_ + 1 ELSE -1 END FROM (SELECT {last('t_', m, n)} AS i_))" for m in text.SHORTEN_MARKS] + [last("t_", x, n) for x in (*text.SEPARATORS, " ")]
    cut = f"SELECT t_, CASE WHEN b_ > {least} THEN left(t_, b_) ELSE left(t_, {n}) END AS p_ FROM (SELECT t_, greatest({', '.join(ends)}) AS b_ FROM (SELECT {e} AS t_))"
    return f"(SELECT CASE WHEN length(t_) <= {n} THEN t_ ELSE trim(CASE WHEN length(p_) > {n} AND {last('p_', ' ', n + 1)} > {least} THEN {rep('p_', chr(92) + 's+' + chr(92) + 'S*' + chr(92) + 'z')} ELSE p_ END) END FROM ({cut}))"


def chain(e: str, pairs) -> str:
    for pattern, put in pairs:
        e = rep(e, pattern, put)
    return e


def sanitize(e: str) -> str:
    return collapse(chain(e, text.LINE_MARKUP))


def strip(e: str) -> str:
    return rep(e, r"^\s+|\s+\z")


def collapse_lines(e: str) -> str:
    return strip(chain(e, ((r"[\t\r\f\x0B ]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n"))))


def clean_view(e: str) -> str:
    return collapse_lines(chain(f"coalesce({e}, '')", [(p, " ") for p in text.LEAKS]))


def meaningless(e: str) -> str:
    return let("n_", norm(e), f"n_ = '' OR {rx('n_', text.MEANINGLESS)}")


def clean_title(e: str) -> str:
    value = f"trim({rep(collapse_lines(chain(clean_view(e), text.TITLE_STRIPS)), r'[….]{2,}' + chr(92) + 'z')})"
    return let("v_", value, f"CASE WHEN {meaningless('v_')} THEN {q(text.UNTITLED)} ELSE v_ END")


def clean_project(e: str) -> str:
    return let("v_", clean_view(e), f"CASE WHEN v_ = '' OR {rx('v_', r'(?i)^(unknown|' + chr(92) + '(unknown' + chr(92) + ')|cross_project)' + chr(92) + 'z')} THEN {q(text.NO_PROJECT)} ELSE v_ END")


def clean_evidence(e: str, n: int = 80) -> str:
    lines = f"list_filter(list_transform(string_split({clean_view(e)}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT {rx('x', text.ENV_LEAK)} AND NOT contains(x, '当前值'))"
    return shorten(collapse_lines(f"array_to_string({lines}, ' ')"), n)


def noise(e: str) -> str:
    letters = r"len(regexp_extract_all(c_, '[\p{L}\p{N}]'))"
    judged = let("c_", clean_title("r_"), f"c_ = {q(text.UNTITLED)} OR length(c_) < 5 OR {letters} = 0 OR length(c_) - {letters} > {letters} * 2")
    marks = " OR ".join(rx("r_", p) for p in (text.TITLE_STRIPS[8][0], text.TITLE_STRIPS[6][0], r"(?i)^\[[A-Za-z0-9_-]+\]\s*name:\s*\S+\s+type:\s*", r"(?i)^\s*(?:hello|hi|test|测试|pong|ping)\s*\z"))
    return let("r_", f"trim(coalesce({e}, ''))", f"r_ = '' OR {marks} OR trim({rep('r_', '<[^>]+>')}) = '' OR {judged}")


def overlap(a: str, b: str) -> str:
    inner = f"SELECT {norm(a)} AS x_, {norm(b)} AS y_"
    return f"(SELECT CASE WHEN x_ = '' OR y_ = '' THEN 0 WHEN x_ = y_ THEN 1 WHEN contains(x_, y_) OR contains(y_, x_) THEN least(length(x_), length(y_)) / greatest(length(x_), length(y_)) ELSE 0 END FROM ({inner}))"


def tidy(e: str) -> str:
    return strip(rep(f"replace({e}, chr(13) || chr(10), chr(10))", "[ \t]+", " "))


def first_sentence(e: str) -> str:
    heading = f"nullif({tidy(f'regexp_extract({e}, {q(chr(40) + chr(63) + chr(109) + chr(41) + r"^#{1,6}[ " + chr(9) + r"]+([^" + chr(13) + chr(10) + r"]+)")}, 1)')}, '')"
    said = f"coalesce(nullif(trim(regexp_extract(t_, {q(r'^([^' + chr(10) + r']+?[。！？.!?])(?:' + chr(92) + 's|' + chr(92) + 'z)')}, 1)), ''), nullif(trim(regexp_extract(t_, {q('^([^' + chr(10) + ']*)')}, 1)), ''), '(untitled memory)')"
    return f"coalesce({heading}, {let('t_', tidy(rep(e, '(?m)^#{1,6}[ ' + chr(9) + ']+')), said)})"


def paragraphs(e: str) -> str:
    return f"list_filter(list_transform(string_split_regex({e}, {q(chr(10) + chr(92) + 's*' + chr(10))}), lambda p: {strip('p')}), lambda p: p <> '')"


def relevant(e: str, pattern: str) -> str:
    return tidy(f"list_filter({paragraphs(e)}, lambda z: {rx('z', pattern)})[1]")


def blocks(e: str) -> str:
    lines = f"list_filter(list_transform(list_filter(list_transform(string_split_regex({e}, '\\r?\\n'), lambda x: trim(x)), lambda x: {rx('x', '^[-*+]' + chr(92) + 's+')}), lambda x: trim({rep('x', '^[-*+]' + chr(92) + 's+')})), lambda x: x <> '')"
    return let("l_", lines, f"CASE WHEN len(l_) > 0 THEN l_ ELSE {paragraphs(e)} END")


def case(e: str, pairs, other: str) -> str:
    """First rule that matches."""
    return "CASE " + " ".join(f"WHEN {rx(e, p)} THEN {q(n)}" for n, p in pairs) + f" ELSE {q(other)} END"


def every(e: str, pairs) -> str:
    """All rules that match."""
    return "list_filter([" + ", ".join(f"CASE WHEN {rx(e, p)} THEN {q(n)} END" for n, p in pairs) + "], lambda x: x IS NOT NULL)"


def relevance(e: str, title: str) -> str:
    head = f"coalesce({title}, '') || ' ' || left({e}, {rules.RELEVANCE_HEAD_CHARS})"
    whole = f"trim(coalesce({title}, '') || chr(10) || {e})"
    arms = [f"WHEN {rx('hd_', p)} THEN {q(n)}" for n, p in rules.RELEVANCE_HEAD] + [f"WHEN {rx('wh_', p)} THEN {q(n)}" for n, p in rules.RELEVANCE_WHOLE]
    test = f"{rx(f'coalesce({title}, {q(str())})', rules.NOISE_TITLES)} OR trim(hd_) = ''"
    return f"(SELECT CASE WHEN {test} THEN 'noise' {' '.join(arms)} ELSE 'generic_execution' END FROM (SELECT {head} AS hd_, {whole} AS wh_))"


def operational(raw: str, line: str) -> str:
    return f"({line} = '' OR {rx(line, '^---' + chr(92) + 'z')} OR {rx(line, '^[#>]')} OR {rx(line, '^<!--')} OR {rx(f'trim({raw})', r'^\|[^' + chr(10) + r']+\|' + chr(92) + 'z')} OR {rx(line, rules.OPERATIONAL)})"


def technologies(line: str) -> str:
    arms = [f"CASE WHEN {rx(line, p)}{f' AND NOT {rx(line, rules.TECH_EXCEPTIONS[n])}' if n in rules.TECH_EXCEPTIONS else ''} THEN {{'category': {q(c)}, 'name': {q(n)}}} END" for c, n, p in rules.TECHNOLOGIES]
    return f"list_filter([{', '.join(arms)}], lambda x: x IS NOT NULL)"


def preference(line: str) -> str:
    return rx(line, rules.either(rules.POSITIVE, rules.NEGATIVE, rules.CONDITIONAL))


def stack(line: str, found: str) -> str:
    return f"(len({found}) > 0 AND {rx(line, rules.STACK_LABELS)} AND {rx(line, '[:：]')} AND (len({found}) > 1 OR {rx(line, '[+,/]')}))"


def did(prefix: str, *parts: str) -> str:
    return hash16(f"{q(prefix)} || " + " || ".join(f"':' || coalesce(CAST({p} AS VARCHAR), '')" for p in parts))


def fingerprint(kind: str, leaves) -> str:
    return f"sha256({q(kind + ':')} || " + " || chr(1) || ".join(f"coalesce({norm(x)}, '')" for x in leaves) + ")"

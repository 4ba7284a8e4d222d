"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element's own text. Lines in containers that by
tag, role, a ``hidden`` attribute or a style of not being displayed are menus, headers, footers, sidebars, notices,
adverts, forms or reader comments carry no text, nor do lines that are mostly links (in a marked article
those of lists only). A class or id that says so counts, too, unless its container holds ``main`` or, and then all articles, at least half of
the page's text outside links, which no menu or notice does (what is named as comments stays out all the
same; a discussion is one of readers if two replies or more are in it). Names of headings, paragraphs and other
text elements say what they are about and never count; inside ``article`` and ``main`` only whole names of known
containers do. The text lengths of ``WINDOW`` lines
are summed at every line, a line counting for ``LINE`` characters at most, so that one long
paragraph does not put ordinary ones below the threshold. The text surges at the first line, and
dives behind the last line, whose window reaches the threshold, a share of the largest sum, and behind the lines
next to it in the same block; where the
page marks ``article`` or ``main`` elements with at least ``MARK`` of its text, only lines inside them
have weight and the threshold is one character, so that short first and last lines of the mark stay (README). A heading just above the surge belongs to the text. All lines between that carry text are
kept, lists and tables of short lines too.

Markup is scanned once, in time linear in the page, broken or not.

Defined cases: null or empty html, or html without such text, gives an empty text; unclosed and
stray tags are closed by their parents; a quote that is never closed is an ordinary character; a tag
without an end drops what is left of the page; all windows that reach the threshold count alike, so
ties need no rule; repeated pages are extracted each on their own; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import tokens

WINDOW = 3
#: Least share of the largest window sum that counts as text where no article is marked.
SHARE = 0.2
#: A line counts for at most so many characters in a window, about one printed line.
LINE = 80

#: Least share of the page's text that the marked elements hold, if the mark is to decide: most of it.
MARK = 0.5

QUOTES = re.compile(r"[\"'>]")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
RAW = frozenset("script style noscript template textarea title svg iframe object canvas annotation select option head".split())
#: Elements whose content is not parsed as markup.
OPAQUE = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ASIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w*|signup|login|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|widget\w*|footer\w*|foot|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|trending|comments?|comment\w*|disqus\w*|respond|repl(?:y|ies)|discussion|pagination|pager|paging|copyright|skip)(?:$|[\s_-])",
    re.I,
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks that are text of an article even where all of them is a link.
SAID = HEADINGS | {"p", "blockquote", "figcaption", "caption"}
P_ENDS = BLOCK - {"html", "body"}


COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|comment\w*|disqus\w*|respond|repl(?:y|ies))(?:$|[\s_-])", re.I)
#: A discussion is one of readers if it holds replies: elements so named, or with a time.
DISCUSSED = re.compile(r"(?:^|[\s_-])discussion(?:$|[\s_-])", re.I)
REPLY = re.compile(r"(?:^|[\s_-])(?:comment|reply|author|username|avatar|posted)(?:$|[\s_-])", re.I)
#: Inside an article a name counts only if a whole class, or id, is that of a known container.
INNER = re.compile(r"(?:^|\s)(?:ads?|advert|advertisements?|adsense|sponsored|promo|share|sharing|social|social-share|share-buttons|related|related-posts|related-articles|newsletter|newsletter-signup|subscribe|breadcrumbs?|pagination|pager|toolbar|popup|modal|sidebar|menu|nav|navigation|cookie-notice|cookie-banner)(?=\s|$)", re.I)
INNER_COMMENTS = re.compile(r"(?:^|\s)(?:comments?|comments-area|comment-list|comments-section|disqus_thread|respond|replies)(?=\s|$)", re.I)
#: Text elements, whose names say what they are about.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd pre blockquote figcaption caption td th tr table ul ol dl a b i em strong span mark code q cite time".split())
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
OPENED = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
#: Not aside; aside by tag, role or attribute; by class or id; by a class or id of reader comments, or of what may be some.
NO, SURE, NAMED, COMMENT, DISCUSSION = range(5)


def _aside(tag: str, attributes: str, in_article: bool) -> tuple[int, bool]:
    """What an element is, and whether it may be a reply of a reader's."""
    if tag in ASIDE or (tag == "header" and not in_article):
        return SURE, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return NO, tag == "time"
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    if "hidden" in found or found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true" or UNSEEN.search(found.get("style", "")):
        return SURE, False
    plain = f"{found.get('class', '')} {found.get('id', '')}"
    name = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", plain)
    reply = tag == "time" or bool(REPLY.search(name))
    if tag in TEXTUAL:
        if in_article or tag not in ("ul", "ol", "dl", "table"):
            return NO, reply
    if in_article:
        return COMMENT if INNER_COMMENTS.search(plain) else NAMED if INNER.search(plain) else NO, reply
    return COMMENT if COMMENTS.search(name) else DISCUSSION if DISCUSSED.search(name) else NAMED if ASIDE_NAME.search(name) else NO, reply


def markup(page: str):
    """(start, end, tag, closing, attributes) of tags, in order, each behind the one before. The tag
    is empty for comments, declarations and the like; a CDATA section's text is its attributes."""
    last = {mark: page.rfind(mark) for mark in ('"', "'", ">", "-->", "]]>")}
    plain = False  # no quotes: after a tag whose quotes hide its end

    def tag_end(at: int) -> int:
        nonlocal plain
        while not plain:
            mark = QUOTES.search(page, at)
            if mark is None:
                plain = True
            elif mark[0] == ">":
                return mark.end()
            else:
                before = mark.start() - 1
                while page[before].isspace():
                    before -= 1
                at = mark.end()
                if page[before] == "=" and at <= last[mark[0]]:
                    at = page.index(mark[0], at) + 1
        return page.index(">", start) + 1

    def behind(mark: str, at: int) -> int:
        return page.index(mark, at) + len(mark) if at <= last[mark] else len(page)

    at = 0
    while (opened := OPENED.search(page, at)) is not None:
        start, at = opened.span()
        if opened[0] == "<!--":
            at = behind("-->", at)
            yield start, at, "", False, ""
        elif opened[0] == "<![CDATA[" and at <= last["]]>"]:
            at = behind("]]>", at)
            yield start, at, "", False, page[start + 9 : at - 3]
        elif start > last[">"]:
            yield start, len(page), "", False, ""
            return
        elif opened[0][1] in "!?":
            at = behind(">", at)
            yield start, at, "", False, ""
        else:
            closing = opened[0][1] == "/"
            name = NAME.match(page, start + 1 + closing)
            at = tag_end(name.end())
            tag = name[0].lower()
            yield start, at, tag, closing, page[name.end() : at - 1]
            if tag in OPAQUE and not closing:
                close = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
                at = len(page) if close is None else close.start()


def lines(page: str) -> list[tuple[str, int, bool, bool, str, int]]:
    """(text, characters within links, carries text, in an article, block tag, number of the block around) by line."""
    out: list[tuple[str, int, bool, bool, str, int, int]] = []
    stack: list[tuple[str, bool, bool, int, int]] = []  # tag, surely aside, article, named container around, number
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack
    blocks: list[int] = []  # places of open block elements
    named: list[tuple[int, int]] = [(0, NO)]  # by number: the container around, what it is
    replies = [0]  # in each of them
    number = 0
    holds_main: set[int] = set()
    words: list[str] = []
    linked = links = raw = 0
    asides = articles = container = 0

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(words)).split())
        if text:
            out.append((text, linked, not asides, articles > 0, stack[blocks[-1]][0] if blocks else "", stack[blocks[-2]][4] if len(blocks) > 1 else 0, container))
        words.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links, raw, asides, articles, container
        while len(stack) > upto:
            tag, aside, article, container, _ = stack.pop()
            places[tag].pop()
            if tag in BLOCK:
                blocks.pop()
            links -= tag == "a"
            raw -= tag in RAW
            asides -= aside
            articles -= article

    at = 0
    for start, behind, tag, closing, attributes in markup(page):
        if start > at and not raw:
            piece = page[at:start]
            words.append(piece)
            linked += len(piece.strip()) * (links > 0)
        at = behind
        if not tag:
            if not raw:
                words.append(attributes)
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in BLOCK:
            end()
        if closing:
            # An inline end tag doesn't close blocks.
            if places.get(tag) and (tag in BLOCK or not blocks or places[tag][-1] > blocks[-1]):
                close(places[tag][-1])
            continue
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in P_ENDS and blocks:
            above = stack[blocks[-1]][0]
            if above == "p" or tag in ("li", "tr", "td", "th", "dd", "dt") and above == tag:
                close(blocks[-1])
        if tag == "body" and raw:
            close(0)
        article = tag in ("article", "main")
        aside, reply = _aside(tag, attributes, articles > 0)
        replies[container] += reply
        number += 1
        stack.append((tag, aside == SURE, article, container, number))
        places.setdefault(tag, []).append(len(stack) - 1)
        if tag in BLOCK:
            blocks.append(len(stack) - 1)
        if aside > SURE:
            named.append((container, aside))
            replies.append(0)
            container = len(named) - 1
        if tag == "main":
            around = container
            while around and around not in holds_main:
                holds_main.add(around)
                around = named[around][0]
        links += tag == "a"
        raw += tag in RAW
        asides += aside == SURE
        articles += article
    if not raw and at < len(page):
        words.append(page[at:])
    end()
    out_of = [False] * len(named)
    if len(named) > 1:
        held, marked = [0] * len(named), [0] * len(named)
        for text, in_links, carries, inside, _, _, own in out:
            size = (len(text) - min(in_links, len(text))) * carries
            held[own] += size
            marked[own] += size * inside
        for k in range(len(named) - 1, 0, -1):
            held[named[k][0]] += held[k]
            marked[named[k][0]] += marked[k]
            replies[named[k][0]] += replies[k]
        for k in range(1, len(named)):
            around, kind = named[k]
            comments = kind == COMMENT or (kind == DISCUSSION and replies[k] >= 2)
            most = 2 * held[k] >= held[0] > 0 and marked[k] == marked[0]
            named_only = kind == NAMED and k not in holds_main and not most
            out_of[k] = out_of[around] or (comments and k not in holds_main) or named_only
    return [(text, in_links, carries and not out_of[own], inside, tag, home) for text, in_links, carries, inside, tag, home, own in out]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    rows = lines(page)
    inside, outside = (sum(max(len(r[0]) - r[1], 0) for r in rows if r[2] and r[3] == mark) for mark in (True, False))
    marked = any(row[3] and row[2] for row in rows) and inside >= MARK * (inside + outside)
    weight = []
    for text, linked, carries, inside, tag, _ in rows:
        mostly_links = linked * 2 > len(text) and not (marked and inside and (linked < len(text) or tag in SAID))
        weight.append(len(text) if carries and not mostly_links and (inside or not marked) else 0)
    if not any(weight):
        return ""
    counted = [min(w, LINE) for w in weight]
    sums = [sum(counted[max(0, k - WINDOW // 2) : k + WINDOW // 2 + 1]) for k in range(len(weight))]
    least = 1 if marked else max(1, SHARE * max(sums))
    within = [k for k, w in enumerate(weight) if w and sums[k] >= least]
    surge, dive = within[0], within[-1]
    while surge and rows[surge - 1][4] in HEADINGS and weight[surge - 1]:
        surge -= 1
    while not marked and dive + 1 < len(rows) and rows[dive + 1][5] == rows[within[-1]][5] and weight[dive + 1]:
        dive += 1  # short last lines beside the last long one
    return "\n\n".join(rows[k][0] for k in range(surge, dive + 1) if weight[k])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars. See the module."""

    tokens.small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("page_id", "url", F.coalesce(text("html"), F.lit("")).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))

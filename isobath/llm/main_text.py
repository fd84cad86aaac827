"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block element's own text, in page order.  A line's weight is
its number of characters, or zero if it can't be article text: inside a menu, header, footer,
sidebar, form, notice, advert or reader comments (by element, role, or a word of class or id), outside
the article where the page marks one, or mostly links where it marks none.  Weights are summed
over a sliding window of ``WINDOW`` lines: the text surges where a sum reaches the threshold and dives
where one falls to zero; lines with weight between surge and dive are kept.

Where the page marks its article (``article``, or ``main``), a single character reaches the threshold,
so short paragraphs and headings stay.  Articles nested in an article are taken as its comments, as
HTML defines them.  Of several articles, those with a fourth of the longest one's text or more are
kept, and of unmarked pages the runs between surge and dive with as much.  An article that has
less than a fourth of what stands outside of it is no mark.

Character references are decoded, white space inside a line is one space, lines are joined by a
newline.  A page is read once, in time linear in its length; nothing is cut off.

Defined results: a null or empty page, or one without article text, gives an empty text; bytes that
are not UTF-8 become U+FFFD; rows are independent, so repeated rows repeat their result, and null
ids are kept; an empty table gives no rows; other columns are neither looked at nor returned.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm.common import decoded, slices

WINDOW = 3
#: Characters in a window at which text surges on a page that marks no article.
SURGE = 86
#: Share of the longest part's text that another part needs to be kept.
SHARE = 0.25

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; all of it is skipped.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements never part of an article's text.
APART = frozenset("aside audio button canvas datalist dialog footer form head map menu nav noscript object search select svg template video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that name what is no article text.
WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs consent cookie cookies footer gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: As ``WORDS``, and never wrapped around the article itself.
STRONG = frozenset("comment commentary commentlist comments disqus recommended recommendation recommendations related replies reply respond responses".split())
#: Words beside which one of ``WORDS`` tells how a page is laid out, and those of an article's own header.
LAYOUT, HEADLINE = frozenset("has layout no theme with without".split()), frozenset("article content entry post story".split())
#: Elements that a start tag of the key ends, up to the elements in the second set.
ENDED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
STOP = re.compile(r"""[>"']""")
CLOSE = {n: re.compile(f"</{n}(?=[\\s/>])", re.IGNORECASE) for n in RAW}
RIGHTS = re.compile(r"©|\(c\) ?[12]\d\d\d|all rights reserved", re.IGNORECASE)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``("text", it, "")``, ``("start", name, attributes)`` and ``("end", name, "")`` in page order, in linear time."""
    at, size, unclosed = 0, len(page), set()
    while at < size:
        opened = page.find("<", at)
        if opened < 0:
            yield "text", page[at:], ""
            return
        if opened > at:
            yield "text", page[at:opened], ""
        if page.startswith("<!--", opened):
            # an empty comment may end with the dashes that begin it
            end = opened + 4 if page.startswith(">", opened + 4) else page.find("-->", opened + 2)
            at = size if end < 0 else end + (1 if end == opened + 4 and page[end] == ">" else 3)
            continue
        found = NAME.match(page, opened + 1)
        if not found:
            if page[opened + 1 : opened + 2] in ("!", "?", "/"):
                end = page.find(">", opened)
                at = size if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = opened + 1
            continue
        end = found.end()
        while True:
            stop = STOP.search(page, end)
            if not stop:
                return
            mark = stop.group()
            if mark == ">":
                break
            close = -1 if mark in unclosed else page.find(mark, stop.end())
            if close < 0:  # no such quote follows anywhere: it quotes nothing
                unclosed.add(mark)
                end = stop.end()
            else:
                end = close + 1
        name, at = found.group().lower(), stop.end()
        if name[0] == "/":
            yield "end", name[1:], ""
            continue
        yield "start", name, page[found.end() : stop.start()]
        if name in RAW:
            close = CLOSE[name].search(page, at)
            at = close.start() if close else size


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def set_apart(name: str, raw: str, inside: bool) -> str:
    """Why an element holds no article text: ``tag``, ``strong`` or ``word``, or the empty string; ``inside`` an article."""
    if name in APART or name == "header" and not inside:
        return "tag"
    if "=" not in raw and "hidden" not in raw:
        return ""
    own = attributes(raw)
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower() or own.get("role", "").lower() in ROLES:
        return "tag"
    if name in ("html", "body", "main"):
        return ""
    for label in [*own.get("class", "").split(), own.get("id", "")]:
        words = [w.lower() for w in WORD.findall(label)]
        named = {*words, *map("".join, zip(words, words[1:]))}
        if STRONG & named:
            return "strong"
        if name != "article" and not LAYOUT & named and (WORDS & named or "header" in named and not inside and not HEADLINE & named):
            return "word"
    return ""


class Line:
    __slots__ = ("text", "linked", "heading", "apart", "article")

    def __init__(self, text: str, linked: int, heading: bool, apart: int, article: int) -> None:
        self.text, self.linked, self.heading, self.apart, self.article = text, linked, heading, apart, article


class Element:
    __slots__ = ("name", "apart", "article", "linked", "block")

    def __init__(self, name: str, apart: int, article: int, linked: bool, block: bool) -> None:
        self.name, self.apart, self.article, self.linked, self.block = name, apart, article, linked, block


def lines(page: str) -> tuple[list[Line], list[int], list[int]]:
    """The page's lines; per article the one around it (0: none; article 1 on, ``main`` negative); per set-apart element the one around it, or -1 if it isn't apart after all."""
    found: list[Line] = []
    stack = [Element("", 0, 0, False, True)]
    around, apart, strength = [0], [0], [""]
    opened: Counter = Counter()
    texts: list[str] = []
    linked = 0
    marked = False

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join(references.unescape("".join(texts)).split())
            if text:
                top = next(e for e in reversed(stack) if e.block)
                found.append(Line(text, linked, any(e.name in ("h1", "h2", "h3") for e in stack[-2:]), top.apart, top.article))
            texts.clear()
        linked = 0

    def pop() -> None:
        opened[stack.pop().name] -= 1

    for kind, name, raw in tokens(page):
        top = stack[-1]
        if kind == "text":
            if not top.block and top.apart != next(e for e in reversed(stack) if e.block).apart:
                continue  # an inline element that is set apart
            texts.append(name)
            if top.linked:
                linked += len(name.strip())
        elif kind == "start":
            block = name in BLOCKS
            if name in RAW:
                continue
            if name in VOID:
                if name == "br":
                    texts.append(" ")
                elif block:
                    flush()
                continue
            if block:
                flush()
                while len(stack) > 1 and not stack[-1].block and stack[-1].apart == stack[-2].apart or stack[-1].name == "p":
                    pop()
                ended, bounds = ENDED.get(name, ((), ()))
                if any(opened[e] for e in ended):
                    depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name in ended or stack[k].name in bounds), 0)
                    if depth and stack[depth].name in ended:
                        while len(stack) > depth:
                            pop()
                top = stack[-1]
            why = set_apart(name, raw, top.article > 0)
            inner, article = top.apart, top.article
            first = name in ("article", "main") and not marked and not why
            if first:  # what is wrapped around a page's first article isn't apart for its name
                marked, k = True, inner
                while k:
                    if strength[k] == "word":
                        strength[k] = "none"
                    k = apart[k]
            if why:
                apart.append(inner)
                strength.append(why)
                inner = len(apart) - 1
            elif name == "article":
                around.append(max(article, 0))
                article = len(around) - 1
            elif name == "main" and not article:
                article = -1
            if block or why or name == "a":
                stack.append(Element(name, inner, article, top.linked or name == "a", block))
                opened[name] += 1
        elif name in BLOCKS or opened[name]:
            if name in BLOCKS:
                flush()
            if opened[name]:
                depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name)
                if name in BLOCKS or all(not e.block for e in stack[depth + 1 :]):
                    while len(stack) > depth:
                        pop()
    flush()
    hidden = [-1] * len(apart)
    for k in range(1, len(apart)):
        hidden[k] = k if strength[k] != "none" else hidden[apart[k]]
    return found, around, hidden


def runs(weights: list[int], threshold: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges from each surge of the window sums to the dive that follows."""
    sums, total = [0] * len(weights), 0
    for k in range(len(weights) - 1, -1, -1):
        total += weights[k] - (weights[k + window] if k + window < len(weights) else 0)
        sums[k] = total
    out, k = [], 0
    while k < len(sums):
        if sums[k] < threshold:
            k += 1
            continue
        begin = k
        while k < len(sums) and sums[k] > 0:
            k += 1
        out.append((begin, k))
    return out


def main_text(page: str | None, surge: int = SURGE) -> str:
    """The article's blocks, joined by newlines."""
    if not page:
        return ""
    found, around, hidden = lines(page)
    open_lines = [hidden[x.apart] < 0 for x in found]
    own: Counter = Counter()
    for x, shown in zip(found, open_lines, strict=True):
        if shown:
            own[x.article] += len(x.text)
    articles = {k: n for k, n in own.items() if k > 0} or {k: n for k, n in own.items() if k < 0}
    outside = sum(len(x.text) for x, shown in zip(found, open_lines, strict=True) if shown and x.article == 0 and not _menu(x))
    most = max(articles.values(), default=0)
    if most and most >= SHARE * outside:
        kept = {k for k, n in articles.items() if n >= SHARE * most}
        kept = {k for k in kept if not _within(k, kept, around)}
        weights = [len(x.text) if shown and x.article in kept else 0 for x, shown in zip(found, open_lines, strict=True)]
        surge = 1
    else:
        weights = [0 if not shown or _menu(x) else len(x.text) for x, shown in zip(found, open_lines, strict=True)]
        surge = min(surge, max((sum(weights[k : k + WINDOW]) for k in range(len(weights))), default=0)) or 1
    parts = [(begin, end, sum(weights[begin:end])) for begin, end in runs(weights, surge)]
    largest = max((n for *_, n in parts), default=0)
    if surge == 1:
        largest = 0
    return "\n".join(found[k].text for begin, end, n in parts if n >= SHARE * largest for k in range(begin, end) if weights[k])


def _menu(x: Line) -> bool:
    """Mostly links, or a note of rights: no article text where the page marks no article."""
    return 2 * x.linked > len(x.text) and not x.heading or len(x.text) < 200 and RIGHTS.search(x.text) is not None


def _within(k: int, kept: set[int], around: list[int]) -> bool:
    """Whether an article lies in another that is kept."""
    while k > 0:
        k = around[k]
        if k in kept:
            return True
    return False


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, the columns ``keep``, and the main ``text`` of every row."""
    rows = pages.select(F.col(id_col), *[F.col(c) for c in keep], F.col(html_col).cast("string").alias("__html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                texts = pa.array([main_text(x) for x in decoded(part.column(part.num_columns - 1))], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=schema.names)

    return rows.mapInArrow(every, schema)

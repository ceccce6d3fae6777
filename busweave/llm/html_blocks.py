"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to a list of lines, one per block element. Menus, forms, scripts and other furniture leave a line
without weight; other lines weigh as much text as they hold outside links. Sums over sliding windows of lines rise
where an article begins (a surge) and fall to zero where it ends (a dive); the text between is kept.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busweave.llm.common import small_batches

#: Lines in a window, and characters of weight in one that make a surge. Titles and lines that end like a sentence weigh as
#: much by themselves, so that no opening or closing line of an article is dropped for being short.
WINDOW = 3
SURGE = 60
SENTENCE = regex.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")
LEGAL = regex.compile(r"©|\(c\)|copyright\b|all rights reserved", regex.IGNORECASE)
TITLES = frozenset(["h1", "h2"])
#: Elements that start a line, elements whose content is raw text, and furniture by element and by name.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
FURNITURE = frozenset("aside button dialog footer form head iframe menu nav noscript object script search select style svg template textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that a start tag closes, and what they aren't looked for beyond.
CELLS, LISTS = frozenset("table td th caption html object template button".split()), frozenset("ul ol menu".split())
TABLE = frozenset(["table", "html", "template"])
CLOSES = dict.fromkeys(BLOCKS - frozenset("body caption frameset head html legend tbody tfoot thead title tr".split()), [(frozenset(["p"]), CELLS)])
CLOSES["li"] = [(frozenset(["li"]), LISTS | CELLS), *CLOSES["li"]]
CLOSES["dt"] = CLOSES["dd"] = [(frozenset(["dt", "dd"]), frozenset(["dl"]) | CELLS), *CLOSES["dd"]]
CLOSES["option"] = [(frozenset(["option"]), frozenset(["select", "datalist", "optgroup"]))]
CLOSES["optgroup"] = [(frozenset(["option", "optgroup"]), frozenset(["select"]))] * 2
CLOSES["td"] = CLOSES["th"] = [(frozenset(["td", "th", "caption"]), TABLE | {"tr"})]
CLOSES["tr"] = [(frozenset(["tr", "caption"]), TABLE)]
CLOSES["tbody"] = CLOSES["thead"] = CLOSES["tfoot"] = [(frozenset(["tbody", "thead", "tfoot"]), TABLE), (frozenset(["tr", "caption"]), TABLE)]
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: End tags that close what is open inside their element; those of tables look beyond cells.
ENDS, OF_TABLES = BLOCKS | {"td", "th"}, frozenset("table tbody thead tfoot tr td th caption body html".split())
#: Words of a class or id that name furniture, words of comments among them, and words that go with them: a name counts
#: only if it holds no other word, so ``site-nav`` is a menu and ``has-sidebar``, ``share-price`` or ``social-policy`` are not.
COMMENTS = frozenset("comment comments disqus replies responses".split())
NAMED = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent footer masthead menu modal nav navbar navigation "
    "newsletter notice notices pagination popup promo promos promotion recommended related share sharing sidebar social sponsor sponsored sponsors subscribe "
    "toolbar topbar widget widgets".split()
)
BESIDE = frozenset(
    "site page main top bottom left right primary secondary global mobile header user reader post posts article articles entry email list bar box area section "
    "block wrapper container panel slot link links button buttons form signup item items inner overlay unit thread icons media stories".split()
)
WORDS = regex.compile(r"[a-z]+|[^a-z\s_\-0-9]")
#: A heading that counts reader comments, or says no more than that they follow.
COMMENT_HEADING = regex.compile(r"\d+ (?:comments?|reactions?|responses?|replies|reply)|(?:reader )?comments(?: \(\d+\))?", regex.IGNORECASE)
HEADINGS, REGIONS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset(["section", "div", "ul", "ol"])
ROLES = frozenset("banner complementary contentinfo dialog form menu menubar navigation search".split())
OPEN = regex.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
STOP = regex.compile("[>\"']")
ANCHOR = regex.compile(r"<(/?)a[\s>]", regex.IGNORECASE)
ATTRIBUTE = regex.compile(r"(class|id|role|hidden|aria-hidden|href)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", regex.IGNORECASE)


class Tags:
    """Tags of a page in order, each found in time that sums up to the length of the page."""

    def __init__(self, page: str):
        self.page, self.quotes = page, {'"', "'"}

    def end(self, at: int) -> int:
        """Place behind the ``>`` outside quotes that ends the tag, or -1.

        A quote that never closes is a character. Where quotes hide every later ``>``, none of them counts from there on.
        """
        start = at
        while True:
            stop = STOP.search(self.page, at)
            if stop is None:
                break
            if stop[0] == ">":
                return stop.end()
            close = self.page.find(stop[0], stop.end()) if stop[0] in self.quotes else stop.start()
            if close < 0:
                self.quotes.discard(stop[0])
            at = (close if close >= 0 else stop.start()) + 1
        self.quotes.clear()
        return self.page.find(">", start) + 1 or -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """``(start, end, name, closing, attributes)`` of the next tag; comments and declarations have no name."""
        found = OPEN.search(self.page, at)
        if found is None:
            return None
        if found[2] is None:
            mark = "-->" if found[0] == "<!--" else ">"
            stop = self.page.find(mark, found.end())
            if stop < 0 and mark == ">":
                return None
            return found.start(), len(self.page) if stop < 0 else stop + len(mark), "", False, ""
        stop = self.end(found.end())
        if stop < 0:
            return None
        return found.start(), stop, found[2].lower(), bool(found[1]), self.page[found.end() : stop - 1]


class Opened:
    """Open elements, innermost last, with the places of each name, so that no search walks the whole depth."""

    def __init__(self):
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def cut(self, at: int) -> None:
        while len(self.names) > at:
            self.places[self.names.pop()].pop()

    def last(self, names: frozenset[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def find(self, names: frozenset[str], beyond: frozenset[str]) -> int | None:
        """Innermost of ``names`` that is not outside one of ``beyond``."""
        at = self.last(names)
        return at if at >= 0 and at >= self.last(beyond) else None


def furniture_kind(name: str, attributes: str, in_article: bool, names: bool) -> str:
    """``tag`` or ``name`` or ``comments``, by what makes the element furniture; empty for others."""
    if name in FURNITURE or name == "header" and not in_article:
        return "tag"
    if not attributes or name in ("html", "body", "article", "main"):
        return ""
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return "tag"
        for token in value.split() if names and key in ("class", "id") else ():
            words = set(WORDS.findall(token))
            if words & NAMED and words <= NAMED | BESIDE:
                return "comments" if words & COMMENTS else "name"
    return ""


def close_open(opened: Opened, name: str, closing: bool, skip: int | None) -> None:
    """Take from the open elements what a tag closes: named by an end tag, or, as HTML allows, closed without one."""
    if not closing:
        rules = CLOSES.get(name, [])
        if "head" in opened.names[:3] and name not in IN_HEAD:
            rules = [(frozenset(["head"]), frozenset()), *rules]
        for names, beyond in rules:
            at = opened.find(names, beyond)
            if at is not None:
                opened.cut(at)
        return
    own = frozenset([name])
    if skip is not None and opened.names[skip] == name and name not in ENDS:
        at = opened.find(own, frozenset())
    elif name in ENDS:
        beyond = TABLE if name in OF_TABLES else CELLS | LISTS if name == "li" else CELLS
        at = opened.find(own, beyond - {name})
    else:
        at = opened.find(own, ENDS)
    if at is not None:
        opened.cut(at)


def lines_of(page: str, names: bool = True) -> tuple[list[tuple[str, int]], bool]:
    """``(text, weight)`` per line of the page, and whether it marks an article or main element.

    A piece of furniture is one empty line of weight zero. On a marked page all text inside such an element weighs, and
    nothing outside; on others, text outside links, with ``SURGE`` on top for a title or a sentence, unless it is a legal
    notice. With ``names`` off, classes and ids name no furniture.
    """
    lines, buffer, linked, link = [], [], 0, False
    opened, skip, kind, inside, marked, at = Opened(), None, "", 0, False, 0
    tags = Tags(page)

    def close(title: bool = False) -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            weight = max(0, len(text) - linked)
            reads = weight and (title or SENTENCE.search(text) and not LEGAL.match(text))
            lines.append((text, weight + SURGE if reads else weight, inside > 0))
        buffer.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        buffer.append(text)
        linked += len(text) if link else 0

    end = len(page)
    while at < end:
        tag = tags.next(at)
        if tag is None:
            if skip is None:
                add(page[at:])
            break
        start, stop, name, closing, attributes = tag
        if skip is None and start > at:
            add(page[at:start])
        at = stop
        if not name:
            continue
        void = name in VOID or attributes.endswith("/") and name not in BLOCKS and name not in RAW
        if not closing and name in RAW:  # up to its end tag, markup in it is text
            last = regex.compile(rf"</{name}\s*>", regex.IGNORECASE).search(page, at)
            at = last.end() if last else end
            continue
        heading = closing and skip is None and name in HEADINGS and len(lines)
        close_open(opened, name, closing, skip)
        if not closing and not void:
            opened.push(name)
        if skip is not None:
            layout = not closing and not marked and (name in ("main", "h1") or name == "article" and kind == "name") and kind != "tag"
            if len(opened.names) > skip + (not closing and not void) and not layout:
                continue
            skip = None  # closed (if by a tag of another element, that tag counts), or a named part that holds the article
        found = "" if closing or void else furniture_kind(name, attributes, inside > 0, names)
        if found:
            if name in BLOCKS or name in ("noscript", "template"):
                close()
                lines.append(("", 0, inside > 0))
            skip, kind = len(opened.names) - 1, found
            continue
        if name in BLOCKS:
            close(closing and name in TITLES)
            if name in ("article", "main"):
                marked = True
                inside = max(0, inside + (-1 if closing else 1))
            if heading is not False and len(lines) > heading and COMMENT_HEADING.fullmatch(lines[-1][0]):
                region = opened.last(REGIONS)
                if region > opened.last(frozenset(["article", "main", "body"])):
                    lines[-1] = ("", 0, inside > 0)
                    skip, kind = region, "comments"
        elif name in ("br", "td", "th", "img", "wbr"):
            buffer.append(" " if name != "wbr" else "")
        elif name == "a":  # a link, if it closes before the next anchor; a target without href is none
            after = None if closing or "href" not in attributes.lower() else ANCHOR.search(page, at)
            link = after is not None and after[1] == "/"
    close()
    if marked:
        return [(text, len(text) if within else 0) for text, _, within in lines], True
    return [(text, weight) for text, weight, _ in lines], False


def regions(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """``(start, end)`` of the lines between each surge and the dive after it.

    Sums run over ``window`` lines in a row, also those that reach over either end of the page. A stretch of windows with
    text lasts until a window without any: the dive. It counts if a window in it holds ``surge`` characters or
    more: the surge. It spans its first to its last line with weight. Where no window holds as much, every stretch counts.
    """
    n = len(weights)
    upto = [0]
    for w in weights:
        upto.append(upto[-1] + w)
    sums = [upto[min(n, i + window)] - upto[max(0, i)] for i in range(1 - window, n)]
    found, start, peak = [], None, 0
    for k, total in enumerate([*sums, 0]):
        if total and start is None:
            start, peak = k, total
        elif total:
            peak = max(peak, total)
        elif start is not None:
            # Window k - 1 was the last with text: its first line is the last one with weight; that of the first is its end.
            found.append((start, k - window + 1, peak))
            start = None
    strong = [(a, b) for a, b, peak in found if peak >= surge]
    return strong or [(a, b) for a, b, _ in found]


def article_spans(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Stretches from the first surge to the last dive: those that surge, and all between them, however short.

    A stretch before the first or after the last that does not surge is a menu, a footer or the like.
    """
    strong = regions(weights, window, surge)
    if not strong:
        return []
    return [(a, b) for a, b in regions(weights, window, 1) if a >= strong[0][0] and b <= strong[-1][1]]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Text between the surges and dives of the page's lines; empty and null pages give an empty text.

    On a page that marks its article the marks give the weights and any text in it is a surge. On others a surge takes
    ``surge`` characters in a window, and lines without weight between surge and dive, such as linked headings, stay. Where
    the names of classes and ids leave nothing, they are not used.
    """
    lines, marked = lines_of(page or "")
    if not any(w for _, w in lines):
        lines, marked = lines_of(page or "", names=False)
    spans = article_spans([w for _, w in lines], window, 1 if marked else surge)
    return "\n".join(text for a, b in spans for text, w in lines[a:b] if text and (w or not marked))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without its markup column, with ``text``. One row per row; repeated rows stay, other columns pass."""
    own = [c for c in pages.columns if c not in (html_col, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = pa.array([main_text(p.as_py()) for p in batch.column(len(own))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*own, "text"])

    source = pages.select(*[F.col(f"`{c}`") for c in own], F.col(html_col).cast("string").alias("__html"))
    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in own)
    return source.mapInArrow(run, f"{kinds}text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))

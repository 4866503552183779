"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from barlens.llm.common import pieces

#: Lines of a sliding window; share of the largest window sum that counts as a surge.
LINES, SURGE = 3, 0.25
#: A line that is links to this share is a menu's.
LINKED = 0.6

#: Elements whose content is not text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math", "canvas", "audio", "video", "xmp", "noembed", "noframes"}
#: Elements that hold what surrounds an article.
ASIDE = {"nav", "aside", "footer", "form", "menu", "dialog", "head", "select", "button", "fieldset", "datalist", "label"}
#: Elements inside a line of text; every other one ends the line.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that close an open paragraph.
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words in class, id or role that mark the same.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner breadcrumb breadcrumbs byline colophon comment comments commentlist cookie cookies consent "
    "copyright disclaimer discussion disqus dialog feedback footer footnav form gdpr header login masthead menu menubar meta modal nav navbar navigation navigations newsletter notice notices "
    "notification overlay pager pagination popup promo promoted promotion promotions recommended related replies reply responses search share sharing shares sidebar sidebars signup skip social "
    "sponsor sponsored sponsors subscribe subscription tags taglist teaser toc toolbar topbar widget widgets complementary contentinfo alert alertdialog".split()
)
#: Words that mark the article itself; a container with one is not judged by the marks.
MAIN = {"article", "main", "content", "post", "story", "entry", "articlebody", "body", "page", "wrapper", "container"}
HOLDS = {"articlebody"}
#: Elements that hold blocks of text; stretches of one of them belong together.
CONTAINERS = {"div", "section", "article", "main", "td"}

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^<>]*$", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


def _kind(name: str, attributes: str, inside: bool) -> str:
    """``drop``, ``main`` or nothing for an element; ``inside``: an article is open."""
    if name in ASIDE or (name == "header" and not inside):
        return "drop"
    found: dict[str, str] = {}
    if attributes.strip():
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return "drop"
    words = [set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", found.get(k, "")).lower())) - {""} for k in ("class", "id", "role")]
    every = set().union(*words)
    main = name in ("article", "main") or found.get("itemprop", "").lower() in HOLDS or "main" in words[2] or "article" in words[2]
    if name not in ("html", "body", "main") and every & MARKS and not (main and not every & {"comment", "comments", "reply", "teaser", "related", "ad", "promo"}):
        # a heading or paragraph of an article may carry such a word as a style
        if not (every & MAIN and not inside and not every & MARKS - {"header", "meta", "tags"}) and not (name in ("h1", "h2", "h3") and every & MARKS <= {"header"}):
            return "drop"
    return "main" if main else ""


def lines(html: str) -> list[tuple[str, float, bool, bool, tuple[int, ...]]]:
    """The page's lines: text, share of it in links, whether in an article, whether stripped, containers.

    What lies in a stripped element comes as one empty line for the whole element.
    """
    out: list[tuple[str, float, bool, bool, tuple[int, ...]]] = []
    held: list[str] = []
    linked = 0
    open_: list[tuple[str, str, int]] = []
    dropped = mains = links = 0

    def end(gap: bool = False) -> None:
        nonlocal linked
        text = _SPACE.sub(" ", unescape("".join(held))).strip() if held else ""
        if text:
            out.append((text, linked / max(1, sum(map(len, held))), mains > 0, False, tuple(x for *_, x in open_ if x)))
        held.clear()
        linked = 0
        if gap:
            out.append(("", 0.0, mains > 0, True, ()))

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece and not dropped:
            held.append(piece)
            linked += len(piece) * (links > 0)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            where = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if where is None:
                if name not in INLINE and not dropped:
                    end()
                continue
            if name in INLINE and any(x not in INLINE for x, *_ in open_[where + 1 :]):
                where_only = [where]
            else:
                where_only = list(range(where, len(open_)))
            if name not in INLINE and not dropped:
                end()
            for i in reversed(where_only):
                shut, kind, _ = open_.pop(i)
                links -= shut == "a"
                dropped -= kind == "drop"
                mains -= kind == "main"
            continue
        if name in RAW:
            if name not in INLINE and not dropped:
                end()
            if not m[3].rstrip().endswith("/") or name in ("script", "style"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = close.end() if close else n
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in INLINE:
            if name not in VOID:
                if name == "a" and links:
                    continue
                kind = _kind(name, m[3], mains > 0) if m[3].strip() else ""
                kind = kind if kind == "drop" else ""
                open_.append((name, kind, 0))
                dropped += kind == "drop"
                links += name == "a"
            continue
        if not dropped:
            end()
        if name in VOID:
            continue
        if name in CLOSES_P and any(x == "p" for x, *_ in open_) or name == "li" and open_ and open_[-1][0] == "li":
            what = "p" if name in CLOSES_P else "li"
            where = max(i for i, (x, *_) in enumerate(open_) if x == what)
            if all(x in INLINE for x, *_ in open_[where + 1 :]):
                for shut, kind, _ in open_[where:]:
                    links -= shut == "a"
                    dropped -= kind == "drop"
                    mains -= kind == "main"
                del open_[where:]
        kind = _kind(name, m[3], mains > 0)
        if kind == "drop" and not dropped:
            end(gap=True)
        open_.append((name, kind, at if name in CONTAINERS else 0))
        dropped += kind == "drop"
        mains += kind == "main"
    end()
    return out


def main_text(html: str) -> str:
    """The text between surges and dives of the page's line lengths.

    Markup and stripped elements become empty lines, and so do menus, lines outside an article that are
    mostly links.  The lengths of ``LINES`` lines are summed; where the sum is largest lies the main surge,
    and the block around it is its home: the named articles, if they hold most of the page's text,
    else the innermost container that holds most of its stretch.  A stretch begins where the sum surges and
    ends where it dives to nothing or leaves or enters the home.  Those of the home are kept whatever
    their length; others if they reach ``SURGE`` of the largest sum and the home is not a named article.
    """
    found = lines(html)
    size = [0 if gap or (share >= LINKED and not main) else len(text) for text, share, main, gap, _ in found]
    if not any(size):
        return ""
    sums = [sum(size[i : i + LINES]) for i in range(len(size))]
    top = sums.index(max(sums))
    top = max(range(top, min(top + LINES, len(size))), key=size.__getitem__)
    first = last = top
    while first and size[first - 1]:
        first -= 1
    while last + 1 < len(size) and size[last + 1]:
        last += 1
    named = 2 * sum(n for n, x in zip(size, found, strict=True) if x[2]) > sum(size)
    if named:
        home = [x[2] for x in found]
    else:
        inside: dict[tuple[int, ...], int] = {}
        for i in range(first, last + 1):
            path = found[i][4]
            for k in range(len(path) + 1):
                inside[path[:k]] = inside.get(path[:k], 0) + size[i]
        holder = max((x for x, n in inside.items() if 2 * n > inside[()]), key=len)
        # the page itself is a container of what no other one holds
        home = [x[4][: len(holder)] == holder if holder else not x[4] for x in found]
    need = SURGE * max(sums)
    kept: list[str] = []
    at = 0
    while at < len(size):
        if not size[at]:
            at += 1
            continue
        end = at
        while end < len(size) and size[end] and home[end] == home[at]:
            end += 1
        # the dive: the first line after which nothing follows
        if home[at] or not named and max(sum(size[i : min(i + LINES, end)]) for i in range(at, end)) >= need:
            kept += [found[i][0] for i in range(at, end)]
        at = end
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every page, one row per input row.

    Character references are decoded, white space inside a line becomes one space, lines are joined by
    a line feed.  A null or empty page, or one without text, gives an empty text; a page cut off in a tag
    loses the tag; pages of any length are read whole.  Rows that repeat are extracted each for itself;
    an empty table gives no row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )

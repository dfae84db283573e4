"""HTML main-text extraction by consensus host paths.

Every page scores its containers by the text in them outside boilerplate and links, and votes for the
generalised tag-class path of the best one. Spark counts the votes per host. Each page is then
extracted again from the containers on its host's winning path; a page without text there uses its
own best.

Boilerplate is told by the element (``nav``, ``aside``, forms, ...) or by its class, id and role.
Inside the article only names that say nothing else count (``ad-slot``, ``comments``), and not around
its title; of others (``related-work``) the content decides: mostly links, or hardly any text. A part
named as a header stays with its heading.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
#: Elements that never hold main text.
DROPPED = frozenset("nav footer aside button select textarea script style noscript template iframe svg canvas video audio object head title dialog menu datalist input option".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Elements that begin and end a block; all others run on in their line.
BLOCK = CLOSES_P | frozenset("html body br li dt dd caption col colgroup tbody thead tfoot tr td th legend optgroup option".split())
CONTAINERS = frozenset("body main article section div td center".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
SIBLINGS = frozenset("li td th tr dt dd option".split())

#: Words of class, id or role that mark boilerplate wherever it stands, and those that may also name a part of an article.
HARD = frozenset(
    "ad ads advert adverts advertisement advertisements advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer masthead menu modal nav navbar navigation "
    "newsletter notice notices popup promo promos promoted sidebar sponsor sponsored subscribe".split()
)
SOFT = frozenset("copyright disclaimer header promotion related search share sharing social toolbar widget widgets".split())
#: Words that say where or how large a part is, not what it is.
LAYOUT = frozenset("area bar block body bottom box col column container count floating form group head holder id inner item items large left link links list meta mobile outer panel place placeholder reply respond right row section slot small text thread title top unit wrap wrapper".split())
MAIN = frozenset("article content entry main post story text body".split())

#: Comments, declarations and tags. A quote opens a value only after "=", and one that never closes is an
#: ordinary sign; a tag that never closes takes the rest of the page. Nothing is tried twice.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"

#: What an element's tag and names say: nothing, boilerplate, perhaps boilerplate, the same by a name of several meanings,
#: boilerplate but for an article's title.
PLAIN, GONE, PURE, MIXED, NAMED = range(5)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of a page's text from which a container that is named as main text, or any container, can stand for the page; least text of a part with a name like boilerplate.
NAMED_SHARE, ANY_SHARE, KEPT_SHARE, LEAST_PART = 0.5, 0.8, 0.9, 200


class Element:
    __slots__ = ("gone", "has_h1", "has_p", "headed", "heads", "inside", "kind", "level", "linked", "mass", "name", "parent", "tag", "title", "top", "total", "wraps")

    def __init__(self, tag: str, name: str, parent: Element | None, kind: int, level: int):
        self.tag, self.name, self.parent, self.kind, self.level = tag, name, parent, kind, level
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.has_h1 = self.has_p = self.headed = self.heads = self.wraps = self.title = self.gone = False
        self.total = self.linked = self.mass = 0
        self.top: Element | None = None

    def dull(self) -> bool:
        """Whether a part that is named like boilerplate is it, by its content."""
        if self.has_h1 or self.headed and self.heads:
            return False
        return 3 * self.linked >= self.total or self.kind == PURE and self.total < LEAST_PART and not self.has_p


def _attributes(raw: str) -> tuple[list[str], list[str], bool]:
    """Class and id names, roles, and whether the element is hidden."""
    names, roles, hidden = [], [], False
    for m in ATTRIBUTE.finditer(raw):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if kind in ("class", "id"):
            names += value.split()
        elif kind == "role":
            roles += value.split()
        elif kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and HIDING.search(value):
            hidden = True
    return names, roles, hidden


def _kind(names: list[str], roles: list[str]) -> int:
    found = PLAIN
    if not HARD.isdisjoint(roles):
        return GONE
    for name in (*names, *roles):
        words = WORD.findall(name)
        hard = not HARD.isdisjoint(words)
        if hard or not SOFT.isdisjoint(words):
            pure = all(w in HARD or w in SOFT or w in LAYOUT for w in words)
            if hard and pure:
                return NAMED
            found = PURE if pure else found or MIXED
    return found


def parse(source: str) -> tuple[list[Element], list[tuple[Element, str, bool, bool]]]:
    """The page's elements, outer ones first, and its text runs in order: (innermost element, text, within a link, starts a block)."""
    root = Element("", "", None, PLAIN, 0)
    stack, elements, open_tags = [root], [root], Counter()
    runs: list[tuple[Element, str, bool, bool]] = []
    fresh, at, n = True, 0, len(source)

    def close(to: int) -> None:
        for e in stack[to:]:
            open_tags[e.tag] -= 1
        del stack[to:]

    while at < n:
        m = TOKEN.search(source, at)
        text = source[at : m.start() if m else n]
        if text:
            # References are decoded run by run: none reaches over a tag.
            runs.append((stack[-1], html.unescape(text) if "&" in text else text, open_tags["a"] > 0, fresh))
            fresh = False
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            fresh = True
        if m[1]:
            if open_tags[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if stack[-1].tag == "p" and tag in CLOSES_P or stack[-1].tag == tag and tag in SIBLINGS or stack[-1].tag == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in VOID:
            continue
        if tag in RAW:
            end = RAW_END[tag].search(source, at)
            at = end.end() if end else n
            continue
        names, roles, hidden = _attributes(m[3]) if m[3] else ([], [], False)
        parent = stack[-1]
        kind = PLAIN if tag in ("body", "html", "article", "main") or not (names or roles) else _kind(names, roles)
        if hidden or tag in DROPPED or tag == "header" and not (parent.inside or parent.tag in ("article", "main")):
            kind = GONE
        name = tag + "".join(sorted("." + DIGITS.sub("#", x) for x in (*names, *roles))) if tag in BLOCK else ""
        level = {"article": 3, "main": 2}.get(tag, int(any(not MAIN.isdisjoint(WORD.findall(x)) for x in names)) if tag in CONTAINERS and tag != "body" else 0)
        element = Element(tag, name, parent, kind, level)
        element.headed = any("header" in WORD.findall(x) for x in names)
        stack.append(element)
        elements.append(element)
        open_tags[tag] += 1
    _weigh(elements, runs)
    return elements, runs


def _weigh(elements: list[Element], runs: list[tuple[Element, str, bool, bool]]) -> None:
    """Text of each element, and whether it is boilerplate, as long as no container is chosen."""
    sizes = []
    for element, text, linked, _ in runs:
        size = len(text) if not text[:1].isspace() and not text[-1:].isspace() else len(text.strip())
        sizes.append(size)
        element.total += size
        element.linked += linked * size
    for e in reversed(elements[1:]):
        up = e.parent
        up.total += e.total
        up.linked += e.linked
        up.has_p |= e.has_p or e.tag == "p"
        up.has_h1 |= e.has_h1 or e.tag == "h1"
        up.heads |= e.heads or e.tag in HEADINGS
        up.wraps |= e.wraps or e.tag in ("article", "main", "h1")
    for e in elements[1:]:
        e.gone = e.parent.gone or _boilerplate(e, e.inside)
    for (element, _, linked, _), size in zip(runs, sizes, strict=True):
        if not element.gone:
            element.mass += size / 4 if linked else size
    holder: dict[int, Element] = {}
    for e in elements:
        holder[id(e)] = e if e.parent is None or e.tag in CONTAINERS else holder[id(e.parent)]
    for e in reversed(elements[1:]):
        e.parent.mass += e.mass
        e.parent.title |= e.title or e.tag == "h1" and not e.gone
        if e.tag in CONTAINERS and not e.gone and e.mass:
            outer = holder[id(e.parent)]
            if outer.top is None or e.mass >= outer.top.mass:
                outer.top = e


def _boilerplate(e: Element, inside: bool) -> bool:
    if e.kind == GONE or e.tag == "form" and not e.wraps:
        return True
    if e.kind == NAMED:
        return not (inside and e.has_h1)
    return e.kind in (PURE, MIXED) and (not inside or e.dull())


def path_of(e: Element) -> str:
    """Generalised tag-class path, from the page's root on."""
    names = []
    up: Element | None = e
    while up is not None:
        if up.name:
            names.append(up.name)
        up = up.parent
    return ">".join(reversed(names))


def best_container(elements: list[Element]) -> tuple[str | None, float]:
    """Generalised path of the container that stands for the page, and its score; no path without text.

    The heaviest containers are followed inwards. An article goes before other elements that are named
    as main text, and these before others; the innermost stands for the page that loses little. A
    title just outside it is taken in.
    """
    root = elements[0]
    if not root.mass:
        return None, 0.0
    chain = [root]
    while chain[-1].top is not None and chain[-1].top.mass >= NAMED_SHARE * root.mass:
        chain.append(chain[-1].top)
    level = max(e.level for e in chain)
    if level:
        named = [e for e in chain if e.level == level]
    else:
        named = [e for e in chain if e.mass >= ANY_SHARE * root.mass]
    best = named[0]
    if level < 2:
        best = [e for e in named if e.mass >= (KEPT_SHARE if level else ANY_SHARE) * best.mass][-1]
        titled = [e for e in chain if e.title and best.mass >= ANY_SHARE * e.mass]
        if titled and not best.title:
            best = titled[-1]
    return path_of(best), float(best.mass)


def text_on(elements: list[Element], runs: list[tuple[Element, str, bool, bool]], path: str) -> str:
    """Text of the containers on ``path``, blocks apart by one space; empty if the page has none of them."""
    names = path.split(">") if path else []
    # Of each element: how many names of the path its own path agrees with, -1 once it left it; whether it is within a container, and left out there.
    agreed: dict[int, int] = {}
    state: dict[int, tuple[bool, bool]] = {}
    for e in elements:
        if e.parent is None:
            agreed[id(e)], state[id(e)] = 0, (not names, False)
            continue
        up, (within, out) = agreed[id(e.parent)], state[id(e.parent)]
        if e.name:
            up = up + 1 if 0 <= up < len(names) and names[up] == e.name else -1
        agreed[id(e)] = up
        if within:
            state[id(e)] = (True, out or _boilerplate(e, True))
        else:
            state[id(e)] = (bool(e.name) and up == len(names) and not e.gone, False)
    pieces: list[str] = []
    last: bool | None = None
    for element, text, _, fresh in runs:
        within, out = state[id(element)]
        if not within or out:
            last = False if pieces else None
            continue
        if pieces and (fresh or last is False):
            pieces.append("\n")
        pieces.append(text)
        last = True
    return " ".join("".join(pieces).split())


def extract(source: str | None, path: str | None) -> str:
    """Main text of one page, given its host's winning path."""
    elements, runs = parse(source or "")
    got = text_on(elements, runs, path) if path is not None else ""
    if not got:
        own, _ = best_container(elements)
        got = text_on(elements, runs, own) if own is not None and own != path else ""
    return got


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [best_container(parse(t.as_py() or "")[0]) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["host", "path", "score"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [extract(h.as_py(), p.as_py()) for h, p in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array([len(g) for g in got], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, path, votes)``: each host's winning path, by votes, then by score, then by name."""
    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_votes, "host string, path string, score double")
    counted = votes.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("best")).select("host", "best.path", "best.votes")


def host_of(url):
    """Host of a URL in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null and empty pages, and pages without text of their own, give an empty text; a page of any length
    is read whole, in time in proportion to it, whatever is left unclosed in it. Repeated rows vote and
    are extracted each; pages without a host vote together; of equal votes the larger text wins. Ids
    and URLs may be null; further columns are ignored, and an empty table gives an empty result.
    """
    winners = Scratch(pages.sparkSession, "html").save(host_paths(pages, url_col, html_col), "winners")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    # Winners are a scan, so Spark picks the join by their size and can split a hot host.
    joined = rows.join(winners.select("host", "path"), "host", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "path")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")

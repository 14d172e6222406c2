"""Main text of web pages by deduction of each host's template.

A page is read as tokens: the paths of its elements, and its text blocks at their paths.

* Over the pages of one host, tokens with the same occurrence vector (how often they occur
  on each page) form an equivalence class.  Vectors are compared by two sums over pages of
  occurrences times a hash of the page, which aggregate like counts do, so a host with a
  third of all pages costs each task one row per token.
* Tokens on a part of the host's pages (`SUPPORT`) are frequent; their number is bounded by
  the size of a page and not by how many pages there are.  A class of them is valid if its
  elements nest: all hang below the same element of another class (a class that does not is
  split by where it hangs); if it has several tokens; and if its elements stand in one order
  on nearly all pages, which a second reading of the pages counts.  A class need not cover
  the host, so several layouts have a template each, and classes nest below each other.
* Elements of valid classes bound slots.  The second reading also sums, for each slot, how
  much prose the pages that have it hold inside it and in all, and how much of its own text
  is linked or the same on many pages.  The innermost slot that holds nearly all prose of
  its pages is the article's; slots mostly of linked or repeated text are left out.

The template's slot decides on every page.  Where a page itself names its article (`article`,
`main`) and the slot is in it or around it, the name says how far the article reaches; a named
element beside the slot stays unless its slot is left out, and if all that a page names lies
beside the slot of its template, the slot is the article.
Menus, headers, footers, sidebars, forms and scripts go by their element, and adverts,
comments and the like where the name of an element says nothing else than that.  Other
names (a warning, related work, a search) are no reason by themselves: inside the article
such a block goes only if the template has its text or its slot is left out.  Text that the template has stays inside `article` and `main`, and
elsewhere if it is a heading, stands between blocks of the page's own, or is more than half
of the page.

Null and empty pages give an empty text.  Pages without a host (null or odd url) share
the host ''.  A host of fewer than LEAST_PAGES pages has no template: a page's own prose
then shows its slot.  Rows with equal or null ids are extracted separately, copies alike.
Extra columns are ignored; an empty table gives an empty result.  Parsing runs in Python
over Arrow batches, in time linear in the page; deduction is DataFrame aggregation and one
bounded group for each host.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import maybe_broadcast, short_batches, table, written

#: Pages of a host, and part of them, that a token of its template is on at least.
LEAST_PAGES = 3
SUPPORT = 0.2
#: Tokens that a valid class has.
LEAST_TOKENS = 2
#: Part of the pages on which a class may stand in another order.
DISORDER = 0.1
#: Part of the prose that the article's slot holds.
PROSE = 0.8
#: Part of a slot's text that is linked or repeated if it is left out.
BOILER = 0.5

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "label", "ruby", "rt", "rp", "picture", "source",
}
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
#: Elements that never hold text of the page, and those that hold no article.
TECHNICAL = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "select", "textarea", "title", "canvas", "audio", "video", "noembed", "noframes", "input"}
EXCLUDED = TECHNICAL | {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
#: Words of class, id or role that name what is never part of an article, ...
STRONG = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies",
    "disqus", "footer", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "pager", "pagination", "popup", "promo", "promoted", "promotion",
    "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar",
}
#: ... what often is none, ...
WEAK = {
    "alert", "aside", "banner", "byline", "complementary", "copyright", "discussion", "header", "legal", "masthead", "notice", "notices", "overlay", "recommended", "related",
    "reply", "responses", "search", "warning", "widget", "widgets",
}
#: ... and what may stand beside the first kind in a name without changing what it says.
NEUTRAL = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form", "global", "inner", "item", "items", "left", "link", "links", "list", "main", "outer",
    "page", "panel", "right", "section", "site", "slot", "thread", "top", "unit", "wrap", "wrapper",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Levels of elements that paths tell apart; elements further down share a path.
DEPTH = 64
#: Elements that their kind, starting again, closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = {"table", "ul", "ol", "dl", "div", "section", "article", "main", "body", "nav", "aside", "footer", "header", "form", "blockquote", "select", "button"}

TAG = re.compile(
    r"<!--(?:.*?-->|>|->|.*\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe|noembed|noframes|xmp)(?P<rawattrs>(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(?P<content>.*?)(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-z][^\s>/]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-z][^\s>/]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-z][-a-z0-9_:]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


class Block:
    __slots__ = ("path", "text", "linked", "excluded", "weak", "article")

    def __init__(self, path: str, text: str, linked: int, excluded: bool, weak: bool, article: bool):
        self.path, self.text, self.linked, self.excluded, self.weak, self.article = path, text, linked, excluded, weak, article

    @property
    def heading(self) -> bool:
        return self.path.rpartition("/")[2].partition(".")[0] in HEADINGS


@functools.lru_cache(4096)
def _named(name: str) -> tuple[bool, bool]:
    """Whether a class, id or role says that an element is no part of the article, and whether it hints at it."""
    words = {w.lower() for w in WORD.findall(name)}
    own = {w for w in words if not w.isdigit()}
    return bool(own & STRONG) and own <= STRONG | WEAK | NEUTRAL, bool(own & (STRONG | WEAK))


def _marked(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element's attributes say that it is no part of the article, or hint at it; its class, for its path."""
    if not attributes or attributes.isspace():
        return False, False, ""
    found = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
    name = found.get("class", "")
    if tag in ("html", "body", "article", "main"):
        return False, False, name
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    said = [_named(x) for k in ("class", "id", "role") for x in found.get(k, "").split()]
    return hidden or any(x for x, _ in said), any(x for _, x in said), name


def parse(page: str, hints: bool = True) -> tuple[list[Block], Counter]:
    """Text blocks in page order, and how often each path of elements occurs, by first
    occurrence.  Without hints nothing is told by the names of elements and classes."""
    blocks: list[Block] = []
    paths: Counter = Counter()
    stack: list[tuple[str, str, bool, bool, bool]] = []  # element, path, excluded, hinted at, in the article
    parts: list[str] = []
    opened: Counter = Counter()  # elements on the stack
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, path, excluded, weak, article = next((x for x in reversed(stack) if x[0] not in INLINE), ("", "", False, False, False))
                blocks.append(Block(path, text, min(linked, len(text)), excluded, weak, article))
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal links
        opened.subtract(x[0] for x in stack[at:])
        links = opened["a"]
        del stack[at:]

    def say(raw: str) -> None:
        nonlocal linked
        if stack and stack[-1][2] and stack[-1][0] in INLINE and not next((x[2] for x in reversed(stack) if x[0] not in INLINE), False):
            return  # an excluded piece inside a block that stays
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text)

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        kind = m.lastgroup
        if m["end"]:
            tag = m["end"].lower()
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # an inline end reaches no further than its block
        elif kind in ("start", "attrs"):
            tag, attributes = m["start"].lower(), m["attrs"] or ""
            if tag == "br":
                parts.append(" ")
                continue
            if tag not in INLINE:
                flush()
                shut = CLOSES.get(tag)
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or shut and stack[k][0] in shut:
                        close(k)
                        if not shut:
                            break
                    elif stack[k][0] in SCOPE:
                        break
            if tag in VOID:
                continue
            _, path, excluded, weak, article = stack[-1] if stack else ("", "", False, False, False)
            strong, hinted, name = _marked(tag, attributes)
            if tag not in INLINE:
                if len(stack) < DEPTH:
                    path = f"{path}/{tag}.{name.replace('/', '|')}" if name else f"{path}/{tag}"
                paths[path] += 1
            if hints:
                article = article or tag in ("article", "main")
                stack.append((tag, path, excluded or strong or tag in EXCLUDED or tag == "header" and not article, weak or hinted, article))
            else:
                stack.append((tag, path, excluded or tag in TECHNICAL, False, False))
            opened[tag] += 1
            links = opened["a"]
        elif m["raw"] and m["raw"].lower() not in INLINE:
            flush()
    if at < len(page):
        say(page[at:])
    flush()
    return blocks, paths


def _hash(path: str, text: str = "") -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}".encode()) - (1 << 63)


def _weights(page: str) -> tuple[int, int]:
    """Two numbers below 2**31 for a page."""
    h = xxhash.xxh3_64_intdigest(page.encode(), 1)
    return h & 0x7FFFFFFF, h >> 33


FRAME = _hash("the page itself")


def has_article(blocks: list[Block]) -> bool:
    return any(x.article and not x.excluded for x in blocks)


def _at_issue(blocks: list[Block]) -> list[Block]:
    """The blocks whose text the template is asked about."""
    return [x for x in blocks if not x.excluded]


def _named_around(path: str) -> str:
    """The path of the outermost `article` or `main` around a block, or the block's own."""
    parts = path.split("/")
    return next(("/".join(parts[: k + 1]) for k, x in enumerate(parts) if x.partition(".")[0] in ("article", "main")), path)


def tokens(pages: DataFrame, hints: bool = True) -> DataFrame:
    """pages: host, html.  Rows (host, token, structure, occurrences, weighted sums, place of
    the first occurrence, path) of each page that is not empty."""
    short_batches(pages.sparkSession)
    names = ["host", "token", "structure", "occurs", "sum1", "sum2", "place", "path"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, paths = parse(page or "", hints)
                if not blocks and not paths:
                    continue
                a, b = _weights(page)
                rows.append((host, FRAME, True, 1, a, b, 0, ""))
                rows += [(host, _hash(p), True, n, n * a, n * b, k + 1, p) for k, (p, n) in enumerate(paths.items())]
                texts = Counter(_hash(x.path, x.text) for x in _at_issue(blocks))
                rows += [(host, t, False, n, n * a, n * b, 0, "") for t, n in texts.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return pages.select("host", "html").mapInArrow(run, "host string, token bigint, structure boolean, occurs bigint, sum1 bigint, sum2 bigint, place bigint, path string")


def frequent(pages: DataFrame, hints: bool = True) -> DataFrame:
    """The tokens that enough of a host's pages have, with what tells their vectors apart."""
    found = tokens(pages, hints).groupBy("host", "token", "structure", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("occurs").alias("occurs"), F.sum("sum1").alias("sum1"), F.sum("sum2").alias("sum2"), F.sum("place").alias("place")
    )
    # written, so that the join deals both sides anew and a large host can be split
    found = written(found.filter(F.col("pages") >= LEAST_PAGES))
    sizes = found.filter(F.col("token") == FRAME).select("host", F.col("pages").alias("all_pages"))
    return found.join(sizes, "host").filter(F.col("pages") >= SUPPORT * F.col("all_pages"))


def _above(path: str) -> Iterator[str]:
    """The paths of the elements around a path, innermost first."""
    while path:
        path = path.rpartition("/")[0]
        yield path


def deduce(rows: list[tuple[int, bool, str, tuple, float]]) -> tuple[dict[int, tuple[int, int]], set[int]]:
    """rows: (token, structure, path, occurrence vector, place on a page) of a host's
    frequent tokens.  Returns the elements of valid classes with their class and their
    place in it, and the tokens of repeated text."""
    vector_of = {path: vector for _, structure, path, vector, _ in rows if structure}
    frame = next((v for t, _, _, v, _ in rows if t == FRAME), None)
    classes: dict[tuple, list[tuple[float, str, int]]] = defaultdict(list)
    texts: Counter = Counter()
    for token, structure, path, vector, place in rows:
        if not structure:
            texts[vector] += 1
        elif token != FRAME:
            # where the class hangs: the innermost element around it that is of another class
            hangs = next((p for p in _above(path) if p and vector_of.get(p, vector) != vector), "")
            classes[vector, hangs].append((place, path, token))
    out: dict[int, tuple[int, int]] = {}
    for number, ((vector, _), members) in enumerate(sorted(classes.items(), key=lambda x: (x[0][1], min(x[1])))):
        # the page itself and texts with the same vector are tokens of the class too
        if len(members) + texts[vector] + (vector == frame) >= LEAST_TOKENS:
            for k, (_, _, token) in enumerate(sorted(members)):
                out[token] = (number, k)
    return out, {t for t, structure, _, _, _ in rows if not structure}


def _packed(value: object) -> bytes:
    return zlib.compress(json.dumps(value, separators=(",", ":")).encode())


@functools.lru_cache(256)
def _classes(blob: bytes | None) -> tuple[dict[int, tuple[int, int, bool]], frozenset[int]]:
    elements, texts = json.loads(zlib.decompress(blob)) if blob else ([], [])
    return {t: (c, k, one) for t, c, k, one in elements}, frozenset(texts)


def classes(pages: DataFrame, hints: bool = True) -> DataFrame:
    """(host, template): elements of classes that nest, and repeated texts, for each host."""

    def run(found: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(x.token), bool(x.structure), x.path, (x.pages, x.occurs, x.sum1, x.sum2), x.place / x.pages) for x in found.itertuples()]
        elements, texts = deduce(rows)
        single = {int(x.token): bool(x.pages == x.occurs) for x in found.itertuples()}
        blob = _packed([[[t, c, k, single[t]] for t, (c, k) in sorted(elements.items())], sorted(texts)])
        return pd.DataFrame({"host": [found["host"].iloc[0]], "template": [blob]})

    return frequent(pages, hints).groupBy("host").applyInPandas(run, "host string, template binary")


def _slots(blocks: list[Block], paths: Counter, known: dict | frozenset) -> dict[str, str]:
    """For the path of each block the innermost path around it that the template has, '' for none."""
    out: dict[str, str] = {}
    for x in blocks:
        if x.path not in out:
            out[x.path] = next((p for p in (x.path, *_above(x.path)) if p in paths and _hash(p) in known), "")
    return out


def slots(pages: DataFrame, hints: bool = True) -> DataFrame:
    """pages: host, html, template.  For each host and element of a class that nests: pages
    that have it, those on which its class stands in another order, prose inside it and on
    those pages, and of the text of its own slot all and what is linked or repeated."""
    names = ["host", "token", "pages", "disordered", "inside", "whole", "own", "boiler"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0] * 6)
            for host, page, blob in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "template")), strict=True):
                known, repeated = _classes(blob)
                if not known:
                    continue
                blocks, paths = parse(page or "", hints)
                here = {p: _hash(p) for p in paths}
                last: dict[int, int] = {}
                disordered = set()
                for t in here.values():
                    if t in known:
                        c, k, _ = known[t]
                        if k < last.get(c, -1):
                            disordered.add(c)
                        last[c] = k
                blocks = _at_issue(blocks)
                slot = _slots(blocks, paths, known)
                prose: Counter = Counter()
                for x in blocks:
                    boiler = _hash(x.path, x.text) in repeated
                    if not boiler and not x.weak:
                        prose[x.path] += len(x.text) - x.linked
                    if slot[x.path]:
                        row = sums[host, here[slot[x.path]]]
                        row[4] += len(x.text)
                        row[5] += len(x.text) if boiler else x.linked
                whole = sum(prose.values())
                inside: Counter = Counter()
                for path, n in prose.items():
                    for p in (path, *_above(path)):
                        inside[p] += n
                for p, t in here.items():
                    if t in known:
                        row = sums[host, t]
                        row[0] += 1
                        row[1] += known[t][0] in disordered
                        row[2] += inside[p]
                        row[3] += whole
            if sums:
                host, token = zip(*sums, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(token, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*sums.values(), strict=True))], names)

    found = pages.select("host", "html", "template").mapInArrow(run, "host string, token bigint, pages bigint, disordered bigint, inside bigint, whole bigint, own bigint, boiler bigint")
    return found.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in names[2:]))


def templates(pages: DataFrame, hints: bool = True) -> DataFrame:
    """pages: host, html.  For each host its template, packed: repeated texts, elements of
    valid classes, of these the slots that hold an article and those that are left out."""
    first = written(classes(pages, hints))
    joined = _beside(pages, first)

    def run(found: pd.DataFrame) -> pd.DataFrame:
        known, repeated = _classes(bytes(found["template"].iloc[0]))
        off = {known[int(t)][0] for t, n, d in zip(found["token"], found["pages"], found["disordered"], strict=True) if d > DISORDER * n}
        holds, out = [], []
        for x in found.itertuples():
            c, _, single = known[int(x.token)]
            if c in off:
                continue
            if single and x.whole and x.inside >= PROSE * x.whole:
                holds.append(int(x.token))
            if x.own and x.boiler >= BOILER * x.own:
                out.append(int(x.token))
        return pd.DataFrame({"host": [found["host"].iloc[0]], "template": [_packed([sorted(repeated), sorted(t for t, (c, _, _) in known.items() if c not in off), sorted(holds), sorted(out)])], "elements": [sum(c not in off for c, _, _ in known.values())]})

    return slots(joined, hints).join(first, "host").groupBy("host").applyInPandas(run, "host string, template binary, elements int")


def _beside(pages: DataFrame, known: DataFrame) -> DataFrame:
    """pages with their host's template."""
    size = known.agg(F.sum(F.octet_length("template") + F.octet_length("host") + 64)).first()[0] or 0
    return pages.join(maybe_broadcast(known, size), "host", "left")


@functools.lru_cache(256)
def _template(blob: bytes | None) -> tuple[frozenset[int], frozenset[int], frozenset[int], frozenset[int]]:
    return tuple(map(frozenset, json.loads(zlib.decompress(blob)))) if blob else (frozenset(),) * 4


def _container(blocks: list[Block], paths: Counter, holds: frozenset[int]) -> str:
    """The path of the slot that holds the article of a page that doesn't name it."""
    known = [p for p in paths if _hash(p) in holds]
    if known:
        return max(known, key=lambda p: (p.count("/"), p))
    inside: Counter = Counter()
    for x in blocks:
        if not x.weak:
            for p in (x.path, *_above(x.path)):
                inside[p] += len(x.text) - x.linked
    return max((p for p, n in inside.items() if n and n >= PROSE * inside[""]), key=lambda p: (p.count("/"), p), default="")


def main_text(page: str, template: bytes | None = None, hints: bool = True) -> list[str]:
    """The blocks of the article."""
    repeated, elements, holds, out = _template(template)
    blocks, paths = parse(page, hints)
    left = [x for x in blocks if not x.excluded]
    slot = _slots(left, paths, elements) if out else {}
    aside = lambda x: not x.heading and slot.get(x.path, "") != "" and _hash(slot[x.path]) in out
    told = lambda x: _hash(x.path, x.text) in repeated
    box = _container([x for x in left if not aside(x) and not told(x)], paths, holds)
    if has_article(left):
        around = {p: _named_around(p) for p in {x.path for x in left if x.article}}
        met = {p: f"{a}/".startswith(f"{box}/") or box.startswith(f"{a}/") or not box for p, a in around.items()}
        if any(met.values()) or _hash(box) not in holds:
            return [x.text for x in left if x.article and not ((x.weak or not met[x.path]) and (aside(x) or x.weak and told(x)))]
    inside = [not box or x.path == box or x.path.startswith(box + "/") for x in left]
    first = inside.index(True) if True in inside else 0
    here = [x for k, x in enumerate(left) if inside[k] or k < first and x.path.rpartition("/")[2].partition(".")[0] == "h1" and not told(x)]
    here = [x for x in here if not aside(x)] or here
    same = [told(x) for x in here]
    if 2 * sum(len(x.text) for x, t in zip(here, same, strict=True) if t) > sum(len(x.text) for x in here):
        return [x.text for x in here]  # nothing much but what other pages say: copies of one article
    ours = [k for k, t in enumerate(same) if not t]
    return [x.text for k, (x, t) in enumerate(zip(here, same, strict=True)) if not t or x.heading or ours[0] < k < ours[-1]]


def extract(pages: DataFrame, hints: bool = True) -> DataFrame:
    """pages: page_id, url, html.  Adds text, the article's blocks joined by new lines."""
    short_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    own = pages.select("page_id", "url", "html", host.alias("host"))
    known = written(templates(own, hints).select("host", "template"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_text(page or "", template, hints)) for page, template in zip(*(batch.column(c).to_pylist() for c in ("html", "template")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = _beside(own, known).select(F.col("page_id").cast("long"), "url", "html", "template")
    return joined.mapInArrow(run, "page_id bigint, url string, text string")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op5_html": op5_html}
ORACLE_SQL: dict[str, str] = {}

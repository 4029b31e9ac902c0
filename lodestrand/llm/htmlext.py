"""Main text of web pages by equivalence-class template deduction.

Pages of a host are made of template and data. A page is read as tokens: its tags with their paths, and its text blocks
with path and words. Tokens with the same occurrence vector over the host's distinct pages (the same number
of times on every page) form an equivalence class; of a class that is frequent, the tokens that keep its order on a page, and
lie within one gap of the classes around them, belong to the host's template. What lies between consecutive template
tokens are the slots.

Blocks that are template tokens themselves (menus, notices, slogans repeated from page to page) are dropped, inside an
article or main element those alone that nearly every page of the host has; but never a page's only text. Of the other
slots, the one with most text is the main one; the element around it that holds most of the page's remaining text
is the main element, and its slots are kept, with the page's h1 headings. Roles of elements cut out what varies from page to page and is no main
text (sidebars, adverts, comments), and break ties: an article or main element is taken for the main one, and so is
one whose class names it so where it holds most of the text. A form that holds nearly all of a page is no form to drop.

Copies of a page count once: vectors are over distinct pages of a host. They are compared by a fingerprint that can be
combined in any order, so they are aggregated where the pages lie; a host's template is no larger than a few
pages, however many pages it has.

Defined results: null, empty and unparsable html give empty text and 0 characters; null urls are one host; broken markup
is read as browsers do, unclosed elements end with their parent; repeated rows, and copies under other
urls, have a text each and count once for the template; a host with few pages has no template; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, join_small, pieces

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?][^>]*>|([^<]+|<)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
OUT_TAGS = frozenset("nav footer aside form script style noscript template button select textarea iframe svg math head title menu dialog object canvas audio video datalist fieldset label input xmp noembed noframes".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion sidebar sidebars menu menus nav navbar navigation navigator breadcrumb breadcrumbs crumbs cookie cookies consent gdpr notice notices notification notifications banner alert popup modal overlay newsletter subscribe subscription signup signin login register social share sharing related recommended recommendations comment comments commentlist disqus respond reply replies footer foot header masthead widget widgets toolbar pagination pager paywall skip search searchform copyright legal disclaimer tagcloud".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar alertdialog".split())
IN_WORDS = frozenset("article content post entry main story".split())
#: Words of elements that are never the page itself.
REMARKS = frozenset("comment comments commentlist disqus respond reply replies menu menus nav navbar navigation footer foot".split())
BOXES = frozenset("html body div section article main td form center aside nav header footer table ul ol blockquote".split())
#: Elements that a start tag ends when one is open nearby, and the elements beyond which it doesn't look.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
_ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}


def _role(tag: str, attrs: str) -> tuple[int, bool]:
    """-1 for an element that holds no main text, 1 for one that names itself the main text, 2 for article and main, 0 else; and
    whether an element that is out may be spared if it holds the whole page."""
    if tag in OUT_TAGS:
        return -1, tag == "form"
    kind = 2 if tag in ("article", "main") else 0
    if attrs and not attrs.isspace():
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return -1, False
            if name == "role":
                if value.lower() in OUT_ROLES:
                    return -1, False
                kind = max(kind, 2 * (value.lower() in ("main", "article")))
            elif name in ("class", "id") and tag not in ("html", "body"):
                words = set(_SPLIT.split(_CAMEL.sub(" ", value).lower()))
                if words & OUT_WORDS and kind < 2:
                    return -1, not words & REMARKS
                if words & IN_WORDS:
                    kind = max(kind, 1)
    return kind, False


class Block(NamedTuple):
    """A text block: its token, main level of the elements around it, number of tags before it, the innermost container
    and the element that excludes it: -1 none, -2 one that can't be spared, else an element that may be. inner: whether
    it is excluded within that element as well."""

    text: str
    token: int
    level: int
    place: int
    box: int
    out: int
    inner: bool
    heading: bool


class Page(NamedTuple):
    blocks: list[Block]
    tags: list[int]
    boxes: list[int]  # the parent of each container
    spare: list[tuple[bool, bool]]  # of each element that may be spared: whether a form, whether it holds a heading or main element


def read(html: str) -> Page:
    """Blocks in page order, and the tags' tokens by place."""
    stack: list[tuple] = []  # tag, then the state within it
    blocks: list[Block] = []
    tags: list[int] = []
    boxes: list[int] = [-1]
    spare: list[list[bool]] = []
    parts: list[str] = []
    state = (-1, False, 0, 0, 0, False)  # out, inner, main level, path, box, h1
    out, inner, main, path, box, heading = state

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append(Block(text, _hash(f"{path}|{text}"), main, len(tags), box, out, inner, heading))

    def pop(i: int) -> None:
        nonlocal out, inner, main, path, box, heading
        del stack[i:]
        out, inner, main, path, box, heading = stack[-1][1:] if stack else state

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        if m is None:
            break
        at = m.end()
        closing, tag, attrs, text = m.groups()
        if text is not None:
            parts.append(unescape(text) if "&" in text else text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if closing:
            if tag in BLOCK or tag in OUT_TAGS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush() if any(x[0] in BLOCK for x in stack[i:]) else None
                    pop(i)
                    break
            continue
        if tag in BLOCK or tag in OUT_TAGS:
            flush()
            if tag in _ENDS_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
            if tag in CLOSES:
                ends, stop = CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in stop:
                        break
                    if stack[i][0] in ends:
                        pop(i)
                        break
        if tag in VOID:
            continue
        role, may = _role(tag, attrs)
        if tag in ("header", "hgroup") and not main:
            role, may = -1, False
        if tag in BLOCK or role:
            path = _hash(f"{path}>{tag}")
        if tag in BLOCK:
            tags.append(path)
        if tag in BOXES:
            boxes.append(box)
            box = len(boxes) - 1
        if role < 0:
            if out == -1 and may:
                spare.append([tag == "form", False])
                out = len(spare) - 1
            elif out == -1:
                out = -2
            else:
                inner = True
        if out >= 0 and not inner and (role > 0 or tag == "h1"):
            spare[out][1] = True
        main, heading = max(main, role), heading or tag == "h1"
        stack.append((tag, out, inner, main, path, box, heading))
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(html, at)
            at = end.start() if end else n
    flush()
    return Page(blocks, tags, boxes, [(a, b) for a, b in spare])


def _hash(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _tokens(page: Page) -> tuple[dict[int, int], dict[int, int]]:
    """Counts and first places of a page's tokens: its tags and its blocks."""
    count: dict[int, int] = {}
    place: dict[int, int] = {}
    for i, t in enumerate(page.tags):
        count[t] = count.get(t, 0) + 1
        place.setdefault(t, 2 * i)
    for x in page.blocks:
        count[x.token] = count.get(x.token, 0) + 1
        place.setdefault(x.token, 2 * x.place + 1)
    return count, place


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, pages, vector, places): tokens combined over the pages of a batch; token 0 counts pages."""
    for b in pieces(batches, "html"):
        seen: dict[tuple[str, int], list[int]] = {}
        for host, key, html in zip(*(b.column(c).to_pylist() for c in ("host", "key", "html"))):
            count, place = _tokens(read(html))
            count[0], place[0] = 1, 0
            for t, c in count.items():
                x = seen.setdefault((host, t), [0, 0, 0])
                x[0] += 1
                x[1] ^= _hash(f"{key}|{c}")
                x[2] += place[t]
        hosts, tokens = zip(*seen) if seen else ((), ())
        pages, vector, places = zip(*seen.values()) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array(pages, pa.int64()), pa.array(vector, pa.int64()), pa.array(places, pa.int64())], names=["host", "token", "pages", "vector", "places"])


def hosted(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host, and key, a hash of the html."""
    host = F.coalesce(F.lower(F.regexp_extract(pages["url"].cast("string"), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    return pages.select("page_id", pages["url"].cast("string").alias("url"), html.alias("html"), host.alias("host"), F.xxhash64(html).alias("key"))


def distinct_pages(src: DataFrame) -> DataFrame:
    """(host, key, html) of hosted pages, each content of a host once. Those that occur once, mostly nearly all, stay where they lie."""
    many = src.groupBy("host", "key").count().filter("count > 1").select("host", "key", F.lit(True).alias("many"))
    marked = join_small(src.select("host", "key", "html").filter("html <> ''"), many, ["host", "key"], "left")
    copies = marked.filter("many").groupBy("host", "key").agg(F.first("html").alias("html"))
    return marked.filter("many is null").select("host", "key", "html").unionByName(copies)


def templates(src: DataFrame, support: int = 4, share: float = 0.5, size: int = 2) -> DataFrame:
    """(host, template) of hosted pages: the tokens of each host's frequent equivalence classes, with class, mean place, share of pages."""
    seen = arrow_map(distinct_pages(src), _observe, "host string, token long, pages long, vector long, places long")
    # combined on both sides of the shuffle: a host with a third of all pages has no more rows than tokens
    tokens = cut(seen.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.sum("places").alias("places")).filter(F.col("pages") >= support))
    whole = tokens.filter("token = 0").select("host", F.col("pages").alias("all"))
    # a row for each host: a host's many tokens don't meet in one task
    often = join_small(tokens.filter("token <> 0"), whole, ["host"], "inner").filter(F.col("pages") >= F.col("all") * share)
    # at most 1/share times the mean number of tokens a page has
    made = F.struct((F.col("places") / F.col("pages")).alias("place"), "vector", "token", (F.col("pages") / F.col("all")).alias("share"))
    classes = often.groupBy("host", "vector").agg(F.collect_list(made).alias("t")).filter(F.size("t") >= size)
    return classes.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("t"))).alias("template"))


def _ordered(places: list[int]) -> list[int]:
    """Indices of a longest ascending run of places."""
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(ends, p)
        back[i] = at[k - 1] if k else -1
        if k == len(ends):
            ends.append(p)
            at.append(i)
        else:
            ends[k], at[k] = p, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def valid_tokens(place: dict[int, int], template: list[tuple]) -> dict[int, float]:
    """Template tokens that hold on a page, with the share of the host's pages that have them.

    template: (mean place, class, token, share), sorted. A class holds where all its tokens occur; those out of order
    don't; and a class must lie within one gap of every class around it, or apart from it.
    """
    classes: dict[int, list[tuple[int, float]]] = {}
    for _, c, t, share in template:
        classes.setdefault(c, []).append((t, share))
    spans: list[tuple[int, int, list, list]] = []
    for tokens in classes.values():
        if all(t in place for t, _ in tokens):
            here = [place[t] for t, _ in tokens]
            keep = _ordered(here)
            spans.append((here[keep[0]], here[keep[-1]], [here[i] for i in keep], [tokens[i] for i in keep]))
    spans.sort(key=lambda s: (s[0], -s[1]))
    outer: list[tuple[int, int, list]] = []
    valid: dict[int, float] = {}
    for lo, hi, here, tokens in spans:
        while outer and outer[-1][1] < lo:
            outer.pop()
        if any(hi > b or bisect_left(gaps, lo) != bisect_left(gaps, hi) for _, b, gaps in outer):
            continue
        outer.append((lo, hi, here))
        valid.update(tokens)
    return valid


def _spared(page: Page) -> int:
    """The element, if any, whose exclusion would leave out the page itself: -1 for none."""
    shown, held = 0, [0] * len(page.spare)
    for x in page.blocks:
        if x.out == -1:
            shown += len(x.text)
        elif x.out >= 0 and not x.inner:
            held[x.out] += len(x.text)
    best = max(range(len(held)), key=lambda i: held[i], default=-1)
    if best < 0 or not held[best]:
        return -1
    form, holds = page.spare[best]
    return best if (form and held[best] >= 4 * shown) or (holds and not shown) else -1


def extract(html: str, template: list[tuple] | None, separator: str = "\n\n", roles: bool = True, always: float = 0.9, most: float = 0.9) -> tuple[str, int, int]:
    """Main text, number of template tokens found valid on the page, number of slots with text.

    roles: whether roles of elements have a part; without, the deduction alone decides.
    """
    page = read(html)
    valid = valid_tokens(_tokens(page)[1], template) if template else {}
    if roles:
        spared = _spared(page) if page.spare else -1
        shown = [x for x in page.blocks if x.out == -1 or (x.out == spared and spared >= 0 and not x.inner)]
    else:
        shown = page.blocks
    data = [x for x in shown if valid.get(x.token, 0) < (always if roles and x.level == 2 else 1e-9)] if valid else shown
    data = data or shown
    # slots: blocks between which no template token lies
    slots: list[list[Block]] = []
    mark, before = None, list(accumulate((t in valid for t in page.tags), initial=0)) if valid else None
    for x in data:
        at = before[x.place] if before else 0
        if at != mark:
            slots.append([])
            mark = at
        slots[-1].append(x)
    kept = data
    if slots:
        text = lambda blocks: sum(len(x.text) for x in blocks)
        total, main = text(data), max(slots, key=text)
        named = [x for x in data if x.level == 2] if roles else []
        if named and 8 * text(named) >= text(main):
            kept = named
        elif roles and 2 * text(named := [x for x in data if x.level]) >= total:
            kept = named
        elif len(slots) > 1:
            kept = _element(page, data, main, most * total)
    return separator.join(x.text for x in kept), len(valid), len(slots)


def _element(page: Page, data: list[Block], main: list[Block], least: float) -> list[Block]:
    """The blocks of the innermost container around the main slot that holds `least` characters, and h1 headings."""
    held: dict[int, int] = {}
    for x in data:
        box = x.box
        while box >= 0:
            held[box] = held.get(box, 0) + len(x.text)
            box = page.boxes[box]
    box = main[0].box
    while box > 0 and held[box] < least:
        box = page.boxes[box]
    inside = {box}
    for i in range(box + 1, len(page.boxes)):  # parents come first
        if page.boxes[i] in inside:
            inside.add(i)
    return [x for x in data if x.box in inside or x.heading]


def main_text(pages: DataFrame, support: int = 4, share: float = 0.5, max_tokens: int = 500_000, roles: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_template, n_slots for each row of pages(page_id, url, html)."""
    kind = dict(pages.dtypes)["page_id"]
    src = hosted(pages)
    found = cut(templates(src, support, share))
    n, longest = found.agg(F.sum(F.size("template")), F.sum(F.octet_length("host"))).first()
    small = (n or 0) + (longest or 0) // 16 <= max_tokens
    read_template = lambda t: [(x["place"], x["vector"], x["token"], x["share"]) for x in t]
    schema = f"page_id {kind}, url string, text string, n_chars long, n_template long, n_slots long"

    def rows(b: pa.RecordBatch, of: Iterator) -> pa.RecordBatch:
        text, valid, slots = zip(*[extract(h, t, roles=roles) for h, t in zip(b.column("html").to_pylist(), of)])
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(valid, pa.int64()), pa.array(slots, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_template", "n_slots"])

    if small:  # of bounded size: sent once to each executor, not with every page
        known = src.sparkSession.sparkContext.broadcast({r["host"]: read_template(r["template"]) for r in found.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, "html"):
                yield rows(b, map(known.value.get, b.column("host").to_pylist()))

        return arrow_map(src.select("page_id", "url", "html", "host"), run, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            yield rows(b, (t and read_template(t) for t in b.column("template").to_pylist()))

    return arrow_map(join_small(src, found, ["host"], "left", 0).select("page_id", "url", "html", "template"), joined, schema)

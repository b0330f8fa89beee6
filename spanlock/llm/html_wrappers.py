"""Main text of web pages through wrappers: union-free regular expressions inferred per host.

A page is a stream of tokens: begins and ends of block elements, and texts (inline markup
belongs to the text). What HTML leaves out, end tags above all, is put in. The wrapper of a
host begins as one page and is aligned with the stream of the next, again and again. Tokens
that both have are matched by a longest common subsequence; a token that only one side has
is optional; a sibling that comes again in the same parent closes a square, and the siblings
from its first place on are a repeated group; a text is a slot. A wrapper keeps one branch for each kind of
token (its path of element names and plain classes): its size follows a host's templates, and grows with its pages only where they make up class names.

The wrapper decides which texts are the article:

* literals: a text that at least ``FIXED_PAGES`` pages of the host and nine in ten of those that fill the
  slot have is part of the template and not of the article. Texts are counted exactly, as
  rows of (host, slot, text), and a text must come from two unlike pages, so that copies of a page are no template.
  Inside article or main, paragraphs, headings and the like are never literals.
* menus: a repeated group outside article and main whose text is links, on all pages together, is a menu.
* inside: where a page fills slots inside main, other slots are left out, articles outside of it too (they are teasers);
  else, where it fills slots inside article, the others are.
* names: menus, headers, footers, sidebars, notices, adverts, forms and comments that say what
  they are, by element, class, id or role, are left out.

Every page takes part: tasks fold their pages into one wrapper per host, and these meet in
salted groups before they meet per host, so a host with a third of all pages is no longer
than others. What decides are sums and unions over pages, so neither their order nor their partitions change a text.

Defined cases: null html is empty and gives empty text; null and odd urls are together one
host; repeated rows are repeated pages and read alike; an empty table gives an empty result; extra
columns do not matter. Very long and very deep pages are read in one pass, without recursion; a comment, script or tag that
does not end runs to the end of the page. Ties (the same token at two places) go to the wrapper's own order.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_small, table

#: Block elements. All others, unknown ones too, are part of the text around them.
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav"
    " ol optgroup option p pre search section summary table caption colgroup tbody td tfoot th thead tr ul template svg math object select button label datalist canvas audio video".split()
)
#: Elements whose content is raw text up to their end tag, never text of the page.
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
#: Elements that end when the next one of them (or of their list) begins.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that are not the article. A header inside the article is part of it.
BOILERPLATE = frozenset("head nav footer aside dialog menu template svg math object select button label datalist canvas audio video".split())
#: Words of class, id or role of what is not the article, and words that say only where or how it is set.
NAMED = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising alert alerts banner banners breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies"
    " copyright dialog disclaimer disqus footer footers form gdpr header headers hidden login masthead menu menus modal nav navbar navigation topnav subnav sidenav bottomnav newsletter notice notices notification notifications pagination pager popup"
    " promo promos promoted promotion promotions recommended related replies reply responses search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
PLACED = frozenset("visually left right top bottom upper lower main site page global primary secondary box area container wrapper wrap block section list links link inner outer bar item items unit slot buttons icons posts articles stories panel column col row text title content group region zone space size small large mobile desktop".split())
#: As the last word of a name these say what it is whatever stands before.
ALWAYS = frozenset("footer sidebar nav navbar navigation menu breadcrumb breadcrumbs comments commentlist advert advertisement pagination newsletter".split())
#: Fixed text of this many pages, and of this share of the pages with its slot, is part of the template.
FIXED_PAGES, FIXED_SHARE = 5, 0.9
NEVER_FIXED = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption".split())
#: Part of the text of a menu that is links.
MENU_SHARE = 0.8

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?+""")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}

#: What is known of an element by its own and its ancestors' names.
NAMED_OUT, IN_FORM, INSIDE, IN_MAIN = 1, 2, 4, 8


def _says_boilerplate(name: str) -> bool:
    """Whether one class, id or role names something that is not the article.

    All its words must, besides those that only say where; or the last one is one of ``ALWAYS``.
    ``share-price`` and ``header-image-story`` do not, ``sidebar-left`` and ``site-footer`` do.
    """
    parts = [p for p in re.split(r"[-_:.]+", name) if p and not re.search(r"\d", p)]
    if not parts or parts[0] in ("has", "with", "no", "is", "js"):
        return False
    if parts[-1] in ALWAYS:
        return True
    rest = [p for p in parts if p not in PLACED]
    return bool(rest) and all(p in NAMED for p in rest)


def _names(tag: str, attributes: str) -> tuple[str, bool]:
    """The name of an element in a wrapper (its tag and plain classes), and whether it is left out by its names."""
    classes: set[str] = set()
    out = tag in BOILERPLATE
    for name, value in ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else ():
        name = name.lower()
        value = value.strip("\"'").lower()
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            out = True
        elif name in ("class", "id", "role"):
            words = value.split()
            if tag not in ("html", "body", "main", "article"):
                out = out or any(map(_says_boilerplate, words))
            if name == "class":
                classes.update(w for w in words if not re.search(r"\d", w))
    return ".".join([tag, *sorted(classes)]), out


def _id(parent: int, key: str, flags: int) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), parent) & ((1 << 62) - 1) ^ flags


@dataclass
class Stream:
    """The tokens of a page. ``order`` has each kind of token once, as first met."""

    order: list[int] = field(default_factory=list)
    #: id -> (parent, name, flags); a text slot has the name "#"
    kinds: dict[int, tuple[int, str, int]] = field(default_factory=dict)
    #: ids of tokens that come again in the same parent, with the first token of their group
    groups: dict[int, int] = field(default_factory=dict)
    #: (slot, text, characters in links, without spaces) in page order
    texts: list[tuple[int, str, int]] = field(default_factory=list)


class _Open:
    """An element that is open: its id and flags, and the kinds of its children so far."""

    __slots__ = ("tag", "id", "flags", "places", "children", "low", "high")

    def __init__(self, tag: str, id_: int, flags: int):
        self.tag, self.id, self.flags = tag, id_, flags
        self.places: dict[int, int] = {}
        self.children: list[int] = []
        self.low = self.high = -1

    def meet(self, child: int, groups: dict[int, int]) -> None:
        """A child begins: if it has been here before, all from its first place on is a repeated group."""
        at = self.places.get(child)
        if at is None:
            self.places[child] = len(self.children)
            self.children.append(child)
            return
        begin = at if self.low < 0 else min(at, self.low)
        first = self.children[begin]
        fresh = self.children[begin:] if self.low < 0 else [*self.children[begin : self.low], *self.children[self.high :]]
        for c in fresh:
            groups[c] = first
        self.low, self.high = begin, len(self.children)


def tokens(page: str) -> Stream:
    """The token stream of a page, in one pass."""
    out = Stream()
    root = _Open("", 0, 0)
    stack = [root]
    open_tags: dict[str, int] = {}
    text: list[str] = []
    link: list[str] = []  # the part of the text in links
    in_link = 0

    def meet(name: str, flags: int) -> int:
        top = stack[-1]
        id_ = _id(top.id, name, flags)
        if id_ not in out.kinds:
            out.kinds[id_] = (top.id, name, flags)
            out.order.append(id_)
        top.meet(id_, out.groups)
        return id_

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                linked = len("".join(entities.unescape("".join(link)).split())) if link else 0
                out.texts.append((meet("#", stack[-1].flags), joined, linked))
            text.clear()
            link.clear()

    def say(part: str) -> None:
        text.append(part)
        if in_link:
            link.append(part)

    def pop() -> None:
        flush()
        open_tags[stack.pop().tag] -= 1

    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            say(page[at:])
            break
        if i > at:
            say(page[at:i])
        after = page[i + 1 : i + 2]
        if after == "!" or after == "?":
            mark = "-->" if page.startswith("<!--", i) else ">"
            stop = page.find(mark, i + 2)
            if stop < 0:
                break
            at = stop + len(mark)
            continue
        if not (after.isalpha() and after.isascii()) and not (after == "/" and page[i + 2 : i + 3].isalpha() and page[i + 2 : i + 3].isascii()):
            say("<")
            at = i + 1
            continue
        m = TAG.match(page, i)
        if m is None:
            break
        at = m.end()
        tag, ending = m[2].lower(), m[1] == "/"
        if tag in RAW:
            if not ending:
                stop = RAW_END[tag].search(page, at)
                at = stop.end() if stop else n
            continue
        if tag not in BLOCK:
            if tag == "br":
                say(" ")
            elif tag == "a":
                in_link = 0 if ending else 1
            continue
        if ending:
            if open_tags.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            else:
                flush()
            continue
        if tag == "hr":  # it has no content
            flush()
            continue
        if tag in ENDS_P and stack[-1].tag == "p":
            pop()
        while stack[-1].tag in CLOSES.get(tag, ()):
            pop()
        flush()
        name, left_out = _names(tag, m[3])
        flags = stack[-1].flags
        if tag in ("article", "main") and not flags & NAMED_OUT:
            flags = INSIDE | (IN_MAIN if tag == "main" else flags & IN_MAIN)  # also where a form is around the whole page
        if tag == "header" and not flags & INSIDE:
            left_out = True
        if tag == "form":
            flags |= IN_FORM
        if left_out:
            flags |= NAMED_OUT
        stack.append(_Open(tag, meet(name, flags), flags))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return out


# A wrapper is {"order": [id], "kinds": {id: [parent, name, flags, pages, chars, link chars, group or 0]}, "pages": n},
# where order is that of the regular expression and a group is named by its first token.


def wrapper_of(stream: Stream) -> dict:
    """The wrapper that stands for one page."""
    kinds = {i: [*stream.kinds[i], 1, 0, 0, stream.groups.get(i, 0)] for i in stream.order}
    for slot, text, linked in stream.texts:
        kinds[slot][4] += len(text) - text.count(" ")
        kinds[slot][5] += linked
    return {"order": stream.order, "kinds": kinds, "pages": 1}


def _common(places: list[int]) -> list[int]:
    """Indices of a longest increasing part of ``places``: the longest common subsequence of two orders."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
            ends.append(i)
        else:
            tails[k], ends[k] = p, i
        before[i] = ends[k - 1] if k else -1
    out: list[int] = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: dict, b: dict) -> dict:
    """The wrapper of everything that a and b stand for. ``a`` may be changed."""
    mine, yours = a["kinds"], b["kinds"]
    if a["order"] != b["order"]:
        place = {t: i for i, t in enumerate(a["order"])}
        both = [t for t in b["order"] if t in place]
        anchors = {both[i] for i in _common([place[t] for t in both])}
        order: list[int] = []
        alone: list[int] = []
        i = 0
        for t in b["order"]:
            if t in anchors:  # what only one side has before the anchor is optional
                order += [*a["order"][i : place[t]], *alone, t]
                i = place[t] + 1
                alone = []
            elif t not in place:
                alone.append(t)
        a["order"] = [*order, *a["order"][i:], *alone]
    for t, k in yours.items():
        m = mine.get(t)
        if m is None:
            mine[t] = k
        else:
            m[3] += k[3]
            m[4] += k[4]
            m[5] += k[5]
            m[6] = m[6] or k[6]
    a["pages"] += b["pages"]
    return a


def expression(w: dict, literals: dict[int, list[str]] | None = None) -> str:
    """The wrapper as a regular expression over tags and text slots, with ``?`` and ``+`` for optional and repeated groups."""
    children: dict[int, list[int]] = {}
    for t in w["order"]:
        children.setdefault(w["kinds"][t][0], []).append(t)

    parts: list[str] = []
    todo: list = [(0, w["pages"])]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            parts.append(at)
            continue
        inner: list = []
        group = 0
        for t in children.get(at[0], ()):
            _, name, _, pages, _, _, g = w["kinds"][t]
            if group and g != group:
                inner.append(")+ ")
            if g and g != group:
                inner.append("(")
            group = g
            body: list = ["|".join(map(repr, (literals or {}).get(t, []))) or "#text"] if name == "#" else [f"<{name}> ", (t, pages), f"</{name}>"]
            inner += ["(", *body, ")? "] if pages < at[1] else [*body, " "]
        if group:
            inner.append(")+ ")
        todo += reversed(inner)
    return "".join(parts).strip()


def _digest(slot: int, text: str) -> int:
    """The signed digest of a text in a slot; never 0."""
    return (xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), slot) >> 1) or 1


def _may_be_fixed(kind: tuple[int, str, int], parent: str) -> bool:
    return not kind[2] & (NAMED_OUT | IN_FORM) and not (kind[2] & INSIDE and parent.split(".")[0] in NEVER_FIXED)


PARTS = "host string, wrapper string, slot long, digest long, pages long, one long, other long"


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host that a task sees, and counts of the texts of its slots.

    A count row has a slot, the digest of a text (0: any text), the number of pages with it, and
    the smallest and largest digest of those pages. All are handed on when there are many.
    """
    held: dict[str, dict] = {}
    counts: dict[tuple[str, int, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, json.dumps(w), None, None, None, None, None) for h, w in sorted(held.items())]
        rows += [(h, None, slot, digest, *c) for (h, slot, digest), c in counts.items()]
        held.clear()
        counts.clear()
        kinds = (pa.string(), pa.string(), *[pa.int64()] * 5)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["host", "wrapper", "slot", "digest", "pages", "one", "other"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            stream = tokens(page.as_py())
            w = wrapper_of(stream)
            held[host] = align(held[host], w) if host in held else w
            whole = xxhash.xxh64_intdigest("\0".join(t for _, t, _ in stream.texts).encode("utf-8", "surrogatepass")) >> 1
            seen = set()
            for slot, text, _ in stream.texts:
                kind = stream.kinds[slot]
                parent = stream.kinds[kind[0]][1] if kind[0] else ""
                if _may_be_fixed(kind, parent):
                    seen |= {(host, slot, 0), (host, slot, _digest(slot, text))}
            for key in seen:
                c = counts.setdefault(key, [0, whole, whole])
                c[0] += 1
                c[1], c[2] = min(c[1], whole), max(c[2], whole)
            if len(held) >= 1000 or len(counts) >= 200_000:
                yield out()
    if held:
        yield out()


def load(text: str) -> dict:
    w = json.loads(text)
    return {**w, "kinds": {int(t): k for t, k in w["kinds"].items()}}


def _merge(pdf):
    wrappers = [load(x) for x in sorted(pdf["wrapper"])]
    out = wrappers[0]
    for w in wrappers[1:]:
        out = align(out, w)
    return json.dumps(out)


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def infer_wrappers(pages: DataFrame, salts: int = 32) -> DataFrame:
    """(host, wrapper, literals): the wrapper of every host from all its pages, as JSON, and the digests of its fixed texts."""
    import pandas as pd

    def some(key, pdf):
        return pd.DataFrame({"host": [key[0]], "wrapper": [_merge(pdf)]})

    rows = pages.select(_host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    parts = cut(rows.mapInArrow(_fold_pages, PARTS))
    salted = parts.where("wrapper is not null").select("host", "wrapper", F.pmod(F.xxhash64("wrapper"), F.lit(salts)).alias("salt"))
    wrappers = salted.groupBy("host", "salt").applyInPandas(some, "host string, wrapper string")
    wrappers = wrappers.groupBy("host").applyInPandas(some, "host string, wrapper string")
    counts = parts.where("slot is not null").groupBy("host", "slot", "digest").agg(F.sum("pages").alias("pages"), F.min("one").alias("one"), F.max("other").alias("other")).where(F.col("pages") >= FIXED_PAGES)
    counts = cut(counts)
    often = counts.where("digest <> 0 and one <> other").select("host", "slot", "digest", "pages")
    of = counts.where("digest = 0").select("host", "slot", F.col("pages").alias("filled"))
    fixed = join_small(often, of, ["host", "slot"]).where(F.col("pages") >= F.col("filled") * FIXED_SHARE)
    literals = fixed.groupBy("host").agg(F.sort_array(F.collect_list("digest")).alias("literals"))  # a template's fixed texts
    return wrappers.join(literals, "host", "left").withColumn("literals", F.coalesce("literals", F.array().cast("array<long>")))


def menus(w: dict) -> list[int]:
    """Slots of repeated groups outside article and main whose text is links; the order in which pages were aligned does not matter."""
    kinds = w["kinds"]
    repeated: dict[int, bool] = {0: False}
    for t in kinds:
        path = []
        while t not in repeated:
            path.append(t)
            t = kinds[t][0]
        for t in reversed(path):  # from the top down: what is in a repeated group is repeated
            repeated[t] = bool(kinds[t][6]) or repeated[kinds[t][0]]
    out = (t for t, (_, name, flags, _, chars, linked, _) in kinds.items() if name == "#" and repeated[t] and not flags & INSIDE and chars and linked >= MENU_SHARE * chars)
    return sorted(out)


def article(page: str, links: frozenset[int], literals: frozenset[int]) -> str:
    """The article of a page, read with the menus and literals of a wrapper."""
    main, inside, outside = [], [], []
    for slot, text, _ in (stream := tokens(page)).texts:
        flags = stream.kinds[slot][2]
        if flags & (NAMED_OUT | IN_FORM) or slot in links or _digest(slot, text) in literals:
            continue
        (main if flags & IN_MAIN else inside if flags & INSIDE else outside).append(text)
    return " ".join(main or inside or outside)


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(page_id, url, text): the article of every page, read with the wrapper of its host."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [menus(load(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(links, pa.list_(pa.int64())), batch.column(2)], names=["host", "links", "literals"])

    chosen = cut(wrappers.select("host", "wrapper", "literals").mapInArrow(pick, "host string, links array<long>, literals array<long>"))
    chosen = chosen.where(F.size("links") + F.size("literals") > 0)  # other hosts have nothing to leave out
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"))
    rows = join_small(rows, chosen, ["host"], "left", weight=1 + F.size("links") + F.size("literals")).select("page_id", "url", "html", "links", "literals")
    schema = rows.select("page_id", "url").schema.add("text", "string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, links, literals in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                out.append(article(page.as_py(), frozenset(links or ()), frozenset(literals or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(read, schema)


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = extract(pages, infer_wrappers(pages))
    return rows.withColumn("n_chars", F.length("text").cast("long"))

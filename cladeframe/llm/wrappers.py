"""Main text of web pages by wrappers inferred from all pages of a host.

A wrapper is a union-free regular expression over the blocks of a page (`markup`): a sequence of
blocks and text slots, each once, optional or repeated, and repeated groups of optional ones.
It is inferred by aligning pages of a host one after another. Blocks that stand side by side
under one label are matched as one repeated block; where the streams do not match, what only one
of them has becomes optional, and blocks that return in changing order become a repeated group.
Text that meets text becomes a slot. A group holds each label once, so wrappers stay as small as
the template, whatever the number of pages.

Pages are folded to their own shapes first, and shapes are counted with what their slots held:
least and greatest hash of a text, characters, characters in links. A wrapper adds those up, so
a slot knows whether its text changes from page to page. Shapes of a host are aligned in shares of
bounded size, their wrappers again in shares, and so on until there is one, always in an order
that the shapes set, so a result does not depend on partitions.

What a slot is: boilerplate, if a block above it is a menu, header, footer, sidebar, form, control
or notice by its tag, role or class, or holds reader comments (an article within an article too);
else article text inside `article`; else inside `main` or a block named as content; else text that
is not mostly links and differs between pages. A page shows its own best kind of these.

Defined results: null html is empty and gives an empty text; pages without a host (null or odd
urls) are one host; broken markup is read as browsers do, references without a semicolon as well.
Rows are taken as they are, repeated page_ids too. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..operators.staging import derived, stage
from .markup import TEXT, Block, parse, plain

GROUP = "*"
# Shapes, or wrappers of shares, that one task aligns at a time.
SHARE = 512
# Blocks of one label, not side by side, from which on they are a repeated group.
MOST_APART = 4
# Cells of an alignment; longer mismatches become a repeated group.
MOST_CELLS = 60_000
# Shapes that a task counts before it hands them on.
MOST_SHAPES = 4096
# Share of link text that makes a slot a list of links, and pages that prove a text fixed.
LINK_SHARE, FIXED_PAGES = 0.5, 3

# Tags of running text, whose order changes from page to page.
FLOW = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table tr td th address details summary".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Tags, roles and parts of class names of what is not the article.
APART_TAGS = set(
    "nav header footer aside form menu dialog head button select svg math object canvas audio video template "
    "noscript datalist fieldset".split()
)
APART_ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist "
    "tooltip status comment".split()
)
APART_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay nav navbar navigation menu menus "
    "submenu breadcrumb breadcrumbs sidebar sidebars footer header masthead topbar toolbar comment comments commentlist "
    "disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe signup "
    "login search widget widgets pagination pager disclaimer copyright legal tags skip".split()
)
MAIN_ROLES = {"main", "articlebody", "article"}
MAIN_WORDS = set("article articlebody post entry story content main maincontent".split())
# Kinds of slots, best first; the rest are never shown.
ARTICLE, MAIN, OTHER, APART = range(4)


class Part:
    """A term of a wrapper: a block, a text slot `#` or a group `*`; least 0 makes it optional,
    many repeated. `seen` is (pages, least hash, greatest hash, characters, in links) of a slot."""

    __slots__ = ("label", "kids", "least", "many", "seen", "runs")

    def __init__(self, label, kids=(), least=1, many=False, seen=None, runs=()):
        self.label, self.kids, self.least, self.many = label, list(kids), least, many
        self.seen, self.runs = seen, list(runs)

    def outline(self) -> tuple:
        """Labels and marks, without what slots held."""
        return (self.label, self.least, self.many, *(k.outline() for k in self.kids))

    def labels(self) -> set[str]:
        return {k.label for k in self.kids}

    def slots(self) -> Iterator[Part]:
        """Its text slots in order."""
        if self.label == TEXT:
            yield self
        for kid in self.kids:
            yield from kid.slots()

    def to_list(self) -> list:
        marks = (0 if self.least else 1) + (2 if self.many else 0)
        return [self.label, marks, self.seen, *(k.to_list() for k in self.kids)]

    @staticmethod
    def of(listed: list) -> Part:
        label, marks, seen, *kids = listed
        return Part(label, map(Part.of, kids), 0 if marks & 1 else 1, bool(marks & 2), seen)


def _added(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return a if b is None else b
    return [a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3], a[4] + b[4]]


def united(a: Part, b: Part, side_by_side: bool = False) -> Part:
    """One term that matches what either does; of neighbours, a repeated one."""
    return Part(
        a.label,
        tidy(align(a.kids, b.kids)) if a.label != GROUP else _grouped(a.kids + b.kids),
        max(a.least, b.least) if side_by_side else min(a.least, b.least),
        side_by_side or a.many or b.many,
        _added(a.seen, b.seen),
        a.runs + b.runs,
    )


def _grouped(parts: list[Part]) -> list[Part]:
    """The terms of a repeated group: every label once, optional, in order of appearance."""
    out: dict[str, Part] = {}
    for part in parts:
        for p in part.kids if part.label == GROUP else [part]:
            held = out.get(p.label)
            out[p.label] = p if held is None else united(held, p, True)
    return [Part(p.label, p.kids, 0, p.many, p.seen, p.runs) for p in out.values()]


def _group(parts: list[Part]) -> Part:
    return Part(GROUP, _grouped(parts), max(p.least for p in parts), True)


def _absorbed(parts: list[Part], groups: list[Part]) -> list[Part]:
    """Terms that a group of the other stream stands for, from the first to the last, as a group."""
    for group in groups:
        labels = group.labels()
        at = [i for i, p in enumerate(parts) if p.label in labels or (p.label == GROUP and p.labels() & labels)]
        if at:
            a, b = at[0], at[-1] + 1
            parts = [*parts[:a], _group(parts[a:b]), *parts[b:]]
    return parts


def _alike(a: Part, b: Part) -> float:
    """How well two terms of one label match: 1, and up to 1 more for equal content."""
    x, y = a.labels(), b.labels()
    return 1 + (len(x & y) / len(x | y) if x or y else 1)


def pairs(x: list[Part], y: list[Part]) -> list[tuple[int, int]]:
    """The best alignment of two streams: places of terms that match, in order."""
    if [p.label for p in x] == [p.label for p in y]:
        return [(i, i) for i in range(len(x))]
    best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(y) - 1, -1, -1):
            top = max(below[j], row[j + 1])
            if x[i].label == y[j].label:
                top = max(top, below[j + 1] + _alike(x[i], y[j]))
            row[j] = top
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i].label == y[j].label and best[i][j] == best[i + 1][j + 1] + _alike(x[i], y[j]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def align(x: list[Part], y: list[Part]) -> list[Part]:
    """One stream that matches both: what matches united, what only one has optional."""
    if not x or not y:
        return [Part(p.label, p.kids, 0, p.many, p.seen, p.runs) for p in x or y]
    x, y = _absorbed(x, [p for p in y if p.label == GROUP]), _absorbed(y, [p for p in x if p.label == GROUP])
    if len(x) * len(y) > MOST_CELLS:
        return [_group(x + y)]
    out: list[Part] = []
    i = j = 0
    for a, b in [*pairs(x, y), (len(x), len(y))]:
        out += [Part(p.label, p.kids, 0, p.many, p.seen, p.runs) for p in x[i:a] + y[j:b]]
        if a < len(x):
            out.append(united(x[a], y[b]))
        i, j = a + 1, b + 1
    return out


def tidy(parts: list[Part]) -> list[Part]:
    """Repeats found: neighbours of one label as one repeated term, returning ones as a group."""
    out: list[Part] = []
    for part in parts:
        if out and out[-1].label == part.label and _repeats(out[-1], part):
            out[-1] = united(out[-1], part, True)
        else:
            out.append(part)
    places: dict[str, list[int]] = {}
    in_group: set[str] = set()
    for i, p in enumerate(out):
        for label in (GROUP, *p.labels()) if p.label == GROUP else (p.label,):
            places.setdefault(label, []).append(i)
        if p.label == GROUP:
            in_group |= p.labels()
    spans = []
    for label, at in places.items():
        # What a group holds stands nowhere else, so that a page's block meets one term only.
        once = label in (TEXT, GROUP) or label in in_group or _tag(label) in FLOW
        if len(at) > (1 if once else MOST_APART):
            spans.append((at[0], at[-1] + 1))
    if not spans:
        return out
    # Spans that overlap are one group; what it holds returns in any order.
    spans.sort()
    a, b = spans[0]
    for c, d in spans[1:]:
        if c < b:
            b = max(b, d)
    return tidy([*out[:a], _group(out[a:b]), *out[b:]])


def _repeats(a: Part, b: Part) -> bool:
    """Are neighbours of one label the same block again? Unnamed containers only with equal content."""
    tag = _tag(a.label)
    if a.label in (TEXT, GROUP) or tag in FLOW:
        return True
    x, y = a.labels(), b.labels()
    if tag != a.label:
        return x == y or len(x & y) * 2 > len(x | y)
    return [k.outline() for k in a.kids] == [k.outline() for k in b.kids]


def _tag(label: str) -> str:
    for i, c in enumerate(label):
        if c in ".#@" and i:
            return label[:i]
    return label


def fold(block: Block) -> Part:
    """A page's own wrapper."""
    if block.label == TEXT:
        return Part(TEXT, runs=block.runs)
    return Part(block.label, tidy([fold(k) for k in block.kids]))


def _said(label: str) -> tuple[str, set[str], set[str]]:
    """Tag, roles and words of class names and id."""
    tag = _tag(label)
    rest = label[len(tag) :]
    for mark in ".#@":
        rest = rest.replace(mark, f" {mark}")
    marks = rest.split()
    roles = {m[1:] for m in marks if m[0] == "@"}
    words = {w for m in marks if m[0] != "@" for w in (m[1:], *m[1:].replace("_", "-").split("-"))}
    return tag, roles, words


def kinds(wrapper: Part) -> dict[int, int]:
    """What each text slot of a wrapper is, by the slot's identity."""
    out: dict[int, int] = {}
    seen = [s.seen for s in wrapper.slots() if s.seen]
    changing = any(s[1] != s[2] for s in seen)

    def walk(part: Part, kind: int) -> None:
        if part.label == TEXT:
            if kind in (MAIN, OTHER) and part.seen:
                pages, low, high, chars, links = part.seen
                if (changing and low == high and pages >= FIXED_PAGES) or links > LINK_SHARE * chars:
                    kind = APART
            out[id(part)] = kind
            return
        if part.label != GROUP:
            tag, roles, words = _said(part.label)
            if kind != APART:
                if tag == "header" and kind in (ARTICLE, MAIN):
                    for kid in part.kids:
                        walk(kid, kind if kid.label == GROUP or _tag(kid.label) in HEADINGS else APART)
                    return
                named = words & APART_WORDS if tag not in ("main", "page") else set()
                if tag in APART_TAGS or roles & APART_ROLES or named or (tag == "article" and kind == ARTICLE):
                    kind = APART
                elif tag == "article" or kind == ARTICLE:
                    kind = ARTICLE
                elif tag == "main" or roles & MAIN_ROLES or words & MAIN_WORDS:
                    kind = MAIN
        for kid in part.kids:
            walk(kid, kind)

    walk(wrapper, OTHER)
    return out


def matched(page: Part, wrapper: Part, found: dict[int, Part]) -> None:
    """Which slot of the wrapper each text slot of a folded page meets.

    A block that the best alignment leaves over meets the term of its label that is most like it.
    """
    if page.label == TEXT:
        found[id(page)] = wrapper
        return
    terms = wrapper.kids
    own = _held(page.kids, [p for p in terms if p.label == GROUP])
    met = dict(pairs(own, terms))
    inner = {k.label: k for t in terms if t.label == GROUP for k in t.kids}
    for i, part in enumerate(own):
        if part.label == GROUP:
            within = {k.label: k for k in terms[met[i]].kids} if i in met else inner
            for kid in part.kids:
                term = within.get(kid.label) or _most_alike(kid, terms)
                if term is not None:
                    matched(kid, term, found)
        else:
            term = terms[met[i]] if i in met else _most_alike(part, terms) or inner.get(part.label)
            if term is not None:
                matched(part, term, found)


def _most_alike(part: Part, terms: list[Part]) -> Part | None:
    same = [t for t in terms if t.label == part.label]
    return max(same, key=lambda t: _alike(part, t), default=None)


def _held(parts: list[Part], groups: list[Part]) -> list[Part]:
    """Like `_absorbed`, but terms stay the page's own."""
    for group in groups:
        labels = group.labels()
        at = [i for i, p in enumerate(parts) if p.label in labels or (p.label == GROUP and p.labels() & labels)]
        if at:
            a, b = at[0], at[-1] + 1
            inside = [k for p in parts[a:b] for k in (p.kids if p.label == GROUP else [p])]
            parts = [*parts[:a], Part(GROUP, inside, 1, True), *parts[b:]]
    return parts


def host_of(url: Column) -> Column:
    """The host of an absolute url in small letters; empty if there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return found


def _shape(html: str) -> tuple[str, Part, list[list[str]], list[int]]:
    tree, runs, linked = parse(html)
    page = fold(tree)
    return _dumped(page), page, runs, linked


def _shapes(pages: DataFrame) -> DataFrame:
    """Counted shapes: host, shape, slot, and what the slot held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[list]] = {}

        def given() -> pa.RecordBatch:
            rows = [(h, s, i, *v) for (h, s), slots in held.items() for i, v in enumerate(slots, -1)]
            columns = list(zip(*rows, strict=True))
            kinds_ = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_, strict=True)], names)

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shape, page, runs, linked = _shape(html)
                slots = held.get((host, shape))
                own = [[1, 0, 0, 0, 0]]
                for slot in page.slots():
                    seen = None
                    for r in slot.runs:
                        text = "".join(runs[r])
                        code = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                        seen = _added(seen, [1, code, code, len(text), linked[r]])
                    own.append(seen)
                held[host, shape] = own if slots is None else [_added(a, b) for a, b in zip(slots, own, strict=True)]
            if len(held) >= MOST_SHAPES:
                yield given()
                held.clear()
        if held:
            yield given()

    names = ["host", "shape", "slot", "pages", "low", "high", "chars", "links"]
    schema = "host string, shape string, slot int, pages long, low long, high long, chars long, links long"
    counted = pages.select("host", "html").mapInArrow(run, schema)
    return counted.groupBy("host", "shape", "slot").agg(
        F.sum("pages").alias("pages"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("chars").alias("chars"),
        F.sum("links").alias("links"),
    )


def _dumped(part: Part) -> str:
    return json.dumps(part.to_list(), separators=(",", ":"))


def infer(pages: DataFrame, share: int = SHARE) -> DataFrame:
    """One wrapper per host, from columns host and html: host, wrapper."""
    slots = F.sort_array(F.collect_list(F.struct("slot", "pages", "low", "high", "chars", "links")))
    shapes = stage(_shapes(pages).groupBy("host", "shape").agg(slots.alias("slots")))
    most = shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 0

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Shapes as wrappers that know what their slots held."""
        for frame in batches:
            wrappers, counts = [], []
            for shape, seen in zip(frame["shape"], frame["slots"], strict=True):
                part = Part.of(json.loads(shape))
                for slot, held in zip(part.slots(), seen[1:], strict=True):
                    slot.seen = [int(held[c]) for c in ("pages", "low", "high", "chars", "links")]
                wrappers.append(_dumped(part))
                counts.append(int(seen[0]["pages"]))
            yield pd.DataFrame({"host": frame["host"], "pages": counts, "tie": frame["shape"], "wrapper": wrappers})

    def aligned(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pages", "tie"], ascending=[False, True])
        whole = None
        for text in frame["wrapper"]:
            part = Part.of(json.loads(text))
            whole = part if whole is None else united(whole, part)
        first = frame.iloc[0]
        return pd.DataFrame(
            {"host": [first["host"]], "pages": [frame["pages"].sum()], "tie": [first["tie"]], "wrapper": [_dumped(whole)]}
        )

    schema = "host string, pages long, tie string, wrapper string"
    state = shapes.mapInPandas(weighed, schema)
    while True:
        most = -(-most // share)
        dealt = F.pmod(F.xxhash64("tie"), F.lit(max(1, most))).cast("int").alias("dealt")
        state = state.groupBy("host", dealt).applyInPandas(aligned, schema)
        if most <= 1:
            return state.select("host", "wrapper")


@lru_cache(maxsize=256)
def _wrapper(text: str) -> tuple[Part, dict[int, int]]:
    part = Part.of(json.loads(text))
    return part, kinds(part)


@lru_cache(maxsize=4096)
def _read_off(wrapper: str, shape: str) -> list[int]:
    """The kind of each text slot of a shape, in order."""
    whole, kind = _wrapper(wrapper)
    page = Part.of(json.loads(shape))
    found: dict[int, Part] = {}
    matched(page, whole, found)
    own = kinds(page)
    return [kind[id(found[id(s)])] if id(s) in found else own[id(s)] for s in page.slots()]


def main_text(html: str, wrapper: str | None = None) -> str:
    """The page's main text, blocks joined by line ends; without a wrapper by its own shape."""
    shape, page, runs, _ = _shape(html)
    read = _read_off(shape if wrapper is None else wrapper, shape)
    best = min((k for k in read if k != APART), default=APART)
    if best == APART:
        return ""
    shown = sorted(r for kind, slot in zip(read, page.slots(), strict=True) if kind == best for r in slot.runs)
    return "\n".join(t for t in (plain(runs[r]) for r in shown) if t)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points)."""
    hosted = pages.select(
        "page_id",
        "url",
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        host_of(F.col("url").cast("string")).alias("host"),
    )
    wrappers = stage(infer(hosted))
    named = derived(wrappers.withColumnRenamed("host", "_host"), wrappers)
    beside = lookup(hosted, named, "host", "_host", staged=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(h, w) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds_ = {f.name: f.dataType.simpleString() for f in hosted.schema.fields}
    schema = f"page_id {kinds_['page_id']}, url {kinds_['url']}, text string, n_chars long"
    return beside.select("page_id", "url", "html", "wrapper").mapInArrow(run, schema)

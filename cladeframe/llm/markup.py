"""Token streams of HTML pages: a tree of labelled blocks and runs of text.

Tags of a line of text (links, emphasis, line breaks) and those that may be left out of a page
make no block; every other tag does. A block's label is its tag with its classes, id and role.
What is never shown (comments, scripts, styles, the title) is left out whole.
"""

from __future__ import annotations

import html as entities
import re

# Tags whose content is no markup and is not shown as text.
HIDDEN = "script style title textarea iframe noembed noframes".split()
# Tags without content, and tags inside a line of text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
# Tags that are there whether a page has them or not.
IMPLIED = {"html", "head", "body"}
# Tags that an unclosed tag of the first kind ends before.
CLOSED_BY = {
    "p": set(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
        "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
    ),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "thead", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"},
    "option": {"option", "optgroup"},
}
# Within these an unclosed tag outside is not ended.
_FENCES = {"table", "ul", "ol", "dl", "td", "th"}
FENCES = {tag: _FENCES - {tag} for tag in CLOSED_BY}
ENDS = {e: [tag for tag, enders in CLOSED_BY.items() if e in enders] for e in set().union(*CLOSED_BY.values())}
# Blocks deeper than this add no level of their own; their text stays.
DEEPEST = 60
TEXT = "#"

_ATTRIBUTES = r"""(?:"[^"<]*+"|'[^'<]*+'|[^>"'])*+"""
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    rf"|<({'|'.join(HIDDEN)})(?=[\s/>])(?:{_ATTRIBUTES}|[^>]*+)(?:>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES}|[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PLAIN = re.compile(r"[^a-z_-]+")


class Block:
    """A block or, with the label `#`, a run of text; `runs` numbers the page's runs it stands for."""

    __slots__ = ("label", "kids", "runs")

    def __init__(self, label: str, kids: list[Block] | None = None, runs: list[int] | None = None):
        self.label, self.kids, self.runs = label, [] if kids is None else kids, [] if runs is None else runs


def label_of(tag: str, attributes: str) -> str:
    """Tag, then `.class` for each class, `#id` and `@role`; digits and signs are left out."""
    if "=" not in attributes:
        return tag
    parts = {"class": [], "id": [], "role": []}
    for name, *values in _NAMED.findall(attributes):
        words = "".join(values).lower().split()
        kind = "role" if name.lower() == "itemprop" else name.lower()
        parts[kind] += [w for w in (_PLAIN.sub("", w) for w in words) if w]
    marks = (("class", "."), ("id", "#"), ("role", "@"))
    return tag + "".join(f"{mark}{w}" for name, mark in marks for w in sorted(set(parts[name])))


def parse(html: str) -> tuple[Block, list[list[str]], list[int]]:
    """The page's tree, the pieces of text of each run, and how many characters of it are links."""
    root = Block("page")
    stack, tags = [root], ["page"]
    runs: list[list[str]] = []
    linked: list[int] = []
    open_run = -1
    links = 0
    skipped = 0
    at = 0

    def add(text: str) -> None:
        nonlocal open_run
        if open_run < 0:
            if not text.strip():
                return
            open_run = len(runs)
            runs.append([])
            linked.append(0)
            stack[-1].kids.append(Block(TEXT, runs=[open_run]))
        runs[open_run].append(text)
        if links:
            linked[open_run] += len(text)

    def close(tag: str, inside: set[str]) -> bool:
        """End the innermost open `tag`, if no fence is in between."""
        nonlocal open_run
        for i in range(len(tags) - 1, 0, -1):
            if tags[i] == tag:
                del stack[i:], tags[i:]
                open_run = -1
                return True
            if tags[i] in inside:
                return False
        return False

    for token in TOKEN.finditer(html):
        if token.start() > at:
            add(html[at : token.start()])
        at = token.end()
        tag = token.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if token.group(2) else 1
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                if open_run >= 0:
                    runs[open_run].append(" ")
                if tag == "hr":
                    close("p", FENCES["p"])
                    open_run = -1
            continue
        open_run = -1
        links = 0
        if tag in IMPLIED:
            continue
        if token.group(2):
            if skipped and tag not in tags:
                skipped -= 1
            else:
                close(tag, {"table"} if tag in ("p", "li", "dt", "dd", "div", "section") else set())
            continue
        for unclosed in ENDS.get(tag, ()):
            close(unclosed, FENCES[unclosed])
        if len(stack) >= DEEPEST:
            skipped += 1
            continue
        block = Block(label_of(tag, token.group(4)))
        stack[-1].kids.append(block)
        stack.append(block)
        tags.append(tag)
    if at < len(html):
        add(html[at:])
    return root, runs, linked


def plain(pieces: list[str]) -> str:
    """A run's text: character references decoded, white space made one blank, trimmed."""
    decoded = "".join(entities.unescape(p) if "&" in p else p for p in pieces)
    return " ".join(decoded.split())

"""Cutting pages into leaf blocks, and what a block looks like to a model."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Tags that begin and end a block of text, tags without content, tags whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template svg annotation annotation-xml head title iframe object".split())
RAW_TAGS = frozenset("script style textarea title".split())
HEAD_TAGS = frozenset("html head base link meta noscript script style template title".split())
#: An opening tag on the left ends an open element on the right.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {
    t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()
}
#: An open element on the right is not looked for beyond one of these.
SCOPE = frozenset("article aside body div footer form header main nav section table td ul ol dl".split())

_OPEN = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'][^\s=/]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|\S*))?")
_MARKING = frozenset("class id role itemprop".split())
_WORDS = re.compile(r"[a-z]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    """Text of one leaf of the DOM; own, parent: its innermost block tags; tags: all of them above it; marks: words of the
    classes, ids and roles above it; linked: characters inside links. Neighbours share tags and marks."""

    text: str
    own: str
    parent: str
    tags: frozenset[str]
    marks: frozenset[str]
    linked: int


def _attributes(tag: str, raw: str) -> tuple[tuple[str, ...], bool]:
    marks, hidden = [], tag in HIDDEN_TAGS
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").strip().lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _INVISIBLE.search(value)):
            hidden = True
        elif name in _MARKING:
            marks += _WORDS.findall(value)
    return tuple(marks), hidden


class _Bag:
    """What stands above the present place, counted; the set of it is made anew only when it changes."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self.made: frozenset[str] | None = frozenset()

    def add(self, x: str, n: int) -> None:
        had = self.counts.get(x, 0)
        self.counts[x] = had + n
        if not had + n:
            del self.counts[x]
        if not had or not had + n:
            self.made = None

    def all(self) -> frozenset[str]:
        if self.made is None:
            self.made = frozenset(self.counts)
        return self.made


class _Open:
    """The open elements, with what blocks need to know of them."""

    def __init__(self, known: frozenset[str] | None) -> None:
        self.stack: list[tuple[str, tuple[str, ...], bool]] = []
        self.places: dict[str, list[int]] = {}
        self.outer: list[str] = []
        self.tags, self.marks = _Bag(), _Bag()
        self.hidden, self.known = 0, known

    def push(self, tag: str, marks: tuple[str, ...], hidden: bool) -> None:
        marks = marks if self.known is None else tuple(m for m in marks if m in self.known)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, marks, hidden))
        self.hidden += hidden
        for m in marks:
            self.marks.add(m, 1)
        if tag in BLOCK_TAGS and tag not in ("html", "body"):
            self.outer.append(tag)
            self.tags.add(tag, 1)

    def pop(self) -> str:
        tag, marks, hidden = self.stack.pop()
        self.places[tag].pop()
        self.hidden -= hidden
        for m in marks:
            self.marks.add(m, -1)
        if tag in BLOCK_TAGS and tag not in ("html", "body"):
            self.outer.pop()
            self.tags.add(tag, -1)
        return tag

    def last(self, tags: frozenset[str] | set[str]) -> int:
        """Where the innermost of these tags stands, -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)


def blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """The page's blocks in order, white space folded. Of marks only `known` ones are kept, if given.

    What stands in a hidden element is left out wherever it stands, and the text round it stays: elements of HIDDEN_TAGS, and
    those with an attribute named hidden, aria-hidden="true", or a style that hides. Formulas are text, their annotations
    aren't.

    Malformed nesting is mended roughly as browsers do. Where a tag's quotes leave it without an end, quotes mean nothing
    from there on; where no > follows, the rest is text. Every character is looked at a bounded number of times.
    """
    out: list[Block] = []
    above = _Open(known)
    text: list[str] = []
    linked, quotes = 0, True
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if text:
            folded = " ".join("".join(text).split())
            if folded:
                own, parent = (["none", "none"] + above.outer[-2:])[:-3:-1]
                out.append(Block(folded, own, parent, above.tags.all(), above.marks.all(), min(linked, len(folded))))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            if above.stack and above.stack[-1][0] == "head" and not raw.isspace():
                close({"head"})
            if above.hidden:
                return
            piece = html.unescape(raw)
            text.append(piece)
            if above.places.get("a"):
                linked += len(piece.strip())

    def close(tags: set[str], scope: frozenset[str] = frozenset()) -> None:
        k = above.last(tags)
        if k < 0 or above.last(scope) > k:
            return
        if any(t in BLOCK_TAGS for t, _, _ in above.stack[k:]):
            flush()
        while len(above.stack) > k:
            above.pop()

    at = start = 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            add(page[start:at])
            at = start = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            add(page[start:at])
            at = start = len(page) if end < 0 else end + 1
            continue
        m = _OPEN.match(page, at)
        if not m:
            at += 1
            continue
        end = _REST.match(page, m.end()) if quotes else None
        if end:
            stop = end.end()
        else:
            quotes = False
            stop = page.find(">", m.end()) + 1
            if not stop:
                break
        add(page[start:at])
        raw, shut = page[m.end() : stop - 1], page[at + 1] == "/"
        at = start = stop
        tag = m[1].lower()
        if shut:
            close({tag})
            continue
        if above.stack and above.stack[-1][0] == "head" and tag not in HEAD_TAGS:
            close({"head"})
        if tag in ENDS:
            close(ENDS[tag], SCOPE - ENDS[tag])
        if tag in BLOCK_TAGS:
            flush()
        if tag == "br":
            text.append(" ")
        if tag in VOID_TAGS or raw.endswith("/") and tag not in BLOCK_TAGS:
            continue
        above.push(tag, *_attributes(tag, raw))
        if tag in RAW_TAGS:
            shutting = re.compile(rf"</{tag}\b", re.I).search(page, at)
            stop = page.find(">", shutting.end()) + 1 if shutting else 0
            if tag not in HIDDEN_TAGS:
                add(page[at : shutting.start() if stop else len(page)])
            at = start = stop or len(page)
            close({tag})
    add(page[start:])
    flush()
    return out


def _step(n: float, *limits: float) -> int:
    return sum(n > x for x in limits)


def features(page: list[Block]) -> list[list[str]]:
    """Features of each block: its ancestors' tags and marks, and its text's length, links and copyright sign."""
    out = []
    for b in page:
        size = _step(b.text.count(" ") + 1, 2, 5, 10, 20, 50)
        links = _step(b.linked / len(b.text), 0.05, 0.3, 0.8)
        f = ["bias", f"tag={b.own}", f"nest={b.parent} {b.own}", f"size={size}", f"links={links}", f"copyright={'©' in b.text}"]
        f += [f"in={t}" for t in b.tags or ("none",)] + [f"mark={m}" for m in b.marks]
        out.append(f)
    return out

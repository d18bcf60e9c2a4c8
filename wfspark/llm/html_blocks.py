"""HTML as a sequence of leaf blocks: text, the tags it stands under and how much of it is linked.

One scan from left to right: every mark is matched once where it begins, quoted values of both kinds included, and a mark that never
ends takes the rest of the page, as browsers do. Elements are found by lists of their depths, so deep nesting costs no search.
The tags above a block are not copied: opening and closing an element adds its names to one list of signed events, and a block notes how
many events came before it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict

#: The rest of a tag up to its end: a value after = may be quoted and hold anything then; a quote that never ends counts as a plain character.
_REST = r"""(?:[^=>]|=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?)*+"""
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)({_REST})>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'][^\s=/]*+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'][^\s]*+))""")
_PARTS = re.compile(r"[^\W\d_]+")

#: Elements whose content is never text of the page.
_HIDDEN = frozenset("script style noscript template svg math iframe object textarea select canvas audio video".split())
_RAW = {name: re.compile(rf"</{name}(?=[\s/>]){_REST}>", re.I) for name in ("script", "style", "textarea")}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element on the left, when it opens, ends an open one on the right that nothing on the far right encloses.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}


class Blocks:
    """Leaf blocks of one page in page order: their texts, how many characters of each are linked, and how many events came before it.
    ``names`` and ``signs`` are the events: 1 where an element with that name (or class, id, role) opens, -1 where it ends."""

    __slots__ = ("texts", "linked", "at", "names", "signs")

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.at: list[int] = []
        self.names: list[str] = []
        self.signs: list[int] = []

    def __len__(self) -> int:
        return len(self.texts)

    def path(self, k: int) -> list[str]:
        """Names above block k, outermost first."""
        out: list[str] = []
        for name, sign in zip(self.names[: self.at[k]], self.signs):
            if sign > 0:
                out.append(name)
            else:
                out.pop()
        return out


class _Scan:
    """State of the scan: open elements, the block that is being gathered, and what hides or links it."""

    def __init__(self) -> None:
        self.out = Blocks()
        self.stack: list[tuple[str, list[str]]] = []
        self.depths: defaultdict[str, list[int]] = defaultdict(list)
        self.pieces: list[str] = []
        self.linked, self.link_depth, self.hidden_from = 0, -1, -1

    def say(self, raw: str) -> None:
        if self.hidden_from >= 0 or not raw:
            return
        piece = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(piece)
        if self.link_depth >= 0:
            self.linked += len(" ".join(piece.split()))

    def flush(self) -> None:
        if not self.pieces:
            return
        text, out = " ".join("".join(self.pieces).split()), self.out
        if text:
            out.texts.append(text)
            out.linked.append(min(self.linked, len(text)))
            out.at.append(len(out.names))
        self.pieces.clear()
        self.linked = 0

    def push(self, name: str, names: list[str]) -> None:
        if name in _HIDDEN and self.hidden_from < 0:
            self.hidden_from = len(self.stack)
        self.depths[name].append(len(self.stack))
        self.stack.append((name, names))
        self.out.names += names
        self.out.signs += [1] * len(names)

    def pop_to(self, depth: int) -> None:
        self.flush()
        while len(self.stack) > depth:
            name, names = self.stack.pop()
            self.depths[name].pop()
            self.out.names += names[::-1]
            self.out.signs += [-1] * len(names)
        if depth < self.link_depth:
            self.link_depth = -1
        if self.hidden_from >= depth:
            self.hidden_from = -1

    def close(self, name: str) -> None:
        if name == "a":
            self.link_depth = -1
        elif name not in _INLINE:
            if self.depths[name]:
                self.pop_to(self.depths[name][-1])
            else:
                self.flush()

    def open(self, name: str, rest: str) -> None:
        if name == "br":
            self.say(" ")
            return
        if name == "a":
            self.link_depth = len(self.stack)
            return
        if name in _INLINE:
            return
        self.flush()
        if name in _VOID:
            return
        if self.stack and self.stack[-1][0] == "p":
            self.pop_to(len(self.stack) - 1)
        if name in _ENDS:
            ends, bounds = _ENDS[name]
            bound = max((self.depths[x][-1] for x in bounds if self.depths[x]), default=-1)
            inner = [d[k] for d in (self.depths[x] for x in ends) if (k := bisect_right(d, bound)) < len(d)]
            if inner:
                self.pop_to(min(inner))
        if rest.endswith("/"):
            return
        names = [name]
        if "=" in rest:
            for key, *values in _ATTRIBUTE.findall(rest):
                if key.lower() in ("class", "id", "role"):
                    names += [x.lower() for x in _PARTS.findall("".join(values))]
        self.push(name, names)


def blocks(page: str | None) -> Blocks:
    """Leaf blocks in page order. Inline elements don't break a block, `br` is white space; what is never shown is left out."""
    scan = _Scan()
    page = page or ""
    at, end = 0, len(page)
    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            scan.say(page[at:])
            break
        scan.say(page[at:mark])
        after = page[mark + 1 : mark + 3]
        if page.startswith("!--", mark + 1):
            short = next((x for x in (">", "->") if page.startswith(x, mark + 4)), None)
            close = page.find("-->", mark + 4) if short is None else mark + 1 + len(short)
            at = close + 3 if close >= 0 else end
        elif after[:1] in ("!", "?") or after[:1] == "/" and not (after[1:].isascii() and after[1:].isalpha()):
            close = page.find(">", mark)
            at = close + 1 if close >= 0 else end
        elif not (after[0:1].isascii() and after[0:1].isalpha() or after[:1] == "/"):
            scan.say("<")
            at = mark + 1
        elif (m := _TAG.match(page, mark)) is None:  # the page ends inside the tag
            break
        else:
            at, name, rest = m.end(), m[2].lower(), m[3]
            if m[1]:
                scan.close(name)
            elif name in _RAW:
                close = _RAW[name].search(page, at)
                at = close.end() if close else end
            else:
                scan.open(name, rest)
    scan.pop_to(0)
    return scan.out

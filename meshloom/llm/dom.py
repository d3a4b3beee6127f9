"""A tolerant HTML reader: elements as parallel lists, and text in page order."""

from __future__ import annotations

import re
from collections.abc import Iterable
from html import unescape

_QUOTED = r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)"
_START = re.compile(rf"<([a-zA-Z][^\s/>]*){_QUOTED}>")
#: How far a start tag's quotes can be read where no > follows them.
_BROKEN = re.compile(rf"<[a-zA-Z][^\s/>]*{_QUOTED}")
_PLAIN = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>")
_END = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never text of a page.
SILENT = frozenset("head script style title noscript template textarea select option button input iframe svg math object canvas audio video datalist dialog xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title", "option", "optgroup", "select"}
#: A start tag ends the open elements named here, up to one that bounds the search.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_P_BOUNDS = frozenset("td th table caption button object article section body html".split())
_P = frozenset(["p"])
_END_BOUNDS = frozenset("td th table caption body html".split())
#: End tags that reach through the bounds.
_END_ANYWHERE = frozenset("table tr tbody thead tfoot body html article main section div".split())


class _Open:
    """Open elements. For each name the places of its open elements, so that no search walks the stack."""

    def __init__(self) -> None:
        self.nodes, self.names = [0], ["#document"]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.nodes))
        self.nodes.append(node)
        self.names.append(name)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.nodes.pop()
            self.places[self.names.pop()].pop()

    def last(self, names: Iterable[str]) -> int:
        """The place of the last open element of these names, 0 if there is none."""
        return max((at[-1] for n in names if (at := self.places.get(n))), default=0)

    def close(self, names: frozenset, bounds: frozenset, once: bool) -> None:
        """Ends elements of these names that no bound holds; `once`: only the last of them."""
        while (at := self.last(names)) > self.last(bounds):
            self.cut(at)
            if once:
                return

    def end(self, name: str) -> None:
        at = self.last((name,))
        if at and (name in _END_ANYWHERE or at >= self.last(_END_BOUNDS)):
            self.cut(at)


class Page:
    """tag, parent, tokens (words of class, id and role), marks (data-y, for training pages) and hidden of each element;
    element 0 is the document. texts: (element, decoded text, whether a block began or ended before it).

    Reading takes time in proportion to the page, whatever its nesting and however much of it is left open. A < that begins no
    tag is text. A tag whose quotes aren't closed ends at its first >, and so does every tag up to the open quote.
    """

    def __init__(self, html: str):
        self.tag: list[str] = ["#document"]
        self.parent: list[int] = [-1]
        self.tokens: list[tuple[str, ...]] = [()]
        self.mark: list[str | None] = [None]
        self.hidden: list[bool] = [False]
        self.texts: list[tuple[int, str, bool]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack, size, broken = _Open(), len(html), True
        last, plain_until, roots = html.rfind(">"), 0, set()
        start = at = 0  # where the text before the next tag begins; where to look for one
        while start < size:
            at = html.find("<", at)
            if at < 0:
                at = size
            stop, name, attrs, ends = at, "", None, False
            after = html[at + 1 : at + 2]
            if at == size:
                start_after = size
            elif html.startswith("<!--", at):
                close = html.find("-->", at + 4)
                start_after = close + 3 if close >= 0 else size
            elif at > last:
                at += 1
                continue
            elif after in ("!", "?"):
                start_after = html.find(">", at + 2) + 1
            else:
                m = None
                if after == "/":
                    m, ends = _END.match(html, at), True
                elif after.isalpha() and after.isascii():
                    m = _START.match(html, at) if at >= plain_until else None
                    if not m:
                        plain_until = max(plain_until, _BROKEN.match(html, at).end()) if at >= plain_until else plain_until
                        m = _PLAIN.match(html, at)
                if not m:
                    at += 1
                    continue
                name, start_after = m.group(1).lower(), m.end()
                attrs = None if ends else m.group(2)
            if stop > start:
                text = html[start:stop]
                self.texts.append((stack.nodes[-1], unescape(text) if "&" in text else text, broken))
                broken = False
            start = at = start_after
            if name in BLOCK:
                broken = True
            if ends:
                stack.end(name)
            elif name:
                if name in ENDS_P:
                    stack.close(_P, _P_BOUNDS, True)
                if name in IMPLIED:
                    stack.close(*IMPLIED[name], False)
                if name in ("html", "body"):
                    if name in roots:
                        continue
                    roots.add(name)
                node = self._add(name, stack.nodes[-1], attrs)
                if name in RAW:
                    close = re.compile(rf"</{name}\b", re.I).search(html, at)
                    start = at = html.find(">", close.end()) + 1 or size if close else size
                elif name not in VOID and not (attrs and attrs.endswith("/") and name in ("svg", "path")):
                    stack.push(node, name)

    def _add(self, name: str, parent: int, attrs: str | None) -> int:
        tokens: list[str] = []
        mark, hidden = None, False
        if attrs and not attrs.isspace():
            for m in _ATTRIBUTE.finditer(attrs):
                key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
                if key in ("class", "id", "role"):
                    tokens += [x.lower() for x in _NAME.findall(value)]
                elif key == "hidden" or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                    hidden = True
                elif key == "data-y":
                    mark = value
        self.tag.append(name)
        self.parent.append(parent)
        self.tokens.append(tuple(tokens))
        self.mark.append(mark)
        self.hidden.append(hidden)
        return len(self.tag) - 1

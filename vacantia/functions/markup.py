"""A stored page read once, from left to right, into tags and the texts between them; fields are
look-ups in what was read. Attributes may stand in either kind of quote or none; character references
are decoded once, as an HTML parser does."""

import re
from collections.abc import Iterator
from html import unescape

# A comment, a declaration, a tag with its quotes in order, or one whose quotes are not closed.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
                  r"""|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNREAD = frozenset({"script", "style"})
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
_LINE_AFTER = frozenset({("br", False), ("p", True), ("li", True)})  # (name, closing)


def attributes(text: str) -> dict[str, str]:
    """By lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


class Markup:
    """tags: (start, end, closing, name, attribute text). Elements are numbers of start tags; an
    element ends where tags of its name, counted up and down, come back to zero, or with the page."""

    def __init__(self, page: str):
        self.page = page
        self.tags: list[tuple[int, int, bool, str, str]] = []
        unread = None
        for found in _TAG.finditer(page):
            closing, name, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not name:
                self.tags.append((found.start(), found.end(), False, "", ""))
                continue
            name = name.lower()
            if unread is not None and not (closing and name == unread):
                continue
            unread = name if name in _UNREAD and not closing else None
            self.tags.append((found.start(), found.end(), bool(closing), name, rest))

    def elements(self, wanted, inside: int | None = None) -> Iterator[int]:
        """Elements, in page order, for which wanted(name, attributes) holds; `inside` another one."""
        first, last = (0, len(self.tags)) if inside is None else (inside + 1, self.end(inside))
        for k in range(first, last):
            _, _, closing, name, rest = self.tags[k]
            if name and not closing and wanted(name, rest):
                yield k

    def first(self, names, inside: int | None = None) -> int | None:
        """The first element with one of these classes."""
        return next(self.elements(with_class(names), inside), None)

    def end(self, element: int) -> int:
        """Number of the tag that ends it."""
        _, stop, _, name, rest = self.tags[element]
        if name in _EMPTY or rest.endswith("/"):
            return element + 1
        depth = 1
        for k in range(element + 1, len(self.tags)):
            if self.tags[k][3] == name:
                depth += -1 if self.tags[k][2] else not self.tags[k][4].endswith("/")
                if depth == 0:
                    return k
        return len(self.tags)

    def texts(self, element: int) -> Iterator[tuple[str, tuple[str, bool]]]:
        """What it holds: each text and the tag (name, closing) behind it."""
        last, tags = self.end(element), self.tags
        for k in range(element, last):
            _, begin, closing, name, _ = tags[k]
            if k == element and last == element + 1 and (name in _EMPTY):
                return
            stop = tags[k + 1][0] if k + 1 < len(tags) else len(self.page)
            behind = tags[k + 1][3:1:-1] if k + 1 < last else ("", True)
            unread = name in _UNREAD and not closing
            yield "" if unread else self.page[begin:stop], behind

    def tight(self, element: int | None) -> str | None:
        """Its texts, each stripped, joined."""
        if element is None:
            return None
        return "".join(unescape(text).strip() for text, _ in self.texts(element))

    def loose(self, element: int) -> str:
        return "".join(unescape(text) for text, _ in self.texts(element))

    def readable(self, element: int | None) -> str | None:
        """Its text in paragraphs: a line ends after a break, paragraph or list item."""
        if element is None:
            return None
        parts = [unescape(text) + "\n" * (behind in _LINE_AFTER) for text, behind in self.texts(element)]
        lines = (line.strip() for line in "".join(parts).splitlines())
        return "\n\n".join(line for line in lines if line)


def with_class(names):
    """Whether an element has one of these classes."""
    some = frozenset(names)

    def wanted(_, rest: str) -> bool:
        return "class" in rest.lower() and not some.isdisjoint(attributes(rest).get("class", "").split())

    return wanted

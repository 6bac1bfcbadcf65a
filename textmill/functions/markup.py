"""Reading markup in time linear in its length, whatever is left open: marks in order, and the open elements."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any, NamedTuple

HEAD = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
STOP = re.compile("[>\"']")


class Mark(NamedTuple):
    """A tag, or what is no text either (comments, declarations; their name is empty)."""

    begin: int
    end: int
    closing: bool = False
    name: str = ""
    attributes: str = ""


class Marks:
    """The marks of a page. Quoted attribute values may hold ``>``; a tag with a quote that is never closed ends at the next ``>``."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.sections = page, page.rfind(">"), True
        #: Opening quotes from which no tag end is reached: a scan that comes to one is over.
        self.lost: set[int] = set()

    def next(self, at: int) -> Mark | None:
        """The first mark at or after a position."""
        page = self.page
        while m := HEAD.search(page, at):
            at = m.end()
            if m[1]:
                return Mark(m.start(), self.after("-->", at) or len(page))
            if at > self.last:
                continue  # no tag ends any more, but a comment may begin
            if m[2]:
                end = self.after("]]>", at) if self.sections else 0
                self.sections = bool(end)
                return Mark(m.start(), end or self.after(">", at))
            if m[3]:
                return Mark(m.start(), self.after(">", at))
            end = self.tag_end(at)
            return Mark(m.start(), end, bool(m[4]), m[5].lower(), page[at : end - 1])
        return None

    def after(self, text: str, at: int) -> int:
        """Where the next occurrence of text ends, or 0."""
        found = self.page.find(text, at)
        return found + len(text) if found >= 0 else 0

    def tag_end(self, at: int) -> int:
        place, passed = at, []
        while m := STOP.search(self.page, place):
            if m[0] == ">":
                return m.end()
            if m.start() in self.lost:
                break
            passed.append(m.start())
            place = self.after(m[0], m.end())
            if not place:
                break
        self.lost.update(passed)
        return self.after(">", at)


class Open:
    """Open elements by depth, each with what its reader keeps of it; the innermost of some names is found without a search."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.kept: list[Any] = []
        self.at: dict[str, list[int]] = {}

    def __len__(self) -> int:
        return len(self.names)

    def push(self, name: str, kept: Any = None) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.kept.append(kept)

    def innermost(self, names: Iterable[str]) -> int:
        """The depth of the innermost open element of one of the names, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def cut(self, depth: int) -> None:
        """Closes the element at a depth and all within it."""
        while len(self.names) > depth:
            self.at[self.names.pop()].pop()
            self.kept.pop()

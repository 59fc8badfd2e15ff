"""Symbols, and a masker that blanks comments and strings so that scanners see code only."""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple


class Symbol(NamedTuple):
    line: int
    kind: str
    name: str
    scope: str | None = None


class Lines:
    """Line numbers, from 1, of offsets in a text."""

    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def at(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)


def blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def mask(text: str, pattern: re.Pattern[str], keep_quotes: bool = True) -> str:
    """Everything the pattern matches becomes blanks of the same length; strings keep their quotes.

    A match of the group ``code`` (what only looks like a string) stays.
    """

    def put(m: re.Match[str]) -> str:
        if "code" in m.re.groupindex and m["code"] is not None:
            return m[0]
        s = m[0]
        if keep_quotes and len(s) >= 2 and s[0] in "\"'`" and s[-1] == s[0]:
            return s[0] + blank(s[1:-1]) + s[-1]
        return blank(s)

    return pattern.sub(put, text)


def closing(text: str, at: int, pairs: str = "{}") -> int:
    """Offset of the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(pairs)}]").finditer(text, at):
        depth += 1 if m[0] == pairs[0] else -1
        if not depth:
            return m.start()
    return len(text)

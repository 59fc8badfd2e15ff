"""The query grammar ``[repo:] [@kind ...] [words ...]``, parsed on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symquarry.functions.names import normalize_text
from symquarry.schema import KINDS

_ATOM = re.compile(r"([A-Za-z0-9_/.\-]+):(?=\s|$)")


class QueryError(ValueError):
    """An unknown repository or kind, or an ambiguous kind."""


@dataclass(frozen=True)
class Word:
    norm: str
    path_only: bool


@dataclass
class ParsedQuery:
    repo_ids: list[int] | None = None
    repo_filter: str | None = None
    kinds: list[str] = field(default_factory=list)
    term: str = ""

    def words(self) -> list[Word]:
        """Words that don't normalise to nothing; those with a slash match paths only."""
        found = (Word(normalize_text(t), "/" in t) for t in self.term.split())
        return [w for w in found if w.norm]


def resolve_kind(sigil: str) -> str:
    """A kind by its name or an unambiguous beginning; ASCII case doesn't matter."""
    needle = sigil.lower() if sigil.isascii() else sigil
    if needle in KINDS:
        return needle
    found = [k for k in KINDS if needle and k.startswith(needle)]
    if len(found) == 1:
        return found[0]
    if found:
        raise QueryError(f"ambiguous kind '@{sigil}' (matches: {', '.join(found)})")
    raise QueryError(f"unknown kind '@{sigil}' (kinds: {', '.join(KINDS)})")


def resolve_repos(repos: DataFrame, token: str, abbreviations: dict[str, str] | None = None) -> tuple[str, list[int]]:
    """(name, ids): abbreviation, then the exact name, then every repository whose name begins so, in any case."""
    name = (abbreviations or {}).get(token, token)
    prefix = F.lower("name").startswith(name.lower())
    # One pass: exact hits are a subset of the prefix hits.
    hits = repos.where((F.col("name") == name) | prefix).select("id", (F.col("name") == name).alias("exact")).orderBy("id").collect()
    ids = [r.id for r in hits if r.exact] or [r.id for r in hits]
    if not ids:
        known = [r.name for r in repos.select("name").distinct().orderBy("name").collect()]
        raise QueryError(f"unknown repository '{token}' (known: {', '.join(known)})")
    return name, ids


def parse(repos: DataFrame, text: str, abbreviations: dict[str, str] | None = None) -> ParsedQuery:
    text = text.strip()
    out = ParsedQuery()
    atom = _ATOM.match(text)
    if atom:
        out.repo_filter, out.repo_ids = resolve_repos(repos, atom[1], abbreviations)
        text = text[atom.end() :].strip()
    tokens = text.split()
    out.kinds = sorted({resolve_kind(t[1:]) for t in tokens if t.startswith("@")})
    out.term = " ".join(t for t in tokens if not t.startswith("@"))
    return out

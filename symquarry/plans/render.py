"""Text sinks: TSV, the picker's feed, previews, selection targets and tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symquarry.functions.names import paint_line, paint_matches
from symquarry.plans.parser import Word


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def tsv(rows: DataFrame) -> DataFrame:
    """Eight columns joined by tabs; nulls are empty."""
    columns = ("repo", "path", "line", "kind", "scope", "name", "name_norm", "qual_norm")
    return rows.select("id", F.concat_ws("\t", *map(_text, columns)).alias("line_text"))


def best_last(rows: DataFrame, limit: int) -> list[str]:
    """The ``limit`` best of ranked rows as TSV lines for a terminal, the best at the end; few rows, on the driver."""
    return [r.line_text for r in tsv(rows.limit(limit)).collect()][::-1]


def pick_feed(rows: DataFrame, words: list[Word] | None = None, sgr: str = "") -> DataFrame:
    """Repository, path and line, then ``repo@kind``, the scoped name and the place, joined by tabs.

    With words and an SGR sequence, what they match is painted: names by name words, paths and file
    rows by all.
    """
    name, place = F.concat_ws("::", "scope", "name"), F.col("path")
    if words and sgr.strip():
        every, named = [w.norm for w in words], [w.norm for w in words if not w.path_only]
        name = F.when(F.col("kind") == "file", paint_matches(name, every, sgr)).otherwise(paint_matches(name, named, sgr))
        place = paint_matches(F.col("path"), every, sgr)
    place = F.when(F.col("kind") == "file", "").otherwise(F.concat(place, F.when(F.col("line").isNull(), "").otherwise(F.concat(F.lit(":"), F.col("line").cast("string")))))
    fields = (_text("repo"), _text("path"), _text("line"), F.concat("repo", F.lit("@"), "kind"), name, place)
    return rows.select("id", F.concat_ws("\t", *fields).alias("feed"))


def selection_target(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """``root/path[:line]``; of repositories with one name the smallest id counts."""
    roots = repos.groupBy("name").agg(F.min_by("root", "id").alias("root"))
    line = F.when(F.col("line").isNull(), "").otherwise(F.concat(F.lit(":"), F.col("line").cast("string")))
    rows = rows.join(roots, rows["repo"] == roots["name"]).drop(roots["name"])
    return rows.select("id", F.concat("root", F.lit("/"), "path", line).alias("target"))


def preview(texts: DataFrame, line: int | None = None, sgr: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, text): the lines of each text, the chosen one painted."""
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "text"))
    painted = F.col("text")
    if line is not None and sgr.strip():
        reset, arm = "\x1b[0m", f"\x1b[{sgr}m"
        whole = F.concat(F.lit(arm), F.replace(F.col("text"), F.lit(reset), F.lit(reset + arm)), F.lit(reset))
        painted = F.when(F.col("pos") + 1 == line, whole).otherwise(F.col("text"))
    return rows.select("id", (F.col("pos") + 1).alias("line_no"), painted.alias("text"))


def preview_file(path: str, line: int | None = None, sgr: str = "") -> list[str]:
    """Lines of one local file on the driver, the chosen one painted."""
    with open(path, encoding="utf-8", errors="replace") as f:
        lines = f.read().split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return [paint_line(t, sgr) if n == line else t for n, t in enumerate(lines, 1)]


def global_table(per_repo: DataFrame) -> str:
    """The global statistics as aligned text; one row per repository, which are few."""
    rows: pd.DataFrame = per_repo.toPandas()
    cells = [["REPO", "FILES", "SYMBOLS", "ROOT"]] + [[r.name, str(r.files), str(r.symbols), r.root] for r in rows.itertuples(index=False)]
    cells.append([f"{len(rows)} repos", str(int(rows.files.sum())), str(int(rows.symbols.sum())), ""])
    widths = [max(len(c[i]) for c in cells) for i in range(4)]
    lines = (f"{c[0]:<{widths[0]}}  {c[1]:>{widths[1]}}  {c[2]:>{widths[2]}}  {c[3]}".rstrip() for c in cells)
    return "\n".join(lines) + "\n"


def listing_text(listing: DataFrame) -> DataFrame:
    """A line per symbol, after a line with the path where a file begins."""
    head = F.when(F.col("header"), F.concat("path", F.lit("\n"))).otherwise("")
    return listing.select("id", F.concat(head, F.lit("  "), "kind", F.lit(": "), "name").alias("block"))

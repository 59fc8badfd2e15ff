"""Ranked symbol search, landing view and candidates: one lazy plan per query."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symquarry.functions.names import boundary_prefix, contains_at_boundary, contains_whole_tokens, kind_rank, match_quality
from symquarry.plans.parser import ParsedQuery, QueryError, Word, parse

#: The path of a file's symbols stands on the symbols too, so that the filter over both is one scan filter.
COLUMNS = ("repo", "path", "line", "kind", "scope", "name", "name_norm", "qual_norm")


def _hit(word: Word) -> Column:
    path = boundary_prefix(F.col("path_norm"), word.norm)
    return path if word.path_only else boundary_prefix(F.col("qual_norm"), word.norm) | path


def _whole(word: Word) -> Column:
    path = contains_whole_tokens(F.col("path_norm"), word.norm)
    return path if word.path_only else contains_whole_tokens(F.col("qual_norm"), word.norm) | path


def matches(symbols: DataFrame, repos: DataFrame, query: ParsedQuery) -> DataFrame:
    """Rows that pass the filters, with their repository's name and the ranking columns."""
    words = query.words()
    rows = symbols
    if query.repo_ids is not None:
        rows = rows.where(F.col("repo_id").isin(query.repo_ids))
    if query.kinds:
        rows = rows.where(F.col("kind").isin(query.kinds))
    if words:
        rows = rows.where(reduce(and_, map(_hit, words)))
    rows = rows.join(repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo")), "repo_id")
    named = [w.norm for w in words if not w.path_only]
    specific = F.lit(False)
    if named:
        specific = reduce(and_, (contains_at_boundary(F.col("qual_norm"), w) for w in named)) & (F.col("kind") != "file")
    whole = reduce(and_, map(_whole, words)) if words else F.lit(True)
    term = "_".join(named)
    tier = match_quality(F.col("name_norm"), F.col("qual_norm"), term) if named else F.lit(0)
    return rows.select(
        "id", *COLUMNS, specific.alias("specific"), whole.alias("whole"), tier.cast("int").alias("tier"),
        (kind_rank(F.col("kind")) if named else F.lit(0)).cast("int").alias("kind_rank"),
        (F.length("qual_norm") if named else F.lit(0)).cast("int").alias("qual_length"),
    )


def drop_echoes(rows: DataFrame) -> DataFrame:
    """Without file rows whose (repository name, path) has a specific row; by a window over each file's hits, so the symbols are read once."""
    seen = F.max(F.col("specific").cast("int")).over(Window.partitionBy("repo", "path"))
    return rows.withColumn("covered", seen).where("not (kind = 'file' and covered = 1)").drop("covered")


def drop_echoes_anti(rows: DataFrame) -> DataFrame:
    """The same by an anti join on the specific rows only: for rows that are written or cheap to compute twice."""
    covered = rows.where("specific").select(F.col("repo").alias("c_repo"), F.col("path").alias("c_path")).distinct()
    same = (rows["repo"] == F.col("c_repo")) & (rows["path"] == F.col("c_path")) & (rows["kind"] == "file")
    return rows.join(covered, same, "left_anti")


def ranking() -> list[Column]:
    """Best first; ties beyond the line go by id."""
    return [
        F.col("specific").desc(), F.col("whole").desc(), F.col("tier"), F.col("kind_rank"), F.col("qual_length"),
        F.col("repo"), F.col("path"), F.col("line").asc_nulls_first(), F.col("id"),
    ]


def search_parsed(symbols: DataFrame, repos: DataFrame, query: ParsedQuery, limit: int | None = None) -> DataFrame:
    """Hits in ranking order. The limit comes after the echo drop and runs as a top-k, not as a full sort."""
    rows = matches(symbols, repos, query)
    if any(not w.path_only for w in query.words()):
        rows = drop_echoes(rows)
    rows = rows.orderBy(*ranking())
    return rows.limit(limit) if limit is not None else rows


def search(symbols: DataFrame, repos: DataFrame, text: str, limit: int | None = None, abbreviations: dict[str, str] | None = None) -> DataFrame:
    return search_parsed(symbols, repos, parse(repos, text, abbreviations), limit)


def landing(symbols: DataFrame, repos: DataFrame, path: str = "README.md") -> DataFrame:
    """One file row per repository that has the landing file, by repository name."""
    rows = symbols.where((F.col("kind") == "file") & (F.col("path") == path))
    rows = rows.join(repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo")), "repo_id")
    return rows.select("id", *COLUMNS).orderBy("repo")


def candidates(symbols: DataFrame, repos: DataFrame, text: str = "", limit: int = 100, landing_path: str = "README.md", abbreviations: dict[str, str] | None = None) -> DataFrame:
    """The landing view for empty input, the first hits otherwise; nothing for input that doesn't parse."""
    if not text.strip():
        return landing(symbols, repos, landing_path)
    try:
        return search(symbols, repos, text, limit, abbreviations).select("id", *COLUMNS)
    except QueryError:
        return landing(symbols, repos, landing_path).limit(0)


def with_rank(rows: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best with their rank from 1: the top-k first, then numbers over those few."""
    return rows.orderBy(*ranking()).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*ranking())))

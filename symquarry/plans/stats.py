"""Index statistics: per repository, totals, kinds and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symquarry.plans.parser import QueryError, resolve_repos


def stats_global(repos: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files and symbols per repository: each side is aggregated before the join, so nothing multiplies."""
    f = files.groupBy("repo_id").agg(F.count("*").alias("files"))
    s = symbols.groupBy("repo_id").agg(F.count("*").alias("symbols"))
    rows = repos.join(f, repos.id == f.repo_id, "left").drop("repo_id").join(s, repos.id == s.repo_id, "left")
    zero = F.lit(0).cast("long")
    return rows.select("id", "name", "root", "head", "dirty", F.coalesce("files", zero).alias("files"), F.coalesce("symbols", zero).alias("symbols")).orderBy("name")


def stats_totals(per_repo: DataFrame) -> DataFrame:
    return per_repo.agg(F.count("*").alias("repos"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"))


def column_widths(per_repo: DataFrame) -> DataFrame:
    """The widest cell of each column of the global table."""
    return per_repo.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(f"{c}_width") for c in ("name", "files", "symbols", "root")])


def kind_breakdown(symbols: DataFrame, repo_id: int) -> DataFrame:
    return symbols.where(F.col("repo_id") == repo_id).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def head_text(repos: DataFrame) -> DataFrame:
    text = F.when(F.col("head").isNull(), "none").when(F.col("dirty"), F.concat("head", F.lit(" (dirty)"))).otherwise(F.col("head"))
    return repos.select("id", "name", "root", text.alias("head_text"))


def detail(repos: DataFrame, files: DataFrame, symbols: DataFrame, repo_ids: list[int]) -> DataFrame:
    """(id, name, block): the detail block of each of some repositories, by name."""
    chosen = F.col("id").isin(repo_ids)
    per = stats_global(repos.where(chosen), files.where(F.col("repo_id").isin(repo_ids)), symbols.where(F.col("repo_id").isin(repo_ids)))
    kinds = symbols.where(F.col("repo_id").isin(repo_ids)).groupBy("repo_id", "kind").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "kind")))
    line = lambda k: F.concat(F.lit("  "), k["kind"], F.lit(": "), (-k["less"]).cast("string"), F.lit("\n"))
    kinds = kinds.groupBy("repo_id").agg(F.array_join(F.transform(ordered, line), "").alias("kinds"))
    rows = per.join(head_text(repos).select(F.col("id").alias("h_id"), "head_text"), F.col("id") == F.col("h_id")).join(kinds, F.col("id") == F.col("repo_id"), "left")
    fields = (("Repo name: ", "name"), ("Repo path: ", "root"), ("Head commit: ", "head_text"), ("Files: ", "files"), ("Symbols: ", "symbols"))
    block = F.concat(*[F.concat(F.lit(title), F.col(c).cast("string"), F.lit("\n")) for title, c in fields], F.lit("Symbol kinds:\n"), F.coalesce("kinds", F.lit("")))
    return rows.select("id", "name", block.alias("block")).orderBy("name", "id")


def stats(repos: DataFrame, files: DataFrame, symbols: DataFrame, repo: str | None = None, *, list_files: bool = False, kinds: list[str] | None = None, abbreviations: dict[str, str] | None = None) -> DataFrame:
    """What the command shows: all repositories; the detail blocks of those that a name stands for; or their files, which a kind implies."""
    if repo is None:
        return stats_global(repos, files, symbols)
    _, ids = resolve_repos(repos, repo, abbreviations)
    if list_files or kinds:
        return file_listing(repos, symbols, ids, kinds)
    return detail(repos, files, symbols, ids)


def file_listing(repos: DataFrame, symbols: DataFrame, repo_ids: list[int], kinds: list[str] | None = None) -> DataFrame:
    """Symbols of some repositories by file; ``header`` marks the first row of each file of a repository.

    Kinds are taken literally. A kind filter without any hit is an error that lists the kinds there are.
    """
    own = symbols.where(F.col("repo_id").isin(repo_ids))
    rows = own.where(F.col("kind").isin(kinds)) if kinds else own
    if kinds and rows.isEmpty():
        known = [r.kind for r in own.select("kind").distinct().orderBy("kind").collect()]
        raise QueryError(f"no symbols of kind '{', '.join(kinds)}' (kinds: {', '.join(known)})")
    rows = rows.join(repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo")), "repo_id")
    order = Window.partitionBy("repo_id", "path").orderBy(F.col("line").asc_nulls_first(), "id")
    rows = rows.withColumn("header", F.row_number().over(order) == 1)
    return rows.select("id", "repo_id", "repo", "path", "line", "kind", "name", "header").orderBy("repo", "path", F.col("line").asc_nulls_first(), "id")

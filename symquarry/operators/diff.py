"""Snapshot comparison behind the incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repos_to_scan(discovered: DataFrame, stored: DataFrame, full: bool = False) -> DataFrame:
    """Discovered repositories without those unchanged: same commit (none equals none), clean then and now."""
    if full:
        return discovered
    s = stored.select(F.col("root").alias("s_root"), F.col("head").alias("s_head"), F.col("dirty").alias("s_dirty"))
    same = (discovered["root"] == s["s_root"]) & discovered["head"].eqNullSafe(s["s_head"]) & ~s["s_dirty"] & ~discovered["dirty"]
    return discovered.join(s, same, "left_anti")


def vanished_repos(stored: DataFrame, discovered: DataFrame) -> DataFrame:
    return stored.join(discovered.select("root"), "root", "left_anti")


def changed_files(current: DataFrame, stored: DataFrame, full: bool = False) -> DataFrame:
    """Files that are new or whose (mtime_ns, size) differs; all with ``full``."""
    if full:
        return current
    return current.join(stored.select("repo_id", "path", "mtime_ns", "size"), ["repo_id", "path", "mtime_ns", "size"], "left_anti")


def removed_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    return stored.join(current.select("repo_id", "path"), ["repo_id", "path"], "left_anti")


def renamed(discovered: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored repositories with the name they have now; the root identifies them."""
    d = discovered.select("root", F.col("name").alias("now"))
    return stored.join(d, "root", "left").withColumn("name", F.coalesce("now", "name")).drop("now").select(*stored.columns)

"""The stored index: Parquet tables by version and repository, refreshed incrementally.

Files and symbols lie in ``<table>/version=V/repo_id=R``. The table of repositories says which version
of each counts, and a commit file, the last by number, says which table of repositories counts. A
refresh reads and parses changed files only, and writes only repositories of which a file changed,
under a new version; nothing counts before its commit, so readers keep what they opened and a crash
leaves the previous state in place.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from symquarry.extract.table import extract_symbols
from symquarry.functions.names import normalize
from symquarry.operators import diff
from symquarry.schema import FILES, REPOS, SCHEMA_VERSION, SYMBOLS
from symquarry.sources import repositories
from symquarry.sources.config import Config
from symquarry.sources.corpus import file_rows, with_norms
from symquarry.sources.storage import Folder

TABLES = {"files": FILES, "symbols": SYMBOLS}
#: Commits that readers may still hold.
KEPT_COMMITS = 2


def lock(spark: SparkSession, directory: str):
    """Yields whether this process is the only refresher; never waits."""
    return Folder(spark, directory).lock("refresh.lock")


def _commits(folder: Folder) -> list[dict]:
    """Commits of this version of the data, oldest first. Others are never migrated: the index is a cache and is built anew."""
    names = [n for n in folder.names() if n.startswith("commit-") and n.endswith(".json")]
    found = [json.loads(folder.read(n)) | {"name": n} for n in names]
    return [c for c in found if c.get("schema_version") == SCHEMA_VERSION]


def _stored(spark: SparkSession, folder: Folder, commit: dict | None) -> DataFrame:
    """Repositories of a commit, with the version of each; none without a commit."""
    schema = f"{REPOS}, version string"
    return spark.read.schema(schema).parquet(f"{folder.path}/{commit['repos']}") if commit else spark.createDataFrame([], schema)


def _table(spark: SparkSession, folder: Folder, table: str, stored: DataFrame) -> DataFrame:
    versions = sorted(r.version for r in stored.select("version").distinct().collect())
    paths = [f"{folder.path}/{table}/version={v}" for v in versions if folder.exists(f"{table}/version={v}")]
    schema = TABLES[table]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, version string").option("basePath", f"{folder.path}/{table}").parquet(*paths)
    if len(versions) > 1:
        rows = rows.join(stored.select(F.col("id").alias("repo_id"), "version"), ["repo_id", "version"], "left_semi")
    else:
        rows = rows.join(stored.select(F.col("id").alias("repo_id")), "repo_id", "left_semi")
    return rows.select(*_names(schema))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def read_index(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The tables repos, files and symbols as of the last commit; empty ones if there is none."""
    folder = Folder(spark, directory)
    stored = _stored(spark, folder, next(reversed(_commits(folder)), None))
    return {"repos": stored.drop("version")} | {t: _table(spark, folder, t, stored) for t in TABLES}


def refresh(spark: SparkSession, directory: str, config: Config, full: bool = False, roots: list[str] | None = None) -> dict[str, int] | None:
    """Brings the index up to date; returns counters, or None if another process refreshes.

    Repositories whose commit is the same and that were and are clean are skipped unless ``full``.
    A repository whose files can't be listed keeps what is stored, and its state stays dirty. With
    ``roots`` only those repositories are looked at; the others stay as they are stored.
    """
    with lock(spark, directory) as alone:
        if not alone:
            return None
        return _refresh(spark, Folder(spark, directory), config, full, roots)


def summary(counters: dict[str, int]) -> str:
    """One line about a refresh."""
    return "{repos} repos ({skipped} skipped, {pruned} pruned, {failed} failed), {indexed} files indexed, {removed} removed, {symbols} symbols".format(**counters)


def _refresh(spark: SparkSession, folder: Folder, config: Config, full: bool, roots: list[str] | None) -> dict[str, int]:
    commits = _commits(folder)
    stored = _stored(spark, folder, commits[-1] if commits else None).cache()
    found = repositories.discover(config.index.paths, config.index.nested)
    here = {root for _, root in found}
    if roots is not None:
        wanted = set(roots)
        found = [(name, root) for name, root in found if root in wanted]
        apart = stored.where(~F.col("root").isin(sorted(wanted)))
    else:
        apart = stored.limit(0)
    states = repositories.git_states(spark.createDataFrame(found, "name string, root string")).cache()
    looked_at = stored.join(apart.select("id"), "id", "left_anti")
    # One row a repository, here and below, is all that reaches the driver.
    known_names = {(r.root, r.name) for r in looked_at.select("root", "name").collect()}
    pruned = sum(root not in here for root, _ in known_names)
    scan = diff.repos_to_scan(states, stored.drop("version"), full).cache()
    n_states, n_scanned = states.count(), scan.count()
    counters = {"repos": n_states + apart.count(), "skipped": n_states - n_scanned, "pruned": pruned, "failed": 0, "indexed": 0, "removed": 0, "symbols": 0}
    if commits and not n_scanned and known_names == {(root, name) for name, root in found}:
        for df in (stored, states, scan):
            df.unpersist()
        return counters  # nothing is different: the last commit stands
    listed = repositories.tracked_files(scan, config.index.ignored if config.index.ignores else None).cache()
    failed = listed.where("path is null").select("root", F.lit(True).alias("failed")).distinct()
    repo_id = F.xxhash64("root")
    current = listed.where("path is not null").select(repo_id.alias("repo_id"), "root", "path", "mtime_ns", "size")
    version = uuid.uuid4().hex[:12]
    changed: list[int] = []
    if n_scanned:
        counters["failed"] = failed.count()
        scanned = scan.join(failed, "root", "left_anti").select(repo_id.alias("repo_id"))
        files = _table(spark, folder, "files", stored)
        known = files.join(scanned, "repo_id", "left_semi").cache()
        fresh = diff.changed_files(current, known, full).select(*current.columns)
        gone = diff.removed_files(known, current).select("id", "repo_id").cache()
        changed = _write_changed(spark, folder, config, files, stored, fresh, gone, version, counters)
        known.unpersist()
        gone.unpersist()
    now = int(time.time())
    before = stored.select("root", F.col("head").alias("old_head"), "indexed_at", F.col("version").alias("old_version"))
    repos = states.join(scan.select("root", F.lit(True).alias("scanned")), "root", "left").join(failed, "root", "left").join(before, "root", "left")
    repos = repos.select(
        repo_id.alias("id"), "name", "root", F.when(F.col("failed"), F.col("old_head")).otherwise(F.col("head")).alias("head"),
        (F.col("dirty") | F.coalesce("failed", F.lit(False))).alias("dirty"),
        F.when(F.col("scanned"), F.lit(now)).otherwise(F.col("indexed_at")).cast("long").alias("indexed_at"),
        F.when(repo_id.isin(changed) | F.col("old_version").isNull(), F.lit(version)).otherwise(F.col("old_version")).alias("version"),
    ).unionByName(apart)
    # The state of repositories comes last: until the commit nothing of this run counts.
    repos.coalesce(1).write.parquet(f"{folder.path}/repos-{version}")
    number = int(commits[-1]["name"][7:-5]) + 1 if commits else 1
    folder.write_new(f"commit-{number:010d}.json", json.dumps({"schema_version": SCHEMA_VERSION, "repos": f"repos-{version}"}))
    _forget_older(spark, folder)
    for df in (stored, states, scan, listed):
        df.unpersist()
    return counters


def _write_changed(spark, folder: Folder, config: Config, files: DataFrame, stored: DataFrame, fresh: DataFrame, gone: DataFrame, version: str, counters: dict[str, int]) -> list[int]:
    """Parses changed files and writes the repositories that they or removed files belong to; returns those, and counts."""
    parsed = repositories.with_contents(fresh, config.index.max_file_size)
    keys = [F.xxhash64("repo_id", "path").alias("id"), "repo_id", "path", normalize(F.col("path")).alias("path_norm"), "mtime_ns", "size", "lang"]
    # One reading of the changed files feeds both tables.
    work = f"work-{version}"
    parsed.select(*keys, "content").write.parquet(f"{folder.path}/{work}")
    new = spark.read.parquet(f"{folder.path}/{work}")
    both = new.select("repo_id", F.lit(1).alias("new"), F.lit(0).alias("gone")).union(gone.select("repo_id", F.lit(0), F.lit(1)))
    per_repo = both.groupBy("repo_id").agg(F.sum("new").alias("new"), F.sum("gone").alias("gone")).collect()
    counters |= {"indexed": sum(r.new for r in per_repo), "removed": sum(r.gone for r in per_repo)}
    touched = sorted(r.repo_id for r in per_repo)
    if touched:
        seen = Observation()
        rows = extract_symbols(new.select("id", "repo_id", "path", "path_norm", "lang", "content"), resolve_yaml=config.index.resolve_yaml)
        code = with_norms(rows).withColumn("file_id", F.col("id"))
        code = code.withColumn("id", F.xxhash64("file_id", "line", "kind", "name", "scope", "ordinal")).observe(seen, F.count("*").alias("n"))
        symbols = file_rows(new).select(*_names(SYMBOLS)).unionByName(code.select(*_names(SYMBOLS)))
        stale = new.select("id").union(gone.select("id"))

        def kept(table: DataFrame, key: str) -> DataFrame:
            return table.where(F.col("repo_id").isin(touched)).join(stale.select(F.col("id").alias(key)), key, "left_anti").select(*table.columns)

        tables = {
            "files": kept(files, "id").unionByName(new.select(*_names(FILES))),
            "symbols": kept(_table(spark, folder, "symbols", stored), "file_id").unionByName(symbols),
        }
        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(lambda t: _write(tables[t], f"{folder.path}/{t}/version={version}"), tables))
        counters["symbols"] = seen.get["n"]
    folder.delete(work)
    return touched


def _write(df: DataFrame, path: str) -> None:
    """By repository, and inside by the name that is searched, for row-group statistics; hot repositories split by AQE."""
    order = "qual_norm" if "qual_norm" in df.columns else "path"
    df.hint("rebalance", "repo_id").sortWithinPartitions("repo_id", order).write.partitionBy("repo_id").parquet(path)


def _forget_older(spark: SparkSession, folder: Folder) -> None:
    """Deletes commits before the last ones, and versions of repositories that none of those names."""
    commits = _commits(folder)
    live: dict[str, set[int]] = {}
    for commit in commits[-KEPT_COMMITS:]:
        for r in _stored(spark, folder, commit).select("version", "id").collect():  # one row a repository
            live.setdefault(r.version, set()).add(r.id)
    for commit in commits[:-KEPT_COMMITS]:
        folder.delete(commit["name"])
        folder.delete(commit["repos"])
    for table in TABLES:
        for name in folder.names(table):
            version = name.partition("=")[2]
            if version not in live:
                folder.delete(f"{table}/{name}")
                continue
            for part in folder.names(f"{table}/{name}"):
                if part.startswith("repo_id=") and int(part[8:]) not in live[version]:
                    folder.delete(f"{table}/{name}/{part}")

"""Sources on a file system: repository discovery, git state, tracked files and their contents.

Discovery walks directories on the driver. Everything per repository or file runs in Arrow batches
on executors, spread by repository for git and by file for contents, so one giant repository is not
one task. Executors need to see the same paths (a shared file system on a cluster).
"""

from __future__ import annotations

import os
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symquarry.functions import paths as path_functions

STATES = "name string, root string, head string, dirty boolean, error string"
TRACKED = "name string, root string, path string, mtime_ns long, size long, error string"


class UnreadableRoot(Exception):
    """A start path can't be listed; nothing below it may be pruned."""


def discover(starts: list[str], nested: list[str] = ()) -> list[tuple[str, str]]:
    """Sorted distinct (name, root): a walk stops at the first ``.git``, but goes on below ``nested`` directories.

    Hidden directories and links to directories are skipped, and so are unreadable ones; an
    unreadable start path is an error.
    """
    below = [os.path.realpath(n) for n in nested]
    found: set[tuple[str, str]] = set()

    def walk(directory: str, parent: tuple[str, str] | None) -> None:
        try:
            entries = sorted(os.scandir(directory), key=lambda e: e.name)
        except OSError:
            return
        if any(e.name == ".git" for e in entries):
            name = os.path.basename(directory)
            if parent:
                name = f"{parent[0]}/{os.path.relpath(directory, parent[1])}"
            found.add((name, directory))
            real = os.path.realpath(directory)
            if not any(real == n or real.startswith(n + os.sep) or n.startswith(real + os.sep) for n in below):
                return
            parent = (name, directory)
        for e in entries:
            if not e.name.startswith(".") and e.is_dir(follow_symlinks=False):
                walk(e.path, parent)

    for start in starts:
        if not os.access(start, os.R_OK | os.X_OK):
            raise UnreadableRoot(start)
        walk(os.path.abspath(start), None)
    if below:
        inside = lambda r: any(os.path.realpath(r) == n or os.path.realpath(r).startswith(n + os.sep) for n in below)
        roots = sorted((r for _, r in found), key=len)
        return sorted((n, r) for n, r in found if inside(r) or not any(r != o and r.startswith(o + os.sep) for o in roots))
    return sorted(found)


def discovered(spark: SparkSession, starts: list[str], nested: list[str] = ()) -> DataFrame:
    return spark.createDataFrame(discover(starts, nested), "name string, root string")


def _git(root: str, *args: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=600)


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


def _states(batches):
    schema = [("name", pa.string()), ("root", pa.string()), ("head", pa.string()), ("dirty", pa.bool_()), ("error", pa.string())]
    for batch in batches:
        rows = []
        for name, root in zip(batch.column("name").to_pylist(), batch.column("root").to_pylist()):
            try:
                head = _git(root, "rev-parse", "--verify", "--quiet", "HEAD")
                status = _git(root, "status", "--porcelain", "--untracked-files=no")
                commit = head.stdout.decode().strip() if head.returncode == 0 else ""
                rows.append((name, root, commit or None, status.returncode != 0 or bool(status.stdout.strip()), None))
            except (OSError, subprocess.SubprocessError) as e:
                rows.append((name, root, None, True, str(e)))
        yield _batch(rows, schema)


def git_states(repos: DataFrame) -> DataFrame:
    """Commit and dirtiness of each repository; what can't be told counts as dirty."""
    spread = max(1, int(repos.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    return repos.select("name", "root").repartition(spread, "root").mapInArrow(_states, STATES)


def _listed(batches):
    schema = [("name", pa.string()), ("root", pa.string()), ("path", pa.string()), ("mtime_ns", pa.int64()), ("size", pa.int64()), ("error", pa.string())]
    for batch in batches:
        for name, root in zip(batch.column("name").to_pylist(), batch.column("root").to_pylist()):
            rows: list[tuple] = []
            done = None
            try:
                done = _git(root, "ls-files", "-z", "--stage")
            except (OSError, subprocess.SubprocessError) as e:
                rows.append((name, root, None, None, None, str(e)))
            if done is not None and done.returncode:
                rows.append((name, root, None, None, None, done.stderr.decode("utf-8", "replace").strip()))
                done = None
            seen = set()
            for entry in done.stdout.split(b"\0") if done else ():
                meta, _, raw = entry.partition(b"\t")
                if not raw or int(meta.split()[0], 8) & 0o170000 != 0o100000 or raw in seen:
                    continue
                seen.add(raw)
                path = raw.decode("utf-8", "replace")
                try:
                    state = os.lstat(os.path.join(root.encode(), raw))
                except OSError:
                    continue  # vanished
                if state.st_mode & 0o170000 == 0o100000:
                    rows.append((name, root, path, state.st_mtime_ns, state.st_size, None))
            yield _batch(rows, schema)


def tracked_files(repos: DataFrame, ignored=None) -> DataFrame:
    """Tracked regular files that exist, with their state; a repository that fails gives one row with its error."""
    spread = max(1, int(repos.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    rows = repos.select("name", "root").repartition(spread, "root").mapInArrow(_listed, TRACKED)
    return rows if ignored is None else rows.where(F.col("path").isNull() | ~ignored(F.col("path")))


def _contents(max_size: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                data, first = [], []
                for root, path, size in zip(*(part.column(c).to_pylist() for c in ("root", "path", "size"))):
                    content = None
                    if size <= max_size:
                        try:
                            with open(os.path.join(root, path), "rb") as f:
                                content = f.read()
                        except OSError:
                            content = None
                        if content is not None and b"\0" in content[:4096]:
                            content = None
                    data.append(content)
                    # Only a script's first line is needed, whatever its encoding and length.
                    first.append(content.split(b"\n", 1)[0].decode("utf-8", "replace") if content is not None and content.startswith(b"#!") else None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary()), pa.array(first, pa.string())], names=[*part.schema.names, "content", "first_line"])

    return run


def with_contents(files: DataFrame, max_size: int) -> DataFrame:
    """Adds content (null where too large, unreadable or binary) and lang, by name or else by the first line."""
    spread = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    schema = files.select("*", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("first_line")).schema
    rows = files.repartition(spread, "root", "path").mapInArrow(_contents(max_size), schema)
    scripts = F.when(~path_functions.basename(F.col("path")).contains("."), path_functions.shebang_language(F.col("first_line")))
    return rows.withColumn("lang", F.coalesce(path_functions.detect_language(F.col("path")), scripts)).drop("first_line")

"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN: dict[str, str] = {}
#: Rows of an Arrow batch: texts of some thousand bytes make a few MB.
ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster, where executors
    would not see such a folder, that is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if sc.applicationId not in _OWN:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="symquarry-")
        base = _OWN[sc.applicationId]
    if "://" not in base and base.startswith("/"):
        base = "file://" + base if sc.master.startswith("local") else base
    return f"{base.rstrip('/')}/symquarry-{sc.applicationId}"


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; the session's folder is removed at exit."""
    base = shared_dir(spark)
    if base not in _OWN:
        _OWN[base] = base
        atexit.register(_forget, spark, base)
    return f"{base}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    _forget(table.sparkSession, table._written_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def split_join(rows: DataFrame, keys: DataFrame, by: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keys``, an aggregate by the columns ``by``, the first a long, so that a hot key can be split.

    Adaptive execution splits a skewed side only where both sides come straight from an exchange. An
    aggregate by the join key has none of its own; joining by the complement of the key gives it one.
    """
    by = [by] if isinstance(by, str) else by
    flip = F.bitwise_not(F.col(by[0]))
    return rows.withColumn(by[0], flip).join(keys.withColumn(by[0], flip), by, how).withColumn(by[0], flip)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ARROW_ROWS rows unless the session sets its own number.

    Spark fills a batch before Python sees any of it, so slices alone don't bound what a task holds.
    """
    conf = df.sparkSession.conf
    if conf.get(_ARROW, "10000") == "10000":  # Spark's default
        conf.set(_ARROW, str(ARROW_ROWS))
    return df


def placed(rows: DataFrame, order: list[Column], sums: dict[str, str], label: str) -> DataFrame:
    """``rows`` in one global order without one task for all: adds, for each new name in ``sums``, the sum of its column before the row.

    Rows are range-partitioned by ``order``; running sums inside a partition and the totals of the
    partitions before it, one row each, add up. ``order`` should leave no ties but between equal rows.
    """
    n = max(1, shuffle_partitions(rows.sparkSession))
    ranged = written(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), label)
    totals = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__{new}") for new, c in sums.items()])
    run = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", *[F.coalesce(F.sum(f"__{new}").over(run), F.lit(0)).alias(f"__{new}") for new in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(new) for new, c in sums.items()])
    both = own.join(totals, "__part")
    return both.select(*rows.columns, *[(F.col(new) + F.col(f"__{new}")).alias(new) for new in sums])


def shared_files(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder below the shared one, for executors' own reads and writes."""
    return pafs.FileSystem.from_uri(folder)


def _text_bytes(batch: pa.RecordBatch) -> np.ndarray:
    held = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return held


def parts(batches, rows: int = 512, size: int = 8 << 20):
    """Arrow batches in slices of at most ``rows`` rows and about ``size`` bytes of text.

    What Python holds of a batch follows the slice, not Spark's batch size. A row longer than
    ``size`` is a slice of its own; no row is cut.
    """
    for batch in batches:
        upto = np.cumsum(_text_bytes(batch))
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            fits = int(np.searchsorted(upto, before + size, side="right"))
            end = min(max(fits, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end

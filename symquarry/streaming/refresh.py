"""Refreshes driven by a stream of change notices: one batch, one refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symquarry.sources import index
from symquarry.sources.config import Config

NOTICE = "root string, at timestamp"


def refresh_on_change(spark: SparkSession, notices_dir: str, index_dir: str, config: Config, checkpoint: str):
    """Starts a query over JSON notices that refreshes the repositories they name, once for all that have come, then stops.

    A notice without a root stands for all repositories. Reruns go on after the last finished batch; the refresh itself can be repeated without harm.
    """
    notices = spark.readStream.schema(NOTICE).json(notices_dir)

    def refresh(batch: DataFrame, _: int) -> None:
        roots = [r.root for r in batch.select("root").distinct().collect()]  # one row a repository at most
        if roots:
            index.refresh(spark, index_dir, config, roots=None if None in roots else roots)

    return notices.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

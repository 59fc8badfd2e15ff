"""Contiguous shards of near-equal bytes from global prefix sums; DataFrame operations only.

Documents are ordered by (hash of the text, doc_id), so equal texts lie together while a hot group
of copies still spreads over range partitions. Running sums inside each partition plus the totals
of the partitions before it give every document its global byte offset; shards are cut at equal
targets of the total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symquarry.llm.store import placed, written


def placements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key, pos, nth): byte offset and number of each row in the global order.

    size: UTF-8 bytes of the text plus 1; a null text has no bytes and the CRC of none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    order = [F.col("key"), F.col("doc_id").asc_nulls_first()]
    rows = placed(written(rows.withColumn("one", F.lit(1).cast("long")), "shard-sizes"), order, {"pos": "size", "nth": "one"}, "shard-ranges")
    return written(rows.drop("one"), "shard-places")


def cut_points(rows: DataFrame, shards: int, slack: float) -> list[int]:
    """Byte offsets at which shards 1, 2, ... begin: equal targets, moved to the nearer document edge.

    Where an edge between different texts lies within ``slack`` of a shard's target from that, the
    cut goes there, so that equal texts stay together. One rule holds for groups of any size: a cut
    deeper inside a group of copies splits it. At most a row per shard reaches the driver.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    middle = (2 * F.col("pos") + F.col("size")) * F.lit(shards)
    number = F.least(F.floor(middle / F.lit(2 * total)).cast("int"), F.lit(shards - 1))
    firsts = rows.groupBy(number.alias("shard")).agg(F.min(F.struct("pos", "key")).alias("f")).select("shard", "f.*").collect()
    begin = {r.shard: r for r in firsts if r.shard}
    keys = sorted({r.key for r in begin.values()})
    spans = {}
    if keys:
        end = (F.col("pos") + F.col("size")).alias("e")
        for r in rows.where(F.col("key").isin(keys)).groupBy("key").agg(F.min("pos").alias("b"), F.max(end).alias("e")).collect():
            spans[r.key] = (r.b, r.e)
    cuts, after = [], total
    for shard in range(shards - 1, 0, -1):
        if shard in begin:
            cut, (b, e) = begin[shard].pos, spans[begin[shard].key]
            edge = b if cut - b <= e - cut else e
            if abs(edge - cut) <= slack * total / shards:
                cut = edge
            after = min(after, cut)
        cuts.append(after)  # a shard without a document begins where the next one does
    return cuts[::-1]


def shard(docs: DataFrame, shards: int = 8, slack: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard null) for each row of ``docs``.

    Shards are contiguous in the order of (text hash, doc_id) and differ from equal bytes by about
    a document at each cut, or by a kept group of equal texts (see :func:`cut_points`). slot counts
    from 0 without gaps in that order. Null doc_ids come first among equal texts; repeated rows get
    a slot each; an empty table gives no rows, and with fewer rows than shards some stay empty.
    """
    rows = placements(docs, id_col, text_col)
    cuts = cut_points(rows, shards, slack)
    number = sum(((F.col("pos") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    rows = rows.withColumn("shard", number)
    base = {r.shard: r.n for r in rows.groupBy("shard").agg(F.min("nth").alias("n")).collect()}  # a row per shard
    first = F.lit(0).cast("long")
    for s, n in base.items():
        first = F.when(F.col("shard") == s, F.lit(n).cast("long")).otherwise(first)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("nth") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def with_shard(docs: DataFrame, shards: int = 8, slack: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column shard (int), without moving a text: cuts are compared as (text hash, doc_id).

    Rows alike in text and doc_id share a shard.
    """
    rows = placements(docs, id_col, text_col)
    cuts = cut_points(rows, shards, slack)
    begins = {}
    if cuts:
        at = F.lit(None).cast("int")
        for i, c in enumerate(cuts):
            at = F.when(F.col("pos") >= F.lit(c), F.lit(i + 1)).otherwise(at)
        low = F.min(F.struct("pos", "key", "doc_id")).alias("f")
        begins = {r.at: r.f for r in rows.groupBy(at.alias("at")).agg(low).collect() if r["at"]}
    key, i = F.xxhash64(F.coalesce(docs[text_col], F.lit(""))), docs[id_col].cast("long")
    number = F.lit(0)
    for s, f in sorted(begins.items()):
        later = i.isNotNull() if f.doc_id is None else i >= F.lit(f.doc_id)
        later = F.lit(True) if f.doc_id is None else F.coalesce(later, F.lit(False))
        number = F.when((key > F.lit(f.key)) | ((key == F.lit(f.key)) & later), F.lit(s)).otherwise(number)
    return docs.withColumn("shard", number)

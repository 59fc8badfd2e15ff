"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

All steps are DataFrame operations. Sizes are pre-aggregated per source before any shuffle, so a
source with a third of all rows costs one row a task. The fractional repetition of a source goes
through its documents in the order of a seeded hash and takes each that still fits. That is done in
rounds: the documents no larger than the gap are taken up to the first that overshoots, which is left
out, and the next round goes on behind it with the smaller gap. Where a round stops is found by words
per hash bucket and then inside one bucket, so that no source is ever sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symquarry.llm.store import discard, placed, written

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the seeded hash, of its leading part that numbers the buckets of a source, and of the part that numbers buckets inside one.
HASH_BITS, BUCKET_BITS, INNER_BITS = 48, 10, 12
#: A source whose taken words miss its target by no more than this share needs no further round.
CLOSE = 0.001
_LEAST_ID, _MOST_ID = -(1 << 63), (1 << 63) - 1
_SEGMENTS = "array<struct<limit:double,from:struct<h:bigint,i:bigint>,upto:struct<h:bigint,i:bigint>>>"


def word_count(text: Column) -> Column:
    """Words of the whole text, as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def seeded_hash(doc_id: Column, seed: int) -> Column:
    """48 bits of the MD5 of the seed and the id; a null id hashes as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Adds target to (source, source_size, weight): shares of the total size by weight, at most ``max_epochs`` sizes.

    Each round clamps every source whose share is above its cap and deals the rest out by weight,
    until none is above. Rounds are aggregations to one row; the table holds a row per source.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = -1.0
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        over = F.lit(level) * F.col("weight") >= cap
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("clamped"),
            F.sum(F.when(~over, F.col("weight")).otherwise(0)).alias("weight"),
        ).first()
        if not row.weight:
            break
        new = max((total - row.clamped) / row.weight, 0.0)
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(F.lit(max(level, 0.0)) * F.col("weight"), cap).cast("double"))


def _id_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(_LEAST_ID))


def _place(h: Column, doc_id: Column) -> Column:
    return F.struct(h.alias("h"), _id_key(doc_id).alias("i"))


def _ends(h: int, i: int) -> Column:
    return F.struct(F.lit(h).cast("long").alias("h"), F.lit(i).cast("long").alias("i"))


def _in_segments(segments: Column, size: Column, place: Column) -> Column:
    """Whether a round took a document: its size fits the round's gap and its place the round's range."""
    return F.exists(segments, lambda s: (place > s["from"]) & (place <= s["upto"]) & (size <= s["limit"]))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _overshot(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(words per bucket, bucket where the first document overshoots) of rows (source, b, size, gap).

    The second has source, b and rest, which is the gap that the buckets before it leave.
    """
    words = written(rows.groupBy("source", "b", "gap").agg(F.sum("size").alias("words")), label)
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    run = words.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    stop = run.where("before <= gap and before + words > gap").select("source", "b", (F.col("gap") - F.col("before")).alias("rest"))
    return words, stop


def _inside(rows: DataFrame, stop: DataFrame) -> DataFrame:
    """The rows of the buckets of ``stop``, whose gap is the rest there."""
    on = _same("s", "t") & (F.col("s.b") == F.col("t.b"))
    return rows.alias("s").join(stop.alias("t"), on).select("s.source", "s.size", "p", F.col("rest").alias("gap"))


def _round(sized: DataFrame, fills: DataFrame) -> DataFrame:
    """One round for the open rows of ``fills`` (source, target, gap, at, segments, open)."""
    outer, inner = HASH_BITS - BUCKET_BITS, HASH_BITS - BUCKET_BITS - INNER_BITS
    rows = sized.where("size > 0").withColumn("p", _place(F.col("h"), F.col("doc_id"))).alias("s").join(fills.where("open").alias("f"), _same("s", "f"))
    rows = rows.where("size <= gap and p > at").select("s.source", "s.size", "p", F.shiftright("s.h", outer).alias("b"), "gap")
    words, stop = _overshot(rows, "mix-buckets")
    rows = _inside(rows, stop).withColumn("b", F.shiftright("p.h", inner))
    rows = written(rows, "mix-inside")
    _, stop = _overshot(rows, "mix-inner")
    inside = _inside(rows, stop.select("source", "b", "rest")).groupBy("source", "gap", "p").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("upto", upto)
    fits = F.col("upto") <= F.col("gap")
    cut = inside.groupBy("source", F.col("gap").alias("rest")).agg(
        F.max(F.when(fits, F.col("p"))).alias("last"), F.max(F.when(fits, F.col("upto"))).alias("held"),
        F.min(F.when(~fits, F.col("p"))).alias("over"), F.min("p.h").alias("h"),
    )
    all_ = words.groupBy("source").agg(F.sum("words").alias("words"))
    joined = fills.alias("f").join(cut.alias("c"), _same("f", "c"), "left").join(all_.alias("a"), _same("f", "a"), "left")
    # Where nothing of the bucket fits, the last one taken lies before it.
    none_inside = F.struct((F.shiftleft(F.shiftright("c.h", inner), inner) - 1).alias("h"), F.lit(_MOST_ID).alias("i"))
    upto = F.when(F.col("c.over").isNull(), _ends((1 << HASH_BITS), _MOST_ID)).otherwise(F.coalesce("c.last", none_inside))
    segment = F.struct(F.col("gap").alias("limit"), F.col("at").alias("from"), upto.alias("upto"))
    gap = F.when(F.col("c.over").isNull(), F.col("gap") - F.col("a.words")).otherwise(F.col("rest") - F.coalesce("held", F.lit(0)))
    moved = F.col("open") & F.col("a.words").isNotNull()
    return joined.select(
        "f.source", "target",
        F.when(moved, gap).otherwise(F.col("gap")).alias("gap"),
        F.when(moved, F.coalesce("c.over", "at")).otherwise(F.col("at")).alias("at"),
        F.when(moved, F.concat("segments", F.array(segment))).otherwise(F.col("segments")).cast(_SEGMENTS).alias("segments"),
        # Whoever found nothing that fits, or took all that fits, is done.
        (moved & F.col("c.over").isNotNull() & (gap > F.lit(CLOSE) * F.col("target"))).alias("open"),
    )


def _last(sized: DataFrame, fills: DataFrame) -> DataFrame:
    """Adds one more document where that comes nearer to the target: the smallest left out, if it overshoots by less than the gap."""
    place = _place(F.col("h"), F.col("doc_id"))
    rows = sized.where("size > 0").withColumn("p", place).alias("s").join(fills.alias("f"), _same("s", "f"))
    rows = rows.where(~_in_segments(F.col("segments"), F.col("size"), F.col("p")) & (F.col("size") < 2 * F.col("gap")))
    rows = rows.groupBy("s.source", "gap", "p").agg(F.sum("size").alias("words")).where("words < 2 * gap")
    best = rows.groupBy("source").agg(F.min(F.struct("words", "p")).alias("x"))
    return fills.alias("f").join(best.alias("b"), _same("f", "b"), "left").select("f.source", "segments", F.col("x.p").alias("extra"))


def mixing_plan(docs: DataFrame, *, seed: int = 7, max_epochs: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sized documents, plan per source) of a mix that shares the words of ``docs`` out by weight.

    Sources go by code point, null last, and weigh ``weights`` in turn. Sized documents: doc_id,
    source, size, h. Plan: source, source_size, weight, target, whole, segments, extra; a document
    is taken ``whole`` times, and once more if a round took it (segments) or it is the extra one.
    So a source misses its target by CLOSE of it at most, or by half of its smallest document that is left out.
    A null text or one of white space only has size 0 and is never taken; documents with one doc_id
    in one source are cut alike; an empty table gives an empty plan.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")
    )
    sized = written(sized.withColumn("h", seeded_hash(F.col("doc_id"), seed)), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    rank = placed(totals, [F.col("source").asc_nulls_last()], {"rank": "one"}, "mix-sources")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    plan = water_fill(written(rank.select("source", "source_size", turn.alias("weight")), "mix-weights"), max_epochs)
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("whole", F.floor("rate").cast("long"))
    plan = written(plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    fills = plan.where("need > 0").select(
        "source", "target", F.col("need").alias("gap"), _ends(-1, _MOST_ID).alias("at"), F.array().cast(_SEGMENTS).alias("segments"), F.lit(True).alias("open")
    )
    fills = written(fills, "mix-fill")
    while not fills.where("open").isEmpty():
        before, fills = fills, written(_round(sized, fills), "mix-fill")
        discard(before)
    last = written(_last(sized, fills), "mix-last")
    plan = plan.alias("p").join(last.alias("c"), _same("p", "c"), "left").select(
        "p.source", "source_size", "weight", "target", "whole", F.coalesce("segments", F.array().cast(_SEGMENTS)).alias("segments"), "extra"
    )
    return sized, written(plan, "mix-cuts")


def repetitions(size: Column, h: Column, doc_id: Column, plan: str = "") -> Column:
    """How often a document with words is taken, beside its plan's columns (named with the prefix ``plan``)."""
    place = _place(h, doc_id)
    more = _in_segments(F.col(f"{plan}segments"), size, place) | F.coalesce(F.col(f"{plan}extra") == place, F.lit(False))
    return F.col(f"{plan}whole") + more.cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``: see :func:`mixing_plan`."""
    sized, plan = mixing_plan(docs, **options)
    rows = sized.alias("d").join(plan.alias("p"), _same("d", "p"))
    taken = repetitions(F.col("d.size"), F.col("h"), F.col("d.doc_id")) * F.col("d.size")
    return rows.select("d.doc_id", "d.size", "p.source_size", "p.target", taken.alias("taken"))


def mixed_rows(docs: DataFrame, *, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``.

    Texts are not shuffled unless the plan, a row per source, is too large to broadcast by Spark's own limit.
    """
    _, plan = mixing_plan(docs, seed=seed, id_col=id_col, source_col=source_col, **options)
    text = options.get("text_col", "text")
    plan = plan.select(F.col("source").alias("__mix_source"), F.struct("whole", "segments", "extra").alias("__mix"))
    rows = docs.join(plan, docs[source_col].cast("string").eqNullSafe(plan["__mix_source"]))
    i = docs[id_col].cast("long")
    # Words are counted only for documents in the range of a round.
    times = repetitions(word_count(docs[text]), seeded_hash(i, seed), i, "__mix.")
    rows = rows.withColumn("__mix_n", F.when(docs[text].rlike(WORD), times).otherwise(F.lit(0).cast("long")).cast("int")).where("__mix_n > 0")
    rows = rows.withColumn("__mix_i", F.explode(F.array_repeat(F.lit(1), F.col("__mix_n"))))
    return rows.select(*[docs[c] for c in docs.columns])

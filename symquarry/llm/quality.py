"""Quality by hierarchical empirical Bayes: classifier evidence, site and section posteriors.

A logistic regression over text statistics gives each document's evidence. Evidence is averaged per
site and per section of a site by grouped aggregation; a site's mean is shrunk toward the global
mean, and a section's toward its site's, by prior strengths estimated from the spread between
groups. The score adds the section's shrunken log odds, relative to the global ones, to the evidence.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symquarry.llm.store import bounded_batches, parts, written
from symquarry.llm.toxicity import held_out, logistic

FEATURES = 14
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_GROUPS = [b"!", b"|", b"#$%&*", b"0123456789", b".,;:?", b"@/\\<>{}[]=_+", b"\n"]


def statistics(text: bytes | None) -> list[float]:
    """Shares of character groups, repetition of words and lines, lengths; of the whole text."""
    text = text or b""
    if not text:
        return [0.0] * FEATURES
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    many = max(len(words), 1)
    same = sum(map(bytes.__eq__, words, words[1:])) / many
    return [
        *(math.log1p(100.0 * sum(int(counts[c]) for c in group) / n) for group in _GROUPS),
        float(counts[_UPPER].sum()) / n,
        math.log1p(many),
        n / many / 10.0,
        len(set(words)) / many,
        same,
        len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
    ]


def _measured(coefficients: np.ndarray | None):
    """Batches of (keys..., text): features with the label, or the evidence in log odds."""

    def run(batches):
        for batch in parts(batches):
            rows = [statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            keys, names = batch.columns[:-1], batch.schema.names[:-1]
            if coefficients is None:
                yield pa.RecordBatch.from_arrays([*keys, pa.array(rows, pa.list_(pa.float64()))], names=[*names, "x"])
            else:
                x = np.array(rows, float).reshape(-1, FEATURES)
                z = np.clip(coefficients[0] + x @ coefficients[1:], -12.0, 12.0)
                yield pa.RecordBatch.from_arrays([*keys, pa.array(z)], names=[*names, "z"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Coefficients from about ``sample_rows`` labelled rows at most (a share of ids by hash), none of them held out.

    Of rows that repeat an id the one with the greatest text teaches; rows without an id or label teach nothing.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality")).where("quality is not null and __id is not null")
    known = known.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("quality").alias("quality"))
    share = int(1_000_000 * min(1.0, sample_rows / max(known.count(), 1)))
    known = known.where(F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(1_000_000)) < share)
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(known), "__id")
    rows = rows.groupBy("__id", "quality").agg(F.max("text").alias("text")).select("quality", "text").mapInArrow(_measured(None), "quality int, x array<double>").collect()
    coefficients = np.zeros(FEATURES + 1)
    if rows and 0 < sum(r.quality for r in rows) < len(rows):
        coefficients = logistic(np.array([r.x for r in rows]), np.array([r.quality for r in rows], float))
    return coefficients


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength by moments: how many documents of evidence the spread between groups is worth."""
    row = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("p") / F.col("n") - F.col(mean)) ** 2).alias("between"),
        F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("pp").alias("pp"), F.sum(F.col("p") * F.col("p") / F.col("n")).alias("group_pp"),
    ).first()
    if not row.n or row.k < 2 or row.n <= row.k:
        return 100.0
    within = max((row.pp - row.group_pp) / (row.n - row.k), 1e-9)
    usual = (row.n - row.nn / row.n) or 1.0
    spread = max((row.between - (row.k - 1) * within) / usual, 1e-9)
    return float(min(max(within / spread, 1.0), 1e6))


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without ``www.``; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The first segment of a URL's path; empty where the path has none, null where there is no host."""
    return F.when(host_of(url).isNotNull(), F.regexp_extract(url, r"^[^/]*//[^/?#]*/([^/?#]*)", 1))


def score(docs: DataFrame, coefficients: np.ndarray, *, site: Column, section: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, evidence, site_posterior, section_posterior, score, keep) for each row of ``docs``.

    ``site`` and ``section`` are the two levels, :func:`host_of` and :func:`path_of` where rows have URLs. Null sites and sections are groups of their own; a null text has the statistics of an empty one.
    Only ids, group names and evidence are shuffled; groups are aggregated before the shuffle.
    """
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), site.cast("string").alias("site"), section.cast("string").alias("section"), F.col(text_col).cast("binary").alias("text"))
    schema = "doc_id long, site string, section string, z double"
    rows = written(rows.mapInArrow(_measured(coefficients), schema), "quality-evidence")
    p = 1 / (1 + F.exp(-F.col("z")))
    groups = written(rows.groupBy("site", "section").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("p"), F.sum(p * p).alias("pp")), "quality-groups")
    total = groups.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    mean = total.p / total.n if total.n else 0.5
    sites = groups.groupBy("site").agg(*[F.sum(c).alias(c) for c in ("n", "p", "pp")]).withColumn("mean", F.lit(mean))
    k1 = _strength(sites, "mean")
    sites = sites.select("site", ((F.lit(k1 * mean) + F.col("p")) / (F.lit(k1) + F.col("n"))).alias("site_posterior"))
    same = lambda a, b, c: F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    both = groups.alias("g").join(sites.alias("s"), same("g", "s", "site")).select("g.*", "site_posterior")
    k2 = _strength(both, "site_posterior")
    both = both.select("site", "section", "site_posterior", ((F.lit(k2) * F.col("site_posterior") + F.col("p")) / (F.lit(k2) + F.col("n"))).alias("section_posterior"))
    # Written, the join with a hot group's documents is one that adaptive execution can split.
    both = written(both, "quality-posteriors")
    out = rows.alias("d").join(both.alias("g"), same("d", "g", "site") & same("d", "g", "section"))
    z = F.col("d.z") + _log_odds(F.col("section_posterior")) - F.lit(math.log(min(max(mean, 1e-4), 1 - 1e-4) / (1 - min(max(mean, 1e-4), 1 - 1e-4))))
    out = out.select("d.doc_id", held_out(F.col("d.doc_id")).alias("held_out"), p.alias("evidence"), "site_posterior", "section_posterior", (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("keep", F.col("score") >= threshold)

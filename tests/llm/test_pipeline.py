"""The pipeline against each stage done in plain Python on what the stage before kept."""

import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from symquarry.llm import toxicity
from symquarry.llm.registry import ORACLE_SQL
from tests.llm.test_brute_force import copies_by_all_pairs, shingles

SF = "/root/testdata/sf0.01"


def hit_by(windows, text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return any(tuple(words[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(words) - n + 1))


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grammar = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    out = corpus_pipeline.run(spark, SF).collect()
    rows = {r.doc_id: r for r in docs.collect()}
    # Toxicity: the grammar is learned; each text is scored on its own.
    kept = [i for i, r in rows.items() if grammar.score(r.text) < toxicity.THRESHOLD]
    assert 0.5 * len(rows) < len(kept) < len(rows)
    # Near copies: all pairs of shingle sets.
    classes = copies_by_all_pairs({i: shingles(rows[i].text) for i in kept})
    kept = [i for i in kept if classes[i] == i]
    # Benchmark windows: every place of every text.
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").lower())
        windows |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))} if words else set()
    clean = [i for i in kept if not hit_by(windows, rows[i].text)]
    assert len(clean) < len(kept) < len(rows)
    # The mix, in SQL.
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, rows[i].text, rows[i].source) for i in clean], columns=["doc_id", "text", "source"]))
    mixed = con.sql(ORACLE_SQL["op1_mixing"]).df()
    times = {int(i): int(t // n) for i, n, t in zip(mixed.doc_id, mixed["size"], mixed.taken) if t}
    assert Counter(r.doc_id for r in out) == times
    assert all(r.text == rows[r.doc_id].text and r.source == rows[r.doc_id].source and r.lang == rows[r.doc_id].lang for r in out)
    # Shards: contiguous in one order and nearly equal.
    sizes, order = defaultdict(int), defaultdict(list)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    for r in out:
        sizes[r.shard] += len((r.text or "").encode()) + 1
        order[r.shard].append((hashes[r.doc_id], r.doc_id))
    share = sum(sizes.values()) / 8
    assert sorted(sizes) == list(range(8)) and all(abs(n - share) < 0.2 * share for n in sizes.values())
    assert all(max(order[s]) < min(order[s + 1]) for s in range(7))
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(50), SF).columns == docs.columns

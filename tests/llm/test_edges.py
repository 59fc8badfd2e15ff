"""Nulls in any column, empty and long texts, ties and repeated rows, empty tables, clashing columns."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symquarry.llm import ann, decontaminate, line_dedup, mixing, quality, secrets, sharding, simhash, store, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, shard int, key string, z double, h string, part int"
ROWS = [
    (1, "one two three four five six seven", "en", "a", 1), (1, "one two three four five six seven", "en", "a", 1), (2, None, None, None, None),
    (None, "one two three four five six seven", "en", "a", 1), (None, None, None, None, None), (3, "", "en", "b", 0), (4, " \t\n ", "en", "b", 3),
    (5, "word " * 40000, "fr", None, 9), (6, "x", "de", "c", 1), (7, "one two three four five six seven", "es", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "s", 1, "k", 0.5, "h", 3) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (5, 0, 1), (6, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "two three four"), (2, None), (None, "zzz"), (3, "")], "item_id long, text string")


def operators(labels, benchmark):
    return {
        "mixing": mixing.mix, "mixed": mixing.mixed_rows, "shard": sharding.shard, "with_shard": sharding.with_shard, "simhash": simhash.near_duplicate_classes,
        "copies": simhash.one_of_each, "secrets": lambda d: secrets.secrets_digest(secrets.secrets(d)), "lines": line_dedup.dedup_lines,
        "decontaminate": lambda d: decontaminate.contamination_digest(decontaminate.contamination(d, benchmark)), "clean": lambda d: decontaminate.clean_documents(d, benchmark),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)), "without_toxic": lambda d: toxicity.without_toxic(d, toxicity.fit(d, labels)),
        "quality": lambda d: quality.score(d, quality.fit(d, labels), site=F.col("source"), section=F.col("lang")),
    }


NAMES = sorted(operators(None, None))
PER_ROW = {"mixing", "shard", "with_shard", "simhash", "secrets", "lines", "decontaminate", "toxicity", "quality"}


@pytest.fixture(scope="module")
def odd_pages(spark):
    """Pages and vectors in one table, with nulls, repeats, a very long page and columns that the operators use themselves."""
    rows = [
        (1, "http://a.example/x", "same", [1.0, 0.0]), (1, "http://a.example/x", "same", [1.0, 0.0]), (2, None, None, None), (None, "http://b.example", "same", [0.5, 0.5]),
        (None, None, None, [1.0, 1.0]), (50, "", "", [0.0, 2.0]), (4, "http://a.example/x", "page " * 200_000, [1.0, 2.0]), (100, "not a url[", "same", [1.0, 2.0]),
    ]
    extra = "digest string, first long, same string, sha string, k long, file string, offset long, ids array<long>, vector string, codes string, cell int, block int, score double, rank int"
    schema = f"page_id long, url string, html string, embedding array<double>, {extra}"
    return spark.createDataFrame([(*r, "d", 1, "s", "h", 2, "f", 3, [4], "v", "c", 5, 6, 0.5, 7) for r in rows], schema)


def test_odd_pages(odd_pages):
    out = warc.round_trip(odd_pages).collect()
    sizes = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in out)
    expected = [("1", 4, "response", None)] * 2 + [("2", 0, "response", None), ("4", 1_000_000, "response", None), ("50", 0, "revisit", 2), ("100", 4, "revisit", 1), ("None", 4, "response", None), ("None", 0, "response", None)]
    assert sizes == sorted(expected)


def test_odd_vectors(odd_pages):
    out = ann.search(odd_pages.withColumn("vec_id", F.col("page_id")), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out] == [(50, 1, 4), (50, 2, 100), (50, 3, 1), (100, 1, 4), (100, 2, 50), (100, 3, 1)]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(odd, labels, benchmark, name):
    out = operators(labels, benchmark)[name](odd)
    rows = out.collect()
    if name in PER_ROW:
        assert len(rows) == len(ROWS)
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(r[0]) for r in ROWS)
    if name in ("mixed", "copies", "clean", "without_toxic"):
        assert out.columns == odd.columns


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(empty, labels, benchmark, name):
    assert operators(labels, benchmark)[name](empty).collect() == []


def test_many_lines_matches_and_candidates_in_one_text(spark):
    text = "\n".join(f"token=abcdef{i} AKIA{'A' * 16} {'0123456789abcdef' * 2} kJ{i}hGfDsAqWeRtYu7IoPzXcV one two three four five six" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    row = secrets.secrets_digest(secrets.secrets(df)).first()
    assert (row.n_assign, row.n_access, row.n_hex) == (20_000, 20_000, 20_000) and row.spans.count("entropy:") == 20_000
    assert {(r.doc_id, r.n_removed) for r in line_dedup.dedup_lines(df).collect()} == {(1, 0), (2, 20_000)}


def test_defined_results(odd, benchmark):
    assert {r.size for r in mixing.mix(odd).where("doc_id in (2, 3, 4)").collect()} == {0}
    kept = [r.doc_id for r in simhash.one_of_each(odd).collect()]
    # Copies of 1 go, repeated rows of the smallest id and rows without an id stay; of the empty texts one stays.
    assert sorted(map(str, kept)) == sorted(["1", "1", "None", "None", "2", "5", "6"])
    fps = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicate_classes(odd).collect()}
    assert fps[2] == fps[3] == fps[4] == ("0" * 16, 2) and fps[7][1] == 1
    hit = {r.doc_id: r.contaminated for r in decontaminate.contamination_digest(decontaminate.contamination(odd, benchmark)).collect()}
    assert hit[1] and hit[7] and not hit[2] and not hit[3] and not hit[5]
    assert decontaminate.clean_documents(odd, benchmark).count() == 6
    assert decontaminate.clean_documents(odd, benchmark.limit(0)).count() == len(ROWS)
    lines = {str(r.doc_id): (r.n_lines, r.n_removed, r.words_removed) for r in line_dedup.dedup_lines(odd).collect()}
    # Of a word that repeats on one line the first pieces stay.
    assert lines["2"] == (0, 0, 0) and lines["3"] == (1, 0, 0) and lines["1"] == lines["None"] == (1, 0, 0) or lines["None"][1:] == (0, 0)
    assert 0 < 40000 - lines["5"][2] <= 3 * line_dedup.PIECE * line_dedup.GRAM
    slots = [(r.shard, r.slot) for r in sharding.shard(odd).collect()]
    assert len(set(slots)) == len(ROWS)


def test_a_hot_group_is_cut(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, F.lit("same text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    sizes = [r["sum(size)"] for r in sharding.shard(rows).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 40


def test_copies_at_a_cut_stay_together_where_the_edge_is_near(spark):
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.floor(F.col("id") / 4)).alias("text"))
    out = sharding.shard(rows).join(rows, "doc_id").groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1")
    assert out.count() == 0


def test_no_vectors_and_no_pages(spark):
    none = spark.createDataFrame([(1, None), (50, [0.0])], "vec_id long, embedding array<float>")
    assert ann.search(none, F.col("vec_id") % 50 == 0).collect() == []
    assert ann.search(none.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string, digest string, first long")
    assert warc.round_trip(pages).collect() == []


def test_slices_hold_bounded_text_and_every_row():
    texts = ["a" * 10, None, "b" * 500, "", "c" * 30, "d" * 30, "e" * 200]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["id", "text"])
    cut = list(store.parts(iter([batch, batch.slice(0, 0), batch.slice(4)]), rows=3, size=64))
    assert [p.column(1).to_pylist() for p in cut] == [texts[:2], texts[2:3], texts[3:6], texts[6:], texts[4:6], texts[6:]]
    assert [p.num_rows for p in store.parts([batch], rows=3)] == [3, 3, 1]


def test_split_join_is_the_plain_join(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([7] * 20 + [1, 2, -5, None])], "k long, i int")
    keys = rows.groupBy("k").agg(F.min("i").alias("first"))
    pairs = lambda d: sorted(map(tuple, d.select("k", "i", "first").collect()))
    assert pairs(store.split_join(rows, keys, "k")) == pairs(rows.join(keys, "k"))


def test_warc_page_ids_that_repeat_with_other_payloads(spark):
    rows = [(1, "u", "a"), (5, "u", "a"), (5, "u", "b"), (2, "u", "b"), (5, "u", "c"), (6, "u", None), (7, "u", "")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    expected = [(1, "a", None), (2, "b", None), (5, "a", 1), (5, "b", 2), (5, "c", None), (6, "", None), (7, "", 6)]
    digest = lambda x: warc.payload_digest(x.encode())
    assert sorted((r.page_id, r.payload_digest, r.refers_to or 0) for r in got) == sorted((i, digest(x), f or 0) for i, x, f in expected)

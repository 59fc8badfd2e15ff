import random

import pytest
from pyspark.sql import functions as F

from symquarry.functions import names

CASES = {
    "FooBar": "foo_bar", "HTTPServer": "http_server", "utf8Decoder": "utf_8_decoder", "MAX_RETRIES": "max_retry", "UserPolicies": "user_policy",
    "business": "business", "its": "its", "classes": "classe", "": "", "lib/user.rb": "lib_user_rb", "a--b::c d\te": "a_b_c_d_e", "x\ny": "x\ny", "ties": "ty", "pies": "py",
}


def test_normalize(spark):
    rows = spark.createDataFrame([(k,) for k in CASES] + [(None,)], "raw string").select("raw", names.normalize(F.col("raw")).alias("n")).collect()
    assert {r.raw: r.n for r in rows} == CASES | {None: None}
    assert {k: names.normalize_text(k) for k in CASES} == CASES


def test_driver_twin_agrees(spark):
    rng = random.Random(4)
    raws = sorted({"".join(rng.choice("abAB12_-./: sieSé") for _ in range(rng.randint(0, 14))) for _ in range(800)})
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", names.normalize(F.col("raw")).alias("n")).collect()
    assert [(r.raw, r.n) for r in rows if names.normalize_text(r.raw) != r.n] == []


def _scan(text, word, whole):
    at = text.find(word) if word else -1
    while at >= 0:
        end = at + len(word)
        if (at == 0 or text[at - 1] == "_") and (not whole or end == len(text) or text[end] == "_"):
            return True
        at = text.find(word, end)
    return False


def test_boundary_predicates(spark):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("ab_") for _ in range(rng.randint(0, 9))) for _ in range(300)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for word in ("a", "ab", "a_a", "b_a", "", "a.b"):  # normal forms begin and end with no underscore
        t = F.col("t")
        rows = df.select("t", names.contains_at_boundary(t, word).alias("b"), names.contains_whole_tokens(t, word).alias("w")).collect()
        assert [(r.b, r.w) for r in rows] == [(_scan(r.t, word, False), _scan(r.t, word, True)) for r in rows]


def test_filter_overlaps_but_specificity_does_not(spark):
    df = spark.createDataFrame([("xa_a_a",)], "q string")
    row = df.select(names.boundary_prefix(F.col("q"), "a_a").alias("f"), names.contains_at_boundary(F.col("q"), "a_a").alias("s")).first()
    assert row.f and not row.s


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_spans_and_painting(spark):
    spans = lambda raw: [tuple(s)[1:] for s in one(spark, names.token_spans(F.lit(raw)))]
    found = lambda raw, words: [tuple(s) for s in one(spark, names.match_spans(F.lit(raw), words))]
    painted = lambda raw, words, sgr: one(spark, names.paint_matches(F.lit(raw), words, sgr))
    assert spans("FooBar") == [(0, 3), (3, 6)]
    assert spans("lib/user.rb") == [(0, 3), (4, 8), (9, 11)]
    assert found("UserPolicies", ["policy"]) == [(4, 12)]
    assert found("lib/user.rb", ["lib_user"]) == [(0, 8)]
    assert found("lib/user.rb", ["lib", "rb"]) == [(0, 3), (9, 11)]
    assert found("superuser", ["user"]) == [] and found("", ["user"]) == [] and found("user", []) == []
    # Bytes, not characters.
    assert found("日本Word", ["日"]) == [(0, 10)] and found("é/User", ["user"]) == [(3, 7)]
    assert found("a_b_a_b_c", ["a_b_c"]) == [(4, 9)] and found("a_a_a", ["a_a"]) == [(0, 5)]
    assert painted("é/UserPolicies x", ["policy"], "31") == "é/User\x1b[31mPolicies\x1b[0m x"
    assert painted("x", [], "31") == painted("x", ["x"], " ") == "x"
    assert one(spark, names.match_spans(F.lit(None).cast("string"), ["x"])) is None
    assert names.paint_line("a\x1b[0mb", "7") == "\x1b[7ma\x1b[0m\x1b[7mb\x1b[0m"


def test_spans_rebuild_the_normal_form(spark):
    rng = random.Random(7)
    raws = sorted({"".join(rng.choice("abAB1_-/é s") for _ in range(rng.randint(0, 16))) for _ in range(400)})
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", names.token_spans(F.col("raw")).alias("t"), names.normalize(F.col("raw")).alias("n")).collect()
    for r in rows:
        assert "_".join(t.token for t in r.t) == r.n
        assert all(t.start < t.end for t in r.t) and all(x.end <= y.start for x, y in zip(r.t, r.t[1:]))
        assert all(names.normalize_text(r.raw.encode()[t.start : t.end].decode()) == t.token for t in r.t)


def test_spans_cover_what_words_touch(spark):
    """Against marks made by looking for each word in the joined tokens, character by character."""
    rng = random.Random(11)
    raws = sorted({"_".join(rng.choice(["a", "ab", "abc", "b", "ba"]) for _ in range(rng.randint(1, 6))) for _ in range(200)})
    words = ["a", "ab", "a_b", "ab_a", "b_a_a"]
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", names.match_spans(F.col("raw"), words).alias("s")).collect()
    for r in rows:
        touched = set()
        for w in words:
            for at in range(len(r.raw)):
                if r.raw.startswith(w, at) and (at == 0 or r.raw[at - 1] == "_"):
                    touched.update(range(at, at + len(w)))
        expected, at, last = [], 0, False
        for token in r.raw.split("_"):
            hit = any(i in touched for i in range(at, at + len(token)))
            if hit and last:
                expected[-1] = (expected[-1][0], at + len(token))
            elif hit:
                expected.append((at, at + len(token)))
            last, at = hit, at + len(token) + 1
        assert [tuple(s) for s in r.s] == expected


@pytest.mark.parametrize("kind,rank", [("class", 0), ("file", 2), ("image", 12), ("other", 99)])
def test_kind_rank(spark, kind, rank):
    assert spark.range(1).select(names.kind_rank(F.lit(kind)).alias("r")).first().r == rank

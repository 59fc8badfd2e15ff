import pytest
from pyspark.sql import functions as F

from symquarry.functions.names import normalize_text as n
from symquarry.plans import parser, render, search, stats

REPOS = [(1, "acme-api", "/src/acme-api", "abc", False, 0), (2, "acme-api-next", "/src/next", None, True, 0)]
FILES = [(1, 1, "app/policy.rb"), (2, 1, "README.md"), (3, 1, "docs/badge.md"), (4, 2, "docs/badge_long.md")]
CODE = [
    (11, 1, 3, "class", "Badge", None), (12, 1, 4, "method", "badge", None), (13, 1, 5, "class", "Badges2x", None), (14, 1, 6, "method", "badge_of", None),
    (15, 1, 7, "const", "LIMIT", "Badge"), (16, 3, 1, "method", "unrelated", None), (17, 1, 9, "func", "superbadge", None),
]


@pytest.fixture(scope="module")
def tables(spark):
    repos = spark.createDataFrame(REPOS, "id long, name string, root string, head string, dirty boolean, indexed_at long")
    rows = [(i, r, i, None, "file", p, None, n(p), n(p), p, n(p)) for i, r, p in FILES]
    by_id = {i: (r, p) for i, r, p in FILES}
    for i, f, line, kind, name, scope in CODE:
        r, p = by_id[f]
        rows.append((i, r, f, line, kind, name, scope, n(name), n("::".join(filter(None, (scope, name)))), p, n(p)))
    symbols = spark.createDataFrame(rows, "id long, repo_id long, file_id long, line int, kind string, name string, scope string, name_norm string, qual_norm string, path string, path_norm string")
    files = spark.createDataFrame([(i, r, p, n(p), 0, 0, None) for i, r, p in FILES], "id long, repo_id long, path string, path_norm string, mtime_ns long, size long, lang string")
    return symbols, repos, files


def ids(df):
    return [r.id for r in df.collect()]


def test_ranking_order(tables):
    symbols, repos, _ = tables
    # exact class, exact method, leaf-prefix class, leaf-prefix method, qualified only; then files; then path-assisted
    assert ids(search.search(symbols, repos, "badge")) == [11, 12, 13, 14, 15, 3, 4, 16]
    assert ids(search.search(symbols, repos, "badge", limit=2)) == [11, 12]


def test_filters_and_sigils(tables):
    symbols, repos, _ = tables
    assert ids(search.search(symbols, repos, "@meth badge")) == [12, 14, 16]
    assert ids(search.search(symbols, repos, "acme-api-next: badge")) == [4]
    assert sorted(ids(search.search(symbols, repos, "ACME: badge"))) == [3, 4, 11, 12, 13, 14, 15, 16]
    assert ids(search.search(symbols, repos, "aa: badge", abbreviations={"aa": "acme-api-next"})) == [4]
    assert ids(search.search(symbols, repos, "docs/badge"))[0] == 3
    assert len(ids(search.search(symbols, repos, ""))) == len(FILES) + len(CODE)


def test_echo_drop_forms_agree(tables):
    symbols, repos, _ = tables
    rows = search.matches(symbols, repos, parser.parse(repos, "policy"))
    assert sorted(ids(search.drop_echoes(rows))) == sorted(ids(search.drop_echoes_anti(rows)))
    rows = search.matches(symbols, repos, parser.parse(repos, "policy badge"))
    assert 1 not in ids(search.drop_echoes(rows)) and 11 in ids(search.drop_echoes(rows))


def test_parse_errors(tables):
    _, repos, _ = tables
    for text, message in (("@c x", "ambiguous"), ("@zzz", "unknown kind"), ("@", "unknown kind"), ("nope: x", "unknown repository")):
        with pytest.raises(parser.QueryError, match=message):
            parser.parse(repos, text)
    q = parser.parse(repos, "Foo::Bar x")
    assert q.repo_ids is None and q.term == "Foo::Bar x"
    assert parser.resolve_kind("HEAD") == "heading"


def test_landing_and_candidates(tables):
    symbols, repos, _ = tables
    assert ids(search.candidates(symbols, repos, " ")) == [2]
    assert ids(search.candidates(symbols, repos, "@zzz")) == []
    assert ids(search.candidates(symbols, repos, "badge", limit=1)) == [11]


def test_sinks(tables):
    symbols, repos, _ = tables
    rows = search.search(symbols, repos, "badge")
    tsv = {r.id: r.line_text.split("\t") for r in render.tsv(rows).collect()}
    assert all(len(c) == 8 for c in tsv.values()) and tsv[3][2] == "" and tsv[15][4] == "Badge"
    feed = {r.id: r.feed for r in render.pick_feed(rows).collect()}
    assert feed[15] == "acme-api\tapp/policy.rb\t7\tacme-api@const\tBadge::LIMIT\tapp/policy.rb:7"
    assert feed[3] == "acme-api\tdocs/badge.md\t\tacme-api@file\tdocs/badge.md\t"
    painted = {r.id: r.feed for r in render.pick_feed(rows, [parser.Word("badge", False)], "31").collect()}
    assert "\x1b[31mBadge\x1b[0m" in painted[11]
    target = {r.id: r.target for r in render.selection_target(rows, repos).collect()}
    assert target[11] == "/src/acme-api/app/policy.rb:3" and target[3] == "/src/acme-api/docs/badge.md"


def test_statistics(tables):
    symbols, repos, files = tables
    per = stats.stats_global(repos, files, symbols)
    assert [(r.name, r.files, r.symbols) for r in per.collect()] == [("acme-api", 3, 10), ("acme-api-next", 1, 1)]
    total = stats.stats_totals(per).first()
    assert (total.repos, total.files, total.symbols) == (2, 4, 11)
    assert [(r.kind, r.n) for r in stats.kind_breakdown(symbols, 1).collect()][:2] == [("file", 3), ("method", 3)]
    assert [r.head_text for r in stats.head_text(repos).orderBy("id").collect()] == ["abc", "none"]
    listing = stats.file_listing(repos, symbols, [1], ["class"]).collect()
    assert [(r.id, r.header) for r in listing] == [(11, True), (13, False)]
    with pytest.raises(parser.QueryError, match="no symbols of kind 'nope'"):
        stats.file_listing(repos, symbols, [1], ["nope"])
    assert "2 repos" in render.global_table(per)


def test_plan_stays_in_the_jvm_and_pushes_filters(spark, tables, tmp_path):
    symbols, repos, _ = tables
    symbols.write.partitionBy("repo_id").parquet(str(tmp_path / "s"))
    stored = spark.read.schema(symbols.schema).parquet(str(tmp_path / "s"))
    plan = search.search(stored, repos, "acme-api: @class badge")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [" in plan and "StringStartsWith" in plan
    assert "Python" not in plan and "Cartesian" not in plan

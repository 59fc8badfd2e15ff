import pytest

from symquarry.plans import parser, picker
from symquarry.plans.render import best_last
from symquarry.plans.search import search
from symquarry.sources import corpus
from symquarry.sources.config import PickConfig

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return corpus.symbols(spark, SF), corpus.repos(spark, SF)


def program(tmp_path, body):
    path = tmp_path / "picker"
    path.write_text(f"#!/bin/sh\n{body}\n")
    path.chmod(0o755)
    return str(path)


def test_pick(spark, tables, tmp_path):
    symbols, repos = tables
    best = search(symbols, repos, "nation_1: widget", 1).first()
    place = f"/r/{best.repo}/{best.path}" + (f":{best.line}" if best.line is not None else "")
    first = program(tmp_path, "head -n 1")
    assert picker.pick(symbols, repos, "nation_1: widget", PickConfig(), program=first) == (0, "", place)
    keyed = program(tmp_path, "echo ctrl-o; head -n 1")
    assert picker.pick(symbols, repos, "nation_1: widget", PickConfig(expect=["ctrl-o"]), program=keyed) == (0, "ctrl-o", place)
    assert picker.pick(symbols, repos, "widget", PickConfig(), program=program(tmp_path, "exit 130")) == (130, "", None)
    with pytest.raises(parser.QueryError):
        picker.pick(symbols, repos, "nowhere: x", PickConfig(), program=first)


def test_feed_and_targets(tables):
    symbols, repos = tables
    landing = picker.feed(symbols, repos, "", PickConfig())
    assert len(landing) == 25 and all(line.split("\t")[1] == "README.md" for line in landing)
    painted = picker.feed(symbols, repos, "widget", PickConfig(limit=5, match_highlight="31"))
    assert len(painted) == 5 and all("\x1b[31m" in line and "\x1b" not in "".join(line.split("\t")[:3]) for line in painted)
    assert picker.target(repos, "NATION_3\ta/b\t7\tx") == "/r/NATION_3/a/b:7" and picker.target(repos, "NATION_3\ta/b\t\tx") == "/r/NATION_3/a/b"
    assert picker.target(repos, "none\ta\t1") is None and picker.target(repos, "x") is None
    ranked = search(symbols, repos, "widget")
    assert best_last(ranked, 3)[-1].split("\t")[0] == ranked.first().repo


def test_preview_and_help(tmp_path):
    source = tmp_path / "it's.txt"
    source.write_text("a\nb\n")
    assert picker.preview(str(source), 2, PickConfig(highlight="7")) == ["a", "\x1b[7mb\x1b[0m"]
    assert picker.preview(str(source), 1, PickConfig(highlight="7", highlighter="sed s/^/-/")) == ["\x1b[7m-a\x1b[0m", "-b"]
    assert picker.preview(str(source), None, PickConfig(highlighter="sed s/a/{file}/ < /dev/null; cat {file}"))[:1] == ["a"]
    assert picker.preview(str(source), None, PickConfig(highlighter="exit 3; cat")) == ["a", "b"]
    lines = picker.sigils().split("\n")
    assert len(lines) > 1 and max(map(len, lines)) <= 60 and " ".join(lines).split()[:2] == ["@class", "@module"]

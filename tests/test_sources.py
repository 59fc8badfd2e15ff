import os
import subprocess

import pytest
from pyspark.sql import functions as F

from symquarry.functions import paths
from symquarry.plans import search
from symquarry.sources import config, index, repositories
from symquarry.streaming import refresh as streaming


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@localhost", *args], check=True, capture_output=True)


def repository(root, files):
    root.mkdir(parents=True)
    git(root, "init", "-q")
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    git(root, "add", ".")
    git(root, "commit", "-qm", "first")


def test_discovery(tmp_path):
    for d in ("a/.git", "a/sub/.git", "b/c/.git", ".hidden/.git", "n/.git", "n/deep/er/.git"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "link").symlink_to(tmp_path / "a")
    names = [n for n, _ in repositories.discover([str(tmp_path), str(tmp_path / "b")])]
    assert names == ["a", "c", "n"]
    assert [n for n, _ in repositories.discover([str(tmp_path)], [str(tmp_path / "n")])] == ["a", "c", "n", "n/deep/er"]
    with pytest.raises(repositories.UnreadableRoot):
        repositories.discover([str(tmp_path / "missing")])


def test_refresh_cycle(spark, tmp_path):
    one, two, store = tmp_path / "src/one", tmp_path / "src/two", str(tmp_path / "index")
    repository(one, {"a.rb": b"class UserPolicy\n  def check\n  end\nend\n", "run": b"#!/usr/bin/env bash\nstart() { :; }\n", ".ci.yml": b"a:\n  b: 1\n", "x.rb": b"\0class No\nend\n", "skip/z.rb": b"class Z\nend\n"})
    repository(two, {"big.py": b"class Big: pass\n" * 20, "m.py": b"def f(): pass\n"})
    os.symlink("m.py", two / "link.py")
    git(two, "add", ".")
    git(two, "commit", "-qm", "link")
    c = config.parse(f'[index]\npaths=["{tmp_path}/src"]\nignores=["skip"]\nmax_file_size=100\n')
    first = index.refresh(spark, store, c)
    assert (first["repos"], first["indexed"], first["symbols"]) == (2, 6, 6)
    again = index.refresh(spark, store, c)
    assert (again["skipped"], again["indexed"]) == (2, 0)
    tables = index.read_index(spark, store)
    assert [(r.name, r.kind, r.scope) for r in search.search(tables["symbols"], tables["repos"], "user policy @class").collect()] == [("UserPolicy", "class", None)]
    assert {r.name for r in tables["symbols"].where("kind <> 'file'").collect()} == {"UserPolicy", "check", "start", "a", "a.b", "f"}
    (one / "a.rb").write_bytes(b"class Other\nend\n")
    git(two, "rm", "-q", "m.py")
    third = index.refresh(spark, store, c)
    assert (third["indexed"], third["removed"]) == (1, 1)
    tables = index.read_index(spark, store)
    assert {r.name for r in tables["symbols"].where("kind <> 'file'").collect()} == {"Other", "start", "a", "a.b"}
    assert index.refresh(spark, store, c, full=True)["indexed"] == 5
    os.rename(two / ".git", two / "was")
    assert index.refresh(spark, store, c)["pruned"] == 1
    assert index.read_index(spark, store)["repos"].count() == 1
    with index.lock(spark, store) as alone:
        assert alone and index.refresh(spark, store, c) is None


def test_streamed_refresh(spark, tmp_path):
    repository(tmp_path / "src/one", {"a.md": b"# Top\n"})
    c = config.parse(f'[index]\npaths=["{tmp_path}/src"]\n')
    (tmp_path / "notices").mkdir()
    repository(tmp_path / "src/two", {"b.md": b"# Other\n"})
    (tmp_path / "notices/1.json").write_text('{"root": "%s/src/one", "at": "2024-01-01T00:00:00Z"}\n' % tmp_path)
    query = streaming.refresh_on_change(spark, str(tmp_path / "notices"), str(tmp_path / "index"), c, str(tmp_path / "check"))
    query.awaitTermination(120)
    # Only the repository that the notice names was looked at; one without a root stands for all.
    headings = lambda: sorted(r.name for r in index.read_index(spark, str(tmp_path / "index"))["symbols"].where("kind = 'heading'").collect())
    assert headings() == ["Top"]
    (tmp_path / "notices/2.json").write_text('{"at": "2024-01-01T00:00:01Z"}\n')
    streaming.refresh_on_change(spark, str(tmp_path / "notices"), str(tmp_path / "index"), c, str(tmp_path / "check")).awaitTermination(120)
    assert headings() == ["Other", "Top"]


def test_any_file_survives_a_refresh(spark, tmp_path):
    files = {
        "LICENSE": "x" .encode() * 255 + "é and more\n".encode(), "AUTHORS": "José\n".encode("latin-1"), "run": b"#!/usr/bin/env bash\nstart() { :; }\n",
        "odd": b"#!/bin/sh \xff\xfe\ngo() { :; }\n", "long": b"#!" + b"a" * 300_000, "empty": b"", "bad.py": b"def f(:\n\xff", "deep.yml": b"[" * 5000, "bom.yml": b"\xef\xbb\xbf'q\\t': 1\n",
    }
    repository(tmp_path / "src/one", files)
    c = config.parse(f'[index]\npaths=["{tmp_path}/src"]\n')
    counters = index.refresh(spark, str(tmp_path / "index"), c)
    assert (counters["indexed"], counters["failed"]) == (len(files), 0)
    symbols = index.read_index(spark, str(tmp_path / "index"))["symbols"]
    assert {r.name for r in symbols.where("kind = 'file'").collect()} == set(files)
    assert {(r.kind, r.name) for r in symbols.where("kind in ('func', 'key')").collect()} == {("func", "start"), ("func", "go"), ("func", "f"), ("key", "q\\t")}
    assert "9 files indexed" in index.summary(counters)


def test_only_changed_repositories_are_written(spark, tmp_path):
    for name in ("one", "two"):
        repository(tmp_path / "src" / name, {"a.md": f"# {name}\n".encode(), "b.md": b"# same\n"})
    c, store = config.parse(f'[index]\npaths=["{tmp_path}/src"]\n'), tmp_path / "index"
    index.refresh(spark, str(store), c)
    parts = lambda: {(p.parent.parent.name, p.parent.name) for p in store.glob("symbols/version=*/repo_id=*/*.parquet")}
    first = parts()
    assert len(first) == 2
    index.refresh(spark, str(store), c)
    assert parts() == first
    (tmp_path / "src/one/a.md").write_bytes(b"# changed\n")
    index.refresh(spark, str(store), c)
    assert len(parts() - first) == 1
    names = lambda: sorted(r.name for r in index.read_index(spark, str(store))["symbols"].where("kind = 'heading'").collect())
    assert names() == ["changed", "same", "same", "two"]
    # What no kept commit names is deleted.
    for text in (b"# again\n", b"# more\n", b"# last\n"):
        (tmp_path / "src/one/a.md").write_bytes(text)
        index.refresh(spark, str(store), c)
    assert len(parts()) == 3 and len(list(store.glob("commit-*.json"))) == 2 and len(list(store.glob("repos-*"))) == 2
    assert names() == ["last", "same", "same", "two"]


def test_config(tmp_path):
    c = config.parse('[index]\npaths=["/x"]\n[abbreviations]\naa="acme"\n')
    assert (c.index.max_file_size, c.index.resolve_yaml, c.pick.limit, c.abbreviations) == (2097152, True, 100, {"aa": "acme"})
    for text in ("[index]\npaths=[]", "[index]\nnope=1", "[other]\n", '[index]\npaths=["/x"]\nignores=["glob:[a"]', '[index]\npaths=["/x"]\nignores=["regex:("]', '[index]\npaths="x"'):
        with pytest.raises(ValueError):
            config.parse(text)
    target = tmp_path / "c" / "config.toml"
    config.write_example(str(target))
    assert config.load(str(target)).index.paths == ["/home/you/projects"]
    with pytest.raises(FileExistsError):
        config.write_example(str(target))
    config.write_example(str(target), force=True)


def test_paths(spark):
    langs = {"a.rb": "ruby", "x/Makefile": "make", "Dockerfile.dev": "dockerfile", "a.tsx": "tsx", "a.gemspec": "ruby", "a.RB": None, "none": None, "a.tar.gz": None, ".rb": "ruby"}
    df = spark.createDataFrame([(k,) for k in langs], "p string")
    assert {r.p: r.l for r in df.select("p", paths.detect_language(F.col("p")).alias("l")).collect()} == langs
    shebangs = {"#!/bin/sh": "bash", "#!/usr/bin/env python3.11": "python", "#!/usr/bin/ruby2.7 -w": "ruby", "#!/usr/bin/perl": None, "sh": None, "#!": None, "#!/usr/bin/env": None}
    df = spark.createDataFrame([(k,) for k in shebangs], "p string")
    assert {r.p: r.l for r in df.select("p", paths.shebang_language(F.col("p")).alias("l")).collect()} == shebangs
    modes = {"100644": True, "100755": True, "120000": False, "160000": False}
    df = spark.createDataFrame([(k,) for k in modes], "p string")
    assert {r.p: r.l for r in df.select("p", paths.is_regular_file(paths.octal(F.col("p"))).alias("l")).collect()} == modes
    ignored = {"a/fixtures/b.rb": True, "fixtures": True, "my_fixtures/b": False, "a.snap": True, "d/a.snap": False, "x/y/a.lock": True, "a.min.js": True}
    df = spark.createDataFrame([(k,) for k in ignored], "p string")
    entries = ["/fixtures/", "glob:*.snap", "glob:**/*.lock", r"regex:\.min\.js$"]
    assert {r.p: r.l for r in df.select("p", paths.ignored(F.col("p"), entries).alias("l")).collect()} == ignored

"""Folders walked level by level."""

import os

import pytest
from pyspark.sql import functions as F

from sieveline.sources import walk as W

FILES = ["a.py", "B.PY", "x/b.py", "x/y/c.py", "x/y/z/d.py", ".env", ".config/e.py", "node_modules/p/f.py", "x/target/g.py", "x/build/h.txt", "docs/i.md", "docs/keep/j.log", "docs/k.log", "l.log", "env", "empty.d/.gitkeep"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for f in FILES:
        (top / f).parent.mkdir(parents=True, exist_ok=True)
        (top / f).write_text(f)
    return top


def paths(spark, tree, *a, **k):
    return sorted(r.path for r in W.walk(spark, str(tree), *a, **k, tasks=3).collect())


def test_names_depths_and_kinds(spark, tree):
    assert paths(spark, tree, "*.py") == ["a.py", "x/b.py", "x/y/c.py", "x/y/z/d.py"]
    assert paths(spark, tree, "*.py", ignore_case=True) == ["B.PY", "a.py", "x/b.py", "x/y/c.py", "x/y/z/d.py"]
    assert paths(spark, tree, "?.py", max_depth=2) == ["a.py", "x/b.py"] and paths(spark, tree, ".", max_depth=1) == ["B.PY", "a.py", "env", "l.log"]
    assert paths(spark, tree, kind="d") == ["docs", "docs/keep", "empty.d", "x", "x/y", "x/y/z"] and paths(spark, tree, kind="d", max_depth=2) == ["docs", "empty.d", "x"]
    assert paths(spark, tree, ".env") == [".env"] and paths(spark, tree, ".*") == [".env", "empty.d/.gitkeep"] and paths(spark, tree, max_depth=0) == [] and paths(spark, tree, "nothing") == []
    r = W.walk(spark, str(tree), "c.py").first()
    assert (r.name, r.size, r.depth, r.is_dir) == ("c.py", len("x/y/c.py"), 3, False) and r.modified is not None


def test_rules(spark, tree):
    (tree / "rules").write_text("# comment\n\n*.log\n!keep/*.log\n /docs/i.md \ny/\n")
    rules = W.ignore_rules(spark, f"file://{tree}/rules")
    os.remove(tree / "rules")
    assert rules == ["*.log", "!keep/*.log", "/docs/i.md", "y/"] and W.ignore_rules(spark, f"file://{tree}/none") == []
    assert paths(spark, tree, rules=rules) == ["B.PY", "a.py", "env", "x/b.py"]
    assert paths(spark, tree, "*.log", rules=["*.log", "!docs/**/j.log"]) == ["docs/keep/j.log"]
    df = spark.createDataFrame([("a/b/c", True), ("c", False), ("a/xc", False), ("b/q/c.py", False)], "p string, d boolean")
    hits = lambda *r: [x[0] for x in df.select(W.ignored(F.col("p"), F.col("d"), list(r))).collect()]
    assert hits("c") == [True, True, False, False] and hits("c/") == [True, False, False, False] and hits("/c") == [False, True, False, False] and hits("b/**/c.py") == [False, False, False, True]
    assert hits("c", "!a/b/c") == [False, True, False, False] and hits("?c") == [False, False, True, False] and hits("**/c.py") == [False, False, False, True] and hits() == [False] * 4


def test_pruned_folders_are_not_opened(spark, tmp_path, monkeypatch):
    """A folder that can't be read is passed over, and what is pruned may be unreadable."""
    for d in ("node_modules", "gone", "ok"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "f.txt").write_text("x")
    opened = spark.sparkContext.accumulator(0)
    real = W._listed

    def counted(root, depth):
        inner = real(root, depth)

        def run(batches):
            def told():
                for b in batches:
                    opened.add(b.num_rows)
                    yield b

            return inner(told())

        return run

    monkeypatch.setattr(W, "_listed", counted)
    assert paths(spark, tmp_path, rules=["gone/"]) == ["ok/f.txt"] and opened.value == 2
    assert paths(spark, tmp_path / "missing") == []


def test_folders(spark, tree):
    got = {r.folder: (r.files, r.names, r.extensions) for r in W.by_folder(W.walk(spark, str(tree), "*.py")).collect()}
    assert got["."] == (1, ["a.py"], ["py"]) and got["x/y/z"] == (1, ["d.py"], ["py"]) and len(got) == 4

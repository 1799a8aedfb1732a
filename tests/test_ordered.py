"""Order-wide operations in blocks, held against one pass over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import joins, ordered, test_results


def frame(spark, values, schema):
    rows = [(i, *v) for i, v in enumerate(values)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, f"n long, {schema}")


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_against_windows(spark, blocks):
    rng = random.Random(blocks)
    values = [(rng.choice(["e", "a", "b", None]), f"s{i // 25}") for i in range(100)]
    df = frame(spark, values, "k string, s string")
    b = ordered.in_blocks(df, ["n"], blocks)
    assert b.select(ordered.BLOCK).distinct().count() == min(blocks, 40)
    kept = lambda x, y: (y["k"] != "e") & (x["k"] != y["k"])
    one = df.withColumn("all", F.lit(0))
    pairs = lambda d: {(r.n, r.match.n if r.match else None) for r in d.collect()}
    assert pairs(ordered.look_ahead(b, ["n"], 3, ["n", "k"], kept)) == pairs(joins.look_ahead(one, ["all"], ["n"], 3, ["n", "k"], kept))
    header = F.when(F.col("k") == "e", F.col("n"))
    last = lambda d: {(r.n, r.h) for r in d.collect()}
    assert last(ordered.carry_forward(b, ["n"], header, "h")) == last(joins.carry_forward(one, ["all"], ["n"], header, "h"))
    assert last(ordered.carry_forward(b, ["n"], header, "h", "s")) == last(joins.carry_forward(one, ["s"], ["n"], header, "h"))
    left = lambda d: {r.n for r in d.collect()}
    assert left(ordered.drop_consecutive(b, ["n"], F.col("k"))) == left(joins.drop_consecutive(one, ["all"], ["n"], F.col("k")))


LINES = ["error: x", "  at y", "", "\tat z", "plain", "ERROR again", "", "", "  after", "ok", " in", "error: last", "é"]


@pytest.mark.parametrize("blocks", [1, 7, 60])
def test_error_lines_are_those_of_the_row_fold(spark, blocks):
    rng = random.Random(blocks)
    texts = {f"f{k}": [rng.choice(LINES) for _ in range(rng.choice([1, 2, 30, 120]))] for k in range(5)}
    rows = [(f, i, x) for f, t in texts.items() for i, x in enumerate(t)]
    rng.shuffle(rows)
    is_error = F.lower("line").contains("error")
    df = spark.createDataFrame(rows, "file string, n int, line string")
    found = ordered.error_lines(ordered.in_blocks(df, ["file", "n"], blocks), ["file", "n"], "line", is_error, "file").orderBy("file", "n").collect()
    whole = spark.createDataFrame([(f, "\n".join(t) + "\n") for f, t in texts.items()], "file string, text string")
    want = {r.file: r.e for r in whole.select("file", test_results.error_blocks(F.col("text"), ("(?i)error",)).alias("e")).collect()}
    for f in texts:
        assert "\n".join(r.line for r in found if r.file == f) == want[f]


DIFF = """diff --git a/x b/x
--- a/x
+++ b/x
@@ -1 +1 @@
+one
 same
-two
--- not a change
diff --git a/y b/y
+++ b/y
""" + "".join(f"+l{i}\n" for i in range(12)) + "+++ z\n same\n+++ w\n-gone\n"


@pytest.mark.parametrize("blocks", [1, 9])
def test_condensed_diff(spark, blocks):
    rows = [(f, i, x) for f in ("p", "q") for i, x in enumerate(("+early\n" + DIFF).splitlines())]
    df = spark.createDataFrame(rows, "file string, n int, line string")
    got = ordered.condensed_diff(ordered.in_blocks(df, ["file", "n"], blocks), ["file", "n"], "line", "file").orderBy("file", "n", "part").collect()
    want = ["[file] x (+1 -1)", "  +one", "  -two", "[file] y (+12 -0)", *[f"  +l{i}" for i in range(12)], "  ... +2 more", "[file] w (+0 -1)", "  -gone"]
    assert [r.line for r in got if r.file == "p"] == want == [r.line for r in got if r.file == "q"]


def test_file_in_splits(spark, tmp_path):
    """A file that is read in many splits folds as a whole, and no task holds more than a block."""
    rng = random.Random(9)
    text = [rng.choice(LINES) for _ in range(40_000)]
    (tmp_path / "log.txt").write_text("\n".join(text) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        read = ordered.lines(spark, str(tmp_path / "log.txt"))
        assert read.rdd.getNumPartitions() > 5
        b = ordered.in_blocks(read, ["file", "start", "seq"], 16)
        assert max(r["count"] for r in b.groupBy(ordered.BLOCK).count().collect()) < 8_000
        assert [r.line for r in b.orderBy("start", "seq").collect()] == text
        is_error = F.lower("line").contains("error")
        got = [r.line for r in ordered.error_lines(b, ["file", "start", "seq"], "line", is_error, "file").orderBy("start", "seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    want, on, blank = [], False, 0
    for x in text:
        if "error" in x.lower():
            on, blank = True, 0
        elif on and not x.strip():
            blank += 1
            on = blank < 2
        elif on and x[0] in " \t":
            blank = 0
        else:
            on = False
        if on:
            want.append(x)
    assert got == want


def test_empty(spark):
    b = ordered.in_blocks(spark.createDataFrame([], "n long, line string"), ["n"], 4)
    assert ordered.error_lines(b, ["n"], "line", F.lit(True)).count() == 0 == ordered.look_ahead(b, ["n"], 2, ["n"], lambda x, y: F.lit(True)).count()
    assert ordered.condensed_diff(b, ["n"], "line").count() == 0

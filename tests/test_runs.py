"""Filtered runs, their side outputs in one job, and the tracker."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators import analytics
from sieveline.sources import runs as R

RUN = "id long, ts timestamp, tool string, args string, stdout string, stderr string, exit_code int, other int"
AT = datetime(2024, 1, 2)


def frame(spark, *rows):
    return spark.createDataFrame([(i, AT, "git", a, out, err, code, 1) for i, (a, out, err, code) in enumerate(rows)], RUN)


def upper(text, code):
    return F.concat(F.upper(text), F.lit("|"), code.cast("string"))


def test_exit_rules(spark):
    df = frame(spark, ("log", "a\r\n", "b\n", 0), (None, "a\n", "b\n", 2), ("x", " \n", "", 1), ("gone", "", "", 127), ("none", None, None, 0), ("null", "a", "", None))
    got = {r.id: r for r in R.filtered(df, upper, label="my tool/é", folder="/d").collect()}
    hint = "[sieveline: full output saved to /d/tee-my_tool__.txt — re-read if the filtered view is insufficient]\n"
    assert got[0].shown == "A\nB\n|0\n" and got[0].errors == "" and got[0].saved is None
    assert got[1].shown == "A\nB\n|2\n" + hint and tuple(got[1].saved) == ("/d/tee-my_tool__.txt", "a\nb\n")
    assert got[2].saved is None and got[2].shown == " \n|1\n" and got[4].shown == "|0\n"
    for k in (3, 5):
        assert (got[k].shown, got[k].errors, got[k].entry, got[k].failure) == (None, None, None, "sieveline: failed to run git")
    e = got[1].entry
    assert (e.cmd, e.label, e.raw_tokens, e.out_tokens, e.passthrough, e.ts) == ("git", "sieveline git", 1, 2, False, AT)


def test_stdout_only_and_skipped_failures(spark):
    df = frame(spark, ("log", "a", "warn", 0), ("log", "a", " \n", 0), ("log", "a", "bad", 1), ("log", " ", "bad", 1))
    got = {r.id: r for r in R.filtered(df, upper, stdout_only=True, skip_on_failure=True, newline=False, label="x").collect()}
    assert [(r.shown, r.errors, r.entry.raw_tokens, r.entry.out_tokens) for _, r in sorted(got.items())] == [("A|0", "warn", 1, 1), ("A|0", "", 1, 1), ("a", "bad", 1, 1), ("", "bad", 1, 1)]
    assert all(r.saved is None for r in got.values())


def test_filter_runs_once_a_row(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    R.filtered(frame(spark, ("a", "x", "", 1), ("b", "y", "", 0)), lambda t, c: counted(t), label="l").collect()
    assert seen.value == 2


def test_one_job_and_repeated_batches(spark, tmp_path):
    df = frame(spark, ("log", "a\nb\nc", "", 1), ("log", "d", "e", 0), ("log", "f", "", 3))
    rest = R.remainder(F.when(F.col("id") == 0, "tail"), F.lit("list"), 3, "/t")
    made = R.filtered(df, upper, label=F.lit("tool"), folder="/t", rest=rest)
    assert made.where("rest IS NOT NULL").first().rest.hint == "[see remaining: tail -n +3 /t/tee-list.txt]"
    folder = str(tmp_path / "runs")
    spark.sparkContext.setJobGroup("sides", "sides")
    R.write(made, folder, 1)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("sides")) == 1
    before = sorted(map(str, R.entries(spark, folder).collect()))
    R.write(made, folder, 1)
    assert sorted(map(str, R.entries(spark, folder).collect())) == before and len(before) == 3
    R.write(R.filtered(frame(spark, ("x", "new", "", 9)), upper, label="tool", folder="/t"), folder, 2)
    assert R.shown(spark, folder).count() == 4 and {(r.path, r.text) for r in R.saved(spark, folder).collect()} == {("/t/tee-tool.txt", "new")}
    assert [tuple(r) for r in R.saved(spark, folder, "rest").collect()] == [("/t/tee-list.txt", "tail")]
    assert analytics.gain(R.entries(spark, folder)).first().total_commands == 4


def test_stream_that_is_started_again(spark, tmp_path):
    src, folder, state = (str(tmp_path / x) for x in ("in", "runs", "state"))
    frame(spark, ("a", "x", "", 0), ("b", "y", "", 1)).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(RUN).parquet(src)

    def run():
        q = R.write_stream(stream(), upper, folder, state, label="l").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    run()
    frame(spark, ("c", "z", "", 0)).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r.cmd for r in R.entries(spark, folder).collect()) == ["git a", "git b", "git c"]


def test_payload(spark):
    rows = R.filtered(frame(spark, ("a", "x" * 40, "", 0)), lambda t, c: F.left(t, F.lit(8))).select("entry.*").unionByName(R.passed_through(frame(spark, ("b", "", "", 0))))
    assert [r.label for r in rows.where("passthrough").collect()] == ["sieveline git (passthrough)"]
    text = R.payload(rows, 'ab"c', system="linux").first().payload
    assert json.loads(text) == {"device_hash": 'ab"c', "version": "dev", "os": "linux", "arch": "", "commands": 2, "raw_tokens": 10, "out_tokens": 2, "tokens_saved": 8} and text == json.dumps(json.loads(text), indent=2)
    assert json.loads(R.payload(rows.limit(0), "d").first().payload)["commands"] == 0


def test_safe_paths(spark):
    got = spark.range(1).select(R.safe_path(F.lit("a b/ç-_9"), "/f"), R.safe_path("", "/f"), R.remainder(F.lit(" \n"), "x", 1, "/f"), T.est_tokens(F.lit("abcde"))).first()
    assert tuple(got) == ("/f/tee-a_b__-_9.txt", "/f/tee-cmd.txt", None, 2)

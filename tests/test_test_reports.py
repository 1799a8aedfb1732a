"""Reports of test runs: streams of events, and runs of JavaScript runners."""

import json

import pytest
from pyspark.sql import functions as F

from sieveline.operators import test_reports as R


def events(*es):
    return "\n".join(json.dumps(e) for e in es)


def ev(action, pkg=None, test=None, output=None, **more):
    return {"Action": action, **{k: v for k, v in (("Package", pkg), ("Test", test), ("Output", output)) if v is not None}, **more}


def go(spark, *texts):
    rows = {r.id: r.report for r in R.go_test(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()}
    return [rows[i] for i in range(len(texts))]


def test_go_runs(spark):
    ok = events(ev("run", "m/a", "T1"), ev("pass", "m/a", "T1"), ev("pass", "m/b", "T2"), ev("skip", "m/b", "T3"), ev("pass", "m/b")) + "\nnot json\n\n"
    bad = events(
        ev("output", "m/a", "T1", "=== RUN T1\n"), ev("output", "m/a", "T1", "  a_test.go:42: odd\n"), ev("output", "m/a", "T1", "context\n"), ev("output", "m/a", "T1", "noise\n"), ev("output", "m/a", "T1", "expected 1\n"), ev("output", "m/a", "T1", "--- FAIL: T1\n"), ev("fail", "m/a", "T1"),
        ev("output", "m/a", "T0", "only this \n"), ev("fail", "m/a", "T0"), ev("pass", "m/a", "T9"), ev("fail", "m/a"), ev("skip", "x/c", "S"), ev("output", "x/c", None, "panic: test timed out\n"), ev("output", "x/c", None, " \n"), ev("fail", "x/c"),
        ev("build-output", None, None, "# x/d\n", ImportPath="x/d [test]"), ev("build-output", None, None, "d.go:1: undefined: y\n", ImportPath="x/d [test]"), ev("build-fail", ImportPath="x/d [test]"), ev("fail", "x/d", FailedBuild="x/d [test]"),
    )
    want = (
        "Go test: 1 passed, 4 failed, 1 skipped in 3 packages\n\nc [FAIL]\n  panic: test timed out\n\nd [build failed]\n  d.go:1: undefined: y\n\n"
        "a (1 passed, 2 failed)\n  [FAIL] T1\n     a_test.go:42: odd\n     context\n     expected 1\n  [FAIL] T0\n     only this"
    )
    assert go(spark, ok, bad, "", "no events", events(ev("skip", "p", "T")), None) == ["Go test: 2 passed in 2 packages", want, "Go test: No tests found", "Go test: No tests found", "Go test: No tests found", "Go test: No tests found"]


def test_go_repeated_failures_and_long_output(spark):
    out = [ev("output", "p", "T", f"got {i} {'x' * 120}\n") for i in range(7)]
    text = events(*out, ev("fail", "p", "T"), ev("output", "p", "T", "second\n"), ev("fail", "p", "T"), ev("output", "p", "T", "late"), ev("fail", None, "U"))
    want = "Go test: 0 passed, 3 failed in 2 packages\n\np (0 passed, 2 failed)\n  [FAIL] T\n" + "".join(f"     {('got %d ' % i + 'x' * 120)[:97]}...\n" for i in range(5)) + "  [FAIL] T\n     second\n\nunknown (0 passed, 1 failed)\n  [FAIL] U"
    assert go(spark, text) == [want]


RUN = {"numTotalTests": 9, "numPassedTests": 2, "numFailedTests": 6, "numPendingTests": 1, "testResults": [{"name": "/a.test.ts", "assertionResults": [{"fullName": f"t {i}", "status": "failed" if i else "passed", "failureMessages": ["no {\n at x", "more"] if i == 1 else []} for i in range(7)]}]}
FULL = "PASS (2) FAIL (6) skipped (1)\n\n1. t 1\n   no {\n    at x\n   more\n2. t 2\n3. t 3\n4. t 4\n5. t 5\n\n... +1 more failures"
LINES = "\x1b[31m FAIL  a.test.ts\x1b[0m\n  Error: no\n    at y\n ✓ fine\n[x] other\n Tests  2 failed | 13 passed (15)\n Duration  1.5s\n"


@pytest.mark.parametrize("before", ["", "> pkg@1 test\n\ndotenv {x}\n", "noise "])
def test_js_json(spark, before):
    got = spark.range(1).select(R.js_report(F.lit(before + json.dumps(RUN) + ("\nDone" if before else "")))).first()[0]
    assert got == FULL


def test_js_tiers(spark):
    long = "é" * 2001
    empty = json.dumps({"numTotalTests": 0})
    rows = spark.createDataFrame([(LINES,), (long,), ("plain",), (empty,), ("Tests  3 passed\nDuration 420ms",), ("Tests 0 passed",), ('{"numTotalTests": 3',), (None,)], "t string").select(*[R.js_report("t", m).alias(m) for m in ("compact", "verbose", "ultra")]).collect()
    assert rows[0].compact == "PASS (13) FAIL (2)\n\n1.  FAIL  a.test.ts\n   Error: no\n   at y\n2. [x] other\n\nTime: 1500ms"
    assert rows[0].verbose == "Tests: 13 passed, 2 failed, 0 skipped (total: 15)\n\nFailures:\n\n1.  FAIL  a.test.ts ()\n   Error: no\nat y\n\n2. [x] other ()\n   \n\nDuration: 1500ms" and rows[0].ultra == "[ok]13 [x]2 [skip]0 (1500ms)"
    assert rows[1].compact == "é" * 2000 + "\n\n[SIEVELINE:PASSTHROUGH] Output truncated (2001 chars → 2000 chars)" and rows[2].compact == "plain" and rows[3].compact == "PASS (0) FAIL (0)"
    assert rows[4].compact == "PASS (3) FAIL (0)\n\nTime: 420ms" and rows[5].compact == "Tests 0 passed" and rows[6].compact == '{"numTotalTests": 3' and rows[7].compact is None


def test_js_tier_names(spark):
    got = spark.createDataFrame([(json.dumps(RUN),), (LINES,), ("x",)], "t string").select(R.js_run("t")["tier"].alias("tier")).collect()
    assert [r.tier for r in got] == ["full", "degraded", None]

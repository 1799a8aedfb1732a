"""Test runs as short text: streams of test events by joins and grouping over their lines, and runs of JavaScript runners in three tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json_tokens as JT
from ..functions import text as T
from ..functions.text import bound
from .scan import begins, fold, has, none, text

_EVENT = "Action string, Package string, Test string, Output string, ImportPath string, FailedBuild string"
#: Lines shown of a failed test, failures shown of a run, characters shown of what can't be read.
LINES, FAILURES, UNREAD = 5, 5, 2000


def failure_lines(outputs: Column) -> Column:
    """Of a failed test's output the first five lines that name a place or a failure, or follow a place; else the first line that says anything."""
    frame = lambda t: (t == "") | begins(t, "=== RUN", "--- FAIL", "--- PASS")
    place = lambda t: t.rlike(r"^(?:(?!\.go:).)*\.go:[0-9]")
    failure = lambda t: F.lower(t).rlike("^(?:panic|error):| error:|expected|got|want|actual|assert|mismatch|fatal") | t.startswith("at ")

    def step(s: Column, t: Column) -> dict[str, Column]:
        shown = ~frame(t) & (place(t) | failure(t) | s["next"]) & (F.size(s["out"]) < LINES)
        return {"out": F.when(shown, F.concat(s["out"], F.array(t))).otherwise(s["out"]), "next": ~frame(t) & place(t)}

    def told(a: Column) -> Column:
        found = fold(a, {"out": none(), "next": F.lit(False)}, step, lambda s: s["out"])
        return bound(found, lambda r: F.when(F.size(r) > 0, r).otherwise(F.slice(F.filter(a, lambda t: ~frame(t)), 1, 1)))

    return bound(F.transform(outputs, T.utrim), told)


def go_test(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, report) of streams of test events, one a line; other lines are passed over.

    Totals, then packages that failed as a whole with what they said, then builds that failed, then failed tests by package in order of their
    failure. Output belongs to the test's next failure. Events are rows, so a stream of any length is dealt by package and test.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    e = rows.select("id", F.posexplode(T.lines("text")).alias("at", "raw")).select("id", "at", F.from_json("raw", _EVENT).alias("e")).select("id", "at", "e.*").where("Action IS NOT NULL")
    own = e.where("Action NOT IN ('build-output', 'build-fail')").withColumn("pkg", F.coalesce("Package", F.lit("unknown")))
    fails, tested = F.col("Action") == "fail", F.col("Test").isNotNull()

    ended = F.min(F.when(fails, F.col("at"))).over(Window.partitionBy("id", "pkg", "Test").orderBy("at").rowsBetween(0, Window.unboundedFollowing))
    right = lambda c: F.regexp_replace(c, r"[ \t\r\n]+\z", "")
    runs = own.where(tested & (fails | (F.col("Action") == "output"))).withColumn("end", ended).where("end IS NOT NULL")
    failed = runs.groupBy("id", "pkg", "Test", "end").agg(F.array_sort(F.collect_list(F.when((F.col("Action") == "output") & F.col("Output").isNotNull(), F.struct("at", right(F.col("Output")).alias("line"))))).alias("out"))
    shown = F.array_join(F.transform(failure_lines(F.transform("out", lambda o: o["line"])), lambda s: text("     ", T.ellipsis(s, 100), "\n")), "")
    failed = failed.select("id", "pkg", "end", F.concat(F.lit("  [FAIL] "), F.col("Test"), F.lit("\n"), shown).alias("told"))
    failed = failed.groupBy("id", "pkg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("end", "told"))), lambda x: x["told"]), "").alias("tests"))

    # what a build said goes to the next package that names it
    broken = own.where(fails & ~tested & F.col("FailedBuild").isNotNull()).select("id", "at", "pkg", F.col("FailedBuild").alias("build"), F.lit(None).cast("string").alias("line"))
    said = e.where("Action = 'build-output' AND ImportPath IS NOT NULL AND Output IS NOT NULL").select("id", "at", F.lit(None).cast("string").alias("pkg"), F.col("ImportPath").alias("build"), T.utrim("Output").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    claimed = F.min_by("pkg", F.when(F.col("pkg").isNotNull(), F.col("at"))).over(Window.partitionBy("id", "build").orderBy("at").rowsBetween(0, Window.unboundedFollowing))
    builds = broken.unionByName(said).withColumn("owner", claimed).where("line IS NOT NULL AND owner IS NOT NULL").groupBy("id", F.col("owner").alias("pkg")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    listed = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: text("  ", T.ellipsis(x["line"], 120), "\n")), ""), F.lit(""))
    builds = builds.select("id", "pkg", listed(F.col("lines")).alias("errors"))

    n = lambda action: F.count_if((F.col("Action") == action) & tested)
    loose = T.utrim("Output")
    packages = own.groupBy("id", "pkg").agg(
        F.min("at").alias("first"), n("pass").alias("passed"), n("fail").alias("failed"), n("skip").alias("skipped"), F.bool_or(fails & ~tested & F.col("FailedBuild").isNotNull()).alias("no_build"),
        F.bool_or(fails & ~tested & F.col("FailedBuild").isNull()).alias("down"),
        F.array_sort(F.collect_list(F.when((F.col("Action") == "output") & ~tested & (loose != ""), F.struct("at", loose.alias("line"))))).alias("loose"))
    packages = packages.join(failed, ["id", "pkg"], "left").join(builds, ["id", "pkg"], "left").withColumn("down", F.col("down") & (F.col("failed") == 0) & ~F.col("no_build"))
    name = T.last_segment("pkg")
    section = lambda when, *parts: F.when(when, F.concat(F.lit("\n"), *[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")
    parts = packages.select(
        "id", "first", "passed", "failed", "skipped", "no_build", "down", section(F.col("down"), name, " [FAIL]\n", listed(F.col("loose"))).alias("a"), section(F.col("no_build"), name, " [build failed]\n", F.coalesce("errors", F.lit(""))).alias("b"),
        section(F.col("failed") > 0, name, " (", F.col("passed").cast("string"), " passed, ", F.col("failed").cast("string"), " failed)\n", F.coalesce("tests", F.lit(""))).alias("c"))
    runs = parts.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("passed").alias("passed"), (F.sum("failed") + F.count_if("no_build") + F.count_if("down")).alias("failed"), F.sum("skipped").alias("skipped"), F.array_sort(F.collect_list(F.struct("first", "a", "b", "c"))).alias("parts"))
    joined = lambda k: F.array_join(F.transform("parts", lambda p: p[k]), "")
    every = F.concat(joined("a"), joined("b"), joined("c"))
    bad = T.utrim(text("Go test: ", F.col("passed"), " passed, ", F.col("failed"), " failed", F.when(F.col("skipped") > 0, text(", ", F.col("skipped"), " skipped")).otherwise(""), " in ", F.col("n"), " packages\n", every))
    report = F.when(F.col("failed") > 0, bad).when(F.col("passed") == 0, "Go test: No tests found").otherwise(text("Go test: ", F.col("passed"), " passed in ", F.col("n"), " packages"))
    return rows.select("id").join(runs.select("id", report.alias("report")), "id", "left").select("id", F.coalesce("report", F.lit("Go test: No tests found")).alias("report"))


# JavaScript runners

_FAILURE = "array<struct<test:string,file:string,message:string>>"
_RUN = "testResults array<struct<name:string,assertionResults:array<struct<fullName:string,status:string,failureMessages:array<string>>>>>, numTotalTests int, numPassedTests int, numFailedTests int, numPendingTests int"


def _run(total: Column, passed: Column, failed: Column, skipped: Column, millis: Column, failures: Column, tier: str) -> Column:
    fields = {"total": total, "passed": passed, "failed": failed, "skipped": skipped, "millis": millis, "failures": failures, "tier": F.lit(tier)}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _object(x: Column) -> Column:
    """What may be a run's JSON object within a text: from the last brace before its total, else from the first line that begins with one."""
    upto = F.substring_index(x, '"numTotalTests"', 1)
    marked = F.regexp_extract(upto, r"(?s)\{[^{]*\z", 0)
    at = F.when(x.contains('"numTotalTests"'), F.length(upto) - F.length(marked) + 1).otherwise(F.length(F.regexp_extract(x, r"(?ms)\A(?:(?!^[ \t]*\{).)*+", 0)) + 1)
    return x.substr(at, F.length(x))


def js_run(x: Column | str) -> Column:
    """(total, passed, failed, skipped, millis, failures, tier) of a run: ``full`` by its JSON, ``degraded`` by its summary lines, null where neither is there."""
    zero = lambda c: F.coalesce(c, F.lit(0))

    def full(j: Column) -> Column:
        tests = F.flatten(F.transform(F.coalesce(j["testResults"], F.array().cast("array<struct<name:string,assertionResults:array<struct<fullName:string,status:string,failureMessages:array<string>>>>>")), lambda f: F.transform(F.coalesce(f["assertionResults"], F.array().cast("array<struct<fullName:string,status:string,failureMessages:array<string>>>")), lambda t: F.struct(
            t["status"].alias("status"), F.coalesce(t["fullName"], F.lit("")).alias("test"), F.coalesce(f["name"], F.lit("")).alias("file"), F.coalesce(F.array_join(t["failureMessages"], "\n"), F.lit("")).alias("message")))))
        bad = F.transform(F.filter(tests, lambda t: t["status"] == "failed"), lambda t: F.struct(t["test"].alias("test"), t["file"].alias("file"), t["message"].alias("message")))
        return _run(zero(j["numTotalTests"]), zero(j["numPassedTests"]), zero(j["numFailedTests"]), zero(j["numPendingTests"]), F.lit(None).cast("long"), bad, "full")

    def degraded(clean: Column) -> Column:
        count = r"Tests\s+(?:(\d+)\s+failed\s+\|\s+)?(\d+)\s+passed"
        n = lambda k: zero(F.nullif(F.regexp_extract(clean, count, k), F.lit("")).try_cast("int"))
        took = F.regexp_extract(clean, r"Duration\s+([\d.]+)(ms|s)", 1).try_cast("double")
        millis = (took * F.when(F.regexp_extract(clean, r"Duration\s+([\d.]+)(ms|s)", 2) == "ms", 1.0).otherwise(1000.0)).cast("long")
        closed = lambda s: F.when(F.size(s["block"]) > 0, F.concat(s["out"], F.array(F.struct(s["block"][0].alias("test"), F.lit("").alias("file"), F.array_join(F.slice(s["block"], F.lit(2), F.size(s["block"])), "\n").alias("message"))))).otherwise(s["out"])

        def step(s: Column, line: Column) -> dict[str, Column]:
            goes_on = (F.size(s["block"]) > 0) & line.startswith("  ")
            opens = ~goes_on & has(line, "[x]", "FAIL")
            return {"out": F.when(goes_on, s["out"]).otherwise(closed(s)), "block": F.when(goes_on, F.concat(s["block"], F.array(T.utrim(line)))).when(opens, F.array(line)).otherwise(none())}

        bad = lambda: fold(T.lines(clean), {"out": F.array().cast(_FAILURE), "block": none()}, step, closed)
        return bound(F.struct(n(1).alias("failed"), n(2).alias("passed")), lambda c: F.when(c["failed"] + c["passed"] > 0, _run(c["failed"] + c["passed"], c["passed"], c["failed"], F.lit(0), millis, bad(), "degraded")))

    def read(j: Column) -> Column:
        """A run's fields if a text's first value is an object."""
        return bound(F.from_json(j, _RUN), lambda r: F.when(JT.is_object(j), full(r)))

    return bound(T.c(x), lambda raw: F.coalesce(F.when(F.try_parse_json(raw).isNotNull(), read(raw)), bound(_object(raw), read), bound(T.strip_ansi(raw), degraded)))


def js_report(x: Column | str, mode: str = "compact", program: str = "sieveline") -> Column:
    """A run in short: counts, five failures with their messages, the time; with mode ``verbose`` all failures, ``ultra`` one line. What can't be read is cut to 2000 characters."""

    def failures(f: Column) -> Column:
        one = lambda r, i: F.concat(text("\n", i + 1, ". ", r["test"]), F.array_join(F.transform(T.lines(r["message"]), lambda s: F.concat(F.lit("\n   "), s)), ""))
        return F.when(F.size(f) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(F.slice(f, 1, FAILURES), one), ""), F.when(F.size(f) > FAILURES, text("\n\n... +", F.size(f) - FAILURES, " more failures")).otherwise(""))).otherwise("")

    def told(r: Column) -> Column:
        skipped = F.when(r["skipped"] > 0, text(" skipped (", r["skipped"], ")")).otherwise("")
        time = lambda name: F.when(r["millis"].isNotNull(), text(f"\n\n{name}: ", r["millis"], "ms")).otherwise("")
        if mode == "ultra":
            return text("[ok]", r["passed"], " [x]", r["failed"], " [skip]", r["skipped"], " (", F.coalesce(r["millis"], F.lit(0)), "ms)")
        if mode == "verbose":
            rows = F.when(F.size(r["failures"]) > 0, F.concat(F.lit("\n\nFailures:"), F.array_join(F.transform(r["failures"], lambda f, i: text("\n\n", i + 1, ". ", f["test"], " (", f["file"], ")\n   ", f["message"])), ""))).otherwise("")
            return F.concat(text("Tests: ", r["passed"], " passed, ", r["failed"], " failed, ", r["skipped"], " skipped (total: ", r["total"], ")"), rows, time("Duration"))
        return F.concat(text("PASS (", r["passed"], ") FAIL (", r["failed"], ")"), skipped, failures(r["failures"]), time("Time"))

    raw = T.c(x)
    unread = F.when(F.length(raw) > UNREAD, F.concat(F.left(raw, F.lit(UNREAD)), text(f"\n\n[{program.upper()}:PASSTHROUGH] Output truncated (", F.length(raw), f" chars → {UNREAD} chars)"))).otherwise(raw)
    return bound(js_run(raw), lambda r: F.when(r.isNull(), unread).otherwise(told(r)))

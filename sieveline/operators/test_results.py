"""Test runners as one relation: (id, suite, test, status, seconds, message), and totals over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def go_events(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Results of a stream of JSON events, one a line; a failed test carries its output lines in order."""
    schema = "Action string, Package string, Test string, Output string, Elapsed double, ImportPath string, FailedBuild string"
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(T.lines(text_col)).alias("at", "raw"))
    e = lines.select("id", "at", F.from_json("raw", schema).alias("e")).select("id", "at", "e.*").where("Action IS NOT NULL")
    done = e.where("Action IN ('pass', 'fail', 'skip') AND Test IS NOT NULL").select("id", F.col("Package").alias("suite"), F.col("Test").alias("test"), F.col("Action").alias("status"), F.col("Elapsed").alias("seconds"))
    failed = done.where("status = 'fail'").select("id", "suite", "test")
    output = e.where("Action = 'output' AND Test IS NOT NULL").select("id", F.col("Package").alias("suite"), F.col("Test").alias("test"), "at", "Output").join(failed, ["id", "suite", "test"], "left_semi")
    text = output.groupBy("id", "suite", "test").agg(F.sort_array(F.collect_list(F.struct("at", "Output"))).alias("o"))
    return done.join(text.select("id", "suite", "test", F.array_join(F.transform("o", lambda x: x["Output"]), "").alias("message")), ["id", "suite", "test"], "left")


def jest_json(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    schema = "struct<testResults:array<struct<name:string,assertionResults:array<struct<fullName:string,status:string,failureMessages:array<string>>>>>>"
    j = df.select(F.col(id_col).alias("id"), F.from_json(F.col(text_col), schema).alias("j")).select("id", F.explode("j.testResults").alias("s")).select("id", F.col("s.name").alias("suite"), F.explode("s.assertionResults").alias("t"))
    status = F.when(F.col("t.status") == "passed", "pass").when(F.col("t.status") == "failed", "fail").otherwise("skip")
    return j.select("id", "suite", F.col("t.fullName").alias("test"), status.alias("status"), F.lit(None).cast("double").alias("seconds"), F.array_join("t.failureMessages", "\n").alias("message"))


def rspec_json(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    schema = "struct<examples:array<struct<full_description:string,status:string,file_path:string,line_number:int,run_time:double,exception:struct<class:string,message:string>>>>"
    j = df.select(F.col(id_col).alias("id"), F.from_json(F.col(text_col), schema).alias("j")).select("id", F.explode("j.examples").alias("t"))
    status = F.when(F.col("t.status") == "passed", "pass").when(F.col("t.status") == "failed", "fail").otherwise("skip")
    return j.select("id", F.col("t.file_path").alias("suite"), F.col("t.full_description").alias("test"), status.alias("status"), F.col("t.run_time").alias("seconds"), F.concat_ws(": ", "t.exception.class", "t.exception.message").alias("message"))


def totals(results: DataFrame, *by: str) -> DataFrame:
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    return results.groupBy("id", *by).agg(n("pass").alias("passed"), n("fail").alias("failed"), n("skip").alias("skipped"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))


def _n(x: Column, pattern: str) -> Column:
    """The number that a pattern captures, the last in the text; 0 where none."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.lit(-1)).cast("int"), F.lit(0))


def cargo_lines(x: Column | str) -> Column:
    """Counters of all ``test result`` lines of an output, summed: passed, failed, ignored, measured, filtered."""
    rows = F.filter(T.lines(x), lambda s: s.startswith("test result:"))
    sums = lambda word: F.aggregate(F.transform(rows, lambda s: _n(s, rf"(\d+) {word}")), F.lit(0), lambda a, b: a + b)
    return F.struct(F.size(rows).alias("suites"), sums("passed").alias("passed"), sums("failed").alias("failed"), sums("ignored").alias("ignored"), sums("measured").alias("measured"), sums("filtered out").alias("filtered"))


def pytest_summary(x: Column | str) -> Column:
    """Counters of the summary line."""
    line = F.coalesce(F.try_element_at(F.filter(T.lines(x), lambda s: s.rlike(r"\d+ (?:passed|failed|error|skipped)") & s.rlike(r" in \d")), F.lit(-1)), F.lit(""))
    return F.struct(*[_n(line, rf"(\d+) {w}").alias(w) for w in ("passed", "failed", "skipped", "xfailed", "xpassed")], _n(line, r"(\d+) errors?").alias("errors"))


def minitest_summary(x: Column | str) -> Column:
    return F.struct(*[_n(T.c(x), rf"(\d+) {w}").alias(w) for w in ("runs", "assertions", "failures", "errors", "skips")])


def generic_counts(x: Column | str) -> Column:
    """The last number before or after each keyword."""
    low = F.lower(T.c(x))
    return F.struct(*[_n(low, rf"(\d+)\s*{w}").alias(w) for w in ("passed", "failed", "skipped")])


#: What marks a line as an error or a warning.
ERROR_LINES = (
    r"(?i:^.*error[\s:\[].*$)", r"(?i:^.*\berr\b.*$)", r"(?i:^.*warning[\s:\[].*$)", r"(?i:^.*\bwarn\b.*$)", r"(?i:^.*failed.*$)", r"(?i:^.*failure.*$)", r"(?i:^.*exception.*$)", r"(?i:^.*panic.*$)",
    r"^error\[E\d+\]:.*$", r"^\s*--> .*:\d+:\d+$", r"^Traceback.*$", r"^\s*File \".*\", line \d+.*$", r"^\s*at .*:\d+:\d+.*$", r"^.*\.go:\d+:.*$",
)


def error_blocks(x: Column | str, patterns: tuple[str, ...] = ERROR_LINES) -> Column:
    """Error lines and their indented continuations; a block ends at a line that isn't indented or at the second blank one."""
    start = F.struct(F.lit(False).alias("on"), F.lit(0).alias("blank"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        hit = T.any_of(line, list(patterns))
        blank = T.is_blank(line)
        goes_on = s["on"] & ((blank & (s["blank"] == 0)) | (~blank & line.rlike(r"^\s")))
        return F.struct((hit | goes_on).alias("on"), F.when(blank & ~hit, s["blank"] + 1).otherwise(0).alias("blank"), F.when(hit | goes_on, F.concat(s["out"], F.array(line))).otherwise(s["out"]).alias("out"))

    return T.unlines(F.aggregate(T.lines(x), start, step, lambda s: s["out"]))

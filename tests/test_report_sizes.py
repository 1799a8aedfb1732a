"""Reports of many lines or rows, and values beyond the usual widths."""

import time

import pytest
from pyspark.sql import functions as F

from sieveline.operators import listings, summaries, tools


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def within(seconds, make):
    started = time.monotonic()
    out = make()
    assert time.monotonic() - started < seconds
    return out


def test_wc_report_finds_the_folder_once(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("id").cast("int") + 400), lambda i: F.concat(F.lit("1 2 3 dir/sub/f"), i.cast("string"))), "\n")
    got = within(20, lambda: spark.range(1).select(tools.wc_report(F.concat(text, F.lit("\n9 8 7 total"))).alias("x")).first().x)
    assert got == "\n".join([*[f"1L 2W 3B f{i}" for i in range(1, 401)], "Σ 9L 8W 7B"])


@pytest.mark.parametrize(
    ("err", "want"), [("odd 2404", "odd 2404"), ("odd 5001", "odd 5001"), ("ERROR 404: no", "404 Not Found"), ("got 403", "403 Forbidden"), ("401", "401 Unauthorized"), ("x 4040\nHTTP/1.1 500 y", "500 Server Error")]
)
def test_download_status_is_a_number_of_its_own(spark, err, want):
    assert one(spark, tools.download_error(F.lit(err), F.lit(""))) == want


def test_download_sizes(spark):
    size = lambda n, *unit: one(spark, tools.download_size(F.lit(n), *unit))
    assert [size(n) for n in (0, 1023, 1024, 1 << 20, 3 << 30)] == ["?", "1023B", "1.0KB", "1.0MB", "3.0GB"]
    assert size(1 << 20, "KB") == "1024.0KB" and size(3 << 30, "MB") == "3072.0MB" and size(5, "KB") == "5B"


def test_discovered_counts_of_six_digits(spark):
    scanned = spark.range(1).select(F.lit(3).alias("sessions"), F.lit(30).alias("days"), F.lit(40).alias("commands"), F.lit(10).alias("covered"))
    good = spark.createDataFrame([("git", 123456, "command", 5, "git log")], "command string, n long, via string, saved_tokens long, display string")
    rest = spark.createDataFrame([("foo", 1234567, "foo bar")], "command string, n long, example string")
    lines = lambda **k: [r.line for r in summaries.discover_lines(scanned, good, rest, **k).orderBy("n").collect()]
    assert "git log                  123456    command    ~5 tokens" in lines() and "foo                      1234567    foo" in lines()[-1]
    assert "git log                  12345    command    ~5 tokens" in lines(fixed=True) and "foo                      12345    foo" in lines(fixed=True)[-1]
    assert any("Total: 123456 commands" in x for x in lines(fixed=True))


def test_environment_reports_in_bulk(spark):
    text = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("LC_"), i.cast("string"), F.lit("="), F.col("id").cast("string"))), "\n")
    got = within(60, lambda: spark.range(0, 2000, 1, 4).select(listings.env_report(text(200)).alias("x")).groupBy().agg(F.count_if(F.col("x").endswith("Total: 200 vars (showing 20 relevant)\n")).alias("n"), F.max("x").alias("x")).first())
    assert got.n == 2000 and got.x.startswith("\nOther:\n  LC_1=") and "  ... +180 more\n" in got.x


@pytest.mark.parametrize("report", [listings.env_report, tools.wc_report])
def test_reports_name_their_text_a_few_times(spark, report):
    """Each place where the text stands in an expression over lines is worked out anew, for each line if it is inside of one."""
    plan = spark.createDataFrame([("A=1",)], "t string").select(report("t").alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("t#") < 10

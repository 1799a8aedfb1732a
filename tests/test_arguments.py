"""Arguments of search commands."""

import pytest
from pyspark.sql import functions as F

from sieveline.functions import arguments as A

CASES = [
    ("foo src/", "foo", "src/", ""), ("-i foo src/", "foo", "src/", "-i"), ("-A 2 error src", "error", "src", "-A 2"), ("-rn foo src", "foo", "src", "-n"), ("-rne PATTERN src", "PATTERN", "src", "-n"), ("-rA 2 foo src", "foo", "src", "-A 2"),
    ("TODO src tests", "TODO", "src tests", ""), ("-i x agent -g *.md", "x", "agent", "-i -g *.md"), ("-e foo -e bar src", "foo bar", "src", ""), ("-- --version", "--version", "", ""), ("", "", "", ""), ("foo", "foo", "", ""),
    ("-e foo -e bar src -e", "foo bar", "src", "-e"), ("-ecarrot file", "carrot", "file", ""), ("aaa sub -g*.rs", "aaa", "sub", "-g *.rs"), ("compact sub --glob *.md", "compact", "sub", "--glob *.md"), ("--max-count 1 fn file", "fn", "file", "--max-count 1"),
    ("-t rust fn src", "fn", "src", "-t rust"), ("-d 3 foo src", "foo", "src", "-d 3"), ("-M 120 foo src", "foo", "src", "-M 120"), ("--regexp a --regexp", "a", "", ""), ("-r --recursive foo", "foo", "", ""), ("- x", "-", "x", ""), ("foo -A", "foo", "", "-A"),
    ("--color=never foo --glob", "foo", "", "--color=never --glob"), ("-- -e x", "-e", "x", ""), ("-e -- x", "--", "x", ""), ("-RrB3 x", "x", "", "-B 3"), ("-rE foo", "foo", "", "-E"),
]


def test_search(spark):
    df = spark.createDataFrame([(a.split(), *[x.split() for x in want]) for a, *want in CASES], "a array<string>, patterns array<string>, paths array<string>, flags array<string>")
    for r in df.withColumn("got", A.search("a")).collect():
        assert tuple(r.got) == (r.patterns, r.paths, r.flags), r


@pytest.mark.parametrize(
    ("args", "want"),
    [
        ("", (80, 200, False, "", [])), ("-l 10 -m 5 foo -l 3", (10, 5, False, "", ["foo", "-l", "3"])), ("--max-len=7 --max=x --context-only -t py --file-type=go -i a", (7, 200, True, "go", ["-i", "a"])), ("-l x foo", (80, 200, False, "", ["foo"])),
        ("-m", (80, 200, False, "", [])), ("--max -3 --max-len +4 -- x", (4, -3, False, "", ["--", "x"])),
    ],
)
def test_own_options(spark, args, want):
    assert tuple(spark.range(1).select(A.own_options(F.array(*map(F.lit, args.split())) if args else F.array().cast("array<string>"))).first()[0]) == want


def test_whole_command(spark):
    got = spark.range(1).select(A.search_command(F.lit("rg -m 3 -rn 'fn run' \"my dir\" -g '*.rs'")), A.search_command(F.lit("grep x"))).first()
    assert tuple(got[0]) == (["fn run"], ["my dir"], ["-n", "-g", "*.rs"], 80, 3, False, "") and tuple(got[1]) == (["x"], ["."], [], 80, 200, False, "")

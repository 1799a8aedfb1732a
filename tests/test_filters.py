"""The filter engine against a plain version of its stages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sieveline.plans import catalog
from sieveline.plans import filters as P


def plain(d: P.FilterDef, text: str) -> str:
    if d.strip_ansi:
        text = re.sub(r"\x1b\[[0-9;]*[a-zA-Z]", "", text)
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    for p, r in d.replace:
        lines = [re.sub(p, r.replace("$", "\\"), x) for x in lines]
    blob = "\n".join(lines)
    for p, message, unless in d.match_output:
        if re.search(p, blob) and not (unless and re.search(unless, blob)):
            return message
    if d.strip_lines_matching:
        lines = [x for x in lines if not any(re.search(p, x) for p in d.strip_lines_matching)]
    elif d.keep_lines_matching:
        lines = [x for x in lines if any(re.search(p, x) for p in d.keep_lines_matching)]
    if d.truncate_lines_at is not None:
        lines = [x[: d.truncate_lines_at] if d.truncate_lines_at > 0 else x for x in lines]
    head, tail = d.head_lines or 0, d.tail_lines or 0
    if (d.head_lines is not None or d.tail_lines is not None) and len(lines) > head + tail:
        lines = [*lines[:head], f"... ({len(lines) - head - tail} lines omitted)", *(lines[-tail:] if tail else [])]
    if d.max_lines is not None and len(lines) > d.max_lines:
        lines = [*lines[: d.max_lines], f"... ({len(lines) - d.max_lines} lines truncated)"]
    out = "\n".join(lines)
    return d.on_empty if d.on_empty is not None and not out.strip() else out


DEFS = [
    P.FilterDef("ansi", strip_ansi=True, strip_lines_matching=(r"^\s*$",)),
    P.FilterDef("keep", keep_lines_matching=("error", "^b"), max_lines=3, on_empty="ok"),
    P.FilterDef("cut", truncate_lines_at=3, head_lines=2, tail_lines=2, max_lines=4),
    P.FilterDef("head", head_lines=2),
    P.FilterDef("tail", tail_lines=1, replace=(("a+", "A"), ("(b)(c)", "$2$1"))),
    P.FilterDef("match", match_output=(("done", "finished", "error"), ("error", "broken", None)), max_lines=2),
    P.FilterDef("zero", truncate_lines_at=0, on_empty="empty"),
]


@pytest.mark.parametrize("d", DEFS, ids=lambda d: d.name)
def test_apply(spark, d):
    rng = random.Random(d.name)
    pieces = ["aab", "bc", "error here", "", "  ", "\x1b[31mred\x1b[0m", "done", "é中文x", "b"]
    texts = ["", "\n", "\n\n", "x", *("\n".join(rng.choice(pieces) for _ in range(rng.randrange(9))) + rng.choice(["", "\n"]) for _ in range(150))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.apply(d, "t").alias("o")).collect()
    assert [(r.t, r.o) for r in got] == [(t, plain(d, t)) for t in texts]


def test_definitions(tmp_path, spark):
    (tmp_path / "a.toml").write_text('[filters.b]\nmatch_command = "^b\\\\b"\nmax_lines = 1\non_empty = "b: ok"\n[filters.a]\nmatch_command = "^[ab]"\n[[tests.b]]\nname = "one"\ninput = "x\\ny\\n"\nexpected = "x\\n... (1 lines truncated)\\n"\n[[tests.b]]\nname = "two"\ninput = ""\nexpected = "no"\n')
    defs = P.load(tmp_path)
    assert [d.name for d in defs] == ["a", "b"]
    assert [r.asDict() for r in P.verify(spark, defs).collect()] == [{"filter": "b", "total": 2, "passed": 1, "failed": 1}]
    got = P.apply_routed(spark.createDataFrame([("b x", "1\n2"), ("c", "1\n2")], "command string, raw string"), "command", "raw", [d for d in defs if d.name == "b"]).orderBy("command").collect()
    assert [(r.filter, r.filtered) for r in got] == [("b", "1\n... (1 lines truncated)"), (None, "1\n2")]
    assert spark.range(1).select(P.route(F.lit("b x"), defs)).first()[0] == "a"
    with pytest.raises(ValueError, match="exclude"):
        P.FilterDef("x", strip_lines_matching=("a",), keep_lines_matching=("b",))
    (tmp_path / "b.toml").write_text("[filters.z]\nmax_line = 1\n")
    with pytest.raises(ValueError, match="unknown"):
        P.load(tmp_path)


@pytest.mark.parametrize(
    ("command", "raw", "name", "want"),
    [
        ("make -j", "make[1]: Entering\n\nmake[1]: Leaving\n", "make", "make: ok"), ("ping h", "PING h\n64 bytes from h\n\n--- h\n1 sent\n", "ping", "--- h\n1 sent"),
        ("rsync a b", "sent 1\ntotal size is 3\n", "rsync", "ok (synced)"), ("rsync a b", "error x\ntotal size is 3", "rsync", "error x\ntotal size is 3"),
        ("df -h", "x" * 100, "df", "x" * 80), ("terraform plan", "\nRefreshing state...\n", "terraform-plan", "terraform plan: no changes detected"), ("nothing", "\n\n", None, "\n\n"),
    ],
)
def test_catalog(spark, command, raw, name, want):
    got = P.apply_routed(spark.createDataFrame([(command, raw)], "command string, raw string"), "command", "raw", catalog.DEFS).first()
    assert (got.filter, got.filtered) == (name, want)


def test_catalog_holds_its_samples(spark):
    from sieveline.plans.catalog import DEFS
    from sieveline.plans.samples import SAMPLES, with_samples

    assert len(DEFS) == 58 and {d.name for d in DEFS} == SAMPLES.keys()
    assert [r.filter for r in P.verify(spark, with_samples()).where("failed > 0").collect()] == []
    got = spark.createDataFrame([(n, c) for n, (c, _, _) in SAMPLES.items()], "name string, command string").select("name", P.route("command", DEFS).alias("got"))
    assert got.where("NOT name <=> got").collect() == []

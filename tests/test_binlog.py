"""Binary build logs that the tests write."""

import struct

import pytest
from pyspark.sql import functions as F

from sieveline.operators import dotnet
from sieveline.sources import binlog as B

n = B.number
T = lambda k: n(B.FIRST_TEXT + k)


def ticks(t):
    return n(B.HAS_TIME) + struct.pack("<q", t) + n(1)


def issue(kind, message, code, file, line, col):
    return kind, n(B.HAS_MESSAGE) + message + n(0) + code + file + n(0) + n(line) + n(col) + n(0) + n(0)


TEXTS = [(B.TEXT, s.encode()) for s in ("bad name", "CS0103", "src/A.cs", "/src/App.csproj", "IDE0055", "/r/B.cs(13,32): error IDE0055: Fix formatting")]


def build(spark, records, version=B.OLDEST):
    return B.builds(B.decode(spark.createDataFrame([("x", bytearray(B.written(records, version)))], "path string, content binary"))).first()


def test_numbers():
    for v in (0, 1, 127, 128, 300, 2**31 - 1, -1, -(2**31)):
        assert B._Bytes(iter([n(v)])).number() == v
    with pytest.raises(B.Damaged):
        B._Bytes(iter([b"\xff" * 6])).number()


def test_build(spark):
    project = (B.PROJECT_STARTED, n(0) + b"\1" + n(0) * 7 + T(3))
    r = build(spark, [*TEXTS[:4], (B.BUILD_STARTED, ticks(0)), project, project, issue(B.ERROR, T(0), T(1), T(2), 42, 15), issue(B.WARNING, n(1), n(0), n(0), -3, 0), (B.NAMES, b"abc"), (99, b"\xff\xff"), (B.BUILD_FINISHED, ticks(37_215_400_000) + b"\1")])
    b = r.build
    assert (b.succeeded, b.projects, b.duration, r.damaged) == (True, 1, "01:02:01.54", None)
    assert [tuple(e) for e in b.errors] == [("CS0103", "src/A.cs", 42, 15, "bad name")] and [tuple(e) for e in b.warnings] == [("", "", 0, 0, "")]


def test_texts_tell_more(spark):
    misread = [issue(B.ERROR, T(0), n(0), T(4), 0, 0)] * 3
    assert [e.file for e in build(spark, [*TEXTS, *misread]).build.errors] == ["/r/B.cs"]
    good = [*misread, issue(B.ERROR, T(0), T(1), T(2), 1, 1)]
    assert len(build(spark, [*TEXTS, *good]).build.errors) == 4


def test_fields_and_damaged_records(spark):
    flags = B.HAS_MESSAGE | B.HAS_CONTEXT | B.HAS_ARGUMENTS | B.HAS_IMPORTANCE | B.IS_EXTENDED
    full = (B.MESSAGE, n(flags) + T(0) + n(0) * 7 + n(0) + n(5) + n(0) + n(2) + T(1) + n(0) + n(1))
    cut = (B.ERROR, n(B.HAS_MESSAGE) + T(0))
    unknown = (B.MESSAGE, n(B.HAS_MESSAGE) + T(77))
    logs = spark.createDataFrame([("a", bytearray(B.written([*TEXTS[:2], full, cut, unknown])))], "path string, content binary")
    assert [(r.kind, r.message) for r in B.decode(logs).orderBy("no").collect()] == [("text", "bad name"), ("text", "CS0103"), ("message", "bad name")]


def test_damaged_logs(spark):
    good = B.written(TEXTS * 3000)
    logs = {"empty": b"", "none": None, "plain": b"not gzip", "short": good[: len(good) // 2], "old": B.written(TEXTS, 17), "good": good}
    rows = [(k, None if v is None else bytearray(v)) for k, v in logs.items()]
    got = {r.path: (r.damaged, r.build) for r in B.builds(B.decode(spark.createDataFrame(rows, "path string, content binary"))).collect()}
    assert {k for k, (d, _) in got.items() if d} == set(logs) - {"good"} and got["old"][0] == "unsupported format 17" and got["good"][1].projects == 3000
    assert B.builds(B.decode(spark.createDataFrame([], "path string, content binary"))).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "msbuild.binlog").write_bytes(B.written(TEXTS[:1]))
    (tmp_path / "other.txt").write_text("x")
    assert [r.message for r in B.events(spark, str(tmp_path)).collect()] == ["bad name"]


def test_many_blocks():
    many = [(B.TEXT, (f"text {i} " * 20).encode()) for i in range(20_000)]
    assert [m for _, m, *_ in B.read(B.written(many))] == [b.decode() for _, b in many]
    assert len(list(B.read(B.written(many[:3]) + b""))) == 3


def test_choice_of_issues(spark):
    kind = dotnet._ISSUE_TYPE
    rows = [
        ([("", "CS1000", 0, 0, "m")] * 3, [("", "src/a.cs", 1, 0, "")], "other"), ([("", "CS1000", 0, 0, "m")] * 3, [("", "", 1, 1, "m")], "first"), ([], [("", "", 0, 0, "")], "other"), ([("", "", 0, 0, "")], [], "first"),
        ([("", "", 0, 0, "Build issue")], [("", "", 0, 0, "told")], "other"), ([("CS1", "a.cs", 1, 1, "m")], [("CS1000", "a.cs", 1, 1, "m")], "other"), ([("CS1000", "a.cs", 1, 1, "m")], [("CS1000", "a.cs", 1, 1, "m")], "first"),
    ]
    df = spark.createDataFrame([(a, b, w) for a, b, w in rows], f"first {kind}, other {kind}, want string")
    for r in df.withColumn("got", dotnet.best_of(F.col("first"), F.col("other"))).collect():
        assert r.got == r[r.want], r

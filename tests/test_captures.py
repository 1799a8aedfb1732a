"""The live source of captures, batch and stream."""

import random

import pytest

from sieveline.sources.captures import Captures, _Folder


@pytest.fixture
def source(spark):
    spark.dataSource.register(Captures)
    return lambda stream=False, **o: ((spark.readStream if stream else spark.read).format("captures").options(**{k: str(v) for k, v in o.items()}).load())


def test_whole_captures(source, tmp_path):
    (tmp_path / "d").mkdir()
    files = {"a.txt": b"x\r\ny\rz\n", "d/b.txt": "é".encode(), "empty.txt": b"", "big.txt": b"1" * 101, "edge.txt": b"2" * 100, "bad.txt": b"\xff\n"}
    for f, raw in files.items():
        (tmp_path / f).write_bytes(raw)
    (tmp_path / ".part.txt").write_text("being written")
    (tmp_path / "other.log").write_text("no")
    got = {r.file: (r.size, r.text, r.error) for r in source(path=tmp_path, cap=100, suffix=".txt").collect()}
    assert got == {"a.txt": (7, "x\ny\nz\n", None), "d/b.txt": (2, "é", None), "empty.txt": (0, "", None), "big.txt": (101, None, "big.txt exceeds 100 byte limit"), "edge.txt": (100, "2" * 100, None), "bad.txt": (2, "�\n", None)}
    with pytest.raises(Exception, match="big.txt exceeds 100 byte limit"):
        source(path=tmp_path, cap=100, overflow="fail").collect()
    assert source(path=tmp_path / "none").count() == 0


def test_refused_options(tmp_path):
    for bad in ({}, {"path": "/x", "mode": "odd"}, {"path": "/x", "overflow": "cut"}):
        with pytest.raises(ValueError, match="captures need|mode is"):
            _Folder(bad)


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
def test_lines_in_ranges(source, tmp_path, split):
    rng = random.Random(split)
    texts = {f"f{k}": ["x" * rng.randrange(12) + "é" * rng.randrange(2) for _ in range(rng.randrange(30))] for k in range(4)}
    for f, ls in texts.items():
        (tmp_path / f).write_text("".join(x + "\n" for x in ls) + rng.choice(["", "open line"]))
    rows = source(path=tmp_path, mode="lines", split=split).orderBy("file", "at").collect()
    for f, ls in texts.items():
        assert [r.line for r in rows if r.file == f] == ls
        at = 0
        for r in (r for r in rows if r.file == f):
            assert r.at == at
            at += len(r.line.encode()) + 1


def test_partitions_by_size(tmp_path):
    for k in range(10):
        (tmp_path / f"s{k}").write_bytes(b"x" * 9 + b"\n")
    (tmp_path / "large").write_bytes(b"y\n" * 100)
    lines = _Folder({"path": str(tmp_path), "mode": "lines", "split": "40"})
    parts = lines.plan({}, lines.ends(lines.sizes()))
    assert all(sum(to - at for _, at, to, _ in p.parts) <= 40 for p in parts) and len(parts) == 8
    whole = _Folder({"path": str(tmp_path), "split": "40", "cap": "20"})
    assert sorted(f for p in whole.plan({"s1": 10}, whole.sizes()) for f, *_ in p.parts) == sorted({"large", *(f"s{k}" for k in range(10))} - {"s1"})


@pytest.mark.parametrize("mode", ["whole", "lines"])
def test_stream_started_again_reads_once(spark, source, tmp_path, mode):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    column = "line" if mode == "lines" else "text"

    def run():
        q = source(stream=True, path=src, mode=mode).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r[column] for r in spark.read.parquet(out).collect())

    (src / "a").write_text("one\n")
    (src / "b").write_text("two\n")
    first = ["one", "two"] if mode == "lines" else ["one\n", "two\n"]
    assert run() == first and run() == first
    (src / "c").write_text("three\n")
    with (src / "a").open("a") as f:
        f.write("more\nopen")
    if mode == "lines":
        assert run() == ["more", "one", "three", "two"]
        with (src / "a").open("a") as f:
            f.write(" line\n")
        assert run() == ["more", "one", "open line", "three", "two"]
    else:
        assert run() == ["one\n", "three\n", "two\n"]


def test_captures_that_grow_wait(tmp_path):
    from sieveline.sources.captures import _Stream

    s = _Stream(_Folder({"path": str(tmp_path)}))
    (tmp_path / "a").write_text("1")
    assert s.latestOffset() == {"a": 1}
    (tmp_path / "b").write_text("1")
    assert s.latestOffset() == {"a": 1}
    (tmp_path / "b").write_text("12")
    assert s.latestOffset() == {"a": 1}
    assert s.latestOffset() == {"a": 1, "b": 2}
    (tmp_path / "a").write_text("grown")
    assert s.latestOffset() == {"a": 5, "b": 2} and s.partitions({"a": 1}, {"a": 5, "b": 2})[0].parts == [("b", 0, 2, 2)]

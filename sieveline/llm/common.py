"""Shared helpers: table access, lineage cuts in the shared folder, word and shingle hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words end at these bytes; the same set that ``bytes.split()`` uses.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session on one machine gets a folder of its own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders of the tables that the open ``scratch`` blocks have written, innermost last.
_OPEN: list[list[str]] = []


def cut(df: DataFrame, *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``folders``, and read it back: later plans start from files that any executor can read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.partitionBy(*folders).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``cut`` that nothing reads any more; other tables are left alone."""
    for t in tables:
        if path := getattr(t, "_written", None):
            _delete(t.sparkSession, path)
            for o in _OPEN:
                if path in o:
                    o.remove(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end what ``cut`` wrote inside, but for tables handed to the function that it yields: a result is read from those."""
    _OPEN.append([])
    kept: set[str] = set()

    def keep(t: DataFrame) -> DataFrame:
        if path := getattr(t, "_written", None):
            kept.add(path)
        return t

    try:
        yield keep
    finally:
        own = _OPEN.pop()
        for path in own:
            if path not in kept:
                _delete(spark, path)
        if _OPEN:
            _OPEN[-1].extend(p for p in own if p in kept)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Hands freed memory back to the system: workers live on between tasks, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def thrifty(run):
    """A function over batches that gives its memory back at the end of a task."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def small_side(ids: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A table of a few numbers a row, marked for broadcasting if it has at most ``rows`` rows (16 MB), else as it is."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids


def _repeats(plan) -> bool:
    """Whether a plan gives the same rows in the same partitions each time it runs, whichever columns are read: scans, projections, filters."""
    if plan.nodeName() not in ("Project", "Filter", "LogicalRelation", "LocalRelation") and not plan.nodeName().startswith("Relation"):
        return False
    kids = plan.children()
    return all(_repeats(kids.apply(k)) for k in range(kids.size()))


def share(*columns) -> Column:
    """A number from 0 to 1 by the hash of some columns, fine enough to draw a few thousand of any number of rows."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def settled(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it gives the same rows in the same order at each run, else a copy in the shared folder."""
    return docs if _repeats(docs._jdf.queryExecution().optimizedPlan()) else cut(docs)


def with_row(docs: DataFrame, id_col: str, text_col: str, twice: bool = False) -> DataFrame:
    """(row, id, text): an own number for each row, since ids may be null or repeated. Other columns go.

    Row numbers hold within one run of the plan. With ``twice`` they hold over several: inputs other than plain
    scans are then written to the shared folder first.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return cut(rows) if twice and not _repeats(docs._jdf.queryExecution().optimizedPlan()) else rows


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased: ``bytes.lower`` and ``bytes.split`` are ASCII only, as the contract asks."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], n: int = 5) -> np.ndarray:
    """64-bit hashes of the n-word shingles in order, repeats kept; fewer words than n make one shingle, no word none."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return mix(np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=n)], np.uint64))
    h = word_hashes(words)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += (h[k : k + m] ^ (h[k : k + m] >> np.uint64(31))) * _MUL[k % 5] + np.uint64(k // 5)
        out = (out << np.uint64(7)) | (out >> np.uint64(57))
    return mix(out)


def exact_shingles(texts: list[list[bytes]], n: int = 5) -> list[np.ndarray]:
    """For word lists: the sorted distinct numbers of their n-word shingles. Within one call equal shingles, and only those, have equal numbers.

    Words are numbered, then neighbouring runs are numbered pair by pair, so no hash decides. Fewer words than n make
    one shingle of their own length, no word none.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    seen: dict[bytes, int] = {}
    word = np.fromiter((seen.setdefault(w, len(seen)) for t in texts for w in t), np.int64, int(size.sum()))
    starts = np.cumsum(size) - size
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    run, have = word, 1
    while have < n and len(run):
        step = min(have, n - have)
        # the run of ``have`` words from each place, with the run that ends ``step`` words later; runs over the end of a text aren't used
        _, run = np.unique(run[:-step] * np.int64(len(word) + 1) + run[step:], return_inverse=True)
        have += step
    short: dict[tuple, int] = {}
    for k, (a, m) in enumerate(zip(starts.tolist(), size.tolist(), strict=True)):
        if m >= n:
            out[k] = np.unique(run[a : a + m - n + 1])
        elif m:
            out[k] = np.array([-1 - short.setdefault(tuple(texts[k]), len(short))], np.int64)
    return out

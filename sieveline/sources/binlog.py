"""Binary build logs: a gzip'd stream of records, each a kind, a length and fields of 7-bit integers, with texts in a table that grows along the stream.

A file is inflated a block at a time and read record by record; a task holds one block, one record and the file's texts, and gives events away in
batches. ``events`` has a row for each record, ``builds`` a row for each log with what the records tell, filled up from the log's own texts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bound
from ..operators import dotnet

#: Kinds of records.
END, BUILD_STARTED, BUILD_FINISHED, PROJECT_STARTED, PROJECT_FINISHED, ERROR, WARNING, MESSAGE, CRITICAL, ARCHIVE, NAMES, TEXT = 0, 1, 2, 3, 4, 9, 10, 11, 13, 17, 23, 24
KINDS = {BUILD_STARTED: "build_started", BUILD_FINISHED: "build_finished", PROJECT_STARTED: "project", PROJECT_FINISHED: "project", ERROR: "error", WARNING: "warning", MESSAGE: "message", CRITICAL: "message", TEXT: "text"}
#: Bits of the fields that an event has, and the number of the first text.
HAS_CONTEXT, HAS_MESSAGE, HAS_TIME, HAS_ARGUMENTS, HAS_IMPORTANCE, IS_EXTENDED = 1 << 0, 1 << 2, 1 << 5, 1 << 14, 1 << 15, 1 << 16
FIRST_TEXT = 10
#: Fixed value: the oldest format that is read.
OLDEST = 18
EVENTS = "path string, no long, kind string, message string, code string, file string, line int, col int, ticks long, succeeded boolean"
_BLOCK = 1 << 16
_ROWS = 4096


class Damaged(ValueError):
    """A log, or a record of it, that ends early or says what can't be."""


class _Bytes:
    """Bytes read on demand: from one record, or from blocks of a compressed stream."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.have, self.at = blocks, b"", 0

    def take(self, n: int) -> bytes:
        if n < 0:
            raise Damaged("negative length")
        parts = []
        while n > len(self.have) - self.at:
            parts.append(self.have[self.at :])
            n -= len(parts[-1])
            self.have, self.at = next(self.blocks, b""), 0
            if not self.have:
                raise Damaged("unexpected end of stream")
        parts.append(self.have[self.at : self.at + n])
        self.at += n
        return b"".join(parts) if len(parts) > 1 else parts[0]

    def ended(self) -> bool:
        if self.at == len(self.have):
            self.have, self.at = next(self.blocks, b""), 0
        return not self.have

    def number(self) -> int:
        """Seven bits a byte, the lowest first, as a signed 32-bit number."""
        value = 0
        for shift in range(0, 35, 7):
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if b < 0x80:
                value &= 0xFFFFFFFF
                return value - (1 << 32) if value >> 31 else value
        raise Damaged("invalid 7-bit number")


def _inflated(content: bytes) -> Iterator[bytes]:
    """Blocks of the text of one or several gzip members."""
    rest = content
    while rest:
        gz = zlib.decompressobj(wbits=31)
        try:
            while not gz.eof:
                block = gz.decompress(rest, _BLOCK)
                rest = gz.unconsumed_tail if not gz.eof else gz.unused_data
                if block:
                    yield block
                elif not gz.eof and not rest:
                    raise Damaged("gzip decode failed: the file ends early")
        except zlib.error as e:
            raise Damaged(f"gzip decode failed: {e}") from None


def _fields(r: _Bytes, text, version: int, importance: bool) -> tuple[str | None, int | None]:
    """What all events begin with: (message, ticks)."""
    flags, message, ticks = r.number(), None, None
    if flags & HAS_MESSAGE:
        message = text(r)
    if flags & HAS_CONTEXT:
        _context(r, version)
    if flags & HAS_TIME:
        ticks = struct.unpack("<q", r.take(8))[0]
        r.number()
    if flags & IS_EXTENDED:
        text(r)
        if version < 10:
            raise Damaged("legacy dictionary")
        r.number()
        text(r)
    if flags & HAS_ARGUMENTS:
        for _ in range(max(r.number(), 0)):
            text(r)
    if (version < 13 and importance) or flags & HAS_IMPORTANCE:
        r.number()
    return message, ticks


def _context(r: _Bytes, version: int) -> None:
    for _ in range(7 if version > 1 else 6):
        r.number()


def _event(kind: int, r: _Bytes, text, version: int) -> tuple | None:
    """(message, code, file, line, col, ticks, succeeded) of a record, or None for kinds that tell nothing here."""
    if kind not in KINDS:
        return None
    message, ticks = _fields(r, text, version, kind == MESSAGE)
    if kind == BUILD_STARTED:
        return None, None, None, None, None, ticks, None
    if kind == BUILD_FINISHED:
        return None, None, None, None, None, ticks, r.take(1) != b"\0"
    if kind in (PROJECT_STARTED, PROJECT_FINISHED):
        if kind == PROJECT_STARTED and r.take(1) != b"\0":
            _context(r, version)
        file = text(r)
        return (None, None, file, None, None, None, None) if file else None
    if kind in (ERROR, WARNING):
        text(r)
        code, file = text(r), text(r)
        text(r)
        line, col = r.number(), r.number()
        r.number(), r.number()
        return message or "", code or "", file or "", max(line, 0), max(col, 0), None, None
    return (message, None, None, None, None, None, None) if message is not None else None


def read(content: bytes) -> Iterator[tuple]:
    """(kind, message, code, file, line, col, ticks, succeeded) for each record that tells something. Damaged records are left out; a damaged log raises."""
    if not content:
        raise Damaged("empty file")
    stream = _Bytes(_inflated(content))
    version = struct.unpack("<i", stream.take(4))[0]
    stream.take(4)
    if version < OLDEST:
        raise Damaged(f"unsupported format {version}")
    texts: list[str] = []

    def text(r: _Bytes) -> str | None:
        n = r.number()
        if n == 1:
            return ""
        if n < FIRST_TEXT:
            return None
        if n - FIRST_TEXT >= len(texts):
            raise Damaged(f"no text {n}")
        return texts[n - FIRST_TEXT]

    while not stream.ended():
        kind = stream.number()
        if kind == END:
            return
        body = stream.take(stream.number())
        if kind == TEXT:
            texts.append(body.decode("utf-8", "replace"))
            yield "text", texts[-1], None, None, None, None, None, None
        elif kind not in (NAMES, ARCHIVE):
            try:
                found = _event(kind, _Bytes(iter([body])), text, version)
            except (Damaged, struct.error):
                continue
            if found:
                yield KINDS[kind], *found


def _rows(batches):
    names = [f.split()[0] for f in EVENTS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]

    def batch(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows, no = [], 0
            try:
                for no, found in enumerate(read(content.as_py() or b"")):  # noqa: B007
                    rows.append((path, no, *found))
                    if len(rows) == _ROWS:
                        yield batch(rows)
                        rows = []
            except Damaged as e:
                rows.append((path, no + 1, "damaged", str(e), None, None, None, None, None, None))
            if rows:
                yield batch(rows)


def decode(logs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``EVENTS`` of logs that stand in a binary column. A log that can't be read to its end has a last row of kind ``damaged`` with the reason; null counts as empty."""
    return logs.select(F.col(path).cast("string"), F.col(content)).mapInArrow(_rows, EVENTS)


def events(spark: SparkSession, path: str) -> DataFrame:
    """``EVENTS`` of all logs below a path."""
    return decode(spark.read.format("binaryFile").option("pathGlobFilter", "*.binlog").option("recursiveFileLookup", "true").load(path))


def duration(ticks: Column) -> Column:
    """Ticks of 100 ns as hours, minutes, seconds and hundredths."""
    s = F.floor(ticks / 10_000_000).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.call_function("div", s, F.lit(3600))
    return F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.call_function("div", s % 3600, F.lit(60))), F.lit(":"), two(s % 60), F.lit("."), two(F.call_function("div", F.pmod(ticks, F.lit(10_000_000)), F.lit(100_000))))


def builds(found: DataFrame) -> DataFrame:
    """(path, damaged, build, texts): a build struct as ``dotnet.build`` gives it for each log, and all texts of the log, by which its tests and restored packages are found.

    Issues come from the records unless those of the texts tell more; projects from the records, else from the texts. A damaged log has null as its build.
    """
    issue = F.struct("no", F.struct("code", "file", F.col("line"), "col", "message").alias("issue"))
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, issue))), lambda x: x["issue"])
    logs = found.groupBy("path").agg(
        F.max(F.when(F.col("kind") == "damaged", F.col("message"))).alias("damaged"), of("error").alias("errors"), of("warning").alias("warnings"), F.collect_set(F.when(F.col("kind") == "project", F.col("file"))).alias("files"),
        F.max_by("ticks", F.when(F.col("kind") == "build_started", F.col("no"))).alias("began"), F.max_by("ticks", F.when(F.col("kind") == "build_finished", F.col("no"))).alias("ended"), F.max_by("succeeded", F.when(F.col("kind") == "build_finished", F.col("no"))).alias("ok"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "text", F.struct("no", "message")))), lambda x: x["message"]), "\n").alias("texts"))
    either = lambda own, told: bound(F.struct(F.col(own).alias("own"), told.alias("told")), lambda p: dotnet.best_of(p["own"], p["told"]))
    build = bound(dotnet.build("texts"), lambda told: F.struct(
        F.coalesce("ok", F.lit(False)).alias("succeeded"), F.when(F.size("files") > 0, F.size("files")).otherwise(told["projects"]).alias("projects"),
        either("errors", told["errors"]).alias("errors"), either("warnings", told["warnings"]).alias("warnings"), F.when(F.col("ended") >= F.col("began"), duration(F.col("ended") - F.col("began"))).alias("duration")))
    return logs.select("path", "damaged", F.when(F.col("damaged").isNull(), build).alias("build"), "texts")


def number(n: int) -> bytes:
    """A number as 7-bit bytes."""
    n &= 0xFFFFFFFF
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def written(records: list[tuple[int, bytes]], version: int = OLDEST) -> bytes:
    """A log of (kind, body) records: the counterpart of ``read``."""
    gz = zlib.compressobj(wbits=31)
    raw = struct.pack("<ii", version, version) + b"".join(number(k) + number(len(b)) + b for k, b in records) + number(END)
    return gz.compress(raw) + gz.flush()

"""Exact dedup by deterministic block naming.

A text is cut into blocks of fixed size. Equal blocks get one integer name: blocks are dealt by
content, sorted, and numbered where the content changes. Then adjacent pairs of names are named in
the same way, level by level, until one name is left of each document. Two texts of the same length
have the same last name exactly if they are equal, so an identity has no collisions; no digest decides.

Only contents are dealt by content, not the places where they stand: a task sends each content once for every ``FOLD`` bytes
of distinct contents that it reads, with a reference, and names come back to the places by reference, which deals them
evenly. So a text that fills a third of the table arrives at its naming task as a row for each such portion, not for
each copy. Names depend on contents and the deal only, so a task that runs again after a lost executor gives the same ones.
Each level is written to the shared folder.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, discard, scratch, thrifty, with_row

#: Bytes of distinct contents that a task remembers before it starts anew.
FOLD = 32_000_000
PLACES = "ref long, content binary, row long, pos int, n int, size long"
_SPACE = b" \t\n\x0b\x0c\r"


def normal(text: str | None) -> bytes:
    """Each run of white space (0x20, 0x09 to 0x0D) as one space, in UTF-8; null is empty."""
    if not text:
        return b""
    raw = text.encode("utf-8", "surrogatepass")
    body = b" ".join(raw.split())
    if not body:
        return b" "
    return (b" " if raw[0] in _SPACE else b"") + body + (b" " if raw[-1] in _SPACE else b"")


class _Folding:
    """Places of one task, each with a reference to its content; a content is given with the first of its places only."""

    def __init__(self):
        self.next, self.known, self.held = TaskContext.get().partitionId() << 40, {}, 0
        self.columns: tuple[list, ...] = ([], [], [], [], [], [])

    def add(self, content: bytes, *place: int) -> None:
        ref = self.known.get(content)
        given = ref is None
        if given:
            if self.held > FOLD:
                self.known, self.held = {}, 0
            ref = self.known[content] = self.next
            self.next += 1
            self.held += len(content) + 100
        for c, v in zip(self.columns, (ref, content if given else None, *place), strict=True):
            c.append(v)

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        out = pa.record_batch([pa.array(c, t) for c, t in zip(self.columns, kinds, strict=True)], ["ref", "content", "row", "pos", "n", "size"])
        self.columns = ([], [], [], [], [], [])
        return out


def _split(block: int):
    def run(batches):
        fold = _Folding()
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = normal(text)
                n = max(1, -(-len(raw) // block))
                for pos in range(n):
                    fold.add(raw[pos * block : (pos + 1) * block], row, pos, n, len(raw))
            yield fold.batch()

    return run


def _paired(batches):
    fold = _Folding()
    for b in batches:
        for content, *place in zip(*[c.to_pylist() for c in b.columns], strict=True):
            fold.add(content, *place)
        yield fold.batch()


def _number(batches):
    base, last, name = TaskContext.get().partitionId() << 40, None, -1
    for b in batches:
        names = []
        for content in b.column(1).to_pylist():
            if content != last:
                last, name = content, name + 1
            names.append(base + name)
        yield pa.record_batch([b.column(0), pa.array(names, pa.int64())], ["ref", "name"])


def _named(folded: DataFrame) -> DataFrame:
    """(row, pos, n, size, name) for each place (ref, content, row, pos, n, size)."""
    places = cut(folded)
    dealt = places.where("content IS NOT NULL").select("ref", "content").repartition("content").sortWithinPartitions("content")
    named = cut(places.drop("content").join(dealt.mapInArrow(thrifty(_number), "ref long, name long"), "ref").drop("ref"))
    discard(places)
    return named


def identities(rows: DataFrame, block: int = 4096) -> DataFrame:
    """(row, size, name) for rows (row, text): equal texts, and only those, agree in size and name."""
    level = _named(rows.select("row", "text").mapInArrow(thrifty(_split(block)), PLACES))
    done = level.where("n = 1").select("row", "size", "name")
    while level.where("n > 1").limit(1).count():
        side = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = level.where("n > 1").groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos"), F.ceil(F.col("n") / 2).cast("int").alias("n"), "size").agg(F.max(side[0]).alias("a"), F.max(side[1]).alias("b"))
        content = F.concat(*[F.unhex(F.lpad(F.hex(F.coalesce(c, F.lit(-1))), 16, "0")) for c in (F.col("a"), F.col("b"))])
        level = _named(pairs.select(content.alias("content"), "row", "pos", "n", "size").mapInArrow(thrifty(_paired), PLACES))
        done = done.unionByName(level.where("n = 1").select("row", "size", "name"))
    return done


def _hashed(batches):
    for b in batches:
        sha = [hashlib.sha256(normal(t)).hexdigest() for t in b.column(2).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(sha, pa.string())], ["row", "id", "text_sha256"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays (a null id counts as the largest; of rows with
    the same id the first read stays). Null and empty texts are equal. Repeated rows are rows of their own, texts of any length are
    compared whole, extra columns are ignored. An empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        rows = with_row(docs, id_col, text_col, twice=True)
        hashed = StructType([StructField("row", LongType()), rows.schema["id"], StructField("text_sha256", StringType())])
        known = keep(cut(identities(rows, block).join(rows.mapInArrow(thrifty(_hashed), hashed), "row")))
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
        groups = keep(cut(known.groupBy("size", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))))
    return known.join(groups, ["size", "name"]).select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"
    )

"""Best-fit-decreasing packing of documents into token sequences.

Lengths are whole numbers up to the capacity, so pieces of one length are interchangeable and best
fit can be planned on the histogram of lengths. The plan takes lengths from the largest to the
smallest; a segment tree over remaining capacities finds the tightest open bin in logarithmic time,
and all bins with that remainder take pieces in one step. This gives what best-fit decreasing gives
piece by piece, over all pieces of all tasks, from at most ``capacity`` counts on the driver. Each
piece then finds its bin by its rank among the pieces of its length. Ranks are counted in hashed
buckets whose sizes are summed first, so a length that a third of all pieces share is still spread.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import cut, tasks, thrifty, with_row


class CapacityTree:
    """Segment tree over remaining capacities 0..n: counts of open bins; finds the smallest remainder >= x that has any."""

    def __init__(self, n: int):
        self.size = 1 << max(1, (n + 1).bit_length())
        self.sum = [0] * (2 * self.size)

    def add(self, at: int, count: int) -> None:
        i = at + self.size
        while i:
            self.sum[i] += count
            i >>= 1

    def tightest(self, x: int) -> int | None:
        i = x + self.size
        if self.sum[i]:
            return x
        while i > 1 and (i & 1 or not self.sum[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i = 2 * i if self.sum[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, pieces per bin, first bin, offset in each bin), and the number of bins."""
    tree, open_bins = CapacityTree(capacity), {}  # remainder -> ranges (first bin, bins)
    runs, bins = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, have = bins, -(-left // per)
                bins += have
            else:
                per = room // length
                first, have = open_bins[room].pop()
                tree.add(room, -have)
            used = min(have, -(-left // per))
            whole = min(used, left // per)
            runs.append((length, rank, min(left, used * per), per, first, capacity - room))
            for start, count, rest in ((first, whole, room - per * length), (first + whole, used - whole, room - (left - whole * per) * length), (first + used, have - used, room)):
                if count:
                    open_bins.setdefault(rest, []).append((start, count))
                    tree.add(rest, count)
            took = min(left, used * per)
            left, rank = left - took, rank + took
    return runs, bins


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, piece, start, length, ids_crc32): only documents over the capacity are cut, their first piece is the short one."""

    def run(batches):
        enc = bpe.encoder(tokenizer_file)
        end = end_id.to_bytes(4, "little")
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for k, text in enumerate(b.column(2).to_pylist()):
                raw = enc.raw(text) + end
                n, at = len(raw) // 4, 0
                size = n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    for c, v in zip(cols, (k, piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])), strict=True):
                        c.append(v)
                    at, size = at + size, capacity
            which = pa.array(cols[0], pa.int64())
            yield pa.record_batch([b.column(0).take(which), b.column(1).take(which), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], ["row", "id", "piece", "start", "length", "ids_crc32"])

    rows = with_row(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(thrifty(run), f"row long, id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 20_000) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end token. Rows with null or repeated ids are packed each
    for itself. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cutted = cut(pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col))
    counts = {r[0]: r[1] for r in cutted.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs, _ = plan(counts, capacity)
    schema = "length long, first_rank long, n long, per long, first_bin long, base long"
    table = spark.createDataFrame(runs, schema).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "n", "per", "first_bin", "base"))).alias("runs"))

    buckets = max(tasks(spark), sum(counts.values()) // rows_per_bucket)
    dealt = cutted.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("row", "piece")
    ranked = dealt.withColumn("own", F.row_number().over(own)).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    # the plan has a few rows per length at most, and lengths are bounded by the capacity
    placed = ranked.join(F.broadcast(table), "length").withColumn("r", F.element_at(F.filter("runs", lambda r: r["first_rank"] <= F.col("rank")), -1))
    k = F.col("rank") - F.col("r.first_rank")
    per = F.col("r.per")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("r.first_bin") + F.floor(k / per)).cast("long").alias("sequence_id"),
        (F.col("r.base") + (k % per) * F.col("length")).cast("long").alias("offset"),
    )

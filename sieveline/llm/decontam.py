"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Containment of a short item in a long text gives a tiny Jaccard similarity, which MinHash can't see.
So the domain is partitioned by size. Items fall into classes of doubling shingle counts [s, 2s); for each class
texts are covered by windows of 4s shingles in steps of 2s (a shorter text is one window), so an item
that stands in a text lies whole in some window, and the similarity of the two is bounded
below. From that bound each class gets as many one-row bands (independent hash functions) as the
recall asks for. A text and an item whose minima agree in a band of some window are candidates, and
candidates are decided by exact containment of the item's word shingles in the whole text.

A benchmark of at most ``block_items`` items and ``block_bytes`` of text (both counted first) is sent out as one table, and texts are held against it in one
pass without a shuffle. A larger one stays a table: its items and the windows of the texts both give band values,
which are joined; a bit map of the items' band values, of bounded size, keeps band values of no item from being
shuffled. Either way texts are read once, however many items there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import cut, mix, scratch, shingle_hashes, thrifty, with_row, words_of

SEED = 20_231


def shingles(words: list[bytes], n: int) -> set:
    """Distinct n-word shingles; fewer words make one shingle of the whole sequence, no word none."""
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def bands(threshold: float, recall: float) -> int:
    """Hash functions needed for the recall: an item of s shingles, contained at the threshold, in a window of 4s."""
    j = threshold / (4 + 1 - threshold)
    return math.ceil(math.log(1 - recall) / math.log(1 - j))


class Bands:
    """Minima of windows under each of some hash functions."""

    def __init__(self, n: int, threshold: float, recall: float):
        rng = np.random.default_rng(SEED)
        self.n, self.threshold, self.k = n, threshold, bands(threshold, recall)
        self.mul = rng.integers(0, 1 << 32, self.k, np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, self.k, np.uint32)

    def hash(self, x: np.ndarray, j: int) -> np.ndarray:
        h = x.astype(np.uint32) * self.mul[j] + self.add[j]
        return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)

    def windows(self, hashes: list[np.ndarray], classes: list[int]):
        """(band, class, minima, texts) for each band and size class: a minimum for each window, and the text it is of. Texts are lists of shingle hashes in order."""
        sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        some = np.flatnonzero(sizes)
        if not len(some) or not classes:
            return
        flat, own = np.concatenate([hashes[i] for i in some]).astype(np.uint32), sizes[some]
        starts = np.cumsum(own) - own
        step = 2 << min(classes)
        # cells of the smallest class's step, restarting with each text; larger classes join cells
        cells = -(-own // step)
        first = np.cumsum(cells) - cells
        at = np.repeat(starts, cells) + step * (np.arange(cells.sum()) - np.repeat(first, cells))
        text = np.repeat(np.arange(len(some)), cells)
        pos = np.arange(len(text)) - first[text]
        for j in range(self.k):
            low = np.minimum.reduceat(self.hash(flat, j), at)
            for c in classes:
                wide = (2 << c) // step
                starts_c = np.flatnonzero(pos % wide == 0) if wide > 1 else None
                m, t = (low, text) if starts_c is None else (np.minimum.reduceat(low, starts_c), text[starts_c])
                pair = m.copy()  # a window is two neighbouring steps of one text
                same = t[1:] == t[:-1]
                pair[:-1][same] = np.minimum(m[:-1], m[1:])[same]
                yield j, c, pair, some[t]


def size_class(shingles: int) -> int:
    return max(0, shingles.bit_length() - 1)


class Items(Bands):
    """A block of benchmark items: minima by size class, in sorted arrays behind a bit filter."""

    def __init__(self, rows: list[tuple], n: int, threshold: float, recall: float):
        super().__init__(n, threshold, recall)
        self.ids = [r[0] for r in rows]
        self.sets = [shingles(words_of(r[1]), n) for r in rows]
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if s:
                classes.setdefault(size_class(len(s)), []).append(i)
        self.bits = max(16, (4 * len(rows)).bit_length() + 2)
        self.classes = {}
        hashes = [np.unique(shingle_hashes(words_of(r[1]), n)) for r in rows]
        for c, members in sorted(classes.items()):
            minima = np.array([[self.hash(hashes[i], j).min() for i in members] for j in range(self.k)], np.uint32)
            order = np.argsort(minima, axis=1, kind="stable")
            seen = np.zeros((self.k, 1 << self.bits), bool)
            for j in range(self.k):
                seen[j, minima[j] & np.uint32((1 << self.bits) - 1)] = True
            self.classes[c] = (np.take_along_axis(minima, order, 1), np.array(members)[order], seen)

    def candidates(self, hashes: list[np.ndarray]) -> set[tuple[int, int]]:
        """(text, item) pairs that share a band."""
        found: set[tuple[int, int]] = set()
        for j, c, pair, text in self.windows(hashes, list(self.classes)):
            minima, members, seen = self.classes[c]
            maybe = np.flatnonzero(seen[j, pair & np.uint32((1 << self.bits) - 1)])
            if len(maybe):
                v = pair[maybe]
                lo, hi = np.searchsorted(minima[j], v, "left"), np.searchsorted(minima[j], v, "right")
                for k in np.flatnonzero(hi > lo):
                    found.update((int(text[maybe[k]]), int(i)) for i in members[j, lo[k] : hi[k]])
        return found


def _portions(texts: list, n: int):
    """Words and shingle hashes of texts, some 400,000 words at a time, with the place of the first."""
    at = 0
    while at < len(texts):
        words, hashes, held, first = [], [], 0, at
        while at < len(texts) and (not words or held < 400_000):
            ws = words_of(texts[at])
            texts[at] = None
            words.append(ws)
            hashes.append(shingle_hashes(ws, n))
            held += len(ws)
            at += 1
        yield first, words, hashes


def _search(items: Items, item_type: pa.DataType):
    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for first, words, hashes in _portions(b.column(1).to_pylist(), items.n):
                last, own = None, set()
                for t, i in sorted(items.candidates(hashes)):
                    if t != last:
                        last, own = t, shingles(words[t], items.n)
                    shared = len(items.sets[i] & own)
                    if shared and shared >= items.threshold * len(items.sets[i]):
                        for c, v in zip(out, (first + t, items.ids[i], shared, len(items.sets[i])), strict=True):
                            c.append(v)
            yield _found(b.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], item_type), out[2], out[3])

    return run


def _found(ids, items, shared: list[int], size: list[int]) -> pa.RecordBatch:
    share = [a / b for a, b in zip(shared, size, strict=True)]
    return pa.record_batch([ids, items, pa.array(shared, pa.int64()), pa.array(size, pa.int64()), pa.array(share, pa.float64())], ["id", "item_id", "n_shared", "n_item", "containment"])


def _band_keys(of: Bands, bits: int, seen: np.ndarray | None, classes: list[int] | None):
    """(row, key, slot, cls) for (row, text): the band values of items (classes None), or those of texts that the bit map has."""

    def run(batches):
        for b in batches:
            row = b.column(0).to_numpy()
            for first, _, hashes in _portions(b.column(1).to_pylist(), of.n):
                parts: list[list] = [[], [], []]
                if classes is None:
                    sets = [np.unique(h) for h in hashes]
                    some = np.flatnonzero([len(x) for x in sets])
                    own = np.array([size_class(len(sets[i])) for i in some], np.int64)
                    found = ((j, own, np.array([of.hash(sets[i], j).min() for i in some], np.uint32), some) for j in range(of.k)) if len(some) else ()
                else:
                    found = of.windows(hashes, classes)
                for j, c, minima, text in found:
                    key = mix(minima.astype(np.uint64) ^ mix(np.atleast_1d(np.asarray(c, np.uint64)) * np.uint64(65536) + np.uint64(j)))
                    slot = (key >> np.uint64(64 - bits)).astype(np.int64)
                    keep = slice(None) if seen is None else (seen[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
                    for x, v in zip(parts, (row[first + text[keep]], key[keep].astype(np.int64), np.broadcast_to(c, minima.shape)[keep]), strict=True):
                        x.append(v)
                rows, keys, cls = (np.concatenate(x) if x else np.empty(0, np.int64) for x in parts)
                pair, at = np.unique(np.stack([rows, keys]), axis=1, return_index=True) if len(rows) else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
                slot = (pair[1].astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                yield pa.record_batch([pa.array(pair[0]), pa.array(pair[1]), pa.array(slot), pa.array(cls[at], pa.int64())], ["row", "key", "slot", "cls"])

    return run


def _contained(n: int, threshold: float):
    def run(batches):
        for b in batches:
            shared, size = [], []
            for t, i in zip(b.column("text").to_pylist(), b.column("item_text").to_pylist(), strict=True):
                item = shingles(words_of(i), n)
                shared.append(len(item & shingles(words_of(t), n)))
                size.append(len(item))
            found = _found(b.column("id"), b.column("item_id"), shared, size)
            yield found.filter(pa.array([s > 0 and s >= threshold * m for s, m in zip(shared, size, strict=True)], pa.bool_()))

    return run


def _joined(docs: DataFrame, items: DataFrame, n: int, threshold: float, recall: float, out: StructType, bits: int) -> DataFrame:
    """The search with items as a table: (row, id, text) held against items (row, id, text)."""
    spark, of = docs.sparkSession, Bands(n, threshold, recall)
    kind = "row long, key long, slot long, cls long"
    keys = cut(items.select("row", "text").mapInArrow(_band_keys(of, bits, None, None), kind))
    classes = sorted(r[0] for r in keys.select("cls").distinct().collect())  # at most 64
    if not classes:
        return spark.createDataFrame([], out)
    # at most 2 ** bits / 64 numbers, whatever the items
    words = keys.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 64))")).alias("bits")).toArrow()
    seen = np.zeros(1 << (bits - 6), np.uint64)
    seen[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype(np.uint64)
    sent = spark.sparkContext.broadcast(seen)
    met = docs.select("row", "text").mapInArrow(thrifty(lambda batches: _band_keys(of, bits, sent.value, classes)(batches)), kind).select("row", "key")
    pairs = cut(met.join(keys.select(F.col("row").alias("item"), "key"), "key").select("row", "item").distinct())
    whole = pairs.join(docs, "row").join(items.select(F.col("row").alias("item"), F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item")
    return cut(whole.select("id", "item_id", "text", "item_text").mapInArrow(thrifty(_contained(n, threshold)), out))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          n: int = 5, threshold: float = 0.75, recall: float = 0.999999, block_items: int = 10_000, block_bytes: int = 64_000_000, bits: int = 27) -> DataFrame:
    """(id, item_id, n_shared, n_item, containment) for each text that holds at least ``threshold`` of an item's distinct n-word shingles.

    A-Z are lower-cased, words end at white space. Null and empty texts and items hold nothing and are
    held by nothing. An item of fewer than n words is held only by a text of exactly these words. Repeated
    rows of ``docs`` give repeated rows; rows of ``benchmark`` are items each, also if ids repeat. Ids of either table are of any type, and
    null ids stay null; extra columns are ignored. Empty tables give no rows.
    """
    kinds = StructType([StructField("id", docs.schema[id_col].dataType), StructField("item_id", benchmark.schema[item_col].dataType)])
    out = StructType([*kinds.fields, *StructType.fromDDL("n_shared long, n_item long, containment double").fields])
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text"))
    first = items.limit(block_items + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if first[0] <= block_items and (first[1] or 0) <= block_bytes:
        block = Items([tuple(r) for r in items.collect()], n, threshold, recall)
        found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(thrifty(_search(block, to_arrow_type(kinds["item_id"].dataType))), out)
        return found.withColumnRenamed("id", id_col)
    with scratch(docs.sparkSession) as keep:
        items = with_row(benchmark, item_col, item_text, twice=True)
        found = keep(_joined(with_row(docs, id_col, text_col, twice=True), items, n, threshold, recall, out, bits))
    return found.withColumnRenamed("id", id_col)

"""Near duplicates by a chosen-path set similarity join.

Each document is the set of its word shingles; documents with the same set are one class with one
representative, once the full sets are seen to be equal. A class gets ``WIDTH`` minwise tokens (the shingle of smallest hash under each of that many
hash functions), so similar sets agree in most places. In each of several independent trees every node
picks a few of the places, by a hash of the node, and sends each of its classes to one child for each picked place,
named by the class's token there: a path that similar sets choose together. Nodes of at most
``leaf`` classes stop and are compared exhaustively; larger ones go on branching until the last level.
Nodes of many very similar classes never get small: large nodes that overlap are joined to a crowd, and a crowd is
compared whole, in tasks of two blocks of about ``block`` classes each, fewer where they are long. A crowd of many sizes, such as documents that
share no more than a passage, is cut into neighbouring sizes first.

Comparison is by four bits of each token; what is above a margin below the threshold is a candidate, and candidates
are decided on the full shingle sets. No list of pairs grows with the square of a group:

1. each class names its most similar partner in small nodes and, in a crowd, among a few leaders and sub-nodes the crowd is dealt into;
2. each class names its most similar partner of another component, now in whole crowds too (classes of one component aren't compared);
3. classes that still have candidates in another component are sent, with their texts, to the tasks in which they
   meet, where every candidate is decided; a task gives back at most one link less than it has classes.

A pair is passed over only if its two ends are connected already, which its link wouldn't change.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, exact_shingles, scratch, share, shingle_hashes, small_side, thrifty, with_row, words_of

WIDTH = 128
#: Standard deviations of the estimate below the threshold from which a pair isn't a candidate: 7.5e-5 of pairs at 0.75.
MARGIN = 4
SEED = 77_003


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, WIDTH, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, WIDTH, np.uint32)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens (sets x WIDTH) of non-empty arrays of shingle hashes."""
    mul, add = _functions()
    flat = np.concatenate(sets).astype(np.uint32)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(size) - size
    out = np.empty((len(sets), WIDTH), np.uint32)
    for j in range(WIDTH):
        h = flat * mul[j] + add[j]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x45D9F3B)
        out[:, j] = np.minimum.reduceat(h, starts)
    return out


def packed(tokens: np.ndarray) -> np.ndarray:
    """The low four bits of each token (rows x WIDTH), two to a byte."""
    low = (tokens & np.uint32(15)).astype(np.uint8)
    return low[:, 0::2] | low[:, 1::2] << np.uint8(4)


def _sketch(n: int):
    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            sizes, keys, tokens, low = [], [], [], []
            at = 0
            while at < len(texts):
                sets, slots, held = [], [], 0
                while at < len(texts) and (held == 0 or held < 300_000):
                    h = np.unique(shingle_hashes(words_of(texts[at]), n))
                    texts[at] = None
                    sizes.append(len(h))
                    keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                    tokens.append(None)
                    low.append(None)
                    if len(h):
                        slots.append(at)
                        sets.append(h)
                    held += len(h)
                    at += 1
                if sets:
                    found = minima(sets)
                    for slot, m, x in zip(slots, found, packed(found), strict=True):
                        tokens[slot], low[slot] = m.tobytes(), x.tobytes()
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary()), pa.array(low, pa.binary())], ["row", "id", "n_shingles", "set_key", "tokens", "low"])

    return run


def _branch(picks: float):
    """From (node, cls, tokens) to (node, cls) of the children. The root picks two places a tree, other nodes ``picks`` on average."""

    def run(batches):
        for b in batches:
            nodes, cls = b.column(0).to_numpy().astype(np.uint64), b.column(1)
            tok = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, WIDTH)
            out_n, out_c = [], []
            for k in range(2):
                h = _mix(nodes * np.uint64(2) + np.uint64(k))
                place = (h % np.uint64(WIDTH)).astype(np.int64)
                take = np.ones(len(nodes), bool) if k == 0 else (h >> np.uint64(40)).astype(float) / (1 << 24) < picks - 1
                rows = np.flatnonzero(take)
                child = _mix(h[rows] ^ (tok[rows, place[rows]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                out_n.append(child)
                out_c.append(rows)
            yield pa.record_batch([pa.array(np.concatenate(out_n).astype(np.int64)), cls.take(pa.array(np.concatenate(out_c)))], ["node", "cls"])

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _roots(trees: int):
    def run(batches):
        for b in batches:
            tok = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, WIDTH)
            out = []
            for tree in range(trees):
                base = np.uint64(tree * 1_000_003 + 17)
                for k in range(2):
                    h = _mix(np.array([base * np.uint64(2) + np.uint64(k)], np.uint64))[0]
                    out.append(_mix(h ^ (tok[:, int(h % np.uint64(WIDTH))].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
            cls = b.column(0)
            index = pa.array(np.tile(np.arange(len(tok)), len(out)))
            yield pa.record_batch([pa.array(np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)), cls.take(index)], ["node", "cls"])

    return run


def _least(threshold: float) -> float:
    """Estimates below this aren't candidates. Four bits agree by chance in one of sixteen places, which widens the estimate a little."""
    p = threshold + (1 - threshold) / 16
    return threshold - MARGIN * math.sqrt(p * (1 - p) / WIDTH) * 16 / 15


def _apart(s: float, levels: int, picks: float) -> float:
    """Probability that two classes that agree in a share ``s`` of the places share no node of a tree's last level."""
    below = 0.0
    for k in range(levels):
        lost = 1 - s * (1 - below)
        below = lost**2 if k == levels - 1 else (2 - picks) * lost + (picks - 1) * lost**2
    return below


def missed(trees: int, threshold: float, levels: int, picks: float) -> float:
    """Share of the pairs at the threshold that ``trees`` trees never bring together, of those that the margin lets pass.

    Nodes that stop earlier only add pairs, and all nodes are compared whole.
    """
    ks = [k for k in range(WIDTH + 1) if k / WIDTH >= _least(threshold)]
    return sum(math.comb(WIDTH, k) * threshold**k * (1 - threshold) ** (WIDTH - k) * _apart(k / WIDTH, levels, picks) ** trees for k in ks)


def trees_for(recall: float, threshold: float, levels: int, picks: float) -> int:
    """The least number of trees that miss at most ``1 - recall`` of the pairs at the threshold."""
    if recall >= 1:
        raise ValueError("recall must be below 1")
    trees = 1
    while missed(trees, threshold, levels, picks) > 1 - recall:
        trees += 1
    return trees


_NIBBLES = np.uint64(0x1111111111111111)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of packed tokens (as 64-bit numbers), corrected for those that agree by chance."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    same = WIDTH - np.bitwise_count(x & _NIBBLES).sum(-1, dtype=np.int64)
    return (same / WIDTH - 1 / 16) * (16 / 15)


def _low(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDTH // 16)


class Members:
    """Classes of some tasks: (cls, label, low, no1, no2). A class's ``no`` are partners that were found not to link with it."""

    def __init__(self, part: pa.Table):
        self.cls, self.label = (part.column(c).to_numpy() for c in ("cls", "label"))
        self.no = [part.column(c).fill_null(-1).to_numpy() for c in ("no1", "no2")]
        self.low = _low(part.column("low"))

    def similar(self, i, j, least: float) -> np.ndarray:
        """Estimates for pairs of indices; 0 where they are below ``least``, of one label or decided."""
        s = _agree(self.low[i], self.low[j])
        out = (s < least) | (self.label[i] == self.label[j])
        for no in self.no:
            out |= (no[i] == self.cls[j]) | (no[j] == self.cls[i])
        s[out] = 0
        return s


def _best(cls: np.ndarray, other: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """(a, b, s): the most similar of the partners of each class, the smallest of equals."""
    order = np.lexsort((other, -s, cls))
    cls, other, s = cls[order], other[order], s[order]
    first = np.flatnonzero(np.append(True, cls[1:] != cls[:-1])) if len(cls) else np.empty(0, np.int64)
    return pa.record_batch([pa.array(cls[first], pa.int64()), pa.array(other[first], pa.int64()), pa.array(s[first], pa.float64())], ["a", "b", "s"])


def _open(task: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
    """(task, cls) of classes that still have candidates in a task."""
    pair = np.unique(np.stack([task, cls]), axis=1) if len(cls) else np.empty((2, 0), np.int64)
    return pa.record_batch([pa.array(pair[0], pa.int64()), pa.array(pair[1], pa.int64())], ["task", "cls"])


def _in_nodes(least: float, name: bool):
    """Over rows sorted by node, all nodes of at most ``leaf`` classes: the best partner of each class, or the classes that have any."""

    def pairs(part: pa.Table):
        node, of = part.column("node").to_numpy(), Members(part)
        out: list[list] = [[], [], [], []]
        i, d = np.arange(len(node)), 0
        while len(i):
            d += 1
            i = i[i + d < len(node)]
            i = i[node[i] == node[i + d]]
            for at in range(0, len(i), 200_000):
                x = i[at : at + 200_000]
                s = of.similar(x, x + d, least)
                hit = np.flatnonzero(s)
                for c, v in zip(out, (node[x[hit]], of.cls[x[hit]], of.cls[x[hit] + d], s[hit]), strict=True):
                    c.append(v)
        node, a, b, s = (np.concatenate(c) if c else np.empty(0, np.int64) for c in out)
        if name:
            return _best(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s]))
        return _open(np.concatenate([node, node]), np.concatenate([a, b]))

    def run(batches):
        rest = None
        for b in batches:
            part = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            node = part.column("node").to_numpy()
            # the last node may go on in the next batch
            cut_at = int(np.searchsorted(node, node[-1], "left")) if len(node) else 0
            rest = part.slice(cut_at)
            if cut_at:
                yield pairs(part.slice(0, cut_at))
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    return run


def _in_blocks(least: float, name: bool):
    """The same over a task of two blocks of a crowd: pairs between its sides, or within its only side."""

    def run(part: pa.Table) -> pa.Table:
        of, side, task = Members(part), part.column("side").to_numpy(), part.column("task").to_numpy()
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(x) or not len(y)
        if alone:
            x = y = np.arange(len(side))
        out: list[list] = [[], [], []]
        for k, i in enumerate(x):
            own = y[k + 1 :] if alone else y
            s = of.similar(i, own, least)
            hit = np.flatnonzero(s)
            if name and len(hit):  # the best of i, and each other's own
                for c, v in zip(out, (np.full(len(hit), i), own[hit], s[hit]), strict=True):
                    c.append(v)
                if sum(map(len, out[0])) > 1_000_000:
                    a, b, s = (np.concatenate(c) for c in out)
                    out = _reduced(of.cls, a, b, s)
            elif len(hit):
                out[0].append(np.append(own[hit], i))
        if name:
            a, b, s = (np.concatenate(c) if c else np.empty(0, np.int64) for c in out)
            found = _best(of.cls[np.concatenate([a, b])], of.cls[np.concatenate([b, a])], np.concatenate([s, s]))
        else:
            some = np.unique(np.concatenate(out[0])) if out[0] else np.empty(0, np.int64)
            found = _open(task[some], of.cls[some])
        return pa.Table.from_batches([found])

    return run


def _reduced(cls: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> list[list]:
    """Of pairs of indices those that are the best of either end."""
    keep = np.zeros(len(a), bool)
    for x, y in ((a, b), (b, a)):
        order = np.lexsort((cls[y], -s, x))
        keep[order[np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1]))]] = True
    return [[a[keep]], [b[keep]], [s[keep]]]


def crowds(large: DataFrame) -> DataFrame:
    """(crowd, cls): large nodes (node, cls) that overlap, directly or over others, as one."""
    first = cut(large.groupBy("node").agg(F.min("cls").alias("a")))
    links = cut(large.join(first, "node").where("cls <> a").select("a", F.col("cls").alias("b")).distinct())
    return components(links).select(F.col("label").alias("crowd"), "cls")


#: Shingles of a class that counts as one in a block; longer ones count as more.
USUAL = 512
#: Bands of sizes that a crowd spans at least to be cut by size: from there on less is compared than before.
WIDE = 5


def _by_size(crowd: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Crowds that span many sizes cut into overlapping ones of two neighbouring bands of sizes: sets of which one has less than ``threshold`` of the other's shingles can't link."""
    band = F.floor(F.log(F.col("size").cast("double")) / (-math.log(threshold) * 1.0001))
    of = cut(crowd.join(classes.select("cls", "size"), "cls").select("crowd", "cls", band.alias("band")))
    wide = of.groupBy("crowd").agg((F.max("band") - F.min("band") + 1 >= WIDE).alias("wide")).where("wide")
    rows = of.join(wide, "crowd", "left").withColumn("part", F.when(F.col("wide"), F.array("band", F.col("band") + 1)).otherwise(F.array(F.lit(None).cast("long"))))
    rows = rows.select("crowd", "cls", F.explode("part").alias("part"))
    return cut(rows.select(F.when(F.col("part").isNull(), F.col("crowd")).otherwise(F.xxhash64("crowd", "part")).alias("crowd"), "cls"))


def _blocks(crowd: DataFrame, known: DataFrame, block: int) -> DataFrame | None:
    """Tasks (task, side, and the columns of ``known``) that bring together all classes of a crowd with different labels, or None if there are none.

    The classes of the crowd's most frequent label meet all others, but not each other. A block holds ``block`` classes of usual
    size, or fewer that are longer, so that what a task holds is bounded by the shingles in it, not by the number of classes.
    """
    of = crowd.join(known, "cls")
    sizes = cut(of.groupBy("crowd", "label").agg(F.sum("weight").alias("n")))
    main = sizes.groupBy("crowd").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n"), F.sum("n").alias("total")).where("n < total")
    main = cut(main.select("crowd", "main", F.ceil((F.col("total") - F.col("n")) / block).alias("others"), F.ceil(F.col("n") / block).alias("mains")))
    if not main.limit(1).count():
        return None
    most, salt = F.col("label") == F.col("main"), F.xxhash64("cls", F.lit(9))
    rows = of.join(main, "crowd").withColumn("own", F.when(most, F.col("others") + F.pmod(salt, "mains")).otherwise(F.pmod(salt, "others")))
    rows = rows.withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.when(most, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))))
    return rows.select(F.xxhash64("crowd", F.least("own", "met"), F.greatest("own", "met")).alias("task"), *known.columns, (F.col("own") > F.col("met")).cast("int").alias("side"))


#: Mean similarity from which the classes of a large node are much alike: branching wouldn't part them.
DENSE = 0.4
#: Classes of a large node from which its mean similarity is told, about.
SAMPLE = 24


def _likeness(part: pa.Table) -> pa.Table:
    """(node, mean): the mean similarity of a node's sampled classes."""
    low = _low(part.column("low"))
    i, j = np.triu_indices(len(low), 1)
    mean = float(_agree(low[i], low[j]).mean()) if len(i) else 0.0
    return pa.table({"node": part.column("node").slice(0, 1), "mean": pa.array([mean], pa.float64())})


def groups(classes: DataFrame, trees: int, leaf: int, levels: int, picks: float) -> tuple[DataFrame, DataFrame | None]:
    """Small nodes (node, cls), and the crowds (crowd, cls) of those that stayed large, if any. ``classes``: (cls, tokens, low).

    A large node stops early where a sample of it says that its classes are much alike: that only adds pairs, since what
    stops is compared whole.
    """
    nodes = classes.mapInArrow(thrifty(_roots(trees)), "node long, cls long")
    small, large = [], []
    for level in range(levels):
        made = nodes = cut(nodes)
        size = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        nodes = cut(nodes.join(size, "node"))
        discard(made)
        small.append(nodes.where(F.col("size") <= leaf).select("node", "cls"))
        wide = nodes.where(F.col("size") > leaf)
        if level == levels - 1:
            large.append(wide.select("node", "cls"))
            break
        some = wide.where(share("node", "cls") < SAMPLE / F.col("size")).join(classes.select("cls", "low"), "cls")
        alike = cut(some.select("node", "low").groupBy("node").applyInArrow(_likeness, "node long, mean double"))
        dense = small_side(alike.where(F.col("mean") >= DENSE).select("node"))
        large.append(wide.join(dense, "node", "left_semi").select("node", "cls"))
        goes_on = wide.join(dense, "node", "left_anti")
        if not goes_on.limit(1).count():
            break
        nodes = goes_on.join(classes, "cls").select("node", "cls", "tokens").mapInArrow(thrifty(_branch(picks)), "node long, cls long")
    both = reduce(DataFrame.unionByName, large)
    return reduce(DataFrame.unionByName, small), cut(crowds(both)) if both.limit(1).count() else None


def _dealt(crowd: DataFrame, leaf: int) -> DataFrame:
    """(node, cls): each crowd dealt into sub-nodes of about half of ``leaf`` classes, in two orders."""
    size = cut(crowd.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / (leaf // 2)).alias("parts")))
    of = crowd.join(size, "crowd")
    return reduce(DataFrame.unionByName, [of.select(F.xxhash64("crowd", F.lit(k), F.pmod(F.xxhash64("crowd", "cls", F.lit(k)), "parts")).alias("node"), "cls") for k in range(2)])


def _led(crowd: DataFrame, known: DataFrame, leaders: int, least: float) -> DataFrame:
    """Candidates (a, b, s) between each class of a crowd and a few leaders of it."""

    def close(batches):
        for b in batches:
            s = _agree(_low(b.column("low")), _low(b.column("other")))
            keep = pa.array(s >= least)
            yield pa.record_batch([b.column("cls").filter(keep), b.column("leader").filter(keep), pa.array(s[s >= least], pa.float64())], ["a", "b", "s"])

    lead = crowd.groupBy("crowd").agg(*[F.min_by("cls", F.xxhash64("crowd", "cls", F.lit(2 + k))).alias(f"l{k}") for k in range(leaders)])
    lead = lead.select("crowd", F.explode(F.array_distinct(F.array(*[f"l{k}" for k in range(leaders)]))).alias("leader"))
    lead = cut(lead.join(known.select(F.col("cls").alias("leader"), F.col("low").alias("other")), "leader"))
    return crowd.join(lead, "crowd").where("cls <> leader").join(known.select("cls", "low"), "cls").select("cls", "leader", "low", "other").mapInArrow(close, "a long, b long, s double")


PAIR = "a long, b long, s double"


def linked(classes: DataFrame, texts, n: int, threshold: float, trees: int, leaf: int, levels: int, picks: float, leaders: int, block: int = 1024) -> DataFrame:
    """(cls, label): components of the confirmed links. classes: (cls, tokens, low, size); texts: from (cls) to (cls, text)."""
    least = _least(threshold)
    small, crowd = groups(classes, trees, leaf, levels, picks)
    none = F.lit(None).cast("long")
    if crowd is not None:
        crowd = _by_size(crowd, classes, threshold)
    known = classes.select("cls", "low", F.col("cls").alias("label"), none.alias("no1"), none.alias("no2"), F.greatest(F.col("size") / USUAL, F.lit(1.0)).alias("weight"))
    text = None

    def seen(nodes: DataFrame, crowd: DataFrame | None, name: bool) -> DataFrame:
        schema = PAIR if name else "task long, cls long"
        parts = [nodes.join(known, "cls").repartition("node").sortWithinPartitions("node").mapInArrow(thrifty(_in_nodes(least, name)), schema)]
        if crowd is not None and (tasks := _blocks(crowd, known, block)) is not None:
            parts.append(tasks.groupBy("task").applyInArrow(_in_blocks(least, name), schema))
        return reduce(DataFrame.unionByName, parts)

    def settle(named: DataFrame, turn: int) -> None:
        """Decides pairs (a, b), a naming b, on the full sets; joins the labels of those that link, and notes the others."""
        nonlocal known
        pairs = named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        full = pairs.join(text.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(text.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
        decided = cut(full.select("a", "b", "text_a", "text_b").mapInArrow(thrifty(_verify(n, threshold)), "a long, b long, linked boolean"))
        known = _joined(known, decided.where("linked").select("a", "b"))
        no = named.join(decided.where("NOT linked").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")), (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y"))).select(F.col("a").alias("cls"), F.col("b").alias("no"))
        known = cut(known.join(no, "cls", "left").withColumn(f"no{turn}", F.col("no")).select(known.columns))

    # each class names its most similar partner: in small nodes, and in large ones among what they are dealt into and a few leaders
    first = seen(small if crowd is None else small.unionByName(_dealt(crowd, leaf)), None, True)
    if crowd is not None:
        first = first.unionByName(_led(crowd, known, leaders, least))
    per_class = lambda found: cut(found.groupBy("a").agg(F.max_by("b", F.struct("s", -F.col("b"))).alias("b")))
    named = per_class(first)
    some = named.select(F.col("a").alias("cls")).union(named.select("b")).distinct()
    if crowd is not None:
        some = some.union(crowd.select("cls")).distinct()
    some = cut(some)
    if not some.limit(1).count():
        return known.select("cls", "label")
    text = cut(texts(some))
    settle(named, 1)
    # of classes that named nobody nothing can come in small nodes
    small = cut(small.join(named.select(F.col("a").alias("cls")), "cls", "left_semi"))
    named = per_class(seen(small, crowd, True))
    settle(named, 2)
    # what still has candidates of other labels is decided where it meets, on the full sets, so that no pairs are listed
    rest = cut(seen(small, crowd, False))
    if rest.limit(1).count():
        met = rest.join(known, "cls").join(text, "cls").select("task", *known.columns, "text")
        known = _joined(known, cut(met.groupBy("task").applyInArrow(_decide(n, threshold, least), "a long, b long")))
    return known.select("cls", "label")


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` with the labels of linked classes (a, b) made one."""
    named = known.select("cls", "label")
    ends = links.join(named.select(F.col("cls").alias("a"), F.col("label").alias("x")), "a").join(named.select(F.col("cls").alias("b"), F.col("label").alias("y")), "b")
    edges = cut(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct())
    new = components(edges).select(F.col("cls").alias("label"), F.col("label").alias("to"))
    return known.join(new, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to").select(known.columns)


def _links(share: int, x: np.ndarray, y: np.ndarray) -> bool:
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * inter >= share * (len(x) + len(y) - inter)


def _verify(n: int, threshold: float):
    share = round(threshold * 100)

    def run(batches):
        for b in batches:
            a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
            keep: list[bool] = []
            while len(keep) < len(a):
                slots: dict[int, int] = {}
                words: list[list[bytes]] = []
                at, held = len(keep), 0
                end = at
                while end < len(a) and (held == 0 or held < 400_000):
                    for key, column in ((a[end], "text_a"), (c[end], "text_b")):
                        if key not in slots:
                            slots[key] = len(words)
                            words.append(words_of(b.column(column)[end].as_py()))
                            held += len(words[-1]) + 1
                    end += 1
                sets = exact_shingles(words, n)
                keep += [_links(share, sets[slots[a[k]]], sets[slots[c[k]]]) for k in range(at, end)]
            yield pa.record_batch([b.column("a"), b.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return run


def _shared(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``rows`` with all sets, by products of their incidence matrices, some columns at a time."""
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, slot, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count > 1
    where = np.cumsum(common) - 1
    keep = common[slot]
    slot, who = where[slot[keep]], who[keep]
    order = np.argsort(slot, kind="stable")
    slot, who = slot[order], who[order]
    out = np.zeros((len(rows), len(sets)), np.float32)
    wide = 4096
    for at in range(0, int(common.sum()), wide):
        lo, hi = np.searchsorted(slot, (at, at + wide))
        m = np.zeros((len(sets), wide), np.float32)
        m[who[lo:hi], slot[lo:hi] - at] = 1
        out += m[rows] @ m.T
    return out


def _decide(n: int, threshold: float, least: float):
    """Links (a, b) among the classes of a task, decided on the full sets: enough of them to connect what links connect, at most one less than classes."""
    share = round(threshold * 100)

    def run(part: pa.Table) -> pa.Table:
        of = Members(part)
        sets = exact_shingles([words_of(t) for t in part.column("text").to_pylist()], n)
        size = np.array([len(x) for x in sets], np.int64)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        a, b = [], []
        for at in range(0, len(sets), 256):
            rows = np.arange(at, min(at + 256, len(sets)))
            inter = _shared(sets, rows).astype(np.int64) if len(sets) > 64 else None
            for k, i in enumerate(rows.tolist()):
                js = np.arange(i + 1, len(sets))
                js = js[of.similar(i, js, least) > 0]
                if inter is not None:
                    js = js[100 * inter[k, js] >= share * (size[i] + size[js] - inter[k, js])]
                for j in js.tolist():
                    x, y = root(int(of.label[i])), root(int(of.label[j]))
                    if x != y and (inter is not None or _links(share, sets[i], sets[j])):
                        parent[max(x, y)] = min(x, y)
                        a.append(int(of.cls[i]))
                        b.append(int(of.cls[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


#: Links that one task follows to their ends.
FEW = 10_000


def _ends(batches):
    """(cls, to) for links (a, b): one class for each component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    yield pa.record_batch([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], ["cls", "to"])


def components(links: DataFrame) -> DataFrame:
    """(cls, label): the smallest class reachable, for every class in a link (a, b). Links go both ways.

    The graph is contracted: each class moves to the neighbour (or itself) of smallest hash, links between what has
    moved to one place go, and the smaller graph is treated alike. Its size falls by a constant factor a round, so the rows of all
    rounds together are in proportion to the links, also for long chains and for hubs. The last ``FEW`` links are followed in one task.
    """
    edges, moves, salt = links.select("a", "b").where("a <> b"), [], 0
    while True:
        edges = cut(edges)
        if (left := edges.limit(FEW + 1).count()) <= FEW:
            if left:
                moves.append(cut(edges.coalesce(1).mapInArrow(_ends, "cls long, to long")))
            break
        rank = lambda c, k=salt: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("to"))
        ends = edges.select(F.col("a").alias("cls"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("cls"), F.col("a").alias("to")))
        move = cut(ends.groupBy("cls").agg(F.min(rank("to")).alias("m")).select("cls", F.least(F.col("m"), rank("cls"))["to"].alias("to")))
        near = move.select(F.col("cls").alias("a"), F.col("to").alias("x")), move.select(F.col("cls").alias("b"), F.col("to").alias("y"))
        moves.append(move)
        edges = edges.join(near[0], "a").join(near[1], "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        salt += 1
    if not moves:
        return links.select(F.col("a").alias("cls"), F.col("b").alias("label")).limit(0)
    at = None
    for move in reversed(moves):
        # where a place of this round ends up: places of later rounds are named in ``at``, others are ends
        at = move.withColumnRenamed("to", "end") if at is None else move.join(at.select(F.col("cls").alias("to"), "end"), "to", "left").select("cls", F.coalesce("end", "to").alias("end"))
    at = cut(at)
    return cut(at.join(at.groupBy("end").agg(F.min("cls").alias("label")), "end").select("cls", "label"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.75,
               recall: float = 0.999998, leaf: int = 128, levels: int = 5, picks: float = 1.5, leaders: int = 6) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable over links), kept.

    ``recall`` is that of the trees for a pair at the threshold, and sets their number; the margin of the estimate loses
    7.5e-5 of such pairs besides. More similar pairs are missed less often.

    Null and empty texts have no shingles, are linked with nothing and are kept. Of rows with the same
    smallest id one stays; a null id counts as the largest. Repeated rows are rows of their own. An empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        rows = with_row(docs, id_col, text_col, twice=True)
        keep(rows)
        kind = rows.schema["id"].dataType.simpleString()
        sets = cut(rows.mapInArrow(thrifty(_sketch(n)), f"row long, id {kind}, n_shingles long, set_key binary, tokens binary, low binary"))
        # rows with the same digest of their set belong to the first of them once their full sets are seen to be equal
        first = cut(sets.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("row").alias("cls"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
        alike = cut(sets.join(first, "set_key").where("row <> cls").select("row", "cls"))
        text_of = lambda name, wanted: rows.join(small_side(wanted.withColumnRenamed(name, "row")), "row", "left_semi").select(F.col("row").alias(name), "text")
        firsts, copies = text_of("cls", first.select("cls")), text_of("row", alike.select("row"))
        both = copies.join(alike, "row").select("row", "cls", F.col("text").alias("text_b")).join(firsts.withColumnRenamed("text", "text_a"), "cls")
        copy = cut(both.select("row", "cls", "text_a", "text_b").mapInArrow(thrifty(_equal(n)), "row long, cls long, equal boolean").where("equal").select("row", "cls"))
        gone = copy.select("row")
        side = small_side(gone)
        classes = sets.where("set_key IS NOT NULL").join(side, "row", "left_anti").select(F.col("row").alias("cls"), "tokens", "low", F.col("n_shingles").alias("size"))
        classes = cut(classes) if side is gone else classes  # a broadcast table is joined anew at each use, others are joined once
        label = cut(linked(classes, lambda wanted: text_of("cls", wanted), n, threshold, trees_for(recall, threshold, levels, picks), leaf, levels, picks, leaders))
        own = label.unionByName(copy.select(F.col("row").alias("x"), "cls").join(label, "cls").select(F.col("x").alias("cls"), "label")).withColumnRenamed("cls", "row")
        known = keep(cut(sets.select("row", "id", "n_shingles").join(own, "row", "left").withColumn("label", F.coalesce("label", "row"))))
        least = keep(cut(known.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))))
    return known.join(least, "label").select(F.col("id").alias(id_col), "n_shingles", F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def _equal(n: int):
    """Whether two texts have the same set of shingles: by their words, else by the full sets."""

    def run(batches):
        for b in batches:
            same = []
            for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
                x, y = words_of(x), words_of(y)
                same.append(x == y or np.array_equal(*exact_shingles([x, y], n)))
            yield pa.record_batch([b.column("row"), b.column("cls"), pa.array(same, pa.bool_())], ["row", "cls", "equal"])

    return run

"""Source divergence audit: how far the words of each source lie from its language's and from other sources'.

All figures are whole numbers. A term's share p is 1 + floor(10^9 (count + 1) / (N + V)), the divergence of a share from another
floor((p - q)^2 / q).

Terms are counted in each task, then summed by language and term, where they meet as one list of sources.

Pairs of sources: most terms are missing from most sources, and all terms missing from both give the same value, the baseline of the
pair. So a pair's sum is the baseline times V, plus a correction for each term of one source (from the histogram of that source's shares), plus one for each term
of both. Only the last needs terms and pairs at once; it is summed in the tasks, a row for each pair and block of terms.

Terms of a source, the k highest of each: radix select. The kth value is found from the highest bits down, 16 at a time: a
histogram of the next bits among values that agree so far is counted over all tasks, the digit in which the kth falls is kept. Terms
tied at the kth value are selected by their UTF-8 bytes in the same way, two bytes at a time after what they have in common. Only
the k terms of each group are sorted.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch, small_side

UNIT = 1_000_000_000
#: Bytes that end a term: ASCII but letters. Bytes of other characters are above.
_TERM = bytes(c if c > 0x7F or bytes([c]).isalpha() else 0x20 for c in range(256))
#: Distinct terms a task holds before it hands its counts on.
HELD = 1_000_000
COUNTS = "lang string, term string, source string, n long, docs long"
#: Pairs of shares compared at a time.
BLOCK = 1 << 20
PAIRS = "lang string, source string, item string, value long"


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and other characters outside ASCII, with A-Z lower-cased."""
    return text.translate(_TERM).lower().split(b" ") if text else []


def _counted(batches):
    """Counts of terms by language and source, and of their documents, combined within the task."""
    n: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def out():
        for (lang, source), counts in n.items():
            have, rows = docs[lang, source], list(counts)
            for k in range(0, len(rows), 50_000):
                part = rows[k : k + 50_000]
                yield pa.record_batch([
                    pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([source] * len(part)),
                    pa.array([counts[t] for t in part], pa.int64()), pa.array([have[t] for t in part], pa.int64()),
                ], ["lang", "term", "source", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            own = Counter(terms_of(text))
            own.pop(b"", None)
            counts = n.setdefault((lang, source), Counter())
            held -= len(counts)
            counts.update(own)
            held += len(counts)
            docs.setdefault((lang, source), Counter()).update(own.keys())
            if held > HELD:
                yield from out()
                n, docs, held = {}, {}, 0
    yield from out()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)) in whole numbers: three decimals at a time, so that nothing overflows below 9e15."""
    d, out, rest = total + terms, F.lit(0).cast("long"), count + 1
    for _ in range(3):
        out, rest = out * 1000 + _div(rest * 1000, d), (rest * 1000) % d
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _f(p, q):
    return (p - q) ** 2 // q


def _met(batches):
    """For rows (lang, posts: source, p, p0 of its sources): for each ordered pair of sources the correction for the terms that they share, summed for each block."""
    for b in batches:
        lists = b.column("posts")
        flat, size = lists.flatten(), np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        names = flat.field("source").dictionary_encode()
        source, p, p0 = np.asarray(names.indices.to_numpy(zero_copy_only=False), np.int64), flat.field("p").to_numpy(), flat.field("p0").to_numpy()
        known = names.dictionary.to_pylist()
        langs = b.column("lang").dictionary_encode()
        lang, lang_names = np.asarray(langs.indices.to_numpy(zero_copy_only=False), np.int64), langs.dictionary.to_pylist()
        start, s = np.cumsum(size) - size, len(known)
        code, value = [], []
        for m in np.unique(size[size > 1]).tolist():
            at = np.flatnonzero(size == m)
            step, wide = max(1, BLOCK // (m * m)), max(1, BLOCK // m)
            for k in range(0, len(at), step):
                rows = at[k : k + step]
                cells = start[rows][:, None] + np.arange(m)
                for left in range(0, m, wide):  # a term of many sources is compared some sources at a time
                    a = cells[:, left : left + wide]
                    px, qx, py, qy = p[a][:, :, None], p0[a][:, :, None], p[cells][:, None, :], p0[cells][:, None, :]
                    v = _f(px, py) - _f(px, qy) - _f(qx, py) + _f(qx, qy)
                    c = (lang[rows][:, None, None] * s + source[a][:, :, None]) * s + source[cells][:, None, :]
                    kinds, inverse = np.unique(c, return_inverse=True)
                    sums = np.zeros(len(kinds), np.int64)
                    np.add.at(sums, inverse.ravel(), v.ravel())
                    code.append(kinds), value.append(sums)
        if code:
            kinds, inverse = np.unique(np.concatenate(code), return_inverse=True)
            sums = np.zeros(len(kinds), np.int64)
            np.add.at(sums, inverse, np.concatenate(value))
            kinds, right = np.divmod(kinds, s)
            of, left = np.divmod(kinds, s)
            other = left != right
            take = lambda xs, i: pa.array([xs[k] for k in i[other].tolist()], pa.string())
            yield pa.record_batch([take(lang_names, of), take(known, left), take(known, right), pa.array(sums[other])], ["lang", "source", "item", "value"])


GROUP = ["lang", "source"]


def _settled(histogram: DataFrame, need: Column, high_first: bool) -> DataFrame:
    """Of each group's (digit, n) the digit in which the needed row falls, with ``before``: the rows of the digits before it."""
    order = F.col("digit").desc() if high_first else F.col("digit").asc()
    upto = F.sum("n").over(Window.partitionBy(*GROUP).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return histogram.withColumn("before", upto - F.col("n")).where((F.col("before") < need) & (F.col("before") + F.col("n") >= need))


def _thresholds(rows: DataFrame, k: int) -> DataFrame:
    """(lang, source, at, need): the ``k``-th highest value of each group with more than ``k`` rows, and how many of the rows with this value belong to the ``k``."""
    state = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select(*GROUP, F.lit(0).cast("long").alias("at"), F.lit(k).cast("long").alias("need"))
    for shift in (48, 32, 16, 0):
        state = cut(state)
        alike = rows.join(small_side(state), GROUP)
        if shift < 48:
            alike = alike.where(F.shiftright("value", shift + 16) == F.col("at"))
        histogram = alike.groupBy(*GROUP, "at", "need", F.shiftright("value", shift).bitwiseAND(0xFFFF).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        state = _settled(histogram, F.col("need"), True).select(*GROUP, (F.col("at") * 65536 + F.col("digit")).alias("at"), (F.col("need") - F.col("before")).alias("need"))
    return cut(state)


def _last_tied(rows: DataFrame, thresholds: DataFrame) -> list[DataFrame]:
    """(lang, source, at, last), in parts: the last item, by its bytes, of the tied ones that belong to the k."""
    tied = cut(rows.join(small_side(thresholds), GROUP).where("value = at").select(*GROUP, F.col("item").cast("binary").alias("item")))
    state, done = cut(thresholds.withColumn("lead", F.lit("").cast("binary"))), []
    while state.limit(1).count():
        alike = tied.join(small_side(state), GROUP).where(F.startswith("item", "lead"))
        ends = alike.groupBy(*GROUP, "at", "need").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("least"), F.max("item").alias("last"))
        ends = cut(ends)
        done.append(ends.where("n = need").select(*GROUP, "at", "last"))
        # what all that are left have in common is skipped, then two bytes are told apart
        common = F.unhex(F.regexp_extract(F.concat(F.hex("least"), F.lit("|"), F.hex("last")), r"^((?:..)*)[0-9A-F]*\|\1[0-9A-F]*$", 1))
        open_ = cut(ends.where("n > need").select(*GROUP, "at", "need", common.alias("lead")))
        digit = F.substr("item", F.octet_length("lead") + 1, F.lit(2))
        histogram = tied.join(small_side(open_), GROUP).where(F.startswith("item", "lead")).groupBy(*GROUP, "at", "need", "lead", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        chosen = cut(_settled(histogram, F.col("need"), False).select(*GROUP, "at", (F.col("need") - F.col("before")).alias("need"), F.concat("lead", "digit").alias("lead"), F.octet_length("digit").alias("wide")))
        # an item that ends here is alone
        done.append(chosen.where("wide < 2").select(*GROUP, "at", F.col("lead").alias("last")))
        state = cut(chosen.where("wide = 2").drop("wide"))
    return done


def top(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of each (lang, source) with the highest value, of equal values those whose item is first by its UTF-8 bytes, with their ``rank``.

    ``rows`` (lang, source, item, value): items of a group are distinct, values are whole and not negative, no column is null. It is read several times.
    """
    thresholds = _thresholds(rows, k)
    bounds = thresholds.select(*GROUP).limit(0).selectExpr(*GROUP, "0L AS at", "CAST('' AS BINARY) AS last")
    for part in _last_tied(rows, thresholds):
        bounds = bounds.unionByName(part)
    best = rows.join(small_side(cut(bounds)), GROUP, "left").where("at IS NULL OR value > at OR (value = at AND CAST(item AS BINARY) <= last)")
    return ranked(best.select(*GROUP, "item", "value"))


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")))


def _pairs(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other source of its language, summed over the kept terms."""
    base = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1)
    known = cut(totals.select(*GROUP, "terms", base.alias("p0")))
    other = small_side(known.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")))
    baseline = known.join(other, "lang").where("source <> item").select(*GROUP, "item", F.when(F.col("terms") > 0, F.col("terms") * divergence(F.col("p0"), F.col("q0"))).otherwise(0).alias("value"))
    histogram = cut(cells.groupBy(*GROUP, "p", "p0").agg(F.count(F.lit(1)).alias("n")))
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    ways = F.array(
        F.struct("source", "item", (F.col("n") * (divergence(p, q0) - divergence(p0, q0))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n") * (divergence(q0, p) - divergence(q0, p0))).alias("value")),
    )
    single = histogram.join(other, "lang").where("source <> item").select("lang", F.inline(ways))
    posts = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("posts")).where(F.size("posts") > 1)
    both = posts.select("lang", "posts").mapInArrow(_met, PAIRS).select(*GROUP, "item", "value")
    return baseline.unionByName(single).unionByName(both).groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, k: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank, for each (lang, source) that occurs.

    A term is a run of ASCII letters and of characters outside ASCII, with A-Z lower-cased; each language keeps those in at least ``least_docs`` of its
    documents. Part ``pair``: item is another source of the language, value the source's divergence from it summed over all kept terms, all ranks. Part
    ``term``: item is a kept term that the source holds and uses more than the language does, value its divergence from the language, ranks to ``k``.
    Ranks go by value, then by the item's UTF-8 bytes.

    Nulls in any of the three columns count as empty; empty texts have no terms, but their group counts as a source. Each row is a document, repeated
    rows too. Texts of any length are read whole, other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    with scratch(spark) as keep:
        counted = rows.mapInArrow(_counted, COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        posts = counted.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("posts")).where(F.col("docs") >= least_docs)
        kept = cut(posts.drop("docs"))
        of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("whole"))
        of_source = kept.select("lang", F.inline("posts")).groupBy(*GROUP).agg(F.sum("n").alias("total"))
        totals = cut(rows.select(*GROUP).distinct().join(of_lang, "lang", "left").join(of_source, GROUP, "left").fillna(0, ["terms", "whole", "total"]))
        flat = kept.select("lang", "term", "all", F.inline("posts")).join(small_side(totals, 250_000), GROUP)
        cells = cut(flat.select(*GROUP, "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.lit(0), F.col("total"), F.col("terms")).alias("p0"), share(F.col("all"), F.col("whole"), F.col("terms")).alias("q")))
        used_more = cells.where("p > q").select(*GROUP, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        pairs = keep(cut(ranked(_pairs(cells, totals))))
        terms = keep(cut(top(cut(used_more), k)))
    part = lambda df, name: df.select(*GROUP, F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(terms, "term"))

"""Filter interaction audit: what each filter removes in each order of the filters.

The orders of n filters form a trie with n! leaves, but which documents are left depends on the set of filters applied, not on their order.
The trie is walked depth first; the survivors of a set are a persisted DataFrame, made by one filter from the
survivors of its parent, and a set that was met on another path is not walked again: 2^n states instead of n! paths. At each state one aggregation
counts what every filter that is still to come would remove there: the edges. Survivors are released when all below them is done.

Counts are combined before they are shuffled, a row for each part and task; orders are put together from the edges by a join with the plan of all orders,
whose size depends on the number of filters only. Nothing goes through the driver.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, scratch, small_side

#: Orders grow as the factorial of the filters.
MOST = 7


def quality_filters(text: Column) -> dict[str, Column]:
    """Failure of a text by letter: A under 50 words, B few distinct words, C many capitals, D odd signs."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (id, digest, ...) with ``repeat``: whether a smaller id has the same digest. A null id counts as the largest, rows of one id don't repeat each other.

    The join has a hot key where one text fills much of the table: it goes by broadcast, or adaptive execution splits it.
    """
    groups = cut(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    repeat = F.coalesce((F.col("first") < F.col("id")) | (F.col("id").isNull() & F.col("first").isNotNull()), F.lit(False))
    return rows.join(small_side(groups, 250_000), "digest", "left").withColumn("repeat", repeat).drop("digest", "first")


def _walk(survivors: DataFrame, state: tuple[str, ...], filters: list[str], losses: list[str], seen: set, edges: list) -> None:
    left = [f for f in filters if f not in state]
    if not left:
        return
    survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = [F.struct(F.lit(f).alias("filter"), F.sum(F.col(f).cast("long")).alias("removed"), *[F.sum((F.col(f) & F.col(x)).cast("long")).alias(x) for x in losses]) for f in left]
        edges.append(cut(survivors.groupBy("part").agg(F.count(F.lit(1)).alias("here"), F.array(*counts).alias("out")).select("part", F.lit("".join(state)).alias("state"), "here", F.inline("out"))))
        for f in left:
            child = tuple(sorted((*state, f)))
            if child not in seen:
                seen.add(child)
                _walk(survivors.where(~F.col(f)), child, filters, losses, seen, edges)
    finally:
        survivors.unpersist()


def _edges(rows: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    """A row for each part and edge (state, filter) of the trie, written to the shared folder."""
    if not filters or len(filters) > MOST or any(len(f) != 1 for f in filters):
        raise ValueError(f"one to {MOST} filters with names of one letter are audited")
    n = len(filters)
    with scratch(rows.sparkSession) as keep:
        base = cut(rows.select("part", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (*filters, *losses)]))
        edges: list[DataFrame] = []
        _walk(base, (), filters, losses, {()}, edges)
        # parts of which a state has no rows left have edges of zeros
        every = [("".join(s), f) for k in range(n) for s in itertools.combinations(filters, k) for f in filters if f not in s]
        zero = F.lit(0).cast("long")
        zeros = F.array(*[F.struct(F.lit(s).alias("state"), zero.alias("here"), F.lit(f).alias("filter"), *[zero.alias(x) for x in ("removed", *losses)]) for s, f in every])
        nothing = edges[0].select("part").distinct().select("part", F.inline(zeros))
        full = reduce(DataFrame.unionByName, edges, nothing).groupBy("part", "state", "filter").agg(*[F.sum(x).alias(x) for x in ("here", "removed", *losses)])
        of, before = Window.partitionBy("part", "filter"), F.length("state")
        weight = reduce(lambda acc, k: acc.when(before == k, math.factorial(k) * math.factorial(n - 1 - k)), range(1, n), F.when(before == 0, math.factorial(n - 1)))
        return keep(cut(full.withColumns({
            "redundant": F.max(F.when(before == 0, F.col("removed"))).over(of) - F.col("removed"),
            "unique_fails": F.max(F.when(before == n - 1, F.col("removed"))).over(of),
            "shapley": F.sum(F.col("removed") * weight).over(of),
            "kept": F.col("here") - F.col("removed"),
        })))


def _orders(edges: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    steps = [("".join(o), k + 1, o[k], "".join(sorted(o[:k]))) for o in itertools.permutations(filters) for k in range(len(filters))]
    plan = edges.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, state string")
    return edges.join(F.broadcast(plan), ["state", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *losses, "shapley")


def audit(rows: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    """For each part, order of the filters and step: what the step's filter does there.

    ``rows`` has ``part``, a boolean for each filter (true: it removes the row) and for each loss. Nulls count as false, a null part is a part of its own. The result
    has part, filter_order, step (from 1), kept (rows left after it), removed, redundant (rows that fail the filter but were
    removed before), unique_fails (rows that fail this filter only), each loss (such rows removed here), and shapley (the filter's
    removed, summed over all orders). Parts with nothing left have zeros. Repeated rows are rows of their own; an empty table gives no rows.
    """
    filters = sorted(filters)
    return _orders(_edges(rows, filters, losses), filters, losses)


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``audit`` of the quality filters and of exact repeats (E) over the parts of ``docs``, with ``good_lost`` and ``toxic_lost`` by ``labels`` (id, quality, toxic).

    A null text counts as empty, a null part as the empty string. Texts of any length are read whole. Of several labels of one id any may say
    good or toxic; null ids have no labels. Extra columns are ignored, an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    parts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    with scratch(docs.sparkSession) as keep:
        checks = quality_filters(text)
        judged = cut(parts.select("id", "part", *[c.alias(f) for f, c in checks.items()], F.unhex(F.sha2(text, 256)).alias("digest")))
        marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good_lost"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic_lost"))
        rows = repeats(judged).withColumnRenamed("repeat", "E").join(small_side(marks, 250_000), "id", "left")
        edges = keep(_edges(rows, [*checks, "E"], ["good_lost", "toxic_lost"]))
    return _orders(edges, [*checks, "E"], ["good_lost", "toxic_lost"])

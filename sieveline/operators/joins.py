"""Join-like operators: calls to results, look-ahead corrections, positional differences, carried sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import ordered


def link_results(uses: DataFrame, results: DataFrame, scope: str, use_id: str, result_id: str, payload: Column, order: Column) -> DataFrame:
    """Left join of calls to results within a scope; of several results of one id the last by ``order`` wins; none gives -1 as length."""
    last = results.groupBy(scope, F.col(result_id).alias(use_id)).agg(F.max_by(payload, order).alias("output"))
    return uses.join(last, [scope, use_id], "left").withColumn("output_len", F.coalesce(F.octet_length("output"), F.lit(-1)))


def look_ahead(df: DataFrame, scope: list[str], order: list[str], reach: int, columns: list[str], keep, split: bool = False) -> DataFrame:
    """Each row with the first of the next ``reach`` rows of its scope that ``keep(row, other)`` accepts.

    One window of leads instead of a self join: rows are sorted once and nothing is multiplied. A scope is one task; with ``split``, and where
    there is no scope, ranges of the order are tasks instead, which cut large scopes but cost a second shuffle.
    """
    if split or not scope:
        own = [c for c in scope if c not in columns]
        alike = lambda a, b: reduce(lambda t, c: t & a[c].eqNullSafe(b[c]), scope, F.lit(True))
        return ordered.look_ahead(ordered.in_blocks(df, [*scope, *order]), [*scope, *order], reach, [*columns, *own], lambda a, b: alike(a, b) & keep(a, b)).drop(ordered.BLOCK)
    w = Window.partitionBy(*scope).orderBy(*order)
    ahead = F.array(*[F.lead(F.struct(*columns), k).over(w) for k in range(1, reach + 1)])
    found = F.filter(F.filter("_ahead", lambda o: o.isNotNull()), lambda o: keep(F.struct(*columns), o))
    return df.withColumn("_ahead", ahead).withColumn("match", F.try_element_at(found, F.lit(1))).drop("_ahead")


def positional_diff(left: Column, right: Column) -> Column:
    """Differences of two texts line by line at the same number: array of (pos, kind, old, new).

    Lines more alike than half by their characters are modified; else one is removed and one added.
    """
    a, b = T.lines(left), T.lines(right)
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def kind(p: Column) -> Column:
        x, y = p["x"], p["y"]
        return F.when(x.isNull(), "added").when(y.isNull(), "removed").when(x == y, "same").when(T.char_similarity(x, y) > 0.5, "modified").otherwise("replaced")

    rows = F.transform(pairs, lambda p, i: F.struct((i + 1).alias("pos"), kind(p).alias("kind"), p["x"].alias("old"), p["y"].alias("new")))
    return F.filter(rows, lambda r: r["kind"] != "same")


def line_hashes(x: Column | str) -> Column:
    """A 64-bit hash of each line: what two texts need to say of each other which lines differ, at eight bytes a line."""
    return F.transform(T.lines(x), lambda s: F.xxhash64(s))


def positional_counts(left: Column, right: Column) -> Column:
    """(added, removed, changed) lines of two texts by their ``line_hashes``, line by line at the same number."""
    a, b = F.size(left), F.size(right)
    same = F.size(F.filter(F.zip_with(left, right, lambda x, y: x.eqNullSafe(y)), lambda s: s))
    return F.struct(F.greatest(b - a, F.lit(0)).cast("long").alias("added"), F.greatest(a - b, F.lit(0)).cast("long").alias("removed"), (F.least(a, b) - same).cast("long").alias("changed"))


def carry_forward(df: DataFrame, scope: list[str], order: list[str], header: Column, name: str) -> DataFrame:
    """The last header at or before each row: sections of a log, continuation lines of a diagnostic. Without a scope ranges of the order are tasks."""
    if not scope:
        return ordered.carry_forward(ordered.in_blocks(df, order), order, header, name).drop(ordered.BLOCK)
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(header, ignorenulls=True).over(w))


def drop_consecutive(df: DataFrame, scope: list[str], order: list[str], value: Column) -> DataFrame:
    """Rows whose value differs from the row before; equal values apart from each other stay. Without a scope ranges of the order are tasks."""
    if not scope:
        return ordered.drop_consecutive(ordered.in_blocks(df, order), order, value).drop(ordered.BLOCK)
    w = Window.partitionBy(*scope).orderBy(*order)
    return df.withColumn("_was", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1).where(F.col("_first") | ~F.col("_was").eqNullSafe(value)).drop("_was", "_first")


def exclude(df: DataFrame, command: str, excluded: list[str]) -> DataFrame:
    """Drops commands equal to an excluded one or beginning with it and white space; a leading ``^`` is ignored."""
    bare = [e.removeprefix("^").strip() for e in excluded]
    hit = [F.col(command).eqNullSafe(e) | F.coalesce(F.col(command).startswith(e + " ") | F.col(command).startswith(e + "\t"), F.lit(False)) for e in bare if e]
    out = df
    for h in hit:
        out = out.where(~h)
    return out

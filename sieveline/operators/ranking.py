"""Counts with caps: group, rank with explicit ties, keep the top, say how many more there were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Counts, largest first is left to the caller's ordering; partial counts before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, or of all. Spark turns the filter on the rank into a limit per task before the shuffle."""
    if not by:
        top = df.orderBy(*order).limit(k)
        return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def double_cap(df: DataFrame, group: list[str], order: list[Column], per_group: int, overall: int) -> DataFrame:
    """At most ``per_group`` rows of each group, then at most ``overall`` by (group, order)."""
    capped = top_k(df, per_group, order, group, "rank_in_group")
    return top_k(capped, overall, [*(F.col(g) for g in group), F.col("rank_in_group")], rank="rank_overall")


def budget_cap(df: DataFrame, group: list[str], order: list[Column], budget: int, cost: Column) -> DataFrame:
    """Rows of each group in order while the running sum of ``cost`` stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(cost).over(w)).where(F.col("running") <= budget)


def overflow(items: Column, cap: int, label: str = "more") -> Column:
    """The first items joined by newlines, and ``... +N label`` where there are more."""
    n = F.size(items)
    more = F.concat(F.lit("\n... +"), (n - cap).cast("string"), F.lit(f" {label}"))
    return F.concat(F.array_join(F.slice(items, 1, cap), "\n"), F.when(n > cap, more).otherwise(""))


def reduced(cap: int, by: int) -> int:
    return cap - by if by < cap else cap

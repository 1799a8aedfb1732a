"""Savings, cost and session reports over tracker rows, usage rows and transcript commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def gain(tracker: DataFrame) -> DataFrame:
    """One row: commands in all, passed through, filtered; raw and output tokens of the filtered ones, saved, percent."""
    on = ~F.col("passthrough")
    raw, out = F.coalesce(F.sum(F.when(on, F.col("raw_tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(on, F.col("out_tokens"))), F.lit(0))
    return tracker.agg(
        F.count(F.lit(1)).alias("total_commands"), F.coalesce(F.sum((~on).cast("long")), F.lit(0)).alias("passthrough_commands"), F.coalesce(F.sum(on.cast("long")), F.lit(0)).alias("filtered_commands"),
        raw.alias("raw_tokens"), out.alias("out_tokens"), (raw - out).alias("tokens_saved"), T.saved_pct(raw, out).alias("saved_pct"),
    )


def period(ts: Column, grain: str) -> Column:
    """day, week (its Monday) or month of a timestamp as text; ``unknown`` where there is none."""
    form = {"day": F.date_format(ts, "yyyy-MM-dd"), "week": F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd"), "month": F.date_format(ts, "yyyy-MM")}[grain]
    return F.coalesce(form, F.lit("unknown"))


#: Dollars a million tokens (input, output) by the beginning of a model's name; the first that fits counts, the last is the default.
RATES = (("claude-fable", 10.0, 50.0), ("claude-mythos", 10.0, 50.0), ("claude-opus", 5.0, 25.0), ("claude-sonnet", 3.0, 15.0), ("claude-haiku", 1.0, 5.0), ("", 5.0, 25.0))


def usage_cost(model: Column, inp: Column, out: Column, cache_write: Column, cache_read: Column, rates=RATES) -> Column:
    pick = lambda k: F.coalesce(*[F.when(model.startswith(r[0]), F.lit(r[k])) for r in rates], F.lit(rates[-1][k]))
    return (inp * pick(1) + out * pick(2) + cache_write * pick(1) * 1.25 + cache_read * pick(1) * 0.10) / 1e6


def economics(usage: DataFrame, tracker: DataFrame, grain: str) -> DataFrame:
    """Cost and savings by period, and a TOTAL row whose ratios come from the summed inputs.

    usage: (ts, cost, input, output, cache_create, cache_read); tracker: (ts, raw_tokens, out_tokens). Both sides are
    grouped before the full join, so the join sees a row per period.
    """
    tokens = ["input", "output", "cache_create", "cache_read"]
    u = usage.groupBy(period(F.col("ts"), grain).alias("period")).agg(F.sum("cost").alias("cost"), *[F.sum(t).alias(t) for t in tokens])
    saved = F.greatest(F.col("raw_tokens") - F.col("out_tokens"), F.lit(0))
    t = tracker.groupBy(period(F.col("ts"), grain).alias("period")).agg(F.count(F.lit(1)).alias("commands"), F.sum(saved).alias("saved_tokens"))
    both = u.join(t, "period", "full").fillna(0)
    sums = [F.sum(x).alias(x) for x in ("cost", *tokens, "commands", "saved_tokens")]
    out = both.rollup("period").agg(*sums).withColumn("period", F.coalesce("period", F.lit("TOTAL")))
    weight = F.col("input") + 5 * F.col("output") + 1.25 * F.col("cache_create") + 0.1 * F.col("cache_read")
    per_token = F.when(weight > 0, F.col("cost") / weight).otherwise(0.0)
    return out.withColumn("cost_per_token", per_token).withColumn("saved_usd", F.col("saved_tokens") * F.col("cost_per_token") * 5)


def log_report(df: DataFrame, line: str, order: str, caps: dict[str, int] | None = None) -> DataFrame:
    """Log lines grouped by severity and normalised text: count, first original, rank; capped per severity."""
    caps = caps or {"error": 10, "warn": 5}
    found = df.withColumn("severity", T.log_severity(line)).where("severity IS NOT NULL").withColumn("key", T.normalize_log(line))
    grouped = found.groupBy("severity", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.col(line), F.col(order)).alias("first_line"))
    ranked = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("severity").orderBy(F.desc("n"), "key")))
    shown = ranked.where(F.coalesce(*[F.when(F.col("severity") == s, F.col("rank") <= k) for s, k in caps.items()], F.lit(False)))
    text = F.concat(F.when(F.col("n") > 1, F.concat(F.lit("[×"), F.col("n").cast("string"), F.lit("] "))).otherwise(""), T.byte_gated("first_line"))
    return shown.select("severity", "rank", "key", "n", text.alias("shown"))


def log_summary(df: DataFrame, line: str) -> DataFrame:
    """By severity: lines and distinct normalised lines."""
    found = df.select(T.log_severity(line).alias("severity"), T.normalize_log(line).alias("key")).where("severity IS NOT NULL")
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("key").alias("kinds"))


def corrections(commands: DataFrame, scope: list[str], order: list[str], least: float = 0.6) -> DataFrame:
    """Failed commands with the similar one among the next three that put it right.

    commands: (command, is_error, output). Similarity is 0 for different base commands (the program as written and its first argument), else
    half plus half the Jaccard similarity of the words that follow; 0.2 more, up to 1, where the later command doesn't fail. Equal commands and
    those that differ by a path only (0.9 to 1) are passed over.
    """
    from ..functions.shell import base_words
    from .joins import look_ahead
    from .summaries import is_command_error, is_test_cycle

    words = lambda x: F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    base = base_words
    # what the command begins with beyond its base (an assignment, say) leaves the base among the words
    args = lambda x: words(F.when(x.startswith(base(x)), F.substring(x, F.length(base(x)) + 1, F.length(x))).otherwise(x))

    # worked out once a command, not once for each pair
    known = commands.where(F.col("output") != "").withColumn("_base", base(F.col("command"))).withColumn("_args", args(F.col("command")))

    def confidence(a: Column, b: Column) -> Column:
        """Null where a later command is no candidate at all."""
        s = F.when(a["_base"] == b["_base"], 0.5 + 0.5 * T.jaccard(a["_args"], b["_args"]))
        return T.bound(s, lambda s: F.when((a["command"] != b["command"]) & ~((s > 0.9) & (s < 1.0)), F.least(F.lit(1.0), s + F.when(b["is_error"], 0.0).otherwise(0.2))))

    columns = ["command", "is_error", "_base", "_args"]
    found = look_ahead(known, scope, order, 3, columns, lambda a, b: F.coalesce(confidence(a, b) >= least, F.lit(False))).where(is_command_error(F.col("is_error"), "output") & ~is_test_cycle("output") & F.col("match").isNotNull())
    return found.select(*scope, *order, "command", F.col("match.command").alias("correction"), confidence(F.struct(*columns), F.col("match")).alias("confidence"))


def best_of(df: DataFrame, keys: list[str], value: str, by: Column, order: str) -> DataFrame:
    """Per key: rows, and the value of the largest ``by``; ties go to the first by ``order``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.max_by(F.col(value), F.struct(by, -F.col(order))).alias(value), F.max(by).alias("best"))


def adoption(sessions: DataFrame, top: int = 10) -> DataFrame:
    """Newest sessions with the share of their command segments that are covered; sessions: (session, modified, covered, total)."""
    pct = F.when(F.col("total") > 0, F.col("covered") * 100.0 / F.col("total")).otherwise(0.0)
    return sessions.orderBy(F.desc("modified"), "session").limit(top).withColumn("pct", pct).withColumn("bar", T.progress_bar(pct))

"""Exact length histogram: documents by encoded length, with suffix sums for every context limit.

Each task encodes whole texts and emits one integer a document; counts are combined before the
shuffle, so what moves is one row per distinct length and task. Suffix sums run in two levels
(chunks of lengths, then lengths within a chunk), so a task holds at most a chunk of lengths.

Null and empty texts have length 0 and are counted, repeated rows each; ids, ties and extra columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import cut


def lengths(docs: DataFrame, tokenizer_file: str, text_col: str = "text") -> DataFrame:
    def run(batches):
        enc = bpe.encoder(tokenizer_file)
        for b in batches:
            yield pa.record_batch([pa.array([len(enc.ids(t)) for t in b.column(0).to_pylist()], pa.int64())], ["length"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "length long")


def histogram(docs: DataFrame, tokenizer_file: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs): every distinct encoded length once."""
    return lengths(docs, tokenizer_file, text_col).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, chunk: int = 4096) -> DataFrame:
    """A row per distinct length L, which is the answer for the context limit L and for all limits up to the next length:

    docs_ge, tokens_ge: documents of at least L tokens and their tokens; docs_le, tokens_le: of at most L;
    truncated_tokens: tokens left if every document is cut to L; cut_tokens: tokens lost by that;
    quantile: the share of documents of at most L tokens.
    """
    h = cut(hist).withColumn("chunk", F.floor(F.col("length") / chunk)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    later = Window.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    chunks = (
        h.groupBy("chunk").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
        .select("chunk", F.coalesce(F.sum("d").over(later), zero).alias("later_docs"), F.coalesce(F.sum("t").over(later), zero).alias("later_tokens"))
    )
    total = h.agg(F.sum("n_docs").alias("all_docs"), F.sum("n_tokens").alias("all_tokens"))
    within = Window.partitionBy("chunk").orderBy(F.desc("length"))
    return (
        h.join(chunks, "chunk").join(F.broadcast(total))
        .withColumn("docs_ge", F.col("later_docs") + F.sum("n_docs").over(within))
        .withColumn("tokens_ge", F.col("later_tokens") + F.sum("n_tokens").over(within))
        .select(
            "length", "n_docs", "n_tokens", "docs_ge", "tokens_ge",
            (F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
            (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens")).alias("tokens_le"),
            (F.col("all_tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_tokens"),
            (F.col("tokens_ge") - F.col("length") * F.col("docs_ge")).alias("cut_tokens"),
            ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
        )
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for given context limits: each takes the row of the largest length at or below it, corrected for the gap."""
    wanted = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit")
    row = F.max(F.when(F.col("length") <= F.col("limit"), F.struct("length", "docs_le", "tokens_le")))
    got = sums.select("*", wanted).groupBy("limit").agg(row.alias("r"), F.max(F.col("docs_le")).alias("all_docs"))
    below, held = F.coalesce(F.col("r.docs_le"), F.lit(0)), F.coalesce(F.col("r.tokens_le"), F.lit(0))
    return got.select("limit", below.alias("docs_whole"), (F.col("all_docs") - below).alias("docs_cut"), (held + F.col("limit") * (F.col("all_docs") - below)).alias("truncated_tokens"))


def quantiles(sums: DataFrame, probabilities: list[float]) -> DataFrame:
    """The smallest length that at least the given share of documents don't exceed."""
    p = F.explode(F.array(*[F.lit(float(x)) for x in probabilities])).alias("p")
    return sums.select("*", p).where("quantile >= p").groupBy("p").agg(F.min("length").alias("length"))

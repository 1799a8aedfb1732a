"""A training-data pipeline over ``documents``: language ID, exact dedup, near dedup, decontamination, packing.

Each stage works on all rows that the one before kept. All but the last return the columns of documents. Null and empty
texts are rejected by the first stage; rows that repeat are rows of their own; extra columns, whatever their names, are
carried along; an empty table gives no rows, and an empty benchmark rejects nothing.

Texts aren't shuffled to keep or drop rows: language ID gives its verdict where it reads a row, and the other filters drop the rows
on a list, which is broadcast if it has at most a million rows and joined by row number beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontam, exact_dedup, lang_id, near_dedup, packing
from sieveline.llm.common import cut, discard, scratch, settled, small_side, table
from sieveline.llm.queries import BYTE_BPE


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, row, key, text): rows whole, numbered, with a key that orders them by doc_id, nulls last, and tells rows of the same doc_id apart."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumns({"key": F.struct(F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id").alias("id"), "row"), "text": F.col("doc.text")})


def _without(docs: DataFrame, rejected) -> DataFrame:
    """``docs`` without the rows whose keys ``rejected`` gives for (key, text)."""
    rows = _numbered(settled(docs))
    gone = cut(rejected(rows.select("key", "text")).select("key.row").distinct())
    return rows.join(small_side(gone), "row", "left_anti").select("doc.*")


#: Mail addresses and runs of letters that touch digits (tokens, keys): no words of any language, so they don't count as noise.
#: Each is sought at the beginning of a word or run only.
MACHINE = r"(?<!\S)[^\s@]++@[^\s@]++|(?<![\p{L}\d_])[\p{L}_]*+\d[\p{L}\d_]*+"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no letters or is mostly noise rather than any learned language."""
    model = lang_id.learn(lang_id.labelled(docs, F.lit(False)))
    rows = _numbered(docs).select("doc", "text", F.regexp_replace("text", MACHINE, " ").alias("words"))
    rows = rows.select("doc", F.when(F.col("words").rlike(r"\p{L}"), F.col("words")).otherwise(F.col("text")).alias("text"))
    return lang_id.predict(rows, model, id_col="doc").where("lang_pred <> 'und' AND noise_share <= 0.5").select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return _without(docs, lambda rows: exact_dedup.dedup(rows, id_col="key").where("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    return _without(docs, lambda rows: near_dedup.near_dedup(rows, id_col="key").where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold at least three quarters of a benchmark item's word shingles."""
    return _without(docs, lambda rows: decontam.leaks(rows, table(spark, sf_dir, "benchmark"), id_col="key"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("packing", pack)]

#: Language ID and tokenization aren't expressible in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            kept = keep(cut(stage(spark, docs, sf_dir)))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

"""Line dedup over levelled sorted runs of line hashes.

A text's lines are told apart by a key (white space stripped at both ends, A-Z lower-cased) and keys by their 128-bit hash.
Documents arrive in batches, those with the largest ids first. A batch's hashes are counted, merge-anti-joined with the runs that
are there, and what is left is added as a run of its own: a table bucketed and sorted by hash, so that a run is never shuffled
again. What the anti-join takes out is settled: a run already holds it in enough documents, and since ids descend from batch to
batch the line that stays is known as well. When a level holds ``fan`` runs they are merged into one of the next level, so a hash is
rewritten once a level, and a batch meets fewer than ``fan`` runs of each.

Texts are read twice, to hash lines and to leave lines out; they are shuffled only if more than a million lines go. A hot line is
one row of a run, whatever its number of copies: counts are combined before they are shuffled.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import _OPEN, cut, scratch, share, shared_dir, small_side, tasks, with_row

_SPACE = " \t\n\x0b\x0c\r"
#: Lines of a document: the hash of each long enough key with the line numbers, from 1, where it stands.
LINES = ArrayType(StructType([StructField("key", BinaryType()), StructField("at", ArrayType(IntegerType()))]))
_LINES = pa.list_(pa.struct([("key", pa.binary()), ("at", pa.list_(pa.int32()))]))


def line_keys(text: str | None, least_chars: int) -> dict[bytes, list[int]]:
    """Line numbers by the hash of the key, for keys of ``least_chars`` code points at least."""
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate((text or "").split("\n"), 1):
        key = line.strip(_SPACE)
        if len(key) >= least_chars:
            found.setdefault(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()), []).append(at)
    return found


def _hashed(least_chars: int):
    def run(batches):
        for b in batches:
            lines = [[{"key": k, "at": at} for k, at in line_keys(t, least_chars).items()] for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("row"), b.column("id"), b.column("batch"), pa.array(lines, _LINES)], ["row", "id", "batch", "lines"])

    return run


class LineRuns:
    """Runs (key, docs, id, row) of line hashes: how many documents hold a line, and the id and row of the last of them.

    ``add`` takes batches of (key, id, row), a row for each document that holds the line; ids of a batch lie below those of the batch before, nulls come last.
    ``settled`` gives the lines found in ``least`` documents or more; a count is exact below ``least`` and at least ``least`` else.
    Runs are tables of the session's catalog with files in the shared folder; ``drop`` takes them out of the catalog, and the
    enclosing ``scratch`` deletes the files.
    """

    def __init__(self, spark: SparkSession, least: int, fan: int = 4):
        self.spark, self.least, self.fan, self.buckets = spark, least, fan, tasks(spark)
        self.levels: list[list[str]] = [[]]
        self.names: list[str] = []

    def _written(self, run: DataFrame) -> str:
        name, path = f"line_run_{uuid.uuid4().hex}", f"{shared_dir(self.spark)}/tables/{uuid.uuid4().hex}"
        if _OPEN:
            _OPEN[-1].append(path)
        run.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        self.names.append(name)
        return name

    def _runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs' entries by key, bucket by bucket, without a shuffle."""
        # true of each row; without a filter the union is one of column batches, which doesn't keep equal buckets together though the planner trusts it to
        both = reduce(DataFrame.unionByName, [self.spark.table(n).where("docs > 0") for n in names])
        return both.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("id").alias("id"), F.coalesce(F.max_by("row", "id"), F.max("row")).alias("row"))

    def add(self, holders: DataFrame) -> None:
        own = holders.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("id"), F.coalesce(F.max_by("row", "id"), F.max("row")).alias("row"))
        for name in self._runs():
            own = own.join(self.spark.table(name).where(F.col("docs") >= self.least).select("key").hint("merge"), "key", "left_anti")
        self.levels[0].append(self._written(own))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fan:
                self.levels[k : k + 2] = [[], [*(self.levels[k + 1] if k + 1 < len(self.levels) else []), self._written(self._merged(self.levels[k]))]]

    def settled(self) -> DataFrame:
        return self._merged(self._runs()).where(F.col("docs") >= self.least).select("key", "row")

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _batch(rows: DataFrame, batches: int):
    """The number of a row's batch: ranges of ids, the largest first, nulls last; about even by a sample of a thousand ids, on which no result depends."""
    sample = rows.where("id IS NOT NULL").select("id").orderBy(share("id", "row")).limit(1000)
    ids = sorted(r["id"] for r in sample.collect())
    edges = sorted({ids[len(ids) * k // batches] for k in range(1, batches)}) if ids else []
    below = reduce(lambda a, e: a + (F.col("id") < F.lit(e)).cast("int"), edges, F.lit(0))
    return F.coalesce(below, F.lit(len(edges))), len(edges) + 1


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, batches: int = 8, fan: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, text without its repeated lines, n_lines (before), n_dropped.

    Lines end at \\n. Lines whose key has at least ``least_chars`` code points and stands in at least ``least_docs`` documents go, but for
    those in the document with the largest id (all of them there). Other lines stay, joined by \\n; a text whose lines all go is empty.

    A null or empty text is one empty line (a null text comes back as it is). Each row is a document, repeated rows and ids too: of
    rows with the same largest id one keeps the line. A null id counts as the smallest. Texts of any length are read whole, extra columns are ignored,
    an empty table gives no rows. Ids are of any type that orders and can be a literal.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, least_docs, fan)
    with scratch(spark) as keep:
        rows = with_row(docs, id_col, text_col, twice=True)
        keep(rows)
        batch, n = _batch(rows, batches)
        schema = StructType([StructField("row", LongType()), rows.schema["id"], StructField("batch", IntegerType()), StructField("lines", LINES)])
        long_enough = rows.where(F.length("text") >= least_chars).select("row", "id", batch.alias("batch"), "text")
        hashed = cut(long_enough.mapInArrow(_hashed(least_chars), schema).where(F.size("lines") > 0), "batch")
        try:
            for k in range(n):
                runs.add(hashed.where(F.col("batch") == k).select(F.explode("lines.key").alias("key"), "id", "row"))
            each = hashed.select("row", F.explode("lines").alias("line")).select("row", "line.key", "line.at")
            gone = cut(each.join(small_side(cut(runs.settled()), 250_000).withColumnRenamed("row", "stays"), "key").where("row <> stays").select("row", "at"))
        finally:
            runs.drop()
        left_out = cut(gone.groupBy("row").agg(F.flatten(F.collect_list("at")).alias("at")))
        few = left_out.agg(F.sum(F.size("at"))).first()[0] or 0
        keep(left_out)
    return _left(rows.join(F.broadcast(left_out) if few <= 1_000_000 else left_out, "row", "left"), id_col)


def _left(rows: DataFrame, id_col: str) -> DataFrame:
    """Texts without the lines whose numbers are in ``at``."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # the lines are bound to a name, else they would be split again for each one that stays
    stays = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(ls)), "at"), lambda k: F.element_at(ls, k)), "\n"))[0]
    return rows.select(F.col("id").alias(id_col), F.when(F.col("at").isNull(), F.col("text")).otherwise(stays).alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"))

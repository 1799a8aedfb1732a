"""Operations along one order with no key that bounds a group: an output of any length, all sessions as one sequence, one user with most rows.

Rows are dealt into ranges of the order (blocks), one task each, and kept in the checkpoint folder so that blocks hold still. What crosses
the edges of blocks is a small table, a row or a few for each block: the first rows of what follows (look-ahead), the last header before (carry-forward), or the map from a
state at a block's beginning to the state at its end (folds). Maps are composed block by block, then each block is gone over once
more from its known state. The largest task holds one block, whatever the sizes of outputs, sessions or users.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BLOCK = "_block"


def _settled(df: DataFrame) -> DataFrame:
    """A checkpoint: in the folder that the cluster names, else, on a local master only, in one of its own."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="sieveline-"))
    return df.checkpoint()


def in_blocks(df: DataFrame, order: list[str], blocks: int | None = None) -> DataFrame:
    """``df`` with the number of the range of the order that a row lies in. ``order`` tells all rows apart, else equal ones stand in any order; nulls come first."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _settled(df.repartitionByRange(n, *order).withColumn(BLOCK, F.spark_partition_id()))


def _along():
    """All blocks in order, for tables with a row for each block: one task sorts them."""
    return Window.orderBy(BLOCK)


def carry_forward(blocked: DataFrame, order: list[str], header: Column, name: str, scope: str | None = None) -> DataFrame:
    """The last header at or before each row, of the row's ``scope`` only if one is given (rows of a scope stand together)."""
    of = F.struct(header.alias("h"), (F.col(scope) if scope else F.lit(0)).alias("s"))
    rows = blocked.withColumn("_h", F.when(header.isNotNull(), of))
    ends = rows.groupBy(BLOCK).agg(F.max_by("_h", F.when(F.col("_h").isNotNull(), F.struct(*order))).alias("_h"))
    before = ends.select(BLOCK, F.last("_h", ignorenulls=True).over(_along().rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.last("_h", ignorenulls=True).over(Window.partitionBy(BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.join(F.broadcast(before), BLOCK).withColumn("_h", F.coalesce(own, F.col("_before")))
    fits = F.col("_h.s").eqNullSafe(F.col(scope)) if scope else F.lit(True)
    return found.withColumn(name, F.when(fits, F.col("_h.h"))).drop("_h", "_before")


def look_ahead(blocked: DataFrame, order: list[str], reach: int, columns: list[str], keep: Callable[[Column, Column], Column]) -> DataFrame:
    """Each row with ``match``: the first of the next ``reach`` rows that ``keep(row, other)`` accepts, or null.

    The halo of a block is what the next ``reach`` rows after it are, from as many blocks as it takes.
    """
    w = Window.partitionBy(BLOCK).orderBy(*order)
    it = F.struct(*columns)
    heads = blocked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= reach).groupBy(BLOCK).agg(F.array_sort(F.collect_list(F.struct("_n", it.alias("row")))).alias("_heads"))
    following = F.flatten(F.collect_list("_heads").over(_along().rowsBetween(1, reach)))
    halo = heads.select(BLOCK, F.transform(F.slice(following, 1, reach), lambda h: h["row"]).alias("_halo"))
    ahead = F.filter(F.array(*[F.lead(it, k).over(w) for k in range(1, reach + 1)]), lambda o: o.isNotNull())
    rows = blocked.withColumn("_ahead", ahead).join(F.broadcast(halo), BLOCK)
    found = F.filter(F.slice(F.concat("_ahead", "_halo"), 1, reach), lambda o: keep(it, o))
    return rows.withColumn("match", F.try_element_at(found, F.lit(1))).drop("_ahead", "_halo")


def drop_consecutive(blocked: DataFrame, order: list[str], value: Column) -> DataFrame:
    """Rows whose value differs from the row before; equal values apart from each other stay."""
    rows = blocked.withColumn("_v", F.struct(value.alias("v")))
    ends = rows.groupBy(BLOCK).agg(F.max_by("_v", F.struct(*order)).alias("_v"))
    before = ends.select(BLOCK, F.lag("_v").over(_along()).alias("_before"))
    was = F.coalesce(F.lag("_v").over(Window.partitionBy(BLOCK).orderBy(*order)), F.col("_before"))
    return rows.join(F.broadcast(before), BLOCK).withColumn("_was", was).where(F.col("_was").isNull() | ~F.col("_was.v").eqNullSafe(F.col("_v.v"))).drop("_v", "_was", "_before")


def _walk(kinds: np.ndarray, fresh: np.ndarray, table: np.ndarray, state: int) -> list[int]:
    """States before each line."""
    out, rows = [], table.tolist()
    for kind, new in zip(kinds.tolist(), fresh.tolist(), strict=True):
        if new:
            state = 0
        out.append(state)
        state = rows[state][kind]
    return out


def _opened(t: pa.Table, order: list[str], scope: str | None) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows in order, their kinds, and whether a scope begins at a row (not told for the first)."""
    t = t.take(pc.sort_indices(t, [(c, "ascending") for c in order], null_placement="at_start"))
    fresh = np.zeros(t.num_rows, bool)
    if scope and t.num_rows > 1:
        s = t.column(scope).combine_chunks()
        fresh[1:] = ~pc.fill_null(pc.equal(s[1:], s[:-1]), False).to_numpy(zero_copy_only=False)
    return t, t.column("_kind").to_numpy(), fresh


def states(blocked: DataFrame, order: list[str], kind: Column, table: list[list[int]], scope: str | None = None) -> DataFrame:
    """Each row with ``state``: where a machine that reads the rows in order stands before the row.

    ``kind`` gives a row's number among the machine's signs, ``table[state][kind]`` the next state; it begins with 0, and again at each
    row whose ``scope`` differs from the row before. A task reads a block twice: to find the map from state to state over the block, and again from the state that the maps before it lead to.
    """
    moves = np.array(table, np.int64)
    rows = blocked.withColumn("_kind", kind.cast("int"))
    narrow = rows.select(BLOCK, "_kind", *dict.fromkeys([*order, *([scope] if scope else [])]))

    def mapped(t: pa.Table) -> pa.Table:
        t, kinds, fresh = _opened(t, order, scope)
        ends = np.arange(len(moves))
        for k, new in zip(kinds.tolist(), fresh.tolist(), strict=True):
            ends = moves[ends * 0 if new else ends, k]
        sides = [str(t.column(scope)[i].as_py()) if scope else "" for i in (0, -1)]
        return pa.table({BLOCK: t.column(BLOCK)[:1], "ends": pa.array([ends.tolist()], pa.list_(pa.int32())), "first": [sides[0]], "last": [sides[1]]})

    maps = narrow.groupBy(BLOCK).applyInArrow(mapped, f"{BLOCK} int, ends array<int>, first string, last string")
    listed = maps.agg(F.array_sort(F.collect_list(F.struct(BLOCK, "ends", "first", "last"))).alias("m"))
    zero = F.struct(F.lit(0).alias("state"), F.lit(None).cast("string").alias("last"), F.array().cast(f"array<struct<{BLOCK}:int,entry:int>>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        entry = F.when(s["last"].eqNullSafe(m["first"]), s["state"]).otherwise(0)
        return F.struct(F.element_at(m["ends"], entry + 1).alias("state"), m["last"].alias("last"), F.concat(s["out"], F.array(F.struct(m[BLOCK].alias(BLOCK), entry.alias("entry")))).alias("out"))

    entries = listed.select(F.inline(F.aggregate("m", zero, step, lambda s: s["out"])))
    entered = rows.join(F.broadcast(entries), BLOCK)
    names, schema = blocked.columns, StructType(blocked.schema.fields).add("state", IntegerType())

    def placed(t: pa.Table) -> pa.Table:
        t, kinds, fresh = _opened(t, order, scope)
        found = _walk(kinds, fresh, moves, t.column("entry")[0].as_py())
        return t.select(names).append_column("state", pa.array(found, pa.int32()))

    return entered.groupBy(BLOCK).applyInArrow(placed, schema)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, seq, line) of text files: in the order of the first three a file's lines stand as in the file, though it is read in splits."""
    # columns of a row's split are put beside it before anything moves; a task reads a split from its beginning to its end
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


#: Signs of lines (error, blank, indented, other) and states (outside, within, within after a blank line).
_ERROR_MOVES = [[1, 0, 0, 0], [1, 2, 1, 0], [1, 0, 1, 0]]


def error_lines(blocked: DataFrame, order: list[str], line: str, is_error: Column, scope: str | None = None) -> DataFrame:
    """Error lines and their indented continuations; a block ends at a line that isn't indented or at the second blank one."""
    blank, indented = F.col(line).rlike(r"^[\s\x{85}\p{Z}]*\z"), F.col(line).rlike(r"^[ \t]")
    kind = F.when(is_error, 0).when(blank, 1).when(indented, 2).otherwise(3)
    found = states(blocked, order, kind, _ERROR_MOVES, scope)
    return found.where(is_error | (blank & (F.col("state") == 1)) | (~blank & indented & (F.col("state") > 0))).drop("state")


def condensed_diff(blocked: DataFrame, order: list[str], line: str, scope: str | None = None) -> DataFrame:
    """Lines of a unified diff in short: for each file its name and counts, its changed lines, and how many are over ten. Columns: scope, order, part, line; in this order they read as the text."""
    raw, at = F.col(line), F.struct(*dict.fromkeys([*([scope] if scope else []), *order]))
    head = F.when(raw.startswith("+++ "), F.struct(F.regexp_replace(F.substring(raw, 5, 1 << 30), "^b/", "").alias("name"), at.alias("at")))
    rows = carry_forward(blocked, order, head, "_file", scope)
    sign = F.when(raw.startswith("diff --git") | raw.startswith("--- ") | raw.startswith("+++ "), None).when(raw.startswith("+") & ~raw.startswith("+++"), "+").when(raw.startswith("-") & ~raw.startswith("---"), "-")
    changes = rows.select("_file", at.alias("at"), sign.alias("sign"), raw.alias("line")).where("sign IS NOT NULL AND _file.name <> ''")
    files = changes.groupBy("_file").agg(F.count_if(F.col("sign") == "+").alias("added"), F.count_if(F.col("sign") == "-").alias("removed"), F.max("at").alias("last"))
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    total = F.col("added") + F.col("removed")
    parts = [
        files.select(F.col("_file.at").alias("at"), F.lit(0).alias("part"), text("[file] ", F.col("_file.name"), " (+", F.col("added"), " -", F.col("removed"), ")").alias("line")),
        changes.select("at", F.lit(1).alias("part"), text("  ", F.col("line")).alias("line")),
        files.where(total > 10).select(F.col("last").alias("at"), F.lit(2).alias("part"), text("  ... +", total - 10, " more").alias("line")),
    ]
    return reduce(DataFrame.unionByName, parts).select("at.*", "part", "line")

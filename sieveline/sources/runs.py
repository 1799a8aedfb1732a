"""Captured runs: what a filtered run shows, what it keeps aside, and what it records, from one pass over the captures.

``filtered`` is a projection. ``write`` puts all its outputs (shown text, raw text of failures, left-over tails, tracker entries) away in one
job, a folder for each batch: a batch that comes again replaces itself, and files of tasks that fail or run twice never
leave the job's own folder. ``entries``, ``saved`` and ``shown`` read them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text as T
from .readers import TRACKER

#: Fixed value: the exit code of a program that couldn't be started.
NOT_STARTED = 127
_ROWS = "id string, path string, text string, batch long, sink string"


def safe_path(label: Column | str, folder: str) -> Column:
    """Where the raw text of a label is kept: anything but ASCII letters, digits, ``-`` and ``_`` becomes ``_``."""
    safe = F.regexp_replace(F.lit(label) if isinstance(label, str) else label, r"[^a-zA-Z0-9_-]", "_")
    return F.concat(F.lit(f"{folder}/tee-"), F.when(safe == "", "cmd").otherwise(safe), F.lit(".txt"))


def remainder(content: Column, slug: Column | str, offset: int, folder: str) -> Column:
    """(path, text, hint) of what a list left out; null if there is nothing."""
    path = safe_path(slug, folder)
    hint = F.concat(F.lit(f"[see remaining: tail -n +{offset} "), path, F.lit("]"))
    return F.when(~T.is_blank(content), F.struct(path.alias("path"), content.alias("text"), hint.alias("hint")))


def filtered(
    runs: DataFrame, apply: Callable[[Column, Column], Column], label: Column | str | None = None, stdout_only: bool = False, skip_on_failure: bool = False, newline: bool = True, program: str = "sieveline",
    folder: str = "captures", rest: Column | None = None,
) -> DataFrame:
    """Runs (id, ts, tool, args, stdout, stderr, exit_code) with what becomes of their output; other columns go.

    id, exit_code, shown (standard output), errors (standard error), failure (why there is neither), saved (path and raw text
    of a failed run with a ``label``), rest (as ``remainder`` gives it) and entry (the tracker's row). ``apply`` gets the text and the exit code. With ``stdout_only``
    standard error passes as it is; with ``skip_on_failure`` failed runs pass as they are. Line ends count as newlines, null outputs as empty. A run that wasn't started (``NOT_STARTED``) shows and records nothing.
    """
    text = lambda c: T.normalize_newlines(F.coalesce(F.col(c), F.lit("")))
    rows = runs.select("id", "ts", "tool", F.trim(F.concat_ws(" ", "tool", F.coalesce("args", F.lit("")))).alias("cmd"), text("stdout").alias("out"), text("stderr").alias("err"), F.col("exit_code").cast("int").alias("exit_code"), *([rest.alias("rest")] if rest is not None else []))
    started = F.coalesce(F.col("exit_code") != NOT_STARTED, F.lit(False))
    unless_blank = lambda x: F.when(~T.is_blank(x), x).otherwise("")
    raw = F.concat("out", "err")
    taken = F.col("out") if stdout_only else raw
    as_is = (F.col("exit_code") != 0) if skip_on_failure else F.lit(False)
    rows = rows.withColumn("given", F.when(as_is, raw).otherwise(taken))
    # bound by a column of its own, so that the filter runs once a row
    rows = rows.withColumn("made", F.when(started & ~as_is, apply(F.col("given"), F.col("exit_code"))))
    path = safe_path(label, folder) if label is not None else F.lit(None).cast("string")
    keeps = (F.col("exit_code") != 0) & ~T.is_blank(raw) & started & ~as_is if label is not None else F.lit(False)
    end = F.lit("\n" if newline else "")
    hint = F.when(keeps, F.concat(F.lit(f"[{program}: full output saved to "), path, F.lit(" — re-read if the filtered view is insufficient]\n"))).otherwise("")
    shown = F.when(as_is, unless_blank(F.col("out"))).otherwise(F.concat("made", end, hint))
    errors = F.when(as_is | F.lit(stdout_only), unless_blank(F.col("err"))).otherwise("")
    entry = F.struct(F.col("ts"), F.col("cmd"), F.concat(F.lit(program + " "), "cmd").alias("label"), T.est_tokens("given").alias("raw_tokens"), T.est_tokens(F.when(as_is, raw).otherwise(F.col("made"))).alias("out_tokens"), F.lit(False).alias("passthrough"))
    return rows.select(
        "id", "exit_code", F.when(started, shown).alias("shown"), F.when(started, errors).alias("errors"), F.when(~started, F.concat(F.lit(f"{program}: failed to run "), "tool")).alias("failure"),
        F.when(keeps, F.struct(path.alias("path"), raw.alias("text"))).alias("saved"), *([F.col("rest")] if rest is not None else []), F.when(started, entry).alias("entry"))


def passed_through(runs: DataFrame, program: str = "sieveline") -> DataFrame:
    """Entries of runs (ts, tool, args) whose output isn't looked at."""
    return runs.select("ts", F.concat_ws(" ", "tool", F.coalesce("args", F.lit(""))).alias("cmd"), F.concat(F.lit(program + " "), "tool", F.lit(" (passthrough)")).alias("label"), F.lit(0).cast("long").alias("raw_tokens"), F.lit(0).cast("long").alias("out_tokens"), F.lit(True).alias("passthrough"))


def write(made: DataFrame, folder: str, batch: int = 0) -> None:
    """All outputs of ``filtered`` in one job. What the batch wrote before is replaced."""
    side = lambda sink, path, text: F.struct(F.lit(sink).alias("sink"), path.alias("path"), text.alias("text"))
    none = F.lit(None).cast("string")
    sides = [side("shown", none, F.col("shown")), side("errors", none, F.nullif(F.col("errors"), F.lit(""))), side("saved", F.col("saved.path"), F.col("saved.text")), side("entry", none, F.to_json("entry", {"ignoreNullFields": "false"}))]
    if "rest" in made.columns:
        sides.append(side("rest", F.col("rest.path"), F.col("rest.text")))
    rows = made.select(F.col("id").cast("string").alias("id"), F.explode(F.array(*sides)).alias("s")).where("s.text IS NOT NULL").select("id", "s.path", "s.text", "s.sink")
    rows.write.mode("overwrite").partitionBy("sink").parquet(f"{folder}/batch={batch}")


def write_stream(runs: DataFrame, apply: Callable[[Column, Column], Column], folder: str, checkpoint: str, **options) -> DataStreamWriter:
    """A stream of runs written batch by batch: started again after a failure, it writes the batch that failed anew under the same number."""
    return runs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: write(filtered(df, apply, **options), folder, n))


def _sink(spark: SparkSession, folder: str, sink: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(folder).where(F.col("sink") == sink)


def shown(spark: SparkSession, folder: str) -> DataFrame:
    return _sink(spark, folder, "shown").select("id", "text")


def saved(spark: SparkSession, folder: str, sink: str = "saved") -> DataFrame:
    """(path, text): what is kept of failures (or, with sink ``rest``, of left-over tails). A path is written over by later batches and, within one, by later ids."""
    return _sink(spark, folder, sink).groupBy("path").agg(F.max_by("text", F.struct("batch", "id")).alias("text"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The tracker's rows."""
    return _sink(spark, folder, "entry").select(F.from_json("text", TRACKER).alias("e")).select("e.*")


def payload(tracker: DataFrame, device: str, version: str = "dev", system: str = "", machine: str = "") -> DataFrame:
    """One row: the indented JSON of the tracker's totals. Passed-through commands count, but have no tokens."""
    on = ~F.col("passthrough")
    total = lambda c: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0))
    sums = tracker.agg(F.count(F.lit(1)).alias("commands"), total("raw_tokens").alias("raw"), total("out_tokens").alias("out"))
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(F.lit(x))), r"^\[(.*)\]\z", 1)
    fields = {"device_hash": quoted(device), "version": quoted(version), "os": quoted(system), "arch": quoted(machine), "commands": F.col("commands"), "raw_tokens": F.col("raw"), "out_tokens": F.col("out"), "tokens_saved": F.col("raw") - F.col("out")}
    lines = [F.concat(F.lit(f'  "{k}": '), v.cast("string")) for k, v in fields.items()]
    return sums.select(F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}")).alias("payload"))

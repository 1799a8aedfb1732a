"""Which commands of agent sessions would profit from filtering, and how far sessions are covered already."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shell as S
from ..functions import text as T

#: Assumed savings by verdict, and raw tokens where the output is unknown.
SAVING = {"command": 0.70, "filter": 0.50}
UNKNOWN_TOKENS = 150


def segments(commands: DataFrame, own: list[str], defs: list) -> DataFrame:
    """A row per segment of each command's chain, with its verdict; the whole output is charged to every segment."""
    seg = commands.withColumn("segment", F.explode(S.split_chain("command")))
    raw = F.when(F.col("output_len") < 0, UNKNOWN_TOKENS).otherwise(F.floor((F.col("output_len") + 3) / 4)).cast("long")
    return seg.withColumn("verdict", S.classify("segment", own, defs)).withColumn("base", S.base_command("segment")).withColumn("raw_tokens", raw)


def discover(segs: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Supported commands by what they would save, and unsupported ones by count with their first example.

    Savings are truncated per segment before they are summed. A bucket's verdict is that of its first segment.
    """
    pct = F.when(F.col("verdict") == "command", SAVING["command"]).otherwise(SAVING["filter"])
    good = segs.where("verdict IN ('command', 'filter')").withColumn("saved", F.floor(F.col("raw_tokens") * pct).cast("long"))
    name = S.command_name("segment")
    supported = good.groupBy(name.alias("command")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("saved").alias("saved_tokens"), F.min_by("verdict", F.struct("file", "seq")).alias("via"),
        F.mode("base", deterministic=True).alias("display"),
    )
    rest = segs.where("verdict = 'unsupported'").groupBy(F.col("base").alias("command")).agg(F.count(F.lit(1)).alias("n"), F.min_by("segment", F.struct("file", "seq")).alias("example"))
    return supported.orderBy(F.desc("saved_tokens"), "command").limit(top), rest.orderBy(F.desc("n"), "command").limit(top)


def coverage(segs: DataFrame, program: str) -> DataFrame:
    """Per session: segments in all, those run through the program, bytes of output (once a command)."""
    once = F.row_number().over(Window.partitionBy("file", "seq").orderBy("segment")) == 1
    s = segs.withColumn("bytes", F.when(once & (F.col("output_len") > 0), F.col("output_len")).otherwise(0))
    return s.groupBy(F.col("file").alias("session")).agg(F.count(F.lit(1)).alias("total"), F.sum((S.command_name("segment") == program).cast("long")).alias("covered"), F.sum("bytes").alias("output_bytes"))


#: How failures are told apart, the first that fits.
ERROR_KINDS = (
    ("unknown_flag", r"unexpected argument|unknown (?:option|flag)|unrecognized (?:option|flag)|invalid (?:option|flag)"), ("not_found", r"command not found|not recognized as an internal"),
    ("missing_argument", r"requires a value|requires an argument|missing (?:required )?argument"), ("permission", r"permission denied|access denied|not permitted"),
    ("wrong_path", r"no such file or directory|cannot find the path|file not found"),
)


def error_kind(output) -> object:
    low = F.lower(T.c(output))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(k)) for k, p in ERROR_KINDS], F.lit("other"))

"""Readers and writers: tracker and transcript JSON lines, captures, text files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

TRACKER = "ts timestamp, cmd string, label string, raw_tokens bigint, out_tokens bigint, passthrough boolean"
TRANSCRIPT = "type string, timestamp string, sessionId string, message struct<model:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>,content:string>"
BLOCKS = "array<struct<type:string,name:string,id:string,input:struct<command:string>,tool_use_id:string,content:string,is_error:boolean>>"
#: Caps of the inputs, in bytes.
STDIN_CAP, HOOK_CAP = 10 * 1024 * 1024, 1024 * 1024


def tracker(spark: SparkSession, path: str) -> DataFrame:
    """Tracker rows; malformed lines are skipped, missing fields are 0 and false."""
    return spark.read.schema(TRACKER).option("mode", "DROPMALFORMED").json(path).fillna({"raw_tokens": 0, "out_tokens": 0, "passthrough": False})


def file_lines(reader: DataFrameReader, path: str) -> DataFrame:
    """(file, at, raw): lines of files, which are split like any other text. ``at`` orders the lines of a file: where its part of the file begins, then the line's number in the task."""
    return reader.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), F.col("value").alias("raw"))


def tracker_until_malformed(spark: SparkSession, path: str) -> DataFrame:
    """Tracker rows of each file up to its first malformed line."""
    lines = file_lines(spark.read, path).where("trim(raw) <> ''")
    bad = lines.where(F.try_parse_json("raw").isNull()).groupBy("file").agg(F.min("at").alias("end"))
    good = lines.join(bad, "file", "left").where(F.col("end").isNull() | (F.col("at") < F.col("end")))
    return good.select(F.from_json("raw", TRACKER).alias("r")).select("r.*").fillna({"raw_tokens": 0, "out_tokens": 0, "passthrough": False})


def write_tracker(rows: DataFrame, path: str) -> None:
    rows.select("ts", "cmd", "label", "raw_tokens", "out_tokens", "passthrough").write.mode("append").json(path)


def transcripts(spark: SparkSession, path: str, modified_after: datetime | None = None, project: str | None = None) -> DataFrame:
    """Entries of all ``*.jsonl`` files below a folder, with their file and place (see ``file_lines``)."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after.strftime("%Y-%m-%dT%H:%M:%S"))
    lines = file_lines(reader, path)
    if project:
        lines = lines.where(F.col("file").contains(project))
    return lines.select("file", "at", F.from_json("raw", TRANSCRIPT).alias("e")).where("e.type IS NOT NULL").select("file", "at", "e.*")


def _result_text(content):
    """A result's content: a string, or an array of texts that are joined."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    return F.coalesce(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""), content)


def commands(entries: DataFrame) -> DataFrame:
    """Shell commands with their results: (file, seq, command, output, output_len, is_error). Of repeated results the last counts; none gives length -1."""
    from ..operators.joins import link_results

    blocks = entries.select("file", "at", F.posexplode(F.from_json("message.content", BLOCKS)).alias("nth", "b"))
    uses = blocks.where("b.type = 'tool_use' AND b.name = 'Bash' AND b.input.command IS NOT NULL").select("file", F.struct("at", "nth").alias("seq"), F.col("b.id").alias("id"), F.col("b.input.command").alias("command"))
    results = blocks.where("b.type = 'tool_result'").select("file", F.struct("at", "nth").alias("seq"), F.col("b.tool_use_id").alias("of"), F.struct(_result_text(F.col("b.content")).alias("text"), F.coalesce("b.is_error", F.lit(False)).alias("is_error")).alias("r"))
    last = results.groupBy("file", F.col("of").alias("id")).agg(F.max_by("r", "seq").alias("r"))
    joined = uses.join(last, ["file", "id"], "left")
    return joined.select("file", "seq", "command", F.coalesce("r.text", F.lit("")).alias("output"), F.coalesce(F.octet_length("r.text"), F.lit(-1)).alias("output_len"), F.coalesce("r.is_error", F.lit(False)).alias("is_error"))


def usage(entries: DataFrame) -> DataFrame:
    """Token usage of assistant turns that carry one."""
    u = entries.where("type = 'assistant' AND message.usage IS NOT NULL")
    z = lambda c: F.coalesce(f"message.usage.{c}", F.lit(0))
    return u.select("file", F.try_to_timestamp("timestamp").alias("ts"), "timestamp", F.coalesce("message.model", F.lit("")).alias("model"), z("input_tokens").alias("input"), z("output_tokens").alias("output"), z("cache_creation_input_tokens").alias("cache_create"), z("cache_read_input_tokens").alias("cache_read"))


#: Bytes beyond which a file isn't opened as one capture, since a row can't hold it.
MOST = 1 << 30


def captures(spark: SparkSession, path: str, cap: int = STDIN_CAP, most: int = MOST) -> DataFrame:
    """Captured outputs, a file each, with newlines made uniform; files over the cap are flagged, not cut. Files of more than ``most`` bytes are flagged by their size alone and have no text."""
    files = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_size") <= most)
    read = files.select(F.col("_metadata.file_path").alias("file"), T.normalize_newlines("value").alias("text"), (F.octet_length("value") > cap).alias("over_cap"))
    large = spark.read.format("binaryFile").load(path).where(F.col("length") > most)
    return read.unionByName(large.select(F.col("_metadata.file_path").alias("file"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("over_cap")))


#: Languages by extension.
LANGUAGES = {"rust": ("rs",), "python": ("py", "pyw"), "javascript": ("js", "mjs", "cjs", "jsx"), "typescript": ("ts", "tsx"), "go": ("go",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp"), "java": ("java",), "ruby": ("rb",), "shell": ("sh", "bash", "zsh"), "data": ("json", "yaml", "yml", "toml", "xml", "csv", "md", "txt", "lock", "env")}


def language(path) -> object:
    ext = F.lower(T.extension(path))
    return F.coalesce(*[F.when(ext.isin(*e), F.lit(k)) for k, e in LANGUAGES.items()], F.lit("unknown"))


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """Paths, sizes and times of a tree; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def walk(files: DataFrame, pattern: str = "*", max_depth: int | None = None, hidden: bool = False, noise: tuple[str, ...] = ("node_modules", "target", ".git", "__pycache__", "dist", "build", "vendor")) -> DataFrame:
    """Rows of ``file_rows`` whose name fits the glob, outside noise and hidden folders."""
    import fnmatch

    out = files.where(T.basename("path").rlike(fnmatch.translate(pattern).replace(r"\Z", r"\z")))
    out = out.where(~F.col("path").rlike("/(?:" + "|".join(n.replace(".", r"\.") for n in noise) + ")/"))
    if not hidden:
        out = out.where(~F.col("path").rlike(r"/\.[^/]+"))
    return out if max_depth is None else out.where(F.size(F.split("path", "/")) <= max_depth)


def trx(spark: SparkSession, path: str) -> DataFrame:
    """Test results of XML reports: (file, test, status, message)."""
    schema = "_testName string, _outcome string, _duration string, Output struct<ErrorInfo:struct<Message:string,StackTrace:string>>"
    x = spark.read.format("xml").option("rowTag", "UnitTestResult").schema(schema).load(path)
    status = F.when(F.col("_outcome") == "Passed", "pass").when(F.col("_outcome") == "Failed", "fail").otherwise("skip")
    return x.select(F.col("_metadata.file_path").alias("id"), F.col("_testName").alias("test"), status.alias("status"), F.col("Output.ErrorInfo.Message").alias("message"))

"""Linters, type checkers and compilers as one relation: (id, file, line, col, severity, code, message, at).

Text formats are one pattern each, applied to exploded lines; JSON formats are read by their schema. Reports over the
relation are shared: counts by file and code, the top codes of each file, and the first violations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .joins import carry_forward
from .ranking import count_by, top_k

#: Line formats. Groups: file, line, col, severity, code, message by name.
FORMATS = {
    "mypy": (r"^(?<file>[^:\n]+):(?<line>\d+)(?::(?<col>\d+))?: (?<severity>error|warning|note): (?<message>.+?)(?:\s+\[(?<code>[\w-]+)\])?$"),
    "tsc": (r"^(?<file>.+?)\((?<line>\d+),(?<col>\d+)\):\s+(?<severity>error|warning)\s+(?<code>TS\d+):\s+(?<message>.+)$"),
    "go": (r"^(?:vet: )?(?<file>[^\s:]+\.go):(?<line>\d+)(?::(?<col>\d+))?: (?<severity>)(?<code>)(?<message>.+)$"),
    "gcc": (r"^(?<file>[^:\n]+):(?<line>\d+):(?<col>\d+): (?:fatal )?(?<severity>error|warning|note): (?<message>.+?)(?: \[(?<code>-W[^\]]+)\])?$"),
    "msbuild": (r"^\s*(?<file>[^\x28\n]+)\((?<line>\d+),(?<col>\d+)\): (?<severity>error|warning) (?<code>[A-Za-z]+\d+): (?<message>.+?)(?: \[[^\]]+\])?$"),
}
_GROUPS = ("file", "line", "col", "severity", "code", "message")


def _group_numbers(pattern: str) -> dict[str, int]:
    """Positions of the named groups: Spark extracts by number."""
    out, n, i = {}, 0, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "(" and (pattern[i + 1] != "?" or pattern[i + 2] == "<" and pattern[i + 3] not in "=!"):
            n += 1
            if pattern[i + 1] == "?":
                out[pattern[i + 3 : pattern.index(">", i)]] = n
        i += 1
    return out


def from_text(df: DataFrame, tool: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Diagnostics of a line format; lines that don't fit are dropped. ``at`` is the line's number in the output."""
    pattern = "(?d)" + FORMATS[tool]
    at = _group_numbers(FORMATS[tool])
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(T.lines(T.strip_ansi(T.normalize_newlines(text_col)))).alias("at", "raw"))
    g = lambda k: F.nullif(F.regexp_extract("raw", pattern, at[k]), F.lit(""))
    hit = lines.where(F.col("raw").rlike(pattern))
    return hit.select("id", g("file").alias("file"), g("line").cast("int").alias("line"), g("col").cast("int").alias("col"), F.coalesce(g("severity"), F.lit("error")).alias("severity"), g("code").alias("code"), g("message").alias("message"), "at")


#: JSON formats by tool.
SCHEMAS = {
    "ruff": "array<struct<code:string,message:string,location:struct<row:int,column:int>,filename:string,fix:struct<applicability:string>>>",
    "eslint": "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int,column:int>>>>",
    "pylint": "array<struct<type:string,path:string,line:int,column:int,symbol:string,message:string>>",
    "golangci": "struct<Issues:array<struct<FromLinter:string,Text:string,Pos:struct<Filename:string,Line:int,Column:int>>>>",
    "rubocop": "struct<files:array<struct<path:string,offenses:array<struct<cop_name:string,severity:string,message:string,location:struct<start_line:int,start_column:int>>>>>>",
    "dotnet-format": "array<struct<FilePath:string,FileChanges:array<struct<LineNumber:int,CharNumber:int,DiagnosticId:string,FormatDescription:string>>>>",
}


def from_json(df: DataFrame, tool: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Diagnostics of a JSON format; text that isn't JSON gives none."""
    j = df.select(F.col(id_col).alias("id"), F.from_json(F.col(text_col), SCHEMAS[tool]).alias("j"))
    pick = lambda d, *cols: d.select("id", *[F.expr(e).alias(n) for e, n in zip(cols, _GROUPS, strict=True)], "at")
    if tool == "ruff":
        return pick(j.select("id", F.posexplode("j").alias("at", "x")), "x.filename", "x.location.row", "x.location.column", "'error'", "x.code", "x.message")
    if tool == "pylint":
        return pick(j.select("id", F.posexplode("j").alias("at", "x")), "x.path", "x.line", "x.column", "x.type", "x.symbol", "x.message")
    if tool == "golangci":
        return pick(j.select("id", F.posexplode("j.Issues").alias("at", "x")), "x.Pos.Filename", "x.Pos.Line", "x.Pos.Column", "'error'", "x.FromLinter", "x.Text")
    outer, inner = {"eslint": ("j", "messages"), "rubocop": ("j.files", "offenses"), "dotnet-format": ("j", "FileChanges")}[tool]
    nested = j.select("id", F.posexplode(outer).alias("nth", "f")).select("id", "nth", "f", F.posexplode(f"f.{inner}").alias("k", "x")).withColumn("at", F.col("nth") * 1_000_000 + F.col("k"))
    if tool == "eslint":
        return pick(nested, "f.filePath", "x.line", "x.column", "CASE WHEN x.severity = 2 THEN 'error' ELSE 'warning' END", "x.ruleId", "x.message")
    if tool == "rubocop":
        return pick(nested, "f.path", "x.location.start_line", "x.location.start_column", "x.severity", "x.cop_name", "x.message")
    return pick(nested, "f.FilePath", "x.LineNumber", "x.CharNumber", "'warning'", "x.DiagnosticId", "x.FormatDescription")


def attach_notes(diags: DataFrame) -> DataFrame:
    """Notes joined to the last error before them in the same file; errors keep their notes as an array."""
    key = F.when(F.col("severity") != "note", F.col("at"))
    owned = carry_forward(diags, ["id", "file"], ["at"], key, "owner")
    notes = owned.where("severity = 'note' AND owner IS NOT NULL").groupBy("id", "file", F.col("owner").alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "message"))).alias("n"))
    return owned.where("severity <> 'note'").drop("owner").join(notes.select("id", "file", "at", F.transform("n", lambda x: x["message"]).alias("notes")), ["id", "file", "at"], "left")


def by_file(diags: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    return count_by(diags, *by, "file")


def top_codes(diags: DataFrame, k: int = 3, by: tuple[str, ...] = ("id", "file")) -> DataFrame:
    """The k most frequent codes of each group; ties by code."""
    return top_k(count_by(diags.where("code IS NOT NULL"), *by, "code"), k, [F.desc("n"), F.col("code")], list(by))


def first_seen_codes(diags: DataFrame, k: int = 5) -> DataFrame:
    """As ``top_codes`` over all files of an output, but ties go to the code seen first."""
    c = diags.where("code IS NOT NULL").groupBy("id", "code").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    return top_k(c, k, [F.desc("n"), F.col("first_at")], ["id"])


def summary(diags: DataFrame) -> DataFrame:
    sev = lambda s: F.sum((F.col("severity") == s).cast("long"))
    return diags.groupBy("id").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("file").alias("files"), sev("error").alias("errors"), sev("warning").alias("warnings"))


#: Severities by rank; others come last.
SEVERITY = (("fatal", "error"), ("warning",), ("convention", "refactor", "info"))


def worst_files(diags: DataFrame, files: int = 10, per_file: int = 5) -> DataFrame:
    """Files by their worst severity, then path; of each the first offenses by severity, then line."""
    rank = F.coalesce(*[F.when(F.col("severity").isin(*s), F.lit(i)) for i, s in enumerate(SEVERITY)], F.lit(len(SEVERITY)))
    d = diags.withColumn("severity_rank", rank)
    d = d.withColumn("worst", F.min("severity_rank").over(Window.partitionBy("id", "file")))
    d = d.withColumn("file_rank", F.dense_rank().over(Window.partitionBy("id").orderBy("worst", "file")))
    return top_k(d.where(F.col("file_rank") <= files), per_file, [F.col("severity_rank"), F.col("line"), F.col("at")], ["id", "file"])

"""Folders walked level by level: the folders of a level are dealt to tasks, each lists its own, and what a rule leaves out is never opened.

The frontier of each level is a checkpoint, so a lost task lists its folders again and no others. A tree takes as many rounds as it is deep; a folder with very
many entries is one task's stream, not one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ordered import _settled
from ..operators.tools import ignore_patterns

#: Folders that hold what tools have made.
NOISE = (
    "node_modules", ".git", "target", "__pycache__", ".next", "dist", "build", ".cache", ".turbo", ".vercel", ".pytest_cache", ".mypy_cache", ".tox", ".venv", "venv", "env", "coverage", ".nyc_output", ".DS_Store", "Thumbs.db",
    ".idea", ".vscode", ".vs", "*.egg-info", ".eggs",
)
ENTRIES = "path string, name string, is_dir boolean, size long, modified timestamp, depth int"
_ROWS = 10_000


def _listed(root: str, depth: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        for b in batches:
            for rel in b.column("path").to_pylist():
                try:
                    found = system.get_file_info(fs.FileSelector(f"{base}/{rel}" if rel else base, recursive=False))
                except OSError:  # gone meanwhile, or not to be read
                    continue
                for k in range(0, len(found), _ROWS):
                    part = [i for i in found[k : k + _ROWS] if i.type in (fs.FileType.File, fs.FileType.Directory)]
                    names = [i.base_name for i in part]
                    yield pa.record_batch([
                        pa.array([f"{rel}/{n}" if rel else n for n in names], pa.string()), pa.array(names, pa.string()), pa.array([i.type == fs.FileType.Directory for i in part], pa.bool_()), pa.array([i.size for i in part], pa.int64()),
                        pa.array([i.mtime for i in part], pa.timestamp("us", tz="UTC")), pa.array([depth] * len(part), pa.int32()),
                    ], ["path", "name", "is_dir", "size", "modified", "depth"])

    return run


def glob(pattern: str, name: Column, ignore_case: bool = False) -> Column:
    """Whether a whole name fits a pattern in which ``*`` stands for any characters and ``?`` for one."""
    parts = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in (pattern.lower() if ignore_case else pattern))
    return (F.lower(name) if ignore_case else name).rlike(f"(?s)^{parts}\\z")


def _rule(line: str) -> tuple[str, bool, bool]:
    """(pattern over a path, whether it only fits folders, whether it takes back) of a line of an ignore file."""
    back, line = line.startswith("!"), line.removeprefix("!")
    folders, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    out, k = "", 0
    while k < len(line):
        if line.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif line.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(line[k], re.escape(line[k])), k + 1
    return ("^" if anchored else "(?:^|/)") + out + r"\z", folders, back


def ignored(path: Column, is_dir: Column, rules: list[str]) -> Column:
    """Whether the last rule that fits a path leaves it out. Rules are lines of an ignore file: ``!`` takes back, a ``/`` at the end means folders only, one elsewhere a path from the root."""
    made = [(F.when(path.rlike(p) & (is_dir if folders else F.lit(True)), F.lit(not back))) for p, folders, back in map(_rule, rules)]
    return F.coalesce(*reversed(made), F.lit(False)) if made else F.lit(False)


def ignore_rules(spark: SparkSession, path: str) -> list[str]:
    """The rules of one ignore file, in order; none if there is no such file. The file is read whole: it is written by hand."""
    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(at).type != fs.FileType.File:
        return []
    rows = spark.read.text(path, wholetext=True).select(F.explode(ignore_patterns("value")).alias("rule"))
    return [r.rule for r in rows.collect()]


def walk(
    spark: SparkSession, root: str, pattern: str = "*", kind: str = "f", max_depth: int | None = None, ignore_case: bool = False, noise: tuple[str, ...] = NOISE, rules: list[str] | tuple[str, ...] = (), tasks: int | None = None,
) -> DataFrame:
    """Entries (``ENTRIES``) below a folder whose name fits a pattern, files or with kind ``d`` folders; paths are relative, ``.`` as pattern means all.

    Folders of ``noise``, hidden ones and those that ``rules`` leave out aren't opened; hidden entries are told only for a pattern that begins with a dot. Entries of the root have depth 1,
    and no entry deeper than ``max_depth`` is given, nor any folder at it: a folder there counts as closed. Folders that can't be read are passed over.
    """
    root = root if "://" in root else f"file://{root}"
    pattern = "*" if pattern == "." else pattern
    hidden = pattern.startswith(".")
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier, levels, depth = spark.createDataFrame([("",)], "path string"), [], 1
    is_dir, name = F.col("is_dir"), F.col("name")
    while max_depth is None or depth <= max_depth:
        # folders are dealt by number, so that each task has about as many whatever their names
        found = frontier.repartition(n).mapInArrow(_listed(root, depth), ENTRIES)
        out = (is_dir & name.isin(*noise)) | (F.lit(not hidden) & name.startswith(".")) | ignored(F.col("path"), is_dir, list(rules))
        if max_depth is not None:
            out = out | (is_dir & (F.col("depth") >= max_depth))
        level = _settled(found.where(~out))
        levels.append(level)
        frontier = level.where("is_dir").select("path")
        if not frontier.limit(1).count():
            break
        depth += 1
    every = reduce(DataFrame.unionByName, levels) if levels else spark.createDataFrame([], ENTRIES)
    return every.where((is_dir if kind == "d" else ~is_dir) & glob(pattern, name, ignore_case))


def by_folder(found: DataFrame) -> DataFrame:
    """(folder, files, names): entries by the folder that they are in, names in order."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    return found.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_list("name")).alias("names")).withColumn("extensions", F.array_sort(F.array_distinct(F.transform("names", lambda x: T.extension(x)))))

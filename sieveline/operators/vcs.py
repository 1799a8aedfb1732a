"""Version control output: unified diffs, logs, status, branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .joins import carry_forward
from .ranking import top_k


def diff_lines(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, at, file, hunk, kind, line): added, removed and context lines with the file and hunk they stand in."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(T.lines(text_col)).alias("at", "raw"))
    raw = F.col("raw")
    head = F.when(raw.startswith("diff --git "), F.regexp_extract(raw, r"^diff --git \S+ b/(.*)$", 1))
    d = carry_forward(lines, ["id"], ["at"], head, "file")
    d = carry_forward(d, ["id"], ["at"], F.when(raw.startswith("@@"), F.col("at")).when(raw.startswith("diff --git "), F.lit(-1)), "hunk")
    kind = F.when(raw.startswith("+"), "added").when(raw.startswith("-"), "removed").otherwise("context")
    return d.where((F.col("hunk") >= 0) & ~raw.startswith("@@")).select("id", "at", "file", "hunk", kind.alias("kind"), raw.alias("line"))


def diff_stat(lines: DataFrame) -> DataFrame:
    n = lambda k: F.sum((F.col("kind") == k).cast("long"))
    return lines.groupBy("id", "file").agg(n("added").alias("added"), n("removed").alias("removed"), F.countDistinct("hunk").alias("hunks"))


def compact_diff(lines: DataFrame, per_hunk: int = 100, overall: int = 500) -> DataFrame:
    """Changed lines, the first of each hunk and of each output."""
    per = top_k(lines.where("kind <> 'context'"), per_hunk, [F.col("at")], ["id", "file", "hunk"], "nth_in_hunk")
    return top_k(per, overall, [F.col("at")], ["id"], "nth")


def commits(df: DataFrame, body: int = 3, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Commits of a log: hash, author, subject, the first body lines and how many were left out."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(T.lines(text_col)).alias("at", "raw"))
    d = carry_forward(lines, ["id"], ["at"], F.when(F.col("raw").rlike(r"^commit [0-9a-f]{7,40}"), F.col("at")), "commit_at").where("commit_at IS NOT NULL")
    text = F.when(F.col("raw").startswith("    ") & (F.trim("raw") != ""), F.trim("raw"))
    g = d.groupBy("id", "commit_at").agg(
        F.max(F.regexp_extract("raw", r"^commit ([0-9a-f]+)", 1)).alias("hash"), F.max(F.regexp_extract("raw", r"^Author:\s*(.*)$", 1)).alias("author"),
        F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct("at", text.alias("t"))))).alias("m"),
    )
    m = F.transform("m", lambda x: x["t"])
    return g.select("id", "commit_at", F.left("hash", F.lit(7)).alias("hash"), "author", F.try_element_at(m, F.lit(1)).alias("subject"), F.slice(m, 2, body).alias("body"), F.greatest(F.size(m) - 1 - body, F.lit(0)).alias("omitted"))


def status_rows(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Porcelain status: staged, modified, untracked or conflict, and the path."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(T.lines(text_col)).alias("at", "raw"))
    xy, path = F.substring("raw", 1, 2), F.substring(F.col("raw"), F.lit(4), F.length("raw"))
    kind = F.when(F.col("raw").startswith("## "), "branch").when(xy == "??", "untracked").when(xy.isin("UU", "AA", "DD", "AU", "UA", "DU", "UD"), "conflict").when(F.substring("raw", 1, 1) != " ", "staged").otherwise("modified")
    return lines.where(F.length("raw") >= 4).select("id", "at", kind.alias("kind"), path.alias("path"))


def branches(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Current, local and remote-only branches: remote names without those that are local."""
    lines = df.select(F.col(id_col).alias("id"), F.explode(T.lines(text_col)).alias("raw")).where("trim(raw) <> '' AND NOT contains(raw, '->')")
    name = F.regexp_replace(F.regexp_replace("raw", r"^[*+ ]\s*", ""), r"\s.*$", "")
    rows = lines.select("id", F.when(F.col("raw").startswith("*"), "current").when(name.startswith("remotes/"), "remote").otherwise("local").alias("kind"), F.regexp_replace(name, r"^remotes/[^/]+/", "").alias("name")).distinct()
    own = rows.where("kind <> 'remote'")
    return own.unionByName(rows.where("kind = 'remote'").join(own.select("id", "name"), ["id", "name"], "left_anti").select("id", "kind", "name"))


def parse_commit(x: Column | str) -> Column:
    """``[branch hash] ...`` as ``ok`` and seven characters of the hash."""
    h = F.regexp_extract(T.c(x), r"^\[[^\]\s]+(?: \([^)]*\))? ([0-9a-f]+)\]", 1)
    return F.when(h != "", F.concat(F.lit("ok "), F.left(h, F.lit(7)))).otherwise("ok")


def stashes(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    lines = df.select(F.col(id_col).alias("id"), F.explode(T.lines(text_col)).alias("raw")).where("raw <> ''")
    return lines.select("id", F.regexp_extract("raw", r"^(stash@\{\d+\})", 1).alias("stash"), F.regexp_replace(F.regexp_replace("raw", r"^stash@\{\d+\}: ", ""), r"^(?:WIP on|On) [^:]+: ", "").alias("message"))


def checks(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Counts of passed, failed and pending check lines; a line counts once, by the first mark or word that fits. Case matters."""
    has = lambda *marks: F.greatest(*[F.col("raw").contains(m) for m in marks])
    kind = F.when(has("[ok]", "pass"), "passed").when(has("[x]", "fail"), "failed").when(has("*", "pending"), "pending")
    lines = df.select(F.col(id_col).alias("id"), F.explode(T.lines(text_col)).alias("raw")).withColumn("kind", kind)
    n = lambda k: F.sum((F.col("kind") == k).cast("long"))
    return lines.where("kind IS NOT NULL").groupBy("id").agg(n("passed").alias("passed"), n("failed").alias("failed"), n("pending").alias("pending"))

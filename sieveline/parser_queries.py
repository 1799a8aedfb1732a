"""Queries over the parsers: tool output is written from the driver's tables, parsed back and reported.

The oracles count the same rows straight from the tables, so a line lost or misread shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import json_tokens as JT
from .functions import shell as S
from .functions import text as T
from .operators import answers as AN
from .operators import cloud, diagnostics, listings, test_results, transcripts, vcs
from .plans import filters as P
from .queries import query, table


def blob(df: DataFrame, ident: Column, at: str, line: Column) -> DataFrame:
    """(id, text): lines of each id in order, one output per id. Ids are numbers divided by a hundred, or orders of one customer or lines of one order, so each holds few rows at any scale."""
    g = df.select(ident.alias("id"), F.col(at).alias("at"), line.alias("line")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("l"))
    return g.select("id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def _s(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _k() -> Column:
    return F.col("p_partkey")


def _mypy(spark, sf_dir) -> DataFrame:
    line = _s("src/m", _k() % 7, ".py:", _k(), F.when(_k() % 3 == 0, ": warning: ").otherwise(": error: "), "bad part", F.when(_k() % 4 == 0, "").otherwise(_s("  [code-", _k() % 5, "]")))
    noise = F.when(_k() % 11 == 0, "Found errors").otherwise(line)
    return diagnostics.from_text(blob(table(spark, sf_dir, "part"), F.floor(_k() / 100), "p_partkey", noise), "mypy")


@query("SELECT p_partkey // 100 AS id, 'src/m' || (p_partkey % 7) || '.py' AS file, count(*) AS n FROM part WHERE p_partkey % 11 <> 0 GROUP BY 1, 2")
def mypy_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.by_file(_mypy(spark, sf_dir))


@query("SELECT p_partkey // 100 AS id, count(*) AS issues, count(DISTINCT p_partkey % 7) AS files, count(*) FILTER (p_partkey % 3 <> 0) AS errors, count(*) FILTER (p_partkey % 3 = 0) AS warnings FROM part WHERE p_partkey % 11 <> 0 GROUP BY 1")
def mypy_summary(spark, sf_dir):
    return diagnostics.summary(_mypy(spark, sf_dir))


@query("""SELECT id, file, code, n, rank FROM (SELECT p_partkey // 100 AS id, 'src/m' || (p_partkey % 7) || '.py' AS file, 'code-' || (p_partkey % 5) AS code, count(*) AS n,
 row_number() OVER (PARTITION BY p_partkey // 100, p_partkey % 7 ORDER BY count(*) DESC, p_partkey % 5) AS rank FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 4 <> 0 GROUP BY p_partkey // 100, p_partkey % 7, p_partkey % 5) WHERE rank <= 3""")
def mypy_top_codes(spark, sf_dir):
    return diagnostics.top_codes(_mypy(spark, sf_dir))


@query("""SELECT id, code, n, rank FROM (SELECT p_partkey // 100 AS id, 'TS' || (2000 + p_partkey % 9) AS code, count(*) AS n, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY count(*) DESC, min(p_partkey)) AS rank FROM part GROUP BY p_partkey // 100, p_partkey % 9) WHERE rank <= 5""")
def tsc_first_seen_codes(spark, sf_dir):
    line = _s("app/", _k() % 5, ".ts(", _k(), ",1): error TS", 2000 + _k() % 9, ": no")
    d = diagnostics.from_text(blob(table(spark, sf_dir, "part"), F.floor(_k() / 100), "p_partkey", line), "tsc")
    return diagnostics.first_seen_codes(d).drop("first_at")


@query("SELECT p_partkey // 100 AS id, count(*) AS issues, count(DISTINCT p_partkey % 6) AS files, count(*) AS errors, 0::BIGINT AS warnings FROM part GROUP BY 1")
def ruff_json_summary(spark, sf_dir):
    v = F.struct(_s("E", _k() % 9).alias("code"), F.lit("long line").alias("message"), F.struct(_k().alias("row"), F.lit(1).alias("column")).alias("location"), _s("a/b", _k() % 6, ".py").alias("filename"))
    text = table(spark, sf_dir, "part").groupBy(F.floor(_k() / 100).alias("id")).agg(F.to_json(F.collect_list(v)).alias("text"))
    return diagnostics.summary(diagnostics.from_json(text, "ruff"))


@query("""SELECT user_id AS id, count(*) FILTER (event_type = 'view') AS passed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'click') AS skipped FROM events WHERE event_type IN ('view', 'error', 'click') GROUP BY 1""")
def go_test_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "view", "pass").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "skip").otherwise("run")
    line = F.to_json(F.struct(action.alias("Action"), F.lit("p").alias("Package"), _s("T", F.col("event_id")).alias("Test"), F.lit(0.5).alias("Elapsed")))
    return test_results.totals(test_results.go_events(blob(e, F.col("user_id"), "event_id", line))).drop("seconds")


@query("""SELECT id, ext, n, rank FROM (SELECT o_custkey AS id, 'e' || (o_orderkey % 6) AS ext, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, 'e' || (o_orderkey % 6)) AS rank FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_custkey, o_orderkey % 6) WHERE rank <= 5""")
def ls_top_extensions(spark, sf_dir):
    o = F.col("o_orderkey")
    line = _s(F.when(o % 5 == 0, "drwxr-xr-x").otherwise("-rw-r--r--"), "  1 me staff  ", o, " Jan  1 12:00 f", o, ".e", o % 6)
    return listings.top_extensions(listings.ls_rows(blob(table(spark, sf_dir, "orders"), F.col("o_custkey"), "o_orderkey", line)))


@query("SELECT o_custkey AS id, 'src/f' || (o_orderkey % 3) AS file, count(*) AS n FROM orders GROUP BY 1, 2")
def grep_by_file(spark, sf_dir):
    o = F.col("o_orderkey")
    rows = listings.grep_rows(blob(table(spark, sf_dir, "orders"), F.col("o_custkey"), "o_orderkey", _s("src/f", o % 3, ":", o, ":x: y")))
    return rows.groupBy("id", "file").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey AS id, 'f' || (l_linenumber % 2) AS file, count(*) FILTER (l_suppkey % 2 = 0) AS added, count(*) FILTER (l_suppkey % 2 = 1) AS removed, count(*) AS hunks FROM lineitem GROUP BY 1, 2""")
def diff_stat(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("at", (F.col("l_linenumber") % 2) * 100 + F.col("l_linenumber"))
    f = F.col("l_linenumber") % 2
    line = _s("diff --git a/f", f, " b/f", f, "\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n", F.when(F.col("l_suppkey") % 2 == 0, "+new").otherwise("-old"), "\n same")
    return vcs.diff_stat(vcs.diff_lines(blob(li, F.col("l_orderkey"), "at", line)))


@query("""SELECT c_custkey // 100 AS id, count(*) AS pods, count(*) FILTER (c_custkey % 3 = 0) AS running, count(*) FILTER (c_custkey % 3 = 1) AS pending, count(*) FILTER (c_custkey % 3 = 2) AS failed, 0::BIGINT AS succeeded, sum(c_custkey % 4)::BIGINT AS restarts, count(*) FILTER (c_custkey % 3 = 1) AS waiting FROM customer GROUP BY 1""")
def pod_report(spark, sf_dir):
    k = F.col("c_custkey")
    state = F.struct(F.struct(F.when(k % 3 == 1, "CrashLoopBackOff").alias("reason")).alias("waiting"))
    pod = F.struct(F.struct(F.lit("ns").alias("namespace"), F.col("c_name").alias("name")).alias("metadata"), F.struct(F.when(k % 3 == 0, "Running").when(k % 3 == 1, "Pending").otherwise("Failed").alias("phase"), F.array(F.struct((k % 4).alias("restartCount"), state.alias("state"))).alias("containerStatuses")).alias("status"))
    text = table(spark, sf_dir, "customer").groupBy(F.floor(k / 100).alias("id")).agg(F.to_json(F.struct(F.collect_list(pod).alias("items"))).alias("text"))
    return listings.pod_report(listings.pods(text))


@query("""SELECT n_regionkey AS answer, n_nationkey::VARCHAR AS id, 'Active' AS state, n_name AS engine FROM nation""")
def cloud_rows(spark, sf_dir):
    item = F.struct(F.col("n_nationkey").cast("string").alias("DBInstanceIdentifier"), F.col("n_name").alias("Engine"), F.lit("Active").alias("DBInstanceStatus"))
    text = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.to_json(F.struct(F.collect_list(item).alias("DBInstances"))).alias("text"))
    return cloud.rows(text, "rds-instances").select("answer", "id", "state", "engine")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE p_size % 4 + 1 END::BIGINT AS n_segments, CASE p_partkey % 5 WHEN 2 THEN 'git' WHEN 3 THEN 'cat' WHEN 4 THEN 't' || p_size ELSE 'make' END AS first_program FROM part""")
def split_chain(spark, sf_dir):
    cmd = (
        F.when(_k() % 5 == 0, _s("FOO=", _k(), " /usr/bin/make all && echo 'a && b' | wc -l")).when(_k() % 5 == 1, "sudo make; ls & pwd").when(_k() % 5 == 2, "git log --format=\"%h; %s\"")
        .when(_k() % 5 == 3, "cat <<E; ls").otherwise(_s("t", F.col("p_size"), " x", F.repeat(F.lit(" || true"), (F.col("p_size") % 4).cast("int"))))
    )
    seg = table(spark, sf_dir, "part").select("p_partkey", S.split_chain(cmd).alias("s"))
    return seg.select("p_partkey", F.size("s").cast("long").alias("n_segments"), S.command_name(F.element_at("s", 1)).alias("first_program"))


_PROGRAMS = ("git log -3", "/usr/bin/git status", "make all", "df -h", "sudo cargo build", "rm -rf x", "sieveline git log", "foo bar", "A=1 cargo test", "cargo build --release")


def _segments(spark, sf_dir):
    cmd = F.concat(F.lit("cd x && "), F.element_at(F.array(*[F.lit(x) for x in _PROGRAMS]), (_k() % len(_PROGRAMS) + 1).cast("int")))
    c = table(spark, sf_dir, "part").select(F.lit("f").alias("file"), _k().alias("seq"), cmd.alias("command"), F.when(_k() % 7 == 0, -1).otherwise(_k() * 4).cast("int").alias("output_len"))
    return transcripts.segments(c, ["git", "cargo"], [P.FilterDef("make", match_command="^make"), P.FilterDef("df", match_command="^df")])


_SEGMENTS_SQL = "s AS (SELECT p_partkey AS k, p_partkey % 10 AS c, CASE WHEN p_partkey % 7 = 0 THEN 150 ELSE p_partkey END AS raw FROM part)"


@query(f"""WITH {_SEGMENTS_SQL}, n AS (SELECT *, CASE WHEN c IN (0, 1) THEN 'git' WHEN c = 2 THEN 'make' WHEN c = 3 THEN 'df' ELSE 'cargo' END AS command, CASE WHEN c IN (2, 3) THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS pct,
 CASE c WHEN 0 THEN 'git log' WHEN 1 THEN 'git status' WHEN 2 THEN 'make all' WHEN 3 THEN 'df' WHEN 8 THEN 'cargo test' ELSE 'cargo build' END AS base FROM s WHERE c IN (0, 1, 2, 3, 4, 8, 9)),
b AS (SELECT command, base, count(*) AS m FROM n GROUP BY ALL)
SELECT command, count(*) AS n, sum(raw)::BIGINT AS raw_tokens, sum(CAST(floor(raw * pct) AS BIGINT))::BIGINT AS saved_tokens, CASE WHEN command IN ('make', 'df') THEN 'filter' ELSE 'command' END AS via,
 (SELECT base FROM b WHERE b.command = n.command ORDER BY m DESC, base LIMIT 1) AS display FROM n GROUP BY command""")
def discover_supported(spark, sf_dir):
    return transcripts.discover(_segments(spark, sf_dir))[0]


@query(f"""WITH {_SEGMENTS_SQL} SELECT 'foo bar' AS command, count(*) AS n, 'foo bar' AS example FROM s WHERE c = 7""")
def discover_unsupported(spark, sf_dir):
    return transcripts.discover(_segments(spark, sf_dir))[1]


@query("SELECT event_id, '{' || chr(10) || '  k: ' || json_extract_string(props, '$.k') || chr(10) || '}' AS shown FROM events")
def json_compact(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", JT.compact("props").alias("shown"))


#: Texts as JSON strings of an object in DuckDB, and what is shown of a string.
_AS_TYPE = "CASE WHEN strlen(#) > 50 THEN 'string[' || strlen(#) || ']' WHEN starts_with(#, 'http') THEN 'url' WHEN contains(#, '-') AND strlen(#) = 10 THEN 'date?' ELSE 'string' END"
_AS_VALUE = "'\"' || CASE WHEN strlen(#) > 80 THEN left(#, list_max(list_filter(range(0, 78), lambda k: strlen(left(#, k)) <= 77))) || '...' ELSE # END || '\"'"


def _objects(spark, sf_dir):
    """Documents as JSON: numbers as they are written, the text whole, alone and in a list."""
    d = table(spark, sf_dir, "documents")
    quoted = F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2)
    return d.select(F.col("doc_id").alias("id"), _s('{"text": ', quoted, ', "id": ', F.col("doc_id"), '.50e2, "list": [', quoted, ', null, {"lang": "', F.col("lang"), '"}], "many": [1,2,3,4,5,-0]}').alias("json"))


@query(f"SELECT doc_id AS id, '{{' || chr(10) || '  id: ' || doc_id || '.50e2' || chr(10) || '  list:' || chr(10) || '  [' || chr(10) || '    ' || {_AS_VALUE.replace('#', 'text')} || ',' || chr(10) || '    null,' || chr(10) || '    {{' || chr(10) || '      lang: \"' || lang || '\"' || chr(10) || '    }},' || chr(10) || '  ]' || chr(10) || '  many:' || chr(10) || '  [1, ... +5 more]' || chr(10) || '  text: ' || {_AS_VALUE.replace('#', 'text')} || chr(10) || '}}' AS shown FROM documents")
def json_compact_texts(spark, sf_dir):
    return _objects(spark, sf_dir).select("id", JT.compact("json").alias("shown"))


@query(f"SELECT doc_id AS id, '{{' || chr(10) || '  id: float,' || chr(10) || '  list:' || chr(10) || '  [' || {_AS_TYPE.replace('#', 'text')} || '] (3)' || chr(10) || '  many:' || chr(10) || '  [int] (6)' || chr(10) || '  text: ' || {_AS_TYPE.replace('#', 'text')} || chr(10) || '}}' AS shown FROM documents")
def json_shape_texts(spark, sf_dir):
    return _objects(spark, sf_dir).select("id", JT.shape("json").alias("shown"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN '[' || doc_id || ']' ELSE 'no [' || text END AS shown FROM documents")
def generic_answers(spark, sf_dir):
    """Answers in short where they are JSON, else as they are."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), AN.generic(F.when(F.col("doc_id") % 2 == 0, _s("[ ", F.col("doc_id"), " ]")).otherwise(F.concat(F.lit("no ["), F.col("text")))).alias("shown"))

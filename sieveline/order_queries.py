"""Queries along one order without a key that bounds a group: all events as one sequence, all documents' lines as one output."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import analytics as A
from .operators import joins as J
from .operators import ordered as O
from .parser_queries import _s
from .queries import query, table

AT = ["ts", "event_id"]

#: Lines of documents in DuckDB, all of them, with one number over the whole table.
LINES_SQL = """
SELECT doc_id, n, CASE WHEN length(line) % 3 = 0 THEN '  ' || line ELSE line END AS line, row_number() OVER (ORDER BY doc_id, n) AS pos
FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents)
"""


def _lines(spark, sf_dir):
    """(doc_id, n, line): a third of the lines indented."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line"))
    return rows.select("doc_id", "n", F.when(F.length("line") % 3 == 0, _s("  ", F.col("line"))).otherwise(F.col("line")).alias("line"))


@query("""WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events)
SELECT a.event_id, min_by(b.event_id, b.rn) AS fixed_by FROM e a JOIN e b ON b.rn BETWEEN a.rn + 1 AND a.rn + 3 AND b.event_type <> 'error' WHERE a.event_type = 'error' GROUP BY a.event_id""")
def lookahead_all(spark, sf_dir):
    found = J.look_ahead(table(spark, sf_dir, "events"), [], AT, 3, ["event_id", "event_type"], lambda a, b: b["event_type"] != "error")
    return found.where("event_type = 'error' AND match IS NOT NULL").select("event_id", F.col("match.event_id").alias("fixed_by"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT a.event_id, min_by(b.event_id, b.rn) AS fixed_by FROM e a JOIN e b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn + 1 AND a.rn + 3 AND b.event_type <> 'error' WHERE a.event_type = 'error' GROUP BY a.event_id""")
def lookahead_split_users(spark, sf_dir):
    """The same within users, however many rows one of them has."""
    found = J.look_ahead(table(spark, sf_dir, "events"), ["user_id"], AT, 3, ["event_id", "event_type"], lambda a, b: b["event_type"] != "error", split=True)
    return found.where("event_type = 'error' AND match IS NOT NULL").select("event_id", F.col("match.event_id").alias("fixed_by"))


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS section FROM events")
def carry_forward_all(spark, sf_dir):
    header = F.when(F.col("event_type") == "error", F.col("event_id"))
    return J.carry_forward(table(spark, sf_dir, "events"), [], AT, header, "section").select("event_id", F.coalesce("section", F.lit(-1)).alias("section"))


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS was, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1 OR was IS DISTINCT FROM event_type")
def drop_consecutive_all(spark, sf_dir):
    return J.drop_consecutive(table(spark, sf_dir, "events"), [], AT, F.col("event_type")).select("event_id", "event_type")


@query("""
WITH e AS (SELECT event_id, event_type = 'error' AS bad, user_id % 2 AS u, event_id % 3 AS v, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events),
p AS (SELECT a.event_id, b.rn, 'tool run u' || a.u || ' v' || a.v AS command, 'tool run u' || b.u || ' v' || b.v AS correction,
             CASE WHEN a.u = b.u OR a.v = b.v THEN 0.5::DOUBLE + 0.5::DOUBLE * (1.0::DOUBLE / 3) ELSE 0.5::DOUBLE END + CASE WHEN b.bad THEN 0::DOUBLE ELSE 0.2::DOUBLE END AS confidence
      FROM e a JOIN e b ON b.rn BETWEEN a.rn + 1 AND a.rn + 3 AND (a.u <> b.u OR a.v <> b.v) WHERE a.bad)
SELECT event_id, any_value(command) AS command, arg_min(correction, rn) AS correction, round(arg_min(confidence, rn), 6) AS confidence FROM p WHERE confidence >= 0.6 GROUP BY event_id
""")
def corrections_all_sessions(spark, sf_dir):
    """Failed commands with the similar one that put them right, all sessions as one sequence."""
    bad = F.col("event_type") == "error"
    runs = table(spark, sf_dir, "events").select("ts", "event_id", _s("tool run u", F.col("user_id") % 2, " v", F.col("event_id") % 3).alias("command"), bad.alias("is_error"), F.when(bad, "error: unknown option").otherwise("fine").alias("output"))
    return A.corrections(runs, [], AT).select("event_id", "command", "correction", F.round("confidence", 6).alias("confidence"))


@query(f"""
WITH l AS ({LINES_SQL}),
k AS (SELECT *, regexp_matches(line, '(?i)\\bthe\\b') AS bad, regexp_matches(line, '^\\s*$') AS blank, line[1] IN (' ', chr(9)) AS indented FROM l),
e AS (SELECT *, NOT bad AND ((blank AND lag(blank AND NOT bad) OVER (ORDER BY pos)) OR (NOT blank AND NOT indented)) AS ends FROM k),
w AS (SELECT *, max(CASE WHEN bad THEN pos END) OVER o AS opened, max(CASE WHEN ends THEN pos END) OVER o AS ended FROM e WINDOW o AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, n::INT AS n, line FROM w WHERE bad OR (opened IS NOT NULL AND opened > coalesce(ended, 0))
""")
def error_lines_all(spark, sf_dir):
    """All documents' lines as one output: lines with a word, and what is indented below them."""
    rows = O.in_blocks(_lines(spark, sf_dir), ["doc_id", "n"])
    return O.error_lines(rows, ["doc_id", "n"], "line", F.col("line").rlike(r"(?i)\bthe\b")).select("doc_id", "n", "line")


_DIFF_SQL = f"SELECT doc_id, n, CASE WHEN n = 0 THEN '+++ b/doc' || doc_id ELSE ['+', '-', ' '][(length(line) % 3 + 1)::INT] || line END AS line FROM ({LINES_SQL})"


@query(f"""
WITH d AS ({_DIFF_SQL}), c AS (SELECT * FROM d WHERE n > 0 AND line[1] IN ('+', '-') AND line[1:3] NOT IN ('+++', '---')),
f AS (SELECT doc_id, count(*) FILTER (WHERE line[1] = '+') AS a, count(*) FILTER (WHERE line[1] = '-') AS r, max(n) AS last FROM c GROUP BY doc_id)
SELECT doc_id, 0 AS n, 0 AS part, '[file] doc' || doc_id || ' (+' || a || ' -' || r || ')' AS line FROM f UNION ALL
SELECT doc_id, n::INT, 1, '  ' || line FROM c UNION ALL
SELECT doc_id, last::INT, 2, '  ... +' || (a + r - 10) || ' more' FROM f WHERE a + r > 10
""")
def condensed_diff_all(spark, sf_dir):
    """All documents as one diff, a file each, their lines added, removed or kept."""
    sign = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (F.length("line") % 3 + 1).cast("int"))
    rows = _lines(spark, sf_dir).withColumn("line", F.when(F.col("n") == 0, _s("+++ b/doc", F.col("doc_id"))).otherwise(F.concat(sign, F.col("line"))))
    return O.condensed_diff(O.in_blocks(rows, ["doc_id", "n"]), ["doc_id", "n"], "line")

"""Queries over what a source reads: logs, captures, folders and trackers that are first written from the driver's tables, where the tables don't hold them."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from .functions import text as T
from .operators import dotnet
from .queries import query, table
from .sources import binlog, runs


def _logs(batches):
    """A binary build log for each list of parts: a third of them errors, a third warnings, a project for each brand."""
    n = binlog.number
    for b in batches:
        out = []
        for parts in b.column("parts").to_pylist():
            records, at = [], {}

            def text(s, records=records, at=at):
                if s not in at:
                    at[s] = binlog.FIRST_TEXT + len(at)
                    records.append((binlog.TEXT, s.encode()))
                return n(at[s])

            ticks = lambda t: n(binlog.HAS_TIME) + struct.pack("<q", t) + n(1)
            records.append((binlog.BUILD_STARTED, ticks(10_000_000)))
            for p in parts:
                k = p["k"]
                project, file, code, message = text(f"/src/{p['brand']}.csproj"), text(f"/src/p{k}.cs"), text(f"CS{1000 + k % 9}"), text(p["name"])
                records.append((binlog.PROJECT_STARTED, n(0) + b"\0" + project))
                kind = (binlog.ERROR, binlog.WARNING, binlog.MESSAGE)[k % 3]
                if kind == binlog.MESSAGE:
                    records.append((kind, n(binlog.HAS_MESSAGE) + message))
                else:
                    records.append((kind, n(binlog.HAS_MESSAGE | binlog.HAS_CONTEXT) + message + n(1) * 7 + n(0) + code + file + n(0) + n(k) + n(k % 7) + n(0) * 2))
                records.append((binlog.NAMES, b"\x07" * (k % 5)))
            records.append((binlog.BUILD_FINISHED, ticks(10_000_000 + 1_230_000 * len(parts)) + b"\0"))
            out.append(binlog.written(records))
        yield pa.record_batch([b.column("id").cast(pa.string()), pa.array(out, pa.binary())], ["path", "content"])


def _part_logs(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).cast("string").alias("id"), F.struct(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name")).alias("p"))
    return parts.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("parts")).mapInArrow(_logs, "path string, content binary")


@query("SELECT (p_partkey // 100)::VARCHAR AS path, CASE p_partkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'message' END AS kind, p_name AS message, CASE WHEN p_partkey % 3 < 2 THEN 'CS' || (1000 + p_partkey % 9) END AS code, CASE WHEN p_partkey % 3 < 2 THEN '/src/p' || p_partkey || '.cs' END AS file, CASE WHEN p_partkey % 3 < 2 THEN p_partkey::INT END AS line, CASE WHEN p_partkey % 3 < 2 THEN (p_partkey % 7)::INT END AS col FROM part")
def binlog_events(spark, sf_dir):
    return binlog.decode(_part_logs(spark, sf_dir)).where("kind IN ('error', 'warning', 'message')").select("path", "kind", "message", "code", "file", "line", "col")


@query("""
SELECT id::VARCHAR AS path, FALSE AS succeeded, projects, e AS errors, w AS warnings, first_error,
       printf('00:00:%02d.%02d', 123 * n // 1000, (123 * n % 1000) // 10) AS duration
FROM (SELECT p_partkey // 100 AS id, count(*) AS n, count(*) FILTER (WHERE p_partkey % 3 = 0) AS e, count(*) FILTER (WHERE p_partkey % 3 = 1) AS w, count(DISTINCT p_brand) AS projects,
             arg_min('CS' || (1000 + p_partkey % 9) || ' ' || '/src/p' || p_partkey || '.cs(' || p_partkey || ',' || p_partkey % 7 || '): ' || p_name, p_partkey) FILTER (WHERE p_partkey % 3 = 0) AS first_error
      FROM part GROUP BY 1)
""")
def binlog_builds(spark, sf_dir):
    """Builds by their logs, filled up from a console text that tells less."""
    raw = dotnet.build(F.lit("Build FAILED.\n    3 Error(s)\nTime Elapsed 00:00:09.99\n"))
    b = F.col("b")
    first = b["errors"][0]
    shown = F.concat(first["code"], F.lit(" "), first["file"], F.lit("("), first["line"].cast("string"), F.lit(","), first["col"].cast("string"), F.lit("): "), first["message"])
    both = T.bound(F.struct(F.col("build").alias("log"), raw.alias("text")), lambda p: dotnet.merged(p["log"], p["text"]))
    return binlog.builds(binlog.decode(_part_logs(spark, sf_dir))).select("path", F.explode(F.array(both)).alias("b")).select(
        "path", b["succeeded"].alias("succeeded"), b["projects"].cast("long").alias("projects"), F.size(b["errors"]).cast("long").alias("errors"), F.size(b["warnings"]).cast("long").alias("warnings"), shown.alias("first_error"), b["duration"].alias("duration"))


def _runs(spark, sf_dir):
    """Documents as captured runs: the text on standard output, a note on standard error, exit codes 0 to 2."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.lit("2024-01-02").cast("timestamp").alias("ts"), F.lit("show").alias("tool"), F.col("doc_id").cast("string").alias("args"), F.col("text").alias("stdout"), F.lit("note\n").alias("stderr"), (F.col("doc_id") % 3).alias("exit_code"))


@query("""
SELECT doc_id AS id, translate(text, 'e', '3') || 'not3' || chr(10) || '|' || doc_id % 3 || chr(10) || CASE WHEN doc_id % 3 > 0 THEN '[sieveline: full output saved to /x/tee-show_' || doc_id || '.txt — re-read if the filtered view is insufficient]' || chr(10) ELSE '' END AS shown,
       '' AS errors, CASE WHEN doc_id % 3 > 0 THEN '/x/tee-show_' || doc_id || '.txt' END AS path, CASE WHEN doc_id % 3 > 0 THEN text || 'note' || chr(10) END AS saved, 'sieveline show ' || doc_id AS label,
       (strlen(text) + 5 + 3) // 4 AS raw_tokens, (strlen(text) + 5 + 2 + 3) // 4 AS out_tokens
FROM documents
""")
def filtered_runs(spark, sf_dir):
    made = runs.filtered(_runs(spark, sf_dir), lambda t, code: F.concat(F.translate(t, "e", "3"), F.lit("|"), code.cast("string")), label=F.concat(F.lit("show "), F.col("id").cast("string")), folder="/x")
    return made.select("id", "shown", "errors", F.col("saved.path").alias("path"), F.col("saved.text").alias("saved"), "entry.label", "entry.raw_tokens", "entry.out_tokens")


@query("""
SELECT doc_id AS id, CASE WHEN doc_id % 3 > 0 THEN text ELSE length(text)::VARCHAR END AS shown, 'note' || chr(10) AS errors, CASE WHEN doc_id % 3 > 0 THEN (strlen(text) + 8) // 4 ELSE (strlen(text) + 3) // 4 END AS raw_tokens,
       CASE WHEN doc_id % 3 > 0 THEN (strlen(text) + 8) // 4 ELSE (strlen(length(text)::VARCHAR) + 3) // 4 END AS out_tokens
FROM documents
""")
def failed_runs_as_they_are(spark, sf_dir):
    made = runs.filtered(_runs(spark, sf_dir), lambda t, code: F.length(t).cast("string"), stdout_only=True, skip_on_failure=True, newline=False)
    return made.select("id", "shown", "errors", "entry.raw_tokens", "entry.out_tokens")


@query("""
SELECT '{' || chr(10) || '  "device_hash": "d",' || chr(10) || '  "version": "dev",' || chr(10) || '  "os": "",' || chr(10) || '  "arch": "",' || chr(10) || '  "commands": ' || count(*) || ',' || chr(10) || '  "raw_tokens": ' || sum((strlen(text) + 8) // 4) || ',' || chr(10)
       || '  "out_tokens": ' || sum((strlen(left(text, 100)) + 3) // 4) || ',' || chr(10) || '  "tokens_saved": ' || sum((strlen(text) + 8) // 4) - sum((strlen(left(text, 100)) + 3) // 4) || chr(10) || '}' AS payload
FROM documents
""")
def tracker_payload(spark, sf_dir):
    made = runs.filtered(_runs(spark, sf_dir), lambda t, code: F.left(t, F.least(F.length(t) - 5, F.lit(100))))
    return runs.payload(made.select("entry.*"), "d")

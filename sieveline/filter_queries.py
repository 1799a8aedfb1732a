"""Queries over the declarative filters: the whole catalog routed and applied to documents, and verified by its samples.

Their counterparts are written from the same definitions for DuckDB, whose engine and patterns are others'.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans import filters as P
from .plans import named
from .plans.catalog import DEFS
from .plans.samples import SAMPLES
from .queries import query, table

NAMES = sorted(SAMPLES)


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(patterns: tuple[str, ...]) -> str:
    return _q("|".join(f"(?:{p})" for p in patterns))


def filter_sql(d: P.FilterDef, source: str, ident: str, raw: str = "raw") -> str:
    """A definition as a DuckDB query over ``source``: (ident, filtered)."""
    clean = f"regexp_replace({raw}, '\\r\\n?', chr(10), 'g')"
    if d.strip_ansi:
        clean = f"regexp_replace({clean}, '\\x1b\\[[0-9;]*[a-zA-Z]', '', 'g')"
    a = "a"
    if d.strip_lines_matching:
        a = f"list_filter({a}, lambda x: NOT regexp_matches(x, {_any(d.strip_lines_matching)}))"
    elif d.keep_lines_matching:
        a = f"list_filter({a}, lambda x: regexp_matches(x, {_any(d.keep_lines_matching)}))"
    if d.truncate_lines_at is not None:
        a = f"list_transform({a}, lambda x: x[1:{d.truncate_lines_at}])"
    kept = "b"
    if d.head_lines is not None or d.tail_lines is not None:
        head, tail = d.head_lines or 0, d.tail_lines or 0
        kept = f"CASE WHEN len(b) > {head + tail} THEN list_concat(b[1:{head}], ['... (' || (len(b) - {head + tail}) || ' lines omitted)'], b[len(b) - {tail} + 1 : len(b)]) ELSE b END"
    cut = "c"
    if d.max_lines is not None:
        cut = f"CASE WHEN len(c) > {d.max_lines} THEN list_concat(c[1:{d.max_lines}], ['... (' || (len(c) - {d.max_lines}) || ' lines truncated)']) ELSE c END"
    out = f"array_to_string({cut}, chr(10))"
    if d.on_empty is not None:
        out = f"CASE WHEN regexp_matches({out}, '^\\s*$') THEN {_q(d.on_empty)} ELSE {out} END"
    for pattern, message, unless in reversed(d.match_output):
        test = f"regexp_matches(blob, {_q(pattern)})" + (f" AND NOT regexp_matches(blob, {_q(unless)})" if unless else "")
        out = f"CASE WHEN {test} THEN {_q(message)} ELSE {out} END"
    return f"""SELECT {ident}, {out} AS filtered FROM (SELECT {ident}, blob, {kept} AS c FROM (SELECT {ident}, array_to_string(a, chr(10)) AS blob, {a} AS b FROM (
 SELECT {ident}, CASE WHEN ends_with(t, chr(10)) OR t = '' THEN string_split(t, chr(10))[:-2] ELSE string_split(t, chr(10)) END AS a FROM (SELECT {ident}, {clean} AS t FROM {source}))))"""


_BASE = "base AS (SELECT doc_id, name, output || text AS raw FROM documents JOIN (VALUES " + ", ".join(f"({i}, {_q(n)}, {_q(SAMPLES[n][1])})" for i, n in enumerate(NAMES)) + f") s(i, name, output) ON doc_id % {len(NAMES)} = i)"


@query(f"WITH {_BASE} " + " UNION ALL ".join(f"SELECT doc_id, {_q(d.name)} AS filter, filtered FROM ({filter_sql(d, f'(SELECT * FROM base WHERE name = {_q(d.name)})', 'doc_id')})" for d in DEFS))
def catalog_filters(spark, sf_dir):
    """Every document behind a sample output of one of the 58 definitions, with a command that routes to it."""
    samples = F.broadcast(spark.createDataFrame([(i, SAMPLES[n][0], SAMPLES[n][1]) for i, n in enumerate(NAMES)], "i long, command string, output string"))  # 58 rows
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("i", F.col("doc_id") % len(NAMES)).join(samples, "i")
    return P.apply_routed(docs.select("doc_id", "command", F.concat("output", "text").alias("raw")), "command", "raw", DEFS).select("doc_id", "filter", "filtered")


_TESTS = "t AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(n)}, {_q(SAMPLES[n][1])}, {_q(SAMPLES[n][2])})" for n in NAMES) + ") v(name, raw, expected))"


#: How many documents each sample is dealt in DuckDB.
_DEALT = "d AS (SELECT name, count(doc_id) AS n FROM (VALUES " + ", ".join(f"({i}, {_q(n)})" for i, n in enumerate(NAMES)) + f") s(i, name) LEFT JOIN documents ON doc_id % {len(NAMES)} = i GROUP BY name)"


def _dealt(spark, sf_dir):
    """(doc_id, name, command, output, expected): every document with one of the catalog's samples."""
    rows = [(i, n, *SAMPLES[n]) for i, n in enumerate(NAMES)]
    samples = F.broadcast(spark.createDataFrame(rows, "i long, name string, command string, output string, expected string"))  # 58 rows
    return table(spark, sf_dir, "documents").select("doc_id").withColumn("i", F.col("doc_id") % len(NAMES)).join(samples, "i").drop("i")


@query(f"WITH {_TESTS}, {_DEALT}, f AS (" + " UNION ALL ".join(f"SELECT name, filtered FROM ({filter_sql(d, f'(SELECT * FROM t WHERE name = {_q(d.name)})', 'name')})" for d in DEFS) + ") SELECT f.name AS filter, n AS total, CASE WHEN rtrim(filtered, chr(10)) = rtrim(expected, chr(10)) THEN n ELSE 0 END AS passed, CASE WHEN rtrim(filtered, chr(10)) <> rtrim(expected, chr(10)) THEN n ELSE 0 END AS failed FROM f JOIN t ON f.name = t.name JOIN d ON d.name = f.name WHERE n > 0")
def verified_filters(spark, sf_dir):
    """The catalog's samples, one a document, routed by their commands and held against what they are to become."""
    cut = lambda c: F.regexp_replace(c, r"\n+\z", "")
    got = P.apply_routed(_dealt(spark, sf_dir), "command", "output", DEFS)
    ok = (F.col("filter") == F.col("name")) & (cut("filtered") == cut("expected"))
    return got.groupBy(F.col("name").alias("filter")).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


@query(f"WITH {_DEALT} SELECT v.*, coalesce(n, 0) AS documents FROM (VALUES " + ", ".join(f"({_q(d.name)}, {len(d.strip_lines_matching)}, {len(d.keep_lines_matching)}, {'NULL' if d.max_lines is None else d.max_lines})" for d in DEFS) + ") v(name, n_strip, n_keep, max_lines) LEFT JOIN d ON d.name = v.name")
def filter_catalog(spark, sf_dir):
    """The catalog with the documents whose commands route to each definition."""
    routed = _dealt(spark, sf_dir).groupBy(P.route("command", DEFS).alias("name")).agg(F.count(F.lit(1)).alias("documents"))
    return P.catalog(spark, DEFS).join(routed, "name", "left").select("name", "n_strip", "n_keep", "max_lines", F.coalesce("documents", F.lit(0)).alias("documents"))


@query(f"WITH {_DEALT} SELECT v.name, coalesce(n, 0) AS documents FROM (SELECT unnest([" + ", ".join(_q(n) for n in ["fd", "find", "grep", "rg", *(d.name for d in DEFS)]) + "]) AS name) v LEFT JOIN d ON d.name = v.name")
def filter_names(spark, sf_dir):
    """All names of filters with the documents whose commands route to them."""
    routed = _dealt(spark, sf_dir).groupBy(P.route("command", DEFS).alias("name")).agg(F.count(F.lit(1)).alias("documents"))
    return named.names(spark).join(routed, "name", "left").select("name", F.coalesce("documents", F.lit(0)).alias("documents"))

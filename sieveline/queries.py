"""Queries over the driver's tables for the library's own operators, and their DuckDB counterparts.

``documents.text`` and ``conversations.text`` stand for captured output, ``events`` for tracker and log rows.
Patterns are written so that Java's and RE2's engines read them alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import analytics as A
from .operators import joins as J
from .operators import ranking as R
from .plans import filters as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of documents in DuckDB: one empty line after the last newline isn't one.
LINES = "(CASE WHEN ends_with(text, chr(10)) OR text = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END)"
TOK = "((strlen({0}) + 3) // 4)"


def _filtered(spark, sf_dir, d: P.FilterDef) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.apply(d, "text").alias("out"))


@query(f"""
SELECT lang, count(*) AS docs, sum({TOK.format('text')})::BIGINT AS raw_tokens, sum({TOK.format('o')})::BIGINT AS out_tokens,
       round((sum({TOK.format('text')}) - sum({TOK.format('o')})) * 100.0 / sum({TOK.format('text')}), 6) AS saved_pct
FROM (SELECT lang, text, CASE WHEN len(a) > 6 THEN array_to_string(list_concat(a[1:4], ['... (' || (len(a) - 6) || ' lines omitted)'], a[len(a) - 1 : len(a)]), chr(10)) ELSE array_to_string(a, chr(10)) END AS o
      FROM (SELECT lang, text, list_filter({LINES}, lambda x: NOT regexp_matches(x, '^\\s*$')) AS a FROM documents))
GROUP BY lang""")
def filter_savings_by_lang(spark, sf_dir):
    """The flagship: filter every text, estimate tokens before and after, report savings."""
    d = P.FilterDef("q", strip_lines_matching=(r"^\s*$",), head_lines=4, tail_lines=2)
    df = table(spark, sf_dir, "documents").select("lang", T.est_tokens("text").alias("raw"), T.est_tokens(P.apply(d, "text")).alias("out"))
    raw, out = F.sum("raw"), F.sum("out")
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), raw.alias("raw_tokens"), out.alias("out_tokens"), F.round(T.saved_pct(raw, out), 6).alias("saved_pct"))


@query(f"SELECT lang, count(*) AS docs, sum({TOK.format('text')})::BIGINT AS tokens FROM documents GROUP BY lang")
def est_tokens_by_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(T.est_tokens("text")).alias("tokens"))


@query(f"SELECT doc_id, len({LINES}) AS n_lines FROM documents")
def line_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.count_lines("text").alias("n_lines"))


@query(f"SELECT doc_id, array_to_string(list_filter({LINES}, lambda x: NOT regexp_matches(x, '^\\s*$')), chr(10)) AS out FROM documents")
def strip_blank_lines(spark, sf_dir):
    return _filtered(spark, sf_dir, P.FilterDef("q", strip_lines_matching=(r"^\s*$",)))


@query(f"SELECT doc_id, array_to_string(list_filter({LINES}, lambda x: regexp_matches(x, 'License|[0-9]')), chr(10)) AS out FROM documents")
def keep_matching_lines(spark, sf_dir):
    return _filtered(spark, sf_dir, P.FilterDef("q", keep_lines_matching=("License", "[0-9]")))


@query(f"SELECT doc_id, array_to_string(list_transform({LINES}, lambda x: regexp_replace(regexp_replace(x, '[0-9]+', 'N', 'g'), 'th([aeiou])', '<\\1>', 'g')), chr(10)) AS out FROM documents")
def replace_chain(spark, sf_dir):
    return _filtered(spark, sf_dir, P.FilterDef("q", replace=(("[0-9]+", "N"), ("th([aeiou])", "<$1>"))))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(t, 'License') AND NOT regexp_matches(t, 'MIT') THEN 'licensed'
  WHEN regexp_matches(t, 'password') THEN 'secret' ELSE CASE WHEN t = '' THEN 'empty' ELSE t END END AS out
FROM (SELECT doc_id, rtrim(text, chr(10)) AS t FROM documents)""")
def match_output_unless(spark, sf_dir):
    d = P.FilterDef("q", match_output=(("License", "licensed", "MIT"), ("password", "secret", None)), on_empty="empty")
    return _filtered(spark, sf_dir, d)


@query(f"SELECT doc_id, array_to_string(list_transform({LINES}, lambda x: x[1:40]), chr(10)) AS out FROM documents")
def truncate_lines(spark, sf_dir):
    return _filtered(spark, sf_dir, P.FilterDef("q", truncate_lines_at=40))


@query(f"""
SELECT doc_id, CASE WHEN len(a) > 5 THEN array_to_string(list_concat(a[1:3], ['... (' || (len(a) - 5) || ' lines omitted)'], a[len(a) - 1 : len(a)]), chr(10)) ELSE array_to_string(a, chr(10)) END AS out
FROM (SELECT doc_id, {LINES} AS a FROM documents)""")
def head_tail(spark, sf_dir):
    return _filtered(spark, sf_dir, P.FilterDef("q", head_lines=3, tail_lines=2))


@query(f"""
SELECT doc_id, CASE WHEN trim(o) = '' THEN 'nothing' ELSE o END AS out FROM (
SELECT doc_id, CASE WHEN len(a) > 2 THEN array_to_string(list_concat(a[1:2], ['... (' || (len(a) - 2) || ' lines truncated)']), chr(10)) ELSE array_to_string(a, chr(10)) END AS o
FROM (SELECT doc_id, list_filter({LINES}, lambda x: regexp_matches(x, '[0-9]')) AS a FROM documents))""")
def max_lines_on_empty(spark, sf_dir):
    return _filtered(spark, sf_dir, P.FilterDef("q", keep_lines_matching=("[0-9]",), max_lines=2, on_empty="nothing"))


@query(f"""
SELECT key, count(*) AS n, min(doc_id) AS first_doc FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(unnest({LINES}), '0x[0-9a-fA-F]+', '<HEX>', 'g'), '\\b[0-9]{{4,}}\\b', '<NUM>', 'g'), '/[a-zA-Z0-9_./-]+', '<PATH>', 'g')) AS key FROM documents)
WHERE key <> '' GROUP BY key HAVING count(*) > 1""")
def normalize_dedup(spark, sf_dir):
    steps = (("0x[0-9a-fA-F]+", "<HEX>"), (r"\b[0-9]{4,}\b", "<NUM>"), ("/[a-zA-Z0-9_./-]+", "<PATH>"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.lines("text")).alias("line"))
    key = F.trim(reduce(lambda x, s: F.regexp_replace(x, *s), steps, F.col("line")))
    return lines.select("doc_id", key.alias("key")).where("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def _log(spark, sf_dir) -> DataFrame:
    """Events as log lines: a time stamp before or within the line, one of the words that make a severity, a path, a hexadecimal number, the user."""
    e = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    word = F.element_at(F.array(*[F.lit(w) for w in _LOG_WORDS]), (F.col("user_id") % len(_LOG_WORDS) + 1).cast("int"))
    text = F.concat(F.col("event_type"), F.lit(": "), word, F.lit(" user "), F.col("user_id").cast("string"), F.lit(" at /var/"), F.col("event_type"), F.lit("/x 0x"), F.hex("user_id"))
    line = F.when(F.col("event_type") == "view", F.concat(text, F.lit(" since "), stamp)).otherwise(F.concat(stamp, F.lit(" "), text))
    return e.select("event_id", line.alias("line"))


_LOG_WORDS = ("critical", "ALERT", "emerg", "Severe", "notice", "WARN", "info", "plain", "fatal", "Panic")
_LOG_SQL = f"""t AS (SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, event_type || ': ' || {list(_LOG_WORDS)}[user_id % {len(_LOG_WORDS)} + 1] || ' user ' || user_id || ' at /var/' || event_type || '/x 0x' || printf('%X', user_id) AS text FROM events),
l AS (SELECT event_id, CASE event_type WHEN 'view' THEN text || ' since ' || stamp ELSE stamp || ' ' || text END AS line FROM t),
s AS (SELECT *, CASE WHEN regexp_matches(lower(line), 'error|fatal|panic|critical|alert|emerg|severe') THEN 'error' WHEN regexp_matches(lower(line), 'warn|notice') THEN 'warn' WHEN contains(lower(line), 'info') THEN 'info' END AS severity,
      trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}[.,]?\\d*\\s*', ''), '0x[0-9a-fA-F]+', '<HEX>', 'g'), '\\b[0-9]{{4,}}\\b', '<NUM>', 'g'), '/[a-zA-Z0-9_./-]+', '<PATH>', 'g')) AS key FROM l)"""


@query(f"WITH {_LOG_SQL} SELECT severity, count(*) AS lines, count(DISTINCT key) AS kinds FROM s WHERE severity IS NOT NULL GROUP BY severity")
def log_summary(spark, sf_dir):
    return A.log_summary(_log(spark, sf_dir), "line")


@query(f"""WITH {_LOG_SQL}, g AS (SELECT severity, key, count(*) AS n, min_by(line, event_id) AS first_line FROM s WHERE severity IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY n DESC, key) AS rank FROM g)
SELECT severity, rank, key, n, CASE WHEN n > 1 THEN '[×' || n || '] ' ELSE '' END || CASE WHEN strlen(first_line) > 100 AND length(first_line) > 97 THEN first_line[1:97] || '...' ELSE first_line END AS shown FROM r WHERE (severity = 'error' AND rank <= 10) OR (severity = 'warn' AND rank <= 5)""")
def log_topk(spark, sf_dir):
    return A.log_report(_log(spark, sf_dir), "line", "event_id")


@query("""SELECT count(*) AS total_commands, count(*) FILTER (lang = 'de') AS passthrough_commands, count(*) FILTER (lang <> 'de') AS filtered_commands,
 (sum(r) FILTER (lang <> 'de'))::BIGINT AS raw_tokens, (sum(o) FILTER (lang <> 'de'))::BIGINT AS out_tokens, (sum(r - o) FILTER (lang <> 'de'))::BIGINT AS tokens_saved,
 round(sum(r - o) FILTER (lang <> 'de') * 100.0 / sum(r) FILTER (lang <> 'de'), 6) AS saved_pct
FROM (SELECT lang, (strlen(text) + 3) // 4 AS r, (strlen(text[1:200]) + 3) // 4 AS o FROM documents)""")
def gain_total(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("lang") == "de").alias("passthrough"), T.est_tokens("text").alias("raw_tokens"), T.est_tokens(T.truncate("text", 200)).alias("out_tokens"))
    return A.gain(d).withColumn("saved_pct", F.round("saved_pct", 6))


#: Models of the events, every rate among them and one that isn't known.
_MODELS = ("claude-opus-x", "claude-haiku-x", "claude-sonnet-x", "claude-fable-x", "claude-mythos-x", "other", "old-claude-haiku")
_RATES_SQL = "[5.0, 1.0, 3.0, 10.0, 10.0, 5.0, 5.0]::DOUBLE[]", "[25.0, 5.0, 15.0, 50.0, 50.0, 25.0, 25.0]::DOUBLE[]"


def _economics(spark, sf_dir, grain):
    """Usage is every event but purchases, the tracker holds purchases, views and clicks, so each event is in one log at least."""
    e = table(spark, sf_dir, "events")
    n = F.col("user_id")
    model = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (n % len(_MODELS) + 1).cast("int"))
    usage = e.where("event_type <> 'purchase'").select("ts", A.usage_cost(model, n, n + 1, n + 2, n + 3).alias("cost"), n.alias("input"), (n + 1).alias("output"), (n + 2).alias("cache_create"), (n + 3).alias("cache_read"))
    tracker = e.where("event_type IN ('purchase', 'view', 'click')").select("ts", (n * 4).alias("raw_tokens"), F.col("event_id").alias("out_tokens"))
    out = A.economics(usage, tracker, grain)
    return out.select("period", F.round("cost", 6).alias("cost"), "input", "output", "cache_create", "cache_read", "commands", "saved_tokens", F.round(F.col("cost_per_token") * 1e6, 6).alias("usd_per_million"), F.round("saved_usd", 4).alias("saved_usd"))


def _economics_sql(grain: str) -> str:
    p = {"day": "strftime(ts, '%Y-%m-%d')", "week": "strftime(date_trunc('week', ts), '%Y-%m-%d')", "month": "strftime(ts, '%Y-%m')"}[grain]
    return f"""
WITH u AS (SELECT {p} AS period, sum((user_id * i + (user_id + 1) * o + (user_id + 2) * i * 1.25 + (user_id + 3) * i * 0.10) / 1e6) AS cost, sum(user_id) AS input, sum(user_id + 1) AS output, sum(user_id + 2) AS cache_create, sum(user_id + 3) AS cache_read
  FROM (SELECT *, ({_RATES_SQL[0]})[user_id % 7 + 1] AS i, ({_RATES_SQL[1]})[user_id % 7 + 1] AS o FROM events WHERE event_type <> 'purchase') GROUP BY 1),
t AS (SELECT {p} AS period, count(*) AS commands, sum(greatest(user_id * 4 - event_id, 0)) AS saved_tokens FROM events WHERE event_type IN ('purchase', 'view', 'click') GROUP BY 1),
b AS (SELECT coalesce(u.period, t.period) AS period, coalesce(cost, 0) AS cost, coalesce(input, 0) AS input, coalesce(output, 0) AS output, coalesce(cache_create, 0) AS cache_create, coalesce(cache_read, 0) AS cache_read, coalesce(commands, 0) AS commands, coalesce(saved_tokens, 0) AS saved_tokens FROM u FULL JOIN t ON u.period = t.period),
r AS (SELECT coalesce(period, 'TOTAL') AS period, sum(cost) AS cost, sum(input) AS input, sum(output) AS output, sum(cache_create) AS cache_create, sum(cache_read) AS cache_read, sum(commands) AS commands, sum(saved_tokens) AS saved_tokens FROM b GROUP BY ROLLUP (period)),
k AS (SELECT *, CASE WHEN input + 5 * output + 1.25 * cache_create + 0.1 * cache_read > 0 THEN cost / (input + 5 * output + 1.25 * cache_create + 0.1 * cache_read)::DOUBLE ELSE 0 END AS w FROM r)
SELECT period, round(cost, 6) AS cost, input::BIGINT AS input, output::BIGINT AS output, cache_create::BIGINT AS cache_create, cache_read::BIGINT AS cache_read, commands::BIGINT AS commands, saved_tokens::BIGINT AS saved_tokens, round(w * 1e6, 6) AS usd_per_million, round(saved_tokens * w * 5, 4) AS saved_usd FROM k"""


@query(_economics_sql("day"))
def economics_daily(spark, sf_dir):
    return _economics(spark, sf_dir, "day")


@query(_economics_sql("week"))
def economics_weekly(spark, sf_dir):
    return _economics(spark, sf_dir, "week")


@query(_economics_sql("month"))
def economics_monthly(spark, sf_dir):
    return _economics(spark, sf_dir, "month")


@query("""SELECT c.conv_id, c.turn, CASE WHEN r.text IS NULL THEN -1 ELSE strlen(r.text) END AS output_len
FROM conversations c LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant' WHERE c.role = 'user'""")
def tool_join_left(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    uses, results = c.where("role = 'user'").select("conv_id", "turn"), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("of"), "text", "turn")
    return J.link_results(uses, results, "conv_id", "turn", "of", F.col("text"), F.col("turn")).select("conv_id", "turn", F.col("output_len").cast("long").alias("output_len"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT a.event_id, min_by(b.event_id, b.rn) AS fixed_by FROM e a JOIN e b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn + 1 AND a.rn + 3 AND b.event_type <> 'error' WHERE a.event_type = 'error' GROUP BY a.event_id""")
def lookahead_3(spark, sf_dir):
    found = J.look_ahead(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 3, ["event_id", "event_type"], lambda a, b: b["event_type"] != "error")
    return found.where("event_type = 'error' AND match IS NOT NULL").select("event_id", F.col("match.event_id").alias("fixed_by"))


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(text, ' '), lambda x: x <> '')) AS s FROM conversations),
p AS (SELECT *, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM w)
SELECT conv_id, turn, round(len(list_intersect(s, q)) / len(list_distinct(list_concat(s, q))), 9) AS similarity FROM p WHERE q IS NOT NULL""")
def jaccard_adjacent(spark, sf_dir):
    words = F.array_distinct(F.filter(F.split("text", " "), lambda w: w != ""))
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("s"))
    p = w.withColumn("q", F.lag("s").over(Window.partitionBy("conv_id").orderBy("turn"))).where("q IS NOT NULL")
    return p.select("conv_id", "turn", F.round(T.jaccard(F.col("s"), F.col("q")), 9).alias("similarity"))


@query("""SELECT user_id, event_type, count(*) AS occurrences, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS best FROM events GROUP BY user_id, event_type HAVING count(*) >= 2""")
def dedup_argmax(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.col("event_id"))
    return A.best_of(e, ["user_id", "event_type"], "event_id", F.col("value"), "at").where("occurrences >= 2")


@query("""SELECT user_id AS session, modified, covered, total, pct, repeat('@', CAST(floor(pct / 10 + 0.5) AS INT)) || repeat('.', 10 - CAST(floor(pct / 10 + 0.5) AS INT)) AS bar FROM (
SELECT user_id, max(ts) AS modified, count(*) FILTER (event_type <> 'error') AS covered, count(*) AS total, count(*) FILTER (event_type <> 'error') * 100.0::DOUBLE / count(*) AS pct FROM events GROUP BY user_id ORDER BY modified DESC, user_id LIMIT 10)""")
def session_top10(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(F.max("ts").alias("modified"), F.count(F.when(F.col("event_type") != "error", 1)).alias("covered"), F.count(F.lit(1)).alias("total"))
    return A.adoption(s)


@query("""SELECT p_type, p_size, n, rank FROM (SELECT p_type, p_size, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_size) AS rank FROM part GROUP BY p_type, p_size) WHERE rank <= 3""")
def group_top3(spark, sf_dir):
    return R.top_k(R.count_by(table(spark, sf_dir, "part"), "p_type", "p_size"), 3, [F.desc("n"), F.col("p_size")], ["p_type"])


@query("""WITH g AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rank_in_group FROM lineitem)
SELECT *, row_number() OVER (ORDER BY l_suppkey, rank_in_group) AS rank_overall FROM g WHERE rank_in_group <= 5 ORDER BY l_suppkey, rank_in_group LIMIT 200""")
def double_cap(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return R.double_cap(li, ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")], 5, 200)


@query("""SELECT o_custkey, o_orderkey, running FROM (SELECT o_custkey, o_orderkey, sum(o_orderkey % 7 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM orders) WHERE running <= 20""")
def budget_cap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return R.budget_cap(o, ["o_custkey"], [F.col("o_orderkey")], 20, F.col("o_orderkey") % 7 + 1)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT array_to_string(list_sort(json_keys(props)), ',') AS keys, count(*) AS n FROM events GROUP BY 1")
def json_keys_sorted(spark, sf_dir):
    return R.count_by(table(spark, sf_dir, "events").select(F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("keys")), "keys")


@query("""SELECT regexp_extract(url, '([^/]*)$', 1) AS name, count(*) AS n FROM pages GROUP BY 1""")
def path_basename(spark, sf_dir):
    return R.count_by(table(spark, sf_dir, "pages").select(T.basename("url").alias("name")), "name")


@query("""SELECT page_id, CASE WHEN length(b) > 50 THEN b[1:25] || '...' || right(b, 20) ELSE b END AS short FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS b FROM pages)""")
def compact_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.compact_url("url").alias("short"))


@query("""WITH d AS (SELECT a.doc_id, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
p AS (SELECT doc_id, unnest(range(1, greatest(len(x), len(y)) + 1)) AS pos, x, y FROM d)
SELECT doc_id, count(*) FILTER (x[pos] IS NULL) AS added, count(*) FILTER (y[pos] IS NULL) AS removed, count(*) FILTER (x[pos] <> y[pos]) AS changed FROM p GROUP BY doc_id""")
def positional_diff(spark, sf_dir):
    """Documents against the next one: only hashes of lines are joined."""
    d = table(spark, sf_dir, "documents").select("doc_id", J.line_hashes("text").alias("lines"))
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lines").alias("other")), "doc_id")
    return both.select("doc_id", F.explode(F.array(J.positional_counts(F.col("lines"), F.col("other")))).alias("n")).select("doc_id", "n.*")


@query("""WITH d AS (SELECT a.doc_id, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
p AS (SELECT doc_id, unnest(range(1, greatest(len(x), len(y)) + 1)) AS pos, x, y FROM d)
SELECT doc_id, pos::INT AS pos, x[pos] AS old, y[pos] AS new FROM p WHERE x[pos] IS DISTINCT FROM y[pos]""")
def positional_diff_lines(spark, sf_dir):
    """The lines themselves, for which both texts meet."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    return both.select("doc_id", F.explode(J.positional_diff(F.col("text"), F.col("other"))).alias("r")).select("doc_id", "r.pos", "r.old", "r.new")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS was, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn = 1 OR was <> event_type""")
def consecutive_dedup(spark, sf_dir):
    return J.drop_consecutive(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], F.col("event_type")).select("event_id", "user_id", "event_type")


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS section FROM events""")
def carry_forward_section(spark, sf_dir):
    header = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return J.carry_forward(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], header, "section").select("event_id", F.coalesce("section", F.lit(-1)).alias("section"))


@query("""SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '****' ELSE c_name[1:2] || '****' || right(c_name, 2) END AS masked FROM customer""")
def mask_value(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.mask_value("c_name").alias("masked"))


@query("""SELECT r.name AS filter, count(*) AS n FROM (SELECT page_id, min(name) AS name FROM pages LEFT JOIN (VALUES ('a-secure', '^https://'), ('b-digit', '[0-9]$'), ('c-any', '.')) AS f(name, pattern) ON regexp_matches(url, pattern) GROUP BY page_id) r GROUP BY 1""")
def regex_route(spark, sf_dir):
    defs = [P.FilterDef("a-secure", match_command="^https://"), P.FilterDef("b-digit", match_command="[0-9]$"), P.FilterDef("c-any", match_command=".")]
    return R.count_by(table(spark, sf_dir, "pages").select(P.route("url", defs).alias("filter")), "filter")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click')")
def anti_exclude(spark, sf_dir):
    return J.exclude(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["^view", "click"])


@query("""SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') THEN 1.5 WHEN starts_with(p_type, 'PROMO') THEN 2.5 ELSE 9.0 END::DOUBLE AS rate FROM part""")
def price_prefix(spark, sf_dir):
    rates = (("STANDARD", 1.5), ("PROMO", 2.5))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(*[F.when(F.col("p_type").startswith(p), F.lit(r)) for p, r in rates], F.lit(9.0)).alias("rate"))

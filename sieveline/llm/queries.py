"""The queries over this subpackage's operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, exact_dedup, filter_audit, lang_id, line_dedup, lm_score, near_dedup, packing, pii, source_audit, token_hist, toxicity
from .common import table

#: A parameter: the folder of public tokenizer files. They stay where they are.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat_format.from_turns(table(spark, sf_dir, "conversations"))
    return chat_format.link(messages, chat_format.REPLY).withColumnsRenamed({"conv": "conv_id", "pos": "turn"})


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), _fold(7) == 2, blend=True)


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), _fold(5) == 0
    return lang_id.identify(docs, held_out).withColumn("held_out", held_out)


def op4_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_hist.suffix_sums(token_hist.histogram(table(spark, sf_dir, "documents"), BYTE_BPE))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _fold(4) == 2
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "features")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key="sieveline")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_format, op2_ppm_score, op3_language_mixture, op4_token_histogram, op5_exact_dedup, op6_decontamination, op7_near_dedup, op8_toxicity, op9_best_fit_packing, op10_pii_surrogates, op11_line_dedup, op12_filter_audit, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": CHAT_FORMAT, "op5_exact_dedup": EXACT_DEDUP, "op6_decontamination": DECONTAMINATION, "op11_line_dedup": LINE_DEDUP, "op12_filter_audit": FILTER_AUDIT, "op13_source_divergence": SOURCE_DIVERGENCE}


EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

# Words joined by one space, so that a shingle is a string.
DECONTAMINATION = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL
  SELECT 'b', item_id, coalesce(text, '') FROM benchmark
), w AS (
  SELECT kind, id, list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM t
), s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k : k + 4], ' ')) END) AS shingle
  FROM w WHERE len(words) > 0
), n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM s d JOIN s b ON d.shingle = b.shingle AND d.kind = 'd' AND b.kind = 'b' JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.75 * any_value(n_item)
"""

CHAT_FORMAT = """
WITH c AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, text,
         CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS id
  FROM conversations
), s AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS order_no,
         CASE kind WHEN 'message' THEN 'message'
              WHEN 'call' THEN CASE WHEN bool_or(kind = 'result') OVER same THEN 'linked' ELSE 'call_without_result' END
              ELSE CASE WHEN bool_or(kind = 'call') OVER same THEN 'linked' ELSE 'result_without_call' END END AS status
  FROM c WINDOW same AS (PARTITION BY conv_id, id)
)
SELECT conv_id, turn, order_no, kind, id, CASE kind WHEN 'call' THEN 'reply' END AS tool, status,
       CASE WHEN kind = 'call' AND text IS NULL THEN 'missing chars; missing text' ELSE '' END AS errors,
       CASE kind WHEN 'call' THEN to_json({arguments: {chars: length(text), text: text}, id: id, kind: kind, status: status, tool: 'reply'})
                 WHEN 'result' THEN to_json({content: text, id: id, kind: kind, status: status})
                 ELSE to_json({content: text, kind: kind, status: status}) END::VARCHAR AS record
FROM s
"""

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), h AS (
  SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), d AS (SELECT k.*, coalesce(k.doc_id <> h.stays, false) AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

FILTER_AUDIT = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY text) AS e
  FROM t
), g AS (
  SELECT f.*, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails
  FROM f LEFT JOIN labels USING (doc_id)
), n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM g GROUP BY ALL
), x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM x p, x q, x r, x s, x t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31
), steps AS (SELECT filter_order, step, bits[step] AS bit, list_sum(list_slice(bits, 1, step - 1)) AS prior FROM o, range(1, 6) AS z(step)
), edges AS (
  SELECT part, bit, prior, coalesce(sum(n) FILTER (WHERE fails & prior = 0 AND fails & bit = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails & prior = 0 AND fails & bit > 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE fails & prior > 0 AND fails & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fails & prior = 0 AND fails & bit > 0), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE fails & prior = 0 AND fails & bit > 0), 0) AS toxic_lost
  FROM n, (SELECT DISTINCT bit, coalesce(prior, 0)::INT AS prior FROM steps) GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, edges.bit))::BIGINT AS shapley
FROM steps JOIN edges ON edges.bit = steps.bit AND edges.prior = coalesce(steps.prior, 0)
"""

SOURCE_DIVERGENCE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents
), w AS (
  SELECT lang, source, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM w GROUP BY ALL
), kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3
), l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), k AS (SELECT c.lang, c.source, c.term, c.n, kept.n AS whole FROM c JOIN kept ON c.lang = kept.lang AND c.term = kept.term
), g AS (
  SELECT d.lang, d.source, coalesce(any_value(l.v), 0) AS v, any_value(l.total) AS whole, coalesce(any_value(s.total), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN l ON l.lang = d.lang LEFT JOIN (SELECT lang, source, sum(n) AS total FROM k GROUP BY ALL) s ON s.lang = d.lang AND s.source = d.source GROUP BY ALL
), full_ AS (
  SELECT g.lang, g.source, kept.term, 1 + 1000000000::HUGEINT * (coalesce(k.n, 0) + 1) // (g.total + g.v) AS p
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = kept.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0
), q AS (
  SELECT k.lang, k.source, k.term AS item, 1 + 1000000000::HUGEINT * (k.n + 1) // (g.total + g.v) AS p, 1 + 1000000000::HUGEINT * (k.whole + 1) // (g.whole + g.v) AS q
  FROM k JOIN g ON g.lang = k.lang AND g.source = k.source
), r AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL
  SELECT lang, source, 'term', item, (p - q) * (p - q) // q FROM q WHERE p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= 200
"""

"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_bpe, chat_format, decontaminate, filter_audit, line_dedup, pii, quality_classifier, quality_rules, secret_scan, simhash, source_divergence, suffix_dedup
from .common import spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; one of fewer partitions than cores is dealt over them first, a larger one stays as it lies."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, net)
    return scored.select("doc_id", quality_classifier.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), vocabulary(), with_ids=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


#: The conversation that op8 adds: (conv_id, turn, role, text).
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_turns(turns.union(extra)))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(documents(spark, sf_dir))


def ranks() -> tuple[str, str]:
    """The rank file and the pattern that splits texts before it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(documents(spark, sf_dir), *ranks(), with_ids=False)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_secret_scan, op3_pii, op4_quality_classifier, op5_line_dedup, op6_bpe, op7_simhash, op8_chat_format, op9_suffix_dedup, op10_decontaminate, op11_filter_audit, op12_source_divergence, op13_byte_bpe)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op8_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role) + length(text) + length('### ' || ':' || chr(10) || '</turn>' || chr(10))
    + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({w for s in quality_rules.STOP_WORDS for w in (s, s.capitalize())}))

ORACLE_SQL["op1_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM l),
g AS (SELECT doc_id, i, t || ' ' || lead(t) OVER x || ' ' || lead(t, 2) OVER x AS g FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT l.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, greatest(len(w), 1)::DOUBLE AS nw, greatest(len(lines), 1)::DOUBLE AS nl,
  len(list_filter(w, lambda x: x IN ({STOPS}))) AS stops, len(list_filter(lines, lambda x: regexp_matches(x, '^\s*([-*•]|[0-9]+[.)])\s'))) AS listed, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS cut
  FROM l LEFT JOIN r USING (doc_id)),
v AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, word_chars / nw AS mean_word_chars, n_symbols / nw AS symbols_per_word, stops / nw AS stop_word_ratio,
  n_dup_lines / nl AS dup_line_ratio, listed / nl AS list_line_ratio, cut / nl AS cut_line_ratio, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND mean_word_chars >= 2 AND mean_word_chars <= 14 AND symbols_per_word <= 0.2 AND stop_word_ratio >= 0.02 AND dup_line_ratio <= 0.5 AND list_line_ratio <= 0.9 AND cut_line_ratio <= 0.5 AS kept FROM v
"""


def item_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE_SQL["op10_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {item_words('text')} AS w FROM documents),
b AS (SELECT item_id, {item_words('text')} AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS key FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM s)),
x AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS key FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM s) WHERE len(w) >= size)),
h AS (SELECT doc_id, item_id, i, x.size FROM x JOIN k ON x.size = k.size AND x.key = k.key),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)
"""

ORACLE_SQL["op11_filter_audit"] = r"""
WITH l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM w),
f AS (SELECT part, coalesce(good, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
  100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(m.doc_id > first, false)] AS fails FROM m LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
v AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM v a, v b, v c, v d, v e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
x AS (SELECT c.*, o, coalesce(list_position(list_transform(o, lambda i: fails[i]), true), 6) AS first FROM c, o),
s AS (SELECT part, list_aggregate(list_transform(o, lambda i: substr('ABCDE', i, 1)), 'string_agg', '') AS filter_order, k AS step, o[k] AS i,
  sum(n) FILTER (first > k) AS kept, sum(n) FILTER (first = k) AS removed, sum(n) FILTER (first < k AND fails[o[k]]) AS redundant,
  sum(n) FILTER (fails[o[k]] AND len(list_filter(fails, lambda y: y)) = 1) AS unique_fails, sum(n) FILTER (first = k AND good) AS good_lost, sum(n) FILTER (first = k AND toxic) AS toxic_lost
  FROM x, v GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, i), 0)::BIGINT AS shapley FROM s
"""

ORACLE_SQL["op12_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, v FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM grid),
every AS (SELECT lang, term, sum(n) AS n, any_value(v) AS v FROM grid GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM every),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN s USING (lang, source, item)
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u QUALIFY part = 'pair' OR rank <= 10
"""

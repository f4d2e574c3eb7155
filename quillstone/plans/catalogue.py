"""The query catalogue over the star-schema test tables, each with the SQL it must agree with.

Where an operator is sequential, random or beyond SQL, a query has no SQL and a unit test instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillstone.functions import text as X
from quillstone.operators import chunking as C
from quillstone.operators import clustering as K
from quillstone.operators import code as CO
from quillstone.operators import evaluation as V
from quillstone.operators import extraction as E
from quillstone.operators import graph as G
from quillstone.operators import lifecycle as L
from quillstone.operators import retrieval as R
from quillstone.operators import statistics as S
from quillstone.plans import queries as Q
from quillstone.plans import search as P
from quillstone.session import checkpointed, spread, table
from quillstone.sources import readers as I
from quillstone.streaming import events as Z

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def tok(x: str) -> str:
    """SQL: lower-case runs of ASCII letters and digits."""
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"


def words(x: str) -> str:
    """SQL: lower-case words of letters, digits and underscores."""
    return f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"


WEAK = ", ".join(f"'{w}'" for w in R.WEAK_TERMS)


def grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) + 3), lambda i: substr('  ' || lower({x}) || '  ', i, 3)))"


BM25 = f"""
WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({tok('text')}) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY ALL),
l AS (SELECT doc_id, len({tok('text')}) AS dl FROM documents),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
scored AS (
  SELECT query_id, doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN p USING (term) JOIN d USING (term) JOIN l USING (doc_id), s GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
"""


def keyword(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), X.ascii_terms("text").alias("terms"))
    docs = table(spark, d, "documents")
    posts = R.token_postings(docs, "doc_id", "text", X.ascii_terms)
    # Texts without terms count as well; null ones have no length.
    stats = docs.agg(F.count("*").alias("n"), F.count("text").alias("sized")).crossJoin(posts.agg(F.count("*").alias("tokens"))).select("n", (F.col("tokens") / F.col("sized")).alias("avgdl"))
    return R.top_k(R.prefix_bm25(q, posts, "terms", prefix=False, digits=6, stats=stats, most=k), k)


@query(BM25 + "SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def q01_keyword_search(spark, d):
    return keyword(spark, d)


@query(f"""
WITH c AS (SELECT item_id AS query_id, list_filter({words('text')}, lambda t: length(t) >= 2 AND t NOT IN ({WEAK})) AS w FROM benchmark),
q AS (SELECT query_id, unnest(list_filter(w, lambda t, i: list_position(w, t) = i)[1:5]) AS term FROM c),
n AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1),
p AS (SELECT DISTINCT doc_id, unnest({words('text')}) AS term FROM documents)
SELECT query_id, doc_id FROM q JOIN p USING (term) JOIN n USING (query_id) GROUP BY query_id, doc_id, need HAVING count(*) = need
""")
def q02_strict_and_match(spark, d):
    """The first five core terms of each whole query, all of which a text must hold."""
    docs = table(spark, d, "documents")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.slice(R.evidence_plan(F.col("text")), 1, 5)).alias("term"))
    return R.all_terms(q, docs.select("doc_id", F.explode(X.tokens("text")).alias("term")))


@query("""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
SELECT query_id, vec_id, round(c, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""")
def q03_vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return R.vector_top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 10).withColumn("score", F.round("score", 6))


def two_lists(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("query_id"), "doc_id", F.col("n_chars").cast("double").alias("score"), (F.col("doc_id") % 97).cast("double").alias("other"))
    a = R.top_k(docs, 50).withColumn("list", F.lit("long"))
    b = R.top_k(docs.withColumn("score", F.col("other")), 50).withColumn("list", F.lit("other"))
    return a.union(b)


TWO = """
WITH a AS (SELECT * FROM (SELECT lang AS query_id, doc_id, n_chars::DOUBLE AS score, 'long' AS list, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 50),
b AS (SELECT * FROM (SELECT lang AS query_id, doc_id, (doc_id % 97)::DOUBLE AS score, 'other' AS list, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 97 DESC, doc_id) AS rank FROM documents) WHERE rank <= 50),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
sig AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, max(score / 40000) FILTER (list = 'long') AS vector_similarity, max(score / 100) FILTER (list = 'other') AS fts_rank_score,
  count(DISTINCT list) AS n_retrievers, coalesce(bool_or(doc_id % 50 = 0), false) AS exact_match FROM u GROUP BY ALL)
"""


@query(TWO + "SELECT query_id, doc_id, round(sum(1.0 / (60 + rank - 1)), 9) AS score, count(DISTINCT list) AS n_lists FROM u GROUP BY ALL")
def q04_rrf_fuse(spark, d):
    return R.rrf(two_lists(spark, d), zero_based=True).select("query_id", "doc_id", F.round("score", 9).alias("score"), F.size("lists").alias("n_lists"))


def signals(spark: SparkSession, d: str) -> DataFrame:
    u = two_lists(spark, d).withColumn("vector_similarity", F.when(F.col("list") == "long", F.col("score") / 40000)).withColumn("fts_rank_score", F.when(F.col("list") == "other", F.col("score") / 100))
    none = F.lit(None).cast("double")
    u = u.withColumns({"summary_score": none, "table_score": none, "metadata_score": none, "exact_match": F.col("doc_id") % 50 == 0}).drop("other")
    return R.rrf_signals(u)


@query(TWO + "SELECT query_id, doc_id, score, vector_similarity, fts_rank_score, n_retrievers, exact_match FROM sig")
def q05_rrf_signals(spark, d):
    return signals(spark, d).select("query_id", "doc_id", F.round("score", 9).alias("score"), "vector_similarity", "fts_rank_score", F.size("retrievers").alias("n_retrievers"), "exact_match")


DIRS = ["originals/", "writing/", "concepts/", "people/", "companies/", "deals/", "meetings/", "media/articles/", "daily/", "media/x/", "notes/", "archive/"]
DIR_SQL = "[" + ", ".join(f"'{x}'" for x in DIRS) + "]"
BOOST_SQL = "CASE " + " ".join(f"WHEN slug LIKE '{p}%' THEN {f}" for p, f in sorted(R.SOURCE_BOOSTS.items(), key=lambda x: -len(x[0]))) + " ELSE 1.0 END"


def slugged(spark: SparkSession, d: str) -> DataFrame:
    slug = F.concat(F.element_at(F.array(*map(F.lit, DIRS)), (F.col("doc_id") % 12 + 1).cast("int")), F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents").withColumn("slug", slug).withColumn("page_type", X.infer_page_type("slug")).withColumn("source_kind", F.when(F.col("doc_id") % 3 == 0, "compiled_truth").otherwise("timeline"))
    return docs.select("doc_id", "slug", "page_type", F.col("source_kind").alias("source"), F.col("lang").alias("query_id"), "text", "n_chars", F.col("n_chars").cast("double").alias("score"))


@query(f"""
WITH t AS (SELECT doc_id, lang AS query_id, n_chars::DOUBLE AS score, {DIR_SQL}[doc_id % 12 + 1] || doc_id AS slug, doc_id % 3 = 0 AS truth FROM documents),
a AS (SELECT *, score * {BOOST_SQL} AS s FROM t WHERE NOT starts_with(slug, 'archive/')),
b AS (SELECT *, s / max(s) OVER (PARTITION BY query_id) AS n FROM a),
c AS (SELECT *, 0.7 * (CASE WHEN truth THEN 2 * n ELSE n END) + 0.3 * ((doc_id % 100) / 100.0) AS r FROM b),
e AS (SELECT *, r * (1 + 0.05 * ln(1 + doc_id % 7)) + 0.05 / (1 + date_diff('day', DATE '2024-01-01' + (doc_id % 500)::INT, DATE '2025-06-01') / 365.0) AS x FROM c)
SELECT query_id, doc_id, slug, round(x + CASE WHEN NOT truth THEN 0.1 ELSE 0 END, 6) AS score FROM e
""")
def q06_boost_chain(spark, d):
    t = slugged(spark, d).where(~R.hidden("slug")).withColumns({"cosine": (F.col("doc_id") % 100) / 100, "backlinks": F.col("doc_id") % 7, "intent": F.lit("temporal"), "updated_at": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 500).cast("int"))})
    t = R.max_normalised(R.source_boost(t))
    for c in (R.truth_boost(), R.cosine_rescore(), R.backlink_boost(), R.recency_boost("updated_at", F.lit("2025-06-01").cast("timestamp")), R.intent_boost()):
        t = t.withColumn("score", c)
    return t.select("query_id", "doc_id", "slug", F.round("score", 6).alias("score"))


CHUNKS = "WITH t AS (SELECT doc_id AS chunk_id, lang AS query_id, source AS slug, n_chars::DOUBLE AS score, CASE WHEN doc_id % 3 = 0 THEN 'compiled_truth' ELSE 'timeline' END AS source, text FROM documents)"


def chunk_hits(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "compiled_truth").otherwise("timeline")
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("query_id"), F.col("source").alias("slug"), F.col("n_chars").cast("double").alias("score"), kind.alias("source"), F.col("text").alias("chunk_text"), F.col("lang").alias("page_type"))


@query(CHUNKS + "SELECT query_id, slug, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, slug ORDER BY source = 'compiled_truth' DESC, score DESC, chunk_id) AS n FROM t) WHERE n <= 3")
def q07_dedup_top3_per_page(spark, d):
    return R.top_chunks_per_page(chunk_hits(spark, d)).select("query_id", "slug", "chunk_id", "score")


@query("""SELECT query_id, doc_id, page_type, score FROM (SELECT source AS query_id, doc_id, lang AS page_type, n_chars::DOUBLE AS score,
  count(lang) OVER (PARTITION BY source) AS c, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= greatest(1, floor(0.6 * c))""")
def q08_type_diversity(spark, d):
    return R.diversify(table(spark, d, "documents").select(F.col("source").alias("query_id"), "doc_id", F.col("lang").alias("page_type"), F.col("n_chars").cast("double").alias("score")))


@query(CHUNKS + """,
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, slug ORDER BY score DESC, chunk_id) AS n FROM t) WHERE n <= 2),
lack AS (SELECT query_id, slug FROM k GROUP BY ALL HAVING NOT bool_or(source = 'compiled_truth')),
low AS (SELECT query_id, slug, chunk_id FROM (SELECT k.*, row_number() OVER (PARTITION BY query_id, slug ORDER BY score, chunk_id DESC) AS m FROM k JOIN lack USING (query_id, slug)) WHERE m = 1),
best AS (SELECT query_id, slug, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, slug ORDER BY score DESC, chunk_id) AS m FROM t WHERE source = 'compiled_truth') WHERE m = 1),
swap AS (SELECT low.query_id, low.slug, low.chunk_id AS gone, best.chunk_id, best.score FROM low JOIN best USING (query_id, slug))
SELECT query_id, slug, chunk_id, score FROM k WHERE NOT EXISTS (SELECT 1 FROM swap WHERE swap.query_id = k.query_id AND swap.slug = k.slug AND swap.gone = k.chunk_id) UNION ALL SELECT query_id, slug, chunk_id, score FROM swap""")
def q09_ct_guarantee(spark, d):
    t = chunk_hits(spark, d)
    return R.guarantee_truth(R.cap_per(t, "slug", 2, tie="chunk_id"), t).select("query_id", "slug", "chunk_id", "score")


def kept_greedily(source: str) -> str:
    """SQL: the table kept (query_id, chunk_id): what one pass over each query's hits (query_id, chunk_id, score, text), best first, keeps."""
    return f"""gw AS MATERIALIZED (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM ({source})),
gp AS MATERIALIZED (SELECT a.query_id, a.n AS a, b.n AS b, len(a.w) + len(b.w) AS total FROM gw a JOIN gw b ON a.query_id = b.query_id AND a.n < b.n AND len(a.w) >= 0.85 * len(b.w) AND len(b.w) >= 0.85 * len(a.w) AND len(b.w) > 0),
gu AS MATERIALIZED (SELECT query_id, n, unnest(w) AS w FROM gw),
gc AS MATERIALIZED (SELECT p.query_id, a, b, total, count(*) AS shared FROM gp p JOIN gu x ON x.query_id = p.query_id AND x.n = p.a JOIN gu y ON y.query_id = p.query_id AND y.n = p.b AND y.w = x.w GROUP BY ALL),
ge AS MATERIALIZED (SELECT query_id, b AS n, list(a) AS better FROM gc WHERE shared / (total - shared) > 0.85 GROUP BY ALL),
gs AS MATERIALIZED (SELECT query_id, max(n) AS size FROM gw GROUP BY 1),
gr(query_id, n, kept) AS (SELECT query_id, 0::BIGINT, []::BIGINT[] FROM gs UNION ALL SELECT r.query_id, r.n + 1, CASE WHEN list_has_any(kept, coalesce(better, [])) THEN kept ELSE list_append(kept, r.n + 1) END
  FROM gr r JOIN gs ON gs.query_id = r.query_id AND r.n < size LEFT JOIN ge ON ge.query_id = r.query_id AND ge.n = r.n + 1),
kept AS (SELECT gw.query_id, chunk_id FROM (SELECT query_id, unnest(kept) AS n FROM gr JOIN gs USING (query_id) WHERE n = size) k JOIN gw ON gw.query_id = k.query_id AND gw.n = k.n)"""


@query(CHUNKS.replace("WITH t", "WITH RECURSIVE t") + ", " + kept_greedily("SELECT query_id, chunk_id, score, text FROM t") + " SELECT query_id, chunk_id, slug, score FROM t SEMI JOIN kept USING (query_id, chunk_id)")
def q10_greedy_jaccard_dedup(spark, d):
    """All texts of a language as one query's hits, the longest first."""
    return R.greedy_text_dedup(chunk_hits(spark, d)).select("query_id", "chunk_id", "slug", "score")


@query(f"""
WITH n AS (SELECT p_partkey AS doc_id, p_name AS t, {grams('p_name')} AS g FROM part),
q AS (SELECT p_partkey AS query_id, 'x' || substr(p_name, 2) AS t FROM part WHERE p_partkey % 100 = 0),
qq AS (SELECT query_id, {grams('t')} AS g FROM q),
s AS (SELECT query_id, doc_id, len(list_intersect(qq.g, n.g)) AS b, len(qq.g) + len(n.g) AS tot FROM qq, n),
r AS (SELECT query_id, doc_id, b / (tot - b) AS score FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score >= 0.3) WHERE rank <= 10
""")
def q11_trigram_fuzzy(spark, d):
    p = table(spark, d, "part")
    q = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("x"), F.expr("substr(p_name, 2)")).alias("text"))
    return R.fuzzy(q, p.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")), 0.3, 10).withColumn("score", F.round("score", 6))


@query(f"""
WITH p AS (SELECT lower(replace(s_name, '#', '-')) AS slug FROM supplier),
q AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 8 WHEN 0 THEN lower(replace(s_name, '#', '-')) WHEN 1 THEN upper(replace(s_name, '#', ' ')) WHEN 2 THEN left(lower(replace(s_name, '#', '-')), 16) WHEN 3 THEN left(s_name, 2) WHEN 4 THEN left(s_name, 1)
  WHEN 5 THEN substr(s_name, 3, 3) WHEN 6 THEN right(s_name, 2) ELSE right(s_name, 1) END AS text FROM supplier),
own AS (SELECT *, regexp_replace(lower(trim(text)), '[ _]+', '-', 'g') AS s FROM q),
e AS (SELECT query_id, slug, 1 AS stage FROM q JOIN p ON text = slug UNION ALL SELECT query_id, slug, 2 FROM own JOIN p ON s = slug UNION ALL SELECT query_id, slug, 3 FROM own JOIN p ON starts_with(slug, s)
  UNION ALL SELECT query_id, slug, 4 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS rank FROM
    (SELECT query_id, slug, len(list_intersect({grams('text')}, {grams('slug')})) / (len({grams('text')}) + len({grams('slug')}) - len(list_intersect({grams('text')}, {grams('slug')}))) AS score FROM q, p) WHERE score >= 0.55) WHERE rank <= 10
  UNION ALL SELECT query_id, slug, 5 FROM q JOIN p ON contains(slug, lower(text)))
SELECT DISTINCT query_id, slug, stage FROM (SELECT *, min(stage) OVER (PARTITION BY query_id) AS m FROM e) WHERE stage = m
""")
def q12_resolve_slugs(spark, d):
    """Whole slugs, other spellings, beginnings of one, two and more characters, parts inside."""
    s = table(spark, d, "supplier")
    slug = F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-")))
    k, name = F.col("s_suppkey") % 8, F.col("s_name")
    forms = [slug, F.upper(F.replace(name, F.lit("#"), F.lit(" "))), F.left(slug, F.lit(16)), F.left(name, F.lit(2)), F.left(name, F.lit(1)), F.substring(name, 3, 3), F.right(name, F.lit(2))]
    text = X.ladder([(k == i, f) for i, f in enumerate(forms)], F.right(name, F.lit(1)))
    return R.resolve(s.select(F.col("s_suppkey").alias("query_id"), text.alias("text")), s.select(slug.alias("slug")))


def rx(patterns: list[str]) -> str:
    return Q.any_pattern(patterns).replace("'", "''")


INTENT_SQL = f"CASE WHEN regexp_matches(lower(text), '{rx(Q.FULL_CONTEXT)}') OR regexp_matches(lower(text), '{rx(Q.TEMPORAL)}') THEN 'temporal' WHEN regexp_matches(lower(text), '{rx(Q.EVENT)}') THEN 'event' WHEN regexp_matches(lower(text), '{rx(Q.ENTITY)}') THEN 'entity' ELSE 'general' END"
SAMPLES = ["who is {}", "when was {}", "{} funding news", "{}", "everything about {}", "tell me about {}", "report-{}.pdf", "csv of {}", "{}?", "q1 {}"]
ASKED_SQL = "asked AS (SELECT conv_id, turn, replace([" + ", ".join(f"'{s}'" for s in SAMPLES) + "][((conv_id + turn) % 10 + 1)::INT], '{}', text) AS text FROM conversations)"


def asked(spark: SparkSession, d: str) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, SAMPLES)), ((F.col("conv_id") + F.col("turn")) % 10 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.replace(form, F.lit("{}"), F.col("text")).alias("text"))


@query(f"WITH {ASKED_SQL}, i AS (SELECT conv_id, turn, {INTENT_SQL} AS intent FROM asked) SELECT *, CASE WHEN intent = 'entity' THEN 'low' WHEN intent <> 'general' THEN 'high' END AS detail, CASE WHEN intent IN ('temporal', 'event') THEN 'timeline_first' WHEN intent = 'entity' THEN 'brain_first' ELSE 'evidence_first' END AS strategy FROM i")
def q13_intent_classify(spark, d):
    i = asked(spark, d).select("conv_id", "turn", Q.intent("text").alias("intent"))
    return i.withColumn("detail", Q.detail(F.col("intent"))).withColumn("strategy", Q.strategy(F.col("intent")))


PLAN_SQL = ", ".join(f"('{k}', '{r}', {w})" for k, v in Q.PLANS.items() for r, w in v.items())
has = lambda words: " OR ".join(f"contains(q, '{w}')" for w in words)


@query(f"""WITH {ASKED_SQL}, l AS (SELECT conv_id, turn, lower(trim(text)) AS q FROM asked),
t AS (SELECT conv_id, turn, CASE WHEN {has(Q.TABLE_WORDS)} THEN 'table_lookup' WHEN {has(Q.HOW_WORDS)} THEN 'how_to' WHEN {has(Q.TIME_WORDS)} THEN 'recent_or_timebound' WHEN {has(Q.FACT_WORDS)} OR ends_with(q, '?') OR ends_with(q, '？') THEN 'fact_lookup'
  WHEN regexp_matches(q, '\\.[A-Za-z]{{2,5}}$') OR regexp_matches(q, '[/\\\\]') OR (regexp_matches(q, '^[A-Za-z0-9_#-]*$') AND regexp_matches(q, '[0-9]')) OR regexp_matches(q, '^v[0-9.]{{2,}}$') THEN 'exact_lookup' ELSE 'conceptual' END AS query_type FROM l)
SELECT conv_id, turn, query_type, retriever, weight::DOUBLE AS weight FROM t JOIN (VALUES {PLAN_SQL}) AS p(query_type, retriever, weight) USING (query_type)""")
def q14_query_type_plan(spark, d):
    return Q.retrievers(asked(spark, d)).select("conv_id", "turn", "query_type", "retriever", "weight")


@query(f"SELECT conv_id, turn, trim(regexp_replace(translate(translate(lower(trim(text)), '{X.TRADITIONAL}', '{X.SIMPLIFIED}'), '{X.FULL_WIDTH}', '{X.HALF_WIDTH}'), '\\s+', ' ', 'g')) AS query FROM conversations")
def q15_normalize_query(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.normalize_query("text").alias("query"))


@query(TWO + "SELECT query_id, doc_id, exact_match OR n_retrievers >= 2 OR coalesce(vector_similarity >= 0.55, false) OR coalesce(fts_rank_score >= 0.18, false) AS balanced, exact_match OR n_retrievers >= 2 OR coalesce(vector_similarity >= 0.7, false) OR coalesce(fts_rank_score >= 0.3, false) AS precise, exact_match OR coalesce(vector_similarity >= 0.4, false) OR coalesce(fts_rank_score >= 0.1, false) AS recall FROM sig")
def q16_quality_gate(spark, d):
    return signals(spark, d).select("query_id", "doc_id", *(R.passes_gate(p).alias(p) for p in R.GATES))


@query(TWO + "SELECT query_id, doc_id, round(0.30 * coalesce(fts_rank_score, 0) + 0.25 * coalesce(vector_similarity, 0) + 0.10 * exact_match::INT, 9) AS score FROM sig")
def q17_local_rerank(spark, d):
    none = F.lit(None).cast("double")
    s = signals(spark, d).withColumns({"fts_score": F.col("fts_rank_score"), "vector_score": F.col("vector_similarity"), "title_score": none, "exact_match_score": F.col("exact_match").cast("double"), "freshness_score": none})
    return s.select("query_id", "doc_id", F.round(R.local_rerank(), 9).alias("score"))


@query("""WITH r AS (SELECT lang AS query_id, source AS document_id, doc_id AS node_id, n_chars::DOUBLE AS score, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS n FROM documents)
SELECT query_id, document_id, max(node_id) FILTER (n = 1) AS node_id, max(score) AS score, count(*) - 1 AS others, coalesce(string_agg(node_id::VARCHAR, ',' ORDER BY n) FILTER (n > 1), '') AS other_nodes FROM r GROUP BY ALL""")
def q18_group_by_document(spark, d):
    h = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("node_id"), F.col("n_chars").cast("double").alias("score"))
    return R.group_by_document(h).select("query_id", "document_id", "node_id", "score", F.size("group_hits").alias("others"), F.array_join(F.transform("group_hits", lambda g: g["node_id"].cast("string")), ",").alias("other_nodes"))


@query("""SELECT conv_id, turn, right(p, 200) AS context_before, left(n, 200) AS context_after FROM (SELECT conv_id, turn, lag(text) OVER w AS p0, lead(text) OVER w AS n0,
  CASE WHEN lag(turn) OVER w = turn - 1 THEN lag(text) OVER w END AS p, CASE WHEN lead(turn) OVER w = turn + 1 THEN lead(text) OVER w END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def q19_context_window(spark, d):
    return R.neighbour_context(table(spark, d, "conversations"), ("conv_id",), "turn", "text").select("conv_id", "turn", "context_before", "context_after")


@query("""WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, unnest(range(0, greatest(0, ceil((n - 120) / 600.0)::BIGINT - 1) + 1)) AS passage_order, text, n FROM t)
SELECT doc_id, passage_order, passage_order * 600 AS source_start, least(n, passage_order * 600 + 720) AS source_end, sha256(substr(text, (passage_order * 600 + 1)::BIGINT, 720)) AS digest FROM w
WHERE length(trim(regexp_replace(substr(text, (passage_order * 600 + 1)::BIGINT, 720), '\\s+', ' ', 'g'))) >= 24""")
def q20_passages(spark, d):
    p = C.window_passages(spread(table(spark, d, "documents"), "doc_id"), "doc_id", "text")
    return p.select("doc_id", "passage_order", "source_start", "source_end", F.sha2("content", 256).alias("digest"))


@query()
def q21_chunk_recursive(spark, d):
    docs = table(spark, d, "documents")
    a = C.exploded(docs, C.character_splitter(1000, 200)("text"), "doc_id").withColumn("splitter", F.lit("characters"))
    return a.union(C.exploded(docs, C.word_splitter()("text"), "doc_id").withColumn("splitter", F.lit("words")))


@query("""WITH p AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\n+'), lambda x: trim(x) <> '')) AS paragraph, generate_subscripts(list_filter(string_split_regex(text, '\\n+'), lambda x: trim(x) <> ''), 1) - 1 AS i FROM documents),
n AS (SELECT *, lead(paragraph) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM p),
s AS (SELECT doc_id, i, CASE WHEN starts_with(next, '#') THEN 0.8 ELSE 0 END
  + CASE WHEN length(regexp_extract(trim(next), '^(#*)', 1)) > 0 AND length(regexp_extract(trim(next), '^(#*)', 1)) < length(regexp_extract(trim(paragraph), '^(#*)', 1)) THEN 0.6 WHEN length(regexp_extract(trim(next), '^(#*)', 1)) > 0 AND length(regexp_extract(trim(paragraph), '^(#*)', 1)) = 0 THEN 0.4 ELSE 0 END
  + CASE WHEN greatest(strlen(paragraph) / strlen(next), strlen(next) / strlen(paragraph)) > 3 THEN 0.3 ELSE 0 END
  + CASE WHEN length(paragraph) - length(replace(paragraph, '-', '')) > 5 THEN 0.2 ELSE 0 END
  + CASE WHEN starts_with(trim(next), '- ') OR starts_with(trim(next), '* ') THEN 0.2 ELSE 0 END AS signal FROM n WHERE next IS NOT NULL),
l AS (SELECT *, lag(signal, 2) OVER w AS a, lag(signal) OVER w AS b, lead(signal) OVER w AS c, lead(signal, 2) OVER w AS e FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, i, round(signal::DOUBLE, 6) AS signal, round((coalesce(-3 * a, 0) + coalesce(12 * b, 0) + 17 * signal + coalesce(12 * c, 0) + coalesce(-3 * e, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE -3 END + CASE WHEN b IS NULL THEN 0 ELSE 12 END + 17 + CASE WHEN c IS NULL THEN 0 ELSE 12 END + CASE WHEN e IS NULL THEN 0 ELSE -3 END), 6) AS smooth FROM l""")
def q22_semantic_boundaries(spark, d):
    b = C.boundary_signals(C.paragraphs(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    return b.select("doc_id", "i", F.round("signal", 6).alias("signal"), F.round("smooth", 6).alias("smooth"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS tokens, strlen(text) // 4 AS byte_tokens, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) AS words,
  CASE WHEN length(text) > 30000 THEN 'large' WHEN length(text) > 3000 THEN 'medium' WHEN length(text) > 800 THEN 'small' ELSE 'micro' END AS granularity,
  CASE WHEN length(text) > 30000 THEN 'hierarchical' WHEN length(text) > 3000 THEN 'sections' WHEN length(text) > 800 THEN 'paragraphs' ELSE 'whole' END AS strategy FROM documents""")
def q23_token_stats(spark, d):
    t = table(spark, d, "documents").withColumn("granularity", S.granularity(F.lit("txt"), F.length("text"), F.lit(1)))
    return t.select("doc_id", X.token_count("text").alias("tokens"), X.byte_tokens("text").alias("byte_tokens"), X.word_count("text").alias("words"), "granularity", S.chunk_strategy(F.col("granularity")).alias("strategy"))


STOPS = ", ".join(f"'{w}'" for w in E.STOP_WORDS)


@query(f"""WITH w AS (SELECT doc_id, least(15, 5 + length(text) // 5000) AS most, unnest(list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')) AS term FROM documents),
c AS (SELECT doc_id, most, term, count(*) AS n FROM w WHERE strlen(term) >= 2 AND term NOT IN ({STOPS}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM c)
SELECT doc_id, term, n, rank FROM r WHERE rank <= most""")
def q24_keywords(spark, d):
    return E.keywords(spread(table(spark, d, "documents"), "doc_id"), "doc_id", "text")


@query(f"""WITH t AS (SELECT DISTINCT doc_id, unnest({tok('text')}) AS term FROM documents)
SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 10 AND count(*) <= floor((SELECT count(DISTINCT doc_id) FROM t) * 0.3) AND length(term) >= 2""")
def q24b_document_frequency(spark, d):
    return S.document_frequency(table(spark, d, "documents").select("doc_id", F.explode(X.ascii_terms("text")).alias("term")), "doc_id", "term")


REDACT_SQL = "text"
for _put, _p in X.REDACTIONS:
    REDACT_SQL = f"regexp_replace({REDACT_SQL}, '{_p}', '{_put}', 'g')"


@query(f"SELECT doc_id, array_to_string(list_concat(list_transform(regexp_extract_all(text, '\\d{{4}}[-/年]\\d{{1,2}}[-/月]\\d{{1,2}}[日]?')[1:5], lambda x: 'DATE:' || x), list_transform(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}')[1:5], lambda x: 'EMAIL:' || x)), ',') AS entities, sha256({REDACT_SQL}) AS redacted FROM documents")
def q25_entities_redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(E.pattern_entities("text"), ",").alias("entities"), F.sha2(X.redact("text"), 256).alias("redacted"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS text FROM documents), c AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){1,3})\\b', 1)) AS d, regexp_extract_all(text, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){1,3})\\b', 1) AS a FROM t),
f AS (SELECT doc_id, unnest(d) AS name, a FROM c), r AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(a, name)) - 1 AS rank FROM f)
SELECT doc_id, rank, name, CASE WHEN regexp_matches(name, '(?i)\\b(Inc|Corp|Ltd|LLC|Labs?|Tech|AI|Capital|Ventures?|Fund)\\b') THEN 'company' WHEN len(string_split_regex(name, '\\s+')) = 2 THEN 'person' ELSE 'unknown' END AS entity_type FROM r WHERE rank < 20""")
def q25b_entity_candidates(spark, d):
    return E.entity_candidates(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|nav|footer|noscript|template)\\b[^>]*>.*?</(?:script|style|nav|footer|noscript|template)\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>')) AS n_headings,
  len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|nav|footer|noscript|template)\\b[^>]*>.*?</(?:script|style|nav|footer|noscript|template)\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<a\\s[^>]*href=["'']([^"'']+)["'']')) AS n_links FROM pages""")
def q26_html_parse(spark, d):
    return I.html_documents(table(spark, d, "pages"), "page_id", "html").select("page_id", "title", F.size("headings").alias("n_headings"), F.size("links").alias("n_links"))


@query("""SELECT page_id, count(*) AS n_links, count(DISTINCT regexp_extract(l, '^(?:https?://)?([^/]+)', 1)) AS hosts FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href=["'']([^"'']+)["'']', 1)) AS l FROM pages) GROUP BY page_id""")
def q27_links_extract(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"']+)[\"']"), F.lit(1))).alias("l"))
    return links.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_distinct(F.regexp_extract("l", "^(?:https?://)?([^/]+)", 1)).alias("hosts"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """order -> customer -> nation -> region as one edge list."""
    e = lambda df, a, ka, b, kb, t: df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("dst"), F.lit(t).alias("link_type"))
    o = e(table(spark, d, "orders"), "o", "o_orderkey", "c", "o_custkey", "placed_by")
    return o.union(e(table(spark, d, "customer"), "c", "c_custkey", "n", "c_nationkey", "lives_in")).union(e(table(spark, d, "nation"), "n", "n_nationkey", "r", "n_regionkey", "part_of"))


EDGES = "e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'placed_by' AS link_type FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'lives_in' FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation)"


@query(f"""WITH RECURSIVE {EDGES}, t(start, node, depth) AS (SELECT 'o' || o_orderkey, 'o' || o_orderkey, 0 FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT start, dst, depth + 1 FROM t JOIN e ON node = src WHERE depth < 3)
SELECT start, node, min(depth) AS depth FROM t GROUP BY ALL""")
def q28_graph_traverse(spark, d):
    starts = table(spark, d, "orders").where("o_orderkey % 100 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("start"))
    return G.traverse(starts, edges(spark, d), 3)


@query(f"""WITH {EDGES}, a AS (SELECT 'o' || o_orderkey AS start FROM orders WHERE o_orderkey % 100 = 0)
SELECT start, src AS from_node, dst AS to_node, link_type, 1 AS depth FROM a JOIN e ON src = start UNION ALL SELECT start, y.src, y.dst, y.link_type, 2 FROM a JOIN e x ON x.src = start JOIN e y ON y.src = x.dst""")
def q28b_graph_paths(spark, d):
    starts = table(spark, d, "orders").where("o_orderkey % 100 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("start"))
    return G.paths(starts, edges(spark, d), 2)


@query(f"WITH {EDGES}, u AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) SELECT node, count(*) AS degree FROM u GROUP BY node")
def q29_degrees(spark, d):
    return G.degrees(edges(spark, d))


@query(f"WITH {EDGES}, n AS (SELECT 'c' || c_custkey AS node FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || n_nationkey FROM nation) SELECT node FROM n WHERE node NOT IN (SELECT src FROM e) AND node NOT IN (SELECT dst FROM e)")
def q29b_orphans(spark, d):
    named = lambda t, p, c: table(spark, d, t).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("node"))
    return G.orphans(named("customer", "c", "c_custkey").union(named("supplier", "s", "s_suppkey")).union(named("nation", "n", "n_nationkey")), edges(spark, d))


@query(f"WITH {EDGES} SELECT src, dst FROM e WHERE dst NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def q29c_dead_links(spark, d):
    nodes = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return G.dead_links(nodes, edges(spark, d))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT sha256(text)) AS texts FROM documents GROUP BY ALL")
def q30_brain_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct(F.sha2("text", 256)).alias("texts"))


@query("""WITH c AS (SELECT count(*)::DOUBLE AS n, count(l.doc_id)::DOUBLE AS linked, count(e.vec_id)::DOUBLE AS embedded FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id)
SELECT round(0.35 * embedded / n + 0.25 * linked / n + 0.15 * linked / n + 0.15 * embedded / n + 0.10 * (1 - (n - linked) / n), 4) AS health, (n - linked)::BIGINT AS unlabelled, (n - embedded)::BIGINT AS unembedded FROM c""")
def q30b_health(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    j = docs.join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("e")), "doc_id", "left")
    c = j.agg(F.count("*").cast("double").alias("n"), F.count("l").cast("double").alias("l"), F.count("e").cast("double").alias("e"))
    n, linked, embedded = F.col("n"), F.col("l"), F.col("e")
    return c.select(S.health(n, embedded, linked, linked, embedded, n - linked).alias("health"), (n - linked).cast("long").alias("unlabelled"), (n - embedded).cast("long").alias("unembedded"))


EVAL = BM25 + """, rel AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark JOIN labels ON doc_id % 7 = item_id % 7 AND quality = 0),
m AS (SELECT r.*, (rel.doc_id IS NOT NULL)::INT AS hit FROM ranked r LEFT JOIN rel USING (query_id, doc_id) WHERE rank <= 50),
g AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) AS hits, min(rank) FILTER (hit = 1) AS first, sum(CASE WHEN rank <= 10 AND hit = 1 THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM m GROUP BY 1),
w AS (SELECT query_id, count(*) AS relevant FROM rel GROUP BY 1)
SELECT query_id, round(coalesce(hits, 0) / 10.0, 6) AS precision, round(coalesce(hits, 0) / relevant, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS rr,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, relevant) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg FROM w LEFT JOIN g USING (query_id)"""


@query(EVAL)
def q31_eval_metrics(spark, d):
    b, low = table(spark, d, "benchmark"), table(spark, d, "labels").where("quality = 0")
    rel = b.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 7).alias("k")).join(low.select("doc_id", (F.col("doc_id") % 7).alias("k")), "k").select("query_id", "doc_id").distinct()
    m = V.per_query(keyword(spark, d, 50), rel, 10)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "rr", "ndcg")))


@query("SELECT label, i - 1 AS pos, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def q32_mean_vectors(spark, d):
    return K.mean_vector(table(spark, d, "embeddings"), "label").withColumn("mean", F.round("mean", 6))


@query()
def q32b_kmeans(spark, d):
    e = table(spark, d, "embeddings")
    return K.kmeans(e.select("vec_id", "embedding"), max(2, int((e.count() / 5) ** 0.5)))


@query()
def q32c_summary_tree(spark, d):
    e = table(spark, d, "embeddings")
    return K.summary_tree(e.select(F.col("label").cast("long").alias("document_id"), F.col("vec_id").alias("node"), F.concat(F.lit("node "), F.col("vec_id")).alias("content"), "embedding"))


@query("""WITH t AS (SELECT vec_id, 'tok' || chr((97 + vec_id % 26)::INT) || vec_id AS token, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS q, b.vec_id AS v, a.token, b.token AS synonym, list_cosine_similarity(a.e, b.e) AS c FROM t a JOIN t b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, v) AS n FROM s),
p AS (SELECT token, synonym, round(c, 6) AS score FROM r WHERE n <= 6 AND c >= 0.3 AND NOT contains(token, synonym) AND NOT contains(synonym, token)),
b AS (SELECT * FROM p UNION ALL SELECT synonym, token, score FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, synonym) AS k FROM b)
SELECT token, synonym, max(score) AS score FROM m WHERE k <= 5 GROUP BY ALL""")
def q33_synonym_mining(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("tok"), F.char((F.lit(97) + F.col("vec_id") % 26)), F.col("vec_id").cast("string")).alias("token"), "embedding")
    return K.mine_synonyms(K.similar_tokens(t, least=0.3).withColumn("score", F.round("score", 6)))


@query("""WITH c AS (SELECT doc_id AS item_path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), p AS (SELECT doc_id AS item_path, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 3)
SELECT item_path, CASE WHEN p.h IS NULL THEN 'new' WHEN c.h IS NULL THEN 'missing' WHEN c.h = p.h THEN 'unchanged' ELSE 'changed' END AS action FROM c FULL JOIN p USING (item_path)""")
def q34_incremental_diff(spark, d):
    t = table(spark, d, "documents")
    k = F.col("doc_id") % 10
    now = t.where(k != 1).select(F.col("doc_id").alias("item_path"), F.sha2("text", 256).alias("sha256"))
    was = t.where(k != 3).select(F.col("doc_id").alias("item_path"), F.sha2(F.when(k == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return L.snapshot_diff(now, was)


@query("SELECT doc_id, version_id, coalesce(lead(version_id) OVER (PARTITION BY doc_id ORDER BY version_id), -1) AS superseded_by, CASE WHEN lead(version_id) OVER (PARTITION BY doc_id ORDER BY version_id) IS NULL THEN 'ready' ELSE 'retired' END AS status FROM (SELECT user_id AS doc_id, event_id AS version_id FROM events)")
def q35_version_activation(spark, d):
    v = L.activate(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("version_id")))
    return v.withColumn("superseded_by", F.coalesce("superseded_by", F.lit(-1)))


@query("SELECT id, job_type, priority FROM (SELECT event_id AS id, event_type AS job_type, (event_id % 10)::INT AS priority, ts AS created_at FROM events WHERE event_type <> 'error') ORDER BY priority DESC, created_at, id LIMIT 50")
def q36_job_queue(spark, d):
    jobs = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("job_type"), (F.col("event_id") % 10).cast("int").alias("priority"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", "failed").otherwise("pending").alias("status"))
    return L.next_jobs(jobs, 50).select("id", "job_type", "priority")


@query("SELECT event_type AS job_type, CASE WHEN event_id % 4 < 3 THEN 'pending' ELSE 'failed' END AS status, count(*) AS n FROM events GROUP BY ALL")
def q36b_job_counts(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("job_type"), L.after_failure(F.col("event_id") % 4, F.lit(3)).alias("status")).groupBy("job_type", "status").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT event_type AS scope, ts::DATE AS day, event_id AS id, coalesce(value, 0.0)::DOUBLE AS amount, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id) AS n FROM events),
r AS (SELECT scope, day, id, amount, n, amount <= 500 AS admitted, CASE WHEN amount <= 500 THEN amount ELSE 0.0 END AS total FROM e WHERE n = 1
  UNION ALL SELECT e.scope, e.day, e.id, e.amount, e.n, total + e.amount <= 500, CASE WHEN total + e.amount <= 500 THEN total + e.amount ELSE total END FROM r JOIN e ON e.scope = r.scope AND e.day = r.day AND e.n = r.n + 1)
SELECT scope, day, id, amount, admitted FROM r""")
def q37_budget_ledger(spark, d):
    """Reservations of each scope and day while they stay within the cap."""
    e = table(spark, d, "events").select(F.col("event_type").alias("scope"), F.col("ts").cast("date").alias("day"), F.col("event_id").alias("id"), F.coalesce("value", F.lit(0.0)).alias("amount"))
    return L.admit(e, 500.0)


@query("SELECT DISTINCT sha256(doc_id % 100 || '|' || lang || '|' || source) AS fingerprint FROM documents WHERE sha256(doc_id % 100 || '|' || lang || '|' || source) NOT IN (SELECT sha256(doc_id % 100 || '|' || lang || '|' || source) FROM documents WHERE doc_id < 50)")
def q38_candidate_fingerprint(spark, d):
    t = table(spark, d, "documents").select("doc_id", L.fingerprint((F.col("doc_id") % 100).cast("string"), F.col("lang"), F.col("source")).alias("fingerprint"))
    return L.new_candidates(t, t.where("doc_id < 50").withColumn("status", F.lit("pending"))).select("fingerprint")


@query("SELECT event_id, ts::DATE::VARCHAR AS day, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20') WHERE n <= 50")
def q39_timeline_query(spark, d):
    e = table(spark, d, "events").where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-20'")
    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id"))
    return e.withColumn("n", n).where("n <= 50").select("event_id", F.col("ts").cast("date").cast("string").alias("day"), "event_type", "value")


def weights_sql() -> str:
    m = {"urls": "u", "citations": "u3", "title": "1.0", "body": "b", "timeline": "0.0", "recency": "r", "none": "0.0", "all": "1.0"}
    case = " ".join(f"WHEN page_type = '{k}' THEN " + " + ".join(f"{w} * {m.get(x, '0.0')}" for x, w in dims) for k, dims in E.RUBRICS.items() if k)
    return f"CASE {case} ELSE " + " + ".join(f"{w} * {m[x]}" for x, w in E.RUBRICS[""]) + " END"


@query(f"""WITH t AS (SELECT doc_id, text, {DIR_SQL}[doc_id % 12 + 1] AS dir, date_diff('day', DATE '2024-01-01' + (doc_id % 500)::INT, DATE '2025-06-01') AS days FROM documents),
x AS (SELECT doc_id, CASE dir WHEN 'people/' THEN 'person' WHEN 'companies/' THEN 'company' WHEN 'deals/' THEN 'deal' WHEN 'concepts/' THEN 'concept' ELSE 'other' END AS page_type, 0.0 AS u, 0.0 AS u3, CASE WHEN strlen(trim(text)) > 50 THEN 1.0 ELSE 0.0 END AS b, CASE WHEN days < 90 THEN 1.0 WHEN days < 180 THEN 0.7 WHEN days < 365 THEN 0.4 ELSE 0.1 END AS r FROM t)
SELECT doc_id, round(({weights_sql()})::DOUBLE, 3) AS score FROM x""")
def q40_completeness(spark, d):
    t = slugged(spark, d).withColumn("updated_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 500).cast("int")))
    return t.select("doc_id", E.completeness(F.col("page_type"), F.col("slug"), F.col("text"), F.lit(""), F.lit(""), F.col("updated_at"), F.lit("2025-06-01").cast("date")).alias("score"))


PRE = " OR ".join(f"starts_with(lower(trim(raw)), '{p.replace(chr(39), chr(39) * 2)}')" for p in E.PREAMBLES)
MADE = ["Here is the page", "## Empty", "", "## Next", "on YYYY-MM-DD", "```", "see [Source:nowhere]"]
MADE_SQL = " || chr(10) || ".join(f"'{x}'" for x in MADE)


@query(f"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN {MADE_SQL} || chr(10) ELSE '' END || text AS body FROM documents),
l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM b),
f AS (SELECT *, lead(trim(raw)) OVER (PARTITION BY doc_id ORDER BY line) AS next FROM l WHERE trim(raw) <> '')
SELECT doc_id, 'llm-preamble' AS rule, line FROM l WHERE {PRE}
UNION ALL SELECT doc_id, 'placeholder-date', line FROM l WHERE contains(raw, 'YYYY-MM-DD')
UNION ALL SELECT doc_id, 'missing-frontmatter', 1 FROM b WHERE NOT starts_with(ltrim(body), '---') AND trim(body) <> '' AND len(string_split(regexp_replace(body, '\\n$', ''), chr(10))) > 2
UNION ALL SELECT doc_id, 'empty-section', line FROM f WHERE starts_with(trim(raw), '## ') AND (next IS NULL OR starts_with(next, '#'))
UNION ALL SELECT doc_id, 'code-fence-residue', max(line) FROM l WHERE starts_with(trim(raw), '```') GROUP BY doc_id HAVING count(*) % 2 = 1
UNION ALL SELECT doc_id, 'broken-citation', line FROM (SELECT doc_id, line, unnest(regexp_extract_all(raw, '\\[Source:([^\\]]+)\\]', 1)) AS s FROM l)""")
def q41_lint(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id").withColumn("body", F.concat(F.when(F.col("doc_id") % 5 == 0, "\n".join(MADE) + "\n").otherwise(""), "text"))
    slugs = docs.select(F.concat(F.lit("documents/"), F.col("doc_id")).alias("slug"))
    return E.lint(docs, "doc_id", "body", slugs).select("doc_id", "rule", "line")


@query("""SELECT n_nationkey AS library_id, coalesce(a.c, 0) AS documents, coalesce(b.c, 0) AS nodes FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS c FROM supplier GROUP BY 1) b ON b.k = n_nationkey""")
def q42_library_stats(spark, d):
    lib = table(spark, d, "nation").select(F.col("n_nationkey").alias("library_id"))
    return S.library_stats(lib, table(spark, d, "customer").select(F.col("c_nationkey").alias("library_id")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("library_id")))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def q43_exact_dup_docs(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")


CODE = "class P{}:\n    def run(self):\n        helper_{}()\n\ndef helper_{}():\n    pass\n"


@query("""WITH p AS (SELECT p_partkey AS file_id, 'P' || p_partkey AS c, 'helper_' || p_size AS h FROM part)
SELECT file_id, 'class' AS kind, c AS name, '' AS calls FROM p UNION ALL SELECT file_id, 'function', c || '.run', '' FROM p UNION ALL SELECT file_id, 'function', h, '' FROM p UNION ALL SELECT file_id, 'call', 'run', h FROM p""")
def q44_code_symbols(spark, d):
    """Declarations and calls of a file per part."""
    head, a, b, tail = CODE.split("{}")
    size = F.col("p_size").cast("string")
    code = F.concat(F.lit(head), F.col("p_partkey").cast("string"), F.lit(a), size, F.lit(b), size, F.lit(tail))
    files = table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.lit("python").alias("language"), code.alias("code"))
    every = checkpointed(CO.structure(files, "file_id", "code", "language"))
    found, calls = CO.declared(every, "file_id"), CO.linked(every, "file_id")
    return found.select("file_id", "kind", F.col("qualified").alias("name"), F.lit("").alias("calls")).union(calls.select("file_id", F.lit("call"), "from_symbol", "to_symbol"))


def search_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    s = slugged(spark, d)
    chunks = s.join(e, s.doc_id == e.vec_id, "left").select(F.col("doc_id").alias("chunk_id"), "slug", "page_type", "source", F.col("text").alias("chunk_text"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 500).cast("int")).alias("updated_at"), "embedding")
    b = table(spark, d, "benchmark").join(e, F.col("item_id") == F.col("vec_id"), "left").select(F.col("item_id").alias("query_id"), "text", "embedding")
    return b, chunks, s.select("slug", (F.col("doc_id") % 7).alias("backlinks"))


def prefix_bm25(name: str, source: str, queries: str, k: int, terms: str | None = None) -> str:
    """SQL: the tables {name}_t (distinct tokens of source: id, text) and {name} (query_id, id, score, rank: the k best by BM25 of escaped prefixes).

    terms: rows (query_id, w) in place of the words of queries; then texts must hold all of them.
    """
    asked = terms or f"SELECT query_id, unnest({words('text')}) AS w FROM ({queries})"
    return f"""{name}_t AS (SELECT id, unnest(list_distinct({words('text')})) AS term FROM ({source})),
{name}_l AS (SELECT id, count(*) AS dl FROM {name}_t GROUP BY 1), {name}_s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM {name}_l),
{name}_q AS (SELECT DISTINCT query_id, CASE WHEN w IN ('and', 'or', 'not', 'near') THEN '_' || w ELSE w END AS q FROM ({asked})),
{name}_h AS (SELECT q, id, count(*)::DOUBLE AS tf FROM (SELECT DISTINCT q FROM {name}_q) JOIN {name}_t ON starts_with(term, q) GROUP BY ALL),
{name}_d AS (SELECT q, count(*) AS df FROM {name}_h GROUP BY 1), {name}_n AS (SELECT query_id, count(*) AS need FROM {name}_q GROUP BY 1),
{name}_r AS (SELECT query_id, id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score
  FROM {name}_q JOIN {name}_h USING (q) JOIN {name}_d USING (q) JOIN {name}_l USING (id) JOIN {name}_n USING (query_id), {name}_s GROUP BY query_id, id, need {'HAVING count(*) = need' if terms else ''}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_r) WHERE rank <= {k})"""


ROWS_SQL = "SELECT p_partkey AS id, p_brand AS table_id, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part"


@query(f"""WITH r AS ({ROWS_SQL}), {prefix_bm25("k", "SELECT id, text FROM r", "SELECT p_partkey AS query_id, p_type AS text FROM part WHERE p_partkey % 100 = 0", 1 << 30)},
b AS (SELECT * FROM (SELECT query_id, table_id, id, score, row_number() OVER (PARTITION BY query_id, table_id ORDER BY score DESC, id) AS n FROM k JOIN r USING (id)) WHERE n = 1)
SELECT query_id, table_id, id AS row_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 10""")
def q45_table_retrieval(spark, d):
    """The best row of each table, the ten best tables of a query."""
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("table_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    q = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("text"))
    return R.table_hits(q, rows).withColumn("score", F.round("score", 6))


def nearest(name: str, source: str, queries: str, k: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
  (SELECT query_id, id, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM ({queries}) a, ({source}) b)) WHERE rank <= {k})"""


SEARCHED = f"""b AS (SELECT item_id AS query_id, text, embedding::DOUBLE[] AS e FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
c AS (SELECT doc_id AS id, text, {DIR_SQL}[doc_id % 12 + 1] || doc_id AS slug, doc_id % 3 = 0 AS truth, embedding::DOUBLE[] AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""
PAGE_KIND_SQL = "CASE " + " ".join(f"WHEN starts_with(slug, '{p}') THEN '{t}'" for p, t in X.PAGE_TYPES) + " ELSE 'note' END"
HYBRID_SQL = f"""WITH {SEARCHED}, v AS (SELECT * FROM c WHERE NOT starts_with(slug, 'archive/')),
{prefix_bm25("k", "SELECT id, text FROM v", "SELECT query_id, text FROM b", 20)},
{nearest("x", "SELECT id, e FROM v WHERE e IS NOT NULL", "SELECT query_id, e FROM b WHERE e IS NOT NULL", 20)},
i AS (SELECT query_id, {INTENT_SQL} AS intent, e AS qe FROM b),
l AS (SELECT u.query_id, list, id, slug, CASE WHEN intent IN ('temporal', 'event') THEN score ELSE score * {BOOST_SQL} END AS score FROM (SELECT query_id, id, score, 'keyword' AS list FROM k UNION ALL SELECT query_id, id, score, 'vector' FROM x) u JOIN v USING (id) JOIN i USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, id) AS rank FROM l),
f AS (SELECT query_id, id, sum(1.0 / (60 + rank - 1)) AS s FROM r GROUP BY ALL),
n AS (SELECT f.query_id, id, s / max(s) OVER (PARTITION BY f.query_id) AS s FROM f),
t AS (SELECT n.query_id, id, slug, truth, intent, 0.7 * (CASE WHEN truth AND intent NOT IN ('temporal', 'event') THEN 2 * s ELSE s END) + 0.3 * coalesce(greatest(0, least(1, list_cosine_similarity(v.e, i.qe))), 0) AS s FROM n JOIN v USING (id) JOIN i USING (query_id)),
z AS (SELECT query_id, id AS chunk_id, slug, round(s * (1 + 0.05 * ln(1 + id % 7)) + 0.05 / (1 + date_diff('day', DATE '2024-01-01' + (id % 500)::INT, DATE '2025-06-01') / 365.0)
  + CASE WHEN intent = 'entity' AND (starts_with(slug, 'people/') OR starts_with(slug, 'companies/')) OR intent IN ('temporal', 'event') AND NOT truth THEN 0.1 ELSE 0 END, 9) AS s FROM t)
"""


@query(HYBRID_SQL + "SELECT query_id, rank, chunk_id, slug, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM z) WHERE rank <= 10")
def q46_hybrid_search(spark, d):
    """Both lists fused and boosted; the layers against alike hits are q46b."""
    q, chunks, links = search_inputs(spark, d)
    return P.hybrid_search(q, chunks, links, F.lit("2025-06-01").cast("timestamp"), P.SearchOptions(dedup=False)).select("query_id", "rank", "chunk_id", "slug", F.round("score", 6).alias("score"))


#: SQL: the layers of de-duplication over the hits h (query_id, chunk_id, slug, kind, truth, score, text), in their order.
LAYERS_SQL = f"""w1 AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, slug ORDER BY truth DESC, score DESC, chunk_id) <= 3),
{kept_greedily("SELECT query_id, chunk_id, score, text FROM w1")}, w2 AS (SELECT * FROM w1 SEMI JOIN kept USING (query_id, chunk_id)),
w3 AS (SELECT * FROM w2 QUALIFY kind IS NULL OR row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, chunk_id) <= greatest(1, floor(0.6 * count(kind) OVER (PARTITION BY query_id)))),
w4 AS (SELECT * FROM w3 QUALIFY row_number() OVER (PARTITION BY query_id, slug ORDER BY score DESC, chunk_id) <= 2),
lack AS (SELECT query_id, slug FROM w4 GROUP BY ALL HAVING NOT bool_or(truth)),
low AS (SELECT query_id, slug, chunk_id FROM w4 SEMI JOIN lack USING (query_id, slug) QUALIFY row_number() OVER (PARTITION BY query_id, slug ORDER BY score, chunk_id DESC) = 1),
best AS (SELECT query_id, slug, chunk_id, score FROM h WHERE truth QUALIFY row_number() OVER (PARTITION BY query_id, slug ORDER BY score DESC, chunk_id) = 1),
swap AS (SELECT low.query_id, low.slug, low.chunk_id AS gone, best.chunk_id, best.score FROM low JOIN best USING (query_id, slug)),
w5 AS (SELECT query_id, slug, chunk_id, score FROM w4 WHERE (query_id, slug, chunk_id) NOT IN (SELECT (query_id, slug, gone) FROM swap) UNION ALL SELECT query_id, slug, chunk_id, score FROM swap)"""


@query(HYBRID_SQL.replace("WITH b", "WITH RECURSIVE b", 1) + ", h AS (SELECT z.query_id, chunk_id, z.slug, " + PAGE_KIND_SQL.replace("slug", "z.slug") + " AS kind, chunk_id % 3 = 0 AS truth, s AS score, text FROM z JOIN c ON c.id = chunk_id), "
    + LAYERS_SQL + " SELECT query_id, rank, chunk_id, slug, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM w5) WHERE rank <= 10")
def q46b_hybrid_dedup(spark, d):
    """The same with all layers of de-duplication."""
    q, chunks, links = search_inputs(spark, d)
    return P.hybrid_search(q, chunks, links, F.lit("2025-06-01").cast("timestamp")).select("query_id", "rank", "chunk_id", "slug", F.round("score", 6).alias("score"))


def node_inputs(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("node_id"), (F.col("chunk_id") % 200).alias("document_id"), F.concat(F.lit("doc-"), (F.col("chunk_id") % 200).cast("string"), F.lit(".md")).alias("name"), F.col("chunk_text").alias("content"), F.get(F.split("chunk_text", "\n"), F.lit(0)).alias("summary"), "embedding")


def held(name: str, source: str, queries: str, k: int) -> str:
    """SQL: the table {name}: the first k texts, by id, that hold the query as a substring; the score is 1 / rank."""
    return f"""{name} AS (SELECT *, 1.0::DOUBLE / rank AS score FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM (SELECT DISTINCT query_id, s.id FROM ({queries}) q JOIN ({source}) s ON contains(lower(s.text), lower(q.text)) WHERE q.text <> '')) WHERE rank <= {k})"""


NORMAL_SQL = f"trim(regexp_replace(translate(translate(lower(trim(text)), '{X.TRADITIONAL}', '{X.SIMPLIFIED}'), '{X.FULL_WIDTH}', '{X.HALF_WIDTH}'), '\\s+', ' ', 'g'))"
TYPE_SQL = f"""CASE WHEN {has(Q.TABLE_WORDS)} THEN 'table_lookup' WHEN {has(Q.HOW_WORDS)} THEN 'how_to' WHEN {has(Q.TIME_WORDS)} THEN 'recent_or_timebound' WHEN {has(Q.FACT_WORDS)} OR ends_with(q, '?') OR ends_with(q, '？') THEN 'fact_lookup'
  WHEN regexp_matches(q, '\\.[A-Za-z]{{2,5}}$') OR regexp_matches(q, '[/\\\\]') OR (regexp_matches(q, '^[A-Za-z0-9_#-]*$') AND regexp_matches(q, '[0-9]')) OR regexp_matches(q, '^v[0-9.]{{2,}}$') THEN 'exact_lookup' ELSE 'conceptual' END"""
FIRST_SQL = "first_ AS (SELECT id % 200 AS document_id, min(id) AS id, 'doc-' || (id % 200) || '.md' AS name FROM c GROUP BY 1, 3), own AS (SELECT f.*, string_split(text, chr(10))[1] AS summary FROM first_ f JOIN c USING (id))"


def picked(name: str, columns: str = "query_id, text") -> str:
    return f"SELECT {columns} FROM a JOIN p USING (query_id) WHERE retriever = '{name}'"


@query(f"""WITH {SEARCHED}, a AS (SELECT query_id, {NORMAL_SQL} AS text, e FROM b), {FIRST_SQL},
p AS (SELECT query_id, retriever FROM (SELECT query_id, {TYPE_SQL} AS query_type FROM (SELECT query_id, lower(trim(text)) AS q FROM a)) JOIN (VALUES {PLAN_SQL}) AS w(query_type, retriever, weight) USING (query_type)),
{prefix_bm25("nf", "SELECT id, text FROM c", picked("node_fts"), 30)},
{prefix_bm25("tn", "SELECT id, name AS text FROM own", picked("title_name"), 30)},
{held("sm", "SELECT id, summary AS text FROM own", picked("summary"), 30)}, {held("md", "SELECT id, name AS text FROM own", picked("metadata"), 30)},
{nearest("vx", "SELECT id, e FROM c WHERE e IS NOT NULL", picked("vector", "query_id, e") + " AND e IS NOT NULL", 30)},
u AS (SELECT query_id, id, score, rank, 'node_fts' AS list, score / max(score) OVER (PARTITION BY query_id) AS fts, NULL AS vec, NULL AS summ, NULL AS meta, false AS exact FROM nf
  UNION ALL SELECT query_id, id, score, rank, 'vector', NULL, score, NULL, NULL, false FROM vx
  UNION ALL SELECT query_id, id, score, rank, 'summary', NULL, NULL, score, NULL, false FROM sm UNION ALL SELECT query_id, id, score, rank, 'metadata', NULL, NULL, NULL, score, false FROM md
  UNION ALL SELECT tn.query_id, id, score, rank, 'title', NULL, NULL, NULL, NULL, 'doc-' || (id % 200) = regexp_replace(lower(trim(a.text)), '^(.+)\\.[^.]{{0,10}}$', '\\1') FROM tn JOIN a USING (query_id)),
g AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS fused, max(score) AS own, max(fts) AS fts, max(vec) AS vec, max(summ) AS summ, max(meta) AS meta, bool_or(exact) AS exact, count(DISTINCT list) AS n FROM u GROUP BY ALL),
o AS (SELECT g.query_id, id, id % 200 AS document_id, CASE WHEN lists = 1 THEN own ELSE fused END AS score, fts, vec, summ, meta, exact FROM g JOIN (SELECT query_id, count(DISTINCT list) AS lists FROM u GROUP BY 1) USING (query_id)
  WHERE exact OR n >= 2 OR coalesce(vec >= 0.55, false) OR coalesce(fts >= 0.18, false) OR coalesce(summ >= 0.2, false) OR coalesce(meta >= 0.2, false)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, id) AS k FROM o) WHERE k <= 3),
s AS (SELECT query_id, document_id, id, round(CASE WHEN count(*) OVER (PARTITION BY query_id) <= 50 THEN 0.30 * coalesce(fts, 0) + 0.25 * coalesce(vec, 0) + 0.05 * coalesce(meta, 0) + 0.05 * coalesce(summ, 0) + 0.10 * exact::INT ELSE score END, 9) AS score FROM m),
d AS (SELECT query_id, document_id, arg_max(id, score * 1e6 - id / 1e9) AS node_id, max(score) AS score, count(*) - 1 AS others FROM s GROUP BY ALL)
SELECT query_id, rank, document_id, node_id, round(score, 6) AS score, others FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM d) WHERE rank <= 10""")
def q47_kb_search(spark, d):
    """The retrievers of each query's kind, fused, gated, re-ranked and grouped by document."""
    q, chunks, _ = search_inputs(spark, d)
    return P.document_search(q, node_inputs(chunks)).select("query_id", "rank", "document_id", "node_id", F.round("score", 6).alias("score"), F.size("group_hits").alias("others"))


ASKED_TEXT = "(['who is ', 'when was ', ''])[query_id % 3 + 1] || text"


@query(f"""WITH {SEARCHED}, a AS (SELECT query_id, text, {ASKED_TEXT} AS asked FROM b),
core AS (SELECT query_id, list_filter(w, lambda t, i: list_position(w, t) = i AND length(t) >= 2) AS core FROM (SELECT query_id, {words('asked')} AS w FROM a)),
{prefix_bm25("pg", "SELECT id, text FROM c", "SELECT query_id, text FROM a", 10)},
ps AS (SELECT id * 1000 + o AS id, id AS document_id, substr(text, (o * 600 + 1)::BIGINT, 720) AS text FROM (SELECT id, text, unnest(range(0, greatest(0, ceil((length(text) - 120) / 600.0)::BIGINT - 1) + 1)) AS o FROM c WHERE length(text) > 0) WHERE length(trim(regexp_replace(substr(text, (o * 600 + 1)::BIGINT, 720), '\\s+', ' ', 'g'))) >= 24),
{prefix_bm25("rl", "SELECT id, text FROM ps", "SELECT query_id, asked AS text FROM a", 80)},
{prefix_bm25("st", "SELECT id, text FROM ps", "", 80, "SELECT query_id, unnest(core[1:5]) AS w FROM core WHERE len(core) >= 2")},
rt AS (SELECT query_id, id, sum(w / (60 + rank)) AS route FROM (SELECT query_id, id, rank, 1.0::DOUBLE AS w FROM rl UNION ALL SELECT query_id, id, rank, 1.6 FROM st) GROUP BY ALL),
cv AS (SELECT query_id, id, document_id, route, core, lower(text) AS low, length(text) AS size, list_filter(core, lambda t: contains(lower(text), t)) AS cov FROM rt JOIN ps USING (id) JOIN core USING (query_id)),
sp AS (SELECT *, list_transform(cov, lambda t: strlen(left(low, strpos(low, t) - 1))) AS pl, len(cov) AS n FROM cv),
ev AS (SELECT query_id, id, document_id, n, len(core) AS total, round(10 * route + coalesce(list_sum(list_transform(cov, lambda t: 2.5 + least(0.8, length(t) * 0.15))), 0) + CASE WHEN len(core) > 0 THEN 4.0 * n / len(core) ELSE 0 END + CASE WHEN n >= 2 THEN 2.5 ELSE 0 END
  + CASE WHEN n = len(core) AND n > 0 THEN 2 ELSE 0 END + CASE WHEN n < 2 THEN 0 WHEN list_max(pl) - list_min(pl) <= 120 THEN 3 WHEN list_max(pl) - list_min(pl) <= 300 THEN 1.5 ELSE 0 END + 1.0 + 1.0 + CASE WHEN size > 2500 THEN -1.5 WHEN size <= 900 THEN 0.8 ELSE 0 END, 9)::DOUBLE AS score FROM sp),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS many FROM ev),
gd AS (SELECT query_id, min(rank) FILTER (rank > 1 AND n >= least(2, total)) AS best, bool_or(rank = 1 AND n >= least(2, total)) AS fine FROM rk GROUP BY 1),
sw AS (SELECT rk.*, CASE WHEN total < 2 OR many < 2 OR fine OR best IS NULL THEN rank WHEN rank = 1 THEN best WHEN rank = best THEN 1 ELSE rank END AS r FROM rk JOIN gd USING (query_id)),
kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY r, id) AS k FROM sw) WHERE k <= 3),
fe AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, id) AS z FROM kp) WHERE z <= 10),
tl AS (SELECT query_id, ref, score FROM (SELECT event_id % 40 AS query_id, event_id::VARCHAR AS ref, value AS score, row_number() OVER (PARTITION BY event_id % 40 ORDER BY value DESC, event_id::VARCHAR) AS k FROM events WHERE value IS NOT NULL) WHERE k <= 5),
al AS (SELECT query_id, id::VARCHAR AS ref, round(score, 6) AS score, 'brain' AS route FROM pg UNION ALL SELECT query_id, id::VARCHAR, round(score, 6), 'evidence' FROM fe UNION ALL SELECT query_id, ref, round(score, 6), 'timeline' FROM tl),
i AS (SELECT query_id, {INTENT_SQL} AS intent FROM (SELECT query_id, asked AS text FROM a)), s AS (SELECT query_id, CASE WHEN intent IN ('temporal', 'event') THEN 'timeline_first' WHEN intent = 'entity' THEN 'brain_first' ELSE 'evidence_first' END AS strategy FROM i)
SELECT query_id, ref, score, route, strategy, row_number() OVER (PARTITION BY query_id ORDER BY (strategy = route || '_first') DESC, score DESC, route, ref) AS rank FROM al JOIN s USING (query_id)""")
def q48_unified_query(spark, d):
    """Pages, evidence and events, in the order that each query's strategy asks for."""
    q, chunks, _ = search_inputs(spark, d)
    asked_ = q.select("query_id", F.concat(F.element_at(F.array(F.lit("who is "), F.lit("when was "), F.lit("")), (F.col("query_id") % 3 + 1).cast("int")), "text").alias("text"))
    k = F.round("score", 6).alias("score")
    pages = P.keyword_list(q, R.token_postings(chunks, "chunk_id", "chunk_text"), 10).select("query_id", F.col("doc_id").cast("string").alias("ref"), k)
    p = C.window_passages(chunks, "chunk_id", "chunk_text").select((F.col("chunk_id") * 1000 + F.col("passage_order")).alias("passage_id"), F.col("chunk_id").alias("document_id"), F.lit("").alias("title"), "content", F.lit("window").alias("view_type"), F.lit(0).alias("level"))
    evidence = P.evidence_search(asked_, p.withColumn("node_id", F.col("passage_id"))).select("query_id", F.col("node_id").cast("string").alias("ref"), k)
    e = table(spark, d, "events").select((F.col("event_id") % 40).alias("query_id"), F.col("event_id").cast("string").alias("ref"), F.col("value").alias("score"))
    events = R.top_k(e.where("score is not null"), 5, tie="ref").select("query_id", "ref", k)
    return P.unified_query(asked_, pages, evidence, events)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x01_stream_windows(spark, d):
    return Z.daily(table(spark, d, "events")).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))

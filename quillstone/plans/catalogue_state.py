"""More of the catalogue: state, rules and scalar functions over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import extraction as E
from quillstone.operators import graph as G
from quillstone.operators import lifecycle as L
from quillstone.operators import retrieval as R
from quillstone.operators import statistics as S
from quillstone.plans.catalogue import QUERIES, query
from quillstone.session import table

__all__ = ["QUERIES"]


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN 'changed' ELSE lang END AS lang FROM documents UNION ALL SELECT doc_id + 1000000000, 'new' FROM documents WHERE doc_id % 10 = 4""")
def q49_upsert(spark: SparkSession, d: str) -> DataFrame:
    """K1, K4: changed rows replace those of their key, new ones are added; of repeated changes the last counts."""
    t = table(spark, d, "documents").select("doc_id", "lang")
    hit = t.where("doc_id % 10 = 4")
    changes = hit.select("doc_id", F.lit("early").alias("lang"), F.lit(1).alias("at")).union(hit.select("doc_id", F.lit("changed"), F.lit(2))).union(hit.select(F.col("doc_id") + 1000000000, F.lit("new"), F.lit(1)))
    return L.upsert(t, changes, ("doc_id",), "at").select("doc_id", "lang")


@query("SELECT DISTINCT o_custkey AS from_slug, o_orderpriority AS to_slug FROM orders")
def q50_insert_ignore(spark, d):
    """K6, K8: rows whose key is there already are left out."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("from_slug"), F.col("o_orderpriority").alias("to_slug"))
    half = rows.where("from_slug % 2 = 0").distinct()
    return L.insert_ignore(half, rows, ("from_slug", "to_slug"))


@query("SELECT user_id % 50 AS scope, count(*) AS kept FROM events WHERE NOT (event_type = 'error' AND ts < TIMESTAMP '2024-01-28') GROUP BY ALL")
def q51_purge_deleted(spark, d):
    """K2, K3: errors are soft-deleted at their time; those deleted over 72 hours before the last day go."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    marked = L.soft_delete(e, F.col("event_type") == "error", F.col("ts"))
    kept, _ = L.purge(marked, F.lit("2024-01-31").cast("timestamp"), 72)
    return kept.groupBy((F.col("user_id") % 50).alias("scope")).agg(F.count("*").alias("kept"))


@query("SELECT doc_id AS page_id FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND quality = 1 ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5")
def q52_list_pages(spark, d):
    """Live pages of a type with a tag, newest first, one page of them."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("lang").alias("page_type"), F.col("n_chars").alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    tagged = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id"))
    return S.list_pages(t, "en", tagged, offset=5, limit=20).select("page_id")


@query("SELECT doc_id AS chunk_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL OR label < doc_id % 10")
def q53_stale_chunks(spark, d):
    """Chunks without a vector, or with one that is older than their page."""
    t = table(spark, d, "documents")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("embedded_at"))
    return S.stale_chunks(t.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("page_id")), e, t.select(F.col("doc_id").alias("page_id"), (F.col("doc_id") % 10).alias("updated_at"))).select("chunk_id")


@query("""SELECT 'unlabelled' AS "check", (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n, CASE WHEN (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0 THEN 'ok' ELSE 'warning' END AS status
UNION ALL SELECT 'labels_without_document', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)), CASE WHEN (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 THEN 'ok' ELSE 'warning' END
UNION ALL SELECT 'orders_without_customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), CASE WHEN (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 THEN 'ok' ELSE 'warning' END""")
def q54_index_health(spark, d):
    """Named anti-joins that should be empty."""
    t, l = table(spark, d, "documents"), table(spark, d, "labels")
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return S.checks(unlabelled=t.join(l, "doc_id", "left_anti"), labels_without_document=l.join(t, "doc_id", "left_anti"), orders_without_customer=o.join(c, o.o_custkey == c.c_custkey, "left_anti"))


@query("""WITH p AS (SELECT DISTINCT user_id AS document_id, (event_id // 40)::BIGINT AS page FROM events),
i AS (SELECT *, page - row_number() OVER (PARTITION BY document_id ORDER BY page) AS island FROM p),
k AS (SELECT *, (row_number() OVER (PARTITION BY document_id, island ORDER BY page) - 1) // 3 AS part FROM i)
SELECT document_id, min(page) AS first_page, max(page) AS last_page FROM k GROUP BY document_id, island, part""")
def q55_ocr_segments(spark, d):
    """Consecutive pages in runs of three at most."""
    p = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.floor(F.col("event_id") / 40).alias("page"))
    return S.ocr_segments(p, 3)


@query("""WITH g AS (SELECT user_id AS document_id, count(*) FILTER (event_type <> 'view') AS total, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)
SELECT document_id, CASE WHEN total = 0 THEN 'not_needed' WHEN done = total THEN 'done' WHEN failed = total THEN 'failed' WHEN done > 0 THEN 'partial' ELSE 'needed' END AS status, round(CASE WHEN total = 0 THEN 1.0 ELSE done / total END, 6)::DOUBLE AS coverage FROM g""")
def q56_ocr_status(spark, d):
    """Roll-up of page states."""
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("waiting")
    p = table(spark, d, "events").select(F.col("user_id").alias("document_id"), (F.col("event_type") != "view").alias("needed"), state.alias("state"))
    return S.ocr_status(p).withColumn("coverage", F.round("coverage", 6))


@query("""SELECT doc_id, sha256(source || chr(10) || source || chr(10) || source || chr(10) || lang || chr(10) || 'Page ' || (doc_id % 7) || chr(10) || text) AS digest FROM documents""")
def q57_embedding_text(spark, d):
    """title three times, path, page, content."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.sha2(X.embedding_text("source", "lang", (F.col("doc_id") % 7).cast("int"), "text"), 256).alias("digest"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'table' WHEN length(text) > 30000 OR doc_id % 4 = 1 THEN 'large' WHEN length(text) > 3000 THEN 'medium' WHEN length(text) > 800 THEN 'small' ELSE 'micro' END AS granularity,
  CASE doc_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'text' WHEN 2 THEN 'image' ELSE 'code' END AS modality, CASE doc_id % 4 WHEN 0 THEN 'kb' WHEN 1 THEN 'page' WHEN 2 THEN 'kb' ELSE 'kb' END AS route,
  CASE doc_id % 4 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'image/png' ELSE 'application/octet-stream' END AS media FROM documents""")
def q58_routing(spark, d):
    """Rules by extension and size."""
    k = F.col("doc_id") % 4
    ext = F.when(k == 0, "CSV").when(k == 1, "md").when(k == 2, "png").otherwise("rs")
    t = table(spark, d, "documents").withColumn("ext", ext)
    return t.select("doc_id", S.granularity(F.col("ext"), F.length("text"), F.when(k == 1, 31).otherwise(1)).alias("granularity"), S.modality(F.col("ext")).alias("modality"), S.route(F.col("ext"), F.lit("auto")).alias("route"), X.media_type("ext").alias("media"))


@query("SELECT event_id, CASE WHEN value IS NOT NULL THEN least(5, greatest(0, floor(value / 20)::BIGINT - 1)) END AS rating FROM events")
def q59_feedback(spark, d):
    """Ratings held within 0 and 5."""
    e = table(spark, d, "events")
    return L.feedback(e.select("event_id", (F.floor(F.col("value") / 20) - 1).alias("rating")))


@query("SELECT event_type AS operation, left(sha256(user_id % 9 || ''), 12) AS pattern, count(*) AS n, min(user_id % 9 || '') AS example FROM events GROUP BY ALL")
def q60_failure_patterns(spark, d):
    """Errors by their hash."""
    e = table(spark, d, "events").select(F.col("event_type").alias("operation"), (F.col("user_id") % 9).cast("string").alias("error"))
    return L.failure_patterns(e)


@query("SELECT c_custkey AS artifact_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open_orders FROM customer")
def q61_delete_impact(spark, d):
    """What hangs on each artifact."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "artifact_id")
    return L.delete_impact(table(spark, d, "customer").select(F.col("c_custkey").alias("artifact_id")), orders=o, open_orders=o.where("o_orderstatus = 'O'"))


@query("SELECT vec_id AS artifact_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') AND date_diff('day', DATE '2024-01-01' + (vec_id % 60)::INT, DATE '2024-03-01') > 30")
def q62_orphan_projections(spark, d):
    """Projections of no artifact, over thirty days old."""
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("artifact_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 60).cast("int")).alias("updated_at"))
    a = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("artifact_id"))
    return L.orphan_projections(p, a, F.lit("2024-03-01").cast("date"), 30).select("artifact_id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'created' WHEN doc_id % 3 = 0 THEN 'unchanged' WHEN doc_id % 2 = 0 AND doc_id % 7 <> 0 THEN 'conflict' ELSE 'updated' END AS resolution FROM documents")
def q63_put_resolution(spark, d):
    """What a put does to a page."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", L.put_resolution(k % 5 != 0, k % 3 == 0, k % 2 == 0, k % 7 == 0).alias("resolution"))


@query("""WITH c AS (SELECT user_id % 20 AS slug, event_id % 97 AS page FROM events WHERE event_type <> 'view' UNION ALL SELECT user_id % 20, event_id % 89 FROM events WHERE event_type = 'view')
SELECT slug, count(DISTINCT page) AS n, CASE WHEN count(DISTINCT page) >= 8 THEN 1 WHEN count(DISTINCT page) >= 3 THEN 2 ELSE 3 END AS tier FROM c WHERE slug <> page GROUP BY slug""")
def q64_mentions_and_tier(spark, d):
    """Distinct pages that link to or name a page, and its tier."""
    e = table(spark, d, "events")
    a = e.where("event_type <> 'view'").select((F.col("user_id") % 20).alias("slug"), (F.col("event_id") % 97).alias("page"))
    b = e.where("event_type = 'view'").select((F.col("user_id") % 20).alias("slug"), (F.col("event_id") % 89).alias("page"))
    return S.mentions(a, b).withColumn("tier", E.tier(F.col("n"), F.lit(2), F.lit("person")))


@query("SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS root, 1 AS depth FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def q65_container_tree(spark, d):
    """All that lies within each root container."""
    n, r, s = (table(spark, d, x) for x in ("nation", "region", "supplier"))
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    tree = n.select(named("n", "n_nationkey").alias("id"), named("r", "n_regionkey").alias("parent_id")).union(s.select(named("s", "s_suppkey"), named("n", "s_nationkey"))).union(r.select(named("r", "r_regionkey"), F.lit(None).cast("string")))
    return G.descendants(tree, tree.where("parent_id is null")).select("id", "root", "depth")


@query("SELECT query_id, slug, max(confidence) AS confidence, arg_max(resolver, confidence * 10 + ascii(resolver) / 1000.0) AS resolver FROM (SELECT user_id AS query_id, event_type AS slug, (event_id % 100) / 100.0::DOUBLE AS confidence, CASE WHEN event_id % 2 = 0 THEN 'exact' ELSE 'fuzzy' END AS resolver FROM events) GROUP BY ALL")
def q66_best_resolution(spark, d):
    """Of all resolvers' answers the surest."""
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("slug"), ((F.col("event_id") % 100) / 100.0).alias("confidence"), F.when(F.col("event_id") % 2 == 0, "exact").otherwise("fuzzy").alias("resolver"))
    return S.best_resolution(e)


@query("""WITH t AS (SELECT doc_id, lang AS query_id, CASE doc_id % 3 WHEN 0 THEN 1.3 WHEN 1 THEN 1.6 ELSE 0.8 END AS w, row_number() OVER (PARTITION BY lang, doc_id % 3 ORDER BY n_chars DESC, doc_id) AS r FROM documents)
SELECT query_id, doc_id % 40 AS node_id, round(sum(w / (60 + r)), 9)::DOUBLE AS score FROM t GROUP BY ALL""")
def q67_evidence_routes(spark, d):
    """Weighted routes summed per node."""
    k = F.col("doc_id") % 3
    t = table(spark, d, "documents").select("doc_id", F.col("lang").alias("query_id"), k.alias("k"), F.col("n_chars").cast("double").alias("score"), F.col("text").alias("content"), F.when(k == 0, 1.3).when(k == 1, 1.6).otherwise(0.8).alias("weight"))
    ranked = R.top_k(t, 1 << 30, keys=("query_id", "k")).select("query_id", (F.col("doc_id") % 40).alias("node_id"), "rank", "weight", "content")
    return R.merge_routes(ranked).select("query_id", "node_id", F.round("score", 9).alias("score"))


@query("SELECT s_suppkey, regexp_matches(lower(replace(s_name, '#', '-')), '^[a-z0-9][a-z0-9_-]*(/[a-z0-9][a-z0-9_-]*)*$') AS valid, regexp_matches(s_name, '^[a-z0-9][a-z0-9_-]*(/[a-z0-9][a-z0-9_-]*)*$') AS raw_valid, regexp_replace(lower(trim(s_name)), '[ _]+', '-', 'g') AS slug FROM supplier")
def q68_slug_rules(spark, d):
    """Slug form."""
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", S.valid_slug(F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-")))).alias("valid"), S.valid_slug(F.col("s_name")).alias("raw_valid"), X.slugify_for_match("s_name").alias("slug"))


@query("SELECT event_id, least(100 * pow(2, event_id % 8), 5000)::BIGINT AS delay_ms, CASE WHEN date_diff('day', ts::DATE, DATE '2024-07-01') < 90 THEN 1.0 WHEN date_diff('day', ts::DATE, DATE '2024-07-01') < 180 THEN 0.7 ELSE 0.4 END::DOUBLE AS recency FROM events")
def q69_backoff_and_recency(spark, d):
    """delays and recency buckets."""
    return table(spark, d, "events").select("event_id", X.backoff_ms(F.col("event_id") % 8 + 1, 100, 5000).alias("delay_ms"), X.recency(F.col("ts").cast("date"), F.lit("2024-07-01").cast("date")).alias("recency"))

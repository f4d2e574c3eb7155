"""More of the catalogue: artifacts, versions, graph and retrieval helpers, sources, hooks, with their SQL."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillstone.functions import text as X
from quillstone.operators import chunking as C
from quillstone.operators import clustering as K
from quillstone.operators import evaluation as V
from quillstone.operators import facade as A
from quillstone.operators import fields as FS
from quillstone.operators import graph as G
from quillstone.operators import lifecycle as L
from quillstone.operators import retrieval as R
from quillstone.operators import statistics as S
from quillstone.operators import vectors as VX
from quillstone.operators import words as WD
from quillstone.plans import search as P
from quillstone.plans.catalogue import BOOST_SQL, DIR_SQL, EDGES, PLAN_SQL, QUERIES, TYPE_SQL, WEAK, edges, held, nearest, prefix_bm25, query, slugged, words
from quillstone.session import checkpoint_folder, dealt, table
from quillstone.sources import readers as I
from quillstone.streaming import events as Z
from quillstone.streaming import ledger as LG

__all__ = ["QUERIES"]


def say(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Artifacts, documents and projections stand on customers and parts.
ART_SQL = "art AS (SELECT c_custkey AS artifact_id, 'u' || c_custkey AS artifact_uid, 'documents/' || c_custkey AS slug, c_mktsegment AS name, CASE WHEN c_custkey % 7 = 0 THEN 'deleted' ELSE 'active' END AS status FROM customer)"
DOC_SQL = "doc AS (SELECT p_partkey AS document_id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS title, p_name || '.md' AS name, p_size AS folder_id, p_partkey % 11 = 0 AS gone FROM part)"
PRO_SQL = "pro AS (SELECT c_custkey AS artifact_id, c_custkey * 2 AS document_id, c_custkey % 3 <> 0 AS active FROM customer UNION ALL SELECT c_custkey, c_custkey * 2 + 1, true FROM customer)"
JOINED_SQL = f"{ART_SQL}, {DOC_SQL}, {PRO_SQL}, pd AS (SELECT artifact_id, document_id, title, name FROM pro JOIN doc USING (document_id) WHERE active AND NOT gone)"


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("artifact_id"), say("u", k).alias("artifact_uid"), say("documents/", k).alias("slug"), F.col("c_mktsegment").alias("name"), F.sha2(say(k % 40), 256).alias("sha256"), F.when(k % 7 == 0, "deleted").otherwise("active").alias("status"))


def kb_documents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("document_id"), F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("title"), say(F.col("p_name"), ".md").alias("name"), F.col("p_size").alias("folder_id"), F.when(k % 11 == 0, F.current_timestamp()).alias("deleted_at"))


def projections(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    one = c.select(k.alias("artifact_id"), say("kb_document:", k * 2).alias("projection_ref"), F.when(k % 3 != 0, "active").otherwise("stale").alias("status"))
    return one.union(c.select(k, say("kb_document:", k * 2 + 1), F.lit("active"))).withColumn("stale_reason", F.lit(None).cast("string"))


@query(f"WITH {JOINED_SQL} SELECT artifact_id, document_id, title, name FROM pd")
def q95_projected_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of active projections, by the key in their reference."""
    return A.projected_documents(projections(spark, d), kb_documents(spark, d))


@query(f"WITH {JOINED_SQL}, o AS (SELECT document_id, min(artifact_id) AS artifact_id FROM pro WHERE active GROUP BY 1) SELECT document_id, artifact_uid, slug FROM doc LEFT JOIN o USING (document_id) LEFT JOIN art USING (artifact_id)")
def q96_enriched_hits(spark, d):
    """The artifact behind each document."""
    return A.enriched(kb_documents(spark, d).select("document_id"), projections(spark, d), artifacts(spark, d)).select("document_id", "artifact_uid", "slug")


@query("SELECT document_id, node_id FROM (SELECT doc_id % 200 AS document_id, doc_id AS node_id, row_number() OVER (PARTITION BY doc_id % 200 ORDER BY n_chars, doc_id) AS n FROM documents) WHERE n = 1")
def q97_first_nodes(spark, d):
    """The first node of each document."""
    return A.first_node(table(spark, d, "documents").select((F.col("doc_id") % 200).alias("document_id"), F.col("doc_id").alias("node_id"), F.col("n_chars").alias("chunk_order")))


ASKS = ("small ring", "what is the blue bolt building", "a red machinery gear")
ASK_SQL = f"ask AS (SELECT s_suppkey AS query_id, {list(ASKS)}[s_suppkey % 3 + 1] AS text FROM supplier), core AS (SELECT query_id, list_distinct(list_filter({words('text')}, lambda t: length(t) >= 2 AND t NOT IN ({WEAK}))) AS core FROM ask)"


def asks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.element_at(F.array(*map(F.lit, ASKS)), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("text"))


@query(f"""WITH {JOINED_SQL}, {ASK_SQL}, t AS (SELECT DISTINCT artifact_uid, slug || ' ' || a.name || coalesce(' ' || p.title || ' ' || p.name, '') AS t, CASE WHEN trim(p.title) <> '' THEN p.title WHEN trim(p.name) <> '' THEN p.name ELSE a.name END AS title FROM art a LEFT JOIN pd p USING (artifact_id) WHERE status = 'active'),
s AS (SELECT query_id, artifact_uid, title, len(core) AS n, len(list_filter(core, lambda c: contains(lower(t), c))) AS c FROM core, t),
g AS (SELECT query_id, artifact_uid, title, max(round(c / n, 9)) AS score FROM s WHERE c >= CASE WHEN n >= 3 THEN 2 ELSE 1 END GROUP BY ALL)
SELECT query_id, artifact_uid, title, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_uid, title) AS rank FROM g) WHERE rank <= 5""")
def q98_title_candidates(spark, d):
    """Artifacts whose names hold enough of a query's core terms."""
    return A.title_candidates(asks(spark, d), artifacts(spark, d), projections(spark, d), kb_documents(spark, d)).select("query_id", "artifact_uid", "title", "score")


#: Whole words, parts of words, one and two characters, marks that patterns of SQL give a meaning.
TIMELINE_ASKS = [(1, "click of"), (2, "Purchase of 5"), (3, "supplier#"), (4, "none such"), (5, "lick"), (6, "urchase of 12"), (7, "f"), (8, "R#"), (9, " OF "), (10, "  "), (11, '"summary":"sig'), (12, "%"), (13, "_date")]


@query("""WITH c AS (SELECT event_id, event_type || ' of ' || user_id AS summary, ts::DATE::VARCHAR AS day, ts, s_name, s_suppkey % 2 = 0 AS titled FROM events LEFT JOIN supplier ON s_suppkey = user_id WHERE event_id % 4 <> 0),
q AS (SELECT query_id, trim(q) AS q FROM (VALUES (1, 'click of'), (2, 'Purchase of 5'), (3, 'supplier#'), (4, 'none such'), (5, 'lick'), (6, 'urchase of 12'), (7, 'f'), (8, 'R#'), (9, ' OF '), (10, '  '), (11, '"summary":"sig'), (12, '%'), (13, '_date')) AS v(query_id, q) WHERE trim(q) <> ''),
h AS (SELECT query_id, event_id AS candidate_id, day AS "date", summary, CASE WHEN titled THEN 'T ' || s_name ELSE s_name END AS source, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, event_id) AS rank FROM c, q
  WHERE contains(lower('{"event_date":"' || day || '","summary":"' || summary || '"}'), lower(q)) OR coalesce(contains(lower(s_name), lower(q)), false) OR coalesce(titled AND contains('t ' || lower(s_name), lower(q)), false))
SELECT query_id, rank, candidate_id, "date", summary, source FROM h WHERE rank <= 20""")
def q99_timeline_hits(spark, d):
    """Accepted events that hold the query in payload, name or title."""
    e = table(spark, d, "events")
    payload = say('{"event_date":"', F.col("ts").cast("date"), '","summary":"', F.col("event_type"), " of ", F.col("user_id"), '"}')
    c = e.select(F.col("event_id").alias("candidate_id"), payload.alias("payload"), F.col("ts").alias("created_at"), F.col("user_id").alias("document_id"), F.lit("timeline_event").alias("candidate_type"), F.when(F.col("event_id") % 4 == 0, "pending").otherwise("accepted").alias("status"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("document_id"), F.when(F.col("s_suppkey") % 2 == 0, say("T ", F.col("s_name"))).alias("title"), F.col("s_name").alias("name"))
    q = spark.createDataFrame(TIMELINE_ASKS, "query_id int, text string")
    return A.timeline_hits(q, c, s)


@query(f"""WITH {JOINED_SQL}, n AS (SELECT artifact_id, count(*) FILTER (active) AS projections FROM pro GROUP BY 1), f AS (SELECT artifact_id, min(document_id) AS document_id FROM pd GROUP BY 1)
SELECT artifact_id AS query_id, artifact_id, slug, projections, document_id, CASE WHEN document_id IS NULL THEN NULL ELSE 'about ring ' || p_name || ' ' || p_partkey END AS content FROM art JOIN n USING (artifact_id) LEFT JOIN f USING (artifact_id) LEFT JOIN part ON p_partkey = document_id WHERE status = 'active'""")
def q100_artifact_detail(spark, d):
    """Artifacts by id, uid or slug, with the node of theirs that answers best."""
    a = artifacts(spark, d)
    k = F.col("artifact_id")
    wanted = a.select(k.alias("query_id"), F.when(k % 3 == 0, say(k)).when(k % 3 == 1, F.col("artifact_uid")).otherwise(F.col("slug")).alias("key"), F.lit("ring").alias("query"))
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("document_id"), F.col("p_partkey").alias("node_id"), F.lit(2).alias("chunk_order"), say("about ring ", F.col("p_name"), " ", F.col("p_partkey")).alias("content"))
    nodes = nodes.union(p.select("p_partkey", F.col("p_partkey") + 10**9, F.lit(1), F.lit("first but off the point")))
    return A.artifact_detail(a, projections(spark, d), kb_documents(spark, d), nodes, wanted)


@query("SELECT event_id AS provenance_id, user_id AS artifact_id FROM events WHERE event_type <> 'error' AND event_type = 'click'")
def q101_provenance(spark, d):
    """Active records of one field."""
    r = table(spark, d, "events").select(F.col("event_id").alias("provenance_id"), say("p/", F.col("user_id")).alias("slug"), F.col("event_type").alias("field"), F.col("user_id").alias("artifact_id"), F.col("event_id").alias("document_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", "stale").otherwise("active").alias("status"))
    return A.provenance(r, field="click").select("provenance_id", "artifact_id")


@query("SELECT n_name AS slug, CASE WHEN n_nationkey % 2 = 0 THEN 'old ' || n_nationkey ELSE 'new' END AS title, 'note' AS page_type, CASE WHEN n_nationkey % 2 = 0 THEN 'b1' ELSE 'b2' END AS body FROM nation")
def q102_page_versions(spark, d):
    """K9: a snapshot, a change, and half of the pages put back; versions that are not there change nothing."""
    n = table(spark, d, "nation")
    old = n.select(F.col("n_name").alias("slug"), say("old ", F.col("n_nationkey")).alias("title"), F.lit("note").alias("page_type"), F.lit("b1").alias("body"))
    none = spark.createDataFrame([], "slug string, title string, page_type string, body string, version_id long, snapshot_at timestamp")
    v = A.snapshot(old, none, F.lit("2024-01-01").cast("timestamp"))
    now = old.withColumn("title", F.lit("new")).withColumn("body", F.lit("b2"))
    v = A.snapshot(now, v, F.lit("2024-01-02").cast("timestamp"))
    wanted = n.select(F.col("n_name").alias("slug"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(9).cast("long").alias("version_id"))
    return A.revert(now, v, wanted)


@query("SELECT user_id % 5 AS library_id, event_type AS call_type, 'm' || event_id % 2 AS model, count(*) AS calls, count(*) FILTER (value IS NULL) AS failed, sum(event_id % 100 + 7)::BIGINT AS tokens FROM events GROUP BY ALL")
def q103_call_audit(spark, d):
    """External calls by library, kind and model."""
    e = table(spark, d, "events")
    return A.audited(e.select((F.col("user_id") % 5).alias("library_id"), F.col("event_type").alias("call_type"), say("m", F.col("event_id") % 2).alias("model"), F.col("value").isNotNull().alias("success"), (F.col("event_id") % 100).alias("input_tokens"), F.lit(7).alias("output_tokens")))


@query(f"""WITH {ART_SQL}, k AS (SELECT sha256((artifact_id % 40)::VARCHAR) AS h, min(artifact_id) AS artifact_id FROM art WHERE status = 'active' GROUP BY 1)
SELECT p_partkey, CASE WHEN k.h IS NULL THEN -1 ELSE k.artifact_id END AS known, k.h IS NULL AS created, CASE WHEN p_partkey % 2 = 0 THEN 'page' ELSE 'kb' END AS route FROM part LEFT JOIN k ON k.h = sha256((p_partkey % 60)::VARCHAR)""")
def q104_upload(spark, d):
    """Known contents are found again by their hash, and each upload has its route."""
    k = F.col("p_partkey")
    files = table(spark, d, "part").select(say(k).alias("name"), F.when(k % 2 == 0, "md").otherwise("pdf").alias("ext"), F.lit("auto").alias("intent"), F.sha2(say(k % 60), 256).alias("sha256"))
    out = A.upload(files, artifacts(spark, d))
    return out.select(F.col("name").cast("long").alias("p_partkey"), F.when(F.col("created"), -1).otherwise(F.col("artifact_id")).alias("known"), "created", "route")


@query(f"""WITH {ART_SQL}, {PRO_SQL}, due AS (SELECT artifact_id FROM art WHERE status = 'active' AND artifact_id % 4 = 0)
SELECT artifact_id, CASE WHEN active AND artifact_id IN (SELECT artifact_id FROM due) OR NOT active THEN 'stale' ELSE 'active' END AS status, coalesce(CASE WHEN active AND artifact_id IN (SELECT artifact_id FROM due) THEN 'reprocess' END, '') AS reason, count(*) AS n FROM pro GROUP BY ALL
UNION ALL SELECT artifact_id, 'pending', 'job', 1 FROM due""")
def q105_reprocess(spark, d):
    """Projections grow stale and jobs are due, for active artifacts alone."""
    a = artifacts(spark, d)
    p, jobs = A.reprocess(a, projections(spark, d), a.where("artifact_id % 4 = 0").select("artifact_id"))
    p = p.groupBy("artifact_id", "status", F.coalesce("stale_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))
    return p.union(jobs.select("artifact_id", "status", F.lit("job"), F.lit(1).cast("long")))


@query("SELECT o_custkey AS document_id, count(*) AS n, string_agg('m' || o_orderkey, ',' ORDER BY o_orderkey) AS assets FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def q106_media_of_documents(spark, d):
    """Media references of each document, in the order of its nodes."""
    meta = F.when(F.col("o_orderstatus") != "F", say('{"media_refs":[{"asset_id":"m', F.col("o_orderkey"), '","kind":"image"}]}')).otherwise("{}")
    m = A.media_of(table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("node_id"), meta.alias("metadata")))
    return m.select("document_id", F.size("refs").cast("long").alias("n"), F.array_join(F.transform("refs", lambda r: r["asset_id"]), ",").alias("assets"))


@query(f"""WITH {DOC_SQL} SELECT 'folder' AS kind, document_id FROM doc WHERE folder_id = 7 UNION ALL SELECT 'chosen', p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_partkey % 3 = 0 AND p_name <> 'red widget'
UNION ALL SELECT 'ids', p_partkey FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'listed', * FROM (SELECT document_id FROM doc WHERE NOT gone AND folder_id = 9 ORDER BY document_id DESC LIMIT 10 OFFSET 2)""")
def q107_filters(spark, d):
    """Folders, exact slugs, kinds, ids, and one page of a library's documents."""
    docs, p = kb_documents(spark, d), table(spark, d, "part")
    rows = p.select("p_partkey", F.col("p_name").alias("slug"), F.col("p_type").alias("page_type"), F.lit("en").alias("language"), F.when(F.col("p_partkey") % 3 == 0, "compiled_truth").otherwise("timeline").alias("source"))
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"))
    some = docs.where("folder_id = 9").select(F.col("document_id").alias("page_id"), F.col("document_id").alias("updated_at"), "deleted_at")
    tag = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("document_id"))
    out = tag(A.in_folder(docs, docs, F.lit(7)), "folder", "document_id").union(tag(rows.where(A.chosen(hidden=("red widget",), page_type="ECONOMY", language="en", low_detail=True)), "chosen", "p_partkey"))
    return out.union(tag(S.in_ids(p, "p_partkey", ids), "ids", "p_partkey")).union(tag(S.list_pages(some, offset=2, limit=A.limit_of(-1)), "listed", "page_id"))


CODE_SQL = "SELECT p_partkey AS id, 'fn ' || p_name || ' ' || p_brand AS text FROM part WHERE (p_partkey % 2 = 0 OR p_partkey % 5 = 0) AND p_size > 10"


@query(f"""WITH {ASK_SQL}, {prefix_bm25("k", CODE_SQL, "SELECT query_id, text FROM ask", 20)},
b AS (SELECT query_id, id, round(score * CASE WHEN id % 3 = 0 THEN 1.3 ELSE 1.0 END, 9) AS score FROM k)
SELECT query_id, rank, id AS chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b)""")
def q108_code_search(spark, d):
    """Code pages and fenced code alone."""
    k = F.col("p_partkey")
    chunks = table(spark, d, "part").select(k.alias("chunk_id"), F.when(k % 3 == 0, say("concepts/", k)).otherwise(say("x/", k)).alias("slug"), F.when(k % 2 == 0, "code").otherwise("note").alias("page_type"), F.when(k % 5 == 0, "fenced_code").otherwise("timeline").alias("source"), say("fn ", F.col("p_name"), " ", F.col("p_brand")).alias("chunk_text"), "p_size")
    return A.code_search(asks(spark, d), chunks, F.col("p_size") > 10).withColumn("score", F.round("score", 6))


@query("""WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS node_id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderstatus <> 'F' AS ok, count(*) OVER (PARTITION BY o_custkey) AS many FROM orders),
s AS (SELECT query_id, min(rank) FILTER (ok AND rank > 1) AS best, bool_or(ok AND rank = 1) AS first_ok FROM h GROUP BY 1)
SELECT query_id, node_id, CASE WHEN many < 2 OR first_ok OR best IS NULL THEN rank WHEN rank = 1 THEN best WHEN rank = best THEN 1 ELSE rank END AS rank FROM h JOIN s USING (query_id)""")
def q109_quality_guard(spark, d):
    """A first hit that covers too little changes places with the best one that covers enough."""
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderstatus") == "F", "an alpha").otherwise("alpha BETA").alias("content"))
    h = R.top_k(h, 1 << 30).select("query_id", F.col("doc_id").alias("node_id"), "rank", "score", "content", F.lit("t").alias("title"), F.array(F.lit("alpha"), F.lit("beta")).alias("core"))
    return A.guarded(h).select("query_id", "node_id", "rank")


@query("""WITH a AS (SELECT user_id AS query_id, event_id % 50 AS node_id, round(max(coalesce(value, 0)), 6) AS score FROM events WHERE event_type <> 'view' GROUP BY ALL), b AS (SELECT user_id AS query_id, event_id % 50 AS node_id, round(max(coalesce(value, 0)) + 1, 6) AS score FROM events WHERE event_type = 'view' GROUP BY ALL),
u AS (SELECT query_id, node_id, score FROM a UNION ALL SELECT query_id, node_id, score FROM b WHERE (query_id, node_id) NOT IN (SELECT (query_id, node_id) FROM a)),
m AS (SELECT 'union' AS kind, query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM u),
s AS (SELECT query_id FROM a GROUP BY 1 HAVING count(*) >= 10), t AS (SELECT query_id, node_id, score FROM a UNION ALL SELECT query_id, node_id, score FROM b WHERE query_id NOT IN (SELECT query_id FROM s) AND (query_id, node_id) NOT IN (SELECT (query_id, node_id) FROM a)),
n AS (SELECT 'topped up' AS kind, query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM t)
SELECT * FROM m WHERE rank <= 10 UNION ALL SELECT * FROM n WHERE rank <= 10""")
def q110_index_lists(spark, d):
    """Lists of several indexes as one, and short lists topped up from a fallback."""
    e = table(spark, d, "events").fillna(0.0, ["value"])
    hits = lambda seen, more: e.where((F.col("event_type") == "view") == seen).groupBy(F.col("user_id").alias("query_id"), (F.col("event_id") % 50).alias("node_id")).agg(F.round(F.max("value") + more, 6).alias("score"))
    a, b = hits(False, 0), hits(True, 1)
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "query_id", "node_id", "score", "rank")
    return tag(A.unioned_indexes(a, b), "union").union(tag(A.supplemented(a, b), "topped up"))


@query("""WITH w AS (SELECT DISTINCT o_custkey AS page_id, o_orderpriority AS tag FROM orders WHERE o_orderkey % 3 <> 0), h AS (SELECT DISTINCT o_custkey AS page_id, o_orderpriority AS tag FROM orders WHERE o_orderkey % 2 = 0)
SELECT page_id, tag, 'add' AS action FROM w EXCEPT SELECT page_id, tag, 'add' FROM h UNION ALL (SELECT page_id, tag, 'remove' FROM h WHERE page_id IN (SELECT page_id FROM w) EXCEPT SELECT page_id, tag, 'remove' FROM w)
UNION ALL (SELECT page_id, tag, 'link' FROM w EXCEPT SELECT page_id, tag, 'link' FROM h) UNION ALL SELECT page_id, tag, 'kept' FROM h WHERE page_id NOT IN (SELECT page_id FROM w) OR (page_id, tag) IN (SELECT (page_id, tag) FROM w)""")
def q111_reconcile(spark, d):
    """Tags to add and remove, links that contents name and the table lacks, and keys that stay."""
    o = table(spark, d, "orders")
    key = [F.col("o_custkey").alias("page_id"), F.col("o_orderpriority").alias("tag")]
    w, h = o.where("o_orderkey % 3 <> 0").select(*key).distinct(), o.where("o_orderkey % 2 = 0").select(*key).distinct()
    links = lambda df: df.select(F.col("page_id").alias("from_slug"), F.col("tag").alias("to_slug"))
    lacks = A.missing_links(links(w), links(h)).select("from_slug", "to_slug", F.lit("link"))
    kept = L.drop_stale(h, w, ("page_id", "tag"), ("page_id",)).select("page_id", "tag", F.lit("kept"))
    return A.reconciled_tags(w, h).select("page_id", "tag", "action").union(lacks).union(kept)


@query("""WITH v AS (SELECT user_id AS doc_id, 'h' || event_id % 3 AS content_hash, event_id AS version_id, CASE WHEN event_type = 'view' THEN 'retired' ELSE 'ready' END AS status FROM events),
r AS (SELECT DISTINCT user_id AS doc_id, 'h' || user_id % 4 AS content_hash FROM events), f AS (SELECT doc_id, content_hash, max(version_id) AS found FROM v WHERE status = 'ready' GROUP BY ALL), l AS (SELECT doc_id, max(version_id) AS last FROM v GROUP BY 1)
SELECT 'begin' AS kind, r.doc_id, coalesce(found, last + 1) AS version_id, found IS NOT NULL AS flag FROM r LEFT JOIN f USING (doc_id, content_hash) LEFT JOIN l USING (doc_id)
UNION ALL SELECT 'cleanup', doc_id, version_id, true FROM v WHERE status = 'retired' AND version_id % 10 <> 0
UNION ALL SELECT 'active', user_id, event_id, true FROM events WHERE user_id % 6 <> 0 AND user_id % 5 <> 0 AND event_id = user_id * 10
UNION ALL SELECT 'follows', event_id, event_id % 7, (event_id % 7, event_type) IN ((1, 'click'), (3, 'click'), (4, 'click')) FROM events""")
def q112_document_versions(spark, d):
    """Versions begun or used again, cleaned, active nodes, and allowed changes of state."""
    e = table(spark, d, "events")
    v = e.select(F.col("user_id").alias("doc_id"), say("h", F.col("event_id") % 3).alias("content_hash"), F.col("event_id").alias("version_id"), F.when(F.col("event_type") == "view", "retired").otherwise("ready").alias("status"))
    r = e.select(F.col("user_id").alias("doc_id"), say("h", F.col("user_id") % 4).alias("content_hash")).distinct()
    begin = L.begin_versions(r, v).select(F.lit("begin").alias("kind"), "doc_id", "version_id", F.col("reused").alias("flag"))
    clean = L.retired_for_cleanup(v, e.where("event_id % 10 = 0").select(F.col("event_id").alias("version_id"))).select(F.lit("cleanup"), "doc_id", "version_id", F.lit(True))
    docs = e.select(F.col("user_id").alias("document_id")).distinct().select("document_id", F.when(F.col("document_id") % 6 == 0, F.lit("2024-01-01")).alias("deleted_at"), F.when(F.col("document_id") % 5 == 0, "building").otherwise("ready").alias("index_status"), (F.col("document_id") * 10).alias("current_version_id"))
    nodes = S.active_nodes(e.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("version_id")), docs).select(F.lit("active"), "document_id", "version_id", F.lit(True))
    now = F.element_at(F.array(*map(F.lit, ("uploaded", "queued", "processing", "partial", "ready", "failed", "deleted"))), (F.col("event_id") % 7 + 1).cast("int"))
    to = F.when(F.col("event_type") == "click", "processing").otherwise("uploaded")
    moves = e.select(F.lit("follows"), "event_id", F.col("event_id") % 7, L.may_follow(now, to))
    return begin.union(clean).union(nodes).union(moves)


@query("""SELECT 'n' || s_suppkey AS ref, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'active' ELSE 'stale' END AS status, coalesce(CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'delete' ELSE 'rebuild' END, '') AS reason FROM supplier
UNION ALL SELECT CASE WHEN s_nationkey = 3 THEN 'new' ELSE 'a' || s_nationkey END, 'link', CASE WHEN s_nationkey = 4 THEN 'new' ELSE 'a' || (s_nationkey - 1) END FROM supplier""")
def q113_restore_and_rename(spark, d):
    """Only what a delete made stale comes back; links follow a renamed page."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    p = s.select(k.alias("artifact_id"), say("n", k).alias("ref"), F.lit("stale").alias("status"), F.when(k % 3 == 0, "delete").otherwise("rebuild").alias("stale_reason"))
    back = L.restore_staled(p, s.where(k % 2 == 0).select(k.alias("artifact_id")), "delete").select("ref", "status", F.coalesce("stale_reason", F.lit("")).alias("reason"))
    links = s.select(say("a", F.col("s_nationkey")).alias("from_slug"), say("a", F.col("s_nationkey") - 1).alias("to_slug"))
    return back.union(L.rename_slug(links, "a3", "new").select("from_slug", F.lit("link"), "to_slug"))


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'nodes', count(*) FROM supplier WHERE s_nationkey <> 5 OR s_suppkey % 2 = 0")
def q114_backup_and_nodes(spark, d):
    """Tables written with a manifest and read back; nodes by library, of which one partition is written again."""
    folder = scratch(spark, "backup")
    back = L.read_backup(spark, L.backup({"nation": table(spark, d, "nation"), "region": table(spark, d, "region")}, folder))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("library_id"), F.lit(1).alias("version_id"), F.col("s_suppkey").alias("node_id"))
    A.persist_nodes(s, f"{folder}/nodes")
    A.persist_nodes(s.where("library_id = 5 and node_id % 2 = 0"), f"{folder}/nodes")
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in (*back.items(), ("nodes", spark.read.parquet(f"{folder}/nodes")))]
    return counts[0].union(counts[1]).union(counts[2])


@query("""WITH h AS (SELECT conv_id, turn, text, lag(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS n FROM conversations)
SELECT conv_id, turn, 0 AS variant, CASE WHEN n > 0 THEN sha256(p || ' ' || text) ELSE sha256(text) END AS digest FROM h UNION ALL SELECT conv_id, turn, 1, sha256('alt ' || turn) FROM conversations""")
def q115_rewrite_and_expand(spark, d):
    """Hooks get a turn with its history, or a query, and what they give back is cleaned."""
    c = table(spark, d, "conversations")
    last = lambda t: t.select("conv_id", "turn", F.when(F.size("history") > 0, F.concat_ws(" ", F.element_at("history", -1), "text")).alias("query"))
    said = A.rewritten(c, last).select("conv_id", "turn", F.lit(0).alias("variant"), F.sha2("query", 256).alias("digest"))
    q = c.select(F.struct("conv_id", "turn").alias("query_id"), "text")
    offer = lambda t: t.select("query_id", F.array(say("alt ", F.col("query_id.turn")), F.lit(" "), say("ALT ", F.col("query_id.turn"))).alias("alternatives"))
    more = A.expanded(q, offer).where("variant > 0").select("query_id.conv_id", "query_id.turn", "variant", F.sha2("text", 256))
    return said.union(more)


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'none' WHEN event_id % 5 = 0 THEN 'low' WHEN event_id % 3 >= least(2, event_id % 6) AND event_id % 6 > 0 AND event_id % 2 = 1 THEN 'high' ELSE 'medium' END AS confidence,
  'kb://document/' || user_id || CASE WHEN event_id % 2 = 0 THEN '#page=' || event_id ELSE '' END AS target, 's' || user_id || ':' || CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_id::VARCHAR END AS "key" FROM events""")
def q116_labels_and_targets(spark, d):
    """Confidence, targets to open, keys of results."""
    k = F.col("event_id")
    e = table(spark, d, "events").select(k, "event_type", "user_id", say("s", F.col("user_id")).alias("slug"), F.when(k % 3 != 0, k).alias("chunk_id"), F.col("event_type").alias("chunk_text"))
    label = A.query_confidence((k % 4), F.when(k % 5 == 0, 1).otherwise(0), k % 3, k % 6, k % 2 == 0)
    return e.select("event_id", label.alias("confidence"), R.open_target(F.col("user_id"), F.when(k % 2 == 0, k)).alias("target"), R.result_key().alias("key"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def q117_throttle(spark, d):
    """The first calls of a scope's interval pass; here days stand for seconds."""
    day = F.col("ts").cast("date").cast("timestamp")
    return A.throttled(table(spark, d, "events").select(say(F.col("user_id")).alias("scope"), F.struct("ts", "event_id").alias("id"), day.alias("at")), 2).select("id.event_id", "allowed")


@query(f"""WITH {EDGES} SELECT 'in' AS kind, src AS a, count(*) AS n FROM e WHERE dst = 'n3' GROUP BY ALL UNION ALL SELECT 'out', dst, 1 FROM e WHERE src = 'n3' UNION ALL SELECT 'both', link_type, count(*) FROM e WHERE src = 'n3' OR dst = 'n3' GROUP BY ALL
UNION ALL SELECT 'backlinks', dst, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'symbol', o_orderpriority, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 2 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) FROM orders GROUP BY ALL""")
def q118_graph_reads(spark, d):
    """Links of a node either way, counts of links in, symbols resolved by name or qualified name."""
    e = edges(spark, d)
    near = lambda way, by: G.neighbours(e, "n3", way).groupBy(F.lit(way).alias("kind"), F.col(by).alias("a")).agg(F.count("*").alias("n"))
    chunks = spark.createDataFrame([(1, "1-URGENT", "m.u"), (2, "x", "1-URGENT"), (3, "2-HIGH", "2-HIGH")], "chunk_id long, symbol_name string, symbol_qualified string")
    calls = G.resolve_symbols(table(spark, d, "orders").select(F.col("o_orderpriority").alias("to_symbol")), chunks).groupBy(F.lit("symbol").alias("kind"), F.col("to_symbol").alias("a")).agg(F.count("to_chunk_id").alias("n"))
    back = G.backlink_counts(e).select(F.lit("backlinks"), "dst", "backlinks")
    return near("in", "src").union(near("out", "dst")).union(near("both", "link_type")).union(back).union(calls)


@query(f"""WITH {EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), a AS (SELECT s_suppkey AS query_id, 'n' || s_nationkey AS node FROM supplier),
h AS (SELECT query_id, dst AS node, 0.5 AS score FROM a JOIN b ON a.node = b.src), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS n FROM (SELECT DISTINCT * FROM h)) WHERE n <= 5),
g AS (SELECT DISTINCT query_id, dst AS node FROM one JOIN b ON one.node = b.src WHERE (query_id, dst) NOT IN (SELECT (query_id, node) FROM one) AND (query_id, dst) NOT IN (SELECT (query_id, node) FROM a)),
two AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY node) AS n FROM g)
SELECT query_id, node AS chunk_id, 1 AS hop, 0.5::DOUBLE AS score FROM one UNION ALL SELECT query_id, node, 2, round(0.5 / 3, 9)::DOUBLE FROM two WHERE n <= 5""")
def q119_expand_anchors(spark, d):
    """Neighbours of ranked chunks over two hops, a bounded number per hop (a parameter)."""
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), say("n", F.col("s_nationkey")).alias("chunk_id"), F.lit(1.0).alias("score"))
    return G.expand_anchors(a, edges(spark, d), 2, 5).withColumn("score", F.round("score", 9))


@query("""WITH l AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'P'), h AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id FROM orders), n AS (SELECT query_id, count(*) AS b, count(*) FILTER (doc_id IN (SELECT doc_id FROM l)) AS a FROM h GROUP BY 1),
p AS (SELECT query_id FROM n WHERE a < 3 AND b > a)
SELECT 'escalated' AS kind, query_id, doc_id FROM h WHERE query_id IN (SELECT query_id FROM p) UNION ALL SELECT 'escalated', query_id, doc_id FROM l WHERE query_id NOT IN (SELECT query_id FROM p)
UNION ALL SELECT 'stage', query_id, doc_id FROM (SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_shippriority, min(o_shippriority) OVER (PARTITION BY o_custkey) AS m FROM (SELECT *, left(o_orderpriority, 1)::INT AS o_shippriority FROM orders)) WHERE o_shippriority = m""")
def q120_escalation_and_fallbacks(spark, d):
    """Few answers take the detailed search; of a chain of fallbacks the first with an answer counts."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), "o_orderstatus", F.left("o_orderpriority", F.lit(1)).cast("int").alias("stage"))
    high, low = o.select("query_id", "doc_id"), o.where("o_orderstatus = 'P'").select("query_id", "doc_id")
    up = P.escalated(low, high).select(F.lit("escalated").alias("kind"), "query_id", "doc_id")
    return up.union(R.first_stage(o.select("query_id", "doc_id", "stage")).select(F.lit("stage"), "query_id", "doc_id"))


@query("""SELECT p_partkey, regexp_matches(p_name, '(?i)ring') OR regexp_matches(p_type, '(?i)ring') AS held,
  array_to_string(list_transform(list_filter(range(0, length(p_name)), lambda i: substr(lower(p_name), i + 1, 2) = 'ri'), lambda i: i || '-' || (i + 2)), ',') AS marks,
  round((CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 1 ELSE 0 END) / 2.0, 6)::DOUBLE AS coverage FROM part""")
def q121_substring_retrievers(spark, d):
    """Substrings of several fields, places of query terms, coverage of core terms."""
    p = table(spark, d, "part")
    marks = F.array_join(F.transform(R.highlights(F.col("p_name"), F.array(F.lit("ri"), F.lit("r"))), lambda s: say(s["start"], "-", s["end"])), ",")
    return p.select("p_partkey", R.contains_any(("p_name", "p_type"), F.lit("RING")).alias("held"), marks.alias("marks"), F.round(R.coverage(F.col("p_name"), F.array(F.lit("ring"), F.lit("red"))), 6).alias("coverage"))


@query("""WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_orderkey % 4 = 0 AS rel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS y FROM orders),
m AS (SELECT query_id, count(*) FILTER (rel AND x <= 5) / 5.0 AS px, count(*) FILTER (rel AND y <= 5) / 5.0 AS py, coalesce(1.0 / min(x) FILTER (rel), 0) AS rx, coalesce(1.0 / min(y) FILTER (rel), 0) AS ry FROM r GROUP BY 1 HAVING bool_or(rel))
SELECT query_id, round(py - px, 6)::DOUBLE AS precision_delta, round(ry - rx, 6)::DOUBLE AS rr_delta FROM m""")
def q122_compare_runs(spark, d):
    """Two rankings of the same queries, metric by metric."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    rel = o.where("doc_id % 4 = 0").select("query_id", "doc_id")
    a, b = R.top_k(o, 1 << 30), R.top_k(o.withColumn("score", -F.col("score")), 1 << 30)
    c = V.compare(V.per_query(a, rel), V.per_query(b, rel))
    return c.select("query_id", F.round("precision_delta", 6).alias("precision_delta"), F.round("rr_delta", 6).alias("rr_delta"))


@query("""WITH r AS (SELECT o_custkey AS query_id, o_orderkey % 4 = 0 AS rel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS x FROM orders), m AS (SELECT query_id, count(*) FILTER (rel AND x <= 5) / 5.0 AS p FROM r GROUP BY 1 HAVING bool_or(rel)),
l AS (SELECT list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL) SELECT (SELECT count(*) FROM m) AS queries, round((SELECT avg(p) FROM m), 6) AS precision, l[greatest(1, ceil(0.95 * len(l)))::INT] AS p95_ms FROM l""")
def q123_eval_summary(spark, d):
    """Means over queries and the 95th percentile of latencies."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    m = V.per_query(R.top_k(o, 1 << 30), o.where("doc_id % 4 = 0").select("query_id", "doc_id"))
    s = V.summary(m, table(spark, d, "events").where("value is not null").select(F.col("value").alias("latency_ms")))
    return s.select("queries", F.round("precision", 6).alias("precision"), "p95_ms")


@query("""WITH s AS (SELECT o_orderpriority AS token, o_orderstatus || o_custkey % 20 AS synonym, max(o_totalprice) AS score FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, synonym) AS n FROM s WHERE token <> '5-LOW')
SELECT token, synonym, score FROM k WHERE n <= 3""")
def q124_synonym_lookup(spark, d):
    """The best synonyms of each asked token."""
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("token"), say(F.col("o_orderstatus"), F.col("o_custkey") % 20).alias("synonym")).agg(F.max("o_totalprice").alias("score"))
    return K.synonyms_of(s.where("token <> '5-LOW'").select("token"), s)


@query("""SELECT 'm' || n_regionkey AS model, n_regionkey * 64 AS dimensions, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS libraries, greatest(2, floor(sqrt(count(*) / 5.0)))::BIGINT AS clusters FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY 1, 2""")
def q125_index_groups(spark, d):
    """Libraries by their active index, and how many clusters so many make."""
    n = table(spark, d, "nation")
    idx = n.select(F.col("n_nationkey").alias("library_id"), say("m", F.col("n_regionkey")).alias("model"), (F.col("n_regionkey") * 64).alias("dimensions"), (F.col("n_nationkey") % 4 != 0).alias("is_active"))
    g = S.index_groups(n.select(F.col("n_nationkey").alias("library_id")), idx)
    return g.select("model", "dimensions", F.array_join(F.transform("libraries", lambda x: x.cast("string")), ",").alias("libraries"), K.cluster_count(F.size("libraries")).alias("clusters"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'applied' WHEN event_type = 'click' THEN 'accepted' ELSE 'pending' END AS status, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'applied' ELSE 'kept' END AS effect, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), CASE WHEN value IS NOT NULL THEN 1.0 END), 6) AS norm FROM events WINDOW w AS (PARTITION BY event_type)""")
def q126_apply_and_normalise(spark, d):
    """Accepted candidates of low risk are applied; scores between least and largest."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("query_id"), "value", F.when(F.col("event_type") == "click", "accepted").otherwise("pending").alias("status"), F.when(F.col("event_id") % 2 == 0, "low").otherwise("medium").alias("risk"))
    return L.batch_apply(e, risk="low").select("event_id", "status", "effect", F.round(R.min_max_normalised("value"), 6).alias("norm"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q127_work_loop(spark, d):
    """A stream of files handed to a worker in batches, until there is nothing left."""
    folder = scratch(spark, "work")
    table(spark, d, "events").repartition(3).write.parquet(f"{folder}/in")

    def handle(batch: DataFrame, _: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("append").parquet(f"{folder}/out")

    Z.work(Z.read_events(spark, f"{folder}/in", 1), handle, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT n_nationkey::VARCHAR AS k, n_name AS v, 'Sheet: nation' || chr(10) || 'Headers: k, v' || chr(10) || 'Row: {\"k\":\"' || n_nationkey || '\",\"v\":\"' || n_name || '\"}' AS row_text FROM nation")
def q128_csv(spark, d):
    """A table written as CSV and read back, its rows as text."""
    folder = scratch(spark, "csv")
    table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")).write.option("header", "true").csv(folder)
    rows = I.csv_rows(spark, folder)
    text = I.rows_as_text(rows, "nation")
    return text.select(F.get_json_object("row_json", "$.k").alias("k"), F.get_json_object("row_json", "$.v").alias("v"), "row_text")


@query("SELECT s_suppkey, s_name AS title, '# Body ' || s_suppkey AS body, CASE WHEN s_suppkey % 2 = 0 THEN '- 2024-01-01 | x' ELSE '' END AS timeline FROM supplier")
def q129_markdown_pages(spark, d):
    """Frontmatter, body and timeline of markdown pages."""
    k = F.col("s_suppkey")
    text = say("---\ntitle: \"", F.col("s_name"), "\"\ntags: a\n---\n# Body ", k, F.when(k % 2 == 0, "\n<!-- timeline -->\n- 2024-01-01 | x").otherwise(""))
    return I.markdown_pages(table(spark, d, "supplier").select("s_suppkey", text.alias("t")), "s_suppkey", "t").select("s_suppkey", F.col("frontmatter")["title"].alias("title"), "body", "timeline")


@query("""SELECT 'r' || r_regionkey || '.' || ext AS name, CASE ext WHEN 'md' THEN 'markdown' WHEN 'html' THEN 'html' ELSE 'text' END AS parser, 'Body ' || r_name AS text, sha256(CASE ext WHEN 'html' THEN '<title>T</title><p>Body ' || r_name || '</p>' ELSE 'Body ' || r_name END || chr(10)) AS sha256 FROM region, (VALUES ('txt'), ('md'), ('html')) AS v(ext)""")
def q130_ingest_folder(spark, d):
    """Files below a folder, by extension, parsed by kind, with their hashes; other folders are skipped."""
    folder = scratch(spark, "files")
    r = table(spark, d, "region")
    ways = F.array(*(F.struct(F.lit(e).alias("ext"), (say("<title>T</title><p>Body ", F.col("r_name"), "</p>") if e == "html" else say("Body ", F.col("r_name"))).alias("value")) for e in ("txt", "md", "html")))
    rows = r.select(say("r", F.col("r_regionkey")).alias("stem"), F.explode(ways).alias("w")).select("stem", "w.*")
    # One partition folder per file: names below tell stem and extension.
    rows.repartition("stem", "ext").write.partitionBy("stem", "ext").text(f"{folder}/in")
    rows.write.partitionBy("stem", "ext").text(f"{folder}/node_modules")
    found = I.scan(spark, folder, ("txt",)).withColumn("name", F.concat_ws(".", F.regexp_extract("path", "stem=([^/]+)", 1), F.regexp_extract("path", "ext=([^/]+)", 1)))
    found = found.withColumn("ext", F.regexp_extract("path", "ext=([^/]+)", 1))
    parsed = I.parse_files(found).select("path", "parser", "text")
    hashes = I.manifest(found).withColumnRenamed("item_path", "path")
    return found.select("path", "name").join(parsed, "path").join(hashes, "path").select("name", "parser", "text", "sha256")


def office_files(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """path, content of one word-processor file and one workbook per row (k, v)."""
    w, x = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"

    def zipped(parts: dict[str, str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return out.getvalue()

    def make(batches):
        import pandas as pd

        for pdf in batches:
            files = []
            for k, v in zip(pdf["k"], pdf["v"]):
                files.append((f"{k}.docx", zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:p><w:t>Note </w:t><w:t>{v}</w:t></w:p><w:p><w:t>end</w:t></w:p></w:document>'})))
                shared = f'<sst xmlns="{x}"><si><t>{v}</t></si></sst>'
                files.append((f"{k}.xlsx", zipped({"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{x}"><row><c t="s"><v>0</v></c><c><v>{k}</v></c></row></worksheet>'})))
            yield pd.DataFrame(files, columns=["path", "content"])

    return rows.mapInPandas(make, "path string, content binary")


@query("SELECT n_nationkey || '.docx' AS path, 'Note ' || n_name || chr(10) || 'end' AS text FROM nation UNION ALL SELECT n_nationkey || '.xlsx', n_name || '|' || n_nationkey FROM nation")
def q131_office_files(spark, d):
    """Word-processor files and workbooks."""
    files = office_files(spark, table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")))
    docs = I.docx_texts(files.where("path like '%.docx'"))
    return docs.union(I.xlsx_rows(files.where("path like '%.xlsx'")).select("path", F.array_join("cells", "|")))


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'D' ELSE 'R' END AS status, 'n/' || p_partkey AS path, CASE WHEN p_partkey % 3 = 2 THEN 'o/' || p_partkey END AS old_path FROM part""")
def q132_name_status(spark, d):
    """Lines of a version control diff."""
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, say("M\tn/", k)).when(k % 3 == 1, say("D\tn/", k)).otherwise(say("R097\to/", k, "\tn/", k))
    return I.name_status(table(spark, d, "part").select(line.alias("value")))


@query("""SELECT 'judged' AS kind, r_name AS a, v AS b FROM region, (VALUES ('x+'), ('y+'), ('z-')) AS t(v) UNION ALL SELECT 'pair', r_name, 'alias ' || r_regionkey FROM region UNION ALL SELECT 'key', r_name, 'found' FROM region WHERE r_regionkey = 3""")
def q133_judged_queries_and_pairs(spark, d):
    """Judged queries from JSON, pairs from lines with comments, a row by its key."""
    folder, r = scratch(spark, "lists"), table(spark, d, "region")
    r.select(F.col("r_name").alias("query"), F.array(F.lit("x"), F.lit("y")).alias("relevant"), F.array(F.lit("z")).alias("irrelevant")).write.json(f"{folder}/qrels")
    lines = F.explode(F.array(F.lit("# comment"), F.lit(""), say(" ", F.col("r_name"), " , alias ", F.col("r_regionkey")), F.lit("no pair")))
    r.select(lines.alias("value")).write.text(f"{folder}/pairs")
    q = I.qrels(spark, f"{folder}/qrels", lines=True).select(F.lit("judged").alias("kind"), F.col("query").alias("a"), say(F.col("doc"), F.when(F.col("relevant"), "+").otherwise("-")).alias("b"))
    return q.union(I.pair_file(spark, f"{folder}/pairs").select(F.lit("pair"), "a", "b")).union(I.by_key(r, "r_regionkey", 3).select(F.lit("key"), "r_name", F.lit("found")))


@query("""SELECT doc_id AS item_path, CASE WHEN doc_id % 10 = 1 THEN CASE doc_id % 3 WHEN 0 THEN 'deleted' WHEN 1 THEN 'marked' ELSE 'none' END ELSE 'none' END AS effect FROM documents""")
def q134_delete_policy(spark, d):
    """What becomes of missing items."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("item_path"), F.sha2("lang", 256).alias("sha256"))
    diff = L.snapshot_diff(t.where("item_path % 10 <> 1"), t)
    policy = F.when(F.col("item_path") % 3 == 0, "soft_delete").when(F.col("item_path") % 3 == 1, "mark_only").otherwise("keep")
    return L.delete_policy(diff, policy).select("item_path", "effect")


@query("""SELECT p_partkey AS document_id, CASE WHEN p_partkey % 4 = 0 THEN 'read ' || p_partkey WHEN p_partkey % 4 = 1 THEN p_name ELSE p_name END AS text, 2 + p_partkey AS n_tokens FROM part""")
def q135_provider_hooks(spark, d):
    """A counter and a recogniser of one's own."""
    k = F.col("p_partkey")
    pages = table(spark, d, "part").select(k.alias("document_id"), F.lit(1).alias("page"), F.when(k % 4 == 0, "").otherwise(F.col("p_name")).alias("native"), (k % 4 <= 1).alias("needed"), say(k).alias("content"))
    provider = lambda p: p.select("document_id", "page", say("read ", F.col("content")).alias("text"), F.when(F.col("document_id") % 4 == 0, 0.9).otherwise(0.1).alias("confidence"))
    out = A.recognised(pages, provider).withColumn("id", F.col("document_id"))
    return A.counted(out, "id", lambda c: c + 2).select("document_id", "text", "n_tokens")


@query("""WITH h AS (SELECT doc_id, doc_id // 2 AS page, doc_id % 2 = 0 AS truth, n_chars FROM documents),
p AS (SELECT a.doc_id AS truth_id, b.doc_id AS other_id, a.page % 3 <> 0 AS alike FROM h a JOIN h b ON a.page = b.page AND a.truth AND NOT b.truth)
SELECT page AS slug, doc_id AS chunk_id FROM h WHERE doc_id NOT IN (SELECT other_id FROM p WHERE alike)""")
def q136_cross_source_dedup(spark, d):
    """Of alike hits of one page the compiled truth stays, whatever its score."""
    k = F.col("doc_id")
    page = F.floor(k / 2)
    text = F.when((k % 2 == 0) | (page % 3 != 0), say("one two three four five six seven eight nine ten ", page)).otherwise(say("eleven twelve ", page))
    t = table(spark, d, "documents")
    hits = t.select((k % 5 * 0).alias("query_id"), page.alias("slug"), k.alias("chunk_id"), F.when(k % 2 == 0, "compiled_truth").otherwise("timeline").alias("source"), F.col("n_chars").cast("double").alias("score"), text.alias("chunk_text"))
    return R.cross_source_dedup(hits).select("slug", "chunk_id")


PART_SQL = "SELECT p_partkey, rpad('a' || p_name || p_partkey, 300, 'x') AS a, rpad('b' || p_partkey, 300, 'y') AS b, rpad('c' || p_type, 300, 'z') AS c, rpad('d' || p_brand, 300, 'w') AS d, rpad('e' || p_size, 300, 'v') AS e FROM part"


@query(f"""WITH p AS ({PART_SQL}), f AS (SELECT *, a || chr(10) || chr(10) || b || chr(10) || chr(10) || c AS one FROM p)
SELECT p_partkey, 0 AS chunk_index, sha256(one) AS digest FROM f UNION ALL SELECT p_partkey, 1, sha256(right(one, 200) || d || chr(10) || chr(10) || e) FROM f""")
def q137_character_splitter(spark, d):
    """Parts joined up to the size; the next chunk begins with the end of the last."""
    pad = lambda c, x: F.rpad(c, 300, x)
    parts = [pad(say("a", F.col("p_name"), F.col("p_partkey")), "x"), pad(say("b", F.col("p_partkey")), "y"), pad(say("c", F.col("p_type")), "z"), pad(say("d", F.col("p_brand")), "w"), pad(say("e", F.col("p_size")), "v")]
    docs = table(spark, d, "part").select("p_partkey", F.concat_ws("\n\n", *parts).alias("t"))
    return C.exploded(docs, C.character_splitter(1000, 200)("t"), "p_partkey").select("p_partkey", "chunk_index", F.sha2("chunk_text", 256).alias("digest"))


@query("""WITH w AS (SELECT p_partkey, array_to_string(list_transform(range(200), lambda i: 'a' || i || p_partkey), ' ') AS a, array_to_string(list_transform(range(200), lambda i: 'b' || i || p_partkey), ' ') AS b, array_to_string(list_transform(range(200), lambda i: 'c' || i || p_partkey), ' ') AS c FROM part)
SELECT p_partkey, 0 AS chunk_index, sha256(a || chr(10) || b) AS digest FROM w UNION ALL SELECT p_partkey, 1, sha256(right(a || chr(10) || b, 250) || chr(10) || c) FROM w""")
def q138_word_splitter(spark, d):
    """Paragraphs joined within one and a half sizes; a chunk begins with the end of the one before."""
    k = F.col("p_partkey").cast("string")
    run = lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.lit(x), i.cast("string"), k)), " ")
    docs = dealt(table(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.concat_ws("\n\n", run("a"), run("b"), run("c")).alias("t"))
    return C.exploded(docs, C.word_splitter()("t"), "p_partkey").select("p_partkey", "chunk_index", F.sha2("chunk_text", 256).alias("digest"))


def corners(key: Column, n: int) -> Column:
    """A vector near one of n corners that lie far apart."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.when(key % n == i, 100.0).otherwise(0.0) + (key % 3) / 100.0).cast("float"))


@query("SELECT p_partkey AS vec_id, p_partkey % 4 AS first FROM part")
def q139_kmeans_corners(spark, d):
    """Vectors about four corners fall into four clusters, here named by their least id."""
    v = table(spark, d, "part").select(F.col("p_partkey").alias("vec_id"), corners(F.col("p_partkey"), 4).alias("embedding"))
    c = K.kmeans(v, 4)
    return c.select("vec_id", F.min("vec_id").over(Window.partitionBy("cluster")).alias("first"))


@query("""WITH p AS (SELECT p_size AS document_id, p_partkey AS node, count(*) OVER (PARTITION BY p_size) AS many, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS r FROM part),
n AS (SELECT *, r % greatest(2, floor(sqrt(many / 5.0))::BIGINT) AS side FROM p)
SELECT document_id, 0 AS level, 'n' || node AS content FROM n UNION ALL SELECT document_id, 1, string_agg('n' || node, chr(10) || chr(10) ORDER BY node) FROM n WHERE many >= 3 GROUP BY document_id, side""")
def q140_summary_tree_corners(spark, d):
    """Nodes about as many corners as there are to be clusters make as many parents, whose texts join their children's."""
    p = table(spark, d, "part").select(F.col("p_size").cast("long").alias("document_id"), F.col("p_partkey").alias("node"))
    w = Window.partitionBy("document_id")
    p = p.withColumn("many", F.count("*").over(w)).withColumn("side", F.row_number().over(w.orderBy("node")) % K.cluster_count(F.col("many")))
    vector = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.when(i == F.col("side") % 40, 1.0 + F.col("side")).otherwise(F.lit(0.0)) + F.col("node") % 7 / 1000)
    t = K.summary_tree(p.select("document_id", "node", say("n", F.col("node")).alias("content"), vector.alias("embedding")), levels=1)
    return t.select("document_id", "level", "content")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN '' ELSE 'zhongguo,zg' END AS tokens FROM supplier""")
def q141_pinyin(spark, d):
    """readings of CJK characters from a table that is given."""
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, "中国 x").when(k % 3 == 1, say("a中b", k, "国")).otherwise("latin")
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(X.pinyin_tokens(text, {"中": "zhong", "国": "guo", "人": "ren"}), ",").alias("tokens"))


def pdf_of(pages: list[str], deflate: bool) -> bytes:
    """A PDF file with a page per text, its lines shown one by one."""
    import zlib

    out = [b"%PDF-1.4"]
    for k, text in enumerate(pages):
        body = b"BT " + b" T* ".join(b"(" + line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252") + b") Tj" for line in text.split("\n")) + b" ET"
        data = zlib.compress(body) if deflate else body
        out.append(b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj" % (2 * k + 1, 2 * k + 2))
        out.append(b"%d 0 obj << /Length %d%s >> stream\n" % (2 * k + 2, len(data), b" /Filter /FlateDecode" if deflate else b"") + data + b"\nendstream endobj")
    return b"\n".join([*out, b"%%EOF"])


@query("SELECT 'n' || n_nationkey || '.pdf' AS path, '[PAGE:1]' || chr(10) || 'Name (' || n_name || ')' || chr(10) || 'second line' || chr(10) || chr(10) || '[PAGE:2]' || chr(10) || 'back\\slash' AS text FROM nation UNION ALL SELECT 'bad', NULL FROM region WHERE r_regionkey = 0")
def q142_pdf(spark, d):
    """Text of PDF pages behind their marks; what is no PDF has none."""

    def make(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"path": [f"n{k}.pdf" for k in pdf["k"]], "content": [pdf_of([f"Name ({v})\nsecond line", "back\\slash"], k % 2 == 0) for k, v in zip(pdf["k"], pdf["v"])]})

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    files = n.mapInPandas(make, "path string, content binary").union(spark.range(1).select(F.lit("bad"), F.lit(b"no pdf")))
    return files.select("path").join(I.pdf_texts(files), "path", "left").select("path", "text")


@query("SELECT s_suppkey::VARCHAR AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'said ' || s_suppkey END AS text FROM supplier")
def q143_transcription(spark, d):
    """Texts of audio files from a provider of one's own."""
    files = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.col("s_name").cast("binary").alias("content"))
    return I.transcribed(files, lambda f: f.where("cast(path as int) % 2 = 0").select("path", say(" said ", F.col("path"), " ").alias("text")))


@query("""WITH r AS (SELECT * FROM (VALUES (0, 0), (1, 10), (2, 35)) AS v(run, second)), q AS (SELECT s_suppkey AS query_id, s_suppkey % 60 AS key, run FROM supplier, r WHERE run > 0 OR s_suppkey % 2 = 0),
h AS (SELECT p_size AS key, p_partkey AS doc_id FROM part)
SELECT run, query_id, CASE run WHEN 0 THEN true WHEN 1 THEN key % 2 = 1 ELSE key % 2 = 0 END AS fresh, h.doc_id FROM q LEFT JOIN h USING (key)""")
def q144_remembered_results(spark, d):
    """Answers kept in a table: the second run asks only what the first did not, the third what is over thirty seconds old."""
    s, p, folder = table(spark, d, "supplier"), table(spark, d, "part"), scratch(spark, "results")
    q = s.select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") % 60).alias("key"))
    search = lambda open_: open_.join(p.select(F.col("p_size").alias("key"), F.col("p_partkey").alias("doc_id")), "key").select("query_id", "doc_id")
    at = lambda second: F.lit(f"2025-06-01 00:00:{second:02d}").cast("timestamp")
    runs = [A.remembered(own, search, folder, at(second)).withColumn("run", F.lit(k)) for k, (own, second) in enumerate(((q.where("query_id % 2 = 0"), 0), (q, 10), (q, 35)))]
    return runs[0].union(runs[1]).union(runs[2]).select("run", "query_id", "fresh", "doc_id")


@query("SELECT doc_id, 64 AS size, true AS same, length(trim(text)) = 0 AS blank FROM documents")
def q145_offline_embedding(spark, d):
    """The stand-in for a model gives a text one vector, whatever its white space, and none but an empty text a blank one's."""
    t = table(spark, d, "documents").select("doc_id", "text")
    a = K.hash_embedding(t, "doc_id", "text")
    b = K.hash_embedding(t.select("doc_id", F.concat(F.lit(" \n"), "text", F.lit("\t")).alias("text")), "doc_id", "text").select("doc_id", F.col("embedding").alias("other"))
    return a.join(b, "doc_id").join(t, "doc_id").select("doc_id", F.size("embedding").alias("size"), (F.col("embedding") == F.col("other")).alias("same"), (F.length(F.trim("text")) == 0).alias("blank"))


#: Queries of every kind of fallback: (words of the query, stage that answers it).
FALLBACK_ASKS = ["{}", "合同 zq", "zq nowhere", "zzname", "is it qsum?", "qq csv", "zzznothing", "ZZDB"]
LIBRARY_SQL = """lib AS (SELECT p_partkey AS id, p_partkey // 2 AS document_id, 'zzname-' || (p_partkey % 90) || '.md' AS name, p_name || CASE WHEN p_partkey % 41 = 3 THEN ' 协议' WHEN p_partkey % 41 = 5 THEN ' zz数据库' ELSE '' END AS text,
  CASE WHEN p_partkey % 60 < 2 THEN 'and so: Is it QSUM? yes' ELSE p_type END AS summary, embedding::DOUBLE[] AS e FROM part LEFT JOIN embeddings ON vec_id = p_partkey),
own AS (SELECT min(id) AS id, arg_min(name, id) AS name, arg_min(summary, id) AS summary FROM lib GROUP BY document_id),
ask AS (SELECT p_partkey AS query_id, (p_partkey // 50) % 8 AS kind, replace(""" + str(FALLBACK_ASKS) + """[((p_partkey // 50) % 8 + 1)::INT], '{}', p_name) AS text, e FROM (SELECT p_partkey, p_name, embedding::DOUBLE[] AS e FROM part LEFT JOIN embeddings ON vec_id = p_partkey + 1) WHERE p_partkey % 50 = 0),
a AS (SELECT * REPLACE (lower(text) AS text) FROM ask)"""


def library(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries and nodes of small documents: names, contents, summaries and vectors that only some queries reach."""
    k, e = F.col("p_partkey"), table(spark, d, "embeddings").select("vec_id", "embedding")
    p = table(spark, d, "part")
    mark = F.when(k % 41 == 3, " 协议").when(k % 41 == 5, " zz数据库").otherwise("")
    nodes = p.join(e, k == F.col("vec_id"), "left").select(
        k.alias("node_id"), F.expr("p_partkey div 2").alias("document_id"), say("zzname-", k % 90, ".md").alias("name"), say(F.col("p_name"), mark).alias("content"),
        F.when(k % 60 < 2, "and so: Is it QSUM? yes").otherwise(F.col("p_type")).alias("summary"), "embedding",
    )
    form = F.element_at(F.array(*map(F.lit, FALLBACK_ASKS)), (F.expr("p_partkey div 50") % 8 + 1).cast("int"))
    asked = p.where("p_partkey % 50 = 0").join(e, k + 1 == F.col("vec_id"), "left")
    return asked.select(k.alias("query_id"), F.replace(form, F.lit("{}"), F.col("p_name")).alias("text"), "embedding"), nodes


def of_kind(*kinds: int, text: str = "text") -> str:
    return f"SELECT query_id, {text} AS text FROM a WHERE kind IN ({', '.join(map(str, kinds))})"


@query(f"""WITH {LIBRARY_SQL},
{prefix_bm25("nf", "SELECT id, text FROM lib", of_kind(0), 30)},
{prefix_bm25("sy", "SELECT id, text FROM lib", of_kind(1, text="replace(text, '合同', '协议')") + " UNION ALL " + of_kind(7, text="replace(text, 'db', '数据库')"), 60)},
{prefix_bm25("nm", "SELECT id, name AS text FROM own", of_kind(3), 90)},
{held("sm", "SELECT id, summary AS text FROM own", of_kind(4), 90)},
{nearest("nv", "SELECT id, e FROM lib WHERE e IS NOT NULL", "SELECT query_id, e FROM a WHERE e IS NOT NULL AND kind NOT IN (5)", 30)},
{nearest("vx", "SELECT id, e FROM lib WHERE e IS NOT NULL", "SELECT query_id, e FROM a WHERE e IS NOT NULL AND kind = 5", 150)},
typed AS (SELECT query_id, kind, text, {TYPE_SQL} AS query_type FROM (SELECT *, trim(text) AS q FROM a)),
w AS (SELECT query_id, retriever FROM typed JOIN (VALUES {PLAN_SQL}) AS w(query_type, retriever, weight) USING (query_type)),
{prefix_bm25("tn", "SELECT id, name AS text FROM own", "SELECT query_id, text FROM a JOIN w USING (query_id) WHERE retriever = 'title_name'", 30)},
{held("s0", "SELECT id, summary AS text FROM own", "SELECT query_id, text FROM a JOIN w USING (query_id) WHERE retriever = 'summary'", 30)},
{held("m0", "SELECT id, name AS text FROM own", "SELECT query_id, text FROM a JOIN w USING (query_id) WHERE retriever = 'metadata'", 30)},
p0 AS (SELECT query_id, id, 'node_fts' AS list FROM nf UNION ALL SELECT query_id, id, 'vector' FROM nv SEMI JOIN (FROM w WHERE retriever = 'vector') USING (query_id) UNION ALL SELECT query_id, id, 'title' FROM tn
  UNION ALL SELECT query_id, id, 'summary' FROM s0 UNION ALL SELECT query_id, id, 'metadata' FROM m0),
later AS (SELECT query_id, id, 'node_fts' AS list, 1 AS stage FROM sy UNION ALL SELECT query_id, id, 'title', 4 FROM nm UNION ALL SELECT query_id, id, 'summary', 5 FROM sm UNION ALL SELECT query_id, id, 'vector', 6 FROM vx UNION ALL SELECT query_id, id, 'vector', 6 FROM nv),
h AS (SELECT query_id, id, list, 0 AS stage FROM p0 UNION ALL FROM later ANTI JOIN p0 USING (query_id)),
f AS (SELECT query_id, min(stage) AS stage FROM h GROUP BY 1),
t AS (SELECT query_id, stage FROM h SEMI JOIN f USING (query_id, stage) GROUP BY ALL)
SELECT h.query_id, id AS doc_id, list, h.stage, -1 AS attempts FROM h JOIN f ON h.query_id = f.query_id AND h.stage = f.stage
UNION ALL SELECT query_id, NULL, NULL, NULL, coalesce(stage, 6) + 1 FROM a LEFT JOIN f USING (query_id)""")
def q146_search_fallbacks(spark, d):
    """The six steps for queries of which the planned retrievers find nothing, each asked only what is still open, and how many steps a query took."""
    lists, attempts = P.document_candidates(*library(spark, d))
    hits = lists.select("query_id", "doc_id", "list", "stage", F.lit(-1).cast("long").alias("attempts"))
    none = F.lit(None)
    return hits.union(attempts.groupBy("query_id").agg(F.count("*").alias("attempts")).select("query_id", none.cast("long"), none.cast("string"), none.cast("int"), "attempts"))


FACADE_ASKS = ["small {}", "qqq {}", "zzz", "nosuch", "uildin", "what about {}"]


@query(f"""WITH {JOINED_SQL}, a AS (SELECT s_suppkey AS query_id, s_suppkey % 6 AS kind, replace({FACADE_ASKS}[s_suppkey % 6 + 1], '{{}}', split_part(p_name, ' ', 2)) AS text FROM supplier JOIN part ON p_partkey = s_suppkey),
{prefix_bm25("ev", "SELECT p_partkey AS id, p_name AS text FROM part", "SELECT query_id, CASE kind WHEN 2 THEN 'zzz ring' ELSE text END AS text FROM a WHERE kind NOT IN (3, 4)", 5)},
h AS (SELECT query_id, count(*) AS hits, max(len(list_filter({words('text')}, lambda t: contains(lower(p_name), t)))) AS m FROM ev JOIN a USING (query_id) JOIN part ON p_partkey = id GROUP BY 1),
t AS (SELECT count(*) AS hits FROM (SELECT DISTINCT artifact_uid, CASE WHEN trim(p.title) <> '' THEN p.title WHEN trim(p.name) <> '' THEN p.name ELSE a.name END FROM art a LEFT JOIN pd p USING (artifact_id) WHERE status = 'active' AND contains(lower(concat_ws(' ', slug, a.name, p.title, p.name)), 'uildin'))),
z AS (SELECT query_id, kind, len({words('text')}) AS n, coalesce(h.hits, 0) AS hits, coalesce(m, 0) AS m FROM a LEFT JOIN h USING (query_id)),
o AS (SELECT query_id, CASE WHEN kind = 2 THEN 'core_terms_or' WHEN kind = 3 THEN 'no_results' WHEN kind = 4 THEN 'title_slug' WHEN m >= 2 OR n < 2 AND hits > 0 THEN 'original_query' WHEN m > 0 THEN 'partial_results' ELSE 'no_results' END AS stage,
  CASE WHEN kind = 4 THEN least(10, (SELECT hits FROM t)) ELSE hits END AS hits, n, m FROM z)
SELECT query_id, stage, CASE WHEN stage = 'original_query' THEN NULL WHEN stage = 'partial_results' THEN 'primary_low_quality' ELSE 'primary_no_hits' END AS reason, CASE stage WHEN 'original_query' THEN 1 WHEN 'core_terms_or' THEN 3 ELSE 4 END AS attempts, hits,
  CASE WHEN hits = 0 THEN 'none' WHEN stage = 'title_slug' THEN 'low' WHEN stage = 'original_query' AND m >= least(2, n) THEN 'high' ELSE 'medium' END AS confidence FROM o""")
def q147_facade_fallbacks(spark, d):
    """Queries that are of use as they are, by synonyms, in part, by names only, or not at all."""
    p = table(spark, d, "part")
    posts = R.token_postings(p, "p_partkey", "p_name")

    def search(q: DataFrame) -> DataFrame:
        hits = R.top_k(R.prefix_bm25(q, posts), 5).join(p.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("content")), "doc_id")
        return hits.select("query_id", F.lit("evidence").alias("route"), F.col("doc_id").cast("string").alias("ref"), F.lit("").alias("title"), "content", "score")

    form = F.element_at(F.array(*map(F.lit, FACADE_ASKS)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    q = table(spark, d, "supplier").join(p, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), F.replace(form, F.lit("{}"), word).alias("text"), F.lit("brain_first").alias("strategy"))
    synonyms = table(spark, d, "region").where("r_regionkey = 0").select(F.lit("zzz").alias("token"), F.lit("ring").alias("synonym"), F.lit(1.0).alias("score"))
    _, outcomes, _ = P.facade_query(q, search, artifacts(spark, d), projections(spark, d), kb_documents(spark, d), synonyms)
    return outcomes.select("query_id", "stage", "reason", "attempts", "hits", "confidence")


def cased(x: str) -> str:
    """SQL: words as they stand."""
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')"


def fielded(source: str, queries: str, fields: dict[str, tuple[str, float]], text: str, k: int) -> str:
    """SQL: the table z (query_id, id, slug, score, rank, snippet): BM25 over weighted fields, and the shortest span of the
    most of a query's first twelve terms. source: id, slug and the fields; fields: name to a list of words and a weight."""
    rows = " UNION ALL ".join(f"SELECT id, '{n}' AS field, {w} AS weight, unnest({x}) AS term, generate_subscripts({x}, 1) - 1 AS place FROM src" for n, (x, w) in fields.items())
    seen = ", ".join(f"max(place) FILTER (j = {j}) OVER w" for j in range(12))
    return f"""src AS ({source}), t AS (SELECT id, field, weight, lower(term) AS term, place FROM ({rows})),
l AS (SELECT id, count(*) AS dl FROM t GROUP BY 1), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM l),
q AS (SELECT query_id, j - 1 AS j, u[j] AS q FROM (SELECT query_id, u, unnest(range(1, len(u) + 1)) AS j FROM (SELECT query_id, list_filter(list_transform(w, lambda x: CASE WHEN x IN ('and', 'or', 'not', 'near') THEN '_' || x ELSE x END), lambda x, i: list_position(w, w[i]) = i) AS u FROM (SELECT query_id, {words('text')} AS w FROM ({queries}))))),
p AS (SELECT q, id, field, weight, place FROM (SELECT DISTINCT q FROM q) JOIN t ON starts_with(term, q)),
h AS (SELECT q, id, sum(weight)::DOUBLE AS tf FROM p GROUP BY ALL), d AS (SELECT q, count(*) AS df FROM h GROUP BY 1),
r AS (SELECT query_id, id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score FROM q JOIN h USING (q) JOIN d USING (q) JOIN l USING (id), st GROUP BY ALL),
b AS (SELECT query_id, id, slug, round(score * {BOOST_SQL}, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM r) JOIN src USING (id) WHERE k <= {k}),
m AS (SELECT DISTINCT query_id, id, place, j FROM b JOIN q USING (query_id) JOIN p USING (q, id) WHERE field = '{text}'),
e AS (SELECT query_id, id, place, list_filter([{seen}], lambda v: v > place - 64) AS near FROM m WINDOW w AS (PARTITION BY query_id, id ORDER BY place)),
s AS (SELECT query_id, id, list_min(near) AS lo, place AS hi FROM e QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY len(near) DESC, place - list_min(near), list_min(near)) = 1),
x AS (SELECT query_id, id, list(DISTINCT place) AS marks FROM m GROUP BY ALL),
y AS (SELECT b.*, marks, coalesce({text}, '') AS whole, regexp_extract_all(coalesce({text}, ''), '([\\p{{L}}\\p{{N}}_]+)([^\\p{{L}}\\p{{N}}_]*)', 1) AS w, regexp_extract_all(coalesce({text}, ''), '([\\p{{L}}\\p{{N}}_]+)([^\\p{{L}}\\p{{N}}_]*)', 2) AS gap, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi
  FROM b JOIN src USING (id) LEFT JOIN s USING (query_id, id) LEFT JOIN x USING (query_id, id)),
c AS (SELECT *, greatest(0, least(lo - floor((64 - (hi - lo + 1)) / 2)::BIGINT, len(w) - 64)) AS low FROM y),
f AS (SELECT *, least(low + 64, len(w)) AS upto FROM c),
z AS (SELECT query_id, id, slug, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, CASE WHEN len(w) = 0 THEN left(whole, 64) ELSE CASE WHEN low > 0 THEN '...' ELSE regexp_extract(whole, '^([^\\p{{L}}\\p{{N}}_]*)', 1) END
  || array_to_string(list_transform(range(low, upto), lambda i: CASE WHEN list_contains(marks, i) THEN '<<' || w[i + 1] || '>>' ELSE w[i + 1] END || CASE WHEN i = upto - 1 AND upto < len(w) THEN '' ELSE gap[i + 1] END), '') || CASE WHEN upto < len(w) THEN '...' ELSE '' END END AS snippet FROM f)"""


@query("WITH " + fielded(f"SELECT * FROM (SELECT doc_id AS id, {DIR_SQL}[doc_id % 12 + 1] || doc_id AS slug, text, lang, source FROM documents) WHERE NOT starts_with(slug, 'archive/')", "SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS text FROM benchmark",
    {"text": (cased("text"), 1.0), "tokens": (f"list_distinct({words('text')})", 1.0), "lang": (cased("lang"), 0.5), "source": (cased("source"), 3.0)}, "text", 20) + " SELECT query_id, rank, slug, id AS chunk_id, round(score, 6) AS score, snippet FROM z WHERE rank <= 20")
def q148_field_search(spark, d):
    """Chunks by weighted fields, with the shortest passage that holds the most of a query, marked."""
    s = slugged(spark, d)
    chunks = s.join(table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("symbol_name")), "doc_id").select(F.col("doc_id").alias("chunk_id"), "slug", F.col("text").alias("chunk_text"), F.col("source").alias("chunk_source"), F.col("lang").alias("language"), "symbol_name")
    none = F.lit(None).cast("string")
    pages = s.select("slug", F.col("slug").alias("title"), none.alias("compiled_truth"), none.alias("timeline"), "page_type", none.alias("deleted_at"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("text"))
    return FS.keyword_search(q, chunks, pages).select("query_id", "rank", "slug", "chunk_id", F.round("score", 6).alias("score"), "snippet")


TITLE_SQL = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@query("WITH " + fielded(f"SELECT url AS id, url AS slug, {TITLE_SQL} AS title, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages", f"SELECT page_id AS query_id, array_to_string(string_split({TITLE_SQL}, ' ')[1:3], ' ') AS text FROM pages WHERE page_id % 100 = 0",
    {"slug": (cased("slug"), 1.0), "title": (cased("title"), 10.0), "tt": (f"list_distinct({words('title')})", 10.0), "body": (cased("body"), 5.0), "bt": (f"list_distinct({words('body')})", 5.0)}, "body", 20) + " SELECT query_id, rank, slug, round(score, 6) AS score, snippet FROM z WHERE rank <= 20")
def q149_page_search(spark, d):
    """Pages by weighted fields where there are no chunks: web pages by address, title and text."""
    none = F.lit(None).cast("string")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("slug"), title.alias("title"), X.strip_tags("html").alias("compiled_truth"), none.alias("timeline"), F.lit("note").alias("page_type"), none.alias("deleted_at"))
    q = pages.where("page_id % 100 = 0").select(F.col("page_id").alias("query_id"), F.array_join(F.slice(F.split("title", " "), 1, 3), " ").alias("text"))
    chunks = table(spark, d, "pages").where("false").select(F.col("page_id").alias("chunk_id"), F.col("url").alias("slug"), F.col("html").alias("chunk_text"), none.alias("chunk_source"))
    return FS.keyword_search(q, chunks, pages).select("query_id", "rank", "slug", F.round("score", 6).alias("score"), "snippet")


@query()
def q150_vector_index(spark, d):
    """An index over all vectors, asked with every vector whose id is divisible by 100; a unit test holds its recall against brute force."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = VX.build_index(e, scratch(spark, "vectors"))
    q = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return VX.search_index(q, index, e, 10).withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT p_partkey AS id, 'f' || p_partkey % 197 AS name, lower(replace(p_brand, '#', '-')) AS slug, p_name AS text FROM part), pg AS (SELECT DISTINCT slug, 'About ' || slug AS title FROM c WHERE slug NOT LIKE '%-5%'),
k AS (SELECT o_custkey AS src, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 2000 + 1 END AS dst, 'f' || o_orderkey % 260 AS name FROM orders),
e AS (SELECT src, dst FROM k WHERE dst IS NOT NULL UNION SELECT src, c.id FROM k JOIN c USING (name) WHERE dst IS NULL), b AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
a AS (SELECT s_suppkey AS query_id, s_suppkey * 7 AS id, 2.0 AS score FROM supplier),
y AS (SELECT query_id, id FROM (SELECT s_suppkey AS query_id, c.id, row_number() OVER (PARTITION BY s_suppkey ORDER BY c.id) AS n FROM supplier JOIN c ON name = 'f' || s_suppkey WHERE s_suppkey % 3 = 0) WHERE n <= 5),
z AS (SELECT query_id, id FROM a UNION SELECT query_id, id FROM y),
one AS (SELECT * FROM (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY node) AS n FROM (SELECT DISTINCT query_id, dst AS node FROM z JOIN b ON id = src) h WHERE (query_id, node) NOT IN (SELECT (query_id, id) FROM z)) WHERE n <= 5),
two AS (SELECT * FROM (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY node) AS n FROM (SELECT DISTINCT query_id, dst AS node FROM one JOIN b ON node = src) h WHERE (query_id, node) NOT IN (SELECT (query_id, id) FROM z) AND (query_id, node) NOT IN (SELECT (query_id, node) FROM one)) WHERE n <= 5),
r AS (SELECT query_id, id, 0 AS hop, 2.0 AS score FROM y WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM a) UNION ALL SELECT query_id, node, 1, 1.0 FROM one UNION ALL SELECT query_id, node, 2, 1.0 / 3 FROM two)
SELECT query_id, id AS chunk_id, hop, round(score, 6)::DOUBLE AS score, slug, title, text AS chunk_text FROM r JOIN c USING (id) JOIN pg USING (slug)""")
def q151_two_pass(spark, d):
    """Chunks about ranked ones over resolved and named calls, from a symbol as well, with their texts and titles."""
    k = F.col("p_partkey")
    chunks = table(spark, d, "part").select(k.alias("chunk_id"), say("f", k % 197).alias("symbol_name"), F.lit(None).cast("string").alias("symbol_qualified"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("slug"), F.col("p_name").alias("chunk_text"))
    pages = chunks.select("slug", say("About ", F.col("slug")).alias("title")).distinct().withColumn("deleted_at", F.when(F.col("slug").contains("-5"), "2024-01-01"))
    o = F.col("o_orderkey")
    calls = table(spark, d, "orders").select(F.col("o_custkey").alias("from_chunk_id"), F.when(o % 2 == 0, o % 2000 + 1).alias("to_chunk_id"), say("f", o % 260).alias("to_symbol"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"))
    anchors = s.select("query_id", (F.col("query_id") * 7).alias("chunk_id"), F.lit(2.0).alias("score"))
    asked = s.where("query_id % 3 = 0").select("query_id", say("f", F.col("query_id")).alias("symbol"))
    return G.two_pass(anchors, calls, chunks, pages, asked, 2, 5).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 3 WHEN 0 THEN 'slug:' || s_suppkey % 40 WHEN 1 THEN 'documents/' || s_suppkey % 40 END AS slug FROM supplier),
p AS (SELECT p_partkey % 100 + 1 AS query_id, 'documents/' || p_size AS slug, p_retailprice AS score FROM part),
w AS (SELECT query_id, unnest(['documents/' || query_id % 40, (query_id % 40)::VARCHAR]) AS slug FROM q WHERE slug IS NOT NULL
  UNION ALL SELECT query_id, slug FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS n FROM p SEMI JOIN (FROM q WHERE slug IS NULL) USING (query_id)) WHERE n = 1),
r AS (SELECT o_orderkey AS provenance_id, CASE WHEN o_custkey % 2 = 0 THEN 'documents/' || o_custkey % 50 ELSE (o_custkey % 50)::VARCHAR END AS slug, o_orderdate FROM orders WHERE o_orderstatus <> 'P')
SELECT query_id, provenance_id, slug, row_number() OVER (PARTITION BY query_id ORDER BY o_orderdate DESC, provenance_id) AS rank FROM w JOIN r USING (slug)""")
def q152_provenance_strategy(spark, d):
    """Records of the page that a query names, or else of its best page."""
    k, c = F.col("s_suppkey"), F.col("o_custkey")
    q = table(spark, d, "supplier").select(k.alias("query_id"), F.when(k % 3 == 0, say("slug:", k % 40)).when(k % 3 == 1, say("documents/", k % 40)).alias("slug"))
    pages = table(spark, d, "part").select((F.col("p_partkey") % 100 + 1).alias("query_id"), say("documents/", F.col("p_size")).alias("slug"), F.col("p_retailprice").alias("score"))
    slug = F.when(c % 2 == 0, say("documents/", c % 50)).otherwise(say(c % 50))
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("provenance_id"), slug.alias("slug"), F.when(F.col("o_orderstatus") == "P", "stale").otherwise("active").alias("status"), F.col("o_orderdate").alias("created_at"))
    return P.provenance_answers(q, pages, records).select("query_id", "provenance_id", "slug", "rank")


LETTERS, CHARACTERS = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + 7 * k) for k in range(26))


@query(f"""WITH r AS (SELECT translate(replace(lower(p_name), ' ', ''), '{LETTERS}', '{CHARACTERS}') AS run FROM part), s AS (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM r), z AS (SELECT run, i, unnest(range(1, 5)) AS n FROM s),
g AS (SELECT substr(run, i, n) AS w, CASE WHEN i > 1 THEN substr(run, i - 1, 1) ELSE '' END AS b, substr(run, i + n, 1) AS a FROM z WHERE i + n - 1 <= length(run)),
c AS (SELECT w, count(*) AS n FROM g GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM c WHERE length(w) = 1),
p AS (SELECT w, n, unnest(range(1, length(w))) AS k FROM c WHERE length(w) > 1 AND n >= 5),
h AS (SELECT p.w, p.n, min(ln(p.n * t / (x.n::DOUBLE * y.n))) AS cohesion FROM p JOIN c x ON x.w = left(p.w, k) JOIN c y ON y.w = substr(p.w, k + 1), t GROUP BY ALL HAVING min(ln(p.n * t / (x.n::DOUBLE * y.n))) >= 0.5),
eb AS (SELECT w, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS e FROM (SELECT w, b, count(*)::DOUBLE AS n FROM g GROUP BY ALL) GROUP BY 1), ea AS (SELECT w, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS e FROM (SELECT w, a, count(*)::DOUBLE AS n FROM g GROUP BY ALL) GROUP BY 1)
SELECT w AS word, n, round(cohesion, 6) AS cohesion, round(least(eb.e, ea.e), 6) AS freedom FROM h JOIN eb USING (w) JOIN ea USING (w) WHERE least(eb.e, ea.e) >= 0.2""")
def q153_mined_words(spark, d):
    """words of texts without spaces, by how firmly they hold together and how freely they stand: part names in other characters."""
    t = table(spark, d, "part").select(F.translate(F.replace(F.lower("p_name"), F.lit(" "), F.lit("")), LETTERS, CHARACTERS).alias("t"))
    return WD.mine_words(t, "t", cohesion=0.5, freedom=0.2).select("word", "n", F.round("cohesion", 6).alias("cohesion"), F.round("freedom", 6).alias("freedom"))


@query()
def q154_ledger(spark, d):
    """Reservations, commits and rollbacks of each kind of event and day under a cap; a unit test holds it, and the stream, against a plain ledger."""
    k = F.col("event_id")
    kind = F.when(k % 5 == 0, "commit").when(k % 5 == 1, "rollback").otherwise("reserve")
    e = table(spark, d, "events").select(F.col("event_type").alias("scope"), F.col("ts").cast("date").alias("day"), F.col("ts").cast("timestamp").alias("at"), (k % 40).alias("id"), kind.alias("kind"), "value")
    rows = LG.settled(e.withColumnRenamed("value", "amount"), 500.0)
    return rows.select("scope", "day", "id", "kind", "outcome", F.round("committed", 6).alias("committed"), F.round("reserved", 6).alias("reserved"))

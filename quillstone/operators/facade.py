"""The artifact side: uploads, projections, provenance, page versions, and reads that join them.

Tables (all DataFrames): artifacts (artifact_id, artifact_uid, sha256, slug, name, status, updated_at),
projections (projection_id, artifact_id, projection_type, projection_ref, status), documents (document_id,
title, name, deleted_at), nodes (node_id, document_id, version_id, chunk_order, content).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructField, StructType, TimestampType

from quillstone.functions import text as X
from quillstone.operators import retrieval as R
from quillstone.operators import statistics as S
from quillstone.operators.cascade import union
from quillstone.operators.substring import containing
from quillstone.session import checkpointed

#: Fixed value: how a projection names its document.
DOCUMENT_REF = "kb_document:"


class TokenCounter(Protocol):
    """A hook that counts tokens (X2): a column to a column."""

    def __call__(self, text: Column) -> Column: ...


class OcrProvider(Protocol):
    """A hook that recognises pages (X5): rows with document_id, page, content to document_id, page, text, confidence."""

    def __call__(self, pages: DataFrame) -> DataFrame: ...


def counted(rows: DataFrame, text: str, counter: TokenCounter = X.token_count) -> DataFrame:
    """rows plus n_tokens by any counter."""
    return rows.withColumn("n_tokens", counter(F.col(text)).cast("long"))


def recognised(pages: DataFrame, provider: OcrProvider, least: float = 0.5) -> DataFrame:
    """document_id, page, text: native text merged with what the provider reads on pages that need it.

    pages: document_id, page, native, needed, content. Readings under the least confidence are left out.
    """
    read = provider(pages.where("needed").select("document_id", "page", "content")).where(F.col("confidence") >= least)
    both = pages.select("document_id", "page", "native").join(read.select("document_id", "page", F.col("text").alias("__read")), ["document_id", "page"], "left")
    return both.select("document_id", "page", S.merge_recognised(F.col("native"), F.col("__read")).alias("text"))


def snapshot(pages: DataFrame, versions: DataFrame, at: Column) -> DataFrame:
    """versions with one more of each page, numbered on (K9). Both: slug, title, page_type, body; versions also version_id and snapshot_at."""
    last = versions.groupBy("slug").agg(F.max("version_id").alias("__last"))
    new = pages.join(last, "slug", "left").select("slug", "title", "page_type", "body", (F.coalesce("__last", F.lit(0)) + 1).cast("long").alias("version_id"), at.alias("snapshot_at"))
    return versions.unionByName(new)


def revert(pages: DataFrame, versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """pages with those of wanted (slug, version_id) as they were; a version of another page changes nothing (K9)."""
    old = versions.join(wanted, ["slug", "version_id"]).select("slug", F.struct("title", "page_type", "body").alias("__old"))
    back = pages.join(old, "slug", "left")
    return back.select("slug", *(F.when(F.col("__old").isNotNull(), F.col(f"__old.{c}")).otherwise(F.col(c)).alias(c) for c in ("title", "page_type", "body")))


def persist_nodes(nodes: DataFrame, folder: str) -> None:
    """A version's nodes as Parquet by library and version; written again, they take the place of their own partitions only."""
    nodes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("library_id", "version_id").parquet(folder)


def audited(calls: DataFrame) -> DataFrame:
    """library_id, call_type, model, calls, failed, tokens: external calls summed up."""
    return calls.groupBy("library_id", "call_type", "model").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failed"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))


def upload(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """name, sha256, artifact_id, created, route of uploads.

    A content that is known, or came first in the same upload, is the artifact that it is; a new one's number
    is the hash of its content, which no other upload has to be asked for. files: name, ext, intent, sha256.
    """
    known = artifacts.where("status = 'active'").groupBy("sha256").agg(F.min("artifact_id").alias("__known"))
    out = files.join(known, "sha256", "left")
    return out.select("name", "sha256", F.coalesce("__known", F.xxhash64("sha256")).alias("artifact_id"), F.col("__known").isNull().alias("created"), S.route(F.col("ext"), F.col("intent")).alias("route"))


def reprocess(artifacts: DataFrame, projections: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projections, jobs): of wanted active artifacts the active projections grow stale and one job each is due."""
    due = artifacts.where("status = 'active'").join(wanted.select("artifact_id"), "artifact_id", "left_semi").select("artifact_id")
    marked = projections.join(due.withColumn("__due", F.lit(True)), "artifact_id", "left")
    stale = F.coalesce("__due", F.lit(False)) & (F.col("status") == "active")
    out = marked.withColumn("stale_reason", F.when(stale, "reprocess")).withColumn("status", F.when(stale, "stale").otherwise(F.col("status"))).drop("__due")
    return out, due.select("artifact_id", F.lit("reprocess").alias("job_type"), F.lit("pending").alias("status"))


def projected_documents(projections: DataFrame, documents: DataFrame) -> DataFrame:
    """artifact_id, document_id, title, name: active projections joined by the key in their reference."""
    ref = projections.where((F.col("status") == "active") & F.col("projection_ref").startswith(DOCUMENT_REF)).select("artifact_id", F.substring("projection_ref", len(DOCUMENT_REF) + 1, 20).try_cast("long").alias("document_id"))
    return ref.join(documents.where("deleted_at is null").select("document_id", "title", "name"), "document_id").select("artifact_id", "document_id", "title", "name")


def first_node(nodes: DataFrame) -> DataFrame:
    """document_id, node_id: the first node of each document by order, then id."""
    return nodes.groupBy("document_id").agg(F.min(F.struct("chunk_order", "node_id")).alias("f")).select("document_id", "f.node_id")


def media_of(nodes: DataFrame) -> DataFrame:
    """document_id, refs: the media references of a document's nodes, in node order (J18, F26). nodes: document_id, node_id, metadata."""
    rows = nodes.select("document_id", "node_id", F.posexplode(X.media_refs("metadata")).alias("i", "ref"))
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "i", "ref"))).alias("r")).select("document_id", F.transform("r", lambda x: x["ref"]).alias("refs"))


def enriched(hits: DataFrame, projections: DataFrame, artifacts: DataFrame) -> DataFrame:
    """hits (document_id, ...) plus artifact_uid and slug of the artifact that a document comes from."""
    ref = projections.where((F.col("status") == "active") & F.col("projection_ref").startswith(DOCUMENT_REF)).select("artifact_id", F.substring("projection_ref", len(DOCUMENT_REF) + 1, 20).try_cast("long").alias("document_id"))
    own = ref.groupBy("document_id").agg(F.min("artifact_id").alias("artifact_id")).join(artifacts.select("artifact_id", "artifact_uid", "slug"), "artifact_id")
    return hits.join(own, "document_id", "left")


def in_folder(hits: DataFrame, documents: DataFrame, folder: Column) -> DataFrame:
    """Hits whose document lies in a folder (P5)."""
    return hits.join(documents.where(F.col("folder_id") == folder).select("document_id"), "document_id", "left_semi")


def chosen(slugs: tuple[str, ...] = (), hidden: tuple[str, ...] = (), page_type: str | None = None, language: str | None = None, symbol_kind: str | None = None, low_detail: bool = False) -> Column:
    """Exact slugs in and out, kind, language, kind of symbol, and compiled truth alone at low detail."""
    out = F.lit(True)
    for c, yes in ((F.col("slug").isin(*slugs), bool(slugs)), (~F.col("slug").isin(*hidden), bool(hidden)), (F.col("page_type") == page_type, page_type is not None), (F.col("language") == language, language is not None), (F.col("symbol_type") == symbol_kind, symbol_kind is not None), (F.col("source") == "compiled_truth", low_detail)):
        out = out & c if yes else out
    return F.coalesce(out, F.lit(False))


def code_search(queries: DataFrame, chunks: DataFrame, where: Column | None = None, k: int = 20) -> DataFrame:
    """query_id, rank, chunk_id, score over code pages and fenced code alone, boosted by slug.

    chunks: chunk_id, slug, page_type, source, chunk_text, and what where asks for. As the list is cut before
    the boost, the boost only re-orders it. Equal queries are asked once.
    """
    queries, dealt = R.shared(queries, ("text",))
    code = chunks.where((F.col("page_type") == "code") | (F.col("source") == "fenced_code")).where(~R.hidden("slug"))
    code = code if where is None else code.where(where)
    hits = R.top_k(R.prefix_bm25(queries, R.token_postings(code, "chunk_id", "chunk_text"), most=k), k).drop("rank")
    boosted = R.source_boost(hits.join(code.select(F.col("chunk_id").alias("doc_id"), "slug"), "doc_id")).withColumn("score", F.round("score", 9))
    return dealt(R.top_k(boosted, k).select("query_id", "rank", F.col("doc_id").alias("chunk_id"), "score"))


def guarded(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, node_id, content, title, score, core): a first hit that covers under two core terms
    changes places with the best-scored later one that covers them (W17)."""
    both = F.lower(F.concat_ws(" ", "content", "title"))
    seen = F.size(F.filter("core", lambda t: F.contains(both, t)))
    need = F.least(F.lit(2), F.size("core"))
    w = Window.partitionBy("query_id")
    h = hits.withColumn("__ok", seen >= need).withColumn("__many", (F.size("core") >= 2) & (F.count("*").over(w) >= 2))
    first_ok = F.bool_or(F.col("__ok") & (F.col("rank") == 1)).over(w)
    best = F.max_by("rank", F.when(F.col("__ok") & (F.col("rank") > 1), F.struct("score", -F.col("rank")))).over(w)
    h = h.withColumn("__swap", F.when(F.col("__many") & ~first_ok, best))
    moved = F.when(F.col("__swap").isNull(), F.col("rank")).when(F.col("rank") == 1, F.col("__swap")).when(F.col("rank") == F.col("__swap"), 1).otherwise(F.col("rank"))
    return h.withColumn("rank", moved.cast("int")).drop("__ok", "__many", "__swap")


def unioned_indexes(*lists: DataFrame, k: int = 10) -> DataFrame:
    """query_id, node_id, score, rank over several vector indexes: of a node met twice the earlier index counts."""
    every = None
    for i, one in enumerate(lists):
        rows = one.select("query_id", "node_id", "score", F.lit(i).alias("__index"))
        every = rows if every is None else every.union(rows)
    first = every.groupBy("query_id", "node_id").agg(F.min_by("score", F.struct("__index", -F.col("score"))).alias("score"))
    return R.top_k(first, k, tie="node_id")


def supplemented(found: DataFrame, fallback: DataFrame, k: int = 10) -> DataFrame:
    """Queries with under k hits take the fallback's other nodes as well; sorted anew and cut."""
    short = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
    more = fallback.join(short, "query_id", "left_anti").join(found.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    return R.top_k(found.select("query_id", "node_id", "score").union(more.select("query_id", "node_id", "score")), k, tie="node_id")


def reconciled_tags(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """page_id, tag, action: tags to add and to remove so that existing equal wanted."""
    key = ["page_id", "tag"]
    add = wanted.select(*key).distinct().join(existing, key, "left_anti").withColumn("action", F.lit("add"))
    own = existing.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    return add.union(own.select(*key).distinct().join(wanted, key, "left_anti").withColumn("action", F.lit("remove")))


def missing_links(named: DataFrame, links: DataFrame) -> DataFrame:
    """from_slug, to_slug that contents name and the link table lacks."""
    return named.select("from_slug", "to_slug").distinct().join(links, ["from_slug", "to_slug"], "left_anti")


def timeline_hits(queries: DataFrame, candidates: DataFrame, documents: DataFrame, k: int = 20, projections: DataFrame | None = None) -> DataFrame:
    """query_id, rank, candidate_id, date, summary, source: accepted events whose payload, or whose document's
    name or title, holds the query anywhere, parts of words included, in either case (J10, R52).

    With projections (artifact_id, projection_type, projection_ref, status), a query whose slug is not null sees
    only events of artifacts that have an active page of that slug; candidates then need an artifact_id.
    """
    live = candidates.where("candidate_type = 'timeline_event' and status in ('accepted', 'applied')").join(documents.select("document_id", "title", "name"), "document_id", "left")
    c = checkpointed(live.withColumn("source", F.coalesce("title", "name")))
    fields = [c.select(F.struct("candidate_id", "created_at", F.lit(f).alias("f")).alias("doc_id"), F.col(f).alias("text")) for f in ("payload", "name", "title")]
    asks = queries.select("query_id", X.strip("text").alias("pattern"))
    met = containing(asks, union(fields)).select("query_id", "doc_id.candidate_id", "doc_id.created_at")
    if projections is None:
        # An event is met once for each field at most, so its first k lie among so many rows; the rest is cut before the shuffle.
        early = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("created_at"), "candidate_id"))
        met = met.withColumn("n", early).where(F.col("n") <= len(fields) * k)
    hit = met.select("query_id", "candidate_id").distinct().join(c, "candidate_id")
    if projections is not None:
        pages = projections.where("projection_type = 'brain_shadow_page' and status = 'active'").select("artifact_id", F.regexp_replace("projection_ref", "^slug:", "").alias("slug")).distinct()
        wanted = queries.where("slug is not null").select("query_id", F.explode(S.slug_variants(F.col("slug"))).alias("slug"))
        free = queries.where("slug is null").select("query_id")
        inside = hit.join(wanted.join(pages, "slug").select("query_id", "artifact_id").distinct(), ["query_id", "artifact_id"], "left_semi")
        hit = inside.unionByName(hit.join(free, "query_id", "left_semi").select(inside.columns))
    hit = hit.withColumn("p", X.timeline_payload("payload"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("created_at"), "candidate_id"))
    return hit.withColumn("rank", n).where(F.col("rank") <= k).select("query_id", "rank", "candidate_id", "p.date", "p.summary", "source")


def focused(content: Column, core: Column, most: int = 400) -> Column:
    """The part of a text around its core terms: the window of most characters about the term whose window holds
    the most of them, the earliest of equals; the beginning where none occurs (R51, R53)."""
    low = F.lower(content)
    starts = F.filter(F.transform(core, lambda t: F.instr(low, t)), lambda i: i > 0)
    scored = F.transform(starts, lambda i: F.struct(F.size(F.filter(core, lambda t: F.contains(F.substring(low, F.greatest(F.lit(1), i - most // 4), F.lit(most)), t))).alias("n"), (-F.greatest(F.lit(1), i - most // 4)).alias("at")))
    best = F.array_max(scored)
    return F.when(F.size(starts) == 0, F.left(content, F.lit(most))).otherwise(F.substring(content, -best["at"], F.lit(most)))


def artifact_detail(artifacts: DataFrame, projections: DataFrame, documents: DataFrame, nodes: DataFrame, wanted: DataFrame, most: int = 400) -> DataFrame:
    """query_id, artifact_id, slug, projections, document_id, content: an artifact by id, uid or slug, with the part
    of its document that the query asks for (R53, R63). wanted: query_id, key, query; an empty query takes the first node."""
    keys = artifacts.where("status = 'active'").select("artifact_id", "slug", F.explode(F.array_distinct(F.array(F.col("artifact_id").cast("string"), F.col("artifact_uid"), F.col("slug")))).alias("key"))
    own = wanted.join(keys, "key").select("query_id", "artifact_id", "slug", R.evidence_plan(F.coalesce("query", F.lit(""))).alias("core"))
    n = projections.where("status = 'active'").groupBy("artifact_id").agg(F.count("*").alias("projections"))
    docs = projected_documents(projections, documents).groupBy("artifact_id").agg(F.min("document_id").alias("document_id"))
    own = own.join(n, "artifact_id", "left").join(docs, "artifact_id", "left").fillna(0, ["projections"])
    parts = own.join(nodes.select("document_id", "node_id", "chunk_order", "content"), "document_id", "left")
    low = F.lower("content")
    rank = F.struct(F.size(F.filter("core", lambda t: F.contains(low, t))).alias("n"), (-F.col("chunk_order")).alias("o"), (-F.col("node_id")).alias("i"))
    best = parts.groupBy("query_id", "artifact_id", "slug", "projections", "document_id", "core").agg(F.max_by("content", rank).alias("content"))
    return best.select("query_id", "artifact_id", "slug", "projections", "document_id", focused(F.col("content"), F.col("core"), most).alias("content"))


def title_candidates(queries: DataFrame, artifacts: DataFrame, projections: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, artifact_uid, title, score: artifacts whose slug, names or title hold enough core terms, two
    of three or more, else one (R61).

    A term is held as a substring, part of a word or not; there is no bound on the artifacts that are looked at.
    A query whose slug is not null, if queries have one, sees only artifacts of that slug. Equal queries are asked once.
    """
    queries, dealt = R.shared(queries, tuple(c for c in ("text", "slug") if c in queries.columns))
    docs = projected_documents(projections, documents)
    a = artifacts.where("status = 'active'").join(docs, "artifact_id", "left").select("artifact_uid", "slug", F.concat_ws(" ", "slug", artifacts["name"], "title", docs["name"]).alias("text"), F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.when(F.trim(docs["name"]) != "", docs["name"]), artifacts["name"]).alias("title"))
    rows = checkpointed(a.distinct().select(F.struct("artifact_uid", "title", "slug", F.md5("text").alias("h")).alias("doc_id"), "text"))
    q = checkpointed(queries.select(*queries.columns, R.evidence_plan(F.col("text")).alias("core")))
    asks = q.select(F.struct("query_id", F.size("core").alias("n")).alias("query_id"), F.explode("core").alias("pattern"))
    # Each term is a query of its own; a text counts by how many of a query's distinct terms it holds.
    met = containing(asks, rows).groupBy("query_id", "doc_id").agg(F.count("*").alias("c")).select("query_id.*", "doc_id.*", "c")
    good = met.where(F.col("c") >= F.when(F.col("n") >= 3, 2).otherwise(1))
    if "slug" in queries.columns:
        wanted = queries.where("slug is not null").select("query_id", F.explode(S.slug_variants(F.col("slug"))).alias("slug"))
        good = good.join(wanted, ["query_id", "slug"], "left_semi").unionByName(good.join(queries.where("slug is null"), "query_id", "left_semi").select("query_id", "slug", "n", "artifact_uid", "title", "h", "c"))
    best = good.groupBy("query_id", "artifact_uid", "title").agg(F.max(F.round(F.col("c") / F.col("n"), 9)).alias("score"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "artifact_uid", "title"))
    return dealt(best.withColumn("rank", n).where(F.col("rank") <= k))


def provenance(records: DataFrame, slug: str | None = None, field: str | None = None, artifact_id: int | None = None, document_id: int | None = None) -> DataFrame:
    """Active provenance records of a page, one of its fields, an artifact or a document, the newest first."""
    out = records.where("status = 'active'")
    for c, v in (("slug", slug), ("field", field), ("artifact_id", artifact_id), ("document_id", document_id)):
        out = out if v is None else out.where(F.col(c) == v)
    return out.orderBy(F.desc("created_at"), "provenance_id")


def query_confidence(hits: Column, candidates: Column, matched: Column, core: Column, fell_back: Column) -> Column:
    """none, low, high or medium, from hits, title candidates, matched and core terms, and whether a fallback served."""
    need = F.least(F.lit(2), core)
    return X.ladder([(hits == 0, "none"), (candidates > 0, "low"), ((need > 0) & (matched >= need) & ~fell_back, "high")], "medium")


def limit_of(asked: int | None, default: int = 10, most: int = 200) -> int:
    """A limit that was asked for: the default if there is none or none above zero, at most so many."""
    return min(default if asked is None or asked <= 0 else asked, most)


def throttled(calls: DataFrame, per_second: int) -> DataFrame:
    """calls (scope, id, at) plus allowed: the first so many of a scope's second pass."""
    n = F.row_number().over(Window.partitionBy("scope", F.date_trunc("second", "at")).orderBy("at", "id"))
    return calls.withColumn("allowed", n <= per_second)


def remembered(queries: DataFrame, search: Callable[[DataFrame], DataFrame], folder: str, as_of: Column, ttl: float = 30.0) -> DataFrame:
    """What search finds for queries, taken from the folder's table where it is known and no older than ttl seconds.

    queries: query_id, key and what search reads; queries of one key have one answer. search gets one open query of
    each key and returns rows with query_id. Answers are appended with their key and as_of, those without rows as
    well, so that they are not asked again; of several answers the newest counts. Returns query_id, fresh (asked now)
    and the search's columns, all null for no rows.
    """
    spark = queries.sparkSession
    asked = checkpointed(queries)
    shape = search(asked.limit(0)).drop("query_id").schema
    stored = StructType([StructField("key", asked.schema["key"].dataType), StructField("made_at", TimestampType()), StructField("found", StructType(shape.fields))])
    spark.createDataFrame([], stored).write.mode("append").parquet(folder)
    known = spark.read.schema(stored).parquet(folder).where((F.col("made_at") <= as_of) & (F.unix_timestamp(as_of) - F.unix_timestamp("made_at") <= ttl))
    newest = known.groupBy("key").agg(F.max("made_at").alias("made_at"))
    held = checkpointed(known.join(newest, ["key", "made_at"]).join(asked.select("key").distinct(), "key", "left_semi").select("key", "found"))
    n = F.row_number().over(Window.partitionBy("key").orderBy("query_id"))
    one = asked.join(held.select("key").distinct(), "key", "left_anti").withColumn("__n", n).where("__n = 1").drop("__n")
    one = checkpointed(one)
    rows = search(one).withColumn("found", F.struct(*shape.names)).select("query_id", "found")
    made = checkpointed(one.select("query_id", "key").join(rows, "query_id", "left").select("key", "found"))
    made.select("key", as_of.cast("timestamp").alias("made_at"), "found").write.mode("append").parquet(folder)
    every = held.withColumn("fresh", F.lit(False)).union(made.withColumn("fresh", F.lit(True)))
    return handed_out(asked.select("query_id", "key"), every).select("query_id", "fresh", "found.*")


#: Most parts of a key's answers that queries are sent to; rows of the result for which a task is worth while.
PARTS, TASK_ROWS = 32, 1 << 21


def handed_out(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, fresh, found: the answers (key, found, fresh) of every query's key, however few keys there are.

    A key's answers are dealt in parts over the tasks, each part with all queries of the key, so that a task's share of
    the result follows neither the keys nor the bytes read. A query goes to no more parts than an eighth of the rows
    that one gets.
    """
    spark = asked.sparkSession
    times = asked.groupBy("key").agg(F.count("*").alias("q")).join(answers.groupBy("key").agg(F.count("*").alias("n")), "key")
    queries, rows = times.agg(F.sum("q"), F.sum(F.col("q").cast("double") * F.col("n"))).first()
    cores, most = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = int(max(cores, min(most, (rows or 0) / TASK_ROWS)))
    parts = int(max(1, min(tasks, PARTS, (rows or 0) / (8 * (queries or 1)))))
    dealt = answers.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).repartition(tasks, "key", "part")
    sent = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, "key", "part")
    return sent.join(dealt, ["key", "part"]).select("query_id", "fresh", "found")


def forget(spark: SparkSession, folder: str, to: str, as_of: Column, ttl: float = 30.0, most: int = 200) -> None:
    """Write what may still be asked for to another folder: answers no older than ttl seconds, of the newest so many keys."""
    known = spark.read.parquet(folder).where(F.unix_timestamp(as_of) - F.unix_timestamp("made_at") <= ttl)
    keys = known.groupBy("key").agg(F.max("made_at").alias("made_at")).orderBy(F.desc("made_at"), "key").limit(most)
    known.join(keys, ["key", "made_at"], "left_semi").select(known.columns).write.parquet(to)


def with_history(turns: DataFrame, window: int = 4) -> DataFrame:
    """turns (conv_id, turn, role, text) plus history: the turns just before, the input of a query rewriter."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-window, -1)
    return turns.withColumn("history", F.collect_list(F.concat_ws(": ", "role", "text")).over(w))


def rewritten(turns: DataFrame, rewriter: Callable[[DataFrame], DataFrame], window: int = 4) -> DataFrame:
    """turns plus query: what the rewriter makes of a turn and its history, else the turn itself.

    rewriter gets conv_id, turn, text, history and returns conv_id, turn, query.
    """
    made = rewriter(with_history(turns, window).select("conv_id", "turn", "text", "history")).select("conv_id", "turn", F.col("query").alias("__q"))
    return turns.join(made, ["conv_id", "turn"], "left").withColumn("query", F.coalesce(F.when(F.trim("__q") != "", F.col("__q")), F.col("text"))).drop("__q")


def expanded(queries: DataFrame, expander: Callable[[DataFrame], DataFrame], most: int = 2) -> DataFrame:
    """query_id, variant, text: each query and the cleaned alternatives that the expander offers.

    expander gets query_id and a text fit for a prompt, and returns query_id, alternatives.
    """
    offered = expander(queries.select("query_id", X.sanitize_prompt("text").alias("text"))).select("query_id", F.posexplode(X.sanitize_expansions("alternatives", most)).alias("i", "text"))
    return queries.select("query_id", F.lit(0).alias("variant"), "text").union(offered.select("query_id", F.col("i") + 1, "text"))

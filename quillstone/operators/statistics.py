"""Counts, coverage and health over the stored tables; filters and small rules beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillstone.functions import text as X


def type_counts(pages: DataFrame, kind: str) -> DataFrame:
    return pages.groupBy(kind).agg(F.count("*").alias("n"))


def health(pages: int | Column, embedded: Column, linked: Column, dated: Column, fresh: Column, orphans: Column) -> Column:
    """Weighted health: 35, 25, 15, 15 and 10 hundredths (A2)."""
    part = lambda c: F.when(pages == 0, 0.0).otherwise(c / pages)
    return F.round(0.35 * part(embedded) + 0.25 * part(linked) + 0.15 * part(dated) + 0.15 * part(fresh) + 0.10 * (1 - part(orphans)), 4)


def most_connected(edges: DataFrame, k: int = 5) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def checks(**orphans: DataFrame) -> DataFrame:
    """check, n, status of named sets of rows that should be empty."""
    out = None
    for name, df in orphans.items():
        row = df.agg(F.lit(name).alias("check"), F.count("*").alias("n")).withColumn("status", F.when(F.col("n") == 0, "ok").otherwise("warning"))
        out = row if out is None else out.union(row)
    return out


def library_stats(libraries: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts of documents and nodes per library, 0 where there are none."""
    d = documents.groupBy("library_id").agg(F.count("*").alias("documents"))
    n = nodes.groupBy("library_id").agg(F.count("*").alias("nodes"))
    return libraries.join(d, "library_id", "left").join(n, "library_id", "left").fillna(0, ["documents", "nodes"])


def document_frequency(tokens: DataFrame, doc: str, term: str, least: int = 10, share: float = 0.3, chars: int = 2) -> DataFrame:
    """term, df of terms in at least so many and at most a share of the documents."""
    df = tokens.select(doc, term).distinct().groupBy(term).agg(F.count("*").alias("df"))
    n = tokens.agg(F.count_distinct(doc).alias("n"))
    return df.withColumn("n", n.scalar()).where((F.col("df") >= least) & (F.col("df") <= F.floor(F.col("n") * share)) & (F.length(term) >= chars)).select(term, "df")


def mentions(backlinks: DataFrame, hits: DataFrame) -> DataFrame:
    """slug, n: distinct pages that link to it or name it, itself left out."""
    return backlinks.select("slug", "page").union(hits.select("slug", "page")).where("slug <> page").groupBy("slug").agg(F.count_distinct("page").alias("n"))


def ocr_status(pages: DataFrame) -> DataFrame:
    """document_id, status, coverage from pages (document_id, needed, state)."""
    g = pages.where("needed").groupBy("document_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("state") == s).alias(s) for s in ("done", "failed", "processing")))
    every = pages.select("document_id").distinct().join(g, "document_id", "left")
    status = X.ladder([(F.col("total").isNull(), "not_needed"), (F.col("processing") > 0, "processing"), (F.col("done") == F.col("total"), "done"), (F.col("failed") == F.col("total"), "failed"), (F.col("done") > 0, "partial")], "needed")
    return every.select("document_id", status.alias("status"), F.coalesce(F.col("done") / F.col("total"), F.lit(1.0)).alias("coverage"))


def ocr_segments(pages: DataFrame, most: int) -> DataFrame:
    """document_id, first_page, last_page: runs of consecutive pages, at most so many each."""
    w = Window.partitionBy("document_id").orderBy("page")
    runs = pages.select("document_id", "page").distinct().withColumn("island", F.col("page") - F.row_number().over(w))
    k = F.row_number().over(Window.partitionBy("document_id", "island").orderBy("page"))
    parts = runs.withColumn("part", F.floor((k - 1) / most))
    return parts.groupBy("document_id", "island", "part").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")).select("document_id", "first_page", "last_page")


def needs_ocr(chars: Column, image_area: Column, images: Column, density: int = 50, area: float = 0.5, count: int = 3) -> Column:
    """Pages with little text, or much image."""
    return (chars < density) | (image_area > area) | (images >= count)


def merge_recognised(native: Column, recognised: Column, alike: float = 0.8) -> Column:
    """The recognised text, the native one, or both, by how alike they are."""
    similarity = X.jaccard(X.unpadded_trigrams(native), X.unpadded_trigrams(recognised))
    return F.when(F.coalesce(X.strip(native), F.lit("")) == "", recognised).when(F.coalesce(X.strip(recognised), F.lit("")) == "", native).when(similarity >= alike, F.when(F.length(native) >= F.length(recognised), native).otherwise(recognised)).otherwise(F.concat_ws("\n", native, recognised))


def granularity(ext: Column, chars: Column, pages: Column) -> Column:
    """table, large, medium, small or micro."""
    return X.ladder([(F.lower(ext).isin("csv", "tsv", "xls", "xlsx"), "table"), ((chars > 30_000) | (pages > 30), "large"), (chars > 3_000, "medium"), (chars > 800, "small")], "micro")


def chunk_strategy(kind: Column) -> Column:
    return X.ladder([(kind == "table", "rows"), (kind == "large", "hierarchical"), (kind == "medium", "sections"), (kind == "small", "paragraphs")], "whole")


def modality(ext: Column) -> Column:
    """text, table, image, audio or code by extension."""
    e = F.lower(ext)
    return X.ladder([(e.isin("csv", "tsv", "xls", "xlsx"), "table"), (e.isin("png", "jpg", "jpeg", "gif", "webp", "svg"), "image"), (e.isin("mp3", "wav", "m4a"), "audio"), (e.isin("rs", "py", "ts", "js", "go", "java", "c", "cpp"), "code")], "text")


def route(ext: Column, intent: Column) -> Column:
    """Where an upload goes: page, knowledge base, or both."""
    return X.ladder([(intent == "page", "page"), (intent == "document", "kb"), (F.lower(ext).isin("md", "markdown"), "page"), (F.lower(ext).isin("txt", "html"), "both")], "kb")


def valid_slug(c: Column) -> Column:
    """Lower-case segments of letters, digits and hyphens, without empty or dotted parts."""
    return c.rlike(r"^[a-z0-9][a-z0-9_-]*(/[a-z0-9][a-z0-9_-]*)*$") & (F.length(c) <= 255)


def valid_file_name(c: Column) -> Column:
    return ~c.rlike(r"[/\\\x00-\x1f]") & ~c.isin("", ".", "..") & (F.octet_length(c) <= 255)


def slug_variants(c: Column) -> Column:
    """A slug with and without its prefixes."""
    bare = F.regexp_replace(c, "^slug:", "")
    return F.array_distinct(F.array(bare, F.concat(F.lit("documents/"), F.regexp_replace(bare, "^documents/", "")), F.regexp_replace(bare, "^documents/", "")))


def list_pages(pages: DataFrame, page_type: str | None = None, tagged: DataFrame | None = None, updated_after: Column | None = None, prefix: str | None = None, deleted: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    """Filtered pages, newest first, one page of them."""
    p = pages if deleted else pages.where("deleted_at is null")
    if page_type is not None:
        p = p.where(F.col("page_type") == page_type)
    if updated_after is not None:
        p = p.where(F.col("updated_at") > updated_after)
    if prefix is not None:
        p = p.where(F.col("slug").startswith(prefix))
    if tagged is not None:
        p = p.join(tagged.select("page_id"), "page_id", "left_semi")
    return p.orderBy(F.desc("updated_at"), "page_id").offset(offset).limit(limit)


def active_nodes(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Nodes of the current version of documents that are live and indexed."""
    live = documents.where("deleted_at is null and index_status = 'ready'").select("document_id", F.col("current_version_id").alias("version_id"))
    return nodes.join(live, ["document_id", "version_id"], "left_semi")


def stale_chunks(chunks: DataFrame, embeddings: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks without a vector, or with one older than their page."""
    e = chunks.join(embeddings.select("chunk_id", "embedded_at"), "chunk_id", "left").join(pages.select("page_id", "updated_at"), "page_id")
    return e.where("embedded_at is null or embedded_at < updated_at")


def in_ids(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select(column), column, "left_semi")


def index_groups(libraries: DataFrame, indexes: DataFrame) -> DataFrame:
    """model, dimensions, libraries of the active indexes."""
    return libraries.join(indexes.where("is_active"), "library_id").groupBy("model", "dimensions").agg(F.array_sort(F.collect_set("library_id")).alias("libraries"))


def best_resolution(resolved: DataFrame) -> DataFrame:
    """Of all resolvers' answers the surest per slug."""
    return resolved.groupBy("query_id", "slug").agg(F.max("confidence").alias("confidence"), F.max_by("resolver", F.struct("confidence", "resolver")).alias("resolver"))

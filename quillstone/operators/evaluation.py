"""Ranking quality: precision, recall, reciprocal rank, discounted gain, summaries, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, qrels: DataFrame, k: int = 5, empty_is_perfect: bool = False, cutoff_rr: bool = False) -> DataFrame:
    """query_id, precision, recall, rr, ndcg from (query_id, doc_id, rank) and (query_id, doc_id).

    Precision divides by k. Queries without relevant documents have recall 0, or 1 if empty_is_perfect;
    the reciprocal rank looks at all ranks unless cutoff_rr.
    """
    rel = qrels.select("query_id", "doc_id").where("doc_id is not null").distinct()
    marked = ranked.join(rel.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    in_k = F.col("rank") <= k
    got = marked.groupBy("query_id").agg(
        F.sum(F.when(in_k, F.col("hit")).otherwise(0)).alias("hits"),
        F.min(F.when((F.col("hit") == 1) & (in_k if cutoff_rr else F.lit(True)), F.col("rank"))).alias("first"),
        F.sum(F.when(in_k & (F.col("hit") == 1), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    want = rel.groupBy("query_id").agg(F.count("*").alias("relevant"))
    queries = qrels.select("query_id").distinct()
    q = queries.join(want, "query_id", "left").join(got, "query_id", "left").fillna({"relevant": 0, "hits": 0, "dcg": 0.0})
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    none = F.col("relevant") == 0
    blank = F.lit(1.0 if empty_is_perfect else 0.0)
    return q.select(
        "query_id", (F.col("hits") / k).alias("precision"), F.when(none, blank).otherwise(F.col("hits") / F.col("relevant")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.when(none, blank).otherwise(F.col("dcg") / ideal).alias("ndcg"),
    )


def summary(metrics: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """Means over queries, and the 95th percentile of latency_ms by the ceiling index."""
    out = metrics.agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in ("precision", "recall", "rr", "ndcg")))
    if latencies is None:
        return out
    n = latencies.agg(F.sort_array(F.collect_list("latency_ms")).alias("l"))  # one number per evaluated query
    return out.join(n.select(F.element_at("l", F.greatest(F.lit(1), F.ceil(0.95 * F.size("l")).cast("int"))).alias("p95_ms")))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query the second's metrics less the first's."""
    m = ("precision", "recall", "rr", "ndcg")
    return a.alias("a").join(b.alias("b"), "query_id").select("query_id", *((F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"{c}_delta") for c in m))

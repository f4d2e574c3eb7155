"""A chain of searches in which each step is asked only what the steps before left open."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import checkpointed

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


class Cascade(NamedTuple):
    """hits: rows of each query's closing stage; attempts: query_id, stage, stage_name, hits; rest: rows that closed no query."""

    hits: DataFrame
    attempts: DataFrame
    rest: DataFrame


def cascade(queries: DataFrame, stages: list[Stage], answered: Callable[[DataFrame], DataFrame] | None = None, first: int = 1) -> Cascade:
    """A chain of fallbacks.

    queries: query_id and what stages read, one row per query. A stage gets the open queries and returns
    rows with query_id; all return the same columns. A query is closed by its rows, or where answered is
    given by those it returns of them (query_id). Rows carry stage, counted from first, and stage_name.
    attempts has a row for every stage that a query was asked in. The chain ends when no query is open.
    """
    queries = checkpointed(queries)
    hits, attempts, rest = [], [], []
    for number, (name, find) in enumerate(stages, first):
        found = checkpointed(find(queries))
        mark = lambda df: df.withColumn("stage", F.lit(number)).withColumn("stage_name", F.lit(name))  # noqa: B023, E731
        closed = (found if answered is None else answered(found)).select("query_id").distinct()
        if answered is not None:
            closed = checkpointed(closed)
            rest.append(mark(found.join(closed, "query_id", "left_anti")))
            found = found.join(closed, "query_id", "left_semi")
        hits.append(mark(found))
        n = (found if answered is None else union([found, rest[-1].select(found.columns)])).groupBy("query_id").agg(F.count("*").alias("hits"))
        attempts.append(mark(queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"))).select("query_id", "stage", "stage_name", "hits"))
        queries = checkpointed(queries.join(closed, "query_id", "left_anti"))
        if queries.isEmpty():
            break
    every = union(hits)
    return Cascade(every, union(attempts), union(rest) if rest else every.limit(0))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

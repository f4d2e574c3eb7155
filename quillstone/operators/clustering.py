"""Centroids, k-means, summary trees and synonym mining over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillstone.operators.cascade import union
from quillstone.operators.vectors import BLOCK, VectorIndex, exact_neighbours, packed, search_index
from quillstone.session import checkpointed


def mean_vector(vectors: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """key, pos, mean: element-wise means."""
    return vectors.select(key, F.posexplode(embedding).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def cluster_count(nodes: Column, size: int = 5) -> Column:
    """max(2, floor(sqrt(nodes / size)))."""
    return F.greatest(F.lit(2), F.floor(F.sqrt(nodes / size)))


def kmeans(vectors: DataFrame, k: int, seed: int = 42, iterations: int = 100) -> DataFrame:
    """vec_id, cluster by distributed k-means.

    A round hands results of every task to the driver, up to iterations times; so vectors are read by no more tasks than
    there are cores, however many files or splits they come in.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    few = data.coalesce(vectors.sparkSession.sparkContext.defaultParallelism)
    model = KMeans(k=k, maxIter=iterations, tol=1e-4, seed=seed).fit(few)
    return model.transform(data).select("vec_id", F.col("prediction").alias("cluster"))


#: Vectors of a group among which first centres are looked for, if four times its clusters are fewer; least move of a centre that counts.
SEEDS, MOVED = 512, 1e-4
#: Numbers in the centres of all groups up to which they are sent to every task; with more of them blocks are shuffled to their centres.
SENT = 1 << 21


def first_centres(vectors: DataFrame, size: int, seed: int) -> DataFrame:
    """(cell, cluster, centre) of every group: as many vectors as it is to have clusters, each the farthest from those before.

    They are looked for among a sample of a group's vectors, in the order of a hash of their ids, whose size grows with the
    square root of the group's: SEEDS, or four times the clusters.
    """
    counts = vectors.groupBy("cell").agg(F.count("*").alias("n")).withColumn("k", cluster_count(F.col("n"), size).cast("int"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    some = vectors.join(counts, "cell").withColumn("__p", place).where(F.col("__p") <= F.greatest(F.lit(SEEDS), 4 * F.col("k")))
    kind = vectors.schema["cell"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__p")
        m = np.array(pdf["v"].tolist(), float)
        picked, near = [0], ((m - m[0]) ** 2).sum(1)
        while len(picked) < min(int(pdf["k"].iloc[0]), len(m)) and near.max() > 0:
            picked.append(int(near.argmax()))
            near = np.minimum(near, ((m - m[picked[-1]]) ** 2).sum(1))
        return pd.DataFrame({"cell": pdf["cell"].iloc[0], "cluster": range(len(picked)), "centre": [m[i] for i in picked]})

    return some.groupBy("cell").applyInPandas(run, f"cell {kind}, cluster int, centre array<double>")


def grouped_kmeans(vectors: DataFrame, size: int = 5, seed: int = 42, rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """(cell, id, cluster) and (cell, cluster, centre): k-means inside every group at once.

    vectors: cell, id, v. Blocks of a group's vectors meet its centres, wherever they lie; what a task hands on is a sum
    per cluster, so a large group is split over tasks and a round shuffles as much as the centres take, not the vectors.
    Rounds end when no centre of any group moves.
    """
    data = F.pandas_udf("binary")(as_bytes)
    blocks = checkpointed(packed(vectors.select("cell", "id", data(F.col("v").cast("array<double>")).alias("data")), BLOCK))
    now = checkpointed(first_centres(vectors, size, seed))
    sent = (now.agg(F.sum(F.size("centre"))).first()[0] or 0) <= SENT
    added = F.aggregate(F.slice("totals", 2, F.size("totals")), F.get("totals", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    for _ in range(rounds):
        sums = met(blocks, now, True, sent).groupBy("cell", "cluster").agg(F.collect_list("total").alias("totals"), F.sum("n").alias("n"))
        means = sums.select("cell", "cluster", F.transform(added, lambda x: x / F.col("n")).alias("mean"))
        moved = checkpointed(now.join(means, ["cell", "cluster"], "left").select("cell", "cluster", F.coalesce("mean", "centre").alias("centre"), F.col("centre").alias("before")))
        far = moved.agg(F.max(F.array_max(F.zip_with("centre", "before", lambda a, b: F.abs(a - b))))).first()[0] or 0
        now = moved.select("cell", "cluster", "centre")
        if far < MOVED:
            break
    return met(blocks, now, False, sent), now


def as_bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda x: np.asarray(x, np.float64).tobytes())


def met(blocks: DataFrame, now: DataFrame, summed: bool, sent: bool) -> DataFrame:
    """Blocks with their group's centres: (cell, id, cluster), or summed in each task (cell, cluster, total, n); sent: the centres go to all blocks."""
    centres = now.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("c"))
    pairs = blocks.join(F.broadcast(centres) if sent else centres, "cell").select("cell", "ids", "data", "c.cluster", F.flatten("c.centre").alias("flat"))
    cell, one = (pairs.schema[c].dataType for c in ("cell", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in range(batch.num_rows):
                group, ids, data, names, flat = (batch.column(c)[row] for c in range(5))
                m = np.frombuffer(data.as_py(), np.float64).reshape(len(ids), -1)
                c = flat.values.to_numpy(zero_copy_only=False).reshape(len(names), -1)
                at = ((c * c).sum(1) / 2 - m @ c.T).argmin(1)
                named = names.values.to_numpy(zero_copy_only=False)
                if not summed:
                    yield pa.RecordBatch.from_arrays([pa.array([group.as_py()] * len(ids), group.type), ids.values, pa.array(named[at], pa.int32())], names=["cell", "id", "cluster"])
                    continue
                n, total = np.bincount(at, minlength=len(c)), np.stack([np.bincount(at, m[:, d], len(c)) for d in range(m.shape[1])], 1)
                if held and held[0].equals(group):
                    held[2][:] += n
                    held[3][:] += total
                    continue
                if held:
                    yield handed_on(*held)
                held = group, named, n, total
        if held:
            yield handed_on(*held)

    def handed_on(group: pa.Scalar, named: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        own = np.flatnonzero(n)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * total.shape[1], pa.int32()), pa.array(total[own].ravel()))
        columns = [pa.array([group.as_py()] * len(own), group.type), pa.array(named[own], pa.int32()), sums, pa.array(n[own], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["cell", "cluster", "total", "n"])

    shape = "cluster int, total array<double>, n long" if summed else f"id {one.elementType.simpleString()}, cluster int"
    return pairs.mapInArrow(run, f"cell {cell.simpleString()}, {shape}")


def summary_tree(nodes: DataFrame, size: int = 5, least: int = 3, levels: int = 2, seed: int = 42) -> DataFrame:
    """document_id, level, node, parent, content: nodes clustered level by level, all documents at once.

    nodes: document_id, node, content, embedding, of one length in a document; nodes without one stay as they are. A
    parent's text joins its children's in the order of their numbers, where a language model would write a summary; its
    vector is their mean. A document with fewer than least nodes on a level goes no higher. Parents are numbered on
    from a document's largest node; the topmost have the parent -1.
    """
    now = checkpointed(nodes.select("document_id", F.lit(0).alias("level"), F.col("node").cast("long").alias("node"), "content", F.col("embedding").cast("array<double>").alias("v")))
    done = []
    for level in range(1, levels + 1):
        many = now.where("v is not null").groupBy("document_id").agg(F.count("*").alias("n")).where(F.col("n") >= max(least, 2)).select("document_id")
        ready = checkpointed(now.where("v is not null").join(many, "document_id", "left_semi"))
        if ready.isEmpty():
            break
        at, centres = grouped_kmeans(ready.select(F.col("document_id").alias("cell"), F.col("node").alias("id"), "v"), size, seed)
        at = checkpointed(at.withColumnsRenamed({"cell": "document_id", "id": "node"}))
        last = now.groupBy("document_id").agg(F.max("node").alias("last"))
        order = F.row_number().over(Window.partitionBy("document_id").orderBy("cluster"))
        named = at.select("document_id", "cluster").distinct().withColumn("o", order).join(last, "document_id").select("document_id", "cluster", (F.col("last") + F.col("o")).alias("parent"))
        joined = checkpointed(now.join(at, ["document_id", "node"], "left").join(named, ["document_id", "cluster"], "left"))
        done.append(joined.select("document_id", "level", "node", F.coalesce("parent", F.lit(-1).cast("long")).alias("parent"), "content"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "content"))), lambda x: x["content"]), "\n\n")
        made = joined.where("parent is not null").groupBy("document_id", F.col("parent").alias("node"), "cluster").agg(text.alias("content"))
        vectors = centres.select(F.col("cell").alias("document_id"), "cluster", F.col("centre").alias("v"))
        now = checkpointed(made.join(vectors, ["document_id", "cluster"]).select("document_id", F.lit(level).alias("level"), "node", "content", "v"))
    done.append(now.select("document_id", "level", "node", F.lit(-1).cast("long").alias("parent"), "content"))
    return union(done)


def similar_tokens(tokens: DataFrame, k: int = 6, least: float = 0.75, index: VectorIndex | None = None) -> DataFrame:
    """token, synonym, score: nearest other tokens that do not hold each other.

    Every token is asked for, so neither side passes through the driver: blocks of both meet, or with an index of
    the tokens' vectors only what lies in near cells.
    """
    t, v = tokens.select(F.col("vec_id").alias("query_id"), "embedding"), tokens.select("vec_id", "embedding")
    near = (exact_neighbours(t, v, k + 1) if index is None else search_index(t, index, v, k + 1)).where("query_id <> vec_id")
    name = tokens.select("vec_id", "token")
    pairs = near.join(name.select(F.col("vec_id").alias("query_id"), F.col("token").alias("a")), "query_id").join(name.withColumnRenamed("token", "b"), "vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    pairs = pairs.withColumn("n", rank).where((F.col("n") <= k) & (F.col("score") >= least) & ~F.contains("a", "b") & ~F.contains("b", "a"))
    return pairs.select(F.col("a").alias("token"), F.col("b").alias("synonym"), "score")


def mine_synonyms(pairs: DataFrame, most: int = 5) -> DataFrame:
    """Pairs both ways, the best so many rows per token, then repeats dropped."""
    both = pairs.select("token", "synonym", "score").unionAll(pairs.select(F.col("synonym").alias("token"), F.col("token").alias("synonym"), "score"))
    n = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "synonym"))
    return both.withColumn("n", n).where(F.col("n") <= most).groupBy("token", "synonym").agg(F.max("score").alias("score"))


def synonyms_of(tokens: DataFrame, synonyms: DataFrame, most: int = 3) -> DataFrame:
    """The best synonyms of each asked token."""
    n = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "synonym"))
    return synonyms.join(tokens.select("token").distinct(), "token", "left_semi").withColumn("n", n).where(F.col("n") <= most).drop("n")


def hash_embedding(texts: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """key, embedding: signed hashed words, unit length; the offline stand-in for a model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for pdf in batches:
            out = []
            for t in pdf[text]:
                v = np.zeros(size, np.float32)
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % size] += 1 if h >> 16 & 1 else -1
                n = np.sqrt((v * v).sum())
                out.append(v / n if n else v)
            yield pd.DataFrame({key: pdf[key], "embedding": out})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")

"""Nearest vectors at scale: an index of coarse cells with residual codes, and exact search in blocks.

The index is a table of blocks, partitioned by cell: ids of up to BLOCK vectors, and a byte per few
dimensions of what each differs from its cell's centre. A search reads the cells nearest to some query
and nothing else of the folder, restores approximate vectors, multiplies them with blocks of queries, and
compares the best of these exactly. Neither vectors nor queries pass through the driver; only the bounded
sample on which centres and codes are fitted does, and the numbers of the cells that queries ask for.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators.retrieval import top_k
from quillstone.session import spread

#: Vectors of a block, queries of a block, dimensions of a code, values of a code.
BLOCK, QUERIES, WIDTH, CODES = 1024, 512, 4, 256
#: Vectors on which centres and codes are fitted, rounds, and the most cells.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 12, 1024
#: Bytes of a block of whole vectors, its most and its least rows; queries and vectors of it that are multiplied at once.
EXACT_BYTES, EXACT_ROWS, LEAST_ROWS, TILE = 4 << 20, 4096, 256, (256, 2048)
#: Rows on which the number of probed cells is measured, and the share of neighbours that they must find.
TRIED, FOUND = 256, 0.97


def unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(-1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def centres(m: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k means of rows, beginning with rows far from those already taken; centres without rows stay where they are."""
    r = np.random.default_rng(seed)
    c = m[r.choice(len(m), min(k, len(m)), replace=False)].astype(np.float32)
    for _ in range(ROUNDS):
        at = nearest(m, c)
        n = np.bincount(at, minlength=len(c))
        for d in range(m.shape[1]):
            s = np.bincount(at, m[:, d], len(c))
            c[:, d] = np.where(n > 0, s / np.maximum(n, 1), c[:, d])
    return c


def nearest(m: np.ndarray, c: np.ndarray, step: int = 8192) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(m[k : k + step] @ c.T - half).argmax(1) for k in range(0, len(m), step)] or [np.zeros(0, np.int64)])


class Model(NamedTuple):
    """centres: cells x dimensions; codes: groups of WIDTH dimensions x CODES x WIDTH; probes: cells that a search reads."""

    centres: np.ndarray
    codes: np.ndarray
    probes: int

    def encode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(m, self.centres)
        parts = self.split(m - self.centres[cell])
        return cell, np.stack([nearest(parts[g], self.codes[g]) for g in range(len(self.codes))], 1).astype(np.uint8)

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        own = self.codes[np.arange(len(self.codes)), codes]
        return self.centres[cell] + own.reshape(len(codes), -1)[:, : self.centres.shape[1]]

    def split(self, m: np.ndarray) -> np.ndarray:
        groups = -(-m.shape[1] // WIDTH)
        full = np.zeros((len(m), groups * WIDTH), np.float32)
        full[:, : m.shape[1]] = m
        return full.reshape(len(m), groups, WIDTH).transpose(1, 0, 2)


def enough_probes(m: np.ndarray, c: np.ndarray, share: float = FOUND, k: int = 10) -> int:
    """The least number of cells whose reading finds the share of the k nearest rows, measured on TRIED rows.

    Vectors that lie in groups need few cells, vectors without any structure need most of them.
    """
    tried = m[:: max(1, len(m) // TRIED)][:TRIED]
    far = (c * c).sum(1) / 2 - tried @ c.T
    place = np.argsort(np.argsort(far, 1), 1)
    near = np.argpartition(-(tried @ m.T), min(k, len(m) - 1), 1)[:, : k + 1]
    order = np.sort(np.take_along_axis(place, nearest(m, c)[near], 1).ravel())
    return int(order[min(len(order) - 1, int(np.ceil(share * len(order))))]) + 1


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Model:
    """Centres and codes of unit vectors (vec_id, embedding), from at most sample rows, chosen by a hash of their ids.

    Vectors whose length is not the sample's commonest are in no index.
    """
    rows = vectors.where("size(embedding) > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    sizes = [len(r.embedding) for r in rows]
    width = max(set(sizes), key=lambda n: (sizes.count(n), n), default=1)
    m = unit(np.array([r.embedding for r in rows if len(r.embedding) == width], np.float32).reshape(-1, width))
    if not len(m):
        return Model(np.zeros((1, width), np.float32), np.zeros((-(-width // WIDTH), 1, WIDTH), np.float32), 1)
    c = centres(m, cells or max(1, min(MOST_CELLS, int(len(m) ** 0.5))))
    probes = enough_probes(m, c)
    rest = Model(c, np.zeros((0, 0, WIDTH), np.float32), probes).split(m - c[nearest(m, c)])
    return Model(c, np.stack([centres(part, min(CODES, len(m))) for part in rest]), probes)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column that have the width, as a matrix of unit vectors, and which they are."""
    own = np.flatnonzero(np.array([x is not None and len(x) == width for x in column.to_pylist()], bool))
    flat = column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
    return unit(np.asarray(flat, np.float32).reshape(len(own), width)), own


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(cell, id, data) to (cell, ids, data): rows of one cell, at most size in a block; a large cell lies in many tasks."""
    of, kind = (rows.schema[c].dataType.simpleString() for c in ("cell", "id"))
    names = ["cell", "ids", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, data = None, [], []
        for batch in batches:
            out = []
            for c, i, d in zip(*(batch.column(k) for k in range(3))):
                if len(ids) == size or ids and c.as_py() != cell:
                    out.append((cell, ids, b"".join(data)))
                    ids, data = [], []
                cell = c.as_py()
                ids.append(i.as_py())
                data.append(d.as_py())
            if out:
                yield block(out, batch.schema)
            last = batch.schema
        if ids:
            yield block([(cell, ids, b"".join(data))], last)

    def block(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        c, i, d = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(0).type), pa.array(i, pa.list_(schema.field(1).type)), pa.array(d, pa.binary())], names=names)

    dealt = rows.hint("rebalance", F.col("cell")).sortWithinPartitions("cell")
    return dealt.select("cell", "id", "data").mapInArrow(run, f"cell {of}, ids array<{kind}>, data binary")


class VectorIndex(NamedTuple):
    folder: str
    model: Model


def build_index(vectors: DataFrame, folder: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Write every vector (vec_id, embedding) of the model's width into the folder's blocks, by cell."""
    model = fit(vectors, cells, sample)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            m, at = matrix(batch.column(1), own.centres.shape[1])
            cell, codes = own.encode(m)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0).take(pa.array(at)), pa.array([x.tobytes() for x in codes], pa.binary())], names=["cell", "id", "data"])

    rows = spread(vectors.select("vec_id", "embedding"), "vec_id").mapInArrow(run, f"cell int, id {kind}, data binary")
    packed(rows, BLOCK).write.partitionBy("cell").parquet(f"{folder}/blocks")
    file = io.BytesIO()
    np.savez(file, centres=model.centres, codes=model.codes, probes=model.probes)
    vectors.sparkSession.createDataFrame([(bytearray(file.getvalue()),)], "model binary").coalesce(1).write.parquet(f"{folder}/model")
    return VectorIndex(folder, model)


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    file = np.load(io.BytesIO(bytes(spark.read.parquet(f"{folder}/model").first()[0])))
    return VectorIndex(folder, Model(file["centres"], file["codes"], int(file["probes"])))


def asked_cells(queries: DataFrame, model: Model, probes: int) -> DataFrame:
    """(cell, id, data): each query's unit vector, once for each of the cells whose centres are nearest to it."""
    shared = queries.sparkSession.sparkContext.broadcast(model)
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value.centres
        n = min(probes, len(c))
        for batch in batches:
            m, at = matrix(batch.column(1), c.shape[1])
            far = (c * c).sum(1) / 2 - m @ c.T
            best = np.argpartition(far, n - 1, 1)[:, :n]
            yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int32)), batch.column(0).take(pa.array(np.repeat(at, n))), pa.array([x.tobytes() for x in np.repeat(m, n, 0)], pa.binary())], names=["cell", "id", "data"])

    return queries.select("query_id", "embedding").mapInArrow(run, f"cell int, id {kind}, data binary")


def places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask that is mostly empty, eight at a time."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    return (some[:, None] * 8 + np.arange(8))[flat.reshape(-1, 8)[some]]


class Nearest:
    """The k best rows of each query of a block, over all blocks of vectors that it met; of equals those of the least ids.

    What is under a query's k-th best so far is dropped by one comparison, on products of single precision with a margin
    over their error; only the rest is multiplied again in double precision and sorted.
    """

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int, exact: bool):
        self.q_ids, self.q, self.k, self.exact = q_ids, q, k, exact
        self.fast = q[:, :-1].astype(np.float32) if exact else q
        self.margin = (q.shape[1] + 8) * 2.0**-22 if exact else 0.0
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(q), -np.inf, np.float32)

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        """v: whole vectors with their lengths behind them, or, if not exact, approximate ones."""
        fast = np.ascontiguousarray((v[:, :-1] if self.exact else v).astype(np.float32).T)
        mixed = self.exact and len(np.unique(np.concatenate([self.q[:, -1], v[:, -1]]))) > 1
        high, wide = TILE
        for at in range(0, len(ids), wide):
            for top in range(0, len(self.q), high):
                s = self.fast[top : top + high] @ fast[:, at : at + wide]
                if mixed:
                    s[self.q[top : top + high, -1:] != v[at : at + wide, -1]] = 0
                least = self.least[top : top + high]
                if s.shape[1] >= self.k and np.isneginf(least).any():
                    least = np.maximum(least, np.partition(s, s.shape[1] - self.k, 1)[:, s.shape[1] - self.k] - 2 * self.margin)
                # Negated, so that what is no number is looked at as well.
                found = places(~(s < least[:, None]))
                if not len(found):
                    continue
                row, col = top + found // s.shape[1], at + found % s.shape[1]
                self.keep(row, ids[col], self.cosines(row, v, col) if self.exact else np.clip(s.ravel()[found], -1, 1).astype(float))

    def cosines(self, row: np.ndarray, v: np.ndarray, col: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        parts = []
        for n in range(0, len(row), step):
            a, b = self.q[row[n : n + step]], v[col[n : n + step]]
            parts.append(np.where(a[:, -1] == b[:, -1], np.clip(np.einsum("ij,ij->i", a[:, :-1], b[:, :-1]), -1, 1), 0))
        return np.concatenate(parts)

    def keep(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Only the rows of queries that have something new are sorted."""
        new = np.zeros(len(self.q), bool)
        new[row] = True
        own = new[self.row]
        r, i, s = (np.concatenate([old[own], more]) for old, more in ((self.row, row), (self.id, ids), (self.score, score)))
        order = np.lexsort((i, -s, r))
        r, i, s = r[order], i[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        last = place == self.k - 1
        self.least[r[last]] = (s[last] - self.margin).astype(np.float32) - np.float32(self.margin)
        best = place < self.k
        self.row, self.id, self.score = (np.concatenate([old[~own], more[best]]) for old, more in ((self.row, r), (self.id, i), (self.score, s)))

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.q_ids[self.row]), pa.array(self.id), pa.array(self.score)], names=["query_id", "vec_id", "score"])


def best_of_blocks(pairs: DataFrame, model: Model | None, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each cell for each query of a block that meets it.

    pairs: cell, ids and data of queries (q_ids, q_data), ids and data of vectors: codes, or without a model vectors.
    Pairs of one block of queries that come one after the other, as they do from a join by merging, give k rows a query
    together; in another order there are more rows, and the same ones among them.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(model)
    kinds = [pairs.schema[c].dataType.elementType.simpleString() for c in ("q_ids", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, met = shared.value, None, None
        kinds = (np.float64, np.float64) if own is None else (np.float32, np.uint8)
        for batch in batches:
            for row in range(batch.num_rows):
                cell, q_ids, q_data, ids, data = (batch.column(c)[row] for c in range(5))
                asked = cell.as_py(), q_ids.values.to_numpy(zero_copy_only=False), q_data.as_py()
                if now is None or asked[0] != now[0] or not np.array_equal(asked[1], now[1]) or asked[2] != now[2]:
                    if met is not None:
                        yield met.rows()
                    now = asked
                    met = Nearest(asked[1], np.frombuffer(asked[2], kinds[0]).reshape(len(asked[1]), -1), k, own is None)
                v = np.frombuffer(data.as_py(), kinds[1]).reshape(len(ids), -1)
                met.meet(ids.values.to_numpy(zero_copy_only=False), v if own is None else unit(own.decode(cell.as_py(), v)))
        if met is not None:
            yield met.rows()

    return pairs.select("cell", "q_ids", "q_data", "ids", "data").mapInArrow(run, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")


def search_index(queries: DataFrame, index: VectorIndex, vectors: DataFrame, k: int, probes: int | None = None, refine: int = 8) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest that the probed cells hold, by exact cosine.

    queries: query_id, embedding; vectors: vec_id, embedding, of which only candidates are read again, refine
    times k a query. Without probes as many cells are read as the index found to be enough. What the index misses lies in cells that were not probed; probing all of them misses
    only what the codes rank under refine times k.
    """
    spark, probes = queries.sparkSession, probes or index.model.probes
    asked = packed(asked_cells(queries, index.model, probes), QUERIES).withColumnsRenamed({"ids": "q_ids", "data": "q_data"})
    cells = [r.cell for r in asked_cells(queries, index.model, probes).select("cell").distinct().collect()]  # as many as the model has at most
    kind = vectors.schema["vec_id"].dataType.simpleString()
    blocks = spark.read.schema(f"ids array<{kind}>, data binary, cell int").parquet(f"{index.folder}/blocks").where(F.col("cell").isin(cells))
    near = top_k(best_of_blocks(asked.join(blocks, "cell"), index.model, refine * k), refine * k, tie="vec_id").drop("score", "rank")
    own = near.join(vectors.select("vec_id", F.col("embedding").alias("v")), "vec_id").join(queries.select("query_id", "embedding"), "query_id")
    return top_k(own.select("query_id", "vec_id", X.cosine("embedding", "v").alias("score")), k, tie="vec_id")


def exact_neighbours(queries: DataFrame, vectors: DataFrame, k: int, slices: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of all vectors, for any number of queries.

    Vectors are dealt into slices, each a number of blocks; blocks of queries go to every slice. So each
    query meets each vector once, in one pass, whatever their numbers; k rows a query and slice are shuffled.
    Vectors of different or no length have cosine 0, as everywhere here; null vectors of queries find nothing.
    """
    queries = queries.where("embedding is not null")
    widest = vectors.select("embedding").union(queries.select("embedding")).agg(F.max(F.size("embedding")).alias("n")).first()
    width = max(0, widest[0] or 0)
    parts = slices or max(1, 2 * vectors.sparkSession.sparkContext.defaultParallelism)
    size = max(LEAST_ROWS, min(EXACT_ROWS, EXACT_BYTES // (8 * (width + 1))))
    deal = lambda df, i, cell: units(df.select(i, "embedding"), i, width).select(cell.alias("cell"), "id", "data")
    v = packed(deal(vectors, "vec_id", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), size)
    q = packed(deal(queries, "query_id", F.lit(0)), size).withColumnsRenamed({"ids": "q_ids", "data": "q_data"})
    every = q.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return top_k(best_of_blocks(every.hint("merge").join(v, "cell"), None, k), k, tie="vec_id")


def units(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(id, data): unit vectors, filled up with zeros to the width, and each vector's length, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.zeros((batch.num_rows, width + 1))
            for i, x in enumerate(batch.column(1).to_pylist()):
                if x:
                    m[i, : len(x)], m[i, -1] = x, len(x)
            m[:, :-1] = unit(m[:, :-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in m], pa.binary())], names=["id", "data"])

    return rows.select(key, "embedding").mapInArrow(run, f"id {rows.schema[key].dataType.simpleString()}, data binary")

"""What the training-data operators share: table access, checkpoints, text kernels, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.session import checkpoint_folder, checkpointed, spread, table  # noqa: F401

#: Size of a bitmap of documents.
DOC_BITS = 1 << 23
#: Output rows and bytes after which a text kernel hands over an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


#: Spark's own setting by which a query's shuffle files go as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one job in the shared checkpoint folder: each cuts the lineage, survives lost executors, and
    is dropped by its owner once later ones stand. The shuffle files behind a table go when it is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(f"{self.folder}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, so that no other column of the input can clash with what is added."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def released() -> None:
    """Give memory that a task's kernel has freed back to the system: workers live on, and the next stages share their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(docs: DataFrame, make_kernel: Callable[[], Callable[[bytes | None], tuple]], fields: list[pa.Field], ddl: str, release: bool = False) -> DataFrame:
    """One output row per text: doc_id and what the kernel returns for the text's UTF-8 bytes.

    make_kernel runs once per task; rows go through one at a time, so memory holds one Arrow batch
    and one text's working set whatever the partition's size. release gives a large kernel's memory back at its end.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start, held, rows = 0, 0, []
            for i in range(batch.num_rows):
                s = texts[i].as_py()
                rows.append(kernel(s))
                held += sum(len(x) for x in rows[-1] if isinstance(x, (str, bytes)))
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pack(ids.slice(start, len(rows)), rows)
                    start, held, rows = i + 1, 0, []
            if rows:
                yield pack(ids.slice(start, len(rows)), rows)
        if release:
            kernel = batch = ids = texts = rows = s = None  # noqa: F841
            released()

    def pack(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array(col, f.type) for col, f in zip(zip(*rows), fields)]
        return pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", *(f.name for f in fields)])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {id_type}, {ddl}")


#: What a kernel of replace_texts() returns for a row that goes.
DROP = b"\xff<drop>"


def replace_texts(docs: DataFrame, text_col: str, make_kernel: Callable[[], Callable[[bytes | None], bytes | None]]) -> DataFrame:
    """docs with each text replaced by what the kernel returns for its UTF-8 bytes; rows for which it returns DROP go."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in batches:
            texts, keep = [], []
            for s in batch.column(at).cast(pa.binary()):
                t = kernel(s.as_py())
                keep.append(t != DROP)
                texts.append(t if t != DROP else None)
            column = pa.array(texts, pa.binary()).cast(pa.string())
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), column).filter(pa.array(keep))
        kernel = batch = texts = column = None
        released()

    return docs.mapInArrow(run, docs.schema)


def sealed(df: DataFrame, *columns: str) -> DataFrame:
    """df with columns passed through a generator of one row.

    Filters on them stay above it; else the optimizer copies the computations behind them into each
    filter, and into the bodies of lambdas, where they would run once per element.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*columns))))


def fixed_array(values: DataFrame, size: int, kind: str = "bigint", chunk: int = 1 << 14) -> DataFrame:
    """One row: an array of size numbers from rows (slot, v), 0 where there is none; put together by chunks."""
    full = values.sparkSession.range(size).select(F.col("id").alias("slot")).join(values, "slot", "left")
    rows = full.select((F.col("slot") / chunk).cast("long").alias("c"), F.struct("slot", F.coalesce("v", F.lit(0)).cast(kind).alias("v")).alias("x"))
    parts = rows.groupBy("c").agg(F.expr("transform(array_sort(collect_list(x)), x -> x.v)").alias("a"))
    return checkpointed(parts.agg(F.expr("flatten(transform(array_sort(collect_list(struct(c, a))), x -> x.a))").alias("a")))


def doc_bitmap(rows: DataFrame) -> Column:
    """A bitmap of the rows' doc_id and th, as an array of longs."""
    b = rows.select(F.xxhash64("doc_id", "th").bitwiseAND(F.lit(DOC_BITS - 1)).alias("b"))
    return fixed_array(b.groupBy(F.expr("b div 64").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")), DOC_BITS // 64).scalar()


def marked_by(texts: DataFrame, bits: Column) -> DataFrame:
    """texts with maybe: whether the bitmap has them."""
    t = texts.withColumn("bits", bits).withColumn("b", F.xxhash64("doc_id", "th").bitwiseAND(F.lit(DOC_BITS - 1)))
    return t.withColumn("maybe", F.expr("(shiftrightunsigned(bits[b div 64], cast(b % 64 as int)) & 1) = 1")).drop("bits", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of node's connected component; edges has long a, b.

    Alternating large-star and small-star steps, each a group-by with map-side combine and a join
    on the node, until the edge set stands still. A step at least halves the paths' lengths, so the
    number of rounds grows with the logarithm of the longest path. Only two sums reach the driver.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            n = both(e)
            least = n.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            return n.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        n = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = n.groupBy("a").agg(F.min("b").alias("m"))
        j = n.join(least, "a")
        moved = j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = mark(e)
    while before[0]:
        e = checkpointed(star(star(e, True), False))
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

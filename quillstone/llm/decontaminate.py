"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

A-Z is lower-cased; words are runs of digits, lower-case letters and non-ASCII characters. A window
is 10 consecutive words of an item; an item of fewer words, but not none, is one window. Each
training text's words become numbers of the benchmark's vocabulary; windows of known words are
hashed by one vectorised polynomial, looked up, and verified word by word. Spans are then cut.

A set that may have more than max_windows windows is dealt by hash to shards that have no more, a
long item in pieces that share what a window needs. Each shard is a broadcast set of its own for a
pass over the texts, of which only hits remain; so no benchmark is too large.

Defined cases: null text has no words; items without words are left out, items that repeat an id count
once; a null id is no item of the list, but its windows hit; repeated documents each come back; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import DROP, Scratch, doc_bitmap, map_texts, marked_by, narrow, replace_texts

WINDOW, MAX_WINDOWS = 10, 1_000_000
#: Byte to byte: lower case, and a space for all that is in no word.
NORMAL = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
WORD = re.compile(rb"[^ ]+")
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def windows_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    if len(words) < WINDOW:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)}


class Index:
    """The windows of the benchmark, by length, as sorted hashes and as exact tuples of word numbers."""

    def __init__(self, items: list[tuple[object, bytes]]):
        of: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, text in items:
            for w in windows_of(words_of(text)):
                of[w].add(item)
        self.number: dict[bytes, int] = {}
        for w in of:
            for x in w:
                self.number.setdefault(x, len(self.number) + 1)
        self.exact = {np.array([self.number[x] for x in w], np.int64).tobytes(): frozenset(v) for w, v in of.items()}
        keys: dict[int, list[list[int]]] = defaultdict(list)
        for w in of:
            keys[len(w)].append([self.number[x] for x in w])
        self.hashes = {n: np.unique(self.hash(np.array(v, np.uint64).T)) for n, v in keys.items()}

    @staticmethod
    def hash(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c) * STEP
            h ^= h >> np.uint64(29)
        return h

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items with one."""
        n = len(words)
        hit, items = np.zeros(n, bool), set()
        ids = np.fromiter(map(self.number.get, words, (0 for _ in words)), np.int64, n)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for size, hashes in self.hashes.items():
            if n < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            h = self.hash([ids[at + j].astype(np.uint64) for j in range(size)])
            found = np.searchsorted(hashes, h)
            found[found == len(hashes)] = 0
            for i in at[hashes[found] == h].tolist():
                of = self.exact.get(ids[i : i + size].tobytes())
                if of:
                    hit[i : i + size] = True
                    items |= of
        return hit, items


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """text without the runs of hit words and what stands between them."""
    spans = [m.span() for m in WORD.finditer(text.translate(NORMAL))]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    out, at = [], 0
    for a, b in edge.reshape(-1, 2).tolist():
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, text[at:]])


def result(text: bytes | None, words: list[bytes], hit: np.ndarray, items: set, with_text: bool) -> tuple:
    ids = sorted(str(i) for i in items if i is not None)
    row = len(words), int(hit.sum()), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit.any())
    return row if not with_text else (*row, None if text is None else (cut(text, hit) if hit.any() else text).decode("utf-8", "replace"))


def usable(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null")


def too_large(items: DataFrame, max_windows: int) -> bool:
    """A text of b bytes has at most b / 2 windows: this bounds the set before anything is fetched."""
    return (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > 2 * max_windows


def broadcast_index(docs: DataFrame, items: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(Index([(r.item, bytes(r.text)) for r in items.collect()]))


FIELDS = [pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("n_items", pa.int64()), pa.field("items_sha256", pa.string()), pa.field("contaminated", pa.bool_())]
DDL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_text: bool = False, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and clean_text (hit spans cut) if with_text."""
    items = usable(benchmark, item_col, item_text_col)
    docs = narrow(docs, id_col, text_col)
    if too_large(items, max_windows):
        return sharded(docs, items, with_text, max_windows).drop("th")
    index = broadcast_index(docs, items)

    def make():
        own = index.value

        def kernel(text: bytes | None) -> tuple:
            words = words_of(text)
            return result(text, words, *own.scan(words), with_text)

        return kernel

    return map_texts(docs, make, FIELDS + [pa.field("clean_text", pa.string())] * with_text, DDL + ", clean_text string" * with_text)


#: Words of an item's piece.
PIECE_WORDS = 5_000


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) of pieces of PIECE_WORDS words, which share all but one word of a window."""
    for batch in batches:
        names, texts = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = words_of(text)
            for k in range(0, max(1, len(w) - WINDOW + 1), PIECE_WORDS - WINDOW + 1):
                names.append(item)
                texts.append(b" ".join(w[k : k + PIECE_WORDS]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["item", "text"])


#: Groups of pieces whose sizes are summed before each group's pieces are laid end to end.
GROUPS = 1_024


def dealt(items: DataFrame, max_windows: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Different pieces with their shard, and the number of shards.

    Pieces are laid end to end and cut every so many bytes, so a shard has at most max_windows windows, or half
    of that and a piece, and there are no more shards than twice the bytes need. Repeated rows are one piece.
    """
    parts = scratch.put("pieces", items.mapInArrow(pieces, "item string, text binary").where("octet_length(text) > 0").distinct())
    most = max(2 * max_windows, 12 * PIECE_WORDS)
    told = parts.withColumn("h", F.xxhash64("item", "text")).withColumn("g", F.expr(f"pmod(h, {GROUPS})")).withColumn("size", F.octet_length("text") + 1)
    sums = told.groupBy("g").agg(F.sum("size").alias("all"))
    offsets = sums.select("g", (F.sum("all").over(Window.orderBy("g")) - F.col("all")).alias("offset"))
    start = F.col("offset") + F.sum("size").over(Window.partitionBy("g").orderBy("h", "item", "text").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    told = scratch.put("dealt", told.join(offsets, "g").withColumn("s", start).select("item", "text", F.expr(f"s div {most // 2}").alias("shard")))
    scratch.drop("pieces")
    return told, (told.agg(F.max("shard")).first()[0] or 0) + 1


def hits_of(index, id_type: str):
    """(doc_id, th, text) to doc_id, th, first and last of the runs of hit words, items: texts with hits alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            keep, firsts, lasts, names = [], [], [], []
            for i in range(batch.num_rows):
                hit, items = own.scan(words_of(batch.column(2)[i].as_py()))
                if hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                    keep.append(i)
                    firsts.append(edge[::2].tolist())
                    lasts.append((edge[1::2] - 1).tolist())
                    names.append([None if x is None else str(x) for x in items])
            part = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(firsts, pa.list_(pa.int32())), pa.array(lasts, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "th", "first", "last", "items"])

    return run, f"doc_id {id_type}, th long, first array<int>, last array<int>, items array<string>"


def sharded(docs: DataFrame, items: DataFrame, with_text: bool, max_windows: int) -> DataFrame:
    """The same for a benchmark of any size, plus th (the text's hash): a pass per shard, whose hits are then put together.

    Only texts with hits meet them in a join; a bitmap of fixed size tells which those may be.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "shards")
    told, shards = dealt(items, max_windows, scratch)
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    sc, found = docs.sparkSession.sparkContext, None
    for k in range(shards):
        index = sc.broadcast(Index([(r.item, bytes(r.text)) for r in told.where(F.col("shard") == k).select("item", "text").collect()]))
        run, ddl = hits_of(index, id_type)
        own = scratch.put(f"hits{k}", texts.mapInArrow(run, ddl))
        index.unpersist()
        found = own if found is None else found.union(own)
    found = scratch.put("hits", merged(found))
    scratch.drop("dealt", *(f"hits{k}" for k in range(shards)))
    seen = marked_by(texts, doc_bitmap(found))
    near = (F.col("t.doc_id").eqNullSafe(F.col("f.doc_id"))) & (F.col("t.th") == F.col("f.th"))
    lists = ("first", "last", "items")
    ready = seen.where("maybe").alias("t").join(found.alias("f"), near, "left").select("t.doc_id", "text", *lists, "t.th")
    ready = ready.union(seen.where("not maybe").select("doc_id", "text", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in lists), "th"))
    fields = FIELDS + [pa.field("clean_text", pa.string())] * with_text

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, first, last, names in zip(*(batch.columns[1:5])):
                text = text.as_py()
                words = words_of(text)
                hit = np.zeros(len(words), bool)
                for a, b in zip(first.as_py() or [], last.as_py() or []):
                    hit[a : b + 1] = True
                rows.append(result(text, words, hit, set(names.as_py() or []), with_text))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), fields)), batch.column(5)], names=["doc_id", *(f.name for f in fields), "th"])

    return ready.mapInArrow(tell, f"doc_id {id_type}, {DDL}" + ", clean_text string" * with_text + ", th long")


def merged(found: DataFrame) -> DataFrame:
    """Hits of all shards by text; a row's lists belong together, so they are gathered as one."""
    rows = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "last", "items")).alias("m"))
    return rows.select("doc_id", "th", *(F.expr(f"flatten(transform(m, x -> x.{c}))").alias(c) for c in ("first", "last", "items")))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs, all columns, with hit spans cut from text_col; a row whose words are all hit goes.

    Texts are replaced in their own rows, so nothing is shuffled while the benchmark is broadcast.
    """
    items = usable(benchmark, "item_id", "text")
    if too_large(items, max_windows):
        found = sharded(narrow(docs, id_col, text_col), items, True, max_windows).where("contaminated")
        found = found.select(F.col("doc_id").alias("__qs_id"), F.col("clean_text").alias("__qs_text"), (F.col("n_hit") == F.col("n_words")).alias("__qs_gone"), F.col("th").alias("__qs_of")).distinct()
        out = docs.join(found, F.col(id_col).eqNullSafe(F.col("__qs_id")) & (F.xxhash64(text_col) == F.col("__qs_of")), "left").where("__qs_gone is null or not __qs_gone")
        return out.withColumn(text_col, F.when(F.col("__qs_gone").isNotNull(), F.col("__qs_text")).otherwise(F.col(text_col))).select(*docs.columns)
    index = broadcast_index(docs, items)

    def make():
        own = index.value

        def kernel(text: bytes | None) -> bytes | None:
            words = words_of(text)
            hit, _ = own.scan(words)
            return text if not hit.any() else DROP if hit.all() else cut(text, hit)

        return kernel

    return replace_texts(docs, text_col, make)

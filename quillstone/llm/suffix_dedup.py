"""Removal of long repeated byte strings with a run-length index.

A byte goes if it lies in a string of LONG bytes that also starts anywhere else in the corpus. Texts
are UTF-8 bytes and no string crosses texts. Beside that, passages are told: WORDS words and the white
space behind them, FIND bytes or more and under LONG, that also start at a word elsewhere.

Dealing out. Every string of FIND bytes has an anchor, the gram of GRAM bytes in it with the least
hash (the last of equals), which its content alone determines; so equal strings meet under equal
anchors. Neighbouring starts with one anchor at one place form a span, whose body reaches LONG bytes
past each start. Anchors that occur once are done: none of their strings repeat. Copies of a body are
one class, held once with its number (map-side combine); an anchor that has one class only is nothing
but copies, so it repeats in whole.

Index. The classes of all other anchors, sorted by anchor, fill blocks of BLOCK bytes, or of one anchor
of at most HOT, and a block is one run-length index (see there), from which matching statistics stream over the bodies: how
far each start agrees with any other place. A body that has copies agrees to its end. For passages that
agreement may be with the same place of the text, as bodies overlap, so those that agree are looked up
among each other; for strings of LONG bytes it may not, as no body holds another's start that far.

An anchor whose classes exceed HOT bytes (a passage with very many surroundings) is not indexed: its
strings are counted by 128-bit hash instead, which is exact and splits over all tasks.

Texts are shuffled only where they are needed: those that hold a class's body, and those that have
marks; bitmaps of fixed size tell them, and where those are full more texts travel to the same result.

Defined cases: null is the empty text; texts under LONG bytes keep all; repeated rows are copies of
each other and go in whole if long enough; rows with null ids take part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, doc_bitmap, marked_by, narrow

LONG, FIND, WORDS, GRAM, BLOCK = 400, 240, 50, 64, 700_000
#: Bytes of one anchor's classes up to which it is indexed, and places that are compared at a time: both bound a task's memory.
HOT, LANES = 3_000_000, 1 << 17
SPAN = FIND - GRAM + 1
PIECE = 1 << 20
PLACE = np.uint64((1 << 21) - 1)
SPACES = np.zeros(257, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Symbols that are compared at a time.
STRIDE = 16
#: Bits of a place of which three fit into 64: texts of more symbols cannot carry two ranks and a place in one key.
PACKED = 21


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size bytes from each position, from hashes of half the size."""
    h, step = mixed(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while step < size:
        shift = min(step, size - step)
        h = h[:-shift] * np.uint64(0xD6E8FEB86659FD93) + (h[shift:] ^ (h[shift:] >> np.uint64(31)))
        step += shift
    return mixed(h)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    m, step = v, 1
    while step < width:
        shift = min(step, width - step)
        m = np.minimum(m[:-shift], m[shift:])
        step += shift
    return m


def spans_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, hash of the body, first start and number of starts of each span."""
    data, out = np.frombuffer(text, np.uint8), []
    starts = len(data) - FIND + 1
    for k in range(0, max(0, starts), PIECE):
        grams = gram_hashes(data[k : min(len(data), k + PIECE + FIND - 1)], GRAM)
        # The low bits hold the place, so that the least is one place: of equal grams the last.
        least = sliding_min((grams & ~PLACE) | (PLACE - np.arange(len(grams), dtype=np.uint64)), SPAN)
        at = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        n = np.diff(np.append(at, len(least)))
        anchor = grams[(PLACE - (least[at] & PLACE)).astype(np.int64)]
        h = np.array([xxhash.xxh3_64_intdigest(text[k + a : k + a + c + LONG - 1]) for a, c in zip(at.tolist(), n.tolist())], np.uint64)
        # The lowest bit tells whether a word may start with the body.
        fresh = SPACES[data[np.maximum(at + k - 1, 0)]] | (at + k == 0)
        out.append((anchor.view(np.int64), ((h & ~np.uint64(1)) | fresh.astype(np.uint64)).view(np.int64), at + k, n))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))


def word_starts(data: np.ndarray, fresh: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts of words that begin a passage, and its length: to the start of the word after WORDS words."""
    space = SPACES[data]
    at = np.flatnonzero(~space & np.concatenate(([fresh], space[:-1])))
    far = at[WORDS:] - at[:-WORDS] if len(at) > WORDS else np.zeros(0, np.int64)
    fits = (far >= FIND) & (far < LONG)
    return at[: len(far)][fits], far[fits]


def runs_of(yes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], yes.astype(np.int8), [0]))))
    return edge[::2], edge[1::2] - 1


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of bodies, with sampled run ends.

    What is kept, besides the text, has the size of the number of runs: heads (the symbol of each run),
    lengths, and at the first and the last row of each run the suffix's place and how far it agrees with
    the row next to it outside the run. Repetitive bodies have few runs.
    """

    def __init__(self, bodies: list[bytes]):
        sizes = np.array([len(b) + 1 for b in bodies])
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        n = int(self.ends[-1])
        self.text = np.zeros(n, np.int32)
        self.text[self.ends - 1] = 256 + np.arange(len(bodies))  # each body ends in a symbol of its own
        inside = np.ones(n, bool)
        inside[self.ends - 1] = False
        self.text[inside] = np.frombuffer(b"".join(bodies), np.uint8)
        order = suffix_order(self.text)
        last = self.text[order - 1]
        top = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        bottom = np.append(top[1:], n) - 1
        self.heads, self.lengths = last[top], bottom - top + 1
        above, below = np.maximum(top - 1, 0), np.minimum(bottom + 1, n - 1)
        self.tops, self.bottoms = order[top], order[bottom]
        self.agree_top = np.where(top > 0, self.common_prefix(order[top], order[above]), 0)
        self.agree_bottom = np.where(bottom < n - 1, self.common_prefix(order[bottom], order[below]), 0)

    def common_prefix(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols agree from each x and y; bodies' own end symbols stop it."""
        padded = np.concatenate((self.text, np.full(STRIDE, -1, np.int32)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, STRIDE)
        same = np.zeros(len(x), np.int64)
        for k in range(0, len(x), LANES):
            open_ = k + np.flatnonzero(x[k : k + LANES] != y[k : k + LANES])
            while len(open_):
                differ = windows[x[open_] + same[open_]] != windows[y[open_] + same[open_]]
                full = ~differ.any(1)
                same[open_] += np.where(full, STRIDE, differ.argmax(1))
                open_ = open_[full]
        return same

    def matching_statistics(self) -> np.ndarray:
        """For each place of the text how far it agrees with any other place.

        Inside a run, a row and its neighbour have one symbol before them, so the place before agreed by
        one more with the same neighbour's: each sample carries on, less one for each step, to the next.
        """
        at = np.arange(len(self.text))
        match = np.zeros(len(at), np.int64)
        for places, agree in ((self.tops, self.agree_top), (self.bottoms, self.agree_bottom)):
            sample = np.full(len(at), -1, np.int64)
            sample[places] = agree
            last = np.maximum.accumulate(np.where(sample >= 0, at, 0))
            match = np.maximum(match, sample[last] - (at - last))
        return match

    def marks(self, spans: list[tuple[int, bool, bool]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each body, given its number of starts, whether it has copies and whether a word may start with it:
        first and last of the runs of starts that agree for LONG bytes, and of the runs of word starts whose
        passage is another's."""
        starts, copied, fresh = (np.array(x) for x in zip(*spans))
        sizes, at = self.ends - self.begins, np.arange(len(self.text))
        body, offset = np.repeat(np.arange(len(sizes)), sizes), at - np.repeat(self.begins, sizes)
        own = offset < np.repeat(starts, sizes)
        match = np.where(copied[body], np.repeat(self.ends - 1, sizes) - at, self.matching_statistics())
        # Words that begin a passage.
        symbol = np.minimum(self.text, 256)
        space = SPACES[symbol]
        before = np.concatenate(([True], space[:-1]))
        before[self.begins] = fresh
        word = np.flatnonzero(before & ~space & (symbol < 256))
        far, first = word[WORDS:] - word[:-WORDS], word[:-WORDS]
        fits = (body[first] == body[word[WORDS:]]) & (far >= FIND) & (far < LONG) & own[first]
        first, far = first[fits], far[fits]
        agree = np.flatnonzero(match[first] >= far)
        raw, seen = self.text.astype(np.uint8).tobytes(), Counter()
        passages = [raw[i : i + k] for i, k in zip(first[agree].tolist(), far[agree].tolist())]
        for p, more in zip(passages, copied[body[first[agree]]].tolist()):
            seen[p] += 1 + more
        again = np.zeros(len(first), bool)
        again[agree] = [seen[p] > 1 for p in passages]
        lists = []
        for places, yes in ((at, own & (match >= LONG)), (first, again)):
            new = np.concatenate(([True], body[places][1:] != body[places][:-1]))[: len(places)]
            begin = yes & (new | ~np.concatenate(([False], yes[:-1]))[: len(yes)])
            end = yes & np.concatenate((new[1:] | ~yes[1:], [True]))[: len(yes)]
            for which in (begin, end):
                p = places[which]
                lists.append(np.split(offset[p], np.searchsorted(body[p], np.arange(1, len(sizes)))))
        return list(zip(*lists))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling.

    As many symbols as fit are packed first, up to an end symbol. Suffixes that agree up to an end symbol
    follow by place, as end symbols do, so they have ranks of their own from the first round on.

    Two ranks and a place fill one sorted key up to 1 << PACKED symbols; of longer texts the two ranks are
    sorted by their order.
    """
    n = len(text)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    mask = np.uint64((1 << int(bits)) - 1)
    inside = text < 256
    # 255 is no byte of UTF-8 and can stand for 0, so that 0 is free for end symbols.
    wide = 8 if not (text == 255).any() else 9
    own = np.where(inside, text + 1 if wide == 9 else np.where(text == 0, 255, text), 0).astype(np.uint64)
    length = min(n, (64 - int(bits)) // wide)
    key, at, going = np.zeros(n, np.uint64), np.arange(n, dtype=np.uint64), np.ones(n, bool)
    for j in range(length):
        key <<= np.uint64(wide)
        key[: n - j] |= own[j:] * going[: n - j]
        going[: n - j] &= inside[j:]
    alone = ~going
    rank, new, packed = np.empty(n, np.uint32), np.empty(n, bool), True
    while True:
        if packed:
            key <<= bits
            key |= at
            key.sort()
            order = (key & mask).astype(np.int64)
            key >>= bits
        else:
            order = np.argsort(key)
            key = key[order]
        packed = int(bits) <= PACKED
        new[0] = False
        np.not_equal(key[1:], key[:-1], out=new[1:])
        if alone is not None:
            new[1:] |= alone[order[1:]]
            alone = None
        place = np.cumsum(new, dtype=np.uint32)
        if place[-1] == n - 1:
            return order
        rank[order] = place
        key = rank.astype(np.uint64)
        key <<= bits
        key[: n - length] |= rank[length:]
        length *= 2


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie between a start and its end."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def taken(text: bytes, marks: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes go, and which lie in passages, from the lists of a text's marks."""
    first, last, word_first, word_last = (np.array(m or [], np.int64) for m in marks)
    # Copies are marked in whole, with starts that have under LONG bytes behind them.
    last = np.minimum(last, len(text) - LONG)
    gone = cover(len(text), first[first <= last], last[first <= last] + LONG)
    at, far = word_starts(np.frombuffer(text, np.uint8))
    yes = cover(len(text) + 1, word_first, word_last + 1)[at]
    return gone, gone | cover(len(text), at[yes], (at + far)[yes])


def keyed(docs: DataFrame) -> DataFrame:
    """Texts as bytes, with th: rows of one id and text have one result, so (doc_id, th) names them."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def find_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text the lists of its spans."""
    names = ["a", "s", "at", "n"]
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            rows = [spans_of(t.as_py()) for t in part.column(2)]
            at = pa.array(np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(c).astype(np.int64), t)) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["doc_id", "th", *names])


BODY = [("a", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("copied", pa.bool_()), ("hot", pa.bool_()), ("body", pa.binary())]
MARKS = [("a", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("first", "last", "word_first", "word_last"))]
BODY_DDL = "a long, s long, n int, copied boolean, hot boolean, body binary"
MARKS_DDL = "a long, s long, n int, first array<int>, last array<int>, word_first array<int>, word_last array<int>"


def rows_to_batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, spans) to one row of bytes per span."""
    for batch in batches:
        rows, held = [], 0
        for text, spans in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            for x in spans.as_py():
                rows.append((x["a"], x["s"], x["n"], x["copied"], x["hot"], text[x["at"] : x["at"] + x["n"] + LONG - 1]))
                held += x["n"] + LONG
                if held > 4 << 20:
                    yield rows_to_batch(rows, BODY)
                    rows, held = [], 0
        if rows:
            yield rows_to_batch(rows, BODY)


def index_spans(block_bytes: int):
    """Rows sorted by anchor to the marks of each class, a block of whole anchors at a time."""

    def marked(spans: list[tuple]) -> pa.RecordBatch:
        found = RunLengthIndex([x[4] for x in spans]).marks([(x[2], x[3], bool(x[1] & 1)) for x in spans])
        return rows_to_batch([(*x[:3], *(m.tolist() for m in own)) for x, own in zip(spans, found) if any(map(len, own))], MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        group: list[tuple] = []
        held = grown = 0
        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    if block and held + grown > block_bytes:
                        yield marked(block)
                        block, held = [], 0
                    block, held, group, grown = block + group, held + grown, [], 0
                if last != row[:3]:  # rows of one id and text give their spans twice
                    group.append(row)
                    grown += len(row[4]) + 1
                last = row[:3]
        if block and held + grown > block_bytes:
            yield marked(block)
            block = []
        if block or group:
            yield marked(block + group)

    return run


STRINGS = [("a", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("i", pa.int32()), ("word", pa.bool_()), ("own", pa.bool_()), ("h", pa.int64()), ("g", pa.int64())]


def single_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of LONG bytes of a body, and each passage, as its 128-bit hash; own: the body has copies."""
    for batch in batches:
        for a, s, n, copied, body in zip(*(c.to_pylist() for c in batch.columns)):
            at, far = word_starts(np.frombuffer(body, np.uint8), bool(s & 1))
            whole = max(0, min(n, len(body) - LONG + 1))
            strings = [(i, False, body[i : i + LONG]) for i in range(whole)] + [(i, True, body[i : i + k]) for i, k in zip(at.tolist(), far.tolist()) if i < n]
            if not strings:
                continue
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for _, _, t in strings), np.int64).reshape(-1, 2)
            m = len(strings)
            cols = [[a] * m, [s] * m, [n] * m, [i for i, _, _ in strings], [w for _, w, _ in strings], [copied] * m, h[:, 0].copy(), h[:, 1].copy()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, STRINGS)], names=[c for c, _ in STRINGS])


def repeated_spans(docs: DataFrame, scratch: Scratch, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, th, first, last, word_first, word_last): per text the runs of repeated starts, of strings and of passages."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = keyed(docs).where(F.octet_length("text") >= FIND)
    lists = scratch.put("lists", texts.mapInArrow(find_spans, f"doc_id {id_type}, th long, a array<long>, s array<long>, at array<int>, n array<int>"))
    spans = lists.select("doc_id", "th", F.inline(F.arrays_zip("a", "s", "at", "n")))
    anchors = spans.groupBy("a").agg(F.count("*").alias("times"), ((F.min("s") != F.max("s")) | (F.min("n") != F.max("n"))).alias("several")).where("times > 1")
    # Tables between the steps let adaptive execution split an anchor with very many spans.
    anchors = scratch.put("anchors", anchors.select("a", "several"))
    again = scratch.put("again", spans.join(anchors, "a"))
    scratch.drop("lists", "anchors")
    classes = again.groupBy("a", "s", "n").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "th", "at")).alias("one"), F.first("several").alias("several"))
    classes = scratch.put("classes", classes)
    none = F.array().cast("array<int>")
    ends = (F.array(F.lit(0)), F.array(F.col("n") - 1))
    whole = classes.where("not several and times > 1").select("a", "s", "n", *(c.alias(x) for c, x in zip((*ends, *ends), ("first", "last", "word_first", "word_last"))))
    open_ = classes.where("several")
    sizes = open_.groupBy("a").agg((F.sum(F.col("n") + LONG) > hot).alias("hot"))
    places = open_.join(sizes, "a").groupBy("one.doc_id", "one.th").agg(F.collect_list(F.struct("a", "s", "n", (F.col("times") > 1).alias("copied"), "hot", "one.at")).alias("spans"))
    places = scratch.put("places", places)
    near = (F.col("t.doc_id").eqNullSafe(F.col("p.doc_id"))) & (F.col("t.th") == F.col("p.th"))
    held = marked_by(texts, doc_bitmap(places)).where("maybe").drop("maybe")
    bodies = held.alias("t").join(places.alias("p"), near).select("text", "spans").mapInArrow(cut_spans, BODY_DDL)
    bodies = scratch.put("bodies", bodies)
    scratch.drop("places")
    cold = bodies.where("not hot").select("a", "s", "n", "copied", "body").repartition("a").sortWithinPartitions("a", "s", "n")
    marked = scratch.put("marked", cold.mapInArrow(index_spans(block), MARKS_DDL))
    large = bodies.where("hot").select("a", "s", "n", "copied", "body").dropDuplicates(["a", "s", "n"])
    strings = scratch.put("strings", large.mapInArrow(single_strings, "a long, s long, n int, i int, word boolean, own boolean, h long, g long"))
    met = scratch.put("met", strings.groupBy("h", "g").agg(F.count("*").alias("times"), F.bool_or("own").alias("own")).where("times > 1 or own").select("h", "g"))
    pick = lambda word: F.collect_list(F.when(F.col("word") == word, F.col("i")))
    counted = strings.join(met, ["h", "g"]).groupBy("a", "s", "n").agg(pick(False).alias("first"), pick(True).alias("word_first"))
    counted = counted.select("a", "s", "n", "first", F.col("first").alias("last"), "word_first", F.col("word_first").alias("word_last"))
    flags = scratch.put("flags", whole.union(marked).union(counted))
    moved = [F.expr(f"transform({c}, x -> x + at)").alias(c) for c in ("first", "last", "word_first", "word_last")]
    runs = again.join(flags, ["a", "s", "n"]).select("doc_id", "th", F.struct(*moved).alias("m"))
    # One row per text: repeated rows of one id and text name the same runs.
    runs = runs.groupBy("doc_id", "th").agg(F.collect_set("m").alias("m"))
    runs = scratch.put("runs", runs.select("doc_id", "th", *(F.expr(f"flatten(transform(m, x -> x.{c}))").alias(c) for c in ("first", "last", "word_first", "word_last"))))
    scratch.drop("again", "classes", "bodies", "marked", "strings", "met", "flags")
    return runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, and kept (bytes) if with_kept.

    n_passages: maximal runs of bytes that go or lie in repeated passages; such passages alone take nothing away.
    """
    docs = narrow(docs, id_col, text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    runs = repeated_spans(docs, Scratch(docs.sparkSession, "repeats"), block, hot)
    texts = marked_by(keyed(docs), doc_bitmap(runs))
    near = (F.col("t.doc_id").eqNullSafe(F.col("r.doc_id"))) & (F.col("t.th") == F.col("r.th"))
    lists = ("first", "last", "word_first", "word_last")
    joined = texts.where("maybe").alias("t").join(runs.alias("r"), near, "left").select("t.doc_id", "text", *lists)
    rest = texts.where("not maybe").select("doc_id", "text", *(F.lit(None).cast("array<int>").alias(c) for c in lists))
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), *([("kept", pa.binary())] * with_kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, *marks in zip(*(batch.columns[1:])):
                text, marks = text.as_py(), [m.as_py() for m in marks]
                kept, spans, passages = text, 0, 0
                if any(marks):
                    gone, passage = taken(text, marks)
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    spans, passages = len(runs_of(gone)[0]), len(runs_of(passage)[0])
                rows.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), passages, *([kept] * with_kept)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *rows_to_batch(rows, fields).columns], names=["doc_id", *(n for n, _ in fields)])

    return joined.union(rest).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", kept binary" * with_kept)

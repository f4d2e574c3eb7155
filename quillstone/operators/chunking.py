"""Generators that turn a text into rows: chunkers, passages, sections, timeline entries.

Splitters whose next cut depends on the last are UDFs over Arrow batches; the rest are
expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quillstone.functions import text as X

WINDOW, OVERLAP, ATOMIC_LEAST, ATOMIC_MOST, MOST_PASSAGES = 720, 120, 24, 900, 512
#: Texts that a splitter takes out of a batch at a time.
TEXTS = 64
#: Separators of the character splitter, in the order in which they are tried.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", ". ", "! ", "? ", "; ", " ", ""]
#: Smoothing weights (window 5, second order), over 35.
SMOOTHING = (-3, 12, 17, 12, -3)


def exploded(docs: DataFrame, splitter: Column, *keep: str) -> DataFrame:
    """keep, chunk_index, chunk_text: one row per chunk."""
    return docs.select(*keep, F.posexplode(splitter).alias("chunk_index", "chunk_text"))


def as_splitter(f: Callable[[str], list[str]]):
    """An Arrow UDF from a function of one text: the hook for splitters of one's own.

    Few texts of a batch and their chunks are Python's strings at a time.
    """

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(k, TEXTS).to_pylist() for k in range(0, len(texts), TEXTS))
        done = [pa.array([[] if t is None else f(t) for t in part], pa.list_(pa.string())) for part in parts]
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))

    return split


def character_splitter(size: int = 1000, overlap: int = 200):
    """Character chunks (E7): joins parts up to size; only what is left at the end is split further.

    size is at least 100 and overlap at most half of it; a new chunk begins with the tail of the last.
    """
    size, overlap = max(100, size), min(overlap, size // 2)

    def split(text: str) -> list[str]:
        if not text.strip():
            return []
        out: list[str] = []
        rest, k = text, 0
        while True:
            if len(rest) <= size:
                return out + [rest] if rest else out
            at = next((i for i in range(k, len(SEPARATORS)) if SEPARATORS[i] and SEPARATORS[i] in rest), len(SEPARATORS) - 1)
            sep = SEPARATORS[at]
            held = ""
            for part in rest.split(sep) if sep else rest:
                if not held:
                    held = part
                elif len(held) + len(part) + len(sep) <= size:
                    held += sep + part
                else:
                    out.append(held)
                    held = (out[-1][-overlap:] if overlap else "") + part
            if not held:
                return out
            if len(held) <= size or at + 1 >= len(SEPARATORS):
                return [*out, held]
            rest, k = held, at + 1

    return as_splitter(split)


def words_in(text: str) -> int:
    return len(text.split())


def pieces(text: str, most: int) -> list[str]:
    """Paragraphs, else lines, sentences, clauses, or runs of words, until each has at most so many words."""
    if words_in(text) <= most:
        return [text]
    for cut in (r"\n\n", r"\n", r"(?<=[。！？；])|(?<=[.!?])(?= )", r"(?<=[；：，])|(?<=[;:,])(?= )"):
        parts = [p for p in re.split(cut, text) if p]
        if len(parts) > 1:
            return [x for p in parts for x in pieces(p, most)]
    w = text.split()
    return [" ".join(w[i : i + most]) for i in range(0, len(w), most)]


def word_splitter(size: int = 300, overlap: int = 50):
    """Word chunks (E1, E2): pieces are joined while they stay within one and a half sizes; what is under half a size joins its neighbour; a chunk begins with the last sentences of the one before."""

    def tail(text: str) -> str:
        want = overlap * 5
        if len(text) <= want:
            return ""
        start = len(text) - want
        ends = [m.end() for m in re.finditer(r"[.!?。！？；]\s?", text[:start]) if m.end() >= max(0, start - want)]
        return text[ends[-1] if ends else start :]

    def split(text: str) -> list[str]:
        parts = [p for p in pieces(text, size) if p.strip()]
        if not parts:
            return []
        out: list[str] = []
        held = parts[0]
        for p in parts[1:]:
            if words_in(held) + words_in(p) + 1 <= size * 1.5:
                held += "\n" + p
                continue
            if words_in(held) >= size // 2 or not out:
                out.append(held)
            else:
                out[-1] += "\n" + held
            lead = tail(out[-1]) if overlap else ""
            held = f"{lead}\n{p}" if lead else p
        if words_in(held) < size // 2 and out:
            out[-1] += "\n" + held
        elif held:
            out.append(held)
        return out

    return as_splitter(split)


def header_splitter(most: int = 1600):
    """Markdown sections under their headings, long ones by characters."""
    small = re.compile(r"(?m)^(?=#{1,6} )")

    def split(text: str) -> list[str]:
        out = []
        for section in small.split(text):
            if not section.strip():
                continue
            head = section.split("\n", 1)[0] if section.startswith("#") else ""
            for k in range(0, len(section), most):
                part = section[k : k + most]
                out.append(part if k == 0 or not head else f"{head}\n{part}")
        return out

    return as_splitter(split)


def adaptive_chunks(docs: DataFrame, ext: str, text: str, *keep: str) -> DataFrame:
    """Tables by row groups, code by blank lines, markdown by headings, the rest by characters."""
    kind = F.lower(F.col(ext))
    code = as_splitter(lambda t: [b for b in re.split(r"\n\s*\n", t) if b.strip()])
    table = as_splitter(lambda t: ["\n".join(rows[i : i + 40]) for rows in [t.split("\n")] for i in range(0, len(rows), 40)])
    parts = [
        (kind.isin("csv", "tsv", "xlsx", "xls"), table),
        (kind.isin("rs", "py", "ts", "js", "go", "java", "c", "cpp"), code),
        (kind.isin("md", "markdown"), header_splitter()),
        (F.lit(True), character_splitter()),
    ]
    out, seen = None, F.lit(False)
    for condition, splitter in parts:
        rows = exploded(docs.where(~seen & condition), splitter(F.col(text)), *keep)
        out, seen = (rows if out is None else out.union(rows)), seen | F.coalesce(condition, F.lit(False))
    return out


def sentences(c: Column | str) -> Column:
    """Sentences; a dot between digits ends none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(c, r"(?<=[。！？；!?])|(?<=(?<![0-9])\.)|(?<=[0-9]\.)(?![0-9])"), lambda x: X.strip(x)), lambda x: x != "")


def window_passages(nodes: DataFrame, key: str, text: str) -> DataFrame:
    """key, passage_order, source_start, source_end, content: windows of 720 characters, 120 shared.

    Texts of more than MOST_PASSAGES windows get longer ones, so that all of the text is covered.
    """
    n = F.length(text)
    step = F.when(n > MOST_PASSAGES * (WINDOW - OVERLAP), F.ceil(n / MOST_PASSAGES)).otherwise(WINDOW - OVERLAP)
    last = F.greatest(F.lit(0), F.ceil((n - OVERLAP) / step) - 1)
    w = nodes.where(n > 0).select(key, text, n.alias("n"), step.cast("long").alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("passage_order"))
    start = F.col("passage_order") * F.col("step")
    w = w.withColumn("source_start", start).withColumn("source_end", F.least(F.col("n").cast("long"), start + F.col("step") + OVERLAP))
    w = w.withColumn("content", F.substring(text, (F.col("source_start") + 1).cast("int"), (F.col("source_end") - F.col("source_start")).cast("int")))
    # What the beginning has left when cleaned, the whole has as well: most windows are told by it.
    enough = lambda c: F.length(X.clean_for_search(c)) >= ATOMIC_LEAST
    w = w.where(enough(F.left("content", F.lit(3 * ATOMIC_LEAST))) | enough("content"))
    return w.select(key, F.col("passage_order").cast("int").alias("passage_order"), "source_start", "source_end", "content", X.text_quality(X.clean_for_search("content")).alias("quality"))


def atomic_passages(nodes: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of 24 to 900 cleaned characters, numbered as they are kept."""
    lines = nodes.select(key, F.posexplode(F.split(text, "[\n\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]")).alias("line", "content"))
    # What the order needs is told before the shuffle, so that lines themselves are shuffled only for those who read them.
    lines = lines.withColumn("__n", F.length("content")).withColumn("__fits", F.length(X.clean_for_search("content")).between(ATOMIC_LEAST, ATOMIC_MOST))
    before = F.coalesce(F.sum(F.col("__n") + 1).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = lines.withColumn("source_start", before).withColumn("source_end", F.col("source_start") + F.col("__n")).where("__fits")
    order = F.row_number().over(Window.partitionBy(key).orderBy("line")) - 1
    out = kept.withColumn("passage_order", order).where(F.col("passage_order") < MOST_PASSAGES)
    return out.select(key, "passage_order", "source_start", "source_end", "content", X.text_quality(X.clean_for_search("content")).alias("quality"))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.filter(F.split(text, "\n+"), lambda p: X.strip(p) != "")).alias("i", "paragraph"))


def heading_level(c: str) -> Column:
    return F.length(F.regexp_extract(X.strip(F.col(c)), "^(#*)", 1))


def boundary_signals(parts: DataFrame, key: str) -> DataFrame:
    """key, i, signal, smooth: how likely a topic ends after paragraph i.

    Headings, list items, rules and jumps in length add up; the signal is smoothed over five places,
    with the weights that fall outside left out.
    """
    w = Window.partitionBy(key).orderBy("i")
    nxt = F.lead("paragraph").over(w)
    p = parts.withColumn("next", nxt).where(F.col("next").isNotNull())
    here, there = heading_level("paragraph"), heading_level("next")
    size, size_next = F.octet_length("paragraph"), F.octet_length("next")
    dashes = F.length("paragraph") - F.length(F.replace(F.col("paragraph"), F.lit("-"), F.lit("")))
    signal = (
        F.when(F.col("next").startswith("#"), 0.8).otherwise(0.0)
        + F.when((there > 0) & (there < here), 0.6).when((there > 0) & (here == 0), 0.4).otherwise(0.0)
        + F.when((size > 0) & (size_next > 0) & (F.greatest(size / size_next, size_next / size) > 3.0), 0.3).otherwise(0.0)
        + F.when((X.strip("paragraph") == "") | (dashes > 5), 0.2).otherwise(0.0)
        + F.when(X.strip("next").startswith("- ") | X.strip("next").startswith("* "), 0.2).otherwise(0.0)
    )
    p = p.withColumn("signal", signal)
    total, weight = F.lit(0.0), F.lit(0.0)
    for offset, c in zip(range(-2, 3), SMOOTHING):
        at = F.lag("signal", -offset).over(w) if offset else F.col("signal")
        total = total + F.when(at.isNotNull(), at * (c / 35)).otherwise(0.0)
        weight = weight + F.when(at.isNotNull(), c / 35).otherwise(0.0)
    return p.select(key, "i", "signal", F.when(weight > 0, total / weight).otherwise(F.col("signal")).alias("smooth"))


def semantic_breaks(similarities: DataFrame, key: str, share: float = 0.6) -> DataFrame:
    """key, i of neighbours less alike than the text's share-th smallest similarity."""
    at = similarities.groupBy(key).agg(F.sort_array(F.collect_list("similarity")).alias("s"))
    limit = at.select(key, F.element_at("s", F.least(F.size("s"), F.floor(F.size("s") * share).cast("int") + 1)).alias("limit"))
    return similarities.join(limit, key).where("similarity < limit").select(key, "i")


def neighbour_similarity(sentences: DataFrame, key: str) -> DataFrame:
    """key, i, similarity of each sentence (key, i, embedding) to the next."""
    nxt = F.lead("embedding").over(Window.partitionBy(key).orderBy("i"))
    return sentences.withColumn("__n", nxt).where("__n is not null").select(key, "i", F.round(X.cosine("embedding", "__n"), 9).alias("similarity"))


def embedded_chunks(sentences: DataFrame, key: str, share: float = 0.6) -> DataFrame:
    """sentences (key, i, embedding, ...) plus chunk: a new one begins behind each break (E5)."""
    cuts = semantic_breaks(neighbour_similarity(sentences, key), key, share).select(key, (F.col("i") + 1).alias("i"), F.lit(1).alias("__cut"))
    upto = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return sentences.join(cuts, [key, "i"], "left").withColumn("chunk", F.coalesce(F.sum("__cut").over(upto), F.lit(0))).drop("__cut")


def checked_chunks(docs: DataFrame, text: str, offered: str, fallback: Callable[..., Column]) -> DataFrame:
    """docs plus chunks and accepted: a provider's chunks are taken if, white space aside, they give the text back in order; else the fallback splitter's."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    good = F.coalesce((F.size(offered) > 0) & (bare(F.array_join(offered, "")) == bare(F.col(text))), F.lit(False))
    out = docs.withColumn("accepted", good)
    return out.withColumn("chunks", F.when(F.col("accepted"), F.col(offered)).otherwise(fallback(F.when(~F.col("accepted"), F.col(text)))))


def locate_chunks(most_overlap: int = 400):
    """(full text, chunks) to each chunk's start and end, looked for from where the last one began."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
    def locate(full: pd.Series, chunks: pd.Series) -> pd.Series:
        def one(text, parts):
            at, out = 0, []
            for c in parts if parts is not None else []:
                k = text.find(c, max(0, at - most_overlap))
                k = text.find(c) if k < 0 else k
                k = at if k < 0 else k
                out.append({"start": k, "end": k + len(c)})
                at = k + len(c)
            return out

        return pd.Series([one(t or "", c) for t, c in zip(full, chunks)])

    return locate


def timeline_entries(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, date, summary of lines ``- DATE | text`` in three forms; indented lines carry on."""
    lines = docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("line", "raw"))
    bold, dash, colon = r"-\s*\*\*(\d{4}-\d{2}-\d{2})\*\*\s*[|\-–—]*\s*(.+)", r"-\s*(\d{4}-\d{2}-\d{2})\s*[|\-–—]+\s*(.+)", r"-\s*(\d{4}-\d{2}-\d{2})\s*:\s*(.+)"
    found = [F.struct(F.regexp_extract("raw", p, 1).alias("date"), X.strip(F.regexp_extract("raw", p, 2)).alias("summary")) for p in (bold, dash, colon)]
    entry = F.get(F.filter(F.array(*found), lambda e: X.is_date(e["date"]) & (e["summary"] != "")), F.lit(0))
    lines = lines.withColumn("e", entry)
    upto = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("first", F.last(F.when(F.col("e").isNotNull(), F.col("line")), ignorenulls=True).over(upto)).where("first is not null")
    more = F.when(F.col("e").isNull() & F.col("raw").rlike(r"^[ \t]"), X.strip("raw"))
    g = lines.groupBy(key, "first").agg(F.min_by("e", "line").alias("e"), F.sort_array(F.collect_list(F.when(more != "", F.struct("line", more.alias("t"))))).alias("more"))
    return g.select(key, F.col("first").alias("line"), "e.date", F.array_join(F.concat(F.array("e.summary"), F.transform("more", lambda m: m["t"])), " ").alias("summary"))


def fenced_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, block, language, code of fenced code."""
    p = r"```(\w*)\n([\s\S]*?)```"
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("language"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("code"))
    return docs.select(key, F.posexplode(zipped).alias("block", "b")).select(key, "block", "b.language", "b.code")

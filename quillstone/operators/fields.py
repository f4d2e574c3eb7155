"""Keyword search over several weighted fields, with the places of hits and the passages around them.

An index row is one word at its place in a field of a document. Rows arise where documents lie; those that
no query asks for are dropped there by a bitmap of the asked words' beginnings, so only places of asked
words are shuffled. A term is scored over all fields at once: its weighted count saturates as one, its
rarity counts documents, and a document's length is that of all fields. Up to SHARED_TERMS terms go to the
documents, which are counted where they lie; then only words of the best documents become index rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillstone.functions import text as X
from quillstone.operators.retrieval import B, K1, SHARED_TERMS, Best, hidden, ranges, source_boost, top_k
from quillstone.operators.substring import asked_for, bitmap
from quillstone.session import checkpointed, spread

#: Weights of a chunk's and of a page's fields.
CHUNK_FIELDS = {"chunk_text": 1.0, "chunk_text_tokens": 1.0, "language": 0.5, "symbol_name": 3.0, "symbol_type": 2.0}
PAGE_FIELDS = {"slug": 1.0, "title": 10.0, "title_tokens": 10.0, "compiled_truth": 5.0, "compiled_truth_tokens": 5.0, "timeline": 2.0, "timeline_tokens": 2.0}
#: What marks a hit and a cut in a snippet, and its length in words.
OPEN, CLOSE, CUT, SNIPPET = "<<", ">>", "...", 64
WORD, GAP = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]"
HEAD = 3
#: Documents that are counted at once, words whose terms a task remembers, and ids of documents up to which they are sent to all tasks.
COUNTED_DOCS, KNOWN_WORDS, SENT_IDS = 256, 1 << 18, 1_000_000


def spelled(c: Column | str) -> Column:
    """Words of letters, digits and underscores as they stand, repeats included; places count from 0."""
    text = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(text, f"{GAP}+"), lambda x: x != "")


def placed_words(docs: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """doc_id, dl (words of all fields), field, place, term (lower case): one row per word. fields: name to an array of words."""
    rows = spread(docs, key)
    blank = F.array().cast("array<string>")
    own = rows.select(F.col(key).alias("doc_id"), *(F.coalesce(c, blank).alias(f"__{n}") for n, c in enumerate(fields.values())))

    def rows_of(n: int, field: str) -> Column:
        return F.transform(f"__{n}", lambda w, i: F.struct(F.lit(field).alias("field"), i.alias("place"), F.lower(w).alias("term")))

    words = F.concat(*(rows_of(n, field) for n, field in enumerate(fields)))
    total = sum((F.size(f"__{n}") for n in range(len(fields))), F.lit(0))
    return own.select("doc_id", total.alias("dl"), F.inline_outer(words))


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, j, q: the escaped terms of each query's text, numbered from 0."""
    return queries.select("query_id", F.posexplode(X.match_terms("text")).alias("j", "q"))


def places_of(asked: DataFrame, index: DataFrame) -> DataFrame:
    """q, doc_id, dl, field, place: where words of the index begin with an asked term."""
    heads = checkpointed(asked.select("q", F.left("q", F.lit(HEAD)).alias("g")).distinct())
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(HEAD))), lambda n: F.left("term", n))
    rows = index.where("term <> ''").select("*", F.explode(starts).alias("g"))
    return asked_for(rows, bitmap(heads.select("g").distinct())).join(heads, "g").where(F.startswith(F.col("term"), F.col("q"))).select("q", "doc_id", "dl", "field", "place")


def field_search(queries: DataFrame, docs: DataFrame, key: str, fields: dict[str, tuple[Column, float]], k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, score, rank) by BM25 over weighted fields, and the places of all hits.

    queries: query_id, text; fields: name to an array of words and a weight. The places (query_id, j, doc_id,
    field, place) are those of the k best documents of each query. Documents without words count towards no average;
    rows of one key are one document, as long as all of them.
    """
    words = {n: c for n, (c, _) in fields.items()}
    asked = checkpointed(asked_terms(queries))
    if asked.count() <= SHARED_TERMS:
        best = checkpointed(top_k(scored_in_place(asked, docs, key, fields, k), k))
        few = best.select("doc_id").distinct()
        few = F.broadcast(few) if best.count() <= SENT_IDS else few
        places = checkpointed(places_of(asked, placed_words(docs.join(few, docs[key] == few["doc_id"], "left_semi"), key, words)))
    else:
        places = checkpointed(places_of(asked, placed_words(docs, key, words)))
        best = checkpointed(top_k(scored_by_joins(asked, places, docs, key, fields), k))
    seen = best.select("query_id", "doc_id").join(asked, "query_id").join(places, ["q", "doc_id"]).select("query_id", "j", "doc_id", "field", "place")
    return best, seen


def scored_by_joins(asked: DataFrame, places: DataFrame, docs: DataFrame, key: str, fields: dict[str, tuple[Column, float]]) -> DataFrame:
    """(query_id, doc_id, score) from the places of all hits, for any number of terms."""
    blank = F.array().cast("array<string>")
    sizes = docs.select(F.col(key).alias("doc_id"), sum((F.size(F.coalesce(c, blank)) for c, _ in fields.values()), F.lit(0)).alias("dl")).where("dl > 0")
    sizes = checkpointed(sizes.groupBy("doc_id").agg(F.sum("dl").alias("dl"), F.count("*").alias("rows")))
    stats = checkpointed(sizes.agg(F.struct(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl")).alias("s")))
    weight = F.lit(0.0)
    for name, (_, w) in fields.items():
        weight = F.when(F.col("field") == name, w).otherwise(weight)
    several = checkpointed(sizes.where("rows > 1").select("doc_id", F.col("dl").alias("whole")))
    hits = places.join(several, "doc_id", "left").groupBy("q", "doc_id", F.coalesce("whole", "dl").alias("dl")).agg(F.sum(weight).alias("tf"))
    df = hits.groupBy("q").agg(F.count_if(F.col("tf") >= 0).alias("df"))
    s = hits.join(df, "q").withColumn("s", stats.scalar()).select("q", "doc_id", "tf", "dl", "df", "s.*")
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = asked.join(s.select("q", "doc_id", part.alias("part")), "q").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return scored


def scored_in_place(asked: DataFrame, docs: DataFrame, key: str, fields: dict[str, tuple[Column, float]], k: int) -> DataFrame:
    """(query_id, doc_id, score) of what may be among the k best, for up to SHARED_TERMS terms: they go to the documents.

    A document's words are counted where it lies; what is kept of it is its length and a weighted count for each term
    that it holds. Places are not laid out.
    """
    spark = docs.sparkSession
    ids = checkpointed(asked.select("query_id").distinct().withColumn("__k", F.monotonically_increasing_id()))
    rows = [r for r in asked.join(ids, "query_id").select("__k", "q").collect() if r.q]
    kind = docs.schema[key].dataType.simpleString()
    if not rows:
        return spark.createDataFrame([], StructType([asked.schema["query_id"], StructField("doc_id", docs.schema[key].dataType), StructField("score", DoubleType())]))
    names, terms = np.array(sorted({r["__k"] for r in rows}), np.int64), {x: j for j, x in enumerate(sorted({r.q for r in rows}))}
    pairs = sorted((terms[r.q], int(np.searchsorted(names, r["__k"]))) for r in rows)
    of, who = np.array(pairs, np.int64).T
    given = spark.sparkContext.broadcast((terms, sorted({len(x) for x in terms}), [w for _, w in fields.values()]))
    own = spread(docs, key).select(F.col(key).alias("doc_id"), *(F.transform(c, F.lower).alias(f"__{n}") for n, (c, _) in enumerate(fields.values())))
    hits = checkpointed(own.mapInArrow(lambda batches: weighted_counts(batches, *given.value), f"doc_id {kind}, dl double, j array<long>, tf array<double>"))
    sizes = checkpointed(hits.where("dl > 0").groupBy("doc_id").agg(F.sum("dl").alias("whole"), F.count("*").alias("rows")))
    several = checkpointed(sizes.where("rows > 1").select("doc_id", "whole"))
    if not several.isEmpty():
        each = hits.join(several, "doc_id").select("doc_id", "whole", F.inline(F.arrays_zip("j", "tf"))).groupBy("doc_id", "whole", "j").agg(F.sum("tf").alias("tf"))
        both = each.groupBy("doc_id", F.col("whole").alias("dl")).agg(F.array_sort(F.collect_list(F.struct("j", "tf"))).alias("h")).select("doc_id", "dl", "h.j", "h.tf")
        hits = checkpointed(hits.join(several, "doc_id", "left_anti").union(both))
    s = sizes.agg(F.count("*").alias("n"), F.avg("whole").alias("avgdl")).first()
    n, avgdl = float(s.n), s.avgdl or 1.0

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = np.zeros(len(given.value[0]), np.int64)
        for batch in batches:
            texts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(texts))
        found = np.flatnonzero(texts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(texts[found])], names=["j", "n"])

    df = np.zeros(len(terms))
    for r in hits.select("j").mapInArrow(counted, "j long, n long").groupBy("j").agg(F.sum("n").alias("n")).collect():  # as many as there are terms
        df[r.j] = r.n
    idf = np.maximum(1e-6, np.log(np.maximum((n - df + 0.5) / (df + 0.5), 1e-300)))
    shared = spark.sparkContext.broadcast((names, idf, np.searchsorted(of, np.arange(len(terms) + 1)), who))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf, at, who = shared.value
        best = Best(len(names), k, 1e-8)
        for batch in batches:
            for part in (batch.slice(x, COUNTED_DOCS) for x in range(0, batch.num_rows, COUNTED_DOCS)):
                docs, dl = part.column(0), part.column(1).to_numpy()
                d = np.repeat(np.arange(len(dl)), pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False))
                j, tf = (part.column(x).flatten().to_numpy() for x in (2, 3))
                share = idf[j] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[d] / avgdl))
                many = at[j + 1] - at[j]
                key, where = np.unique(who[ranges(at[j], many)] * len(dl) + np.repeat(d, many), return_inverse=True)
                total, q, d = np.bincount(where, np.repeat(share, many)), key // len(dl), key % len(dl)
                keep = best.may_be(q, total)
                yield pa.RecordBatch.from_arrays([pa.array(names[q[keep]]), docs.take(pa.array(d[keep])), pa.array(total[keep])], names=["__k", "doc_id", "score"])

    found = hits.where("size(j) > 0").mapInArrow(scored, f"__k long, doc_id {kind}, score double")
    return found.join(F.broadcast(ids), "__k").select("query_id", "doc_id", F.round("score", 9).alias("score"))


def weighted_counts(batches: Iterator[pa.RecordBatch], terms: dict[str, int], sizes: list[int], weights: list[float]) -> Iterator[pa.RecordBatch]:
    """(doc_id, dl, j, tf) of rows (doc_id, words of each field): the terms that begin words, and their weighted counts; sizes: of terms."""
    known: dict[str, list[int]] = {}

    def found(word: str) -> list[int]:
        own = known.get(word)
        if own is None:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            own = known[word] = [terms[h] for h in (word[:n] for n in sizes if n <= len(word)) if h in terms]
        return own

    for batch in batches:
        for part in (batch.slice(x, COUNTED_DOCS) for x in range(0, batch.num_rows, COUNTED_DOCS)):
            dl, keys, shares = np.zeros(part.num_rows), [np.zeros(0, np.int64)], [np.zeros(0)]
            for column, weight in zip(part.columns[1:], weights):
                many = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                dl += many
                words = column.flatten().dictionary_encode()
                own = [*map(found, words.dictionary.to_pylist()), []]
                n, flat = np.array([len(x) for x in own], np.int64), np.array([j for x in own for j in x], np.int64)
                at = words.indices.fill_null(len(own) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                each = n[at]
                keys.append(np.repeat(np.repeat(np.arange(len(dl)), many), each) * len(terms) + flat[ranges((np.cumsum(n) - n)[at], each)])
                shares.append(np.full(len(keys[-1]), weight))
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            ends = pa.array(np.searchsorted(key // len(terms), np.arange(len(dl) + 1)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (key % len(terms), np.bincount(where, np.concatenate(shares), len(key)).astype(float)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(dl), *lists], names=["doc_id", "dl", "j", "tf"])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def best_windows(places: DataFrame, most: int = SNIPPET) -> DataFrame:
    """query_id, doc_id, first, last, marks: the span of at most so many words that holds the most of a query's
    terms; of equals the shortest, then the earliest (R51). marks: all places of hits.

    places: query_id, j (number of the term), doc_id, place. Places are gone through once: of each term the
    latest place is kept, and the span that ends here begins at the earliest of those near enough.
    """
    own = places.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_set(F.struct("place", "j"))).alias("p"), F.max("j").alias("top"))
    far = -(1 << 30)
    state = F.struct(F.transform(F.sequence(F.lit(0), F.col("top")), lambda i: F.lit(far)).alias("seen"), F.struct(F.lit(0).alias("n"), F.lit(far).alias("short"), F.lit(far).alias("early"), F.lit(0).alias("last")).alias("best"))

    def step(s: Column, x: Column) -> Column:
        seen = F.transform(s["seen"], lambda v, i: F.when(i == x["j"], x["place"]).otherwise(v))
        return bound(seen, lambda new: bound(F.filter(new, lambda v: v > x["place"] - most), lambda near: bound(F.array_min(near), lambda low: next_state(s, x, new, near, low))))

    def next_state(s: Column, x: Column, new: Column, near: Column, low: Column) -> Column:
        here = F.struct(F.size(near).alias("n"), (low - x["place"]).alias("short"), (-low).alias("early"), x["place"].alias("last"))
        return F.struct(new.alias("seen"), F.greatest(s["best"], here).alias("best"))

    folded = own.withColumn("best", F.aggregate("p", state, step)["best"])
    return folded.select("query_id", "doc_id", (-F.col("best.early")).alias("first"), F.col("best.last").alias("last"), F.array_distinct(F.transform("p", lambda x: x["place"])).alias("marks"))


def snippet(text: Column, first: Column, last: Column, marks: Column, most: int = SNIPPET) -> Column:
    """At most so many words of a text around the words first to last, words at marks between << and >>, ... where it is cut.

    The rest of the length is shared by both sides; what one side lacks the other has. Text without hits
    (first null) begins at its beginning.
    """
    cut = lambda group: F.regexp_extract_all(text, F.lit(f"({WORD})({GAP}*)"), F.lit(group))
    start = F.coalesce(first, F.lit(0))
    spare = most - (F.coalesce(last, F.lit(0)) - start + 1)

    def cut_out(t: Column) -> Column:
        total = F.size(t["words"])
        low = F.greatest(F.lit(0), F.least(start - F.floor(spare / 2).cast("int"), total - most))
        return bound(F.struct(low.alias("low"), F.least(low + most, total).alias("end"), total.alias("total")), lambda s: shown(t, s))

    def shown(t: Column, s: Column) -> Column:
        word = lambda w, i: F.when(F.array_contains(marks, i), F.concat(F.lit(OPEN), w, F.lit(CLOSE))).otherwise(w)
        gap = lambda i: F.when((i == s["end"] - 1) & (s["end"] < s["total"]), F.lit("")).otherwise(F.get(t["gaps"], i))
        parts = F.transform(F.slice(t["words"], s["low"] + 1, F.lit(most)), lambda w, i: F.concat(word(w, i + s["low"]), gap(i + s["low"])))
        lead = F.when(s["low"] > 0, F.lit(CUT)).otherwise(F.regexp_extract(text, f"^({GAP}*)", 1))
        return F.when(s["total"] == 0, F.left(text, F.lit(most))).otherwise(F.concat(lead, F.array_join(parts, ""), F.when(s["end"] < s["total"], F.lit(CUT)).otherwise("")))

    return bound(F.struct(cut(1).alias("words"), cut(2).alias("gaps")), cut_out)


def with_snippets(best: DataFrame, places: DataFrame, texts: DataFrame, field: str, most: int = SNIPPET) -> DataFrame:
    """best with snippet, from the hits in one field; texts: doc_id, text."""
    spans = best_windows(places.where(F.col("field") == field), most)
    rows = best.join(texts.select("doc_id", F.coalesce("text", F.lit("")).alias("__t")), "doc_id", "left").join(spans, ["query_id", "doc_id"], "left")
    marks = F.coalesce("marks", F.array().cast("array<int>"))
    return rows.withColumn("snippet", snippet(F.col("__t"), F.col("first"), F.col("last"), marks, most)).select(*best.columns, "snippet")


def keyword_search(queries: DataFrame, chunks: DataFrame, pages: DataFrame, k: int = 20, page_type: str | None = None, detail: str | None = None) -> DataFrame:
    """query_id, rank, slug, title, chunk_id, score, snippet: chunks by their weighted fields, or pages where there is no chunk.

    queries: query_id, text. chunks: chunk_id, slug, chunk_text, chunk_source and, if there, language, symbol_name,
    symbol_type. pages: slug, title, compiled_truth, timeline, page_type, deleted_at. Pages that are deleted,
    hidden or of another type are left out before anything is counted. Scores are multiplied by what the slug's
    directory is worth, but not with detail high; with detail low only compiled truth counts.
    """
    seen = pages.where(F.col("deleted_at").isNull() & ~hidden("slug"))
    seen = seen if page_type is None else seen.where(F.col("page_type") == page_type)
    if chunks.isEmpty():
        seen = seen if detail != "low" else seen.where("compiled_truth <> ''")
        made = {"slug": spelled("slug"), "title": spelled("title"), "title_tokens": X.tokens("title"), "compiled_truth": spelled("compiled_truth"), "compiled_truth_tokens": X.tokens("compiled_truth"), "timeline": spelled("timeline"), "timeline_tokens": X.tokens("timeline")}
        best, places = field_search(queries, seen, "slug", {n: (made[n], w) for n, w in PAGE_FIELDS.items()}, k)
        out = with_snippets(best, places, seen.select(F.col("slug").alias("doc_id"), F.col("compiled_truth").alias("text")), "compiled_truth")
        out = out.select("query_id", F.col("doc_id").alias("slug"), F.lit(None).cast("long").alias("chunk_id"), "score", "snippet")
        tie = "slug"
    else:
        own = chunks.join(seen.select("slug"), "slug", "left_semi")
        own = checkpointed(own if detail != "low" else own.where("chunk_source = 'compiled_truth'"))  # read five times
        made = {"chunk_text": spelled("chunk_text"), "chunk_text_tokens": X.tokens("chunk_text")} | {c: spelled(c) for c in ("language", "symbol_name", "symbol_type") if c in own.columns}
        best, places = field_search(queries, own, "chunk_id", {n: (c, CHUNK_FIELDS[n]) for n, c in made.items()}, k)
        out = with_snippets(best, places, own.select(F.col("chunk_id").alias("doc_id"), F.col("chunk_text").alias("text")), "chunk_text")
        out = out.join(own.select(F.col("chunk_id").alias("doc_id"), "slug"), "doc_id").select("query_id", "slug", F.col("doc_id").alias("chunk_id"), "score", "snippet")
        tie = "chunk_id"
    boosted = source_boost(out.join(seen.select("slug", "title"), "slug"), detail=F.lit(detail)).withColumn("score", F.round("score", 9))
    return top_k(boosted, k, tie=tie).select("query_id", "rank", "slug", "title", "chunk_id", "score", "snippet")

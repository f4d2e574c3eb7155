"""Personal data: fixed shapes, and information-theoretic sanitisation of what stands around them.

Base kinds (leftmost, non-overlapping per kind): email, ip, card, phone. Places of matches follow from
the lengths of the matches and of the pieces between them, so nothing but built-in functions is used.

Around each match, the NEAR nearest words before and after are its context. Over the whole corpus, a
word's occurrences next to an entity against all its occurrences estimate how surely the word names the
entity (posterior), and the logarithm of posterior over the entity's share of all entities is what it
reveals in bits. A word met in at least LEAST different contexts of an entity is removed if its posterior
is REMOVE or more and generalised to its initial if it is GENERALISE or more; that holds for entities of
any share, and for every occurrence of the word in any text. Words are pre-aggregated before each
shuffle; words that are in no candidate pair are left out of the corpus count by a bitmap of fixed size
before they are aggregated, and occurrences are found by another such bitmap of the disclosing terms.

Defined cases: null is the empty text; repeated rows each come back; positions are code points, ends
exclusive; an empty table gives no rows; without entities there are no terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpointed, fixed_array, narrow, sealed

#: The base kinds in their order. Possessive forms and look-behinds only spare backtracking.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEAR, REACH, LEAST, GENERALISE, REMOVE = 4, 120, 3, 0.5, 0.8
WORD = r"[\p{L}\p{M}]{3,}+"
SLOT_BITS = 1 << 20
#: Span kinds of terms, in their order after the base kinds: those removed, and those generalised.
TERMS = ("term", "term_generalised")


def valid() -> Column:
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    digits = F.regexp_replace("match", "[^0-9]", "")
    return (
        F.when(F.col("kind") == "ip", F.col("match").rlike(rf"^{part}(\.{part}){{3}}$"))
        .when(F.col("kind") == "card", F.length(digits).between(13, 19) & F.call_function("luhn_check", digits))
        .when(F.col("kind") == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


def entity() -> Column:
    return F.when(F.col("kind") == "email", F.lower("match")).otherwise(F.regexp_replace("match", "[^0-9.]", ""))


def matches(texts: DataFrame) -> DataFrame:
    """doc_id, th, k (place of the kind), kind, start, end, match, before and after (neighbouring text), cut_before, cut_after, rows (that have it)."""
    may = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    found = texts.select("doc_id", "th", "text", *(F.when(may.get(kind, F.lit(True)), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(kind) for kind, p in KINDS.items()))
    kinds = [F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.col(kind).alias("m"), F.when(F.size(kind) > 0, F.split("text", p, -1)).alias("gaps")) for k, (kind, p) in enumerate(KINDS.items())]
    some = found.where(" or ".join(f"size({kind}) > 0" for kind in KINDS)).select("doc_id", "th", F.explode(F.array(*kinds)).alias("x")).where("size(x.m) > 0")
    rows = some.select("doc_id", "th", "x.k", "x.kind", F.posexplode(F.arrays_zip("x.m", F.expr("slice(x.gaps, 1, size(x.m))").alias("gap"), F.expr("slice(x.gaps, 2, size(x.m))").alias("next"))).alias("i", "r"))
    rows = rows.select("doc_id", "th", "k", "kind", "i", F.col("r.m").alias("match"), (F.length("r.gap") + F.length("r.m")).cast("long").alias("size"), F.right("r.gap", F.lit(REACH)).alias("before"), F.left("r.next", F.lit(REACH)).alias("after"), (F.length("r.gap") > REACH).alias("cut_before"), (F.length("r.next") > REACH).alias("cut_after"))
    # Rows of one id and text have the same matches: each is kept once, with their number. One shuffle serves this and the running sum.
    rest = [c for c in rows.columns if c not in ("doc_id", "th", "k", "i")]
    rows = rows.repartition("doc_id", "th").groupBy("doc_id", "th", "k", "i").agg(*(F.first(c).alias(c) for c in rest), F.count("*").alias("rows"))
    upto = Window.partitionBy("doc_id", "th", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("size").over(upto)).withColumn("start", F.col("end") - F.length("match"))
    return rows.where(valid()).drop("i", "size")


def context(found: DataFrame) -> DataFrame:
    """doc_id, th, entity, start, end, term, context, rows: the NEAR words on either side of each match."""
    placed = "transform(filter(sequence(1, greatest(1, size(w))), k -> k <= size(w)), k -> struct(get(w, k - 1) as word, length(array_join(slice(g, 1, k), '')) + length(array_join(slice(w, 1, k - 1), '')) as at))"
    rows = []
    for side in ("before", "after"):
        r = found.withColumn("w", F.regexp_extract_all(side, F.lit(WORD), F.lit(0))).withColumn("g", F.split(side, WORD, -1)).where("size(w) > 0").withColumn("p", F.expr(placed))
        if side == "before":
            r = r.withColumn("p", F.expr(f"slice(reverse(filter(p, e -> not (cut_before and e.at = 0))), 1, {NEAR})"))
            start = F.col("start") - F.length("before") + F.col("e.at")
        else:
            r = r.withColumn("p", F.expr(f"slice(filter(p, e -> not (cut_after and e.at + length(e.word) = {REACH})), 1, {NEAR})"))
            start = F.col("end") + F.col("e.at")
        r = r.withColumn("e", F.explode("p"))
        rows.append(r.select("doc_id", "th", entity().alias("entity"), F.struct(F.lit(side), F.xxhash64("before", "after").alias("h")).alias("context"), start.cast("long").alias("start"), (start + F.length("e.word")).cast("long").alias("end"), F.lower("e.word").alias("term"), "rows"))
    # A word between two matches of one entity is one occurrence, in the context of the first.
    return rows[0].union(rows[1]).groupBy("doc_id", "th", "entity", "start", "end", "term").agg(F.min("context")["h"].alias("context"), F.first("rows").alias("rows"))


def bitmap_of(terms: DataFrame) -> Column:
    """The slots of the terms as an array of longs; marked() asks it."""
    slot = F.pmod(F.xxhash64("term"), F.lit(SLOT_BITS))
    bits = terms.select(slot.alias("b")).groupBy(F.expr("b div 64").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    return fixed_array(bits, SLOT_BITS // 64).scalar()


def marked(term: str) -> str:
    """SQL: whether the slot of term is set in the column bits."""
    return f"(shiftrightunsigned(bits[pmod(xxhash64({term}), {SLOT_BITS}) div 64], cast(pmod(xxhash64({term}), {SLOT_BITS}) % 64 as int)) & 1) = 1"


def disclosing(texts: DataFrame, near: DataFrame, found: DataFrame) -> DataFrame:
    """term, entity, posterior, bits, action of the pairs over the thresholds."""
    pairs = near.groupBy("term", "entity", "context").agg(F.sum("rows").alias("n")).groupBy("term", "entity").agg(F.sum("n").alias("together"), F.count("*").alias("contexts"))
    pairs = checkpointed(pairs.where(F.col("contexts") >= LEAST))
    words = texts.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}]+")).alias("term")).withColumn("bits", bitmap_of(pairs))
    total = words.where(F.expr(marked("term"))).groupBy("term").agg(F.count("*").alias("everywhere"))
    entities = found.select(entity().alias("entity"), "rows").groupBy("entity").agg(F.sum("rows").alias("times"))
    all_ = entities.agg(F.sum("times").alias("all"))
    told = pairs.join(total, "term").join(entities, "entity").withColumn("all", all_.scalar())
    told = told.withColumn("posterior", F.col("together") / F.col("everywhere")).withColumn("bits", F.log2(F.col("posterior") / (F.col("times") / F.col("all"))))
    return told.where(F.col("posterior") >= GENERALISE).select("term", "entity", "posterior", "bits", F.when(F.col("posterior") >= REMOVE, "remove").otherwise("generalise").alias("action"))


def occurrences(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, th, k, start, end, kind: every place of a disclosing term; terms has term and kind.

    Words of unset slots are passed over in place; each of the rest carries the length of the text since the
    one before, and a running sum over them gives the places.
    """
    w = sealed(texts.withColumn("w", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]++"), F.lit(0))).withColumn("bits", bitmap_of(terms)), "w")
    w = w.withColumn("h", F.expr(f"filter(sequence(0, size(w)), i -> i < size(w) and coalesce({marked('lower(get(w, i))')}, false))"))
    w = sealed(w.drop("bits"), "h").where("size(h) > 0").withColumn("lens", F.expr(r"zip_with(w, slice(split(text, '[\\p{L}\\p{M}]++', -1), 1, size(w)), (x, g) -> length(x) + length(g))"))
    w = sealed(w.drop("text"), "lens")
    size = "aggregate(slice(lens, if(n = 0, 0, h[n - 1] + 1) + 1, i - if(n = 0, -1, h[n - 1])), 0L, (a, x) -> a + x)"
    rows = w.select("doc_id", "th", F.posexplode(F.expr(f"transform(h, (i, n) -> struct(w[i] as word, {size} as size))")).alias("i", "r"))
    # Rows of one id and text have the same words: each is kept once. One shuffle serves this and the running sum.
    rows = rows.select("doc_id", "th", "i", "r.word", "r.size").repartition("doc_id", "th").dropDuplicates(["doc_id", "th", "i"])
    upto = Window.partitionBy("doc_id", "th").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("size").over(upto)).withColumn("term", F.lower("word")).join(terms, "term")
    k = F.when(F.col("kind") == TERMS[0], len(KINDS)).otherwise(len(KINDS) + 1)
    return rows.select("doc_id", "th", k.alias("k"), (F.col("end") - F.length("word")).alias("start"), "end", "kind")


def spans_of(texts: DataFrame) -> DataFrame:
    """doc_id, th, spans: per text with any, a sorted list of (k, start, end, kind); terms have k = 4, generalised ones 5."""
    found = checkpointed(matches(texts))
    told = disclosing(texts, context(found), found)
    # A term that names several entities is removed if it is to be removed for one.
    terms = checkpointed(told.groupBy("term").agg(F.when(F.max("posterior") >= REMOVE, TERMS[0]).otherwise(TERMS[1]).alias("kind")))
    every = found.select("doc_id", "th", "k", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind")
    every = every.unionByName(occurrences(texts, terms))
    return every.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("k", "start", "end", "kind"))).alias("found"))


def ready(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return narrow(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans."""
    texts = ready(docs, id_col, text_col)
    s = spans_of(texts).withColumnsRenamed({"doc_id": "__qs_id", "th": "__qs_th"})
    out = texts.select("doc_id", "th").join(s, F.col("doc_id").eqNullSafe(F.col("__qs_id")) & (F.col("th") == F.col("__qs_th")), "left")
    out = out.select("doc_id", F.coalesce("found", F.array().cast("array<struct<k:int,start:bigint,end:bigint,kind:string>>")).alias("found"))
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"size(filter(found, s -> s.kind like '{kind}%'))").cast("long").alias(f"n_{kind}") for kind in (*KINDS, "term")]
    return out.select("doc_id", *counts, F.sha2(told(F.filter("found", lambda s: s["k"] < len(KINDS))), 256).alias("base_sha256"), told("found").alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with <EMAIL>, <IP>, <CARD>, <PHONE> and <TERM> in place of what was found.

    Of a generalised term its initial and * stay, which all words of that initial have in common.
    """
    texts = ready(docs, id_col, text_col)
    s = spans_of(texts).select(F.col("doc_id").alias("__qs_id"), F.col("th").alias("__qs_th"), F.expr("array_sort(transform(found, s -> struct(s.start as start, s.end as end, s.kind as kind)))").alias("__qs_found"))
    out = docs.join(s, F.col(id_col).eqNullSafe(F.col("__qs_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__qs_th")), "left")
    # Spans that overlap one already written only move the end.
    written = f"""aggregate(__qs_found, struct(0L as at, '' as out),
        (a, s) -> if(s.start >= a.at, struct(s.end as at, concat(a.out, substring(`{text_col}`, int(a.at + 1), int(s.start - a.at)), if(s.kind = '{TERMS[1]}', concat(substring(`{text_col}`, int(s.start + 1), 1), '*'), concat('<', upper(s.kind), '>'))) as out), struct(greatest(a.at, s.end) as at, a.out as out)),
        a -> concat(a.out, substring(`{text_col}`, int(a.at + 1))))"""
    return out.withColumn(text_col, F.when(F.col("__qs_found").isNull(), F.col(text_col)).otherwise(F.expr(written))).select(*docs.columns)

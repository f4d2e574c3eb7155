"""How each source's vocabulary differs from the other sources of its language and from the language, in DuckDB shards.

Spark deals term counts over shards by language and term; in each shard DuckDB counts, keeps and compares
in vectorized SQL; Spark adds up the shards' partial sums and ranks them.

1. Each task counts the terms of its own texts by language and source and hands on sums, a bounded number
   at a time: a term of every text is a few rows per task, not one per occurrence.
2. All rows of a (language, term) lie in one shard. DuckDB adds them up as they stream in and keeps the
   terms of enough documents. Spark sums what a source holds of them: its total.
3. The totals of all sources go to every shard beside its counts. DuckDB gives partial sums of each pair of
   sources, and the foremost terms of each source. Most terms of a language are in few sources, so a pair
   counts all terms as absent from both, corrects that for the terms that each has (once per distinct
   count, not per term), and again for the terms that both have: no grid of terms and sources is made.

All arithmetic is on whole numbers of 128 bits (quotients rounded down), so results do not depend on
shards or order. A shard holds the distinct (language, source, term) rows of its terms in memory; their
number per shard falls as spark.sql.shuffle.partitions rises.

Defined cases: null text, language and source are the empty string; each row is a document of its own,
repeated rows and null ids too; a source without terms has pairs and totals of 0; a language without kept
terms gives pairs of value 0 and no terms; a language with one source gives no pairs; bytes
that are no UTF-8 count as U+FFFD; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, checkpointed

MIN_DOCS, SCALE, SMOOTH, TOP = 10, 1_000_000_000, 2, 10
#: A task's sums are handed on when they hold so many bytes, a term costing KEY besides its own; output rows of an Arrow batch; counts a shard of the second step.
HELD, KEY, BATCH, SHARD = 64 << 20, 200, 20_000, 500_000

#: Bytes of terms, A to Z lower-cased; every other byte becomes a space. All bytes of a character beyond ASCII are kept.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").encode().translate(TERM_BYTES).split()


def count_terms(most: int):
    """A mapInArrow function from lang, source, text (binary) to lang, source, term, n (occurrences), docs (documents with it), summed per task and handed on whenever the sums hold over most bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs, held = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3))):
                words, group = terms(text.as_py()), (lang.as_py(), source.as_py())
                once = set(words)
                fresh = once.difference(found[group])
                held += sum(map(len, fresh)) + KEY * (len(fresh) + 1)
                found[group].update(words)
                docs[group].update(once)
                if held > most:
                    yield from sums(found, docs)
                    found.clear()
                    docs.clear()
                    held = 0
        yield from sums(found, docs)

    def sums(found: dict[tuple, Counter], docs: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in found.items():
            words, own_docs = list(own), docs[lang, source]
            for k in range(0, len(words), BATCH):
                part = words[k : k + BATCH]
                counts = [pa.array([c[w] for w in part], pa.int64()) for c in (own, own_docs)]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), pa.repeat(source, len(part)), pa.array(part, pa.binary()).cast(pa.string()), *counts], names=["lang", "source", "term", "n", "docs"])

    return run


def duck():
    """A database in memory: nothing is written to the machine's own folders."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "900MB", "temp_directory": "", "preserve_insertion_order": False})
    con.execute("CREATE MACRO share(n, total, kinds) AS (1 + (SCALE::HUGEINT * (n + SMOOTH)) // (total + SMOOTH * kinds))::BIGINT".replace("SCALE", str(SCALE)).replace("SMOOTH", str(SMOOTH)))
    con.execute("CREATE MACRO apart(p, q) AS ((p - q) * (p - q)) // (p + q)")
    return con


#: Counts of one shard's terms, if the term is in enough documents of its language.
COUNTS = f"""
WITH c AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM given GROUP BY ALL)
SELECT lang, source, term, n FROM c QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {MIN_DOCS}
"""

#: Each row is a count (term, n) of a source, or (term null) the source's total and its language's number of terms.
SPLIT = """
CREATE TABLE every AS SELECT * FROM given;
CREATE TABLE g AS SELECT DISTINCT lang, source, n AS total, kinds, share(0, n, kinds) AS p0 FROM every WHERE term IS NULL AND kinds > 0;
CREATE TABLE r AS SELECT c.lang, c.source, c.term, c.n, share(c.n, g.total, g.kinds) AS p, g.p0 FROM every c JOIN g ON c.lang = g.lang AND c.source = g.source WHERE c.term IS NOT NULL;
DROP TABLE every;
"""

#: Partial sums of pairs x < y over this shard's terms.
PAIRS = """
WITH here AS (SELECT lang, count(DISTINCT term) AS n FROM r GROUP BY lang),
pairs AS (SELECT a.lang, a.source AS x, b.source AS y, a.p0 AS p, b.p0 AS q FROM g a JOIN g b ON a.lang = b.lang AND a.source < b.source),
none AS (SELECT lang, x, y, n * apart(p, q) AS value FROM pairs JOIN here USING (lang)),
levels AS (SELECT lang, source, p, count(*) AS n FROM r GROUP BY ALL),
lone AS (
  SELECT s.lang, x, y, sum(n * (apart(l.p, s.q) - apart(s.p, s.q))) AS value FROM pairs s JOIN levels l ON l.lang = s.lang AND l.source = s.x GROUP BY ALL
  UNION ALL
  SELECT s.lang, x, y, sum(n * (apart(s.p, l.p) - apart(s.p, s.q))) AS value FROM pairs s JOIN levels l ON l.lang = s.lang AND l.source = s.y GROUP BY ALL),
both_have AS (
  SELECT a.lang, a.source AS x, b.source AS y, sum(apart(a.p, b.p) - apart(a.p, b.p0) - apart(a.p0, b.p) + apart(a.p0, b.p0)) AS value
  FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL)
SELECT 'pair' AS part, lang, x AS source, y AS item, sum(value)::BIGINT AS value FROM (FROM none UNION ALL FROM lone UNION ALL FROM both_have) GROUP BY ALL
"""

#: The foremost of this shard's terms by source.
FOREMOST = f"""
WITH whole AS (SELECT lang, sum(total) AS total, any_value(kinds) AS kinds FROM g GROUP BY lang),
every AS (SELECT lang, term, sum(n) AS n FROM r GROUP BY ALL),
q AS (SELECT e.lang, e.term, share(e.n, w.total, w.kinds) AS q FROM every e JOIN whole w USING (lang)),
v AS (SELECT r.lang, r.source, r.term, apart(r.p, q.q) AS value FROM r JOIN q ON r.lang = q.lang AND r.term = q.term WHERE r.n > 0 AND r.p > q.q)
SELECT 'term' AS part, lang, source, term AS item, value FROM v QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {TOP}
"""


def in_duck(schema: pa.Schema, setup: str, *queries: str):
    """A mapInArrow function: a shard's rows stream into DuckDB as the view given, and each query's rows stream out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duck()
        given = pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches))
        con.register("given", given)
        for statement in filter(str.strip, setup.split(";")):
            con.execute(statement)
        for query in queries:
            yield from con.sql(query).to_arrow_reader(BATCH)
        con.close()

    return run


def shard_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n of the terms in enough documents of their language; docs has lang, source, text without nulls."""
    counted = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(count_terms(held), "lang string, source string, term string, n long, docs long")
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    return counted.repartition("lang", "term").mapInArrow(in_duck(schema, "", COUNTS), "lang string, source string, term string, n long")


def source_totals(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, n (occurrences of kept terms), kinds (kept terms of the language), for every source."""
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kinds = counts.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("kinds"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return groups.join(totals, ["lang", "source"], "left").join(kinds, "lang", "left").select("lang", "source", zero("n"), zero("kinds"))


def shard_results(counts: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """part, lang, source, item, value: each shard's partial sums of pairs and its foremost terms."""
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")
    own = counts.select(shard.alias("shard"), "lang", "source", "term", "n", F.lit(None).cast("long").alias("kinds"))
    all_of_them = totals.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), "n", "kinds")
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("kinds", pa.int64())])
    dealt = own.union(all_of_them).repartitionById(shards, "shard").drop("shard")
    return dealt.mapInArrow(in_duck(schema, SPLIT, PAIRS, FOREMOST), "part string, lang string, source string, item string, value long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank: by source, the other sources of its language and its foremost terms."""
    blank = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    texts = docs.select(blank(lang_col, "lang"), blank(source_col, "source"), blank(text_col, "text"))
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.put("counts", shard_counts(texts, held))
    groups = checkpointed(texts.select("lang", "source").distinct())
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // SHARD))
    found = checkpointed(shard_results(counts, source_totals(groups, counts), shards))
    scratch.drop("counts")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.union(sums.select("lang", F.col("item"), F.col("source"), "value"))
    others = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = others.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    foremost = found.where("part = 'term'").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    # Each shard has its own foremost terms; fewer, larger partitions rank theirs before the shuffle.
    ranked = foremost.coalesce(max(1, isqrt(shards))).withColumn("rank", rank).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", rank).union(ranked)

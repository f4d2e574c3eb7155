"""Which filters do the same work: an audit of every order of five filters, by inclusion and exclusion.

Each document gets a 0 or 1 for every filter it fails. One aggregate per part counts, for all 32 sets of
filters, the documents that fail all of a set, as sums of products of those flags (all documents, good
ones, toxic ones). Everything reported comes from these joint counts: a Moebius inversion over subsets
gives the survivors of any filters in any order, one over supersets the documents that fail exactly a
set, and the signed joint counts are the Harsanyi dividends of "documents removed", whose equal shares
are the Shapley values. So 120 orders cost no more passes than one.

Identity of texts is that of their SHA-256. The first document of each text is found by an aggregate with
map-side combine, and meets the documents on (hash, id), never on the hash alone, so that copies of one
text spread over all tasks. Texts are read once and never shuffled.

Defined cases: a null or empty text has no words (fails A, and E if a smaller id's text is empty too);
a null part is the empty string; a null id is never smaller or larger than another (passes E, has no
label); repeated rows count each, and rows with one id and text are not copies of each other; several
labels of one document count as one that has any of their marks; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SPACE = "[\\x20\\x09-\\x0D]+"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 50, 65, 5


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Filters that look at one text, by letter: whether it fails. words: its words, as an array."""
    n = F.size(words)
    return {
        "A": n < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT_PERCENT,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * MAX_CAPITAL_PERCENT,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: part, good, toxic, and A to E as 0 or 1; E is a text that a smaller id has too."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = texts.withColumn("w", F.array_remove(F.split("text", SPACE), ""))
    flags = {k: c.cast("long").alias(k) for k, c in text_filters(F.col("text"), F.col("w")).items()}
    own = checkpointed(split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("h"), *flags.values()))
    first = own.groupBy("h").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("is_first", F.lit(True))
    mark = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))
    met = own.join(first, ["h", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return met.select("part", *flags, copy.cast("long").alias("E"), zero("good"), zero("toxic"))


def subsets(k: int) -> range:
    return range(1 << k)


def joint_failures(rows: DataFrame, by: str, letters: str, weights: dict[str, str]) -> DataFrame:
    """One row per value of by; for each weight (an expression) an array, over the sets of letters as bit masks, of the summed weight of rows that fail all of a set."""
    product = lambda s, weight: " * ".join([weight, *(f"`{letter}`" for i, letter in enumerate(letters) if s >> i & 1)])
    return rows.groupBy(by).agg(*[F.expr(f"array({', '.join(f'sum({product(s, w)})' for s in subsets(len(letters)))})").alias(name) for name, w in weights.items()])


def signed(joint: str) -> Column:
    """The joint counts with the sign of inclusion and exclusion; negated, the Harsanyi dividends of the number removed."""
    return F.expr(f"transform({joint}, (x, s) -> if(bit_count(s) % 2 = 1, -x, x))")


def over_subsets(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """column[s] becomes the sum of column over the subsets of s: of signed joint counts, the rows that fail none of s."""
    for bit in (1 << i for i in range(k)):
        df = df.withColumns({c: F.expr(f"transform({c}, (x, s) -> if(s & {bit} <> 0, x + {c}[s - {bit}], x))") for c in columns})
    return df


def exactly(df: DataFrame, column: str, k: int) -> DataFrame:
    """column[s], rows that fail all of s, becomes the rows that fail s and nothing else."""
    for bit in (1 << i for i in range(k)):
        df = df.withColumn(column, F.expr(f"transform({column}, (x, s) -> if(s & {bit} = 0, x - {column}[s + {bit}], x))"))
    return df


def shapley(joint: str, k: int) -> Column:
    """By filter, the rows it removes summed over all k! orders: an equal share of each dividend, times k!."""
    share = lambda s: (-1) ** (s.bit_count() + 1) * factorial(k) // s.bit_count()
    sums = (" + ".join(f"{joint}[{s}] * {share(s)}" for s in subsets(k) if s >> i & 1) for i in range(k))
    return F.expr(f"array({', '.join(sums)})")


def report(joint: DataFrame, by: str, letters: str) -> DataFrame:
    """Each order of the filters, step by step, from the joint counts n, good and toxic."""
    k, weights = len(letters), ["n", "good", "toxic"]
    counts = joint.select(by, F.col("n").alias("joint"), F.col("n").alias("exact"), shapley("n", k).alias("shares"), *[signed(c).alias(c) for c in weights])
    counts = exactly(over_subsets(counts, weights, k), "exact", k)
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    mask = f"aggregate(slice(split(filter_order, ''), 1, {{}}), 0, (m, x) -> m | shiftleft(1, instr('{letters}', x) - 1))"
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    steps = steps.withColumns({"before": F.expr(mask.format("step - 1")), "after": F.expr(mask.format("step"))}).withColumn("own", F.expr("after - before"))
    gone = lambda c: F.expr(f"{c}[before] - {c}[after]")
    return steps.select(
        by, "filter_order", "step", F.expr("n[after]").alias("kept"), gone("n").alias("removed"), (F.expr("joint[own]") - gone("n")).alias("redundant"),
        F.expr("exact[own]").alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.expr("shares[cast(log2(own) as int)]").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = failures(docs, labels, id_col, text_col, part_col)
    return report(joint_failures(rows, "part", "ABCDE", {"n": "1L", "good": "good", "toxic": "toxic"}), "part", "ABCDE")

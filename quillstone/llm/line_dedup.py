"""Line dedup: an exact set-similarity join between lines, in built-in functions only.

A line's set is its distinct lower-cased words. A line goes if an earlier line, by doc_id and then
line number, has a set of Jaccard similarity SIMILAR or more (whether or not that line itself goes).

1. The words of all texts are counted in SLOTS hash slots, a table of fixed size. Each word's key is
   its slot's rarity above its hash: a total order by rarity, in which sets are sorted.
2. Lines with one set are one class, known by its first line (map-side combine: copies cost nothing).
3. Prefix filter: similar sets share a word among their n - ceil(0.8 n) + 1 rarest. Classes meet on
   those words in a semi-join whose condition holds the length filter, the positional filter and a
   bitmap filter (the parities of two sets differ in no more bits than the sets differ in words; 64 bits
   for short sets, 128 and 256 for long ones, whose many words would fill 64).
   Being a semi-join it stops at the first hit and never lists the pairs of a group. It is done for a share
   of the words at a time, which bounds the disk that prefixes take.
4. The first lines of classes that passed are read again (a bitmap of fixed size picks them in place)
   and meet with whole sets, where the Jaccard similarity to an earlier class is verified, again for a share
   of the words at a time.

Tables of fixed size only filter: where they are full at a larger scale, results stay the same.

Defined cases: null text has no lines; lines without words stay; a text keeps its other lines and
their order; rows that repeat a doc_id and text share their lines' places, so neither loses a line to
the other; null ids come first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fixed_array, narrow, sealed

SIMILAR = (4, 5)
#: Sets of fewer words are similar to none but themselves: 0.8 needs four shared words of five.
LEAST = 4
SLOTS, BITS = 1 << 20, 1 << 24
#: Shares of the prefix words, and of those with whole sets.
ROUNDS, WHOLE_ROUNDS = 3, 4
#: One of this many texts is counted for the order of words: all of them.
COUNTED = 1
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
#: Sets of more words have parities of 128 and of 256 bits: odd is over words with one more bit of the key, twos with another, both with both.
LONG, LONGER = 64, 180
BITMAPS = ("parity", "odd", "twos", "both")


def spaced(c: str) -> Column:
    """The text with spaces for tabs, form feeds and returns; most texts have none and stay as they are."""
    t = F.col(c)
    marks = [m for m in "\t\x0b\x0c\r"]
    return F.when(reduce(lambda a, b: a | b, (t.contains(m) for m in marks)), reduce(lambda x, m: F.replace(x, F.lit(m), F.lit(" ")), marks, t)).otherwise(t)


def cut(c: str | Column) -> Column:
    """The lower-cased words of a spaced text, and empty strings between them (one character splits without a pattern)."""
    return F.split(F.lower(c), " ", -1)


def hashes(c: str) -> Column:
    """64-bit hashes of the distinct words."""
    return F.array_remove(F.array_distinct(F.transform(cut(c), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lines_of(docs: DataFrame, pick: Callable[[DataFrame], DataFrame] = lambda lines: lines) -> DataFrame:
    """th, doc_id, line, words: picked lines that have words, as sets of word hashes."""
    # The text's hash is taken before its lines are laid out, else it would be taken again for each.
    # Outer: else a filter would be inferred that cuts each text a second time; the row of a null text goes with the blank lines.
    t = docs.select("doc_id", F.xxhash64("text").alias("th"), F.split(spaced("text"), "\n").alias("cut")).select("doc_id", "th", F.posexplode_outer("cut").alias("line", "raw"))
    return pick(t).where(F.trim("raw") != "").select("doc_id", "th", "line", hashes("raw").alias("words"))


def rarity(docs: DataFrame) -> DataFrame:
    """One row: for each slot twice the logarithm of how many words of one of COUNTED texts fall into it, as the highest byte of a key."""
    some = docs if COUNTED == 1 else docs.where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0)
    slots = some.select(F.explode(cut(F.replace(spaced("text"), F.lit("\n"), F.lit(" ")))).alias("w")).where("w <> ''").select(F.xxhash64("w").bitwiseAND(F.lit(SLOTS - 1)).alias("slot"))
    return fixed_array(slots.groupBy("slot").agg(F.count("*").alias("n")).select("slot", F.expr("shiftleft(floor(2 * log2(n) + 1), 56)").alias("v")), SLOTS)


def keyed(lines: DataFrame, table: DataFrame) -> DataFrame:
    """lines plus keys (sorted by rarity), n, sid and BITMAPS: the set's name and bitmaps (0 where the set is too short for them)."""
    # No slot is null; said so, keys are sorted as plain numbers.
    rare = f"coalesce(get(rare, cast(h & {SLOTS - 1} as int)), 0L)"
    k = lines.withColumn("rare", table.scalar()).select("doc_id", "th", "line", F.expr(f"sort_array(transform(words, h -> {rare} | shiftrightunsigned(h, 8)))").alias("keys"))
    bits = "aggregate(keys, 0L, (b, k) -> b ^ shiftleft({}, cast(k & 63 as int)))"
    k = sealed(k, "keys")
    parts = [
        bits.format("1L"),
        f"if(size(keys) > {LONG}, {bits.format('shiftrightunsigned(k, 6) & 1L')}, 0L)",
        f"if(size(keys) > {LONGER}, {bits.format('shiftrightunsigned(k, 7) & 1L')}, 0L)",
        f"if(size(keys) > {LONGER}, {bits.format('shiftrightunsigned(k, 6) & shiftrightunsigned(k, 7) & 1L')}, 0L)",
    ]
    bitmaps = [F.expr(part).alias(name) for name, part in zip(BITMAPS, parts)]
    return sealed(k.select("doc_id", "th", "line", "keys", F.size("keys").alias("n"), F.xxhash64("keys").alias("sid"), *bitmaps), "n", "sid", *BITMAPS)


def differing() -> str:
    """In how many bits the parities of x and y differ, by as many bits as both have."""
    d, e, f, g = (f"(x.{b} ^ y.{b})" for b in BITMAPS)
    count = lambda *parts: " + ".join(f"bit_count({p})" for p in parts)
    short, long, longer = count(d), count(e, f"{d} ^ {e}"), count(g, f"{e} ^ {g}", f"{f} ^ {g}", f"{d} ^ {e} ^ {f} ^ {g}")
    return f"case when least(x.n, y.n) > {LONGER} then {longer} when least(x.n, y.n) > {LONG} then {long} else {short} end"


def head() -> Column:
    """The keys of the prefix."""
    a, b = SIMILAR
    return F.expr(f"slice(keys, 1, cast(n - ({a} * n + {b - 1}) div {b} + 1 as int))")


def place() -> Column:
    """The order of lines as one number: doc_id, then line."""
    return (F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)")) * F.lit(1 << 32).cast("decimal(11,0)") + F.col("line")).cast("decimal(38,0)")


def meeting(classes: DataFrame, *more: Column, share: tuple[int, int]) -> DataFrame:
    """sid of classes that meet another on a prefix word under the filters and more; share (r, k): by words of the r-th of k shares.

    Both sides are the same exchange: one row per class and prefix word (outer: no set is empty, and
    so no filter is inferred that would compute the prefix twice). A word with very many rows is split by
    adaptive execution on the left side.
    """
    a, b = SIMILAR
    rows = classes.select(*(c for c in classes.columns if c != "head"), F.posexplode_outer("head").alias("pos", "token"))
    rows = rows.where(F.expr("pmod(hash(token), {1}) = {0}".format(*share)))
    need = f"({a} * (x.n + y.n) + {a + b - 1}) div {a + b}"
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.sid") != F.col("y.sid"))
    meet = meet & F.expr(f"{a} * greatest(x.n, y.n) <= {b} * least(x.n, y.n)")
    meet = meet & F.expr(f"least(x.pos, y.pos) + least(x.n - x.pos, y.n - y.pos) >= {need}")
    meet = meet & F.expr(f"{differing()} <= x.n + y.n - 2 * ({need})")
    for condition in more:
        meet = meet & condition
    return rows.alias("x").join(rows.alias("y"), meet, "left_semi").select("sid").distinct()


def bitmap(names: DataFrame, key: Column) -> DataFrame:
    """One row: BITS bits, set where key falls for a row of names."""
    b = names.select(key.bitwiseAND(F.lit(BITS - 1)).alias("b"))
    return fixed_array(b.groupBy(F.expr("b div 64").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")), BITS // 64)


def similar_classes(docs: DataFrame, classes: DataFrame, table: DataFrame, scratch: Scratch) -> DataFrame:
    """sid of each class that has an earlier similar class; classes: sid, BITMAPS, n, head, place of its first line."""
    a, b = SIMILAR
    sets = classes.where(f"n >= {LEAST}").select("sid", *BITMAPS, "n", "head")
    passed = [scratch.put(f"passed{r}", meeting(sets, share=(r, ROUNDS))) for r in range(ROUNDS)]
    passed = reduce(DataFrame.union, passed).distinct()
    first = scratch.put("first", classes.select("sid", "place").join(passed, "sid", "left_semi"))
    # Only the first lines of classes that passed are read again.
    key = F.xxhash64("place")
    bits = bitmap(first, key)
    at = key.bitwiseAND(F.lit(BITS - 1)).alias("at")
    test = F.expr("(shiftrightunsigned(bits[at div 64], cast(at % 64 as int)) & 1) = 1")
    again = keyed(lines_of(docs, lambda t: t.withColumn("at", F.xxhash64(place()).bitwiseAND(F.lit(BITS - 1))).withColumn("bits", bits.scalar()).where(test)), table)
    again = again.select("sid", place().alias("place"), "n", *BITMAPS, "keys")
    whole = again.join(first, ["sid", "place"]).dropDuplicates(["sid"])
    whole = scratch.put("whole", whole.select("sid", "n", "keys", "place", head().alias("head"), *BITMAPS))
    same = F.expr(f"{a + b} * size(array_intersect(x.keys, y.keys)) >= {a} * (x.n + y.n)")
    # Whole sets travel once per prefix word.
    found = [scratch.put(f"found{r}", meeting(whole, F.col("y.place") < F.col("x.place"), same, share=(r, WHOLE_ROUNDS))) for r in range(WHOLE_ROUNDS)]
    return reduce(DataFrame.union, found).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, gone): the numbers of the lines that go, for texts that lose some."""
    scratch = Scratch(docs.sparkSession, "lines")
    table = rarity(docs)
    short = F.expr("transform(head, k -> cast(k & 2147483647 as int))").alias("head")
    lines = keyed(lines_of(docs), table).select("doc_id", "th", "line", "sid", *BITMAPS, "n", head().alias("head"))
    lines = scratch.put("lines", lines.select("doc_id", "th", "line", "sid", *BITMAPS, "n", short))
    classes = lines.withColumn("place", place()).groupBy("sid", *BITMAPS, "n", "head").agg(F.min("place").alias("place"), F.count("*").alias("times"))
    classes = scratch.put("classes", classes)
    gone = similar_classes(docs, classes, table, scratch)
    late = gone.select("sid", F.lit(True).alias("late"))
    # Written out, so that adaptive execution can split the lines of a very common set.
    marked = scratch.put("marked", classes.select("sid", "place", "times").join(late, "sid", "left").where("late or times > 1").select("sid", F.col("place").alias("least"), "late"))
    out = lines.select("sid", "doc_id", "th", "line", place().alias("place")).join(marked, "sid").where("late or place > least")
    out = scratch.put("gone", out.groupBy("doc_id", "th").agg(F.collect_set("line").alias("gone")))
    scratch.drop("lines", "classes", "first", "whole", "marked", *(f"passed{r}" for r in range(ROUNDS)), *(f"found{r}" for r in range(WHOLE_ROUNDS)))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, plus __qs_gone (numbers of the lines that went) and __qs_text (the other lines)."""
    own = removed_lines(narrow(docs, id_col, text_col))
    own = own.select(F.col("doc_id").alias("__qs_id"), F.col("th").alias("__qs_th"), F.col("gone").alias("__qs_gone"))
    out = docs.join(own, F.col(id_col).eqNullSafe(F.col("__qs_id")) & (F.xxhash64(text_col) == F.col("__qs_th")), "left")
    out = out.withColumn("__qs_cut", F.when(F.col("__qs_gone").isNotNull(), F.split(text_col, "\n")))
    left = F.expr("array_join(transform(array_except(sequence(0, size(__qs_cut) - 1), __qs_gone), i -> __qs_cut[i]), '\n')")
    out = out.withColumn("__qs_text", F.when(F.col("__qs_gone").isNull(), F.col(text_col)).otherwise(left)).drop("__qs_id", "__qs_th", "__qs_cut")
    return sealed(out, "__qs_gone", "__qs_text")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers), kept_sha256."""
    d = dedup(narrow(docs, id_col, text_col))
    return d.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__qs_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform(F.array_sort("__qs_gone"), lambda i: i.cast("string")), ","), F.lit("")).alias("removed"),
        F.sha2(F.coalesce("__qs_text", F.lit("")), 256).alias("kept_sha256"),
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with the lines that go taken out of text_col; a row that had words and has none left goes."""
    d = dedup(docs, id_col, text_col)
    d = d.where(F.col("__qs_gone").isNull() | F.col("__qs_text").rlike(NOT_SPACE))
    return d.withColumn(text_col, F.col("__qs_text")).select(*docs.columns)

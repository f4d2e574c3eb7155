"""Quality rules: a threshold table compiled into one projection of text ratios.

Words are maximal runs of what is neither space nor \\t \\n \\v \\f \\r. Every measure is an expression of
built-in functions over the words, lines and 3-word windows of one row, so a table of any size is one
scan without a shuffle. Repeated 3-word windows are found by sorting their hashes (64 bits) with their
positions, so a text of n words costs n log n.

Defined cases: null has no words; empty and wordless texts fail (under MIN_WORDS words); repeated rows
each come back; columns of the input other than id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, sealed

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACE = "[\\x20\\x09-\\x0D]+"

#: Frequent function words of the four languages.
STOP_WORDS = """
a an and are as at be by for from had has have he her his in is it of on or she than that the their they this to was were which with you
au aux avec dans de des du elle en est et il la le les leur mais ne nous ou par pas pour que qui se son sur un une vous
als am auf aus bei das dem den der des die ein eine einen er es für im in ist mit nicht oder sich sie und von war wie zu
al como con del desde el ella en entre era es esta este las lo los más no para pero por que se sin su sus un una y
""".split()

#: (measure, least, most): a document is kept if each measure lies within its bounds. None: no bound.
TABLE: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.2),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("list_line_ratio", None, 0.9),
    ("cut_line_ratio", None, 0.5),
]


def verdict(table: list[tuple[str, float | None, float | None]]) -> Column:
    """The table as one boolean expression over the measures' columns."""
    ok = F.lit(True)
    for name, least, most in table:
        if least is not None:
            ok = ok & (F.col(name) >= least)
        if most is not None:
            ok = ok & (F.col(name) <= most)
    return ok


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[tuple[str, float | None, float | None]] | None = None) -> DataFrame:
    """doc_id, the base counts, the table's measures, base_failed and kept."""
    t = narrow(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cased = sorted({w for s in STOP_WORDS for w in (s, s.capitalize())})
    split = t.select(
        "doc_id",
        F.array_remove(F.split("text", SPACE), "").alias("w"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    hashed = split.withColumn("h", F.expr("if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"))
    counted = hashed.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("w", lambda x: x.isin(*cased))).alias("n_stops"),
        F.size(F.filter("lines", lambda x: x.rlike("^\\s*([-*\\u2022]|[0-9]+[.)])\\s"))).alias("n_list_lines"),
        F.size(F.filter("lines", lambda x: x.rlike("(\\.\\.\\.|\\u2026)\\s*$"))).alias("n_cut_lines"),
        # Sorted (hash, position) pairs of texts with a repeated window; none otherwise.
        F.expr("if(size(h) = size(array_distinct(h)), array(), sort_array(transform(h, (x, i) -> struct(x as x, i as i))))").alias("s"),
    )
    places = counted.withColumn(
        "p",
        F.expr("if(size(s) = 0, array(), sort_array(transform(filter(transform(s, (e, k) -> struct(e.i as i, coalesce(e.x = get(s, k - 1).x, false) or coalesce(e.x = get(s, k + 1).x, false) as twice)), e -> e.twice), e -> e.i)))"),
    )
    # A window covers three words, or as many as there are up to the next window.
    repeat = F.expr("aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1) - x, 3))), 0L, (total, x) -> total + x)")
    out = places.withColumn("n_repeat_words", repeat)
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    out = out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / n).alias("mean_word_chars"), (F.col("n_symbols") / n).alias("symbols_per_word"), (F.col("n_stops") / n).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / lines).alias("dup_line_ratio"), (F.col("n_list_lines") / lines).alias("list_line_ratio"), (F.col("n_cut_lines") / lines).alias("cut_line_ratio"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )
    out = out.withColumn("kept", ~F.col("base_failed") & verdict(TABLE if table is None else table))
    return sealed(out, *out.columns[1:])

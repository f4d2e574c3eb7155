"""Words of text without spaces: mined from a corpus, and cut out along the likeliest path.

Runs of CJK characters are cut into the words of a table of frequencies, so that the product of the words'
shares is largest. The table is a parameter: a dictionary, or what mine_words finds in the texts themselves,
strings that hold together (their parts meet far more often than by chance) and that stand freely (many
different characters come before and after them).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X

#: Longest word, least occurrences, least cohesion (natural logarithm), least entropy of the neighbours on either side.
LONGEST, LEAST, COHESION, FREEDOM = 4, 5, 1.0, 0.7
#: The same characters as those of runs.
IDEOGRAPH = re.compile("[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff]")
#: Words that a table may have to be sent to every task.
MOST_WORDS = 2_000_000


def cjk_runs(texts: DataFrame, text: str) -> DataFrame:
    """chars: the characters of each run, an edge at either end."""
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{X.CJK}]+"), F.lit(0))).alias("run")
    return texts.select(run).select(F.concat(F.array(F.lit("")), F.split("run", ""), F.array(F.lit(""))).alias("chars"))


def mine_words(texts: DataFrame, text: str, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, freedom: float = FREEDOM) -> DataFrame:
    """word, n, cohesion, freedom: strings of two characters or more that are words by their statistics (F1).

    cohesion is the least logarithm, over the places where a string can be parted, of how much more often it occurs
    than its parts would meet by chance; freedom the smaller entropy of the characters before and after it, an edge
    of a run being a character of its own. Counts are over all texts, combined in every task before the shuffle.
    """
    runs = cjk_runs(texts, text)
    window = "flatten(transform(sequence(1, {n}), n -> transform(filter(sequence(1, size(chars) - 2), i -> i + n <= size(chars) - 1), i -> struct(array_join(slice(chars, i + 1, n), '') as w, chars[i - 1] as before, chars[i + n] as after))))"
    rows = runs.select(F.explode(F.expr(window.format(n=longest))).alias("g")).select("g.*")
    sides = rows.groupBy("w", "before", "after").agg(F.count("*").alias("n"))
    counts = sides.groupBy("w").agg(F.sum("n").alias("n"))
    total = counts.where(F.length("w") == 1).agg(F.sum("n").cast("double").alias("t")).scalar()

    def entropy(side: str) -> DataFrame:
        near = sides.groupBy("w", side).agg(F.sum("n").cast("double").alias("c"))
        return near.groupBy("w").agg((F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias(f"{side}_entropy"))

    long = counts.where((F.length("w") > 1) & (F.col("n") >= least))
    parts = long.select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("k")).select("w", "n", F.expr("left(w, k)").alias("a"), F.expr("substr(w, k + 1)").alias("b"))
    of = lambda c, n: counts.select(F.col("w").alias(c), F.col("n").alias(n))
    met = parts.join(of("a", "x"), "a").join(of("b", "y"), "b").withColumn("t", total)
    held = met.groupBy("w", "n").agg(F.min(F.log(F.col("n") * F.col("t") / (F.col("x") * F.col("y")))).alias("cohesion")).where(F.col("cohesion") >= cohesion)
    free = held.join(entropy("before"), "w").join(entropy("after"), "w").withColumn("freedom", F.least("before_entropy", "after_entropy"))
    return free.where(F.col("freedom") >= freedom).select(F.col("w").alias("word"), "n", "cohesion", "freedom")


def best_path(run: str, weights: dict[str, float], unknown: float, longest: int) -> list[str]:
    """The words of a run whose weights sum to the most; of equals fewer words, then longer ones first. A character that is no word weighs unknown."""
    n = len(run)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)] * (n + 1)
    for i in range(n - 1, -1, -1):
        options = []
        for size in range(1, min(longest, n - i) + 1):
            w = weights.get(run[i : i + size], unknown if size == 1 else None)
            if w is not None:
                total, words, _ = best[i + size]
                options.append((w + total, words - 1, size))
        best[i] = max(options)
    out, i = [], 0
    while i < n:
        out.append(run[i : i + best[i][2]])
        i += best[i][2]
    return out


def segmenter(table: DataFrame, most: int = MOST_WORDS) -> Callable[[Column | str], Column]:
    """A tokens function from a table (word, n), for token_postings and SearchOptions: lower-case words, CJK runs cut along the best path.

    The table is counted before it is fetched and sent to all tasks; a larger one than most is an error.
    """
    many = table.count()
    if many > most:
        raise ValueError(f"{many} words are more than {most}")
    rows = table.select("word", "n").collect()
    total = math.log(sum(r.n for r in rows) + 1)
    weights = {r.word.lower(): math.log(r.n) - total for r in rows if r.word and r.n > 0}
    longest = max(map(len, weights), default=1)
    # Less than any word of the table: a run of unknown characters is better as a known word.
    unknown = min(weights.values(), default=0.0) - 1.0
    shared = table.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<string>")
    def cut(runs: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([None if r is None else [w for run in r for w in (best_path(run, own, unknown, longest) if IDEOGRAPH.match(run) else [run])] for r in runs])

    def tokens(c: Column | str) -> Column:
        text = F.lower(F.col(c) if isinstance(c, str) else c)
        parts = F.regexp_extract_all(text, F.lit(rf"[{X.CJK}]+|[\p{{L}}\p{{N}}_&&[^{X.CJK}]]+"), F.lit(0))
        return F.array_distinct(F.coalesce(cut(parts), F.array().cast("array<string>")))

    return tokens

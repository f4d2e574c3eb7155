"""Mined words against counted ones, and best paths against all paths."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.operators import retrieval as R
from quillstone.operators import words as W


def all_paths(run, weights, unknown):
    """Every way to part a run into words and single characters, with its weight."""
    if not run:
        return [(0.0, [])]
    out = []
    for size in range(1, len(run) + 1):
        w = weights.get(run[:size], unknown if size == 1 else None)
        if w is not None:
            out += [(w + rest, [run[:size], *words]) for rest, words in all_paths(run[size:], weights, unknown)]
    return out


def test_best_path_is_the_best_of_all():
    r = random.Random(6)
    letters = "天地人和大小"
    for _ in range(200):
        weights = {"".join(r.choices(letters, k=r.randint(1, 4))): -r.choice([1.0, 2.0, 3.5, r.random() * 5]) for _ in range(r.randint(0, 14))}
        unknown = min(weights.values(), default=0.0) - 1
        run = "".join(r.choices(letters, k=r.randint(0, 9)))
        got = W.best_path(run, weights, unknown, max(map(len, weights), default=1))
        best = max(all_paths(run, weights, unknown), key=lambda x: x[0])[0]
        assert "".join(got) == run and sum(weights.get(w, unknown) for w in got) == pytest.approx(best)


def plain_words(texts, longest, least, cohesion, freedom):
    import re

    count, before, after = Counter(), defaultdict(Counter), defaultdict(Counter)
    for t in texts:
        for run in re.findall("[一-鿿]+", t or ""):
            for n in range(1, longest + 1):
                for i in range(len(run) - n + 1):
                    w = run[i : i + n]
                    count[w] += 1
                    before[w][run[i - 1] if i else ""] += 1
                    after[w][run[i + n] if i + n < len(run) else ""] += 1
    total = sum(n for w, n in count.items() if len(w) == 1)
    entropy = lambda c: -sum(n / sum(c.values()) * math.log(n / sum(c.values())) for n in c.values())
    out = {}
    for w, n in count.items():
        if len(w) > 1 and n >= least:
            tight = min(math.log(n * total / (count[w[:k]] * count[w[k:]])) for k in range(1, len(w)))
            free = min(entropy(before[w]), entropy(after[w]))
            if tight >= cohesion and free >= freedom:
                out[w] = (n, tight, free)
    return out


def test_mined_words(spark):
    r = random.Random(2)
    known = ["天气", "人民", "大学生", "和平", "小", "北京", "飞机场"]
    texts = ["".join(r.choices(known, k=r.randint(0, 12))) + r.choice(["", "abc ", "，", "\n"]) + "".join(r.choices(known, k=3)) for _ in range(200)] + [None, "", "latin only", "一"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {x.word: (x.n, x.cohesion, x.freedom) for x in W.mine_words(df, "t").collect()}
    want = plain_words(texts, W.LONGEST, W.LEAST, W.COHESION, W.FREEDOM)
    assert got.keys() == want.keys() and all(got[w] == pytest.approx(want[w]) for w in want)
    assert {"天气", "人民", "大学生", "北京", "飞机场"} <= got.keys() and "学生" not in got and "气人" not in got
    assert W.mine_words(df.limit(0), "t").count() == 0


def test_searches_use_the_words(spark):
    from quillstone.plans import search as P

    table = spark.createDataFrame([("北京", 50), ("大学", 40), ("北京大学", 5), ("大学生", 30), ("生活", 30), ("京大", 1)], "word string, n long")
    cut = W.segmenter(table)
    rows = [(1, "北京大学生活 in Beijing"), (2, "东京大学"), (3, None), (4, ""), (5, "京大 ABC_1"), (6, "한국어 かな")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {x.k: x.w for x in df.select("k", cut("t").alias("w")).collect()}
    assert got == {1: ["北京", "大学", "生活", "in", "beijing"], 2: ["东", "京", "大学"], 3: [], 4: [], 5: ["京大", "abc_1"], 6: ["한국어", "かな"]}
    posts = R.token_postings(df, "k", "t", cut)
    asked = spark.createDataFrame([(1, "京大"), (2, "北京大学")], "query_id long, text string")
    hits = {(x.query_id, x.doc_id) for x in P.keyword_list(asked, posts, 10, words=cut).collect()}
    assert (1, 5) in hits and (1, 1) not in hits and (2, 1) in hits
    with pytest.raises(ValueError, match="more than 3"):
        W.segmenter(table, most=3)


def test_summary_tree_is_a_fixed_point_of_every_document(spark):
    import numpy as np

    from quillstone.operators import clustering as K

    g = np.random.default_rng(4)
    vectors = {(d, i): g.normal(size=5) for d, n in ((1, 70), (2, 12), (3, 2), (4, 1300)) for i in range(n)}
    rows = [(d, i, f"{d}.{i}", v.tolist()) for (d, i), v in vectors.items()] + [(2, 99, "bare", None), (5, 0, "alone", None), *((6, i, "same", [1.0, 2.0]) for i in range(9))]
    df = spark.createDataFrame(rows, "document_id long, node long, content string, embedding array<float>")
    out = K.summary_tree(df).collect()
    by = {(x.document_id, x.node): x for x in out}
    assert len(by) == len(out) and {k for k, x in by.items() if x.level == 0} == {(d, i) for d, i, *_ in rows}
    assert [x.parent for x in out if x.document_id in (3, 5)] == [-1] * 3 and by[2, 99].parent == -1
    for d, k in ((1, 3), (2, 2), (4, 16)):
        own = [i for e, i in vectors if e == d]
        groups = defaultdict(list)
        for i in own:
            groups[by[d, i].parent].append(i)
        assert len(groups) == k and all(by[d, p].level == 1 for p in groups)
        means = {p: np.mean([np.float32(vectors[d, i]) for i in group], 0) for p, group in groups.items()}
        for i in own:
            far = {p: ((np.float32(vectors[d, i]) - m) ** 2).sum() for p, m in means.items()}
            assert far[by[d, i].parent] <= min(far.values()) + 1e-3
        for p, group in groups.items():
            assert by[d, p].content == "\n\n".join(by[d, i].content for i in sorted(group))
    tops = {p.parent for p in out if p.document_id == 1 and p.level == 1}
    assert len(tops) == 2 and all(by[1, t].level == 2 and by[1, t].parent == -1 for t in tops)
    assert len({by[6, i].parent for i in range(9)}) == 1
    assert K.summary_tree(df.limit(0)).count() == 0

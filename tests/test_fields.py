"""Weighted fields, places and snippets against their plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.operators import fields as S

WORD = re.compile(r"[^\W]+")


def spelled(t):
    return re.findall(r"\w+", t or "")


def plain_search(queries, docs, weights, k):
    """(query_id, rank) -> (doc_id, score), by the definition."""
    index = {i: {f: [w.lower() for w in spelled(t)] for f, t in own.items()} for i, own in docs.items()}
    length = {i: sum(map(len, own.values())) for i, own in index.items()}
    full = [n for n in length.values() if n]
    avg = sum(full) / len(full) if full else 0
    out = {}
    for q, text in queries:
        terms = list(dict.fromkeys(w.lower() for w in spelled(text)))
        score = Counter()
        for t in terms:
            tf = {i: sum(weights[f] * sum(w.startswith(t) for w in ws) for f, ws in own.items()) for i, own in index.items()}
            held = [i for i, own in index.items() if any(w.startswith(t) for ws in own.values() for w in ws)]
            idf = max(1e-6, math.log((len(full) - len(held) + 0.5) / (len(held) + 0.5)))
            for i in held:
                score[i] += idf * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * length[i] / avg))
        for rank, (i, s) in enumerate(sorted(((i, round(s, 9)) for i, s in score.items()), key=lambda x: (-x[1], x[0]))[:k], 1):
            out[q, rank] = (i, s)
    return out


def test_field_search(spark):
    r = random.Random(5)
    vocabulary = ["ring", "rings", "bolt", "blue", "b", "é", "large", "Large", "x1", "of", "日本"]
    make = lambda n: " ".join(r.choices(vocabulary, k=r.randint(0, n)))
    docs = {i: {"head": make(4), "body": make(30)} for i in range(120)} | {900: {"head": None, "body": None}, 901: {"head": "", "body": "ring"}}
    queries = [(1, "ring"), (2, "b blue zz"), (3, "É LARGE ring ring"), (4, ""), (5, "nothing"), (6, None), (7, "日")]
    weights = {"head": 10.0, "body": 0.5}
    df = spark.createDataFrame([(i, d["head"], d["body"]) for i, d in docs.items()], "id long, head string, body string")
    best, places = S.field_search(spark.createDataFrame(queries, "query_id long, text string"), df, "id", {f: (S.spelled(f), w) for f, w in weights.items()}, 7)
    got = {(x.query_id, x["rank"]): (x.doc_id, x.score) for x in best.collect()}
    want = plain_search(queries, docs, weights, 7)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    kept = {(q, i) for (q, _), (i, _) in want.items()}
    spots = Counter((x.query_id, x.j, x.doc_id, x.field, x.place) for x in places.collect())
    terms = {q: list(dict.fromkeys(w.lower() for w in spelled(t))) for q, t in queries}
    assert spots == Counter((q, j, i, f, p) for q, i in kept for j, t in enumerate(terms[q]) for f, text in docs[i].items() for p, w in enumerate(spelled(text)) if w.lower().startswith(t))
    assert S.field_search(spark.createDataFrame(queries, "query_id long, text string"), df.limit(0), "id", {"body": (S.spelled("body"), 1.0)}, 7)[0].count() == 0


def plain_window(places, most):
    """(first, last): the most terms within most words, the shortest, the earliest; over all pairs of places."""
    spots = sorted({p for _, p in places})
    at = defaultdict(set)
    for j, p in places:
        at[p].add(j)
    spans = [(-len(set().union(*(at[p] for p in spots if a <= p <= b))), b - a, a) for a in spots for b in spots if a <= b < a + most]
    _, size, first = min(spans)
    return first, first + size


def test_best_windows(spark):
    r = random.Random(9)
    rows, want = [], {}
    for i in range(150):
        own = {(r.randrange(5), r.randrange(60)) for _ in range(r.randint(1, 25))}
        rows += [(1, j, i, p) for j, p in own]
        want[i] = plain_window(own, 8)
    got = {x.doc_id: (x.first, x.last) for x in S.best_windows(spark.createDataFrame(rows, "query_id long, j int, doc_id long, place int"), 8).collect()}
    assert got == want


def plain_snippet(text, first, last, marks, most):
    found = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    if not found:
        return text[:most]
    n = len(found)
    spare = most - ((last or 0) - (first or 0) + 1)
    low = max(0, min((first or 0) - spare // 2, n - most))
    end = min(low + most, n)
    out = "..." if low else text[: found[0][0]]
    for i in range(low, end):
        a, b = found[i]
        out += f"<<{text[a:b]}>>" if i in marks else text[a:b]
        out += text[b : found[i + 1][0]] if i + 1 < end else text[b:] if end == n else ""
    return out + ("..." if end < n else "")


def test_snippets(spark):
    r = random.Random(3)
    rows, want = [], {}
    for i in range(120):
        text = "".join(r.choice(["word", "é1", "x_y", " ", ", ", "\n", "...", "日本"]) for _ in range(r.randint(0, 60)))
        n = len(spelled(text))
        marks = sorted(r.sample(range(n), min(n, r.randint(1, 4)))) if n else []
        near = [m for m in marks if m < marks[0] + 6] if marks else []
        first, last = (near[0], near[-1]) if near else (None, None)
        rows.append((i, text, first, last, marks))
        want[i] = plain_snippet(text, first, last, marks, 6)
    df = spark.createDataFrame(rows, "id long, t string, first int, last int, marks array<int>")
    got = {x.id: x.s for x in df.select("id", S.snippet(F.col("t"), F.col("first"), F.col("last"), F.col("marks"), 6).alias("s")).collect()}
    assert got == want


def test_keyword_search_of_chunks_and_of_pages(spark):
    pages = spark.createDataFrame([("people/ann", "Ann Lee", "Ann wrote letters", "met Bob", "person", None), ("notes/x", "Other", "letters to Ann", None, "note", None), ("archive/y", "Ann", "Ann Ann", None, "note", None), ("notes/z", "Ann", "", "Ann", "note", None), ("notes/gone", "Ann", "Ann", None, "note", "2024-01-01")], "slug string, title string, compiled_truth string, timeline string, page_type string, deleted_at string")
    chunks = spark.createDataFrame([(1, "people/ann", "Ann wrote, letters; to all.", "compiled_truth", "fn_ann"), (2, "notes/x", "say ann twice: Ann", "timeline", None), (3, "archive/y", "Ann", "compiled_truth", None)], "chunk_id long, slug string, chunk_text string, chunk_source string, symbol_name string")
    q = spark.createDataFrame([(1, "ann"), (2, "letters ann"), (3, "nobody")], "query_id long, text string")
    got = {(x.query_id, x["rank"]): x for x in S.keyword_search(q, chunks, pages).collect()}
    assert {(k, x.slug, x.chunk_id) for k, x in got.items() if k[0] < 3} >= {((2, 1), "people/ann", 1)} and all(x.slug not in ("archive/y", "notes/gone") for x in got.values())
    assert got[2, 1].snippet == "<<Ann>> wrote, <<letters>>; to all." and got[2, 1].title == "Ann Lee" and (3, 1) not in got
    assert {x.chunk_id for x in S.keyword_search(q, chunks, pages, detail="low").collect()} == {1} and {x.chunk_id for x in S.keyword_search(q, chunks, pages, page_type="note").collect()} == {2}
    page = {(x.query_id, x.slug): x for x in S.keyword_search(q, chunks.limit(0), pages).collect()}
    assert {s for i, s in page if i == 1} == {"people/ann", "notes/x", "notes/z"} and page[1, "notes/z"].snippet == "" and page[2, "notes/x"].snippet == "<<letters>> to <<Ann>>"
    assert {s for i, s in ((x.query_id, x.slug) for x in S.keyword_search(q, chunks.limit(0), pages, detail="low").collect()) if i == 1} == {"people/ann", "notes/x"}

"""Substring and likeness search, and chains of fallbacks, against their plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.operators import facade as A
from quillstone.operators import retrieval as R
from quillstone.operators.cascade import cascade
from quillstone.operators.substring import alike, containing

LETTERS = "abAB éÉ\U0001f600%_\\日"


@pytest.mark.parametrize("fold", [True, False])
def test_containing(spark, fold):
    r = random.Random(4)
    make = lambda most: "".join(r.choice(LETTERS) for _ in range(r.randint(0, most)))
    texts = [(i, make(30)) for i in range(200)] + [(500, None), (501, ""), (502, "ab" * 4000)]
    asks = [(i, make(7)) for i in range(150)] + [(200, None), (201, "ab"), (201, "É"), (202, "no such text in any")]
    same = (lambda s: s.lower()) if fold else (lambda s: s)
    want = Counter((q, i) for q, p in asks for i, t in texts if p and t is not None and same(p) in same(t))
    got = containing(spark.createDataFrame(asks, "query_id long, pattern string"), spark.createDataFrame(texts, "doc_id long, text string"), fold)
    assert Counter(map(tuple, got.collect())) == want


def test_containing_nothing(spark):
    texts, asks = spark.createDataFrame([(1, "abc")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "query_id long, pattern string")
    assert containing(asks.limit(0), texts).count() == 0 and containing(asks, texts.limit(0)).count() == 0
    assert [tuple(x) for x in containing(asks, texts).collect()] == [(1, 1)]


def trigrams(s):
    p = f"  {s.lower()}  "
    return {p[i : i + 3] for i in range(len(p) - 2)}


@pytest.mark.parametrize("least", [0.3, 0.55, 0.8, 1.0])
def test_alike(spark, least):
    r = random.Random(int(least * 100))
    words = ["ring", "rings", "bolt", "blue", "large", "lager", "a", "x-1", "é"]
    names = [(i, " ".join(r.choices(words, k=r.randint(0, 4)))) for i in range(150)] + [(900, None)]
    asks = [(i, " ".join(r.choices(words, k=r.randint(0, 4))) + r.choice(["", "s", " q"])) for i in range(40)]
    want = {}
    for q, a in asks:
        for i, b in names:
            if b is not None:
                x, y = trigrams(a), trigrams(b)
                if len(x & y) / len(x | y) >= least:
                    want[q, i] = len(x & y) / len(x | y)
    got = {(x.query_id, x.doc_id): x.score for x in alike(spark.createDataFrame(asks, "query_id long, text string"), spark.createDataFrame(names, "doc_id long, text string"), least).collect()}
    assert got == pytest.approx(want) and want


def test_fuzzy_pages_take_the_better_field_inside_a_directory(spark):
    pages = [("people/ann", "Ann Lee", "wrote letters"), ("people/bob", "Robert", "Ann Lee"), ("peoples/x", "Ann Lee", None), ("notes/ann", None, "Ann Leed"), ("notes/far", "far", "x" * 600 + "Ann Lee")]
    asks = [(1, "Ann Lee", None), (2, "Ann Lee", "people"), (3, "Ann Lee", "people/"), (4, "zzz", None)]
    got = R.fuzzy_pages(spark.createDataFrame(asks, "query_id long, text string, directory string"), spark.createDataFrame(pages, "slug string, title string, body string"))
    by = {q: [x.slug for x in sorted(got.collect(), key=lambda x: x["rank"]) if x.query_id == q] for q in (1, 2, 3, 4)}
    assert by[1][:3] == ["people/ann", "people/bob", "peoples/x"] and set(by[1]) == {"people/ann", "people/bob", "peoples/x", "notes/ann"}
    assert by[2] == by[3] == ["people/ann", "people/bob"] and by[4] == []


def test_resolve_of_short_and_inner_words(spark):
    pages = spark.createDataFrame([("alpha-one",), ("beta/alphabet",), ("a",), ("gamma",)], "slug string")
    asks = spark.createDataFrame([(1, "al"), (2, "lph"), (3, "gamma"), (4, "Gamma"), (5, "b"), (6, "m"), (7, ""), (8, None), (9, "qq"), (10, "gama")], "query_id long, text string")
    got = Counter((x.query_id, x.slug, x.stage) for x in R.resolve(asks, pages).collect())
    assert got == Counter({(1, "alpha-one", 3): 1, (2, "alpha-one", 5): 1, (2, "beta/alphabet", 5): 1, (3, "gamma", 1): 1, (4, "gamma", 2): 1, (5, "beta/alphabet", 3): 1, (6, "gamma", 5): 1, (10, "gamma", 4): 1})


def test_cascade_asks_only_what_is_open(spark):
    queries = spark.createDataFrame([(i,) for i in range(6)], "query_id long")
    seen = []

    def stage(*answers):
        def find(q):
            asked = sorted(x.query_id for x in q.collect())
            seen.append(asked)
            return spark.createDataFrame([(a, x) for a, x in answers if a in asked], "query_id long, x int")

        return find

    hits, attempts, _ = cascade(queries, [("a", stage((0, 1), (0, 2), (3, 1))), ("b", stage()), ("c", stage((1, 9), (2, 9), (0, 9))), ("d", stage((4, 5))), ("e", stage((5, 6))), ("f", stage((0, 0)))])
    assert seen == [[0, 1, 2, 3, 4, 5], [1, 2, 4, 5], [1, 2, 4, 5], [4, 5], [5]]
    assert Counter((x.query_id, x.x, x.stage, x.stage_name) for x in hits.collect()) == Counter([(0, 1, 1, "a"), (0, 2, 1, "a"), (3, 1, 1, "a"), (1, 9, 3, "c"), (2, 9, 3, "c"), (4, 5, 4, "d"), (5, 6, 5, "e")])
    tried = {(x.query_id, x.stage): x.hits for x in attempts.collect()}
    assert tried[0, 1] == 2 and tried[1, 2] == 0 and (0, 2) not in tried and len(tried) == sum(map(len, seen))


def test_cascade_with_answers_of_its_own(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    one = lambda x: lambda q: q.selectExpr("query_id", f"{x} * query_id as x")
    hits, attempts, rest = cascade(queries, [("weak", one(1)), ("strong", one(10))], answered=lambda df: df.where("x >= 2"))
    assert sorted(map(tuple, hits.select("query_id", "x", "stage").collect())) == [(1, 10, 2), (2, 2, 1)] and attempts.count() == 3 and [tuple(x) for x in rest.select("query_id", "x", "stage").collect()] == [(1, 1, 1)]
    assert cascade(queries.limit(0), [("weak", one(1)), ("strong", one(10))])[0].count() == 0


def test_timeline_hits_of_one_slug(spark):
    day = "2024-01-0"
    rows = [(i, f'{{"summary":"prepayment {i}"}}', f"{day}{i}", 7, "timeline_event", "accepted", i % 2) for i in range(1, 5)] + [(9, '{"summary":"prepayment"}', "2024-02-01", 7, "timeline_event", "rejected", 1)]
    c = spark.createDataFrame(rows, "candidate_id long, payload string, created_at string, document_id long, candidate_type string, status string, artifact_id long")
    docs = spark.createDataFrame([(7, "Title", "name.md")], "document_id long, title string, name string")
    p = spark.createDataFrame([(0, "brain_shadow_page", "slug:documents/x", "active"), (1, "brain_shadow_page", "slug:y", "stale"), (1, "brain_shadow_page", "slug:documents/z", "active"), (1, "brain_shadow_page", "slug:z", "active")], "artifact_id long, projection_type string, projection_ref string, status string")
    q = spark.createDataFrame([(1, "PAYMENT", None), (2, "pay", "x"), (3, "pay", "y"), (4, "ment", "slug:z"), (5, "itle", None)], "query_id long, text string, slug string")
    got = {(x.query_id, x["rank"]): x.candidate_id for x in A.timeline_hits(q, c, docs, 20, p).collect()}
    assert got == {(1, 1): 4, (1, 2): 3, (1, 3): 2, (1, 4): 1, (2, 1): 4, (2, 2): 2, (4, 1): 3, (4, 2): 1, (5, 1): 4, (5, 2): 3, (5, 3): 2, (5, 4): 1}


def test_title_candidates_of_parts_of_words_and_slugs(spark):
    arts = spark.createDataFrame([(1, "u1", "documents/plan", "prepayments", "active"), (2, "u2", "docs/other", "budget", "active"), (3, "u3", "documents/gone", "prepayment", "deleted")], "artifact_id long, artifact_uid string, slug string, name string, status string")
    pro = spark.createDataFrame([(1, "kb_document:5", "active")], "artifact_id long, projection_ref string, status string")
    docs = spark.createDataFrame([(5, "Yearly", "year.md", None)], "document_id long, title string, name string, deleted_at timestamp")
    q = spark.createDataFrame([(1, "payment", None), (2, "ear budg", None), (3, "payment", "plan"), (4, "payment", "docs/other"), (5, "zzz", None)], "query_id long, text string, slug string")
    got = sorted((x.query_id, x["rank"], x.artifact_uid, x.title, x.score) for x in A.title_candidates(q, arts, pro, docs).collect())
    assert got == [(1, 1, "u1", "Yearly", 1.0), (2, 1, "u1", "Yearly", 0.5), (2, 2, "u2", "budget", 0.5), (3, 1, "u1", "Yearly", 1.0)]


def test_facade_takes_the_first_useful_attempt(spark):
    from quillstone.plans import search as P

    answers = {"alpha beta": [("evidence", "alpha only")], "alpha beta gamma": [("evidence", "ALPHA then beta"), ("evidence", "x")], "page": [("brain", "anything")], "half done": [("evidence", "half of it")], "one": [("evidence", "nothing of it")]}
    seen = []

    def search(q):
        rows = [(x.query_id, route, "r", "", text, 1.0) for x in q.collect() for route, text in answers.get(x.text, [])]
        seen.append(sorted((x.query_id, x.text, x.strategy) for x in q.collect()))
        return spark.createDataFrame(rows, "query_id long, route string, ref string, title string, content string, score double")

    q = spark.createDataFrame([(1, "alpha beta", "brain_first"), (2, "page", "brain_first"), (3, "half done", "timeline_first"), (4, "budget", "brain_first"), (5, "none such", "brain_first"), (6, "one", "brain_first"), (7, "", "brain_first")], "query_id long, text string, strategy string")
    synonyms = spark.createDataFrame([("beta", "gamma", 0.9), ("other", "x", 1.0)], "token string, synonym string, score double")
    arts = spark.createDataFrame([(1, "u1", "documents/plan", "budgets", "active")], "artifact_id long, artifact_uid string, slug string, name string, status string")
    pro = spark.createDataFrame([], "artifact_id long, projection_ref string, status string")
    docs = spark.createDataFrame([], "document_id long, title string, name string, deleted_at timestamp")
    hits, outcomes, attempts = P.facade_query(q, search, arts, pro, docs, synonyms)
    got = {x.query_id: (x.stage, x.reason, x.attempts, x.hits, x.confidence) for x in outcomes.collect()}
    assert got == {
        1: ("core_terms_or", "primary_low_quality", 3, 2, "medium"), 2: ("original_query", None, 1, 1, "medium"), 3: ("partial_results", "primary_low_quality", 4, 1, "medium"),
        4: ("title_slug", "primary_no_hits", 4, 1, "low"), 5: ("no_results", "primary_no_hits", 4, 0, "none"), 6: ("original_query", None, 1, 1, "medium"), 7: ("no_results", "primary_no_hits", 4, 0, "none"),
    }
    assert [x.ref for x in hits.where("query_id = 4").collect()] == ["u1"] and hits.where("query_id = 1").count() == 2
    later = [s for s in seen if s and s[0][1] != "alpha beta"]
    assert all(all(i not in (2, 6) for i, *_ in s) for s in later) and (1, "alpha beta gamma", "brain_first") in [x for s in seen for x in s]
    assert attempts.where("query_id = 2").count() == 1


def test_vector_index_and_exact_blocks(spark, sf_dir, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F

    from quillstone.operators import vectors as V
    from quillstone.session import table

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    rows = e.orderBy("vec_id").collect()
    m = V.unit(np.array([r.embedding for r in rows], float))
    ids = np.array([r.vec_id for r in rows])
    asked = np.flatnonzero(ids % 10 == 0)
    want = {(int(ids[a]), int(i)) for a in asked for i in ids[np.lexsort((ids, -(m[a] @ m.T)))[:10]]}
    found = lambda df: {(x.query_id, x.vec_id) for x in df.collect()}
    assert found(V.exact_neighbours(q, e, 10)) == want == found(V.exact_neighbours(q, e, 10, slices=3))
    index = V.build_index(e, str(tmp_path / "index"))
    held = spark.read.parquet(f"{index.folder}/blocks").select(F.explode("ids").alias("i"))
    assert held.count() == held.distinct().count() == len(rows)
    again = V.open_index(spark, index.folder)
    assert (again.model.centres == index.model.centres).all() and again.model.probes == index.model.probes < len(index.model.centres)
    assert len(found(V.search_index(q, again, e, 10)) & want) >= 0.9 * len(want)
    assert len(found(V.search_index(q, index, e, 10, probes=10**6)) & want) >= 0.99 * len(want)


def test_vector_index_of_copies_odd_lengths_and_nothing(spark, tmp_path):
    from quillstone.operators import vectors as V

    rows = [(i, [1.0, float(i % 3), 0.5, 0.25, 0.1]) for i in range(3000)] + [(5000, [0.0] * 5), (5001, [1.0, 2.0]), (5002, None), (5003, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0, 0.5, 0.25, 0.1]), ("b", [2.0, 4.0]), ("c", None), ("d", [])], "query_id string, embedding array<float>")
    exact = {}
    for x in V.exact_neighbours(q, v, 5).collect():
        exact.setdefault(x.query_id, []).append((x["rank"], x.vec_id, round(x.score, 6)))
    assert sorted(exact["a"]) == [(k + 1, 3 * k, 1.0) for k in range(5)] and sorted(exact["b"])[0] == (1, 5001, 1.0) and "c" not in exact and sorted(exact["d"])[0] == (1, 0, 0.0)
    index = V.build_index(v, str(tmp_path / "a"), cells=4)
    got = [(x.query_id, x["rank"], round(x.score, 6)) for x in V.search_index(q, index, v, 5).collect()]
    assert sorted(got) == [("a", k, 1.0) for k in range(1, 6)]
    nothing = V.build_index(v.limit(0), str(tmp_path / "b"))
    assert V.search_index(q, nothing, v.limit(0), 5).count() == 0 and V.exact_neighbours(q, v.limit(0), 5).count() == 0


def test_greedy_rounds_keep_what_one_pass_keeps(spark):
    import re

    r = random.Random(31)
    vocabulary = [f"w{k}" for k in range(40)]
    base = [r.sample(vocabulary, r.randint(5, 25)) for _ in range(12)]
    rows = []
    for i in range(400):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((r.choice([1, 2, 3, None]), i, r.choice(["s", "t"]), r.choice(["compiled_truth", "timeline", None]), r.choice(["Ä, ", "", "x-"]) + " ".join(words), float(r.randint(0, 20))))
    rows += [(1, 900, "s", None, None, 5.0), (1, 901, "s", None, "", 5.0), (1, 902, "s", None, " - ", 5.0), (1, 903, "s", None, "one", None), (1, 904, "s", None, "ONE", None)]

    def plain(keys, key):
        kept = Counter()
        groups = {}
        for row in sorted(rows, key=key):
            own = set(re.findall(r"[^\W_]+", (row[4] or "").lower()))
            before = groups.setdefault(keys(row), [])
            if not any(own | b and len(own & b) / len(own | b) > 0.85 for b in before):
                before.append(own)
                kept[row[1]] += 1
        return kept

    df = spark.createDataFrame(rows, "query_id int, chunk_id int, slug string, source string, chunk_text string, score double")
    low = lambda x: (x is None, -(x or 0))
    assert Counter(x.chunk_id for x in R.greedy_text_dedup(df).collect()) == plain(lambda x: x[0], lambda x: (low(x[5]), x[1]))
    truth = lambda x: (x[3] is None, -(x[3] == "compiled_truth"))
    assert Counter(x.chunk_id for x in R.cross_source_dedup(df).collect()) == plain(lambda x: (x[0], x[2]), lambda x: (truth(x), low(x[5]), x[1]))
    out = R.greedy_text_dedup(df.withColumn("__p", F.lit(1)).drop("__p").limit(0))
    assert out.count() == 0 and out.columns == df.columns


def test_remembered_results(spark, tmp_path):
    asked = []

    def search(q):
        rows = q.collect()
        asked.append(sorted(x.key for x in rows))
        return spark.createDataFrame([(x.query_id, f"{x.key}{k}") for x in rows for k in range(len(x.key) - 1)], "query_id long, ref string")

    at = lambda s: F.lit(f"2025-01-01 00:{s // 60:02d}:{s % 60:02d}").cast("timestamp")
    q = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "c"), (4, "xyz")], "query_id long, key string")
    folder, less = str(tmp_path / "kept"), str(tmp_path / "less")
    want = [(1, "ab0"), (2, "ab0"), (3, None), (4, "xyz0"), (4, "xyz1")]
    for second, fresh in ((0, {1, 2, 3, 4}), (20, set()), (45, {1, 2, 3, 4})):
        got = A.remembered(q, search, folder, at(second)).collect()
        assert sorted((x.query_id, x.ref) for x in got) == sorted(want, key=lambda x: (x[0], x[1] or "")) and {x.query_id for x in got if x.fresh} == fresh
    assert [a for a in asked if a] == [["ab", "c", "xyz"], ["ab", "c", "xyz"]]
    A.forget(spark, folder, less, at(50), most=2)
    assert {(x.key) for x in spark.read.parquet(less).collect()} == {"ab", "c"}
    assert {x.query_id for x in A.remembered(q, search, less, at(51)).collect() if x.fresh} == {4}


def test_backup_that_lost_rows_is_refused(spark, tmp_path):
    from quillstone.operators import lifecycle as L

    t = spark.range(10)
    L.backup({"a": t, "b": t}, str(tmp_path))
    assert L.read_backup(spark, str(tmp_path))["b"].count() == 10
    t.limit(9).write.mode("overwrite").parquet(f"{tmp_path}/b.parquet")
    with pytest.raises(ValueError, match="not whole"):
        L.read_backup(spark, str(tmp_path))


def test_unified_query_by_provenance_and_reranking_with_gaps(spark):
    from quillstone.plans import search as P

    q = spark.createDataFrame([(1, "who is Ann", "provenance"), (2, "who is Ann", "brain_first"), (3, "who is Ann", "evidence_first"), (4, "when was it", None)], "query_id long, text string, strategy string")
    ready = lambda ref: spark.createDataFrame([(i, ref, 0.5) for i in (1, 2, 3, 4)], "query_id long, ref string, score double")
    out = P.unified_query(q, ready("p"), ready("e"), ready("t"), ready("r"))
    first = {x.query_id: (x.ref, x.strategy) for x in out.where("rank = 1").collect()}
    assert first == {1: ("r", "provenance"), 2: ("p", "brain_first"), 3: ("e", "evidence_first"), 4: ("t", "timeline_first")}
    assert out.where("query_id = 1").count() == 1 and out.where("query_id > 1 and route = 'provenance'").count() == 0
    hits = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.7)], "query_id long, node_id long, score double")
    some = lambda h: h.where("node_id <> 10").withColumn("score", F.when(F.col("node_id") == 12, 5.0))
    assert sorted(tuple(x) for x in P.reranked(hits, some, ["query_id", "node_id"]).collect()) == [(1, 10, 0.9), (1, 11, 0.8), (1, 12, 5.0)]

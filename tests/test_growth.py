"""Work that must grow with the input only: hubs, repeated queries, repeated texts."""

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.llm import line_dedup as LD
from quillstone.operators import chunking as C
from quillstone.operators import clustering as K
from quillstone.operators import code as CO
from quillstone.operators import extraction as E
from quillstone.operators import facade as A
from quillstone.operators import fields as FS
from quillstone.operators import graph as G
from quillstone.operators import retrieval as R
from quillstone.operators import substring as S
from quillstone.operators import vectors as VX
from quillstone.plans import catalogue, catalogue_facade, catalogue_text
from quillstone.plans import search as P


def test_hubs_are_walked_as_far_as_a_query_can_take(spark):
    """A name that many call and many define; the edges between them are never laid out."""
    chunks = spark.createDataFrame([(i, f"f{i % 3}", None) for i in range(60)], "chunk_id long, symbol_name string, symbol_qualified string")
    calls = spark.createDataFrame([(i, (i * 7) % 60 if i % 4 == 0 else None, f"f{i % 5}") for i in range(60)], "from_chunk_id long, to_chunk_id long, to_symbol string")
    anchors = spark.createDataFrame([(q, c, float(c % 2 + 1)) for q in range(12) for c in {q, q * 5 % 60, q * 11 % 60}], "query_id long, chunk_id long, score double")
    rows = lambda df: sorted((x.query_id, x.chunk_id, x.hop, round(x.score, 6)) for x in df.collect())
    edges = [(x.src, x.dst) for x in G.symbol_edges(calls, chunks).collect()]
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in range(60)}
    expected = []
    for q in range(12):
        frontier = {c: float(c % 2 + 1) for c in {q, q * 5 % 60, q * 11 % 60}}
        seen = set(frontier)
        for hop in (1, 2):
            met = {}
            for n, s in frontier.items():
                for m in near[n] - seen:
                    met[m] = max(met.get(m, 0), s / (1 + hop))
            frontier = dict(sorted(met.items(), key=lambda x: (-x[1], x[0]))[:4])
            seen |= set(frontier)
            expected += [(q, m, hop, round(s, 6)) for m, s in frontier.items()]
    assert rows(G.expand_calls(anchors, calls, chunks, 2, 4)) == rows(G.expand_anchors(anchors, spark.createDataFrame(edges, "src long, dst long"), 2, 4)) == sorted(expected)
    assert G.nearest_ends(spark.createDataFrame(edges, "src long, dst long"), 4).groupBy("src").count().where("count > 4").count() == 0


def test_scores_are_rounded_once_and_count_what_they_are_told(spark):
    """texts without terms count in n, and no score is rounded to nine digits before it is to six."""
    docs = spark.createDataFrame([(i, "ab " * (i % 7) + "cd" if i % 5 else "!") for i in range(40)], "doc_id long, text string")
    q = spark.createDataFrame([(1, ["ab", "cd"])], "query_id long, terms array<string>")
    posts = R.token_postings(docs, "doc_id", "text", lambda c: F.filter(F.split(c, " "), lambda w: w.rlike("[a-z]")))
    stats = docs.agg(F.count("*").alias("n")).crossJoin(posts.agg(F.count("*").alias("t"))).select("n", (F.col("t") / F.col("n")).alias("avgdl"))
    got = lambda **how: {x.doc_id: x.score for x in R.prefix_bm25(q, posts, "terms", prefix=False, **how).collect()}
    exact = got(digits=15, stats=stats)
    assert got(digits=6, stats=stats) == {i: round(v, 6) for i, v in exact.items()}
    assert got() != {i: round(v, 9) for i, v in exact.items()} and len(exact) == 32


def test_rows_of_one_key_are_one_document(spark):
    """two pages of one address; its length is that of both, wherever its words are."""
    docs = spark.createDataFrame([("a", "x y z"), ("a", "x"), ("b", "x y"), ("c", "y y y"), ("d", "w")], "slug string, t string")
    q = spark.createDataFrame([(1, "x y")], "query_id long, text string")
    best, _ = FS.field_search(q, docs, "slug", {"t": (FS.spelled("t"), 1.0)}, 9)
    whole = docs.groupBy("slug").agg(F.concat_ws(" ", F.array_sort(F.collect_list("t"))).alias("t"))
    same, _ = FS.field_search(q, whole, "slug", {"t": (FS.spelled("t"), 1.0)}, 9)
    rows = lambda df: sorted((x.doc_id, x.score, x["rank"]) for x in df.collect())
    assert rows(best) == rows(same) and len(rows(best)) == 3


def test_equal_texts_are_compared_once(spark, monkeypatch):
    """50 queries of two texts over 300 names of three are six comparisons; each query has its k best, by id where they tie."""
    names = spark.createDataFrame([(i, ("blue ring", "blue gear", "red bolt")[i % 3]) for i in range(300)] + [(999, None)], "doc_id long, text string")
    q = spark.createDataFrame([(i, ("xlue ring", "blue gea")[i % 2]) for i in range(50)], "query_id long, text string")
    sizes, alike = [], R.alike
    monkeypatch.setattr(R, "alike", lambda a, b, least: sizes.append((a.count(), b.count())) or alike(a, b, least))
    got = {(x.query_id, x["rank"]): (x.doc_id, x.score) for x in R.fuzzy(q, names, 0.3, 5).collect()}
    every = {(x.query_id, x["rank"]): (x.doc_id, x.score) for x in R.top_k(alike(q, names, 0.3), 5).collect()}
    assert sizes == [(2, 3)] and got == every and len(got) == 250


def counted(monkeypatch, module, name):
    """How many queries each call of module.name got."""
    seen, own = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda q, *a, **k: seen.append(q.count()) or own(q, *a, **k))
    return seen


def test_code_search_asks_equal_queries_once(spark, monkeypatch):
    """F5"""
    chunks = spark.createDataFrame([(i, f"x/{i}", "code", "timeline", f"fn ring {i}") for i in range(9)], "chunk_id long, slug string, page_type string, source string, chunk_text string")
    seen = counted(monkeypatch, R, "prefix_bm25")
    got = A.code_search(spark.createDataFrame([(i, ("ring", "fn 3")[i % 2]) for i in range(20)], "query_id long, text string"), chunks, k=4)
    assert seen == [2] and got.count() == 80 and {(x.query_id, x.chunk_id) for x in got.where("rank = 1").collect()} == {(i, 3 * (i % 2)) for i in range(20)}


def test_title_candidates_ask_equal_queries_once(spark, monkeypatch):
    """F4"""
    arts = spark.createDataFrame([(i, f"u{i}", f"documents/{i}", ("ring", "gear")[i % 2], "active") for i in range(6)], "artifact_id long, artifact_uid string, slug string, name string, status string")
    pro = spark.createDataFrame([], "artifact_id long, projection_ref string, status string")
    docs = spark.createDataFrame([], "document_id long, title string, name string, deleted_at string")
    seen = counted(monkeypatch, A, "containing")
    got = A.title_candidates(spark.createDataFrame([(i, "gear") for i in range(20)], "query_id long, text string"), arts, pro, docs)
    assert seen == [1] and {(x.query_id, x.artifact_uid) for x in got.collect()} == {(i, u) for i in range(20) for u in ("u1", "u3", "u5")}


def test_facade_query_asks_equal_queries_once(spark):
    """F6"""
    arts = spark.createDataFrame([], "artifact_id long, artifact_uid string, slug string, name string, status string")
    pro = spark.createDataFrame([], "artifact_id long, projection_ref string, status string")
    docs = spark.createDataFrame([], "document_id long, title string, name string, deleted_at string")
    seen = []

    def search(q):
        seen.append(q.count())
        return q.where("text = 'ring'").select("query_id", F.lit("brain").alias("route"), F.lit("r").alias("ref"), F.lit("").alias("title"), F.lit("ring").alias("content"), F.lit(1.0).alias("score"))

    q = spark.createDataFrame([(i, ("ring", "zzz")[i % 2], "brain_first") for i in range(20)], "query_id long, text string, strategy string")
    hits, outcomes, attempts = P.facade_query(q, search, arts, pro, docs)
    assert seen[0] == 2 and {x.query_id for x in hits.collect()} == set(range(0, 20, 2)) and attempts.where("stage = 1").count() == 20
    assert {(x.query_id, x.stage) for x in outcomes.collect()} == {(i, ("original_query", "no_results")[i % 2]) for i in range(20)}


def test_table_hits_ask_equal_queries_once(spark, monkeypatch):
    """F11"""
    rows = spark.createDataFrame([(i, f"t{i % 3}", f"red bolt{i}") for i in range(9)], "row_id long, table_id string, text string")
    seen = counted(monkeypatch, R, "prefix_bm25")
    got = R.table_hits(spark.createDataFrame([(i, "bolt") for i in range(20)], "query_id long, text string"), rows)
    assert seen == [1] and {(x.query_id, x.table_id, x.row_id) for x in got.collect()} == {(i, f"t{j}", j) for i in range(20) for j in range(3)}


def test_slugs_are_resolved_once_per_text(spark, monkeypatch):
    """F10"""
    pages = spark.createDataFrame([(f"supplier-{i}",) for i in range(9)], "slug string")
    seen = counted(monkeypatch, R, "starting")
    got = R.resolve(spark.createDataFrame([(i, ("su", "s")[i % 2]) for i in range(20)], "query_id long, text string"), pages)
    assert seen == [2] and got.count() == 180


def test_records_are_ranked_once_per_page(spark, monkeypatch):
    """F9"""
    q = spark.createDataFrame([(i, ("slug:a", "documents/a", "b", None)[i % 4]) for i in range(20)], "query_id long, slug string")
    pages = spark.createDataFrame([(i, "b", 1.0) for i in range(20)], "query_id long, slug string, score double")
    records = spark.createDataFrame([(i, ("a", "documents/a", "b")[i % 3], "active", f"2024-01-{i + 10}") for i in range(12)], "provenance_id long, slug string, status string, created_at string")
    seen = []
    own = R.shared
    monkeypatch.setattr(R, "shared", lambda q, by: (lambda one: seen.append(one[0].count()) or one)(own(q, by)))
    got = {}
    for x in sorted(P.provenance_answers(q, pages, records).collect(), key=lambda x: (x.query_id, x["rank"])):
        got.setdefault(x.query_id, []).append(x.provenance_id)
    a, b = [i for i in range(11, -1, -1) if i % 3 < 2], [11, 8, 5, 2]
    assert all(got[i] == (a, a, b, b)[i % 4] for i in range(20)) and seen and seen[0] <= 4


def test_keyword_lists_ask_equal_queries_once(spark, monkeypatch):
    """F3, F12"""
    posts = R.token_postings(spark.createDataFrame([(i, f"red bolt{i}") for i in range(9)], "doc_id long, text string"), "doc_id", "text")
    seen = counted(monkeypatch, R, "prefix_bm25")
    got = P.keyword_list(spark.createDataFrame([(i, "bolt") for i in range(20)], "query_id long, text string"), posts, 2)
    assert seen == [1] and {(x.query_id, x.doc_id, x["rank"]) for x in got.collect()} == {(i, j, j + 1) for i in range(20) for j in range(2)}


def test_rarity_counts_every_text(spark):
    """The order of words comes from all texts, not from a share of them."""
    docs = spark.createDataFrame([(i, f"common t{i}") for i in range(64)], "doc_id long, text string")
    slot = spark.range(1).select(F.xxhash64(F.lit("common")).bitwiseAND(F.lit(LD.SLOTS - 1))).first()[0]
    assert LD.rarity(docs).first()[0][slot] >> 56 >= 13


def test_near_copies_are_compared_with_the_one_that_stays(spark, monkeypatch):
    """of 120 near copies the pairs of the first are compared, not all 7140."""
    words = [f"w{k}" for k in range(60)]
    hits = spark.createDataFrame([(1, i, " ".join(words + [f"own{i}", "x"]), float(i // 3)) for i in range(120)] + [(1, 500 + i, f"lone{i} w1 w2", 1.0) for i in range(9)], "query_id int, chunk_id int, chunk_text string, score double")
    met, own = [], R.alike_sets
    monkeypatch.setattr(R, "alike_sets", lambda *a: (lambda df: met.append(df.count()) or df)(own(*a)))
    assert {x.chunk_id for x in R.greedy_text_dedup(hits).collect()} == {117, *range(500, 509)}
    assert sum(met) == 119


def test_texts_are_scored_where_they_lie(spark, monkeypatch):
    """terms that go to the texts give the scores of the join; a list cut to its best is cut before the shuffle, ties kept."""
    docs = spark.createDataFrame([(i, " ".join(f"{w}{i % 3}" for w in ("red", "re", "bolt", "ring")[: 1 + i % 4]) + f" own{i}") for i in range(300)] + [(900, None), (901, "")], "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "re bolt0"), (2, "ring"), (3, "r own7 zzz"), (4, "zzz"), (5, "")], "query_id long, text string")
    posts = R.token_postings(docs, "doc_id", "text")
    monkeypatch.setattr(R, "COUNTED_ROWS", 64)
    rows = lambda df: sorted((x.query_id, x.doc_id, x.score) for x in df.collect())
    placed, cut = R.prefix_bm25(q, posts), R.prefix_bm25(q, posts, most=4)
    few, best = rows(placed), rows(R.top_k(cut, 4).select("query_id", "doc_id", "score"))
    sent = cut.count()
    plan = placed._jdf.queryExecution().executedPlan().toString()
    strict = rows(R.prefix_bm25(q, posts, every=True))
    monkeypatch.setattr(R, "SHARED_TERMS", 0)
    joined = R.prefix_bm25(q, posts)
    assert few == rows(joined) and best == rows(R.top_k(joined, 4).select("query_id", "doc_id", "score")) and len(best) == 12
    assert strict == rows(R.prefix_bm25(q, posts, every=True)) and 12 <= sent < len(few)
    assert "Exchange hashpartitioning" not in plan


def in_one_task(spark, sf_dir, monkeypatch, module):
    """The tables of a module's queries as files of one row group: one partition has all rows."""
    monkeypatch.setattr(module, "table", lambda s, d, name: s.read.parquet(f"{d}/{name}.parquet").coalesce(1))


def test_files_are_parsed_once_and_by_all_cores(spark, sf_dir, monkeypatch):
    """F20"""
    in_one_task(spark, sf_dir, monkeypatch, catalogue)
    made, own = [], CO.structure
    monkeypatch.setattr(CO, "structure", lambda *a: (lambda df: made.append(df.rdd.getNumPartitions()) or df)(own(*a)))
    assert catalogue.QUERIES["q44_code_symbols"](spark, sf_dir).count() == 4 * spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert made and len(made) == 1 and made[0] >= spark.sparkContext.defaultParallelism


def test_long_work_on_short_rows_is_dealt(spark, sf_dir, monkeypatch):
    """F23, F30"""
    seen = []
    own, refs = C.exploded, E.entity_refs
    in_one_task(spark, sf_dir, monkeypatch, catalogue_facade)
    in_one_task(spark, sf_dir, monkeypatch, catalogue_text)
    monkeypatch.setattr(C, "exploded", lambda docs, *a: seen.append(docs.rdd.getNumPartitions()) or own(docs, *a))
    monkeypatch.setattr(E, "entity_refs", lambda docs, *a: seen.append(docs.rdd.getNumPartitions()) or refs(docs, *a))
    catalogue.QUERIES["q138_word_splitter"](spark, sf_dir), catalogue.QUERIES["q83_entity_refs"](spark, sf_dir)
    assert len(seen) == 2 and min(seen) >= spark.sparkContext.defaultParallelism


def test_few_patterns_go_to_the_texts(spark, monkeypatch):
    """no windows are made for them; what is found is the same."""
    texts = spark.createDataFrame([(i, f"Click of {i} R#_%{i % 7}") for i in range(60)] + [(99, None), (98, "")], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "click"), (2, "f"), (3, "r#"), (4, "_%3"), (5, None), (6, ""), (7, "none"), (8, "click")], "query_id long, pattern string")
    made, own = [], S.windows
    monkeypatch.setattr(S, "windows", lambda *a: made.append(1) or own(*a))
    rows = lambda: sorted(map(tuple, S.containing(asks, texts).collect()))
    few = rows()
    assert not made
    monkeypatch.setattr(S, "FEW", 0)
    assert rows() == few and made and len(few) == 60 * 4 + 9


def test_lines_are_not_shuffled_for_their_places(spark):
    """F27"""
    docs = spark.createDataFrame([(1, "short\n" + "a line of more than twenty-four\n" * 3)], "doc_id long, text string")
    places = C.atomic_passages(docs, "doc_id", "text").select("doc_id", "passage_order", "source_start", "source_end")
    assert sorted(map(tuple, places.collect())) == [(1, k, 6 + 32 * k, 37 + 32 * k) for k in range(3)]
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    below = plan.split(windows[-1])[1].splitlines()[1]
    assert windows and " content#" not in below.replace("length(content#", "").split("AS __n")[0]


def test_keywords_are_dealt_once(spark):
    """F32: words are counted before the shuffle, of which there is one."""
    docs = spark.createDataFrame([(1, "beta alpha beta Gamma x the gamma beta alpha"), (2, None), (3, "x"), (4, "one one"), (4, "one two")], "k long, t string")
    got = E.keywords(docs, "k", "t")
    assert sorted(map(tuple, got.collect())) == [(1, "Gamma", 1, 3), (1, "alpha", 2, 2), (1, "beta", 3, 1), (1, "gamma", 1, 4), (4, "one", 3, 1), (4, "two", 1, 2)]
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_a_round_of_kmeans_hands_on_sums_of_tasks(spark):
    """five blocks of a group in one task give a row per cluster, not one per block, cluster and dimension; sent or joined centres give the same."""
    data = lambda *rows: b"".join(struct.pack("<2d", *r) for r in rows)
    blocks = spark.createDataFrame([(1, [2 * i, 2 * i + 1], bytearray(data((i, 1), (i + 10.5, 1)))) for i in range(5)], "cell long, ids array<long>, data binary").coalesce(1)
    now = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [20.0, 0.0]), (2, 0, [1.0, 1.0])], "cell long, cluster int, centre array<double>")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(K.met(blocks, now, True, True)) == rows(K.met(blocks, now, True, False)) == [(1, 0, [10.0, 5.0], 5), (1, 1, [62.5, 5.0], 5)]
    assert rows(K.met(blocks, now, False, True)) == rows(K.met(blocks, now, False, False))


def test_a_slice_hands_on_the_nearest_of_all_its_blocks(spark):
    """a block of queries that meets five blocks of vectors gives its k best once, not k of each block; copies, other lengths and ties as before."""
    r = np.random.default_rng(5)
    made = [[float(x) for x in v] for v in r.integers(-3, 4, (90, 6))]
    rows = [(i, made[i % 90][: 4 if i % 11 == 0 else 6]) for i in range(200)] + [(900, []), (902, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x.query_id, x["rank"]): (x.vec_id, round(x.score, 9)) for x in VX.exact_neighbours(df.withColumnRenamed("vec_id", "query_id"), df, 9, 2).collect()}
    cos = X.cosine("embedding", "v")
    pairs = df.withColumnRenamed("vec_id", "query_id").where("embedding is not null").crossJoin(df.select("vec_id", F.col("embedding").alias("v"))).select("query_id", "vec_id", F.round(cos, 9).alias("score"))
    want = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in R.top_k(pairs, 9, tie="vec_id").collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and len(got) == 202 * 9
    data = VX.units(df.where("size(embedding) = 6 and vec_id < 200").select("vec_id", "embedding"), "vec_id", 6).collect()
    block = lambda n, own: (0, [x.id for x in own], bytearray(b"".join(bytes(x.data) for x in own)))
    q, v = block(0, data[:20]), [block(n, data[n * 30 : n * 30 + 30]) for n in range(5)]
    meet = spark.createDataFrame([(*q, *b[1:]) for b in v], "cell int, q_ids array<long>, q_data binary, ids array<long>, data binary").coalesce(1)
    assert VX.best_of_blocks(meet, None, 9).count() == 20 * 9


def test_places_of_hits_are_laid_out_for_the_best_documents_only(spark, monkeypatch):
    """one word index, of the best documents; the scores are those of the joins."""
    docs = spark.createDataFrame([(i % 55, "Ring " * (i % 7) + f"rin gear{i % 5}", "en" if i % 3 else None) for i in range(60)] + [(90, "", "")], "id long, body string, lang string")
    q = spark.createDataFrame([(1, "ring gear1"), (2, "ri zz"), (3, "!"), (4, "e")], "query_id long, text string")
    fields = {"body": (FS.spelled("body"), 1.0), "lang": (FS.spelled("lang"), 0.5)}
    rows = lambda df: sorted((x.query_id, x.doc_id, x.score, x["rank"]) for x in df.collect())
    sizes, laid = [], FS.placed_words
    monkeypatch.setattr(FS, "placed_words", lambda docs, *a: sizes.append(docs.count()) or laid(docs, *a))
    best, seen = FS.field_search(q, docs, "id", fields, 3)
    got = rows(best), sorted(map(tuple, seen.collect()))
    assert sizes[0] < 20 and len(got[0]) == 9
    monkeypatch.setattr(FS, "SHARED_TERMS", 0)
    best, seen = FS.field_search(q, docs, "id", fields, 3)
    assert got == (rows(best), sorted(map(tuple, seen.collect()))) and sizes[1] == 61


def test_a_splitter_takes_few_texts_of_a_batch_at_a_time(spark):
    """a batch of texts is never laid out whole as Python's strings, nor are its chunks; nulls and all chunks as before."""
    texts = [None if i % 50 == 7 else f"{i} " * (i % 9) for i in range(300)]
    taken = []

    class Batch:
        def __len__(self):
            return len(texts)

        def slice(self, k, n):
            taken.append(len(texts[k : k + n]))
            return pa.array(texts[k : k + n], pa.string())

    got = C.as_splitter(str.split).func(Batch()).to_pylist()
    assert got == [[] if t is None else t.split() for t in texts] and max(taken) <= C.TEXTS < 300 and sum(taken) == 300
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    assert [x.c for x in df.select("k", C.as_splitter(str.split)("t").alias("c")).orderBy("k").collect()] == got


def test_answers_of_few_keys_are_dealt_over_all_tasks(spark):
    """two keys have every answer; no task lays out more than a small share of the result, which stays whole, with the lost and the empty."""
    asked = spark.createDataFrame([(i, i % 3) for i in range(90)] + [(90, 7)], "query_id long, key long")
    answers = spark.createDataFrame([(i % 2, (i,), i % 2 == 0) for i in range(4000)] + [(2, None, True), (9, (1,), True)], "key long, found struct<ref: int>, fresh boolean").coalesce(1)
    got = A.handed_out(asked, answers)
    rows = [(x.query_id, x.fresh, x.found and x.found.ref) for x in got.collect()]
    assert sorted(rows, key=str) == sorted([(q, q % 3 == 0, i) for q in range(90) if q % 3 < 2 for i in range(q % 3, 4000, 2)] + [(q, True, None) for q in range(2, 90, 3)], key=str)
    shares = [n for n, in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).select("n").collect()]
    assert len(shares) > 2 and max(shares) < len(rows)


def test_kmeans_rounds_have_no_more_tasks_than_cores(spark, monkeypatch):
    """what rounds hand to the driver does not follow the number of splits; every vector still gets a cluster."""
    from pyspark.ml.clustering import KMeans

    fitted, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df: fitted.append((df.rdd.getNumPartitions(), df.count())) or fit(self, df))
    cores = spark.sparkContext.defaultParallelism
    vectors = spark.createDataFrame([(i, [float(i % 4 * 50 + j + i % 3) for j in range(4)]) for i in range(200)], "vec_id long, embedding array<float>").repartition(5 * cores)
    got = {x.vec_id: x.cluster for x in K.kmeans(vectors, 4).collect()}
    assert fitted == [(cores, 200)] and len(got) == 200
    assert len(set(got.values())) > 1 and all(got[i] == got[i % 12] for i in range(200))


def test_fields_are_searched_once_for_equal_queries(spark, monkeypatch):
    """F2 of round 5: of equal queries one is asked, and its hits are cut before the others get them."""
    docs = spark.createDataFrame([(i, f"red bolt {i % 2}", f"part {i}" if i % 3 else "red part") for i in range(60)], "doc_id long, name string, summary string")
    q = spark.createDataFrame([(i, ("Red", "bolt 1", "none", None)[i % 4]) for i in range(40)], "query_id long, text string")
    seen = counted(monkeypatch, R, "containing")
    for fields, want in ((("name", "summary"), {0: list(range(5)), 1: [1, 3, 5, 7, 9]}), (("summary",), {0: [0, 3, 6, 9, 12]})):
        got = {}
        for x in sorted(R.field_hits(q, docs, fields, 5).collect(), key=lambda x: (x.query_id, x["rank"])):
            assert x.score == 1 / x["rank"]
            got.setdefault(x.query_id, []).append(x.doc_id)
        assert got == {i: want[i % 4] for i in range(40) if i % 4 in want}
    assert len(seen) == 2 and max(seen) <= 4


def test_evidence_counts_texts_once(spark, monkeypatch):
    """F6 of round 5: both routes share one pass over the texts, and tokens are those of X.tokens whatever the script."""
    texts = ["Red bolt_1, ring", "Größe ÉTÉ red", "İstanbul redden 协议合同 x", "", None, "ſ K Å red ªº ²3", "\u0250a red"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    posts = R.token_postings(docs, "k", "t")
    want = docs.select("k", F.explode(X.tokens("t")).alias("term"))
    assert sorted((x.doc_id, x.term) for x in posts.collect()) == sorted((x.k, x.term) for x in want.collect())
    seen, own = [], R.counted_terms
    monkeypatch.setattr(R, "counted_terms", lambda asked, *a, **b: seen.append(len(asked)) or own(asked, *a, **b))
    p = docs.select(F.col("k").alias("passage_id"), F.col("k").alias("node_id"), F.col("k").alias("document_id"), F.lit("").alias("title"), F.col("t").alias("content"), F.lit("window").alias("view_type"), F.lit(0).alias("level"))
    got = P.evidence_search(spark.createDataFrame([(1, "red ring"), (2, "größe red")], "query_id long, text string"), p).collect()
    assert seen == [2] and {x.node_id for x in got if x.query_id == 2 and x["rank"] == 1} == {1} and {x.node_id for x in got if x.query_id == 1} == {0, 1, 2, 5, 6}


def shares(df):
    """Rows of each task of a result."""
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()


def test_answers_of_few_questions_are_handed_out_by_many_tasks(spark):
    """F3, F7 of round 5: one text or page that all queries name is no longer one task's work, and no row is lost."""
    n = 200
    pages = spark.createDataFrame([(f"page-{i:04d}",) for i in range(n)], "slug string")
    got = R.resolve(spark.createDataFrame([(i, "page") for i in range(n)], "query_id long, text string"), pages)
    assert got.distinct().count() == got.count() == n * n and max(shares(got)) < n * n // 2
    records = spark.createDataFrame([(i, "documents/1", "active", f"2024-01-{i % 28 + 1:02d}") for i in range(n)], "provenance_id long, slug string, status string, created_at string")
    none = spark.createDataFrame([], "query_id long, slug string, score double")
    got = P.provenance_answers(spark.createDataFrame([(i, "documents/1") for i in range(n)], "query_id long, slug string"), none, records)
    assert got.distinct().count() == got.count() == n * n and max(shares(got)) < n * n // 2
    assert {(x.a, x.b) for x in got.groupBy("query_id").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).collect()} == {(1, n)}


def test_sets_that_parities_tell_apart_are_not_compared(spark, monkeypatch):
    """F4 of round 5: texts that share rare words and sizes, but little else, never meet their word sets; those that are alike do."""
    common = lambda i: " ".join(f"c{(i * 37 + k * 11) % 400}" for k in range(60))
    rows = [(1, i, f"rare{i // 2} {common(i)}", float(200 - i)) for i in range(80)] + [(1, 100 + i, f"rare{i // 2} {common(2 * (i // 2))} more{i}", 1.0) for i in range(0, 20, 2)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id int, chunk_text string, score double")
    met, own = [], R.asked_for
    monkeypatch.setattr(R, "asked_for", lambda r, bits: (lambda df: met.append(df.count()) or df)(own(r, bits)))
    got = {x.chunk_id for x in R.greedy_text_dedup(hits).collect()}
    plain, kept = {i: set(t.split()) for _, i, t, _ in rows}, []
    for _, i, _, _ in sorted(rows, key=lambda x: (-x[3], x[1])):
        if all(len(plain[i] & plain[k]) <= 0.85 * len(plain[i] | plain[k]) for k in kept):
            kept.append(i)
    assert got == set(kept) and sum(met) < 60

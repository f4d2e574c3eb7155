"""Operators on hand-made rows: ranking, graph, extraction, lifecycle, sources, streaming."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.operators import chunking as C
from quillstone.operators import clustering as K
from quillstone.operators import evaluation as V
from quillstone.operators import extraction as E
from quillstone.operators import graph as G
from quillstone.operators import lifecycle as L
from quillstone.operators import retrieval as R
from quillstone.operators import statistics as S
from quillstone.plans import search as P
from quillstone.sources import readers as I
from quillstone.streaming import events as Z


def test_rrf(spark):
    u = spark.createDataFrame([(1, 1, 1, "v"), (1, 2, 2, "v"), (1, 2, 1, "f"), (1, 3, 2, "f")], "query_id int, doc_id int, rank int, list string")
    best = R.rrf(u).orderBy(F.desc("score")).first()
    assert best.doc_id == 2 and best.score == pytest.approx(1 / 61 + 1 / 62)
    assert R.rrf(u, zero_based=True).where("doc_id = 2").first().score == pytest.approx(1 / 60 + 1 / 61)


def test_rrf_single_list_keeps_scores(spark):
    u = spark.createDataFrame([(1, 1, 1, "v", 0.7, False)], "query_id int, doc_id int, rank int, list string, score double, exact_match boolean")
    assert R.rrf_signals(u).first().score == 0.7


def test_bm25_prefix(spark):
    p = spark.createDataFrame([(1, "alpha", 1.0), (1, "alphabet", 1.0), (2, "beta", 1.0), (3, "al", 1.0)], "doc_id int, term string, tf double")
    n = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "doc_id int, dl int")
    q = spark.createDataFrame([(1, "alph"), (2, "al"), (3, "b")], "query_id int, term string")
    got = {(r.query_id, r.doc_id) for r in R.bm25(q, p, n, prefix=True).collect()}
    assert got == {(1, 1), (2, 1), (2, 3), (3, 2)}


def test_greedy_dedup(spark):
    rows = [(1, 1, 0.9, "a b c d"), (1, 2, 0.8, "a b c d"), (1, 3, 0.7, "x y"), (2, 4, 0.1, "a b c d")]
    h = spark.createDataFrame(rows, "query_id int, chunk_id int, score double, chunk_text string")
    assert sorted(r.chunk_id for r in R.greedy_text_dedup(h).collect()) == [1, 3, 4]


def test_layered_dedup_caps_pages_and_keeps_truth(spark):
    rows = [(1, i, "p", None, "timeline", f"text {i} {i * 7}", 1.0 - i / 10) for i in range(4)] + [(1, 9, "p", None, "compiled_truth", "truth itself", 0.1)]
    h = spark.createDataFrame(rows, "query_id int, chunk_id int, slug string, page_type string, source string, chunk_text string, score double")
    out = R.layered_dedup(h, 10).collect()
    assert len(out) == 2 and any(r.source == "compiled_truth" for r in out)


def test_vector_top_k_ties_and_shapes(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0]), (5, None)], "vec_id long, embedding array<float>")
    q = v.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    assert [r.vec_id for r in R.vector_top_k(q, v, 2).orderBy("rank").collect()] == [1, 2]


def test_vector_top_k_takes_queries_in_slices(spark, sf_dir, monkeypatch):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(45)
    q = e.select((F.col("vec_id").cast("long") / 2).cast("long").alias("query_id"), "embedding")  # ids come twice
    rows = lambda **b: sorted((r.query_id, r.vec_id, round(r.score, 6)) for r in R.vector_top_k(q, e, 5, **b).collect())
    whole = rows()
    monkeypatch.setattr(R, "MAX_QUERIES", 7)
    assert whole == rows() == rows(block=0) and len({r[0] for r in whole}) > 7


def test_partition_count_does_not_matter(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = lambda df: sorted((r.query_id, r.vec_id, round(r.score, 9)) for r in R.vector_top_k(q, df, 5).collect())
    assert rows(e.repartition(1)) == rows(e.repartition(8))


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("a", "c", "y"), ("d", "gone", "x")], "src string, dst string, link_type string")
    s = spark.createDataFrame([("a",)], "start string")
    assert {(r.node, r.depth) for r in G.traverse(s, e, 5).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert {(r.node, r.depth) for r in G.traverse(s, e, 5, link_types=("x",)).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert len(G.paths(s, e, 1).collect()) == 2
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    assert [r.node for r in G.orphans(nodes, e).collect()] == ["e"]
    assert [(r.src, r.dst) for r in G.dead_links(nodes, e).collect()] == [("d", "gone")]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id int, parent_id int")
    assert {(r.id, r.depth) for r in G.descendants(tree, tree.where("id = 1")).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_expand_anchors(spark):
    e = spark.createDataFrame([(1, 2, "x"), (2, 3, "x")], "src int, dst int, link_type string")
    a = spark.createDataFrame([(7, 1, 1.0)], "query_id int, chunk_id int, score double")
    assert {(r.chunk_id, r.hop, round(r.score, 6)) for r in G.expand_anchors(a, e).collect()} == {(2, 1, 0.5), (3, 2, round(0.5 / 3, 6))}


def test_eval(spark):
    q = spark.createDataFrame([(1, 1), (1, 3), (1, 9), (2, None)], "query_id int, doc_id int")
    r = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id int, doc_id int, rank int")
    m = {x.query_id: x for x in V.per_query(r, q, 3).collect()}
    assert m[1].precision == pytest.approx(2 / 3) and m[1].recall == pytest.approx(2 / 3) and m[1].rr == 1.0
    assert m[2].recall == 0.0
    assert {x.query_id: x.recall for x in V.per_query(r, q, 3, empty_is_perfect=True).collect()}[2] == 1.0
    s = V.summary(V.per_query(r, q, 3), spark.createDataFrame([(float(i),) for i in range(1, 21)], "latency_ms double")).first()
    assert s.queries == 2 and s.p95_ms == 19.0


def test_splitters(spark):
    df = spark.createDataFrame([(1, ""), (2, "word " * 500), (3, "a" * 2500), (4, None)], "k int, t string")
    chunks = C.exploded(df, C.character_splitter(1000, 100)("t"), "k").collect()
    assert {r.k for r in chunks} == {2, 3}
    words = C.exploded(df.where("k = 2"), C.word_splitter(100, 0)("t"), "k").collect()
    assert sum(len(r.chunk_text.split()) for r in words) == 500
    heads = spark.createDataFrame([(1, "# A\ntext\n## B\nmore")], "k int, t string")
    assert len(C.exploded(heads, C.header_splitter()("t"), "k").collect()) == 2
    assert [r.chunk_text for r in C.adaptive_chunks(spark.createDataFrame([(1, "py", "a\n\nb")], "k int, e string, t string"), "e", "t", "k").collect()] == ["a", "b"]
    at = spark.createDataFrame([("hello world again", ["hello", "world", "again"])], "t string, c array<string>").select(C.locate_chunks()("t", "c").alias("x")).first().x
    assert [(p.start, p.end) for p in at] == [(0, 5), (6, 11), (12, 17)]


def test_sentences(spark):
    assert spark.range(1).select(C.sentences(F.lit("Pi is 3.14. Yes! 好。Done")).alias("x")).first().x == ["Pi is 3.14.", "Yes!", "好。", "Done"]


def test_passages(spark):
    df = spark.createDataFrame([(1, "x" * 30 + "\nshort\n" + "y" * 40), (2, "")], "k int, t string")
    assert [(r.source_start, r.source_end) for r in C.atomic_passages(df, "k", "t").orderBy("source_start").collect()] == [(0, 30), (37, 77)]
    w = C.window_passages(spark.createDataFrame([(1, "z" * 1500)], "k int, t string"), "k", "t").orderBy("passage_order").collect()
    assert [(r.source_start, r.source_end) for r in w] == [(0, 720), (600, 1320), (1200, 1500)]


def test_timeline(spark):
    t = "- 2024-01-02 | met\n  more\n- **2024-02-30** | bad\n- **2024-03-01** | bold\n- 2024-04-01: colon\nplain"
    rows = C.timeline_entries(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t").orderBy("line").collect()
    assert [(r.date, r.summary) for r in rows] == [("2024-01-02", "met more"), ("2024-03-01", "bold"), ("2024-04-01", "colon")]


def test_refs(spark):
    t = "[founded:Acme](companies/acme) and [Bob](people/bob) who works at it, [[people/eve|Eve]], concepts/graph `people/no`"
    rows = {(r.slug, r.link_type) for r in E.entity_refs(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t").collect()}
    assert ("companies/acme", "founded") in rows and ("concepts/graph", "mentions") in rows
    assert not any(s == "people/no" for s, _ in rows)
    bob = E.entity_refs(spark.createDataFrame([(1, "[Bob](people/bob) works at a mill")], "k int, t string"), "k", "t").first()
    assert (bob.slug, bob.name, bob.link_type) == ("people/bob", "Bob", "works_at")
    far = "word " * 60
    twice = E.entity_refs(spark.createDataFrame([(1, f"[Bob](people/bob) sang. {far}[Bob](people/bob) works at a mill. {far}[[people/eve]] and {far}[[people/eve]] founded it")], "k int, t string"), "k", "t").collect()
    assert {(x.slug, x.link_type) for x in twice} >= {("people/bob", "works_at"), ("people/eve", "founded")} and len({x.link_type for x in twice if x.slug == "people/bob"}) == 2


def test_symbols_and_calls(spark):
    from quillstone.operators import code as C

    f = spark.createDataFrame([(1, "rust", "pub fn alpha() {\n  beta();\n}\nfn beta() {}")], "k int, l string, c string")
    found = C.symbols(f, "k", "c", "l")
    assert {r.name for r in found.collect()} == {"alpha", "beta"}
    assert [(r.from_symbol, r.to_symbol) for r in C.call_edges(f, "k", "c", "l").collect()] == [("alpha", "beta")]


def test_lint_and_fix(spark):
    p = spark.createDataFrame([("a", "Sure! here\nok\n```\ncode"), ("b", "---\nx: 1\n---\ntext")], "slug string, body string")
    rules = {(r.slug, r.rule) for r in E.lint(p, "slug", "body", p).collect()}
    assert rules == {("a", "llm-preamble"), ("a", "missing-frontmatter"), ("a", "code-fence-residue")}
    assert p.where("slug = 'a'").select(E.fix_lint("body").alias("x")).first().x == "ok\n```\ncode\n```"


def test_validate(spark):
    p = spark.createDataFrame([("a", "t"), ("b", "t"), ("C d", "t")], "slug string, body string")
    l = spark.createDataFrame([("a", "b"), ("a", "zz")], "from_slug string, to_slug string")
    assert {(r.slug, r.check) for r in E.validate(p, "slug", "body", l).collect()} == {("C d", "slug"), ("a", "links"), ("a", "back-links")}


def test_entities_tags_links(spark):
    d = spark.createDataFrame([(1, "John Smith met Acme Capital Fund in 2024, draft [[people/x]] [y](notes/y) [z](http://z)")], "k int, t string")
    assert [(r.name, r.entity_type) for r in E.entity_candidates(d, "k", "t").orderBy("rank").collect()] == [("John Smith", "person"), ("Acme Capital Fund", "company")]
    assert d.select(E.tags(F.col("t"), F.lit("note")).alias("x")).first().x == ["note", "status-draft", "year-2024"]
    assert {r.to_slug for r in E.suggested_links(d, "k", "t").collect()} == {"people/x", "notes/y"}


def test_state(spark):
    cur = spark.createDataFrame([("a", 1), ("b", 2)], "slug string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "slug string, v int")
    assert {(r.slug, r.v) for r in L.upsert(cur, new, ("slug",)).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {(r.slug, r.v) for r in L.insert_ignore(cur, new, ("slug",)).collect()} == {("a", 1), ("b", 2), ("c", 4)}
    diff = {(r.item_path, r.action) for r in L.snapshot_diff(spark.createDataFrame([("x", "1"), ("y", "2"), ("n", "3")], "item_path string, sha256 string"), spark.createDataFrame([("x", "1"), ("y", "9"), ("m", "4")], "item_path string, sha256 string")).collect()}
    assert diff == {("x", "unchanged"), ("y", "changed"), ("n", "new"), ("m", "missing")}
    v = spark.createDataFrame([(1, "h", 4, "ready"), (1, "g", 5, "retired")], "doc_id int, content_hash string, version_id int, status string")
    b = L.begin_versions(spark.createDataFrame([(1, "h"), (1, "z"), (2, "q")], "doc_id int, content_hash string"), v)
    assert {(r.doc_id, r.content_hash, r.version_id, r.reused) for r in b.collect()} == {(1, "h", 4, True), (1, "z", 6, False), (2, "q", 1, False)}
    assert spark.range(1).select(L.may_follow(F.lit("ready"), F.lit("processing")).alias("a"), L.may_follow(F.lit("ready"), F.lit("queued")).alias("b")).first() == (True, False)


def test_deletes(spark):
    rows = spark.sql("SELECT 'a' AS slug, timestamp'2024-01-01' AS deleted_at UNION ALL SELECT 'b', CAST(NULL AS timestamp)")
    kept, gone = L.purge(rows, F.lit("2024-01-10").cast("timestamp"), 72)
    assert [r.slug for r in kept.collect()] == ["b"] and [r.slug for r in gone.collect()] == ["a"]
    now = L.soft_delete(rows, F.col("slug") == "b", F.lit("2024-02-01").cast("timestamp"))
    assert now.where("deleted_at is null").count() == 0 and L.restore(now, F.lit(True)).where("deleted_at is null").count() == 2


def test_budget(spark):
    e = spark.sql("SELECT 's' AS scope, date'2024-01-01' AS day, id, amount FROM VALUES (1L, 60.0D), (2L, 50.0D), (3L, 40.0D) AS t(id, amount)")
    assert [(r.id, r.admitted) for r in L.admit(e, 100.0).orderBy("id").collect()] == [(1, True), (2, False), (3, True)]


def test_backup(spark, tmp_path):
    t = {"a": spark.range(3), "b": spark.range(5)}
    back = L.read_backup(spark, L.backup(t, str(tmp_path / "b")))
    assert {k: v.count() for k, v in back.items()} == {"a": 3, "b": 5}


def test_ocr(spark):
    p = spark.createDataFrame([(1, x) for x in (1, 2, 3, 5, 9, 10)], "document_id int, page int")
    assert {(r.first_page, r.last_page) for r in S.ocr_segments(p, 2).collect()} == {(1, 2), (3, 3), (5, 5), (9, 10)}
    s = spark.createDataFrame([(1, True, "done"), (1, True, "failed"), (2, False, None)], "document_id int, needed boolean, state string")
    assert {(r.document_id, r.status, r.coverage) for r in S.ocr_status(s).collect()} == {(1, "partial", 0.5), (2, "not_needed", 1.0)}


def test_synonyms(spark):
    p = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.9), ("a", "c", 0.8)], "token string, synonym string, score double")
    assert {(r.token, r.synonym) for r in K.mine_synonyms(p, 2).collect()} == {("a", "b"), ("b", "a"), ("c", "a")}


def test_hash_embedding(spark):
    r = K.hash_embedding(spark.createDataFrame([(1, "a b"), (2, None)], "k int, t string"), "k", "t", 8).orderBy("k").collect()
    assert sum(x * x for x in r[0].embedding) == pytest.approx(1.0, abs=1e-5) and set(r[1].embedding) == {0.0}


def test_sources(spark, tmp_path):
    (tmp_path / "d" / ".git").mkdir(parents=True)
    (tmp_path / "d" / "a.md").write_text("---\ntitle: T\n---\nbody\n\n<!-- timeline -->\n- 2024-01-01 | x")
    (tmp_path / "d" / ".git" / "b.md").write_text("no")
    files = I.scan(spark, str(tmp_path / "d"), ("md",))
    assert files.count() == 1 and len(I.manifest(files).first().sha256) == 64
    page = I.markdown_pages(files.select("path", F.col("content").cast("string").alias("c")), "path", "c").first()
    assert page.frontmatter == {"title": "T"} and page.body == "body" and page.timeline == "- 2024-01-01 | x"
    (tmp_path / "s.txt").write_text("# c\na,b\n\nx , y\n")
    assert [(r.a, r.b) for r in I.pair_file(spark, str(tmp_path / "s.txt")).collect()] == [("a", "b"), ("x", "y")]
    (tmp_path / "q.json").write_text(json.dumps([{"query": "t", "relevant": ["a", "b"], "irrelevant": ["c"]}]))
    assert {(r.doc, r.relevant) for r in I.qrels(spark, str(tmp_path / "q.json")).collect()} == {("a", True), ("b", True), ("c", False)}
    (tmp_path / "t.csv").write_text("x,y\n1,2\n")
    assert I.rows_as_text(I.csv_rows(spark, str(tmp_path / "t.csv"))).first().row_json == '{"x":"1","y":"2"}'
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Hi</w:t></w:p></w:document>')
    docx = spark.read.format("binaryFile").load(str(tmp_path / "w.docx"))
    assert I.docx_texts(docx).first().text == "Hi"
    html = spark.createDataFrame([(1, "<title>A &amp; B</title><script>x</script><h1>H</h1><p>one</p><p>t&lt;o</p>")], "k int, h string")
    row = I.html_documents(html, "k", "h").first()
    assert row.headings == ["H"] and "x" not in row.text and "t<o" in row.text


def test_streaming_equals_batch(spark, sf_dir, tmp_path):
    src = tmp_path / "in"
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.repartition(3).write.parquet(str(src))
    stream = Z.read_events(spark, str(src))
    out = []
    Z.work(stream, lambda df, _: out.append(df.count()), str(tmp_path / "ck")).awaitTermination()
    assert sum(out) == e.count()
    assert Z.daily(e).agg(F.sum("n")).first()[0] == e.count()
    assert Z.sessions(e).agg(F.sum("n")).first()[0] == e.count()


def test_escalation(spark):
    low = spark.createDataFrame([(1, 1)], "query_id int, doc_id int")
    high = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "query_id int, doc_id int")
    assert {(r.query_id, r.doc_id) for r in P.escalated(low, high).collect()} == {(1, 1), (1, 2), (2, 5)}


def test_vector_search_with_null_and_string_queries(spark):
    from quillstone.operators import retrieval as R

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.1]), ("b", None), ("c", [0.0, 2.0])], "query_id string, embedding array<float>")
    got = {(r.query_id, r.rank): r.vec_id for r in R.vector_top_k(q, v, 2).collect()}
    assert got == {("a", 1): 1, ("a", 2): 3, ("c", 1): 2, ("c", 2): 3}
    assert R.vector_top_k(q.where("query_id = 'b'"), v, 2).count() == 0


def test_searches_find_accented_and_cjk_words_by_prefix(spark):
    from pyspark.sql import functions as F

    from quillstone.operators import retrieval as R

    texts = [(1, "Éléphant dans la forêt"), (2, "数据库管理系统 v2"), (3, "plain elephants"), (4, "über uns"), (5, ""), (6, None)]
    posts = R.token_postings(spark.createDataFrame(texts, "id long, text string"), "id", "text")
    asked = spark.createDataFrame([(1, "élé"), (2, "数据"), (3, "ELEPH"), (4, "Ü"), (5, "nothing"), (6, "la forêt"), (7, ""), (8, "and")], "query_id long, text string")
    got = {}
    for r in R.prefix_bm25(asked, posts).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    assert got == {1: {1}, 2: {2}, 3: {3}, 4: {4}, 6: {1}}
    both = R.prefix_bm25(asked.where("query_id = 6").select("query_id", F.array(F.lit("la"), F.lit("über")).alias("t")), posts, "t", every=True)
    assert both.count() == 0


def test_hooks_of_the_searches(spark, sf_dir):
    from pyspark.sql import functions as F

    from quillstone.plans import catalogue as C
    from quillstone.plans import search as P

    q, chunks, links = C.search_inputs(spark, sf_dir)
    turned = lambda h: h.withColumn("score", -F.col("score"))
    opts = P.SearchOptions(dedup=False)
    as_of = F.lit("2025-06-01").cast("timestamp")
    a = P.hybrid_search(q, chunks, links, as_of, opts, reranker=turned).where("rank = 1").collect()
    assert a and all(r.score <= 0 for r in a)
    d = P.document_search(q, C.node_inputs(chunks), reranker=turned).where("rank = 1").collect()
    assert d and all(r.score <= 0 for r in d)


def test_evidence_over_all_routes(spark):
    from quillstone.plans import search as P

    rows = [(10, 1, 1, "T", "alpha beta near each other", "window", 0), (11, 1, 1, "T", "alpha only here", "atomic", 0), (20, 2, 1, "T", "beta far " + "x " * 300 + " alpha", "window", 0), (30, 3, 2, "T", "nothing at all", "window", 0)]
    passages = spark.createDataFrame(rows, "passage_id long, node_id long, document_id long, title string, content string, view_type string, level int")
    nodes = spark.createDataFrame([(1, 1, "T", "alpha beta near each other. alpha only here", 0), (2, 1, "T", "beta alpha", 0), (3, 2, "T", "nothing", 0)], "node_id long, document_id long, title string, content string, level int")
    hybrid = spark.createDataFrame([(1, 3, 1)], "query_id long, node_id long, rank int")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "的")], "query_id long, text string")
    got = [(r.query_id, r.rank, r.node_id) for r in P.evidence_search(asked, passages, 10, nodes, hybrid).orderBy("query_id", "rank").collect()]
    # Of a node's passages the shortest stays, so the first node covers one term and the second both.
    assert got == [(1, 1, 2), (1, 2, 1), (1, 3, 3)]

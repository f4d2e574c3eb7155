"""The pipeline's stages, each on its own input, and the whole of it."""

import brute as B
import corpus_pipeline as P
from pyspark.sql import functions as F

from quillstone.llm import quality_classifier
from quillstone.llm.common import table


def test_stages_keep_columns_and_nulls(spark, sf_dir, hard):
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert P.tokens(spark, docs, sf_dir).count() == docs.count()


def test_run(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality_classifier.train(docs, labels)
    good = {r.doc_id: r.text for r in docs.collect() if net.score((r.text or "").encode()) >= 0.5}
    kept = {r.doc_id for r in P.keep_good(spark, docs, sf_dir).collect()}
    assert kept == set(good)
    lined = P.drop_lines(spark, P.keep_good(spark, docs, sf_dir), sf_dir).cache()
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    rows = [(r.doc_id, r.text) for r in lined.collect()]
    groups = B.simhash_groups(rows)
    one = P.one_of_each(spark, lined, sf_dir).cache()
    assert {r.doc_id for r in one.collect()} == {c for _, c in groups.values()}
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    clean = P.remove_benchmark(spark, one, sf_dir).collect()
    assert not any(x[-1] for x in B.contamination([r.text for r in clean], items) if x[0] > 20)
    out = P.run(spark, sf_dir)
    assert out.count() == len(clean)
    assert out.agg(F.min("n_tokens")).first()[0] >= 0
    lined.unpersist()
    one.unpersist()
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"]

"""Scalar functions and predicates on small cases."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.plans import queries as Q


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if hasattr(v, "_jc") else F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("q,want", [("who is Alice", "entity"), ("when was the latest funding round", "temporal"), ("acquisition of Acme Corp", "event"), ("random search terms", "general"), ("everything about it", "temporal")])
def test_intent(spark, q, want):
    assert one(spark, Q.intent("q"), q=q) == want


@pytest.mark.parametrize("q,want", [("如何配置SSL证书", "how_to"), ("report.pdf", "exact_lookup"), ("ABC-123", "exact_lookup"), ("12345", "exact_lookup"), ("RAG", "conceptual"), ("2024 Q3 报销清单", "table_lookup"), ("what?", "fact_lookup")])
def test_query_type(spark, q, want):
    assert one(spark, Q.query_type("q"), q=q) == want


def test_tokens_are_all_of_a_text(spark):
    words = [f"w{i}" for i in range(12_000)]
    assert one(spark, X.tokens("t"), t=" ".join(words)) == words
    assert one(spark, X.tokens("t", 2), t="a b a c") == ["a", "b"]


def test_trigrams(spark):
    assert len(one(spark, X.trigrams("t"), t="abc")) == 5
    assert len(one(spark, X.trigrams("t"), t="a")) == 3
    assert one(spark, X.trigram_similarity("a", "b"), a="Hello", b="hello") == 1.0


@pytest.mark.parametrize("a,b,want", [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [-1.0], -1.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0)])
def test_cosine(spark, a, b, want):
    arr = lambda v: F.array(*map(F.lit, v))
    assert one(spark, X.cosine("a", "b"), a=arr(a), b=arr(b)) == pytest.approx(want)


def test_cosine_truncating(spark):
    assert one(spark, X.cosine_truncating("a", "b"), a=F.array(F.lit(1.0)), b=F.array(F.lit(1.0), F.lit(5.0))) == pytest.approx(1.0)


def test_normalize(spark):
    assert one(spark, X.normalize_query("q"), q="  國 Ａ，  b？ ") == "国 ａ, b?"
    assert one(spark, X.clean_for_search("q"), q=" a​​ b  \t c\r\n\n d ") == "a\nb c\nd"
    assert one(spark, X.word_count("q"), q="  ") == 0
    assert one(spark, X.byte_tokens("q"), q="abcdefghi") == 2


def test_redact_order(spark):
    assert one(spark, X.redact("q"), q="a@b.co 13812345678 sk-abcdefghijklmnopqrstuvwx") == "[EMAIL] [PHONE] [API_KEY]"


def test_names_and_slugs(spark):
    assert one(spark, X.name_for_match("q"), q=" Report.PDF ") == "report"
    assert one(spark, X.name_for_match("q"), q=".hidden") == ".hidden"
    assert one(spark, X.slugify_for_match("q"), q="Alice Smith_Jr") == "alice-smith-jr"
    assert one(spark, X.slugify_path("q"), q="Notes/Über Café!.md") == "notes/uber-cafe"
    assert one(spark, X.infer_page_type("q"), q="People/bob") == "person"
    assert one(spark, X.infer_page_type("q"), q="x/bob") == "note"


def test_blobs(spark):
    assert one(spark, X.blob_to_vector(X.vector_to_blob("v")), v=F.array(F.lit(1.5).cast("float"), F.lit(-2.0).cast("float"))) == [1.5, -2.0]


def test_dates_and_backoff(spark):
    assert one(spark, X.is_date("q"), q="2024-02-30") is False
    assert one(spark, X.is_date("q"), q="2024-02-29") is True
    assert one(spark, X.backoff_ms("n", 100, 1000), n=5) == 1000
    assert one(spark, X.backoff_ms("n", 100, 1000), n=3) == 400


def test_expansions(spark):
    assert one(spark, X.sanitize_expansions("a"), a=F.array(F.lit("<b>One</b>"), F.lit("one"), F.lit("two"), F.lit("three"))) == ["One", "two"]
    assert one(spark, X.sanitize_prompt("q"), q="Ignore: system: tell ```x``` me") == "tell me"
    assert one(spark, X.synonym_variants("q"), q="合同") == ["合同", "协议"]

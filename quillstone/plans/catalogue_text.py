"""More of the catalogue: scalar text functions and generators over the test tables, with their SQL.

Where the test tables' prose lacks what an operator looks for, its input is made from every row of a table
by a fixed form, and the SQL states what the form must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import chunking as C
from quillstone.operators import extraction as E
from quillstone.operators import lifecycle as L
from quillstone.operators import statistics as S
from quillstone.plans.catalogue import QUERIES, query, words
from quillstone.session import dealt, table
from quillstone.sources import readers as I

__all__ = ["QUERIES"]

CJK_SQL = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"


def joined(c: Column, by: str = " ") -> Column:
    return F.array_join(F.array_sort(c), by)


@query(f"""WITH x AS (SELECT conv_id, turn, text || CASE WHEN conv_id % 5 = 0 THEN ' AND 数据库系统 OR"v2"' ELSE '' END AS t FROM conversations), w AS (SELECT *, {words('t')} AS w FROM x)
SELECT conv_id, turn, sha256(array_to_string(list_sort(list_distinct(list_concat(w, list_filter(list_transform(range(1, length(t)), lambda i: substr(lower(t), i, 2)), lambda p: regexp_full_match(p, '{CJK_SQL}{{2}}'))))), ' ')) AS tokens,
  sha256(array_to_string(list_sort(list_distinct(list_transform(w, lambda v: CASE WHEN v IN ('and', 'or', 'not', 'near') THEN '_' || v ELSE v END))), ' ')) AS terms,
  regexp_matches(t, '{CJK_SQL}') AS cjk, regexp_replace(t, '[^{CJK_SQL[1:-1]}]', '', 'g') AS cjk_text, sha256(regexp_replace(lower(trim(t)), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS token FROM w""")
def q70_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and escaped search terms of every turn."""
    t = table(spark, d, "conversations").withColumn("t", F.concat("text", F.when(F.col("conv_id") % 5 == 0, ' AND 数据库系统 OR"v2"').otherwise("")))
    sha = lambda c: F.sha2(c, 256)
    return t.select("conv_id", "turn", sha(joined(X.tokens("t"))).alias("tokens"), sha(joined(X.match_terms("t"))).alias("terms"), X.has_cjk("t").alias("cjk"), X.cjk_of("t").alias("cjk_text"), sha(X.normalize_token("t")).alias("token"))


FILE_SQL = "SELECT p_partkey, replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '-' ELSE ' ' END) || '.' || (['pdf', 'CSV', 'md', 'tar'])[p_partkey % 4 + 1] AS f FROM part"


def file_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    sep = F.when(k % 3 == 0, "_").when(k % 3 == 1, "-").otherwise(" ")
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "CSV", "md", "tar"))), (k % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.replace(F.col("p_name"), F.lit(" "), sep), F.lit("."), ext).alias("f"))


@query(f"""WITH x AS ({FILE_SQL}), y AS (SELECT *, lower(f) AS l, regexp_extract(lower(f), '\\.([^.]+)$', 1) AS e, regexp_replace(lower(f), '\\.[^.]+$', '') AS s FROM x)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_concat([s], string_split_regex(s, '[\\s_.\\-]+'), [e]), lambda v: v <> ''))), ' ') AS tokens, s AS name,
  regexp_matches(f, '\\.[A-Za-z]{{2,5}}$') AS exact, array_to_string(list_sort(list_distinct([f, 'documents/' || f])), ' ') AS variants, NOT regexp_matches(f, '/') AS valid,
  CASE e WHEN 'pdf' THEN 'application/pdf' WHEN 'csv' THEN 'text/csv' WHEN 'md' THEN 'text/markdown' ELSE 'application/octet-stream' END AS media,
  CASE e WHEN 'pdf' THEN 'pdf' WHEN 'csv' THEN 'csv' WHEN 'md' THEN 'markdown' ELSE 'text' END AS parser,
  trim(regexp_replace(regexp_replace(l, '\\.md$', ''), '[^a-z0-9._-]+', '-', 'g'), '-') AS slug FROM y""")
def q71_file_names(spark, d):
    """What a file's name tells."""
    t = file_names(spark, d)
    ext = F.regexp_extract("f", r"\.([^.]+)$", 1)
    return t.select(
        "p_partkey", joined(X.name_tokens("f")).alias("tokens"), X.name_for_match("f").alias("name"), X.is_exact_lookup("f").alias("exact"), joined(S.slug_variants(F.concat(F.lit("slug:"), "f"))).alias("variants"),
        S.valid_file_name(F.col("f")).alias("valid"), X.media_type(ext).alias("media"), I.parser_of(ext).alias("parser"), X.slugify_path(F.lower("f")).alias("slug"),
    )


PAIRS_SQL = lambda pairs: ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in pairs)
ASK_SQL = "SELECT s_suppkey, (['合同在哪里', '怎么安装系统', 'erp api', 'hello'])[s_suppkey % 4 + 1] || ' ' || s_suppkey AS q FROM supplier"


@query(f"""WITH x AS ({ASK_SQL})
SELECT s_suppkey, 'synonym' AS kind, q AS variant FROM x UNION ALL SELECT s_suppkey, 'synonym', replace(lower(q), a, b) FROM x, (VALUES {PAIRS_SQL(X.SYNONYMS)}) AS p(a, b) WHERE contains(lower(q), a)
UNION ALL SELECT s_suppkey, 'alias', q FROM x UNION ALL SELECT s_suppkey, 'alias', replace(lower(q), a, b) FROM x, (VALUES {PAIRS_SQL(X.ALIASES)}) AS p(a, b) WHERE contains(lower(q), a)
UNION ALL SELECT s_suppkey, 'latin', regexp_full_match(q, '[A-Za-z\\s]*')::VARCHAR FROM x UNION ALL SELECT s_suppkey, 'count', len(regexp_extract_all(q, '{CJK_SQL}|[A-Za-z0-9]+'))::VARCHAR FROM x""")
def q72_query_variants(spark, d):
    """Synonyms, aliases, romanised queries, token counts."""
    k = F.col("s_suppkey")
    x = table(spark, d, "supplier").select("s_suppkey", F.concat(F.element_at(F.array(*map(F.lit, ("合同在哪里", "怎么安装系统", "erp api", "hello"))), (k % 4 + 1).cast("int")), F.lit(" "), k.cast("string")).alias("q"))
    row = lambda kind, c: x.select("s_suppkey", F.lit(kind).alias("kind"), c.alias("variant"))
    return row("synonym", F.explode(X.synonym_variants("q"))).union(row("alias", F.explode(X.alias_variants("q")))).union(row("latin", X.is_latin_query("q").cast("string"))).union(row("count", X.token_count("q").cast("string")))


@query("""WITH x AS (SELECT event_id, event_type, ts::DATE::VARCHAR AS day, event_id % 3 AS k FROM events)
SELECT event_id, day AS "date", event_type AS summary, CASE WHEN k = 0 THEN 'a' || event_id || ':image' ELSE '' END AS media, '{"a":"1","b":"' || event_id || '"}' AS merged,
  sha256('{"event_type":"' || event_type || '","k":' || k || '}') AS hash, 'Sheet: s' || chr(10) || 'Headers: x, y' || chr(10) || 'Row: {"x":' || event_id || '}' AS row_text FROM x""")
def q73_json_functions(spark, d):
    """Payloads, media references, merged metadata, hashes and row texts."""
    k = F.col("event_id") % 3
    x = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("date").cast("string").alias("day"), k.alias("k"))
    s = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    key = F.when(k == 0, "event_date").otherwise("date")
    what = F.when(k == 0, "summary").when(k == 1, "event").otherwise("title")
    payload = s('{"', key, '":"', F.col("day"), '","', what, '":"', F.col("event_type"), '"}')
    meta = F.when(k == 0, s('{"media_refs":[{"asset_id":"a', F.col("event_id").cast("string"), '","kind":"image","path":"p"}]}')).otherwise("{}")
    refs = F.transform(X.media_refs("meta"), lambda m: F.concat(m["asset_id"], F.lit(":"), m["kind"]))
    x = x.withColumn("meta", meta).withColumn("payload", X.timeline_payload(payload))
    return x.select(
        "event_id", "payload.date", "payload.summary", F.coalesce(F.array_join(refs, ","), F.lit("")).alias("media"), X.merge_metadata(F.lit('{"a":"1","b":"2"}'), s('{"b":"', F.col("event_id").cast("string"), '"}')).alias("merged"),
        X.content_hash("event_type", "k").alias("hash"), X.row_text(F.lit("s"), F.array(F.lit("x"), F.lit("y")), s('{"x":', F.col("event_id").cast("string"), "}")).alias("row_text"),
    )


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS n, label, lead(label) OVER (ORDER BY vec_id) AS m FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(e, n), 6) AS same_size, 0.0::DOUBLE AS other_size, round(list_cosine_similarity(e[1:32], n[1:32]), 6) AS cut, CASE WHEN label = m THEN 1.0 ELSE 1 / 3.0 END::DOUBLE AS alike, 64 AS size FROM e WHERE n IS NOT NULL""")
def q74_vector_functions(spark, d):
    """Blobs to vectors and back, both cosines, set similarity; each vector against the next."""
    e = table(spark, d, "embeddings").withColumn("embedding", X.blob_to_vector(F.concat(X.vector_to_blob("embedding"), F.lit(b"\x01"))))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("n"), F.col("label").alias("m"))
    half = F.slice("n", 1, 32)
    alike = X.jaccard(F.array(F.lit(-1), F.col("label")), F.array(F.lit(-1), F.col("m")))
    return e.join(n, "vec_id").select("vec_id", F.round(X.cosine("embedding", "n"), 6).alias("same_size"), X.cosine(F.col("embedding"), half).alias("other_size"), F.round(X.cosine_truncating(F.col("embedding"), half), 6).alias("cut"), alike.alias("alike"), F.size("embedding").alias("size"))


@query("""WITH x AS (SELECT doc_id, text, '2024-02-' || lpad((doc_id % 35)::VARCHAR, 2, '0') AS day FROM documents)
SELECT doc_id, sha256(CASE WHEN length(text) <= 100 THEN text WHEN regexp_extract(left(text, 100), '(?s)^(.*)\\s', 1) <> '' THEN regexp_extract(left(text, 100), '(?s)^(.*)\\s', 1) ELSE left(text, 100) END) AS head,
  try_cast(day AS DATE) IS NOT NULL AS is_date, 'see ***PATH*** and htt***PATH*** with Bearer ***REDACTED*** in ***POSIX_PATH*** token***REDACTED***' AS diagnostic, CASE WHEN length(text) = 0 THEN 0.0 ELSE round(least(1.0, greatest(0.1, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / length(text) * 1.2)), 6) END::DOUBLE AS quality,
  len(list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda v: v <> '')) AS words FROM x""")
def q75_text_functions(spark, d):
    """Cuts at words, dates, diagnostics without paths, quality."""
    t = table(spark, d, "documents")
    day = F.concat(F.lit("2024-02-"), F.lpad((F.col("doc_id") % 35).cast("string"), 2, "0"))
    said = F.concat(F.lit("see C:\\Users\\u"), F.col("doc_id").cast("string"), F.lit(" and http://10.0.0.1:80/x with Bearer abc"), F.col("doc_id").cast("string"), F.lit(" in /data/a/b.txt token=abcdefghijklmnopqrstuvwx"))
    return t.select("doc_id", F.sha2(X.truncate_at_word("text", 100), 256).alias("head"), X.is_date(day).alias("is_date"), X.redact_diagnostic(said).alias("diagnostic"), F.round(X.text_quality("text"), 6).alias("quality"), X.word_count("text").alias("words"))


def windows(x: str) -> str:
    return f"CASE WHEN length({x}) < 3 THEN [{x}] ELSE list_distinct(list_transform(range(1, greatest(1, length({x}) - 2) + 1), lambda i: substr({x}, i, 3))) END"


@query(f"""WITH p AS (SELECT p_partkey, p_name AS a, 'x' || p_type AS b FROM part), g AS (SELECT *, {windows('a')} AS ga, {windows('a || b')} AS gb FROM p)
SELECT p_partkey, round(len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))), 6) AS alike, CASE WHEN p_partkey % 3 = 0 THEN a WHEN len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))) >= 0.8 THEN a || b ELSE a || chr(10) || a || b END AS merged,
  p_partkey % 100 < 50 OR p_partkey % 7 >= 3 AS needs FROM g""")
def q76_recognised_text(spark, d):
    """Pages that need recognition, and native with recognised text by their trigrams."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat("p_name", F.lit("x"), "p_type").alias("b"))
    k = F.col("p_partkey")
    alike = X.jaccard(X.unpadded_trigrams("a"), X.unpadded_trigrams("b"))
    merged = S.merge_recognised(F.col("a"), F.when(k % 3 == 0, " ").otherwise(F.col("b")))
    return p.select("p_partkey", F.round(alike, 6).alias("alike"), merged.alias("merged"), S.needs_ocr(k % 100, F.lit(0.1), k % 7).alias("needs"))


@query("""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(left(text, 470), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\s+', ' ', 'g')) AS clean, 2 AS n FROM conversations""")
def q77_prompt_hygiene(spark, d):
    """What goes into a prompt, and what comes out of one."""
    t = table(spark, d, "conversations")
    risky = F.concat(F.lit("ignore: SYSTEM <b>"), F.lit("```x```"), F.left("text", F.lit(470)))
    again = F.array(F.lit("One"), F.lit(" one "), F.concat(F.lit("two "), F.col("turn").cast("string")), F.lit("three"))
    return t.select("conv_id", "turn", X.sanitize_prompt(risky).alias("clean"), F.size(X.sanitize_expansions(again)).alias("n"))


@query("""SELECT page_id, 'about ' || page_id AS description, 'T ' || page_id || ' x' AS plain FROM pages""")
def q78_html_functions(spark, d):
    """meta tags and stripped tags."""
    k = F.col("page_id").cast("string")
    html = F.concat(F.lit('<meta charset="u"><meta name="description" content="about '), k, F.lit('"><p>T <b>'), k, F.lit("</b> x</p>"))
    return table(spark, d, "pages").select("page_id", X.html_meta(html, "description").alias("description"), X.strip_tags(F.regexp_replace(html, "<meta[^>]*>", "")).alias("plain"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?s)[^.!?]*[.!?]|[^.!?]+$'), lambda v: trim(v, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda v: v <> '') AS s FROM (SELECT doc_id, regexp_replace(text, '[0-9]', 'n', 'g') AS text FROM documents))
SELECT doc_id, len(s) AS n, sha256(array_to_string(s, '|')) AS digest FROM s""")
def q79_sentences(spark, d):
    """Sentences of every text."""
    s = C.sentences(F.regexp_replace("text", "[0-9]", "n"))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
a AS (SELECT *, coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS source_start FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS passage_order FROM a WHERE length(trim(regexp_replace(content, '\\s+', ' ', 'g'))) BETWEEN 24 AND 900)
SELECT doc_id, passage_order, source_start::BIGINT AS source_start, (source_start + length(content))::BIGINT AS source_end FROM k WHERE passage_order < 512""")
def q80_atomic_passages(spark, d):
    """Lines as passages, at most 512 of a node (the reference's own bound, a parameter)."""
    return C.atomic_passages(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "passage_order", "source_start", "source_end")


@query("""WITH o AS (SELECT o_orderkey, '2024-01-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0') AS day FROM orders)
SELECT o_orderkey, 1 AS line, day AS "date", 'bold ' || o_orderkey AS summary FROM o UNION ALL SELECT o_orderkey, 2, day, 'dash and more' FROM o UNION ALL SELECT o_orderkey, 4, day, 'colon' FROM o""")
def q81_timeline_entries(spark, d):
    """Three forms of entries and a line that carries on."""
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("o_orderkey") % 28 + 1).cast("string"), 2, "0"))
    text = F.concat(F.lit("# Log\n- **"), day, F.lit("** | bold "), F.col("o_orderkey").cast("string"), F.lit("\n- "), day, F.lit(" — dash\n  and more\n- "), day, F.lit(": colon\n- 2024-13-45: no date"))
    return C.timeline_entries(table(spark, d, "orders").select("o_orderkey", text.alias("t")), "o_orderkey", "t")


@query("""SELECT p_partkey, 0 AS block, 'rust' AS language, 'fn f' || p_partkey || '() {}' || chr(10) AS code FROM part UNION ALL SELECT p_partkey, 1, '', 'plain' || chr(10) FROM part""")
def q82_fenced_blocks(spark, d):
    """Fenced code, and a text without it."""
    text = F.concat(F.lit("a\n```rust\nfn f"), F.col("p_partkey").cast("string"), F.lit("() {}\n```\nb `x` c\n```\nplain\n```\n"))
    return C.fenced_blocks(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")


REFS = "Met [Ann](people/ann-{k}) who founded it. See [[companies/acme-{k}|Acme]] and [works_at:Bo](people/bo). Also people/ann-{k} and deals/seed-{k}.\n`people/not-this` [out](https://x.org)"


@query("""SELECT c_custkey, 'people/ann-' || c_custkey AS slug, 'Ann' AS name, 'founded' AS link_type FROM customer UNION ALL SELECT c_custkey, 'companies/acme-' || c_custkey, 'Acme', 'founded' FROM customer
UNION ALL SELECT c_custkey, 'people/bo', 'Bo', 'works_at' FROM customer UNION ALL SELECT c_custkey, 'deals/seed-' || c_custkey, 'seed-' || c_custkey, 'mentions' FROM customer""")
def q83_entity_refs(spark, d):
    """References of every page, with the kind of each link."""
    text = F.replace(F.lit(REFS), F.lit("{k}"), F.col("c_custkey").cast("string"))
    return E.entity_refs(dealt(table(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", text.alias("t")), "c_custkey", "t").select("c_custkey", "slug", "name", "link_type")


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'invested_in' WHEN 1 THEN 'works_at' WHEN 2 THEN 'advises' WHEN 3 THEN 'invested_in' WHEN 4 THEN 'acquired' ELSE 'mentions' END AS kind FROM customer""")
def q84_link_types(spark, d):
    """Phrases tell the kind of a link; capitals of the pattern never match lower-cased text."""
    k = F.col("c_custkey") % 6
    said = F.element_at(F.array(*map(F.lit, ("she led the huge round there", "spent nine years at the firm", "joined an advisory board", "partner at the fund", "it acquired them", "CEO of it"))), (k + 1).cast("int"))
    target = F.when(k.isin(0, 1, 2, 5), "people/x").otherwise("companies/x")
    return table(spark, d, "customer").select("c_custkey", E.link_type(said, target).alias("kind"))


RULES = [("company", "works_at", "out"), ("investors", "invested_in", "in")]


@query("""SELECT s_suppkey, 'acme-' || s_suppkey AS slug, 'works_at' AS link_type, 'out' AS direction FROM supplier UNION ALL SELECT s_suppkey, v, 'invested_in', 'in' FROM supplier, (VALUES ('ann-b'), ('bo')) AS x(v)""")
def q85_frontmatter_refs(spark, d):
    """Links from frontmatter fields by rules."""
    fields = F.create_map(F.lit("company"), F.concat(F.lit("Acme "), F.col("s_suppkey").cast("string")), F.lit("investors"), F.lit("Ann B, Bo"), F.lit("other"), F.lit("x"))
    return E.frontmatter_refs(table(spark, d, "supplier").select("s_suppkey", fields.alias("f")), "s_suppkey", "f", RULES)


@query("""SELECT event_id, array_to_string(list_sort(list_filter([event_type, CASE WHEN event_id % 2 = 0 THEN 'status-draft' END, 'year-2024'], lambda x: x IS NOT NULL)), ',') AS tags FROM events""")
def q86_tags(spark, d):
    """Page type, years and status words."""
    e = table(spark, d, "events")
    text = F.concat(F.lit("in 2024 again 2024 "), F.when(F.col("event_id") % 2 == 0, "a Draft").otherwise(""))
    return e.select("event_id", F.array_join(E.tags(text, F.col("event_type")), ",").alias("tags"))


@query("""SELECT o_orderkey, 'people/a' AS to_slug, 0.9::DOUBLE AS confidence FROM orders UNION ALL SELECT o_orderkey, 'x-' || o_orderkey || '.md', 0.8::DOUBLE FROM orders""")
def q87_suggested_links(spark, d):
    """Links that a text suggests, each once."""
    text = F.concat(F.lit("[[people/a]] [n](x-"), F.col("o_orderkey").cast("string"), F.lit(".md) [o](https://o.org) [again](people/a)"))
    return E.suggested_links(table(spark, d, "orders").select("o_orderkey", text.alias("t")), "o_orderkey", "t")


@query("""SELECT doc_id, sha256('# Title' || chr(10) || '```' || chr(10) || lang || chr(10) || '```') AS digest FROM documents""")
def q88_fix_lint(spark, d):
    """Preambles go and an open fence is closed."""
    text = F.concat(F.lit("Here is the page\n# Title\n```\n"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.sha2(E.fix_lint(text), 256).alias("digest"))


@query("""WITH n AS (SELECT 'n/' || n_nationkey || CASE WHEN n_nationkey % 5 = 0 THEN '_x' ELSE '' END AS slug, n_nationkey AS k FROM nation),
l AS (SELECT a.slug AS f, coalesce(b.slug, 'n/gone') AS t FROM n a LEFT JOIN n b ON b.k = a.k + 1)
SELECT slug, 'slug' AS "check", slug AS detail FROM n WHERE NOT regexp_matches(slug, '^[a-z0-9/\\-]+$') UNION ALL SELECT slug, 'triple-rule', '' FROM n WHERE k % 2 = 0
UNION ALL SELECT f, 'links', t FROM l WHERE t NOT IN (SELECT slug FROM n) UNION ALL SELECT f, 'back-links', t FROM l WHERE t IN (SELECT slug FROM n)""")
def q89_validate(spark, d):
    """Forms of slugs, rules in threes, dead links and links without a way back."""
    k = F.col("n_nationkey")
    slug = lambda x: F.concat(F.lit("n/"), x.cast("string"), F.when(x % 5 == 0, "_x").otherwise(""))
    n = table(spark, d, "nation")
    pages = n.select(slug(k).alias("slug"), F.when(k % 2 == 0, "---\na\n---\nb\n---\n").otherwise("a").alias("t"))
    links = n.select(slug(k).alias("from_slug"), F.when(k == 24, "n/gone").otherwise(slug(k + 1)).alias("to_slug"))
    return E.validate(pages, "slug", "t", links)


@query("""SELECT p_partkey, chunk_index, digest FROM (
  SELECT p_partkey, 0 AS chunk_index, sha256('# A' || chr(10) || p_name || chr(10)) AS digest FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 1, sha256('## B' || chr(10) || 'text') FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 0, sha256('fn a() {}') FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 1, sha256('fn b() {}') FROM part WHERE p_partkey % 3 = 1
  UNION ALL SELECT p_partkey, 0, sha256(array_to_string(list_transform(range(40), lambda i: 'r' || i), chr(10))) FROM part WHERE p_partkey % 3 = 2 UNION ALL SELECT p_partkey, 1, sha256(array_to_string(list_transform(range(40, 50), lambda i: 'r' || i), chr(10))) FROM part WHERE p_partkey % 3 = 2)""")
def q90_adaptive_chunks(spark, d):
    """Sections by headings, code by blank lines, tables by row groups."""
    k = F.col("p_partkey") % 3
    rows = F.lit("\n".join(f"r{i}" for i in range(50)))
    text = F.when(k == 0, F.concat(F.lit("# A\n"), "p_name", F.lit("\n## B\ntext"))).when(k == 1, "fn a() {}\n\nfn b() {}").otherwise(rows)
    ext = F.when(k == 0, "md").when(k == 1, "RS").otherwise("csv")
    docs = table(spark, d, "part").select("p_partkey", text.alias("t"), ext.alias("ext"))
    return C.adaptive_chunks(docs, "ext", "t", "p_partkey").select("p_partkey", "chunk_index", F.sha2("chunk_text", 256).alias("digest"))


@query("""WITH t AS (SELECT doc_id, length(text) AS n, least(20, length(text)) AS a FROM documents WHERE text IS NOT NULL),
u AS (SELECT *, CASE WHEN n > 15 THEN 15 ELSE greatest(0, a - 10) END AS s, CASE WHEN n > 15 THEN least(40, n) ELSE greatest(0, a - 10) END AS e FROM t)
SELECT doc_id, 0 AS i, 0 AS "start", a AS "end" FROM u UNION ALL SELECT doc_id, 1, s, e FROM u UNION ALL SELECT doc_id, 2, CASE WHEN n > 35 THEN 35 ELSE greatest(0, e - 10) END, CASE WHEN n > 35 THEN n ELSE greatest(0, e - 10) END FROM u""")
def q91_locate_chunks(spark, d):
    """Places of overlapping chunks in their text, each looked for near the end of the last; chunks beyond a short text are empty.

    A number in front makes every place of the text unique enough for its first match.
    """
    t = table(spark, d, "documents").where("text is not null")
    full = F.expr("if(text = '', '', array_join(transform(sequence(1, length(text)), i -> decode(unhex(lpad(hex(19968 + i % 20000), 4, '0')), 'UTF-16BE')), ''))")
    t = t.select("doc_id", full.alias("full"))
    parts = F.array(F.substring("full", 1, 20), F.substring("full", 16, 25), F.expr("substr(full, 36)"))
    found = t.select("doc_id", F.posexplode(C.locate_chunks(10)("full", parts)).alias("i", "c"))
    return found.select("doc_id", "i", "c.start", "c.end")


@query("""WITH e AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
s AS (SELECT label, i, round(list_cosine_similarity(v, n), 9) AS s FROM e WHERE n IS NOT NULL), l AS (SELECT label, list_sort(list(s)) AS a FROM s GROUP BY 1),
c AS (SELECT s.label, i FROM s JOIN l USING (label) WHERE s < a[least(len(a), floor(len(a) * 0.6)::INT + 1)])
SELECT e.label, e.vec_id, (SELECT count(*) FROM c WHERE c.label = e.label AND c.i < e.i) AS chunk FROM e""")
def q92_embedding_breaks(spark, d):
    """Sentences with vectors cut where neighbours are least alike."""
    e = table(spark, d, "embeddings")
    place = F.row_number().over(C.Window.partitionBy("label").orderBy("vec_id")) - 1
    return C.embedded_chunks(e.select("label", "vec_id", place.alias("i"), "embedding"), "label").select("label", "vec_id", "chunk")


@query("""SELECT doc_id, 'summary' AS candidate_type, lang AS payload, 0.8::DOUBLE AS confidence, 'low' AS risk FROM documents UNION ALL SELECT doc_id, 'fact', source, 0.7::DOUBLE, 'low' FROM documents UNION ALL SELECT doc_id, 'entity', 'e' || doc_id, 0.75::DOUBLE, 'medium' FROM documents
UNION ALL SELECT doc_id, 'timeline', '2024', 0.6::DOUBLE, 'medium' FROM documents UNION ALL SELECT doc_id, 'link', 'l', 0.5::DOUBLE, 'low' FROM documents UNION ALL SELECT doc_id, 'fact', lang, 0.6::DOUBLE, 'medium' FROM documents""")
def q93_promotion_candidates(spark, d):
    """What a document offers for promotion."""
    one = lambda c: F.array(c)
    t = table(spark, d, "documents").select("doc_id", F.col("lang").alias("summary"), one(F.col("source")).alias("keywords"), one(F.concat(F.lit("e"), F.col("doc_id").cast("string"))).alias("entities"), one(F.lit("2024")).alias("dates"), one(F.lit("l")).alias("links"))
    return L.promotion_candidates(t)


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN -1 ELSE 3 END AS chunks FROM documents""")
def q94_model_chunks(spark, d):
    """Chunks from a provider are taken if they give the text back, else the splitter's are."""
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("one two. three four. five "), F.col("doc_id").cast("string")).alias("t"))
    parts = F.split("t", r"(?<=\.) ")
    offered = t.withColumn("offered", F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("made up"))).otherwise(parts))
    out = C.checked_chunks(offered, "t", "offered", C.character_splitter())
    return out.select("doc_id", F.when(F.col("accepted"), F.size("chunks")).otherwise(-1).alias("chunks"))

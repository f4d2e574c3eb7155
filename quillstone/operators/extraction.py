"""Extraction and checks over page texts: references, entities, keywords, tags, symbols, lint, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillstone.functions import text as X

#: Directories a slug may begin with.
SLUG_DIRS = "people|companies|deals|topics|concepts|projects|entities|tech|finance|personal|openclaw|wiki|writing|meetings|deal|civic|project|source|media|yc"
#: Phrases that tell the kind of a link; they are held against lower-cased text, so those with capitals never match.
FOUNDED = r"\b(?:founded|co-?founded|started the company|incorporated|founders?\b|founder of|founders? (?:include|are)|the founder|is a co-?founder|is one of the founders)\b"
INVESTED = r"\b(?:invested in|invests in|investing in|invest in|investment in|investments in|backed by|funding from|funded by|raised from|led the (?:seed|Series|round|investment|round)|led .{0,30}(?:Series [A-Z]|seed|round|investment)|participated in (?:the )?(?:seed|Series|round)|wrote (?:a |the )?check|first check|early investor|portfolio (?:company|includes)|board seat (?:at|in|on)|term sheet for)\b"
ADVISES = r"\b(?:advises|advised|advisor (?:to|at|for|of)|advisory (?:board|role|position)|board advisor|on .{0,20} advisory board|joined .{0,20} advisory board)\b"
WORKS_AT = r"\b(?:CEO of|CTO of|COO of|CFO of|CMO of|CRO of|VP at|VP of|VPs? Engineering|VPs? Product|works at|worked at|working at|employed by|employed at|joined as|joined the team|engineer at|engineer for|director at|director of|head of|leads engineering|leads product|currently at|previously at|previously worked at|spent .* (?:years|months) at|stint at|tenure at)\b"
PARTNER = r"\b(?:partner at|partner of|venture partner|VC partner|invested early|investor at|investor in|portfolio|venture capital|early-stage investor|seed investor|fund [A-Z]|invests across|backs companies)\b"
ADVISOR = r"\b(?:full-time advisor|professional advisor|advises (?:multiple|several|various))\b"
#: Openings of machine-written answers.
PREAMBLES = ["of course,", "certainly,", "here is", "here's", "i've created", "i have created", "sure!", "absolutely!", "let me", "as an ai", "as a language model", "i'd be happy to", "i would be happy to", "i can help", "great question"]
#: Words that are never keywords.
STOP_WORDS = "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 那 些".split() + "the a an is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through during and but or nor not so yet both either".split()
COMPANY_WORDS = r"(?i)\b(Inc|Corp|Ltd|LLC|Labs?|Tech|AI|Capital|Ventures?|Fund)\b"
#: Per page type the dimensions and their weights; a field:a|b dimension is 1 if frontmatter has a or b.
RUBRICS: dict[str, list[tuple[str, float]]] = {
    "person": [("field:company|role", 0.20), ("urls", 0.20), ("timeline", 0.15), ("citations", 0.15), ("none", 0.10), ("recency", 0.10), ("all", 0.10)],
    "company": [("body", 0.20), ("field:founders", 0.15), ("field:funding", 0.15), ("urls", 0.15), ("citations", 0.15), ("field:employees|investors", 0.10), ("recency", 0.10)],
    "project": [("body", 0.25), ("field:owner", 0.20), ("timeline", 0.15), ("citations", 0.15), ("field:status", 0.15), ("recency", 0.10)],
    "deal": [("field:company", 0.25), ("field:amount|terms", 0.25), ("field:date", 0.15), ("urls", 0.15), ("citations", 0.20)],
    "concept": [("body", 0.35), ("citations", 0.30), ("none", 0.20), ("field:related", 0.15)],
    "source": [("urls", 0.35), ("field:author", 0.20), ("field:date", 0.20), ("body", 0.25)],
    "": [("title", 0.30), ("body", 0.30), ("urls", 0.20), ("citations", 0.20)],
}


def without_code(c: Column | str) -> Column:
    """Code blocks and spans removed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(c, r"```[\s\S]*?(```|$)", " "), "`[^`\n]*`", " ")


def is_slug(c: Column) -> Column:
    return c.rlike(f"^({SLUG_DIRS})/[a-z0-9][a-z0-9/-]*$")


def link_type(context: Column, target: Column, source_type: Column | None = None) -> Column:
    """The kind of a link, from the words around it, then from the types of its ends."""
    t, x = F.lower(context), F.lower(target)
    person, company = x.startswith("people/"), x.startswith("companies/")
    cases = [
        (person & t.rlike(FOUNDED), "founded"), (person & t.rlike(INVESTED), "invested_in"), (person & t.rlike(ADVISES), "advises"), (person & t.rlike(WORKS_AT), "works_at"), (person & t.rlike("attended|attendee"), "attended"),
        (company & t.rlike(INVESTED), "invested_in"), (company & t.rlike(FOUNDED), "founded"), (company & t.contains("acquired"), "acquired"), (company & t.rlike(PARTNER), "invested_in"),
        (x.startswith("deals/"), "deal"),
    ]
    if source_type is not None:
        cases += [
            ((source_type == "person") & company & t.rlike(ADVISOR), "advises"), ((source_type == "person") & company, "works_at"),
            ((source_type == "company") & person & t.rlike(PARTNER), "invested_in"), ((source_type == "company") & person, "key_person"),
            (source_type == "company", "acquired"), (source_type == "person", "advised_by"),
        ]
    return X.ladder(cases, "mentions")


def entity_refs(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, slug, name, link_type of labelled links, markdown links, wiki links and bare slugs."""
    clean = pages.select(key, without_code(text).alias("t"))

    def all_of(pattern: str, *groups: int) -> DataFrame:
        zipped = F.arrays_zip(*(F.regexp_extract_all("t", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in (0, *groups)))
        # A match's place: the text is cut at the pattern, and a match lies behind the pieces and matches before it.
        pieces = F.split("t", f"(?:{pattern})")
        spread_out = clean.select(key, "t", zipped.alias("m"), pieces.alias("p")).select(key, "t", "p", F.posexplode("m").alias("i", "m"), F.col("m").alias("all"))
        before = F.expr("aggregate(slice(p, 1, i + 1), 0, (n, x) -> n + length(x)) + aggregate(slice(all, 1, i), 0, (n, x) -> n + length(x.g0)) + 1")
        return spread_out.select(key, "t", before.alias("at"), "m.*")

    around = lambda df: df.withColumn("context", F.expr("substring(t, greatest(1, at - 120), 240 + length(g0))"))
    labelled = all_of(r"\[([a-z_]+):([^\]]+)\]\(([^)]+)\)", 1, 2, 3).where(is_slug(F.col("g3"))).select(key, F.col("g3").alias("slug"), F.col("g2").alias("name"), F.col("g1").alias("link_type"), F.lit(0).alias("p"))
    links = around(all_of(r"\[([^\]]+)\]\(([^)]+)\)", 1, 2).where(is_slug(F.col("g2")) & ~F.col("g1").contains(":")))
    links = links.select(key, F.col("g2").alias("slug"), F.col("g1").alias("name"), link_type(F.col("context"), F.col("g2")).alias("link_type"), F.lit(1).alias("p"))
    wiki = around(all_of(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", 1, 2)).withColumn("s", F.regexp_replace(F.regexp_replace("g1", "#.*$", ""), r"\.md$", "")).where(is_slug(F.col("s")))
    wiki = wiki.select(key, F.col("s").alias("slug"), F.when(F.col("g2") != "", F.col("g2")).otherwise(F.regexp_extract("s", "([^/]+)$", 1)).alias("name"), link_type(F.col("context"), F.col("s")).alias("link_type"), F.lit(2).alias("p"))
    bare = all_of(rf"\b(?:{SLUG_DIRS})/[a-z0-9][a-z0-9/-]*\b").select(key, F.col("g0").alias("slug"), F.regexp_extract("g0", "([^/]+)$", 1).alias("name"), F.lit("mentions").alias("link_type"), F.lit(3).alias("p"))
    named = labelled.union(links).union(wiki)
    every = named.union(bare.join(named.select(key, "slug"), [key, "slug"], "left_anti").select(*named.columns))
    first = F.row_number().over(Window.partitionBy(key, "slug", "link_type").orderBy("p", "name"))
    return every.withColumn("n", first).where("n = 1").drop("n", "p")


def frontmatter_refs(pages: DataFrame, key: str, fields: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """key, slug, link_type, direction from a map of frontmatter fields and (field, type, direction) rules."""
    spark = pages.sparkSession
    table = F.broadcast(spark.createDataFrame(rules, "field string, link_type string, direction string"))  # written in code
    rows = pages.select(key, F.explode(fields).alias("field", "value")).select(key, "field", F.explode(F.split("value", r"\s*,\s*")).alias("value"))
    return rows.join(table, "field").select(key, X.slugify_for_match("value").alias("slug"), "link_type", "direction")


def entity_candidates(docs: DataFrame, key: str, text: str, most: int = 20) -> DataFrame:
    """key, rank, name, entity_type of runs of two to four capitalised words, first seen first."""
    names = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b"), F.lit(1))), 1, most)
    rows = docs.select(key, F.posexplode(names).alias("rank", "name"))
    kind = X.ladder([(F.col("name").rlike(COMPANY_WORDS), "company"), (F.size(F.split("name", r"\s+")) == 2, "person")], "unknown")
    return rows.select(key, "rank", "name", kind.alias("entity_type"))


def tier(mentions: Column, sources: Column, page_type: Column) -> Column:
    return X.ladder([(mentions >= 8, 1), (page_type.isin("meeting", "note"), 1), ((mentions >= 3) & (sources >= 2), 2)], 3)


def tags(text: Column, page_type: Column, most: int = 10) -> Column:
    """Page type, years and status words, sorted."""
    low = F.lower(text)
    years = F.transform(F.regexp_extract_all(low, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: F.concat(F.lit("year-"), y))
    status = [F.when(low.contains(w), f"status-{w}") for w in ("active", "inactive", "archived", "draft")]
    return F.slice(F.array_sort(F.array_distinct(F.concat(F.array(page_type), years, F.array_compact(F.array(*status))))), 1, most)


def suggested_links(docs: DataFrame, key: str, text: str, most: int = 20) -> DataFrame:
    """key, to_slug, confidence: wiki links, then markdown links that stay inside."""
    wiki = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda s: F.struct(s.alias("to_slug"), F.lit(0.9).alias("confidence")))
    md = F.transform(F.filter(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\(([^)]+)\)"), F.lit(2)), lambda s: ~s.startswith("http")), lambda s: F.struct(s.alias("to_slug"), F.lit(0.8).alias("confidence")))
    rows = docs.select(key, F.posexplode(F.concat(wiki, md)).alias("i", "l")).select(key, "i", "l.*")
    first = rows.groupBy(key, "to_slug").agg(F.min("i").alias("i"), F.min_by("confidence", "i").alias("confidence"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("i"))).where(F.col("n") <= most).select(key, "to_slug", "confidence")


def keywords(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, n, rank: the most frequent words, 5 and one more per 5,000 characters, 15 at most.

    Words keep their case and have two bytes or more; runs of CJK count as pairs of characters.
    """
    size = F.least(F.lit(15), F.lit(5) + F.floor(F.length(text) / 5000))
    # One generated row per text holds its size and sorted words, so neither is computed again for each word.
    own = F.sort_array(F.filter(X.words(text), lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOP_WORDS)))
    sized = docs.select(key, F.inline_outer(F.array(F.struct(size.alias("most"), own.alias("words"))))).where(F.size("words") > 0)
    begins = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1)))
    runs = sized.select(key, "most", "words", F.inline_outer(F.array(F.struct(begins.alias("at")))))
    each = F.transform("at", lambda i, j: F.struct(F.get("words", i).alias("term"), (F.coalesce(F.get("at", j + 1), F.size("words")) - i).alias("n")))
    # Words are counted where their text lies and dealt once, by text, for the sum and for the rank.
    counted = runs.select(key, "most", F.inline(each)).repartition(key).groupBy(key, "most", "term").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "term"))
    return counted.withColumn("rank", rank).where("rank <= most").select(key, "term", "n", "rank")


def pattern_entities(c: Column | str, most: int = 5) -> Column:
    """DATE: and EMAIL: entities, the first five of each."""
    c = F.col(c) if isinstance(c, str) else c
    take = lambda p, name: F.transform(F.slice(F.regexp_extract_all(c, F.lit(p), F.lit(0)), 1, most), lambda x: F.concat(F.lit(name), x))
    return F.concat(take(r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?", "DATE:"), take(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "EMAIL:"))


def lint(pages: DataFrame, key: str, text: str, slugs: DataFrame | None = None) -> DataFrame:
    """key, rule, severity, line of six rules, found in one pass; only citations are joined with slugs."""
    issue = lambda rule, severity, line, cited=None: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), line.cast("int").alias("line"), F.lit(cited).cast("string").alias("cited") if cited is None else cited.alias("cited"))
    numbered = F.transform(F.split(text, "\n"), lambda raw, i: F.struct(raw.alias("raw"), X.strip(raw).alias("t"), (i + 1).alias("line")))
    one = pages.select(key, F.col(text).alias("__text"), F.filter(numbered, lambda x: x["t"] != "").alias("full"))

    def of_line(x: Column, i: Column) -> Column:
        low, after = F.lower(x["t"]), F.get("full", i + 1)["t"]
        opens = F.lit(False)
        for p in PREAMBLES:
            opens = opens | low.startswith(p)
        dated = x["raw"].contains("[DATE]") | x["raw"].contains("{{DATE}}")
        found = F.array(
            F.when(opens, issue("llm-preamble", "warning", x["line"])), F.when(x["raw"].contains("YYYY-MM-DD"), issue("placeholder-date", "error", x["line"])), F.when(dated, issue("placeholder-date", "error", x["line"])),
            F.when(x["t"].startswith("## ") & (after.isNull() | after.startswith("#")), issue("empty-section", "info", x["line"])),
        )
        cites = F.filter(F.transform(F.regexp_extract_all(x["raw"], F.lit(r"\[Source:([^\]]+)\]"), F.lit(1)), X.strip), lambda c: c != "")
        return F.concat(F.array_compact(found), F.transform(cites, lambda c: issue("broken-citation", "warning", x["line"], c)))

    fences = F.filter("full", lambda x: x["t"].startswith("```"))
    bare = ~X.strip("__text").startswith("---") & (X.strip("__text") != "") & (F.size(F.split(F.regexp_replace("__text", "\n$", ""), "\n")) > 2)
    whole = F.array_compact(F.array(F.when(bare, issue("missing-frontmatter", "info", F.lit(1))), F.when(F.size(fences) % 2 == 1, issue("code-fence-residue", "error", F.element_at(fences, -1)["line"]))))
    found = one.select(key, F.inline(F.concat(whole, F.flatten(F.transform("full", of_line)))))
    out = found.where("cited is null").drop("cited")
    if slugs is not None:
        out = out.union(found.where("cited is not null").join(slugs.select(F.col("slug").alias("cited")), "cited", "left_anti").select(*out.columns))
    return out


def fix_lint(c: Column | str) -> Column:
    """Preamble lines at the top removed and an open fence closed."""
    c = F.col(c) if isinstance(c, str) else c
    fixed = F.array_join(F.filter(F.split(c, "\n"), lambda line: ~F.exists(F.array(*map(F.lit, PREAMBLES)), lambda p: F.startswith(F.lower(X.strip(line)), p))), "\n")
    odd = F.size(F.regexp_extract_all(fixed, F.lit(r"(?m)^\s*```"), F.lit(0))) % 2 == 1
    return F.when(odd, F.concat(fixed, F.lit("\n```"))).otherwise(fixed)


def validate(pages: DataFrame, key: str, text: str, links: DataFrame) -> DataFrame:
    """key, check, detail: slugs out of form, rules in threes, links without a page or without a way back."""
    form = pages.where(~F.col(key).rlike(r"^[a-z0-9/\-]+$")).select(key, F.lit("slug").alias("check"), F.col(key).alias("detail"))
    rules = pages.where(F.size(F.regexp_extract_all(text, F.lit(r"(?m)^---\s*$"), F.lit(0))) > 2).select(key, F.lit("triple-rule").alias("check"), F.lit("").alias("detail"))
    known = pages.select(F.col(key).alias("to_slug"))
    own = links.select(F.col("from_slug").alias(key), "to_slug")
    dead = own.join(known, "to_slug", "left_anti").select(key, F.lit("links").alias("check"), F.col("to_slug").alias("detail"))
    back = links.select(F.col("to_slug").alias(key), F.col("from_slug").alias("to_slug"))
    oneway = own.join(known, "to_slug", "left_semi").join(back, [key, "to_slug"], "left_anti").select(key, F.lit("back-links").alias("check"), F.col("to_slug").alias("detail"))
    return form.union(rules).union(dead).union(oneway)


def completeness(page_type: Column, title: Column, body: Column, timeline: Column, frontmatter: Column, updated: Column, as_of: Column) -> Column:
    """Weighted score of a page against its type's rubric, to three places."""
    count = lambda p: F.size(F.regexp_extract_all(body, F.lit(p), F.lit(0)))
    urls = count(r"\]\(\s*https?://")
    entries = F.size(F.filter(F.split(F.coalesce(timeline, F.lit("")), "\n"), lambda x: X.strip(x).startswith("-")))
    fm = F.coalesce(frontmatter, F.lit(""))
    measures = {
        "urls": X.ladder([(urls == 0, 0.0), (urls == 1, 0.6)], 1.0),
        "citations": F.least(F.lit(1.0), count(r"\[Source:\s*\S[^\]]*\]|\]\(\s*https?://[^)]+\)") / 3.0),
        "title": F.when(X.strip(title) == "", 0.0).otherwise(1.0),
        "body": F.when(F.octet_length(X.strip(body)) > 50, 1.0).otherwise(0.0),
        "timeline": X.ladder([(entries == 0, 0.0), (entries < 3, 0.5)], 1.0),
        "recency": X.recency(updated, as_of), "none": F.lit(0.0), "all": F.lit(1.0),
    }

    def of(name: str) -> Column:
        if not name.startswith("field:"):
            return measures[name]
        has = F.lit(False)
        for f in name[6:].split("|"):
            has = has | fm.contains(f'"{f}":') | fm.contains(f"{f}:")
        return has.cast("double")

    total = {kind: sum((w * of(d) for d, w in dims), F.lit(0.0)) for kind, dims in RUBRICS.items()}
    return F.round(X.ladder([(page_type == k, v) for k, v in total.items() if k], total[""]), 3)

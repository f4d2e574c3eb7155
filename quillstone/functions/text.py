"""Scalar text functions as column expressions; none of them leaves the JVM unless it says so."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"

#: Traditional characters and their simplified forms, in order.
TRADITIONAL = "國後時體對會機發書長門開關學實現萬為當個種裡從來這說話見頭氣無問愛電視聽變動風飛馬魚車點業義過進遠運連還總東臺灣華經繫處號區歷壓應邊標準導層際隊驗顯設計認識確質據轉難醫舊寫畫藥衛護辦處備預眾雙龍鳳鳥麼嗎呀員廣廠裝線組織節約紙統規則戰爭選舉"
SIMPLIFIED = "国后时体对会机发书长门开关学实现万为当个种里从来这说话见头气无问爱电视听变动风飞马鱼车点业义过进远运连还总东台湾华经系处号区历压应边标准导层际队验显设计认识确质据转难医旧写画药卫护办处备预众双龙凤鸟么吗呀员广厂装线组织节约纸统规则战争选举"
#: Full-width marks and their half-width forms.
FULL_WIDTH, HALF_WIDTH = "，。！？：；（）", ",.!?:;()"
#: Pairs that replace each other in queries.
SYNONYMS = [("合同", "协议"), ("怎么", "如何"), ("申请", "提交"), ("报销", "报账"), ("电脑", "计算机"), ("数据", "资料"), ("系统", "平台"), ("方案", "计划"), ("工具", "软件"), ("使用", "操作"), ("安装", "部署"), ("配置", "设置"), ("错误", "异常"), ("修复", "解决"), ("优化", "提升"), ("测试", "验证")]
ALIASES = [("oa", "办公自动化"), ("erp", "企业资源计划"), ("crm", "客户关系管理"), ("hr", "人力资源"), ("api", "接口"), ("db", "数据库"), ("ui", "界面"), ("ux", "用户体验"), ("ci/cd", "持续集成"), ("kpi", "绩效指标")]
#: What a redaction replaces, in the order in which it is applied.
REDACTIONS = [
    ("[EMAIL]", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("[PHONE]", r"1[3-9]\d{9}"),
    ("[ID_NUMBER]", r"\d{17}[\dXx]"),
    ("[API_KEY]", r"\b(sk-[a-zA-Z0-9]{20,}|pk-[a-zA-Z0-9]{20,}|[a-zA-Z0-9]{32,})\b"),
    ("[BANK_CARD]", r"\b\d{16,19}\b"),
]
#: What stored diagnostics must not show, in the order in which it is applied.
DIAGNOSTIC_REDACTIONS = [
    ("$1***REDACTED***", r"(?i)(Bearer\s+)\S+"),
    ("$1***REDACTED***", r"""(?i)(api[_-]?key|token|secret|authorization)["'\s:=]+["']?([a-zA-Z0-9_\-]{20,})"""),
    ("***PATH***", r"(?i)[A-Z]:[\\/][^\s'\"]+"),
    ("***FILE_URL***", r"(?i)file:/+[^\s'\"]+"),
    ("***INTERNAL_URL***", r"""(?i)https?://(127\.\d{1,3}\.\d{1,3}\.\d{1,3}|\[::1\]|\[fe[89ab][0-9a-f:.]+\]|\[f[cd][0-9a-f]{2}[0-9a-f:.]+\]|localhost|10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|169\.254\.\d{1,3}\.\d{1,3})(:\d+)?(/[^\s'"<>]*)?"""),
    ("***UNC_PATH***", r"""\\\\[a-zA-Z0-9_.$-]+(\\[^\s'"<>]*)+"""),
    ("$1***POSIX_PATH***", r"""(?m)(^|[\s=(:\x60'"<>])(/([a-zA-Z0-9_.-]+/)+[a-zA-Z0-9_.-]+)"""),
    ("$1***POSIX_PATH***", r"""(?m)(^|[\s=(:\x60'"<>])(/([a-zA-Z0-9_.-]+\.(?:pdf|png|jpe?g|gif|bmp|svg|webp|tiff?|json|xml|csv|txt|log|tmp|dat|bin|html?|css|js|py|rs|go|java|md|zip|tar|gz|bz2|xz|7z|docx?|xlsx?|pptx?)))"""),
]
#: Media types by extension.
MEDIA_TYPES = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "csv": "text/csv", "json": "application/json", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4"}
#: Slug prefixes and the page type each names.
PAGE_TYPES = [("people/", "person"), ("person/", "person"), ("companies/", "company"), ("company/", "company"), ("deals/", "deal"), ("deal/", "deal"), ("yc/", "yc"), ("projects/", "project"), ("project/", "project"), ("concepts/", "concept"), ("concept/", "concept"), ("wiki/analysis/", "analysis"), ("wiki/guides/", "guide"), ("wiki/guide/", "guide"), ("wiki/hardware/", "hardware"), ("wiki/architecture/", "architecture"), ("meetings/", "meeting"), ("meeting/", "meeting"), ("writing/", "writing"), ("media/", "media"), ("source/", "source"), ("sources/", "source"), ("code/", "code"), ("civic/", "civic")]

col = F.col


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ladder(cases: Iterable[tuple[Column, object]], default: object) -> Column:
    """The value of the first condition that holds."""
    out: Column | None = None
    for condition, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, v) if out is None else out.when(condition, v)
    return F.lit(default) if out is None else out.otherwise(default)


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(_c(c), F.lit(" \t\n\x0b\x0c\r"))


def terms(c: Column | str) -> Column:
    """Lower-case words of letters, digits and underscores, repeats included."""
    return F.filter(F.split(F.lower(_c(c)), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def words(c: Column | str) -> Column:
    """Words of letters, digits and underscores in their own case, repeats included; runs of CJK give pairs of characters."""
    found = F.filter(F.split(_c(c), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    pairs = F.regexp_extract_all(_c(c), F.lit(f"(?=([{CJK}]{{2}}))"), F.lit(1))
    return F.when(has_cjk(c), F.concat(F.filter(found, lambda x: ~x.rlike(f"[{CJK}]")), pairs)).otherwise(found)


def tokens(c: Column | str, cap: int | None = None) -> Column:
    """Distinct words in order of first occurrence, the first cap of them if one is given; runs of CJK give characters and pairs (F1)."""
    text = F.lower(_c(c))
    pairs = F.regexp_extract_all(text, F.lit(f"(?=([{CJK}]{{2}}))"), F.lit(1))
    found = F.array_distinct(F.concat(terms(text), F.when(has_cjk(text), pairs).otherwise(F.array().cast("array<string>"))))
    return found if cap is None else F.slice(found, 1, cap)


def ascii_terms(c: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits, repeats included: the tokenizer of checked queries."""
    return F.filter(F.split(F.lower(_c(c)), "[^a-z0-9]+"), lambda x: x != "")


def name_tokens(c: Column | str) -> Column:
    """Stem, its parts and the extension of a file name (F2)."""
    name = F.lower(strip(_c(c)))
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    return F.array_distinct(F.filter(F.concat(F.array(stem), F.split(stem, r"[\s_.\-]+"), F.array(ext)), lambda x: x != ""))


def normalize_token(c: Column | str) -> Column:
    """Lower-case letters and digits of a token."""
    return F.regexp_replace(F.lower(strip(_c(c))), r"[^\p{L}\p{N}]", "")


def escape_term(c: Column | str) -> Column:
    """A term fit for a match expression: no quotes or operators; operator words get a prefix."""
    t = F.regexp_replace(F.lower(_c(c)), "[\"'*():^+\\-]", "")
    return F.when(t.isin("and", "or", "not", "near"), F.concat(F.lit("_"), t)).otherwise(t)


def match_terms(c: Column | str) -> Column:
    """Distinct escaped terms of a query; each is searched as a prefix and all are joined by OR."""
    return F.array_distinct(F.filter(F.transform(terms(c), escape_term), lambda x: x != ""))


def has_cjk(c: Column | str) -> Column:
    return _c(c).rlike(f"[{CJK}]")


def cjk_of(c: Column | str) -> Column:
    """The CJK characters alone."""
    return F.regexp_replace(_c(c), f"[^{CJK}]", "")


def pinyin_tokens(c: Column | str, readings: dict[str, str], most: int = 200) -> Column:
    """Of the CJK characters that have a reading, the readings joined and their first letters joined.

    readings maps characters to plain syllables; no such table is installed, so it is a parameter. More than
    most CJK characters have no such tokens.
    """
    table = F.create_map(*(F.lit(x) for pair in readings.items() for x in pair)) if readings else F.create_map().cast("map<string,string>")
    own = cjk_of(c)
    read = F.filter(F.transform(F.filter(F.split(own, ""), lambda x: x != ""), lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull())
    made = F.array(F.array_join(read, ""), F.array_join(F.transform(read, lambda x: F.left(x, F.lit(1))), ""))
    return F.when((F.length(own) <= most) & (F.size(read) > 0), made).otherwise(F.array().cast("array<string>"))


def simplified(c: Column | str) -> Column:
    """Traditional characters in their simplified form (F8)."""
    return F.translate(_c(c), TRADITIONAL, SIMPLIFIED)


def normalize_query(c: Column | str) -> Column:
    """Trimmed, lower-case, simplified, half-width marks, single spaces."""
    q = F.translate(simplified(F.lower(strip(_c(c)))), FULL_WIDTH, HALF_WIDTH)
    return strip(F.regexp_replace(q, r"\s+", " "))


def variants(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """The query, then a copy for each side of a pair that it holds with the other side in its place."""
    q = F.lower(_c(c))
    made = [F.when(q.contains(a), F.replace(q, F.lit(a), F.lit(b))) for k, v in pairs for a, b in ((k, v), (v, k))]
    return F.array_compact(F.array(_c(c), *made))


def synonym_variants(c: Column | str) -> Column:
    return variants(c, SYNONYMS)


def alias_variants(c: Column | str) -> Column:
    return variants(c, ALIASES)


def is_latin_query(c: Column | str) -> Column:
    """Letters and spaces only: a query that may be romanised."""
    return _c(c).rlike(r"^[A-Za-z\s]*$")


def token_count(c: Column | str) -> Column:
    """CJK characters and runs of ASCII letters and digits count one each."""
    return F.size(F.regexp_extract_all(_c(c), F.lit(f"[{CJK}]|[A-Za-z0-9]+"), F.lit(0)))


def byte_tokens(c: Column | str) -> Column:
    """A quarter of the UTF-8 bytes, rounded down."""
    return F.floor(F.octet_length(_c(c)) / 4).cast("int")


def word_count(c: Column | str) -> Column:
    """Words between white space."""
    t = strip(F.regexp_replace(_c(c), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def clean_for_search(c: Column | str) -> Column:
    """Zero-width marks and returns as line feeds; runs of line feeds and of spaces collapsed; trimmed."""
    t = F.regexp_replace(_c(c), "[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\r]", "\n")
    t = F.regexp_replace(t, r"[^\S\n]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, "\n +", "\n"), "\n+", "\n")
    return strip(F.regexp_replace(t, r"^\s+|\s+$", ""))


def text_quality(c: Column | str) -> Column:
    """1.2 times the share of letters and digits, within 0.1 and 1; 0 for empty text (F16)."""
    n = F.length(_c(c))
    useful = F.length(F.regexp_replace(_c(c), r"[^\p{L}\p{N}]", ""))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.1), useful / n * 1.2)))


@F.pandas_udf(T.StringType())
def slugify_path(s: pd.Series) -> pd.Series:
    """Path segments without marks, lower-case, hyphenated (F17). Unicode decomposition has no JVM expression."""
    import re
    import unicodedata

    def one(path):
        if path is None:
            return None
        plain = "".join(ch for ch in unicodedata.normalize("NFD", path) if unicodedata.category(ch) != "Mn")
        parts = [re.sub(r"-{2,}", "-", re.sub(r"[^a-z0-9._-]+", "-", p.lower())).strip("-") for p in re.sub(r"\.mdx?$", "", plain).split("/")]
        return "/".join(p for p in parts if p)

    return s.map(one)


def slugify_for_match(c: Column | str) -> Column:
    """Lower-case with hyphens for spaces and underscores."""
    return F.regexp_replace(F.lower(strip(_c(c))), "[ _]+", "-")


def content_hash(*columns: Column | str) -> Column:
    """SHA-256 of the columns as JSON under sorted names."""
    named = sorted((c if isinstance(c, str) else str(c), _c(c)) for c in columns)
    return F.sha2(F.to_json(F.struct(*(x.alias(n) for n, x in named)), {"ignoreNullFields": "false"}), 256)


def embedding_text(title: Column | str, path: Column | str, page: Column | str, content: Column | str, weight: float = 1.0) -> Column:
    """Title repeated ceil(3 weight) times, path and page, then the content."""
    times = -int(-3 * weight // 1)
    head = [F.when(_c(title) != "", _c(title))] * times
    return F.concat_ws("\n", *head, F.when(_c(path) != "", _c(path)), F.when(_c(page).isNotNull(), F.format_string("Page %d", _c(page))), _c(content))


def row_text(sheet: Column | str, headers: Column | str, row_json: Column | str) -> Column:
    """A table row as text: sheet, headers, row."""
    return F.concat_ws("\n", F.concat(F.lit("Sheet: "), _c(sheet)), F.concat(F.lit("Headers: "), F.array_join(_c(headers), ", ")), F.concat(F.lit("Row: "), _c(row_json)))


def name_for_match(c: Column | str) -> Column:
    """A file name without an extension of up to ten characters; hidden names stay whole."""
    return F.regexp_replace(F.lower(strip(_c(c))), r"^(.+)\.[^.]{0,10}$", "$1")


def is_exact_lookup(c: Column | str) -> Column:
    """File names, paths, codes with a digit and versions."""
    q = _c(c)
    return q.rlike(r"\.[A-Za-z]{2,5}$") | q.rlike(r"[/\\]") | (q.rlike(r"^[A-Za-z0-9_#-]*$") & q.rlike("[0-9]")) | q.rlike(r"^v[0-9.]{2,}$")


def recency(updated: Column | str, as_of: Column) -> Column:
    """1, 0.7, 0.4 or 0.1 for under 90, 180, 365 or more days; 0 for none."""
    days = F.greatest(F.lit(0), F.datediff(as_of, _c(updated)))
    return ladder([(_c(updated).isNull(), 0.0), (days < 90, 1.0), (days < 180, 0.7), (days < 365, 0.4)], 0.1)


def timeline_payload(c: Column | str) -> Column:
    """(date, summary) of a JSON payload, under any of the names in use."""
    at = lambda *names: F.coalesce(*(F.get_json_object(_c(c), f"$.{n}") for n in names), F.lit(""))
    return F.struct(at("event_date", "date").alias("date"), at("summary", "event", "title").alias("summary"))


MEDIA_REFS = "array<struct<asset_id:string,kind:string,path:string,caption:string>>"


def media_refs(c: Column | str) -> Column:
    """Media references in a node's metadata."""
    return F.from_json(F.get_json_object(_c(c), "$.media_refs"), MEDIA_REFS)


def merge_metadata(existing: Column | str, added: Column | str) -> Column:
    """One JSON object of two; the second wins."""
    m = lambda x: F.coalesce(F.from_json(_c(x), "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(m(existing), lambda k, v: ~F.map_contains_key(m(added), k))
    return F.to_json(F.map_concat(kept, m(added)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def blob_to_vector(s: pd.Series) -> pd.Series:
    """Little-endian float32 bytes; a partial last number is dropped (F28). Bytes to floats have no JVM expression."""
    import numpy as np

    return s.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


@F.pandas_udf(T.BinaryType())
def vector_to_blob(s: pd.Series) -> pd.Series:
    import numpy as np

    return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def truncate_at_word(c: Column | str, most: int) -> Column:
    """At most so many characters, back to the last white space among them."""
    cut = F.left(_c(c), F.lit(most))
    back = F.regexp_extract(cut, r"(?s)^(.*)\s", 1)
    return F.when(F.length(_c(c)) <= most, _c(c)).when(back != "", back).otherwise(cut)


def media_type(ext: Column | str) -> Column:
    """Media type of an extension."""
    e = F.lower(_c(ext))
    return ladder([(e == k, v) for k, v in MEDIA_TYPES.items()], "application/octet-stream")


def is_date(c: Column | str) -> Column:
    """A real ISO date."""
    return _c(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(_c(c), F.lit("yyyy-MM-dd")).isNotNull()


def redact_with(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    out = _c(c)
    for put, pattern in rules:
        out = F.regexp_replace(out, pattern, put)
    return out


def redact(c: Column | str) -> Column:
    """Addresses, numbers, keys and cards replaced, in that order."""
    return redact_with(c, REDACTIONS)


def redact_diagnostic(c: Column | str) -> Column:
    """Keys, tokens, paths and internal addresses replaced (F32)."""
    return redact_with(c, DIAGNOSTIC_REDACTIONS)


def backoff_ms(attempt: Column | str, base: int, most: int) -> Column:
    """base doubled for each attempt after the first, at most so much."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), _c(attempt) - 1), F.lit(float(most))).cast("long")


def html_meta(html: Column | str, name: str) -> Column:
    """A meta tag's content."""
    return F.regexp_extract(_c(html), rf"(?is)<meta[^>]+name=[\"']{name}[\"'][^>]+content=[\"']([^\"']*)[\"']", 1)


def strip_tags(html: Column | str) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(_c(html), "(?s)<[^>]+>", " "), r"\s+", " "))


def sanitize_prompt(c: Column | str, most: int = 500) -> Column:
    """Fences, tags, leading commands and control characters removed; single spaces."""
    q = F.left(_c(c), F.lit(most))
    q = F.regexp_replace(F.regexp_replace(q, r"```[\s\S]*?```", " "), r"</?[a-zA-Z][^>]*>", " ")
    q = F.regexp_replace(q, r"(?i)^(\s*(ignore|forget|disregard|override|system|assistant|human)[\s:]+)+", "")
    return strip(F.regexp_replace(F.regexp_replace(q, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"\s+", " "))


def sanitize_expansions(c: Column | str, most: int = 2) -> Column:
    """Cleaned alternatives, without repeats in either case, at most so many."""
    clean = F.filter(F.transform(_c(c), lambda x: sanitize_prompt(x)), lambda x: x != "")
    lows = F.transform(clean, F.lower)
    return F.slice(F.filter(clean, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1), 1, most)


def infer_page_type(slug: Column | str) -> Column:
    """Page type by slug prefix."""
    s = F.lower(_c(slug))
    return ladder([(s.startswith(p), t) for p, t in PAGE_TYPES], "note")


def trigrams(c: Column | str) -> Column:
    """Distinct three-character windows of the lower-case text between two spaces on either side."""
    p = F.concat(F.lit("  "), F.lower(_c(c)), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(either == 0, 0.0).otherwise(both / either)


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def unpadded_trigrams(c: Column | str) -> Column:
    """The windows without padding, as for comparing recognised text."""
    t = _c(c)
    return F.when(F.length(t) < 3, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 2)), lambda i: F.substring(t, i, F.lit(3)))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine, 0 for vectors of different or no length or without length, within -1 and 1."""
    a, b = _c(a), _c(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def cosine_truncating(a: Column | str, b: Column | str) -> Column:
    """Cosine over the length of the shorter vector, unclamped."""
    n = F.least(F.size(_c(a)), F.size(_c(b)))
    a, b = F.slice(_c(a), F.lit(1), n), F.slice(_c(b), F.lit(1), n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)

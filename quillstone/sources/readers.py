"""Readers: files and pages to DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text as X

#: Parsers by extension.
PARSERS = {"csv": "csv", "tsv": "csv", "xlsx": "xlsx", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "txt": "text", "docx": "docx", "pdf": "pdf"}
SKIPPED = r"(^|/)(\.[^/]+|node_modules|__pycache__)(/|$)"
HIDDEN_BLOCKS = r"(?is)<(script|style|nav|footer|noscript|template)\b[^>]*>.*?</\1\s*>"


def parser_of(ext: Column | str) -> Column:
    e = F.lower(F.col(ext) if isinstance(ext, str) else ext)
    return X.ladder([(e == k, v) for k, v in PARSERS.items()], "text")


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """path, length, modificationTime, content, ext of files under folder; hidden and tool folders are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("ext", ext).where(F.col("ext").isin(*extensions) & ~F.regexp_replace("path", "^.*?" + re.escape(folder.rstrip("/")), "").rlike(SKIPPED))


def manifest(files: DataFrame) -> DataFrame:
    """item_path, sha256 of scanned files: the input of snapshot_diff."""
    return files.select(F.col("path").alias("item_path"), F.sha2("content", 256).alias("sha256"))


def name_status(lines: DataFrame) -> DataFrame:
    """status, path, old_path of name-status lines of a version control diff."""
    p = F.split("value", "\t")
    kind = F.left(F.get(p, F.lit(0)), F.lit(1))
    moved = kind.isin("R", "C")
    return lines.select(kind.alias("status"), F.when(moved, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1))).alias("path"), F.when(moved, F.get(p, F.lit(1))).alias("old_path"))


def csv_rows(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A file's rows with its header as names; malformed rows are dropped."""
    return spark.read.options(header="true", mode="DROPMALFORMED", **options).csv(path)


def rows_as_text(rows: DataFrame, sheet: str = "sheet") -> DataFrame:
    """row_json and row_text of table rows."""
    names = rows.columns
    row = F.to_json(F.struct(*names))
    return rows.select(row.alias("row_json"), X.row_text(F.lit(sheet), F.array(*map(F.lit, names)), row).alias("row_text"))


def html_documents(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, description, headings, links, text of web pages."""
    body = F.regexp_replace(F.regexp_replace(html, HIDDEN_BLOCKS, " "), "(?s)<!--.*?-->", " ")
    title = X.strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    heads = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), X.strip_tags)
    links = F.regexp_extract_all(body, F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"']+)[\"']"), F.lit(1))
    lined = F.regexp_replace(F.regexp_replace(body, r"(?is)<title\b[^>]*>.*?</title\s*>", " "), r"(?i)</(p|div|li|tr|h[1-6]|section|article|table|ul|ol)\s*>|<br\s*/?>", "\n")
    plain = F.regexp_replace(lined, "(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return pages.select(key, title.alias("title"), X.html_meta(html, "description").alias("description"), heads.alias("headings"), links.alias("links"), X.clean_for_search(plain).alias("text"))


def markdown_pages(pages: DataFrame, key: str, content: str) -> DataFrame:
    """key, frontmatter (map), body, timeline of markdown with an optional header."""
    head = F.regexp_extract(content, r"(?s)^\s*---\r?\n(.*?)\r?\n---\s*(?:\r?\n|$)", 1)
    rest = F.regexp_replace(content, r"(?s)^\s*---\r?\n.*?\r?\n---\s*(?:\r?\n|$)", "")
    mark = r"(?s)^(.*?)(?:\r?\n|^)(?:<!--\s*timeline\s*-->|---\s*timeline\s*---|---\s*(?=\r?\n+##\s+(?:Timeline|History)))(.*)$"
    body = F.when(rest.rlike(mark), F.regexp_extract(rest, mark, 1)).otherwise(rest)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda line: line.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    fields = F.map_from_entries(F.transform(pairs, lambda line: F.struct(X.strip(F.regexp_extract(line, "^([^:]+):", 1)), F.regexp_replace(X.strip(F.regexp_extract(line, "^[^:]+:(.*)$", 1)), "^[\"']|[\"']$", ""))))
    return pages.select(key, F.when(F.size(pairs) > 0, fields).otherwise(F.create_map().cast("map<string,string>")).alias("frontmatter"), X.strip(body).alias("body"), X.strip(F.regexp_extract(rest, mark, 2)).alias("timeline"))


def parse_files(files: DataFrame) -> DataFrame:
    """path, parser, text of scanned files (path, ext, content), each by the parser of its extension.

    Web pages, markdown, tables and plain text are read by expressions; office files and PDFs by maps of their own.
    """
    f = files.withColumn("parser", parser_of("ext"))
    plain = f.where("parser in ('text', 'csv', 'markdown')").select("path", "parser", X.strip(F.decode("content", "UTF-8")).alias("text"))
    pages = html_documents(f.where("parser = 'html'").select("path", F.decode("content", "UTF-8").alias("html")), "path", "html").select("path", F.lit("html").alias("parser"), "text")
    docs = docx_texts(f.where("parser = 'docx'")).select("path", F.lit("docx").alias("parser"), "text")
    sheets = xlsx_rows(f.where("parser = 'xlsx'")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("sheet", "row", F.array_join("cells", "\t").alias("t")))).alias("r"))
    pdfs = pdf_texts(f.where("parser = 'pdf'")).select("path", F.lit("pdf").alias("parser"), "text")
    return plain.union(pages).union(docs).union(pdfs).union(sheets.select("path", F.lit("xlsx").alias("parser"), F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("text")))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def docx_texts(files: DataFrame) -> DataFrame:
    """path, text of word-processor files (S7): their zipped XML is read by a pandas map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for pdf in batches:
            texts = []
            for raw in pdf["content"]:
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
                    texts.append("\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    texts.append(None)
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


#: What shows text in a page's content: a string or an array of strings, or a move to another line.
SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:[^\]\\(]|\((?:\\.|[^\\()])*\))*\]\s*TJ|<[0-9A-Fa-f\s]*>\s*Tj|\bT(?:\*|[dDm]\b)|\bBT\b", re.DOTALL)
LITERAL = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|(-?[0-9.]+)", re.DOTALL)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw).decode() + "0" * (len(re.sub(rb"[^0-9A-Fa-f]", b"", raw)) % 2))
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else ESCAPES.get(m[1], b"" if m[1].strip() == b"" else m[1]), raw[1:-1], flags=re.DOTALL)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "replace")


def pdf_text(raw: bytes) -> list[tuple[str, int]] | None:
    """Text and number of images of each page in the order of the objects; None for what is no PDF.

    Streams are plain or deflated, fonts have a Latin encoding: what needs more comes out empty, and a page
    with little text is one that needs recognition.
    """
    if not raw.startswith(b"%PDF"):
        return None
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", raw, re.DOTALL)}

    def stream(number: int) -> bytes:
        m = re.search(rb"(.*?)stream\r?\n(.*?)\r?\n?endstream", objects.get(number, b""), re.DOTALL)
        if m is None:
            return b""
        try:
            return zlib.decompressobj().decompress(m[2]) if b"FlateDecode" in m[1] else m[2]
        except zlib.error:
            return b""

    pages = []
    for number, body in sorted(objects.items()):
        if not re.search(rb"/Type\s*/Page\b", body):
            continue
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        content = b"\n".join(stream(int(x)) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])) if m else b""
        out: list[str] = []
        for op in SHOWN.findall(content):
            if op[:1] in b"T*B" and not op.startswith((b"(", b"[", b"<")):
                out.append("\n")
                continue
            for lit in LITERAL.finditer(op):
                if lit[1] is None:
                    out.append(pdf_string(lit[0]))
                elif float(lit[1] or 0) < -200:
                    out.append(" ")
        text = "\n".join(line for line in (x.strip() for x in "".join(out).split("\n")) if line)
        pages.append((text, len(re.findall(rb"/\w+\s+Do\b", content))))
    return pages


def pdf_pages(files: DataFrame) -> DataFrame:
    """path, page, text, images of PDF files, a row per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, k, text, images) for path, raw in zip(pdf["path"], pdf["content"]) for k, (text, images) in enumerate(pdf_text(raw) or [], 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "images"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, images int")


def pdf_texts(files: DataFrame) -> DataFrame:
    """path, text of PDF files: pages in order, each behind its mark."""
    marked = F.concat(F.lit("[PAGE:"), F.col("page").cast("string"), F.lit("]\n"), F.col("text"))
    pages = pdf_pages(files).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", marked.alias("t")))).alias("p"))
    return pages.select("path", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def transcribed(files: DataFrame, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """path, text of audio files: the provider gets path and content and returns path, text; files it leaves out have none."""
    said = provider(files.select("path", "content")).select("path", F.col("text").alias("__text"))
    return files.select("path").join(said, "path", "left").select("path", X.strip("__text").alias("text"))


def xlsx_rows(files: DataFrame) -> DataFrame:
    """path, sheet, row, cells of workbooks (S3), from their zipped XML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for pdf in batches:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(raw))
                except zipfile.BadZipFile:
                    continue
                shared = []
                if "xl/sharedStrings.xml" in z.namelist():
                    shared = ["".join(t.text or "" for t in s.iter(f"{n}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{n}si")]
                for name in sorted(x for x in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)):
                    for k, row in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{n}row")):
                        cells = []
                        for c in row.iter(f"{n}c"):
                            v = c.find(f"{n}v")
                            inline = "".join(t.text or "" for t in c.iter(f"{n}t"))
                            text = v.text if v is not None else inline
                            cells.append(shared[int(text)] if c.get("t") == "s" and text else text or "")
                        out.append((path, name[14:-4], k, cells))
            yield pd.DataFrame(out, columns=["path", "sheet", "row", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>")


def qrels(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """query_id, query, doc, relevant of judged queries: a JSON list, or one object per line if lines."""
    raw = spark.read.option("multiLine", str(not lines).lower()).schema("query string, relevant array<string>, irrelevant array<string>").json(path)
    raw = raw.withColumn("query_id", F.xxhash64("query"))
    good = raw.select("query_id", "query", F.explode_outer("relevant").alias("doc"), F.lit(True).alias("relevant"))
    return good.union(raw.select("query_id", "query", F.explode("irrelevant").alias("doc"), F.lit(False)))


def pair_file(spark: SparkSession, path: str) -> DataFrame:
    """a, b of lines ``a,b``; blank lines and # comments are skipped."""
    line = X.strip("value")
    p = F.split(line, ",", 2)
    return spark.read.text(path).where((line != "") & ~line.startswith("#") & (F.size(p) == 2)).select(X.strip(p[0]).alias("a"), X.strip(p[1]).alias("b"))


def by_key(rows: DataFrame, key: str, value: object) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


PAGE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("slug", T.StringType()), ("page_type", T.StringType()), ("title", T.StringType()), ("body", T.StringType()), ("timeline", T.StringType()), ("frontmatter", T.MapType(T.StringType(), T.StringType())), ("content_hash", T.StringType()), ("updated_at", T.TimestampType()), ("deleted_at", T.TimestampType()))])

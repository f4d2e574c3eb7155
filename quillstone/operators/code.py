"""The structure of source files: declarations with the whole of their bodies, what they stand in, and the calls inside.

One pass over a file's tokens with a stack of open scopes. A token is a comment, a string (over as many
lines as it has), a bracket, the end of a line or a name before a bracket, so that words in comments and
strings are neither declarations nor calls. Bodies end with their brace, or in Python where a line of
code goes back to the declaration's column. Files lie in tasks one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import dealt

#: Declarations by family of languages, as (kind, pattern of a line, whose group is the name).
SYMBOLS = {
    "rust": [("function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)"), ("struct", r"^\s*(?:pub\s+)?struct\s+([A-Za-z_]\w*)"), ("enum", r"^\s*(?:pub\s+)?enum\s+([A-Za-z_]\w*)"), ("trait", r"^\s*(?:pub\s+)?trait\s+([A-Za-z_]\w*)")],
    "python": [("class", r"^\s*class\s+([A-Za-z_]\w*)"), ("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)")],
    "javascript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)"), ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"), ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)")],
    "go": [("function", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"), ("struct", r"^\s*type\s+([A-Za-z_]\w*)\s+struct"), ("interface", r"^\s*type\s+([A-Za-z_]\w*)\s+interface")],
    "java": [("class", r"^\s*(?:public\s+|private\s+|protected\s+)?class\s+([A-Za-z_]\w*)")],
}
#: Kinds of declarations that hold others, and blocks that are no declarations but name what they hold.
CONTAINERS = ("class", "struct", "enum", "trait", "interface", "impl")
SIGNATURES = ("struct", "enum", "trait", "interface")
BLOCKS = {"rust": r"^\s*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>, &']+?\s+for\s+)?([A-Za-z_]\w*)"}
#: Comments and strings of each family; what begins one and never ends goes to the end of the line or file.
COMMENT, QUOTED = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", r'"(?:\\[\s\S]|[^"\\\n])*"?'
SKIPPED = {
    "rust": rf"{COMMENT}|\bb?r(?P<hashes>\#*)\"[\s\S]*?(?:\"(?P=hashes)|\Z)|\"(?:\\[\s\S]|[^\"\\])*\"?|'(?:\\[^\n']+|[^'\\\n])'",
    "python": r"\#[^\n]*|\"\"\"(?:\\[\s\S]|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\[\s\S]|[^\\])*?(?:'''|\Z)|\"(?:\\[\s\S]|[^\"\\\n])*\"?|'(?:\\[\s\S]|[^'\\\n])*'?",
    "javascript": rf"{COMMENT}|{QUOTED}|'(?:\\[\s\S]|[^'\\\n])*'?|`(?:\\[\s\S]|[^`\\])*`?",
    "go": rf"{COMMENT}|{QUOTED}|`[^`]*`?|'(?:\\[\s\S]|[^'\\\n])*'?",
    "java": rf"{COMMENT}|\"\"\"(?:\\[\s\S]|[^\\])*?(?:\"\"\"|\Z)|{QUOTED}|'(?:\\[\s\S]|[^'\\\n])*'?",
}
TOKENS = {lang: re.compile(rf"(?P<skip>{p})|(?P<call>[A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)*)(?=\s*\()|(?P<mark>[\[\](){{}};\n])") for lang, p in SKIPPED.items()}
DECLARED = {lang: [(kind, re.compile(p)) for kind, p in [*rules, *([("impl", BLOCKS[lang])] if lang in BLOCKS else [])]] for lang, rules in SYMBOLS.items()}
#: Words before a bracket that call nothing.
NO_CALLS = frozenset("if for while switch match return catch and or not in fn func function def class with elif assert lambda await yield loop print_".split())


class Scope:
    __slots__ = ("kind", "name", "line", "indent", "end", "parent", "depth", "open")

    def __init__(self, kind: str, name: str, line: int, indent: int, parent: Scope | None, depth: int):
        self.kind, self.name, self.line, self.indent, self.parent, self.depth = kind, name, line, indent, parent, depth
        self.end, self.open = line, False


def parse(text: str, language: str) -> tuple[list[Scope], list[tuple[int, str, Scope | None]]]:
    """Declarations in their order, and calls: line, name, the declaration they stand in."""
    if language not in TOKENS:
        return [], []
    by_indent = language == "python"
    found: list[Scope] = []
    calls: list[tuple[int, str, Scope | None]] = []
    scopes: list[Scope] = []
    braces: list[Scope | None] = []
    line, last, inner, own = 1, 1, 0, None

    def begin(at: int) -> Scope | None:
        """Open the declaration that the line at a place makes, if any; in Python close what the line is not in."""
        end = text.find("\n", at)
        row = text[at : end if end >= 0 else len(text)]
        if by_indent:
            bare = row.lstrip()
            if not bare or bare.startswith("#"):
                return None
            while scopes and scopes[-1].indent >= len(row) - len(bare):
                scopes.pop().end = last
        for kind, pattern in DECLARED[language]:
            if m := pattern.match(row):
                while scopes and not by_indent and not scopes[-1].open:
                    scopes.pop()
                scopes.append(Scope(kind, m[1], line, len(row) - len(row.lstrip()), scopes[-1] if scopes else None, inner))
                found.append(scopes[-1])
                return scopes[-1]
        return None

    own = begin(0)
    for m in TOKENS[language].finditer(text):
        if m["skip"] is not None:
            line += m["skip"].count("\n")
            last = line if not m["skip"].startswith("#") else last
        elif m["call"] is not None:
            last = line
            name = re.split(r"\.|::", m["call"])[-1]
            # What stands in an interface or a record is a signature.
            if name not in NO_CALLS and not (scopes and scopes[-1].open and scopes[-1].kind in SIGNATURES) and not (own is not None and own.line == line and name == own.name):
                calls.append((line, name, scopes[-1] if scopes else None))
        elif (mark := m["mark"]) == "\n":
            if text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
                last = line if not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].lstrip().startswith("#") else last
            line += 1
            if not by_indent or inner == 0:
                own = begin(m.end()) or (own if own is not None and own.line == line else None)
        elif mark in "([":
            inner += 1
        elif mark in ")]":
            inner = max(0, inner - 1)
        elif by_indent:
            inner = inner + 1 if mark == "{" else max(0, inner - 1) if mark == "}" else inner
        elif mark == "{":
            body = scopes[-1] if scopes and not scopes[-1].open and scopes[-1].depth == inner else None
            if body is not None:
                body.open = True
            braces.append(body)
        elif mark == "}":
            body = braces.pop() if braces else None
            if body is not None:
                while scopes and scopes.pop() is not body:
                    pass
                body.end = line
        elif mark == ";" and scopes and not scopes[-1].open and scopes[-1].depth == inner:
            scopes.pop().end = line
    tail = line - 1 if text.endswith("\n") else line
    for scope in scopes:
        scope.end = max(scope.end, last if by_indent and text.rstrip() else tail)
    return found, calls


def structure(files: DataFrame, key: str, code: str, language: str) -> DataFrame:
    """key, what (declaration or call), line, end_line, kind, name, parent, inside, of every file, in one pass.

    parent is the container that a declaration stands in, and inside the innermost declaration around a call.
    Files in other languages, and without text, have no rows.
    """
    kind = files.schema[key].dataType.simpleString()
    names = ["what", "line", "end_line", "kind", "name", "parent", "inside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, (text, lang) in enumerate(zip(batch.column(1), batch.column(2))):
                found, calls = parse(text.as_py() or "", lang.as_py())
                own = [("declaration", s.line, s.end, s.kind, s.name, s.parent.name if s.parent is not None and s.parent.kind in CONTAINERS else None, None) for s in found if s.kind != "impl"]
                own += [("call", at, at, None, name, None, scope.name if scope is not None and scope.kind != "impl" else None) for at, name, scope in calls]
                ids += [i] * len(own)
                rows += own
            columns = zip(*rows) if rows else [[] for _ in names]
            types = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=[key, *names])

    return dealt(files.select(key, code, language), key).mapInArrow(run, f"{key} {kind}, what string, line int, end_line int, kind string, name string, parent string, inside string")


def symbols(files: DataFrame, key: str, code: str, language: str) -> DataFrame:
    """key, line, kind, name, end_line, parent, qualified of declarations (E24, E25): end_line is the last of the body."""
    return declared(structure(files, key, code, language), key)


def call_edges(files: DataFrame, key: str, code: str, language: str) -> DataFrame:
    """key, from_symbol, to_symbol, confidence: calls between symbols of one file, each from the innermost around it."""
    return linked(structure(files, key, code, language), key)


def declared(every: DataFrame, key: str) -> DataFrame:
    """symbols of a structure that is at hand."""
    found = every.where("what = 'declaration'")
    return found.select(key, "line", "kind", "name", "end_line", "parent", F.concat_ws(".", "parent", "name").alias("qualified"))


def linked(every: DataFrame, key: str) -> DataFrame:
    """call_edges of a structure that is at hand."""
    known = every.where("what = 'declaration'").select(key, F.col("name").alias("to_symbol")).distinct()
    calls = every.where("what = 'call' and inside is not null and inside <> name").select(key, F.col("inside").alias("from_symbol"), F.col("name").alias("to_symbol")).distinct()
    return calls.join(known, [key, "to_symbol"]).select(key, "from_symbol", "to_symbol").withColumn("confidence", F.lit(0.85))

"""Secret scans: fixed shapes, and a battery of randomness tests for the rest.

Base kinds (leftmost, non-overlapping per kind): assign, access, hex. Every other run of 20 or more
encoding characters is a candidate, unless it is a number: plain text has digits as random as any. Its encoding is the smallest alphabet that has its characters
(hex, letters of one case, base32, base36, letters, base62, base64), and two nulls are tested:

* Plain text: a chain over character classes and, within words, over pairs of letters. What is tested
  is the likelihood of the candidate as random text of its encoding over that as plain text: the
  frequencies of symbols, the runs of classes and the dependence of neighbours at once. Under the chain
  the ratio is over 1 / p with a chance of p at most, so p_plain is its inverse, times the encodings.
* Random text: chi-squared uniformity of the alphabet, over bins wide enough for the length,
  Wald-Wolfowitz runs about the alphabet's middle, and serial correlation of neighbouring symbols, joined
  to p_random by Fisher's method. It tells repeats and sequences, which are neither plain nor secret.

Within a document the candidates' p_plain, weighted by length (longer strings carry more evidence), go
through the Benjamini-Hochberg step-up at FDR; what is discovered there and keeps p_random over ALPHA is
a secret. p_random has no part in the step-up: that it is large is no evidence against plain text.

Defined cases: null is the empty text; repeated rows each come back; an empty table gives no rows;
positions are code points, ends exclusive; candidates that touch a base span are left out.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, narrow

FDR, ALPHA, LEAST = 0.01, 0.001, 20
#: The base kinds, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: By size: name, shape, alphabet. Those of one case are read in lower case.
ENCODINGS = (
    ("hex", re.compile(r"[0-9A-F]+|[0-9a-f]+"), "0123456789abcdef"),
    ("letters26", re.compile(r"[A-Z]+|[a-z]+"), LOWER),
    ("base32", re.compile(r"[A-Z2-7]+|[a-z2-7]+"), LOWER + "234567"),
    ("base36", re.compile(r"[A-Z0-9]+|[a-z0-9]+"), LOWER + "0123456789"),
    ("letters52", re.compile(r"[A-Za-z]+"), UPPER + LOWER),
    ("base62", re.compile(r"[A-Za-z0-9]+"), UPPER + LOWER + "0123456789"),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+"), UPPER + LOWER + "0123456789+/"),
)
MIXED = ("letters52", "base62", "base64")
#: Strings of the URL-safe alphabet share the last two places.
VALUES = {name: {c: i for i, c in enumerate(a)} for name, _, a in ENCODINGS}
VALUES["base64"] |= {"-": 62, "_": 63}
#: Fixed values of plain text, from the identifiers, paths and words of Python's standard library: half bits of a word's first
#: letter, of a letter after each letter (rows a to z; 0-9, a-z stand for 0-35), and chances of a class at first and after each class.
FIRST = "997999ab9eda99a8e976bcbcee"
PAIRS = (
    "c988edaeafb688faf676bbdcce 5b8c8dee89e6dd8ae9ad7fef8d 7ecc7de7af78ce5deac6adefdf 8cc93cde5ee9dd7dfa9b8eeecf 9d88cbceefeaa7dac648ecc9cf "
    "7dba86ce5ef8ed6ef8aa9fefcf 9ecd3da88fe9c8bef87b9defed 4edd4eee7eeccd5ef8c9aeefdf bb8abbafeee8947afa77fbfcfb 8dcd4edcad9dee79edac5fdede "
    "9dbb3dbe7ee8eadceb7cce8fce 7dda4dee5fe7ee6cfea9aeefae 5aec4eee8febad76feacafffcf 7e877a6e9eccdb7cee86abefdf cb88eccfcfc985a9f6998badee "
    "6ecc6eec9fe7ee79e6b7bdef7f cdeddfeddfcadceddabe1eddee 7ebb4caf7fccab7df988acdfaf bebe6eda8fdcdeaaee839eefbf 8ecc3df86fecce9cf89abedeae "
    "b9ac7bbfaff785c8f786eefeff 4eee2dee7efebdcefedeeedfee 6edb8ee94efbc87ef69eedccff ad5c7bed7eecadd6edc5eee99e ccacadeeaeea97c4ec75ebadbc 8edc2ddd6eecbe9deddeeecbca"
)
CLASS_FIRST = (0.035, 0.649, 0.219, 0.097)
CLASS_NEXT = ((0.713, 0.186, 0.041, 0.06), (0.011, 0.87, 0.025, 0.094), (0.019, 0.316, 0.594, 0.071), (0.046, 0.82, 0.111, 0.023))
MARKS = {"_": 0.83, "-": 0.09, "/": 0.06, "+": 0.02}


def chain() -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """Natural logarithms of a character's chance at first, and after each character; each sums to 1."""
    share = lambda row: [x / sum(w) for w in [[2.0 ** (-int(c, 36) / 2) for c in row]] for x in w]
    first, after = dict(zip(LOWER, share(FIRST))), {a: dict(zip(LOWER, share(row))) for a, row in zip(LOWER, PAIRS.split())}

    def emitted(c: str, prev: str | None) -> float:
        if c.isdigit():
            return 0.1
        if c in MARKS:
            return MARKS[c]
        word = prev is None or not prev.isalpha() or prev.islower() and c.isupper()
        return (first if word else after[prev.lower()])[c.lower()]

    every = [*VALUES["base64"]]
    scale = [sum(row) for row in (CLASS_FIRST, *CLASS_NEXT)]
    starts = {c: math.log(CLASS_FIRST[kind(c)] / scale[0] * emitted(c, None)) for c in every}
    return starts, {(a, b): math.log(CLASS_NEXT[kind(a)][kind(b)] / scale[1 + kind(a)] * emitted(b, a)) for a in every for b in every}


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


STARTS, STEPS = chain()


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) for chi-squared: exact for even df, Wilson-Hilferty for odd."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term = total = math.exp(-x / 2) if x < 1400 else 0.0
        for k in range(1, df // 2):
            term *= x / 2 / k
            total += term
        return min(1.0, total)
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(s: str) -> tuple[str, float, float]:
    """Encoding, p_random and p_plain of a candidate."""
    body = s.rstrip("=")
    name, alphabet = next((n, a) for n, shape, a in ENCODINGS if shape.fullmatch(body))
    own = VALUES[name]
    v = [own[c if name in MIXED else c.lower()] for c in body]
    n, size = len(v), len(alphabet)
    # Uniformity: at least 5 expected in each bin.
    bins = max(2, min(size, n // 5, 16))
    counts = [0] * bins
    for x in v:
        counts[x * bins // size] += 1
    expected = [n * sum(1 for x in range(size) if x * bins // size == b) / size for b in range(bins)]
    p_uniform = chi2_tail(sum((c - e) ** 2 / e for c, e in zip(counts, expected)), bins - 1)
    # Runs about the middle.
    high = [2 * x >= size for x in v]
    up = sum(high)
    down = n - up
    if up and down:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * up * down / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = normal_two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    # Serial correlation.
    m = sum(v) / n
    spread = sum((x - m) ** 2 for x in v)
    if spread:
        r = sum((a - m) * (b - m) for a, b in zip(v, v[1:])) / spread
        p_serial = normal_two_sided((r + 1 / n) * math.sqrt(n))
    else:
        p_serial = 0.0
    p_random = chi2_tail(-2 * sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial)), 6)
    # Plain text against random text of the encoding.
    plain = STARTS[body[0]] + sum(map(STEPS.__getitem__, zip(body, body[1:])))
    ratio = plain + n * math.log(size) + math.log(len(ENCODINGS))
    return name, p_random, math.exp(min(0.0, ratio))


def discoveries(tests: list[tuple[int, float]]) -> list[bool]:
    """Benjamini-Hochberg over (length, p) with weights in proportion to length, of mean 1."""
    if not tests:
        return []
    mean = sum(n for n, _ in tests) / len(tests)
    weighted = sorted((p * mean / n, i) for i, (n, p) in enumerate(tests))
    most = max((k for k, (q, _) in enumerate(weighted, 1) if q <= FDR * k / len(tests)), default=0)
    chosen = {i for _, i in weighted[:most]}
    return [i in chosen for i in range(len(tests))]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def random_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    found, merged = [], []
    for _, a, b in taken:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        s = m[0]
        k = bisect.bisect_left(starts, b) - 1
        if k >= 0 and merged[k][1] > a or s.rstrip("=").isdigit():
            continue
        name, p_random, p_plain = battery(s)
        found.append((name, a, b, p_random, p_plain))
    chosen = discoveries([(b - a, p) for _, a, b, _, p in found])
    return [(name, a, b) for (name, a, b, p, _), yes in zip(found, chosen) if yes and p > ALPHA]


def scan(text: bytes | None) -> tuple:
    t = (text or b"").decode("utf-8", "replace")
    base = base_spans(t)
    told = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    every = sorted(base + random_spans(t, base), key=lambda s: (s[1], KINDS.index(s[0]) if s[0] in KINDS else 9))
    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
    return (*counts, len(every) - len(base), hashlib.sha256(told(base).encode()).hexdigest(), told(every))


FIELDS = [*(pa.field(f"n_{k}", pa.int64()) for k in (*KINDS, "random")), pa.field("base_sha256", pa.string()), pa.field("spans", pa.string())]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    return map_texts(narrow(docs, id_col, text_col), lambda: scan, FIELDS, "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")

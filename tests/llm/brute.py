"""Plain versions of the operators, against which the queries are held."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


def sha(s: str | bytes) -> str:
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def a_to_z(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def rules(text: str | None) -> tuple:
    t = text or ""
    w = SPACED.findall(t)
    windows = list(zip(w, w[1:], w[2:]))
    count, covered = Counter(windows), [False] * len(w)
    for i, k in enumerate(windows):
        if count[k] > 1:
            covered[i : i + 3] = [True] * 3
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    failed = len(w) < 50 or 100 * sum(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(covered), failed


def secrets(text: str | None) -> tuple:
    t, out = text or "", []
    for k, (kind, p, ok) in enumerate((
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.compile(p, re.A).finditer(t) if ok(m)]
    count = Counter(k for _, k, _ in out)
    return count[0], count[1], count[2], sha(",".join(x for _, _, x in sorted(out)))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text: str | None) -> tuple:
    t, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for k, (kind, p, ok) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )):
        out += [(k, m.start(), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, t) if ok(m)]
    count = Counter(k for k, _, _ in out)
    return count[0], count[1], count[2], count[3], sha(",".join(x for _, _, x in sorted(out)))


def fingerprint(text: str | None) -> int:
    w = SPACED.findall(a_to_z(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    bits = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def simhash_groups(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    fp = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i in fp}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fp)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fp[a] ^ fp[b]).bit_count() <= 3 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def repeats(texts: list[str | None], long: int = 400) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + long] for b in raw for i in range(len(b) - long + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - long + 1):
            if count[b[i : i + long]] > 1:
                gone[i : i + long] = b"\1" * long
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def contamination(texts: list[str | None], items: list[tuple[object, str | None]]) -> list[tuple]:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    of = defaultdict(set)
    for i, t in items:
        w = word.findall(a_to_z(t or ""))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            of[tuple(w[k : k + n])].add(i)
    sizes, out = {len(k) for k in of}, []
    for t in texts:
        w = word.findall(a_to_z(t or ""))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := of.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [True] * n
                    found |= x
        ids = sorted(str(i) for i in found if i is not None)
        out.append((len(w), sum(hit), len(ids), sha(",".join(ids)), any(hit)))
    return out

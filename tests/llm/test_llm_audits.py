"""Filter interaction, source divergence and rank-based BPE against their plain versions."""

import base64
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import brute as B
import numpy as np
import pytest

from quillstone.llm import byte_bpe, filter_audit, source_divergence
from quillstone.llm import queries as Q
from quillstone.llm.common import table

FULL = "doc_id long, text string, lang string, source string"


def every(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.fixture(scope="module")
def mixed(spark):
    """Ties, copies, nulls in every column, repeated rows, clashing names."""
    r = random.Random(11)
    words = [f"w{k}" for k in range(90)] + ["Été", "ÀB", "Zed", "naïve", "日本語", "a_b", "x1y", "#tag", "B&B", "ß"]
    texts = [" ".join(r.choices(words, k=r.choice([3, 40, 60, 200]))) for _ in range(60)] + [None, "", " \n", "A" * 40, "word " * 80]
    rows = [(i if i % 13 else None, r.choice(texts), r.choice(["en", "fr", None, ""]), r.choice(["s1", "s2", "s3", None, "ü", "z"]), 1, "x", 2) for i in range(400)]
    rows += [rows[5]] * 7 + [(2000 + i, texts[3], "en", "s1", 1, "x", 2) for i in range(120)] + [(5000, None, "xx", "only", 1, "x", 2), (5001, "lonely", "yy", "a", 1, "x", 2), (5002, None, "yy", "b", 1, "x", 2)]
    return spark.createDataFrame(rows, FULL + ", step int, part string, value int")


def plain_audit(docs, labels):
    good, toxic, first = set(), set(), {}
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    flags = []
    for i, text, part in docs:
        t = text or ""
        w = B.SPACED.findall(t)
        own = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]]
        flags.append((part or "", own, i in good, i in toxic))
    out, total = defaultdict(lambda: [0] * 6), Counter()
    orders = list(permutations(range(5)))
    for part in {p for p, *_ in flags}:
        for o in orders:
            for step in range(1, 6):
                out[part, o, step]
    for part, own, is_good, is_toxic in flags:
        for o in orders:
            gone = next((k for k, i in enumerate(o, 1) if own[i]), 6)
            for step, i in enumerate(o, 1):
                x = out[part, o, step]
                removed = gone == step
                x[0] += gone > step
                x[1] += removed
                x[2] += own[i] and gone < step
                x[3] += own[i] and sum(own) == 1
                x[4] += removed and is_good
                x[5] += removed and is_toxic
                total[part, i] += removed
    name = lambda o: "".join("ABCDE"[i] for i in o)
    return Counter((p, name(o), step, *x, total[p, o[step - 1]]) for (p, o, step), x in out.items())


@pytest.mark.parametrize("which", ["mixed", "hard", "empty"])
def test_filter_audit(request, spark, which):
    df = request.getfixturevalue(which)
    r = random.Random(3)
    labels = [(r.choice([None, *range(420)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(300)]
    out = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = Counter((x.part, x.filter_order, x.step, x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in out.collect())
    assert got == plain_audit([(x.doc_id, x.text, x.source) for x in df.collect()], labels)


def test_inversions_of_random_joint_counts(spark):
    """Counts of rows by exact set, summed over supersets, come back; survivors and shares add up for any number of filters."""
    r = random.Random(1)
    for k in (1, 3, 6):
        letters = "ABCDEF"[:k]
        rows = [(0, *(r.random() < 0.4 for _ in letters)) for _ in range(200)]
        df = spark.createDataFrame([(p, *map(int, f)) for p, *f in rows], "p int, " + ", ".join(f"{x} long" for x in letters))
        joint = filter_audit.joint_failures(df, "p", letters, {"n": "1L"})
        count = Counter(sum(1 << i for i, x in enumerate(f) if x) for _, *f in rows)
        assert filter_audit.exactly(joint, "n", k).first().n == [count[s] for s in range(1 << k)]
        alive = filter_audit.over_subsets(joint.select("p", filter_audit.signed("n").alias("n")), ["n"], k).first().n
        assert alive == [sum(n for s, n in count.items() if not s & mask) for mask in range(1 << k)]
        orders = list(permutations(range(k)))
        want = [sum(n for o in orders for s, n in count.items() if next((j for j in o if s >> j & 1), None) == i) for i in range(k)]
        assert joint.select(filter_audit.shapley("n", k).alias("s")).first().s == want


def plain_divergence(docs):
    """lang, source, part, item, value, rank, by the definition, over the whole grid of terms and sources."""
    found, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", B.a_to_z(text or ""))
        found[lang or "", source or ""].update(words)
        in_docs[lang or ""].update(set(words))
    out = Counter()
    for lang in {lang for lang, _ in found}:
        kept = [t for t, n in in_docs[lang].items() if n >= 10]
        own = {s: Counter({t: c[t] for t in kept}) for (x, s), c in found.items() if x == lang}
        whole = sum(own.values(), Counter())

        def share(c, kept=kept):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            foremost = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", foremost, 10)):
                for rank, (value, item) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out[lang, s, part, item, value, rank] += 1
    return out


@pytest.mark.parametrize("which", ["docs", "mixed", "hard", "empty"])
@pytest.mark.parametrize("held", [source_divergence.HELD, 3000])
def test_source_divergence(request, spark, sf_dir, which, held):
    df = table(spark, sf_dir, "documents") if which == "docs" else request.getfixturevalue(which)
    got = Counter((x.lang, x.source, x.part, x.item, x.value, x["rank"]) for x in source_divergence.audit(df, held=held).collect())
    assert got == plain_divergence([(x.text, x.lang, x.source) for x in df.collect()])


def test_terms_are_words_of_letters_and_characters_beyond_ascii():
    for text in ["", "Ab-cD é_É 1a2 [x] 日本 `q` {z}", "ÀÉ~ß\x7f\x00k@K"]:
        assert [t.decode() for t in source_divergence.terms(text.encode())] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", B.a_to_z(text))


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = Q.ranks()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("which", ["docs", "hard", "empty"])
def test_byte_bpe(request, spark, sf_dir, library, which):
    df = table(spark, sf_dir, "documents") if which == "docs" else request.getfixturevalue(which)
    want = Counter()
    for x in df.collect():
        ids = library.encode_ordinary(x.text or "")
        want[x.doc_id, len(ids), B.sha(np.array(ids, "<u4").tobytes()), B.sha(library.decode_bytes(ids))] += 1
    enc = byte_bpe.encode(df, *Q.ranks())
    assert Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in enc.collect()) == want
    back = byte_bpe.decode(enc, *Q.ranks())
    assert Counter((x.doc_id, bytes(x.text)) for x in back.collect()) == Counter((x.doc_id, (x.text or "").encode()) for x in df.collect())


def test_byte_bpe_on_mixed_characters(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 2000)
    codec = byte_bpe.Codec(byte_bpe.load(Q.ranks()[0]), Q.ranks()[1])
    r = random.Random(8)
    parts = ["the", " ", "  ", "\n", "'s", "'LL", "1", "23", "é", "日本", "\U0001f600", "\x1c", "\x85", "\xa0", "-", "...", "ing", "A", "zz", "<|endoftext|>", "\x00", "ü̈"]
    for _ in range(400):
        text = "".join(r.choices(parts, k=r.randint(0, 60)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and codec.decode(ids) == text.encode()
    for text in ("a" * 30_000, "ab" * 9000, "".join(r.choice("abcdeé") for _ in range(20_000)), "é" * 5001):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_tree_holds_the_leftmost_least():
    r = random.Random(2)
    for n in (1, 2, 3, 17, 64, 65, 5000):
        leaves = [r.choice([byte_bpe.NONE, r.randrange(50) << byte_bpe.BITS | i]) for i in range(n)]
        nodes = byte_bpe.tree_over(list(leaves))
        half = len(nodes) // 2
        assert nodes[1] == min(leaves) and list(nodes[half : half + n]) == leaves and all(nodes[i] == min(nodes[2 * i], nodes[2 * i + 1]) for i in range(1, half))


def test_rank_file_without_some_byte_is_refused(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(255)))
    with pytest.raises(ValueError, match="255"):
        byte_bpe.load(str(path))

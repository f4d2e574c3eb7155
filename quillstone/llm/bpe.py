"""Byte-level BPE encoding and decoding over a contiguous rank array.

A short word is held as its parts' boundaries and the rank of each adjacent pair. The smallest rank
is looked for, its inner boundary deleted and the two neighbouring ranks refreshed, until no pair has
a rank. Long words (over SHORT bytes), where that scan would be quadratic, take the same merges in
the same order from a heap. Words already met come from a bounded cache.

The vocabulary file's path is a parameter; the driver reads it once and broadcasts the merges, whose
number is checked. Special tokens in a text become their ids, as the tokenizers library does.

Defined cases: null is encoded as the empty text (no tokens); repeated rows each come back; an empty
table gives no rows; bytes that are no UTF-8 become U+FFFD before encoding.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts, narrow

#: Fixed value: the public pre-tokenization pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT, MAX_MERGES = 128, 2_000_000
#: Bytes that a task's cache of words may hold, and what an entry costs besides its word and ids.
CACHE, ENTRY = 24 << 20, 160
NONE = 1 << 60


def alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files, as character -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = set(plain)
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def load(path: str) -> dict:
    """Vocabulary and merges of a byte-level tokenizer file, ready to be broadcast."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, back = file["model"], alphabet()
    if len(model["merges"]) > MAX_MERGES:
        raise ValueError(f"{path} has over {MAX_MERGES} merges; it is not broadcast")
    raw = lambda token: bytes(back[c] for c in token)
    vocab = model["vocab"]
    tokens: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in file["added_tokens"])], default=-1) + 1)
    for token, i in vocab.items():
        tokens[i] = raw(token)
    specials = {t["content"]: t["id"] for t in file["added_tokens"]}
    for content, i in specials.items():
        tokens[i] = content.encode()
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        pairs[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
    return {"tokens": tokens, "pairs": pairs, "specials": specials, "bytes": [vocab[c] for c, _ in sorted(back.items(), key=lambda x: x[1])]}


class Codec:
    """Encoder and decoder over what load() returns."""

    def __init__(self, vocab: dict):
        self.pairs, self.bytes, self.tokens, self.specials = vocab["pairs"], vocab["bytes"], vocab["tokens"], vocab["specials"]
        self.split = regex.compile(PATTERN)
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def merge_short(self, word: bytes) -> list[int]:
        get = self.pairs.get
        parts = [self.bytes[b] for b in word]
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = least & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], NONE)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        get, n = self.pairs.get, len(word)
        parts: list[int] = [self.bytes[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get(parts[i] << 32 | parts[j], NONE) != r:
                continue
            parts[i], parts[j], k = r & 0xFFFFFFFF, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (x := get(parts[i] << 32 | parts[k], NONE)) != NONE:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := get(parts[h] << 32 | parts[i], NONE)) != NONE:
                heapq.heappush(heap, (x, h))
        return [p for p in parts if p >= 0]

    def word(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        ids = np.array(self.merge_short(raw) if len(raw) <= SHORT else self.merge_long(raw), "<u4").tobytes()
        if len(piece) <= SHORT:
            if self.held > CACHE:
                self.cache.clear()
                self.held = 0
            self.cache[piece] = ids
            self.held += len(raw) + len(ids) + ENTRY
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.apart and any(s in text for s in self.specials):
            out = []
            for part in self.apart.split(text):
                out.append(self.specials[part].to_bytes(4, "little") if part in self.specials else self.plain(part))
            return b"".join(out)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        get, word = self.cache.get, self.word
        return b"".join([get(p) or word(p) for p in self.split.findall(text)])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian u32, if with_ids), ids_sha256, decoded_sha256: each text encoded and decoded again."""
    vocab = docs.sparkSession.sparkContext.broadcast(load(path))

    def make():
        codec = Codec(vocab.value)

        def kernel(b: bytes | None) -> tuple:
            ids = codec.encode((b or b"").decode("utf-8", "replace"))
            digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()
            return (len(ids) // 4, *([ids] if with_ids else []), *digests)

        return kernel

    fields = [pa.field("n_tokens", pa.int64()), *([pa.field("ids", pa.binary())] if with_ids else []), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    ddl = "n_tokens long, " + "ids binary, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return map_texts(narrow(docs, id_col, text_col), make, fields, ddl, release=True)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text from little-endian u32 ids."""
    vocab = encoded.sparkSession.sparkContext.broadcast(load(path))

    def make():
        codec = Codec(vocab.value)
        return lambda b: (codec.decode(b or b""),)

    return map_texts(narrow(encoded, id_col, ids_col), make, [pa.field("text", pa.string())], "text string")

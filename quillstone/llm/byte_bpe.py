"""Byte-level BPE by ranks: a segment tree over byte positions holds the leftmost least pair rank.

A piece of text is a row of live parts, each known by the position of its first byte, with links to the
parts before and after. The tree's leaf at a part's position holds the rank of the pair that it begins
(rank and position in one number, so that the least is also the leftmost); its root is the next merge.
A merge takes the right part out and refreshes at most three leaves: its own, the left neighbour's, and
that of the part that is gone; each walks up only as far as values change. So a piece of n bytes costs
O(n log n), be it a word or a megabyte without a space.

The rank file's path and the splitting pattern are parameters; the driver reads the file once and
broadcasts the ranks, whose number is checked. A piece that is itself a token is that token. Pieces
already met come from a cache bounded by its bytes.

Defined cases: null is encoded as the empty text (no tokens); repeated rows each come back; an empty
table gives no rows; bytes that are no UTF-8 become U+FFFD before encoding; strings that look like
special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts, narrow

MAX_RANKS = 2_000_000
#: Bytes of pieces and ids that the cache of a task may hold, longest piece that it takes, and what an entry costs besides.
CACHE_BYTES, CACHED, ENTRY = 80 << 20, 64, 160
#: Trees of more leaves than this are packed arrays instead of lists.
PACKED = 1 << 12
BITS = 32
POSITION, NONE = (1 << BITS) - 1, 1 << 62


def load(path: str) -> dict[bytes, int]:
    """Ranks of a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{path} has over {MAX_RANKS} ranks; it is not broadcast")
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path} has no token for the bytes {missing}")
    return ranks


def tree_over(leaves: list[int]) -> list[int] | array:
    """Nodes of a complete binary tree: the root is 1, the children of i are 2i and 2i + 1, leaves come last; a node is the least of its leaves."""
    size = 1 << max(0, len(leaves) - 1).bit_length()
    nodes = [NONE] * size + leaves + [NONE] * (size - len(leaves))
    for i in range(size - 1, 0, -1):
        a, b = nodes[2 * i], nodes[2 * i + 1]
        nodes[i] = a if a < b else b
    return array("q", nodes) if size > PACKED else nodes


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pairs = [NONE] * (1 << 16)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank << BITS
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def merged(self, piece: bytes) -> list[int]:
        """The piece's ids: the leftmost pair of the least rank is merged until no pair has a rank."""
        get, n = self.ranks.get, len(piece)
        if n == 1:
            return [self.ranks[piece]]
        # The part that begins at i ends where the next begins; n stands for the end, and -1 for no part before.
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        nodes = tree_over([r | i if (r := pairs[a << 8 | b]) != NONE else NONE for i, (a, b) in enumerate(zip(piece, piece[1:]))])
        leaf = len(nodes) >> 1
        while (least := nodes[1]) != NONE:
            i = least & POSITION
            gone = after[i]
            after[i] = k = after[gone]
            if k < n:
                before[k] = i
                r = get(piece[i : after[k]])
                changed = [(gone, NONE), (i, NONE if r is None else r << BITS | i)]
            else:
                changed = [(i, NONE)]
            if (h := before[i]) >= 0:
                r = get(piece[h:k])
                changed.append((h, NONE if r is None else r << BITS | h))
            for at, value in changed:
                at += leaf
                if nodes[at] == value:
                    continue
                nodes[at] = value
                while at > 1:
                    other = nodes[at ^ 1]
                    if other < value:
                        value = other
                    at >>= 1
                    if nodes[at] == value:
                        break
                    nodes[at] = value
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def piece(self, text: str) -> bytes:
        raw = text.encode()
        own = self.ranks.get(raw)
        ids = np.array(self.merged(raw) if own is None else [own], "<u4").tobytes()
        if len(raw) <= CACHED:
            if self.held > CACHE_BYTES:
                self.cache.clear()
                self.held = 0
            self.cache[text] = ids
            self.held += len(raw) + len(ids) + ENTRY
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, piece = self.cache.get, self.piece
        return b"".join([get(p) or piece(p) for p in self.split.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian u32, if with_ids), ids_sha256, decoded_sha256: each text encoded and decoded again."""
    ranks = docs.sparkSession.sparkContext.broadcast(load(path))

    def make():
        codec = Codec(ranks.value, pattern)

        def kernel(b: bytes | None) -> tuple:
            ids = codec.encode((b or b"").decode("utf-8", "replace"))
            digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()
            return (len(ids) // 4, *([ids] if with_ids else []), *digests)

        return kernel

    fields = [pa.field("n_tokens", pa.int64()), *([pa.field("ids", pa.binary())] if with_ids else []), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    ddl = "n_tokens long, " + "ids binary, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return map_texts(narrow(docs, id_col, text_col), make, fields, ddl, release=True)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text (binary) from little-endian u32 ids."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load(path))

    def make():
        codec = Codec(ranks.value, pattern)
        return lambda b: (codec.decode(b or b""),)

    return map_texts(narrow(encoded, id_col, ids_col), make, [pa.field("text", pa.binary())], "text binary")

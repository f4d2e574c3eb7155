"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are laid out in overlapping chunks that cover all of it. Learned byte vectors and
learned filters of WIDTH bytes run over each chunk; each filter's largest response is the chunk's
feature; the largest and the mean over the chunks go into one logistic unit, whose output is the
probability of label 1.

The network is fitted on the driver on a bounded sample: at most max_train labelled texts (three eighths
of them of label 0 where there are enough), of at most max_bytes bytes each, chosen by hash among rows
whose crc32(doc_id) mod 3 is not 1. Scoring reads every text to its end, a block of chunks at a time.

Defined cases: null and empty texts have no chunks and score what the bias says; labels that are
null, or that contradict each other for a doc_id, are not learned from; without labels of both
classes every score leans to the one there is, or is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DROP, map_texts, narrow, replace_texts

CHUNK, STEP, WIDTH, STRIDE = 512, 504, 8, 4
DIM, FILTERS, BLANK = 8, 32, 256
BLOCK, BATCH, EPOCHS, RATE = 128, 48, 12, 0.02
#: Bounds of the labelled sample: texts, and bytes of each. Together at most 256 MB reach the driver.
MAX_TRAIN, MAX_BYTES = 4_000, 1 << 16


def chunks_of(text: bytes) -> np.ndarray:
    """(chunks, CHUNK) byte values; what is past the end is BLANK."""
    n = max(1, -(-max(0, len(text) - CHUNK) // STEP) + 1) if text else 0
    if not n:
        return np.zeros((0, CHUNK), np.int16)
    flat = np.full((n - 1) * STEP + CHUNK, BLANK, np.int16)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (STEP * 2, 2))


class Net:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f32 = lambda x: x.astype(np.float32)
        self.p = {
            "embed": f32(r.normal(0, 0.5, (BLANK + 1, DIM))),
            "filters": f32(r.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS))),
            "bias": np.zeros(FILTERS, np.float32),
            "out": f32(r.normal(0, 0.1, 2 * FILTERS)),
            "out_bias": np.zeros(1, np.float32),
        }
        self.p["embed"][BLANK] = 0

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        x = self.p["embed"][chunks].reshape(len(chunks), -1)
        n = (CHUNK - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(x, (len(chunks), n, WIDTH * DIM), (x.strides[0], STRIDE * DIM * 4, 4))

    def features(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and where it is."""
        w = self.windows(chunks)
        y = np.ascontiguousarray(w).reshape(-1, WIDTH * DIM) @ self.p["filters"]
        y = y.reshape(len(chunks), -1, FILTERS)
        at = y.argmax(1)
        top = np.take_along_axis(y, at[:, None], 1)[:, 0] + self.p["bias"]
        return np.maximum(top, 0), at

    def score(self, text: bytes | None) -> float:
        chunks = chunks_of(text or b"")
        most, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS)
        for k in range(0, len(chunks), BLOCK):
            w = np.ascontiguousarray(self.windows(chunks[k : k + BLOCK]))
            y = (w.reshape(-1, WIDTH * DIM) @ self.p["filters"]).reshape(len(w), -1, FILTERS)
            f = np.maximum(y.max(1) + self.p["bias"], 0)
            most, total = np.maximum(most, f.max(0)), total + f.sum(0)
        z = float(np.concatenate([most, total / max(1, len(chunks))]) @ self.p["out"] + self.p["out_bias"][0])
        return 1 / (1 + np.exp(-max(-60.0, min(60.0, z))))

    def gradient(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        parts = [chunks_of(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        doc = np.zeros((len(texts), 2 * FILTERS), np.float32)
        chunks = np.concatenate(parts) if len(owner) else np.zeros((0, CHUNK), np.int16)
        blocks = [self.features(chunks[k : k + BLOCK]) for k in range(0, len(chunks), BLOCK)]
        if blocks:
            f, at = (np.concatenate(x) for x in zip(*blocks))
            np.maximum.at(doc[:, :FILTERS], owner, f)
            np.add.at(doc[:, FILTERS:], owner, f)
            count = np.bincount(owner, minlength=len(texts)).clip(1)
            doc[:, FILTERS:] /= count[:, None]
        z = (doc @ self.p["out"] + self.p["out_bias"][0]).clip(-30, 30)
        d = ((1 / (1 + np.exp(-z)) - labels) / len(texts)).astype(np.float32)
        g["out"], g["out_bias"] = doc.T @ d, np.array([d.sum()], np.float32)
        if blocks:
            back = d[owner, None] * (self.p["out"][:FILTERS] * (f == doc[owner, :FILTERS]) + self.p["out"][FILTERS:] / count[owner, None]) * (f > 0)
            c, j = np.nonzero(back)
            v = back[c, j]
            values = chunks[c[:, None], at[c, j][:, None] * STRIDE + np.arange(WIDTH)]
            x = self.p["embed"][values].reshape(len(c), WIDTH * DIM)
            g["bias"] = np.bincount(j, v, FILTERS).astype(np.float32)
            for k in range(FILTERS):
                g["filters"][:, k] = v[j == k] @ x[j == k]
            dx = (v[:, None] * self.p["filters"].T[j]).reshape(-1, DIM)
            for k in range(DIM):
                g["embed"][:, k] = np.bincount(values.ravel(), dx[:, k], BLANK + 1)
            g["embed"][BLANK] = 0
        return g

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> Net:
        y, r = np.array(labels, np.float32), np.random.default_rng(seed)
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        t, steps = 0, 1 + epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                own, t = order[k : k + BATCH], t + 1
                for name, g in self.gradient([texts[i] for i in own], y[own]).items():
                    m[name] += 0.1 * (g - m[name])
                    s[name] += 0.01 * (g * g - s[name])
                    self.p[name] -= RATE * (1 - t / steps) * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.99**t)) + 1e-7)
        return self


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Net:
    """A network fitted on the bounded sample described above; doc_id and quality are read of labels."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out("doc_id"))
    known = known.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    pick = lambda q, n: known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", "quality")
    chosen = F.broadcast(pick(0, max_train * 3 // 8).union(pick(1, max_train - max_train * 3 // 8)))  # max_train rows of two numbers at most
    sample = narrow(docs, id_col, text_col).join(chosen, "doc_id").where(F.octet_length("text") <= max_bytes)
    rows = sample.select(F.col("text").cast("binary").alias("text"), "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", "text").limit(max_train).collect()
    return Net().fit([bytes(r.text) for r in rows], [r.quality for r in rows])


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: the probability of label 1."""
    model = docs.sparkSession.sparkContext.broadcast(net.p)

    def make():
        own = Net()
        own.p = model.value
        return lambda b: (float(own.score(b)),)

    return map_texts(narrow(docs, id_col, text_col), make, [pa.field("score", pa.float64())], "score double")


def keep_good(docs: DataFrame, net: Net, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs, all columns, without rows that score under least."""
    model = docs.sparkSession.sparkContext.broadcast(net.p)

    def make():
        own = Net()
        own.p = model.value
        return lambda b: b if own.score(b) >= least else DROP

    return replace_texts(docs, text_col, make)

"""SimHash near-duplicate groups by multi-index hashing.

Fingerprints: words are lower-cased (A-Z), 3-word shingles with repeats are hashed with XXH64
(seed 42) and a bit is 1 if it is set in over half the hashes. Fingerprints within 3 bits link.

Multi-index hashing: a fingerprint has two 32-bit segments. If two fingerprints differ in 3 bits or
fewer, some segment differs in 1 bit or none, so it is enough to look up, for either segment, the
Hamming ball of radius 1 around its value, and to verify the whole distance of what the table
returns. Of two values one bit apart exactly one has a 0 there, so a probe flips zeros only.
Copies with one fingerprint are one table entry; text never shuffles.

Defined cases: a null or wordless text has fingerprint 0 and links like any other; one or two words
are one shingle; rows with null ids take part but never name a component unless all ids in it are
null; repeated rows each come back; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpointed, components, map_texts, narrow

SEED, WIDTH, RADIUS = 42, 3, 3
BLOCK = 1 << 16


def fingerprint_of(text: bytes | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < WIDTH:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(s) for s in zip(words, words[1:], words[2:])]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(shingles), BLOCK):
        part = shingles[k : k + BLOCK]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def text_hash(text: bytes | None) -> int:
    """What Spark's xxhash64 gives for the text."""
    return SEED if text is None else int(np.uint64(xxhash.xxh64_intdigest(text, SEED)).astype(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """doc_id, fp (long), and th, the text's hash (long), if hashed."""
    kernel = (lambda b: (fingerprint_of(b), text_hash(b))) if hashed else (lambda b: (fingerprint_of(b),))
    return map_texts(narrow(docs, id_col, text_col), lambda: kernel, [pa.field("fp", pa.int64())] + [pa.field("th", pa.int64())] * hashed, "fp long" + ", th long" * hashed)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): pairs of different fingerprints (column fp, distinct) at RADIUS bits or fewer."""
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    seg = F.array(F.shiftrightunsigned("fp", 32), low("fp"))
    # Each fingerprint becomes 66 rows, so they are spread before they are laid out.
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    entries = spread.select("fp", F.posexplode(seg).alias("k", "value"))
    flips = F.expr("array_distinct(transform(sequence(-1, 31), b -> if(b < 0, value, value | shiftleft(1L, b))))")
    probes = entries.select(F.col("fp").alias("p"), "k", F.explode(flips).alias("value"))
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("fp"))) <= RADIUS
    hit = probes.join(entries, ["k", "value"]).where((F.col("p") != F.col("fp")) & near)
    return hit.select(F.greatest("p", "fp").alias("a"), F.least("p", "fp").alias("b"))


def rooted(docs: DataFrame, id_col: str, text_col: str, hashed: bool = False) -> DataFrame:
    """fingerprints() with root (the group's smallest fingerprint) and component_id."""
    f = checkpointed(fingerprints(docs, id_col, text_col, hashed))
    reps = f.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(reps.select("fp")))
    named = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return f.join(named.join(ids, "root").select("fp", "root", "component_id"), "fp")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    return rooted(docs, id_col, text_col).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group: a row whose id names the component stays.

    Of several such rows, as of a group of null ids only, the one with the least text hash stays. Rows are
    told apart by id and text hash, so an id (or null) that stands in several groups can stay in each.
    """
    named = rooted(docs, id_col, text_col, hashed=True).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = named.groupBy("root").agg(F.min("th").alias("__qs_th"), F.first("component_id").alias("__qs_keep")).drop("root")
    hashed = docs.withColumn("__qs_of", F.xxhash64(text_col))
    kept = hashed.join(keep, F.col(id_col).eqNullSafe(F.col("__qs_keep")) & (F.col("__qs_of") == F.col("__qs_th")), "left_semi")
    one = Window.partitionBy(id_col, "__qs_of").orderBy(text_col)
    return kept.withColumn("__qs_n", F.row_number().over(one)).where("__qs_n = 1").drop("__qs_n", "__qs_of")

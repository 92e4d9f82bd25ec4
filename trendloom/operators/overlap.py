"""Identity of texts in normal form, and texts that hold most of another."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from trendloom.operators.components import checkpointed

GRAM, SHORTEST, CONTAINED = 12, 200, 0.8
BITS = 16  #: of the filter for each gram of the cases
MOST_GRAMS = 4_000_000  #: of the cases, for a filter of 8 MB; beyond it no filter is sent and all grams are dealt out
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@pandas_udf(StringType())
def normal_form(texts: pd.Series) -> pd.Series:
    """Compatibility forms and case folded, all white space gone: what tells whether two texts say the same. Null stays null."""
    return texts.map(lambda s: re.sub(r"\s+", "", unicodedata.normalize("NFKC", s).casefold()), na_action="ignore")


def gram_hashes(text: str) -> np.ndarray:
    """Different 64-bit hashes of the runs of 12 characters of a normal text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(points) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = (h ^ points[i : i + n]) * _M1
        h ^= h >> np.uint64(29)
    h *= _M2
    return np.unique(h ^ (h >> np.uint64(32)))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def _grams(rows: DataFrame, words: np.ndarray | None = None) -> DataFrame:
    """(id, size, gram): different grams of normal texts of 200 characters or more, with their number before a filter is applied.

    ``words`` are the bits of a Bloom filter; grams that it does not have are left out.
    """

    def run(batches):
        bits = None if words is None else np.unpackbits(words.view(np.uint8), bitorder="little")
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = gram_hashes(text)
                size = len(h)
                if bits is not None:
                    a, b = _places(h, len(bits))
                    h = h[(bits[a] & bits[b]).astype(bool)]
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.int64()), pa.array(np.full(len(h), size)), pa.array(h.view(np.int64))], ["id", "size", "gram"])

    return rows.where(F.length("normal") >= SHORTEST).select("id", "normal").mapInArrow(run, "id long, size long, gram long")


def bloom(grams: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of ``n`` grams, its words united in Spark; its size follows from ``n``."""
    bits = 1 << max(10, (n * BITS - 1).bit_length())

    def run(batches):
        for batch in batches:
            p = np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["at", "word"])

    out = np.zeros(bits // 64, np.int64)
    for r in grams.select("gram").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).collect():
        out[r.at] = r.word
    return out


def overlaps(cases: DataFrame, pool: DataFrame, keys: list[str], contained: float = CONTAINED, most: int = MOST_GRAMS) -> DataFrame:
    """(case_id, id, reasons): rows of ``pool`` that share an identity, the normal text, or most of the grams with a case.

    Both have (id, text) and ``keys``; null and empty keys match nothing. Reasons are the names of equal keys, exact_transcript for equal normal
    texts, and near_transcript_requires_review if the grams that two texts of 200 characters or more share are ``contained`` or more of those of the one
    with fewer. Grams of the pool are dealt out only if a filter of the cases' grams has them; equal texts of the pool are compared once.
    """
    a = checkpointed(cases.select("id", *keys, normal_form("text").alias("normal")).withColumn("digest", F.sha2(F.nullif("normal", F.lit("")), 256)))
    b = checkpointed(pool.select("id", *keys, normal_form("text").alias("normal")).withColumn("digest", F.sha2(F.nullif("normal", F.lit("")), 256)))
    same = None
    for key, reason in [*((k, k) for k in keys), ("digest", "exact_transcript")]:
        left, right = (t.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").select(F.col("id").alias(n), F.col(key).cast("string").alias("value")) for t, n in ((a, "case_id"), (b, "id")))
        found = left.join(right, "value").select("case_id", "id", F.lit(reason).alias("reason"))
        same = found if same is None else same.unionByName(found)
    texts = lambda t: t.where("digest is not null").groupBy("digest").agg(F.first("normal").alias("normal")).select(F.xxhash64("digest").alias("id"), "digest", "normal")
    one, other = checkpointed(texts(a)), checkpointed(texts(b))
    grams = checkpointed(_grams(one))
    n = grams.count()
    held = _grams(other, bloom(grams, n) if n <= most else None)
    shared = grams.select(F.col("id").alias("a"), F.col("size").alias("size_a"), "gram").join(held.select(F.col("id").alias("b"), F.col("size").alias("size_b"), "gram"), "gram")
    near = shared.groupBy("a", "b").agg(F.count("*").alias("k"), F.first(F.least("size_a", "size_b")).alias("fewer")).where((F.col("k") >= contained * F.col("fewer")) & (F.col("a") != F.col("b")))
    near = near.join(one.select(F.col("id").alias("a"), F.col("digest").alias("digest_a")), "a").join(other.select(F.col("id").alias("b"), F.col("digest").alias("digest_b")), "b")
    near = near.join(a.select(F.col("id").alias("case_id"), F.col("digest").alias("digest_a")), "digest_a").join(b.select("id", F.col("digest").alias("digest_b")), "digest_b")
    every = same.unionByName(near.select("case_id", "id", F.lit("near_transcript_requires_review").alias("reason")))
    return every.groupBy("case_id", "id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))  # a few reasons

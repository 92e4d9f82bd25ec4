"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its words' byte n-grams, each n-gram hashed to a row. The model is trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows, and a temperature and a rejection threshold are
calibrated on the part of that sample that training does not see. Both layers being linear, a prediction is one
lookup of class scores for each n-gram of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, utf8

BUCKETS, DIM, SIZES = 1 << 15, 16, (2, 3, 4)
SAMPLE, SAMPLE_BYTES = 4000, 32 << 20  #: rows, and bytes of text, of the sample that the classifier is fitted on, at most
EPOCHS, RATE, REJECTED = 6, 0.5, 0.0005
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, 2, np.uint8)  # 0: a break between words; letters and bytes beyond ASCII belong to words
_KIND[:128] = 0
_KIND[97:123] = 2


def ngrams(texts: list[bytes], sizes=SIZES, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all n-grams inside words (with one blank on each side), and the text each belongs to."""
    joined = b" " + b" ".join(texts) + b" "
    raw = _LOWER[np.frombuffer(joined, np.uint8)]
    raw = np.where(_KIND[raw] == 0, np.uint8(32), raw)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = raw == 32
    code = raw.astype(np.uint32)
    rows, owners = [], []
    for n in sizes:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        inner = np.zeros(m, bool)
        for j in range(n):
            h = (h ^ code[j : j + m]) * np.uint32(16777619)
            if 0 < j < n - 1:
                inner |= blank[j : j + m]
        if n == 2:
            inner = blank[:m] & blank[1 : 1 + m]
        keep = np.flatnonzero(~inner)
        h = h[keep]
        rows.append((h ^ h >> np.uint32(15)) & np.uint32(buckets - 1))
        owners.append(np.searchsorted(ends, keep, side="right"))
    if not rows:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    return np.concatenate(rows), np.minimum(np.concatenate(owners), len(texts) - 1)


@dataclass
class Model:
    """Class scores by n-gram row, the calibrated temperature and the least accepted probability."""

    labels: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.labels)))
        rows, owner = ngrams(texts)
        counts = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        for c in range(len(self.labels)):
            out[:, c] = np.bincount(owner, self.scores[rows, c], len(texts)) / counts + self.bias[c]
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(texts) / self.temperature)
        return p.argmax(1), p.max(1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[bytes], langs: list[str], seed: int = 7, epochs: int = EPOCHS, rate: float = RATE, rejected: float = REJECTED) -> Model:
    """Train on four fifths of the rows, calibrate on the last fifth; ``rejected``: share of it under the threshold."""
    labels = sorted(set(langs))
    gold = np.array([labels.index(x) for x in langs])
    if len(labels) == 1:
        return Model(labels, np.zeros((BUCKETS, 1)), np.zeros(1))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = order[: len(order) // 5] if len(order) >= 50 else order
    train = order[len(order) // 5 :] if len(order) >= 50 else order
    vectors = []
    for t in texts:
        rows, n = np.unique(ngrams([t])[0], return_counts=True)
        vectors.append((rows, (n / max(1, n.sum())).astype(np.float32)))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    steps, at = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            rows, share = vectors[i]
            step = rate * (1 - at / steps)
            at += 1
            hidden = share @ emb[rows]
            err = softmax(hidden @ out + bias).astype(np.float32)
            err[gold[i]] -= 1
            back = out @ err
            out -= step * np.outer(hidden, err)
            bias -= 0.1 * step * err
            emb[rows] -= (step * 20) * np.outer(share, back)
    model = Model(labels, emb @ out, bias)
    logits = model.logits([texts[i] for i in held])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), gold[held]] + 1e-12).mean()
    model.temperature = min((0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0), key=loss)
    best = softmax(logits / model.temperature)
    right = best.argmax(1) == gold[held]
    sure = np.sort(best.max(1)[right])
    model.threshold = float(min(sure[int(rejected * len(sure))] * 0.9, 0.5)) if len(sure) else 0.0
    return model


def is_training_row(modulus: int = 4, held_out: int = 2):
    return F.coalesce(crc32_of_id() % modulus != held_out, F.lit(True))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of a bounded sample, in the order of a hash of id and text; None without a labelled training row.

    At most ``sample`` different rows and SAMPLE_BYTES; texts above an eighth of that don't take part.
    """
    rows = (
        docs.where(is_training_row() & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select(F.xxhash64("doc_id", "text").alias("at"), "doc_id", "lang", utf8().alias("text"))
    )
    # repeated rows are one; no text reaches the driver before its size is known
    each = rows.groupBy("at").agg(F.min("lang").alias("lang"), F.min(F.length("text")).alias("size")).where(F.col("size") <= SAMPLE_BYTES // 8)
    chosen, total = [], 0
    for r in each.orderBy("at").limit(sample).collect():
        if total + r["size"] <= SAMPLE_BYTES:  # a text that does not fit is passed over
            total += r["size"]
            chosen.append(r["at"])
    if not chosen:
        return None
    picked = rows.where(F.col("at").isin(chosen)).groupBy("at").agg(F.min("lang").alias("lang"), F.first("text").alias("text")).toArrow().sort_by("at")
    return fit(picked["text"].to_pylist(), picked["lang"].to_pylist())


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected`` and ``row``, the struct of all input columns.

    A null text, one without a letter, or a missing model gives ``und`` with score 0 and is rejected. Rejected is also a
    best probability under the calibrated threshold. Ties go to the label that sorts first.
    """
    labels = model.labels if model else []

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts, clear = table["bytes"].to_pylist(), np.array(table["letters"].to_pylist(), bool)
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            use, at = [i for i in range(len(texts)) if clear[i] and labels], 0
            while at < len(use):
                size, stop = 0, at
                while stop < len(use) and (stop == at or size < 1_000_000):
                    size += len(texts[use[stop]])
                    stop += 1
                best, p = model.predict([texts[i] for i in use[at:stop]])
                for i, b, q in zip(use[at:stop], best, p):
                    langs[i], scores[i] = labels[b], q
                at = stop
            low = (scores < (model.threshold if model else 0)) | (np.array(langs) == "und")
            yield pa.RecordBatch.from_arrays(
                [*(table[c].combine_chunks() for c in table.column_names if c not in ("bytes", "letters")), pa.array(langs), pa.array(scores), pa.array(low)],
                [c for c in table.column_names if c not in ("bytes", "letters")] + ["lang_pred", "score", "rejected"],
            )

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (~is_training_row()).alias("held_out"), utf8(text_col).alias("bytes"), letters.alias("letters")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def per_document(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``; see ``predict``. Repeated rows are kept; rows without id count as training rows.

    An empty table gives an empty result; a table without usable labels gives ``und`` everywhere; further columns are
    ignored.
    """
    return predict(docs, train(docs, sample))


def keep_known(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns as they were.

    Null texts and texts without a letter go; repeated rows stay or go together; without a labelled training row there is
    no model and nothing is accepted. An empty table gives an empty result.
    """
    model = train(docs, sample)
    if model is None:
        return docs.limit(0)
    codes = F.pandas_udf(lambda s: _accepted(model, s), "boolean")
    return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).where(codes(utf8()))


def _accepted(model: Model, texts):
    import pandas as pd

    out = np.zeros(len(texts), bool)
    values = texts.tolist()
    at = 0
    while at < len(values):
        size, stop = 0, at
        while stop < len(values) and (stop == at or size < 1_000_000):
            size += len(values[stop])
            stop += 1
        out[at:stop] = model.predict(values[at:stop])[1] >= model.threshold
        at = stop
    return pd.Series(out)

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trendloom.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_patterns_hold_the_histogram(histogram):
    patterns = P.pack_histogram(histogram, 64)
    held = Counter()
    for p, n in patterns:
        assert sum(p) <= 64 and n > 0
        held.update({k: c * n for k, c in Counter(p).items()})
    assert held == Counter(histogram)


def test_encoders_agree():
    texts = ["Ünï text <|endoftext|> a  b\n\n x's 12", "", "😀 \x00 \t", "word " * 50, " " * 1_000_000 + "x"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert P.encoder()(texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_pieces_and_sequences(spark):
    rnd = random.Random(2)
    texts = [None, "", "a", "word " * 30000] + [" ".join(rnd.choices(["alpha", "be", "gamma"], k=rnd.randint(1, 900))) for _ in range(300)]
    rows = [(i, t, 5, "s") for i, t in enumerate(texts)] + [(2, "a", 6, "s"), (None, "b c", 6, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, salt string")
    got = P.pack(docs).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 1024):
            want[(-1 if i is None else i, s, min(1024, len(ids) - s), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids))] += 1
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(got[cols].fillna(-1).astype("int64").itertuples(index=False, name=None)) == want
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert list(seq.offset) == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 1024
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))
    assert got.length.sum() / (1024 * got.sequence_id.nunique()) > 0.97
    assert P.pack(docs.limit(0)).count() == 0


def test_ranks_of_a_length_over_any_number_of_salts(spark):
    rows = [(i % 7, i, 4 if i % 3 else 9, i * i % 11, 1) for i in range(300)] + [(1, 1, 4, 1, 1)] * 5  # repeated pieces rank one by one
    cut = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    for salt_rows in (1, 7, 1 << 18):
        got = P.ranked(cut, histogram, salt_rows).collect()
        for length, n in histogram.items():
            assert sorted(r.rank for r in got if r.length == length) == list(range(n))
    assert P.ranked(cut.limit(0), {}).count() == 0

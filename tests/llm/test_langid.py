import zlib

import numpy as np

from trendloom.llm import langid as L


def test_ngrams_are_of_their_text():
    rows, owner = L.ngrams([b"ab", b"", b"cd ef"])
    alone = [sorted(L.ngrams([t])[0]) for t in (b"ab", b"", b"cd ef")]
    assert [sorted(rows[owner == i]) for i in range(3)] == alone
    assert len(alone[1]) == 0 and len(alone[0]) == 6  # _a ab b_ _ab ab_ _ab_


def test_held_out_accuracy_and_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.per_document(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    held = got[got.held_out]
    assert ((got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)) == got.held_out).all()
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert got.rejected.mean() < 0.02
    rows = [(1, None, "en", 1), (2, "", "en", 2), (3, "123 ...", "en", 3), (4, "the and " * 20000, "en", 4), (4, "the and", None, 5), (None, "der und die", "de", 6)]
    small = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = {r.doc_id: r for r in L.per_document(small).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert L.per_document(small).count() == 6 and L.per_document(small.limit(0)).count() == 0
    none = L.per_document(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)
    kept = L.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() > 0.97 * docs.count()


def test_sample_is_bounded_and_passes_over_texts_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_BYTES", 4000)
    data = [(1, "le chat noir et la maison " * 9, "fr")] * 50 + [(i, f"the cat and the house {i} of that", "en") for i in range(2, 40)] + [(99, "x" * 3000, "en")]
    seen = []
    monkeypatch.setattr(L, "fit", lambda texts, langs, **k: seen.append((texts, langs)))
    L.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    texts, langs = seen[0]
    assert sum(map(len, texts)) <= 4000 and len(set(texts)) == len(texts) and b"x" * 3000 not in texts and langs.count("fr") == 1 and len(texts) > 20

import re

import corpus_pipeline as P
from tests.llm.test_licenses_decontaminate import lower
from tests.llm.test_secrets_pii import base_secrets
from tests.llm.test_similar import brute
from trendloom.llm import decontaminate as D
from trendloom.llm import langid


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("extra", docs.doc_id % 3)
    benchmark = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "secret_scans", "packing"]
    frames = [docs]
    for _, stage in P.STAGES:
        frames.append(stage(spark, frames[-1], sf))
    rows = [f.collect() for f in frames]
    assert all(f.columns == docs.columns for f in frames[:-1])
    # language: what the operator rejects goes, all else stays as it is
    bad = {r.doc_id for r in langid.per_document(docs).where("rejected").collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r.doc_id not in bad) and len(bad) < 10
    first = {}
    ordered = sorted(rows[1], key=lambda r: r.doc_id)
    for r, c in zip(ordered, brute([(r.doc_id, r.text) for r in ordered])):
        first.setdefault(c, r)
    assert sorted(rows[2]) == sorted(first.values())
    items = D.Items(benchmark)
    assert sorted(rows[3]) == sorted(r for r in rows[2] if not list(D.covered(items, r.text.encode())))
    before = {r.doc_id: r for r in rows[3]}
    assert len(rows[4]) == len(rows[3])
    for r in rows[4]:
        found = base_secrets(before[r.doc_id].text)
        assert (r.text != before[r.doc_id].text) == bool(found) and not base_secrets(r.text)
        assert r.n_chars == len(r.text) and (r.lang, r.source, r.extra) == (before[r.doc_id].lang, before[r.doc_id].source, before[r.doc_id].extra)
    assert {r.doc_id for r in rows[5]} == {r.doc_id for r in rows[4]}
    assert P.run(spark, sf).count() == len(rows[5])


def test_empty_and_null_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.union(spark.createDataFrame([(None, None, None, None, None), (900001, None, "en", None, 0), (900001, None, "en", None, 0)], docs.schema))
    for data in (docs.limit(0), odd):
        for _, stage in P.STAGES:
            data = stage(spark, data, sf)
        data.count()


def test_near_dedup_knows_rows_by_id_and_text(spark):
    base = " ".join(f"word{i}" for i in range(300))
    near = base.replace(" ", "  ").upper()  # another text of equal fingerprint
    other = " ".join(f"other{i}" for i in range(300))
    data = [(1, base), (1, other), (1, base), (2, near), (None, near), (None, base), (None, "only here"), (None, "ONLY  here"), (None, "only here")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text.lower().split()) for r in P.one_of_each_group(spark, docs, "").collect())
    assert got == [(0, ["only", "here"]), (1, other.split()), (1, base.split())]

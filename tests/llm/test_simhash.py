import numpy as np
import xxhash
from pyspark.sql import functions as F

from trendloom.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, c int"


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    fps = [(i, plain(t)) for i, t in rows]
    comp = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= 3 and comp[i] > comp[j]:
                    comp[i] = comp[j]
                    changed = True
    return {(i, f"{a:016x}", comp[i]) for i, a in fps}


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"wört{i}" for i in range(60)] + ["The", "of"]
    rows = [(0, None), (1, ""), (2, "one"), (3, "one two"), (4, "ONE\ttwo\x0b"), (5, "x " * 30000), (5, "x " * 30000)]
    for i in range(6, 80):
        base = [words[j] for j in rng.integers(0, 62, 150)]
        rows.append((i, " ".join(base)))
        rows.append((i + 200, " ".join(base[: 150 - int(rng.integers(0, 3))])))
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], SCHEMA)
    got = {tuple(r) for r in S.near_duplicates(docs).collect()}
    assert got == brute(rows)
    assert S.near_duplicates(docs).count() == len(rows)
    assert S.near_duplicates(docs.where("doc_id < 0")).count() == 0


def test_large_buckets_as_tile_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 8, dtype=np.int64)
    fps = set()
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.integers(0, 20, 4):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    edges = S.links(nodes, tile=2)
    from trendloom.llm.common import connected_components

    got = {r[0]: r[1] for r in connected_components(edges).collect()}
    comp = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    assert [got.get(i, i) for i in range(len(fps))] == comp


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "only here it is")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}


def components(spark, monkeypatch, rows):
    """near_duplicates of rows (id, fingerprint) in place of texts."""
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(S, "fingerprints", lambda *_: prints)
    return sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(prints).collect()), key=repr)


def test_a_row_without_id_links_others(spark, monkeypatch):
    assert components(spark, monkeypatch, [(1, 0), (None, 0b111), (2, 0b111111)]) == [(1, 1), (2, 1), (None, 1)]
    assert components(spark, monkeypatch, [(None, 0), (None, 0b111)]) == [(None, None), (None, None)]


def test_two_texts_of_one_id_do_not_join_their_neighbours(spark, monkeypatch):
    far = (1 << 40) - 1
    rows = [(5, 0), (5, far), (7, 1), (9, far ^ 1)]
    assert components(spark, monkeypatch, rows) == [(5, 5), (5, 5), (7, 5), (9, 5)]  # the same name, for both hold id 5
    rows = [(5, 0), (5, far), (3, 1), (9, far ^ 1)]
    assert components(spark, monkeypatch, rows) == [(3, 3), (5, 3), (5, 5), (9, 5)]

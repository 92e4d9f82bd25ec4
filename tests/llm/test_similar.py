import random

import numpy as np

from trendloom.llm import similar as S


def brute(rows, width=5):
    """Class of every row by comparing all sets with all others."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                label[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def texts():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(60))
    out = [None, "", "  ", "one", "ONE", "one two", "a b c d e", "a b c d e f", "a b c d e f g h i j k l m", "a b c d e f g h i j k l n"]
    for i in range(40):
        words = [word() for _ in range(rnd.randint(8, 200))]
        out.append(" ".join(words))
        for _ in range(rnd.randint(0, 4)):  # copies with some changes, on both sides of the least similarity
            other = list(words)
            for _ in range(rnd.randint(0, 4)):
                other[rnd.randrange(len(other))] = word()
            out.append(" ".join(other[: len(other) - rnd.randint(0, len(other) // 6)]))
    out += [f"{passage} {' '.join(word() for _ in range(rnd.randint(5, 60)))}" for _ in range(60)]  # share a passage, no more
    base = [word() for _ in range(100)]
    for _ in range(60):  # one large group of near copies
        other = list(base)
        other[rnd.randrange(100)] = word()
        out.append(" ".join(other))
    return out


def test_classes_against_all_pairs(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, k string")
    want = brute(rows)
    for tile in (1024, 2):  # small tiles: large groups are spread
        got = {r.id: r.component for r in S.classes(docs, tile=tile).collect()}
        assert len(got) == len(rows)
        whole = {}
        assert all(whole.setdefault(got[i], want[i]) == want[i] for i, _ in rows)  # no class joins what all pairs keep apart
        assert len(whole) == len(set(want))  # and none splits a class
    assert S.classes(docs.limit(0)).count() == 0


def test_keys_and_fingerprints():
    rnd = random.Random(4)
    assert len(S.keys_of(S.shingles(b""))) == 0 and len(S.fingerprint(S.shingles(b""))) == 32
    long = " ".join(f"w{i}" for i in range(60000)).encode()
    h = S.shingles(long)
    assert len(h) == 59996 and len(S.fingerprint(h)) == 32 and len(set(S.keys_of(h).tolist())) == S.BANDS
    met = within = 0
    for _ in range(300):  # pairs of similarity 0.8, just: 160 of 200 shingles shared
        both = np.array([rnd.getrandbits(64) for _ in range(200)], np.uint64)
        a, b = np.sort(both[:180]), np.sort(both[20:])
        met += bool(set(S.keys_of(a).tolist()) & set(S.keys_of(b).tolist()))
        within += (int.from_bytes(S.fingerprint(a)) ^ int.from_bytes(S.fingerprint(b))).bit_count() <= S.RADIUS
    assert met == within == 300


def test_blocks_against_all_pairs(spark):
    """The last round alone, on sets that are all apart: tiles of any size give the links of all pairs, as spanning edges."""
    rows = {S._node(S.shingles((t or "").encode())): t for t in texts() if t and t.split()}
    docs = spark.createDataFrame(list(enumerate(rows.values())), "doc_id long, text string")
    named = spark.createDataFrame([(1, n, n) for n in rows], "k long, node long, part long")
    want, nodes = brute(list(enumerate(rows.values()))), list(rows)
    for tile in (2048, 7):
        links = [(r.u, r.v) for r in S.across(named, docs, S.WIDTH, S.LEAST, "text", tile).collect()]
        u, v = (np.array(x, np.int64) for x in zip(*links))
        label = dict(zip(nodes, nodes)) | dict(zip(*(x.tolist() for x in S.min_labels(u, v))))
        got = [label[n] for n in nodes]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_shared_counts():
    rnd = random.Random(5)
    sets = [np.array(sorted(rnd.sample(range(500), rnd.randint(0, 300))), np.int32) for _ in range(30)]
    got = S.shared_counts(sets[:12], sets[12:], chunk=64)
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[12:]] for a in sets[:12]]

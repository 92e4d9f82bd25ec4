import random
import re

import numpy as np

from trendloom.llm import decontaminate as D
from trendloom.llm import licenses as L

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_matching_statistics_against_brute_force():
    rnd = random.Random(4)
    for _ in range(40):
        texts = [("t%d" % i, " ".join(rnd.choices("abcd", k=rnd.randint(1, 14)))) for i in range(4)]
        phrases = {"a b": "p", "b c d": "q", "a": "r"}
        auto = L.Automaton(texts, phrases)
        pool = [t.split() for _, t in texts] + [p.split() for p in phrases]
        doc = rnd.choices("abcdx", k=60)
        ids = [auto.ids.get(w.encode(), 0) for w in doc]
        places, matches = auto.stream(ids, 1)
        inside = lambda s: any(s == q[k : k + len(s)] for q in pool for k in range(len(q)))
        stats = [max(n for n in range(i + 2) if n == 0 or inside(doc[i + 1 - n : i + 1])) for i in range(60)]
        ends = [i for i in range(60) if stats[i] and (i == 59 or stats[i + 1] != stats[i] + 1)]
        assert [(a, n) for a, n, _ in matches] == [(i + 1 - stats[i], stats[i]) for i in ends]
        want = sorted((i, v) for i in range(60) for p, v in phrases.items() if doc[i : i + len(p.split())] == p.split())
        assert sorted(places) == want


def test_license_rows(spark):
    apache = L.TEMPLATES["apache-2"]
    texts = [
        None, "", "Released under the MIT License. UNDER THE MIT-LICENSE, cc by-nc", "x " * 30000 + "Apache License, Version 2.0", "é" + L.TEMPLATES["bsd"],
        apache.replace("Apache License", "Apache Licence").replace("AS IS", "as  is"), "under the the mit license apache license version 22",
        "This work is licensed under the GNU General Public License v3",
    ]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)] + [(2, texts[2], 1, "s")], "doc_id long, text string, n_words int, score string")
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(WORD, lower(t))
        hits = [(k, v) for p, v in L.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted({v for _, v in hits})))
        assert (r.first_word, r.last_word) == (min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[4].labels == "bsd" and got[5].labels == "apache-2" and got[5].base_labels == "" and got[7].labels == "gpl"
    assert L.scan(docs).count() == 9 and L.scan(docs.limit(0)).count() == 0


def plain_tiles(text, item, least):
    mt, mi, n_all = [False] * len(text), [False] * len(item), 0
    while True:
        best = 0
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while t + n < len(text) and i + n < len(item) and text[t + n] == item[i + n] and not mt[t + n] and not mi[i + n]:
                    n += 1
                if n > best:
                    best, at = n, (t, i)
        if best < least:
            return n_all
        for j in range(best):
            mt[at[0] + j] = mi[at[1] + j] = True
        n_all += best


def test_tiling_against_brute_force():
    rnd = random.Random(8)
    for _ in range(60):
        item, text = rnd.choices("abc", k=20), rnd.choices("abcd", k=40)
        text[5:15] = item[8:18]
        items = D.Items([(1, " ".join(item).encode())], 3)
        ids = np.array([items.vocabulary.get(w.encode(), 0) for w in text])
        found = [D.tiles(ids, items.tokens[0], s, a, b) for _, s, a, b in items.shared(ids)]
        assert sum(n for f in found for _, _, n in f) == plain_tiles(text, item, 3)


def test_contaminated(spark):
    rnd = random.Random(9)
    bag = [f"w{i}" for i in range(400)]
    items = [" ".join(rnd.choices(bag, k=40)) for _ in range(12)] + ["", None, "only three words"]
    docs, want = [], set()
    for i in range(60):
        w = rnd.choices(bag, k=300)
        if i < 12:
            p = items[i].split()
            p = p[20:] + ["zz"] + p[:20] if i % 2 else p
            w[50:50] = p
            want.add((i, i))
        elif i < 20:
            w[50:50] = items[i - 12].split()[:25]  # 62 %
        docs.append((i, " ".join(w).title() + ".", 0.5))
    docs += [(60, None, 0.0), (61, "", 0.0), (62, "So: only three words!", 0.0), (63, "only three other words", 0.0)]
    want.add((62, 14))
    frame = spark.createDataFrame(docs, "doc_id long, text string, coverage double")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for limit in (1 << 20, 700):
        assert {(r.doc_id, r.item_id) for r in D.contaminated(frame, bench, limit=limit).collect()} == want
    kept = D.remove(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(range(64)) - {i for i, _ in want}
    assert D.contaminated(frame, bench.limit(0)).count() == 0 and D.contaminated(frame.limit(0), bench).count() == 0


def test_tiles_and_their_places_against_brute_force():
    rnd = random.Random(5)
    for round_ in range(150):
        letters = ["a", "ab", "abc", "abcdef"][round_ % 4]
        item, text = rnd.choices(letters, k=rnd.randint(1, 30)), rnd.choices(letters + "z", k=rnd.randint(0, 60))
        at = rnd.randrange(len(text) + 1)
        text[at:at] = item[: rnd.randint(0, len(item))] * rnd.randint(0, 2)
        items = D.Items([(1, " ".join(item).encode())], 3)
        size = min(3, len(item))
        ids = np.array([items.vocabulary.get(w.encode(), 0) for w in text], np.int64)
        found = [x for _, s, a, b in items.shared(ids) for x in D.tiles(ids, items.tokens[0], s, a, b)]
        left, taken_text, taken_item = plain_tiles(text, item, size), set(), set()
        assert sum(n for _, _, n in found) == left and [n for _, _, n in found] == sorted((n for _, _, n in found), reverse=True)
        for t, i, n in found:
            assert text[t : t + n] == item[i : i + n] and n >= size and not taken_text & set(range(t, t + n)) and not taken_item & set(range(i, i + n))
            taken_text |= set(range(t, t + n))
            taken_item |= set(range(i, i + n))


def test_repeated_words_take_room_in_proportion():
    import tracemalloc

    item, text = b"na " * 2000, b"na " * 20000
    shuffled = b" ".join(random.Random(2).choices([b"na", b"no"], k=2000))
    longer = b" ".join(random.Random(3).choices([b"na", b"no"], k=20000))
    items = D.Items([(1, item), (2, shuffled)])
    tracemalloc.start()
    assert [(i, round(share, 6)) for i, share, *_ in D.covered(items, text)] == [(1, 1.0)]
    found = {i: share for i, share, *_ in D.covered(items, longer)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[2] > 0.8 and peak < 64 << 20

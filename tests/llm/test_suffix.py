import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np

from trendloom.llm import queries
from trendloom.llm import suffix as S


def test_suffix_array_and_prefixes():
    rnd = random.Random(1)
    for n in (1, 2, 9, 300):
        for alphabet in (b"a", b"ab", b"\0a", bytes(range(256))):
            text = bytes(rnd.choices(alphabet, k=n))
            raw = np.frombuffer(text, np.uint8)
            order = S.suffix_array(raw)
            assert list(order) == sorted(range(n), key=lambda i: text[i:])
            cuts = sorted({0, n, *rnd.choices(range(n + 1), k=3)})
            got = S.kasai(raw, order, np.array(cuts[:-1]), np.array(cuts[1:]), 40)
            for k in range(1, n):
                a, b = text[order[k] :], text[order[k - 1] :]
                m = 0
                while m < min(len(a), len(b), 40) and a[m] == b[m]:
                    m += 1
                assert got[k] == m


def plain(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        left = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus(length):
    rnd = random.Random(length)
    make = lambda n: "".join(rnd.choices("abcdé ", k=n))
    passage, line = make(3 * length), make(2 * length)
    texts = [None, "", "short", "a" * (3 * length), "ab" * length, "a" * (length - 1), "a" * length]
    for i in range(40):
        body = make(rnd.randint(1, 6 * length))
        if i % 3 == 0:
            body = body + passage[rnd.randint(0, length) : rnd.randint(2 * length, 3 * length)] + make(50)
        if i % 4 == 0:
            body = line[: rnd.randint(length - 2, 2 * length)] + make(3) + body
        texts.append(body)
        if i % 7 == 0:
            texts += [body, body[: len(body) // 2] + "X" + body[len(body) // 2 :]]
    return texts


def test_removal_against_brute_force(spark):
    for length, gram, shard, spread in ((40, 16, 1024, 8), (40, 24, 3, 8), (40, 24, 3, 1), (400, 160, 2, 1), (400, 160, 1024, 8)):  # spread 1: digests of windows
        texts = corpus(length)
        docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, th string, a int")
        got = {r.doc_id: tuple(r)[1:] for r in S.per_document(docs, length, gram, shard, spread).collect()}
        want = plain([(t or "").encode() for t in texts], length)
        assert [got[i] for i in range(len(texts))] == want
    assert S.per_document(docs.limit(0)).count() == 0


def plain_shared(texts, words):
    """By all windows: words in passages that another row holds, and the longest run of them."""
    lists = [re.findall(rb"[^\x20\x09-\x0D]+", t.lower()) for t in texts]
    rows = {}
    for i, w in enumerate(lists):
        for j in range(len(w) - words + 1):
            rows.setdefault(tuple(w[j : j + words]), set()).add(i)
    out = []
    for w in lists:
        got = [False] * len(w)
        for j in range(len(w) - words + 1):
            if len(rows[tuple(w[j : j + words])]) > 1:
                got[j : j + words] = [True] * words
        size = [len(list(g)) for x, g in itertools.groupby(got) if x]
        out.append((sum(size), max(size, default=0)))
    return out


def word_corpus(words):
    rnd = random.Random(words)
    make = lambda n: " ".join("".join(rnd.choices("abé", k=rnd.randint(1, 4))) for _ in range(n))
    passage, line = make(3 * words).split(), make(words + 2)
    texts = [None, "", " \n", "a " * (3 * words), "b a " * words, make(words - 1), make(words), "A\t" * words, line, line, (make(words) + "\n") * 3]
    for i in range(40):
        parts = [make(rnd.randint(1, 4 * words))]
        if i % 3 == 0:
            at = rnd.randint(0, words)
            parts.append(rnd.choice([" ", "\n"]).join(passage[at : at + rnd.randint(words - 1, 2 * words)]))
        if i % 4 == 0:
            parts += [line.upper() if i % 8 else line, make(3), line]
        if i % 5 == 0:
            parts += parts[:1] * 2
        texts.append("\n".join(parts))
        if i % 7 == 0:
            texts += [texts[-1], texts[-1] + " end"]
    return texts


def test_passages_shared_by_documents_against_all_windows(spark):
    for words, gram, shard, spread in ((8, 3, 1024, 8), (8, 3, 3, 8), (8, 3, 3, 1), (8, 3, 2, 1), (51, 12, 1024, 8)):
        texts = word_corpus(words)
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        got = {r.doc_id: tuple(r)[1:] for r in S.per_document(docs, 40, 16, shard, spread, words, gram).collect()}
        whole = [(t or "").encode() for t in texts]
        assert [got[i][:4] for i in range(len(texts))] == plain(whole, 40)
        assert [got[i][4:] for i in range(len(texts))] == plain_shared(whole, words)
        assert 0 < sum(x > 0 for *_, x in got.values()) < len(texts)


def test_the_query_shows_a_shared_passage_of_over_50_words_below_the_removed_length(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(55))
    texts = [f"one begins {passage} and ends", f"two {passage.upper()}", "three " + " ".join(passage.split()[:50]), f"four {'again ' * 90}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op3_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert [rows[i].n_removed for i in range(3)] == [0, 0, 0]
    assert [(rows[i].n_shared_words, rows[i].longest_shared_words) for i in range(4)] == [(55, 55), (55, 55), (0, 0), (0, 0)]


def test_stretches_of_words_taken_side_by_side_are_those_of_each_text():
    texts = [(t or "").encode() for t in word_corpus(8)]
    side = list(zip(*(x.tolist() for x in S.word_stretches(texts, 8, 3))))
    assert side == [(i, *row) for i, t in enumerate(texts) for row in list(zip(*(x.tolist() for x in S.word_stretches([t], 8, 3)[1:])))]
    assert {(i, j) for i, _, _, lo, hi in side for j in range(lo, hi + 1)} <= {(i, j) for i, t in enumerate(texts) for j in range(len(t.split()) - 7)}

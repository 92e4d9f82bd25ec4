"""Repetition inside a text: suffix arrays and prefix intervals against all windows, and the edge cases of the rules."""

import random

from trendloom.llm import quality


def brute(words, least, window=3):
    n = len(words)

    def twice(m):
        at = {}
        for i in range(n - m + 1):
            at.setdefault(tuple(words[i : i + m]), []).append(i)
        return [v for v in at.values() if len(v) > 1]

    again = {i + j for v in twice(window) for i in v for j in range(window)}
    longest = maximal = 0
    covered = set()
    for m in range(1, n):
        if not (found := twice(m)):
            break
        longest = m
        for v in found if m >= least else []:
            covered |= {i + j for i in v for j in range(m)}
            before = {(words[i - 1], 0) if i else ("", 1) for i in v}
            after = {(words[i + m], 0) if i + m < n else ("", 1) for i in v}
            maximal += len(before) > 1 and len(after) > 1
    spans = []
    for i in sorted(covered):
        if spans and spans[-1]["last"] == i - 1:
            spans[-1]["last"] = i
        else:
            spans.append({"first": i, "last": i})
    return len(again), longest, maximal, spans


def test_batches_of_small_texts_equal_brute_force():
    draw = random.Random(5)
    for _ in range(150):
        texts = [[b"w%d" % draw.randrange(draw.choice([1, 2, 3, 8])) for _ in range(draw.randint(0, 40))] for _ in range(draw.randint(1, 6))]
        for least in (2, 5):
            assert quality.repeats(texts, least) == [brute(words, least) for words in texts]


def test_one_word_repeated_many_times_is_one_span():
    n = 200_000
    ((again, longest, maximal, spans),) = quality.repeats([[b"a"] * n])
    assert (again, longest, maximal, spans) == (n, n - 1, n - quality.LEAST, [{"first": 0, "last": n - 1}])


def prose(draw, n):
    return " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(n))


def test_verdicts_and_edge_cases(spark):
    draw = random.Random(1)
    clean, passage = prose(draw, 200), prose(draw, 60)
    rows = [
        (1, clean, 7), (2, None, 7), (3, "", 7), (4, "few words #", 7), (5, "again and " * 60, 7), (6, f"{prose(draw, 900)} {passage} x {passage}", 7),
        (None, clean, 7), (1, clean, 7), (8, "\n".join([clean, "é ü", "é ü", "  ", "  "]), 7),
    ]
    got = quality.profile(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 9 and by[1].kept and by[None].kept and not by[1].base_failed
    assert [(by[i].n_words, by[i].base_failed, by[i].kept) for i in (2, 3, 4)] == [(0, True, False), (0, True, False), (3, True, False)]
    assert by[4].n_symbols == 1 and by[4].word_chars == 9
    assert by[5].base_failed and not by[5].kept and by[5].n_covered == 120
    assert not by[6].base_failed and not by[6].kept and by[6].longest_repeat == 60  # a long repeat alone is enough
    assert [(s.first, s.last) for s in by[6].spans] == [(900, 959), (961, 1020)]
    assert by[8].n_dup_lines == 1 and by[8].word_chars == by[1].word_chars + 4


def test_empty_table(spark):
    assert quality.per_document(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_arrays_hold_whole_texts_beyond_a_batch(spark, monkeypatch):
    monkeypatch.setattr(quality, "BATCH", 50)
    text = prose(random.Random(2), 120)
    got = quality.per_document(spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string").coalesce(1)).collect()
    assert [(r.n_words, r.kept, r.n_covered) for r in got] == [(120, True, 0)] * 5

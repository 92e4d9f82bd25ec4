"""Spans of terms and topics against regular expressions, one term after the other."""

import random
import re

import pytest

from trendloom.operators import spans as S


def by_regex(text, terms, by_ends=False):
    found = []
    for term in dict.fromkeys(terms):
        pattern = r"\s+".join(re.escape(p) for p in term.split())
        word = "A-Za-z0-9_" if by_ends else "A-Za-z0-9"
        edge = lambda ch: ch.isascii() and ch.isalnum()
        if edge(term[0]) if by_ends else term.isascii():
            pattern = f"(?<![{word}])" + pattern
        if edge(term[-1]) if by_ends else term.isascii():
            pattern += f"(?![{word}])"
        found += [(m.start(), m.end(), term) for m in re.finditer(pattern, text, re.IGNORECASE)]
    return found


def longest(found):
    out, reach = [], -1
    for m in sorted(set(found), key=lambda m: (m[0], -m[1])):
        if m[0] >= reach:
            out.append(m)
            reach = m[1]
    return out


def test_automaton_equals_one_regex_a_term():
    draw = random.Random(7)
    pieces = ["battery", "Battery", " life", "life", " ", "  ", "\n", "é", "É", "_", "9", "-", "ab", "aba", "b a", "ß"]
    terms = ["battery", "battery life", "life", "aba aba", "ab", "é", "é-life", "b a", "-life", "ß"]
    for _ in range(3000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 12)))
        for by_ends in (False, True):
            machine = S.Terms(terms, by_ends)
            assert sorted(machine.all(text)) == sorted(by_regex(text, terms, by_ends)), text
            assert machine.longest(text) == longest(by_regex(text, terms, by_ends))


def test_letters_with_longer_lower_case_keep_their_places():
    assert S.Terms(["token"]).longest("İİ token") == [(3, 8, "token")]


CATALOG = [
    {"id": "toy", "label": "Toys", "aliases": [{"text": "squishy", "context_any": ["toy", "soft"], "exclude_any": ["recipe"]}]},
    {"id": "phone", "label": "Phones", "aliases": [{"text": "phone"}, {"text": "smart phone"}]},
]


def test_contexts_must_be_near_and_exclusions_may_not():
    t = S.Topics(CATALOG)
    assert t.spans("unsquishy toy") == []  # inside a longer word
    assert t.spans("squishy " + "x" * 76 + " toy") == []  # one character too far
    assert [s[:4] for s in t.spans("squishy " + "x" * 75 + " toy")] == [("toy", "squishy", 0, 7)]
    assert t.spans("soft squishy recipe") == []
    assert t.spans("soft toy squishy")[0][4] == 2
    assert [s[1:4] for s in t.spans("Smart  Phone")] == [("phone", 7, 12), ("smart phone", 0, 12)]


@pytest.mark.parametrize(
    "bad", [[{"id": "a", "label": "A", "aliases": []}], [{"id": "a", "label": "A", "aliases": [{"text": "x"}]}] * 2, [{"id": i, "label": i, "aliases": [{"text": "X"}]} for i in "ab"], [{"id": "a", "label": "", "aliases": [{"text": "x"}]}]]
)
def test_catalogs_without_ids_labels_or_aliases_of_their_own_are_refused(bad):
    with pytest.raises(ValueError):
        S.check_catalog(bad)


def test_context_needs_one_sentence_or_one_segment(spark):
    rows = [(1, "A phone. It has power", False), (2, "A phone has power", False), (3, "A phone. It has power", True), (4, "phone " + "x" * 180 + " power", False), (5, None, False), (6, "power only", False), (7, "phone only", True)]
    found = S.context_rows(spark.createDataFrame(rows, "id long, body string, timed boolean"), "body", ["phone"], ["power", "PHONE"], "timed")
    got = {r.id: (r.status, r.reason) for r in S.context_status(found, ["id"]).collect()}
    near, far = ("context_present", "same_segment_or_sentence"), ("keyword_only", "context_found_elsewhere")
    unclear = ("unclear", "topic_not_detected")
    assert got == {1: far, 2: near, 3: near, 4: far, 5: unclear, 6: unclear, 7: ("keyword_only", "no_nearby_context_evidence")}


def test_nearest_neighbours_decide_like_all_pairs():
    draw = random.Random(3)
    for _ in range(2000):
        text = "".join(draw.choices(["cat ", "dog ", "xxxxxxxxxxxxxxxxxxxxxxxxxxxx ", "end. "], k=draw.randint(0, 30)))
        a, b = S.Terms(["cat"]).longest(text), S.Terms(["dog"]).longest(text)
        want = any(max(x[1], y[1]) - min(x[0], y[0]) <= 180 and not re.search("[.!?\n]", text[min(x[0], y[0]) : max(x[1], y[1])]) for x in a for y in b)
        assert S.together(text, a, b) == want


def test_candidates_of_a_title():
    got = S.candidates("The #GoPro vs old-school cam, 12 May", frozenset({"cam"}), frozenset({"the"}), frozenset({"vs"}), frozenset({"may"}))
    # "12 May" is a date, "12" has no letter, "cam" is known
    assert {k: v[2] for k, v in got.items()} == {"gopro": "hashtag", "old-school": "word", "old-school cam": "phrase"}


def test_table_functions_keep_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "the MIT\nLicense", ["mit license", "license"], "x"), (2, None, ["a"], "y"), (3, "nothing", None, "z")], "id long, body string, terms array<string>, term_kind string")
    got = S.locate_terms(df, "body", "terms").collect()
    assert [(r.id, r.term, r.start_char, r.end_char, r.quote, r.term_kind) for r in got] == [(1, "mit license", 4, 15, "the MIT\nLicense", "x")]
    spark.udtf.register("locate_terms", S.LocateTerms)
    assert spark.sql("SELECT start_char FROM locate_terms('a token', array('token'))").first()[0] == 2
    assert S.locate_terms(df.limit(0), "body", ["a"]).collect() == []

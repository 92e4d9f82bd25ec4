"""Quality rules by repetition inside a text: suffix arrays over words, and the intervals of their common prefixes.

Words of a batch of texts become symbols that differ between texts, so one suffix array holds many texts and no repeat
crosses them. Suffixes that begin with the same words are neighbours in it. An interval of common prefixes, a run of
neighbours that share at least its length, is a repeated substring; it is maximal if the words before its places differ.
The spans of maximal repeats of ``LEAST`` words or more are united: a text fails if they cover too much of it, or if one is
too long.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import utf8

LEAST = 5  #: words of a repeat that counts
MOST_COVERED = 40  #: percent of the words that repeats may cover
MOST_WORDS = 50  #: words that the longest repeat may have
WINDOW = 3  #: words of the windows of the base rule
MIN_WORDS, MOST_REPEATED = 50, 50  #: base rule: least words, and percent of words in repeated windows
BATCH = 1 << 19  #: words of one suffix array; a longer text has one of its own
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_covered long, longest_repeat long, n_maximal long, spans array<struct<first:long,last:long>>"
)
_KINDS = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
_BLANKS = re.compile(rb"[\x20\x09-\x0D]")


def symbols(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as numbers, equal for equal words of one text only, and the number of each word's text."""
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    ids = np.fromiter((number(w, len(seen)) for words in texts for w in words), np.int64)
    of = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
    return of * max(1, len(seen)) + ids, of


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in the order of what follows them, and the ranks of places by their first 1, 2, 4, ... numbers.

    Only groups of equal beginnings are sorted again, by the rank of what follows these; a group is ranked by its first
    place in the order. A place whose text ends earlier comes first.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    new = np.ones(n, bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank.astype(np.int32)], 1
    while len(at := np.flatnonzero(~(np.append(new[1:], True) & new))):
        places = order[at]
        after = np.where(places + h < n, rank[np.minimum(places + h, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[places]))
        order[at] = places[by]
        group, after = rank[places][by], after[by]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        new[at] = fresh
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        levels.append(rank.astype(np.int32))
        h *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many numbers each place shares with the one before it in ``order``: from the longest beginnings to single numbers."""
    n = len(order)
    p, q = order[1:].copy(), order[:-1].copy()
    out = np.zeros(n, np.int64)
    live = np.arange(n - 1)
    for k in range(len(levels) - 1, -1, -1):
        inside = live[(p[live] < n) & (q[live] < n)]
        same = inside[levels[k][p[inside]] == levels[k][q[inside]]]
        p[same] += 1 << k
        q[same] += 1 << k
        out[same + 1] += 1 << k
    return out


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs left..right of neighbours that share ``length`` numbers, at least ``least`` and as many as can be, each once; and the
    run of every place of ``lcp`` that has so many, else -1.

    Every place looks for the nearest smaller prefix on either side by following the links of those it meets.
    """
    n = len(lcp)
    at = np.flatnonzero(lcp >= least)
    values = np.append(lcp, -1)
    left, right = np.arange(n) - 1, np.arange(n) + 1
    for link in (left, right):
        live = at
        while len(live := live[values[link[live]] >= lcp[live]]):
            link[live] = link[link[live]]
    _, first, number = np.unique(left[at] * (n + 1) + right[at], return_index=True, return_inverse=True)
    run = np.full(n + 1, -1, np.int64)
    run[at] = number
    one = at[first]
    return left[one], right[one] - 1, lcp[one], run


def enclosing(lcp: np.ndarray, run: np.ndarray, left: np.ndarray, right: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For every place of ``order`` the smallest wanted run around it, else -1. Runs lie inside each other or apart."""
    values = np.append(lcp, -1)
    around = lambda lo, hi: np.where(values[lo] >= values[hi], run[lo], run[hi])
    up = np.append(np.where(wanted, np.arange(len(left)), around(left, right + 1)), -1)
    while not np.array_equal(up, nxt := up[up]):
        up = nxt
    n = len(lcp)
    return up[around(np.arange(n), np.arange(1, n + 1))]


def left_maximal(x: np.ndarray, of: np.ndarray, order: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which runs have places with different numbers before them, the beginning of a text being unlike all."""
    n = len(x)
    before = np.where(order > 0, x[order - 1], -1)
    before = np.where((order > 0) & (of[order - 1] == of[order]), before, -1 - order)
    change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]) if n else np.empty(0, np.int64)
    return change[right] != change[left]


def _union(first: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans [first, end), in order of first, that overlap or touch in one text, united."""
    reach = np.maximum.accumulate(end)
    start = np.ones(len(first), bool)
    start[1:] = (first[1:] > reach[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(start)
    return first[head], reach[np.append(head[1:], len(first))[: len(head)] - 1]


def repeats(texts: list[list[bytes]], least: int = LEAST, window: int = WINDOW):
    """Of every text: (words in windows found twice, longest repeat, maximal repeats, spans of united repeats).

    Repeats overlap as they like; spans are in words, last included.
    """
    x, of = symbols(texts)
    n, size = len(x), np.array([len(words) for words in texts], np.int64)
    begin = np.cumsum(size) - size
    order, levels = suffix_array(x)
    lcp = common_prefixes(order, levels)
    del levels
    with_next = np.append(lcp[1:], 0)
    reach = np.empty(n, np.int64)
    reach[order] = np.maximum(lcp, with_next)

    edge = np.zeros(n + window + 1, np.int64)
    hit = np.flatnonzero(reach >= window)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    repeated = np.bincount(of[np.cumsum(edge)[:n] > 0], minlength=len(texts))

    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, of, reach)
    left, right, length, run = intervals(lcp, least)
    whole = left_maximal(x, of, order, left, right)
    maximal = np.bincount(of[order[left[whole]]], minlength=len(texts))
    # runs inside a run share more, so the smallest one around a place has its longest maximal repeat
    inner = enclosing(lcp, run, left, right, whole)
    best = np.zeros(n, np.int64)
    best[order] = np.where(inner >= 0, np.append(length, 0)[inner], 0)
    at = np.flatnonzero(best)
    first, end = _union(at, at + best[at], of[at])
    where = of[first]
    cut = np.searchsorted(where, np.arange(len(texts) + 1))
    spans = [
        [{"first": int(a), "last": int(b) - 1} for a, b in zip(first[i:j] - begin[k], end[i:j] - begin[k])]
        for k, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist()))
    ]
    return list(zip(repeated.tolist(), longest.tolist(), maximal.tolist(), spans))


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _continuations(text: bytes) -> int:
    raw = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((raw & 0xC0) == 0x80))


def profile(docs: DataFrame, least: int = LEAST, most_covered: int = MOST_COVERED, most_words: int = MOST_WORDS) -> DataFrame:
    """One row for each row of ``docs``: base counts, united repeats, and whether the text is kept.

    Texts are compared with themselves alone, so no row moves. A null text is empty and, having under 50 words, fails the base
    rules; a null id stays null; repeated rows have equal values; an empty table gives an empty result; further columns are
    ignored. A text of one repeated word has one maximal repeat that covers it. Texts of any length are read whole.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def judged(ids: list, bodies: list[bytes], texts: list[list[bytes]]) -> pa.RecordBatch:
        out = []
        for key, body, words, (again, longest, maximal, spans) in zip(ids, bodies, texts, repeats(texts, least)):
            n = len(words)
            covered = sum(s["last"] - s["first"] + 1 for s in spans)
            failed = n < MIN_WORDS or 100 * again > MOST_REPEATED * n
            kept = not failed and 100 * covered <= most_covered * n and longest <= most_words
            blanks = len(_BLANKS.findall(body))
            signs = len(body) - len(body.translate(None, SYMBOLS))
            out.append((key, n, len(body) - _continuations(body) - blanks, signs, _duplicate_lines(body), again, failed, kept, covered, longest, maximal, spans))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * len(names), _KINDS)], names)

    def run(batches):
        ids, bodies, texts, size = [], [], [], 0
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = body.split()
                if ids and size + len(words) > BATCH:
                    yield judged(ids, bodies, texts)
                    ids, bodies, texts, size = [], [], [], 0
                ids.append(key)
                bodies.append(body)
                texts.append(words)
                size += len(words)
        if ids:
            yield judged(ids, bodies, texts)

    return docs.select("doc_id", utf8("text").alias("body")).mapInArrow(run, SCHEMA)


def per_document(docs: DataFrame) -> DataFrame:
    """The columns of ``profile`` without its spans."""
    return profile(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered")

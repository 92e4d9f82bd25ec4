"""Benchmark decontamination by greedy string tiling.

Windows of words that a document shares with a test item are the seeds, found by Karp-Rabin hashes. For every document
and item with a shared seed, the longest common run of unmarked words is marked again and again until none of the least
length is left; running Karp-Rabin hashes find its length. The share of the item's words that are marked catches passages in any order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8
from .words import words

LEAST, COVERAGE = 5, 0.8  #: words of the shortest tile, and the least share of an item's words
BLOCK_BYTES = 8 << 20  #: text of test items that goes to the tasks at once; more items are taken block by block
BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of the windows of ``size`` ids that start at ``at``."""
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        h = h * BASE + ids[at + j].astype(np.uint64)
    return h


class Items:
    """Test items as word ids, with the places of their seeds by hash."""

    def __init__(self, rows: list[tuple[int, bytes]], least: int = LEAST):
        self.least, self.vocabulary, self.item_ids, self.tokens = least, {}, [], []
        for item, text in rows:
            seq = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if seq:
                self.item_ids.append(item)
                self.tokens.append(np.array(seq, np.int64))
        self.seeds = {}
        sizes = {min(least, len(t)) for t in self.tokens}
        for size in sizes:
            hashes, items, places = [], [], []
            for k, t in enumerate(self.tokens):
                if min(least, len(t)) == size:
                    at = np.arange(len(t) - size + 1)
                    hashes.append(window_hashes(t, at, size))
                    items.append(np.full(len(at), k))
                    places.append(at)
            h, k, p = (np.concatenate(x) for x in (hashes, items, places))
            order = np.argsort(h, kind="stable")
            self.seeds[size] = (h[order], k[order], p[order])

    def shared(self, ids: np.ndarray, coverage: float = 0.0):
        """(item, window size, places in the text, places in the item) of items that share seeds with the text.

        Places are those at which any shared seed stands, in order; they are not paired, so repeated words take no more room
        than text and items together. Items whose seeds together cover less than ``coverage`` of their words are left out.
        """
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for size, (h, k, p) in self.seeds.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            own = window_hashes(ids, at, size)
            order = np.argsort(own, kind="stable")
            mine, at = own[order], at[order]
            different = mine[np.concatenate([[True], mine[1:] != mine[:-1]])]
            seed = ranges(np.searchsorted(h, different, "left"), np.searchsorted(h, different, "right"))
            if not len(seed):
                continue
            seed = seed[np.argsort(k[seed], kind="stable")]
            for part in np.split(seed, np.flatnonzero(np.diff(k[seed])) + 1):
                item, in_item = int(k[part[0]]), np.sort(p[part])
                if np.count_nonzero(spread(in_item, size, len(self.tokens[item]))) < coverage * len(self.tokens[item]):
                    continue
                values = np.unique(h[part])
                in_text = at[ranges(np.searchsorted(mine, values, "left"), np.searchsorted(mine, values, "right"))]
                yield item, size, np.sort(in_text), in_item


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of the half-open ranges from ``lo`` to ``hi``, one range behind the other."""
    n = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def spread(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words that starts at one of the places."""
    edge = np.zeros(n + size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge)[:n] > 0


#: fixed values: moduli and bases of the running Karp-Rabin hash
PRIMES = ((2147483647, 911382323), (2147483629, 972663749))


class Running:
    """Karp-Rabin hashes of all windows of any length, from sums made once: hash of n words from i on in one step."""

    def __init__(self, ids: np.ndarray):
        self.parts = []
        for prime, base in PRIMES:
            power = lambda b: self._powers(b, len(ids), prime)  # noqa: B023, E731  used in this round only
            sums = np.concatenate([[0], np.cumsum((ids.astype(np.uint64) + 1) % prime * power(base) % prime)]).astype(np.uint64)
            self.parts.append((np.uint64(prime), sums, power(pow(base, -1, prime))))

    @staticmethod
    def _powers(base: int, n: int, prime: int) -> np.ndarray:
        out, k = np.ones(n, np.uint64), 1
        while k < n:
            out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, prime)) % np.uint64(prime)
            k *= 2
        return out

    def windows(self, at: np.ndarray, n: int) -> np.ndarray:
        a, b = ((sums[at + n] - sums[at]) % prime * back[at] % prime for prime, sums, back in self.parts)
        return a << np.uint64(32) | b


def tiles(text: np.ndarray, item: np.ndarray, size: int, in_text: np.ndarray, in_item: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the text, place in the item, words), longest first, none overlapping, from the shared seeds.

    The longest length of which unmarked text and item share a run is found by halving, with running Karp-Rabin hashes. All
    runs of that length are marked in the order of the item, then of the text, each compared word by word first; then
    shorter ones are looked for. Room grows with text and item, not with the pairs of their places. Only words of the
    text in a shared seed are looked at.
    """
    place = np.flatnonzero(spread(in_text, size, len(text)))
    place = np.insert(place, np.flatnonzero(np.diff(place) > 1) + 1, -1)  # a break where words are left out
    short = text[place]
    marked = [place < 0, ~spread(in_item, size, len(item))]
    running = [Running(short), Running(item)]

    def free(side: int, n: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marked[side])])
        return np.flatnonzero(sums[n:] == sums[:-n])

    def hashes(n: int):
        at = [free(side, n) for side in (0, 1)]
        return at, [running[side].windows(at[side], n) for side in (0, 1)]

    def common(n: int) -> bool:
        return bool(np.isin(*reversed(hashes(n)[1])).any())

    out, top = [], min(len(short), len(item))
    while top >= size and common(size):
        n = size
        while n < top:  # common at n, not above top
            half = (n + top + 1) // 2
            n, top = (half, top) if common(half) else (n, half - 1)
        (a, b), (ha, hb) = hashes(n)
        order = np.argsort(ha, kind="stable")
        a, ha = a[order], ha[order]
        lo, hi = np.searchsorted(ha, hb, "left"), np.searchsorted(ha, hb, "right")
        at = {}
        for i, first, end in zip(b[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            if marked[1][i] or marked[1][i + n - 1]:  # tiles have n words or more, so one that overlaps covers an end
                continue
            k = at.get(first, first)
            while k < end and (marked[0][a[k]] or marked[0][a[k] + n - 1]):
                k += 1
            at[first] = k
            if k < end and np.array_equal(short[a[k] : a[k] + n], item[i : i + n]):
                marked[0][a[k] : a[k] + n] = marked[1][i : i + n] = True
                out.append((int(place[a[k]]), i, n))
        top = n - 1
    return out


def covered(items: Items, text: bytes, coverage: float = COVERAGE):
    """(item id, share, marked words, item words, tiles, first word, last word) of items covered to that share."""
    get = items.vocabulary.get
    ids = np.array([get(w, 0) for w in words(text)], np.int64)
    for k, size, in_text, in_item in items.shared(ids, coverage):
        whole = items.tokens[k]
        found = tiles(ids, whole, size, in_text, in_item)
        marked = sum(n for _, _, n in found)
        if marked >= coverage * len(whole):
            yield items.item_ids[k], marked / len(whole), marked, len(whole), len(found), min(t for t, _, _ in found), max(t + n for t, _, n in found) - 1


SCHEMA = "doc_id long, item_id long, coverage double, marked_words long, item_words long, tiles long, first_word long, last_word long"


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """The test items in blocks of bounded size, each collected when it is its turn."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), utf8().alias("text")).where("length(text) > 0")
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = -(-total // limit)
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], bytes(r["text"])) for r in part.orderBy("item_id").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, limit: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and test item whose words are covered to ``coverage`` or more by tiles of ``least`` words.

    Null and empty texts or items match nothing. An item of fewer than ``least`` words counts if it stands in the text
    as a whole. Repeated rows and items repeat their matches. Empty tables give an empty result; other columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), utf8().alias("text"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    parts = []
    for block in blocks(benchmark, limit):

        def run(batches, block=block):
            items = Items(block, least)
            for batch in batches:
                found = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in covered(items, t, coverage)]
                types = [pa.int64(), pa.int64(), pa.float64()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*found) if found else [[]] * 8, types)], [x.split()[0] for x in SCHEMA.split(", ")]
                )

        parts.append(rows.mapInArrow(run, SCHEMA))
    for part in parts:
        out = part if part is parts[0] else out.unionByName(part)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text covers no test item, with all their columns.

    Null and empty texts cover nothing and stay; repeated rows stay or go together; without test items all rows stay.
    """
    for block in blocks(benchmark, limit):

        def clean(texts, block=block, made=[]):  # noqa: B006  the index is made once for each task
            import pandas as pd

            if not made:
                made.append(Items(block, least))
            return pd.Series([next(covered(made[0], t, coverage), None) is None for t in texts], dtype=bool)

        docs = docs.where(F.pandas_udf(clean, "boolean")(utf8()))
    return docs

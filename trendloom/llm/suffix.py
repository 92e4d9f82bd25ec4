"""Exact repeated substrings by suffix arrays, over bytes.

A string of ``LENGTH`` bytes that repeats has the same anchor at the same place in each copy: the window's least hash of
``GRAM`` bytes. So only stretches around anchors that occur more than once can hold repeats. Equal stretches fold into one;
those that share an anchor but differ are dealt into shards, each of which gets a suffix array by Larsson-Sadakane
refinement and common prefixes by Kasai's method, all in numpy. An anchor with too many different stretches is spread over
several shards, whose suffix arrays are then merged pair by pair by binary search. Pairs grow with the square of the shards, so
beyond ``SPREAD`` shards the windows of an anchor are counted by 128-bit digests instead, in work in proportion to their number.

The same steps find passages of ``WORDS`` words that stand in more than one document, whatever their length in bytes, case of
A-Z and white space: there a text is the sequence of its words' 64-bit hashes, and windows, grams, suffix arrays and prefixes
count words. The lowest bit of an anchor's hash is 1 for words and 0 for bytes, so both kinds share the shuffles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, partitions_for, sorted_groups, utf8

LENGTH, GRAM = 400, 160
WORDS, WORD_GRAM = 51, 12
CHUNK = 1 << 17  #: bytes of texts of which the words are taken side by side
SHARD = 1024  #: different stretches of one anchor in a shard at most
SPREAD = 8  #: shards of one anchor that are merged pair by pair at most
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_POWERS = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def running(raw: np.ndarray) -> np.ndarray:
    """Sums of which the differences, divided by a power, are hashes of what lies between."""
    global _POWERS
    n = len(raw)
    if len(_POWERS[0]) < n:
        _POWERS = (powers(_BASE, n), powers(_INVERSE, n))
    sums = np.zeros(n + 1, np.uint64)
    x = np.add(raw, 1, dtype=np.uint64)
    x *= _POWERS[0][:n]
    np.cumsum(x, out=sums[1:])
    return sums


def gram_hashes(sums: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` units from every place on, from their running sums."""
    h = sums[gram:] - sums[:-gram]
    h *= _POWERS[1][: len(h)]
    return mixed(h)


def range_hashes(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the units of each [first, end), from their running sums."""
    return mixed((sums[end] - sums[first]) * _POWERS[1][first])


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The starts of words between white space, and a 64-bit hash of every word, A-Z lower-cased."""
    raw = np.frombuffer(text.lower(), np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = (raw - np.uint8(9) < 5) | (raw == 32)
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], range_hashes(running(raw), edge[::2], edge[1::2])


def word_hashes(text: bytes) -> np.ndarray:
    return word_places(text)[1]


def anchors(sums: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all grams, and the place of its anchor for each window of ``length``.

    A window's anchor is its gram of the least 33-bit hash, the first of equals, which depends on its units alone.
    """
    h = gram_hashes(sums, gram)
    key = h >> np.uint64(31)
    key <<= np.uint64(31)
    key |= np.arange(len(h), dtype=np.uint64)
    return h, (sliding_min(key, length - gram + 1) & np.uint64(2**31 - 1)).astype(np.int64)


def stretches(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, first start, last start) of runs of starts whose windows of ``length`` have the same anchor."""
    n = len(text) - length + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    h, chosen = anchors(running(np.frombuffer(text, np.uint8)), length, gram)
    first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
    last = np.append(first[1:], n) - 1
    return h[chosen[first]].view(np.int64), first, last


def word_stretches(texts: list[bytes], words: int = WORDS, gram: int = WORD_GRAM):
    """(text, anchor hash, hash of all words, first start, last start) of the stretches of words of some texts, taken side by side.

    Of stretches of the same words only the first in a text is given.
    """
    begins, units = word_places(b"\n".join(texts))
    n = len(units) - words + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 5
    bound = np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    of = np.repeat(np.arange(len(texts)), np.diff(bound))
    sums = running(units)
    h, chosen = anchors(sums, words, gram)
    first = np.concatenate([[0], np.flatnonzero((chosen[1:] != chosen[:-1]) | (of[1:n] != of[: n - 1]) | (of[words:] != of[words - 1 : -1])) + 1])
    last = np.append(first[1:], n) - 1
    inside = of[first] == of[first + words - 1]  # other windows reach into the next text
    first, last = first[inside], last[inside]
    text, ctx = of[first], range_hashes(sums, first, last + words).view(np.int64)
    order = np.lexsort((ctx, text))
    t, c = text[order], ctx[order]
    pick = order[np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])[: len(order)]]
    text, first, last = text[pick], first[pick], last[pick]
    return text, h[chosen[first]].view(np.int64), ctx[pick], first - bound[text], last - bound[text]


def words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one number that sorts like them; zero bytes behind the end."""
    x = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(raw)
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out |= x[j : j + n] << np.uint64(56 - 8 * j)
    return out


def steps(raw: np.ndarray) -> tuple[np.ndarray, int]:
    """What begins at every place as one number, and how many units it holds: 8 bytes or one word."""
    return (words_at(raw), 8) if raw.dtype == np.uint8 else (raw, 1)


def suffix_array(raw: np.ndarray) -> np.ndarray:
    """Places in the order of what follows them; needs fewer than 2 ** 21 units.

    Larsson and Sadakane's refinement: places start in groups of equal 8 bytes (one word); only groups of more than one are
    sorted again, by the rank of the place ``h`` further on, and h doubles until all groups are single.
    """
    n = len(raw)
    first, h = steps(raw)
    order = np.argsort(first, kind="stable")
    new = np.ones(n, bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        at = np.flatnonzero(~(np.append(new[1:], True) & new))
        if not len(at):
            return order
        places = order[at]
        # of places whose 8 bytes reach beyond the end, the one with fewer bytes comes first; later rounds build on that
        after = np.where(places + h < n, rank[np.minimum(places + h, n - 1)] + 9, np.minimum(n - places, 8))
        packed = np.sort(rank[places] << 42 | after << 21 | places)
        order[at] = packed & (2**21 - 1)
        group = packed >> 21
        fresh = np.ones(len(at), bool)
        fresh[1:] = group[1:] != group[:-1]
        new[at] = fresh
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        h *= 2


def kasai(raw: np.ndarray, order: np.ndarray, begins: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix, up to ``limit``, of each place in ``order`` with the one before it.

    Kasai's method: going from a place to the next in the text, the common prefix shrinks by one at most. Stretches
    [begins, ends) of the text take their steps side by side.
    """
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    common = np.zeros(n, np.int64)
    size, place, live = np.zeros(len(begins), np.int64), begins.copy(), np.flatnonzero(begins < ends)
    while len(live):
        p = place[live]
        q = before[p]
        most = np.where(q >= 0, np.minimum(limit, n - np.maximum(p, q)), 0)
        now = np.minimum(np.maximum(size[live] - 1, 0), most)
        grow = np.flatnonzero(now < most)
        while len(grow):
            grow = grow[raw[p[grow] + now[grow]] == raw[q[grow] + now[grow]]]
            now[grow] += 1
            grow = grow[now[grow] < most[grow]]
        common[p] = size[live] = now
        place[live] += 1
        live = live[place[live] < ends[live]]
    return common[order]


class Shard:
    """Some stretches with their suffix array, reduced to the starts that have ``length`` units in their stretch.

    What begins in stretches of one owner only is no repeat; without ``owners`` each stretch is its own.
    """

    def __init__(self, texts: list[bytes], length: int, owners: np.ndarray | None = None, unit: type = np.uint8):
        self.length = length
        sizes = np.array([len(t) // np.dtype(unit).itemsize for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.raw = np.frombuffer(b"".join(texts), unit)
        order = suffix_array(self.raw)
        common = kasai(self.raw, order, self.begins, self.ends, length)
        group = np.cumsum(common < length)  # places of one group begin the same units
        room = (np.repeat(self.ends, sizes) - np.arange(len(self.raw)) >= length)[order]
        self.order = order[room]
        self.firsts = np.flatnonzero(np.diff(group[room], prepend=-1))
        self.group = np.repeat(np.arange(len(self.firsts)), np.diff(np.append(self.firsts, len(self.order))))
        self.owner = np.repeat(np.arange(len(texts)) if owners is None else owners, sizes)[self.order]
        self.hit = np.zeros(len(self.raw), bool)

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest owner of each group."""
        if not len(self.firsts):
            return self.firsts, self.firsts
        return np.minimum.reduceat(self.owner, self.firsts), np.maximum.reduceat(self.owner, self.firsts)

    def mark_own(self) -> None:
        least, most = self.owners()
        self.hit[self.order[(least != most)[self.group]]] = True

    def merge(self, other: "Shard") -> None:
        """Mark what begins here and in ``other``: a binary search of other's starts in this suffix array."""
        (mine, step), (theirs, _) = steps(self.raw), steps(other.raw)
        query = other.order
        lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(self.order))
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) // 2
            less = _compare(mine, theirs, self.order[mid], query[live], self.length, step) < 0
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        at = np.flatnonzero(lo < len(self.order))
        at = at[_compare(mine, theirs, self.order[lo[at]], query[at], self.length, step) == 0]
        least, most = self.owners()
        group, owner = self.group[lo[at]], other.owner[at]
        other.hit[query[at[(least[group] != owner) | (most[group] != owner)]]] = True
        least, most = np.full(len(self.firsts), np.iinfo(np.int64).max), np.full(len(self.firsts), -1)
        np.minimum.at(least, group, owner)
        np.maximum.at(most, group, owner)
        least, most = least[self.group], most[self.group]
        self.hit[self.order[(most >= 0) & ((least != self.owner) | (most != self.owner))]] = True

    def marks(self) -> list[np.ndarray]:
        """For each stretch, which of its starts are marked."""
        return [self.hit[b : max(b, e - self.length + 1)] for b, e in zip(self.begins, self.ends)]


def _compare(mine, theirs, p, q, length: int, step: int) -> np.ndarray:
    """-1, 0 or 1: the order of ``length`` units from p in mine against those from q in theirs."""
    out = np.zeros(len(p), np.int8)
    tie = np.arange(len(p))
    for at in [*range(0, length - step + 1, step), *([length - step] if length % step else [])]:
        a, b = mine[p[tie] + at], theirs[q[tie] + at]
        out[tie] = np.where(a < b, -1, np.where(a > b, 1, 0))
        tie = tie[a == b]
        if not len(tie):
            break
    return out


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def text_id() -> F.Column:
    return F.unhex(F.substring(F.sha2(utf8("text"), 256), 1, 32))


def in_words() -> F.Column:
    return F.col("a").bitwiseAND(1) == 1


def occurrences(docs: DataFrame, length: int, gram: int, words: int | None, word_gram: int) -> DataFrame:
    """(th, a, ctx, lo, hi): the stretches of every text, with the hashes of their anchor and of all their units."""
    names = ["th", "a", "ctx", "lo", "hi"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def of_bytes(text):
        a, lo, hi = stretches(text, length, gram)
        ctx = [hashlib.blake2b(text[i : j + length], digest_size=8).digest() for i, j in zip(lo.tolist(), hi.tolist())]
        return a & ~1, np.frombuffer(b"".join(ctx), "<i8"), lo, hi

    def of_words(texts):
        held, size = [], 0
        for i, text in enumerate(texts):
            if len(text) >= 2 * words - 1:
                held.append(i)
                size += len(text)
            if held and (size > CHUNK or i + 1 == len(texts)):
                which, a, *rest = word_stretches([texts[j] for j in held], words, word_gram)
                yield np.array(held)[which], a | 1, *rest
                held, size = [], 0

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                found = [(np.full(len(x[0]), i), *x) for i, x in enumerate(map(of_bytes, texts))] + list(of_words(texts) if words else [])
                which, *cols = (np.concatenate(c) for c in zip(*found))
                th = part.column(0).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([th, *(pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(cols, types))], names)

    rows = docs.select(text_id().alias("th"), utf8("text").alias("body"))
    return rows.mapInArrow(run, "th binary, a long, ctx long, lo int, hi int")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(th, body, copies): every different text once, compressed, since it is dealt out by its id, and its rows."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(t) for t in batch.column(1).to_pylist()], pa.binary())], ["th", "body"])

    rows = docs.select(text_id().alias("th"), utf8("text").alias("body")).mapInArrow(run, "th binary, body binary")
    # the filter, and reading all columns, keep both uses of this table alike, so that it is dealt out once
    return rows.where("th is not null").groupBy("th").agg(F.first("body").alias("body"), F.count("*").alias("copies"))


def cut_out(texts: DataFrame, wanted: DataFrame, length: int, words: int | None) -> DataFrame:
    """The bytes, or hashes of the words, of wanted stretches: (a, ctx, k, once, th, lo, bytes)."""
    schema = "a long, ctx long, k long, once boolean, th binary, lo int, bytes binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.binary()]

    def cut(body, want):
        units = word_hashes(body) if any(w["a"] & 1 for w in want) else None
        return [units[w["lo"] : w["hi"] + words].tobytes() if w["a"] & 1 else body[w["lo"] : w["hi"] + length] for w in want]

    def run(batches):
        unsqueeze = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [
                    (w["a"], w["ctx"], w["k"], w["once"], th, w["lo"], found)
                    for th, body, want in zip(*(part.column(i).to_pylist() for i in range(3)))
                    for w, found in zip(want, cut(unsqueeze(body), want))
                ]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names)

    lists = wanted.groupBy("th").agg(F.collect_list(F.struct("a", "ctx", "k", "once", "lo", "hi")).alias("want"))
    return texts.join(lists, "th").select("th", "body", "want", "copies").mapInArrow(run, schema)


MARK = "th binary, w boolean, lo int, hi int"


def shard_marks(cut: DataFrame, length: int, words: int | None, shard: int, target: int = 1 << 20) -> DataFrame:
    """(th, w, lo, hi): runs of repeated starts in stretches that occur once as a whole but share an anchor with others."""
    subs = F.ceil(F.col("k") / shard).cast("long")
    own = F.pmod("ctx", subs)
    t = F.when(subs == 1, F.array(F.lit(-1).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), subs - 1), lambda o: F.least(own, o) * (1 << 20) + F.greatest(own, o))
    )
    rows = cut.select("a", F.explode(t).alias("t"), own.alias("own"), "once", "th", "lo", "bytes")
    rows = rows.repartition(partitions_for(cut), "a", "t").sortWithinPartitions("a", "t", "own")

    def emit(found):
        types = [pa.binary(), pa.bool_(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found) if found else [[]] * 4, types)], ["th", "w", "lo", "hi"])

    def of(rows, masks, word):
        return [(r[2], bool(word), r[3] + i, r[3] + j) for r, mask in zip(rows, masks) if r[1] for i, j in runs(mask)]

    def owners(rows, word):
        """A text owns its stretches of words; one of bytes, or that stands for several texts, is its own."""
        ids = {}
        return np.array([ids.setdefault(r[2] if word and r[1] else i, len(ids)) for i, r in enumerate(rows)])

    def make(rows, owner, word):
        return Shard([r[4] for r in rows], words if word else length, owner, np.uint64 if word else np.uint8)

    def flush(held, word):
        if not held:
            return emit([])
        one = make(held, owners(held, word), word)
        one.mark_own()
        return emit(of(held, one.marks(), word))

    def run(batches):
        held, size = [[], []], [0, 0]  # of bytes and of words
        for group_rows in sorted_groups(batches, ["a", "t"]):
            a, t = group_rows.column("a").to_numpy(), group_rows.column("t").to_numpy()
            cut_at = np.flatnonzero((np.diff(a) != 0) | (np.diff(t) != 0)) + 1
            for lo, hi in zip([0, *cut_at], [*cut_at, len(a)]):
                part, word = group_rows.slice(lo, hi - lo), int(a[lo] & 1)
                rows = list(zip(*(part.column(c).to_pylist() for c in ("own", "once", "th", "lo", "bytes"))))
                if t[lo] >= 0 and t[lo] >> 20 != t[lo] & (2**20 - 1):  # two shards of one anchor: merge them
                    owner, here = owners(rows, word), np.array([r[0] == t[lo] >> 20 for r in rows])
                    left, right = ([r for r, x in zip(rows, side) if x] for side in (here, ~here))
                    if left and right:
                        x, y = make(left, owner[here], word), make(right, owner[~here], word)
                        x.merge(y)
                        yield emit(of(left, x.marks(), word) + of(right, y.marks(), word))
                    continue
                more = sum(len(r[4]) for r in rows) // (8 if word else 1)
                if size[word] + more > target:
                    yield flush(held[word], word)
                    held[word], size[word] = [], 0
                held[word] += rows
                size[word] += more
        for word in (0, 1):
            yield flush(held[word], word)

    return rows.mapInArrow(run, MARK)


def window_marks(cut: DataFrame, length: int, words: int | None) -> DataFrame:
    """(th, w, lo, hi): starts of windows that begin elsewhere as well, for anchors with too many different stretches for pairs of shards.

    A start lies in one stretch only, and no window occurs twice in a stretch, so a digest counted twice is a repeat;
    of words, one that is counted in two texts.
    """
    rows = keep(cut)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                w, once, th, lo, body = (part.column(c).to_pylist() for c in ("w", "once", "th", "lo", "bytes"))
                step = [8 if x else 1 for x in w]
                size = [8 * words if x else length for x in w]
                n = [(len(b) - z) // s + 1 for b, s, z in zip(body, step, size)]
                found = b"".join(
                    hashlib.blake2b(b[i : i + z], digest_size=16).digest() for b, m, s, z in zip(body, n, step, size) for i in range(0, m * s, s)
                )
                x = np.frombuffer(found, np.int64).reshape(-1, 2)
                of = np.repeat(np.arange(len(n)), n)
                begin = np.concatenate([np.arange(i, i + m, dtype=np.int32) for i, m in zip(lo, n)]) if n else np.empty(0, np.int32)
                flags = [pa.array(np.array(c, bool)[of]) for c in (w, once)]
                cols = [pa.array(x[:, 0]), pa.array(x[:, 1]), *flags, pa.array(th, pa.binary()).take(pa.array(of)), pa.array(begin)]
                yield pa.RecordBatch.from_arrays(cols, ["x", "y", "w", "once", "th", "lo"])

    windows = rows.select(in_words().alias("w"), "once", "th", "lo", "bytes").mapInArrow(run, "x long, y long, w boolean, once boolean, th binary, lo int")
    met = windows.groupBy("w", "x", "y").agg(F.count("*").alias("n"), F.min("th").alias("least"), F.max("th").alias("most"), F.min("once").alias("once"))
    again = keep(met.where("n > 1 and (not w or not once or least < most)").select("w", "x", "y"))
    return windows.where("once").join(again, ["w", "x", "y"]).select("th", "w", "lo", F.col("lo").alias("hi"))


DIGEST = "th binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SHARED = ["n_shared_words", "longest_shared_words"]


def removal(n: int, marks: list, length: int) -> np.ndarray:
    """Which of ``n`` units a marked window covers."""
    edge = np.zeros(n + 1, np.int64)
    for m in marks:
        edge[m["lo"]] += 1
        edge[m["hi"] + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def shared_words(text: bytes, copies: int, marks: list, words: int) -> tuple[int, int]:
    """Words in passages of ``words`` or more that other documents hold too, and the longest run of them.

    ``marks`` name the first of equal windows of the text; the others are found by their hashes.
    """
    if copies == 1 and not marks:
        return 0, 0
    units = word_hashes(text)
    if copies > 1 or len(units) < words:
        n = len(units) if len(units) >= words else 0
        return n, n
    windows = gram_hashes(running(units), words)
    marked = removal(len(windows), marks, 1)
    starts = runs(np.isin(windows, windows[marked]))
    size = [j - i + 1 for i, j in runs(removal(len(units), [{"lo": i, "hi": j} for i, j in starts], words))]
    return sum(size), max(size)


def digests(texts: DataFrame, length: int, words: int | None) -> DataFrame:
    """(th, the contract's columns, those of shared words): from (th, body, marks, copies)."""
    schema = ", ".join([DIGEST, *(f"{c} long" for c in SHARED)])
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        unsqueeze = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for th, body, marks, copies in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text, of = unsqueeze(body), ([], [])
                for m in marks or []:
                    of[m["w"]].append(m)
                shared = shared_words(text, copies, of[1], words) if words else (0, 0)
                if not of[0]:
                    out.append((th, len(text), 0, 0, hashlib.sha256(text).hexdigest(), *shared))
                    continue
                gone = removal(len(text), of[0], length)
                left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((th, len(text), int(gone.sum()), len(runs(gone)), hashlib.sha256(left).hexdigest(), *shared))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names)

    return texts.select("th", "body", "marks", "copies").mapInArrow(run, schema)


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, spread: int = SPREAD, words: int | None = None, word_gram: int = WORD_GRAM
) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (th, body, copies), and (th, w, lo, hi): runs of starts of windows that also begin elsewhere.

    w is true for windows of words that also begin in another text, of which the first in a text is given.
    """
    found = keep(occurrences(docs, length, gram, words, word_gram))
    # the sums are kept as tables, so that a join with them can split the rows of a frequent anchor or stretch
    again = keep(found.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"))
    seen = keep(found.join(again, "a", "left_semi"))  # most anchors occur once: nothing else moves their stretches
    folded = seen.groupBy("a", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("th", "lo", "hi")).alias("rep"), F.max("th").alias("last"))
    many = F.when(in_words(), F.col("rep.th") < F.col("last")).otherwise(F.col("n") > 1)
    whole = keep(folded.select("a", "ctx", "rep", "last", (~many).alias("once")))
    copied = seen.join(whole.where("not once").select("a", "ctx"), ["a", "ctx"]).select("th", in_words().alias("w"), "lo", "hi").distinct()
    kinds = whole.groupBy("a").agg(F.count("*").alias("k"), F.min("rep.th").alias("least"), F.max("last").alias("most"))
    mixed = whole.join(keep(kinds.where((F.col("k") > 1) & (~in_words() | (F.col("least") < F.col("most")))).select("a", "k")), "a")
    wanted = keep(mixed.select("a", "ctx", "k", "once", "rep.th", "rep.lo", "rep.hi"))
    texts = distinct_texts(docs)
    spans = copied.unionByName(shard_marks(cut_out(texts, wanted.where(F.col("k") <= spread * shard), length, words), length, words, shard))
    hot = wanted.where(F.col("k") > spread * shard)
    return texts, spans if hot.isEmpty() else spans.unionByName(window_marks(cut_out(texts, hot, length, words), length, words))


def per_document(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, spread: int = SPREAD, words: int | None = None, word_gram: int = WORD_GRAM
) -> DataFrame:
    """One row for each row of ``docs``: bytes, removed bytes, removed runs, and the digest of what is left.

    Null texts are empty. Copies, repeated rows included, count as elsewhere for each other, so texts of ``length`` or
    more that occur twice go as a whole; equal texts have equal values. Texts shorter than ``length`` stay. An empty
    table gives an empty result; other columns are ignored.

    With ``words`` two columns follow: the words in passages of that many words or more that another row holds too, A-Z
    lower-cased and parted by any white space, and how many the longest run of them has. They do not change what is removed.
    """
    texts, spans = repeated_spans(docs, length, gram, shard, spread, words, word_gram)
    marks = spans.groupBy("th").agg(F.collect_list(F.struct("w", "lo", "hi")).alias("marks"))
    by_text = digests(texts.join(marks, "th", "left"), length, words)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(SHARED if words else [])]
    return docs.select("doc_id", text_id().alias("th")).join(by_text, "th").select(*columns)

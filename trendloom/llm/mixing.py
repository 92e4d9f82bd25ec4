"""Language-model scores by online logistic context mixing.

Bytes are coded as paths in the Huffman tree of the byte before them, so a byte is a few binary decisions. For each of some
orders there is a table of slots, hashed from the last bytes and the tree node, that predicts the bit; the slots are counted over all training texts, and
the tables grow with them up to ``MOST`` bits. In each document the predictions are combined in the logistic domain by weights,
which a gate picks by the confidence of the two longest orders. The weights start from constants, so no part of the texts stands for
the others, and are refined online: each step of ``STEP`` bytes is predicted with the weights learned
from the steps before it. A last stage adapts, in every document, an offset for each range of the mixed prediction. The score
is the total of the bits' log10 probabilities.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, keep, materialize, partitions_for, utf8

ORDERS, LESS = (3, 4, 6), (4, 2, 0)  #: bytes of context, and by how many bits an order's table is smaller than the largest
LEAST, MOST, BLOCK_BITS = 16, 26, 16  #: bits of the largest table; tables are counted in blocks of 2 ** BLOCK_BITS slots
CONFIDENCE = (1, 2, 4, 16, 128)  #: counts at which a slot's confidence rises
REACH, LEVELS = (1.26, 2.15, 3.66, 5.78, 10.0), (2, 12, 40, 80, 121)  #: largest logit of each confidence, and its levels
GATES, RANGES, RATE, OFFSET_RATE = 36, 16, 0.0003, 0.003
STEP = 32  #: bytes of a text after which its weights are refined
BATCH, SIDE = 64 << 10, 128  #: bytes of texts that are scored side by side, and how many texts at least where there are as many
CHUNK, PIECE = 8 << 20, 64 << 10  #: bytes of texts that are counted at once, and of those whose contexts are formed at once
BLOCK_BYTES, FEW_BYTES = 16 << 20, 2 << 20  #: text of a block, in which words are looked up together, and least text of one where data are few
START = (0.25, 0.35, 0.6)  #: starting weights of the orders

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NODE = (np.arange(256, dtype=np.int64) + 1) * 40503 & 0xFFFF  # where a node's slot lies in a block
_START = np.concatenate([[0], 1 + np.cumsum((0, *LEVELS[:-1]))])  # first code of each confidence


def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """The logit and the confidence of each of the 256 codes of a slot."""
    logit, conf = np.zeros(256), np.zeros(256, np.int64)
    for c, (reach, levels) in enumerate(zip(REACH, LEVELS), 1):
        logit[_START[c] : _START[c] + levels] = np.linspace(-reach, reach, levels)
        conf[_START[c] : _START[c] + levels] = c
    return logit, conf


LOGIT, CONF = code_tables()
_GATE = (CONF[:, None] * 6 + CONF).ravel()  # of the codes of the longest order and the one before it


def codes(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """One byte for each slot from its count and its count of ones."""
    conf = np.digitize(n, CONFIDENCE)
    reach, levels = np.array((1.0, *REACH))[conf], np.array((1, *LEVELS))[conf]
    logit = np.clip(np.log((ones + 0.4) / (n - ones + 0.4)), -reach, reach)
    return np.where(conf > 0, _START[conf] + np.rint((logit + reach) / (2 * reach) * (levels - 1)), 0).astype(np.uint8)


def table_bits(training_bytes: int) -> int:
    """Bits of the largest table: about a slot for two training bytes."""
    return int(min(MOST, max(LEAST, int(training_bytes).bit_length() - 1)))


def bits_of(order: int, bits: int) -> int:
    return max(LEAST, bits - LESS[order])


def last_bytes(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every byte the six before it in one number, A-Z in lower case, the nearest lowest; zero before a text's ``first`` place."""
    one = np.zeros(len(raw), np.uint64)
    one[1:] = _LOWER[raw[:-1]]
    two = one.copy()
    two[1:] |= one[:-1] << np.uint64(8)
    value = two.copy()
    value[2:] |= two[:-2] << np.uint64(16)
    value[4:] |= two[:-4] << np.uint64(32)
    for j in range(max(ORDERS)):
        at = first + j
        value[at[at < len(raw)]] &= np.uint64((1 << 8 * j) - 1)
    return value


def slots(last: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The context's slot in the table of an order; a node moves it within its block."""
    h = (last & np.uint64((1 << 8 * ORDERS[order]) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(64 - bits_of(order, bits))).astype(np.int64)


def first_places(sizes: np.ndarray) -> np.ndarray:
    """Starts of the texts that aren't empty, in their concatenation."""
    return (np.cumsum(sizes) - sizes)[sizes > 0]


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each byte its path of (node, bit); ties go to the smaller symbol."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    node = 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (node, 0), (node, 1)
        heapq.heappush(heap, (a + b, node, node))
        node += 1
    out = []
    for s in range(256):
        path, at = [], s
        while at in parent:
            up, bit = parent[at]
            path.append((up - 256, bit))
            at = up
        out.append(path[::-1])
    return out


@dataclass
class Paths:
    """Huffman paths as arrays: of each pair of byte before and byte the depth, and where its nodes and bits begin."""

    depth: np.ndarray
    place: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> "Paths":
        """``counts``: of each byte after each byte, 256 by 256; all are taken to occur once more than that."""
        paths = [path for row in counts for path in huffman(row)]
        depth = np.array([len(p) for p in paths])
        return cls(
            depth, np.cumsum(depth) - depth, np.array([a for p in paths for a, _ in p], np.int64), np.array([b for p in paths for _, b in p], np.float64)
        )

    def expand(self, before: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many decisions each byte has, and where in ``node`` and ``bit`` they are."""
        pair = before << 8 | symbol
        depth = self.depth.take(pair)
        ends = np.cumsum(depth)
        return depth, np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.place.take(pair) - ends + depth, depth)


def pair_counts(texts: list[bytes], weights: np.ndarray | None):
    """For each order, the longest first, the different (last bytes, byte) pairs of the texts and their counts."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    pair, first, at = np.empty(len(raw), np.uint64), first_places(sizes), 0
    while at < len(first):  # in pieces that stay in the cache
        stop = max(at + 1, int(np.searchsorted(first, first[at] + PIECE)))
        lo, hi = first[at], first[stop] if stop < len(first) else len(raw)
        pair[lo:hi] = last_bytes(raw[lo:hi], first[at:stop] - lo) << np.uint64(8) | raw[lo:hi]
        at = stop
    times = None if weights is None else np.repeat(weights, sizes)
    for k in reversed(range(len(ORDERS))):
        if ORDERS[k] < max(ORDERS):
            pair = pair & np.uint64((1 << 8 * ORDERS[k] + 8) - 1)
        if times is None:
            pair.sort()
        else:
            order = np.argsort(pair)
            pair, times = pair[order], times[order]
        at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        times = np.diff(np.append(at, len(pair))) if times is None else np.add.reduceat(times, at)
        pair = pair[at]
        yield k, pair, times


def count_blocks(bits: int):
    """A function for mapInArrow over (body, n): (cell, pairs) of each block of each order's table."""

    def pack(texts, weights):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        cells, pairs = [], []
        for k, pair, n in pair_counts(texts, weights):
            key = slots(pair >> np.uint64(8), k, bits).astype(np.uint64) << np.uint64(16) | (pair & np.uint64(0xFFFF))
            order = np.argsort(key)
            key, n = key[order], n[order].astype("<u4")
            block = (key >> np.uint64(16 + BLOCK_BITS)).astype(np.int64)
            edges = [*np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist(), len(block)]
            place = (key >> np.uint64(16)).astype("<u2")  # the slot in the block, as steps from one to the next
            step = np.diff(place, prepend=place[:1])
            step[edges[:-1]] = place[edges[:-1]]
            both = [(key >> np.uint64(8)).astype(np.uint8), key.astype(np.uint8)]  # the byte before and the byte
            for i, j in zip(edges[:-1], edges[1:]):
                cells.append(k << 16 | int(block[i]))
                # like parts side by side, which packs well
                pairs.append(squeeze(b"".join([n[i:j].tobytes(), step[i:j].tobytes(), both[0][i:j].tobytes(), both[1][i:j].tobytes()])))
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(pairs, pa.binary())], ["cell", "pairs"])

    def run(batches):
        unsqueeze = zstandard.ZstdDecompressor().decompress
        once, often, times, sizes = [], [], [], [0, 0]
        for batch in batches:
            for body, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = unsqueeze(body)
                if n == 1:
                    once.append(text)
                else:
                    often.append(text)
                    times.append(n)
                sizes[n != 1] += len(text)
                if sizes[0] > CHUNK:
                    yield pack(once, None)
                    once, sizes[0] = [], 0
                if sizes[1] > CHUNK:
                    yield pack(often, np.array(times, np.int64))
                    often, times, sizes[1] = [], [], 0
        if once:
            yield pack(once, None)
        if often:
            yield pack(often, np.array(times, np.int64))

    return run


def build_blocks(paths: Paths):
    """A function for mapInArrow over rows in the order of cell: (cell, codes) of every block, summed row by row."""
    size = 1 << BLOCK_BITS

    def run(batches):
        unsqueeze = zstandard.ZstdDecompressor().decompress
        squeeze = zstandard.ZstdCompressor(level=1).compress
        cell, held, many = None, [], 0
        n, ones = np.zeros(size), np.zeros(size)

        def add():
            parts = []
            for body in held:
                m = len(body) // 8
                parts.append((np.frombuffer(body, "<u4", m), np.cumsum(np.frombuffer(body, "<u2", m, 4 * m), dtype=np.uint16), *np.frombuffer(body, np.uint8, 2 * m, 6 * m).reshape(2, m)))
            counts, place, before, symbol = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
            depth, at = paths.expand(before, symbol)
            slot = np.repeat(place, depth) ^ _NODE[paths.node[at]]
            times = np.repeat(counts.astype(np.float64), depth)
            np.add(n, np.bincount(slot, times, size), out=n)
            np.add(ones, np.bincount(slot, times * paths.bit[at], size), out=ones)

        def done():
            if held:
                add()
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([squeeze(codes(n, ones).tobytes())], pa.binary())], ["cell", "codes"])

        for batch in batches:
            for now, pairs in zip(*(c.to_pylist() for c in batch.columns)):
                if now != cell:
                    if cell is not None:
                        yield done()
                    cell, held, many = now, [], 0
                    n[:], ones[:] = 0, 0
                held.append(unsqueeze(pairs))
                many += len(held[-1])
                if many > 2 << 20:
                    add()
                    held, many = [], 0
        if cell is not None:
            yield done()

    return run


def step_of(n: int) -> np.ndarray:
    """The step of each of the first ``n`` places of a text: all are of one length, so weights follow a long text as closely as a short one."""
    return np.arange(n) // STEP


class Room:
    """Arrays that are used again from batch to batch, since fresh memory costs more than the sums in it."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, n: int, kind=np.float64) -> np.ndarray:
        """``n`` entries with whatever the last use has left there."""
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n + min(n // 4, 1 << 18), kind)
        return self.held[name][:n]


def take(values: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    return np.take(values, at, out=out, mode="clip")  # no place is outside; other modes would make a copy of ``out``


@dataclass
class Model:
    """The slots' codes of each order, the paths, and the starting weights of each gate (orders by gates)."""

    tables: list[np.ndarray]
    paths: Paths
    bits: int
    start: np.ndarray

    def __post_init__(self) -> None:
        self.move, self.sign = _NODE.take(self.paths.node), 1 - 2 * self.paths.bit  # of each decision: where its node moves a slot, and -1 for a one

    def __getstate__(self) -> dict:
        return {"tables": [zstandard.ZstdCompressor(level=1).compress(t) for t in self.tables], "paths": self.paths, "bits": self.bits, "start": self.start}

    def __setstate__(self, state: dict) -> None:
        unsqueeze = zstandard.ZstdDecompressor().decompress
        self.__init__([np.frombuffer(unsqueeze(t), np.uint8) for t in state["tables"]], state["paths"], state["bits"], state["start"])

    @classmethod
    def of(cls, cells, blocks, paths: Paths, bits: int) -> "Model":
        unsqueeze = zstandard.ZstdDecompressor().decompress
        tables = [np.zeros(1 << bits_of(k, bits), np.uint8) for k in range(len(ORDERS))]
        for cell, body in zip(cells, blocks):
            at = (cell & 0xFFFF) << BLOCK_BITS
            tables[cell >> 16][at : at + (1 << BLOCK_BITS)] = np.frombuffer(unsqueeze(body), np.uint8)
        return cls(tables, paths, bits, np.repeat(np.array(START)[:, None], GATES, 1))

    def predictions(self, raw: np.ndarray, last: np.ndarray, room: Room):
        """For every decision: the logit of each order, the gate, the bit as a sign (-1: one) and the place of its byte; and where each byte's decisions begin.

        All but the last lie in ``room``.
        """
        pair = (last & np.uint64(255)).astype(np.int64) << 8 | raw
        first = np.append(0, np.cumsum(self.paths.depth.take(pair)))
        n = int(first[-1])
        byte, at, move, code = room("byte", n, np.int64), room("at", n, np.int64), room("move", n, np.int64), room("code", n, np.uint8)
        byte.fill(0)
        byte[first[1:-1]] = 1
        np.cumsum(byte, out=byte)
        take(self.paths.place.take(pair) - first[:-1], byte, at)
        at += np.arange(n)
        take(self.move, at, move)
        sign = take(self.sign, at, room("sign", n))
        logits, gate = [], room("gate", n, np.int64)
        for k, table in enumerate(self.tables):
            take(slots(last, k, self.bits), byte, at)
            at ^= move
            at[:] = take(table, at, code)
            logits.append(take(LOGIT, at, room(f"logit {k}", n)))
            if k == len(ORDERS) - 2:
                gate[:] = at
        at <<= 8
        at |= gate
        take(_GATE, at, gate)
        return logits, gate, sign, byte, first

    def tune(self, texts: list[bytes], rounds: int = 8) -> None:
        """Fit the starting weights of every gate on texts that the tables don't count: Newton steps, drawn to the constants."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        if not len(raw):
            return
        logits, gate, sign, _, _ = self.predictions(raw, last_bytes(raw, first_places(np.array([len(t) for t in texts]))), Room())
        x, bit = np.stack(logits), (1 - sign) / 2
        order = np.argsort(gate, kind="stable")
        x, bit, gate = x[:, order], bit[order], gate[order]
        edges = np.searchsorted(gate, np.arange(GATES + 1))
        for g in range(GATES):
            a, y = x[:, edges[g] : edges[g + 1]], bit[edges[g] : edges[g + 1]]
            if len(y):
                w = base = self.start[:, g].astype(np.float64)
                for _ in range(rounds):
                    p = 1 / (1 + np.exp(-np.clip(w @ a, -30, 30)))
                    w = w + np.linalg.solve((a * (p * (1 - p) + 1e-6)) @ a.T + 5 * np.eye(len(w)), a @ (y - p) - 5 * (w - base))
                self.start[:, g] = np.clip(w, -4, 4)

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """The log10 probability of each text; a text's score doesn't depend on the others."""
        out, room = np.zeros(len(texts)), Room()
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            size, stop = 0, at
            while stop < len(order) and (stop - at < SIDE or size + len(texts[order[stop]]) <= BATCH):
                size += len(texts[order[stop]])
                stop += 1
            if size:
                out[order[at:stop]] = self._log10([texts[i] for i in order[at:stop]], room)
            at = stop
        return out

    def _log10(self, texts: list[bytes], room: Room) -> np.ndarray:
        """Texts side by side, as many steps of all of them at once as make up ``BATCH`` bytes; weights and offsets go on from one part to the next."""
        sizes = np.array([len(t) for t in texts], np.int64)
        weights = [np.tile(w, len(texts)) for w in self.start]
        offset, total, at = np.zeros(len(texts) * RANGES), np.zeros(len(texts)), 0
        while at < sizes.max():
            on = np.flatnonzero(sizes > at)
            stop = at + max(1, BATCH // len(on) // STEP) * STEP
            total[on] += self._part([texts[i] for i in on], on, at, stop, weights, offset, room)
            at = stop
        return total

    def _part(self, texts: list[bytes], on: np.ndarray, at: int, stop: int, weights: list[np.ndarray], offset: np.ndarray, room: Room) -> np.ndarray:
        """The log10 probability of the places from ``at`` to ``stop`` of texts; ``on``: where their weights and offsets lie, which are refined."""
        head = min(at, max(ORDERS))  # bytes before the part, which are contexts only
        cut = [t[at - head : stop] for t in texts]
        sizes = np.array([len(t) for t in cut], np.int64)
        raw = np.frombuffer(b"".join(cut), np.uint8)
        last = last_bytes(raw, first_places(sizes))
        inside = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes) - head
        step = step_of(stop - at).astype(np.uint16)[inside]
        by_step = np.argsort(step, kind="stable")
        if head:
            by_step = by_step[inside[by_step] >= 0]
        owner, step = np.repeat(np.arange(len(texts)), sizes)[by_step], step[by_step]
        logits, gate, sign, byte, first = self.predictions(raw[by_step], last[by_step], room)
        ends = first[np.searchsorted(step, np.arange(int(step[-1]) + 2))].tolist()
        n = len(gate)
        whose = take(on[owner] * GATES, byte, room("whose", n, np.int64))
        gate += whose
        take(on[owner] * RANGES, byte, whose)
        inverse = room("inverse", n)  # of the probability of the bit that came
        xs, ys, places = room("x", n), room("y", n), room("place", n, np.int64)
        for lo, hi in zip(ends[:-1], ends[1:]):
            g, s = gate[lo:hi], sign[lo:hi]
            v = [x[lo:hi] for x in logits]
            x, y, place = xs[: hi - lo], ys[: hi - lo], places[: hi - lo]
            take(weights[0], g, x)
            x *= v[0]
            for w, z in zip(weights[1:], v[1:]):
                take(w, g, y)
                y *= z
                x += y
            np.clip(x, -11.9, 11.9, out=x)
            np.add(x, 12, out=y)
            y *= RANGES / 24
            place[:] = y
            place += whose[lo:hi]
            x += take(offset, place, y)
            x *= s
            np.exp(x, out=x)
            x += 1
            inverse[lo:hi] = x
            np.divide(1, x, out=x)
            x -= 1
            x *= s  # the bit less its probability
            for w, z in zip(weights, v):
                w += RATE * np.bincount(g, np.multiply(x, z, out=y), len(w))
            offset += OFFSET_RATE * np.bincount(place, x, len(offset))
            np.clip(offset, -2, 2, out=offset)
        return -np.bincount(owner, np.log10(np.multiply.reduceat(inverse, first[:-1])), len(texts))


def is_held_out(modulus: int = 7, held_out: int = 2):
    return F.coalesce(crc32_of_id() % modulus == held_out, F.lit(False))


def byte_counts(batches):
    """(pair, n) of every byte and the one before it, A-Z of that in lower case, over texts (body, n)."""
    unsqueeze = zstandard.ZstdDecompressor().decompress
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for body, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = np.frombuffer(unsqueeze(body), np.uint8)
            before = np.zeros(len(raw), np.int64)
            before[1:] = _LOWER[raw[:-1]]
            pair, times = np.unique(before << 8 | raw, return_counts=True) if len(raw) < 1 << 14 else (slice(None), np.bincount(before << 8 | raw, minlength=1 << 16))
            total[pair] += times * n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(th, body, n, size): every different text once, compressed; n: how many training rows hold it; size: its bytes."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cols = [batch.column(0), pa.array([squeeze(t) for t in texts], pa.binary()), batch.column(2), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["th", "body", "n", "size"])

    rows = docs.select("th", utf8("text").alias("text"), (~F.col("held_out")).cast("long").alias("n"))
    rows = rows.mapInArrow(run, "th binary, body binary, n long, size long")
    return rows.groupBy("th").agg(F.first("body").alias("body"), F.sum("n").alias("n"), F.first("size").alias("size"))


def train(texts: DataFrame, tuning: Sequence[bytes] = ()) -> Model:
    """The model of all training texts among ``texts`` (th, body, n, size); ``tuning`` as in ``score``.

    What reaches the driver is the finished tables, at most 2 ** MOST bytes and the smaller orders'.
    """
    counted = texts.where("n > 0").select("body", "n")
    n = np.zeros(1 << 16, np.int64)
    for pair, count in counted.mapInArrow(byte_counts, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        n[pair] = count
    paths, bits = Paths.of(n.reshape(256, 256)), table_bits(n.sum())
    parts = counted.mapInArrow(count_blocks(bits), "cell int, pairs binary").repartition(partitions_for(texts), "cell")
    blocks = parts.sortWithinPartitions("cell").mapInArrow(build_blocks(paths), "cell int, codes binary").toArrow()
    model = Model.of(blocks["cell"].to_pylist(), blocks["codes"].to_pylist(), paths, bits)
    model.tune(list(tuning))
    return model


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case, and one end, which no word equals."""
    return [*text.lower().split(), b" "]


SCHEMA = "th binary, n long, n_tokens long, n_known long, mass double, heads long, score double, n_bytes long"


def score(docs: DataFrame, text_col: str = "text", tuning: Sequence[bytes] = ()) -> DataFrame:
    """One row for each row of ``docs``: the unigram base score, and the mixing model's log10 probability of the text.

    Null and empty texts have one token, the end, and score 0 (no bytes). Repeated rows are kept; copies of a text are scored
    once and count as often as they are training rows. Rows without id count as training rows. With no training rows N and
    V are 0. An empty table gives an empty result; other columns are ignored. Starting weights are constants; only if a caller has
    texts of their own that ``docs`` does not hold can these be fitted to them (``tuning``).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    th = F.unhex(F.substring(F.sha2(utf8(), 256), 1, 32))
    rows = docs.select("doc_id", is_held_out().alias("held_out"), th.alias("th"), "text")
    texts = keep(distinct_texts(rows))
    total = texts.agg(F.sum("size")).first()[0] or 0
    model = docs.sparkSession.sparkContext.broadcast(train(texts, tuning))
    blocks = max(1, -(-total // BLOCK_BYTES), min(partitions_for(docs), -(-total // FEW_BYTES)))
    dealt = texts.select("th", "body", "n", F.pmod(F.xxhash64("th"), F.lit(blocks)).alias("bid"))

    def bodies(table: pa.Table) -> list[bytes]:
        unsqueeze = zstandard.ZstdDecompressor().decompress
        return [unsqueeze(b) for b in table["body"].to_pylist()]

    def block_words(table: pa.Table) -> pa.Table:
        counts, other = Counter(), set()
        for text, n in zip(bodies(table), table["n"].to_pylist()):
            if not n:
                other.update(tokens(text))
            elif n == 1:
                counts.update(tokens(text))
            else:
                for word, c in Counter(tokens(text)).items():
                    counts[word] += c * n
        other -= counts.keys()
        words = [*counts, *other]
        n = [*counts.values(), *([0] * len(other))]
        return pa.table([pa.array([table["bid"][0].as_py()] * len(words), pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["bid", "word", "n"])

    def block_scores(left: pa.Table, right: pa.Table) -> pa.Table:
        gain = dict(zip(right["word"].to_pylist(), np.log10(right["c"].to_numpy() + 1).tolist()))  # zero: a word that no training text holds
        heads = int(right["head"].to_numpy().sum())
        texts = bodies(left)
        mass, n_tokens, n_known = [], [], []
        for text in texts:
            gains = [gain[word] for word in tokens(text)]
            mass.append(sum(gains))
            n_tokens.append(len(gains))
            n_known.append(len(gains) - gains.count(0.0))
        return pa.table(
            [
                left["th"], left["n"], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(mass, pa.float64()),
                pa.array([heads] + [0] * (len(texts) - 1), pa.int64()), pa.array(model.value.log10(texts)), pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )

    words = dealt.groupBy("bid").applyInArrow(block_words, "bid long, word binary, n long")
    each = Window.partitionBy("word")  # a word has one row for each block at most
    counted = words.withColumn("c", F.sum("n").over(each)).withColumn("head", ((F.col("c") > 0) & (F.col("bid") == F.min("bid").over(each))).cast("long"))
    scored = materialize(
        dealt.groupBy("bid").cogroup(counted.select("bid", "word", "c", "head").groupBy("bid")).applyInArrow(block_scores, SCHEMA)
    )
    n, v = scored.agg(F.sum(F.col("n") * F.col("n_tokens")), F.sum("heads")).first()
    n, v = n or 0, v or 0
    return rows.select("doc_id", "held_out", "th").join(scored, "th").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("mass") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )

"""Near-duplicate classes by word shingles of a given similarity, found through SimHash fingerprints.

Texts fold into their different shingle sets. Candidates come from two sides: the operator's tiled exact comparison of
fingerprints (``simhash.links``), and keys made of the least hashes of a set in five orders: two sets of similarity 0.8 share one
of 30 such keys but for seven pairs in a million. Under its keys every set is held against the partners, two for each key, with
which it shares most keys, which joins most of a class by few comparisons; of these candidates, those whose 256-bit
fingerprints lie within a radius are compared exactly. A last round takes the rest: sets connected by keys that still hold sets
of different classes form blocks, in which all sets of different classes are compared exactly, tile against tile, and only
spanning links go on. So a pair of the least similarity stays apart only if it shares no key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, keep, materialize, min_labels, partitions_for, sorted_groups, utf8

WIDTH, SEED = 5, 42
LEAST = (4, 5)  #: the least similarity as a fraction
RADIUS = 72  #: of 256 bits; sets of similarity 0.8 differ in 39 to 48 bits, with a deviation of 6
BANDS, ROWS, PARTNERS = 30, 5, 4  #: keys of a set, orders of the hashes in a key, and partners of a set in a round
FILTER_BITS = 26  #: of the bitmap of wanted sets that is broadcast, 8 MB at every size of the corpus
_ORDERS = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LANES = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted different 64-bit hashes of a text's shingles; fewer words than a shingle: of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    of = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([of(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    return np.unique(np.array([of(joined[i:j], SEED) for i, j in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())], np.uint64))


def fingerprint(hashes: np.ndarray) -> bytes:
    """256 bits: each set if it is in over half of the hashes."""
    ones = np.zeros(256, np.int64)
    for i in range(0, len(hashes), 16384):
        lanes = hashes[i : i + 16384, None] * _LANES
        lanes[:, 1:] ^= lanes[:, 1:] >> np.uint64(32)
        lanes[:, 1:] *= _LANES[2]
        ones += np.unpackbits(lanes.view(np.uint8).reshape(-1, 32), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """The set's keys; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 256):
        np.minimum(least, (hashes[i : i + 256, None] * _ORDERS).min(0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * _LANES[2]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _node(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "big", signed=True)


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, node, f0, f1, f2, f3, keys) of every row: its set's name, fingerprint and keys."""

    def run(batches):
        for batch in batches:
            nodes, fps, keys = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text, width)
                nodes.append(_node(h))
                fps.append(fingerprint(h))
                keys.append(keys_of(h))
            lanes = np.frombuffer(b"".join(fps), np.int64).reshape(-1, 4)
            cols = [batch.column(0), pa.array(nodes, pa.int64()), *(pa.array(lanes[:, i]) for i in range(4)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "node", "f0", "f1", "f2", "f3", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, node long, f0 long, f1 long, f2 long, f3 long, keys array<long>")


def grams_of(nodes: DataFrame, docs: DataFrame, width: int, text_col: str) -> DataFrame:
    """(node, grams) of the given distinct sets, formed again from the texts."""
    low = F.col("node").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = nodes.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            sets = [(_node(h), h) for h in (shingles(t, width) for t in batch.column(0).to_pylist())]
            sets = [(n, h) for n, h in sets if wanted.value[(n & (1 << FILTER_BITS) - 1) >> 6] >> (n & 63) & 1]
            grams = [(h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for _, h in sets]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in sets], pa.int64()), pa.array(grams, pa.list_(pa.int32()))], ["node", "grams"])

    # the bitmap only spares the exchange most of the other sets; the join decides
    sets = docs.select(utf8(text_col).alias("text")).mapInArrow(run, "node long, grams array<int>")
    return keep(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams")))


def similar(pairs: DataFrame, docs: DataFrame, width: int, least: tuple[int, int], text_col: str) -> DataFrame:
    """The pairs (u, v) whose sets reach the similarity."""
    pairs = materialize(pairs)
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    sets = grams_of(nodes, docs, width, text_col)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("gu")), "u").join(sets.select(F.col("node").alias("v"), F.col("grams").alias("gv")), "v")
    shared, total = F.size(F.array_intersect("gu", "gv")), F.size("gu") + F.size("gv")
    return both.where((least[0] + least[1]) * shared >= least[0] * total).select("u", "v")


def partners(shared: DataFrame) -> DataFrame:
    """Candidate pairs (u, v): each set with the PARTNERS others with which it shares most keys.

    ``shared``: (k, node). Under every key the partners are the first and the last set in an order that depends on the key, so
    a frequent key costs each of its sets two rows.
    """
    one = F.struct(F.col("node").bitwiseXOR(F.col("k")).alias("o"), "node")
    ends = shared.groupBy("k").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo.node <> hi.node")
    met = shared.join(ends, "k").select("node", F.explode(F.array("lo.node", "hi.node")).alias("with")).where("node <> with")
    counts = met.groupBy("node", "with").count()
    # a set has two partners a key at most, so its list is short
    best = counts.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "with")), asc=False), 1, PARTNERS).alias("best"))
    pairs = best.select("node", F.explode("best.with").alias("with"))
    return pairs.select(F.least("node", "with").alias("u"), F.greatest("node", "with").alias("v")).distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 8192) -> np.ndarray:
    """How many elements each set on the left shares with each on the right, by products of membership matrices."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1  # what only one set holds is shared by none
    some = n[at] > 1
    owner, at = owner[some], rank[at[some]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, chunk):
        i, j = np.searchsorted(at, [lo, lo + chunk])
        member = np.zeros((len(sets), chunk), np.float32)
        member[owner[i:j], at[i:j] - lo] = 1
        out += member[: len(left)] @ member[len(left) :].T
    return out


def block_links(least: tuple[int, int], side: int = 256):
    """A function for mapInArrow: spanning links of different parts in each (block, t) group of rows."""
    num, den = least[0], least[0] + least[1]

    def run(batches):
        for rows in sorted_groups(batches, ["block", "t"]):
            block, t, node, part, right = (rows.column(n).to_numpy() for n in ("block", "t", "node", "part", "side"))
            grams = rows.column("grams").combine_chunks()
            values, ends = grams.values.to_numpy(), grams.offsets.to_numpy()
            size = np.diff(ends)
            new = np.ones(len(block), bool)
            new[1:] = (block[1:] != block[:-1]) | (t[1:] != t[:-1])
            starts = np.append(np.flatnonzero(new), len(block))
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for lo, hi in zip(starts, starts[1:]):
                at = lo + np.argsort(size[lo:hi], kind="stable")  # sets of like size lie in one tile
                two = t[lo] // (1 << 31) != t[lo] % (1 << 31)  # rows of two different tiles
                a, b = (at[~right[at]], at[right[at]]) if two else (at, at)
                for i in range(0, len(a), side):
                    x = a[i : i + side]
                    for j in range(0 if two else i, len(b), side):
                        y = b[j : j + side]
                        total = size[x][:, None] + size[y][None, :]
                        open_ = (part[x][:, None] != part[y][None, :]) & (den * np.minimum(size[x][:, None], size[y][None, :]) >= num * total)
                        if not open_.any():
                            continue
                        p, q = open_.any(1), open_.any(0)
                        x, y = x[p], y[q]
                        shared = shared_counts([values[ends[r] : ends[r + 1]] for r in x], [values[ends[r] : ends[r + 1]] for r in y])
                        m, n = np.nonzero(open_[p][:, q] & (den * shared >= num * total[p][:, q]))
                        u, v = min_labels(node[x[m]], node[y[n]])
                        us.append(u)
                        vs.append(v)
            u, v = min_labels(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def across(named: DataFrame, docs: DataFrame, width: int, least: tuple[int, int], text_col: str, tile: int) -> DataFrame:
    """Links (u, v) that span all pairs of different parts under a key which reach the similarity.

    ``named``: (k, node, part). Keys all in one part are done and cost nothing; sets that the others connect form blocks. A
    block of more than ``tile`` sets, or of more than ``1024 * tile`` elements, goes to tasks as pairs of its tiles.
    """
    held = named.groupBy("k").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("node").alias("v")).where("lo < hi")
    open_ = keep(named.join(held.select("k", "v"), "k").select("node", "part", "v"))
    blocks = connected_components(open_.select(F.col("node").alias("u"), "v")).withColumnRenamed("component", "block")
    sets = grams_of(open_.select("node").distinct(), docs, width, text_col)
    rows = keep(open_.select("node", "part").distinct().join(blocks, "node").join(sets, "node"))
    sums = rows.groupBy("block").agg(F.greatest(F.count("*"), F.sum(F.size("grams")) / 1024).alias("n"))
    rows = rows.join(sums, "block").withColumn("subs", F.ceil(F.col("n") / tile).cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), "subs"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
    tiles = dealt.select(
        "block", (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).alias("t"), "node", "part", (F.col("own") > F.col("other")).alias("side"), "grams"
    )
    return tiles.repartition(partitions_for(named), "block", "t").sortWithinPartitions("block", "t").mapInArrow(block_links(least), "u long, v long").distinct()


def within(pairs: DataFrame, sets: DataFrame, radius: int) -> DataFrame:
    """The pairs whose fingerprints differ in ``radius`` bits at most."""
    lanes = [f"f{i}" for i in range(4)]
    side = lambda c: sets.select(F.col("node").alias(c), *[F.col(x).alias(c + x) for x in lanes])
    differ = sum((F.bit_count(F.col("u" + x).bitwiseXOR(F.col("v" + x))) for x in lanes), F.lit(0))
    return pairs.join(side("u"), "u").join(side("v"), "v").where(differ <= radius).select("u", "v")


def classes(
    docs: DataFrame, width: int = WIDTH, least: tuple[int, int] = LEAST, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, near: int = simhash.RADIUS,
    tile: int = simhash.TILE,
) -> DataFrame:
    """(id, node, component): one row for each row of ``docs``; component names the class of linked sets.

    Similarity is that of the sets of ``width``-word shingles (A-Z in lower case, white space of ASCII), reached at the
    fraction ``least`` exactly. Texts without words form one class; repeated rows share theirs; null texts count as empty; an
    empty table gives an empty result; other columns are ignored.
    """
    rows = keep(sketches(docs, width, id_col, text_col))
    lanes = [f"f{i}" for i in range(4)]
    sets = keep(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in (*lanes, "keys")]))
    prints = sets.groupBy(F.col("f0").alias("fp")).agg(F.min("node").alias("node"))
    equal = sets.join(prints.select(F.col("fp").alias("f0"), F.col("node").alias("v")), "f0").where("node <> v").select(F.col("node").alias("u"), "v")
    tiled = simhash.links(prints, near, tile=tile).unionByName(equal)
    members = sets.select("node", F.explode("keys").alias("k"))
    shared = keep(members.join(members.groupBy("k").count().where("count > 1").select("k"), "k"))
    first = keep(within(tiled.unionByName(partners(shared)).distinct(), sets, radius))
    links = materialize(similar(first, docs, width, least, text_col))
    parts = keep(connected_components(links))
    named = keep(shared.join(parts, "node", "left").select("k", "node", F.coalesce("component", "node").alias("part")))
    rest = materialize(across(named, docs, width, least, text_col, tile))
    final = keep(connected_components(links.unionByName(rest)))
    return rows.select("id", "node").join(final, "node", "left").select("id", "node", F.coalesce("component", "node").alias("component"))

"""SimHash near-duplicates by tiled exact comparison.

Fingerprints come from word shingles. Equal fingerprints fold into one node first. Two 64-bit values at most r bits
apart agree on at least (b - r) of b blocks, so every link is found in a bucket of equal (b - r)-block keys; there,
tiles are compared exactly by numpy exclusive-or and bit counts, and tile pairs whose population counts differ by more
than the radius are skipped. A bucket above the tile bound is spread over tasks as tile pairs, so no task holds it whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, min_labels, partitions_for, sorted_groups, utf8

WIDTH, RADIUS, BLOCKS, TILE, SEED = 3, 3, 5, 1024, 42


def simhash(text: bytes, width: int = WIDTH) -> int:
    """The 64-bit fingerprint: a bit is set if it is in over half of the shingles' hashes; no words: zero."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    of = xxhash.xxh64_intdigest
    hashes = [of(joined[i:j], SEED) for i, j in zip((ends - sizes)[: 1 - width].tolist(), ends[width - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; null texts count as empty."""

    def run(batches):
        for batch in batches:
            fps = np.array([simhash(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """Signed 64-bit masks of every choice of (blocks - radius) blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(single, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def compare_tiles(fp_a, node_a, fp_b, node_b, radius: int, same: bool, side: int = 512):
    """Spanning edges between two sets, tile against tile in the order of population counts."""
    pa_, pb_ = np.bitwise_count(fp_a), np.bitwise_count(fp_b)
    a, b = np.argsort(pa_, kind="stable"), np.argsort(pb_, kind="stable")
    us, vs = [], []
    for i in range(0, len(a), side):
        ta = a[i : i + side]
        for j in range(i if same else 0, len(b), side):
            tb = b[j : j + side]
            if int(pb_[tb[0]]) - int(pa_[ta[-1]]) > radius or int(pa_[ta[0]]) - int(pb_[tb[-1]]) > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(fp_a[ta][:, None] ^ fp_b[tb][None, :]) <= radius)
            u, v = node_a[ta[x]], node_b[tb[y]]
            u, v = min_labels(u[u != v], v[u != v])
            us.append(u)
            vs.append(v)
    empty = np.empty(0, np.int64)
    return min_labels(np.concatenate([*us, empty]), np.concatenate([*vs, empty]))


def bucket_edges(radius: int, small: int = 64):
    """A function for mapInArrow: spanning edges of each (c, k, t) group of rows."""

    def run(batches):
        for rows in sorted_groups(batches, ["c", "k", "t"]):
            c, k, t, node, fp, right = (rows.column(n).to_numpy() for n in ("c", "k", "t", "node", "fp", "side"))
            fp = fp.view(np.uint64)
            new = np.ones(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1]) | (t[1:] != t[:-1])
            group = np.cumsum(new) - 1
            starts = np.append(np.flatnonzero(new), len(c))
            sizes = np.diff(starts)
            us, vs = [], []
            few = np.flatnonzero(sizes[group] <= small)
            two = (t >= 0) & (t >> 28 != t & (2**28 - 1))  # rows of two different tiles
            g, f, n, r, cross = group[few], fp[few], node[few], right[few], two[few]
            for d in range(1, min(small, int(sizes[sizes <= small].max(initial=0)))):
                close = (g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius) & (~cross[d:] | (r[d:] != r[:-d]))
                us.append(n[d:][close])
                vs.append(n[:-d][close])
            for i in np.flatnonzero(sizes > small):
                at = np.arange(starts[i], starts[i + 1])
                a, b = at[~right[at]], at[right[at]]
                same = not two[at[0]]
                if same:
                    b = a
                if len(a) and len(b):
                    u, v = compare_tiles(fp[a], node[a], fp[b], node[b], radius, same)
                    us.append(u)
                    vs.append(v)
            empty = np.empty(0, np.int64)
            u, v = min_labels(np.concatenate([*us, empty]), np.concatenate([*vs, empty]))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that span all links among distinct fingerprints; ``nodes`` has node and fp, each fp once."""
    masks = block_masks(blocks, radius)
    keyed = nodes.select("node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "k"))
    held = keyed.groupBy("c", "k").count().where("count > 1")
    keyed = keyed.join(held, ["c", "k"]).select("c", "k", "node", "fp", F.ceil(F.col("count") / (8 * tile)).cast("long").alias("subs"))
    whole = keyed.where("subs = 1").select("c", "k", F.lit(-1).cast("long").alias("t"), "node", "fp", F.lit(False).alias("side"))
    # tiles of a large bucket: (population count, part); only pairs within the radius exist
    own = (F.bit_count("fp").cast("long") * (1 << 20)) + F.pmod(F.xxhash64("fp"), "subs")
    other = F.expr(
        f"flatten(transform(sequence(-{radius}L, {radius}L), d -> transform(sequence(0L, subs - 1), s -> (bit_count(fp) + d) * {1 << 20}L + s)))"
    )
    spread = (
        keyed.where("subs > 1")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.filter(other, lambda x: x >= 0)))
        .select(
            "c", "k", (F.least("own", "other") * (1 << 28) + F.greatest("own", "other")).alias("t"), "node", "fp", (F.col("own") > F.col("other")).alias("side")
        )
    )
    rows = whole.unionByName(spread).repartition(partitions_for(nodes), "c", "k", "t").sortWithinPartitions("c", "k", "t")
    return rows.mapInArrow(bucket_edges(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    The nodes are the fingerprints, so rows without id link others as well, and different texts of one id stay apart. A component is named
    after the least id of all its rows, null if none has one; a row without id gets the component of its fingerprint. Null and
    empty texts have the zero fingerprint and are linked like any other; repeated rows share a component. Ties (exactly half
    of the hashes) leave a bit unset. An empty table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, width, id_col, text_col))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    parts = materialize(connected_components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius)).withColumnRenamed("node", "fp"))
    least = materialize(parts.join(nodes, "fp").groupBy("component").agg(F.min("id").alias("least")))
    named = parts.join(least, "component").select("fp", "least")
    by_print = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "id").alias("component_id"))
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

"""Sequence packing: shortest-pack-first over the length histogram.

Texts become token ids with a closing 0 and are cut into pieces of at most the sequence length. Pieces are packed by
their lengths alone: the histogram has one bin for each length, so its size doesn't grow with the corpus. Lengths are
placed longest first, each into the shortest open packs; packs of equal content are one pattern with a count. Patterns are then joined back to pieces by the rank of a piece among those of its length.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MAX_TOKENS, SALT_ROWS = 1024, 1 << 14  #: pieces of one length that a task ranks, about


def default_tokenizer() -> str:
    """Place of the vocabulary on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None):
    """A function from texts to lists of ids.

    The byte-level vocabulary exists in two file forms; where the ranks lie beside the JSON file, the faster library reads
    them, which gives the same ids (a test holds the two against each other). Otherwise the JSON file is used.
    """
    import base64
    import json
    import os

    path = path or default_tokenizer()
    ranks = path.removesuffix(".json") + ".tiktoken"
    tok = None

    def slow(texts: list[str]) -> list[list[int]]:
        nonlocal tok
        if tok is None:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
        return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]

    if not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken

    with open(path) as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def one(text: str) -> list[int]:
        try:
            return enc.encode(text, allowed_special="all")
        except ValueError:  # its pattern engine gives up on a very long run of blanks
            return slow([text])[0]

    return lambda texts: [one(t) for t in texts]


def pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every text's ids with a closing 0, cut every ``max_tokens``."""

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for i, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids = np.array([*ids, 0], "<u4")
                    out += [(i, s, min(max_tokens, len(ids) - s), zlib.crc32(ids[s : s + max_tokens].tobytes()), len(ids)) for s in range(0, len(ids), max_tokens)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(histogram: dict[int, int], capacity: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, count) that hold each length as often as the histogram says; shortest pack first.

    Lengths go longest first. Of the open patterns in which a length fits, the shortest is filled first; packs into
    which nothing fits begin a new pattern. Every step handles a whole count, so the work depends on the number of
    different lengths, not of documents.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by length used
    used: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int) -> None:
        size = sum(pattern)
        if size == capacity:
            done.append((pattern, count))
        else:
            if size not in open_:
                open_[size] = []
                insort(used, size)
            open_[size].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if not used or used[0] + length > capacity:
                fits = capacity // length
                if left >= fits:
                    put((length,) * fits, left // fits)
                if left % fits:
                    put((length,) * (left % fits), 1)
                left = 0
                continue
            size = used[0]
            pattern, count = open_[size].pop()
            if not open_[size]:
                del open_[size]
                used.pop(0)
            take = min(count, left)
            if count > take:
                put(pattern, count - take)
            put((*pattern, length), take)
            left -= take
    return done + [x for parts in open_.values() for x in parts]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, offset): ranks from there on lie in consecutive sequences."""
    out: dict[int, list] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = filled.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, offset))
            filled[length] = rank + count
            offset += length
        sequence += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def ranked(cut: DataFrame, histogram: dict[int, int], salt_rows: int = SALT_ROWS) -> DataFrame:
    """``cut`` with ``rank``, from 0 among the pieces of a length.

    A length is spread over salts, one for about every ``salt_rows`` of its pieces, so a task's share doesn't grow with the
    corpus. The histogram, at most one row a length, goes to all tasks.
    """
    salts = cut.sparkSession.createDataFrame([(k, n // salt_rows + 1) for k, n in histogram.items()] or [(0, 1)], "length long, salts long")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts"))).drop("salts")
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
        .select("length", "salt", "before")
    )
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    return salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("salt", "own", "before")


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece of one id. Repeated rows and rows without id are packed each on its own. Ties
    in a length are ranked by id, start and checksum. An empty table gives an empty result; other columns are ignored.
    """
    cut = materialize(pieces(docs, max_tokens, tokenizer, text_col))
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most max_tokens rows
    table = slots(pack_histogram(histogram, max_tokens))
    starts = {k: (v[:, 0], v[:, 1], v[:, 2]) for k, v in table.items()}

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                first, seq, off = starts[int(size)]
                slot = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = seq[slot] + rank[at] - first[slot]
                offset[at] = off[slot]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked(cut, histogram).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long").alias("rank")).mapInArrow(run, schema)

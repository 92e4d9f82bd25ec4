"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames with the number of units, characters and bytes before each. A cut after
so many units is found by decompressing the one frame that it falls into; the three parts are then streamed frame by frame, in
the order that the form asks for, into the digests or into new frames. Only one frame is open at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, utf8

FRAME = 1 << 16  #: bytes of text in a frame
SEED, RATE, SPM_RATE = 42, 50, 80  #: percent of texts that are transformed, and of these in the order suffix, prefix, middle
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")

ONE = "struct<units:long,chars:long,bytes:long,data:binary>"
FRAMES = f"array<{ONE}>"
STORED = f"doc_id long, n long, n_bytes long, marked boolean, frames {FRAMES}"
OUTPUT = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, output {FRAMES}"
_ARROW_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]))


def new_units(raw: np.ndarray) -> np.ndarray:
    """Byte places, the first left out, where units begin: a run of blanks and the word behind it, or blanks at the end."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    return np.flatnonzero(blank[1:] & ~blank[:-1]) + 1


def characters(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def pack(chunks: Iterable[bytes], size: int = FRAME) -> tuple[list[dict], int, int]:
    """Frames of about ``size`` bytes of the concatenated chunks, cut between characters; the number of units and of bytes.

    ``units``, ``chars`` and ``bytes`` count what begins before the frame. A unit may go on into the next frame.
    """
    squeeze = zstandard.ZstdCompressor(level=3).compress
    frames: list[dict] = []
    units = chars = done = 0
    was_blank = True  # of the byte before; what begins the text begins a unit
    held = b""

    def add(part: bytes) -> None:
        nonlocal units, chars, done, was_blank
        raw = np.frombuffer(part, np.uint8)
        frames.append({"units": units, "chars": chars, "bytes": done, "data": squeeze(part)})
        units += len(new_units(raw)) + (done == 0 or (not was_blank and part[:1] in BLANKS))
        chars += characters(raw)
        done += len(part)
        was_blank = part[-1:] in BLANKS

    for chunk in chunks:
        held += chunk
        at = 0
        while len(held) - at >= 2 * size:
            end = at + size
            while end < len(held) and held[end] & 0xC0 == 0x80:
                end += 1
            add(held[at:end])
            at = end
        held = held[at:]
    if held:
        add(held)
    return frames, units, done


class Frames:
    """A stored text: any range of bytes, and the byte and character place of any unit."""

    def __init__(self, frames: list[dict], n: int, n_bytes: int):
        self.frames, self.n, self.n_bytes = frames, n, n_bytes
        self.unsqueeze = zstandard.ZstdDecompressor().decompress

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, characters) before the unit of this number; of the whole text behind the last one. Opens one frame."""
        if units >= self.n:
            return self.n_bytes, self._all_chars()
        at = bisect_right(self.frames, units, key=lambda f: f["units"]) - 1
        frame = self.frames[at]
        raw = np.frombuffer(self.unsqueeze(frame["data"]), np.uint8)
        begins = new_units(raw)
        after = self.frames[at + 1]["units"] if at + 1 < len(self.frames) else self.n
        if len(begins) < after - frame["units"]:  # one more begins here: the frame's first byte begins it
            begins = np.concatenate([[0], begins])
        place = int(begins[units - frame["units"]])
        return frame["bytes"] + place, frame["chars"] + characters(raw[:place])

    def _all_chars(self) -> int:
        if not self.frames:
            return 0
        last = self.frames[-1]
        return last["chars"] + characters(np.frombuffer(self.unsqueeze(last["data"]), np.uint8))

    def read(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """The bytes from start to end, frame by frame."""
        end = self.n_bytes if end is None else end
        at = max(0, bisect_right(self.frames, start, key=lambda f: f["bytes"]) - 1)
        while start < end:
            frame = self.frames[at]
            part = self.unsqueeze(frame["data"])[start - frame["bytes"] : end - frame["bytes"]]
            yield part
            start += len(part)
            at += 1


def arranged(text: Frames, form: str, a: int, b: int) -> Iterator[bytes]:
    """The output in pieces, for a prefix of ``a`` bytes and a middle up to byte ``b``."""
    prefix, middle, suffix = (PREFIX, 0, a), (MIDDLE, a, b), (SUFFIX, b, text.n_bytes)
    order = {"plain": [(b"", 0, text.n_bytes)], "psm": [prefix, suffix, middle], "spm": [suffix, prefix, middle]}[form]
    for mark, start, end in order:
        yield mark
        yield from text.read(start, end)


def find(output: Frames, mark: bytes, start: int) -> int:
    """The first place of ``mark`` from ``start`` on, also across frames."""
    tail, at = b"", start
    for part in output.read(start):
        seen = tail + part
        if (i := seen.find(mark)) >= 0:
            return at - len(tail) + i
        at += len(part)
        tail = seen[-(len(mark) - 1) :]
    raise ValueError(f"no {mark!r} in the output")


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text in pieces, from its output and form alone.

    A text with a mark in it is plain, and a mark cannot begin inside another, so the first place of each is the right one.
    """
    if form == "plain":
        yield from output.read()
        return
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    two = find(output, second, len(first))
    three = find(output, MIDDLE, two + len(second))
    parts = {first: (len(first), two), second: (two + len(second), three)}
    yield from output.read(*parts[PREFIX])
    yield from output.read(three + len(MIDDLE))
    yield from output.read(*parts[SUFFIX])


def _batch(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)


def store(docs: DataFrame, size: int = FRAME) -> DataFrame:
    """(doc_id, n, n_bytes, marked, frames): every text as frames; ``marked`` if it contains one of the three marks.

    A null text is empty and has no frame; repeated rows are stored as often as they occur; further columns are ignored.
    """
    names, kinds = ["doc_id", "n", "n_bytes", "marked", "frames"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), _ARROW_FRAMES]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for key, body in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    frames, n, n_bytes = pack([body], size)
                    out.append((key, n, n_bytes, any(m in body for m in (PREFIX, SUFFIX, MIDDLE)), frames))
                yield _batch(out, names, kinds)

    return docs.select("doc_id", utf8("text").alias("body")).mapInArrow(run, STORED)


def drawn(seed: int = SEED) -> list[F.Column]:
    """Four numbers of 32 bits from the hash of the id; a null id counts as the empty string."""
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexes, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(stored: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, size: int = FRAME) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the transformed texts, as frames again.

    Texts that are empty or hold a mark stay plain. Cuts may fall together or on an end, so parts may be empty.
    """
    h1, h2, h3, h4 = drawn(seed)
    n1 = F.col("n") + 1
    plain = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    rows = stored.select("doc_id", "n", "n_bytes", "frames", form.alias("form"), F.least(h1 % n1, h2 % n1).alias("first"), F.greatest(h1 % n1, h2 % n1).alias("second"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), _ARROW_FRAMES]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for key, n, n_bytes, frames, form, first, second in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    text = Frames(frames, n, n_bytes)
                    if form == "plain":
                        out.append((key, n, form, None, None, frames))
                        continue
                    (a, a_chars), (b, b_chars) = text.cut(first), text.cut(second)
                    out.append((key, n, form, a_chars, b_chars - a_chars, pack(arranged(text, form, a, b), size)[0]))
                yield _batch(out, names, kinds)

    return rows.mapInArrow(run, OUTPUT)


def opened(frames: list[dict]) -> Frames:
    """A stored output; its length is that of the frames before the last and of the last."""
    size = frames[-1]["bytes"] + len(zstandard.ZstdDecompressor().decompress(frames[-1]["data"])) if frames else 0
    return Frames(frames, 0, size)


def texts(outputs: DataFrame) -> DataFrame:
    """``outputs`` with the transformed text itself in place of its frames."""
    names, kinds = ["doc_id", "form", "text"], [pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, 64).columns))
                yield _batch([(key, form, b"".join(opened(frames).read()).decode()) for key, form, frames in rows], names, kinds)

    return outputs.select("doc_id", "form", "output").mapInArrow(run, "doc_id long, form string, text string")


def digests(outputs: DataFrame) -> DataFrame:
    """The outputs by digest: of the output, and of the text rebuilt from it."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    names, kinds = [x.split()[0] for x in schema.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def sha(parts: Iterable[bytes]) -> str:
        h = hashlib.sha256()
        for part in parts:
            h.update(part)
        return h.hexdigest()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for *head, form, prefix, middle, frames in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    output = opened(frames)
                    out.append((*head, form, prefix, middle, sha(output.read()), sha(restored(output, form))))
                yield _batch(out, names, kinds)

    return outputs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").mapInArrow(run, schema)


def per_document(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: number of units, form, lengths of prefix and middle, digests of output and restored text.

    Texts are stored as a table of frames, then cut and streamed from it; no row moves between tasks. A null text is empty and
    plain; a null id draws as the empty string; an empty table gives an empty result; repeated rows have equal values.
    """
    return digests(transform(keep(store(docs))))

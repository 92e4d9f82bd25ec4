"""MPEG audio as a binary column: write payloads into frames, and parse streams into exact durations and seek offsets.

The writer makes a valid Layer III stream: an ID3v2 tag, a variable-bitrate table frame, then frames with checksums and
empty granules whose main data, which a player skips as ancillary bytes, carries the payload without loss. The reader
takes any stream: it skips or parses tags, finds frame headers again after junk, reads the bitrate tables and checks
checksums.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

UNIT = 192

# Fixed values of the MPEG audio header: kbit/s by (version 1?, layer), and samples per second of version 1.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)


def header(word: int):
    """(version, layer, protected, bytes, samples, rate, mono, kbits) of a 32-bit header; None if it is none."""
    if word >> 21 != 0x7FF:
        return None
    version, layer = {3: 1, 2: 2, 0: 25}.get(word >> 19 & 3), {3: 1, 2: 2, 1: 3}.get(word >> 17 & 3)
    rate_at, bit_at = word >> 10 & 3, word >> 12 & 15
    if version is None or layer is None or rate_at == 3 or bit_at in (0, 15):
        return None  # reserved values, and free-format streams
    rate = RATES[rate_at] // {1: 1, 2: 2, 25: 4}[version]
    kbits, pad = KBITS[version == 1, layer][bit_at], word >> 9 & 1
    if layer == 1:
        samples, size = 384, (12000 * kbits // rate + pad) * 4
    else:
        samples = 576 if layer == 3 and version != 1 else 1152
        size = samples // 8 * 1000 * kbits // rate + pad
    return version, layer, not word >> 16 & 1, size, samples, rate, word >> 6 & 3 == 3, kbits


_seen: dict[int, tuple | None] = {}


def header_of(word: int):
    try:
        return _seen[word]
    except KeyError:
        if len(_seen) > 50_000:
            _seen.clear()
        return _seen.setdefault(word, header(word))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x8005, table << 1) & 0xFFFF
    return table


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """MPEG's CRC-16 of each row of bytes, all rows at once."""
    state = np.full(len(rows), 0xFFFF, np.uint32)
    for j in range(rows.shape[1]):
        state = (state << 8 & 0xFFFF) ^ CRC[(state >> 8) ^ rows[:, j]]
    return state


def side_bytes(version: int, mono: bool) -> int:
    return (17 if mono else 32) if version == 1 else (9 if mono else 17)


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def text_frame(name: str, text: str) -> bytes:
    body = b"\x03" + text.encode()
    return name.encode() + syncsafe(len(body)) + b"\0\0" + body


RATE_INDEX, MONO = 1, 3  # 48,000 samples a second, one channel: a frame has 3 bytes for each kbit/s
HEAD, SIDE, CHECK = 4, 17, 2
#: bytes of payload in a frame, by bitrate index
ROOM = {i: 3 * k - HEAD - CHECK - SIDE for i, k in enumerate(KBITS[True, 3]) if k}


def frames(payload: bytes) -> bytes:
    """Frames of the highest bitrate, and one last frame of the least that holds the rest."""
    full = ROOM[14]
    n, rest = divmod(len(payload), full)
    out = []
    for bit_at, count, data in ((14, n, payload[: n * full]), (min((i for i in ROOM if ROOM[i] >= rest), default=14), int(rest > 0), payload[n * full :])):
        if not count:
            continue
        size = 3 * KBITS[True, 3][bit_at]
        block = np.zeros((count, size), np.uint8)
        block[:, :4] = (0xFF, 0xFA, bit_at << 4 | RATE_INDEX << 2, MONO << 6)  # version 1, layer III, with checksum
        check = crc16(np.concatenate([block[:, 2:4], block[:, 6 : 6 + SIDE]], axis=1)[:1])[0]
        block[:, 4], block[:, 5] = check >> 8, check & 255
        room = np.zeros(count * ROOM[bit_at], np.uint8)
        room[: len(data)] = np.frombuffer(data, np.uint8)
        block[:, HEAD + CHECK + SIDE :] = room.reshape(count, -1)
        out.append(block.tobytes())
    return b"".join(out)


def encode(payload: bytes) -> bytes:
    """An MPEG audio stream that holds ``payload``."""
    body = frames(payload)
    n = (len(body) + 959) // 960
    sizes = np.minimum(960, len(body) - 960 * np.arange(n))
    toc = bytes((np.concatenate([[0], np.cumsum(sizes)])[np.arange(100) * n // 100] * 255 // max(1, len(body))).astype(np.uint8))
    first = bytearray(240)
    first[:4] = (0xFF, 0xFB, 6 << 4 | RATE_INDEX << 2, MONO << 6)
    table = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + (len(body) + 240).to_bytes(4, "big") + toc
    first[HEAD + SIDE : HEAD + SIDE + len(table)] = table
    tags = text_frame("TXXX", f"payload_bytes\0{len(payload)}") + text_frame("TXXX", f"payload_crc32\0{zlib.crc32(payload)}")
    return b"ID3\x04\0\0" + syncsafe(len(tags)) + tags + bytes(first) + body


def read_tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Text tags, and where the audio begins and ends."""
    tags, at, end = {}, 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        major, flags = data[at + 3], data[at + 5]
        safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
        stop = min(end, at + 10 + safe(data[at + 6 : at + 10]))
        p = at + 10
        if flags & 64 and p + 4 <= stop:  # extended header
            p += safe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4], "big")
        while major >= 3 and p + 10 <= stop and data[p]:
            name = data[p : p + 4].decode("latin-1")
            size = safe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
            body = data[p + 10 : min(stop, p + 10 + size)]
            if name[0] == "T" and body:
                text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(3, body[0])], "replace").rstrip("\0")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags[key] = value
            p += 10 + size
        at = stop + (10 if flags & 16 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, lo, hi in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if value := data[end + lo : end + hi].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(key, value)
    return tags, at, end


def read_table(data: bytes, at: int, head: tuple) -> dict | None:
    """The variable-bitrate table of a frame: Xing or Info behind the side information, or VBRI at its fixed place."""
    p = at + HEAD + (CHECK if head[2] else 0) + side_bytes(head[0], head[6])
    if data[p : p + 4] in (b"Xing", b"Info"):
        flags, q, out = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8, {"kind": data[p : p + 4].decode()}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key] = int.from_bytes(data[q : q + 4], "big")
                q += 4
        if flags & 4:
            out["toc"] = list(data[q : q + 100])
        return out
    p = at + 36
    if data[p : p + 4] == b"VBRI":
        of = lambda lo, hi: int.from_bytes(data[p + lo : p + hi], "big")
        scale, width, count = of(20, 22), of(22, 24), of(18, 20)
        steps = [of(26 + width * i, 26 + width * (i + 1)) * scale for i in range(min(count, 65536))]
        return {"kind": "VBRI", "bytes": of(10, 14), "frames": of(14, 18), "toc": [int(x) for x in np.cumsum([0, *steps])[:-1]]}
    return None


def parse(data: bytes) -> dict:
    """Tags, table, frames, checksum results, exact duration, seek offsets and main data of a stream.

    A header counts if the frame fits into the stream and it either goes on with the version, layer and rate of the frame
    before it, or another such header, or the end, follows; else the search goes on at the next sync byte. Such steps over junk are counted as ``resyncs``.
    """
    tags, at, end = read_tags(data)
    table, offsets, spans, resyncs, lost = None, [], [], 0, False
    samples: dict[int, int] = {}
    while at + 4 <= end:
        h = header_of(int.from_bytes(data[at : at + 4], "big"))
        ok = h is not None and at + h[3] <= end
        sure = offsets and not lost and (h and (h[0], h[1], h[5])) == (spans[-1][0], spans[-1][1], spans[-1][5])
        if ok and not sure and at + h[3] + 4 <= end:
            g = header_of(int.from_bytes(data[at + h[3] : at + h[3] + 4], "big"))
            ok = g is not None and (g[0], g[1], g[5]) == (h[0], h[1], h[5])
        if not ok:
            nxt = data.find(b"\xff", at + 1, end)
            resyncs, lost = resyncs + (not lost), True
            if nxt < 0:
                break
            at = nxt
            continue
        lost = False
        if not offsets and table is None and h[1] == 3 and (table := read_table(data, at, h)):
            at += h[3]
            continue
        offsets.append(at)
        spans.append(h)
        samples[h[5]] = samples.get(h[5], 0) + h[4]
        at += h[3]
    checked, bad = 0, 0
    raw = np.frombuffer(data, np.uint8)
    layer3 = [(o, side_bytes(h[0], h[6])) for o, h in zip(offsets, spans) if h[2] and h[1] == 3]
    for side in {s for _, s in layer3}:
        of = np.array([o for o, s in layer3 if s == side])
        of = of[of + 6 + side <= len(raw)]
        cover = np.concatenate([raw[of[:, None] + np.arange(2, 4)], raw[of[:, None] + 6 + np.arange(side)]], axis=1)
        stored = raw[of + 4].astype(np.uint32) << 8 | raw[of + 5]
        checked += len(of)
        bad += int((crc16(cover) != stored).sum())
    main = b"".join(data[o + HEAD + (CHECK if h[2] else 0) + (side_bytes(h[0], h[6]) if h[1] == 3 else 0) : o + h[3]] for o, h in zip(offsets, spans))
    seconds = sum((Fraction(n, rate) for rate, n in samples.items()), Fraction(0))
    return {
        "tags": tags, "table": table, "offsets": offsets, "kbits": [h[7] for h in spans], "resyncs": resyncs, "checked": checked, "bad": bad,
        "seconds": seconds, "main": main,
    }


def decode(data: bytes) -> bytes:
    """The payload that ``encode`` stored."""
    got = parse(data)
    payload = got["main"][: int(got["tags"]["payload_bytes"])]
    if got["bad"] or zlib.crc32(payload) != int(got["tags"]["payload_crc32"]):
        raise ValueError("a checksum of the stored stream is wrong")
    return payload


def padded(text: bytes) -> bytes:
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``, the MPEG audio stream of each text; null texts count as empty."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col("doc_id").cast("long"), utf8(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


INFO = (
    "doc_id long, n_bytes long, tags map<string,string>, table_kind string, table_frames long, frames long, resyncs long, checked long, bad long, "
    "duration_num long, duration_den long, seek array<long>, payload binary"
)


def probe(media: DataFrame) -> DataFrame:
    """What each stream holds: tags, table, frame and checksum counts, duration as an exact fraction of a second, the
    offset of every frame, and the stored payload (null without a length tag)."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                got = parse(data or b"")
                size, s = got["tags"].get("payload_bytes"), got["seconds"]
                rows.append(
                    (
                        i, n, list(got["tags"].items()), got["table"] and got["table"]["kind"], got["table"] and got["table"].get("frames"), len(got["offsets"]),
                        got["resyncs"], got["checked"], got["bad"], s.numerator, s.denominator, got["offsets"], got["main"][: int(size)] if size else None,
                    )
                )
            names = [x.split()[0] for x in INFO.split(", ")]
            types = [pa.int64()] * 2 + [pa.map_(pa.string(), pa.string()), pa.string()] + [pa.int64()] * 7 + [pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 13, types)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, INFO)


DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, frames long, duration_num long, duration_den long, seek string"
)


def digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: sizes and digests of the stored stream and of the payload read back from it.

    feature: frames, checksum failures, duration as a fraction of a second, the table's frame count, and a digest of the
    frame offsets. duration_num / duration_den is the exact duration in seconds, seek the offset of every frame, comma-joined.
    Null and empty texts are one unit of blanks; repeated rows get equal values; an empty table gives an empty result; other
    columns are ignored.
    """

    def run(batches):
        names = [x.split()[0] for x in DIGEST.split(", ")]
        for batch in batches:
            rows = []
            for i, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                got = parse(data)
                payload = got["main"][: int(got["tags"]["payload_bytes"])]
                if got["bad"] or zlib.crc32(payload) != int(got["tags"]["payload_crc32"]):
                    raise ValueError("a checksum of the stored stream is wrong")
                s, seek = got["seconds"], np.array(got["offsets"], "<i8")
                feature = f"frames={len(seek)};bad={got['bad']};seconds={s};table={got['table']['frames']};kbits={sum(got['kbits'])};seek={zlib.crc32(seek.tobytes()):08x}"
                rows.append(
                    (
                        i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(),
                        feature, len(seek), s.numerator, s.denominator, ",".join(map(str, got["offsets"])),
                    )
                )
            types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)

    return store(docs, text_col).mapInArrow(run, DIGEST)

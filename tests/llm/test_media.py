import hashlib
import random
import zlib
from fractions import Fraction

from trendloom.llm import media as M


def test_round_trip_and_resync():
    rnd = random.Random(1)
    for n in (1, 192, 400, 5000, 100_003):
        payload = rnd.randbytes(n)
        data = M.encode(payload)
        assert M.decode(data) == payload
        got = M.parse(data)
        assert got["table"]["frames"] == len(got["offsets"]) and got["checked"] == len(got["offsets"]) and not got["bad"]
        assert got["seconds"] == Fraction(1152 * len(got["offsets"]), 48000)
    payload = b"x" * 9000
    data = M.encode(payload)
    o = M.parse(data)["offsets"]
    junk = data[: o[3]] + b"\xff\xfbjunk\xff" * 5 + data[o[3] :] + b"TAG" + b"title".ljust(125, b"\0")
    got = M.parse(junk)
    assert len(got["offsets"]) == len(o) and got["resyncs"] == 1 and got["tags"]["TIT2"] == "title" and got["main"][:9000] == payload
    broken = bytearray(data)
    broken[o[1] + 8] ^= 1
    assert M.parse(bytes(broken))["bad"] == 1
    assert M.parse(b"")["offsets"] == [] and M.parse(b"\xff" * 50)["offsets"] == []


def test_headers():
    assert M.header(0xFFFB9000) == (1, 3, False, 417, 1152, 44100, False, 128)
    assert M.header(0xFFFB9200)[3] == 418
    assert M.header(0xFFF38000)[4:6] == (576, 22050)
    assert M.header(0xFFFF1000)[4] == 384
    assert M.header(0xFFFBF000) is None and M.header(0x12345678) is None


def test_vbri_table():
    data = bytearray(4 * 417)
    for i in range(4):
        data[i * 417 : i * 417 + 4] = b"\xff\xfb\x90\0"
    table = b"VBRI" + bytes(6) + (1668).to_bytes(4, "big") + (3).to_bytes(4, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big")
    data[36 : 36 + len(table) + 4] = table + (417).to_bytes(2, "big") * 2
    got = M.parse(bytes(data))
    assert got["table"] == {"kind": "VBRI", "bytes": 1668, "frames": 3, "toc": [0, 417]} and len(got["offsets"]) == 3


def test_digests(spark):
    texts = [None, "", "a", "é" * 96, "é" * 97, "long " * 60000]
    rows = [(i, t, 0, "m") for i, t in enumerate(texts)] + [(2, "a", 1, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, frames int, media string")
    got = M.digests(docs).collect()
    assert len(got) == len(rows) and M.digests(docs.limit(0)).count() == 0
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
    info = M.probe(M.store(docs)).where("doc_id = 5").first()
    whole = next(r for r in got if r.doc_id == 5)
    assert (whole.duration_num, whole.duration_den) == (info.duration_num, info.duration_den) and whole.seek == ",".join(map(str, info.seek))
    assert info.payload.rstrip(b" ") == ("long " * 60000).strip().encode() and info.duration_num * 48000 == info.frames * 1152 * info.duration_den

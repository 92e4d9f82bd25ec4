"""Fill-in-middle over frames: cuts against the regular expression, outputs, and exact round trips."""

import hashlib
import random
import re

from trendloom.llm import frames

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_cuts_and_round_trips_over_small_frames():
    draw = random.Random(2)
    for _ in range(500):
        text = "".join(draw.choice(["a", "é", " ", "\n", "<", "P", ">", "S", "M", "𝄞", " x"]) for _ in range(draw.randint(0, 60)))
        size = draw.choice([1, 3, 7, 20])
        stored, n, n_bytes = frames.pack([text.encode()], size)
        units = UNITS.findall(text)
        assert (n, n_bytes) == (len(units), len(text.encode()))
        f = frames.Frames(stored, n, n_bytes)
        assert b"".join(f.read()).decode() == text
        for u in range(n + 1):
            assert f.cut(u) == (len("".join(units[:u]).encode()), len("".join(units[:u])))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
            continue
        i, j = sorted((draw.randint(0, n), draw.randint(0, n)))
        prefix, middle, suffix = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
        for form, want in (("psm", f"<P>{prefix}<S>{suffix}<M>{middle}"), ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}")):
            output = frames.opened(frames.pack(frames.arranged(f, form, f.cut(i)[0], f.cut(j)[0]), size)[0])
            assert b"".join(output.read()).decode() == want
            assert b"".join(frames.restored(output, form)).decode() == text


def plain(doc_id, text):
    text = text or ""
    h = [int(sha(f"42:{doc_id if doc_id is not None else ''}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (n, "plain", None, None, sha(text), sha(text))
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return (n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_rows_of_all_kinds(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(i, " ".join("é" * draw.randint(1, 9) for _ in range(draw.randint(0, 400))), "x") for i in range(60)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "a <M> b", "x"), (None, "no id here", "x"), (3, rows[3][1], "x"), (103, " \n\t ", "x"), (104, "w" * 300_000 + " end", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    for docs in (df, df.repartition(3)):
        got = sorted(map(tuple, frames.per_document(docs).collect()), key=repr)
        assert got == sorted([(i, *plain(i, t)) for i, t, _ in rows], key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    texts = {r.doc_id: r.text for r in frames.texts(frames.transform(frames.store(df, 64))).collect()}
    assert all(sha(texts[i]) == plain(i, t)[4] for i, t, _ in rows)


def test_empty_table(spark):
    assert frames.per_document(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_only_one_frame_is_open_at_a_time():
    stored, n, n_bytes = frames.pack([("word " * 100_000).encode()])
    f = frames.Frames(stored, n, n_bytes)
    assert len(stored) > 5 and max(map(len, f.read())) <= 2 * frames.FRAME
    opened = []
    plain_open = f.unsqueeze
    f.unsqueeze = lambda data: opened.append(1) or plain_open(data)
    assert f.cut(70_000) == (349_999, 349_999) and len(opened) == 1

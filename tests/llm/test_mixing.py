import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard

from trendloom.llm import mixing as M

SQUEEZE = zstandard.ZstdCompressor(level=1).compress
GOLD, MIX, MASK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1


def lower(b):
    return b + 32 if 65 <= b <= 90 else b


def brute_slot(text, i, order, bits):
    """The slot of the context before place i, worked out with plain integers."""
    value = sum(lower(text[i - j]) << 8 * (j - 1) for j in range(1, M.ORDERS[order] + 1) if i - j >= 0)
    h = value * GOLD & MASK
    h = (h ^ h >> 32) * MIX & MASK
    return h >> (64 - M.bits_of(order, bits))


def before(text, i):
    return lower(text[i - 1]) if i else 0


def built(data, bits):
    """Model of (text, times) rows through the functions that Spark runs, and the same counts by brute force."""
    pairs = np.zeros((256, 256), np.int64)
    for t, n in data:
        for i, b in enumerate(t):
            pairs[before(t, i), b] += n
    got = list(M.byte_counts([pa.RecordBatch.from_arrays([pa.array([SQUEEZE(t) for t, _ in data]), pa.array([n for _, n in data])], ["body", "n"])]))[0]
    assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist())) == {int(i): int(pairs.ravel()[i]) for i in np.flatnonzero(pairs)}
    paths = M.Paths.of(pairs)
    halves = [data[::2], data[1::2]]
    batches = [pa.RecordBatch.from_arrays([pa.array([SQUEEZE(t) for t, _ in h], pa.binary()), pa.array([n for _, n in h], pa.int64())], ["body", "n"]) for h in halves]
    rows = [b for h in batches for b in M.count_blocks(bits)([h])]
    ordered = pa.Table.from_batches(rows).sort_by("cell").combine_chunks().to_batches()
    out = pa.Table.from_batches(M.build_blocks(paths)(ordered))
    assert len(set(out["cell"].to_pylist())) == len(out)
    model = M.Model.of(out["cell"].to_pylist(), out["codes"].to_pylist(), paths, bits)
    return model, pairs


def test_tables_and_scores_against_brute_force():
    rnd = random.Random(1)
    data = [(bytes(rnd.choices(b"abc AB\xff", k=rnd.randint(0, 120))), rnd.choice([1, 1, 1, 3])) for _ in range(40)]
    bits = 18
    model, pairs = built(data, bits)
    trees = [M.huffman(row) for row in pairs]
    node = lambda a: (a + 1) * 40503 & 0xFFFF
    n, ones = [defaultdict(int) for _ in M.ORDERS], [defaultdict(int) for _ in M.ORDERS]
    for t, times in data:
        for i, b in enumerate(t):
            for a, bit in trees[before(t, i)][b]:
                for k in range(len(M.ORDERS)):
                    slot = brute_slot(t, i, k, bits) ^ node(a)
                    n[k][slot] += times
                    ones[k][slot] += bit * times
    for k, table in enumerate(model.tables):
        assert set(np.flatnonzero(table)) == set(n[k])
        for slot, c in n[k].items():
            exact = math.log((ones[k][slot] + 0.4) / (c - ones[k][slot] + 0.4))
            conf = sum(c >= x for x in M.CONFIDENCE)
            assert M.CONF[table[slot]] == conf and abs(M.LOGIT[table[slot]] - exact) <= M.REACH[conf - 1] / (M.LEVELS[conf - 1] - 1) + 1e-9
    # online mixing, decision by decision
    for text in (data[0][0], data[5][0] * 4, b"", b"a", b"zz\0"):
        weights, offset, total, done = model.start.copy(), np.zeros(M.RANGES), 0.0, 0
        steps = M.step_of(len(text))
        while done < len(text):
            stop = done + int((steps == steps[done]).sum())
            grad_w, grad_o = np.zeros_like(weights), np.zeros_like(offset)
            for i in range(done, stop):
                for a, bit in trees[before(text, i)][text[i]]:
                    code = [model.tables[k][brute_slot(text, i, k, bits) ^ node(a)] for k in range(3)]
                    gate = M.CONF[code[2]] * 6 + M.CONF[code[1]]
                    x = float(np.clip(sum(weights[k, gate] * M.LOGIT[code[k]] for k in range(3)), -11.9, 11.9))
                    place = int((x + 12) * M.RANGES / 24)
                    p = 1 / (1 + math.exp(-x - offset[place]))
                    total += math.log10(p if bit else 1 - p)
                    for k in range(3):
                        grad_w[k, gate] += (bit - p) * M.LOGIT[code[k]]
                    grad_o[place] += bit - p
            weights += M.RATE * grad_w
            offset = np.clip(offset + M.OFFSET_RATE * grad_o, -2, 2)
            done = stop
        assert abs(model.log10([text])[0] - total) < 1e-6 * max(1, -total)
    whole = [t for t, _ in data]
    assert np.allclose(model.log10(whole), [model.log10([t])[0] for t in whole], rtol=1e-9)
    prefix = whole[1] + b"ab"
    assert abs(sum(10 ** (model.log10([prefix + bytes([b])])[0] - model.log10([prefix])[0]) for b in range(256)) - 1) < 0.02


def test_tune_lowers_the_loss():
    rnd = random.Random(2)
    make = lambda: b" ".join(rnd.choices([b"alpha", b"beta", b"gamma", b"delta"], k=60))
    model, _ = built([(make(), 1) for _ in range(30)], 18)
    held = [make() for _ in range(20)]
    before_ = model.log10(held).sum()
    model.tune([make() for _ in range(20)])
    after = model.log10(held).sum()
    assert after > before_ and -after / math.log10(2) / sum(map(len, held)) < 0.6


def test_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    rows = list(docs.itertuples(index=False, name=None))
    rows += [(100001, None), (100002, ""), (100003, "Zzz qqq"), (100003, "Zzz qqq"), (100005, "a " * 20000), (None, "no id"), (100007, "a " * 20000)]
    frame = spark.createDataFrame([(i if i is None else int(i), t, 1.0, "w", 5) for i, t in rows], "doc_id long, text string, score double, word string, n int")
    got = M.score(frame).collect()
    tok = lambda t: [*(t or "").encode().lower().split(), b" "]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = [(i or -1, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 5)) for i, t in rows]
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    out = [r for r in got if r.held_out and r.doc_id < 100000]
    raw = "".join(t for i, t in rows if i and i < 100000 and held(i)).encode()
    flat = sum(k * math.log2(k / len(raw)) for k in Counter(raw).values()) / len(raw)
    assert -sum(r.score for r in out) / math.log10(2) / len(raw) < -0.8 * flat  # well under the bytes' own entropy
    assert {r.score for r in got if r.doc_id in (100001, 100002)} == {0.0}
    assert len({r.score for r in got if r.doc_id in (100005, 100007)}) == 1
    assert M.score(frame.limit(0)).count() == 0


def test_every_training_text_is_counted_and_none_sets_the_weights(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("abcdefghij ", k=60)) for _ in range(300)]
    rows = M.distinct_texts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("doc_id", "text", "unhex(md5(text)) AS th", "false AS held_out"))
    model = M.train(rows)
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        _, gate, *_ = model.predictions(raw, M.last_bytes(raw, np.array([0])), M.Room())
        assert (gate >= 6).all() and (gate % 6 > 0).all()  # both of the longest orders have seen every byte of it
    assert (model.start == np.array(M.START)[:, None]).all()


def test_room_that_is_used_again_does_not_change_scores():
    rnd = random.Random(5)
    data = [bytes(rnd.choices(b"abc AB", k=k)) for k in (300, 5, 0, 90, 2000, 40)]
    model, _ = built([(t, 1) for t in data], 18)
    room = M.Room()
    got = [model._log10([t], room)[0] for t in data if t]
    assert got == [model._log10([t], M.Room())[0] for t in data if t]
    assert {len(a) for a in room.held.values()} == {max(map(len, room.held.values()))}  # the largest serves all


def test_long_texts_are_refined_as_often_as_short_ones_and_in_parts(monkeypatch):
    assert set(np.bincount(M.step_of(100 * M.STEP)).tolist()) == {M.STEP}
    rnd = random.Random(6)
    data = [bytes(rnd.choices(b"abc AB", k=k)) for k in (300, 5, 0, 90, 7000, 40, M.STEP, 2 * M.STEP + 1)]
    model, _ = built([(t, 1) for t in data[:4]], 18)
    whole = model.log10(data)
    monkeypatch.setattr(M, "BATCH", 4 * M.STEP)  # several parts of a text, whose weights, offsets and contexts go on
    assert np.allclose(model.log10(data), whole, rtol=1e-9)
    monkeypatch.setattr(M, "SIDE", 2)
    assert np.allclose(model.log10(data), whole, rtol=1e-9)

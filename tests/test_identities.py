"""Identities, overlaps and samples against plain Python."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from trendloom.operators.components import identity_issues
from trendloom.operators.overlap import normal_form, overlaps
from trendloom.operators.sampling import balanced_sample, holdout_plan


def normal(s):
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", s).casefold())


def test_compatibility_forms_are_one_text(spark):
    texts = ["ﬁne Ｆｕｌｌ ½", "FINE full 1⁄2", "Straße", "STRASSE", "a b\n", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(normal_form("t")).collect()]
    assert got == [None if t is None else normal(t) for t in texts] and got[0] == got[1] and got[2] == got[3]


@pytest.mark.parametrize("most", [10, 4_000_000])
def test_overlaps_equal_all_pairs(spark, most):
    draw = random.Random(9)
    text = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    base = [text(300), text(260), text(199), text(900)]
    cases = [(1, base[0], "k1"), (2, base[1], ""), (3, base[2], None), (4, base[3], "k4"), (5, None, "k5"), (6, base[0][:215], "k6")]
    pool = [(10, base[0].upper(), None), (11, base[0] + text(400), "k1"), (12, base[1][:230] + text(40), "k9"), (13, base[1][:150] + text(120), ""), (14, base[2], "k4"), (15, base[2] + "x", None), (16, text(500), None), (17, base[3][300:600], "k5"), (18, base[0] + text(400), None), (19, "", None), (19, "", None)]
    pool += [(20, pool[1][1], None)] * 2
    schema = "id long, text string, record string"
    got = {(r.case_id, r.id): r.reasons for r in overlaps(spark.createDataFrame(cases, schema), spark.createDataFrame(pool, schema), ["record"], most=most).collect()}
    grams = lambda s: {s[i : i + 12] for i in range(len(s) - 11)}
    want = {}
    for i, s, k in cases:
        for j, t, m in pool:
            a, b = normal(s or ""), normal(t or "")
            why = {"record"} if k and k == m else set()
            if a and a == b:
                why.add("exact_transcript")
            elif min(len(a), len(b)) >= 200 and len(grams(a) & grams(b)) >= 0.8 * min(len(grams(a)), len(grams(b))):
                why.add("near_transcript_requires_review")
            if why:
                want[i, j] = ",".join(sorted(why))
    assert got == want and {"exact_transcript", "near_transcript_requires_review", "record"} <= set(want.values())


def test_issues_equal_a_union_of_sets(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice(["fit", "fit", "test", None]), f"c{i // 3}" if i % 2 else None, draw.choice(["", f"v{draw.randrange(60)}"]), draw.choice([None, f"h{draw.randrange(60)}"])) for i in range(90)]
    got = {r.id: (r.component, r.reasons) for r in identity_issues(spark.createDataFrame(rows, "id long, role string, channel string, video string, sha string"), "id", ["channel", "video", "sha"], ["video", "sha"], "role").collect()}
    label = {r[0]: r[0] for r in rows}
    while True:
        groups = defaultdict(list)
        for i, _, *values in rows:
            for k, x in enumerate(values):
                if x:
                    groups[k, x].append(i)
        before = dict(label)
        for members in groups.values():
            low = min(label[i] for i in members)
            for i in members:
                label[i] = min(label[i], low)
        if before == label:
            break
    reasons = defaultdict(set)
    roles = {r[0]: r[1] for r in rows}
    for i in label:
        if len({roles[j] for j in label if label[j] == label[i]} - {None}) > 1:
            reasons[i].add("identity_crosses_outcome_partitions")
    for (k, _), members in groups.items():
        if k and len(members) > 1:
            mixed = len({roles[i] for i in members} - {None}) > 1
            for i in members:
                if mixed or i != min(members):
                    reasons[i].add("identity_crosses_outcome_partitions" if mixed else "duplicate_video_or_transcript")
    assert got == {i: (label[i], ",".join(sorted(reasons[i]))) for i in label}


def plain_sample(rows, size, test, seed):
    h = lambda i, s=seed: hashlib.sha256(f"{s}|{i}".encode()).hexdigest()
    turn, place, ranked = Counter(), Counter(), []
    for i, cat, ch in sorted(rows, key=lambda r: h(r[0])):
        turn[cat, ch] += 1
        ranked.append((cat, turn[cat, ch], h(i), i))
    out = []
    for cat, _, x, i in sorted(ranked):
        place[cat] += 1
        out.append((place[cat], cat, x, i))
    chosen = sorted(out)[:size]
    counts = Counter(c for _, c, _, _ in chosen)
    n = len(chosen)
    target = n * test // size if n < size else min(test, n - 1)
    quota = {c: k * target // n for c, k in counts.items()}
    for c in sorted(counts, key=lambda c: (-(counts[c] * target % n), c))[: target - sum(quota.values())]:
        quota[c] += 1
    split, used = {}, Counter()
    for _, c, _, i in sorted(chosen, key=lambda r: (r[1], h(r[3], "split|" + seed))):
        split[i] = "test" if used[c] < quota[c] else "development"
        used[c] += 1
    return split


@pytest.mark.parametrize("size, test", [(20, 7), (45, 11), (500, 100)])
def test_samples_take_turns(spark, size, test):
    draw = random.Random(size)
    rows = [(i, draw.choice("aaab"), draw.choice("xxxxyz")) for i in range(60)] + [(100, "c", None), (101, "c", "x")]
    got = {r.id: r.split for r in balanced_sample(spark.createDataFrame(rows, "id long, category string, channel string"), size, test, "s").collect()}
    assert got == plain_sample(rows, size, test, "s")
    with pytest.raises(ValueError):
        balanced_sample(spark.createDataFrame(rows, "id long, category string, channel string"), 5, 5, "s")


def test_holdouts_move_whole_channels(spark):
    rows = [(i, f"c{i % 12}", i % 5 > 0, "train" if i % 12 < 9 else "validation") for i in range(120)] + [(500, "c1", True, "test")]
    channels, changes = holdout_plan(spark.createDataFrame(rows, "id long, channel string, known boolean, split string"), 10, 5)
    plan = {r.channel: r for r in channels.collect()}
    unknown = Counter(c for _, c, known, _ in rows if not known)
    assert set(plan) == set(unknown) and plan["c1"].conflict and plan["c1"].new_split is None and plan["c1"].place is None
    free = sorted((c for c in unknown if int(c[1:]) < 9 and c != "c1"), key=lambda c: hashlib.sha256(f"scope-holdout-v1:{c}".encode()).hexdigest())
    need, want, split = 10 - sum(n for c, n in unknown.items() if int(c[1:]) >= 9), {}, "validation"
    for c in free:
        if need <= 0:
            need, split = (5, "test") if split == "validation" else (0, None)
        want[c] = split
        need -= unknown[c]
    assert {c: plan[c].new_split for c in free} == want and {"validation", "test"} <= set(want.values())
    assert sorted((r.id, r.new_split) for r in changes.collect()) == sorted((i, want[c]) for i, c, *_ in rows if want.get(c))
    assert all(x.count() == 0 for x in holdout_plan(spark.createDataFrame([], "id long, channel string, known boolean, split string"), 1, 1))

"""MinHash near duplicates against all pairs of whole sets."""

import random

import numpy as np
import pytest

from spindrift.llm import jaccard, minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(rows, n):
    out = []
    for doc, text in rows:
        ws = [w for w in (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").split(" ") if w]
        out.append((doc, frozenset(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) or (frozenset([tuple(ws)]) if ws else frozenset())))
    return out


def brute(rows, n, percent):
    """{(doc, size): component} by all pairs; rows that share an id are linked."""
    sets = word_sets(rows, n)
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (d, x) in enumerate(sets):
        for j, (e, y) in enumerate(sets[:i]):
            if d is not None and e is not None and x and y and (d == e or 100 * len(x & y) >= percent * len(x | y)):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted((repr(d), len(x), repr(least.get(top(i)) if d is not None else None)) for i, (d, x) in enumerate(sets))


def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)] + ["École", "ÇA", "ИМЯ"]
    prose = lambda k: [rng.choice(words) for _ in range(k)]
    base = [prose(rng.randrange(0, 200)) for _ in range(60)]
    out = [(i, " ".join(w)) for i, w in enumerate(base)]
    common = prose(150)
    for i in range(80):  # a large group of near copies, and texts that share most of a passage
        w = list(common)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((200 + i, " ".join(w)))
        out.append((300 + i, " ".join(common[:120] + prose(rng.randrange(10, 120)))))
    for i in range(40):
        w = list(base[i])
        if w:
            w[rng.randrange(len(w))] = "changed"
        out.append((400 + i, " ".join(w)))
    out += [(500, out[3][1]), (501, out[3][1].upper()), (502, None), (503, ""), (504, " \t\n"), (505, " ".join(prose(20_000))), (506, "x" * 50_000)]
    return out + [(7, out[7][1]), (None, out[7][1]), (507, "one"), (508, "ONE"), (509, out[40][1]), (3, out[9][1]), (510, "one two")]


@pytest.mark.parametrize("n, percent", [(5, 85), (5, 80), (2, 90)])
def test_components_against_all_pairs(spark, n, percent, monkeypatch):
    given = rows()
    if percent == 90:  # small bands and blocks: stars, several blocks, whole products
        monkeypatch.setattr(jaccard, "COLD", 3)
        monkeypatch.setattr(jaccard, "BLOCK", 25)
        monkeypatch.setattr(minhash, "FAILURES", 0)
    df = spark.createDataFrame([(d, t, "n", "p") for d, t in given], "doc_id long, text string, sketch string, keys string").repartition(3)
    got = sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in minhash.near_duplicates(df, n, percent).collect())
    assert got == brute(given, n, percent)


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(2)
    for s in (1.0, 0.95, 0.85, 0.7):
        counts = []
        for _ in range(60):
            tokens = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            k = round(1000 * (1 - s) / (1 + s))  # of 1000 tokens each side, k differ
            other = np.concatenate([tokens[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])
            x, y = minhash.odd_sketch(minhash.minima(tokens)), minhash.odd_sketch(minhash.minima(other))
            counts.append(int(np.bitwise_count((x ^ y).view(np.uint64)).sum()))
            assert s < 0.8 or counts[-1] <= minhash.furthest(80)
        told = np.mean([1 + minhash.BITS / (4 * minhash.SAMPLES) * np.log(1 - 2 * c / minhash.BITS) for c in counts])
        assert abs(told - s) < 0.03


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(one).collect()) == [(1, 0, 1, 1), (2, 0, 2, 2)]

"""The filter audit against applying the filters one by one."""

import random
import re
from itertools import permutations

import pytest

from spindrift.llm import interactions


def made():
    rng = random.Random(6)
    words = [f"word{i}" for i in range(300)] + ["ABC", "É", "Straße"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words if rng.random() < 0.7 else words[:20]) for _ in range(rng.choice([5, 150, 260, 420])))
        if rng.random() < 0.2:
            text += rng.choice([" #tag", " a|b", " 100%", "\tLOUD " * 60])
        rows.append((i, text, rng.choice(["x", "x", "y", None, ""])))
    rows += [(200 + i, rows[i * 3][1], "x") for i in range(25)] + [(300, None, "x"), (301, "", "y"), (302, "", "z"), (None, rows[0][1], "x"), (None, None, None), (303, "\x1c  a", "z"), (5, rows[5][1], "x"), (304, "A" * 90_000, "x")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i in range(0, 230, 2)] + [(2, 1, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def brute(rows, labels):
    firsts, good, toxic = {}, {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    for d, t, _ in rows:
        if d is not None:
            firsts[t or ""] = min(d, firsts.get(t or "", d))
    docs = []
    for d, t, p in rows:
        t = t or ""
        ws = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = {f for f, x in zip("ABCDE", (len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > firsts[t])) if x}
        docs.append((p or "", fails, d in good, d in toxic))
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                all_fail = [d for d in docs if d[0] == part and f in d[1]]
                out[part, "".join(order), step] = (len(left), len(gone), len(all_fail) - len(gone), sum(d[1] == {f} for d in all_fail), sum(d[2] for d in gone), sum(d[3] for d in gone))
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_brute_force(spark):
    rows, labels = made()
    docs = spark.createDataFrame([(d, t, p, "c", 1) for d, t, p in rows], "doc_id long, text string, source string, part string, same int").repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    got = {tuple(r)[:3]: tuple(r)[3:] for r in interactions.audit(interactions.judged(docs, told)).collect()}
    assert got == brute(rows, labels)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_own_filters_and_nothing(spark):
    rows = spark.createDataFrame([("p", True, False, True, False), ("p", False, True, True, True), ("q", None, None, None, False)], "part string, good boolean, toxic boolean, X boolean, Y boolean")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in interactions.audit(rows, "XY").collect()}
    assert got["p", "XY", 1] == (0, 2, 0, 1, 1, 1, 3) and got["p", "XY", 2] == (0, 0, 1, 0, 0, 0, 1)
    assert got["p", "YX", 1] == (1, 1, 0, 0, 0, 1, 1) and got["q", "YX", 2] == (1, 0, 0, 0, 0, 0, 0)
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert interactions.audit(interactions.judged(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
    with pytest.raises(ValueError):
        interactions.audit(rows, "XX")

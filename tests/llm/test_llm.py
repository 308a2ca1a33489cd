"""Each operator against brute force, on texts with nulls, repeats, ties, clashes and nothing at all."""

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import ann, chat, common, components, decontaminate, jaccard, packing, pii, quality, training_order, urls, warc
from spindrift.llm.common import scratch_path
from spindrift.llm.queries import RULES, tokenizer_path

rng = random.Random(5)
WORDS = [f"w{i}" for i in range(400)] + ["École", "ÇA", "ИМЯ"]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def made():
    """Rows (doc_id, text): prose, copies, near copies, nulls, empty and very long texts, repeated rows."""
    base = [prose(rng.randrange(0, 120)) for _ in range(60)]
    rows = list(enumerate(base))
    for i in range(20):
        words = base[i].split()
        if words:
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, base[3]), (201, base[3].upper()), (202, None), (203, ""), (204, " \t\n"), (205, prose(30_000)), (206, "x" * 50_000), (7, base[7]), (None, "no id"), (207, "one"), (208, "ONE")]
    return rows


ROWS = made()


def documents():
    return list(ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in documents()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- nearest neighbours


def test_nearest_against_brute_force(spark):
    g = np.random.default_rng(1)
    centres = g.normal(size=(6, 16))
    v = [(centres[i % 6] + 0.3 * g.normal(size=16)).astype(np.float32).tolist() for i in range(900)]
    rows = [(i, x) for i, x in enumerate(v)] + [(1000 + i, v[50]) for i in range(200)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0]), (None, v[0]), (2005, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, sample=400).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(x, np.float64) for i, x in rows if i is not None and (i < 2000)}
    found = total = 0
    for q in [i for i in good if i % 50 == 0]:
        s = sorted(((-float(good[q] @ x / np.linalg.norm(good[q]) / np.linalg.norm(x)), i) for i, x in good.items() if i != q))
        want = [i for _, i in sorted((round(a, 12), i) for a, i in s)[:5]]
        have = [i for _, i, _ in sorted(got[q])]
        assert len(have) == 5 and [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        for _, i, score in got[q]:
            assert math.isclose(score, float(good[q] @ good[i] / np.linalg.norm(good[q]) / np.linalg.norm(good[i])), abs_tol=1e-12)
        found, total = found + len(set(want) & set(have)), total + 5
    assert found / total >= 0.9
    assert [i for _, i, _ in sorted(got[1000])] == [50, 1001, 1002, 1003, 1004]


def test_nearest_where_one_id_has_many_vectors(spark):
    g = np.random.default_rng(3)
    q = g.normal(size=8)
    many = [(9, (q + 0.01 * g.normal(size=8)).tolist()) for _ in range(50)] + [(8, (q + 0.02 * g.normal(size=8)).tolist()) for _ in range(30)]
    others = [(i, g.normal(size=8).tolist()) for i in range(1, 8)]
    rows = [(50, q.tolist())] + many + others
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [r["vec_id"] for r in ann.nearest(df, F.col("vec_id") == 50).orderBy("rank").collect()]
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    best = {}
    for i, x in rows[1:]:
        best[i] = max(best.get(i, -2.0), float(unit(q) @ unit(x)))
    want = sorted(best, key=lambda i: -best[i])
    assert len(set(got)) == 5 and got[:2] == want[:2] and got == sorted(got, key=lambda i: -best[i]) and len(set(got) & set(want[:5])) >= 4



def test_nearest_among_repeated_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(10)] * 4 + [(100 + i, [1.0, 0.1 + i / 100]) for i in range(10)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    # the leaf of the hot vector holds one id, so the search has to go on
    g = np.random.default_rng(3)
    rows = [(0, [9.0] * 8)] * 40 + [(1 + i, g.normal(size=8).tolist()) for i in range(600)]
    assert ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 5


def test_nearest_with_clashing_columns(spark):
    g = np.random.default_rng(2)
    df = spark.createDataFrame([(i, g.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<float>")
    clash = df.withColumns({c: F.lit(7) for c in ("leaf", "query_id", "score", "rank", "v", "n", "block", "id")})
    rows = lambda x: sorted(tuple(r) for r in ann.nearest(x, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert rows(clash) == rows(df)


def test_nearest_of_little(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in got] == [(2, 0.707107), (1, 0.0)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_recall_on_supplied_vectors(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    ids = sorted(rows)
    x = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, held in got.items():
        s = x @ x[ids.index(q)]
        s[ids.index(q)] = -2
        hits += len(held & {ids[i] for i in np.argsort(-s)[:5]})
    assert hits / (5 * len(got)) >= 0.9


# --- URLs


def rule_of(host, path):
    best = None
    for what, rule in RULES:
        domain, _, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    return best


def test_urls_against_brute_force(spark):
    links = [None, "", "nothing", "http://EXAMPLE.org/es/x?q#f", "http://a.example.org/en/1", "http://org", "http://xorg/", "ftp://é.com/FR/", "http://b.com/de/" + "y" * 20_000]
    links += [f"https://good{i}.example.org/page/{i}" for i in range(60)] + [f"https://bad{i}.shop.com/de/xxx-{i}" for i in range(60)] + [f"https://good{i}.example.net/page/{i}" for i in range(20)] + [f"https://bad{i}.shop.net/de/xxx-{i}" for i in range(20)]
    df = spark.createDataFrame([(i, x, "h") for i, x in enumerate(links * 2)], "page_id long, url string, verdict string")
    out = {r["page_id"]: r for r in urls.judge(df, RULES).collect()}
    assert len(out) == len(links) * 2
    fold = {r["u"]: r["f"] for r in df.select(F.col("url").alias("u"), F.pmod(F.xxhash64("url"), F.lit(urls.HELD_OUT)).alias("f")).collect()}
    parts, counts = {}, {}
    for u in set(links):
        if not u or "://" not in u:
            continue
        s = re.sub(r"[^a-z0./?#=&_%:~+@,-]", "*", re.sub("[0-9]", "0", u.split("://", 1)[1].translate(LOWER)))
        parts[u] = [("^^^" + s + "$")[i : i + 4] for i in range(len(s) + 1)] if s else []
    for i, u in enumerate(links):
        r = out[i]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"[^/?#]*", rest).group().translate(LOWER), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        assert (r["host"], r["path"]) == (host, path)
        rule = rule_of(host, path)
        assert r["rule"] == (rule and rule[1])
        assert r["verdict"] == (rule[0] if rule else "allow" if r["score"] >= r["threshold"] else "block")
        if rule and fold[u]:
            for g in parts.get(u, []):
                for k in range(4):
                    c = counts.setdefault((k, g[3 - k : 3], rule[0]), {})
                    c[g[3]] = c.get(g[3], 0) + 1

    def p(g, what):
        value = 1 / urls.SYMBOLS
        for k in range(4):
            c = counts.get((k, g[3 - k : 3], what), {})
            if c:
                value = (c.get(g[3], 0) + len(c) * value) / (sum(c.values()) + len(c))
        return value

    for i, u in enumerate(links):
        if parts.get(u):
            want = sum(math.log(p(g, "allow") / p(g, "block")) for g in parts[u]) / len(parts[u])
            assert math.isclose(out[i]["score"], want, rel_tol=1e-9, abs_tol=1e-9)
    assert all(out[i]["verdict"] == "allow" for i, u in enumerate(links) if u and "good" in u)
    assert all(out[i]["verdict"] == "block" for i, u in enumerate(links) if u and "bad" in u)
    assert urls.judge(df.limit(0), RULES).count() == 0
    # without scores of what rules decide the rest is the same, also where urls are shuffled and the hot ones told to all
    bound, many = common.BROADCAST_ROWS, common.MANY
    for common.BROADCAST_ROWS, common.MANY in ((bound, many), (0, 50)):
        try:
            lean = {r["page_id"]: r for r in urls.judge(df.unionByName(df.where("page_id = 10").withColumn("page_id", F.explode(F.sequence(F.lit(1000), F.lit(1300))))), RULES, score_all=False).collect()}
        finally:
            common.BROADCAST_ROWS, common.MANY = bound, many
        assert len(lean) == len(out) + 301
        for i, r in out.items():
            assert (lean[i]["host"], lean[i]["rule"], lean[i]["verdict"]) == (r["host"], r["rule"], r["verdict"])
            assert lean[i]["score"] is None if r["rule"] else math.isclose(lean[i]["score"], r["score"], abs_tol=1e-12)


# --- decontamination


def test_decontamination_against_brute_force(spark):
    items = [(1, prose(14)), (2, "short item"), (3, "İ ONE-word; É2"), (4, None), (5, ""), (10, prose(9)), (11, prose(10))]
    rows = documents()
    for i, (_, t) in enumerate(items):
        if t:
            rows.append((300 + i, prose(37) + " - " + t.upper() + "! " + prose(13)))
            rows.append((320 + i, t))
    rows.append((350, " ".join([items[0][1]] * 300)))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int").repartition(4)
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    wins = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        m = min(10, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[j : j + m]), set()).add(i)
    want = []
    for d, t in rows:
        w = word.findall((t or "").translate(LOWER))
        hit, held = set(), set()
        for m in {len(k) for k in wins}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in wins:
                    hit |= set(range(j, j + m))
                    held |= wins[tuple(w[j : j + m])]
        want.append((d, len(w), len(hit), tuple(sorted(map(str, held)))))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.report(df, bench).collect()]
    key = lambda x: repr(x)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = decontaminate.remove(df, bench)
    assert kept.columns == df.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(d) for d, _, n, _ in want if not n)
    cut = decontaminate.remove(df, bench, mode="span")
    assert cut.count() == len(rows)
    again = {(d, n - h) for d, n, h, _ in want}
    assert {(r["doc_id"], r["n_words"]) for r in decontaminate.report(cut, bench).collect()} == again
    assert decontaminate.report(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.report(df.limit(0), bench).count() == 0


# --- chat


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\\\<|image:0|>", "</turn></turn>\n### user:\n", None, "", "é😀<|", "\\", "x" * 30_000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b\\"]), rng.choice(nasty)) for c in range(12) for t in range(rng.randrange(1, 9))]
    rows += [rows[0], (None, 0, "user", "null id"), (99, None, None, "null turn")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "conv_id long, turn long, role string, text string, number int")
    segments = chat.render_conversations(df)
    for ordered in (True, False):
        got = {r["conv_id"]: r for r in chat.read_back(segments, ordered).collect()}
        for c in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == c), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", json.dumps(r[3] or "", ensure_ascii=False)))
            whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
            loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
            assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(loss)
            assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
            assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert chat.read_back(chat.render_conversations(df.limit(0))).count() == 0


def test_chat_parts(spark):
    kind = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    rows = [(1, 0, "user", [("text", "look ", None, None, None, None, None), ("image", None, "a.png", 56, 57, None, None), ("audio", None, "b.wav", None, None, 1.5, None)]), (1, 1, "user", [("document", "page", "c.pdf", None, None, None, 2)]), (1, 2, "user", None)]
    got = chat.render_conversations(spark.createDataFrame(rows, kind), parts="parts").orderBy("number").collect()
    assert got[0]["segment"] == "### user:\nlook <|image:0|><|audio:1|></turn>\n"
    assert [(a["ref"], a["tokens"]) for r in got for a in r["attachments"]] == [("a.png", 6), ("b.wav", 38), ("c.pdf", 1152)]
    assert got[1]["segment"] == "### user:\n<|document:2|>page</turn>\n" and got[1]["start"] == len(got[0]["segment"])


# --- packing


def checked(counts, capacity):
    rows, made = packing.plan(counts, capacity)
    seen, held = {}, {}
    for n, rank, count, first, offset in rows.tolist():
        for j in range(count):
            held.setdefault(first + j, []).append((offset, n))
            assert seen.setdefault((n, rank + j), True) is True
    assert len(seen) == sum(counts.values())
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(held)


def test_plan_is_whole_and_tight():
    for seed in range(4):
        g = np.random.default_rng(seed)
        lengths = np.clip(g.lognormal(4, 1, 3000), 1, 256).astype(int)
        counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
        least = -(-int(lengths.sum()) // 256)
        assert checked(counts, 256) <= 1.02 * least + 2
    assert checked({}, 64) == 0 and checked({64: 3, 1: 1}, 64) == 4 and checked({33: 5}, 64) == 5


def decreasing(counts, capacity):
    """How many sequences plain best fit decreasing needs."""
    rooms, made = [0] * (capacity + 1), 0
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            room = next((r for r in range(n, capacity + 1) if rooms[r]), None)
            if room is None:
                room, made = capacity, made + 1
            else:
                rooms[room] -= 1
            rooms[room - n] += 1
    return made


def test_plan_needs_no_more_than_best_fit_decreasing():
    g = np.random.default_rng(3)
    draws = [g.integers(1, 257, 4000), g.integers(75, 138, 4000), g.integers(60, 113, 4000), np.clip(g.lognormal(4, 1, 4000), 1, 256), g.choice([129, 128, 86, 85, 43], 4000), 257 - np.clip(g.exponential(60, 4000), 1, 256), np.full(999, 100)]
    better = 0
    for lengths in draws:
        counts = {int(n): int(c) for n, c in zip(*np.unique(np.asarray(lengths, int), return_counts=True))}
        needed, plain = checked(counts, 256), decreasing(counts, 256)
        assert needed == packing.plan(counts, 256)[1] <= plain
        better += needed < plain
    assert better >= 2


def test_packing_against_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), capacity=64).collect()
    want = {}
    for d, t in documents():
        want.setdefault(d, []).append(whole.encode(t or "", add_special_tokens=False).ids + [0])
    by, places = {}, {}
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] and r["start"] == 64 * r["piece"]
        by.setdefault(r["doc_id"], []).append((r["piece"], ids))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, lists in want.items():
        if len(lists) == 1:
            assert [x for _, ids in sorted(by[d]) for x in ids] == lists[0]
        else:
            assert sorted(x for _, ids in by[d] for x in ids) == sorted(x for ids in lists for x in ids)
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0
    clash = docs.withColumns({c: F.lit(7) for c in ("piece", "start", "length", "ids", "part", "place", "bases", "rank", "offset", "sequence_id")})
    keyed = lambda rows: sorted((repr(r["doc_id"]), r["piece"], r["start"], bytes(r["ids"])) for r in rows)
    packing_parts, packing.PARTS = packing.PARTS, 0  # the bases are joined by a shuffle
    try:
        assert keyed(packing.pack(clash, tokenizer_path(), capacity=64).collect()) == keyed(got)
    finally:
        packing.PARTS = packing_parts


# --- Jaccard


def brute_groups(rows, n, percent):
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {d: d for d, _ in rows if d is not None}
    changed = True
    pairs = [(rows[i][0], rows[j][0]) for i in sets for j in sets if i < j and sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {(d, len(sets[i])): label.get(d) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("tight", [False, True])
def test_jaccard_against_brute_force(spark, docs, monkeypatch, tight):
    if tight:  # every path: local counts, frequent classes, pairs, hot keys in small blocks of bands, long keys that are shuffled, stars
        for name, value in (("COLD", 1), ("BLOCK", 3), ("FREQUENT", 2), ("LOCAL", 1), ("FLUSH", 500), ("MANY", 20)):
            monkeypatch.setattr(jaccard, name, value)
        monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
        monkeypatch.setattr(common, "MANY", 20)
        monkeypatch.setattr(components, "FEW", 0)
    rows = documents()
    for n, percent in ((4, 85), (5, 80)) if not tight else ((4, 85),):
        want = brute_groups(rows, n, percent)
        got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.near_duplicates(docs, n, percent).collect()}
        assert got == want
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_jaccard_keeps_texts_that_share_an_id_apart(spark):
    w = [f"u{i}" for i in range(400)]
    text = lambda a, b: " ".join(w[a:b])
    rows = [(30, text(0, 100)), (30, text(150, 250)), (31, text(50, 100) + " " + text(150, 200))]  # half of 31 stands in either text of 30
    rows += [(21, text(250, 400)), (21, text(300, 340)), (23, text(300, 340) + " more"), (23, text(300, 340) + " more")]
    rows += [(40, text(0, 60)), (10, text(0, 60)), (40, text(100, 140)), (41, text(100, 140) + " more"), (None, text(100, 140)), (50, None), (50, "a b c d e f")]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, doc int, node int, n int")
    for parts in (1, 5):
        got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.near_duplicates(df.repartition(parts)).collect()}
        assert got == brute_groups(rows, 4, 85)
    assert {c for (d, _), c in got.items() if d == 31} == {31} and {c for (d, _), c in got.items() if d == 23} == {21} and {c for (d, _), c in got.items() if d == 41} == {10}


def test_jaccard_across_bands_and_blocks(spark, monkeypatch):
    # one common line in all, groups of near copies of sizes on both sides of a band's edge
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "COLD", 2)
    rows = []
    for g in range(12):
        base = [f"g{g % 6}x{i}" for i in range(8 + 3 * g)]
        rows += [(100 * g + k, " ".join(["the", "common", "line", "of", "all"] * 2 + base + [f"t{k}"] * (k % 3))) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent in (40, 70, 85, 100):
        got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.near_duplicates(df, 2, percent).collect()}
        assert got == brute_groups(rows, 2, percent)


def test_one_of_each(spark, docs):
    groups = brute_groups(documents(), 5, 80)
    kept = jaccard.one_of_each(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == sorted(set(groups.values()) - {None})
    assert ids.count(None) == 1


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    one, two = prose(60), prose(60)
    rows = [(1, one, "x"), (1, two, "y"), (1, two, "y"), (1, two, "z"), (2, one, "x"), (3, one + " more", "x"), (4, prose(40), "x"), (4, None, "x"), (4, None, "x"), (None, one, "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [jaccard.one_of_each(df.repartition(n)).collect() for n in (1, 3)]
    assert sorted(map(repr, got[0])) == sorted(map(repr, got[1])) and got[0][0].asDict().keys() == {"doc_id", "text", "source"}
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in got[0])
    kept_one = [r for r in left if r[1].startswith(one)]
    assert len([r for r in kept_one if r[0]]) == 1  # of ids 1, 2 and 3 with near copies one stays
    assert (1, two) in left and left.count((1, two)) == 1 and left.count((4, "")) == 1 and (0, one) in left and (5, "") in left
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_components_of_chains(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (0, 1000):
        monkeypatch.setattr(components, "FEW", few)
        got = {r["node"]: r["component"] for r in components.components(df).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# --- WARC


def test_warc_round_trip(spark):
    same = "<p>" + "y" * 200
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" + "é" * rng.randrange(300)) for i in range(50)] + [(60, "a\r\nb", same), (61, None, same), (59, "u", same), (62, "v", None), (63, "w", ""), (64, "short", "ab"), (65, "short", "ab"), (66, "big", "z" * 600_000), (59, "u", same)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = scratch_path(spark, "t")
    index = warc.write(df, path, frame_bytes=4096)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.fetch(index, path).collect())
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        other = 59 if h == same and i != 59 else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if other else "response", other))
    assert [repr(x) for x in got] == [repr(x) for x in sorted(want, key=lambda x: x[:4])]
    assert warc.verify_index(spark, path) == len(rows)
    one = warc.fetch(index.where("page_id = 66"), path, payloads=True).first()
    assert bytes(one["payload"]) == b"z" * 600_000
    empty = scratch_path(spark, "t")
    assert warc.fetch(warc.write(df.limit(0), empty), empty).count() == 0


# --- quality


def test_quality_on_held_out_documents(spark):
    def junk():
        return " ".join(w + "!!" for w in prose(60).upper().split())

    def toxic():
        w = prose(80).split()
        for _ in range(6):
            w.insert(rng.randrange(len(w)), rng.choice(["scum", "moron", "trash"]))
        return " ".join(w)

    kinds = [rng.choice("ggggjt") for _ in range(900)]
    texts = {"g": lambda: prose(80), "j": junk, "t": toxic}
    rows = [(i, texts[k](), i) for i, k in enumerate(kinds)] + [(5000, None, 0), (5001, "", 0), (5002, prose(20_000), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rate int").repartition(4)
    labels = spark.createDataFrame([(i, int(k != "j"), int(k == "t")) for i, k in enumerate(kinds) if i < 600], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.decide(df, labels).scores.collect()}
    held = [(k, got[i]) for i, k in enumerate(kinds) if i >= 600]
    assert sum(keep for k, keep in held if k == "g") >= 0.95 * sum(k == "g" for k, _ in held)
    assert sum(keep for k, keep in held if k != "g") <= 0.1 * sum(k != "g" for k, _ in held)
    kept = quality.keep(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, keep in got.items() if keep}
    assert quality.keep(df, labels.limit(0)).count() == len(rows)
    assert quality.keep(df.limit(0), labels).count() == 0


def test_quality_finds_toxic_documents_at_every_size(spark, small):
    # a lexicon so large that each word stands in about four labelled documents, all toxic
    lexicon = [f"slur{i}{c}" for i in range(20) for c in "xy"]
    kinds = ["t" if i % 8 == 0 else "g" for i in range(1000)]

    def text(kind):
        w = prose(80).split()
        return " ".join(w + rng.sample(lexicon, 4) * (kind == "t"))

    df = spark.createDataFrame([(i, text(k)) for i, k in enumerate(kinds)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, int(k == "t")) for i, k in enumerate(kinds) if i < 400], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.decide(df, labels).scores.collect()}
    assert sum(not got[i] for i in range(400, 1000) if kinds[i] == "t") >= 0.8 * sum(k == "t" for k in kinds[400:])
    assert sum(not got[i] for i in range(400, 1000) if kinds[i] == "g") <= 0.05 * sum(k == "g" for k in kinds[400:])
    # the supplied tables, judged on the fold that took no part in training
    path = small.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)) == 0)
    scores = quality.decide(docs, labels).scores.join(held, "doc_id").select("keep", "quality", "toxic").collect()
    toxic = [r["keep"] for r in scores if r["toxic"] == 1 and r["quality"] == 1]
    good = [r["keep"] for r in scores if r["toxic"] == 0 and r["quality"] == 1]
    assert toxic and sum(toxic) <= 0.6 * len(toxic) and sum(good) >= 0.9 * len(good)


def test_quality_weights_and_draw_against_brute_force(spark):
    letters = "bcdfg"
    vocabulary = [a + "aei"[i % 3] + b * (1 + i % 4) for i, (a, b) in enumerate((a, b) for a in letters for b in letters if a < b)]
    pick = random.Random(9)

    def text(kind):
        w = [pick.choice(vocabulary) for _ in range(pick.randrange(1, 60))]
        if kind == "t":
            w += ["vile"] * pick.randrange(1, 3)
        return " ".join(x.upper() + "!" if kind == "j" and pick.random() < 0.7 else x for x in w)

    kinds = [pick.choice("ggggggjt") for _ in range(1200)]
    rows = [(i, text(k)) for i, k in enumerate(kinds)] + [(5000, None), (5001, ""), (3, text("g")), (3, text("g")), (None, text("g")), (None, None)]
    known = {i: (int(k != "j"), int(k == "t")) for i, k in enumerate(kinds) if i % 2}
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, kind int, noise int, fold int").repartition(3)
    labels = spark.createDataFrame([(i, q, t, "x") for i, (q, t) in known.items()] + [(None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    folds = {r["i"]: r["f"] for r in df.select(F.col("doc_id").alias("i"), F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)).alias("f")).collect()}

    def grams(t):
        w = (t or "").translate(LOWER).split()
        again = [("again", i > 0 and w[i] == w[i - 1]) for i in range(len(w))]
        return len(w), [("word", x) for x in w] + [("four", x[:4]) for x in w] + [("five", x[:5]) for x in w] + [("tail", x[-2:]) for x in w] + again + [("pair", *p) for p in zip(w, w[1:])]

    raw, good, docs_with, toxic_with, n_known, n_toxic, n_good = {}, {}, {}, {}, 0, 0, 0
    add = lambda d, gs: [d.__setitem__(g, d.get(g, 0) + 1) for g in gs]
    for i, t in rows:
        _, gs = grams(t)
        add(raw, gs)
        if i in known and folds[i]:
            n_known, n_toxic = n_known + 1, n_toxic + known[i][1]
            add(docs_with, set(gs))
            if known[i][1]:
                add(toxic_with, set(gs))
            if known[i] == (1, 0):
                n_good += 1
                add(good, gs)
    size = quality.BUCKETS
    empty = 1e-3 * size  # every bucket has a little; buckets of seen n-grams are assumed apart, see below
    total, all_good = sum(raw.values()) + empty, sum(good.values())

    def rate(g):
        p = (raw[g] + 1e-3) / total
        return math.log((good.get(g, 0) + size * p) / (all_good + size)) - math.log(p)

    usual = 1 - n_toxic / n_known

    def sign(g):
        n = docs_with.get(g, 0)
        c = n - toxic_with.get(g, 0)
        if not n:
            return 0.0
        e = lambda h, x: h * math.log(max(h, 1) / x)
        sure = max(e(c, n * usual) + e(n - c, n * (1 - usual)), 0) ** quality.STEEP
        value = math.log((c + quality.SMOOTH * usual) / (n + quality.SMOOTH) / usual) * sure / (sure + quality.HALF**quality.STEEP)
        return value if value <= -quality.LEAST else 0.0

    decision = quality.decide(df, labels)
    m, got = decision.model, decision.scores.collect()
    # each n-gram alone in its bucket, or the sums would differ by what shares it
    import pyarrow as pa

    used = {int(b) for _, _, buckets, _ in quality.features(pa.array([t for _, t in rows])) for b in buckets}
    assert len(used) == len(raw)
    want = sorted((repr(i), round(sum(map(rate, gs)) / max(n, 1), 8), round(sum(map(sign, set(gs))) / math.sqrt(n + 20), 8), n) for i, t in rows for n, gs in [grams(t)])
    assert want == sorted((repr(r["doc_id"]), round(r["rate"], 8) + 0.0, round(r["signs"], 8) + 0.0, int(r["words"])) for r in got)
    for r in got:
        lacks = r["words"] * min(r["rate"] - m.rate_at, 0) + math.sqrt(r["words"] + 20) * min(r["signs"] - m.signs_at, 0)
        assert math.isclose(r["weight"], lacks, abs_tol=1e-9) and math.isclose(r["key"], r["weight"] + r["noise"], abs_tol=1e-12)
    noise = sorted(r["noise"] for r in got)
    assert abs(sum(noise) / len(noise) - 0.5772) < 0.15 and abs(noise[len(noise) // 2] - 0.3665) < 0.15
    k = round(sum(math.exp(r["weight"]) for r in got))
    cut = sorted((r["key"] for r in got), reverse=True)[k - 1]
    assert [r["keep"] for r in got] == [r["key"] >= cut for r in got] and k <= sum(r["keep"] for r in got) < k + 10
    # the draw is no threshold: some of lower weight are in while some of higher weight are out
    assert min(r["weight"] for r in got if r["keep"]) < min(0.0, max(r["weight"] for r in got if not r["keep"]))
    half = quality.decide(df, labels, share=0.5).scores.collect()
    assert len(rows) // 2 <= sum(r["keep"] for r in half) < len(rows) // 2 + 10
    kept = quality.keep(df, labels)
    assert kept.columns == df.columns and sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(r["doc_id"]) for r in got if r["keep"])


def test_kth_largest(spark):
    values = [rng.choice([rng.random(), 0.5]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 1500, 3000):
        assert quality.kth_largest(df, "x", k, bins=16, few=10) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "x", 0) == float("inf")


# --- training order


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(training_order.permuted(np.arange(n), n).tolist()) == list(range(n))
    assert training_order.permuted(np.arange(1000), 1000, 1).tolist() != training_order.permuted(np.arange(1000), 1000, 2).tolist()


def test_each_sequence_stands_in_its_slot_and_each_shard_in_one_task(spark, docs, monkeypatch):
    path = scratch_path(spark, "t")
    clash = docs.withColumns({c: F.lit(7) for c in ("part", "slot", "shard", "used", "ids", "spans", "local")})
    training_order.write(clash, path, tokenizer_path(), length=64, per_shard=16)
    shape = training_order.layout(path)
    cut = training_order.sequences(docs, tokenizer_path(), 64).orderBy("part", "local").collect()
    slots = training_order.permuted(np.arange(len(cut)), len(cut), shape["key"])
    held = {s: x.tolist() for s, x in training_order.read_slots(path)}
    assert len(held) == len(cut)
    for row, slot in zip(cut, slots.tolist()):
        assert held[slot] == np.frombuffer(bytes(row["ids"]), "<u2").tolist()
    files = spark.read.parquet(f"{path}/index").select(F.input_file_name().alias("file"), F.floor(F.col("slot") / 16).alias("shard"))
    assert files.groupBy("file").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    assert files.groupBy("shard").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0
    with pytest.raises(Exception, match="16 bits"):
        training_order.sequences(docs, tokenizer_path(), 64, end=70_000).count()


def test_training_order_round_trip(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    path = scratch_path(spark, "t")
    training_order.write(docs, path, tokenizer_path(), length=64, per_shard=16)
    n = training_order.layout(path)["sequences"]
    slots = dict(training_order.read_slots(path))
    assert sorted(slots) == list(range(n))
    assert [(s, x.tolist()) for s, x in training_order.read_slots(path, 37, 61)] == [(s, slots[s].tolist()) for s in range(37, min(61, n))]
    want = {}
    for d, t in documents():
        want.setdefault(d, []).append(whole.encode(t or "", add_special_tokens=False).ids + [0])
    spans = training_order.read_spans(spark, path).collect()
    by = {}
    for r in spans:
        ids = slots[r["slot"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        by.setdefault(r["doc_id"], []).append((r["start"], ids.tolist()))
    for d, lists in want.items():
        if len(lists) == 1:
            assert [x for _, ids in sorted(by[d]) for x in ids] == lists[0]
    empty = scratch_path(spark, "t")
    training_order.write(docs.limit(0), empty, tokenizer_path())
    assert training_order.read_spans(spark, empty).count() == 0 and list(training_order.read_slots(empty)) == []


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    total = sum(int(x) if i % 2 == 0 else (2 * int(x) - 9 * (int(x) > 4)) for i, x in enumerate(reversed(d)))
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 13 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]


def test_pii_against_plain_patterns():
    bits = ["a@b.co", "@", "x..%@y-z.a.b", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+1(", "word", " ", "é@é.com", "..", "0012.1.1.1", "-", "DE89 3704 0044 0532 0130 00", "123-45-6789"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", "x"]) for _ in range(rng.randrange(8)))
        want = [(k, *m.span()) for k in PATTERNS for m in re.finditer(PATTERNS[k], text) if holds(k, m.group())]
        assert [(k, a, b) for k, a, b, _ in pii.spans(text) if k in PATTERNS] == want
    assert pii.spans(None) == [] and len(pii.spans("a" * 200_000 + "@" + "1" * 200_000)) == 0
    found = pii.spans("Bank account IBAN DE89370400440532013000, ssn 123-45-6789, call 555-010-9999")
    assert {k for k, *_ in found} >= {"iban", "ssn", "local_phone"}


def test_iban_ends_where_its_country_says():
    for iban in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"):
        for after in ("", " BIC COBADEFF", " 2024", " A payment", " AND 12 MORE", ", then", " GB82 WEST 1234 5698 7654 32"):
            found = [s for s in pii.spans(f"pay to {iban}{after}") if s[0] == "iban"]
            assert found and found[0][1:3] == (7, 7 + len(iban)), (iban, after)
            assert len(found) == 1 + after.startswith(" GB82")
    assert not [s for s in pii.spans("pay to DE89 3704 0044 0532 0130 01 and DE89 3704 0044 0532 0130 00X") if s[0] == "iban"]
    # a country without a fixed length: shorter ends until the checksum holds
    other = next(f"ZZ{n:02} 1234 5678 9012 34" for n in range(2, 99) if pii.mod97(f"ZZ{n:02}12345678901234"))
    assert [s[1:3] for s in pii.spans(f"{other} ABC DEF") if s[0] == "iban"] == [(0, len(other))]


def test_pii_on_rows(spark):
    rows = [(1, "mail a@b.co now", 7), (2, None, 8), (3, "", 9), (1, "mail a@b.co now", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").select("doc_id", "text", F.col("spans").alias("n_chars"))
    got = pii.detect(df, mask=True)
    assert got.columns == ["doc_id", "text", "n_chars", "spans"]
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == [(1, "mail <EMAIL> now"), (1, "mail <EMAIL> now"), (2, ""), (3, "")]
    assert pii.detect(df.limit(0)).count() == 0
    clash = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    found = pii.detect(clash)
    assert found.columns == ["doc_id", "spans"] and sorted(len(r["spans"]) for r in found.collect()) == [0, 0, 1, 1]
    other = pii.detect(clash, mask=True, name="found")
    assert other.columns == ["doc_id", "text", "spans", "found"] and sorted(r["spans"] for r in other.collect()) == [7, 7, 8, 9]


# --- the pipeline


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = scratch_path(spark, "stage")
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        if i < 4:
            assert docs.columns == columns
            now = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert now <= ids
            ids = now
    assert {r["doc_id"] for r in docs.collect()} == ids and ids
    assert corpus_pipeline.run(spark, small).count() == docs.count()

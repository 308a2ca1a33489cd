"""Suggestions: edge prefixes against a plain scan, admission, groups, nulls and nothing at all."""

from pyspark.sql import functions as F

from spindrift.operators import suggest as S


def test_prefix_table(spark):
    rows = [(i, n, "c") for i, n in enumerate(["Red pen", "red  pen!", "redder", "r", "", None, "re", "blue pen", "Ёлка", "red cup"])]
    df = spark.createDataFrame(rows, "item_id long, name string, category string")
    got = {}
    for r in S.prefix_table(df, most=3).orderBy("prefix", "place").collect():
        got.setdefault(r["prefix"], []).append(r["item_id"])
    assert got["re"] == [6, 2, 9] and got["red"] == [2, 9, 0] and got["red "] == [9, 0, 1] and got["ел"] == [8] and "r" not in got and "" not in got
    assert S.prefix_table(df.limit(0)).count() == 0


def test_short_prefix(spark):
    asked = [("Ручка", 1), ("ру", 1), ("ру", None), ("р", 1), ("а б", 1), ("", 1), (None, 1), ("руч ", 1)]
    df = spark.createDataFrame(asked, "query string, customer_id long")
    assert [r[0] for r in df.select(S.short_prefix(F.col("query"), F.col("customer_id"))).collect()] == [None, "ру", None, None, None, None, None, "руч"]


def test_products_of_a_type(spark):
    products = spark.createDataFrame([(1, "ручка синяя", "ручки a01"), (2, "ручник", "тормоза"), (3, "рубанок", "инструмент"), (4, "рукав", "шланги a01b")], "item_id long, name string, category string")
    people = spark.createDataFrame([(1, "school"), (2, "school"), (3, "garage"), (4, "alone")], "customer_id long, type string")
    lines = spark.createDataFrame([(2, 1)] * 4 + [(3, 1)] * 1 + [(2, 2)] * 1 + [(3, 2)] * 9 + [(2, 3)] * 3 + [(3, 3)] * 2 + [(2, 4)] * 1 + [(3, 4)] * 20 + [(1, 1)] * 50, "customer_id long, item_id long")
    typical = spark.createDataFrame([("school", "ручки a01"), ("alone", "тормоза")], "type string, category string")
    nothing = spark.createDataFrame([], "customer_id long, category string, weight double")
    advised = spark.createDataFrame([(1, 3, 50.0)], "customer_id long, item_id long, weight double")
    asked = spark.createDataFrame([(1, "ру"), (4, "руч"), (9, "ру"), (1, "рубанок")], "customer_id long, query string")
    got = {(r["customer_id"], r["item_id"]): r for r in S.same_type_prefix(asked, S.prefix_table(products), people, lines, typical, nothing, advised).collect()}
    # the category's code fits product 4, nothing fits 2, of which the type bought a tenth
    assert set(got) == {(1, 1), (1, 3), (1, 4), (4, 2)}
    assert got[1, 1]["count"] == 4 and got[4, 2]["count"] == 10
    import math

    assert math.isclose(got[1, 1]["score"], round(7.2 + 2.5 * math.log1p(4) + 18 * 4 / 55 + 12 + 14, 4), abs_tol=1e-4)
    assert math.isclose(got[1, 3]["score"], round(7.2 + 2.5 * math.log1p(3) + 18 * 3 / 5 + 6 - 10, 4), abs_tol=1e-4)
    assert math.isclose(got[1, 4]["score"], round(7.2 + 2.5 * math.log1p(1) + 18 / 21 + 14 * 0.8, 4), abs_tol=1e-4)


def test_groups(spark):
    products = spark.createDataFrame([("a", "руч", "Ручка синяя 5 шт", 3, None), ("a", "руч", "Стол", 9, None), ("b", "стол", "Стол", 1, None)], "asked string, query string, name string, count long, score double")
    typed = spark.createDataFrame([("a", "руч", "Ручник", 40, 30.0)], products.schema)
    categories = spark.createDataFrame([("a", "руч", "Ручки"), ("b", "стол", "Столы офисные")], "asked string, query string, category string")
    queries = spark.createDataFrame([("b", "стул", "стол", ["парта"]), ("c", "x", "x", [])], "asked string, normalized string, corrected_query string, synonyms array<string>")
    got = {}
    for r in S.suggested(products, typed, categories, queries).orderBy("asked", "place").collect():
        got.setdefault(r["asked"], []).append((r["text"], r["kind"], r["score"]))
    assert got["a"] == [("Ручка синяя", "product", 180.0 + 3 + 18 + 10 + 35), ("Ручник", "product", 180.0 + 15 + 12 + 18 + 10 + 35)]
    assert {t for t, _, _ in got["b"]} == {"столы офисные", "стол", "парта"} or {t for t, _, _ in got["b"]} == {"столы офисные", "парта"} and "c" not in got
    empty = S.suggested(products.limit(0), typed.limit(0), categories.limit(0), queries.limit(0))
    assert empty.count() == 0


def of_type_plainly(asked, products, people, lines, typical, preferred, advised, most):
    """The best products of a type by loops, over all products of a prefix; names of one token, categories without codes."""
    import math

    name, category, kind = {i: n for i, n, _ in products}, {i: c for i, _, c in products}, dict(people)
    own, typed, total = {}, {}, {}
    for c, i in lines:
        own[c, i] = own.get((c, i), 0) + 1
        typed[kind[c], i] = typed.get((kind[c], i), 0) + 1
        total[i] = total.get(i, 0) + 1
    out = set()
    for c, q in asked:
        t = kind[c]
        held = [i for i in name if t is not None and name[i].startswith(q)]
        some = any(typed.get((t, i), 0) > own.get((c, i), 0) for i in held)
        best = []
        for i in held:
            usual, mine = (t, category[i]) in typical, own.get((c, i), 0)
            n = typed.get((t, i), 0) - mine if some else total.get(i, 0) - mine if usual else 0
            if n <= 0:
                continue
            part, liked = n / max(n, total[i]), 12.0 if usual else min(10.0, 1.8 * preferred.get((c, category[i]), 0.0))
            if liked > 0 or (part >= S.LEAST_SHARE_ALONE and n >= S.LEAST_COUNT):
                match = 120.0 if len(q) == 2 else 180.0
                score = 0.06 * match + min(14.0, 2.5 * math.log1p(n)) + 18.0 * part + liked + min(6.0, advised.get((c, i), 0.0)) - (0.0 if liked > 0 else 10.0)
                best.append((round(score, 4), n, name[i], -i))
        out |= {(c, q, -i, n, rank) for rank, (_, n, _, i) in enumerate(sorted(best, reverse=True)[:most], 1)}
    return out


def test_all_products_of_a_prefix_compete(spark, monkeypatch):
    import random

    random.seed(8)
    monkeypatch.setattr(S, "TOP_OF_TYPE", 4)
    products = [(i, random.choice(["pena", "penb", "pelt", "perm", "rope"]), random.choice(["c0", "c1", "c2", "c3", None])) for i in range(400)]
    people = [(c, [None, "t0", "t1", "t2"][min(3, c % 9)] if c else "alone") for c in range(40)]
    bought = lambda c: random.choices(range(400), k=90 if c in (1, 2) else 12)
    lines = [(c, i) for c in range(40) for i in bought(c)]
    typical = {("t0", "c0"), ("t1", "c1"), ("alone", "c2")}
    preferred = {(c, f"c{random.randrange(4)}"): random.choice([0.5, 0.75, 1.0, 9.0]) for c in range(30) for _ in range(2)}
    advised = {(c, random.randrange(400)): random.choice([0.5, 20.0]) for c in range(40) for _ in range(5)}
    asked = [(c, q) for c in range(40) for q in ("pe", "pen")[: 1 + c % 2]]
    make = spark.createDataFrame
    pairs = lambda held: [(c, x, w) for (c, x), w in held.items()]
    found = S.same_type_prefix(
        make(asked, "customer_id long, query string"), S.prefixes(make(products, "item_id long, name string, category string")), make(people, "customer_id long, type string"), make(lines, "customer_id long, item_id long"),
        make(sorted(typical), "type string, category string"), make(pairs(preferred), "customer_id long, category string, weight double"), make(pairs(advised), "customer_id long, item_id long, weight double"),
    )
    want = of_type_plainly(asked, products, people, lines, typical, preferred, advised, 4)
    assert len(want) > 100 and {(r["customer_id"], r["query"], r["item_id"], r["count"], r["rank"]) for r in found.collect()} == want  # the 120 products of shortest name alone before

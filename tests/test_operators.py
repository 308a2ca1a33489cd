import datetime

import pandas as pd
from pyspark.sql import functions as F

from spindrift.operators import online, personal, ranking, rewrite, suggest, vectors
from spindrift.sources import files
from spindrift.streaming import state, windows


def test_readers(spark, tmp_path):
    path = tmp_path / "contracts.csv"
    path.write_text('﻿"Поставка ""ручек""";c1;s1;2024-01-02 10:00:00;12,50;i1;Школа;Москва;p1;Ромашка;\nкороткая;строка\nПоставка;c2;s2;плохо;x;;;;p2;Лютик;Тула\n')
    rows, odd = files.read_contracts(spark, str(path))
    got = {r["contract_id"]: r for r in rows.collect()}
    assert got["c1"]["amount"] == 12.5 and got["c1"]["day"] == datetime.date(2024, 1, 2) and got["c1"]["contract_item_name"] == 'Поставка "ручек'
    assert got["c2"]["customer_inn"] == "UNKNOWN" and got["c2"]["day"] is None and got["c2"]["amount"] == 0.0
    assert odd.count() == 1
    catalog = tmp_path / "catalog.csv"
    catalog.write_text("s1;Ручка синяя;Ручки;Цвет:синий;Вес\ns2;Флешка;Накопители;\"Объем:16.00000;Цвет:черный\"\n")
    rows, odd = files.read_catalog(spark, str(catalog))
    assert [(r["ste_id"], r["attribute_keys"], r["attribute_count"]) for r in rows.collect()] == [("s2", "Объем | Цвет", 2)] and odd.count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int")
    files.write_csv(df, str(tmp_path / "csv"), [F.asc("k")])
    assert [r["k"] for r in files.read_headered(spark, str(tmp_path / "csv"), ("k",)).collect()] == ["a", "b"]
    rows, features = files.read_ranking(spark, str(tmp_path / "csv"), ("k",), "n")
    assert features == [] and rows.agg(F.sum("n")).first()[0] == 3.0


def test_completion_and_correction(spark):
    words = spark.createDataFrame([("парацетамол", "п", 11, 5), ("многофункциональное", "м", 19, 2), ("труба", "т", 5, 3)], "token string, first_char string, token_length long, frequency long")
    asked = spark.createDataFrame([("парацетомол",), ("мног",), ("турба",)], "token string")
    got = {r["token"]: r["candidate"] for r in rewrite.corrections(rewrite.correction_candidates(asked, words)).collect()}
    assert got == {"парацетомол": "парацетамол", "турба": "труба"}
    assert [r["token"] for r in rewrite.completions(asked.withColumnRenamed("token", "prefix"), words).collect()] == ["многофункциональное"]


def test_correction_of_a_wrong_first_letter(spark):
    words = spark.createDataFrame([("труба", "т", 5, 3), ("лампа", "л", 5, 9), ("трубаа", "т", 6, 1)], "token string, first_char string, token_length long, frequency long")
    asked = spark.createDataFrame([("яруба",), ("лруба",)], "token string")
    got = {(r["token"], r["candidate"]) for r in rewrite.correction_candidates(asked, words).collect()}
    assert got == {("яруба", "труба"), ("яруба", "трубаа")}  # a word that met a candidate gets no others


def test_archetype(spark):
    rows = spark.createDataFrame([(1, "Иммунодепрессанты", 0.9, 20, 1), (1, "Бумага", 0.3, 1, 2), (2, "Столы", 0.9, 9, 1)], "customer_id long, category string, weight double, purchase_count long, rank int")
    got = {r["customer_id"]: r["archetype"] for r in personal.archetypes(rows).collect()}
    assert got == {1: "healthcare", 2: "general"}


def test_session_fold_and_stream_agree(spark, small, tmp_path):
    events = online.events_of(spark.read.parquet(f"{small}/events.parquet")).replace({"click": "item_click", "view": "item_close", "signup": "cart_add", "error": "cart_remove"}, subset="kind")
    events = events.withColumn("item", F.concat("item", F.lit("|x")))
    batch = {r["user_id"]: r for r in online.fold_sessions(events).collect()}
    source = str(tmp_path / "in")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(source)
    # a processing-time timeout would make empty batches for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(events.schema).parquet(source)
    out = state.session_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    out.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {r["user_id"]: r for r in spark.table("folded").collect()}
    assert got == batch


def test_session_windows_agree(spark, small, tmp_path):
    raw = spark.read.parquet(f"{small}/events.parquet")
    source = str(tmp_path / "in")
    raw.withColumn("ts", F.col("ts").cast("timestamp")).repartition(1).write.parquet(source)
    late = raw.withColumns({"ts": F.lit("2099-01-01").cast("timestamp"), "user_id": F.lit(-1).cast("long")}).limit(1)
    late.write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    windows.session_counts(stream).writeStream.outputMode("append").format("memory").queryName("closed").trigger(availableNow=True).start().awaitTermination(120)
    want = {tuple(r) for r in windows.session_counts(raw).collect()}
    got = {tuple(r) for r in spark.table("closed").collect()}
    assert got and got <= want and len(got) >= len(want) - 2


def test_cart_counter_never_negative(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(1, "a", day + datetime.timedelta(hours=i), i, k) for i, k in enumerate(["purchase", "click", "purchase", "purchase", "click", "click"])]
    df = spark.createDataFrame(rows, "user_id long, category string, ts timestamp, event_id long, kind string")
    assert online.cart_counts(df).first()["n"] == 2


def test_session_rules():
    s, t = online.Session(), pd.Timestamp("2024-01-01")
    s.apply(t, "view", "i1", "c1", 500.0)  # neither a close nor a bounce
    s.apply(t, "item_close", "i1", "c1", 3000.0)
    assert s.bounced == [] and s.recent == [] and s.clicked == []
    s.apply(t, "item_close", "i1", "c1", 500.0)
    assert s.bounced == ["c1"]
    s.apply(t, "cart_add", "i1", "", None)
    s.apply(t, "cart_add", "", "c3", None)
    assert s.cart == ["i1"] and s.recent == ["c3"]
    s.apply(t, "purchase", "i1", "c1", None)  # clears the bounce, enters the recent ones, leaves the cart alone
    assert s.cart == ["i1"] and s.bounced == [] and s.recent == ["c1", "c3"] and s.counts["purchase"] == 1 and s.last_kind == "purchase"
    for i in range(25):
        s.apply(t, "item_open", f"x|{i}", "c", None)
    assert s.clicked == [f"x|{i}" for i in range(24, 4, -1)]
    s.apply(t + pd.Timedelta(hours=25), "item_click", "i2", "c2", None)
    assert s.version == 1 and s.clicked == ["i2"] and s.counts == {"item_click": 1}


def test_counters_expire(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(1, "a", day + datetime.timedelta(hours=h), i, k, 100.0) for i, (h, k) in enumerate([(0, "click"), (1, "click"), (200, "click"), (210, "purchase"), (211, "click"), (212, "view"), (217, "view"), (218, "view")])]
    df = spark.createDataFrame(rows, "user_id long, category string, ts timestamp, event_id long, kind string, duration_ms double")
    assert online.cart_counts(df).first()["n"] == 1 and online.skip_counts(df).first()["n"] == 2


def test_metrics_edge_cases(spark):
    rows = spark.createDataFrame([("g", "a", 0.0, 1.0), ("g", "b", 1.0, 1.0), ("none", "a", 0.0, 2.0)], "group_id string, candidate_id string, label double, score double")
    got = {r["group_id"]: r for r in ranking.rank_metrics(rows).collect()}
    assert got["g"]["mrr_10"] == 1.0 and got["none"]["ndcg_5"] == 0.0
    assert ranking.rank_metrics(rows.limit(0)).count() == 0


def test_negatives_are_whole(spark):
    items = spark.createDataFrame([(i, f"thing{i % 5} part{i % 7}", f"c{i % 3}", "a:b") for i in range(40)], "item_id long, name string, category string, attributes string")
    asked = items.select(F.concat(F.lit("g"), F.col("item_id")).alias("group_id"), "item_id", "category", F.split("name", " ").alias("words"))
    got = ranking.negatives(asked, items).collect()
    by = {}
    for r in got:
        by.setdefault(r["group_id"], []).append(r)
    assert len(by) == 40
    for g, rows in by.items():
        i = int(g[1:])
        assert len({r["item_id"] for r in rows}) == 6 and i not in {r["item_id"] for r in rows}
        assert sum(r["kind"] == "same_category" for r in rows) == 2 and all(r["item_id"] % 3 == i % 3 for r in rows if r["kind"] == "same_category")
        near = [r["item_id"] for r in rows if r["kind"] == "similar_text"]
        assert len(near) == 2 and all(x % 5 == i % 5 or x % 7 == i % 7 for x in near)
    assert ranking.negatives(asked, items).count() == ranking.negatives(asked.repartition(5), items.repartition(3)).intersect(ranking.negatives(asked, items)).count()
    assert ranking.negatives(asked.limit(0), items.limit(0)).count() == 0


def test_negatives_of_small_categories(spark):
    items = spark.createDataFrame([(i, f"thing{i}", "pair" if i < 2 else f"c{i}", "a:b") for i in range(9)] + [(9, "thing9", None, "a:b")], "item_id long, name string, category string, attributes string")
    asked = items.crossJoin(spark.range(8)).select(F.concat_ws("-", "item_id", "id").alias("group_id"), "item_id", "category", F.split("name", " ").alias("words"))
    by = {}
    for r in ranking.negatives(asked, items).collect():
        by.setdefault(r["group_id"], []).append((r["item_id"], r["kind"]))
    assert len(by) == 80
    for g, rows in by.items():
        i = int(g.split("-")[0])
        assert len({x for x, _ in rows}) == len(rows) == 6 and i not in {x for x, _ in rows}  # a pair's other was drawn twice
        assert [x for x, kind in rows if kind == "same_category"] == ([1 - i] if i < 2 else [])
    texts = items.select("item_id", "category", F.split("name", " ").alias("words"))
    told = ranking.negatives(asked.select("group_id", "item_id"), items, texts=texts)
    assert {g: sorted((r["item_id"], r["kind"]) for r in rows) for g, rows in grouped(told, "group_id").items()} == {g: sorted(rows) for g, rows in by.items()}


def grouped(df, key):
    by = {}
    for r in df.collect():
        by.setdefault(r[key], []).append(r)
    return by


def test_similar_texts_with_a_cap(spark):
    items = spark.createDataFrame([(i, "pen red" if i == 9 else "pen", None, "") for i in range(10)], "item_id long, name string, category string, attributes string")
    asked = spark.createDataFrame([(["pen", "red"],), (["pen", "pen"],), ([],), (None,)], "words array<string>")
    got = {tuple(r["words"]): [] for r in ranking.similar_texts(asked, items, 3, cap=2).collect()}
    for r in ranking.similar_texts(asked, items, 3, cap=2).orderBy("place").collect():
        got[tuple(r["words"])].append((r["item_id"], r["shared"]))
    assert got == {("pen", "red"): [(0, 1), (1, 1), (9, 1)], ("pen", "pen"): [(0, 1), (1, 1)]}


def test_all_products_compete_as_similar_texts(spark):
    held = [(i, "pen" if i < 600 else "red" if i < 1200 else "pen red" if i % 2 else "pen blue", f"c{i}", "a:b") for i in range(1210)]
    items = spark.createDataFrame(held, "item_id long, name string, category string, attributes string")
    asked = spark.createDataFrame([("g", 1203, "c1203", ["pen", "red"]), ("h", 3, "c3", ["blue", "none", "pen"]), ("i", 4, "c4", [])], "group_id string, item_id long, category string, words array<string>")
    found = ranking.similar_texts(asked, items, 6, cap=None).withColumn("said", F.concat_ws(" ", "words"))
    in_order = lambda rows: [(r["item_id"], r["shared"]) for r in sorted(rows, key=lambda r: r["place"])]
    plain = {r: sorted(((i, len(set(n.split()) & set(r))) for i, n, *_ in held if set(n.split()) & set(r)), key=lambda x: (-x[1], x[0]))[:6] for r in (("pen", "red"), ("blue", "none", "pen"))}
    assert {tuple(k.split()): in_order(v) for k, v in grouped(found, "said").items()} == plain  # the first 500 products of a token alone before
    picks = grouped(ranking.negatives(asked, items), "group_id")
    assert {r["item_id"] for r in picks["g"] if r["kind"] == "similar_text"} == {1201, 1205} and all(len(v) == 6 for v in picks.values())


def test_suggestions_merge(spark):
    rows = [("q", 0, "product", "анализатор мочи", 5.0), ("q", 1, "category", "анализаторы мочи", 9.0), ("q", 1, "category", "тест", 1.0)]
    df = spark.createDataFrame(rows, "asked string, group int, kind string, text string, score double")
    got = [r["text"] for r in suggest.merged(df).orderBy("place").collect()]
    assert got == ["анализаторы мочи", "тест"]


def test_graph_vectors_follow_the_graph(spark):
    tokens = spark.createDataFrame([(t,) for t in ("cable", "cables", "drug", "pill", "stone")], "token string")
    edges = spark.createDataFrame([("drug", "pill", 0.5, 9), ("stone", "cable", 0.07, 9)], "token string, neighbor string, score double, cooccurrence long")
    plain = {r["token"]: r["v"] for r in vectors.surfaces(tokens, 48).collect()}
    got = {r["token"]: r["v"] for r in vectors.token_vectors(tokens, edges, 48).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert dot(plain["cable"], plain["cables"]) > 0.4  # shared n-grams
    mixed = [x + 0.35 * y for x, y in zip(plain["drug"], plain["pill"])]
    assert abs(dot(got["drug"], mixed) / dot(mixed, mixed) ** 0.5 - 1) < 1e-9
    assert all(abs(dot(got[t], plain[t]) - 1) < 1e-9 for t in ("cable", "cables", "pill", "stone"))  # no edge, or a weak one
    # the documents' own graph reaches their vectors: the two words always stand together
    rows = spark.createDataFrame([(i, "drug pill") for i in range(20)] + [(100, "drug"), (101, "pill")], "id long, text string")
    held = {r["id"]: r["vector"] for r in vectors.graph_vectors(rows, "id", "text").where("id >= 100").collect()}
    assert dot(held[100], held[101]) > dot(plain["drug"], plain["pill"]) + 0.2


def test_learned_vectors(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    _, out = vectors.learned_vectors(docs, "doc_id", "text", dimensions=4, features=64)
    assert out.count() == 60
    assert vectors.word_vectors(docs, "text", dimensions=8).getVectors().count() > 0


def test_boosted_ranker(spark):
    rows = spark.range(60).select((F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 5 > 2).cast("double").alias("label"))
    assert ranking.boosted_ranker(rows, ["x"], rounds=2).transform(rows).select("score").distinct().count() > 1


def test_session_priority(spark):
    score, codes, tier = personal.session_adjustment(F.lit("i"), F.lit("c"), F.array(F.lit("i")), F.array(F.lit("i")), F.array(F.lit("c")), F.array(F.lit("x")))
    row = spark.range(1).select(score.alias("s"), codes.alias("c"), tier.alias("t")).first()
    assert row["s"] == 48.5 and row["t"] == 100.0 and row["c"] == ["SESSION_CLICK_BOOST", "SESSION_CART_BOOST", "SESSION_CATEGORY_BOOST"]

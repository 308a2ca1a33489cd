"""What a step hands on grows with its input: rows that the nodes of a plan put out, and partitions."""

import math

from pyspark.sql import functions as F

import __spark_entry__
from spindrift.operators import asof, corpus, engine, enrich, index, profile, purchases, retrieval, shared, suggest
from spindrift.operators import vectors as vectors_of
from spindrift.plans import search


def widest(df):
    """The most rows that a node of df's plan put out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            told = node.metrics().get("numOutputRows")
            most = max(most, told.get().value() if told.isDefined() else 0)
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_alike_rows_and_queries_are_scored_once(spark):
    hits = spark.range(1200).select(F.explode(F.array(F.lit("a"), F.concat(F.lit("b"), (F.col("id") % 3).cast("string")))).alias("prefix"), F.col("id").alias("item_id"), (1.0 + F.col("id") % 2).alias("tf"), F.lit(4).alias("length"))
    asked = spark.range(90).select((-F.col("id")).alias("query_id"), F.explode(F.array(F.lit("a"), F.concat(F.lit("b"), (F.col("id") % 3).cast("string")))).alias("prefix"))
    found = index.best_rows(hits, asked, 5000, 4.0, 5)
    rate = {"a": math.log((5000 - 1200 + 0.5) / 1200.5), "b": math.log((5000 - 400 + 0.5) / 400.5)}
    part = lambda tf: tf * 2.2 / (tf + 1.2)
    want = {}
    for q in range(90):
        rows = [(-round(rate["a"] * part(1.0 + i % 2) + (rate["b"] * part(1.0 + i % 2) if i % 3 == q % 3 else 0), 6), i) for i in range(1200)]
        want[-q] = [(i, -s) for s, i in sorted(rows)[:5]]
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["item_id"], round(r["score"], 6)))
    assert got == want
    assert widest(found) <= 2400  # 36,000 and more before


def test_windows_by_customer_take_as_many_tasks_as_their_rows_need(spark, small, monkeypatch):
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    plain = sorted(map(str, __spark_entry__.queries()["rule_score"](spark, small).collect()))
    monkeypatch.setattr(shared, "ROWS_A_TASK", lines // 20)
    for name in ("pit_user_features", "pit_trailing_counts", "history_priority", "reason_trace", "rule_score"):
        got = __spark_entry__.queries()[name](spark, small)
        sizes = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 12 and max(sizes) < lines / 6, name  # four partitions before
    assert sorted(map(str, __spark_entry__.queries()["rule_score"](spark, small).collect())) == plain


def test_peers_meet_where_the_customer_is(spark):
    stats = spark.range(4000).select((F.col("id") % 1000).alias("customer_id"), F.concat(F.lit("c"), (F.col("id") % 7 + F.col("id") / 1000).cast("int").cast("string")).alias("category"), (F.col("id") % 13).alias("purchase_count"), F.lit(1.0).alias("total_amount"))
    people, lists = purchases.overlap_peers(stats, top=2, limit=5, rows=20 * shared.ROWS_A_TASK)
    held = people.join(lists, "list")
    assert held.count() == 5000 and held.where("customer_id = peer_id").count() == 0
    assert len({r[0] for r in people.select(F.spark_partition_id()).distinct().collect()}) > 12


def test_equal_vectors_are_compared_once(spark):
    vectors = [[1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 0.0], [-1.0, 0.0, 0.0], [1.0, None, 0.0], [0.5, 0.5]]
    rows = spark.createDataFrame([(i, vectors[i % 6]) for i in range(1200)], "vec_id long, embedding array<float>")
    asked = rows.where("vec_id % 20 < 2").selectExpr("vec_id AS query_id", "embedding AS asked")
    got = {}
    found = vectors_of.exact_topk(rows, asked, 7)
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 6)))
    want = {}
    for q in (i for i in range(1200) if i % 20 < 2 and i % 6 in (0, 1, 3, 5)):
        want[q] = [(i, 1.0) for i in range(q % 6, 1200, 6) if i != q][:7]
    assert got == want
    assert widest(found) <= 1500  # 144,000 before
    apart = spark.range(400).selectExpr("id AS vec_id", "array(cos(id), sin(id), 0.5D) AS embedding")
    some = apart.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS asked")
    rows = vectors_of.exact_topk(apart, some, 3).select("query_id", "vec_id", "rank", "score").collect()
    assert len(rows) == 60
    for q, i, rank, score in rows:
        near = sorted(((math.cos(q - x) + 0.25) / 1.25 for x in range(400) if x != q), reverse=True)
        assert abs(near[rank - 1] - score) < 1e-9 and abs((math.cos(q - i) + 0.25) / 1.25 - score) < 1e-9  # q + x and q - x are as near


def test_alike_products_and_queries_are_featured_once(spark, monkeypatch):
    kinds = [("red pen", "pens", "a | 5 gb"), ("blue pen", "pens", "a | 7 gb"), ("table", "tables", "b")]
    rows = spark.createDataFrame([(i, *kinds[i % 3], kinds[i % 3][0]) for i in range(90)], "item_id long, name string, category string, attributes string, key_tokens string")
    words = spark.createDataFrame([("desk", "table")], "source string, target string")
    asked = spark.createDataFrame([(i, ["red pen 5 gb", "table", "pen", None][i % 4]) for i in range(40)], "query_id long, query string")
    met, whole = [], retrieval.E.soft_overlaps
    monkeypatch.setattr(retrieval.E, "soft_overlaps", lambda pairs, *rest: met.append(pairs.count()) or whole(pairs, *rest))
    got = {}
    for r in retrieval.search(asked, engine.built(rows, words, least_frequency=1)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"], r["attribute_score"]))
    assert sorted(got) == [i for i in range(40) if i % 4 < 3] and max(met) <= 9  # more than 1,000 before
    for q, held in got.items():
        assert sorted(held) == sorted(got[q % 4]) and [r for r, _, _ in sorted(held)] == list(range(1, len(held) + 1))
    assert [i for _, i, _ in sorted(got[0])] == list(range(0, 60, 3)) and {a for _, _, a in got[0]} == {5.0}


def test_costly_rows_of_few_files_take_several_tasks(spark, small):
    for name in ("text_shapes", "product_shapes"):
        assert __spark_entry__.queries()[name](spark, small).rdd.getNumPartitions() >= 4, name  # one before


def test_profile_cells_meet_where_the_customer_is(spark, tmp_path):
    lines = spark.range(3000).selectExpr("id % 90 AS customer_id", "concat('c', id % 7) AS category", "id % 50 AS item_id", "id % 11 AS supplier_id", "'goods' AS kind", "id % 13 + 0.5D AS amount", "date_add(DATE '2020-12-01', CAST(id % 60 AS INT)) AS day", "id % 2 AS year")
    each, years = str(tmp_path / "each"), str(tmp_path / "years")
    profile.store_each(lines, each, "year")
    for year in (0, 1):
        profile.store(profile.cells(lines.where(f"year = {year}")), years, str(year))
    held = profile.profiles(profile.load(spark, each))
    assert held._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # two before
    assert sorted(map(str, held.collect())) == sorted(map(str, profile.profiles(profile.load(spark, years)).collect()))


def test_documents_of_few_files_are_cut_by_several_tasks(spark, small):
    held = search.texts(spark, small)
    assert held.rdd.getNumPartitions() >= 4 and held.count() == spark.read.parquet(f"{small}/documents.parquet").count()  # read by one task before


def test_candidates_write_no_questions_down(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert widest(__spark_entry__.queries()["candidate_features"](spark, small)) <= 2 * lines  # 17 times the lines and more before


def test_purchases_as_candidates_know_what_candidates_know(spark):
    rows = [(1, 10, 5, 2.0, 0), (1, 10, 6, 1.0, 3), (1, 11, 5, 4.0, 3), (2, 10, 6, 8.0, 5), (2, 12, None, 3.0, 6), (None, 10, 5, 1.0, 7), (1, 10, 5, 2.0, 0), (3, 13, 7, 0.5, None), (1, 13, 7, None, 40), (1, 11, 5, 4.0, 400), (4, 13, 5, 9.0, 400), (2, 11, 6, 2.0, 401)]
    full = [(i, 1, c, it, s, None if it == 12 else f"c{it % 3}", "goods", "r" if c != 2 else None, "t" if c != 4 else "u", a, d) for i, (c, it, s, a, d) in enumerate(rows)]
    lines = spark.createDataFrame(full, "contract_id long, line int, customer_id long, item_id long, supplier_id long, category string, kind string, region string, type string, amount double, n int")
    lines = lines.withColumn("day", F.date_add(F.lit("2023-12-20").cast("date"), F.col("n"))).drop("n")
    about = {"name": F.lit("red pen"), "attributes": F.lit("ink:red"), "attribute_count": F.lit(1), "query": F.lit("red pen")}
    places = spark.createDataFrame([(6, "r"), (5, "q")], "supplier_id long, region string")
    leaders = enrich.leading_category(lines)
    versions = asof.ledger(asof.day_totals(enrich.segmented(lines, leaders), enrich.FACTS))
    bands = enrich.price_bands(versions, lines.select("item_id", "category").distinct(), 2023, 2025)
    order = ("contract_id", "line")
    asked = lines.drop("supplier_id").withColumns(about)
    want = enrich.features(enrich.enriched(asked, ["contract_id"], versions, leaders, enrich.median_amounts(lines.where("day IS NOT NULL"), order), bands, places), "contract_id")
    got = enrich.features(enrich.enriched_purchases(lines, order, places, 3).withColumns(about), "contract_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == len(rows)
    none = enrich.enriched_purchases(lines.limit(0), order, places, 3).withColumns(about)
    assert enrich.features(none, "contract_id").count() == 0


def most_shuffled(df):
    """The most rows that an exchange of df's plan wrote."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            told = node.metrics().get("shuffleRecordsWritten")
            most = max(most, told.get().value() if told.isDefined() else 0)
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_lists_of_a_type_and_query_are_told_once(spark):
    products = spark.range(100).selectExpr("id AS item_id", "concat('pens ', id) AS name", "concat('c', id % 3) AS category")
    people = spark.range(2000).selectExpr("id AS customer_id", "IF(id % 9 = 0, NULL, concat('t', id % 2)) AS type")
    lines = spark.range(600).selectExpr("id % 40 AS customer_id", "id % 120 AS item_id")
    typical = spark.createDataFrame([("t0", "c0"), ("t1", "c1")], "type string, category string")
    preferred = spark.createDataFrame([(1, "c2", 1.0), (1, None, 1.0)], "customer_id long, category string, weight double")
    asked = people.selectExpr("customer_id", "IF(customer_id % 5 = 0, 'pens and more', 'pe') AS query")
    found = suggest.same_type_prefix(asked, suggest.prefix_table(products), people, lines, typical, preferred, lines.selectExpr("customer_id", "item_id", "1D AS weight"))
    assert most_shuffled(found) <= 2000  # a row a customer and product before
    rows = found.collect()
    assert {r["customer_id"] for r in rows} >= {i for i in range(2000) if i % 5 and i % 9} and all(r["query"] == "pe" and 1 <= r["rank"] <= 30 for r in rows)


def test_suggestions_are_computed_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(x):
        made.add(1)
        return x

    rows = spark.range(500).selectExpr("id AS asked", "'pe' AS query", "concat('pens ', chr(97 + CAST(id % 9 AS INT)), 'x') AS name", "2L AS count", "1D AS score").withColumn("name", name.asNondeterministic()("name"))
    nothing = spark.createDataFrame([], "asked long, normalized string, corrected_query string, synonyms array<string>")
    out = suggest.suggested(rows, rows, rows.selectExpr("asked", "query", "name AS category"), nothing)
    assert out.select("asked").distinct().count() == 500 and made.value <= 3 * 500  # three times as many before


def test_texts_share_the_vectors_of_their_words(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = spark.createDataFrame([(i, " ".join(words[(i + j) % 6] for j in range(3))) for i in range(600)] + [(900, ""), (901, None)], "id long, text string")
    found = vectors_of.graph_vectors(rows, "id", "text", 70)
    assert most_shuffled(found) <= 1800 + 4 * 6  # and of each of the 1800 a vector before
    got = {r["id"]: r["vector"] for r in found.collect()}
    assert sorted(got) == list(range(600)) and all(len(v) == 70 and abs(sum(x * x for x in v) - 1) < 1e-4 for v in got.values())
    assert all(got[i] == got[i % 6] for i in got) and got[0] != got[1]
    plain = vectors_of.summed(spark.range(1).select(F.lit("ab").alias("token"), F.explode(F.array(*[F.struct(vectors_of.hashed(F.lit(k), 70).alias("v"), F.lit(w).alias("w")) for k, w in [("tok:ab", 0.7), ("ng:<ab", 0.3), ("ng:ab>", 0.3), ("ng:<ab>", 0.3)]])).alias("p")).select("token", "p.v", "p.w"), "token", "v", F.col("w"), 70).first()["v"]
    held = vectors_of.surfaces(spark.createDataFrame([("ab",)], "token string"), 70).first()["v"]
    assert all(abs(x - y) < 1e-12 for x, y in zip(plain, held))


def test_products_of_few_files_are_stored_by_several_tasks(spark, small):
    rows = search.products(spark, small)
    assert rows.rdd.getNumPartitions() >= 4  # read and cut into words by one task before
    held = search.engine(spark, small)
    assert len(held.store.rows().inputFiles()) >= 4
    words = ("name", "category", "key_tokens")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(held.vocabulary, corpus.token_frequency(rows, *words)) and same(held.edges, corpus.cooccurrence(rows, "item_id", list(words)))
    assert same(held.store.read("terms").select("term"), held.store.postings().select("term").distinct())


def all_shuffled(df):
    """The rows that all exchanges of df's plan wrote."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            told = node.metrics().get("shuffleRecordsWritten")
            rows += told.get().value() if told.isDefined() else 0
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_offers_are_dealt_by_customer_once(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert all_shuffled(__spark_entry__.queries()["reranked_offers"](spark, small)) <= 2 * lines  # four times the lines before, though orders and products are broadcast here


def test_expansion_cuts_texts_once(spark, small):
    found = __spark_entry__.queries()["semantic_expansion"](spark, small)
    assert not any("documents" in f for f in found.inputFiles())  # each count and join read and dealt the texts again before
    rows = spark.createDataFrame([(1, "Red pen, red", "Ёлка"), (2, None, ""), (3, "--", None)], "id long, a string, b string")
    assert {r["row"]: r["tokens"] for r in corpus.words_once(rows, "id", "a", "b").collect()} == {1: ["red", "pen", "red", "елка"], 2: [], 3: []}


def shuffled_bytes(df):
    """The bytes that all exchanges of df's plan wrote, uncompressed."""
    df.collect()
    todo, size = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            told = node.metrics().get("dataSize")
            size += told.get().value() if kind == "ShuffleExchangeExec" and told.isDefined() else 0
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return size


def test_vectors_of_words_are_made_where_texts_are(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(5))) for i in range(400)], "id long, text string")
    assert shuffled_bytes(vectors_of.graph_vectors(rows, "id", "text", 70)) < 2000 * 70 * 8 // 2  # a vector of each of 2000 words before


def test_vectors_of_texts_are_sums_of_those_of_words(spark):
    words = ["cable", "cables", "drug", "pill", "stone", "ab", "насос", "w" * 40]
    rows = spark.createDataFrame([(i % 45, " ".join(words[(i * k) % 8] for k in range(i % 5 + 1))) for i in range(50)] + [(90, "--"), (91, None)], "id long, text string")
    got = {r["id"]: r["vector"] for r in vectors_of.graph_vectors(rows, "id", "text", 70).collect()}
    tokens = rows.select("id", F.explode(F.array_distinct(corpus.T.tokenize(F.col("text")))).alias("token"))
    edges = corpus.cooccurrence(rows, "id", ["text"])
    assert edges.where("score >= 0.08").count() > 4
    weights = tokens.groupBy("token").agg(vectors_of.N.idf(F.count("*"), F.lit(52.0)).alias("w"))
    plain = vectors_of.summed(tokens.join(vectors_of.token_vectors(weights.select("token"), edges, 70), "token").join(weights, "token"), "id", "v", F.col("w"), 70)
    want = {r["id"]: r["v"] for r in plain.collect()}
    assert sorted(got) == sorted(want) == list(range(45)) and all(abs(x - y) < 2e-6 for i in want for x, y in zip(got[i], want[i]))


def test_purchases_take_along_what_is_needed(spark, small):
    from spindrift.plans import profiles

    told = enrich.enriched_purchases(profiles.purchases(spark, small, 4), ("contract_id", "line"), profiles.regions(spark, small, "supplier"), 4)
    assert not {"customer_id", "kind"} & set(told.columns)  # went along to the product before

"""Suggestions: ranked groups, round-robin merging, de-duplication; benchmarks from real purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import phrases as H
from spindrift.functions import text as T
from spindrift.operators.corpus import BROADCAST_ROWS
from spindrift.operators.shared import spread, written

#: Ties between kinds of suggestion.
KINDS = ("query", "correction", "product", "category")


def merged(groups: DataFrame, limit: int = 10) -> DataFrame:
    """asked, text, kind, score, place: ranked groups (asked, group, kind, text, score) taken in turn, the best of each meaning once.

    Texts mean the same if their stems do; the best of them takes the earliest place.
    """
    groups = written(groups, "groups")
    rows = groups.count()
    groups = spread(groups, rows, "asked")
    own = W.partitionBy("asked", "group").orderBy(F.desc("score"), "text")
    turn = groups.withColumn("turn", F.row_number().over(own))
    placed = turn.withColumn("position", F.row_number().over(W.partitionBy("asked").orderBy("turn", "group", "text")))
    meanings = written(groups.select("text").distinct().withColumn("meaning", F.array_join(T.stem_tokens(T.tokenize(F.col("text"))), " ")), "meanings")
    keyed = placed.join(F.broadcast(meanings) if meanings.count() <= BROADCAST_ROWS else meanings, "text")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    same = W.partitionBy("asked", "meaning")
    best = keyed.withColumns({"first": F.min("position").over(same), "again": F.row_number().over(same.orderBy(F.desc("score"), rank, F.length("text"), "text"))}).where("again = 1")
    out = best.withColumn("place", F.row_number().over(W.partitionBy("asked").orderBy("first", "text")))
    return out.where(F.col("place") <= limit).select("asked", "text", "kind", "score", "place")


def query_support(purchases: DataFrame) -> DataFrame:
    """query, items (item:support, best first), support, share of the best, customers: of purchases (query, item_id, customer_id)."""
    pairs = purchases.groupBy("query", "item_id").agg(F.count("*").alias("n"))
    people = purchases.groupBy("query").agg(F.count_distinct("customer_id").alias("customers"))
    own = W.partitionBy("query")
    held = pairs.withColumns({"top": F.max("n").over(own), "support": F.sum("n").over(own)})
    kept = held.where(F.col("n") >= F.greatest(F.lit(2), F.bround(0.25 * F.col("top"))))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "item_id"))), lambda x: F.concat_ws(":", x["item_id"].cast("string"), (-x["m"]).cast("string"))), ",")
    out = kept.groupBy("query").agg(listed.alias("items"), F.max("support").alias("support"), F.max("top").alias("top"))
    return out.join(people, "query").withColumn("share", F.col("top") / F.col("support"))


def benchmark(purchases: DataFrame, least: int = 3, least_top: int = 2, least_share: float = 0.6) -> DataFrame:
    """Queries with enough support whose best item leads clearly."""
    return query_support(purchases).where((F.col("support") >= least) & (F.col("top") >= least_top) & (F.col("share") >= least_share))


#: Edge prefixes that are kept, and how many products each keeps.
EDGES, KEPT = (2, 3, 4), 120
# What a short prefix asks of products whose category doesn't fit (share that the type bought; purchases).
LEAST_SHARE_ALONE, LEAST_COUNT = 0.45, 3
TOP_OF_TYPE = 30


def prefixes(products: DataFrame, edges: tuple[int, ...] = EDGES) -> DataFrame:
    """prefix, item_id, name, category, text: of each edge prefix of the normalised names (text) all its products, a product once a prefix."""
    text = T.normalize_text(F.col("name"))
    held = products.select("item_id", "name", "category", text.alias("text")).where("text <> ''")
    cut = F.array_distinct(F.filter(F.array(*[F.when(F.length("text") >= n, F.substring("text", 1, n)) for n in edges]), lambda x: x.isNotNull()))
    return held.select(F.explode(cut).alias("prefix"), "item_id", "name", "category", "text")


def prefix_table(products: DataFrame, edges: tuple[int, ...] = EDGES, most: int = KEPT) -> DataFrame:
    """prefix, item_id, name, category, place: of each edge prefix of the normalised names the products of shortest name (then by name, then id).

    A product has as many prefixes as there are edges; of each prefix every task sends on its best ones alone.
    """
    order = W.partitionBy("prefix").orderBy(F.length("text"), "text", "item_id")
    return prefixes(products, edges).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("text")


def short_prefix(query: Column, customer: Column) -> Column:
    """The query as a prefix of 2 to 4 characters, if it is one token and the customer is known; else null."""
    text = T.normalize_text(query)
    return F.when(customer.isNotNull() & (F.size(T.tokenize(query)) == 1) & F.length(text).between(EDGES[0], EDGES[-1]), text)


def type_stats(lines: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(type, item_id, count; customer_id, item_id, own; item_id, total) of purchases; people: customer_id, type."""
    own = lines.groupBy("customer_id", "item_id").agg(F.count("*").alias("own"))
    typed = own.join(people, "customer_id").groupBy("type", "item_id").agg(F.sum("own").alias("count"))
    return typed, own, own.groupBy("item_id").agg(F.sum("own").alias("total"))


def near(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def type_facts(kinds: DataFrame, prefixes: DataFrame, typed: DataFrame, totals: DataFrame, typical: DataFrame) -> DataFrame:
    """type, query, item_id, name, category, count (of the type), total, usual, match, code: what a type and query (kinds: type, query, prefix) tell of each product of the prefix."""
    kinds = near(kinds)
    by_type = typed.where("type IS NOT NULL").groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "count"))).alias("counts"))
    held = prefixes.join(totals.join(by_type, "item_id", "left"), "item_id", "left").join(kinds, "prefix")
    names = held.select("query", "name").distinct().withColumn("match", H.prefix_match(F.col("query"), T.tokenize(F.col("name")), secondary=False))
    known = typical.groupBy("type").agg(F.flatten(F.collect_set(T.category_codes(F.col("category")))).alias("codes"))
    code = 14.0 * T.code_match(T.category_codes(F.col("category")), F.coalesce("codes", F.array().cast("array<string>")))
    codes = held.select("type", "category").distinct().join(known, "type", "left").select("type", F.col("category").alias("of"), code.alias("code"))
    usual = typical.select("type", F.col("category").alias("of"), F.lit(True).alias("usual")).distinct()
    codes = written(codes.join(usual, ["type", "of"], "left"), "codes")
    told = held.join(near(written(names, "names")), ["query", "name"]).join(near(codes).withColumnRenamed("type", "__type"), (F.col("type") == F.col("__type")) & F.col("category").eqNullSafe(F.col("of")))
    count = F.coalesce(F.try_element_at("counts", "type"), F.lit(0))
    return told.select("type", "query", "item_id", "name", "category", count.alias("count"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("usual", F.lit(False)).alias("usual"), "match", "code")


def scored(rows: DataFrame) -> DataFrame:
    """rows (n, total, usual, match, code, weight, advised) with admitted and their score, not rounded."""
    liked = F.when(F.col("usual"), 12.0).otherwise(F.least(F.lit(10.0), F.col("weight") * 1.8))
    rows = rows.withColumns({"liked": liked, "part": F.col("n") / F.greatest("n", "total")})
    fits = F.greatest("liked", "code") > 0
    admitted = fits | ((F.col("part") >= LEAST_SHARE_ALONE) & (F.col("n") >= LEAST_COUNT))
    score = 0.06 * F.col("match") + F.least(F.lit(14.0), 2.5 * F.log1p("n")) + 18.0 * F.col("part") + F.col("liked") + F.col("code") + F.least(F.lit(6.0), F.col("advised")) - F.when(fits, 0.0).otherwise(10.0)
    return rows.withColumns({"admitted": admitted, "score": score})


#: Scores are rounded to so many parts of 1; what is further apart than this many parts stays apart.
PARTS, APART = 10_000, 3
ELEMENT = ("item_id", "name", "category", "count", "total", "usual", "match", "code")


def best_lists(facts: DataFrame, depths: DataFrame) -> DataFrame:
    """type, query, depth, anyone, alone, liked (category -> list): the products that can be among the ``depth`` best for someone who has none of them.

    anyone: for a customer who prefers no category; liked: of a category for those who prefer it; alone: for those of whose type nobody else
    bought.  A preference only adds to a score, the same to all of its category, so whoever is among a customer's best is among the best of
    one of these lists; what rounding may make equal to the last place is kept with it.  Of products with equal facts names and ids decide.
    """
    held = facts.where("match > 0").withColumns({"weight": F.lit(0.0), "advised": F.lit(0.0), "element": F.struct(*ELEMENT)})
    by_count = scored(held.where("count > 0").withColumn("n", F.col("count")))
    by_total = scored(held.where("usual AND total > 0").withColumn("n", F.col("total")))
    of = lambda rows, kind, cat: rows.select("type", "query", F.lit(kind).alias("kind"), cat.alias("cat"), "n", "element", "score")
    # a penalty or the code of a category is the same for all its products, so without them the order is that of any customer who prefers it
    base = by_count.withColumn("score", 0.06 * F.col("match") + F.least(F.lit(14.0), 2.5 * F.log1p("n")) + 18.0 * F.col("part"))
    rows = of(by_count.where("admitted"), "anyone", F.lit("")).unionByName(of(base.where("NOT usual AND category IS NOT NULL"), "liked", F.col("category"))).unionByName(of(by_total, "alone", F.lit("")))
    rows = rows.withColumn("z", F.floor(F.col("score") * PARTS))
    key = ["type", "query", "kind", "cat"]
    steps = rows.groupBy(*key, "z").agg(F.count("*").alias("m"))
    steps = steps.withColumn("upto", F.sum("m").over(W.partitionBy(*key).orderBy(F.desc("z")))).crossJoin(F.broadcast(depths))
    ends = steps.groupBy(*key, "depth").agg(F.coalesce(F.max(F.when(F.col("upto") >= F.col("depth"), F.col("z"))), F.min("z")).alias("last"))
    kept = rows.join(near(written(ends, "ends")), key).where(F.col("z") >= F.col("last") - APART)
    turn = F.row_number().over(W.partitionBy(*key, "depth", "score", "n").orderBy(F.desc("element.name"), "element.item_id"))
    kept = kept.withColumn("turn", turn).where(F.col("turn") <= F.col("depth"))
    lists = kept.groupBy(*key, "depth").agg(F.collect_list("element").alias("each"))
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("each"))).alias(kind)
    liked = F.map_from_entries(F.collect_list(F.when(F.col("kind") == "liked", F.struct("cat", "each")))).alias("liked")
    return lists.groupBy("type", "query", "depth").agg(one("anyone"), one("alone"), liked)


def same_type_prefix(asked: DataFrame, prefixes: DataFrame, people: DataFrame, lines: DataFrame, typical: DataFrame, preferred: DataFrame, recommended: DataFrame) -> DataFrame:
    """customer_id, query, item_id, name, count, score, rank: products that begin with a short query and that other customers of the same type buy.

    asked: customer_id, query.  prefixes: see ``prefixes``.  typical: type and category; preferred: customer_id, category, weight (positive); recommended:
    customer_id, item_id, weight (positive).  Customers whose type nobody else bought for are shown what all customers bought of the typical categories.
    A product is admitted if its category, or the codes in it, fit the customer, or if enough of its purchases come from the type.
    All products of a prefix compete.  What a customer bought or is advised is scored for them; the others are the same for all of a type, so a customer
    meets the best of them alone (``best_lists``), as many more as they have own ones among them.
    """
    asked = asked.withColumn("prefix", short_prefix(F.col("query"), F.col("customer_id"))).where("prefix IS NOT NULL").join(people.where("type IS NOT NULL"), "customer_id")
    asked = written(asked.select("customer_id", "type", "query", "prefix"), "asked")
    kinds = asked.select("type", "query", "prefix").distinct()
    items = near(written(prefixes.join(kinds.select("prefix").distinct(), "prefix", "left_semi").select("item_id").distinct(), "items"))
    typed, own, totals = type_stats(lines.join(items, "item_id", "left_semi"), people)
    own = written(own, "own")
    facts = written(type_facts(kinds, prefixes, typed, totals, typical), "facts")

    advised = recommended.join(items, "item_id", "left_semi").groupBy("customer_id", "item_id").agg(F.max("weight").alias("advised"))
    mine = own.join(advised, ["customer_id", "item_id"], "full").join(asked.drop("prefix"), "customer_id").join(near(facts), ["type", "query", "item_id"])
    mine = mine.select("customer_id", "type", "query", F.struct(*ELEMENT, F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("advised", F.lit(0.0)).alias("advised")).alias("x"))
    mine = written(mine.groupBy("customer_id", "type", "query").agg(F.collect_list("x").alias("mine")), "mine")
    depth = lambda c: (TOP_OF_TYPE * F.pow(F.lit(2.0), F.ceil(F.log2((F.size(c) + TOP_OF_TYPE) / TOP_OF_TYPE)))).cast("int")
    depths = mine.select(depth(F.col("mine")).alias("depth")).unionByName(mine.sparkSession.range(1).select(F.lit(TOP_OF_TYPE).alias("depth"))).distinct()
    lists = written(best_lists(facts, depths), "lists")
    bought = facts.groupBy("type", "query").agg(F.sum("count").alias("bought"))

    rows = spread(asked.select("customer_id", "type", "query"), KEPT * asked.count(), "customer_id")
    liking = preferred.where("category IS NOT NULL").groupBy("customer_id", "category").agg(F.max("weight").alias("v"))
    rows = rows.join(liking.groupBy("customer_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "v"))).alias("preferred")), "customer_id", "left")
    rows = rows.join(mine, ["customer_id", "type", "query"], "left").withColumn("depth", F.when(F.col("mine").isNull(), TOP_OF_TYPE).otherwise(depth(F.col("mine"))))
    rows = rows.join(near(written(bought, "bought")), ["type", "query"]).join(near(lists), ["type", "query", "depth"], "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kind = dict(lists.dtypes)["anyone"]
    rows = rows.withColumns({"mine": empty("mine", dict(mine.dtypes)["mine"]), "preferred": F.coalesce("preferred", F.create_map().cast("map<string,double>"))})
    rows = rows.withColumn("some", F.col("bought") > F.aggregate("mine", F.lit(0).cast("long"), lambda s, x: s + x["own"]))
    ids = F.transform("mine", lambda x: x["item_id"])
    likes = F.flatten(F.transform(F.map_keys("preferred"), lambda c: empty(F.try_element_at("liked", c), kind)))
    anyone = F.filter(empty("anyone", kind), lambda x: x["usual"] | x["category"].isNull() | ~F.map_contains_key("preferred", F.coalesce(x["category"], F.lit(""))))
    others = F.when(F.col("some"), F.concat(anyone, likes)).otherwise(empty("alone", kind))
    others = F.transform(F.filter(others, lambda x: ~F.array_contains(ids, x["item_id"])), lambda x: F.struct(*[x[c].alias(c) for c in ELEMENT], F.lit(0).cast("long").alias("own"), F.lit(0.0).alias("advised")))
    rows = rows.select("customer_id", "query", "some", "preferred", F.inline(F.concat("mine", others)))
    rows = rows.withColumn("weight", F.coalesce(F.try_element_at("preferred", "category"), F.lit(0.0))).drop("preferred")
    rows = rows.withColumn("n", F.when(F.col("some"), F.col("count") - F.col("own")).otherwise(F.when(F.col("usual"), F.col("total") - F.col("own")).otherwise(0))).where("n > 0 AND match > 0")
    out = scored(rows).where("admitted").withColumn("score", F.round("score", 4))
    order = W.partitionBy("customer_id", "query").orderBy(F.desc("score"), F.desc("n"), F.desc("name"), "item_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_OF_TYPE)
    return ranked.select("customer_id", "query", "item_id", "name", F.col("n").alias("count"), "score", "rank")


def matching(rows: DataFrame, phrase: Column) -> DataFrame:
    """query, name, text, match of the distinct pairs (query, name) of which the phrase made of the name, or the name, begins like the query; computed once, as these are long expressions."""
    names = written(rows.select("name").distinct().select("name", phrase.alias("phrase")), "names")
    names = written(names.select("name", F.when(F.col("phrase") == "", F.col("name")).otherwise(F.col("phrase")).alias("text")).withColumns({"of_text": T.tokenize(F.col("text")), "of_name": T.tokenize(F.col("name"))}), "words")
    pairs = written(rows.select("query", "name").distinct().join(names, "name"), "pairs")
    scored = [written(pairs.select("query", "name", H.prefix_match(F.col("query"), F.col(c)).alias(c)), "scored") for c in ("of_text", "of_name")]
    both = pairs.select("query", "name", "text").join(scored[0], ["query", "name"]).join(scored[1], ["query", "name"])
    found = written(both.select("query", "name", "text", F.greatest("of_text", "of_name").alias("match")).where("match > 0"), "matches")
    return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found


def product_suggestions(rows: DataFrame, group: int) -> DataFrame:
    """asked, group, kind, text, score of products (asked, query, name, count, score) whose name or short phrase begins like the query.

    score: what recommends the product, null for 0.
    """
    rows = written(rows.select("asked", "query", "name", "count", "score"), "products")
    held = rows.join(matching(rows, H.product_phrase(F.col("name"))), ["query", "name"])
    query = T.normalize_text(F.col("query"))
    begins = lambda c: F.when(F.startswith(T.normalize_text(F.col(c)), query), 1).otherwise(0)
    score = F.col("match") + F.least(F.col("count").cast("double"), F.lit(15.0)) + F.least(F.coalesce("score", F.lit(0.0)), F.lit(12.0)) + 18.0 * begins("text") + 10.0 * begins("name") + 35.0
    return held.where(T.normalize_text(F.col("name")) != query).select("asked", F.lit(group).alias("group"), F.lit("product").alias("kind"), "text", F.round(score, 4).alias("score"))


def category_suggestions(rows: DataFrame, group: int) -> DataFrame:
    """The same of a customer's categories (asked, query, category)."""
    named = written(rows.select("asked", "query", F.col("category").alias("name")), "categories")
    held = named.join(matching(named, H.category_phrase(F.col("name"))), ["query", "name"]).where(F.col("text") != T.normalize_text(F.col("query")))
    return held.select("asked", F.lit(group).alias("group"), F.lit("category").alias("kind"), "text", (F.col("match") + 20.0).alias("score"))


def query_suggestions(analysed: DataFrame, group: int) -> DataFrame:
    """Of analysed queries (asked, normalized, corrected_query, synonyms): the corrected query, if it differs, and synonyms."""
    rows = analysed.select("asked", "normalized", F.explode(F.concat(
        F.array(F.struct(F.lit("correction").alias("kind"), F.col("corrected_query").alias("text"), F.lit(180.0).alias("score"))),
        F.transform("synonyms", lambda s: F.struct(F.lit("query").alias("kind"), s.alias("text"), F.lit(160.0).alias("score"))),
    )).alias("s"))
    return rows.where("s.text <> '' AND s.text <> normalized").select("asked", F.lit(group).alias("group"), "s.*")


def suggested(products: DataFrame, of_type: DataFrame, categories: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """The groups merged; who has products of the type for a short prefix gets no categories.

    products, of_type: asked, query, name, count, score.  categories: asked, query, category.  queries: see ``query_suggestions``.
    """
    mine, typed, named = product_suggestions(products, 1), written(product_suggestions(of_type, 2), "typed"), category_suggestions(categories, 3)
    named = named.join(typed.select("asked").distinct(), "asked", "left_anti")
    return merged(mine.unionByName(typed).unionByName(named).unionByName(query_suggestions(queries, 4)), limit)

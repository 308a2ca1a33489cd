"""Aggregates over purchases: customers, categories, regions, offers, popularity, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.operators.corpus import BROADCAST_ROWS
from spindrift.operators.shared import spread, stored


def money(column: str):
    """An exact sum of cents, the same in whatever order the parts arrive, as a double."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def purchase_stats(lines: DataFrame, *keys: str) -> DataFrame:
    """Count, amount, first and last day of each key: associative measures, so partial sums leave the map side."""
    return lines.groupBy(*keys).agg(
        F.count("*").alias("purchase_count"),
        money("amount").alias("total_amount"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )


def merge_stats(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Stats of old and new lines together, from their stats alone."""
    return old.unionByName(new).groupBy(*keys).agg(
        F.sum("purchase_count").alias("purchase_count"),
        money("total_amount").alias("total_amount"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
    )


def with_category(lines: DataFrame, catalog: DataFrame, unknown: str = "UNKNOWN") -> DataFrame:
    """Lines with their product's category; products that the catalog lacks get the unknown one."""
    return lines.join(catalog.select("item_id", "category"), "item_id", "left").withColumn("category", F.coalesce("category", F.lit(unknown)))


def duplicate_keys(lines: DataFrame, *keys: str) -> DataFrame:
    """One row: distinct keys, keys seen more than once, surplus rows."""
    counts = lines.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("keys"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
    )


def mode_with_count(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key and how often it occurs; ties go to the smaller value."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("frequency"))
    order = W.partitionBy(key).orderBy(F.desc("frequency"), F.asc(value))
    return counts.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def offers(lines: DataFrame) -> DataFrame:
    """Offers of each product: count, average and least price, the supplier of the cheapest, the last day."""
    return lines.groupBy("item_id").agg(
        F.count("*").alias("offer_count"),
        (money("amount") / F.count("amount")).alias("avg_price"),
        F.min("amount").alias("min_price"),
        F.min_by("supplier_id", F.struct("amount", "contract_id", "line", "supplier_id")).alias("supplier_id"),
        F.max("day").alias("last_day"),
    )


def estimated_offers(stats: DataFrame) -> DataFrame:
    """Offers as history suggests them where no offer table is at hand."""
    sums = stats.groupBy("item_id").agg(F.sum("purchase_count").alias("offer_count"), money("total_amount").alias("total_amount"))
    return sums.select("item_id", "offer_count", F.when(F.col("offer_count") > 0, F.col("total_amount") / F.col("offer_count")).otherwise(F.lit(0.0)).alias("avg_price"))


def category_dictionary(catalog: DataFrame, unknown: str = "UNKNOWN") -> DataFrame:
    """category_id and category: the unknown one is 0, the others are numbered by name.  There are as many rows as categories."""
    named = catalog.select("category").where(F.col("category") != unknown).distinct().withColumn("category_id", F.row_number().over(W.orderBy("category")))
    return named.select("category_id", "category").unionByName(catalog.sparkSession.range(1).select(F.lit(0).alias("category_id"), F.lit(unknown).alias("category")))


def longest_values(catalog: DataFrame, key: str, *columns: str, most: str | None = None) -> DataFrame:
    """One row a key: the longest value of each column (ties: the greatest), and the most of one number."""
    pick = [F.max(F.struct(F.length(c).alias("n"), F.col(c).alias("v")))["v"].alias(c) for c in columns]
    return catalog.groupBy(key).agg(*pick, *([F.max(most).alias(most)] if most else []))


def weighted(rows: DataFrame, partition: list[str], tie: str, count: float, amount: float, rank: float, place: Column) -> DataFrame:
    """rank and weight within each partition, by purchase count, amount, then the tie column.

    place numbers the rows; where some repeat what they say of the tie column, a dense rank makes them one.
    The weight mixes the count and log amount against the largest of the partition with the reciprocal rank.
    """
    own = W.partitionBy(*partition)
    order = own.orderBy(F.desc("purchase_count"), F.desc("total_amount"), F.asc(tie))
    log = F.log1p("total_amount")
    share = F.col("purchase_count") / F.max("purchase_count").over(own)
    volume = F.coalesce(log / F.nullif(F.max(log).over(own), F.lit(0.0)), F.lit(0.0))
    ranked = rows.withColumn("rank", place.over(order))
    return ranked.withColumn("weight", count * share + amount * volume + rank / F.col("rank"))


def category_weights(rows: DataFrame, partition: list[str], tie: str = "category", place: Column | None = None) -> DataFrame:
    return weighted(rows, partition, tie, 0.55, 0.25, 0.20, F.row_number() if place is None else place)


def item_weights(rows: DataFrame, partition: list[str], tie: str = "item_id", place: Column | None = None) -> DataFrame:
    return weighted(rows, partition, tie, 0.60, 0.25, 0.15, F.row_number() if place is None else place)


def popularity(stats: DataFrame, key: str, cutoff_days: int, month: int, today) -> DataFrame:
    """Lifetime, recent (bought again within cutoff_days) and seasonal (last bought in that month) counts in one pass."""
    recent = F.col("last_day") >= F.date_sub(F.lit(today).cast("date"), cutoff_days)
    return stats.groupBy(key).agg(
        F.sum("purchase_count").alias("popularity"),
        F.sum(F.when(recent, F.col("purchase_count")).otherwise(0)).alias("recent"),
        F.sum(F.when(F.month("last_day") == month, F.col("purchase_count")).otherwise(0)).alias("seasonal"),
    )


def price_bands(stats: DataFrame, offers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Lower and upper quartile of the products' price proxies by category; products without a positive proxy are left out."""
    own = stats.groupBy("item_id").agg(F.avg(F.col("total_amount") / F.nullif(F.col("purchase_count"), F.lit(0))).alias("paid"))
    proxy = F.coalesce("min_price", "avg_price", "paid")
    rows = own.join(offers.select("item_id", "min_price", "avg_price"), "item_id", "left").withColumn("proxy", proxy).where("proxy > 0")
    return rows.join(catalog.select("item_id", "category"), "item_id").groupBy("category").agg(F.percentile("proxy", 0.25).alias("p25"), F.percentile("proxy", 0.75).alias("p75"))


def few(rows: DataFrame) -> DataFrame:
    """rows, broadcast if a count tells that they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def overlap_peers(category_stats: DataFrame, top: int = 5, limit: int = 120, rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """(customer_id, list; list, peer_id, shared, purchases): the peers that share most of each customer's top categories.

    Peers depend on the set of top categories alone, save that nobody is their own peer.  So lists are made once a
    distinct set, one longer than the limit, and only customers who stand in their set's own list have one of their own.
    A customer's categories stand in one partition and meet all sets there, so nothing is dealt by set or category, of which there are few.
    rows: how many category_stats there are at most.  category_stats: one row a customer and category.
    """
    category_stats = spread(stored(category_stats), rows, "customer_id")
    order = W.partitionBy("customer_id").orderBy(F.desc("purchase_count"), F.desc("total_amount"), "category")
    mine = category_stats.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    mine = mine.groupBy("customer_id").agg(F.array_sort(F.collect_list("category")).alias("held")).select("customer_id", "held", F.to_json("held").alias("set"))
    theirs = category_stats.select(F.col("customer_id").alias("peer_id"), "category", "purchase_count")
    asked = stored(mine.select("set", "held").distinct().select("set", F.explode("held").alias("category")))
    met = theirs.join(few(asked), "category")
    sums = met.groupBy("peer_id", "set").agg(F.count("*").alias("shared"), F.sum("purchase_count").alias("purchases"))
    best = W.partitionBy("set").orderBy(F.desc("shared"), F.desc("purchases"), "peer_id")
    ranked = stored(sums.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit + 1))
    inside = mine.join(few(ranked.select("set", F.col("peer_id").alias("customer_id"))), ["set", "customer_id"]).select("set", "customer_id", F.concat_ws("#", "set", "customer_id").alias("list"))
    own = inside.join(ranked, "set").where("customer_id <> peer_id").select("list", "peer_id", "shared", "purchases")
    common = ranked.where(F.col("place") <= limit).select(F.col("set").alias("list"), "peer_id", "shared", "purchases")
    people = mine.join(few(stored(inside.select("customer_id", "list"))), "customer_id", "left").select("customer_id", F.coalesce("list", "set").alias("list"))
    return people, few(stored(common.unionByName(own)))


def orphans(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """kind and item_id: products bought but not in the catalog, and products never bought."""
    bought, known = lines.select("item_id").distinct(), catalog.select("item_id").distinct()
    return bought.join(known, "item_id", "left_anti").withColumn("kind", F.lit("not_in_catalog")).unionByName(known.join(bought, "item_id", "left_anti").withColumn("kind", F.lit("never_bought")))


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__place = 1").drop("__place")


def ordered_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Union without repeated keys: an earlier part's row wins; source tells which."""
    tagged = [p.withColumn("source", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return first_of_each(out, [key], [F.asc("source")])

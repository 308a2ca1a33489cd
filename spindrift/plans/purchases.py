"""Queries over purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import purchases as P
from spindrift.plans.base import CATALOG, CONTRACTS, CUSTOMER_REGIONS, SUPPLIER_REGIONS, catalog, contracts, line_count, query, regions, table

STATS = "count(*) AS purchase_count, round(sum(amount), 2) AS total_amount, min(day) AS first_day, max(day) AS last_day"
TODAY = "2001-08-01"


def rounded(df, places: int = 2, *columns: str):
    for c in columns or ("total_amount",):
        df = df.withColumn(c, F.round(c, places))
    return df


@query(f"WITH {CONTRACTS} SELECT customer_id, item_id, {STATS} FROM contracts GROUP BY customer_id, item_id")
def customer_item_stats(spark, sf_dir):
    return rounded(P.purchase_stats(contracts(spark, sf_dir), "customer_id", "item_id"))


@query(f"WITH {CONTRACTS}, {CATALOG} SELECT customer_id, coalesce(category, 'UNKNOWN') AS category, {STATS} FROM contracts LEFT JOIN catalog USING (item_id) GROUP BY ALL")
def customer_category_stats(spark, sf_dir):
    return rounded(P.purchase_stats(P.with_category(contracts(spark, sf_dir), catalog(spark, sf_dir)), "customer_id", "category"))


@query(f"WITH {CONTRACTS}, {CATALOG}, {CUSTOMER_REGIONS} SELECT region, category, {STATS} FROM contracts JOIN catalog USING (item_id) JOIN customer_regions USING (customer_id) GROUP BY ALL")
def region_category_stats(spark, sf_dir):
    lines = P.with_category(contracts(spark, sf_dir), catalog(spark, sf_dir)).join(regions(spark, sf_dir, "customer"), "customer_id")
    return rounded(P.purchase_stats(lines, "region", "category"))


@query(f"""WITH {CONTRACTS}, k AS (SELECT count(*) AS n FROM contracts GROUP BY contract_id, item_id, customer_id)
SELECT count(*) AS keys, count(*) FILTER (n > 1) AS repeated_keys, CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS duplicates FROM k""")
def duplicate_contract_keys(spark, sf_dir):
    return P.duplicate_keys(contracts(spark, sf_dir), "contract_id", "item_id", "customer_id")


@query(f"""WITH {CONTRACTS} SELECT count(*) AS lines, count(*) FILTER (amount IS NULL) AS empty_amounts, count(DISTINCT customer_id) AS customers, count(DISTINCT item_id) AS items,
round(avg(amount), 4) AS avg_amount, min(day) AS first_day, max(day) AS last_day, count(DISTINCT year(day)) AS years FROM contracts""")
def dataset_profile(spark, sf_dir):
    return contracts(spark, sf_dir).agg(
        F.count("*").alias("lines"), F.count_if(F.col("amount").isNull()).alias("empty_amounts"), F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("item_id").alias("items"), F.round(F.avg("amount"), 4).alias("avg_amount"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count_distinct(F.year("day")).alias("years"),
    )


@query(f"""WITH {CONTRACTS}, {CATALOG}, n AS (SELECT category, count(*) AS lines FROM contracts JOIN catalog USING (item_id) GROUP BY category)
SELECT category, lines FROM n ORDER BY lines DESC, category LIMIT 3""")
def top_categories(spark, sf_dir):
    """A top-k report: the limit is the feature."""
    return P.with_category(contracts(spark, sf_dir), catalog(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("lines")).orderBy(F.desc("lines"), "category").limit(3)


@query(f"""WITH {CONTRACTS}, {SUPPLIER_REGIONS}, n AS (SELECT customer_id, region, count(*) AS frequency FROM contracts JOIN supplier_regions USING (supplier_id) GROUP BY ALL)
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY frequency DESC, region) = 1""")
def customer_region_mode(spark, sf_dir):
    rows = contracts(spark, sf_dir).join(regions(spark, sf_dir, "supplier"), "supplier_id")
    return P.mode_with_count(rows, "customer_id", "region")


@query(f"""WITH {CONTRACTS} SELECT item_id, count(*) AS offer_count, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(amount) AS avg_price, min(amount) AS min_price,
first(supplier_id ORDER BY amount, contract_id, line, supplier_id) AS supplier_id, max(day) AS last_day FROM contracts GROUP BY item_id""")
def item_offer_lookup(spark, sf_dir):
    return P.offers(contracts(spark, sf_dir))


@query(f"""WITH {CONTRACTS}, s AS (SELECT customer_id, item_id, count(*) AS n, sum(amount) AS t FROM contracts GROUP BY ALL)
SELECT item_id, CAST(sum(n) AS BIGINT) AS offer_count, CAST(sum(CAST(t AS DECIMAL(18,2))) AS DOUBLE) / sum(n) AS avg_price FROM s GROUP BY item_id""")
def estimated_offers(spark, sf_dir):
    return P.estimated_offers(P.purchase_stats(contracts(spark, sf_dir), "customer_id", "item_id"))


@query(f"""WITH {CATALOG}, c AS (SELECT DISTINCT category FROM catalog WHERE category <> 'UNKNOWN')
SELECT CAST(row_number() OVER (ORDER BY category) AS INTEGER) AS category_id, category FROM c UNION ALL SELECT 0, 'UNKNOWN'""")
def category_dictionary(spark, sf_dir):
    return P.category_dictionary(catalog(spark, sf_dir))


@query(f"""WITH {CATALOG} SELECT name, first(category ORDER BY length(category) DESC, category DESC) AS category,
first(attributes ORDER BY length(attributes) DESC, attributes DESC) AS attributes, max(attribute_count) AS attribute_count FROM catalog GROUP BY name""")
def catalog_longest_values(spark, sf_dir):
    return P.longest_values(catalog(spark, sf_dir), "name", "category", "attributes", most="attribute_count")


@query(f"""WITH {CONTRACTS}, s AS (SELECT customer_id, item_id, {STATS} FROM contracts GROUP BY ALL) SELECT * FROM s""")
def incremental_merge(spark, sf_dir):
    """Stats of two halves merged are those of the whole."""
    lines = contracts(spark, sf_dir)
    half = F.col("day") < F.lit("1998-01-01").cast("date")
    keys = ("customer_id", "item_id")
    return rounded(P.merge_stats(P.purchase_stats(lines.where(half), *keys), P.purchase_stats(lines.where(~half), *keys), *keys))


CATEGORY_STATS = f"{CONTRACTS}, {CATALOG}, s AS (SELECT customer_id, category, count(*) AS purchase_count, sum(amount) AS total_amount FROM contracts JOIN catalog USING (item_id) GROUP BY ALL)"


@query(f"""WITH {CATEGORY_STATS}, r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY purchase_count DESC, total_amount DESC, category) AS rk FROM s)
SELECT customer_id, category, purchase_count, round(total_amount, 2) AS total_amount, CAST(rk AS INTEGER) AS rank,
round(0.55e0 * purchase_count / max(purchase_count) OVER (PARTITION BY customer_id) + 0.25e0 * ln(1 + total_amount) / max(ln(1 + total_amount)) OVER (PARTITION BY customer_id) + 0.20e0 / rk, 4) AS weight FROM r""")
def customer_top_categories(spark, sf_dir):
    stats = P.purchase_stats(P.with_category(contracts(spark, sf_dir), catalog(spark, sf_dir)), "customer_id", "category")
    out = P.category_weights(stats, ["customer_id"]).drop("first_day", "last_day")
    return rounded(rounded(out), 4, "weight")


@query(f"""WITH {CONTRACTS}, s AS (SELECT customer_id, item_id, count(*) AS purchase_count, sum(amount) AS total_amount FROM contracts GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY purchase_count DESC, total_amount DESC, item_id) AS rk,
max(purchase_count) OVER (PARTITION BY customer_id) AS mc, max(ln(1 + total_amount)) OVER (PARTITION BY customer_id) AS ml FROM s)
SELECT customer_id, item_id, CAST(rk AS INTEGER) AS rank, round(0.60e0 * purchase_count / mc + 0.25e0 * ln(1 + total_amount) / ml + 0.15e0 / rk, 4) AS weight FROM r WHERE rk <= 20""")
def customer_top_items(spark, sf_dir):
    """Twenty items a customer: the limit is the feature."""
    out = P.item_weights(P.purchase_stats(contracts(spark, sf_dir), "customer_id", "item_id"), ["customer_id"]).where("rank <= 20")
    return rounded(out.select("customer_id", "item_id", "rank", "weight"), 4, "weight")


@query(f"""WITH {CONTRACTS}, s AS (SELECT customer_id, item_id, count(*) AS n, sum(amount) AS t FROM contracts GROUP BY ALL)
SELECT item_id, CAST(sum(n) AS BIGINT) AS purchase_count, CAST(sum(CAST(t AS DECIMAL(18,2))) AS DOUBLE) AS total_amount, CAST(sum(CAST(t AS DECIMAL(18,2))) AS DOUBLE) / sum(n) AS avg_amount FROM s GROUP BY item_id""")
def global_item_stats(spark, sf_dir):
    stats = P.purchase_stats(contracts(spark, sf_dir), "customer_id", "item_id").groupBy("item_id").agg(F.sum("purchase_count").alias("purchase_count"), P.money("total_amount").alias("total_amount"))
    return stats.withColumn("avg_amount", F.col("total_amount") / F.col("purchase_count"))


@query(f"WITH {CATEGORY_STATS} SELECT category, CAST(sum(purchase_count) AS BIGINT) AS popularity FROM s GROUP BY category")
def category_popularity(spark, sf_dir):
    stats = P.purchase_stats(P.with_category(contracts(spark, sf_dir), catalog(spark, sf_dir)), "customer_id", "category")
    return stats.groupBy("category").agg(F.sum("purchase_count").alias("popularity"))


@query(f"""WITH {CONTRACTS}, s AS (SELECT customer_id, item_id, count(*) AS n, max(day) AS last_day FROM contracts GROUP BY ALL)
SELECT item_id, CAST(sum(n) AS BIGINT) AS popularity, CAST(coalesce(sum(n) FILTER (last_day >= DATE '{TODAY}' - 90), 0) AS BIGINT) AS recent,
CAST(coalesce(sum(n) FILTER (month(last_day) = 8), 0) AS BIGINT) AS seasonal FROM s GROUP BY item_id""")
def popularity_recent_seasonal(spark, sf_dir):
    return P.popularity(P.purchase_stats(contracts(spark, sf_dir), "customer_id", "item_id"), "item_id", 90, 8, TODAY)


@query(f"WITH {CONTRACTS}, {CATALOG}, {CUSTOMER_REGIONS} SELECT region, item_id, category, count(*) AS popularity FROM contracts JOIN catalog USING (item_id) JOIN customer_regions USING (customer_id) GROUP BY ALL")
def regional_popularity(spark, sf_dir):
    lines = P.with_category(contracts(spark, sf_dir), catalog(spark, sf_dir)).join(regions(spark, sf_dir, "customer"), "customer_id")
    return lines.groupBy("region", "item_id", "category").agg(F.count("*").alias("popularity"))


@query(f"""WITH {CONTRACTS}, {CATALOG}, o AS (SELECT item_id, min(amount) AS proxy FROM contracts GROUP BY item_id HAVING min(amount) > 0)
SELECT category, round(quantile_cont(proxy, 0.25), 4) AS p25, round(quantile_cont(proxy, 0.75), 4) AS p75 FROM o JOIN catalog USING (item_id) GROUP BY category""")
def category_price_bands(spark, sf_dir):
    lines = contracts(spark, sf_dir)
    return rounded(P.price_bands(P.purchase_stats(lines, "customer_id", "item_id"), P.offers(lines), catalog(spark, sf_dir)), 4, "p25", "p75")


@query(f"""WITH {CONTRACTS}, {CATALOG} SELECT DISTINCT item_id, 'not_in_catalog' AS kind FROM contracts WHERE item_id NOT IN (SELECT item_id FROM catalog)
UNION ALL SELECT DISTINCT item_id, 'never_bought' FROM catalog WHERE item_id NOT IN (SELECT item_id FROM contracts)""")
def catalog_orphans(spark, sf_dir):
    return P.orphans(contracts(spark, sf_dir), catalog(spark, sf_dir))


PEERS = f"""{CATEGORY_STATS}, top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY purchase_count DESC, total_amount DESC, category) <= 2),
p AS (SELECT top.customer_id, s.customer_id AS peer_id, count(DISTINCT s.category) AS shared, CAST(sum(s.purchase_count) AS BIGINT) AS purchases FROM top JOIN s ON top.category = s.category AND top.customer_id <> s.customer_id GROUP BY ALL),
q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY shared DESC, purchases DESC, peer_id) <= 120)"""


def peer_lists(spark, sf_dir):
    return P.overlap_peers(P.purchase_stats(P.with_category(contracts(spark, sf_dir), catalog(spark, sf_dir)), "customer_id", "category"), top=2, rows=line_count(spark, sf_dir))


@query(f"WITH {PEERS} SELECT * FROM q")
def same_type_peers(spark, sf_dir):
    """A hundred and twenty peers of every customer: the limit is the feature."""
    people, lists = peer_lists(spark, sf_dir)
    return people.join(lists, "list").select("customer_id", "peer_id", "shared", "purchases")


@query(f"""WITH {PEERS}, i AS (SELECT p.customer_id, c.item_id, count(*) AS purchase_count, sum(c.amount) AS total_amount FROM q AS p JOIN contracts c ON p.peer_id = c.customer_id GROUP BY ALL)
SELECT customer_id, item_id, purchase_count, round(total_amount, 2) AS total_amount FROM i QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY purchase_count DESC, total_amount DESC, item_id) <= 20""")
def peer_recommendations(spark, sf_dir):
    """Twenty items that every customer's peers buy most, summed once a list of peers: the limit is the feature."""
    people, lists = peer_lists(spark, sf_dir)
    asked = P.few(lists.select(F.col("peer_id").alias("customer_id")).distinct())
    stats = P.purchase_stats(contracts(spark, sf_dir).join(asked, "customer_id", "left_semi"), "customer_id", "item_id").select(F.col("customer_id").alias("peer_id"), "item_id", "purchase_count", "total_amount")
    sums = stats.join(lists, "peer_id").groupBy("list", "item_id").agg(F.sum("purchase_count").alias("purchase_count"), P.money("total_amount").alias("total_amount"))
    out = P.item_weights(sums, ["list"]).where("rank <= 20").drop("rank", "weight")
    return rounded(people.join(out, "list").select("customer_id", "item_id", "purchase_count", "total_amount"))


@query(f"""WITH {CONTRACTS}, r AS (SELECT item_id, count(*) AS n, 0 AS source FROM contracts WHERE supplier_id % 2 = 0 GROUP BY item_id HAVING count(*) >= 5 UNION ALL SELECT item_id, count(*), 1 FROM contracts GROUP BY item_id)
SELECT item_id, n, CAST(source AS INTEGER) AS source FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY source) = 1""")
def fallback_union(spark, sf_dir):
    """Counts of a preferred part of the market, with all of it for products that the part lacks."""
    lines = contracts(spark, sf_dir)
    count = lambda df: df.groupBy("item_id").agg(F.count("*").alias("n"))
    return P.ordered_union([count(lines.where("supplier_id % 2 = 0")).where("n >= 5"), count(lines)], "item_id")


@query("""SELECT n_nationkey AS nation_id, n_name AS nation, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def stats_with_lookup(spark, sf_dir):
    """A lookup table kept whole by a left join."""
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    out = table(spark, sf_dir, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation"), F.coalesce("customers", F.lit(0)).alias("customers"))

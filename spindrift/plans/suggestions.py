"""Queries of suggestions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.operators import suggest as S
from spindrift.operators.shared import shared_path, spread, written
from spindrift.plans.base import CATALOG, CONTRACTS, catalog, contracts, line_count, query, table

PREFIXES = f"""names AS (SELECT p_partkey AS item_id, p_name AS name, p_type AS category FROM part),
prefixes AS (SELECT left(name, n) AS prefix, item_id, name, category, CAST(row_number() OVER (PARTITION BY left(name, n) ORDER BY length(name), name, item_id) AS INTEGER) AS place FROM names, (VALUES (2), (3), (4)) AS e(n) WHERE length(name) >= n QUALIFY place <= 120)"""
ALL_PREFIXES = "prefixes AS (SELECT left(p_name, n) AS prefix, p_partkey AS item_id, p_name AS name, p_type AS category FROM part, (VALUES (2), (3), (4)) AS e(n) WHERE length(p_name) >= n)"


@query(f"WITH {PREFIXES} SELECT * FROM prefixes")
def prefix_top(spark, sf_dir):
    """Of each prefix of two to four characters the 120 products of shortest name, as a stored table: the limit is the feature."""
    path = shared_path(spark, "prefixes")
    S.prefix_table(catalog(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


def people(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("type"))


def asked_prefixes(spark, sf_dir):
    """Every customer asks for the first letters of a product's name; every seventh for something longer."""
    names = catalog(spark, sf_dir).where("item_id BETWEEN -99 AND 99").select(F.col("item_id").alias("of"), "name")
    rows = people(spark, sf_dir).withColumn("of", F.col("customer_id") % 100).join(F.broadcast(names), "of")
    size = F.when(F.col("customer_id") % 7 == 0, 9).otherwise(2 + F.col("customer_id") % 3).cast("int")
    return rows.select("customer_id", F.substr("name", F.lit(1), size).alias("query"))


def inputs(spark, sf_dir):
    """(purchases, typical: the category most bought by a type, preferred: each customer's categories by share, recommended: items bought before)."""
    lines = written(contracts(spark, sf_dir).join(catalog(spark, sf_dir).select("item_id", "category", "name"), "item_id").select("customer_id", "item_id", "category", "name"), "purchases")
    here = spread(lines, line_count(spark, sf_dir), "customer_id")
    counts = lines.join(people(spark, sf_dir), "customer_id").groupBy("type", "category").agg(F.count("*").alias("n"))
    typical = counts.withColumn("place", F.row_number().over(W.partitionBy("type").orderBy(F.desc("n"), "category"))).where("place = 1").select("type", "category")
    mine = here.groupBy("customer_id", "category").agg(F.count("*").alias("n"))
    preferred = mine.select("customer_id", "category", (F.col("n") / F.max("n").over(W.partitionBy("customer_id"))).alias("weight")).where("weight >= 0.5")
    return lines, typical, preferred, lines.groupBy("customer_id", "item_id").agg(F.count("*").cast("double").alias("weight"))


def of_type(spark, sf_dir, lines, typical, preferred, recommended):
    return S.same_type_prefix(asked_prefixes(spark, sf_dir), S.prefixes(catalog(spark, sf_dir)), people(spark, sf_dir), lines, typical, preferred, recommended)


@query(f"""WITH {CONTRACTS}, {CATALOG}, {ALL_PREFIXES}, l AS (SELECT c.*, k.category, c_mktsegment AS type FROM contracts c JOIN catalog k USING (item_id) JOIN customer ON c_custkey = customer_id),
q AS (SELECT c_custkey AS customer_id, c_mktsegment AS type, left(p_name, CAST(CASE c_custkey % 7 WHEN 0 THEN 9 ELSE 2 + c_custkey % 3 END AS INTEGER)) AS query FROM customer JOIN part ON p_partkey = c_custkey % 100),
t AS (SELECT type, category FROM l GROUP BY type, category QUALIFY row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, category) = 1),
ti AS (SELECT type, item_id, count(*) AS c FROM l GROUP BY ALL), oi AS (SELECT customer_id, item_id, count(*) AS own FROM l GROUP BY ALL), al AS (SELECT item_id, count(*) AS total FROM l GROUP BY ALL),
oc AS (SELECT customer_id, category, count(*) / max(count(*)) OVER (PARTITION BY customer_id) AS weight FROM l GROUP BY customer_id, category),
m AS (SELECT q.*, p.item_id, p.name, p.category, coalesce(c, 0) - coalesce(own, 0) AS peers, coalesce(own, 0) AS own, coalesce(total, 0) AS total, t.type IS NOT NULL AS usual, CASE WHEN weight >= 0.5 THEN weight ELSE 0e0 END AS weight
  FROM (SELECT *, rtrim(query) AS norm FROM q) AS q JOIN prefixes p ON p.prefix = q.norm LEFT JOIN ti ON ti.type = q.type AND ti.item_id = p.item_id LEFT JOIN oi ON oi.customer_id = q.customer_id AND oi.item_id = p.item_id LEFT JOIN al ON al.item_id = p.item_id
  LEFT JOIN t ON t.type = q.type AND t.category = p.category LEFT JOIN oc ON oc.customer_id = q.customer_id AND oc.category = p.category WHERE length(norm) BETWEEN 2 AND 4 AND NOT contains(norm, ' ')),
n AS (SELECT *, CASE WHEN max(peers) OVER (PARTITION BY customer_id) > 0 THEN peers WHEN usual THEN total - own ELSE 0 END AS n FROM m),
s AS (SELECT *, n / greatest(n, total) AS part, CASE WHEN usual THEN 12e0 ELSE least(10e0, 1.8e0 * weight) END AS liked FROM n WHERE n > 0),
r AS (SELECT *, round(0.06e0 * CASE WHEN length(norm) > 2 THEN 180 ELSE 120 END + least(14e0, 2.5e0 * ln(1 + n)) + 18e0 * part + liked + least(6, own) - CASE WHEN liked > 0 THEN 0 ELSE 10 END, 4) AS score FROM s WHERE liked > 0 OR (part >= 0.45 AND n >= 3))
SELECT customer_id, query, item_id, name, CAST(n AS BIGINT) AS count, score, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, n DESC, name DESC, item_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 30""")
def same_type_suggestions(spark, sf_dir):
    """For every customer's short query the thirty best products of their type, among all that begin like it: the limit is the feature."""
    return of_type(spark, sf_dir, *inputs(spark, sf_dir))


@query()
def suggestion_groups(spark, sf_dir):
    """Five suggestions a customer from their products, those of their type and their categories, merged in turn: the limit is the feature."""
    asked = asked_prefixes(spark, sf_dir)
    lines, typical, preferred, recommended = inputs(spark, sf_dir)
    mine = spread(lines, line_count(spark, sf_dir), "customer_id").groupBy("customer_id", "item_id", "name").agg(F.count("*").alias("count")).join(asked, "customer_id")
    products = mine.select(F.col("customer_id").alias("asked"), "query", "name", "count", F.lit(None).cast("double").alias("score"))
    typed = of_type(spark, sf_dir, lines, typical, preferred, recommended).select(F.col("customer_id").alias("asked"), "query", "name", "count", "score")
    categories = preferred.join(asked, "customer_id").select(F.col("customer_id").alias("asked"), "query", "category")
    queries = asked.select(F.col("customer_id").alias("asked"), F.col("query").alias("normalized"), F.col("query").alias("corrected_query"), F.array().cast("array<string>").alias("synonyms"))
    return S.suggested(products, typed, categories, queries)

"""Queries of reranking by history and session."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import purchases as P
from spindrift.operators import rerank as R
from spindrift.plans.base import CATALOG, CONTRACTS, catalog, contracts, line_count, query, table

HISTORY = f"""{CONTRACTS}, {CATALOG}, l AS (SELECT c.*, category FROM contracts c JOIN catalog USING (item_id)),
si AS (SELECT customer_id, item_id, count(*) AS n, sum(CAST(amount AS DECIMAL(18,2)))::DOUBLE AS t FROM l GROUP BY ALL),
ri AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, t DESC, item_id) AS rk FROM si),
wi AS (SELECT customer_id, item_id, round(0.60e0 * n / max(n) OVER w + 0.25e0 * ln(1 + t) / max(ln(1 + t)) OVER w + 0.15e0 / rk, 4) AS history FROM ri WINDOW w AS (PARTITION BY customer_id)),
sc AS (SELECT customer_id, category, count(*) AS n, sum(CAST(amount AS DECIMAL(18,2)))::DOUBLE AS t FROM l GROUP BY ALL),
rc AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, t DESC, category) AS rk FROM sc),
wc AS (SELECT customer_id, category, rk, 0.55e0 * n / max(n) OVER w + 0.25e0 * ln(1 + t) / max(ln(1 + t)) OVER w + 0.20e0 / rk AS weight FROM rc WINDOW w AS (PARTITION BY customer_id)),
top AS (SELECT customer_id, category, round(weight, 4) AS affinity FROM wc WHERE rk <= 3),
ev AS (SELECT user_id AS customer_id, event_type AS kind, p_partkey AS item_id, p_type AS category FROM events JOIN part ON CAST(p_partkey AS VARCHAR) = json_extract_string(props, '$.k')),
session AS (SELECT x.customer_id, x.item_id, least(1.5e0, 0.45e0 * bool_or(kind = 'click' AND ev.item_id = x.item_id)::INT + 0.75e0 * bool_or(kind = 'signup' AND ev.item_id = x.item_id)::INT + 0.35e0 * bool_or(kind = 'purchase' AND ev.category = x.category)::INT) AS boost
  FROM (SELECT DISTINCT customer_id, item_id, category FROM l) AS x JOIN ev USING (customer_id) GROUP BY ALL)"""
KNOWN = "coalesce(history, 0e0) AS history, coalesce(affinity, 0e0) AS affinity, coalesce(boost, 0e0) AS session"
JOINED = "LEFT JOIN wi USING (customer_id, item_id) LEFT JOIN top USING (customer_id, category) LEFT JOIN session USING (customer_id, item_id)"


def said_sql(rules, otherwise: str) -> str:
    parts = ", ".join(f"CASE WHEN {name} >= {least} THEN '{text}' END" for name, least, text in rules)
    return f"coalesce(nullif(concat_ws('; ', {parts}), ''), '{otherwise}')"


def bought(spark, sf_dir, *keys):
    """Every customer's products, by further keys, with history, affinity and session."""
    lines = P.with_category(contracts(spark, sf_dir), catalog(spark, sf_dir))
    categories = catalog(spark, sf_dir).select(F.coalesce("category", F.lit("UNKNOWN")).alias("category")).union(spark.range(1).select(F.lit("UNKNOWN"))).distinct()
    of = table(spark, sf_dir, "events").select(F.col("user_id").alias("customer_id"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("item"))
    of = of.join(catalog(spark, sf_dir).select(F.col("item_id").cast("string").alias("item"), "category"), "item")
    held = lambda kind, c: F.collect_set(F.when(F.col("kind") == kind, F.col(c)))
    sessions = of.groupBy("customer_id").agg(held("click", "item").alias("clicked"), held("signup", "item").alias("cart"), held("purchase", "category").alias("recent"))
    return R.bought(lines, categories, sessions, line_count(spark, sf_dir), *keys)


@query(f"""WITH {HISTORY}, r AS (SELECT DISTINCT customer_id, item_id, category, p_size / 10e0 AS search_score FROM l JOIN part ON p_partkey = item_id),
k AS (SELECT r.*, {KNOWN} FROM r {JOINED}), f AS (SELECT *, round(search_score + 5 * history + 3 * affinity + 4 * session, 4) AS final_score FROM k)
SELECT customer_id, item_id, final_score, {said_sql(R.SAID_OF_RESULT, R.ELSE_OF_RESULT)} AS explanation, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY final_score DESC, history DESC, affinity DESC, search_score DESC, item_id) AS INTEGER) AS rank FROM f""")
def reranked_products(spark, sf_dir):
    """Every customer's products, found in order of their size, ranked anew by history and session."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), (F.col("p_size") / 10.0).alias("search_score"))
    return R.ranked_products(bought(spark, sf_dir).join(sizes, "item_id")).select("customer_id", "item_id", "final_score", F.array_join("explanation", "; ").alias("explanation"), "rank")


@query(f"""WITH {HISTORY}, r AS (SELECT customer_id, item_id, category, supplier_id, min(amount) AS unit_price, max(CAST(amount AS DOUBLE)) / 1e5 AS offer_score FROM l GROUP BY ALL),
b AS (SELECT *, CASE WHEN unit_price > 0 THEN greatest(0e0, 1 - unit_price / max(unit_price) OVER (PARTITION BY customer_id)) ELSE 0e0 END AS bonus FROM r),
k AS (SELECT b.*, {KNOWN} FROM b {JOINED}), f AS (SELECT *, round(offer_score + 4 * history + 3 * affinity + 3 * session + 1.5 * bonus, 4) AS final_score FROM k)
SELECT customer_id, item_id, supplier_id, final_score, {said_sql(R.SAID_OF_OFFER, R.ELSE_OF_OFFER)} AS explanation FROM f""")
def reranked_offers(spark, sf_dir):
    """The offers of every customer's products by supplier, with a bonus for low prices."""
    offers = bought(spark, sf_dir, "supplier_id").withColumns({"unit_price": F.col("least"), "offer_score": F.col("most") / 1e5, "offer_id": F.concat_ws("-", "item_id", "supplier_id")})
    out = R.ranked_offers(offers)
    return out.select("customer_id", "item_id", "supplier_id", "final_score", F.array_join("explanation", "; ").alias("explanation"))

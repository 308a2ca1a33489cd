"""Personalisation: archetypes, blended recommendations, session and history adjustments, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import numbers as N
from spindrift.functions import text as T

# Weights of the sources of a recommendation by archetype, for categories and for items.
CATEGORY_BLEND = {
    "healthcare": (4.9, 2.7, 0.0, 1.9, 0.12), "education": (4.5, 2.5, 0.0, 1.7, 0.12), "office_admin": (4.1, 1.9, 0.0, 1.4, 0.10),
    "facilities": (4.0, 1.8, 0.0, 1.4, 0.10), "security_it": (4.7, 2.4, 0.0, 1.8, 0.11), "general": (4.3, 2.1, 0.0, 0.0, 0.10),
}
ITEM_BLEND = {
    "healthcare": (5.2, 2.6, 0.0, 1.8, 0.10), "education": (4.8, 2.4, 0.0, 1.6, 0.10), "office_admin": (4.4, 1.8, 0.0, 1.3, 0.09),
    "facilities": (4.3, 1.8, 0.0, 1.3, 0.09), "security_it": (4.9, 2.3, 0.0, 1.7, 0.09), "general": (4.6, 2.0, 0.0, 0.0, 0.09),
}
SOURCES = ("institution", "peer", "region", "archetype")
# Keywords of the archetypes, in order of preference.
KEYWORDS = {
    "healthcare": ("медицинские", "препарат", "лекарственные", "дезинфицирующие", "санитарно-противоэпидемические", "иммунодепрессанты", "анальгетики", "фармацевтические", "шприцы", "инсулин"),
    "education": ("обучение", "квалификация", "образование", "учебные", "школьные", "учитель", "педагогические", "воспитание"),
    "office_admin": ("канцелярские", "бумага", "ручки", "папки", "файлы", "маркеры", "карандаши", "степлеры", "скрепки", "картриджи", "принтеров", "мфу", "документообороту"),
    "facilities": ("уборочный", "мешки", "бумажные", "туалетная", "мыло", "уборки", "отходами", "ремонту", "строительные", "полотенца", "ветошь"),
    "security_it": ("пожарной", "безопасности", "охраны", "охранный", "информационной", "техническое", "мониторинг", "технологического", "оборудования", "сертификации"),
}


def archetypes(preferences: DataFrame, keywords: dict[str, tuple[str, ...]] = KEYWORDS, least: float = 0.75, top: int = 8) -> DataFrame:
    """customer_id, archetype, score from the weighted categories (customer_id, category, weight, purchase_count, rank).

    The keywords are a fixed list of a few dozen, held as literals.
    """
    stems = T.stem_tokens(T.tokenize(F.col("category")))
    strength = F.col("weight") + F.least(F.col("purchase_count") / 40.0, F.lit(2.0))
    meets = lambda words: T.stems_meet(stems, T.stem_tokens(T.tokenize(F.lit(" ".join(words)))))
    sums = [F.sum(F.when(meets(words), strength).otherwise(0.0)).alias(name) for name, words in keywords.items()]
    scored = preferences.where(F.col("rank") <= top).groupBy("customer_id").agg(*sums)
    best = F.greatest(*[F.col(n) for n in keywords]) if len(keywords) > 1 else F.col(next(iter(keywords)))
    name = reduce(lambda out, n: F.when(F.col(n) == best, n).otherwise(out), reversed(list(keywords)), F.lit("general"))
    return scored.select("customer_id", F.when(best < least, "general").otherwise(name).alias("archetype"), best.alias("score"))


def blended(parts: dict[str, DataFrame], archetype: Column, key: str, weights: dict = ITEM_BLEND, limit: int = 20) -> DataFrame:
    """customer_id, key, score, rank: what several sources (customer_id, key, weight, purchase_count) recommend, merged.

    Each source counts with its largest weight, times the archetype's factor; sources that agree add a little.
    """
    rows = reduce(DataFrame.unionByName, [p.select("customer_id", key, "weight", "purchase_count").withColumn("source", F.lit(s)) for s, p in parts.items()])
    most = [F.coalesce(F.max(F.when(F.col("source") == s, F.col("weight"))), F.lit(0.0)).alias(s) for s in SOURCES]
    held = rows.groupBy("customer_id", key).agg(*most, F.max("purchase_count").alias("purchase_count")).withColumn("archetype_name", archetype)
    factor = lambda i: reduce(lambda out, kv: F.when(F.col("archetype_name") == kv[0], kv[1][i]).otherwise(out), weights.items(), F.lit(weights["general"][i]))
    agree = sum((F.col(s) > 0).cast("int") for s in ("institution", "peer", "archetype"))
    total = reduce(lambda a, b: a + b, [factor(i) * F.col(s) for i, s in enumerate(SOURCES)]) + factor(4) * agree
    order = W.partitionBy("customer_id").orderBy(F.desc("score"), *[F.desc(s) for s in SOURCES], F.desc("purchase_count"), key)
    ranked = held.withColumn("score", F.round(total, 4)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit).select("customer_id", key, *SOURCES, "score", "rank")


def profile_reliability(category_stats: DataFrame) -> DataFrame:
    """customer_id, reliability: enough purchases, and concentrated ones."""
    total = F.sum("purchase_count").over(W.partitionBy("customer_id"))
    held = category_stats.withColumns({"share": F.col("purchase_count") / total, "total": total})
    out = held.groupBy("customer_id").agg(F.max("total").alias("total"), F.max("share").alias("dominant"), F.sum(F.col("share") * F.col("share")).alias("spread"))
    value = F.least(F.lit(1.0), F.col("total") / 8.0) * (0.15 + 0.85 * F.greatest("dominant", "spread"))
    return out.select("customer_id", "total", F.least(F.lit(1.0), value).alias("reliability"))


def history_priority(c: dict[str, Column], quality: Column) -> Column:
    """How far a candidate's own history lifts it: item, category and supplier signals with recency, times the match quality; 0 for poor matches."""
    total = F.greatest(F.lit(1), c["user_total"])
    item, category, supplier = N.history_signal(c["user_item"], total, 0.08, 2), N.history_signal(c["user_category"], total, 0.25, 4), N.history_signal(c["user_supplier"], total, 0.20, 3)
    recent = lambda days, a, b: F.when(days <= 30, a).when(days <= 180, b).otherwise(0.0)
    value = item * (36.0 + recent(c["item_recency"], 8.0, 4.0)) + category * (18.0 + recent(c["category_recency"], 5.0, 2.5)) + 8.0 * supplier
    return F.when(quality < 0.20, F.lit(0.0)).otherwise(value * F.least(F.lit(1.0), quality))


def session_adjustment(item: Column, category: Column, clicked: Column, cart: Column, recent: Column, bounced: Column) -> tuple[Column, Column, Column]:
    """(score, reason codes, priority tier) that a session gives a candidate."""
    cases = [("SESSION_CLICK_BOOST", F.array_contains(clicked, item), 12.0), ("SESSION_CART_BOOST", F.array_contains(cart, item), 35.0), ("SESSION_CATEGORY_BOOST", F.array_contains(recent, category), 1.5), ("SESSION_BOUNCE_PENALTY", F.array_contains(bounced, category), -10.0)]
    score = reduce(lambda a, b: a + b, [F.when(cond, w).otherwise(0.0) for _, cond, w in cases])
    codes = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond, _ in cases]), lambda x: x.isNotNull())
    tier = F.when(F.array_contains(codes, "SESSION_CART_BOOST"), 100.0).when(F.array_contains(codes, "SESSION_CLICK_BOOST"), 60.0).when(F.array_contains(codes, "SESSION_CATEGORY_BOOST"), 15.0).otherwise(0.0)
    return score, codes, tier


def rerank_candidates(candidates: DataFrame, query: str) -> DataFrame:
    """Final scores of candidates (query_id, item_id, search_score, quality, rule, history, reliability, alignment).

    The query's narrowness, the profile's reliability and how the history fits decide how far personalisation may move a candidate; the session decides the tier.
    """
    own = W.partitionBy(query)
    c = candidates.withColumn("best", F.max("quality").over(own))
    gate = N.match_gate(F.col("quality"), F.col("best"), F.col("specificity"))
    ambiguity = F.greatest(F.lit(0.30), 1 - 0.70 * F.col("specificity"))
    weight = F.least(F.lit(1.0), F.pow("reliability", F.lit(1.15)) * ambiguity * (0.15 + 0.85 * F.col("alignment")))
    cap = 0.5 + 3.8 * weight
    cap = F.when(F.col("specificity") >= 0.70, F.least(cap, 1.1 + 0.9 * F.col("alignment"))).otherwise(cap)
    factor = 0.03 + 0.03 * F.greatest(F.lit(0.0), 1 - F.col("specificity"))
    final = F.col("search_score") + 0.35 * F.col("rule") * weight * F.greatest(F.lit(0.2), F.col("quality")) * (gate > 0).cast("double") + F.least(cap, F.col("history") * factor)
    out = c.withColumns({"gate": gate, "history_weight": weight, "final_score": final})
    order = own.orderBy(F.desc("session_tier"), F.desc(F.round("final_score", 6)), F.desc("search_score"), "item_id")
    return out.withColumn("rank", F.row_number().over(order))


def offer_bonus(price: Column, partition: list[str]) -> Column:
    """1 for free, 0 for the dearest of the partition."""
    most = F.max(price).over(W.partitionBy(*partition))
    return F.when(most > 0, 1 - price / most).otherwise(F.lit(0.0))

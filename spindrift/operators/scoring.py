"""Lexical features and scores of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T

# The weights of the retrieval score.
WEIGHTS = {"exact_phrase": 12.0, "full_name_cover": 4.0, "full_category_cover": 6.0, "corrected_overlap": 6.0, "name_overlap": 4.0, "category_overlap": 3.0, "key_overlap": 2.0,
           "semantic_name_overlap": 1.75, "semantic_category_overlap": 1.25, "semantic_key_overlap": 1.0, "synonym_bonus": 1.5, "sentence_similarity": 3.0, "dense_similarity": 3.5, "bm25": 2.0}


def lexical_features(rows: DataFrame, query: Column, stemmed: bool = True) -> DataFrame:
    """rows (name, category, attributes) with the features of one query's tokens against them."""
    shape = T.stem_tokens if stemmed else (lambda x: x)
    name, category, keys = (T.tokenize(F.col(c)) for c in ("name", "category", "attributes"))
    n, c, k, q = (shape(x) for x in (name, category, keys, query))
    phrase = F.contains(F.array_join(name, " "), F.array_join(query, " ")) & (F.size(query) > 0)
    covers = lambda s: ((F.size(q) > 0) & (F.size(F.array_except(q, s)) == 0)).cast("double")
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_distinct(a)))
    return rows.withColumns({
        "exact_phrase": phrase.cast("double"), "full_name_cover": covers(n), "full_category_cover": covers(c),
        "corrected_overlap": share(query, name), "name_overlap": share(q, n), "category_overlap": share(q, c), "key_overlap": share(q, k),
    })


def lexical_score(extra: dict[str, Column] | None = None) -> Column:
    """The weighted sum of the lexical features, and of others given by name."""
    own = ("exact_phrase", "full_name_cover", "full_category_cover", "corrected_overlap", "name_overlap", "category_overlap", "key_overlap")
    parts = [WEIGHTS[c] * F.col(c) for c in own] + [WEIGHTS[c] * v for c, v in (extra or {}).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def passes(semantic: Column, least: Column) -> Column:
    """Whether a candidate passes the least score: by meaning, by an exact match, or by a blend of overlaps."""
    exact = F.greatest("exact_phrase", "full_name_cover", "full_category_cover", "corrected_overlap")
    blend = F.greatest(exact, 0.45 * F.col("corrected_overlap") + 0.25 * F.col("name_overlap") + 0.15 * F.col("category_overlap") + 0.15 * F.col("key_overlap"))
    return (semantic >= least) | (exact >= 1) | (blend >= F.greatest(F.lit(0.52), 0.95 * least))


def attribute_score(asked: Column, found: Column, tokens: Column) -> Column:
    """+5 for an asked (value, unit), -3 for another value of the unit, +2 for the bare value among the tokens; at least -6."""
    of = lambda a: F.when(F.array_contains(found, a), 5.0).otherwise(
        F.when(F.exists(found, lambda f: f["unit"] == a["unit"]), -3.0).otherwise(F.lit(0.0)) + F.when(F.array_contains(tokens, a["value"]), 2.0).otherwise(F.lit(0.0))
    )
    return F.greatest(F.lit(-6.0), F.aggregate(F.transform(asked, of), F.lit(0.0), lambda s, v: s + v))


def sentence_similarity(a: Column, b: Column) -> Column:
    """The greater of token and damped character similarity of two token arrays."""
    grams = lambda x: T.char_ngrams(F.array_join(x, " "))
    return F.greatest(T.jaccard(a, b), 0.75 * T.jaccard(grams(a), grams(b)))

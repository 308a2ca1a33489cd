"""Column builders for numbers, dates, maps and session arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_DAYS = 3650


def lenient_double(c: Column) -> Column:
    """A number with comma or point; 0 if it is none."""
    return F.coalesce(F.translate(F.trim(c), ",", ".").try_cast("double"), F.lit(0.0))


def lenient_date(c: Column) -> Column:
    """The first format that fits, else the first ten characters, else null."""
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy", "yyyy-MM-dd")
    tried = [F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats]
    return F.coalesce(*tried, F.substr(c, F.lit(1), F.lit(10)).try_cast("date"))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def recency_days(last: Column, today: Column) -> Column:
    """Days since, at least 0; a fixed large number if never."""
    return F.when(last.isNull(), MISSING_DAYS).otherwise(F.greatest(F.lit(0), F.datediff(today, last))).cast("double")


def recency_boost(days: Column, horizon: float) -> Column:
    return F.when(days >= MISSING_DAYS, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - days / horizon))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def idf(frequency: Column, documents: Column) -> Column:
    return 1 + F.log1p(documents / F.greatest(F.lit(1), frequency))


def cart_multiplier(n: Column, most: float = 0.15) -> Column:
    """1 for none, towards 1 + most for many."""
    return F.when(n > 0, 1 + most * (1 - F.exp(-n.cast("double")))).otherwise(F.lit(1.0))


def skip_multiplier(n: Column, least: float = 0.4, step: float = 0.2) -> Column:
    return F.when(n > 0, F.greatest(F.lit(least), 1 - step * F.log2(1 + n.cast("double")))).otherwise(F.lit(1.0))


def history_signal(count: Column, total: Column, share: float, support: int) -> Column:
    """How much history speaks: enough purchases, and enough of all."""
    strength = F.least(F.lit(1.0), count / float(support)) * F.least(F.lit(1.0), (count / total) / share)
    return F.when((count > 0) & (total > 0), strength).otherwise(F.lit(0.0))


def query_specificity(text: Column, tokens: Column) -> Column:
    """How narrowly a normalised query (with its tokens) asks, from 0 to 1."""
    words = F.filter(tokens, lambda t: ~t.rlike(r"^\d+$"))
    telling = F.filter(words, lambda t: F.length(t) >= 4)
    base = F.least(F.lit(0.45), 0.22 * F.size(telling))
    base = base + F.when(F.size(words) >= 2, 0.22).otherwise(0.0) + F.when(F.exists(telling, lambda t: F.length(t) >= 10), 0.18).otherwise(0.0) + F.when(F.length(text) >= 12, 0.12).otherwise(0.0)
    alone = (F.size(words) == 1) & (F.size(telling) > 0)
    base = F.when(alone, F.greatest(base, F.least(F.lit(0.70), F.length(F.element_at(telling, 1)) / 18.0))).otherwise(base)
    return F.when(F.size(words) > 0, F.least(F.lit(1.0), base)).otherwise(F.lit(0.0))


def match_gate(quality: Column, best: Column, specificity: Column) -> Column:
    """How far a candidate's match lets personalisation act: 0 under an absolute or relative threshold."""
    absolute, relative = 0.22 + 0.30 * specificity, 0.50 + 0.22 * specificity
    share = quality / F.greatest(best, F.lit(1e-6))
    over = lambda x, t: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - t) / F.greatest(F.lit(1e-6), 1 - t)))
    gate = F.least(F.lit(1.0), 0.45 * over(quality, absolute) + 0.55 * over(share, relative))
    return F.when((quality <= 0) | (best <= 0) | (quality < absolute) | (share < relative), F.lit(0.0)).otherwise(gate)


def cache_key(namespace: str, columns: dict[str, Column]) -> Column:
    """A digest of the columns as JSON, names sorted and nulls kept."""
    return F.concat(F.lit(f"{namespace}:"), F.sha2(F.to_json(F.struct(*[columns[n].alias(n) for n in sorted(columns)]), {"ignoreNullFields": "false"}), 256))


def is_number(c: Column) -> Column:
    """Whether ``lenient_double`` reads a number rather than falling back."""
    return F.translate(F.trim(c), ",", ".").try_cast("double").isNotNull()


def repeated(values: Column, counts: Column, each: int = 5, most: int = 180) -> Column:
    """Every value as often as it counts (at most each times), in order, cut at most."""
    many = F.zip_with(values, counts, lambda v, n: F.array_repeat(v, F.least(F.greatest(n, F.lit(0)), F.lit(each)).cast("int")))
    return F.slice(F.flatten(many), 1, most)


def json_field(c: Column, schema: str) -> Column:
    """Parsed JSON, null for what can't be parsed."""
    return F.from_json(c, schema)


def in_bounds(top: Column, least: Column, duration: Column, kind: Column, kinds: tuple[str, ...]) -> Column:
    """Whether a request is valid: 1 to 50 results, a least score of 0 to 1, no negative duration, a known kind of event."""
    return top.between(1, 50) & least.between(0, 1) & F.coalesce(duration >= 0, F.lit(True)) & F.coalesce(kind.isin(*kinds), F.lit(True))

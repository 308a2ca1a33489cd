"""URL filtering by a ratio of character language models, with DataFrame functions only.

Rules decide the URLs they fit; those URLs also teach two smoothed variable-order
Markov models, one of accepted and one of rejected URLs (Witten-Bell interpolation
of orders 0 to 3 over a folded alphabet).  Other URLs are judged by the
log-likelihood difference a character, against the threshold that best separates
a held-out fifth of the rule-decided URLs (balanced accuracy).

The models come from counts over every distinct URL, and the table of log ratios
has one row a 4-gram of a folded alphabet of 43 symbols, so at most 43**4 rows; it
is broadcast only after a count.

Null URLs and those without ``://`` have an empty host and path, fit no rule and
score 0.  Repeated rows get the same answer.  Without both accepted and rejected
examples every score is 0 and the threshold 0, so the method allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import BROADCAST_ROWS, ascii_lower, left_join, materialise, small_side

ORDER = 3
PAD = "^"
END = "$"
SYMBOLS = 43
HELD_OUT = 5
BINS = 2000


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict.  rules: (verdict, rule) pairs, a short list a person writes."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(f"/{rest}"))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def folded(url: Column) -> Column:
    """The URL after its scheme over the models' alphabet: digits as 0, rare characters as *."""
    s = F.regexp_replace(ascii_lower(F.coalesce(after_scheme(url), F.lit(""))), "[0-9]", "0")
    return F.regexp_replace(s, r"[^a-z0./?#=&_%:~+@,-]", "*")


def grams(text: Column) -> Column:
    """Each symbol (and the end) with the ORDER symbols before it."""
    padded = F.concat(F.lit(PAD * ORDER), text, F.lit(END))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(padded, i, F.lit(ORDER + 1)))).otherwise(F.array().cast("array<string>"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """gram, ratio of a table (gram, good, bad): the log of the models' ratio for the last symbol of each gram."""
    table = counts.withColumns({"pg": F.lit(1.0 / SYMBOLS), "pb": F.lit(1.0 / SYMBOLS)})
    for order in range(ORDER + 1):
        # good and bad of the gram's last order + 1 symbols, then what its context holds
        table = table.withColumn("part", F.substr("gram", F.lit(ORDER + 1 - order), F.lit(order + 1)))
        grouped = counts.groupBy(F.substr("gram", F.lit(ORDER + 1 - order), F.lit(order + 1)).alias("part")).agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
        context = grouped.groupBy(F.substr("part", F.lit(1), F.lit(order)).alias("context")).agg(
            F.sum("g").alias("ng"), F.sum("b").alias("nb"),
            F.count_if(F.col("g") > 0).alias("tg"), F.count_if(F.col("b") > 0).alias("tb"),
        )
        joined = grouped.withColumn("context", F.substr("part", F.lit(1), F.lit(order))).join(context, "context").drop("context")
        table = table.join(joined, "part")
        mixed = lambda c, n, t, p: F.when(F.col(n) > 0, (F.col(c) + F.col(t) * F.col(p)) / (F.col(n) + F.col(t))).otherwise(F.col(p))
        table = table.select("gram", mixed("g", "ng", "tg", "pg").alias("pg"), mixed("b", "nb", "tb", "pb").alias("pb"))
    return table.select("gram", (F.log("pg") - F.log("pb")).alias("ratio"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], ident: str = "page_id", url: str = "url", score_all: bool = True) -> DataFrame:
    """ident, host, path, rule, verdict, score, threshold of every row.

    Rows that a rule decides are judged where they stand.  Without score_all they have no score, and only the others
    meet the scores, which are computed once a distinct URL.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(f"`{ident}`").alias("page_id"), F.col(f"`{url}`").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    name, what = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "url", "host", "path", name.alias("rule"), what.alias("ruled"))
    fold = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT))
    urls = materialise(rows.where(F.col("url").isNotNull()).select("url", "ruled", fold.alias("fold")).distinct(), "urls")
    teaches = lambda w: F.sum(F.when((F.col("ruled") == w) & (F.col("fold") > 0), 1).otherwise(0)).alias
    parts = urls.select("url", "ruled", "fold", F.explode(grams(folded(F.col("url")))).alias("gram"))
    counts = materialise(parts.groupBy("gram").agg(teaches("allow")("good"), teaches("block")("bad")), "grams")
    known = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    asked = F.lit(True) if score_all else F.col("ruled").isNull()
    threshold, scored = 0.0, None
    if known["g"] and known["b"]:
        ratios = small_side(materialise(log_ratios(counts), "ratios"), known["n"], BROADCAST_ROWS)
        some = parts.where(asked | (F.col("fold") == 0)).join(ratios, "gram").groupBy("url", "ruled", "fold").agg(F.avg("ratio").alias("score"))
        scored = materialise(some, "url-scores")
        threshold = calibrated(scored.where("fold = 0 AND ruled IS NOT NULL").select("ruled", "score"))
        scored = scored.where(asked).select("url", "score")
    if scored is None:
        told = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        told = left_join(rows.where(asked), scored, "url").unionByName(rows.where(~asked), allowMissingColumns=True)
    score = F.coalesce("score", F.lit(0.0))
    return told.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(score >= threshold, "allow").otherwise("block")).alias("verdict"),
        (score if score_all else F.when(asked, score)).alias("score"),
        F.lit(threshold).alias("threshold"),
    )


def calibrated(scored: DataFrame) -> float:
    """The threshold of best balanced accuracy, from a histogram of at most BINS bins over the scores' range."""
    ends = scored.agg(F.min("score").alias("a"), F.max("score").alias("b"), F.count_if(F.col("ruled") == "allow").alias("g"), F.count_if(F.col("ruled") == "block").alias("n")).first()
    if not ends["g"] or not ends["n"] or ends["a"] == ends["b"]:
        return 0.0
    step = (ends["b"] - ends["a"]) / BINS
    rows = scored.groupBy(F.least(F.floor((F.col("score") - ends["a"]) / step), F.lit(BINS - 1)).alias("bin")).agg(
        F.count_if(F.col("ruled") == "allow").alias("g"), F.count_if(F.col("ruled") == "block").alias("n")
    )
    held = {r["bin"]: (r["g"], r["n"]) for r in rows.collect()}
    best, below_g, below_n = [], 0, 0
    top = -1.0
    for i in range(BINS):
        value = (1 - below_g / ends["g"]) + below_n / ends["n"]
        if value > top + 1e-12:
            top, best = value, [i]
        elif abs(value - top) <= 1e-12:
            best.append(i)
        g, n = held.get(i, (0, 0))
        below_g, below_n = below_g + g, below_n + n
    run = reduce(lambda r, i: r + [i] if not r or i == r[-1] + 1 else r, best, [])
    return ends["a"] + run[len(run) // 2] * step

"""Benchmark decontamination with DataFrame functions only.

Items become windows of ``n`` normalised words (an item of fewer words is one
window).  Any window of m words holds a whole *aligned* block of (m + 1) // 2
words, so documents are cut into aligned blocks and each block is probed once in
the broadcast hash set of all such blocks of the windows: a fifth of the probes
that a slide over every position needs, at no loss.  A block that hits brings its
two neighbours, from which the windows around it are built and held against the
broadcast set of whole windows.

Null text has no words.  Rows that repeat are judged each; rows that share a
doc_id but differ in text are told apart.  Empty tables give no hits.  Columns
beyond id and text are carried untouched by ``remove``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import ascii_lower, materialise, small_side

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """The words, lower-cased and joined by single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(text), SEPARATORS, " "))


def cut(words: Column, size: int) -> Column:
    """Consecutive blocks of size words each; the last may be shorter."""
    return F.regexp_extract_all(words, F.lit(r"[^ ]++(?: [^ ]++){0,%d}+" % (size - 1)), F.lit(0))


def runs(words: Column, length: Column | int) -> Column:
    """(at, run): every run of consecutive words of that length in an array of words, at from 0."""
    length = F.lit(length) if isinstance(length, int) else length
    last = F.size(words) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, length), " ").alias("run")))


def windows(items: DataFrame, n: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, m, run: the distinct windows of the items."""
    words = F.filter(F.split(normalised(F.col(text)), " "), lambda w: w != "")
    held = items.select(F.col(item).alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    held = held.select("item_id", "w", F.least(F.size("w"), F.lit(n)).alias("m"))
    return held.select("item_id", "m", F.inline(runs(F.col("w"), F.col("m")))).select("item_id", "m", "run").distinct()


def row_key(docs: DataFrame, ident: str, text: str) -> list[Column]:
    """What tells rows apart: the id and a hash of the text."""
    return [F.col(ident).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key")]


def scan(docs: DataFrame, items: DataFrame, n: int, ident: str, text: str, item: str) -> tuple[DataFrame, DataFrame]:
    """What one pass over the texts gives, as tables: (doc_id, text_key, n_words) of every row, and the places of ``find``."""
    wins = materialise(windows(items, n, item, text), "windows")
    sizes: dict[int, list[int]] = {}
    counted = {r["m"]: r["c"] for r in wins.groupBy("m").agg(F.count("*").alias("c")).collect()}  # at most n rows
    for m in sorted(counted):
        sizes.setdefault((m + 1) // 2, []).append(m)
    base = docs.select(*row_key(docs, ident, text), normalised(F.col(text)).alias("w"))
    words, parts = None, []
    for size, lengths in sorted((sizes or {5: []}).items(), reverse=True):
        rows = sum(counted[m] for m in lengths)
        mine = wins.where(F.col("m").isin(lengths))
        keys = mine.select(F.inline(runs(F.split("run", " "), size))).select("run").distinct().withColumn("hit", F.lit(True))
        blocks = base.select("doc_id", "text_key", cut(F.col("w"), size).alias("blocks"))
        hit = blocks.select("doc_id", "text_key", "blocks", F.posexplode_outer("blocks").alias("i", "run"))
        hit = hit.join(small_side(keys, rows * n), "run", "left").where("hit OR i IS NULL OR i = 0")
        near = F.slice("blocks", F.greatest(F.col("i"), F.lit(1)), F.when(F.col("i") > 0, 3).otherwise(2))
        last = F.element_at("blocks", -1)
        told = F.when(F.size("blocks") > 0, (F.size("blocks") - 1) * size + F.length(last) - F.length(F.replace(last, F.lit(" "))) + 1).otherwise(F.lit(0))
        hit = hit.select(
            "doc_id", "text_key",
            F.when(F.coalesce("i", F.lit(0)) == 0, told.cast("long")).alias("n_words"),
            F.when(F.col("hit"), F.greatest(F.col("i") - 1, F.lit(0)) * size).alias("base"),
            F.when(F.col("hit"), F.array_join(near, " ")).alias("near"),
        )
        hit = materialise(hit, "scan")
        words = words or hit.where("n_words IS NOT NULL").select("doc_id", "text_key", "n_words")
        if not lengths:
            continue
        tried = F.flatten(F.array(*[F.transform(runs(F.split("near", " "), m), lambda r: F.struct(r["at"].alias("at"), r["run"].alias("run"))) for m in lengths]))
        tried = hit.where("near IS NOT NULL").select("doc_id", "text_key", "base", F.inline(tried))
        found = tried.join(small_side(mine, rows), "run")
        parts.append(found.select("doc_id", "text_key", (F.col("base") + F.col("at")).alias("start"), "m", "item_id"))
    if parts:
        return words, materialise(reduce(DataFrame.unionByName, parts).distinct(), "places")
    kind = items.schema[item].dataType.simpleString()
    return words, words.where(F.lit(False)).select("doc_id", "text_key", F.lit(0).alias("start"), F.lit(0).alias("m"), F.lit(None).cast(kind).alias("item_id"))


def find(docs: DataFrame, items: DataFrame, n: int = 10, ident: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """doc_id, text_key, start, m, item_id: each place (word number from 0) where a window of an item occurs."""
    return scan(docs, items, n, ident, text, item)[1]


def report(docs: DataFrame, items: DataFrame, n: int = 10, ident: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items (ids as sorted strings), one row for each row of docs."""
    base, places = scan(docs, items, n, ident, text, item)
    spots = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1))
    covered = places.select("doc_id", "text_key", spots.alias("at")).distinct().groupBy("doc_id", "text_key").agg(F.count("*").alias("n_hit"))
    named = places.select("doc_id", "text_key", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = base.alias("b")
    for side, name in ((covered, "c"), (named, "n")):
        same = F.col("b.doc_id").eqNullSafe(F.col(f"{name}.doc_id")) & F.col("b.text_key").eqNullSafe(F.col(f"{name}.text_key"))
        out = out.join(side.alias(name), same, "left")
    return out.select(
        "b.doc_id", "b.text_key", "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def remove(docs: DataFrame, items: DataFrame, n: int = 10, ident: str = "doc_id", text: str = "text", item: str = "item_id", mode: str = "document") -> DataFrame:
    """docs without hits, all columns kept.  mode: "document" drops the rows, "span" cuts the hit words out of the text."""
    places = find(docs, items, n, ident, text, item)
    if mode == "document":
        hit = places.select("doc_id", "text_key").distinct()
        hit = small_side(hit, hit.count()).alias("h")
        same = F.col(f"d.{ident}").eqNullSafe(F.col("h.doc_id")) & F.xxhash64(F.col(f"d.{text}")).eqNullSafe(F.col("h.text_key"))
        return docs.alias("d").join(hit, same, "left_anti")
    spots = places.select("doc_id", "text_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("at"))
    hit = spots.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("spots")).alias("h")
    same = F.col(f"d.{ident}").eqNullSafe(F.col("h.doc_id")) & F.xxhash64(F.col(f"d.{text}")).eqNullSafe(F.col("h.text_key"))
    word, gap = CASED_WORD, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(F.col(f"d.{text}"), F.lit(f"{gap}*+{word}|{gap}++$"), F.lit(0))
    left = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(F.col("h.spots"), i)), "")
    cleaned = F.when(F.col("h.spots").isNull(), F.col(f"d.{text}")).otherwise(left)
    return docs.alias("d").join(hit, same, "left").select(*[cleaned.alias(c) if c == text else F.col(f"d.`{c}`").alias(c) for c in docs.columns])

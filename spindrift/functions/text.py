"""Column builders for text: normalisation, stems, attributes, n-grams, similarity."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

import spindrift

# Functions that run on executors travel by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(spindrift)

TOKEN = r"[0-9A-Za-zА-Яа-яЁё]+"

# Noise words of searching, noise words of keyword extraction, words of purchasing, inflectional endings in the order they are tried,
# units of measure, markers of works and of services.
SEARCH_STOPWORDS = ("и", "в", "во", "на", "по", "для", "с", "со", "к", "ко", "из", "от", "до", "под", "над", "не", "или", "а", "но", "о", "об", "у", "the", "and", "for", "of", "to")
KEYWORD_STOPWORDS = ("и", "в", "во", "на", "по", "под", "над", "для", "с", "со", "к", "ко", "из", "от", "до", "без", "при", "или", "а", "но", "не", "ни", "о", "об", "у", "же", "ли", "бы", "the", "and", "for", "of", "to", "n")
SERVICE_WORDS = ("выполнение", "закупка", "оказание", "оказания", "приобретение", "поставка", "поставку", "работ", "работы", "товара", "товаров", "услуг", "услуги")
ENDINGS = (
    "иями", "ями", "ами", "ией", "ией", "ого", "ему", "ому", "ыми", "ими", "его", "ого", "ая", "яя", "ое", "ее", "ые", "ие", "ий", "ый",
    "ой", "ам", "ям", "ах", "ях", "ом", "ем", "ов", "ев", "ей", "ую", "юю", "ия", "ья", "ие", "ье", "ию", "ью", "иям", "иях", "ию",
    "а", "я", "ы", "и", "е", "о", "у", "ю",
)
#: The characters in which an ending ends; what ends otherwise, numbers too, is its own stem.
LAST = "".join(sorted({e[-1] for e in ENDINGS}))
UNITS = (
    "мкг", "мг", "г", "кг", "мл", "л", "дл", "нм", "мкм", "мм", "см", "м", "км", "м2", "б", "кб", "мб", "гб", "тб", "mb", "gb", "tb", "kb",
    "ма", "а", "мв", "в", "квт", "вт", "ом", "мом", "гц", "кгц", "мгц", "ггц", "hz", "mhz", "ghz", "пф", "нф", "мкф", "usb", "rpm", "dpi",
    "таб", "капс", "амп", "фл", "шт", "уп", "a3", "a4", "a5", "a6",
)
WORK_MARKERS = ("работ", "ремонт", "монтаж", "строител", "установк", "реконструкц", "проектир")
SERVICE_MARKERS = ("услуг", "обслужив", "страхован", "консультац", "обучен", "аренд", "перевозк")


def clean_text(c: Column) -> Column:
    """White space collapsed, outer quotes gone, null as empty."""
    s = F.trim(F.translate(F.coalesce(c, F.lit("")), "﻿\t\n\r", "    "))
    return F.regexp_replace(F.trim(F.regexp_replace(s, '^"+|"+$', "")), r"\s+", " ")


def tokenize(c: Column) -> Column:
    """The lower-case letter and digit runs, ё as е; no other character matters, so the text isn't cleaned before."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е"), F.lit(TOKEN), F.lit(0))


def normalize_text(c: Column) -> Column:
    return F.array_join(tokenize(c), " ")


def listed(words: tuple[str, ...]) -> Column:
    """The words as one constant, which keeps plans small where a rule is used often."""
    return F.split(F.lit(" ".join(words)), " ")


def is_noise(token: Column, stopwords: tuple[str, ...] = SEARCH_STOPWORDS) -> Column:
    """A stop-word, or one character that is no digit."""
    return ((F.length(token) <= max(map(len, stopwords))) & F.array_contains(listed(stopwords), token)) | ((F.length(token) == 1) & ~token.rlike(r"^\d$"))


def normalize_tokens(tokens: Column) -> Column:
    """Distinct tokens without noise, in order of first appearance."""
    plain = lambda t: F.when(t.rlike(r"^[0-9a-zа-я]+\z"), t).otherwise(normalize_text(t))
    return F.array_distinct(F.filter(F.transform(F.array_distinct(tokens), plain), lambda t: (t != "") & ~is_noise(t)))


def stem(token: Column) -> Column:
    """The token without the first listed ending that leaves three characters; short and numeric tokens stay."""
    fits = F.filter(listed(ENDINGS), lambda e: F.endswith(token, e) & (F.length(token) - F.length(e) >= 3))
    kept = (F.length(token) <= 4) | ~F.contains(F.lit(LAST), F.substring(token, -1, 1))
    return F.when(kept, token).otherwise(F.substr(token, F.lit(1), F.length(token) - F.coalesce(F.length(F.get(fits, F.lit(0))), F.lit(0))))


def stem_tokens(tokens: Column) -> Column:
    """Distinct stems without noise."""
    return F.array_distinct(F.filter(F.transform(F.array_distinct(tokens), stem), lambda t: (t != "") & ~is_noise(t)))


def unique_in_order(items: Column) -> Column:
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def extract_keywords(parts: list[Column], stopwords: tuple[str, ...] = KEYWORD_STOPWORDS, limit: int = 24) -> Column:
    """The first distinct informative tokens of several texts, joined."""
    tokens = F.concat(*[tokenize(p) for p in parts])
    return F.array_join(F.slice(F.array_distinct(F.filter(tokens, lambda t: ~is_noise(t, stopwords))), 1, limit), " ")


def parse_attributes(c: Column) -> Column:
    """(key, value) of each ``key[:value]`` between semicolons; keys may not be empty."""
    pairs = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.struct(clean_text(F.substring_index(x, ":", 1)).alias("key"), clean_text(F.when(F.contains(x, F.lit(":")), F.substr(x, F.instr(x, ":") + 1)).otherwise(F.lit(""))).alias("value")))
    return F.filter(pairs, lambda p: p["key"] != "")


def attribute_spans(c: Column) -> Column:
    """Distinct (value, unit) pairs in normalised text."""
    text = normalize_text(c)
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    pattern = rf"(?U)(\d+(?:[.,]\d+)?)\s*({units})\b"
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.translate(v, ",", "."))
    return F.array_distinct(F.arrays_zip(values.alias("value"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("unit")))


def char_ngrams(token: Column, least: int = 3, most: int = 5) -> Column:
    """Distinct character n-grams of the token between angle brackets."""
    s = F.concat(F.lit("<"), token, F.lit(">"))
    def of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(s, i, F.lit(n)))
        return F.when(F.length(s) >= n, cut).otherwise(F.array().cast("array<string>"))

    grams = [of(n) for n in range(least, most + 1)]
    return F.array_distinct(F.concat(*grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of the first set that the second has."""
    a = F.array_distinct(a)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def contains_phrase(tokens: Column, phrase: Column) -> Column:
    """The phrase as whole consecutive tokens."""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def distance_of(a: str, b: str, most: int) -> int:
    """Optimal-string-alignment distance, or most + 1 once it must exceed most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i in range(len(a)):
        row = [i + 1]
        for j in range(len(b)):
            d = min(rows[i][j + 1] + 1, row[j] + 1, rows[i][j] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d = min(d, rows[i - 1][j - 1] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        rows.append(row)
    return rows[-1][-1]


@F.pandas_udf(IntegerType())
def bounded_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance with adjacent transpositions, 3 for more than 2; call it on pairs that already share a block."""
    return pd.Series([None if x is None or y is None else distance_of(x, y, 2) for x, y in zip(a, b)], dtype="Int32")


def item_kind(name: Column, category: Column) -> Column:
    """works, services or goods, by markers in name and category."""
    text = normalize_text(F.concat_ws(" ", name, category))
    return F.when(text.rlike("|".join(WORK_MARKERS)), "works").when(text.rlike("|".join(SERVICE_MARKERS)), "services").otherwise("goods")


def category_codes(c: Column) -> Column:
    """Classification codes such as n02bg."""
    return F.array_distinct(F.regexp_extract_all(normalize_text(c), F.lit(r"(?U)\b[a-zа-я]\d{2}[a-zа-я]{0,2}\b"), F.lit(0)))


def code_match(a: Column, b: Column) -> Column:
    """1 for a common code, 0.8 where one is a prefix of another, else 0."""
    prefix = F.exists(a, lambda x: F.exists(b, lambda y: F.startswith(x, y) | F.startswith(y, x)))
    return F.when(F.arrays_overlap(a, b), F.lit(1.0)).when(prefix, F.lit(0.8)).otherwise(F.lit(0.0))


def stems_meet(a: Column, b: Column) -> Column:
    """A stem of one set is a prefix of a stem of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.startswith(x, y) | F.startswith(y, x)))


def pipe_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def humanize_number(c: Column) -> Column:
    """16.00000 as 16, 1.50 as 1.5."""
    return F.when(c.rlike(r"^-?\d+\.\d+$"), F.regexp_replace(F.regexp_replace(c, "0+$", ""), r"\.$", "")).otherwise(c)


def truncate_words(c: Column, most: int) -> Column:
    """At most that many characters, cut at a space and marked."""
    short = F.substr(c, F.lit(1), F.lit(most - 1))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(short, r" [^ ]*$", ""), F.lit("…")))


def query_variants(c: Column, service_words: tuple[str, ...] = SERVICE_WORDS, compact: int = 8) -> Column:
    """Distinct (name, text) variants of a purchase name: whole, first clause, without service words, first tokens.

    The clause is cut from the normalised text, which has no separators left, so it is the whole and drops out as a repeat.
    """
    tokens = tokenize(c)
    stripped = F.filter(tokens, lambda t: ~t.isin(*service_words))
    clause = F.element_at(F.split(F.array_join(tokens, " "), r"[;,]| - "), 1)
    made = [("full", F.array_join(tokens, " ")), ("clause", clause), ("stripped", F.array_join(stripped, " ")), ("compact", F.array_join(F.slice(tokens, 1, compact), " "))]
    held = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), t.alias("text")) for n, t in made]), lambda v: v["text"] != "")
    first = lambda kept, v: F.when(F.exists(kept, lambda k: k["text"] == v["text"]), kept).otherwise(F.concat(kept, F.array(v)))
    return F.aggregate(held, F.array().cast("array<struct<name:string,text:string>>"), first)


def chosen_query(c: Column, service_words: tuple[str, ...] = SERVICE_WORDS, most: int = 12) -> Column:
    """The (name, text) variant that asks best: stripped, then clause, compact, whole; of at most so many tokens and some telling one; null if there is none."""
    order = {"stripped": 4, "clause": 3, "compact": 2, "full": 1}
    place = lambda v: F.coalesce(*[F.when(v["name"] == n, p) for n, p in order.items()])
    telling = lambda v: F.size(F.filter(F.split(v["text"], " "), lambda t: ~t.isin(*service_words)))
    fit = F.filter(query_variants(c, service_words), lambda v: (F.size(F.split(v["text"], " ")) <= most) & (telling(v) > 0))
    best = F.array_max(F.transform(fit, lambda v: F.struct(place(v).alias("p"), telling(v).alias("n"), (-F.size(F.split(v["text"], " "))).alias("m"), v["text"].alias("text"), v["name"].alias("name"))))
    return F.when(best.isNotNull(), F.struct(best["name"].alias("name"), best["text"].alias("text")))


def pseudo_queries(contract_name: Column, name: Column, category: Column, attributes: Column) -> Column:
    """A map of five queries that could have led to a purchase; contract and item name stand in for each other where one is empty."""
    n, i, c, a = (F.nullif(normalize_text(x), F.lit("")) for x in (contract_name, name, category, attributes))
    join = lambda *xs: F.concat_ws(" ", *xs)
    made = {"contract": F.coalesce(n, i, F.lit("")), "name": F.coalesce(i, n, F.lit("")), "contract_category": join(n, c), "name_category": join(i, c), "name_category_attributes": join(i, c, a)}
    return F.create_map(*reduce(lambda xs, kv: [*xs, F.lit(kv[0]), kv[1]], made.items(), []))


def document_text(name: Column, category: Column, keys: Column) -> Column:
    """What stands for a product when texts are embedded: the name twice, category and keywords."""
    n, c, k = (F.nullif(F.coalesce(x, F.lit("")), F.lit("")) for x in (name, category, keys))
    return F.concat_ws(" ", n, n, c, k)


def asked_text(corrected: Column, synonyms: Column, completions: Column, related: Column, fallback: Column) -> Column:
    """What stands for a query: its distinct tokens, corrected ones first; the fallback if there are none."""
    tokens = normalize_tokens(F.concat(corrected, synonyms, completions, related))
    return F.when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise(normalize_text(fallback))


def needs_broad_retrieval(tokens: Column, completed: Column) -> Column:
    """Whether a query should fetch more candidates: a completed token, or a short one that is no number."""
    return completed | F.exists(tokens, lambda t: (F.length(t) <= 4) & ~t.rlike(r"^\d+$"))


def meets_expectation(haystack: Column, every: Column, some: Column) -> Column:
    """Whether a result's text holds all of one list and any of the other; empty lists ask nothing, but not both."""
    text = normalize_text(haystack)
    wanted = lambda xs: F.filter(F.transform(xs, normalize_text), lambda x: x != "")
    every, some = wanted(every), wanted(some)
    holds = F.forall(every, lambda x: F.contains(text, x)) & ((F.size(some) == 0) | F.exists(some, lambda x: F.contains(text, x)))
    return holds & ((F.size(every) > 0) | (F.size(some) > 0))

"""Column builders for what people see: suggestion phrases, prefix scores, previews, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import text as T

# Words that may not end a phrase, forms that end a product's phrase, companies and countries that do, units that tell nothing.
CONNECTORS = ("и", "или", "а", "но", "на", "в", "во", "с", "со", "к", "ко", "о", "об", "обо", "у", "от", "до", "за", "из", "по", "под", "над", "при", "для", "без", "через", "между")
FORMS = (
    "раствор", "растворы", "таблетки", "таблетка", "табл", "таб", "капсулы", "капсула", "капс", "мазь", "крем", "суспензия", "сусп", "сироп", "порошок", "спрей", "аэрозоль",
    "ампула", "амп", "флакон", "фл", "капли", "концентрат", "конц", "инф", "наруж", "приема", "прием", "внутрь", "введение",
)
MAKERS = ("ооо", "ао", "оао", "зао", "пао", "россия", "германия", "австрия", "италия", "швейцария")
SMALL_UNITS = ("мг", "мл", "шт", "таб", "кап", "фл", "амп", "гр", "г", "дл", "д", "№")
# Keys that lead a preview, and those that come first after them.
LEADS = ("назначение", "общие характеристики", "описание")
PRIORITY = (
    *LEADS, "состав", "тип", "дозировка", "лекарственная форма", "форма", "материал", "цвет", "объем накопителя", "интерфейс подключения", "максимальная скорость чтения",
    "скорость записи данных", "количество определяемых аллергенов", "количество тестов в упаковке", "совместимость", "страна происхождения",
)
NO_VALUES = ("", "0", "0.0", "0.00", "0.00000")


def without_trailing_connectors(tokens: Column) -> Column:
    last = F.array_max(F.transform(tokens, lambda t, i: F.when((F.length(t) > 1) & ~F.array_contains(T.listed(CONNECTORS), t), i + 1).otherwise(0)))
    return F.slice(tokens, 1, F.coalesce(last, F.lit(0)))


def before_first(tokens: Column, ends) -> Column:
    """The tokens before the first for which ends holds."""
    at = F.array_min(F.filter(F.transform(tokens, lambda t, i: F.when(ends(t), i)), lambda i: i.isNotNull()))
    return F.when(at.isNull(), tokens).otherwise(F.slice(tokens, 1, at))


def has_digit(token: Column) -> Column:
    return token.rlike("[0-9]")


def name_phrase(name: Column, query: Column) -> Column:
    """A name's words before the first with a digit; empty if fewer than two where the query has several."""
    words = without_trailing_connectors(before_first(T.tokenize(name), has_digit))
    least = F.when(F.size(T.tokenize(query)) <= 1, 1).otherwise(2)
    return F.when(F.size(words) >= least, F.array_join(words, " ")).otherwise("")


def category_phrase(category: Column) -> Column:
    return F.array_join(without_trailing_connectors(F.filter(T.tokenize(category), lambda t: ~t.rlike("^[0-9]+$"))), " ")


def product_phrase(name: Column) -> Column:
    """A product's name up to numbers, makers and, after the first word, forms; single characters and leading pairs are left out; capitalised."""
    words = F.filter(before_first(T.tokenize(name), lambda t: has_digit(t) | t.isin(*MAKERS)), lambda t: F.length(t) > 1)
    longer = F.array_min(F.filter(F.transform(words, lambda t, i: F.when(F.length(t) > 2, i)), lambda i: i.isNotNull()))
    words = F.when(longer.isNull(), F.array().cast("array<string>")).otherwise(F.slice(words, longer + 1, F.size(words)))
    rest = before_first(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda t: F.array_contains(T.listed(FORMS), t))
    phrase = F.array_join(without_trailing_connectors(F.concat(F.slice(words, 1, 1), rest)), " ")
    return F.concat(F.upper(F.substring(phrase, 1, 1)), F.substring(phrase, 2, 1 << 20))


def significant_tokens(c: Column) -> Column:
    return significant(T.tokenize(c))


def significant(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike("^[0-9]+$") & (F.length(t) > 2) & ~F.array_contains(T.listed(SMALL_UNITS), t))


def prefix_match(query: Column, tokens: Column, secondary: bool = True) -> Column:
    """How well a suggestion's tokens begin like the query: the whole query, then its tokens and their stems against the first and the next three."""
    asked, held, whole = significant_tokens(query), significant(tokens), T.normalize_text(query)
    head, rest, more = F.get(held, F.lit(0)), F.slice(held, 2, 3), F.lit(secondary)
    begins = lambda x, q: F.startswith(x, q)
    own = lambda q: (
        F.when(begins(head, q), 60.0)
        .when(begins(T.stem(head), T.stem(q)), 38.0)
        .when(more & (F.length(q) >= 3) & F.exists(rest, lambda t: begins(t, q)), 26.0)
        .when(more & (F.length(q) >= 3) & F.exists(rest, lambda t: begins(T.stem(t), T.stem(q))), 18.0)
        .otherwise(0.0)
    )
    start = F.when(begins(head, whole), 120.0).otherwise(0.0)
    late = F.when(more & F.exists(F.slice(held, 2, 4), lambda t: begins(t, whole)), 55.0).otherwise(0.0)
    score = start + F.when(F.size(asked) == 0, late).otherwise(F.aggregate(F.transform(asked, own), F.lit(0.0), lambda s, v: s + v))
    return F.when((whole == "") | (F.size(held) == 0), 0.0).otherwise(score)


def preview(attributes: Column, most: int = 240, parts: int = 4) -> Column:
    """A product's telling attributes as text: what it is for (alone if it says much), then the keys that matter, then others, one of a key."""
    key = lambda p: F.translate(F.lower(p["key"]), "ё", "е")
    pairs = F.transform(T.parse_attributes(attributes), lambda p: F.struct(p["key"].alias("key"), T.humanize_number(p["value"]).alias("value")))
    pairs = F.filter(pairs, lambda p: ~F.lower(p["value"]).isin(*NO_VALUES))
    of = lambda k: F.get(F.filter(pairs, lambda p: key(p) == k), F.lit(0))
    said = lambda p: F.concat(p["key"], F.lit(": "), p["value"])
    long_one = lambda p: F.when(F.size(F.split(p["value"], " ")) > 4, F.concat(F.upper(F.substring(p["value"], 1, 1)), F.substring(p["value"], 2, 1 << 20))).otherwise(said(p))
    lead = F.coalesce(*[long_one(of(k)) for k in LEADS])
    lead_key = F.coalesce(*[F.when(of(k).isNotNull(), k) for k in LEADS], F.lit(""))
    first = F.filter(F.array(lead, *[F.when(lead_key != k, said(of(k))) for k in PRIORITY]), lambda x: x.isNotNull())
    names = F.transform(pairs, key)
    other = F.filter(F.transform(pairs, lambda p, i: F.when(~key(p).isin(*PRIORITY) & (F.array_position(names, key(p)) == i + 1), said(p))), lambda x: x.isNotNull())
    return T.truncate_words(F.array_join(F.slice(F.concat(first, other), 1, parts), " "), most)


def fallback_preview(keys: Column, shown: int = 5) -> Column:
    """The first keys of a product without attribute values."""
    held = T.pipe_list(keys)
    text = F.concat(F.lit("Характеристики: "), F.array_join(F.slice(held, 1, shown), ", "), F.when(F.size(held) > shown, "…").otherwise(""))
    return F.when(F.size(held) > 0, T.truncate_words(text, 240)).otherwise("")


def reason_label(codes: Column, category: Column, session_categories: Column, bounced: Column) -> Column:
    """What is shown as the reason of a result; nothing for categories that were given up."""
    any_of = lambda *names: F.arrays_overlap(codes, F.array(*[F.lit(n) for n in names]))
    again = F.array_contains(F.transform(session_categories, T.normalize_text), T.normalize_text(category)) & (T.normalize_text(category) != "")
    return (
        F.when(bounced, None)
        .when(any_of("SESSION_CART_BOOST", "SESSION_CLICK_BOOST"), "Продолжить подбор в этой категории")
        .when(any_of("INSTITUTION_TYPE_PREFIX_MATCH"), "По типу учреждения")
        .when(any_of("USER_CATEGORY_AFFINITY", "USER_REPEAT_BUY", "RECENT_SIMILAR_PURCHASE", "SUPPLIER_AFFINITY"), "На основе ваших закупок")
        .when(any_of("REGIONAL_POPULARITY"), "Популярно в вашем регионе")
        .when(any_of("SIMILAR_CUSTOMER_POPULARITY"), "Популярно у похожих заказчиков")
        .when(again, "Продолжить подбор в этой категории")
    )


def shown_correction(corrected: Column, normalized: Column) -> Column:
    """The corrected query, if it differs."""
    return F.when(F.nullif(corrected, F.lit("")) != F.coalesce(normalized, F.lit("")), corrected)


def user_key(ident: Column, inn: Column, anonymous: bool = True) -> Column:
    """The id, else one made of the customer, else anonymous (or nothing)."""
    name = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(name(ident), F.concat(F.lit("user-"), name(inn)), F.lit("anonymous") if anonymous else F.lit(None))


def learned_neighbor(source: Column, candidate: Column) -> Column:
    """The token of a learned neighbour that may be used; empty for numbers, short ones, mixed scripts and the source itself."""
    token = F.coalesce(F.get(T.normalize_tokens(T.tokenize(candidate)), F.lit(0)), F.lit(""))
    fit = (token != source) & (F.length(token) > 2) & token.rlike(r"^\p{L}+$") & ~(token.rlike("[а-яё]") & token.rlike("[a-z]"))
    return F.when(fit, token).otherwise("")


def match_quality(f: dict[str, Column], score: Column | None = None) -> Column:
    """How well a candidate meets the query, from its search features; from the score where it has none."""
    g = lambda n: F.coalesce(f[n], F.lit(0.0)) if n in f else F.lit(0.0)
    lexical = F.greatest(g("exact_phrase"), g("full_name_cover"), g("corrected_overlap"), g("name_overlap"))
    meaning = F.greatest(g("semantic_name_overlap"), g("semantic_category_overlap"), g("sentence_similarity"))
    value = F.greatest(lexical, 0.60 * lexical + 0.20 * g("category_overlap") + 0.20 * meaning) if f else score / 12.0
    return F.round(F.least(F.lit(1.0), value), 6)

"""The text, alias, phrase and number rules held to cases; what is expected is stated outright."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import numbers as N
from spindrift.functions import phrases as H
from spindrift.functions import text as T
from spindrift.operators import aliases as A
from spindrift.operators import personal as Z
from spindrift.operators import rewrite as R

S = F.lit


def words(*xs: str) -> Column:
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def joined(c: Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def cases(spark, held: dict[str, Column]) -> dict[str, str | None]:
    """What each case gives, as text."""
    rows = [F.struct(F.lit(n).alias("name"), c.cast("string").alias("got")) for n, c in held.items()]
    return {r["name"]: r["got"] for r in spark.range(1).select(F.inline(F.array(*rows))).collect()}


TEXT_RULES = {
    "clean": "ООО Ромашка, Москва", "clean null": "", "tokens": "елка|5|ручка", "normal": "парацетамол таблетки 500 мг 10", "distinct": "стол|дуб|5|а1", "stem": "медицинск|ручк|шт|12345|стол|канцелярск",
    "stems": "ручк|син", "order": "b|a|c", "keywords": "поставка ручек синих школы", "kind works": "works", "kind services": "services", "kind goods": "goods", "codes": "n02bg|a15", "code same": "1.0", "code part": "0.8", "code none": "0.0",
    "pipes": "а|б", "number": "16", "half": "1.5", "plain": "12", "cut": "один…", "uncut": "один два",
    "variants": "full:поставка ручек синих|stripped:ручек синих", "compact": "поставка а1 а2 а3 а4 а5 а6 а7", "chosen": "stripped:ручек синих", "chosen none": None,
    "pseudo contract": "ручка", "pseudo name": "ручка", "pseudo contract_category": "канцтовары", "pseudo name_category": "ручка канцтовары", "pseudo name_category_attributes": "ручка канцтовары цвет",
    "document": "ручка ручка канцтовары цвет", "asked": "ручка синий pen", "asked fallback": "ручка", "broad": "true", "narrow": "false", "meets": "true", "meets not": "false", "meets nothing": "false",
    "phrase": "true", "part of a word": "false", "spans": "16 гб|500 мг",
}


def test_text_rules(spark):
    pseudo = T.pseudo_queries(S(""), S("Ручка"), S("Канцтовары"), S("Цвет"))
    listed = lambda v: joined(F.transform(v, lambda x: F.concat_ws(":", x["name"], x["text"])))
    chosen = lambda x: F.concat_ws(":", T.chosen_query(S(x))["name"], T.chosen_query(S(x))["text"])
    got = cases(spark, {
        "clean": T.clean_text(S('﻿"ООО  Ромашка,\tМосква"')), "clean null": T.clean_text(S(None).cast("string")), "tokens": joined(T.tokenize(S(" Ёлка, №5 Ручка"))),
        "normal": T.normalize_text(S("Парацетамол, таблетки 500 мг №10")), "distinct": joined(T.normalize_tokens(words("Стол", "и", "дуб", "стол", "5", "я", "А1"))),
        "stem": joined(F.transform(words("медицинские", "ручки", "шт", "12345", "столами", "канцелярская"), T.stem)), "stems": joined(T.stem_tokens(words("ручка", "ручки", "и", "синяя"))),
        "order": joined(T.unique_in_order(words("b", "a", "", "b", "c"))), "keywords": T.extract_keywords([S("Поставка ручек без n синих"), S("же для школы, ручек")]),
        "kind works": T.item_kind(S("Ремонт крыши"), S("услуги")), "kind services": T.item_kind(S("Услуга связи"), S("")), "kind goods": T.item_kind(S("Стол"), S("Мебель")),
        "codes": joined(T.category_codes(S("Анальгетики N02BG и A15"))), "code same": T.code_match(words("n02bg"), words("n02bg", "a15")), "code part": T.code_match(words("n02"), words("n02bg")), "code none": T.code_match(words("n02"), words("a15")),
        "pipes": joined(T.pipe_list(S(" а | |б"))), "number": T.humanize_number(S("16.00000")), "half": T.humanize_number(S("1.50")), "plain": T.humanize_number(S("12")), "cut": T.truncate_words(S("один два три"), 9), "uncut": T.truncate_words(S("один два"), 9),
        "variants": listed(T.query_variants(S("Поставка ручек, синих"))), "compact": F.element_at(F.filter(T.query_variants(S("Поставка а1 а2 а3 а4 а5 а6 а7 а8 а9")), lambda v: v["name"] == "compact"), 1)["text"],
        "chosen": chosen("Поставка ручек, синих"), "chosen none": T.chosen_query(S("Оказание услуг"))["text"], **{f"pseudo {n}": pseudo[n] for n in ("contract", "name", "contract_category", "name_category", "name_category_attributes")},
        "document": T.document_text(S("ручка"), S("канцтовары"), S("цвет")), "asked": T.asked_text(words("ручка", "синий"), words("pen", "ручка"), words(), words(), S("x")), "asked fallback": T.asked_text(words(), words(), words(), words(), S("Ручка")),
        "broad": T.needs_broad_retrieval(words("стол", "12"), S(False)), "narrow": T.needs_broad_retrieval(words("столик", "12"), S(False)),
        "meets": T.meets_expectation(S("Флеш-накопитель 16 Гб"), words("накопитель"), words("16 гб", "32 гб")), "meets not": T.meets_expectation(S("Флеш 8 Гб"), words("флеш"), words("16 гб")), "meets nothing": T.meets_expectation(S("Флеш"), words(), words()),
        "phrase": T.contains_phrase(words("флеш", "накопитель"), S("флеш накопитель")), "part of a word": T.contains_phrase(words("флеш", "накопитель"), S("флеш нак")),
        "spans": joined(F.transform(T.attribute_spans(S("Флешка 16 ГБ, 500мг и 16 гб")), lambda x: F.concat_ws(" ", x["value"], x["unit"]))),
    })
    assert got == TEXT_RULES


ALIAS_RULES = {
    "pair": "мфу=многофункциональное устройство:true", "pair of two": "usb хаб=концентратор портов:false", "roman": "", "inflected": "", "longer": "", "noise": "", "acronym": "true", "acronym latin": "true", "acronym no": "false", "acronym roman": "false",
    "bad empty": "true", "bad noise": "true", "bad word": "true", "bad digits": "true", "bad tiny": "true", "good": "false", "short": "true", "short no": "false", "adjective": "true", "adjective no": "false",
    "informative": "true", "too frequent": "false", "frequent abbreviation": "true", "frequent adjective": "false", "unknown": "false", "priority": "3.8439", "alike": "true", "one way": "false", "both ways": "true", "faint": "false", "same": "false", "everywhere": "false",
}


def test_alias_rules(spark):
    pairs = lambda x: joined(F.transform(A.bracketed(S(x)), lambda p: F.concat(p["alias"], S("="), p["base"], S(":"), p["short"].cast("string"))))
    allowed = lambda s, t, score, n, back, f, g: R.target_allowed(S(s), S(t), S(score), S(n), S(back).cast("double"), S(f), S(g))
    got = cases(spark, {
        "pair": pairs("Многофункциональное устройство (МФУ)"), "pair of two": pairs("Концентратор портов (USB ХАБ)"), "roman": pairs("Сталь марки (III)"), "inflected": pairs("Стол (столы)"), "longer": pairs("Стол (АБВГДЕЖ)"), "noise": pairs("Стол для школы (СДШ)"),
        "acronym": A.acronym_like(S("М.Ф.У.")), "acronym latin": A.acronym_like(S("usb3")), "acronym no": A.acronym_like(S("столы")), "acronym roman": A.acronym_like(S("xiv")),
        "bad empty": A.bad_alias(S("!")), "bad noise": A.bad_alias(S("стол для")), "bad word": A.bad_alias(S("цвет синий")), "bad digits": A.bad_alias(S("стол 5")), "bad tiny": A.bad_alias(S("аб вг")), "good": A.bad_alias(S("мфу")),
        "short": A.abbreviation_like(S("мфу")), "short no": A.abbreviation_like(S("ручка")), "adjective": A.adjective_like(S("медицинский")), "adjective no": A.adjective_like(S("стол")),
        "informative": R.informative(S("насос"), S(100)), "too frequent": R.informative(S("насосы"), S(15_000)), "frequent abbreviation": R.informative(S("мфу"), S(20_000)), "frequent adjective": R.informative(S("синий"), S(2_000)), "unknown": R.informative(S("насос"), S(0)),
        "priority": F.round(R.source_priority(S("мфу"), S(100), 230), 4),
        "alike": allowed("ручка", "ручки", 0.01, 1, None, 10, 10), "one way": allowed("насос", "труба", 0.3, 5, None, 10, 10), "both ways": allowed("насос", "труба", 0.3, 5, 0.2, 10, 10), "faint": allowed("насос", "труба", 0.07, 5, 0.2, 10, 10),
        "same": allowed("насос", "насос", 0.9, 5, 0.2, 10, 10), "everywhere": allowed("насос", "трубопровод", 0.9, 5, 0.2, 10, 20_000),
    })
    assert got == ALIAS_RULES


PHRASE_RULES = {
    "name": "анализатор мочи полуавтоматический", "name one": "", "name cut": "стул", "category": "анализаторы мочи", "product": "Альбумин", "product maker": "Ручка шариковая", "product pair": "Бумага офисная", "product none": "",
    "significant": "раствор|альбумин", "whole": "180.0", "later": "26.0", "none": "0.0", "stem": "38.0", "later stem": "18.0", "brief": "55.0", "brief first": "120.0", "first only": "0.0",
    "preview": "Назначение: для письма Цвет: - Вес: 1.5 Объем: 16", "preview long": "Ручка для письма на бумаге Тип: шариковая", "preview once": "Вес: 1 Длина: 2", "preview none": "",
    "keys": "Характеристики: а, б, в, г, д…", "keys few": "Характеристики: а, б", "label cart": "Продолжить подбор в этой категории", "label type": "По типу учреждения", "label own": "На основе ваших закупок", "label region": "Популярно в вашем регионе",
    "label peers": "Популярно у похожих заказчиков", "label session": "Продолжить подбор в этой категории", "label none": None, "label bounced": None, "corrected": "парацетамол", "uncorrected": None, "user": "u1", "user inn": "user-77", "user nobody": "anonymous", "session nobody": None,
    "neighbor": "накопитель", "neighbor mixed": "", "neighbor same": "", "neighbor short": "", "quality": "0.75", "quality blend": "0.7", "quality score": "0.5",
}


def test_phrase_rules(spark):
    label = lambda codes, category="", session=(), bounced=False: H.reason_label(words(*codes), S(category), words(*session), S(bounced))
    q = lambda **f: H.match_quality({k: S(v) for k, v in f.items()})
    got = cases(spark, {
        "name": H.name_phrase(S("Анализатор мочи полуавтоматический 5000 тестов"), S("анализ")), "name one": H.name_phrase(S("Стул 5"), S("стул на")), "name cut": H.name_phrase(S("Стул на 4 ножках"), S("сту")), "category": H.category_phrase(S("Анализаторы мочи 12 и")),
        "product": H.product_phrase(S("альбумин раствор для инфузий 10%")), "product maker": H.product_phrase(S("я ручка шариковая ООО Ромашка")), "product pair": H.product_phrase(S("аб бумага офисная а4")), "product none": H.product_phrase(S("5 шт")),
        "significant": joined(H.significant_tokens(S("Раствор 5 мг, г, альбумин таб"))), "whole": H.prefix_match(S("руч"), words("ручка", "синяя")), "later": H.prefix_match(S("син"), words("ручка", "синяя")), "none": H.prefix_match(S("стол"), words("ручка", "синяя")),
        "stem": H.prefix_match(S("ручками"), words("ручка", "синяя")), "later stem": H.prefix_match(S("синими"), words("ручка", "синяя")), "brief": H.prefix_match(S("си"), words("ручка", "синяя")), "brief first": H.prefix_match(S("ру"), words("ручка", "синяя")), "first only": H.prefix_match(S("си"), words("ручка", "синяя"), secondary=False),
        "preview": H.preview(S("Вес:1.50;Цвет:-;Назначение:для письма;Объем:16.00000")), "preview long": H.preview(S("Тип:шариковая;Описание:ручка для письма на бумаге;Вес:0.0")), "preview once": H.preview(S("Вес:1;Длина:2;Вес:3;Ширина:0")), "preview none": H.preview(S("Вес:0;Цвет")),
        "keys": H.fallback_preview(S("а|б|в|г|д|е")), "keys few": H.fallback_preview(S("а | |б")), "label cart": label(["SESSION_CART_BOOST", "USER_REPEAT_BUY"]), "label type": label(["INSTITUTION_TYPE_PREFIX_MATCH", "REGIONAL_POPULARITY"]), "label own": label(["SUPPLIER_AFFINITY", "REGIONAL_POPULARITY"]),
        "label region": label(["REGIONAL_POPULARITY", "SIMILAR_CUSTOMER_POPULARITY"]), "label peers": label(["SIMILAR_CUSTOMER_POPULARITY"]), "label session": label([], "Ручки", ["ручки"]), "label none": label([], "Ручки", ["столы"]), "label bounced": label(["SESSION_CART_BOOST"], bounced=True),
        "corrected": H.shown_correction(S("парацетамол"), S("парацетомол")), "uncorrected": H.shown_correction(S("стол"), S("стол")), "user": H.user_key(S("u1"), S("77")), "user inn": H.user_key(S(""), S("77")), "user nobody": H.user_key(S(None).cast("string"), S("")), "session nobody": H.user_key(S(None).cast("string"), S(""), anonymous=False),
        "neighbor": H.learned_neighbor(S("флешка"), S("Накопитель")), "neighbor mixed": H.learned_neighbor(S("флешка"), S("uсб")), "neighbor same": H.learned_neighbor(S("флешка"), S("флешка")), "neighbor short": H.learned_neighbor(S("флешка"), S("гб")),
        "quality": q(corrected_overlap=0.75, category_overlap=0.5), "quality blend": q(name_overlap=0.5, category_overlap=1.0, sentence_similarity=1.0), "quality score": H.match_quality({}, S(6.0)),
    })
    assert got == PHRASE_RULES


NUMBER_RULES = {
    "comma": "12.5", "word": "0.0", "word read": "false", "comma read": "true", "date": "2024-02-03", "date russian": "2024-03-02", "date zulu": "2024-02-03", "date none": None, "cosine": "0.6", "cosine zero": "0.0", "never": "3650.0", "future": "0.0", "boost": "0.5", "boost never": "0.0",
    "repeated": "a|a|b|b|b|b|b", "repeated cut": "a|a|b", "json": "5", "json broken": None, "bounds": "true", "bounds top": "false", "bounds score": "false", "bounds duration": "false", "bounds kind": "false", "key order": "true", "key null": "true",
    "session": "48.5", "session codes": "SESSION_CLICK_BOOST|SESSION_CART_BOOST|SESSION_CATEGORY_BOOST", "session tier": "100.0", "bounced": "-10.0",
}


def test_number_rules(spark):
    today = S("2024-05-01").cast("date")
    valid = lambda top=20, least=0.55, ms=100, kind="purchase": N.in_bounds(S(top), S(least), S(ms), S(kind), ("cart_add", "purchase"))
    score, codes, tier = Z.session_adjustment(S("i"), S("c"), words("i"), words("i"), words("c"), words("x"))
    v = lambda *xs: F.array(*[S(float(x)) for x in xs])
    key = lambda **c: N.cache_key("search", c)
    got = cases(spark, {
        "comma": N.lenient_double(S(" 12,5")), "word": N.lenient_double(S("дорого")), "word read": N.is_number(S("дорого")), "comma read": N.is_number(S("12,5")), "date": N.lenient_date(S("2024-02-03 10:00:00")), "date russian": N.lenient_date(S("02.03.2024")), "date zulu": N.lenient_date(S("2024-02-03T10:00:00Z")), "date none": N.lenient_date(S("нет")),
        "cosine": F.round(N.cosine(v(3, 4), v(1, 0)), 6), "cosine zero": N.cosine(v(0, 0), v(1, 0)), "never": N.recency_days(S(None).cast("date"), today), "future": N.recency_days(S("2024-06-01").cast("date"), today), "boost": N.recency_boost(S(45.0), 90.0), "boost never": N.recency_boost(S(3650.0), 90.0),
        "repeated": joined(N.repeated(words("a", "b", "c"), F.array(S(2), S(9), S(0)))), "repeated cut": joined(N.repeated(words("a", "b"), F.array(S(2), S(9)), most=3)), "json": N.json_field(S('{"a": 5}'), "a int")["a"], "json broken": N.json_field(S("{a"), "a int")["a"],
        "bounds": valid(), "bounds top": valid(top=51), "bounds score": valid(least=1.5), "bounds duration": valid(ms=-1), "bounds kind": valid(kind="look"), "key order": key(a=S(1), b=S("x")) == key(b=S("x"), a=S(1)), "key null": key(a=S(None).cast("int"), b=S("x")) != key(b=S("x")),
        "session": score, "session codes": joined(codes), "session tier": tier, "bounced": Z.session_adjustment(S("i"), S("c"), words(), words(), words(), words("c"))[0],
    })
    assert got == NUMBER_RULES

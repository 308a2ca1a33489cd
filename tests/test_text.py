from pyspark.sql import functions as F

from spindrift.functions import numbers as N
from spindrift.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalisation(spark):
    assert one(spark, T.normalize_text(F.lit('﻿ "Ёлка,  №5"\t Ручка '))) == "елка 5 ручка"
    assert one(spark, T.tokenize(F.lit(None).cast("string"))) == []


def test_stems(spark):
    words = F.array(*[F.lit(w) for w in ("медицинские", "ручки", "шт", "12345", "столами", "и")])
    assert one(spark, T.stem_tokens(words)) == ["медицинск", "ручк", "шт", "12345", "стол"]


def test_attribute_spans(spark):
    got = one(spark, T.attribute_spans(F.lit("флешка 16 гб usb 3 0, 500мг и 16 ГБ")))
    assert [(r["value"], r["unit"]) for r in got] == [("16", "гб"), ("500", "мг")]


def test_attributes(spark):
    got = one(spark, T.parse_attributes(F.lit("Цвет:черный;Ссылка:http://x;Вес;:пусто")))
    assert [(r["key"], r["value"]) for r in got] == [("Цвет", "черный"), ("Ссылка", "http://x"), ("Вес", "")]


def test_distance():
    assert T.distance_of("турба", "труба", 2) == 1
    assert T.distance_of("парацетомол", "парацетамол", 2) == 1
    assert T.distance_of("ca", "abc", 2) == 3
    assert T.distance_of("a", "abcd", 2) == 3


def test_ngrams(spark):
    assert one(spark, T.char_ngrams(F.lit("ab"))) == ["<ab", "ab>", "<ab>"]
    assert one(spark, T.jaccard(T.char_ngrams(F.lit("abc")), T.char_ngrams(F.lit("abc")))) == 1.0


def test_kinds_and_codes(spark):
    assert one(spark, T.item_kind(F.lit("Ремонт крыши"), F.lit("услуги"))) == "works"
    assert one(spark, T.item_kind(F.lit("Услуга связи"), F.lit(""))) == "services"
    assert one(spark, T.item_kind(F.lit("Стол"), F.lit("мебель"))) == "goods"
    assert one(spark, T.category_codes(F.lit("анальгетики N02BG и A15"))) == ["n02bg", "a15"]


def test_numbers(spark):
    assert one(spark, N.lenient_double(F.lit(" 12,5"))) == 12.5
    assert one(spark, N.lenient_double(F.lit("дорого"))) == 0.0
    assert str(one(spark, N.lenient_date(F.lit("2024-02-03T10:00:00Z")))) == "2024-02-03"
    assert one(spark, N.lenient_date(F.lit("нет"))) is None
    assert one(spark, N.skip_multiplier(F.lit(3))) == 0.6
    assert one(spark, N.skip_multiplier(F.lit(10))) == 0.4
    assert 1 < one(spark, N.cart_multiplier(F.lit(1))) < one(spark, N.cart_multiplier(F.lit(10))) < 1.15
    assert one(spark, N.cart_multiplier(F.lit(0))) == 1.0


def test_text_helpers(spark):
    assert one(spark, T.humanize_number(F.lit("16.00000"))) == "16"
    assert one(spark, T.humanize_number(F.lit("1.50"))) == "1.5"
    assert one(spark, T.pipe_list(F.lit(" a | |b"))) == ["a", "b"]
    assert one(spark, T.truncate_words(F.lit("один два три"), 9)) == "один…"
    tokens = F.array(F.lit("флеш"), F.lit("накопитель"))
    assert one(spark, T.contains_phrase(tokens, F.lit("флеш накопитель")))
    assert not one(spark, T.contains_phrase(tokens, F.lit("флеш нак")))
    got = one(spark, T.query_variants(F.lit("Поставка ручек, синих"), ("поставка",)))
    assert [(r["name"], r["text"]) for r in got] == [("full", "поставка ручек синих"), ("stripped", "ручек синих")]

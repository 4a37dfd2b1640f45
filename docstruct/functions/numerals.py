"""Numerals of several scripts as a table made by rule, and marker strings as scanners leave them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WIDE = "０１２３４５６７８９"
_KANJI, _FORMAL = "一二三四五六七八九", "壱弐参肆伍陸柒捌玖"
_ROMAN_TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC", "C"]
_ROMAN_ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
#: The circled numbers to 50, which stand in three runs of code points, and the single-character Roman ones to 12.
_CIRCLED = "".join(chr(start + i) for start, n in ((0x2460, 20), (0x3251, 15), (0x32B1, 15)) for i in range(n))
_ROMAN = "".join(chr(0x2160 + i) for i in range(12))


def numeral_table(spark: SparkSession, most: int = 100) -> DataFrame:
    """(marker, number): 1 to `most`, 100 at most, in ASCII and full-width digits, kanji (plain and formal), Roman letters, and in single characters as far as there are any."""
    n = F.col("number")
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i + 1)
    digit = lambda d: F.substring(F.lit(_KANJI), d, F.lit(1))
    kanji = F.when(n == 100, "百").otherwise(F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, digit(ones)).otherwise("")))
    single = lambda text: F.when(n <= len(text), F.substring(F.lit(text), n.cast("int"), F.lit(1)))
    plain = n.cast("string")
    forms = [plain, F.translate(plain, "0123456789", _WIDE), kanji, F.translate(kanji, _KANJI, _FORMAL), F.concat(pick(_ROMAN_TENS, tens), pick(_ROMAN_ONES, ones)), single(_ROMAN), single(_CIRCLED)]
    return spark.range(1, most + 1).withColumnRenamed("id", "number").select(F.explode(F.array_distinct(F.array_compact(F.array(*forms)))).alias("marker"), "number")


def clean_marker(marker: Column) -> Column:
    """A marker without what scanners misread: a doubled sign for 'question', and the sign that looks like it before a digit."""
    return F.regexp_replace(F.regexp_replace(marker, "問問+", "問"), "間(?=[0-9０-９])", "問")


def spoken_number(text: Column) -> Column:
    """The whole number below 10,000 that a text says in ASCII or full-width digits or in kanji with thousands, hundreds and tens ('八十', '二百五十', '１２０'); null if it says none."""
    plain = F.translate(text, _WIDE + _KANJI + "〇", "0123456789" + "123456789" + "0")
    shape = "^(?:([0-9]*)(千))?(?:([0-9]*)(百))?(?:([0-9]*)(十))?([0-9]*)$"
    part = lambda i: F.regexp_extract(plain, shape, i)
    place = lambda i, unit: F.when(part(i + 1) == "", 0).otherwise(F.coalesce(F.nullif(part(i), F.lit("")).try_cast("long"), F.lit(1)) * unit)
    total = place(1, 1000) + place(3, 100) + place(5, 10) + F.coalesce(F.nullif(part(7), F.lit("")).try_cast("long"), F.lit(0))
    return F.when(plain.rlike(shape) & (F.length(plain) > 0), total.cast("long"))

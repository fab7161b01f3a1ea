import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from peerband.functions import parse


def values(spark, parser, items):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, s string")
    return [r["v"] for r in rows.select("i", parser(F.col("s")).alias("v")).orderBy("i").collect()]


def test_money(spark):
    texts = ["$12,345,678.90", "$3", "$.25", " $8.5 ", "$-4.00", "€9", "$1.2.3", "", " ", None, "free"]
    assert values(spark, parse.money, texts) == [
        12345678.9, 3.0, 0.25, 8.5, -4.0, None, None, None, None, None, None]


def test_odd_number_spellings_are_missing(spark):
    odd = ["1.5d", "NaN", "Infinity", "1e999", "-1e999", "1f", "0x10", "--1", "9" * 400]
    assert values(spark, parse.to_double, odd) == [None] * len(odd)
    good = ["1e5", " 7 ", ".5", "5.", "1e150", "+2E-3", "1e-400", "9" * 300, "-0"]
    assert values(spark, parse.to_double, good) == [float(x) for x in good]


def test_flag_percent_bathrooms(spark):
    assert values(spark, parse.flag, ["f", "t", "F", "true", " t", None]) == [
        False, True, None, None, None, None]
    assert values(spark, parse.percent, ["7%", "250%", "12.5%", "0%", "%", "N/A", None]) == [
        0.07, 2.5, 0.125, 0.0, None, None, None]
    texts = ["3 baths", "4.5 baths", "half-bath private", "2 HALF baths", "no bath", "bath 6", None]
    assert values(spark, parse.bathrooms, texts) == [3.0, 4.5, 0.5, 0.5, None, 6.0, None]


def test_whole_numbers(spark):
    texts = ["+7", "12.", "30.000", "-4", "2e3", "9223372036854775807", " 5 ", "x", "", None]
    assert values(spark, parse.to_whole, texts) == [
        7, 12, 30, -4, 2000, 9223372036854775807, 5, None, None, None]
    for bad in ("2.0000000001", "0.5", "9223372036854775808", "1e40", "12345678901234567890123"):
        with pytest.raises(PySparkException, match="not whole"):
            values(spark, parse.to_whole, [bad])


def test_key_must_exist(spark):
    assert values(spark, parse.to_key, ["42", "1234567890123456789"]) == [42, 1234567890123456789]
    for bad in (None, "x", ""):
        with pytest.raises(PySparkException, match="not a number"):
            values(spark, parse.to_key, [bad])


GOOD_DATES = ["2024-02-29", " 2024-2-29 ", "2024-02-29T23:59", "2024-02-29 23:59:59.123Z",
              "2024-02-29T00:00:00+02:00"]
BAD_DATES = ["2024-02-30", "2024-02-29 junk", "2024-02-29T", "2024-02-29T25", "2024-02", "29/02/2024",
             "2024-02-291", "x2024-02-29", ""]


def test_dates_take_a_day_with_or_without_a_time_and_nothing_else(spark):
    import datetime

    leap = datetime.date(2024, 2, 29)
    assert values(spark, parse.to_date, GOOD_DATES) == [leap] * len(GOOD_DATES)
    assert values(spark, parse.date_strict, GOOD_DATES) == [leap] * len(GOOD_DATES)
    assert values(spark, parse.to_date, [*BAD_DATES, None]) == [None] * (len(BAD_DATES) + 1)
    for bad in BAD_DATES:
        with pytest.raises(PySparkException, match="not a date"):
            values(spark, parse.date_strict, [bad])


def test_strict_forms_fail_loudly(spark):
    assert values(spark, parse.money_strict, ["$1,000.50", None]) == [1000.5, None]
    for parser, bad in (
        (parse.money_strict, "abc"), (parse.bigint_strict, "x"), (parse.date_strict, "soon"),
    ):
        with pytest.raises(PySparkException, match="not a"):
            values(spark, parser, [bad])


def test_blank_key_text(spark):
    assert values(spark, parse.blank_to_null, ["", "a", None]) == [None, "a", None]


def mentions(df):
    """How often the optimized plan matches a pattern, by kind."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return {name: plan.lower().count(name) for name in ("rlike", "regexp_extract")}


@pytest.mark.parametrize("parser,matches", [
    (parse.to_double, 1), (parse.to_whole, 2), (parse.to_key, 2), (parse.bigint_strict, 2),
    (parse.money, 1), (parse.percent, 1), (parse.money_strict, 1),
])
def test_each_text_is_matched_once_per_pattern(spark, parser, matches):
    rows = spark.createDataFrame([("1",)], "c string").select(F.upper("c").alias("c"))
    found = mentions(rows.select(parser("c").alias("v")))
    assert found["rlike"] == 0 and found["regexp_extract"] == matches


def test_long_and_odd_spellings_of_whole_numbers(spark):
    texts = ["9007199254740993", "2.000", " 7 ", "1e3", "-0", "1e999", "nan", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["v"] for r in rows.select("i", parse.to_whole("t").alias("v")).orderBy("i").collect()]
    assert got == [9007199254740993, 2, 7, 1000, 0, None, None, None, None]

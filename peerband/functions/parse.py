"""Parsers for the text encodings found in listing and calendar dumps.

The lenient forms give NULL for text they cannot read; the strict forms fail the query.
A number is accepted only in plain decimal or exponent form, so spellings a cast would
take ("1.5d", "NaN", "Infinity") never reach the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"
WHOLE = r"^\s*([+-]?\d+)(\.0*)?\s*$"
# A date alone or with a time of day; nothing may follow.
DATE = (
    r"^\s*\d{4}-\d{1,2}-\d{1,2}"
    r"([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?\s*$"
)


def _text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it.

    Written out, every mention is a copy of the whole expression, and its patterns are matched
    as often.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _finite(number: Column) -> Column:
    return F.when(F.abs(number) < float("inf"), number)


def _number(text: Column) -> Column:
    """A plain number's value, which may be infinite; no match is empty and casts to NULL."""
    return F.regexp_extract(text, NUMBER, 1).try_cast("double")


def _read(text: Column) -> Column:
    """The text, its number and the digits of a whole number without an exponent."""
    return F.struct(
        text.alias("text"), _number(text).alias("number"),
        F.regexp_extract(text, WHOLE, 1).try_cast("bigint").alias("digits"),
    )


def to_double(c) -> Column:
    """Text to double; anything that is not a finite plain number becomes NULL."""
    return let(_number(_text(c)), _finite)


def _whole(read: Column, name: str, missing: Column) -> Column:
    """Plain digits are read as they stand, so long keys stay exact; other spellings by number."""
    number = read["number"]
    failure = F.raise_error(F.concat(F.lit(f"{name} is not whole: "), read["text"]))
    return F.when(_finite(number).isNull(), missing).otherwise(
        F.coalesce(
            read["digits"],
            # A double of 2^63 or more is whole, but a bigint ends one below.
            F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63),
                   number.try_cast("bigint")),
            failure.cast("bigint"),
        )
    )


def to_whole(c, name: str = "value") -> Column:
    """Text to nullable bigint. "2.0" is 2; a fractional number, or one out of range, fails the
    query."""
    return let(_read(_text(c)), lambda r: _whole(r, name, F.lit(None).cast("bigint")))


def to_key(c, name: str = "key") -> Column:
    """Text to non-null bigint; an unreadable or missing key fails the query."""
    def read(r):
        shown = F.coalesce(r["text"], F.lit("NULL"))
        failure = F.raise_error(F.concat(F.lit(f"{name} is not a number: "), shown))
        return _whole(r, name, failure.cast("bigint"))

    return let(_read(_text(c)), read)


def to_date(c) -> Column:
    text = _text(c)
    return F.when(text.rlike(DATE), F.trim(text).try_cast("date"))


def money(c) -> Column:
    """"$1,200.00" to 1200.0; blank or unreadable text to NULL. No currency conversion."""
    return to_double(F.regexp_replace(_text(c), "[$,]", ""))


def flag(c) -> Column:
    """'t' and 'f' to boolean, case sensitive; anything else to NULL."""
    text = _text(c)
    return F.when(text == "t", F.lit(True)).when(text == "f", F.lit(False))


def percent(c) -> Column:
    """"95%" to 0.95; no clamp to [0, 1]."""
    return to_double(F.replace(_text(c), F.lit("%"), F.lit(""))) / 100.0


def bathrooms(c) -> Column:
    """Bathroom count from free text; any mention of a half bath is 0.5."""
    text = _text(c)
    return F.when(text.rlike("(?i)half"), F.lit(0.5)).otherwise(
        F.regexp_extract(text, r"(\d+\.?\d*)", 1).try_cast("double")
    )


def blank_to_null(c) -> Column:
    return F.nullif(_text(c), F.lit(""))


def typed(df: DataFrame, name: str, parser, *types) -> Column:
    """``parser`` applied to a column, or the column itself where it is already typed."""
    return F.col(name) if isinstance(df.schema[name].dataType, types) else parser(F.col(name))


def _strict(value: Column, text: Column, what: str, kind: str) -> Column:
    failure = F.raise_error(F.concat(F.lit(f"not {what}: "), text))
    return F.coalesce(value, F.when(text.isNotNull(), failure.cast(kind)))


def money_strict(c) -> Column:
    """As ``money`` but unreadable text fails the query; NULL stays NULL."""
    text = _text(c)
    return _strict(money(text), text, "a price", "double")


def bigint_strict(c) -> Column:
    def read(r):
        rounded = F.round(_finite(r["number"])).try_cast("bigint")
        return _strict(F.coalesce(r["digits"], rounded), r["text"], "a whole number", "bigint")

    return let(_read(_text(c)), read)


def date_strict(c) -> Column:
    text = _text(c)
    return _strict(to_date(text), text, "a date", "date")

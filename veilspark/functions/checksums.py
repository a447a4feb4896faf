"""Check digits, as columns over strings of digits. Null or malformed digits are not valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i, 1).cast("int")


def _weighted(d: Column, weights) -> Column:
    return sum((_digit(d, i) * w for i, w in enumerate(weights, 1)), F.lit(0))


def days_in(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, fixed.DAYS)), month)


def valid_month_day(month: Column, day: Column) -> Column:
    """February has 29 days in any year."""
    return F.when(month.between(1, 12), day.between(1, days_in(F.when(month.between(1, 12), month).otherwise(1)))).otherwise(False)


def _plausible(d: Column) -> Column:
    return valid_month_day(F.substring(d, 3, 2).cast("int"), F.substring(d, 5, 2).cast("int"))


def _when(d: Column, shape: str, test: Column) -> Column:
    return F.when(F.coalesce(F.regexp_like(d, F.lit(shape)), F.lit(False)), test).otherwise(False)


def valid_rrn(d: Column) -> Column:
    check = (11 - _weighted(d, fixed.RRN_WEIGHTS) % 11) % 10
    return _when(d, "^[0-9]{13}$", _plausible(d) & (check == _digit(d, 13)))


def valid_foreigner(d: Column) -> Column:
    check = ((11 - _weighted(d, fixed.RRN_WEIGHTS) % 11) % 10 + 2) % 10
    return _when(d, "^[0-9]{6}[5-8][0-9]{6}$", _plausible(d) & (check == _digit(d, 13)))


def valid_business(d: Column) -> Column:
    total = _weighted(d, fixed.BUSINESS_WEIGHTS) + F.floor(_digit(d, 9) * 5 / 10)
    return _when(d, "^[0-9]{10}$", (10 - total % 10) % 10 == _digit(d, 10))


def valid_luhn(d: Column) -> Column:
    return _when(d, "^[0-9]{13,19}$", F.call_function("luhn_check", d) & ~F.regexp_like(d, F.lit("^0+$")))

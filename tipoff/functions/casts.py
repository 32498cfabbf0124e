"""Lenient casts from text columns: blank is null, a bad number is null, nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?i)^\s*[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity|nan)\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def to_double(c: Column | str) -> Column:
    """Text to double; the suffixes Java accepts (`7d`, `7f`) are not numbers here."""
    c = _col(c)
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def to_finite_double(c: Column | str) -> Column:
    """Like `to_double`, but true/false count as 1/0 and NaN or infinity is null."""
    c = _col(c)
    word = F.lower(F.trim(c))
    number = to_double(c)
    return (
        F.when(word == "true", F.lit(1.0))
        .when(word == "false", F.lit(0.0))
        .when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None).cast("double"))
        .otherwise(number)
    )


def to_int(c: Column | str) -> Column:
    """Whole numbers only: `7.0` is null."""
    c = _col(c)
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), c.try_cast("int"))


def to_int_via_double(c: Column | str) -> Column:
    """Whole part of any number: `7.0` is 7."""
    return to_double(c).try_cast("int")


def double_or_zero(c: Column | str) -> Column:
    return F.coalesce(to_double(c), F.lit(0.0))


def first_non_empty(*columns: Column | str) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def first_non_zero(a: Column, b: Column) -> Column:
    """`a` unless it is null or zero, else `b`."""
    return F.when(a.isNotNull() & (a != 0), a).otherwise(b)


def is_true(c: Column | str, words: tuple[str, ...] = ("1", "true", "t", "yes", "y")) -> Column:
    """Null counts as false."""
    return F.coalesce(F.lower(F.trim(_col(c).cast("string"))).isin(*words), F.lit(False))


def is_roster_flag(c: Column | str) -> Column:
    return is_true(c, ("true", "1", "yes", "y"))


def is_literal_true(c: Column | str) -> Column:
    return is_true(c, ("true",))


def dash_int(c: Column | str) -> Column:
    """Table cell to int where `-` and `--` mean nothing."""
    return to_int(F.trim(_col(c)))

"""Value helpers: seeded picks, dates, e-mail addresses, log sentinels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trilake.vocab import SENTINELS


def seeded_hash(number: Column, salt: int, seed: int = 42) -> Column:
    """A non-negative integer below 2^62 from `(number, salt, seed)` in plain 64-bit arithmetic.

    Two remainders side by side; the high one also takes in how often the modulus fits
    into the number, so numbers that the low one can not tell apart differ there. Only
    ``+ - * %`` and exact division on integers, so that SQL elsewhere gives the same values.
    """
    modulus = F.lit(2147483647)
    low_part = number % modulus
    turns = ((number - low_part) / modulus).cast("bigint")

    def spread(part: Column, step: int, first: int, second: int) -> Column:
        mixed = (part * F.lit(first) + F.lit(salt * 40503 + seed + step)) % modulus
        return (mixed * F.lit(second + 2 * salt)) % modulus

    high = spread((low_part + turns * F.lit(65537)) % modulus, 7919, 742938285, 950706376)
    return high * modulus + spread(low_part, 0, 48271, 69621)


def pick(choices: Sequence[str], hashed: Column) -> Column:
    """One of `choices`, by a non-negative hash."""
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (hashed % F.lit(len(choices)) + 1).cast("int"))


def uniform_int(hashed: Column, low: int, high: int) -> Column:
    """An integer in ``[low, high]``, by a non-negative hash."""
    return hashed % F.lit(high - low + 1) + F.lit(low)


def uniform_cents(hashed: Column, low: float, high: float) -> Column:
    """A double with two digits in ``[low, high]``, by a non-negative hash."""
    first, last = round(low * 100), round(high * 100)
    return uniform_int(hashed, first, last).cast("double") / F.lit(100.0)


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


def email_address(name: Column, blank: str = " ", domain: str = "example.com") -> Column:
    return F.concat(F.lower(F.replace(name, F.lit(blank), F.lit("."))), F.lit("@" + domain))


def mapped(key: Column, mapping: Mapping[str, object], default: object = None) -> Column:
    """Look a column up in a fixed mapping; `default` where the key is absent."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def clean_seconds(seconds: Column, digits: int = 5) -> Column:
    """Text of a measurement -> double; sentinels and unreadable text -> null."""
    value = F.when(~F.trim(seconds).isin(SENTINELS), seconds.try_cast("double"))
    return F.round(value, digits)

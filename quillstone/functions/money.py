"""Exact money, strict parsing and rounding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wide enough for sums of 31-digit amounts in cents.
WIDE = "decimal(38,0)"


def fail_unless(ok: Column, value: Column, message: str, shown: Column | None = None) -> Column:
    """value where ok holds; else an error that names the text. A null ok counts as a failure."""
    text = F.concat(F.lit(message + ": "), F.coalesce((value if shown is None else shown).cast("string"), F.lit("NULL")))
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(text))


def parse_cents(text: Column, *, signed: bool = False, wide: bool = False, longest: int | None = None) -> Column:
    """Dollars as text, with at most two places, to integer cents. Null stays null; anything else is an error.

    ``signed`` admits a minus sign; ``wide`` keeps decimals of any size that a bigint
    could not hold; ``longest`` bounds the text's length.
    """
    pattern = r"^-?[0-9]+(\.[0-9]{1,2})?$" if signed else r"^[0-9]+(\.[0-9]{1,2})?$"
    ok = text.rlike(pattern) & ~text.contains("\n")
    if longest:
        ok = ok & (F.length(text) <= longest)
    amount = F.round(text.cast("decimal(38,2)") * 100, 0).cast(WIDE if wide else "bigint")
    return F.when(text.isNull(), F.lit(None)).when(ok, amount).otherwise(F.raise_error(F.concat(F.lit("not an amount of money: "), text)))


def dollars(cents: Column) -> Column:
    """Cents as text with two places."""
    return (cents.cast("decimal(38,2)") / 100).cast("decimal(38,2)").cast("string")


def double_cents(amount: Column) -> Column:
    """A double of dollars to the nearest cent, halves away from zero."""
    return F.round(amount * F.lit(100.0), 0).cast("bigint")


def half_up(numerator: Column, denominator: Column) -> Column:
    """Exact quotient of two non-negative integers, halves up."""
    num, den = numerator.cast(WIDE), denominator.cast(WIDE)
    return F.floor((num * 2 + den) / (den * 2)).cast("bigint")


def strict_number(text: Column) -> Column:
    """Text to double; 'NONE' and null give null, other text that is no finite number an error."""
    value = text.try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(text.isNull() | (text == "NONE"), F.lit(None).cast("double")).otherwise(fail_unless(finite, value, "not a number", text))


def strict_integer(text: Column) -> Column:
    value = strict_number(text)
    return F.when(value.isNull(), F.lit(None).cast("int")).otherwise(fail_unless(value == F.floor(value), value.cast("int"), "not an integer", text))


def rate_scaled(text: Column, digits: int = 12) -> Column:
    """A decimal fraction as text to an integer of 10**-digits; longer or negative fractions are an error."""
    ok = text.rlike(rf"^[0-9]+(\.[0-9]{{1,{digits}}})?$")
    scaled = (text.cast(f"decimal(26,{digits})") * F.lit(10**digits).cast(f"decimal({digits + 1},0)")).cast(WIDE)
    return fail_unless(ok, scaled, "not a rate", text)

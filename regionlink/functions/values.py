"""Numbers in spreadsheets, and text for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import strip_space


def to_number(cell: Column, default: float | None = 0.0) -> Column:
    """The number in a cell of text: only digits, points and minus signs count, and outer parentheses negate.

    A column of numbers is taken as it is; as text, large and small ones would have an exponent, whose E does not count.
    default: for null, blank and unreadable cells. Decimal digits of other scripts are not read.
    """
    text = strip_space(cell.cast("string"))
    given = F.typeof(cell).rlike(r"^(tinyint|smallint|int|bigint|float|double|decimal\(.*)$")
    negated = text.startswith("(") & text.endswith(")")
    digits = F.regexp_replace(F.when(negated, F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))).otherwise(text), r"[^0-9.\-]", "")
    number = digits.try_cast("double")
    return F.coalesce(F.when(given, text.try_cast("double")).when(negated, -number).otherwise(number), F.lit(default).cast("double"))


def fixed(value: Column, pattern: Column | str) -> Column:
    """A number by a decimal pattern, without separators of thousands. The exact value is rounded; a tie goes to the even digit."""
    return F.replace(F.call_function("format_number", value, F.lit(pattern) if isinstance(pattern, str) else pattern), F.lit(","))


def plain(value: Column) -> Column:
    """A number in all its digits and without an exponent: to_number() reads the same number from it."""
    return fixed(value, "0." + "#" * 340)


def one_decimal(value: Column) -> Column:
    return fixed(value, "0.0")


def short_number(value: Column) -> Column:
    """1.2M, 3.4k, 56 or 7.8."""
    size = F.abs(value)
    return (
        F.when(size >= 1_000_000, F.concat(one_decimal(value / 1_000_000), F.lit("M")))
        .when(size >= 1_000, F.concat(one_decimal(value / 1_000), F.lit("k")))
        .when(value == F.floor(value), F.floor(value).cast("string"))
        .otherwise(one_decimal(value))
    )


def general(value: Column) -> Column:
    """A number in 6 significant digits without trailing zeros, with an exponent from 1e6 up and below 1e-4."""
    # the exponent is that of the rounded number
    rounded = fixed(value, "0.00000E00")
    exponent = F.substring_index(rounded, "E", -1).cast("int")
    digits = fixed(value, F.concat(F.lit("0."), F.repeat(F.lit("#"), F.greatest(5 - exponent, F.lit(0)))))
    # a formatter rounds ties up where there is an exponent; up to 1e15, whole numbers tell them
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - 5).cast("decimal(11,0)")
    exact = F.abs(value).cast("decimal(26,10)")
    parts = F.struct(exact.alias("x"), unit.alias("u"), F.call_function("div", exact, unit).cast("decimal(7,0)").alias("q"))
    beyond = lambda t: 2 * (t["x"] - t["q"] * t["u"])
    near = F.transform(F.array(parts), lambda t: t["q"].cast("int") + F.when((beyond(t) > t["u"]) | ((beyond(t) == t["u"]) & (t["q"] % 2 == 1)), 1).otherwise(0))
    digits_of = F.element_at(near, 1).cast("string")
    whole = F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.regexp_replace(F.concat(F.substring(digits_of, 1, 1), F.lit("."), F.substring(digits_of, 2, 5)), r"\.?0*$", ""))
    mantissa = F.when((exponent >= 6) & (exponent < 15), whole).otherwise(F.substring_index(fixed(value, "0.#####E0"), "E", 1))
    size = F.abs(exponent).cast("string")
    signed = F.concat(F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")))
    scientific = F.concat(mantissa, F.lit("e"), signed)
    plain = F.when((exponent >= -4) & (exponent < 6), F.regexp_replace(digits, r"\.$", "")).otherwise(scientific)
    return F.when(F.isnan(value), F.lit("nan")).when(F.abs(value) == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf"))).otherwise(plain)


def xml_escape(text: Column) -> Column:
    for raw, safe in _XML:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


_XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def class_of(value: Column, breaks: Column) -> Column:
    """The first class whose upper bound is not below the value; the last one if none is. Null without value or breaks."""
    last = F.size(breaks) - 1
    found = F.array_position(F.transform(breaks, lambda b: (value <= b) & ~F.isnan(value)), True)
    return F.when(value.isNotNull() & (F.size(breaks) > 0), F.when(found > 0, (found - 1).cast("int")).otherwise(last))

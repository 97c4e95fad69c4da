"""Number parsing and finite-value guards.

`NaN > 0` is true in Spark, so every comparison on a double that may hold NaN
goes through `is_finite`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_INF = float("inf")
_PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def is_finite(c: Column) -> Column:
    x = c.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(_INF)), F.lit(False))


def is_positive(c: Column) -> Column:
    return is_finite(c) & (c > 0)


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, inside a lambda function too, where a column named twice is computed twice."""
    return F.element_at(F.transform(F.array(c), use), 1)


def plain_number(text: Column) -> Column:
    """Finite double from plain decimal text, else null (no `1d`, `NaN` or blanks)."""
    t = F.trim(text)
    return finite_or_null(F.when(t.rlike(_PLAIN), t.try_cast("double")))


def reported_number(text: Column) -> Column:
    """`1,234.5` and accounting negatives `(1,234.5)`."""
    # What the pattern does not fit is empty, and no number. It admits no NaN.
    number = lambda t: F.regexp_extract(F.trim(t), _PLAIN, 0).try_cast("double")
    enclosed = lambda t: F.when(t.rlike(r"^\(.*\)$"), -number(F.regexp_replace(t, r"^\((.*)\)$", "$1"))).otherwise(number(t))
    value = once(F.trim(F.replace(text, F.lit(","), F.lit(""))), lambda t: F.when(F.startswith(t, F.lit("(")), enclosed(t)).otherwise(number(t)))
    return once(value, lambda x: F.when(F.abs(x) < F.lit(_INF), x))


def scaled_value(reported: Column, factor: Column, unit: Column) -> Column:
    """Percentages stay as reported; counts and money scale and round half-even."""
    return F.when(unit == "percent", reported).otherwise(F.rint(reported * factor))


def special_value(text: Column) -> Column:
    """Statistical table cell: `...`/`..` absent, `-` is zero, decimal comma allowed.

    Returns struct(status, value); status is VALUE, ABSENT or INVALID.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    number = plain_number(F.replace(t, F.lit(","), F.lit(".")))
    status = (
        F.when(t.isin("...", ".."), F.lit("ABSENT"))
        .when(t == "-", F.lit("VALUE"))
        .when(number.isNull(), F.lit("INVALID"))
        .otherwise(F.lit("VALUE"))
    )
    value = F.when(t.isin("...", ".."), F.lit(None).cast("double")).when(t == "-", F.lit(0.0)).otherwise(number)
    return F.struct(status.alias("status"), value.alias("value"))


def is_close(a: Column, b: Column, rel: float = 1e-12, absolute: float = 1e-12) -> Column:
    """Relative-or-absolute closeness; false for null and non-finite operands."""
    bound = F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return is_finite(a) & is_finite(b) & (F.abs(a - b) <= bound)


def significant_text(c: Column) -> Column:
    """Up to 15 significant digits without trailing zeros (C `%.15g`)."""
    x = c.cast("double")
    size = F.abs(x)
    # Nine whole digits and six decimals are 15 significant ones: where they give the number back, they are its text.
    short = x.try_cast("decimal(38,6)")
    is_short = (size >= 1e-4) & (size < 1e9) & (short.cast("double") == x)
    # All other numbers take much code. A lambda function keeps it out of the caller's generated method, which would else be too large to be compiled.
    return F.when(x == 0, F.lit("0")).when(is_short, F.rtrim(F.rtrim(short.cast("string"), F.lit("0")), F.lit("."))).otherwise(once(x, _rounded_text))


def _rounded_text(x: Column) -> Column:
    """The text of a number that has no short one.

    The decimal format with a pattern rounds half-even by the exact binary value; the printf-like
    one rounds the shortest decimal instead, which is wrong at ties. Subnormal numbers show their shortest digits.
    """
    size = F.abs(x)
    digits = F.call_function("format_number", size, F.lit("0.00000000000000E0"))
    # Above 1e15 only whole numbers below 2e16 can be ties; that format takes them for inexact.
    whole = lambda cut: F.bround(size.try_cast("long").cast("decimal(19,0)"), -cut).cast("string")
    exact = once(F.when(size < 1e16, whole(1)).otherwise(whole(2)), lambda w: F.concat(F.left(w, F.lit(1)), F.lit("."), F.substring(w, 2, 14), F.lit("E"), (F.length(w) - 1).cast("string")))
    digits = F.when((size >= 1e15) & (size < 2e16), exact).otherwise(digits)
    other = F.when(F.isnan(x), F.lit("nan")).otherwise(F.lit("inf"))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.when(is_finite(x), once(digits, _without_zeros)).otherwise(other))


def _without_zeros(digits: Column) -> Column:
    """Digits in scientific form to plain text, or to scientific text for exponents below -4 and from 15 on."""
    exponent = F.substring_index(digits, "E", -1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(F.substring_index(digits, "E", 1), r"0+$", ""), r"\.$", "")
    plain = F.regexp_replace(F.regexp_replace(F.replace(digits, F.lit("E"), F.lit("e")).try_cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when((exponent >= -4) & (exponent < 15), plain).otherwise(F.concat(mantissa, F.format_string("e%+03d", exponent)))

"""Numeric column functions: exact rounding, number texts, unit conversions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from norrsken.constants import EUR_RATES

_NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_SPLITTER = 134217729.0  # 2**27 + 1


def _round_scaled(x: Column, scale: Column | float) -> Column:
    product = x * scale
    whole = F.rint(product)
    gap = product - whole
    upper = x * _SPLITTER - (x * _SPLITTER - x)
    error = (upper * scale - product) + (x - upper) * scale
    step = F.when((F.abs(gap) == 0.5) & (error * gap > 0), gap * 2.0).otherwise(0.0)
    return (whole + step) / scale


def round_dp(x: Column, digits: int) -> Column:
    """Round to ``digits`` decimals by the exact binary value, ties to even.

    Spark's ``round`` works on the shortest decimal text (1.005 -> 1.01) and allocates a
    BigDecimal per row. Here the product with the power of ten is rounded with ``rint``, and only
    if it lands exactly between two integers its exact rounding error (from a split of x into
    two halves) says on which side the true value lies. Everything is plain double arithmetic.
    """
    return _round_scaled(x, float(10**digits))


def _trim_zeros(text: Column) -> Column:
    return F.regexp_replace(text, r"\.?0+$", "")


def compact_number(x: Column) -> Column:
    """Six significant digits without trailing zeros, as C's ``%g`` prints them.

    Pass a plain column: the expression mentions ``x`` many times.
    """
    exponent = F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), F.lit(5) - exponent)
    shown = _round_scaled(x, scale)
    plain = _trim_zeros(shown.try_cast("decimal(30,10)").cast("string"))
    # Mantissa and exponent form, for magnitudes of 1e6 and above or below 1e-4.
    unit = F.pow(F.lit(10.0), exponent - F.lit(5))
    six_digits = F.when(exponent > 5, F.rint(x / unit) * unit).otherwise(x)
    scientific = F.regexp_replace(F.format_string("%.5e", six_digits), r"\.?0*e", "e")
    return (
        F.when(x == 0, "0")
        .when((F.abs(x) >= 0.0001) & (F.abs(x) < 999999.5), plain)
        .when(x.isNotNull(), scientific)
    )


def fixed_text(x: Column, digits: int) -> Column:
    """Fixed number of decimals, rounded by the exact binary value."""
    sign = F.when(x < 0, "-").otherwise("")
    digits_text = F.format_string(f"%.{digits}f", round_dp(F.abs(x), digits))
    return F.when(x.isNotNull(), F.concat(sign, digits_text))


def percent_text(x: Column, signed: bool = False) -> Column:
    """Two decimals, trailing zeros cut, percent sign; optionally a plus sign."""
    body = F.concat(_trim_zeros(F.concat(fixed_text(F.abs(x), 2))), F.lit("%"))
    plus = F.when(x > 0, "+").otherwise("") if signed else F.lit("")
    return F.when(x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(plus), body))


def finite(x: Column) -> Column:
    """Non-finite numbers become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(text: Column) -> Column:
    """Text to double; anything that is not a number is null.

    The pattern keeps out suffixes such as ``10d`` that the JVM would read, and ``nan``, which
    Spark orders above every number.
    """
    digits = F.regexp_extract(text.cast("string"), _NUMBER_PATTERN, 0)
    return F.trim(digits).try_cast("double")


def market_number(text: Column) -> Column:
    """A number as market pages print it: ``+6.25%`` or ``10,116,648``."""
    return number(F.regexp_replace(text, "[,%]", ""))


def payload_number(value: Column) -> Column:
    """A payload value, given as its JSON text: plain or wrapped as ``{"raw": x}``.

    Booleans and other objects do not count.
    """
    wrapped = F.when(value.startswith("{"), F.get_json_object(value, "$.raw")).otherwise(value)
    return number(wrapped)


def eur_rate(currency: Column, rates: Mapping[str, float] = EUR_RATES) -> Column:
    """Rate to EUR, null for a currency without rate. ``rates`` is a handful of constants."""
    known = F.create_map(*(F.lit(part) for pair in rates.items() for part in pair))
    return F.try_element_at(known, F.upper(currency))


def as_percent(x: Column) -> Column:
    """Values from -1 to 1 are ratios; others are percentages already."""
    return F.when(x.between(-1.0, 1.0), x * 100.0).otherwise(x)

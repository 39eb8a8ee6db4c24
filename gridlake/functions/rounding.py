"""Rounding that agrees with correctly rounded decimal output of a binary double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Powers of two that turn a double below the bound into an exact 64-bit integer.
_UNITS = ((1.0, 1 << 62), (1024.0, 1 << 52), (1048576.0, 1 << 42), (1073741824.0, 1 << 32))
_EXACT_BELOW = _UNITS[-1][0]


def round_half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value of a double, ties to even.

    ``bround`` rounds the shortest decimal text of the double, so 2.675 (whose
    binary value is just below the tie) goes up.  Here the double is scaled by
    a power of two into an integer, which is exact, and rounded in integers.
    Values of 2**30 and more, beyond the exact range, fall back to ``bround``.

    The value is bound once by a one-element ``transform``; the plan would
    otherwise repeat its whole expression at every mention.
    """
    return F.call_function("transform", F.array(value.cast("double")), F.expr(_rounding_sql(digits)))[0]


def _rounding_sql(digits: int) -> str:
    """The rounding of a variable ``x`` as a SQL lambda."""
    tiers = " ".join(f"WHEN abs(x) < {bound}D THEN {unit}" for bound, unit in _UNITS)
    unit = f"CAST(CASE {tiers} END AS DECIMAL(20, 0))"
    steps = f"CAST(floor(IF(abs(x) < {_EXACT_BELOW}D, abs(x), NULL) * CAST({unit} AS DOUBLE)) AS DECIMAL(20, 0))"
    scaled = f"{steps} * CAST({10**digits} AS DECIMAL(7, 0))"
    whole = f"({scaled}) div {unit}"
    twice_rest = f"(({scaled}) % {unit}) * 2"
    up = f"{twice_rest} > {unit} OR ({twice_rest} = {unit} AND ({whole}) % 2 = 1)"
    exact = f"sign(x) * CAST(({whole}) + IF({up}, 1, 0) AS DOUBLE) / {float(10**digits)}D"
    slow = f"IF(abs(x) < {_EXACT_BELOW}D, {exact}, bround(x, {digits}))"
    # Away from a tie, plain double arithmetic gives the same result.
    moved = f"(x * {float(10**digits)}D)"
    clear = f"abs({moved}) < {_EXACT_BELOW}D AND abs({moved} - floor({moved}) - 0.5D) > 0.000001D"
    return f"x -> IF({clear}, rint({moved}) / {float(10**digits)}D, {slow})"


def fixed(value: Column, digits: int, sign: bool = False) -> Column:
    """The double as text with a fixed number of digits after the point."""
    flag = "+" if sign else ""
    return F.format_string(f"%{flag}.{digits}f", round_half_even(value, digits))


def percent_text(rate: Column) -> Column:
    """A 0..1 rate as whole percent, e.g. ``70%``."""
    return F.concat(fixed(rate * 100.0, 0), F.lit("%"))

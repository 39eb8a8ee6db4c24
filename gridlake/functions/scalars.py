"""Scalar rules of the race domain, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlake.functions.rounding import round_half_even

# Fixed values -------------------------------------------------------------
NOT_CLASSIFIED_STATUSES = ("retired", "did not start", "disqualified", "withdrawn")
NO_START_STATUSES = ("did not start", "withdrawn", "dns")
NO_START_POSITIONS = ("W", "DNS")
GRID_TIERS = (("front", 1, 4), ("midfield", 5, 10), ("lower", 11, 20))
SEASON_PHASES = (("Early", 1, 8), ("Middle", 9, 16), ("Late", 17, 24))
# --------------------------------------------------------------------------

_BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def best_qualifying_millis(q1: Column, q2: Column, q3: Column) -> Column:
    """The time of the deepest session reached, even if an earlier one was faster."""
    return F.coalesce(q3, q2, q1)


def _lower(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit("")))


def is_classified(position_text: Column, status: Column) -> Column:
    """A numeric position and no status that takes the finish away."""
    numeric = F.coalesce(position_text.rlike(r"\A[0-9]+\z"), F.lit(False))
    return numeric & ~_lower(status).isin(*NOT_CLASSIFIED_STATUSES)


def is_actual_start(status: Column, position_text: Column) -> Column:
    position = F.upper(F.coalesce(position_text, F.lit("")))
    return ~_lower(status).isin(*NO_START_STATUSES) & ~position.isin(*NO_START_POSITIONS)


def _attrition(position: Column, status: Column, raw_status: Column) -> Column:
    return (
        F.when(status.isin(*NO_START_STATUSES) | position.isin(*NO_START_POSITIONS), "DNS")
        .when((status == "disqualified") | (position == "D"), "DSQ")
        .when((status == "retired") | (position == "R"), "DNF")
        .when((position != "") | status.isin("finished", "lapped") | raw_status.startswith("+"), "CLASSIFIED")
        .otherwise("UNKNOWN_NON_CLASSIFIED")
    )


def attrition_class(position_text: Column, status: Column) -> Column:
    """Result state of loosely written source text: blanks and case do not matter."""
    position = F.upper(strip(F.coalesce(position_text, F.lit(""))))
    cleaned = strip(_lower(status))
    return _attrition(position, cleaned, cleaned)


def attrition_class_stored(position_text: Column, status: Column) -> Column:
    """Result state of stored rows: positions match exactly, nothing is trimmed."""
    text = F.coalesce(status, F.lit(""))
    return _attrition(F.coalesce(position_text, F.lit("")), F.lower(text), text)


def position_change(grid: Column, finish: Column) -> Column:
    """Places gained from grid to finish; NULL if either is unknown."""
    return grid - finish


def raced_position_change(grid: Column, finish: Column) -> Column:
    """Places gained, leaving out pit-lane starts (grid 0)."""
    return F.when(grid > 0, grid - finish)


def grid_tier(grid: Column) -> Column:
    tier = F.lit(None).cast("string")
    for name, low, high in GRID_TIERS:
        tier = F.when(grid.between(low, high), F.lit(name)).otherwise(tier)
    return tier


def rate_percent(part: Column, whole: Column) -> Column:
    """Percentage at two digits; 0.0 when there is nothing to divide by."""
    return F.when(whole > 0, round_half_even(part / whole * 100.0, 2)).otherwise(0.0)


def rate_percent_or_null(part: Column, whole: Column) -> Column:
    """Percentage at four digits; NULL when there is nothing to divide by."""
    return F.when(whole > 0, round_half_even(part / whole * 100, 4))


def ratio_or_null(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole > 0, round_half_even(part.cast("double") / whole, digits))


def evidence_strength(observations: Column, required: int | Column = 1) -> Column:
    needed = required if isinstance(required, Column) else F.lit(required)
    return (
        F.when((observations < needed) | (observations <= 0), "INSUFFICIENT")
        .when(observations == 1, "LOW")
        .when(observations <= 4, "MODERATE")
        .otherwise("HIGH")
    )


def evidence(
    total: Column,
    valid: Column,
    rounds: Column,
    required: int = 1,
    window: int | None = None,
    excluded: Column | None = None,
) -> Column:
    """Audit record of a sample: how much there was, how much counted, how strong it is."""
    return F.struct(
        total.cast("int").alias("total_races"),
        valid.cast("int").alias("valid_observations"),
        (F.greatest(F.lit(0), total - valid) if excluded is None else excluded)
        .cast("int")
        .alias("excluded_observations"),
        F.lit(required).alias("min_required_observations"),
        ((valid >= required) & (valid > 0)).alias("is_available"),
        evidence_strength(valid, required).alias("evidence_strength"),
        F.array_sort(rounds).alias("rounds_included"),
        F.lit(window).cast("int").alias("window_size_requested"),
    )


def full_name(given: Column, family: Column) -> Column:
    return F.concat_ws(" ", given, family)


def truncated_mean(total: Column, count: Column) -> Column:
    """Mean of whole milliseconds, cut to a whole millisecond; NULL without observations."""
    return F.when(count > 0, F.call_function("div", total, count))


def values_equal(old: Column, new: Column, numeric: bool = False) -> Column:
    """Null-safe equality; numbers compare by value whatever their type."""
    if numeric:
        old, new = old.cast("decimal(38,6)"), new.cast("decimal(38,6)")
    return old.eqNullSafe(new)


def round_span(rounds: Column, single: bool, empty: str) -> Column:
    """``rounds_2-9`` for a list of rounds; one round may read ``round_2``."""
    low, high = F.array_min(rounds), F.array_max(rounds)
    label = F.concat(F.lit("rounds_"), low, F.lit("-"), high)
    if single:
        label = F.when(low == high, F.concat(F.lit("round_"), low)).otherwise(label)
    return F.when(F.size(rounds) > 0, label).otherwise(F.lit(empty))


def any_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result

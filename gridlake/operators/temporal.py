"""Work along an ordered column: as-of join, interval join and running maximum.

All take any tables and any whole-number order column (a round, a lap, an
offset, a timestamp in milliseconds).  None puts a key into one task: as-of
join and running maximum split every key by ranges of the order column and
carry the last value from range to range, an interval join meets its points in
bins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def _boundaries(times: DataFrame, ranges: int) -> list[int]:
    """At most ``ranges - 1`` increasing values that cut the rows into about equal parts."""
    shares = [k / ranges for k in range(1, ranges)]
    found = times.agg(F.percentile_approx("_at", shares, 10_000)).head()[0] if shares else None
    return sorted(set(found or []))


def _range_of(at: Column, boundaries: list[int]) -> Column:
    """How many boundaries lie at or below the value."""
    if not boundaries:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, boundaries)), lambda b: b <= at))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def max_before(
    rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, ranges: int = RANGES
) -> DataFrame:
    """The rows with ``name``: the largest value of the rows of their key that come before in ``order``; else NULL.

    The first column of ``order`` holds whole numbers without nulls.  Its
    quantiles cut a key into ranges, each ordered on its own, and the maximum of
    the ranges before is carried from one row for each range; so a key of any
    length uses as many tasks as there are ranges.  Rows that are alike in
    ``order`` stand in any order.
    """
    cut = rows.withColumn("_at", F.col(order[0]).cast("long")).withColumn("_value", value)
    cut = cut.withColumn("_range", _range_of(F.col("_at"), _boundaries(cut, ranges)))
    earlier = Window.partitionBy(*[f"_{c}" for c in by]).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_of"))
        .agg(F.max("_value").alias("_most"))
        .withColumn("_carry", F.max("_most").over(earlier))
        .drop("_most")
    )
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = _all([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("_range") == F.col("_of")])
    joined = cut.join(carried, same)
    return joined.select(*rows.columns, F.greatest(F.max("_value").over(inside), F.col("_carry")).alias(name))


def as_of_join(
    left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], prefix: str, ranges: int = RANGES
) -> DataFrame:
    """``left`` with the values of the last ``right`` row of the same key at or before its own time.

    ``by`` and ``at`` are columns of both sides; ``values`` of the right come
    as ``prefix + name``, and its time as ``prefix + at``.  Of several right
    rows at one time the one with the largest values counts.  Left rows
    without an earlier right row, or with a null in ``by`` or ``at``, keep NULLs;
    right rows with a null there match nothing.  Repeated left rows stay.

    Only distinct times of a key are ordered, so a busy moment is one row.  The
    times are cut into ``ranges`` by their quantiles, which bounds what is
    gathered to that number; a window orders one range of one key, and the last
    value of the ranges before comes from one row for each range.
    """
    keys = [f"_key_{k}" for k in range(len(by))]

    def keyed(rows: DataFrame, state: Column) -> DataFrame:
        named = [F.col(c).alias(k) for c, k in zip(by, keys)]
        rows = rows.where(_all([F.col(c).isNotNull() for c in (*by, at)]))
        return rows.select(*named, F.col(at).cast("long").alias("_at"), state.alias("_state"))

    told = keyed(right, F.struct(F.col(at).alias("at"), F.struct(*values).alias("value")))
    asked = keyed(left, F.lit(None).cast(told.schema["_state"].dataType))
    moments = asked.unionByName(told).groupBy(*keys, "_at").agg(F.max("_state").alias("_state"))
    moments = moments.withColumn("_range", _range_of(F.col("_at"), _boundaries(moments, ranges)))

    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        moments.groupBy(*keys, "_range")
        .agg(F.max("_state").alias("_last"))
        .select(*keys, "_range", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    found = moments.join(carried, [*keys, "_range"]).select(
        *keys, "_at", F.coalesce(F.last("_state", ignorenulls=True).over(inside), F.col("_carry")).alias("_found")
    )
    same = [F.col(c) == F.col(k) for c, k in zip(by, keys)] + [F.col(at).cast("long") == F.col("_at")]
    return left.join(found, _all(same), "left").select(
        *left.columns,
        F.col("_found.at").alias(prefix + at),
        *[F.col(f"_found.value.{v}").alias(prefix + v) for v in values],
    )


def _bin(value: Column) -> Column:
    """The bin of a value at the row's level: bins are 2 ** level wide."""
    return F.call_function("shiftright", value, F.col("_level"))


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every point with every interval of the same key that holds it; both ends belong to it.

    Intervals may overlap and be of any length.  One goes into bins wider than
    itself, a power of two, so it lies in two of them at most; a point goes into
    one bin for each width that occurs, of which there are 63 at most (they are
    gathered).  The pairs of a bin are tested exactly, and no pair meets twice.
    Points and intervals with a null in a key or bound, and intervals that end
    before they start, match nothing; repeated rows count each.  Columns: those
    of the points, then those of the intervals but ``by``, which must differ.
    """
    rest = [c for c in intervals.columns if c not in by]
    keys = [f"_key_{k}" for k in range(len(by))]
    first, last = F.col(start).cast("long"), F.col(end).cast("long")
    spread = (
        intervals.where(first <= last)
        .withColumn("_level", F.length(F.bin(last - first)).cast("int"))
        .select(
            *[F.col(c).alias(k) for c, k in zip(by, keys)],
            F.struct(*rest).alias("_interval"),
            first.alias("_first"),
            last.alias("_last"),
            F.col("_level").alias("_width"),
            F.explode(F.sequence(_bin(first), _bin(last))).alias("_cell"),
        )
    )
    widths = sorted(r[0] for r in spread.select("_width").distinct().collect())
    listed = F.array(*map(F.lit, widths)) if widths else F.array().cast("array<int>")
    moment = F.col(at).cast("long")
    placed = points.withColumn("_level", F.explode(listed)).withColumn("_bin", _bin(moment))
    same = [F.col(c) == F.col(k) for c, k in zip(by, keys)]
    met = _all([*same, F.col("_level") == F.col("_width"), F.col("_bin") == F.col("_cell")])
    return (
        placed.join(spread, met)
        .where(moment.between(F.col("_first"), F.col("_last")))
        .select(*points.columns, *[F.col(f"_interval.{c}").alias(c) for c in rest])
    )

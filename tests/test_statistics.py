"""Statistics against Python's own."""

import random
import statistics as st
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridlake.operators import statistics


def expected(values):
    n = len(values)
    q = st.quantiles(values, n=4, method="inclusive") if n >= 2 else [None] * 3
    return (
        n,
        st.mean(values) if n else None,
        st.median(values) if n else None,
        st.stdev(values) if n >= 2 else None,
        min(values, default=None),
        max(values, default=None),
        q[0],
        q[2],
    )


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 40])
def test_describe(spark, size):
    rng = random.Random(size)
    values = [rng.randint(-20, 20) for _ in range(size)]
    frame = spark.createDataFrame([(v,) for v in [*values, None]], "x int")
    got = frame.agg(statistics.describe(F.col("x")).alias("s")).first().s
    want = expected(values)
    for g, w in zip(got, want):
        assert g == w or g == pytest.approx(w, rel=1e-12)


def test_spread_meets_a_threshold_exactly(spark):
    values = [1, 1, 4, 4, 1, 4, 4, 1, 4, 1]
    frame = spark.createDataFrame([(v,) for v in values], "x int").repartition(4)
    assert frame.agg(statistics.exact_stddev(F.col("x"))).first()[0] == st.stdev(values)
    points = [Decimal("0.50"), Decimal("1.00"), Decimal("25.00")]
    frame = spark.createDataFrame([(p,) for p in points], "x decimal(5,2)")
    assert frame.agg(statistics.exact_stddev(F.col("x"), 2)).first()[0] == pytest.approx(st.stdev(map(float, points)))


def test_consistency(spark):
    frame = spark.createDataFrame([(v,) for v in (1, 2, 6)], "x int")
    stats = frame.agg(statistics.describe(F.col("x")).alias("s"))
    row = stats.select(statistics.consistency(F.col("s"), allow_cv=True).alias("c")).first().c
    assert (row.range, row.coefficient_of_variation) == (5.0, pytest.approx(st.stdev([1, 2, 6]) / 3))
    assert stats.select(statistics.consistency(F.col("s")).alias("c")).first().c.coefficient_of_variation is None


@pytest.mark.parametrize("window", [1, 3, 5])
def test_rolling(spark, window):
    rng = random.Random(window)
    series = [(1, r, rng.choice([None, *range(1, 21)])) for r in range(1, 13) if r != 4]
    frame = spark.createDataFrame(series, "e int, round int, x int")
    rows = statistics.rolling_window_stats(frame, ["e"], (("x", "x", 0),), window).orderBy("round").collect()
    for i, row in enumerate(rows):
        part = series[max(0, i - window + 1) : i + 1]
        values = [x for _, _, x in part if x is not None]
        assert row.rounds_included == [r for _, r, _ in part]
        assert row.valid_observations == len(values)
        assert row.mean == (round(st.mean(values), 4) if values else None)
        assert row.median == (round(float(st.median(values)), 4) if values else None)
        assert row.stddev == (round(st.stdev(values), 4) if len(values) > 1 else None)
        assert row.evidence.excluded_observations == len(part) - len(values)


def test_distribution(spark):
    frame = spark.createDataFrame([(v,) for v in (3, -1, 0, 0, None)], "x int")
    row = frame.agg(statistics.position_change_summary(F.col("x")).alias("s")).first().s
    assert (row.distribution.positive_count, row.distribution.zero_rate) == (1, 0.5)
    assert (row.quality.total_observations, row.quality.excluded_observations) == (5, 1)

import random

import pytest
from pyspark.sql import functions as F

from gridlake.functions import scalars, timing
from gridlake.functions.rounding import fixed, percent_text, round_half_even


def column(spark, values, kind, expression):
    frame = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], kind)
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 4])
def test_rounding_equals_python(spark, digits):
    rng = random.Random(digits)
    values = [2.675, 2.665, 2.125, 2.135, -2.5, 0.5, 16.625, -0.125, 3203.95, 0.0]
    values += [rng.randint(0, 24) / rng.randint(1, 24) * 100 for _ in range(500)]
    values += [rng.randint(-10**6, 10**6) / 200 for _ in range(500)]
    got = column(spark, values, "i int, x double", round_half_even(F.col("x"), digits))
    assert got == [round(v, digits) for v in values]


def test_fixed_text(spark):
    values = [2.675, -1.5, 12.0, 0.125]
    assert column(spark, values, "i int, x double", fixed(F.col("x"), 2)) == [f"{v:.2f}" for v in values]
    assert column(spark, values, "i int, x double", fixed(F.col("x"), 2, sign=True)) == [f"{v:+.2f}" for v in values]
    assert column(spark, [0.7, 0.125], "i int, x double", percent_text(F.col("x"))) == ["70%", "12%"]


# Time texts with their milliseconds, and what is wrong with bad ones
TIMES = [
    ("1:06:40.125", 4000125, None),
    ("33:20.250", 2000250, None),
    ("1:12.040", 72040, None),
    ("23.405", 23405, None),
    ("+0.500", 500, None),
    ("+1:02.345", 62345, None),
    ("5.7", 5700, None),
    ("5.7425", 5742, None),
    (" 99:59 ", 5999000, None),
    ("", None, "empty time"),
    ("  ", None, "empty time"),
    ("abc", None, "malformed time"),
    ("1:2:3:4", None, "malformed time"),
    ("1:60", None, "invalid seconds"),
    ("1:60:00", None, "invalid minutes"),
    ("-1.5", None, "negative duration"),
    (None, None, None),
]


def test_durations(spark):
    texts = [t for t, _, _ in TIMES]
    assert column(spark, texts, "i int, t string", timing.time_to_millis(F.col("t"))) == [m for _, m, _ in TIMES]
    assert column(spark, texts, "i int, t string", timing.time_problem(F.col("t"))) == [p for _, _, p in TIMES]


def test_gaps(spark):
    texts = ["+22.457", "-1.5", "+1 Lap", "Lapped", " ", None, "1:99"]
    assert column(spark, texts, "i int, t string", timing.gap_to_millis(F.col("t"))) == [
        22457, -1500, None, None, None, None, None,
    ]
    assert column(spark, texts, "i int, t string", timing.gap_problem(F.col("t")))[-1] == "invalid seconds"


def test_time_texts_read_back(spark):
    millis = [0, 7, 59999, 60000, 5504742]
    for write in (timing.lap_text, timing.race_text, timing.seconds_text):
        text = write(F.col("m"))
        assert column(spark, millis, "i int, m bigint", timing.time_to_millis(text)) == millis


# Position text, status, state, classified finish, actual start
STATES = [
    ("R", "Retired", "DNF", False, True),
    ("17", "Retired", "DNF", False, True),
    ("W", "Did not start", "DNS", False, False),
    ("D", "Disqualified", "DSQ", False, True),
    ("15", "Lapped", "CLASSIFIED", True, True),
    ("17", "Engine", "CLASSIFIED", True, True),
    ("", "", "UNKNOWN_NON_CLASSIFIED", False, True),
    (None, None, "UNKNOWN_NON_CLASSIFIED", False, True),
    ("", "+1 Lap", "CLASSIFIED", False, True),
    ("dns", "Finished", "DNS", False, False),
    (" r ", "x", "DNF", False, True),
]


def test_result_states(spark):
    rows = [(p, s) for p, s, *_ in STATES]
    kind = "i int, p string, s string"
    p, s = F.col("p"), F.col("s")
    assert column(spark, rows, kind, scalars.attrition_class(p, s)) == [r[2] for r in STATES]
    assert column(spark, rows, kind, scalars.is_classified(p, s)) == [r[3] for r in STATES]
    assert column(spark, rows, kind, scalars.is_actual_start(s, p)) == [r[4] for r in STATES]


def test_stored_states_are_literal(spark):
    rows = [("r", "x"), (" D", "x"), ("", "finished"), ("R", "Engine")]
    got = column(spark, rows, "i int, p string, s string", scalars.attrition_class_stored(F.col("p"), F.col("s")))
    assert got == ["CLASSIFIED", "CLASSIFIED", "CLASSIFIED", "DNF"]


def test_small_rules(spark):
    assert column(spark, [0, 1, 4, 5, 10, 11, 20, 21, None], "i int, g int", scalars.grid_tier(F.col("g"))) == [
        None, "front", "front", "midfield", "midfield", "lower", "lower", None, None,
    ]
    assert column(spark, [0, 1, 2, 4, 5], "i int, n int", scalars.evidence_strength(F.col("n"))) == [
        "INSUFFICIENT", "LOW", "MODERATE", "MODERATE", "HIGH",
    ]
    assert column(spark, [2, 3], "i int, n int", scalars.evidence_strength(F.col("n"), 3)) == ["INSUFFICIENT", "MODERATE"]
    q = scalars.best_qualifying_millis(F.col("a"), F.col("b"), F.col("c"))
    assert column(spark, [(90, 80, 85), (90, 80, None), (90, None, None)], "i int, a int, b int, c int", q) == [85, 80, 90]
    rate = scalars.rate_percent(F.col("a"), F.col("b"))
    assert column(spark, [(1, 3), (0, 0), (1, 8)], "i int, a int, b int", rate) == [33.33, 0.0, 12.5]
    span = scalars.round_span(F.col("r"), single=True, empty="none")
    assert column(spark, [([3],), ([9, 2],), ([],)], "i int, r array<int>", span) == ["round_3", "rounds_2-9", "none"]
    equal = scalars.values_equal(F.col("a"), F.col("b"), numeric=True)
    kind = "i int, a decimal(5,2), b int"
    from decimal import Decimal

    assert column(spark, [(Decimal("26.00"), 26), (None, None), (None, 1)], kind, equal) == [True, True, False]

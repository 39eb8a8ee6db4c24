"""Numbering and repeating rows of very uneven groups, against brute force."""

import random

from pyspark.sql import functions as F

from gridlake.operators import numbering


def test_numbers_follow_the_order(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(8), v, rng.randint(1, 4)) for g in ("hot", "cold") for v in range(200 if g == "hot" else 5)]
    frame = spark.createDataFrame(rows, "g string, slot int, v int, copies bigint")
    counters = {"all": F.lit(True), "even": F.col("v") % 2 == 0}
    got = {
        (r.g, r.v): (r["all"], r.even)
        for r in numbering.number_within(frame, ["g"], "slot", ["v"], "copies", counters).collect()
    }
    for g in ("hot", "cold"):
        total = even = 0
        for _, _, v, copies in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            total += copies
            even += copies if v % 2 == 0 else 0
            assert got[(g, v)] == (total, even)


def test_copies_are_all_written(spark, monkeypatch):
    monkeypatch.setattr(numbering, "COPIES_PER_PIECE", 10)
    frame = spark.createDataFrame([("a", 1), ("b", 7), ("c", 137)], "k string, n bigint")
    got = numbering.repeat_rows(frame, "n", "i").groupBy("k").agg(
        F.count("*").alias("rows"), F.countDistinct("i").alias("distinct"), F.min("i").alias("low"), F.max("i").alias("high")
    )
    assert {tuple(r) for r in got.collect()} == {("a", 1, 1, 0, 0), ("b", 7, 7, 0, 6), ("c", 137, 137, 0, 136)}

"""Registered queries: page parsing, with pages rendered from the race tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions import timing
from gridlake.plans.catalog_event import over_star
from gridlake.sources import pages
from gridlake.sources.landing import landed_pages
from gridlake.tables import RaceTables

_DROPPED = {
    "seasons": [],
    "circuits": ["url"],
    "constructors": ["url"],
    "drivers": ["url"],
    "races": ["url"],
    "race_results": [],
    "qualifying_results": [],
    "sprint_results": [],
    "pit_stops": [],
    "lap_times": [],
    "driver_standings": [],
    "constructor_standings": [],
}


def _parse(entity: str):
    def view(t: RaceTables) -> DataFrame:
        parsed = pages.PARSERS[entity](landed_pages(t, entity))
        return pages.accepted(parsed).drop(*_DROPPED[entity])

    return view


def _rejects(t: RaceTables) -> DataFrame:
    parsed = pages.parse_race_results(landed_pages(t, "race_results"))
    return pages.rejected(parsed).select("season_year", "round", "driver_id", "reject_reason")


def _wrong_table(t: RaceTables) -> DataFrame:
    """Standings pages read as race results: every page lacks its table."""
    parsed = pages.parse_race_results(landed_pages(t, "driver_standings"))
    return parsed.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rejected"))


def _documents_as_pages(spark, root: str) -> DataFrame:
    """Free text is no page: each document is turned away whole."""
    texts = spark.read.parquet(f"{root}/documents.parquet").select(F.col("text").alias("payload"))
    parsed = pages.parse_race_results(texts)
    return parsed.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rejected"))


def _raw_records(t: RaceTables) -> DataFrame:
    rows = pages.raw_records(landed_pages(t, "circuits"), "Circuits", "CircuitTable")
    return rows.select(
        F.get_json_object("record", "$.circuitId").alias("circuit_id"),
        F.get_json_object("record", "$.Location.country").alias("country"),
    )


_PAGE = 4


def result_pages(t: RaceTables) -> DataFrame:
    """Result pages of four records per race; by season whole, or with a fault.

    Faults by the season's remainder of 5: 1 the second page is missing; 2 it
    begins two records early; 3 it is missing and the third begins two early; 4 the
    last page is missing.
    """
    kind, number, total = F.col("season_year") % 5, F.col("number"), F.col("total")
    last = F.ceil(total / _PAGE) - 1
    cars = t.race_results.groupBy("season_year", "round").agg(F.count(F.lit(1)).alias("total"))
    listed = cars.withColumn("number", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    missing = (kind.isin(1, 3) & (number == 1)) | ((kind == 4) & (number == last))
    early = F.when((kind == 2) & (number == 1), 2).when((kind == 3) & (number == 2), 2).otherwise(0)
    paging = F.struct(
        F.lit(str(_PAGE)).alias("limit"),
        (number * _PAGE - early).cast("string").alias("offset"),
        total.cast("string").alias("total"),
        F.struct("season_year", "round").alias("RaceTable"),
    )
    endpoint = F.concat_ws("/", "season_year", "round", F.lit("results"))
    return listed.where(~missing).select(endpoint.alias("endpoint"), F.to_json(F.struct(paging.alias("MRData"))).alias("payload"))


def _series_audit(t: RaceTables) -> DataFrame:
    return pages.page_series_audit(result_pages(t))


def _metadata(t: RaceTables) -> DataFrame:
    return pages.page_metadata(landed_pages(t, "driver_standings")).select(
        "endpoint", "limit", "offset", "total", F.array_join("tables", ",").alias("tables"), "reject_reason"
    )


def _gaps(t: RaceTables) -> DataFrame:
    text = F.col("time_text")
    shown = F.when(F.col("status") == "+1 Lap", F.col("status")).otherwise(text)
    return t.race_results.select(
        "season_year",
        "round",
        "driver_id",
        shown.alias("gap_text"),
        timing.gap_to_millis(shown).alias("gap_millis"),
        timing.gap_problem(shown).alias("problem"),
    )


QUERIES = {f"parse_{entity}": over_star(_parse(entity)) for entity in _DROPPED}
QUERIES |= {
    "parse_rejects": over_star(_rejects),
    "parse_wrong_table": over_star(_wrong_table),
    "parse_documents": _documents_as_pages,
    "raw_records": over_star(_raw_records),
    "page_series": over_star(_series_audit),
    "page_metadata": over_star(_metadata),
    "gap_times": over_star(_gaps),
}

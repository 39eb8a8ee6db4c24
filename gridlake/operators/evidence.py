"""Evidence packages from insights, and checks of narratives against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.rounding import round_half_even
from gridlake.functions.scalars import strip
from gridlake.operators.insights import SORT_ORDER

# Fixed values ---------------------------------------------------------------
MAX_INSIGHTS = 10
LIMITATIONS = (
    "Telemetry, tyre compound/degradation, and weather data are absent from this evidence package; do not invent "
    "technical causes.",
    "The database and deterministic analytics are the sole source of truth; no external knowledge may be introduced.",
)
LOW_EVIDENCE_NOTE = (
    "One or more insights have LOW evidence strength (sample size = 1); describe as an isolated session/race "
    "observation and NOT as a persistent trend."
)
LONGITUDINAL_NOTE = (
    "Longitudinal findings describe only the supplied rounds in the observed season; do not extrapolate beyond the "
    "observed sample, make career-level conclusions, or predict future performance."
)
SLOWER_WORDS = "slower|deficit|behind"
LOST_WORDS = "lost positions|dropped positions|lost ground"
GAINED_WORDS = "gained positions|moved up|improved position"
FINISHED_WORDS = "finished all|completed all|finished every|no dnfs?|never retired|100% finish"
RATIO_PATTERN = r"\b(\d+)\s+(?:of|out of)\s+(\d+)\b"
SCORE_PATTERN = r"\b(\d+)\s*-\s*(\d+)\b"
FINISHES_PATTERN = r"\bacross\s+(\d+)\s+valid finishes\b"
# ----------------------------------------------------------------------------


def numbered(insights: DataFrame, package: list[str], limit: int = MAX_INSIGHTS) -> DataFrame:
    """The first insights of each package in their usual order, with their number.

    Spark keeps only the first rows of each group before the shuffle, so a
    large package does not travel whole.
    """
    order = Window.partitionBy(*package).orderBy(*SORT_ORDER)
    return insights.withColumn("insight_no", F.row_number().over(order)).where(F.col("insight_no") <= limit)


def is_longitudinal() -> Column:
    rounds = F.size(F.coalesce("traceability.rounds_included", F.array().cast("array<int>")))
    return F.col("rule_id").startswith("LONGITUDINAL_") | (rounds > 1)


def _fields(*columns: Column) -> Column:
    """The members of a JSON object, without its braces and with nulls kept."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.regexp_replace(text, r"\A\{|\}\z", "")


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def evidence_records(insights: DataFrame) -> DataFrame:
    """Insights with a ``record`` column, the JSON a narrative may rest on."""
    trace = F.col("traceability")
    longitudinal = is_longitudinal()
    sample = [
        F.col("sample_size").alias("valid_observations"),
        F.coalesce(trace["excluded_observations"], F.lit(0)).alias("excluded_observations"),
        F.coalesce(trace["rounds_included"], F.array().cast("array<int>")).alias("rounds_included"),
    ]
    sampled = F.when(longitudinal, _fields(*sample))
    kept = ("source_metric", "source_function", "observed_value", "sign_convention", "season_year", "round_num")
    trail = _object(
        _fields(
            *[trace[c].alias(c) for c in kept],
            trace["rule_parameters"].alias("threshold"),
            trace["minimum_sample_size"].alias("minimum_sample_size"),
        ),
        sampled,
    )
    facts = _fields(
        "insight_id",
        F.when(longitudinal, "longitudinal").otherwise("race").alias("scope"),
        "rule_id",
        "category",
        trace["season_year"].alias("season"),
        "subject_id",
        "comparison_subject_id",
        "metric",
        "direction",
        "magnitude",
        "unit",
        "evidence_strength",
        "sample_size",
    )
    said = F.when(F.length("explanation") > 0, _fields("explanation"))
    record = _object(facts, F.concat(F.lit('"traceability":'), trail), sampled, said)
    return insights.withColumn("record", record)


def evidence_packages(insights: DataFrame, package: list[str], limit: int = MAX_INSIGHTS) -> DataFrame:
    """One JSON payload per package: its first insights and what they do not cover."""
    rows = evidence_records(numbered(insights, package, limit))
    grouped = rows.groupBy(*package).agg(
        F.array_sort(F.collect_list(F.struct("insight_no", "record"))).getField("record").alias("records"),
        F.bool_or(F.col("evidence_strength") == "LOW").alias("has_low"),
        F.bool_or(is_longitudinal()).alias("has_longitudinal"),
    )
    notes = F.array_compact(
        F.array(
            *[F.lit(text) for text in LIMITATIONS],
            F.when(F.col("has_low"), LOW_EVIDENCE_NOTE),
            F.when(F.col("has_longitudinal"), LONGITUDINAL_NOTE),
        )
    )
    payload = F.concat(
        F.lit('{"insights":['), F.array_join("records", ","), F.lit('],"limitations":'), F.to_json("notes"), F.lit("}")
    )
    return grouped.withColumn("notes", notes).select(
        *package, F.size("records").alias("insights"), F.col("notes").alias("limitations"), payload.alias("payload")
    )


def parse_narratives(narratives: DataFrame, raw: str = "raw") -> DataFrame:
    """Narrative, limitations and references of each raw answer, and why it is unusable."""
    text = strip(F.col(raw))
    opened = F.regexp_replace(text, r"\A```[^\n]*(\n|\z)", "")
    closed = F.regexp_replace(opened, r"(\A|\n)[ \t]*```[ \t]*\z", "")
    body = F.when(text.startswith("```"), strip(closed)).otherwise(text)

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("_v", path, "variant")), F.lit("MISSING"))

    story = F.try_variant_get("_v", "$.narrative", "string")
    problem = (
        F.when(F.coalesce(text, F.lit("")) == "", "empty response")
        .when(F.col("_v").isNull(), "not valid JSON")
        .when(~kind("$").startswith("OBJECT"), "not a JSON object")
        .when((kind("$.narrative") != "STRING") | (strip(story) == ""), "narrative is not a non-empty string")
        .when(~kind("$.limitations").startswith("ARRAY"), "limitations is not a list")
        .when(~kind("$.evidence_references").startswith("ARRAY"), "evidence_references is not a list")
    )
    return narratives.withColumn("_v", F.try_parse_json(body)).select(
        *narratives.columns,
        strip(story).alias("narrative"),
        F.try_variant_get("_v", "$.limitations", "array<string>").alias("limitations"),
        F.try_variant_get("_v", "$.evidence_references", "array<string>").alias("evidence_references"),
        problem.alias("problem"),
    )


def _word(text: Column) -> Column:
    return F.concat(F.lit(r"\b\Q"), text, F.lit(r"\E\b"))


def _claims(pattern: str, groups: int, text: Column, wrong) -> Column:
    """Whether any match of the pattern makes a wrong claim."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g + 1)) for g in range(groups)]
    claims = F.arrays_zip(*[f.alias(f"g{i}") for i, f in enumerate(found)]) if groups > 1 else found[0]

    def number(claim: Column, group: int) -> Column:
        return (claim[f"g{group}"] if groups > 1 else claim).try_cast("bigint")

    return F.exists(claims, lambda c: F.coalesce(wrong(*[number(c, g) for g in range(groups)]), F.lit(False)))


def _contradictions() -> list[tuple[str, Column]]:
    """Each check's name and when it fails, for a narrative row joined to an insight."""
    text = F.lower("narrative")
    subject, other = F.lower("subject_id"), F.lower(F.coalesce("comparison_subject_id", F.lit("")))
    trace, size = F.col("traceability"), F.col("sample_size").cast("bigint")
    rounds = F.size(F.coalesce(trace["rounds_included"], F.array().cast("array<int>")))
    excluded = F.coalesce(trace["excluded_observations"], F.lit(0))

    def says(words: str, *tail: Column) -> Column:
        return F.regexp_like(text, F.concat(_word(subject), F.lit(rf".*?\b({words})\b"), *tail))

    races = F.when(rounds > 0, rounds).otherwise(size + excluded)
    all_races = F.regexp_like(text, F.concat(F.lit(r"\b(finished all|completed all)\s+"), races.cast("string"), F.lit(r"\b")))
    expected = round_half_even(F.col("magnitude") * F.col("sample_size"), 0).cast("bigint")
    has_record = F.col("metric").isin("qualifying_win_rate", "race_win_rate") & F.col("magnitude").isNotNull() & (size > 0)
    return [
        (
            "says slower, evidence says faster",
            (F.col("direction") == "faster") & (other != "") & says(SLOWER_WORDS, F.lit(".*?"), _word(other)),
        ),
        ("says positions lost, evidence says gained", (F.col("direction") == "gained") & says(LOST_WORDS)),
        ("says positions gained, evidence says lost", (F.col("direction") == "lost") & says(GAINED_WORDS)),
        ("says all races finished, evidence excludes some", (excluded > 0) & (says(FINISHED_WORDS) | all_races)),
        (
            "states a wrong win ratio",
            has_record & _claims(RATIO_PATTERN, 2, text, lambda won, of: (of == size) & (won != expected)),
        ),
        (
            "states a wrong score",
            has_record & _claims(SCORE_PATTERN, 2, text, lambda won, lost: (won + lost == size) & (won != expected)),
        ),
        (
            "states a wrong number of finishes",
            (F.col("rule_id") == "LONGITUDINAL_RECENT_FORM")
            & _claims(FINISHES_PATTERN, 1, text, lambda finishes: finishes != size),
        ),
    ]


def check_narratives(
    narratives: DataFrame,
    insights: DataFrame,
    package: list[str],
    raw: str = "raw",
    limit: int = MAX_INSIGHTS,
    narrative_id: str | None = None,
) -> DataFrame:
    """A verdict per narrative: usable, or the first thing that is wrong with it.

    A package may have any number of narratives, told apart by ``narrative_id``
    or, without it, by their text.

    Insights are checked in order and every insight's checks in order; a
    narrative meets at most ``limit`` insights.
    """
    key = F.col(narrative_id) if narrative_id else F.sha2(F.coalesce(F.col(raw), F.lit("")), 256)
    parsed = parse_narratives(narratives, raw).withColumn("_narrative", key)
    evidence = numbered(insights, package, limit)
    checks = _contradictions()
    verdict = F.lit(None).cast("struct<check_no:int,reason:string>")
    for number, (name, fails) in reversed(list(enumerate(checks, 1))):
        found = F.struct(F.lit(number).alias("check_no"), F.lit(name).alias("reason"))
        verdict = F.when(F.coalesce(fails, F.lit(False)), found).otherwise(verdict)
    wrong = (
        parsed.where(F.col("problem").isNull())
        .select(*package, "_narrative", "narrative")
        .dropDuplicates([*package, "_narrative"])
        .join(evidence, package)
        .select(*package, "_narrative", "insight_no", "insight_id", verdict.alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy(*package, "_narrative")
        .agg(
            F.min_by(
                F.struct(F.col("v.reason").alias("reason"), "insight_id"), F.struct("insight_no", "v.check_no")
            ).alias("first")
        )
    )
    reason = F.coalesce("problem", "first.reason")
    return parsed.join(wrong, [*package, "_narrative"], "left").select(
        *package,
        *([narrative_id] if narrative_id else []),
        F.when(reason.isNull(), "ok").otherwise("unavailable").alias("status"),
        reason.alias("reason"),
        F.col("first.insight_id").alias("contradicted_insight"),
        "narrative",
        "limitations",
        "evidence_references",
    )

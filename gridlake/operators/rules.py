"""The insight rules: identity, category, metric, sample size and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Thresholds --------------------------------------------------
LARGE_GAIN = 5.0
FAST_STOP_MILLIS = 25000.0
STOP_SPREAD_MILLIS = 1500.0
GRID_SPREAD = 1.5
FINISH_SPREAD = 1.5
MEAN_GAIN = 2.0
MEAN_LOSS = -2.0
FORM_FINISH = 5.0
FORM_WINDOW_SIZE = 3
POINTS_PER_START = 15.0
POINTS_PER_ROUND = 15.0
WIN_RATE = 0.70
POINTS_GAP = 15.0
PODIUM_RATE = 0.60
FRONT_TIER_LOSS = -1.50
LOWER_TIER_GAIN = 2.00
TOP_TEN_RATE = 90.0
EVEN_RATE = 50.0
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    metric: str
    min_sample_size: int
    description: str
    thresholds: dict[str, float] = field(default_factory=dict)


# Rule ids, categories, metrics, sample sizes, threshold names --
_RULES = [
    Rule("QUALIFYING_TEAMMATE_ADVANTAGE", "QUALIFYING", "qualifying_delta_millis", 1, "Faster than the teammate in qualifying."),
    Rule("QUALIFYING_TEAMMATE_DEFICIT", "QUALIFYING", "qualifying_delta_millis", 1, "Slower than the teammate in qualifying."),
    Rule("QUALIFYING_TEAMMATE_EQUAL", "QUALIFYING", "qualifying_delta_millis", 1, "Same qualifying time as the teammate."),
    Rule("POSITION_GAIN", "POSITION_CHANGE", "position_change", 1, "Finished ahead of the grid position."),
    Rule("POSITION_LOSS", "POSITION_CHANGE", "position_change", 1, "Finished behind the grid position."),
    Rule("POSITION_MAINTAINED", "POSITION_CHANGE", "position_change", 1, "Finished where the race was started."),
    Rule("LARGE_POSITION_GAIN", "POSITION_CHANGE", "position_change", 1, "Gained five places or more.", {"gain_threshold": LARGE_GAIN}),
    Rule("FASTEST_RECORDED_LAP", "RACE_PACE", "fastest_recorded_millis", 1, "Fastest lap the driver recorded."),
    Rule("RACE_PACE_TEAMMATE_ADVANTAGE", "RACE_PACE", "pace_delta_millis", 1, "Lower mean lap time than the teammate."),
    Rule("RACE_PACE_TEAMMATE_DEFICIT", "RACE_PACE", "pace_delta_millis", 1, "Higher mean lap time than the teammate."),
    Rule("FAST_PIT_STOP", "PIT_STOP", "duration_millis", 1, "Pit stop under 25 seconds.", {"duration_threshold_millis": FAST_STOP_MILLIS}),
    Rule("PIT_STOP_HIGH_VARIABILITY", "PIT_STOP", "stddev_duration_millis", 2, "Pit stop durations spread over 1.5 seconds.", {"stddev_threshold_millis": STOP_SPREAD_MILLIS}),
    Rule("TEAMMATE_POINTS_ADVANTAGE", "TEAMMATE", "points_delta", 1, "More points than the teammate."),
    Rule("TEAMMATE_POINTS_DEFICIT", "TEAMMATE", "points_delta", 1, "Fewer points than the teammate."),
    Rule("TEAMMATE_FINISH_ADVANTAGE", "TEAMMATE", "finish_delta", 1, "Finished ahead of the teammate."),
    Rule("TEAMMATE_GRID_ADVANTAGE", "TEAMMATE", "grid_delta", 1, "Started ahead of the teammate."),
    Rule("LONGITUDINAL_QUALIFYING_CONSISTENCY", "QUALIFYING", "grid_position_stddev", 3, "Grid positions hardly vary.", {"stddev_threshold": GRID_SPREAD}),
    Rule("LONGITUDINAL_FINISH_CONSISTENCY", "RACE_RESULT", "finish_position_stddev", 3, "Classified finishes hardly vary.", {"stddev_threshold": FINISH_SPREAD}),
    Rule("LONGITUDINAL_POSITION_GAIN_PATTERN", "POSITION_CHANGE", "mean_position_change", 3, "Gains places on average.", {"gain_threshold": MEAN_GAIN}),
    Rule("LONGITUDINAL_POSITION_LOSS_PATTERN", "POSITION_CHANGE", "mean_position_change", 3, "Loses places on average.", {"loss_threshold": MEAN_LOSS}),
    Rule("LONGITUDINAL_RECENT_FORM", "DRIVER_FORM", "rolling_mean_finish", 2, "Strong mean finish over the latest rounds.", {"window_size": float(FORM_WINDOW_SIZE), "finish_threshold": FORM_FINISH}),
    Rule("LONGITUDINAL_POINTS_PER_START", "POINTS", "points_per_gp_start", 3, "High race points per start.", {"points_per_start_threshold": POINTS_PER_START}),
    Rule("LONGITUDINAL_POINTS_PER_ROUND", "POINTS", "points_per_round_total", 3, "High points per round, sprints included.", {"points_per_round_threshold": POINTS_PER_ROUND}),
    Rule("LONGITUDINAL_TEAMMATE_QUALIFYING_H2H", "TEAMMATE", "qualifying_win_rate", 3, "Clearly ahead of the teammate in qualifying.", {"win_rate_threshold": WIN_RATE}),
    Rule("LONGITUDINAL_TEAMMATE_RACE_H2H", "TEAMMATE", "race_win_rate", 3, "Clearly ahead of the teammate in races both finished.", {"win_rate_threshold": WIN_RATE}),
    Rule("LONGITUDINAL_TEAMMATE_POINTS_H2H", "TEAMMATE", "points_difference", 3, "Clearly more points than the teammate.", {"points_diff_threshold": POINTS_GAP}),
    Rule("LONGITUDINAL_CONSTRUCTOR_PODIUM_RATE", "CONSTRUCTOR", "podium_rate", 3, "Podiums in most rounds entered.", {"podium_rate_threshold": PODIUM_RATE}),
    Rule("POLE_TO_WIN_CONVERSION", "QUALIFYING", "pole_to_win_rate", 3, "Share of poles turned into wins."),
    Rule("FRONT_ROW_PODIUM_RETENTION", "QUALIFYING", "front_row_podium_rate", 3, "Share of front-row starts kept as podiums."),
    Rule("GRID_TIER_POSITION_LOSS", "POSITION_CHANGE", "avg_position_delta", 5, "Loses places from the front of the grid.", {"loss_threshold": FRONT_TIER_LOSS}),
    Rule("GRID_TIER_POSITION_GAIN", "POSITION_CHANGE", "avg_position_delta", 5, "Gains places from the back of the grid.", {"gain_threshold": LOWER_TIER_GAIN}),
    Rule("TOP10_CONVERSION_HIGH", "POSITION_CHANGE", "top10_conversion_rate", 5, "Turns top-ten grids into top-ten finishes.", {"conversion_threshold": TOP_TEN_RATE}),
]
# ---------------------------------------------------------------------------

REGISTRY = {rule.rule_id: rule for rule in _RULES}
ALIASES = {"LONGITUDINAL_CONSTRUCTOR_TRAJECTORY": "LONGITUDINAL_CONSTRUCTOR_PODIUM_RATE"}


def get_rule(rule_id: str) -> Rule:
    """The rule of that id; an unknown id is an error."""
    try:
        return REGISTRY[ALIASES.get(rule_id, rule_id)]
    except KeyError:
        raise KeyError(f"no insight rule named '{rule_id}'") from None


def registry_frame(spark: SparkSession) -> DataFrame:
    """The rules as a small table."""
    rows = [
        (r.rule_id, r.category, r.description, r.metric, r.min_sample_size, r.thresholds) for r in _RULES
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, category string, description string, metric string, min_sample_size int, "
        "thresholds map<string,double>",
    )

"""Idempotent upserts: what a batch inserts, updates or leaves as it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.functions.scalars import any_of, values_equal
from gridlake.session import frees_shuffles
from gridlake.tables import FOREIGN_KEYS, NATURAL_KEYS, RaceTables

# Text that must not replace a stored value by nothing.
_KEEP_WHEN_BLANK = {"lap_times": ("time",)}
# A task sorts this many rows in memory where a batch names keys again.
ROWS_PER_TASK = 300_000


def _numeric(frame: DataFrame, column: str) -> bool:
    return isinstance(frame.schema[column].dataType, T.NumericType)


def plan_upsert(
    entity: str, existing: DataFrame, batch: DataFrame, keys: list[str] | None = None, order: str | None = None
) -> DataFrame:
    """Existing and incoming rows merged by natural key, with the action of each key.

    Existing rows have one row a key.  The rows of a batch are applied one after
    the other in ``order`` (without it in the order of their values, which makes
    the outcome repeatable); the last one stays.

    Keys are counted first, by hash aggregation, in a job of its own.  A batch that names no key
    again, as nearly all do, meets the stored rows in a hash join, without sorting, and needs one
    exchange of each side, or none where tables are bucketed by season.  A batch that names keys
    again is brought together with the stored rows by one exchange of both, too, and every key is
    settled by windows there.  They go to tasks of about ``ROWS_PER_TASK`` rows and are sorted once,
    so a sort stays in memory however many rows there are; tasks that write the exchange may spill.

    The result holds the merged columns, ``action`` (``inserted``, ``updated``,
    ``skipped`` or ``kept`` for rows the batch does not mention), ``copies``,
    the number of batch rows of that key, and ``updates``, how many of them
    changed what was there before them.
    """
    keys = keys or NATURAL_KEYS[entity]
    values = [c for c in existing.columns if c not in keys and c in batch.columns]
    kept_text = _KEEP_WHEN_BLANK.get(entity, ())
    place = F.col(order) if order else F.lit(0)
    incoming = batch.select(
        *keys, *[F.col(c).cast(existing.schema[c].dataType).alias(c) for c in values], place.alias("_at")
    )
    # Rows that lack a part of their key meet no other row, however many there are.
    by_key = incoming.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    spark = existing.sparkSession
    with frees_shuffles(spark):
        rows, most = by_key.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
        if most > 1:
            rows += existing.count()
    if most <= 1:
        return _merge_single(existing, incoming.drop("_at"), keys, values, kept_text)
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    return _merge_in_order(existing, incoming, keys, values, kept_text, tasks)


def _merge_single(existing: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], kept_text: tuple) -> DataFrame:
    """The plan for keys that have at most one row on either side."""
    old = existing.select(*keys, F.struct(*[c for c in existing.columns if c not in keys], F.lit(1).alias("_one")).alias("_old"))
    new = incoming.select(*keys, F.struct(*values, F.lit(1).alias("_one")).alias("_new")).hint("shuffle_hash")
    given, stored = F.col("_new").isNotNull(), F.col("_old").isNotNull()

    def after(column: str) -> Column:
        if column not in values:
            return F.col(f"_old.{column}")
        value = F.col(f"_new.{column}")
        if column in kept_text:
            value = F.coalesce(F.nullif(value, F.lit("")), F.nullif(F.col(f"_old.{column}"), F.lit("")), value)
        return F.when(given, value).otherwise(F.col(f"_old.{column}"))

    merged = old.join(new, keys, "full_outer").select(
        "*", *[after(c).alias(c) for c in existing.columns if c not in keys]
    )
    changed = any_of(~values_equal(F.col(f"_old.{c}"), F.col(c), _numeric(existing, c)) for c in values)
    action = F.when(~given, "kept").when(~stored, "inserted").when(changed, "updated").otherwise("skipped")
    return merged.select(
        *existing.columns,
        action.alias("action"),
        F.when(given, 1).otherwise(0).cast("long").alias("copies"),
        F.when(given & stored & changed, 1).otherwise(0).cast("long").alias("updates"),
    )


def _merge_in_order(
    existing: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], kept_text: tuple, tasks: int
) -> DataFrame:
    """The plan for keys the batch may name more than once: every row meets the one before it."""
    rest = [c for c in existing.columns if c not in keys and c not in values]
    kind = incoming.schema["_at"].dataType
    stored = existing.select("*", F.lit(False).alias("_new"), F.lit(None).cast(kind).alias("_at"))
    added = incoming.select(
        *keys, *values, *[F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in rest],
        F.lit(True).alias("_new"), "_at",
    )
    lacking = any_of(F.col(k).isNull() for k in keys)
    # All windows have this order, which goes by the values as they were given: one sort serves them.
    steps = Window.partitionBy(*keys).orderBy("_new", "_at", *values)
    so_far = steps.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = steps.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = {c: f"_after_{c}" if c in kept_text else c for c in values}
    both = stored.unionByName(added)
    rows = both.where(~lacking).repartition(tasks, *keys).select(
        "*",
        *[
            F.coalesce(F.last(F.nullif(F.col(c), F.lit("")), True).over(so_far), F.col(c)).alias(after[c])
            for c in values
            if c in kept_text
        ],
    )
    rows = rows.select(
        "*",
        *[F.lag(after[c]).over(steps).alias(f"_before_{c}") for c in values],
        F.lag(F.lit(1)).over(steps).isNull().alias("_first"),
        F.lead(F.lit(1)).over(steps).isNull().alias("_last"),
    )
    changed = any_of(~values_equal(F.col(f"_before_{c}"), F.col(after[c]), _numeric(existing, c)) for c in values)
    step = (
        F.when(~F.col("_new"), "kept").when(F.col("_first"), "inserted").when(changed, "updated").otherwise("skipped")
    )
    counted = rows.withColumn("_did", step).select(
        *keys,
        *[F.col(after[c]).alias(c) for c in values],
        *[F.first(c, True).over(whole).alias(c) for c in rest],
        "_last",
        F.count(F.when(F.col("_new"), 1)).over(whole).alias("copies"),
        F.count(F.when(F.col("_did") == "updated", 1)).over(whole).alias("updates"),
        F.count(F.when(F.col("_did") == "inserted", 1)).over(whole).alias("_inserted"),
    )
    copies, new = F.col("copies"), F.col("_new")
    action = F.when(copies == 0, "kept").when(F.col("_inserted") > 0, "inserted").when(F.col("updates") > 0, "updated")
    settled = counted.where("_last OR copies = 0").select(
        *existing.columns, action.otherwise("skipped").alias("action"), "copies", "updates"
    )
    return settled.unionByName(
        both.where(lacking).select(
            *existing.columns,
            F.when(new, "inserted").otherwise("kept").alias("action"),
            new.cast("long").alias("copies"),
            F.lit(0).cast("long").alias("updates"),
        )
    )


def merged_rows(plan: DataFrame) -> DataFrame:
    return plan.drop("action", "copies", "updates")


def ingestion_stats(plan: DataFrame, entity: str, by: list[str] | None = None) -> DataFrame:
    """Counts of an upsert; a repeated row counts as updated where it differs from the one before it."""
    inserted = F.count(F.when(F.col("action") == "inserted", 1))
    updated = F.coalesce(F.sum("updates"), F.lit(0))
    processed = F.sum("copies")
    rows = plan.where(F.col("action") != "kept")
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(
        F.lit(entity).alias("entity_type"),
        F.coalesce(processed, F.lit(0)).alias("records_processed"),
        inserted.alias("records_inserted"),
        updated.alias("records_updated"),
        F.coalesce(processed - inserted - updated, F.lit(0)).alias("records_skipped"),
    )


def total_stats(stats: DataFrame) -> DataFrame:
    """The sum of several entities' statistics."""
    columns = [c for c in stats.columns if c.startswith("records_")]
    return stats.groupBy().agg(
        F.concat_ws(",", F.array_sort(F.collect_list("entity_type"))).alias("entity_type"),
        *[F.sum(c).alias(c) for c in columns],
    )


def missing_parents(entity: str, batch: DataFrame, parents: RaceTables) -> DataFrame:
    """Parent keys the batch refers to but the tables lack, with the rows affected.

    References are counted before the join, so a parent named by very many
    rows is one row of it.
    """
    found = []
    for parent, columns in FOREIGN_KEYS.get(entity, []):
        used = batch.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
        orphans = used.join(parents[parent].select(*columns), columns, "left_anti")
        found.append(
            orphans.select(
                F.lit(entity).alias("entity_type"),
                F.lit(parent).alias("missing_entity"),
                F.concat_ws("/", *columns).alias("missing_id"),
                "rows",
            )
        )
    if not found:
        return batch.sparkSession.createDataFrame(
            [], "entity_type string, missing_entity string, missing_id string, rows bigint"
        )
    return reduce(DataFrame.unionByName, found)


def parent_id(parent: str, columns: list[str]) -> Column:
    """A parent's name in one text: ``races/2030/1``."""
    return F.concat_ws("/", F.lit(parent), *columns)


def first_missing(entity: str, batch: DataFrame, parents: RaceTables) -> DataFrame:
    """Batch rows with ``missing_parent``, the first parent that is not there; NULL where all are."""
    missing = []
    for number, (parent, columns) in enumerate(FOREIGN_KEYS.get(entity, [])):
        there = f"_there_{number}"
        batch = batch.join(parents[parent].select(*columns).distinct().withColumn(there, F.lit(True)), columns, "left")
        missing.append((there, F.when(F.col(there).isNull(), parent_id(parent, columns))))
    found = F.coalesce(*[m for _, m in missing]) if missing else F.lit(None).cast("string")
    return batch.withColumn("missing_parent", found).drop(*[there for there, _ in missing])


def resolve(entity: str, batch: DataFrame, parents: RaceTables) -> DataFrame:
    """Batch rows all of whose parents exist."""
    for parent, columns in FOREIGN_KEYS.get(entity, []):
        batch = batch.join(parents[parent].select(*columns), columns, "left_semi")
    return batch

"""Numbering the rows of groups that may be far larger than one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A row that stands for more copies than this is first cut into pieces of this
# size, which are then spread over the cluster before they are written out.
COPIES_PER_PIECE = 100_000


def number_rows(rows: DataFrame, group: list[str], order: list[str], copies: str, counters: dict[str, Column]) -> DataFrame:
    """Like ``number_within`` for groups that one task can hold: one window, no slots."""
    so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    amount = {name: F.when(cond, F.col(copies)).otherwise(0) for name, cond in counters.items()}
    return rows.select("*", *[F.sum(a).over(so_far).alias(name) for name, a in amount.items()])


def number_within(
    rows: DataFrame,
    group: list[str],
    slot: str,
    order: list[str],
    copies: str,
    counters: dict[str, Column],
) -> DataFrame:
    """Give every row its last running number per counter within its group.

    ``slot`` is a small integer that splits a group evenly and comes first in
    the order, so a huge group is numbered slot by slot in separate tasks: a
    running number inside the slot plus the total of the slots before it.
    ``copies`` is how often the row occurs; a counter adds it where its
    condition holds.
    """
    in_slot = Window.partitionBy(*group, slot).orderBy(*order)
    running = in_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    amounts = {name: F.when(cond, F.col(copies)).otherwise(0) for name, cond in counters.items()}

    totals = rows.groupBy(*group, slot).agg(*[F.sum(a).alias(f"_{n}_total") for n, a in amounts.items()])
    earlier = (
        Window.partitionBy(*group).orderBy(slot).rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    )
    offsets = totals.select(
        *group,
        slot,
        *[F.coalesce(F.sum(f"_{n}_total").over(earlier), F.lit(0)).alias(f"_{n}_offset") for n in amounts],
    )
    numbered = rows.select("*", *[F.sum(a).over(running).alias(f"_{n}_inner") for n, a in amounts.items()])
    return numbered.join(offsets, [*group, slot]).select(
        *rows.columns, *[(F.col(f"_{n}_offset") + F.col(f"_{n}_inner")).alias(n) for n in amounts]
    )


def repeat_rows(rows: DataFrame, copies: str, index: str) -> DataFrame:
    """One output row per copy, with ``index`` counting 0 .. copies-1.

    Single rows pass straight through.  Rows with very many copies are cut
    into pieces and spread first, so no task has to write a long run on its
    own.  Over a stored table the row-group statistics of ``copies`` let the
    scan skip the branches that have nothing to do.
    """
    keys = rows.columns
    count = F.col(copies)
    zero = F.lit(0).cast("bigint")
    single = rows.where(count == 1).select(*keys, zero.alias(index))
    few = rows.where(count.between(2, COPIES_PER_PIECE)).select(
        *keys, F.explode(F.sequence(zero, count - 1)).alias(index)
    )
    last_piece = F.call_function("div", count - 1, F.lit(COPIES_PER_PIECE).cast("bigint"))
    start = F.col("_piece") * COPIES_PER_PIECE
    many = (
        rows.where(count > COPIES_PER_PIECE)
        .select(*keys, F.explode(F.sequence(zero, last_piece)).alias("_piece"))
        .repartition(*keys, "_piece")
        .select(
            *keys,
            F.explode(F.sequence(start, F.least(start + COPIES_PER_PIECE, count) - 1)).alias(index),
        )
    )
    return single.unionByName(few).unionByName(many)

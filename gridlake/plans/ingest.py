"""Audited, all-or-nothing ingestion of parsed batches into stored race tables.

Every table is one Parquet folder, partitioned by season where it has one, and
written by Spark's own dynamic partition overwrite.  A table whose first delivery holds
more than ``SEASON_FOLDERS`` seasons has a folder for each of ``SEASON_BLOCKS`` blocks of seasons
instead, because every folder costs a file and a rename however few its rows are.  A run first does all its
work beside the tables: parsed rows are staged, checked, and merged with the
stored rows of the seasons they touch.  Its commit is one file of the audit log,
the SUCCESS rows; only then are the staged seasons published over the stored
ones.  A run that fails before the commit leaves every table as it was.
Publishing writes the same seasons again however often it is repeated, so a run whose process
died after its commit is finished by the next one, or by ``recover``.

Rows that cannot be parsed are kept in the ``rejects`` table with endpoint and
reason, or fail the run (``strict``).  Rejects belong to a delivery, so a delivery
that is replayed replaces its rejects.

A store has one writer at a time.  A reader that needs several tables in one
state reads between runs.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.operators.upsert import first_missing, ingestion_stats, merged_rows, missing_parents, parent_id, plan_upsert
from gridlake.sources import pages
from gridlake.tables import FOREIGN_KEYS, INGEST_ORDER, NATURAL_KEYS, RaceTables, schema

SOURCE = "landing"
_WHOLE = ("seasons", "circuits", "constructors", "drivers")
_PUBLISHED = "run_id bigint"
SEASON_FOLDERS, SEASON_BLOCKS = 1000, 256
_BLOCK, _BY_BLOCK = "season_block", "_by_block"
_COUNTS = "records_processed", "records_inserted", "records_updated", "records_skipped"


class DependencyError(ValueError):
    """A batch refers to a parent that is neither stored nor in the batch."""


class RejectedError(ValueError):
    """A strict run met rows that cannot be parsed."""


class RaceStore:
    """Stored race tables under one folder, with their audit log."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Reading

    def _rows(self, folder: str, kind, missing: str | None = "empty") -> DataFrame | None:
        try:
            return self.spark.read.schema(kind).parquet(f"{self.root}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], kind) if missing else None

    def read(self, table: str) -> DataFrame:
        """The stored table; empty while nothing has been stored."""
        return self._rows(table, schema(table)).select(*schema(table).fieldNames())

    def _has_blocks(self, table: str) -> bool | None:
        """Whether the stored table lies in blocks of seasons; None while nothing has been stored."""
        rows = self._rows(table, schema(table), missing=None)
        return None if rows is None else _BLOCK in rows.columns

    def touched(self, table: str, batch: DataFrame) -> DataFrame:
        """The stored rows of the seasons a batch holds, or of their blocks.

        The join prunes the table's folders to those seasons at run time; the
        batch's first and last season do so before.
        """
        if table in _WHOLE:
            return self.read(table)
        first, last = batch.agg(F.min("season_year"), F.max("season_year")).first()
        if first is None:
            return self.read(table).where(F.lit(False))
        if self._has_blocks(table):
            blocks = batch.select(_block_of().alias(_BLOCK)).distinct()
            rows = self._rows(table, schema(table)).join(F.broadcast(blocks), _BLOCK, "left_semi")
            return rows.select(*schema(table).fieldNames())
        span = F.col("season_year").between(first, last)
        return self.read(table).where(span).join(batch.select("season_year").where(span).distinct(), "season_year", "left_semi")

    def tables(self) -> RaceTables:
        return RaceTables(self.read)

    def log(self) -> DataFrame:
        """The latest state of every run and entity: RUNNING, SUCCESS, FAILED or ROLLED_BACK."""
        state = F.when(F.col("status") == "RUNNING", 0).otherwise(1)
        last = Window.partitionBy("run_id", "entity_type").orderBy(state.desc())
        rows = self._rows("etl_log", schema("etl_log"))
        return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")

    def counts(self) -> DataFrame:
        """Number of stored rows per table."""
        parts = [
            self.read(table).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("table"), "rows")
            for table in INGEST_ORDER
        ]
        total = parts[0]
        for part in parts[1:]:
            total = total.unionByName(part)
        return total

    # Writing

    def _append(self, folder: str, rows: list[tuple], kind) -> None:
        """A few rows as one file, which appears whole or not at all."""
        self.spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{self.root}/{folder}")

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _next_run(self) -> int:
        known = self._rows("etl_log", schema("etl_log")).agg(F.max("run_id")).first()[0]
        return (known or 0) + 1

    def _publish(self, run: int) -> None:
        """The staged rows of a committed run over the stored ones; may be repeated."""
        staging = f"{self.root}/_staging/{run}"
        blocks = [f"{t}{_BY_BLOCK}" for t in INGEST_ORDER if t not in _WHOLE]
        for staged in (*INGEST_ORDER, *blocks, "rejects"):
            table = staged.removesuffix(_BY_BLOCK)
            kind = schema(table)
            if table == "rejects":
                kind = T.StructType([*kind.fields, T.StructField("delivery", T.StringType())])
            rows = self._rows(f"_staging/{run}/merged/{staged}", kind, missing=None)
            if rows is None:
                continue
            key = {"rejects": "delivery"}.get(table, None if table in _WHOLE else "season_year")
            if staged != table:
                key = _BLOCK
                rows = rows.withColumn(_BLOCK, _block_of()).hint("rebalance", _BLOCK)
            writer = rows.write.mode("overwrite")
            if key:
                writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(key)
            writer.parquet(f"{self.root}/{table}")
        self._append("_published", [(run,)], _PUBLISHED)
        self._delete(staging)

    def recover(self) -> list[int]:
        """Publishes what committed runs have not published yet; returns their numbers."""
        committed = self._rows("etl_log", schema("etl_log")).where("status = 'SUCCESS'").select("run_id").distinct()
        published = self._rows("_published", _PUBLISHED)
        # One writer at a time: at most the last run is unfinished.
        open_runs = [r.run_id for r in committed.join(published, "run_id", "left_anti").orderBy("run_id").collect()]
        for run in open_runs:
            self._publish(run)
        return open_runs

    def vacuum(self) -> None:
        """Deletes what runs that died before their commit have staged."""
        self.recover()
        self._delete(f"{self.root}/_staging")

    def ingest(
        self,
        batch: Mapping[str, DataFrame],
        season: int | None = None,
        round_number: int | None = None,
        endpoint: str | None = None,
        strict: bool = False,
        orphans: str = "fail",
        delivery: str | None = None,
        late: str | None = None,
    ) -> DataFrame:
        """Upsert rows of any entities, parents first; returns the run's statistics.

        Rows may be parsed ones with ``reject_reason``, ``endpoint`` and
        ``batch_order``.  ``orphans`` is "fail", "reject" or "wait": what to do with a
        row whose parent is neither stored nor in the batch; rows that wait go to the
        folder ``late``, a source of the stream that sends them again.  Rejects replace
        those of an earlier run of the same ``delivery``, by default the run itself.
        """
        self.recover()
        run, started = self._next_run(), _now()
        delivery = delivery or f"run-{run}"
        entities = [e for e in INGEST_ORDER if e in batch]
        staging = f"{self.root}/_staging/{run}"
        current, done = entities[0] if entities else "", []

        def entry(entity: str, status: str, counts=(0, 0, 0, 0), error: str | None = None, rejected: int = 0) -> tuple:
            ended = None if status == "RUNNING" else _now()
            return (SOURCE, entity, endpoint, None, season, round_number, status, *counts, error, started, ended, rejected, run)

        self._append("etl_log", [entry(e, "RUNNING") for e in entities], schema("etl_log"))
        try:
            staged = {}
            for current in entities:
                batch[current].write.parquet(f"{staging}/parsed/{current}")
                staged[current] = self.spark.read.schema(batch[current].schema).parquet(f"{staging}/parsed/{current}")
            good = {e: pages.accepted(rows, ordered=True) if "reject_reason" in rows.columns else rows for e, rows in staged.items()}
            rejects = {e: self._rejects(e, pages.rejected(rows), run) for e, rows in staged.items() if "reject_reason" in rows.columns}
            known, waiting = self._known(good), []
            for current in entities:
                orphan = missing_parents(current, good[current], known).first()
                if orphan is None:
                    continue
                problem = f"{orphan.missing_entity} '{orphan.missing_id}' not found"
                if orphans == "fail":
                    raise DependencyError(f"{current}: {problem}")
                # Split once, on a written copy: a row is good or lacks a parent, never both.
                first_missing(current, good[current], known).write.parquet(f"{staging}/parsed/_{current}")
                split = self.spark.read.parquet(f"{staging}/parsed/_{current}")
                good[current] = split.where("missing_parent IS NULL").drop("missing_parent")
                lost = split.where("missing_parent IS NOT NULL")
                if orphans == "wait":
                    waiting.append((current, lost))
                    continue
                lost = self._rejects(current, lost.drop("missing_parent").withColumn("reject_reason", F.lit("parent not found")), run)
                rejects[current] = rejects[current].unionByName(lost) if current in rejects else lost
            rejected = dict.fromkeys(entities, 0)
            kept = f"{staging}/merged/rejects"
            for current in rejects:
                rows = rejects[current].withColumn("delivery", F.lit(delivery))
                rows.write.mode("append").parquet(kept)
                stored = self.spark.read.schema(rows.schema).parquet(kept)
                rejected[current] = stored.where(F.col("entity_type") == current).count()
                if strict and rejected[current]:
                    reason = stored.where(F.col("entity_type") == current).agg(F.min("reason")).first()[0]
                    raise RejectedError(f"{current}: {rejected[current]} rows rejected, among them: {reason}")
            for current in entities:
                done.append((current, self._stage(current, good[current], staging)))
            if orphans == "wait" and late:
                self._send_late(late, good, waiting)
        except Exception as error:
            rows = [entry(current, "FAILED", error=str(error))]
            rows += [entry(e, "ROLLED_BACK") for e in entities if e != current]
            self._delete(staging)
            self._append("etl_log", rows, schema("etl_log"))
            raise
        self._delete(f"{staging}/parsed")
        # The commit.
        self._append("etl_log", [entry(e, "SUCCESS", c, rejected=rejected[e]) for e, c in done], schema("etl_log"))
        self._publish(run)
        spec = "entity_type string, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", records_rejected bigint"
        return self.spark.createDataFrame([(e, *c, rejected[e]) for e, c in done], spec)

    def _known(self, batch: Mapping[str, DataFrame]) -> RaceTables:
        """Stored parents together with those of the batch itself."""

        def load(table: str) -> DataFrame:
            stored = self.read(table)
            if table in batch:
                keys = [c for c in batch[table].columns if c in stored.columns]
                return stored.select(*keys).unionByName(batch[table].select(*keys))
            return stored

        return RaceTables(load)

    @staticmethod
    def _rejects(entity: str, rows: DataFrame, run: int) -> DataFrame:
        """Rejected rows in one layout, the row itself as JSON."""
        endpoint = F.col("endpoint") if "endpoint" in rows.columns else F.lit(None).cast("string")
        kept = [c for c in rows.columns if c not in ("endpoint", "reject_reason", pages.ORDER)]
        return rows.select(
            F.lit(entity).alias("entity_type"), endpoint.alias("endpoint"), F.col("reject_reason").alias("reason"),
            F.to_json(F.struct(*kept)).alias("record"), F.lit(run).cast("bigint").alias("run_id"),
        )

    @staticmethod
    def _send_late(late: str, good: Mapping[str, DataFrame], waiting: list[tuple[str, DataFrame]]) -> None:
        """Back into a stream: the rows that lack a parent, and a mark for every parent that is stored now.

        Sent before the commit: a row or mark that is sent again does no harm, a lost one would.
        """
        for entity, rows in waiting:
            record = F.to_json(F.struct(*[c for c in rows.columns if c != "missing_parent"])).alias("record")
            rows.select(F.lit(entity).alias("entity"), F.col("missing_parent").alias("parent"), record, F.lit("late").alias("status")).write.mode(
                "append"
            ).parquet(late)
        for entity, rows in good.items():
            if any(entity == parent for parents in FOREIGN_KEYS.values() for parent, _ in parents):
                none = F.lit(None).cast("string")
                rows.select(
                    F.lit(entity).alias("entity"), parent_id(entity, NATURAL_KEYS[entity]).alias("parent"),
                    none.alias("record"), F.lit("stored").alias("status"),
                ).distinct().write.mode("append").parquet(late)

    def _stage(self, entity: str, batch: DataFrame, staging: str) -> tuple:
        """Writes the merged rows of the touched seasons to the staging folder; the counts of the upsert."""
        order = pages.ORDER if pages.ORDER in batch.columns else None
        plan_upsert(entity, self.touched(entity, batch), batch, order=order).write.parquet(f"{staging}/planned/{entity}")
        plan = self.spark.read.parquet(f"{staging}/planned/{entity}")
        stats = ingestion_stats(plan, entity).first()
        if stats.records_inserted or stats.records_updated:
            rows = merged_rows(plan).select(*schema(entity).fieldNames())
            folder = entity
            if entity not in _WHOLE:
                blocks = self._has_blocks(entity)
                if blocks is None:
                    blocks = plan.select("season_year").distinct().count() > SEASON_FOLDERS
                if blocks:
                    folder = f"{entity}{_BY_BLOCK}"
                else:
                    # Rebalancing splits a season that is too large for one task.
                    rows = rows.hint("rebalance", "season_year")
            rows.write.parquet(f"{staging}/merged/{folder}")
        self._delete(f"{staging}/planned/{entity}")
        return tuple(stats[c] for c in _COUNTS)

    def ingest_landing(
        self,
        landing: str,
        season: int | None = None,
        start_round: int | None = None,
        end_round: int | None = None,
        include_laps: bool = True,
        strict: bool = False,
        one_per_line: bool = True,
    ) -> DataFrame:
        """Parse and upsert everything landed; rounds may be limited to an inclusive range.

        Rows that cannot be parsed are rejected whatever their season and round.
        """
        if start_round is not None and end_round is not None and start_round > end_round:
            raise ValueError("start_round is after end_round")
        batch = pages.parse_landing(self.spark, landing, include_laps, season, one_per_line)
        for entity, rows in batch.items():
            wanted = F.lit(True)
            if season is not None and "season_year" in rows.columns:
                wanted = wanted & (F.col("season_year") == season)
            if "round" in rows.columns and start_round is not None:
                wanted = wanted & (F.col("round") >= start_round)
            if "round" in rows.columns and end_round is not None:
                wanted = wanted & (F.col("round") <= end_round)
            batch[entity] = rows.where(wanted | F.col("reject_reason").isNotNull())
        return self.ingest(batch, season=season, endpoint=landing, strict=strict)


def _block_of() -> Column:
    return F.pmod(F.xxhash64("season_year"), F.lit(SEASON_BLOCKS)).cast("int")


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)

"""Incremental ingestion: pages are upserted as they land.

``stream_landing`` takes all entities in any order: a row whose parents have
not been stored waits in the state of the stream, keyed by the first parent it lacks,
until that parent is stored or its time is up.  ``stream_entity`` is the simple form for one entity
whose parents are stored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import count
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridlake.plans.ingest import RaceStore
from gridlake.sources import pages
from gridlake.tables import INGEST_ORDER

if TYPE_CHECKING:
    import pandas as pd

HOLD_SECONDS = 24 * 3600
# A parent that very many rows wait for is spread over this many state keys.
SALTS = 16
_LATE = "entity string, parent string, record string, status string"
_OUT = ["entity", "record", "status"]


def _folder(landing: str) -> str:
    return hashlib.sha256(landing.rstrip("/").encode()).hexdigest()[:16]


def stream_entity(spark: SparkSession, landing: str, entity: str, store: RaceStore) -> StreamingQuery:
    """Upsert newly landed pages of one entity, then stop.

    A page that arrives late or again is just an update or a skip, so the
    stream needs no watermark.  Rows that cannot be parsed, or whose parents
    are not stored, go to the store's rejects.  Progress is kept under the
    store for each landing folder; a restarted stream goes on where it stopped,
    and a batch that is replayed changes nothing, its rejects included.
    """
    source = spark.readStream.schema("value string").text(f"{landing}/{entity}")
    where = _folder(landing)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        delivered = batch.select(F.col("value").alias("payload"), F.lit(f"{landing}/{entity}#{batch_id}").alias("endpoint"))
        rows = pages.PARSERS[entity](delivered)
        store.ingest(
            {entity: rows}, endpoint=f"{landing}/{entity}#{batch_id}", orphans="reject", delivery=f"{where}-{entity}-{batch_id}"
        )

    return (
        source.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", f"{store.root}/_streams/{where}/{entity}")
        .trigger(availableNow=True)
        .start()
    )


def wait_for_parent(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, hold_ms: int) -> Iterator[pd.DataFrame]:
    """Holds the rows that lack one parent until its mark comes, at most ``hold_ms`` after the last of them.

    Rows come with status "late", the parent's mark with "stored"; rows without a
    key pass.  A row that is delivered again while it waits is held once.
    Rows leave as "new", or as "expired".
    """
    import pandas as pd

    (held,) = state.get if state.exists else ([],)
    waiting = dict.fromkeys(held)

    def leave(status: str) -> pd.DataFrame:
        return pd.DataFrame([(*json.loads(w), status) for w in waiting], columns=_OUT)

    if state.hasTimedOut:
        yield leave("expired")
        state.remove()
        return
    stored = grown = False
    for frame in frames:
        late = frame["status"] == "late"
        stored = stored or bool((frame["status"] == "stored").any())
        grown = grown or bool(late.any())
        waiting |= dict.fromkeys(map(json.dumps, frame.loc[late, ["entity", "record"]].values.tolist()))
        passing = frame.loc[frame["status"] == "new", _OUT]
        if len(passing):
            yield passing
    if stored and waiting:
        yield leave("new")
    if stored or not waiting:
        if state.exists:
            state.remove()
    else:
        state.update((list(waiting),))
        if hold_ms:
            state.setTimeoutDuration(hold_ms)


def with_late_rows(rows: DataFrame, late: DataFrame, hold_seconds: float = HOLD_SECONDS, salts: int = SALTS) -> DataFrame:
    """New rows as they come, late ones once their parent is stored: entity, record, status."""
    hold_ms = max(1, int(hold_seconds * 1000))

    def wait(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return wait_for_parent(key, frames, state, hold_ms)

    salt = F.pmod(F.xxhash64("record"), F.lit(salts)).cast("int")
    everywhere = F.sequence(F.lit(0), F.lit(salts - 1))
    keyed = rows.unionByName(late).withColumn(
        "salt", F.explode(F.when(F.col("status") == "stored", everywhere).otherwise(F.array(salt)))
    )
    return keyed.groupBy("parent", "salt").applyInPandasWithState(
        wait, "entity string, record string, status string", "waiting array<string>", "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )


def stream_landing(
    spark: SparkSession,
    landing: str,
    store: RaceStore,
    hold_seconds: float = HOLD_SECONDS,
    salts: int = SALTS,
    entities: Sequence[str] = INGEST_ORDER,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Upsert newly landed pages of all entities in whatever order they arrive.

    Each batch stores the rows whose parents are stored or come with it.  The others
    go back into the stream under the first parent they lack, and every parent that
    a batch brings sends a mark after them; the next batch joins the two in the state.
    A row waits ``hold_seconds`` at most; after that it is stored if its parents
    are, or goes to the rejects.  Waiting rows live in the checkpoint, so a
    restart loses none, and a replayed batch changes nothing.

    By default a run takes what there is and stops (``settle`` repeats it until no row moves);
    ``trigger={"processingTime": "1 minute"}`` keeps it running.  Time passes when a batch runs.
    """
    where = _folder(landing)
    work = f"{store.root}/_streams/{where}"
    late = f"{work}/late"
    spark.createDataFrame([], _LATE).write.mode("append").parquet(late)
    rows, kinds = [], {}
    for entity in entities:
        # A folder no page has reached yet is an empty one.
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{landing}/{entity}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        text = spark.readStream.schema("value string").text(f"{landing}/{entity}")
        delivered = text.select(F.col("value").alias("payload"), F.lit(f"{landing}/{entity}").alias("endpoint"))
        parsed = pages.PARSERS[entity](delivered)
        kinds[entity] = parsed.schema
        record = F.to_json(F.struct(*parsed.columns)).alias("record")
        rows.append(parsed.select(F.lit(entity).alias("entity"), F.lit("").alias("parent"), record, F.lit("new").alias("status")))
    again = spark.readStream.schema(_LATE).parquet(late)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # Written once, as every entity reads it.
        batch.write.mode("overwrite").parquet(f"{work}/batch")
        found = spark.read.schema("entity string, record string, status string").parquet(f"{work}/batch")
        for status, orphans in (("new", "wait"), ("expired", "reject")):
            some = found.where(F.col("status") == status)
            present = {r.entity for r in some.select("entity").distinct().collect()}
            split = {
                e: some.where(F.col("entity") == e).select(F.from_json("record", kinds[e]).alias("r")).select("r.*")
                for e in entities
                if e in present
            }
            if split:
                delivery = f"{where}-{batch_id}-{status}"
                store.ingest(split, endpoint=f"{landing}#{batch_id}", orphans=orphans, delivery=delivery, late=late)

    query = with_late_rows(reduce(DataFrame.unionByName, rows), again, hold_seconds, salts).writeStream.foreachBatch(upsert)
    query = query.option("checkpointLocation", f"{work}/all").trigger(**(trigger or {"availableNow": True}))
    # Timeouts ask for batch after batch without data; a run that is to stop must not give in.
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "true" if trigger else "false")
    try:
        return query.start()
    finally:
        spark.conf.set(idle, before)


def settle(spark: SparkSession, landing: str, store: RaceStore, **how) -> int:
    """Runs ``stream_landing`` until a run meets nothing new; returns the number of runs."""
    for runs in count(1):
        query = stream_landing(spark, landing, store, **how)
        query.awaitTermination()
        if not any(p.numInputRows for p in query.recentProgress):
            return runs

"""Tables a plan writes once and reads many times."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.session import JOINS_IN_BUCKETS, frees_shuffles, working_folder

# Rows take about ten times as much memory as they take in a Parquet file, and a task
# sorts them several times over.
_BYTES_PER_BUCKET = 4 << 20
_MAX_BUCKETS = 100_000

_written: dict[tuple[str, str, str, int], str] = {}


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files under a path, read from their listing only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.sum("length")).first()[0] or 0


def bucket_count(spark: SparkSession, data_bytes: int) -> int:
    """Buckets of about 4 MB of Parquet, at least one per core; Spark allows no more than the limit."""
    wanted = max(spark.sparkContext.defaultParallelism, -(-data_bytes // _BYTES_PER_BUCKET))
    return max(1, min(wanted, _MAX_BUCKETS))


def _state(spark: SparkSession, source: str) -> int:
    """Changes whenever a file under the source is added, replaced or removed; from the listing only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    each = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return int(files.agg(F.sum(each)).first()[0] or 0)


def drop_stored(spark: SparkSession, source: str | None = None) -> None:
    """Deletes the tables stored for a source, or all of this application's."""
    application = spark.sparkContext.applicationId
    for key in [k for k in _written if k[0] == application and source in (None, k[1])]:
        kept = _written.pop(key)
        folder = kept if "/" in kept else f"{working_folder(spark)}/{kept}"
        if "/" not in kept:
            spark.sql(f"DROP TABLE IF EXISTS {kept}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(
    spark: SparkSession,
    source: str,
    name: str,
    build: Callable[..., DataFrame],
    bucket_by: str | None = None,
    sort_by: list[str] | None = None,
    sized_by: str | None = None,
) -> DataFrame:
    """The named table derived from ``source``: written on first use, then scanned.

    Building a query may so run write jobs.  A source whose files have changed
    is derived anew; ``drop_stored`` deletes what was stored.

    The files lie in the shared working folder, so a lost executor costs no
    recomputation.  With ``bucket_by`` the table is bucketed, the number of
    buckets following the size of the files at ``sized_by``; ``build`` is given
    that number and returns the rows in that many partitions of the column.
    Grouping, windows and joins over keys that contain the column then need no
    shuffle; for the joins the session is told so, whatever it was started with.
    """
    if bucket_by:
        spark.conf.set(*JOINS_IN_BUCKETS)
    key = (spark.sparkContext.applicationId, source, name, _state(spark, source))
    if key not in _written:
        table = f"gridlake_{name}_{uuid.uuid4().hex}"
        path = f"{working_folder(spark)}/{table}"
        with frees_shuffles(spark):
            if bucket_by:
                buckets = bucket_count(spark, stored_bytes(spark, sized_by))
                (
                    build(buckets)
                    .write.bucketBy(buckets, bucket_by)
                    .sortBy(*(sort_by or [bucket_by]))
                    .option("path", path)
                    .saveAsTable(table)
                )
                _written[key] = table
            else:
                build().write.parquet(path)
                _written[key] = path
    if bucket_by:
        return spark.table(_written[key])
    return spark.read.parquet(_written[key])

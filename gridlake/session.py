"""Session settings the plans are tuned for, and the shared working folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Fact tables are bucketed by season; joins on (season, round, driver)
# may then run inside the buckets instead of shuffling both sides again.
JOINS_IN_BUCKETS = ("spark.sql.requireAllClusterKeysForCoPartition", "false")

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Capturing the Python call site of every column costs several times the
    # time of building the plan itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    JOINS_IN_BUCKETS[0]: JOINS_IN_BUCKETS[1],
}

# Spark deletes the shuffle files of a query as it ends, not when the driver happens to collect garbage.
_FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}


def local_session(cores: int | str = "*", app_name: str = "gridlake") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def frees_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs run here leave no shuffle files behind, so the disk holds those of one job at a time.

    Only for frames that are run once: one run again would have to shuffle again.
    """
    before = spark.conf.get(_FREES_SHUFFLES, None)
    spark.conf.set(_FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREES_SHUFFLES)
        else:
            spark.conf.set(_FREES_SHUFFLES, before)


def working_folder(spark: SparkSession) -> str:
    """The shared folder for tables a plan has to write.

    It is the folder the cluster names in ``spark.checkpoint.dir``.  Only a
    local-mode session without that setting gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="gridlake-")
    return _local_dirs[context.applicationId]

"""Exact duplicates by a tree merge of sorted digest runs.

Texts are equal when they are identical after lower-casing A-Z only.  Each text
becomes a short digest, the order of the runs, with its proof: SHA-256 and byte
length.  Input partitions are dealt to leaves; a leaf's run has one entry for
each text in it.  Then runs meet in rounds, as in a binomial tree with ``fan_in``
children: in every round the runs of neighbouring nodes are merged by digest,
and an entry keeps its number of rows and the row that stays (largest or
smallest identifier).  Entries of one digest are merged only where their proofs
agree, at every level, so a digest that two texts share costs nothing but a
second entry.

What this means for a group that holds a third of all rows: a partition's own
rows of it are counted before they are shuffled, a round brings at most
``fan_in`` entries of one text together, and the way back goes by (leaf, digest),
so no task ever gets more rows of a group than its leaf holds.  Every round
spreads its entries over all tasks by node and digest.  Texts are read once and
never shuffled; entries are about 60 bytes.

Defined results for odd input: a null text counts as empty, all empty texts are
one group; a null identifier is smaller than every other; of rows with the same
identifier in one group exactly one stays (the one whose unchanged text has the
larger hash, of identical rows any one); an empty table gives an empty result;
very long texts are hashed whole; further columns are ignored, whatever their names.

Everything is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import text_or_empty, written

FAN_IN = 8
_ENTRY = ["digest", "proof", "n_bytes"]


def lowered(text: Column) -> Column:
    """A-Z lowered, nothing else; ``lower`` is the quicker way where there is only ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digested(
    documents: DataFrame, leaves: int, id_column: str, text_column: str, digest: Callable[[Column], Column]
) -> DataFrame:
    """A row for each document: run (its leaf), digest, proof, n_bytes, row (identifier and tie-breakers)."""
    text = F.col("_text")
    rows = documents.select(F.col(id_column).alias("_id"), text_or_empty(text_column).alias("_text"))
    rows = rows.select("_id", "_text", lowered(text).alias("_lowered"))
    return rows.select(
        F.pmod(F.spark_partition_id(), F.lit(leaves)).alias("run"),
        digest(F.col("_lowered")).alias("digest"),
        F.unhex(F.sha2("_lowered", 256)).alias("proof"),
        F.octet_length("_lowered").cast("long").alias("n_bytes"),
        F.struct(
            F.col("_id").alias("id"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place")
        ).alias("row"),
    )


def merged(runs: DataFrame, best: Callable[[str], Column]) -> DataFrame:
    """The runs of equal number as one: an entry for each proven text, with its rows and the row that stays."""
    return runs.groupBy("run", *_ENTRY).agg(best("row").alias("row"), F.sum("size").alias("size"))


def tree_merge(runs: DataFrame, leaves: int, fan_in: int, best: Callable[[str], Column]) -> DataFrame:
    """One run of all entries, after as many rounds as the tree of leaves is high."""
    nodes = leaves
    while nodes > 1:
        runs = merged(runs.withColumn("run", F.floor(F.col("run") / F.lit(fan_in)).cast("int")), best)
        nodes = -(-nodes // fan_in)
    return runs


def exact_duplicates(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "largest",
    fan_in: int = FAN_IN,
    leaves: int | None = None,
    digest: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """Per document row: doc_id, keep_id, group_size, kept, text_sha256 (of the lowered text).

    ``leaves`` is the number of runs before the first round, the session's
    shuffle partitions if not given.
    """
    spark = documents.sparkSession
    leaves = leaves or int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = {"largest": F.max, "smallest": F.min}[keep]
    # Written once: texts are hashed a single time, and the partition a row was read in stays fixed.
    rows = written(digested(documents, leaves, id_column, text_column, digest), "digests")
    runs = merged(rows.withColumn("size", F.lit(1).cast("long")), best)
    whole = tree_merge(runs, leaves, fan_in, best)
    groups = whole.filter("size > 1").select(*_ENTRY, F.col("row").alias("stays"), "size")
    # Back to the rows by leaf: a leaf has one entry for each group it holds.
    held = runs.select("run", *_ENTRY).join(groups, _ENTRY)
    found = rows.join(held, ["run", *_ENTRY], "left")
    alone = F.col("size").isNull()
    return found.select(
        F.col("row.id").alias("doc_id"),
        F.when(alone, F.col("row.id")).otherwise(F.col("stays.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row.place") == F.col("stays.place"))).alias("kept"),
        F.lower(F.hex("proof")).alias("text_sha256"),
    )


def deduplicated(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The documents that stay, with all their columns."""
    found = exact_duplicates(documents, id_column, text_column, **how)
    stay = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    stay = written(stay.filter("kept and rows > 1 or not kept"), "decisions")
    names = documents.columns
    rows = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(id_column).alias("_id"),
        F.sha2(lowered(text_or_empty(text_column)), 256).alias("_sha"),
    )
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_sha") == F.col("text_sha256"))
    once = rows.join(stay, same, "left_anti").select("row.*")
    # Rows that share identifier and text: the one of largest (smallest) hash of the unchanged text.
    again = rows.join(stay.filter("kept"), same).groupBy("_id", "_sha").agg(
        (F.min_by if how.get("keep") == "smallest" else F.max_by)("row", F.xxhash64(F.col(f"row.`{text_column}`").cast("string"))).alias("row")
    )
    return once.unionByName(again.select("row.*"))

"""A corpus from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``, whatever they are.  doc_id identifies a
document; a row without one is never rejected as a duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import catalog, decontaminate, mixing, near_dedup, quality, token_files
from gridlake.llm.common import read, written

BROADCAST_IDS = 1_000_000


def _joined(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on doc_id; few ids are sent to every task, more are joined by shuffle."""
    ids = written(ids.filter("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(few, docs["doc_id"] == few["_id"], how)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    found = quality.scores(docs, read(spark, sf_dir, "labels"))
    return _joined(docs, found.filter(~F.col("kept")), "left_anti")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of smallest doc_id."""
    found = written(near_dedup.near_duplicates(docs), "classes")
    ids = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("class_id")).alias("first"), F.count("*").alias("rows"))
    ids = written(ids.filter("doc_id is not null"), "class_ids")
    kept = _joined(docs, ids.filter(~F.col("first")), "left_anti")
    again = ids.filter("first and rows > 1")
    if again.isEmpty():
        return kept
    once = _joined(kept, again, "left_semi").dropDuplicates(["doc_id"])
    return _joined(kept, again, "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    return _joined(docs, found.filter("contaminated"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    size = mixing.sized(docs.select("doc_id", "source", "text"))
    size = written(size, "doc_sizes")
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), "doc_id", "source", mixing.size_of("text").alias("size")
    )
    repeated = mixing.Mix(size).repeats(rows)
    return repeated.select("row", F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int")))).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.ids_crc32(token_files.read_blocks(catalog.byte_bpe_blocks(docs)))


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token files", write_tokens),
]

# The language model cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage_{number}")
    return docs

"""Mixing sources to target weights by capped water-filling.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...  Together
they share 100 % of all words by weight.  A source is clamped at ``max_epochs``
times its own words; what is over goes to the others by weight until none is
above.  With the sources sorted by cap over weight, a source is clamped exactly
when the level that the rest would reach without it lies above its own ratio,
so one sorted pass gives the fixed point.

A target of e epochs takes every document floor(e) whole times; the fraction is
filled by whole documents in a seeded order: a document that does not fit is
passed over, and the next ones are tried until none fits; last comes the one
document whose size is nearest to what still lacks.  A pass sums hash buckets up
to the one where the source is cut and looks inside that one only; the next pass
goes on behind the document that did not fit, over those no longer than what
lacks.  The order depends on seed and doc_id only, so reruns agree.

Defined results for odd input: a null text has size 0; a null source is a
source of its own; rows that agree in doc_id, source and size are taken
together; a source without words has target 0; an empty table gives no rows;
further columns are ignored.  One aggregated row for each source, and one for
each source and hash bucket, is all that is ever brought together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.llm.common import written

MAX_EPOCHS = 3
SEED = "mix-1"
_WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: str) -> Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(_WORDS)), F.lit(0)).cast("long")


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source and size in words of every document."""
    return documents.select("doc_id", "source", size_of("text").alias("size"))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, weight and capped target, from (source, source_size) rows."""
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*(F.lit(w) for w in weights))
    ranked = totals.withColumn("weight", F.get(cycle, F.pmod(place - 1, F.lit(len(weights))).cast("int")))
    cap = (max_epochs * F.col("source_size")).alias("cap")
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("cap", cap).withColumn("clamped", level >= F.col("cap") / F.col("weight"))
    free_words = F.sum("source_size").over(everything) - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(everything)
    free_weight = F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(free_words / free_weight * F.col("weight"))
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def _order(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


class Mix:
    """The decisions of one mix: a row for each source, and the documents at the cut."""

    def __init__(self, sizes: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED):
        self.seed = seed
        rows = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
        rows = rows.select("doc_id", "source", "size", (F.col("size") * F.col("rows")).alias("total"), _order(seed).alias("key"))
        rows = written(rows.withColumn("bucket", F.substring("key", 1, 3)), "mix_sizes")
        buckets = written(rows.groupBy("source", "bucket").agg(F.sum("total").alias("words")), "mix_buckets")
        targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs=max_epochs)
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        targets = targets.withColumn("whole", whole.cast("long")).withColumn(
            "part", F.col("target") - F.col("whole") * F.col("source_size")
        )
        targets = written(targets, "mix_targets")

        # The first pass; all buckets below its cut are taken whole and never listed.
        place = T.StructType([rows.schema[name] for name in ("key", "doc_id", "size")])
        start = targets.select("source", F.col("part").alias("lack"), F.lit(None).cast(place).alias("at"))
        cuts, fitting, state = self._fill(rows, start)
        cut_of = targets.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        self.sources = written(cut_of.withColumn("below", F.coalesce("below", F.lit(0))), "mix_sources")
        # What lacks is now less than one document, so the lists of the passes after it are short.
        passes = [fitting]
        while not state.isEmpty():
            _, more, state = self._fill(rows, state, below=True)
            passes.append(more)
        fitting = written(reduce(DataFrame.unionByName, passes), "mix_fitting")
        cut = self._with_source(rows)

        # What still lacks is filled by the document nearest to it in size, if that helps.
        filled = fitting.groupBy(F.col("source").alias("_f")).agg(F.sum("total").alias("filled"))
        lacking = self.sources.join(filled, F.col("source").eqNullSafe(F.col("_f")), "left").select(
            F.col("source").alias("_l"), (F.col("part") - F.col("below") - F.coalesce("filled", F.lit(0))).alias("lack")
        )
        left = cut.filter(F.col("cut").isNotNull() & (F.col("bucket") >= F.col("cut")))
        left = left.join(
            fitting.select(F.col("doc_id").alias("_d"), F.col("source").alias("_f"), F.col("size").alias("_z")),
            F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_f")) & (F.col("size") == F.col("_z")),
            "left_anti",
        )
        left = left.join(lacking, F.col("source").eqNullSafe(F.col("_l")))
        off = F.abs(F.col("total") - F.col("lack"))
        nearest = (
            left.filter(off < F.col("lack"))
            .groupBy("source")
            .agg(F.min_by(F.struct("doc_id", "size"), F.struct(off, "key", "doc_id", "size")).alias("one"))
            .select("one.doc_id", "source", "one.size")
        )
        self.chosen = written(fitting.select("doc_id", "source", "size").unionByName(nearest), "mix_chosen")

    @staticmethod
    def _fill(rows: DataFrame, state: DataFrame, below: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """One pass in seeded order over the documents after ``at`` that are no longer than what lacks.

        Gives the bucket at which each source is cut with the words below it,
        the documents taken (of the cut bucket, or with ``below`` of all
        buckets), and the state of the sources that go on: what lacks, and the
        place of the document that did not fit.
        """
        state = state.withColumnRenamed("source", "_s")
        left = rows.join(state, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        place = F.struct("key", "doc_id", "size")
        left = left.filter((F.col("at").isNull() | (place > F.col("at"))) & (F.col("total") > 0))
        # In the first pass a long document may be the one that is cut; later it would only be passed over.
        left = left.filter(F.col("at").isNull() | (F.col("total") <= F.col("lack")))
        running = Window.partitionBy("source").orderBy("bucket")
        buckets = left.groupBy("source", "bucket", "lack").agg(F.sum("total").alias("words"))
        over = F.col("upto") > F.col("lack")
        cuts = (
            buckets.withColumn("upto", F.sum("words").over(running))
            .groupBy(F.col("source"))
            .agg(
                F.min(F.when(over, F.col("bucket"))).alias("cut"),
                F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("below"),
            )
        )
        cuts = written(cuts, "mix_cuts")
        joined = left.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        inside = Window.partitionBy("source").orderBy("key", "doc_id", "size")
        at_cut = joined.filter(F.col("bucket") == F.col("cut"))
        at_cut = at_cut.withColumn("upto", F.col("below") + F.sum("total").over(inside)).withColumn("place", place)
        at_cut = written(at_cut.select("doc_id", "source", "size", "total", "lack", "below", "upto", "place"), "mix_at_cut")
        fits = F.col("upto") <= F.col("lack")
        taken = at_cut.filter(fits).select("doc_id", "source", "size", "total")
        if below:
            whole = joined.filter(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")))
            taken = written(taken.unionByName(whole.select("doc_id", "source", "size", "total")), "mix_taken")
        # Exactly the documents that fit end before the first one that does not.
        state = at_cut.groupBy("source", "lack").agg(
            F.max(F.when(fits, F.col("upto"))).alias("upto"),
            F.min(F.when(~fits, F.col("place"))).alias("at"),
            F.max("below").alias("below"),
        )
        lack = F.col("lack") - F.coalesce("upto", "below")
        state = state.filter(F.col("at").isNotNull()).select("source", lack.alias("lack"), "at")
        return cuts, taken, written(state.filter(F.col("lack") > 0), "mix_state")

    def _with_source(self, frame: DataFrame) -> DataFrame:
        sources = self.sources.withColumnRenamed("source", "_s")
        return frame.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def repeats(self, frame: DataFrame) -> DataFrame:
        """Adds source_size, target and repeats to rows with doc_id, source and size."""
        joined = self._with_source(frame.withColumn("_bucket", F.substring(_order(self.seed), 1, 3)))
        chosen = self.chosen.select(F.col("doc_id").alias("_d"), F.col("source").alias("_c"), F.col("size").alias("_z"))
        joined = joined.join(
            chosen,
            F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_c")) & (F.col("size") == F.col("_z")),
            "left",
        )
        extra = F.col("_z").isNotNull() | (F.col("_bucket") < F.col("cut")) | (F.col("cut").isNull() & (F.col("part") > 0))
        repeats = F.col("whole") + F.when(extra, 1).otherwise(0)
        return joined.select(*frame.columns, "source_size", "target", repeats.cast("long").alias("repeats"))


def mix(documents: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, repeats and taken words."""
    sizes = written(sized(documents), "doc_sizes")
    return Mix(sizes, max_epochs, seed).repeats(sizes).withColumn("taken", F.col("size") * F.col("repeats"))

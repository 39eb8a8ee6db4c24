"""Document fingerprints by a threshold-scaled sketch.

The sketch of a text keeps every hash of its five-word shingles that lies below
a fixed fraction of the hash range.  Whether a shingle is kept depends on the
shingle alone, so sketches of unequal documents are comparable, the sketch of a
union is the union of sketches, and containment and Jaccard likeness follow
from plain set operations.  Beside them the smallest hash is always kept (also
closed under union), so that a short text has a sketch as well.

Words are runs of non-white characters of the lower-cased text; a text of fewer
than five words, but not none, is one shingle; an empty or null text has the
empty sketch.  Likeness of two empty sketches is 1, of an empty and another 0.

Everything is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import text_or_empty, written

SHINGLE = 5
FRACTION = 0.25
ROWS_PER_BUCKET = 8000
_RANGE = (1 << 63) - 1


def sketch(text: Column, fraction: float = FRACTION, shingle: int = SHINGLE) -> Column:
    """Sorted array of the kept 63-bit shingle hashes."""
    found = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - shingle)
        hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(shingle))).bitwiseAND(F.lit(_RANGE)))
        whole = F.array(F.xxhash64(F.array_join(w, " ")).bitwiseAND(F.lit(_RANGE)))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= shingle, hashes).when(F.size(w) > 0, whole).otherwise(none)

    def kept(hashes: Column) -> Column:
        below = F.lit(int(_RANGE * fraction))
        return F.transform(
            F.array(F.array_min(hashes)),
            lambda least: F.filter(hashes, lambda h: (h < below) | (h == least)),
        )[0]

    # A one-element transform binds a value once, so that it isn't computed for each use.
    bound = F.transform(F.array(found), of)[0]
    return F.array_sort(F.array_distinct(F.transform(F.array(bound), kept)[0]))


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _bucket(bounds: list) -> Column:
    """Number of the bounds up to doc_id, found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    upto = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id")))
    coarse = F.greatest(upto(F.lit([g[0] for g in groups])) - 1, F.lit(0))
    inside = F.get(F.array(*(F.lit(g) for g in groups)), coarse)
    return coarse * width + upto(inside)


def with_next(documents: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, text, ``bucket`` in the order by doc_id, and ``own``: whether the row is the bucket's own.

    Rows are dealt into buckets of neighbouring doc_ids at quantiles of the
    column, and each bucket also gets a copy of the first row of the next one
    (the last: of the first).  So ``lead`` inside a bucket finds the next
    document without ordering all rows in one task.  Null doc_ids come first;
    rows of equal doc_id are ordered by text.
    """
    rows = documents.select("doc_id", text_or_empty().alias("text"))
    buckets = max(1, -(-documents.count() // rows_per_bucket))
    bounds = []
    if buckets > 1:
        shares = [k / buckets for k in range(1, buckets)]
        found = documents.agg(F.percentile_approx("doc_id", shares, 20 * buckets).alias("at")).first()["at"]
        bounds = sorted(set(found or []))
    number = F.when(F.col("doc_id").isNull(), 0).otherwise(_bucket(bounds)).cast("int")
    dealt = rows.withColumn("bucket", number)
    least = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).getField("doc_id")
    heads = documents.select("doc_id").withColumn("bucket", number).groupBy("bucket").agg(least.alias("head"))
    # One row for each bucket.
    ring = Window.orderBy("bucket")
    last = F.max("bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = written(heads.select("head", F.coalesce(F.lag("bucket").over(ring), last).alias("before")), "bucket_heads")
    copies = dealt.join(heads, F.col("doc_id").eqNullSafe(F.col("head")))
    copies = copies.select("doc_id", "text", F.col("before").alias("bucket"), F.lit(False).alias("own"))
    return dealt.withColumn("own", F.lit(True)).unionByName(copies)


def with_edits(documents: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per document: its text, the edited text, both sketches and the next document's sketch.

    The edited text has the last quarter of the code points (rounded down)
    replaced by as many of the next document's first, or all it has.
    """
    inside = Window.partitionBy("bucket").orderBy(F.col("own").desc(), F.col("doc_id").asc_nulls_first(), "text")
    rows = with_next(documents, rows_per_bucket).withColumn("next_text", F.lead("text").over(inside))
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail))
    rows = rows.select(
        "bucket", "own", "doc_id", "text", n.cast("long").alias("n_chars"),
        F.when(F.col("own"), edited).alias("edited"), sketch(F.col("text")).alias("sketch"),
    )
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(inside)).filter("own")
    return rows.select(
        "doc_id", "n_chars", "text", "edited", "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch"
    )

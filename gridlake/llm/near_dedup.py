"""Near-duplicates by Order MinHash, verified by banded alignment.

Words are those of ``common.words``; a k-mer is five words in a row (all words
of a shorter text), labelled with how often it came before in the text.  Each of ``SKETCHES``
hash functions picks the ``PICKED`` labelled k-mers of smallest hash, and the
sketch is their hash in text order, so a sketch agrees only where both the
k-mers and their order do.

Texts that are equal go together first, by digest; what follows works on one
document of each distinct text.  Documents with an equal sketch are candidates:
all pairs of a bucket of up to ``SMALL`` documents; in a larger one each
document with the bucket's smallest id.  Larger buckets whose documents are not in one class yet then get rounds:
each document meets ``RING`` neighbours on either side, in a new random order,
that are of other classes and share ``SHARED`` of all sketches, until a round
adds no link.  The rounds only bring large classes together cheaply.  What they
leave is finished exactly: the documents of larger buckets that still hold
several classes are joined on the rarest shingles of each, as many as a
partner of the wanted similarity can't all lack.  A pair is made only if the
places of the shared shingle in both, counted from the rarest, allow the
similarity, so documents that have only a common passage make no pairs.

A pair is linked if its similarity is at least 0.8: the distinct five-word
shingles inside runs of the alignment, over those of both texts.  The alignment
is the one of fewest word insertions and deletions; it is looked for in the
band that a similarity of 0.8 leaves, counting repeated shingles.  Classes are the connected components.

Two texts of exactly 0.8 share none of the sketches with probability 3e-6;
every other pair is compared or already in one class.

Defined results for odd input: null and empty texts are equal texts, as are all
repeated rows; a text without words has no sketches and only equal texts as
partners; null doc_ids get the class of their text, null if no row of it has an
id; very long texts are compared whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import eq, itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import batched, releasing, rows_of, text_or_empty, words, written
from gridlake.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 24
PICKED = 4
SMALL = 32
RING = 2
SHARED = 4
BROADCAST_IDS = 1_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEEDS = (np.arange(1, SKETCHES + 1, dtype=np.uint64) * _B) ^ _A
_WIDE = 200_000


def word_codes(text: str) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(crc32, found), np.uint32, len(found))


def _mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(32))) * _A
    codes = (codes ^ (codes >> np.uint64(29))) * _B
    return codes ^ (codes >> np.uint64(32))


def shingles(codes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words, or the one of all words of a shorter text."""
    if not len(codes):
        return np.empty(0, np.uint64)
    size = min(size, len(codes))
    wide = codes.astype(np.uint64)
    out = np.zeros(len(codes) - size + 1, np.uint64)
    for k in range(size):
        out = out * _B + wide[k : k + len(out)]
    return _mixed(out + np.uint64(size))


def order_sketches(codes: np.ndarray) -> np.ndarray:
    """The Order MinHash sketches of a text's word codes, one 64-bit number each."""
    grams = shingles(codes)
    if not len(grams):
        return np.empty(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    places = np.arange(len(grams))
    seen = np.empty(len(grams), np.uint64)
    seen[order] = places - np.maximum.accumulate(np.where(new, places, 0))
    labelled = grams + seen * _A
    picked = min(PICKED, len(grams))
    step = max(1, _WIDE // len(grams))
    out = []
    for at in range(0, SKETCHES, step):
        ranks = _mixed(labelled[None, :] ^ _SEEDS[at : at + step, None])
        least = np.argpartition(ranks, picked - 1, axis=1)[:, :picked] if picked < len(grams) else np.tile(places, (len(ranks), 1))
        chosen = grams[np.sort(least, axis=1)]
        code = _SEEDS[at : at + step].copy()
        for k in range(picked):
            code = _mixed(code * _B + chosen[:, k])
        out.append(code)
    return np.concatenate(out)


# Alignment


def _same_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    most, step = min(len(a), len(b)), 32
    at = 0
    while at < most:
        upto = min(most, at + step)
        differs = a[at:upto] != b[at:upto]
        k = int(differs.argmax())
        if differs[k]:
            return at + k
        at, step = upto, step * 4
    return most


def aligned_runs(a: np.ndarray, b: np.ndarray, band: int) -> list[tuple[int, int, int]] | None:
    """Runs (start in a, start in b, length) of an alignment with at most ``band`` insertions and deletions."""
    n, m = len(a), len(b)
    reach = {1: 0}
    trace: list[dict[int, tuple[int, int]]] = []  # for each cost: diagonal -> (start, end in a) of its last run
    for cost in range(band + 1):
        step: dict[int, tuple[int, int]] = {}
        after: dict[int, int] = {}
        for k in range(-cost, cost + 1, 2):
            if k < -m or k > n:
                continue
            down, right = reach.get(k + 1, -1), reach.get(k - 1, -2) + 1
            x = max(down, right)
            if x < 0 or x > n or x - k > m:
                continue
            end = x + _same_run(a[x:], b[x - k :])
            step[k], after[k] = (x, end), end
            if end >= n and end - k >= m:
                trace.append(step)
                return _runs(trace, k)
        trace.append(step)
        reach = after
        if not after:
            return None
    return None


def _runs(trace: list[dict[int, tuple[int, int]]], k: int) -> list[tuple[int, int, int]]:
    out = []
    for cost in range(len(trace) - 1, -1, -1):
        x, end = trace[cost][k]
        if end > x:
            out.append((x, x - k, end - x))
        if cost:
            down = trace[cost - 1].get(k + 1, (0, -1))[1]
            right = trace[cost - 1].get(k - 1, (0, -2))[1] + 1
            k = k + 1 if down >= right else k - 1
    return out[::-1]


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two texts' word codes; 0 where it is known to be below ``least``."""
    left, right = shingles(a), shingles(b)
    mine, theirs = np.unique(left), np.unique(right)
    shared = len(np.intersect1d(mine, theirs, assume_unique=True))
    either = len(mine) + len(theirs) - shared
    if not either or shared < least * either:
        return 0.0
    # Shingles outside the runs are at most (1 - least) / (1 + least) of all, and an edit costs one at least.
    band = int((1 - least) / (1 + least) * (len(a) + len(b))) + 2 * SHINGLE
    runs = aligned_runs(a, b, band)
    if runs is None:
        return 0.0
    width = min(SHINGLE, len(a), len(b))
    inside = [left[x : x + size - width + 1] for x, _, size in runs if size >= width and len(a) >= SHINGLE]
    if len(a) < SHINGLE or len(b) < SHINGLE:
        inside = [left] if np.array_equal(a, b) else []
    found = len(np.unique(np.concatenate(inside))) if inside else 0
    return found / either


# Spark


def sketched(documents: DataFrame) -> DataFrame:
    """doc_id, digest of the text, and the sketches, of every document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc, text in rows_of(batches):
                digest = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                yield doc, digest, order_sketches(word_codes(text)).view(np.int64).tolist()

        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("sketches", pa.list_(pa.int64()))])
        yield from batched(rows(), schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, digest binary, sketches array<bigint>"), "sketched")


def _neighbours(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of rows (bucket, size, doc, label, sketches) of different labels.

    All pairs of a small bucket; in a larger one neighbours in a random order
    that share at least ``SHARED`` of their sketches.
    """
    spark = rows.sparkSession
    part = F.when(F.col("size") <= SMALL, 0).otherwise(F.pmod(F.xxhash64("doc", F.lit(turn)), F.ceil(F.col("size") / 1000)))
    rows = rows.withColumn("part", part.cast("int")).withColumn("spot", F.xxhash64("doc", "bucket", F.lit(turn)))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "part")
    rows = rows.sortWithinPartitions("bucket", "part", "spot").select("bucket", "part", "size", "doc", "label", "sketches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            key, held = None, []
            for bucket, part, size, doc, label, own in rows_of(batches):
                if (bucket, part) != key:
                    key, held = (bucket, part), []
                for other, its, theirs in held:
                    if its != label and (own is None or sum(map(eq, own, theirs)) >= SHARED):
                        yield min(doc, other), max(doc, other)
                held.append((doc, label, own))
                if len(held) > (SMALL if size <= SMALL else RING):
                    del held[0]

        yield from batched(pairs(), pa.schema([("a", pa.int64()), ("b", pa.int64())]), 20_000)

    return rows.mapInArrow(run, "a long, b long")


def _codes(documents: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """doc_id and word codes of the documents with these ids."""
    # Few ids are sent to every task; more are joined by shuffle.
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(few, "doc_id", "left_semi")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc, word_codes(text).tobytes()) for doc, text in rows_of(batches))
        yield from batched(rows, pa.schema([("doc_id", pa.int64()), ("codes", pa.binary())]))

    return written(texts.mapInArrow(code, "doc_id long, codes binary"), name).dropDuplicates(["doc_id"])


def _prefixes(docs: DataFrame, documents: DataFrame, least: float) -> DataFrame:
    """Rows (gram, doc, label, place, n): the rarest shingles of each of the docs (doc, label) that other classes have too.

    A partner of another class has at least ``least`` of a document's n
    shingles, so it has one of the n - ceil(least * n) + 1 that come first in
    an order of all shingles; ``place`` counts from the first.  The order puts
    shingles of one class alone before those that classes share, rarest first.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, label, codes in rows_of(releasing(batches)):
            own = np.unique(shingles(np.frombuffer(codes, np.uint32))).view(np.int64)
            for at in range(0, len(own), 50_000):
                part = own[at : at + 50_000]
                same = [pa.array(np.full(len(part), x)) for x in (doc, label, len(own))]
                yield pa.RecordBatch.from_arrays([pa.array(part), *same], names=["gram", "doc", "label", "n"])

    codes = _codes(documents, docs.select(F.col("doc").alias("doc_id")), "large_codes")
    coded = codes.join(docs, F.col("doc_id") == F.col("doc")).select("doc", "label", "codes")
    found = written(coded.mapInArrow(grams, "gram long, doc long, label long, n long"), "grams")
    counts = found.groupBy("gram").agg(F.count("*").alias("df"), F.min("label").alias("low"), F.max("label").alias("high"))
    shared = found.join(counts.filter("low < high").select("gram", "df"), "gram")
    last = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("df"), F.desc("gram")))
    rows = shared.withColumn("last", last).filter(F.col("last") >= F.ceil(least * F.col("n") - 1e-9))
    return written(rows.select("gram", "doc", "label", (F.col("n") - F.col("last")).alias("place"), "n"), "prefixes")


def _overlapping(rows: DataFrame, least: float) -> DataFrame:
    """Pairs of rows (gram, doc, label, place, n) of one gram and different labels that can be similar enough.

    If the gram is a pair's first common one, the pair has in common at most
    what follows in either, and all that comes before differs.
    """
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gram")
    rows = rows.sortWithinPartitions("gram", "place").select("gram", "doc", "label", "place", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groupby(rows_of(releasing(batches)), itemgetter(0)):
            doc, label, place, n = np.array([x[1:] for x in held], np.int64).T
            for k in range(1, len(doc)):
                after, others = n[k] - place[k], n[:k] - place[:k]
                either = place[k] + place[:k] + np.maximum(after, others)
                near = doc[:k][(np.minimum(after, others) >= least * either - 1e-6) & (label[:k] != label[k])]
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(near, doc[k])), pa.array(np.maximum(near, doc[k]))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, documents: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    pairs = written(pairs.filter("a < b").distinct(), "pairs")
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair_ids")
    codes = _codes(documents, ids, "pair_codes")
    left = codes.select(F.col("doc_id").alias("a"), F.col("codes").alias("left"))
    right = codes.select(F.col("doc_id").alias("b"), F.col("codes").alias("right"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for a, b, one, other in rows_of(batches):
                found = similarity(np.frombuffer(one, np.uint32), np.frombuffer(other, np.uint32), least)
                if found >= least:
                    yield a, b, found

        yield from batched(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())]))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return written(joined.mapInArrow(verify, "a long, b long, similarity double"), "verified")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds to rows with a column doc the label of its class."""
    return rows.join(labels, F.col("doc") == F.col("node"), "left").withColumn("label", F.coalesce("label", "doc")).drop("node")


def _of_many(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys with more than one label."""
    mixed = rows.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return rows.join(mixed, key, "left_semi")


def near_duplicates(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Per document row: doc_id and class_id, the smallest doc_id of its class."""
    rows = sketched(documents)
    firsts = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first")), "firsts")
    known = firsts.filter("first is not null").select(F.col("first").alias("doc_id"))
    distinct = rows.join(known, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    distinct = written(distinct.select(F.col("doc_id").alias("doc"), "sketches"), "distinct")
    sketches = distinct.select("doc", F.explode("sketches").alias("bucket"))
    sizes = sketches.groupBy("bucket").agg(F.count("*").alias("size"), F.min("doc").alias("hub")).filter("size > 1")
    members = written(sketches.join(sizes, "bucket"), "members")

    large = F.col("size") > SMALL
    none = F.lit(None).cast("array<bigint>").alias("sketches")
    small = members.filter(~large).select("bucket", "size", "doc", F.col("doc").alias("label"), none)
    pairs = _neighbours(small, 0).unionByName(members.filter(large).select(F.col("hub").alias("a"), F.col("doc").alias("b")))
    links = _verified(pairs, documents, least)
    labels = components(links)
    # One row a document, with its large buckets (SKETCHES at most), so that classes are attached once a document.
    of = members.filter(large).groupBy("doc").agg(F.collect_list(F.struct("bucket", "size")).alias("buckets"))
    turn, left, members = 1, None, written(of.join(distinct, "doc"), "large_members")
    while not members.isEmpty():
        named = _labelled(members, labels).select(F.inline("buckets"), "doc", "label", "sketches")
        left = written(_of_many(named, "bucket"), "large_named")
        more = _verified(_neighbours(left, turn), documents, least)
        if more.isEmpty():
            break
        links = written(links.unionByName(more), "verified")
        members = written(members.join(left.select("doc").distinct(), "doc", "left_semi"), "large_members")
        labels, turn = components(links), turn + 1

    if left is not None and not members.isEmpty():
        # Each large gram's document with the fewest rarer shingles first, so that few classes are left for all pairs.
        prefixes = _prefixes(left.select("doc", "label").distinct(), documents, least)
        grams = prefixes.groupBy("gram").agg(F.count("*").alias("size"), F.min(F.struct("place", "doc", "label")).alias("hub"))
        prefixes = written(prefixes.join(grams.filter("size > 1"), "gram"), "prefixes")
        small = _overlapping(_of_many(prefixes.filter(~large), "gram"), least)
        hubs = prefixes.filter(large & (F.col("hub.label") != F.col("label")))
        hubs = hubs.select(F.least("hub.doc", "doc").alias("a"), F.greatest("hub.doc", "doc").alias("b"))
        links = written(links.unionByName(_verified(small.unionByName(hubs), documents, least)), "verified")
        labels = components(links)
        rest = written(_of_many(_labelled(prefixes.filter(large).drop("label"), labels), "gram"), "prefixes")
        if not rest.isEmpty():
            links = written(links.unionByName(_verified(_overlapping(rest, least), documents, least)), "verified")
            labels = components(links)

    classes = firsts.join(labels, F.col("first") == F.col("node"), "left")
    classes = classes.select("digest", F.coalesce("label", "first").alias("class_id"))
    return rows.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id")

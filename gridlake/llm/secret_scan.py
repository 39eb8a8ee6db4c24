"""Secret scan: candidates from texts, false positives removed by a random forest.

A candidate is a run of at least twelve letters, digits and ``+/=_.@:-`` with a
digit in it.  The forest sees its length; its character transitions (mean log
probability of letter pairs as the corpus's words have them, share of changes
between kinds of characters); how much of its letters the corpus's frequent words
cover; the words of its path (the document's source); and the words and marks
beside it.  Words of path and neighbourhood go to a fixed number of slots by
hash.  The forest learns from labelled findings; ``known_findings`` gives such
labels by form where there are no others.

The word list is the ``DICTIONARY`` most frequent words of three to five letters,
counted over all documents.  Training uses at most ``TRAIN_ROWS`` labelled
findings, those of the smallest hash; every candidate is classified.

Defined results for odd input: null and empty texts have no candidates; a null
source has no path words; labels that match no candidate, or are null, are
ignored; without labels of both kinds there is no forest, and every candidate
is reported with null probability; repeated rows are reported again; further
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import batched, rows_of, text_or_empty, words, written

DICTIONARY = 5000
TRAIN_ROWS = 20_000
SLOTS = 16
TREES = 30
DEPTH = 8
SEED = 7
_CANDIDATE = re.compile(r"[A-Za-z0-9+/=_.@:-]{12,}")
_SIDE = re.compile(r"[^\W\d_]+|[=:\"'`]")
_KINDS = bytes(0 if 48 <= b <= 57 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 for b in range(256))
# Names that credentials are given.
_CREDENTIAL = re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential)s?\b\W{0,6}$")
_MAIL = re.compile(r"[^@]+@[^@]+\.[a-z]{2,}")


def word_counts(documents: DataFrame) -> DataFrame:
    """Rows (word, n) of the ASCII words of three to five letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for (text,) in rows_of(batches):
            counts.update(w for w in words(text) if 3 <= len(w) <= 5)
        rows = ((w.decode(), n) for w, n in counts.items() if w.isalpha())
        yield from batched(rows, pa.schema([("word", pa.string()), ("n", pa.int64())]), 50_000)

    texts = documents.select(text_or_empty().alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Features:
    """Features of candidates, from the frequent words and their counts."""

    def __init__(self, counts: list[tuple[str, int]]):
        self.words = {w for w, _ in counts}
        pairs: Counter = Counter()
        firsts: Counter = Counter()
        for word, n in counts:
            for pair in zip(word, word[1:]):
                pairs[pair] += n
                firsts[pair[0]] += n
        self.pairs: dict[tuple[str, str], float] = defaultdict(float)
        letters = "abcdefghijklmnopqrstuvwxyz"
        self.pairs.update({(a, b): math.log((pairs[a, b] + 1) / (firsts[a] + 26)) for a in letters for b in letters})

    def coverage(self, letters: str) -> float:
        """Share of the letters inside frequent words, the longest first from the left."""
        at = inside = 0
        while at < len(letters):
            size = next((k for k in (5, 4, 3) if letters[at : at + k] in self.words and len(letters) - at >= k), 0)
            inside += size
            at += size or 1
        return inside / len(letters) if letters else 0.0

    def of(self, found: str, left: list[str], right: list[str], path: str | None) -> list[float]:
        letters = re.findall(r"[a-z]+", found.lower())
        steps = [self.pairs[p] for run in letters for p in zip(run, run[1:])]
        kinds = found.encode("ascii").translate(_KINDS)
        changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / (len(found) - 1)
        shares = [kinds.count(k) / len(found) for k in range(4)]
        joined = "".join(letters)
        out = [float(len(found)), sum(steps) / len(steps) if steps else 0.0, changes, len(set(found)) / len(found), *shares]
        out += [self.coverage(joined), max((len(r) for r in letters), default=0) / len(found)]
        for some in (left[-2:], right[:2], re.findall(r"[^\W\d_]+", path or "")):
            slots = [0.0] * SLOTS
            for word in some:
                slots[crc32(word.lower().encode("utf-8", "surrogatepass")) % SLOTS] = 1.0
            out += slots
        return out


def candidates(documents: DataFrame, features: Features) -> DataFrame:
    """Rows (doc_id, start, end, found, label by form or null, features) of all candidates."""
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    doc_arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(doc_type, pa.string())
    sent = documents.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc, text, path in rows_of(batches):
                for m in _CANDIDATE.finditer(text):
                    found = m.group().rstrip(".:-=")
                    if len(found) < 12 or found.isalpha() or not any(c.isdigit() for c in found):
                        continue
                    before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 40]
                    vector = sent.value.of(found, _SIDE.findall(before), _SIDE.findall(after), path)
                    yield doc, m.start(), m.start() + len(found), found, known(found, before), vector

        schema = pa.schema(
            [("doc_id", doc_arrow), ("start", pa.int32()), ("end", pa.int32()), ("found", pa.string()),
             ("known", pa.int32()), ("features", pa.list_(pa.float64()))]
        )
        yield from batched(rows(), schema)

    rows = documents.select("doc_id", text_or_empty().alias("text"), F.col("source").cast("string").alias("path"))
    ddl = f"doc_id {doc_type}, start int, end int, found string, known int, features array<double>"
    return written(rows.mapInArrow(run, ddl), "candidates")


def known(found: str, before: str) -> int | None:
    """1 for what is assigned to a credential's name, 0 for mail addresses, plain numbers and addresses, else null."""
    if _CREDENTIAL.search(before):
        return 1
    if _MAIL.fullmatch(found) or re.fullmatch(r"[\d.:/-]+", found):
        return 0
    return None


def known_findings(found: DataFrame) -> DataFrame:
    """Labelled findings (doc_id, start, label) by form."""
    return found.filter("known is not null").select("doc_id", "start", F.col("known").alias("label"))


def scan(documents: DataFrame, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per candidate: doc_id, start, end (code points), found, probability and is_secret.

    ``labelled`` has doc_id, start and label (1 for a secret, 0 for none).
    """
    counts = word_counts(documents).orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()
    found = candidates(documents, Features([(r.word, r.n) for r in counts]))
    labels = (known_findings(found) if labelled is None else labelled.select("doc_id", "start", "label")).filter("label in (0, 1)")
    labels = labels.groupBy("doc_id", "start").agg(F.min("label").alias("label"))
    chosen = found.join(labels, ["doc_id", "start"]).select(F.col("label").cast("double").alias("label"), "features", "doc_id", "start")
    chosen = chosen.orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(train_rows)
    chosen = written(chosen.select("label", array_to_vector("features").alias("features")), "labelled")
    kinds = chosen.agg(F.countDistinct("label")).first()[0]
    rows = found.withColumn("vector", array_to_vector("features"))
    if kinds < 2:
        return found.select("doc_id", "start", "end", "found", F.lit(None).cast("double").alias("probability"), F.lit(True).alias("is_secret"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label").fit(chosen)
    scored = forest.setFeaturesCol("vector").transform(rows)
    probability = vector_to_array("probability")[1]
    return scored.select("doc_id", "start", "end", "found", probability.alias("probability"), (probability >= 0.5).alias("is_secret"))

"""Quality by an interpolated modified Kneser-Ney model of characters.

One model for each language is trained on trusted text: documents labelled of
good quality and not toxic.  Every task counts the character five-grams of its
trusted documents; the counts of all tasks meet by (language, n-gram).  Lower
orders count continuations (the distinct characters before an n-gram).
Discounts come from the counts of counts of each order and language, and the
interpolated probability of an n-gram is joined from its context's totals and
its suffix's probability, all as joins sharded by (language, n-gram).

An n-gram of characters is used rather than of words because the join of every
document's word n-grams with the counts would shuffle several times the corpus,
while the distinct character n-grams of a language are few.  Scoring looks
n-grams up in shards of at most about ``MODEL_ROWS`` rows, sent to the executors
one after the other: a shard holds the n-grams whose last two context
characters fall to it, so every position is scored in exactly one shard and the
sums of shards add up to the document's log probability.

A document's score is its mean negative log probability for a character, with
``PRIOR_CHARS`` characters of the language's mean added so that a very short
text says little; perplexity is its exponential.  A document is rejected above
its language's threshold: the ``QUANTILE`` of the scores of trusted documents
held out from training (one in ``HELD_OUT``), and a margin for their number.

Defined results for odd input: an empty or null text is kept, its perplexity
that of the language; a language without trusted text has no model, and its
documents are kept with null perplexity (a null language counts as one
language); labels with null values, or labelled twice in different ways, are not
trusted; repeated documents count again; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import batched, releasing, rows_of, text_or_empty, written

ORDER = 5
QUANTILE = 0.99
HELD_OUT = 4
PRIOR_CHARS = 50
MODEL_ROWS = 4_000_000
BROADCAST_IDS = 1_000_000
_START = 2
_CHUNK = 400_000
_SLOTS = 1 << 18
_PRIME = np.uint64(0x9FB21C651E98DF25)


# Counting


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after ORDER - 1 start marks, and the places of the real characters."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    lengths = np.array([len(r) for r in raw], np.int64)
    start = np.full(ORDER - 1, _START, "<u4")
    points = np.concatenate([x for r in raw for x in (start, r)]).astype(np.uint64)
    places = np.ones(len(points), bool)
    begins = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
    for k in range(ORDER - 1):
        places[begins + k] = False
    return points, np.flatnonzero(places)


def _hashes(points: np.ndarray, places: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hash of the ``size`` characters that end at each place."""
    codes = np.full(len(places), salt, np.uint64)
    for k in range(size - 1, -1, -1):
        codes ^= points[places - k]
        codes *= _PRIME
        codes ^= codes >> np.uint64(29)
    return codes


def _salt(lang: str, size: int) -> int:
    # Above all code points, also for the empty name: else the first character might turn one size into another.
    return (1 << 40) + (zlib.crc32(lang.encode()) << 8) + size + 1


def count_grams(documents: DataFrame) -> DataFrame:
    """Rows (lang, gram, n) of ORDER characters, summed over all documents with lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list] = defaultdict(list)

        def merge(lang: str) -> None:
            codes = np.concatenate([t[0] for t in totals[lang]])
            grams = np.concatenate([t[1] for t in totals[lang]])
            counts = np.concatenate([t[2] for t in totals[lang]])
            codes, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
            totals[lang] = [(codes, grams[first], np.bincount(inverse, weights=counts).astype(np.int64))]

        def add(lang: str, texts: list[str]) -> None:
            points, places = _points(texts)
            codes, first, counts = np.unique(_hashes(points, places, ORDER, 1), return_index=True, return_counts=True)
            spots = places[first][:, None] + np.arange(1 - ORDER, 1)
            totals[lang].append((codes, points[spots].astype("<u4"), counts))
            if len(totals[lang]) >= 16:
                merge(lang)

        for lang, texts in _by_language(rows_of(batches)):
            add(lang, texts)

        def rows():
            for lang in totals:
                merge(lang)
                _, grams, counts = totals[lang][0]
                for gram, n in zip(grams, counts.tolist()):
                    yield lang, gram.tobytes().decode("utf-32-le", "surrogatepass"), n

        schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
        yield from batched(rows(), schema, 50_000)

    counted = documents.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _by_language(rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language together, in chunks of about _CHUNK characters."""
    held: dict[str, list[str]] = defaultdict(list)
    weight: dict[str, int] = defaultdict(int)
    for lang, text in rows:
        if text:
            held[lang].append(text)
            weight[lang] += len(text)
            if weight[lang] >= _CHUNK:
                yield lang, held.pop(lang)
                weight[lang] = 0
    yield from held.items()


# The model


def _discount(n: Column, prefix: str = "d") -> Column:
    return F.when(n == 1, F.col(f"{prefix}1")).when(n == 2, F.col(f"{prefix}2")).otherwise(F.col(f"{prefix}3"))


def _discounts(counts: DataFrame) -> DataFrame:
    """Per language and order the three discounts; fixed ones where the counts of counts leave one open."""
    of = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def one(k: int) -> Column:
        value = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{k}") > 0)
        return F.when(known, F.greatest(F.least(value, F.lit(k - 0.05)), F.lit(0.05))).otherwise(k - 0.5).alias(f"d{k}")

    return counts.groupBy("lang", "size").agg(*of).select("lang", "size", one(1), one(2), one(3))


def train(trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (lang, text): n-grams (lang, size, gram, p) and contexts (lang, size, context, back_off).

    All orders go through the same few plans; every plan and every table sent
    out costs the driver memory.  Only the probabilities follow one another.
    """
    counts = {ORDER: written(count_grams(trusted), "grams")}
    for size in range(ORDER - 1, 0, -1):
        longer = counts[size + 1]
        shorter = longer.groupBy("lang", F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n"))
        counts[size] = written(shorter, "grams")
    rows = _union([counts[size].select("lang", F.lit(size).alias("size"), "gram", "n") for size in counts])
    discounts = written(_discounts(rows), "discounts")
    rows = rows.join(F.broadcast(discounts), ["lang", "size"])  # a row for each language and order
    rows = rows.withColumn("context", F.expr("substring(gram, 1, size - 1)"))
    totals = rows.groupBy("lang", "size", "context").agg(
        F.sum("n").alias("total"), F.sum(_discount(F.col("n"))).alias("given"), F.count("*").alias("kinds")
    )
    # The lowest order is interpolated with the uniform distribution over the seen characters and one for all others.
    back_off = F.col("given") / F.col("total")
    back_off = F.when(F.col("size") == 1, back_off / (F.col("kinds") + 1)).otherwise(back_off)
    totals = written(totals.select("lang", "size", "context", "total", back_off.alias("back_off")), "totals")
    own = (F.col("n") - _discount(F.col("n"))) / F.col("total")
    rows = rows.join(totals, ["lang", "size", "context"])
    rows = written(rows.select("lang", "size", "gram", own.alias("own"), "back_off"), "own")
    grams: list[DataFrame] = []
    for size in range(1, ORDER + 1):
        of_size, below = rows.filter(F.col("size") == size), F.lit(1.0)
        if grams:
            lower = grams[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_below"))
            of_size = of_size.withColumn("suffix", F.substring("gram", 2, size - 1)).join(lower, ["lang", "suffix"])
            below = F.col("p_below")
        p = F.col("own") + F.col("back_off") * below
        grams.append(written(of_size.select("lang", "size", "gram", p.alias("p")), "model"))
    return _union(grams), totals.select("lang", (F.col("size") - 1).alias("size"), "context", "back_off")


def _union(parts: list[DataFrame]) -> DataFrame:
    return parts[0] if len(parts) == 1 else parts[0].unionByName(_union(parts[1:]))


class _Table:
    """64-bit hashes to numbers; sorted hashes are found by their leading bits."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order].astype(np.float32)
        self.bits = max(4, int(len(codes)).bit_length() + 2)
        self.begins = np.full((1 << self.bits) + 1, len(codes), np.int32)
        for k in range(0, 1 << self.bits, _SLOTS):
            slots = np.arange(k, min(k + _SLOTS, 1 << self.bits), dtype=np.uint64)
            self.begins[k : k + len(slots)] = np.searchsorted(self.codes, slots << np.uint64(64 - self.bits))
        self.deepest = int(np.diff(self.begins).max()) if len(codes) else 0

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The number of each hash, NaN where there is none."""
        out = np.full(len(codes), np.nan, np.float32)
        if not self.deepest:
            return out
        slots = (codes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.begins[slots], self.begins[slots + 1]
        open_ = np.flatnonzero(at < end)
        for k in range(self.deepest):
            spots = at[open_] + k
            hit = self.codes[spots] == codes[open_]
            out[open_[hit]] = self.values[spots[hit]]
            open_ = open_[~hit & (spots + 1 < end[open_])]
            if not len(open_):
                break
        return out


def _coded(langs: list, sizes: list, texts: list, extra: int) -> np.ndarray:
    """Hashes of n-grams of one language and size each."""
    codes = np.zeros(len(texts), np.uint64)
    groups: dict[tuple[str, int], list[int]] = defaultdict(list)
    for k, key in enumerate(zip(langs, sizes)):
        groups[key].append(k)
    for (lang, size), places in groups.items():
        joined = "".join(texts[k] for k in places).encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(joined, "<u4").astype(np.uint64)
        ends = np.arange(1, len(places) + 1, dtype=np.int64) * size - 1
        codes[places] = _hashes(points, ends, size, _salt(lang, size + extra))
    return codes


def _numbers(rows: DataFrame, column: str, value: str, extra: int) -> _Table:
    """The table of a shard's n-grams or contexts; tasks hash them, so only numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in releasing(batches):
            langs, sizes, texts, values = (c.to_pylist() for c in batch.columns)
            codes = _coded(langs, sizes, texts, extra).view(np.int64)
            logs = np.log(np.maximum(np.array(values, np.float64), 1e-300)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(logs)], ["code", "value"])

    found = rows.select("lang", "size", column, value).mapInArrow(run, "code long, value float").toArrow()
    return _Table(found.column("code").to_numpy().view(np.uint64), found.column("value").to_numpy())


class _Shard:
    """N-grams and contexts of one shard."""

    def __init__(self, grams: DataFrame, contexts: DataFrame, number: int, shards: int):
        self.number, self.shards = number, shards
        self.grams = _numbers(grams, "gram", "p", 0)
        self.contexts = _numbers(contexts, "context", "back_off", 100)
        # A row for each language.
        self.unseen = {r.lang: float(np.log(r.back_off)) for r in contexts.filter("size = 0").collect()}

    def score(self, lang: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log probabilities of the texts' characters that fall to this shard, and their number."""
        points, places = _points(texts)
        lengths = np.array([len(t) for t in texts])
        owner = np.repeat(np.arange(len(texts)), lengths)
        if self.shards > 1:
            mine = (points[places - 2] * np.uint64(31) + points[places - 1]) % np.uint64(self.shards) == self.number
            places, owner = places[mine], owner[mine]
        logs = np.zeros(len(places), np.float64)
        open_ = np.arange(len(places))
        for size in range(ORDER, 0, -1):
            found = self.grams.find(_hashes(points, places[open_], size, _salt(lang, size)))
            seen = ~np.isnan(found)
            logs[open_[seen]] += found[seen]
            open_ = open_[~seen]
            if not len(open_):
                break
            if size > 1:
                back = self.contexts.find(_hashes(points, places[open_] - 1, size - 1, _salt(lang, size - 1 + 100)))
                logs[open_] += np.nan_to_num(back)
            else:
                logs[open_] += self.unseen[lang]
        return np.bincount(owner, logs, len(texts)), np.bincount(owner, minlength=len(texts))


def log_probabilities(documents: DataFrame, grams: DataFrame, contexts: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """Adds log_p and n to rows (doc_id, lang, text), without the text; a language without a model gets null."""
    spark = documents.sparkSession
    shards = max(1, -(-(grams.count() + contexts.count()) // model_rows))

    def part(frame: DataFrame, column: str, tail: int, number: int) -> DataFrame:
        # The last two context characters decide; rows that hold fewer are in every shard.
        length = F.char_length(column)
        first, second = F.substring(column, -1 - tail, 1), F.substring(column, -tail, 1)
        shard = F.pmod(F.ascii(first) * 31 + F.ascii(second), F.lit(shards))
        return frame.filter((length < tail + 1) | (shard == number))

    frame = documents.select("doc_id", "lang", "text", F.lit(0.0).alias("log_p"), F.lit(0).cast("long").alias("n"))
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    for number in range(shards):
        shard = _Shard(part(grams, "gram", 2, number), part(contexts, "context", 1, number), number, shards)
        sent, last = spark.sparkContext.broadcast(shard), number == shards - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for batch in releasing(batches):
                langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                log_p = np.array(batch.column(3).to_pylist(), np.float64)
                n = np.array(batch.column(4).to_pylist(), np.int64)
                groups: dict[str, list[int]] = defaultdict(list)

                def flush(lang: str) -> None:
                    places = groups.pop(lang)
                    sums, numbers = model.score(lang, [texts[k] for k in places])
                    log_p[places] += sums
                    n[places] += numbers

                weight: dict[str, int] = defaultdict(int)
                for k, (lang, text) in enumerate(zip(langs, texts)):
                    if lang in model.unseen and text:
                        groups[lang].append(k)
                        weight[lang] += len(text)
                        if weight[lang] >= _CHUNK:
                            flush(lang)
                            weight[lang] = 0
                for lang in list(groups):
                    flush(lang)
                known = np.array([lang in model.unseen for lang in langs], bool)
                columns = [batch.column(0), batch.column(1), *([] if last else [batch.column(2)])]
                columns += [pa.array(log_p, pa.float64(), mask=~known if last else None), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", *([] if last else ["text"]), "log_p", "n"])

        middle = "" if last else "text string, "
        frame = frame.mapInArrow(run, f"doc_id {doc_type}, lang string, {middle}log_p double, n long")
    return frame


# Scores and thresholds


def _trusted_ids(labels: DataFrame) -> DataFrame:
    good = F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False)))
    return labels.groupBy("doc_id").agg(good.alias("good")).filter("good and doc_id is not null").select("doc_id")


def _held_out() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0


def scores(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, model_rows: int = MODEL_ROWS) -> DataFrame:
    """Per document row: doc_id, lang, n_chars, perplexity, threshold and kept."""
    rows = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text_or_empty().alias("text"))
    ids = written(_trusted_ids(labels), "trusted_ids")
    # Few ids are sent to every task; more are joined by shuffle.
    few = F.broadcast if ids.count() <= BROADCAST_IDS else (lambda frame: frame)
    grams, contexts = train(rows.filter(~_held_out()).join(few(ids), "doc_id", "left_semi"))
    scored = written(log_probabilities(rows, grams, contexts, model_rows), "scores")
    trusted = scored.join(few(ids), "doc_id", "left_semi")
    means = trusted.groupBy("lang").agg((-F.sum("log_p") / F.sum("n")).alias("mean"))
    with_mean = scored.join(F.broadcast(means), "lang", "left")  # a row for each language
    score = (-F.col("log_p") + PRIOR_CHARS * F.col("mean")) / (F.col("n") + PRIOR_CHARS)
    with_score = with_mean.withColumn("score", score)
    held = with_score.filter(_held_out()).join(few(ids), "doc_id", "left_semi")
    # Few held-out documents say little about the tail: the margin is three standard errors of their mean.
    margin = 3 * F.coalesce(F.stddev("score"), F.lit(1.0)) / F.sqrt(F.count("score"))
    limits = held.groupBy("lang").agg((F.percentile_approx("score", quantile, 10_000) + margin).alias("limit"))
    kept = F.coalesce(F.col("score") <= F.col("limit"), F.lit(True))
    return with_score.join(F.broadcast(limits), "lang", "left").select(
        "doc_id", "lang", F.col("n").alias("n_chars"), F.exp("score").alias("perplexity"),
        F.exp("limit").alias("threshold"), kept.alias("kept"),
    )



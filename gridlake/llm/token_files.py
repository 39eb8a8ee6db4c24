"""Token ids in files of a byte-aligned variable-length code.

A file block holds the ids of documents in ascending order.  Its ids are
replaced by their rank in the block's own frequency table, most frequent first
(ties: the smaller id), and each rank takes one to four bytes, little-endian,
without leading zero bytes.  The lengths lie apart, two bits for each token,
four to a control byte (lowest bits first).  The block's columns are

    part, block       the order of blocks
    doc_ids           the documents, in order
    counts            tokens of each document
    ranks             the frequency table: the id of each rank
    control, data     control bytes and data bytes

stored as Parquet through Spark's writer, so a failed task leaves nothing
behind and any store Spark can write will do.  Each block counts all of its own
tokens, so there is no pass over the corpus before the first byte is written,
and a block is decoded by itself: a table lookup gives the four lengths of each
control byte, a running sum the places, and numpy gathers the bytes.

Defined results for odd input: a null or empty text has only the end id; null
doc_ids come first; rows of equal doc_id are ordered by a hash of the text and
repeated rows are all written; an empty table gives no blocks; a very long text
may make a block longer than the target, never split; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import batched, release, rows_of, text_or_empty, written

END = 2
BLOCK_TOKENS = 1_000_000
CACHED_PIECES = 300_000
LONGEST_PIECE = 64

_STEP = 1 << 18
_LOOKUP = 1 << 20
_TEXTS = 600
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Rank table, control bytes and data bytes of uint32 ids."""
    top = int(ids.max()) + 1 if len(ids) else 0
    if top <= 1 << 22:
        counts = np.bincount(ids, minlength=top)
        used = np.flatnonzero(counts)
        used = used[np.argsort(-counts[used], kind="stable")]
        place = np.zeros(top, np.uint32)
        place[used] = np.arange(len(used), dtype=np.uint32)
        ranks = place[ids]
    else:
        values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(values), np.uint32)
        place[order] = np.arange(len(values), dtype=np.uint32)
        used, ranks = values[order], place[inverse]
    sizes = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = sizes - 1
    control = (padded.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(axis=1, dtype=np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4, dtype=np.uint8) < sizes[:, None]]
    return used.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_block(ranks: bytes, control: bytes, data: bytes, count: int) -> np.ndarray:
    """The uint32 ids of a block."""
    sizes = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    values = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(sizes > k)
        if not len(longer):
            break
        values[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranks, "<u4")[values]


# Classes of bytes: letters (ASCII and U+00C0 to U+023F), digits, ASCII punctuation, the apostrophe, the space, the line end,
# other characters outside ASCII, and all that may be white space or is a control character.
_LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _LINE, _OTHER, _UNSURE = range(8)


def _classes() -> np.ndarray:
    table = np.full(256, _UNSURE, np.uint8)
    table[0x21:0x7F] = _MARK
    for low, high in ("AZ", "az"):
        table[ord(low) : ord(high) + 1] = _LETTER
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[[ord("'"), ord(" "), ord("\n")]] = _QUOTE, _SPACE, _LINE
    table[0x80:], table[0xC3:0xC9] = _OTHER, _LETTER
    return table


def _sure() -> np.ndarray:
    """Whether the byte-level split cuts between two classes, wherever they meet."""
    table = np.zeros((8, 8), bool)
    table[np.ix_([_LETTER, _DIGIT, _MARK, _QUOTE, _OTHER], [_SPACE, _LINE])] = True
    table[np.ix_([_LETTER, _DIGIT, _MARK], [_LETTER, _DIGIT, _MARK])] = ~np.eye(3, dtype=bool)
    table[[_LETTER, _DIGIT], _QUOTE] = True
    return table.reshape(-1)


_CLASSES, _SURE = _classes(), _sure()


def sure_cuts(raw: np.ndarray) -> np.ndarray:
    """Per byte of UTF-8 texts, whether the byte-level split surely cuts before it.

    It takes a space with the letters, digits or other characters that follow
    it, and an apostrophe with some letters, so it cuts where letters, digits
    and punctuation meet, before white space that follows another character,
    and after a single line end between two of them.
    """
    kinds = _CLASSES[raw]
    two = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC8))
    kinds[two + 1] = _LETTER
    signs = two[(raw[two] == 0xC3) & ((raw[two + 1] == 0x97) | (raw[two + 1] == 0xB7))]  # multiplication and division
    kinds[signs], kinds[signs + 1] = _OTHER, _OTHER
    two = np.flatnonzero(raw == 0xC2) + 1
    kinds[two[(raw[two] == 0x85) | (raw[two] == 0xA0)]] = _UNSURE
    three = np.flatnonzero((raw >= 0xE1) & (raw <= 0xE3))
    first, second, third = raw[three], raw[three + 1], raw[three + 2]
    wide = (third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)
    white = (first == 0xE1) & ((second == 0x9A) | (second == 0xA0))
    white |= (first == 0xE2) & ((second == 0x80) & wide | (second == 0x81) & (third == 0x9F))
    white |= (first == 0xE3) & (second == 0x80) & (third == 0x80)
    kinds[three[white] + 2] = _UNSURE
    cuts = np.empty(len(raw), bool)
    cuts[:1] = True
    cuts[1:] = _SURE[kinds[:-1] * np.uint8(8) + kinds[1:]]
    line = np.flatnonzero(kinds[1:-1] == _LINE) + 1
    cuts[line[cuts[line] & (kinds[line + 1] <= _QUOTE)] + 1] = True
    return cuts


class _Kept:
    """Pieces and their ids: an Arrow array of the pieces, and their ids one after the other."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.pieces = pa.array([], pa.large_string())
        self.ids, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int32)

    def __len__(self) -> int:
        return len(self.pieces)

    def places(self, pieces: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The place of each piece among the kept ones and, after them, the distinct others, which come second."""
        both = pa.concat_arrays([self.pieces, pieces]).dictionary_encode()
        return both.indices.to_numpy()[len(self) :], both.dictionary[len(self) :]

    def add(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray, room: int) -> None:
        """Keeps the first pieces of at most LONGEST_PIECE bytes, as far as there is room."""
        some = np.flatnonzero(pc.binary_length(pieces).to_numpy() <= LONGEST_PIECE)[:room]
        chosen = np.zeros(len(pieces), bool)
        chosen[some] = True
        self.pieces = pa.concat_arrays([self.pieces, pieces.take(pa.array(some))])
        self.ids = np.r_[self.ids, ids[np.repeat(chosen, sizes)]]
        self.sizes = np.r_[self.sizes, sizes[some]]


class WordEncoder:
    """Whole-text ids from the tokenizer, which sees each distinct piece of text once while it is kept.

    Texts are cut where the byte-level split is sure to cut, and the pieces'
    ids joined.  Places are found by numpy and the kept pieces by Arrow, so
    only those not kept yet become Python strings.  The number of kept pieces
    is bounded; the others are encoded anew.
    """

    def __init__(self, path: str, kept: int = CACHED_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = kept
        self.kept = _Kept()
        pieces = (self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size()))
        self.starts = np.array([p.startswith("Ġ") for p in pieces])
        self.line = self.tokenizer.token_to_id("Ċ")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        plain = [k for k, text in enumerate(texts) if not any(s in text for s in self.special)]
        found = dict(zip(plain, self._joined([texts[k] for k in plain])))
        return [found[k] if k in found else self.ids(text).tobytes() for k, text in enumerate(texts)]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens, from those of their pieces."""
        column = pa.array(texts, pa.large_string())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(texts) + 1) if texts else np.zeros(1, np.int64)
        if not bounds[-1]:
            return [b""] * len(texts)
        raw = np.frombuffer(data, np.uint8, bounds[-1])
        cuts = sure_cuts(raw)
        cuts[bounds[bounds < len(raw)]] = True
        at = np.r_[np.flatnonzero(cuts), len(raw)]
        parts, counts = [], []
        for k in range(0, len(at) - 1, _LOOKUP):
            some = at[k : k + _LOOKUP + 1]
            ids, sizes = self._pieces(pa.LargeStringArray.from_buffers(len(some) - 1, pa.py_buffer(some), data))
            parts.append(ids)
            counts.append(sizes)
        joined = np.concatenate(parts)
        limits = np.r_[0, np.cumsum(np.concatenate(counts), dtype=np.int64)][np.searchsorted(at, bounds)].tolist()
        return [joined[a:b].tobytes() for a, b in zip(limits, limits[1:])]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and their number for each piece."""
        places, others = self.kept.places(pieces)
        ids, sizes = self.kept.ids, self.kept.sizes
        if len(others):
            found = self._encoded(others.to_pylist())
            own, lengths = np.frombuffer(b"".join(found), "<u4"), np.fromiter((len(x) // 4 for x in found), np.int32, len(found))
            del found
            ids, sizes = np.r_[ids, own], np.r_[sizes, lengths]
            room = self.most - len(self.kept)
            if room > 0:
                self.kept.add(others, own, lengths, room)
        counts, begins = sizes[places], (np.cumsum(sizes, dtype=np.int64) - sizes)[places]
        ends = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        joined = np.empty(ends[-1], "<u4")
        for k in range(0, len(places), _STEP):
            some = slice(k, min(k + _STEP, len(places)))
            low, high = ends[some.start], ends[some.stop]
            # A piece's place among the known ids, less its place in the text.
            joined[low:high] = ids[np.repeat(begins[some] - ends[:-1][some], counts[some]) + np.arange(low, high)]
        return joined, counts

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found: list[bytes | None] = [None] * len(pieces)
        spaced, bare = [], []
        for k, piece in enumerate(pieces):
            if piece.rfind(" ") == 0 and not piece[-1].isspace():
                spaced.append(k)
            elif piece.split() == [piece]:
                bare.append(k)
        self._together(pieces, spaced, found)
        self._lines(pieces, bare, found)
        return [self.ids(pieces[k]).tobytes() if x is None else x for k, x in enumerate(found)]

    def _together(self, pieces: list[str], spaced: list[int], found: list[bytes | None]) -> None:
        """Fills in the ids of pieces that have a space only at their begin, many at a time."""
        for n in range(0, len(spaced), 1000):
            some = spaced[n : n + 1000]
            ids = self.ids("".join([pieces[k] for k in some]))
            bounds = np.flatnonzero(self.starts[ids])
            if len(bounds) != len(some):
                continue
            raw, ends = ids.tobytes(), [*bounds[1:].tolist(), len(ids)]
            for k, a, b in zip(some, bounds.tolist(), ends):
                found[k] = raw[4 * a : 4 * b]

    def _lines(self, pieces: list[str], bare: list[int], found: list[bytes | None]) -> None:
        """Fills in the ids of pieces without white space, as many lines: a line end before another character stays alone."""
        if self.line is None:
            return
        for n in range(0, len(bare), 1000):
            some = bare[n : n + 1000]
            ids = self.ids("\n".join([pieces[k] for k in some]))
            bounds = np.flatnonzero(ids == self.line)
            if len(bounds) != len(some) - 1:
                continue
            raw = ids.tobytes()
            for k, a, b in zip(some, [0, *(bounds + 1).tolist()], [*bounds.tolist(), len(ids)]):
                found[k] = raw[4 * a : 4 * b]


_encoders: dict[tuple, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file, kept while the worker lives."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


_BLOCK = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()),
     ("n_tokens", pa.int64()), ("ranks", pa.binary()), ("control", pa.binary()), ("data", pa.binary())]
)
_BLOCK_DDL = (
    "part int, block int, doc_ids array<bigint>, counts binary, n_tokens long, ranks binary, control binary, data binary"
)


def write_blocks(
    documents: DataFrame,
    encoder: Callable[[], Callable[[list[str]], list[bytes]]],
    end: int = END,
    block_tokens: int = BLOCK_TOKENS,
    partitions: int | None = None,
) -> DataFrame:
    """Writes the blocks and returns them as read back; doc_id must be an integer column.

    ``encoder`` makes, on a worker, the function from texts to ids.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    count = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).select("doc_id", "text")
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(), TaskContext.get().partitionId()

        def blocks():
            held, docs, counts, number = bytearray(), [], [], 0

            def block():
                ids = np.frombuffer(bytes(held), "<u4")
                return (part, number, docs, np.array(counts, "<u4").tobytes(), len(ids), *encode_block(ids))

            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at in range(0, len(texts), _TEXTS):
                    for doc, code in zip(ids[at : at + _TEXTS], encode(texts[at : at + _TEXTS])):
                        held += code
                        held += last
                        docs.append(doc)
                        counts.append(len(code) // 4 + 1)
                        if len(held) >= 4 * block_tokens:
                            yield block()
                            held, docs, counts, number = bytearray(), [], [], number + 1
                            release()
            if docs:
                yield block()

        yield from batched(blocks(), _BLOCK, 1)

    return written(rows.mapInArrow(run, _BLOCK_DDL), "token_blocks")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids (binary, little-endian uint32)."""
    sums = blocks.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each block: a few bytes for some megabytes of text.
    bases = sums.select("part", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = blocks.join(written(bases, "token_bases"), ["part", "block"]).select(
        "base", "doc_ids", "counts", "n_tokens", "ranks", "control", "data"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for base, docs, counts, n, ranks, control, data in rows_of(batches):
                ids = decode_block(ranks, control, data, n).astype("<u4")
                at = 0
                for doc, count in zip(docs, np.frombuffer(counts, "<u4").tolist()):
                    yield doc, base + at, count, ids[at : at + count].tobytes()
                    at += count

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        yield from batched(rows(), schema)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def ids_crc32(frame: DataFrame) -> DataFrame:
    """Replaces the ids by their unsigned crc32; crc32 is one of Spark's functions."""
    return frame.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

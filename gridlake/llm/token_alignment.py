"""Alignment of two tokenizers' tokens of the same text.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B
(SentencePiece) the text, to which it adds the space itself, so the tokens of
both spell the same bytes.  For a batch of texts, one after the other on a
byte axis, the incidence matrices A and B (tokens x bytes) are built in
compressed rows.  The nonzeros of A B' are the overlap links: pairs of tokens
that share bytes, with the number of bytes.  Offsets where both tokenizers end
a token cut the tokens into groups; with the incidence of tokens and groups
GA and GB, the nonzeros of GA GB' are the shared-group links.  Products
go row by row (Gustavson) in blocks of rows, so long texts need no more memory.

A group's tokens may all be linked with each other; such links are counted by
the product of GA with the group sizes GB' 1, and listed only on request.

Links of an id pair are counted by the documents that hold the pair, over the
whole corpus, with partial counts in each task.  Every document then meets the
counts of its pairs: the ``BROADCAST_PAIRS`` pairs of most documents at most are sent
to all tasks (about 16 bytes each), whatever the corpus; the remaining pairs, of fewer documents each,
are joined by shuffle, so no common pair becomes a hot key.

Defined results for odd input: texts that are null or empty, or whose tokens of
A or B spell other bytes than a space and the text (B writes some characters
anew), have no tokens and no links; special tokens' strings inside a text are
plain text; a repeated row, or id, is a document of its own; very long texts are
aligned whole; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import text_or_empty, written
from gridlake.llm.sparse import Csr
from gridlake.llm.token_files import WordEncoder

BROADCAST_PAIRS = 1_000_000
CACHED_WORDS = 250_000
_BATCH_BYTES = 1 << 20
_MARK = "▁"
_SEGMENT = re.compile(f"{_MARK}+[^{_MARK}\n]*|[^{_MARK}\n]+|\n")


class ByteTokens:
    """Ids of a space and the text by a byte-level tokenizer; a token's bytes."""

    def __init__(self, path: str, kept: int = CACHED_WORDS):
        self.words = WordEncoder(path, kept)
        self.words.tokenizer.encode_special_tokens = True
        self.words.special = []
        self.first = len(self.words.ids("x"))
        size = self.words.tokenizer.get_vocab_size()
        # The byte-level alphabet: printable bytes stand for themselves, the others for 256 and on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        spelled = [self.words.tokenizer.id_to_token(k) or "" for k in range(size)]
        self.bytes = [bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode() for s in spelled]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        # Tokens never go on over the white space after a character, so the first tokens are those of the x alone,
        # and every word of the text is one after a space.
        return [np.frombuffer(ids, "<u4")[self.first :].astype(np.int64) for ids in self.words(["x " + t for t in texts])]


class PieceTokens:
    """Ids of a text by a SentencePiece model that adds a first space; a token's bytes.

    No piece joins a character with a space or line end after it, so the
    words' ids, each found once while it is kept, make up the text's.
    """

    def __init__(self, path: str, kept: int = CACHED_WORDS):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        model, numbers = self.model, range(self.model.get_piece_size())
        spelled = [model.id_to_piece(k) for k in numbers]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace(_MARK, " ").encode()
            for k, p in zip(numbers, spelled)
        ]
        plain = [p for k, p in zip(numbers, spelled) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        self.by_word = not any(re.search(f"[^{_MARK}]{_MARK}|\n", p) for p in plain)
        line = model.encode("\n")
        self.line = line[-1] if len(line) == 2 and self.bytes[line[-1]] == b"\n" else None
        self.kept, self.rows = kept, {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word or self.line is None:
            return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]
        cut = [_SEGMENT.findall(_MARK + t.replace(" ", _MARK)) if t else [] for t in texts]
        rows = self.rows
        missing = list(dict.fromkeys(s for segments in cut for s in segments if s not in rows))
        fresh = dict(self._encode(missing))
        out = [np.frombuffer(b"".join([rows.get(s) or fresh[s] for s in segments]), "<u4").astype(np.int64) for segments in cut]
        if len(rows) < self.kept:
            rows.update((s, r) for s, r in fresh.items() if len(s) <= 64)
        return out

    def _encode(self, segments: list[str]) -> Iterator[tuple[str, bytes]]:
        lines = [s for s in segments if s != "\n"]
        if len(lines) < len(segments):
            yield "\n", np.array([self.line], "<u4").tobytes()
        for at in range(0, len(lines), 1000):
            some = lines[at : at + 1000]
            # After a line end the model adds no space of its own, and the line end is a token by itself.
            ids = np.array(self.model.encode("\n" + "\n".join(some).replace(_MARK, " ") + "\n"), "<u4")
            ends = np.flatnonzero(ids == self.line)
            yield from ((s, ids[a + 1 : b].tobytes()) for s, a, b in zip(some, ends[:-1].tolist(), ends[1:].tolist(), strict=True))


class Segments:
    """Ids of both tokenizers for the segments of texts, each found once while it is kept.

    In texts whose white space is spaces and line ends, both tokenizers end a
    token before each run of white space, and around a single line end between
    characters.  A segment is a word with the space before it, such a line end, a word
    after one, or a longer run of white space with the word after it.  Many are encoded at once, and
    the tokens are dealt out by their bytes; where those differ from the text, each is encoded by itself.
    """

    PATTERN = re.compile(r" ?\S+|(?<=\S)\n(?=\S)|[ \n]+\S*")
    IRREGULAR = re.compile(rf"[^\S \n]|{_MARK}")
    TOGETHER = 500

    def __init__(self, a: ByteTokens, b: PieceTokens, kept: int):
        self.kept = kept
        tokenizer, model = a.words.tokenizer, b.model
        self.sides = (
            (lambda text: tokenizer.encode(text, add_special_tokens=False).ids, a.bytes, np.array([len(x) for x in a.bytes])),
            # After a line end the model adds no space of its own.
            (lambda text: model.encode("\n" + text)[2:], b.bytes, np.array([len(x) for x in b.bytes])),
        )
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.pools = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.good = np.zeros(0, bool)

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides for each text; none where a side spells other bytes than the text."""
        if len(self.slots) > self.kept or sum(map(len, self.pools)) > 16 * self.kept:
            self._clear()
        cut = [self.PATTERN.findall(" " + t) for t in texts]
        flat = [s for segments in cut for s in segments]
        found = list(map(self.slots.get, flat))
        if None in found:
            self._add(list(dict.fromkeys(s for s, k in zip(flat, found) if k is None)))
            found = list(map(self.slots.__getitem__, flat))
        slots = np.array(found, np.int64)
        bounds = np.cumsum([0, *map(len, cut)])
        good = np.concatenate([[0], np.cumsum(~self.good[slots])])[bounds]
        good = good[1:] == good[:-1]
        parts = []
        for pool, ends in zip(self.pools, self.ends):
            starts, sizes = ends[slots], ends[slots + 1] - ends[slots]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            whole = pool[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], sizes)]
            parts.append(np.split(whole, upto[bounds[1:-1]]))
        none = np.zeros(0, np.int64)
        return [(a, b) if ok else (none, none) for a, b, ok in zip(*parts, good)] if texts else []

    def _add(self, segments: list[str]) -> None:
        kinds: tuple[list[str], list[str], list[str]] = ([], [], [])
        for s in segments:
            kinds[2 if "\n" in s or s[:2] in (" ", "  ") else 0 if s[0] == " " else 1].append(s)
        segments = [s for kind in kinds for s in kind]
        good = np.ones(len(segments), bool)
        lengths = [np.array([len(s.encode()) for s in kind], np.int64) for kind in kinds]
        for side, (encode, spelled, sizes) in enumerate(self.sides):
            ids, counts, done = [self.pools[side]], [], 0
            for kind, glue, length in zip(kinds, ("", "\n", None), lengths):
                for at in range(0, len(kind), self.TOGETHER):
                    some = kind[at : at + self.TOGETHER]
                    together = None if glue is None else self._together(some, glue, length[at : at + self.TOGETHER], encode, spelled, sizes)
                    if together:
                        ids.append(together[0])
                        counts.append(together[1])
                    else:
                        alone = [np.array(encode(s), np.int64) for s in some]
                        ids += alone
                        counts.append(np.array([len(x) for x in alone], np.int64))
                        held = slice(done, done + len(some))
                        good[held] &= [b"".join([spelled[k] for k in x.tolist()]) == s.encode() for x, s in zip(alone, some)]
                    done += len(some)
            self.pools[side] = np.concatenate(ids)
            self.ends[side] = np.concatenate([self.ends[side], self.ends[side][-1] + np.cumsum(np.concatenate(counts))])
        self.slots.update(zip(segments, range(len(self.slots), len(self.slots) + len(segments))))
        self.good = np.concatenate([self.good, good])

    @staticmethod
    def _together(
        segments: list[str], glue: str, lengths: np.ndarray, encode, spelled: list[bytes], sizes: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray] | None:
        """The segments' ids from one call and their counts, None where tokens don't end where the segments do."""
        raw = glue.join(segments)
        listed = encode(raw)
        if b"".join([spelled[k] for k in listed]) != raw.encode():
            return None
        ids = np.array(listed, np.int64)
        ends = np.cumsum(lengths + len(glue)) - len(glue)
        token_ends = np.cumsum(sizes[ids])
        last = np.searchsorted(token_ends, ends)
        first = np.searchsorted(token_ends, ends - lengths, side="right")
        if (token_ends[last] != ends).any() or (np.concatenate([[0], token_ends])[first] != ends - lengths).any():
            return None
        if glue:  # a line end's token stands before each segment but the first
            ids = np.delete(ids, first[1:] - 1)
        return ids, last + 1 - first


@dataclass
class Batch:
    """Aligned tokens of some texts on one byte axis; texts without tokens take no place on it."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray  # where each token ends on the axis
    ends_b: np.ndarray
    counts_a: np.ndarray  # tokens of each text
    counts_b: np.ndarray

    def __post_init__(self):
        # Offsets where tokens of both end; a text's end is one of them.
        self.cuts = np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)
        self.groups_a = np.searchsorted(self.cuts, self.ends_a)
        self.groups_b = np.searchsorted(self.cuts, self.ends_b)

    def texts_of(self, counts: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(counts)), counts)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Overlap links in blocks: token of A, token of B, shared bytes."""
        size = int(self.ends_a[-1]) if len(self.ends_a) else 0
        a = Csr.of_runs(np.diff(self.ends_a, prepend=0), size)
        b = Csr.of_runs(np.diff(self.ends_b, prepend=0), size)
        return a.product(b.transposed())

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Shared-group links in blocks: token of A, token of B, 1."""
        a = Csr.of_labels(self.groups_a, len(self.cuts))
        return a.product(Csr.of_labels(self.groups_b, len(self.cuts)).transposed())

    def shared_group_counts(self) -> np.ndarray:
        """Shared-group links of each token of A, without listing them."""
        a = Csr.of_labels(self.groups_a, len(self.cuts))
        b = Csr.of_labels(self.groups_b, len(self.cuts))
        return a.times_vector(b.transposed().times_vector(np.ones(len(self.groups_b), np.int64)))


class Aligner:
    """The two tokenizers of a worker and what is derived from their vocabularies."""

    def __init__(self, path_a: str, path_b: str, kept: int = CACHED_WORDS):
        self.a, self.b = ByteTokens(path_a, kept // 4), PieceTokens(path_b, kept // 4)
        self.sizes_a = np.array([len(x) for x in self.a.bytes])
        self.sizes_b = np.array([len(x) for x in self.b.bytes])
        self.segments = Segments(self.a, self.b, kept)
        most = max(len(self.sizes_a), len(self.sizes_b))
        # Every id as text, after each of the signs that may stand before it.
        self.numbers = np.array([sign + str(k) for sign in ("", ";", ",", "|") for k in range(most)], object).reshape(4, most)

    def align(self, texts: list[str]) -> Batch:
        none = np.zeros(0, np.int64)
        found = [(none, none)] * len(texts)
        whole = self.b.by_word and self.b.line is not None
        regular = [k for k, t in enumerate(texts) if t and whole and not Segments.IRREGULAR.search(t)]
        for k, ids in zip(regular, self.segments.ids([texts[k] for k in regular])):
            found[k] = ids
        places = [k for k in sorted({*range(len(texts))} - {*regular}) if texts[k]]
        some = [texts[k] for k in places]
        for k, t, a, b in zip(places, some, self.a.ids(some), self.b.ids(some)):
            raw = (" " + t).encode("utf-8", "surrogatepass")
            if b"".join([self.a.bytes[i] for i in a.tolist()]) == raw == b"".join([self.b.bytes[i] for i in b.tolist()]):
                found[k] = (a, b)
        ids_a, ids_b = (np.concatenate([none, *(x[side] for x in found)]) for side in (0, 1))
        return Batch(
            ids_a, ids_b, np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]),
            np.array([len(a) for a, _ in found], np.int64), np.array([len(b) for _, b in found], np.int64),
        )

    def group_texts(self, batch: Batch) -> list[str]:
        """For each text its groups as ids: ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b, groups = len(batch.ids_a), len(batch.ids_b), len(batch.cuts)
        sizes_a = np.bincount(batch.groups_a, minlength=groups)
        sizes_b = np.bincount(batch.groups_b, minlength=groups)
        # A group's tokens of A come before its tokens of B.
        place_a = np.arange(n_a) + (np.cumsum(sizes_b) - sizes_b)[batch.groups_a]
        place_b = np.arange(n_b) + np.cumsum(sizes_a)[batch.groups_b]
        first_a = np.diff(batch.groups_a, prepend=-1) > 0
        first_b = np.diff(batch.groups_b, prepend=-1) > 0
        text_starts = (np.cumsum(batch.counts_a) - batch.counts_a)[batch.counts_a > 0]
        sign_a = np.where(first_a, 1, 2)
        sign_a[text_starts] = 0
        parts = np.empty(n_a + n_b, object)
        parts[place_a] = self.numbers[sign_a, batch.ids_a]
        parts[place_b] = self.numbers[np.where(first_b, 3, 2), batch.ids_b]
        listed, ends = parts.tolist(), np.cumsum(batch.counts_a + batch.counts_b).tolist()
        return ["".join(listed[a:b]) for a, b in zip([0, *ends[:-1]], ends)]

    def id_pairs(self, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, id of A, id of B) among the overlap links, the links of each, and links of each text."""
        text_a = batch.texts_of(batch.counts_a)
        wide = len(self.sizes_b)
        keys, counts = [], []
        for a, b, _ in batch.overlaps():
            pair = (text_a[a] * len(self.sizes_a) + batch.ids_a[a]) * wide + batch.ids_b[b]
            key, count = np.unique(pair, return_counts=True)
            keys.append(key)
            counts.append(count)
        if len(keys) == 1:
            key, count = keys[0], counts[0]
        else:
            key, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            count = np.bincount(at, np.concatenate([np.zeros(0, np.int64), *counts]), minlength=len(key)).astype(np.int64)
        text, pair = key // (len(self.sizes_a) * wide), key % (len(self.sizes_a) * wide)
        links = np.bincount(text, count, minlength=len(batch.counts_a)).astype(np.int64)
        return text, pair // wide, pair % wide, count, links


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of two tokenizer files, kept while the worker lives."""
    if (path_a, path_b) not in _aligners:
        _aligners.clear()
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _in_batches(
    make: Callable[[pa.RecordBatch, Aligner, Batch], Iterator[pa.RecordBatch]], path_a: str, path_b: str
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(path_a, path_b)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), _BATCH_BYTES, side="right")))
                part = batch.slice(at, upto - at)
                yield from make(part, tools, tools.align(part.column(1).to_pylist()))
                at = upto

    return run


def alignments(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document row: doc_id, n_a, n_b, n_groups, n_links, n_group_links, groups_text's SHA-256, and its
    distinct linked id pairs as arrays a, b and links (how often each is linked)."""
    doc_type = documents.schema["doc_id"].dataType.simpleString()

    def make(part: pa.RecordBatch, tools: Aligner, batch: Batch) -> Iterator[pa.RecordBatch]:
        texts = part.num_rows
        text, a, b, count, links = tools.id_pairs(batch)
        offsets = pa.array(np.searchsorted(text, np.arange(texts + 1)), pa.int32())
        cuts = np.concatenate([[0], np.cumsum(batch.counts_a)])
        group_links = np.concatenate([[0], np.cumsum(batch.shared_group_counts())])[cuts]
        upto = np.concatenate([[-1], batch.groups_a])[cuts]  # number of the last group before each text's end
        shas = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in tools.group_texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(batch.counts_a), pa.array(batch.counts_b), pa.array(np.diff(upto)),
                pa.array(links), pa.array(np.diff(group_links)), pa.array(shas, pa.string()),
                *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (a, b, count)),
            ],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256", "a", "b", "links"],
        )

    ddl = (
        f"doc_id {doc_type}, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, "
        "a array<int>, b array<int>, links array<int>"
    )
    rows = documents.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(_in_batches(make, path_a, path_b), ddl)


def token_links(documents: DataFrame, path_a: str, path_b: str, kind: str = "overlap") -> DataFrame:
    """Every link: doc_id, a_place, b_place (tokens of the text from 0), a, b (ids), shared (bytes).

    ``kind`` is "overlap" or "group" (tokens of the same group, shared is 1).
    """
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    products = {"overlap": Batch.overlaps, "group": Batch.shared_groups}[kind]

    def make(part: pa.RecordBatch, tools: Aligner, batch: Batch) -> Iterator[pa.RecordBatch]:
        text_a = batch.texts_of(batch.counts_a)
        start_a, start_b = np.cumsum(batch.counts_a) - batch.counts_a, np.cumsum(batch.counts_b) - batch.counts_b
        for a, b, shared in products(batch):
            text = text_a[a]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(text)), pa.array(a - start_a[text]), pa.array(b - start_b[text]),
                    pa.array(batch.ids_a[a].astype(np.int32)), pa.array(batch.ids_b[b].astype(np.int32)), pa.array(shared),
                ],
                ["doc_id", "a_place", "b_place", "a", "b", "shared"],
            )

    rows = documents.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(
        _in_batches(make, path_a, path_b), f"doc_id {doc_type}, a_place long, b_place long, a int, b int, shared long"
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per linked id pair: a, b, pair_docs (documents that hold it), best (whether none of a's pairs has more)."""
    pairs = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("p")).select("p.a", "p.b")
    counts = written(pairs.groupBy("a", "b").agg(F.count("*").alias("pair_docs")), "pair_counts")
    most = counts.groupBy("a").agg(F.max("pair_docs").alias("most"))
    return counts.join(most, "a").select("a", "b", "pair_docs", (F.col("pair_docs") == F.col("most")).alias("best"))


def _few_and_rest(counts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The pairs of most documents, at most ``limit``, and the rest, or None, by a histogram of powers of two."""
    level = F.floor(F.log2("pair_docs")).cast("int")
    sizes = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    held, lowest = 0, None
    for row in sizes:
        if held + row["count"] > limit:
            break
        held, lowest = held + row["count"], row["level"]
    if held == sum(r["count"] for r in sizes):
        return counts, None
    frequent = level >= lowest if lowest is not None else F.lit(False)
    return counts.filter(frequent), counts.filter(~frequent)


def alignment_scores(documents: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links.

    n_best counts the links whose pair no other pair of the same id of A
    exceeds in documents; count_sum adds up the documents of each link's pair.
    """
    aligned = written(alignments(documents, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(aligned), "pair_bests")
    frequent, rest = _few_and_rest(counts, broadcast_pairs)
    pairs = aligned.select("row", F.explode(F.arrays_zip("a", "b", "links")).alias("p")).select("row", "p.a", "p.b", "p.links")
    best = F.when(F.col("best"), F.col("links")).otherwise(0).cast("long").alias("n_best")
    score = (F.col("links") * F.col("pair_docs")).alias("count_sum")
    if rest is None:
        met = pairs.join(F.broadcast(frequent), ["a", "b"]).select("row", best, score)
    else:
        few = pairs.join(F.broadcast(frequent), ["a", "b"], "left")
        found = few.filter("pair_docs is not null").select("row", best, score)
        more = few.filter("pair_docs is null").select("row", "a", "b", "links").join(rest, ["a", "b"])
        met = found.unionByName(more.select("row", best, score))
    sums = met.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.drop("a", "b", "links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", "n_group_links",
    )

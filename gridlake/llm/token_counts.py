"""Exact token counts at every prefix of a text.

``prefixes`` holds, for every code point of a text, by how much the token count
changes when the prefix grows by it: one signed byte each (a merge can lower
the count, so the values may be negative).  The sum of the first n bytes is the exact
count of the first n code points, so counts, truncation to a budget and chunk
borders need no further encoding.

The table is filled by dynamic programming over prefixes.  The model never
joins a character with a space or line end after it, so the count of a prefix is the count
up to its last word plus the count of the word's begun part.  Inside a word, the
count of a prefix is one more than the count of the prefix before its last
piece.  Rows of words are kept between texts up to a fixed number, and so are
the library's answers on which piece may follow which; no text is encoded.

Defined results for odd input: a null or empty text has no tokens; a repeated
row is counted again; text of any length is counted whole; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridlake.llm.common import text_or_empty

KEPT_WORDS = 600_000
KEPT_PAIRS = 500_000
_BATCH_CHARS = 8 << 20
_MARK = "▁"
_SEGMENT = re.compile(f"{_MARK}+[^{_MARK}\n]*|[^{_MARK}\n]+|\n")


class PrefixTable:
    """Prefix rows of the words of one SentencePiece BPE model with a dummy first space."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        numbers = range(self.model.get_piece_size())
        plain = [k for k in numbers if not (self.model.is_byte(k) or self.model.is_control(k) or self.model.is_unknown(k))]
        self.pieces = {p: p for p in map(self.model.id_to_piece, plain)}
        if any(re.search(f"[^{_MARK}]{_MARK}|\n", p) for p in self.pieces):
            raise ValueError("the model joins words or lines; their counts cannot be added")
        self.longest = max(map(len, self.pieces))
        self.kept = kept
        self.rows: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _follows(self, before: str, piece: str) -> bool:
        """Whether the model encodes the two pieces' joined text as just these two."""
        # The line end keeps the mark that the model puts first away from the pieces.
        ids = self.model.encode("\n" + (before + piece).replace(_MARK, " "))[2:]
        good = [self.model.id_to_piece(k) for k in ids] == ([before, piece] if before else [piece])
        if len(self.pairs) < KEPT_PAIRS:
            self.pairs[before, piece] = good
        return good

    def fill(self, segments: set[str]) -> dict[str, bytes]:
        """Rows of segments that aren't kept: signed change of the token count at each character.

        A merge order gives each prefix one last piece: the one that ends there
        and may follow the last piece of the prefix before it.  In sorted order
        a segment goes on from what it has in common with the one before.  Time
        is linear in the length of the segments.
        """
        pieces, pairs, longest = self.pieces, self.pairs, self.longest
        fresh, counts, last, previous = {}, [0], [""], ""
        for segment in sorted(segments):
            same, most = 0, min(len(segment), len(previous))
            while same < most and segment[same] == previous[same]:
                same += 1
            del counts[same + 1 :], last[same + 1 :]
            for end in range(same + 1, len(segment) + 1):
                char = segment[end - 1]
                if char not in pieces:  # written as bytes, which join nothing
                    counts.append(counts[-1] + len(char.encode("utf-8", "surrogatepass")))
                    last.append("")
                    continue
                for start in range(max(0, end - longest), end):
                    piece = pieces.get(segment[start:end])
                    if piece is None:
                        continue
                    good = pairs.get((last[start], piece))
                    if good or good is None and self._follows(last[start], piece):
                        counts.append(counts[start] + 1)
                        last.append(piece)
                        break
                else:
                    raise ValueError("no piece ends here")
            fresh[segment] = bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])
            previous = segment
        if len(self.rows) < self.kept:
            self.rows.update((s, r) for s, r in fresh.items() if len(s) <= 64)
        return fresh

    def prefixes_of(self, texts: list[str]) -> list[bytes]:
        """For each text one signed byte for each code point."""
        cut = [_SEGMENT.findall(_MARK + t.replace(" ", _MARK)) if t else [] for t in texts]
        rows = self.rows
        fresh = self.fill({s for segments in cut for s in segments if s not in rows})
        out = []
        for segments in cut:
            if not segments:
                out.append(b"")
                continue
            whole = b"".join([rows.get(s) or fresh[s] for s in segments])
            # The model's own first mark is no character of the text: its count goes to the first one.
            out.append(((whole[0] + whole[1]) & 255).to_bytes(1, "little") + whole[2:])
        return out

    def prefixes(self, text: str) -> bytes:
        return self.prefixes_of([text])[0]


_tables: dict[str, PrefixTable] = {}


def prefix_table(path: str) -> PrefixTable:
    """The worker's table of a model file, kept while the worker lives."""
    if path not in _tables:
        _tables.clear()
        _tables[path] = PrefixTable(path)
    return _tables[path]


def count_at(prefixes: bytes, n_chars: int | None = None) -> int:
    """Tokens of the first n code points."""
    return int(np.frombuffer(prefixes, np.int8)[:n_chars].sum(dtype=np.int64))


def longest_within(prefixes: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    counts = np.cumsum(np.frombuffer(prefixes, np.int8), dtype=np.int64)
    fitting = np.flatnonzero(counts <= budget)
    return int(fitting[-1]) + 1 if len(fitting) else 0


def prefix_counts(documents: DataFrame, model_path: str) -> DataFrame:
    """Per document row: doc_id, n_bytes (UTF-8), n_tokens and the prefix table."""
    doc_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model_path)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                upto, held = at, 0
                while upto < len(texts) and held < _BATCH_CHARS:
                    held += len(texts[upto])
                    upto += 1
                some = texts[at:upto]
                found = table.prefixes_of(some)
                columns = [
                    batch.column(0).slice(at, upto - at),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in some], pa.int64()),
                    pa.array([count_at(p) for p in found], pa.int64()),
                    pa.array(found, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "prefixes"])
                at = upto

    rows = documents.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {doc_type}, n_bytes long, n_tokens long, prefixes binary")

"""License scan: winnowed fingerprints in an inverted index, verified by banded alignment.

Texts are reduced to their lower-cased words joined by single spaces.  The
eight-byte grams of that are hashed, and of every ``WINDOW`` grams in a row the
smallest hashes are kept, so a passage of at least ``WINDOW + 7`` bytes that a
text has in common with a template shares a fingerprint with it.  The templates'
fingerprints form an inverted index (hash to template and place); hits of one
template that agree on where it would begin make a candidate region.  The
template's words are aligned with the region's, in a band around it, as a
longest common subsequence; a template is reported where at least ``COVERAGE``
of its words are matched, with the matched spans as code-point offsets.

The index is sent to every task; templates are a stated collection, and one of
more than ``MOST_WORDS`` words in all is scanned in several parts.

Defined results for odd input: null and empty texts have no matches; a template
without words is ignored; repeated rows are reported again; a template that
occurs several times is reported for each place; a match with gaps or missing
words is left out where another template of the same part matches all its words
and more, or has fewer left over (versions of one license); a header inside a whole text is reported too; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import batched, rows_of, words

GRAM = 8
WINDOW = 5
COVERAGE = 0.8
MOST_WORDS = 2_000_000
_A = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

# License texts, headers and notices to look for, by name; read by the driver only.
TEMPLATES: dict[str, str] = json.loads(Path(__file__).with_name("licenses.json").read_text(encoding="utf-8"))


def winnow(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the kept grams and the places where they begin; a shorter text is one gram, padded."""
    raw = np.frombuffer(data if len(data) >= GRAM else data.ljust(GRAM), np.uint8)
    count = len(raw) - GRAM + 1
    pairs = raw[:-1].astype(np.uint64) | raw[1:].astype(np.uint64) << np.uint64(8)
    fours = pairs[:-2] | pairs[2:] << np.uint64(16)
    codes = (fours[:-4] | fours[4:] << np.uint64(32)) * _A
    codes ^= codes >> np.uint64(31)
    least = codes
    if count <= WINDOW:
        places = np.flatnonzero(codes == codes.min())
        return codes[places], places
    size = 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    # A gram is kept if it is the least of any window around it: if the greatest of their minima is its own hash.
    most = np.zeros(len(least) + 2 * (WINDOW - 1), np.uint64)
    most[WINDOW - 1 : WINDOW - 1 + len(least)] = least
    size = 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        most = np.maximum(most[:-step], most[step:])
        size += step
    places = np.flatnonzero(most == codes)
    return codes[places], places


def aligned_words(template: list[bytes], region: list[bytes], band: int) -> list[tuple[int, int]]:
    """Pairs (word of the template, word of the region) of a longest common subsequence.

    Word i of the template may match words i to i + 2 * band of the region.
    """
    width = 2 * band + 1
    codes: dict[bytes, int] = {}
    wanted = np.array([codes.setdefault(w, len(codes)) for w in template])
    padded = np.full(len(template) + 2 * band, -1)
    found = np.array([codes.get(w, -1) for w in region[: len(padded)]], int)
    padded[: len(found)] = found
    table = np.zeros((len(template) + 1, width + 1), np.int32)
    for i in range(len(template)):
        # Column c of row i + 1 is word i + c of the region; in the row before, that word was column c + 1.
        before = table[i]
        skip = before[1:]
        match = before[:-1] + (padded[i : i + width] == wanted[i])
        table[i + 1, :-1] = np.maximum.accumulate(np.maximum(skip, match))
        table[i + 1, -1] = table[i + 1, -2]
    pairs, i, c = [], len(template), width - 1
    while i and table[i, c]:
        if c and table[i, c - 1] == table[i, c]:
            c -= 1  # the region's word isn't needed
        elif table[i - 1, c + 1] == table[i, c]:
            i, c = i - 1, min(c + 1, width - 1)  # nor is the template's
        else:
            i -= 1
            pairs.append((i, i + c))
    return pairs[::-1]


def _verbatim(template: list[bytes], region: list[bytes]) -> list[tuple[int, int]]:
    """The pairs where the whole template stands in the region once, else none."""
    whole, part = b" %b " % b" ".join(region), b" %b " % b" ".join(template)
    at = whole.find(part)
    if at < 0 or whole.find(part, at + 1) >= 0:
        return []
    first = whole.count(b" ", 0, at)
    return [(k, first + k) for k in range(len(template))]


class TemplateIndex:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float):
        self.coverage = coverage
        self.names, self.words, self.kept = [], [], []
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, text in templates:
            found = words(text)
            if not found:
                continue
            codes, word_at = self._fingerprints(found)
            for code, at in zip(codes.tolist(), word_at.tolist()):
                postings[code].append((len(self.names), at))
            self.names.append(name)
            self.words.append(found)
            self.kept.append(len(codes))
        self.codes = np.array(sorted(postings), np.uint64)
        self.postings = [postings[c] for c in self.codes.tolist()]
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(self.codes >> np.uint64(46)).astype(np.int64)] = True

    @staticmethod
    def _fingerprints(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = b" ".join(found)
        codes, places = winnow(data)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
        return codes, np.searchsorted(ends, places)

    def regions(self, found: list[bytes]) -> list[tuple[int, int, int]]:
        """Candidates (template, first and last word at which it may begin)."""
        data = b" ".join(found)
        codes, places = winnow(data)
        near = np.flatnonzero(self.bits[(codes >> np.uint64(46)).astype(np.int64)])
        if not len(near) or not len(self.codes):
            return []
        at = np.minimum(np.searchsorted(self.codes, codes[near]), len(self.codes) - 1)
        near, at = near[self.codes[at] == codes[near]], at[self.codes[at] == codes[near]]
        if not len(near):
            return []
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
        word_at = np.searchsorted(ends, places[near])
        begins: dict[int, list[int]] = defaultdict(list)
        for k, word in zip(at.tolist(), word_at.tolist()):
            for template, offset in self.postings[k]:
                begins[template].append(word - offset)
        out = []
        for template, spots in begins.items():
            slack, group = self.slack(template), []
            for spot in [*sorted(spots), math.inf]:
                if group and (spot - group[-1] > slack or spot - group[0] > 2 * slack):
                    if len(group) >= max(1, self.kept[template] // 10):
                        out.append((template, group[0], group[-1]))
                    group = []
                group.append(spot)
        return out

    def slack(self, template: int) -> int:
        return max(1, len(self.words[template]) // 4)

    def matches(self, text: str) -> list[tuple[str, float, int, list[tuple[int, int]]]]:
        """(name, coverage, words matched, spans) of every template found in a text."""
        found = words(text)
        regions = self.regions(found) if found else []
        if not regions:
            return []
        offsets, out, places, seen = None, [], [], set()
        for template, first, last in regions:
            wanted, slack = self.words[template], self.slack(template)
            begin = first - slack
            band = (last - begin + slack) // 2 + 1
            # A template cut off at the text's start begins before it.
            region = [b""] * max(0, -begin) + found[max(0, begin) : max(0, begin + len(wanted) + 2 * band)]
            if sum((Counter(wanted) & Counter(region)).values()) < self.coverage * len(wanted):
                continue
            pairs = _verbatim(wanted, region) or aligned_words(wanted, region, band)
            if len(pairs) < self.coverage * len(wanted):
                continue
            key = (template, begin + pairs[0][1], begin + pairs[-1][1])
            if key in seen:
                continue
            seen.add(key)
            offsets = offsets or [m.span() for m in _WORD.finditer(text)]
            spans: list[list[int]] = []
            previous = None
            for _, word in pairs:
                start, end = offsets[begin + word]
                if previous is not None and word == previous + 1:
                    spans[-1][1] = end
                else:
                    spans.append([start, end])
                previous = word
            out.append((self.names[template], len(pairs) / len(wanted), len(pairs), [tuple(s) for s in spans]))
            places.append({begin + word for _, word in pairs})
        # A match with gaps or words missing, of which another template matches every word and has fewer left, is that other license.
        out = [
            m
            for m, own in zip(out, places)
            if (m[1] == 1 and len(m[3]) == 1) or not any(
                other > own or other == own and n[1] > m[1] for n, other in zip(out, places) if n[0] != m[0]
            )
        ]
        return sorted(out, key=lambda m: (m[3][0], m[0]))


_SPANS = "array<struct<start:int,end:int>>"


def scan(documents: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Per document and match: doc_id, template, coverage, n_matched (words) and spans (code points)."""
    spark, doc_type = documents.sparkSession, documents.schema["doc_id"].dataType.simpleString()
    doc_arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(doc_type, pa.string())
    parts: list[list[tuple[str, str]]] = [[]]
    held = 0
    for name, text in sorted((TEMPLATES if templates is None else templates).items()):
        if held and held + len(words(text)) > MOST_WORDS:
            parts.append([])
            held = 0
        parts[-1].append((name, text))
        held += len(words(text))
    out = None
    for part in parts:
        sent = spark.sparkContext.broadcast(TemplateIndex(part, coverage))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            def rows():
                for doc, text in rows_of(batches):
                    for name, share, matched, spans in sent.value.matches(text) if text else ():
                        yield doc, name, share, matched, [{"start": a, "end": b} for a, b in spans]

            kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            schema = pa.schema(
                [("doc_id", doc_arrow), ("template", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("spans", kinds)]
            )
            yield from batched(rows(), schema)

        rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
        found = rows.mapInArrow(run, f"doc_id {doc_type}, template string, coverage double, n_matched long, spans {_SPANS}")
        out = found if out is None else out.unionByName(found)
    return out

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gridlake.llm import token_alignment as ta
from gridlake.llm.sparse import Csr

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", " a", "a ", "a  b\n\n c ", "z's it's <|endoftext|> x", "é 漢字　x  ", "a" * 2000, "\0a b", "▁a▁", "</s> <unk> <0x0A>", "🙂🙂 ☃ ½\tq"]
TEXTS = st.text(alphabet="abtheTHE  \n▁é漢🙂.,09\t\x00ſ%'s<|>", max_size=40)
SCHEMA = "doc_id long, text string, a string, row string, links int"


class Plain:
    """Both libraries on whole texts, and token bytes from their offsets in the bytes."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=B)
        self.tools = ta.Aligner(A, B, 500)

    def ids(self, text):
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        raw = (" " + text).encode()
        spelled = b""
        for k in b:
            piece = self.b.id_to_piece(k)
            spelled += bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()
        if spelled != raw or b"".join(self.tools.a.bytes[k] for k in a) != raw:
            return [], []
        return a, b

    def spans(self, ids, table):
        at, out = 0, []
        for k in ids:
            out.append((at, at + len(table[k])))
            at += len(table[k])
        return out

    def aligned(self, text):
        """ids, overlap links by place, groups."""
        a, b = self.ids(text)
        sa, sb = self.spans(a, self.tools.a.bytes), self.spans(b, self.tools.b.bytes)
        links = {(i, j, min(x[1], y[1]) - max(x[0], y[0])) for i, x in enumerate(sa) for j, y in enumerate(sb) if max(x[0], y[0]) < min(x[1], y[1])}
        cuts = sorted({x[1] for x in sa} & {y[1] for y in sb})
        groups = [([i for i, x in enumerate(sa) if lo < x[1] <= hi], [j for j, y in enumerate(sb) if lo < y[1] <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        return a, b, links, groups


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(6)
    words = ["the", "tion", "Éléa", "1234", "\n", "unbelievable", "漢字", "  ", "naïveté", "x=y;"]
    rows = [(k, t) for k, t in enumerate(ODD)]
    rows += [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for k in range(60)]
    return rows + [rows[20], (None, "no id"), (100, "another the text")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(5)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS | st.text(alphabet="abthe .,\n\né漢", max_size=30), min_size=1, max_size=5))
def test_both_encoders_are_the_libraries(texts):
    tools, plain = ta.aligner(A, B), _plain()
    for t, a, b in zip(texts, tools.a.ids(texts), tools.b.ids(texts)):
        assert a.tolist() == plain.a.encode(" " + t, add_special_tokens=False).ids
        assert b.tolist() == plain.b.encode(t)
    batch = tools.align(texts)
    wanted = [plain.ids(t) for t in texts]
    assert batch.ids_a.tolist() == [k for a, _ in wanted for k in a]
    assert batch.ids_b.tolist() == [k for _, b in wanted for k in b]
    assert batch.counts_a.tolist() == [len(a) for a, _ in wanted]


_held = []


def _plain():
    if not _held:
        _held.append(Plain())
    return _held[0]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 6), st.integers(0, 6), st.integers(0, 6), st.integers(0, 999), st.integers(1, 9))
def test_product_is_the_dense_product(n, k, m, seed, most):
    rng = np.random.default_rng(seed)
    dense = [rng.integers(0, 3, (n, k)), rng.integers(0, 3, (k, m))]

    def sparse(d):
        rows, columns = np.nonzero(d)
        return Csr(np.searchsorted(rows, np.arange(len(d) + 1)), columns, d[rows, columns], d.shape[1])

    got = np.zeros((n, m), int)
    last = -1
    for rows, columns, values in sparse(dense[0]).product(sparse(dense[1]), most):
        got[rows, columns] += values
        assert not len(rows) or rows[0] > last
        last = rows[-1] if len(rows) else last
    assert (got == dense[0] @ dense[1]).all()
    assert (sparse(dense[0]).times_vector(np.arange(k)) == dense[0] @ np.arange(k)).all()
    turned = sparse(dense[0]).transposed()
    assert turned.height == k and (turned.times_vector(np.ones(n, int)) == dense[0].sum(axis=0)).all()


@pytest.mark.parametrize("limit", [0, 20, 10**6])
def test_scores_are_those_of_all_pairs(spark, plain, documents, limit):
    aligned = [(d, *plain.aligned(t)) for d, t in documents]
    held = Counter(pair for _, a, b, links, _ in aligned for pair in {(a[i], b[j]) for i, j, _ in links})
    most = {}
    for (a, _), count in held.items():
        most[a] = max(most.get(a, 0), count)
    wanted = []
    for doc, a, b, links, groups in aligned:
        counts = [(a[i], held[a[i], b[j]]) for i, j, _ in links]
        text = ";".join(",".join(str(a[i]) for i in ga) + "|" + ",".join(str(b[j]) for j in gb) for ga, gb in groups)
        wanted.append((
            doc, len(a), len(b), len(groups), len(links), sum(most[k] == c for k, c in counts), sum(c for _, c in counts),
            hashlib.sha256(text.encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups),
        ))
    found = ta.alignment_scores(frame(spark, documents), A, B, broadcast_pairs=limit)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))


def test_links_by_place(spark, plain, documents):
    docs = [(k, t) for k, (_, t) in enumerate(documents)]
    for kind in ("overlap", "group"):
        found = {(r.doc_id, r.a_place, r.b_place, r.a, r.b, r.shared) for r in ta.token_links(frame(spark, docs), A, B, kind).collect()}
        wanted = set()
        for doc, text in docs:
            a, b, links, groups = plain.aligned(text)
            if kind == "group":
                links = {(i, j, 1) for ga, gb in groups for i in ga for j in gb}
            wanted |= {(doc, i, j, a[i], b[j], n) for i, j, n in links}
        assert found == wanted


def test_long_texts_in_blocks_and_an_empty_table(spark, plain):
    text = "Unbelievable naïveté of the 漢字 " * 60_000
    tools = plain.tools
    batch = tools.align([text, "", "short one"])
    text_of, a, b, count, links = tools.id_pairs(batch)
    spans = len(np.unique(np.concatenate([batch.ends_a, batch.ends_b])))
    assert links.sum() == spans and links[1] == 0
    assert len(tools.group_texts(batch)[0]) > len(text)
    none = spark.createDataFrame([], SCHEMA)
    assert ta.alignment_scores(none, A, B).count() == 0 and ta.token_links(none, A, B).count() == 0

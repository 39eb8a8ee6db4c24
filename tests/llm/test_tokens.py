import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gridlake.llm import token_counts as tc
from gridlake.llm import token_files as tf

BYTE_BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", " a", "a ", "a  b\n\n c ", "\x1c x\x85y <|endoftext|> z's it's", "é 漢字　x  ", "a" * 3000, "\0a b", "x\n", "▁a▁", "</s> <unk> <0x0A>"]
TEXTS = st.text(alphabet="abtheTHE  \n▁é漢🙂.,09\t\x00ſ%'s<|>", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_word_encoder_is_the_tokenizer(texts):
    encode = tf.word_encoder(BYTE_BPE)
    for text, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


ANY_TEXTS = st.text(alphabet=st.sampled_from("ab Z09.,!-'s\n\t \xa0\x85\x1c×÷éÿɏɐ’漢　   \u180e\u200b🙂²Ⅷ") | st.characters(exclude_categories=["Cs"]), max_size=30)


@settings(max_examples=500, deadline=None)
@given(ANY_TEXTS)
def test_sure_cuts_are_cuts_of_the_tokenizer(text):
    encode = tf.word_encoder(BYTE_BPE)
    raw = np.frombuffer(text.encode(), np.uint8)
    begins = {len(text[:a].encode()) for _, (a, _) in encode.tokenizer.pre_tokenizer.pre_tokenize_str(text)}
    assert set(np.flatnonzero(tf.sure_cuts(raw)).tolist()) <= begins | {0}
    assert np.frombuffer(encode([text, "", text + " x"])[2], "<u4").tolist() == encode.ids(text + " x").tolist()


def test_a_word_is_encoded_once_whatever_follows_it():
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.seen = tokenizer, 0

        def encode(self, text, **options):
            self.seen += len(text)
            return self.tokenizer.encode(text, **options)

    encode = tf.WordEncoder(BYTE_BPE)
    text = "".join(f" Wort{mark}" for mark in (".", ",", "!", ";", ":", "?", ".\nx", "9", "'", "%%%"))
    wanted = encode.ids(text).tolist()
    counted = encode.tokenizer = Counted(encode.tokenizer)
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == wanted
    assert counted.seen < len(text) / 2
    most = encode.most = 3
    encode.kept.clear()
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == wanted and len(encode.kept) == most


def test_pieces_go_to_the_tokenizer_together():
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.calls = tokenizer, 0

        def encode(self, text, **options):
            self.calls += 1
            return self.tokenizer.encode(text, **options)

    encode = tf.WordEncoder(BYTE_BPE)
    bare = [f"Wort{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    texts = ["\n".join(bare), " ".join(bare), "\n".join("'s 1 x'll\x85漢 ×9\x1c'".split(" ")), "\n\n'\n"]
    wanted = [encode.ids(text).tolist() for text in texts]
    counted = encode.tokenizer = Counted(encode.tokenizer)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == wanted
    assert counted.calls < 20
    calls = counted.calls
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts[::-1])] == wanted[::-1]
    assert counted.calls == calls
    encode.kept.clear()
    encode.most = 7
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == wanted and len(encode.kept) == 7


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_every_prefix_has_its_exact_count(text):
    table, model = tc.prefix_table(PIECES), SentencePieceProcessor(model_file=PIECES)
    prefixes = table.prefixes(text)
    counts = [len(model.encode(text[:n])) for n in range(len(text) + 1)]
    assert [tc.count_at(prefixes, n) for n in range(len(text) + 1)] == counts
    for budget in (0, 3, 10):
        assert tc.longest_within(prefixes, budget) == max(n for n, c in enumerate(counts) if c <= budget)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=300))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert tf.decode_block(*tf.encode_block(ids), len(ids)).tolist() == ids.tolist()


def test_ranks_follow_frequency():
    ranks, control, data = tf.encode_block(np.array([9, 7, 7, 300, 7, 9], np.uint32))
    assert np.frombuffer(ranks, "<u4").tolist() == [7, 9, 300]
    assert (len(control), len(data)) == (2, 6)


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(5)
    rows = [(k, t) for k, t in enumerate(ODD)]
    rows += [(1000 - k, " ".join(rng.choice(["the", "tion", "Éléa", "1234", "\n"]) for _ in range(rng.randrange(80)))) for k in range(120)]
    return rows + [rows[20], (None, "no id"), (rows[20][0], "another text")]


def test_files_hold_all_ids_in_order(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string").withColumn("part", tf.F.lit("x")).repartition(5)
    blocks = tf.write_blocks(docs, lambda: tf.word_encoder(BYTE_BPE), block_tokens=300, partitions=4)
    assert blocks.count() > 8
    rows = sorted(tf.ids_crc32(tf.read_blocks(blocks)).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    wanted = {}
    for doc, text in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [tf.END]
        wanted.setdefault(doc, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.doc_id for r in rows] == sorted((d for d, _ in documents), key=lambda d: -1 if d is None else d)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        wanted[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(wanted.values())
    assert tf.read_blocks(tf.write_blocks(docs.limit(0), lambda: tf.word_encoder(BYTE_BPE))).count() == 0


def test_counts_of_documents(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string").withColumn("n_bytes", tf.F.lit(0))
    model = SentencePieceProcessor(model_file=PIECES)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tc.prefix_counts(docs, PIECES).collect())
    assert got == sorted((str(d), len((t or "").encode()), len(model.encode(t or ""))) for d, t in documents)
    assert tc.prefix_counts(docs.limit(0), PIECES).count() == 0


def test_a_long_run_takes_linear_time():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(60_000))
    assert tc.count_at(tc.prefix_table(PIECES).prefixes(text)) == len(SentencePieceProcessor(model_file=PIECES).encode(text))

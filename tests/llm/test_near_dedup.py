import random

import numpy as np
import pytest

from gridlake.llm import near_dedup as nd
from gridlake.llm.components import components


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + rng.choice((0, 1, 1))] = rng.choice(([], [f"new{rng.random()}"]))
    return words


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(4, 250))]
        if rng.random() < 0.5:
            base += shared
        texts.append(base)
        texts += [edited(rng, base, rng.randrange(0, 6)) for _ in range(rng.randrange(4))]
    hot = [rng.choice(vocabulary) for _ in range(200)]
    texts += [hot] + [edited(rng, hot, 2) for _ in range(60)]
    return [" ".join(t) for t in texts]


def brute_classes(texts):
    label = list(range(len(texts)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    codes = [nd.word_codes(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if texts[a] == texts[b] or nd.similarity(codes[a], codes[b]) >= nd.SIMILARITY:
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return [top(k) for k in range(len(texts))]


def test_classes_are_those_of_all_pairs(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert [found[k] for k in range(len(texts))] == brute_classes(texts)


def test_odd_rows(spark):
    rows = [(3, None, 1), (1, "", 1), (1, "", 1), (None, "a b c d e f g", 1), (7, "a b c d e f g", 1), (None, "alone here", 1), (9, "x", 1), (10, "X!", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int").withColumn("first", nd.F.lit("x"))
    found = sorted((r.doc_id or -1, r.class_id or -1) for r in nd.near_duplicates(docs).collect())
    assert found == [(-1, -1), (-1, 7), (1, 1), (1, 1), (3, 1), (7, 7), (9, 9), (10, 9)]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_alignment_is_the_longest_common_subsequence(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 6, rng.integers(0, 40)), rng.integers(0, 6, rng.integers(0, 40))
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    runs = nd.aligned_runs(a, b, len(a) + len(b))
    assert sum(size for _, _, size in runs) == table[-1, -1]
    for x, y, size in runs:
        assert (a[x : x + size] == b[y : y + size]).all()
    assert nd.aligned_runs(a, b, len(a) + len(b) - 2 * table[-1, -1] - 1) is None


def test_sketches_follow_similarity():
    rng = random.Random(2)
    base = [f"w{rng.randrange(1000)}" for _ in range(300)]
    near = edited(rng, base, 3)
    swapped = base[150:] + base[:150]
    own = nd.order_sketches(nd.word_codes(" ".join(base)))
    assert (own == nd.order_sketches(nd.word_codes(" ".join(near)))).sum() >= 8
    # The same k-mers in another order agree far less often.
    assert (own == nd.order_sketches(nd.word_codes(" ".join(swapped)))).sum() < 12


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 300), (300, 200)], "a long, b long")
    found = {r.node: r.label for r in components(links).collect()}
    assert found == {**{k: 0 for k in range(101)}, 200: 200, 300: 200}


def test_a_large_group_costs_pairs_in_proportion(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(2000)}" for _ in range(200)]
    passage = [f"p{rng.randrange(2000)}" for _ in range(60)]
    texts = [" ".join(edited(rng, base, 1)) for _ in range(400)]
    texts += [" ".join([f"v{rng.randrange(2000)}" for _ in range(60)] + passage) for _ in range(200)]
    seen = []
    verified = nd._verified
    monkeypatch.setattr(nd, "_verified", lambda pairs, *rest: (seen.append(pairs.distinct().count()), verified(pairs, *rest))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert {found[k] for k in range(400)} == {0}
    assert all(found[k] == k for k in range(400, 600))
    assert sum(seen) < 30 * len(texts)


@pytest.mark.parametrize("own, extra", [(52, 44), (60, 48)])
def test_pairs_inside_a_group_with_a_long_common_passage(spark, own, extra):
    """Nearly all sketches that a planted pair shares lie in the passage, hence in large buckets."""
    fresh = (f"u{k}" for k in range(10**6))
    some = lambda n: [next(fresh) for _ in range(n)]
    passage = some(400)
    texts = [passage + some(own) for _ in range(240)]
    for _ in range(40):
        both = some(12)
        texts += [passage + both + some(extra), passage + both + some(extra)]
    codes = [nd.word_codes(" ".join(t)) for t in texts]
    assert nd.similarity(codes[240], codes[241]) >= nd.SIMILARITY
    assert not any(nd.similarity(codes[k], codes[240]) for k in (0, 242))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert found == {k: k if k < 240 else k - k % 2 for k in range(len(texts))}

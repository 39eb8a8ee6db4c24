import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridlake.llm import quality

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "thé  chat\nnoir", "zz", "the then them"] * 2


def brute(train, texts, order=quality.ORDER):
    """Interpolated modified Kneser-Ney in plain Python: (log probability, characters) of each text."""
    pad = "\x02" * (order - 1)
    counts = {order: Counter(g for t in train for g in ((pad + t)[i : i + order] for i in range(len(t))))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, contexts = {}, {}
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        found = []
        for j in (1, 2, 3):
            if n[1] and n[2] and n[j]:
                y = n[1] / (n[1] + 2 * n[2])
                found.append(max(min(j - (j + 1) * y * n[j + 1] / n[j], j - 0.05), 0.05))
            else:
                found.append(j - 0.5)
        discounts[k] = found
        contexts[k] = defaultdict(list)
        for g, c in counts[k].items():
            contexts[k][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k, seen = len(g), contexts[len(g)].get(g[:-1])
        if not seen:
            return p(g[1:])
        c, d = counts[k].get(g, 0), discounts[k]
        given = sum(d[min(x, 3) - 1] for x in seen)
        return ((c - d[min(c, 3) - 1] if c else 0) + given * p(g[1:])) / sum(seen)

    return [(sum(math.log(p((pad + t)[i : i + order])) for i in range(len(t))), len(t)) for t in texts]


@pytest.mark.parametrize("model_rows", [quality.MODEL_ROWS, 40])
def test_log_probabilities_are_those_of_plain_python(spark, model_rows):
    train = spark.createDataFrame([("en", t) for t in TEXTS], "lang string, text string").repartition(3)
    grams, contexts = quality.train(train)
    texts = ["the cat", "", "xyz the q", "dog\x02é", "漢字 and 😀", "t" * 50]
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)] + [(99, "xx", "none")], "doc_id long, lang string, text string")
    found = {r.doc_id: r for r in quality.log_probabilities(docs, grams, contexts, model_rows).collect()}
    for k, (log_p, n) in enumerate(brute(TEXTS, texts)):
        assert found[k].n == n
        assert found[k].log_p == pytest.approx(log_p, rel=1e-4, abs=1e-4)
    assert found[99].log_p is None


def test_junk_goes_and_clean_text_stays(spark):
    words = "the cat and dog sat on mat with log then them that this some more".split()
    clean = [(k, " ".join(words[(k * 7 + j * j) % 15] for j in range(40)), "en", "s") for k in range(200)]
    junk = [(1000 + k, f"##{k} %%% @@@ ~~~ {k} ||| ^^^ !!!! $$$ &&& zzqx" * 3, "en", "s") for k in range(5)]
    odd = [(2000, None, "en", None), (2001, "", None, "s"), (2002, "hors de la langue", None, "s"), (None, "the cat", "en", "s")]
    docs = spark.createDataFrame(clean + junk + odd, "doc_id long, text string, lang string, source string").withColumn("n", quality.F.lit(1))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(150)] + [(151, None, None), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scores(docs, labels).collect()
    assert len(rows) == docs.count()
    kept = {r.doc_id: r.kept for r in rows}
    assert not any(kept[1000 + k] for k in range(5))
    assert sum(kept[k] for k in range(200)) >= 194
    assert kept[2000] and kept[2001] and kept[2002] and kept[None]
    empty = quality.scores(docs.limit(0), labels.limit(0))
    assert empty.count() == 0


def test_all_orders_share_the_tables_sent_out(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(quality.F, "broadcast", lambda frame: sent.append(frame) or frame)
    grams, _ = quality.train(spark.createDataFrame([("en", "abcab"), ("de", "öäöä")], "lang string, text string"))
    assert sorted({r.size for r in grams.select("size").collect()}) == [1, 2, 3, 4, 5]
    assert len(sent) == 1


def test_a_table_is_made_in_little_memory():
    codes = np.random.default_rng(3).permutation(np.arange(1, 1_000_001, dtype=np.uint64) * np.uint64(18_446_744_073_709))
    values = np.arange(len(codes)) % 1000
    tracemalloc.start()
    table = quality._Table(codes, values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * table.begins.nbytes
    assert np.array_equal(table.find(codes), values.astype(np.float32))
    assert np.isnan(table.find(codes + np.uint64(1))).all()
    assert np.isnan(quality._Table(codes[:0], values[:0]).find(codes[:5])).all()


@pytest.mark.parametrize("lang", ["", "en"])
def test_contexts_of_different_sizes_have_different_hashes(lang):
    contexts = ["", *map(chr, range(1, 128)), *(a + chr(c) for a in "efghi" for c in range(1, 128))]
    codes = quality._coded([lang] * len(contexts), [len(c) for c in contexts], contexts, 100)
    assert len(np.unique(codes)) == len(contexts)

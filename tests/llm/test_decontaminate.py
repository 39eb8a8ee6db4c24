import hashlib
import random

import pytest

from gridlake.llm import decontaminate as dc
from gridlake.llm.common import words


def brute(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + window]), set()).add(str(item) if item is not None else "")
    sizes = {len(k) for k in windows}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if key := windows.get(tuple(w[s : s + size])):
                    hit.update(range(s, s + size))
                    found |= key
        yield doc, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{k}é" for k in range(12)] + ["the", "of", "a", "1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice((1, 2, 4, 5, 12, 13, 20, 60)))) for k in range(12)]
    items += [(100, None), (101, "?!"), (None, text(15)), (5, items[5][1]), (200, "the of " * 20)]
    docs = []
    for k in range(60):
        body = text(rng.randrange(0, 200)).split()
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(body) + 1)
            cut = rng.randrange(len(w) + 1) if rng.random() < 0.5 else 0
            body[at:at] = [x.lower() for x in w[cut:]]
        docs.append((k, ", ".join(body)))
    return docs + [(61, None), (62, ""), (None, items[7][1]), (3, docs[3][1]), (63, "x " * 40_000 + (items[7][1] or ""))], items


@pytest.mark.parametrize("seed,block_rows", [(1, dc.BLOCK_ROWS), (2, 40)])
def test_spans_and_items_are_those_of_every_window(spark, seed, block_rows):
    docs, items = case(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", dc.F.lit("x")).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", dc.F.lit(1))
    rows = dc.contamination(frame, bench, block_rows=block_rows).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in rows)
    assert got == sorted((str(d), *rest) for d, *rest in brute(docs, items))
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = dc.contamination(docs, none).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
    assert dc.contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert hashlib.sha256(b"").hexdigest()

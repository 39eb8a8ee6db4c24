import random

from gridlake.llm import secret_scan as ss


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = "the of and tion with this that from ever near seen house river".split()
    rows, truth = [], {}
    for k in range(n):
        text = [rng.choice(words) for _ in range(30)]
        kind = k % 4
        if kind == 0:
            secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            text.insert(15, f'{rng.choice(["token", "api_key", "password"])} = "{secret}"')
            truth[k] = secret
        elif kind == 1:
            text.insert(15, f"river.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com")
        elif kind == 2:
            text.insert(15, f"{rng.randrange(10**15, 10**16)}")
        else:
            text.insert(15, f"house-of-the-river-{rng.randrange(99)}")
        rows.append((k, " ".join(text), rng.choice(["config/app.env", "docs/readme", None])))
    return rows, truth


def test_held_out_secrets_are_told_from_others(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("label", ss.F.lit("x")).repartition(3)
    found = {(r.doc_id, r.start): r for r in ss.scan(docs, spark.createDataFrame([], "doc_id long, start int, label int")).collect()}
    assert all(r.is_secret and r.probability is None for r in found.values())
    labels = [(d, s, int(truth.get(d) == r.found)) for (d, s), r in found.items() if d < 200]
    labelled = spark.createDataFrame(labels + [(5, 1, None), (None, 2, 1)], "doc_id long, start int, label int")
    scored = [r for r in ss.scan(docs, labelled).collect() if r.doc_id >= 200]
    right = sum(r.is_secret == (truth.get(r.doc_id) == r.found) for r in scored)
    assert len(scored) >= 150 and right / len(scored) >= 0.98
    for r in scored:
        assert dict((k, t) for k, t, _ in rows)[r.doc_id][r.start : r.end] == r.found


def test_labels_by_form_and_odd_rows(spark):
    rows, truth = corpus(120, 2)
    rows += [(500, None, None), (501, "", "x"), (None, 'token = "0123456789abcdef0123456789"', None), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = ss.scan(docs).collect()
    assert {r.doc_id for r in found if r.is_secret} >= set(truth)
    assert not [r for r in found if r.is_secret and "@" in r.found]
    assert sum(r.doc_id == 0 for r in found) == 2
    assert ss.scan(docs.limit(0)).count() == 0

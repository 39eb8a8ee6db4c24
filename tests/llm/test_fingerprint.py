import hashlib
import random

from gridlake.llm import fingerprint as fp


def rows_of(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", fp.F.lit("x")).repartition(3)
    return {(r.doc_id, r.text): r for r in fp.with_edits(docs, **how).collect()}


def corpus():
    rng = random.Random(3)
    rows = [(3 * k, " ".join(rng.choice("the of tion éa re nd").strip() + str(rng.randrange(99)) for _ in range(rng.randrange(120)))) for k in range(90)]
    return rows + [(1, None), (2, "one two"), (4, "a b c d e"), (7, "🙂é漢字"), (8, "🙂é漢字"), (10, "x y  z\n\nx y z " * 3000)]


def test_edits_and_sketches(spark):
    rows = sorted((d, t or "") for d, t in corpus())
    for size in (10_000, 7, 1):
        found = rows_of(spark, corpus(), rows_per_bucket=size)
        assert len(found) == len(rows)
        sketches = {t: r.sketch for (_, t), r in found.items()}
        for k, (doc, text) in enumerate(rows):
            row, after = found[doc, text], rows[(k + 1) % len(rows)][1]
            tail = len(text) // 4
            edited = text[: len(text) - tail] + after[:tail]
            assert row.n_chars == len(text)
            assert hashlib.sha256(row.edited.encode()).hexdigest() == hashlib.sha256(edited.encode()).hexdigest()
            assert row.next_sketch == sketches[after]
            if edited in sketches:
                assert row.edited_sketch == sketches[edited]


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_likeness_estimates_jaccard_and_containment(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(9999)}" for _ in range(4000)]
    pairs = [(" ".join(base), " ".join(base[n:])) for n in (0, 400, 2000, 3600)] + [("", ""), ("", "a b"), ("a b", "a b"), ("a b c", "d e f")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    a, b = fp.sketch(fp.F.col("a")), fp.sketch(fp.F.col("b"))
    rows = frame.select(
        fp.likeness(a, b).alias("like"), fp.containment(b, a).alias("held"), a.alias("own"), fp.merge(a, b).alias("both"),
        fp.as_text(a).alias("text"),
    ).collect()
    for (x, y), row in zip(pairs, rows):
        s, t = shingles(x), shingles(y)
        assert abs(row["like"] - (len(s & t) / len(s | t) if s | t else 1)) < 0.06
        assert abs(row["held"] - (len(s & t) / len(t) if t else 1)) < 0.06
        assert len(row["text"]) == 16 * len(row["own"])
        if t <= s and t:
            assert row["both"] == row["own"] or len(row["both"]) - len(row["own"]) <= 1
    assert abs(len(rows[0]["own"]) / 3996 - fp.FRACTION) < 0.05


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    plan = fp.with_edits(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(5, "one two three four five six seven")], "doc_id long, text string")
    row = fp.with_edits(docs).first()
    assert row.edited == row.text[: 33 - 8] + row.text[:8] and row.next_sketch == row.sketch
    assert fp.with_edits(docs.limit(0)).count() == 0

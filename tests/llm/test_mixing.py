import hashlib
import random
from collections import defaultdict

import pytest

from gridlake.llm import checks, mixing

import compare as comparing


def targets(totals, weights=(1, 2, 3), cap=3):
    """Clamp and share out again until nothing is above its cap."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    whole, fixed = sum(totals.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (whole - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > cap * totals[s]]
        if not over:
            return {s: fixed.get(s, level * weight[s]) for s in order}
        fixed.update({s: cap * totals[s] for s in over})


def filled(rows, part):
    """The documents of one source that its fraction takes, one at a time in seeded order."""
    order = sorted({r for r in rows}, key=lambda r: (hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    total = {r: r[1] * rows.count(r) for r in order}
    taken, lack = set(), part
    for r in order:
        if 0 < total[r] <= lack:
            taken.add(r)
            lack -= total[r]
    left = [r for r in order if r not in taken and abs(total[r] - lack) < lack]
    if left:
        taken.add(min(left, key=lambda r: (abs(total[r] - lack), order.index(r))))
    return taken


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        source = rng.choice(["hot"] * 4 + ["a", "b", "é", "z", None, "tiny" if k % 50 == 0 else "a"])
        rows.append((k, source, " ".join("w" for _ in range(rng.randrange(0, 200)))))
    return rows + [(900, "none", None), (901, "none", ""), rows[3], rows[3], (None, "a", "one two"), (902, "big", "w " * 5000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs = docs.withColumn("size", mixing.F.lit("x")).withColumn("target", mixing.F.lit(1)).repartition(3)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    totals, taken = defaultdict(int), defaultdict(int)
    for r in got:
        totals[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.repeats <= 3 and r.taken == r["size"] * r.repeats
    wanted = targets(totals)
    for r in got:
        assert r.source_size == totals[r.source]
        assert r.target == pytest.approx(wanted[r.source])
    for source, target in wanted.items():
        own = [(r.doc_id, r["size"]) for r in got if r.source == source]
        whole = int(target // totals[source]) if totals[source] else 0
        part = target - whole * totals[source]
        extra = filled(own, part)
        assert all(r.repeats == whole + ((r.doc_id, r["size"]) in extra) for r in got if r.source == source and r["size"])
        # Whatever is not taken would go further over than what lacks now.
        passed_over = [n for d, n in own if n and (d, n) not in extra]
        assert abs(taken[source] - target) <= min(passed_over, default=0)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_sql_gives_the_same_rows(spark, tmp_path):
    import duckdb

    docs = spark.createDataFrame(corpus(3)[:400], "doc_id long, source string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    query = lambda s, _: mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    problem, _, _ = comparing.compare(spark, con, str(tmp_path), "mix", query, checks.MIX)
    assert problem is None


@pytest.mark.parametrize("long_id", range(3))
def test_a_long_document_at_the_cut_is_passed_over(spark, long_id):
    rows = [(1000 + long_id, "a", "w " * 3000)] + [(k, "a", "w " * (1 + k % 13)) for k in range(400)]
    rows += [(6000 + k, "b", "w " * 9) for k in range(190)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for source in ("a", "b"):
        got = [r for r in mixing.mix(docs).collect() if r.source == source]
        assert sum(r.taken for r in got) == pytest.approx(got[0].target, abs=9)


def test_no_words_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert [(r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0.0, 0), (0.0, 0)]
    assert mixing.mix(docs.limit(0)).count() == 0

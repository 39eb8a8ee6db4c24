import __spark_entry__ as entry
import corpus_pipeline as cp
import pytest
from gridlake.llm import catalog
from gridlake.llm.common import read

import compare as comparing

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_with_sql(spark, name):
    problem, _, _ = comparing.compare(spark, comparing.connect(ROOT), ROOT, name, catalog.QUERIES[name], catalog.SQL[name])
    assert problem is None


def test_one_query_for_each_operator():
    numbers = [int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(numbers) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_stages_do_what_their_operators_say(spark):
    docs = read(spark, ROOT, "documents")
    extra = docs.withColumn("size", cp.F.lit("x")).withColumn("class_id", cp.F.lit(1)).withColumn("kept", cp.F.lit(2))
    again = extra.unionByName(extra.filter("doc_id < 5")).unionByName(extra.limit(1).withColumn("doc_id", cp.F.lit(None).cast("long")))
    frames = [again]
    for _, stage in cp.STAGES[:-1]:
        frames.append(cp.written(stage(spark, frames[-1], ROOT), "test_stage"))
        assert frames[-1].columns == again.columns
    ids = [sorted(str(r.doc_id) for r in f.select("doc_id").collect()) for f in frames]

    scores = catalog.quality.scores(frames[0], read(spark, ROOT, "labels")).collect()
    rejected = {str(r.doc_id) for r in scores if not r.kept}
    assert ids[1] == [i for i in ids[0] if i not in rejected]
    classes = catalog.near_dedup.near_duplicates(frames[1]).collect()
    assert ids[2] == sorted({str(r.class_id) for r in classes} | {str(r.doc_id) for r in classes if r.doc_id is None})
    found = catalog.decontaminate.contamination(frames[2], read(spark, ROOT, "benchmark")).collect()
    assert ids[3] == sorted(str(r.doc_id) for r in found if not r.contaminated or r.doc_id is None)
    repeats = catalog.mixing.mix(frames[3]).collect()
    assert ids[4] == sorted(str(r.doc_id) for r in repeats for _ in range(r.repeats))
    last = cp.STAGES[-1][1](spark, frames[4], ROOT).collect()
    assert sorted(str(r.doc_id) for r in last) == ids[4]
    assert sum(r.n_tokens for r in last) == max(r.start + r.n_tokens for r in last)


def test_run(spark):
    assert cp.run(spark, ROOT).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]

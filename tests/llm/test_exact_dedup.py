import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridlake.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, run string, digest string, size int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_force(rows, keep=max):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[lower(text)].append(doc)
    order = lambda d: (d is not None, d or 0)
    out = []
    for text, ids in groups.items():
        stays = keep(ids, key=order)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(d, stays, len(ids), sha) for d in ids]
    return sorted(out, key=str)


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = ["Hot passage that a third of all rows hold", "", None, "É", "é", "İ", "i̇", "K", "K", "ſ", "x" * 300_000, "X" * 300_000]
    texts += [f"Text {k // 3} {'Ab' if k % 2 else 'aB'} é" for k in range(200)] + [texts[0].upper()] * 60 + [texts[0]] * 60
    rng.shuffle(texts)
    out = [(rng.randrange(10**6), t) for t in texts]
    return out + [(None, "Text 1 ab é"), (None, "no other"), (5, "one id"), (5, "One id"), (5, "another"), out[3], out[3]]


@pytest.mark.parametrize("leaves, fan_in", [(1, 2), (5, 2), (7, 8), (64, 3)])
def test_groups_are_those_of_a_plain_comparison(spark, rows, leaves, fan_in):
    found = ed.exact_duplicates(frame(spark, rows), leaves=leaves, fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute_force(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_smallest_identifier_and_another_name(spark, rows):
    docs = frame(spark, rows).withColumnRenamed("text", "body").withColumnRenamed("doc_id", "row")
    found = ed.exact_duplicates(docs, "row", "body", keep="smallest").collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute_force(rows, min)


@pytest.mark.parametrize("digest", [lambda t: F.lit(7), lambda t: F.length(t) % 3])
def test_a_shared_digest_is_no_equal_text(spark, rows, digest):
    found = ed.exact_duplicates(frame(spark, rows), leaves=9, fan_in=3, digest=digest).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute_force(rows)


def test_rounds_meet_few_entries_of_one_text(spark):
    rows = [(k, "hot") for k in range(900)] + [(k, f"t{k}") for k in range(900, 1000)]
    docs = frame(spark, rows, 40)
    digests = ed.digested(docs, 40, "doc_id", "text", F.xxhash64)
    runs = ed.merged(digests.withColumn("size", F.lit(1)), F.max)
    most = lambda f: f.groupBy("run", "digest").count().agg(F.max("count")).first()[0]
    assert most(runs) == 1
    assert most(runs.withColumn("run", F.floor(F.col("run") / 8))) <= 8
    assert {(r.size, r.row.id) for r in ed.tree_merge(runs, 40, 8, F.max).filter("size > 1").collect()} == {(900, 899)}


def test_documents_that_stay(spark, rows):
    for keep, first in (("largest", max), ("smallest", min)):
        left = ed.deduplicated(frame(spark, rows), keep=keep)
        assert left.columns == ["doc_id", "text", "run", "digest", "size"]
        found = [(r.doc_id, hashlib.sha256(lower(r.text).encode()).hexdigest()) for r in left.collect()]
        wanted = {(k, sha) for _, k, _, sha in brute_force(rows, first)}
        assert len(found) == len(wanted) and set(found) == wanted


def test_empty_table_string_ids_and_plan(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ed.exact_duplicates(none).count() == 0 and ed.deduplicated(none).count() == 0
    docs = spark.createDataFrame([("a", "T"), ("b", "t"), ("c", "u")], "doc_id string, text string")
    found = ed.exact_duplicates(docs)
    assert {(r.doc_id, r.keep_id, r.kept) for r in found.collect()} == {("a", "b", False), ("b", "b", True), ("c", "c", True)}
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

from collections import Counter

import corpus_pipeline
from helpers import SF, documents, empty, odd

from byteloom.llm import common as C
from byteloom.llm import exact, langid, simhash


def test_stages_in_order(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    docs = documents(spark)
    columns = docs.columns
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = f(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            rejected = {r.doc_id for r in langid.detect(before).where("rejected").collect()}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == rejected
        if k == 1:
            assert docs.count() == before.select("text").distinct().count() and exact.find_copies(docs).where("n_copies > 1").count() == 0
        if k == 2:
            groups = {r.group_id for r in simhash.find_near_copies(before).collect()}
            assert Counter(r.doc_id for r in docs.collect()) == Counter(groups)
        if k == 3:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
        if k == 4:
            assert Counter(r.doc_id for r in docs.collect()) == Counter(r.doc_id for r in before.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_odd_rows(spark):
    docs = odd(spark)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert {1, 6, 11} <= {r.doc_id for r in docs.collect()}


def test_empty(spark):
    docs = empty(spark)
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = f(spark, docs, SF)
        assert docs.collect() == [] and (k == 4 or docs.columns == columns)


def test_a_run_leaves_only_what_its_result_reads(spark):
    since = C.tables_so_far(spark)
    out = corpus_pipeline.run(spark, SF)
    assert C.tables_so_far(spark) - since == 2 and out.count() > 0

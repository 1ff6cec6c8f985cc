import os
from types import SimpleNamespace

import pytest
from helpers import table
from pyspark.sql import functions as F

from byteloom.llm import common as C


def test_the_shared_folder(spark, tmp_path):
    def session(folder, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master))

    assert C.shared_dir(session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://a:7077", "k8s://b"):
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            C.shared_dir(session(None, master))
    own = session(None, "local[3]")
    made = C.shared_dir(own)
    assert os.path.isdir(made.removeprefix("file://")) and C.shared_dir(own) == made


def test_tables_are_written_and_dropped(spark):
    df = C.table(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://")
    assert sorted(r.id for r in df.collect()) == list(range(5)) and os.path.exists(path)
    assert C.table(spark.range(0)).dtypes == spark.range(0).dtypes and C.table(spark.range(0)).collect() == []
    C.drop_tables(spark)
    assert not os.path.exists(path)


def test_only_small_sides_are_broadcast(spark):
    plan = lambda n: spark.range(9).join(C.small(spark.range(3), n, 16), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(10) and "broadcast" not in plan(C.BROADCAST_BYTES)


def test_keeping_rows_by_id(spark):
    docs = table(spark, [(1, "a", None, None), (1, "a", None, None), (2, "b", None, None), (None, "c", None, None)])
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    one = spark.createDataFrame([(1,)], "x bigint")
    assert ids(C.without(docs, "doc_id", one)) == ["2", "None"] and ids(C.once(docs, "doc_id", one, ["doc_id", "text"])) == ["1", "2", "None"]
    assert C.free("gone", docs.withColumnRenamed("i", "GONE").withColumnRenamed("t", "gone_")) == "gone__"


def test_sifting_loses_nothing_and_moves_little(spark, monkeypatch):
    keys = spark.range(0, 30_000, 3).select("id")
    rows = spark.range(60_000).selectExpr("if(id % 1000 = 7, null, id) id", "'x' bloom", "id k")
    among, other = (C.sifted(rows, F.col("id"), keys, 10_000, x) for x in (True, False))
    assert among.columns == rows.columns
    hit, rest = ({r.k: r.id for r in x.collect()} for x in (among, other))
    assert not hit.keys() & rest.keys() and len(hit) + len(rest) == 60_000 and None not in hit.values()
    assert set(range(0, 30_000, 3)) - {k for k in range(60_000) if k % 1000 == 7} <= set(hit.values())
    assert len(hit) < 10_000 + 0.02 * 50_000
    plan = other._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "SortMergeJoin" not in plan
    # too many for a filter: all may be among them
    monkeypatch.setattr(C, "BROADCAST_BYTES", 1000)
    assert C.sifted(rows, F.col("id"), keys, 10_000, True).count() == 60_000 and C.sifted(rows, F.col("id"), keys, 10_000, False).isEmpty()
    want = rows.join(keys, "id", "left_anti").count()
    for limit in (1000, 20_000, 32 << 20):
        monkeypatch.setattr(C, "BROADCAST_BYTES", limit)
        assert C.without(rows, "id", keys).count() == want


def test_tables_of_a_run_are_dropped(spark):
    first = C.table(spark.range(3))
    since = C.tables_so_far(spark)
    gone, kept = C.table(spark.range(4)), C.table(spark.range(5))
    path = gone.inputFiles()[0].removeprefix("file://")
    C.drop_tables(spark, since, kept)
    assert not os.path.exists(path) and kept.count() == 5 and first.count() == 3 and C.tables_so_far(spark) == since + 1


def test_ids_must_be_whole_numbers(spark):
    C.whole_number(spark.range(1), "id")
    C.whole_number(spark.sql("select null id"), "id")
    with pytest.raises(TypeError, match="'id' must be integers, not string"):
        C.whole_number(spark.sql("select 'a-1' id"), "id")


def test_shuffle_files_of_a_table_are_deleted_at_once(spark):
    import time

    def shuffle_files():
        return spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().toString().count("shuffle_")

    rows = spark.range(2000).repartition(3, "id")
    before = shuffle_files()
    cleanup = spark.conf.get(C.CLEANUP, None)
    kept = C.table(rows, free=True)
    for _ in range(50):
        if shuffle_files() <= before:
            break
        time.sleep(0.2)
    assert shuffle_files() <= before and kept.count() == 2000 and rows.count() == 2000
    assert spark.conf.get(C.CLEANUP, None) == cleanup

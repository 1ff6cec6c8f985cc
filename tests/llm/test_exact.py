import numpy as np
from helpers import documents, empty, odd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from byteloom.llm import common as C
from byteloom.llm import exact as E
from byteloom.llm.exact import CountingQuotientFilter, drop_copies, find_copies

prints = st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 5), st.integers(2**64 - 5, 2**64 - 1)), max_size=60)


@settings(max_examples=150, deadline=None)
@given(prints, prints)
def test_filter_holds_and_merges_losslessly(a, b):
    fa, fb = (CountingQuotientFilter.of(np.array(x, np.uint64)) for x in (a, b))
    both = CountingQuotientFilter.from_bytes(fa.merge(fb).to_bytes())
    keys, n = both.items()
    assert dict(zip(keys.tolist(), n.tolist())) == {x: (a + b).count(x) for x in a + b}
    assert both.count(np.array(a + b, np.uint64)).tolist() == [(a + b).count(x) for x in a + b]
    assert both.count(np.array([7_777_777], np.uint64)).tolist() == [(a + b).count(7_777_777)]


def test_counts_of_several_digits():
    f = CountingQuotientFilter.of(np.array([3, 3, 9], np.uint64), np.array([2**40, 5, 1]))
    assert dict(zip(*(x.tolist() for x in CountingQuotientFilter.from_bytes(f.to_bytes()).items()))) == {3: 2**40 + 5, 9: 1}


def brute(rows):
    by = {}
    for i, t in rows:
        by.setdefault(t, []).append(i)
    out = []
    for i, t in rows:
        own = by[t]
        if t is None or len(own) == 1:
            out.append((i, i, 1, False))
        else:
            keep = min((x for x in own if x is not None), default=None)
            out.append((i, keep, len(own), i != keep))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    for docs in (documents(spark), odd(spark)):
        assert got(find_copies(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_colliding_fingerprints_are_told_apart_by_bytes(spark):
    docs = odd(spark)
    assert got(find_copies(docs, _print=lambda c: F.length(c).cast("bigint") % 2)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_one_row_of_each_text_stays(spark):
    docs = odd(spark)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, None, None, 6, 7, 8, 9, 10, 11]))
    assert drop_copies(docs.union(docs)).where("doc_id = 1").count() == 1


def test_empty(spark):
    assert find_copies(empty(spark)).collect() == [] and drop_copies(empty(spark)).collect() == []


def test_many_repeated_fingerprints_are_sifted(spark, monkeypatch):
    """Where the repeated fingerprints are too many to be broadcast as rows, a Bloom filter comes before the only move of texts."""
    docs = documents(spark)
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    for limit in (0, 2048, 4096):
        monkeypatch.setattr(E, "BROADCAST_BYTES", limit // 1000)
        monkeypatch.setattr(C, "BROADCAST_BYTES", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            assert got(find_copies(docs)) == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

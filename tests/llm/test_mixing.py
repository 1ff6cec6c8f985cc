import random
from collections import Counter

import pytest
from helpers import documents, empty, odd, table

from byteloom.llm import mixing as M


def test_pivotal_keeps_sums_and_chances():
    r = random.Random(3)
    p = [r.random() for _ in range(12)]
    hits = [0.0] * 12
    for _ in range(20_000):
        q, held = M.pivotal(p, [r.random() for _ in p])
        assert abs(sum(q) - sum(p)) < 1e-6
        assert all(x in (0.0, 1.0) for k, x in enumerate(q) if k != held)
        if held >= 0:
            q[held] = float(r.random() < q[held])
        hits = [a + b for a, b in zip(hits, q)]
    assert all(abs(h / 20_000 - x) < 0.02 for h, x in zip(hits, p))


@pytest.mark.parametrize("p", [[], [0.5], [1.0, 0.0], [0.5, 0.5], [0.3, 0.7, 0.999999999999]])
def test_pivotal_on_few(p):
    q, held = M.pivotal(p, [0.4] * len(p))
    assert abs(sum(q) - sum(p)) < 1e-6 and held == next((k for k, x in enumerate(q) if x not in (0.0, 1.0)), -1)


def test_sums_are_exact_up_the_tree(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 7)
    monkeypatch.setattr(M, "FAN_IN", 2)
    rows = [(k, "x", "en", "ab"[k % 3 == 0]) for k in range(500)]
    out = M.copies(table(spark, rows), weights={"a": 1, "b": 2}, total=700).collect()
    assert len(out) == 500
    got, want = Counter(), Counter()
    for r in out:
        got[r.source] += r.copies
        want[r.source] += r.expected
        assert r.copies - r.expected < 1 and r.expected - r.copies < 1
    assert all(abs(got[s] - want[s]) < 1 - 1e-9 for s in got) and abs(want["b"] - 2 * want["a"]) < 1e-6


def test_the_same_whatever_the_partitions(spark):
    docs = documents(spark)
    a, b = (sorted(map(tuple, M.copies(docs.repartition(n)).collect())) for n in (2, 5))
    assert a == b and len(a) == docs.count()


def test_by_default_nothing_is_lost(spark):
    out = M.copies(documents(spark), source_col="lang").collect()
    assert min(r.copies for r in out) == 1 and max(r.copies for r in out) > 1


def test_weights(spark):
    rows = [(1, "x", "en", "a"), (2, "x", "en", None), (3, "x", "en", "b")]
    got = {r.doc_id: r.copies for r in M.copies(table(spark, rows), weights={"a": 1.0, None: 2.0}, total=6).collect()}
    assert got == {1: 2, 2: 4, 3: 0}
    assert sorted(r.doc_id for r in M.mix(table(spark, rows), weights={"a": 1.0, None: 2.0}, total=6).collect()) == [1, 1, 2, 2, 2, 2]
    for bad in ({"a": -1.0, "b": 2.0}, {"a": 0.0}, {}):
        with pytest.raises(ValueError):
            M.copies(table(spark, rows), weights=bad)


def test_odd_rows(spark):
    docs = odd(spark)
    out = M.copies(docs).collect()
    assert sorted(r.doc_id for r in out) == list(range(1, 12)) and all(r.copies >= 1 for r in out)
    n = {r.doc_id: r.copies for r in out}
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter(r.doc_id for r in mixed.collect())
    assert got == Counter({**{i: k for i, k in n.items() if i != 2}, 2: 2 * n[2], None: 2})


def test_empty(spark):
    assert M.copies(empty(spark)).collect() == [] and M.mix(empty(spark)).collect() == []

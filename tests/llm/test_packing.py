import itertools
import random
from collections import Counter, defaultdict

import pytest
from helpers import documents, empty, odd

from byteloom.llm import packing as P


def padding(histogram, tops):
    return sum(c * (min(t for t in tops if t >= n) - n) for n, c in histogram)


def test_boundaries_are_optimal():
    r = random.Random(0)
    for _ in range(300):
        hist = [(n, r.randint(1, 9)) for n in r.sample(range(60), r.randint(1, 9))]
        for k in (1, 2, 3, 4, 12):
            tops = P.boundaries(hist, k)
            lens = sorted(n for n, _ in hist)
            assert len(tops) <= k and tops[-1] == lens[-1] and tops == sorted(set(tops))
            best = min(padding(hist, [*c, lens[-1]]) for m in range(min(k, len(lens))) for c in itertools.combinations(lens[:-1], m))
            assert padding(hist, tops) == best
    assert P.boundaries([], 4) == [] and P.boundaries([(5, 0)], 4) == []


def check(rows, texts, budget):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, len(t.split()) if t and t.isascii() else 0 if not t else r_tokens(t)) for i, t in texts)
    cells, sizes = set(), defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.pad_to
        assert (r.bucket, r.batch, r.slot) not in cells
        cells.add((r.bucket, r.batch, r.slot))
        sizes[r.bucket, r.batch].append(r)
    last = {}
    for (b, k), own in sizes.items():
        assert len(own) * max(1, own[0].pad_to) <= budget or len(own) == 1
        last[b] = max(last.get(b, 0), k)
    for (b, k), own in sizes.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        if k < last[b]:
            assert len(own) == max(1, budget // max(1, own[0].pad_to))
    for b in last:
        assert {k for bb, k in sizes if bb == b} == set(range(last[b] + 1))


def r_tokens(t):
    import re

    return len(re.findall(r"[^ \t\n\x0b\f\r]+", t))


@pytest.mark.parametrize("budget", [1, 700, 8192])
def test_batches(spark, budget, monkeypatch):
    monkeypatch.setattr(P, "RUN", 20)
    for docs in (documents(spark), odd(spark)):
        check(P.pack(docs, token_budget=budget).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()], budget)


def test_padding_is_that_of_the_optimum(spark):
    rows = P.pack(documents(spark), buckets=5).collect()
    hist = list(Counter(r.n_tokens for r in rows).items())
    assert sum(r.pad_to - r.n_tokens for r in rows) == padding(hist, P.boundaries(hist, 5))


def test_empty(spark):
    assert P.pack(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        P.pack(empty(spark), buckets=0)

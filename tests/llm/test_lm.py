import math
from collections import Counter

import numpy as np
from helpers import documents, empty, odd, table

from byteloom.llm import lm
from byteloom.llm.common import words


def brute(rows, order=2):
    """Scores from counts in dictionaries, and the weights from expectation-maximisation over lists."""
    seqs = [(i, [*words(t or ""), None]) for i, t in rows]
    held = [lm.held_out(i) for i, _ in seqs]
    seen, ctx = Counter(), Counter()

    def grams(s):
        """Of each place the n-grams of all orders that end there."""
        padded = ["<"] * (order - 1) + s
        return [[tuple(padded[k + order - n : k + order]) for n in range(1, order + 1)] for k in range(len(s))]

    for (_, s), h in zip(seqs, held):
        if not h:
            for own in grams(s):
                for g in own:
                    seen[g] += 1
                    ctx[g[:-1], len(g)] += 1
    v = sum(len(g) == 1 for g in seen)

    def parts(own, h):
        o = 0 if h else 1
        p, c = [], 0
        for g in own:
            c = max(ctx[g[:-1], len(g)] - o, 0)
            p.append(max(seen[g] - o, 0) / c if c else 0.0)
        return min(int(math.log2(1 + c)), lm.CLASSES - 1), [*p[::-1], 1 / (v + 1)]

    places = [parts(own, True) for (_, s), h in zip(seqs, held) if h for own in grams(s)]
    weights = np.full((lm.CLASSES, order + 1), 1 / (order + 1))
    for _ in range(lm.ROUNDS):
        sums = np.zeros_like(weights)
        for k, p in places:
            share = weights[k] * p
            sums[k] += share / share.sum()
        new = lm.maximise(sums)
        done = np.abs(new - weights).max() < lm.SETTLED
        weights = new
        if done:
            break
    out = []
    for (i, s), h in zip(seqs, held):
        total = sum(math.log2(np.dot(weights[k], p)) for k, p in (parts(own, h) for own in grams(s)))
        out.append((i, len(s) - 1, total, h))
    return out


def same(df, rows, order=2):
    got = sorted(((r.doc_id, r.n_words, r.log2_prob, r.held_out) for r in df.collect()), key=str)
    want = sorted(brute(rows, order), key=str)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-6)


def test_against_brute_force(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    same(lm.score(docs), rows)
    same(lm.score(docs.repartition(3), chunk_tokens=2000), rows)


def test_trigrams(spark, monkeypatch):
    monkeypatch.setattr(lm, "ORDER", 3)
    docs = documents(spark).where("doc_id < 60")
    same(lm.score(docs, chunk_tokens=3000), [tuple(r) for r in docs.select("doc_id", "text").collect()], 3)


def test_odd_rows(spark):
    docs = odd(spark)
    same(lm.score(docs), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    r = next(x for x in lm.score(docs).collect() if x.doc_id == 3)
    assert r.n_words == 0 and math.isclose(r.bits_per_token, -r.log2_prob) and math.isclose(r.perplexity, 2**r.bits_per_token)


def test_only_held_out_documents_and_empty(spark):
    ids = [i for i in range(200) if lm.held_out(i)][:3]
    got = lm.score(table(spark, [(i, "a b c", "en", "a") for i in ids])).collect()
    assert all(r.held_out and r.log2_prob <= 0 for r in got) and len(got) == 3
    assert lm.score(empty(spark)).collect() == []


def test_likely_text_scores_better(spark):
    rows = [(k, "the cat sat on the mat and the dog lay on the rug", "en", "a") for k in range(60)] + [(1000, "rug the on lay dog the and mat the on sat cat the", "en", "a")]
    got = {r.doc_id: r.bits_per_token for r in lm.score(table(spark, rows)).collect()}
    assert got[1000] > 3 * got[1]


def test_packing_of_arrays():
    for a in (np.array([], np.uint64), np.array([1, 2**63], np.uint64), np.arange(1000, dtype=np.uint32), np.array([0.25, -1.5])):
        b = lm._unpack(lm._pack(a))
        assert b.dtype == a.dtype and (a == b).all()


def test_the_query_has_trigrams(spark):
    from helpers import SF

    from byteloom.llm import queries

    docs = documents(spark)
    same(queries.op3_lm_score(spark, SF), [tuple(r) for r in docs.select("doc_id", "text").collect()], 3)


def test_tables_are_deleted_once_used(spark):
    from byteloom.llm.common import tables_so_far

    since = tables_so_far(spark)
    docs = documents(spark)
    scored = lm.score(docs, order=3)
    assert tables_so_far(spark) - since == 1  # what the result is made of
    assert scored.count() == scored.count() == docs.count()

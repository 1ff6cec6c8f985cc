import math

import numpy as np
from helpers import table

from byteloom.llm import ann as A


def brute(ids, x, k):
    s = x.astype(np.float64) @ x.astype(np.float64).T
    out = {}
    for i, v in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 9), ids[j]))
        out[v] = [ids[j] for j in order[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.vec_id, r.rank)):
        out.setdefault(r.vec_id, []).append(r.neighbour_id)
    return out


def recall(got, want):
    return np.mean([len(set(got.get(i, ())) & set(w)) / len(w) for i, w in want.items() if w])


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    assert recall(found(A.neighbours(df)), brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float32), 10)) >= 0.97


def test_blocks_and_few_probes(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 150)
    r = np.random.default_rng(0)
    x = (r.normal(size=(30, 9))[r.integers(0, 30, 700)] + 0.2 * r.normal(size=(700, 9))).astype(np.float32)
    df = table(spark, [(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    want = brute(list(range(700)), x, 5)
    full = A.neighbours(df, k=5, rerank=40)
    assert recall(found(full), want) >= 0.95 and full.count() == 3500
    assert all(abs(row.score - float(x[row.vec_id].astype(float) @ x[row.neighbour_id].astype(float))) < 1e-6 for row in full.collect())
    assert recall(found(A.neighbours(df, k=5, probed=0.3)), want) >= 0.8


def test_parallel_error_is_penalised():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 16)).astype(np.float32)
    books = r.normal(size=(8, 16, 2)).astype(np.float32)

    def errors(weight):
        codes = A.encode(x, x, books, weight)
        e = x - books[np.arange(8)[None], codes].reshape(400, 16)
        along = (e * x).sum(1) / np.linalg.norm(x, axis=1)
        return (along**2).mean(), (e**2).sum(1).mean(), codes

    (pa, ea, ca), (pb, eb, _) = errors(1.0), errors(9.0)
    assert pb < pa and eb >= ea
    assert (ca == ((x.reshape(400, 8, 1, 2) - books[None]) ** 2).sum(3).argmin(2)).all()
    new = A.solve(A.book_sums(x, x, books, A.encode(x, x, books, 9.0), 9.0), books)
    loss = lambda b, c: (((e := x - b[np.arange(8)[None], c].reshape(400, 16)) ** 2).sum() + 8 * ((e * x).sum(1) ** 2 / (x * x).sum(1)).sum())
    c = A.encode(x, x, books, 9.0)
    m = new.copy()
    one = books.copy()
    one[0] = m[0]  # each table is best while the others are held
    assert loss(one, c) <= loss(books, c) + 1e-3


def test_tables_scan_what_codes_say():
    r = np.random.default_rng(2)
    books, codes = r.normal(size=(3, 16, 2)).astype(np.float32), r.integers(0, 16, (20, 3)).astype(np.uint8)
    centres, lists, q = r.normal(size=(4, 6)).astype(np.float32), r.integers(0, 4, 20), r.normal(size=(5, 6)).astype(np.float32)
    x = centres[lists] + books[np.arange(3)[None], codes].reshape(20, 6)
    assert np.allclose(A.scan(q, centres, lists, books, codes), x @ q.T, atol=1e-4)


def test_odd_rows_and_empty(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (2, [0.9, 0.1, 0.0]), (3, None), (4, []), (5, [1.0, None, 0.0]), (6, [nan, 0.0, 0.0]), (7, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]), (8, [0.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0])]
    got = found(A.neighbours(table(spark, rows, "vec_id bigint, embedding array<float>"), k=2))
    assert got == {1: [9, 2], 2: [1, 9], 8: [1, 2], 9: [1, 2]}
    schema = "vec_id bigint, embedding array<float>"
    assert A.neighbours(table(spark, [], schema)).collect() == []
    assert A.neighbours(table(spark, [(1, [1.0, 2.0])], schema)).collect() == []
    assert A.neighbours(table(spark, [(1, None)], schema)).collect() == []


def test_dense_groups_and_equal_vectors(spark):
    r = np.random.default_rng(3)
    near = r.normal(size=32)
    near = near + 0.02 * np.linalg.norm(near) / math.sqrt(32) * r.normal(size=(400, 32))
    x = np.concatenate([r.normal(size=(500, 32)), near, np.repeat(r.normal(size=(1, 32)), 300, axis=0)]).astype(np.float32)
    ids = r.permutation(len(x)).tolist()
    df = table(spark, [(i, v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>")
    got, want = found(A.neighbours(df)), brute(ids, x, 10)
    assert recall(got, want) >= 0.999
    assert all(got[i] == want[i] for i in ids[900:])  # equal scores by id


def test_the_query_asks_for_every_fiftieth(spark):
    from byteloom.llm import queries

    got = found(queries.op7_nearest_neighbours(spark, "/root/testdata/sf0.1"))
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float32), 10)
    assert set(got) == {r.vec_id for r in rows if r.vec_id % 50 == 0}
    assert recall(got, {i: w for i, w in want.items() if i % 50 == 0}) >= 0.999


def test_every_vector_is_indexed_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(A, "SAMPLE", 60)
    monkeypatch.setattr(A, "LISTS", 7)
    monkeypatch.setattr(A, "BLOCK", 70)
    monkeypatch.setattr(A, "SLICE", 32)
    fitted = []
    monkeypatch.setattr(A, "fit_lists", lambda rows, *a, fit=A.fit_lists: fitted.append(rows.count()) or fit(rows, *a))
    r = np.random.default_rng(4)
    near = r.normal(size=(1, 12)) + 0.01 * r.normal(size=(400, 12))  # one list's vectors fill many blocks
    x = np.concatenate([r.normal(size=(300, 12)), near, np.repeat(r.normal(size=(1, 12)), 90, axis=0), np.zeros((3, 12))]).astype(np.float32)
    ids = (r.permutation(len(x)) - 200).tolist()
    df = table(spark, [(i, v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>")
    got, want = found(A.neighbours(df, every=3)), brute(ids, x, 10)
    assert fitted[0] < 200
    assert set(got) == {i for i in ids if i % 3 == 0}
    assert recall(got, {i: want[i] for i in got}) >= 0.999
    assert all(got[i] == want[i] for i in ids[700:790] if i in got)  # equal scores by id
    few = found(A.neighbours(df, every=3, probed=0.5))
    assert set(few) == set(got) and all(len(v) == 10 for v in few.values())


def test_long_lists_have_several_blocks():
    first, parts, blocks = A.blocks_of(np.array([3, 4, 25, 0, 9, 2]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5] and parts.tolist() == [1, 1, 3, 1, 1, 1] and blocks == 6
    assert A.blocks_of(np.array([0]), 10)[2] == 1

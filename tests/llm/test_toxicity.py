import numpy as np
import pytest
from helpers import documents, empty, odd, table

from byteloom.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_gradients():
    m = {k: v.astype(np.float64) for k, v in T.new_model(1).items()}
    feats, idx, y = T.features(["abc", "defg", "hi", "ved"]), np.array([[1, 2, 3, 0], [4, 1, 0, 0]]), np.array([1.0, 0.0])

    def loss(m):
        q = 1 / (1 + np.exp(-T.forward(m, T.project(m, T.inputs(m, feats)), idx)))
        return -np.log(np.where(y > 0, q, 1 - q)).mean()

    keep = {}
    p = T.project(m, T.inputs(m, feats))
    logit = T.forward(m, p, idx, keep)
    g, _ = T.backward(m, p, idx, keep, (1 / (1 + np.exp(-logit)) - y) / 2)
    for name in ("wo", "wa", "va", "ba", "uf", "ub"):
        at = np.unravel_index(5, m[name].shape)
        moved = []
        for step in (0.01, -0.01):
            other = dict(m, **{name: m[name].copy()})
            other[name][at] += step
            moved.append(loss(other))
        assert np.isclose((moved[0] - moved[1]) / 0.02, g[name][at], rtol=2e-2, atol=1e-7), name


def test_all_windows_overlap_and_cover():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        w = T.windows(n)
        assert {i for a, b in w for i in range(a, b)} == set(range(n))
        assert all(b - a <= T.WINDOW for a, b in w) and all(w[k + 1][0] < w[k][1] for k in range(len(w) - 1))


def test_many_texts_score_as_one_by_one():
    m = T.new_model(2)
    texts = ["a bb ccc", "", None, "one two " * 200, "bb", "\U0001f600 é " * 30]
    many = T.Reader(m).scores(texts)
    for t, s in zip(texts, many):
        assert np.allclose(T.Reader(m).scores([t])[0], s, atol=1e-5)
    own = T.words(texts[3])
    for k, (a, b) in enumerate(T.windows(len(own))):
        assert np.isclose(T.Reader(m).scores([" ".join(own[a:b])])[0][0], many[3][k], atol=1e-5)


@pytest.fixture(scope="module")
def fitted(spark):
    rows = documents(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("doc_id", "text", "toxic").collect()
    return [tuple(r) for r in rows]


def test_held_out_accuracy(fitted):
    train, check = [r for r in fitted if r[0] % 4], [r for r in fitted if not r[0] % 4]
    seen = {t for _, t, _ in train}
    check = [r for r in check if r[1] not in seen]
    toxic = [r for r in train if r[2]]
    f = T.fit(toxic + [r for r in train if not r[2]][: 3 * len(toxic)])
    s = np.array([x.max() if len(x) else 0 for x in T.Reader(f["model"]).scores([t for _, t, _ in check])])
    y = np.array([r[2] for r in check])
    hit = s >= f["threshold"]
    # a few hundred toxic labels, some of them for words that occur in no other document
    assert hit[y == 0].mean() < 0.05 and hit[y == 1].mean() > 0.9


def test_odd_rows_and_empty(spark):
    labels = table(spark, [(1, 1), (1, 0), (2, 0), (None, 1), (6, None), (7, 5), (11, 0)], "doc_id bigint, toxic int")
    got = T.score(odd(spark), labels).collect()
    assert len(got) == 14 and not any(r.toxic for r in got)
    assert {r.doc_id: r.n_windows for r in got}[6] == len(T.windows(40_000))
    assert all(r.n_windows == 0 and r.score == 0 and r.worst_word is None for r in got if r.doc_id in (3, 4, 5, 8))
    assert T.score(empty(spark), labels).collect() == []
    assert not any(r.toxic for r in T.score(odd(spark), table(spark, [], "doc_id bigint, toxic int")).collect())


def plain_probability(m, own):
    """One window read word by word, straight from the cell's equations."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    rows, grams, starts = T.features(own)
    ends = [*starts[1:], len(grams)]
    x = [np.concatenate([m["ew"][r], m["ec"][grams[a:b]].sum(axis=0) / np.sqrt(b - a)]).astype(np.float64) for r, a, b in zip(rows, starts, ends)]
    states = {}
    for d, seq in (("f", x), ("b", x[::-1])):
        h, out = np.zeros(T.HIDDEN), []
        for v in seq:
            g, hu = v @ m["w" + d] + m["c" + d], h @ m["u" + d]
            z, r = sig(g[: T.HIDDEN] + hu[: T.HIDDEN]), sig(g[T.HIDDEN : 2 * T.HIDDEN] + hu[T.HIDDEN : 2 * T.HIDDEN])
            n = np.tanh(g[2 * T.HIDDEN :] + r * hu[2 * T.HIDDEN :])
            h = (1 - z) * n + z * h
            out.append(h)
        states[d] = out if d == "f" else out[::-1]
    h = np.concatenate([states["f"], states["b"]], axis=1)
    e = np.exp(np.tanh(h @ m["wa"] + m["ba"]) @ m["va"])
    return sig((e / e.sum()) @ h @ m["wo"] + m["bo"][0])


def test_scores_against_brute_force(spark):
    import random

    r = random.Random(6)
    text = lambda n: [r.choice("ab cd ef gh ij kl mn op qr st".split()) + r.choice("xyz") for _ in range(n)]
    rows = []
    for k in range(120):
        own = text(r.choice([1, 5, 40, 64, 65, 150]))
        if k % 3 == 0:
            own[r.randrange(len(own))] = "vilest"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (None, "some vilest text")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(100)], "doc_id bigint, toxic int")
    fitted = T.fit([(k, t, int(k % 3 == 0)) for k, t in rows[:100]])
    got = {r.doc_id: r for r in T.score(docs, labels, max_labelled=4000).collect()}
    for k, t in [*rows, (None, "some vilest text")]:
        own = T.words(t)
        every = [plain_probability(fitted["model"], own[a:b]) for a, b in T.windows(len(own))]
        best = max(range(len(every)), key=lambda i: every[i])
        g = got[k]
        assert g.n_windows == len(every) and np.isclose(g.score, every[best], atol=2e-4)
        assert np.isclose(every[g.worst_word // T.STRIDE], every[best], atol=2e-4)
        assert g.toxic == (g.score >= fitted["threshold"])
    assert not got[500].toxic and not got[501].toxic


def test_the_sample_is_bounded_by_its_parameter_alone(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id doc_id", "concat('w', id) text")
    labels = spark.range(4000).selectExpr("id doc_id", "cast(id % 10 = 0 as int) toxic")
    seen = []
    monkeypatch.setattr(T, "fit", lambda rows, **how: seen.append(rows) or {"model": T.new_model(), "threshold": 2.0})
    for most, toxic, clean in ((400, 100, 300), (100_000, 400, 3600)):
        T.score(docs, labels, max_labelled=most)
        y = [y for *_, y in seen[-1]]
        assert abs(sum(y) - toxic) <= 30 and abs(len(y) - sum(y) - clean) <= 50
    from byteloom.llm.common import below

    for n in (5e10, 1e15):  # the chance of a row stays what it should be where labels are very many
        assert np.isclose((below(900 / n) + 2**63) / 2**64 * n, 900, rtol=1e-3)
    with pytest.raises(TypeError, match="integers"):
        T.score(docs.selectExpr("cast(doc_id as string) doc_id", "text"), labels)

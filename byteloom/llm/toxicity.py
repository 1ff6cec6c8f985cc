"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word is the vector of its hash, if it's common enough, and the scaled sum of its character trigrams' vectors. Windows of WINDOW words, STRIDE apart, overlap; each is read in both directions,
attention weighs its words, and a document's score is that of its worst window. Documents are labelled as a whole, so training first takes every window of a toxic
document for toxic, and then only those that the network itself finds worst."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom._ship import by_value
from byteloom.llm.common import below, small, table, whole_number, words

by_value(__name__)

#: Labelled documents that the network is trained on, about, a quarter of them toxic if there are enough.
MAX_LABELLED = 3600
#: Every passage of STRIDE words and one lies whole in a window.
WINDOW, STRIDE = 64, 32
WORDS, TRIGRAMS = 65_536, 16_384
#: Documents that a word must occur in to have a vector of its own; rarer ones would only be learnt by heart.
COMMON = 3
DIM, HIDDEN, ATTENTION = 12, 16, 16
#: Rounds of training, after each of which windows are chosen anew; passes over all that are chosen; windows of a step.
ROUNDS, PASSES, BATCH, RATE = 5, 1, 128, 0.01
#: Clean windows that a round takes for each toxic one: half of them those that score highest, half drawn.
CLEAN = 3
#: Labels are taken to be so much less than sure, which keeps scores apart at the ends.
SMOOTH = 0.02
#: Words whose projections a task keeps.
CACHE = 300_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def features(own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its row among the word vectors; and all words' rows among the trigram vectors, with where each word's start."""
    import xxhash

    rows = np.array([xxhash.xxh3_64_intdigest(w) % WORDS for w in own], np.int64)
    code = np.frombuffer("".join(f"<{w}>" for w in own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.array([len(w) for w in own], np.int64)  # as many trigrams as letters
    first = np.cumsum(lens + 2) - (lens + 2)
    at = np.arange(lens.sum()) + np.repeat(first - (np.cumsum(lens) - lens), lens)
    h = code[at] * np.uint64(0x9E3779B97F4A7C15) + code[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[at + 2] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return rows, (h >> np.uint64(40)).astype(np.int64) % TRIGRAMS, np.cumsum(lens) - lens


def new_model(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    g = lambda *s: r.normal(0, 1 / math.sqrt(s[0]), s).astype(np.float32)
    m = {"ew": r.normal(0, 0.05, (WORDS, DIM)).astype(np.float32), "ec": r.normal(0, 0.2, (TRIGRAMS, DIM)).astype(np.float32)}
    for d in "fb":
        m |= {"w" + d: g(2 * DIM, 3 * HIDDEN), "c" + d: np.zeros(3 * HIDDEN, np.float32), "u" + d: g(HIDDEN, 3 * HIDDEN)}
    return m | {"wa": g(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": g(ATTENTION), "wo": g(2 * HIDDEN), "bo": np.zeros(1, np.float32)}


def inputs(m: dict, feats) -> np.ndarray:
    rows, grams, starts = feats
    n = np.diff(np.append(starts, len(grams)))
    chars = np.add.reduceat(m["ec"][grams], starts, axis=0) / np.sqrt(n)[:, None].astype(np.float32)
    return np.concatenate([m["ew"][rows], chars], axis=1)


def project(m: dict, x: np.ndarray) -> list[np.ndarray]:
    """Gate inputs of each word by direction, in row 0 those of the padding, whose update gate keeps the state."""
    pad = np.zeros((1, 3 * HIDDEN), np.float32)
    pad[0, :HIDDEN] = 40
    return [np.concatenate([pad, x @ m["w" + d] + m["c" + d]]) for d in "fb"]


def _gru(p: list[np.ndarray], idx: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
    """States (steps, 2, windows, HIDDEN) of both directions, each in its own order of steps: the second reads from the end."""
    seq = idx.T
    x = np.stack([p[0][seq], p[1][seq[::-1]]], axis=1)
    h = np.zeros((2, idx.shape[0], HIDDEN), x.dtype)
    out = np.empty((idx.shape[1], *h.shape), x.dtype)
    for t, g in enumerate(x):
        hu = h @ u
        zr = sigmoid(g[..., : 2 * HIDDEN] + hu[..., : 2 * HIDDEN])
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        n = np.tanh(g[..., 2 * HIDDEN :] + r * hu[..., 2 * HIDDEN :])
        new = n + z * (h - n)
        if keep is not None:
            keep.append((h, z, r, n, hu[..., 2 * HIDDEN :]))
        out[t] = h = new
    return out


def forward(m: dict, p: list[np.ndarray], idx: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows, given as rows of ``p`` with 0 for padding at the end."""
    kept = None if keep is None else []
    both = _gru(p, idx, np.stack([m["uf"], m["ub"]]), kept)
    h = np.concatenate([both[:, 0], both[::-1, 1]], axis=2)
    a = np.tanh(h @ m["wa"] + m["ba"])
    e = np.where(idx.T > 0, a @ m["va"], np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    e /= e.sum(axis=0)
    c = np.einsum("tn,tnh->nh", e, h)
    if keep is not None:
        keep.update(h=h, a=a, e=e, c=c, kept=kept)
    return c @ m["wo"] + m["bo"]


def row_sums(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows named in ``at``, and the sums of their values."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return own[first], np.add.reduceat(values[order], first, axis=0) if len(own) else values[:0]


def backward(m: dict, p: list[np.ndarray], idx: np.ndarray, k: dict, dlogit: np.ndarray) -> tuple[dict, tuple[np.ndarray, np.ndarray]]:
    """Gradients of the dense weights but the inputs', and by direction those of the gate inputs at each place (steps, windows)."""
    g = {"wo": k["c"].T @ dlogit, "bo": dlogit.sum(keepdims=True)}
    dc = dlogit[:, None] * m["wo"]
    de = np.einsum("nh,tnh->tn", dc, k["h"])
    de = k["e"] * (de - (k["e"] * de).sum(axis=0))
    da = de[:, :, None] * m["va"] * (1 - k["a"] ** 2)
    g["va"] = np.einsum("tn,tna->a", de, k["a"])
    g["wa"] = np.einsum("tnh,tna->ha", k["h"], da, optimize=True)
    g["ba"] = da.sum(axis=(0, 1))
    dh_all = k["e"][:, :, None] * dc + da @ m["wa"].T
    u, steps = np.stack([m["uf"], m["ub"]]), idx.shape[1]
    gu, dh = np.zeros_like(u), np.zeros((2, idx.shape[0], HIDDEN), u.dtype)
    every = np.empty((2, steps, idx.shape[0], 3 * HIDDEN), u.dtype)
    ut = np.ascontiguousarray(u.transpose(0, 2, 1))
    for t in reversed(range(steps)):
        h, z, r, n, hun = k["kept"][t]
        dh = dh + np.stack([dh_all[t, :, :HIDDEN], dh_all[steps - 1 - t, :, HIDDEN:]])
        dn = dh * (1 - z) * (1 - n * n)
        gates = every[:, t]
        gates[..., :HIDDEN] = dh * (h - n) * z * (1 - z)
        gates[..., HIDDEN : 2 * HIDDEN] = dn * hun * r * (1 - r)
        dhu = np.concatenate([gates[..., : 2 * HIDDEN], dn * r], axis=2)
        gates[..., 2 * HIDDEN :] = dn
        gu += h.transpose(0, 2, 1) @ dhu
        dh = dh * z + dhu @ ut
    g["uf"], g["ub"] = gu
    return g, (every[0], every[1, ::-1])


def train_step(m: dict, state: dict, feats, idx: np.ndarray, y: np.ndarray, rate: float) -> float:
    """One step of Adam on the dense weights and of Adagrad on the vectors; gives the loss."""
    x = inputs(m, feats)
    p = project(m, x)
    keep: dict = {}
    logit = forward(m, p, idx, keep)
    prob = sigmoid(logit)
    g, gates = backward(m, p, idx, keep, ((prob - (y * (1 - 2 * SMOOTH) + SMOOTH)) / len(y)).astype(np.float32))
    place = idx.T.reshape(-1)
    real = np.flatnonzero(place)
    place, moved = place[real] - 1, 0
    own = x[place]
    for e, d in zip(gates, "fb"):
        e = e.reshape(-1, 3 * HIDDEN)[real]
        g["w" + d], g["c" + d] = own.T @ e, e.sum(axis=0)
        moved = moved + e @ m["w" + d].T
    dx = row_sums(place, moved)[1]  # every word is at some place
    norm = math.sqrt(sum(float((v * v).sum()) for v in g.values()))
    scale = min(1.0, 5.0 / (norm + 1e-9))
    state["t"] = t = state.get("t", 0) + 1
    for k, v in g.items():
        a, b = state.setdefault("m" + k, np.zeros_like(m[k])), state.setdefault("v" + k, np.zeros_like(m[k]))
        a += 0.1 * (scale * v - a)
        b += 0.001 * ((scale * v) ** 2 - b)
        m[k] -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    rows, grams, starts = feats
    n = np.diff(np.append(starts, len(grams)))
    for k, at, grad in (("ew", rows, dx[:, :DIM]), ("ec", grams, np.repeat(dx[:, DIM:] / np.sqrt(n)[:, None], n, axis=0))):
        if k == "ew" and "common" in state:
            kept = state["common"][at]
            at, grad = at[kept], grad[kept]
        uniq, total = row_sums(at, grad.astype(np.float32))
        past = state.setdefault("g" + k, np.full(len(m[k]), 1e-6, np.float32))
        past[uniq] += (total * total).mean(axis=1)
        m[k][uniq] -= 5 * rate * total / np.sqrt(past[uniq])[:, None]
    return float(-(np.log(np.where(y > 0, prob, 1 - prob) + 1e-7)).mean())


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of all windows over ``n`` words; the last ends with the text."""
    if n <= 0:
        return []
    last = max(0, -(-(n - WINDOW) // STRIDE))
    return [(k * STRIDE, min(n, k * STRIDE + WINDOW)) for k in range(last + 1)]


def window_table(docs: list[np.ndarray]) -> np.ndarray:
    """All windows over texts given as arrays of word numbers from 1: a row each, 0 behind its end."""
    idx = np.zeros((sum(len(windows(len(d))) for d in docs), WINDOW), np.int32)
    k = 0
    for d in docs:
        for a, b in windows(len(d)):
            idx[k, : b - a] = d[a:b]
            k += 1
    return idx


def probabilities(m: dict, p: list[np.ndarray], idx: np.ndarray) -> np.ndarray:
    """Of each window of a table; windows of alike length go together, so that short ones take fewer steps."""
    out = np.zeros(len(idx), np.float32)
    sizes = (idx > 0).sum(axis=1)
    order = np.argsort(sizes, kind="stable")
    for i in range(0, len(idx), 1024):
        own = order[i : i + 1024]
        out[own] = sigmoid(forward(m, p, idx[own, : int(sizes[own[-1]])]))
    return out


class Reader:
    """Scores texts with a model; keeps the projections of words that it has met."""

    def __init__(self, model: dict):
        self.m = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.p = project(self.m, np.zeros((0, 2 * DIM), np.float32))

    def scores(self, texts: list[str | None]) -> list[np.ndarray]:
        """The probability of each window of each text."""
        if len(self.at) > CACHE:
            self.clear()
        at, known = self.at, len(self.at)
        docs = []
        for t in texts:
            docs.append(np.array([at.setdefault(w, len(at)) for w in words(t)] if t else [], np.int32) + 1)
        if len(at) > known:
            fresh = list(at)[known:]
            x = inputs(self.m, features(fresh))
            self.p = [np.concatenate([old, new[1:]]) for old, new in zip(self.p, project(self.m, x))]
        return np.split(probabilities(self.m, self.p, window_table(docs)), np.cumsum([len(windows(len(d))) for d in docs])[:-1])


def some_features(feats, own: np.ndarray):
    """The ``features`` of the words numbered ``own``."""
    rows, grams, starts = feats
    n = np.diff(np.append(starts, len(grams)))[own]
    first = np.cumsum(n) - n
    return rows[own], grams[np.arange(n.sum()) + np.repeat(starts[own] - first, n)], first


def fit(rows: list[tuple[int, str, int]], clean: int = CLEAN, common: int = COMMON) -> dict:
    """Model and threshold from (id, text, 0 or 1). A fifth of the documents, by id, is kept for the threshold of the best F1 on them.

    A round goes PASSES times over all windows that it chooses: those of toxic documents that the network finds worst, and ``clean`` times as many clean ones, or all. Words in
    fewer than ``common`` documents have no vector of their own. With fewer than two documents of a class there is nothing to learn: the threshold is above 1, and nothing is toxic."""
    import xxhash

    rows = sorted((i, t, y) for i, t, y in rows if t and words(t))
    m, state = new_model(), {}
    aside = [r for r in rows if xxhash.xxh3_64_intdigest(str(r[0]), 3) % 5 == 0]
    used = [r for r in rows if xxhash.xxh3_64_intdigest(str(r[0]), 3) % 5]
    if min(sum(y for *_, y in used), sum(1 - y for *_, y in used)) < 2:
        return {"model": m, "threshold": 2.0}
    at: dict[str, int] = {}
    texts = [np.array([at.setdefault(w, len(at)) for w in words(t)], np.int32) + 1 for _, t, _ in used]
    idx, feats = window_table(texts), features(list(at))
    sizes = (idx > 0).sum(axis=1)
    doc, label = np.repeat(np.arange(len(used)), [len(windows(len(x))) for x in texts]), np.array([y for *_, y in used], np.float32)
    r = np.random.default_rng(1)
    seen = np.zeros(WORDS, np.int64)
    for own in texts:
        seen[np.unique(feats[0][np.unique(own) - 1])] += 1
    state["common"] = seen >= common
    m["ew"][~state["common"]] = 0
    for turn in range(ROUNDS):
        pick = np.arange(len(idx))
        if turn:
            s = probabilities(m, project(m, inputs(m, feats)), idx)
            best = np.zeros(len(used), np.float32)
            np.maximum.at(best, doc, s)
            # of a toxic document the windows near its worst one, if any is likely, as labels may be wrong; of others all
            pick = np.flatnonzero((label[doc] == 0) | (s >= np.maximum(0.5, 0.8 * best[doc])))
        good, bad = pick[label[doc[pick]] == 0], pick[label[doc[pick]] == 1]
        if len(good) > clean * len(bad):  # the clean windows that score highest, and as many drawn from all
            k = clean * len(bad) // 2
            hard = good[np.argsort(-s[good], kind="stable")[:k]] if turn else good[:0]
            good = np.union1d(hard, r.choice(good, clean * len(bad) - len(hard), replace=False))
        if not len(bad):
            break
        pick = np.concatenate([good, bad])
        order = np.concatenate([r.permutation(pick) for _ in range(PASSES)])
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            part = idx[own, : sizes[own].max()]
            met, place = np.unique(part, return_inverse=True)
            # the padding keeps number 0, whether a window has any or not
            place = place.reshape(part.shape) + (met[0] > 0)
            train_step(m, state, some_features(feats, met[met > 0] - 1), place, label[doc[own]], RATE * (1 - turn / ROUNDS))
    check = aside if len({y for *_, y in aside}) == 2 else used
    worst = np.array([x.max() for x in Reader(m).scores([t for _, t, _ in check])])
    y = np.array([y for *_, y in check])
    cuts = np.unique(np.r_[worst, 0.5])
    f1 = [2 * (y[worst >= c]).sum() / ((worst >= c).sum() + y.sum()) for c in cuts]
    at = int(np.argmax(f1))
    best = cuts[at]
    below = worst[worst < best]
    # half of the way to the next lower score, which was rejected
    return {"model": m, "threshold": float((best + below.max()) / 2) if len(below) else float(best)}


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, label_col: str, max_labelled: int, **how) -> dict:
    """Trains on about ``max_labelled`` documents, chosen by a hash of their ids, up to a quarter of them toxic."""
    y = labels.where(F.col(label_id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(label_id_col).cast("bigint").alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    n = {r.y: r["count"] for r in y.groupBy("y").count().collect()}
    limit = {k: below(min(1.0, max_labelled * part / max(1, n.get(k, 0)))) for k, part in ((1, 0.25), (0, 0.75))}
    y = table(y.where(F.xxhash64("i", F.lit(23)) <= F.when(F.col("y") == 1, limit[1]).otherwise(limit[0])))
    text = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    rows = text.join(small(y, y.count(), 16), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y")).collect()  # bounded by max_labelled
    return fit([(r.i, r.t, r.y) for r in rows], **how)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, clean: int = CLEAN, common: int = COMMON) -> DataFrame:
    """(doc_id, score, toxic, n_windows, worst_word) of every row; worst_word is the place, in words, where the worst window starts.

    Null texts and texts without words have no windows, score 0 and aren't toxic. Repeated rows each have a row; a null id stays null. Labels that are neither 0 nor 1 don't
    count; of several labels of a document the greatest does. Without labels of both classes nothing is toxic. Other columns are ignored; an empty table gives an empty one.
    Of windows that score the same the first is the worst. Long texts are scored whole, in all their windows. Ids, of documents and of labels, must be integers.

    The network is trained on about ``max_labelled`` labelled documents, which alone bounds its work; ``clean`` and ``common`` are those of ``fit``."""
    whole_number(docs, id_col), whole_number(labels, label_id_col)
    fitted = fit_on(docs, labels, id_col, text_col, label_id_col, label_col, max_labelled, clean=clean, common=common)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # of fixed size

    def run(batches):
        reader, threshold = Reader(shared.value["model"]), shared.value["threshold"]
        for whole in batches:
            for b in pa.Table.from_batches([whole]).to_batches(max_chunksize=1000):
                got = reader.scores(b.column(1).to_pylist())
                top = [float(s.max()) if len(s) else 0.0 for s in got]
                cols = [b.column(0), pa.array(top, pa.float64()), pa.array([bool(len(s)) and x >= threshold for s, x in zip(got, top)], pa.bool_())]
                cols += [pa.array([len(s) for s in got], pa.int64()), pa.array([int(s.argmax()) * STRIDE if len(s) else None for s in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "toxic", "n_windows", "worst_word"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, toxic boolean, n_windows bigint, worst_word bigint")

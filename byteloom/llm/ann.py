"""Nearest neighbours by inner product with score-aware anisotropic quantisation.

Vectors are assigned to lists by k-means, and a vector's difference from its list's centre is quantised in pairs of dimensions to one of 16 codewords, four bits each. What
matters for large inner products is the part of the quantisation's error that is parallel to the vector, so that part's square weighs ETA times as much as the rest's, both
when codes are chosen and when codewords are fitted. Centres and codewords are fitted on SAMPLE vectors, those of the least hashes; all vectors are indexed. Lists make blocks of at most about BLOCK vectors, long lists several.
A query scans the codes of the blocks that hold a list it probes, and the RERANK best are scored again exactly. So is every other vector whose rough score, with the bound of its
quantisation's error, could still reach the k-th exact score: of the blocks it scans a query has the true best, and equal scores go by id. By default all lists are probed: vectors without structure have their neighbours
in any list, and fewer probes lose them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom._ship import by_value
from byteloom.llm.common import below, table, whole_number

by_value(__name__)

K = 10
RERANK = 100
#: Part of all lists that a query probes.
PROBED = 1.0
#: Vectors of a block, of members or of queries, about; fewer where their numbers take more than BLOCK_BYTES.
BLOCK, BLOCK_BYTES = 65_536, 32 << 20
#: Queries and members that are compared at once.
QUERIES, SLICE = 64, 16_384
#: Vectors that centres and codewords are fitted on, about, and how many centres there are at most.
SAMPLE, LISTS = 32_768, 1024
#: Tasks of a search, at most.
TASKS = 20_000
LIST_ROUNDS, CODE_ROUNDS = 8, 3
#: Inner products above this share of the norms are the ones to keep; it sets ETA.
THRESHOLD = 0.2
WORDS = 16


def eta(dim: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel error: (d - 1) t^2 / (1 - t^2), 1 at least."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def encode(x: np.ndarray, rest: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n, pairs) of ``rest`` = ``x`` less its centre, by coordinate descent on |error|^2 + (weight - 1) (error . x/|x|)^2."""
    n, pairs = len(x), len(books)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    r, u = (np.ascontiguousarray(a.reshape(n, pairs, 2).transpose(2, 1, 0))[..., None] for a in (rest, u))
    dx, dy = r[0] - books[:, None, :, 0], r[1] - books[:, None, :, 1]
    plain, along = dx * dx + dy * dy, u[0] * dx + u[1] * dy  # (pairs, n, words)
    codes = plain.argmin(axis=2)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=0)
    for _ in range(sweeps):
        for m in range(pairs):
            others = total - along[m, rows, codes[m]]
            codes[m] = (plain[m] + (weight - 1) * (others[:, None] + along[m]) ** 2).argmin(axis=1)
            total = others + along[m, rows, codes[m]]
    return np.ascontiguousarray(codes.T).astype(np.uint8)


def book_sums(x: np.ndarray, rest: np.ndarray, books: np.ndarray, codes: np.ndarray, weight: float) -> np.ndarray:
    """(pairs, 16, 6): for each codeword the matrix (3) and vector (2) of the equations that its best place solves, the others' held, and its vectors' number."""
    n, pairs = len(x), len(books)
    u = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).reshape(n, pairs, 2)
    r = rest.reshape(n, pairs, 2)
    chosen = books[np.arange(pairs)[None], codes]
    along = (u * (r - chosen)).sum(axis=2)
    others = along.sum(axis=1, keepdims=True) - along
    w = weight - 1
    b = r + w * u * ((u * r).sum(axis=2) + others)[:, :, None]
    cols = np.stack([1 + w * u[:, :, 0] ** 2, w * u[:, :, 0] * u[:, :, 1], 1 + w * u[:, :, 1] ** 2, b[:, :, 0], b[:, :, 1], np.ones((n, pairs))], axis=2)
    out = np.zeros((pairs, WORDS, 6))
    for m in range(pairs):
        np.add.at(out[m], codes[:, m], cols[:, m])
    return out


def solve(sums: np.ndarray, books: np.ndarray) -> np.ndarray:
    new = books.astype(np.float64).copy()
    for m, k in zip(*np.nonzero(sums[:, :, 5] > 0)):
        a, b, d, p, q, _ = sums[m, k]
        new[m, k] = np.linalg.lstsq(np.array([[a, b], [b, d]]), np.array([p, q]), rcond=None)[0]
    return new.astype(np.float32)


def decode(centres: np.ndarray, lists: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The vectors that the codes stand for."""
    return centres[lists] + books[np.arange(len(books))[None], codes].reshape(len(codes), -1)


def scan(queries: np.ndarray, centres: np.ndarray, lists: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate products (vectors, queries). One matrix product of decoded vectors takes a quarter of the time that numpy needs to look products up in tables."""
    return decode(centres, lists, books, codes) @ queries.T


def error_bound(x: np.ndarray, centres: np.ndarray, lists: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Of each vector the most by which ``scan`` can miss its product with a query of length 1: its quantisation's error, and the rounding of the scan."""
    coded = books[np.arange(len(books))[None], codes].reshape(x.shape).astype(np.float64)
    c = centres[lists].astype(np.float64)
    size = np.linalg.norm(c, axis=1) + np.linalg.norm(coded, axis=1)
    return np.linalg.norm(x - c - coded, axis=1) + (2 * x.shape[1] + 16) * 2.0**-24 * size


def first_of_equals(x: np.ndarray, most: int) -> np.ndarray:
    """The places, in order, of all rows but those that have ``most`` equal ones before them."""
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).reshape(-1), return_inverse=True)
    order = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(same[order]) > 0])
    before = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    return np.sort(order[before < most])


def best_so_far(who: np.ndarray, y: np.ndarray, coded: np.ndarray, ids: np.ndarray, x: np.ndarray, error: np.ndarray, rerank: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the ids and exact scores (queries, k) of its best members but itself, where ``best`` has those of the members before, with -inf for none yet.

    A product with ``coded`` may miss the score by ``error`` times the query's length."""
    k = best[1].shape[1]
    y = y.astype(np.float64)
    length = np.linalg.norm(y, axis=1)
    length[length == 0] = 1
    unit = (y / length[:, None]).astype(np.float32)
    reach = best[1][:, -1]
    top = max(rerank, k + 1)
    need = np.ones(len(ids), bool)
    most = np.sqrt(np.einsum("nd,nd->n", x, x, dtype=np.float64).max(initial=0))
    if top < len(ids):
        rough = unit @ coded.T
        if np.isneginf(reach).any():
            cand = np.argpartition(rough, len(ids) - top, axis=1)[:, len(ids) - top :]
            exact = np.einsum("nd,ncd->nc", y, x[cand].astype(np.float64))
            exact[who[:, None] == ids[cand]] = -np.inf
            reach = np.maximum(reach, np.partition(exact, top - k, axis=1)[:, top - k])
        rough -= (reach / length).astype(np.float32)[:, None]
        # what isn't a number can't be ruled out
        need = ~(rough.max(axis=0) < -(error + 2.0**-20 * most))
    ids, x = ids[need], x[need]
    if not len(ids):
        return best
    low = reach / length - (x.shape[1] + 8) * 2.0**-22 * most
    a, b = np.divmod(np.flatnonzero(~(unit @ x.T < low.astype(np.float32)[:, None])), len(ids))
    other = who[a] != ids[b]
    a, b = a[other], b[other]
    score = np.concatenate([np.einsum("nd,nd->n", y[a[i : i + 65536]], x[b[i : i + 65536]].astype(np.float64)) for i in range(0, len(a), 65536)] or [np.zeros(0)])
    c, d = np.nonzero(best[1] > -np.inf)
    a, i, score = np.r_[a, c], np.r_[ids[b], best[0][c, d]], np.r_[score, best[1][c, d]]
    order = np.lexsort((i, -score, a))
    a = a[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    order, a, rank = order[rank < k], a[rank < k], rank[rank < k]
    out = np.zeros_like(best[0]), np.full_like(best[1], -np.inf)
    out[0][a, rank], out[1][a, rank] = i[order], score[order]
    return out


def blocks_of(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each list its first block and the number of its blocks, and the number of all blocks: short lists share one, a list of more than ``most`` has several."""
    first, parts, at, used = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for j, n in enumerate(sizes.tolist()):
        if used and used + n > most:
            at, used = at + 1, 0
        first[j], parts[j] = at, max(1, -(-n // most))
        at, used = (at + int(parts[j]), 0) if n > most else (at, used + n)
    return first, parts, max(1, at + (used > 0))


def mixed(ids: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each id, 0 to 2^31 - 1."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) >> np.uint64(33)).astype(np.int64)


def _sums(rows: DataFrame, function, key: str, width: int) -> dict[int, np.ndarray]:
    """``function`` turns a batch's vectors into (keys, float64 rows); these are added up by key over all partitions."""

    def local(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            keys, values = function(matrix(b.column("v")))
            for k, v in zip(keys.tolist(), values):
                total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], [key, "sum"])

    def combine(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(raw)
                total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], [key, "sum"])

    schema = f"{key} bigint, sum binary"
    return {r[0]: np.frombuffer(r[1]) for r in rows.mapInArrow(local, schema).repartition(key).mapInArrow(combine, schema).collect()}


def fit_lists(rows: DataFrame, n: int, lists: int) -> np.ndarray:
    """k-means over ``rows``, started at those whose ids have the least hashes."""
    start = rows.select("id", "v", F.xxhash64("id", F.lit(31)).alias("h")).orderBy("h", "id").limit(lists).collect()
    centres = np.stack([np.frombuffer(r.v, np.float32) for r in start])
    for _ in range(LIST_ROUNDS if lists > 1 else 1):

        def step(x, centres=centres):
            at = nearest(x, centres)
            own = np.unique(at)
            sums = np.zeros((len(centres), x.shape[1] + 1))
            np.add.at(sums[:, :-1], at, x)
            sums[:, -1] = np.bincount(at, minlength=len(centres))
            return own, sums[own]

        new = centres.copy()
        for k, s in _sums(rows, step, "list", centres.shape[1] + 1).items():
            new[k] = s[:-1] / s[-1]
        centres = new
    return centres


def fit_books(rows: DataFrame, centres: np.ndarray, weight: float) -> np.ndarray:
    """Codewords, started at the spread of the differences in each pair of dimensions, then fitted to the score-aware loss over ``rows``."""
    pairs = centres.shape[1] // 2

    def spread(x):
        rest = x - centres[nearest(x, centres)]
        return np.zeros(1, np.int64), np.concatenate([(rest**2).sum(axis=0), [len(x)]])[None].astype(np.float64)

    s = _sums(rows, spread, "all", centres.shape[1] + 1)[0]
    sd = np.sqrt(s[:-1] / s[-1] + 1e-12).reshape(pairs, 2)
    grid = np.array([-1.4, -0.45, 0.45, 1.4])
    books = np.stack([np.stack([np.repeat(grid, 4) * a, np.tile(grid, 4) * b], axis=1) for a, b in sd]).astype(np.float32)
    for _ in range(CODE_ROUNDS):

        def step(x, books=books):
            rest = x - centres[nearest(x, centres)]
            return np.zeros(1, np.int64), book_sums(x, rest, books, encode(x, rest, books, weight), weight).reshape(1, -1)

        books = solve(_sums(rows, step, "all", 0)[0].reshape(pairs, WORDS, 6), books)
    return books


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, probed: float = PROBED, rerank: int = RERANK, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbour_id, score) of every vector whose id is divisible by ``every``: its ``k`` other vectors of greatest inner product, of all, by rank from 1; equal scores go by id.

    Vectors that are null, empty, hold a null or what isn't finite, or haven't the commonest length (of equally common ones the greatest) have no rows and are nobody's
    neighbours; rows without an id neither. Rows that repeat an id are one vector, the least. Ids must be integers. Other columns are ignored; an empty table, and a single vector, give no rows."""
    whole_number(vectors, id_col)
    as_float = F.transform(F.col(vector_col), lambda x: x.cast("float"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), as_float.alias("a")).where("id is not null and size(a) > 0")
    rows = rows.where(F.forall("a", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.groupBy("id").agg(F.min("a").alias("a"))
    common = rows.groupBy(F.size("a").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out_schema = "vec_id bigint, rank int, neighbour_id bigint, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], out_schema)
    dim = common.d + common.d % 2

    def to_bytes(batches):
        for b in batches:
            x = b.column(1).values.to_numpy(zero_copy_only=False)[b.column(1).offsets[0].as_py() :][: b.num_rows * common.d].reshape(b.num_rows, common.d).astype(np.float32)
            x = np.pad(x, ((0, 0), (0, dim - common.d)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "v"])

    rows = table(rows.where(F.size("a") == common.d).mapInArrow(to_bytes, "id bigint, v binary"))
    n = rows.count()
    lists = min(LISTS, max(1, round(math.sqrt(n) / 2)))
    probes = max(min(lists, 4), math.ceil(probed * lists))
    weight = eta(dim)
    # the vectors of a sample are drawn by a hash of the id, so that a task run again draws the same
    sample = rows if n <= SAMPLE else table(rows.where(F.xxhash64("id", F.lit(29)) <= F.lit(below(SAMPLE / n))))
    centres = fit_lists(sample, n, lists)
    lists = len(centres)
    books = fit_books(sample, centres, weight)
    kept = rows.sparkSession.sparkContext.broadcast((centres, books))  # LISTS centres at most

    def place(batches):
        """Each vector with its list, its codes, and the lists that it asks as a query; null if it asks all."""
        centres, books = kept.value
        for b in batches:
            for part in pa.Table.from_batches([b]).to_batches(max_chunksize=2048):
                x = matrix(part.column(1))
                own = nearest(x, centres)
                codes = encode(x, x - centres[own], books, weight)
                asked = [None] * len(x)
                if probes < lists:
                    for i in np.flatnonzero(part.column(0).to_numpy() % every == 0).tolist():
                        asked[i] = np.argpartition(-(centres @ x[i]), probes - 1)[:probes]
                cols = [part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error_bound(x, centres, own, books, codes)), pa.array(own, pa.int64()), pa.array(asked, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "v", "code", "error", "list", "asks"])

    placed = table(rows.mapInArrow(place, "id bigint, v binary, code binary, error double, list bigint, asks array<bigint>"))
    block = max(1, min(BLOCK, BLOCK_BYTES // (4 * dim)))
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():
        sizes[r.list] = r["count"]
    first_block, parts_of, blocks = blocks_of(sizes, block)

    def asking(ids, asks):
        """For each pair of a query and a block that it asks the query's place in the batch, and the block."""
        who = np.flatnonzero(ids % every == 0)
        if probes >= lists:
            return np.repeat(who, blocks), np.tile(np.arange(blocks), len(who))
        own = [np.unique(np.concatenate([np.arange(first_block[j], first_block[j] + parts_of[j]) for j in asks[i].as_py()])) for i in who.tolist()]
        return np.repeat(who, [len(b) for b in own]), np.concatenate([np.zeros(0, np.int64), *own])

    def count(batches):
        askers = np.zeros(blocks, np.int64)
        for b in batches:
            askers += np.bincount(asking(b.column(0).to_numpy(), b.column(1))[1], minlength=blocks)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks)), pa.array(askers)], ["b", "n"])

    # a block of members meets the queries that ask it, about as many of them in a cell; it's copied for these cells only
    groups = np.zeros(blocks, np.int64)
    for r in placed.where(F.col("id") % every == 0).select("id", "asks").mapInArrow(count, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect():  # blocks are about n / BLOCK
        groups[r.b] = -(-r.n // block)
    first_cell = np.cumsum(groups) - groups
    cells_in_all = int(groups.sum())

    def route(batches):
        """A row for each member and cell of its block, and one without code for each query and block that it asks."""
        for b in batches:
            for part in pa.Table.from_batches([b]).to_batches(max_chunksize=512):
                ids, own = part.column(0).to_numpy(), part.column(4).to_numpy()
                home = first_block[own] + mixed(ids, 43) % parts_of[own]
                m = np.repeat(np.arange(len(ids)), groups[home])
                copy = np.arange(len(m)) - np.searchsorted(m, m)
                q, b_ = asking(ids, part.column(5))
                for at, cell, asks in ((m, first_cell[home[m]] + copy, False), (q, first_cell[b_] + mixed(ids[q], 41) % np.maximum(groups[b_], 1), True)):
                    for i in range(0, len(at), 65536):
                        t = part.select([0, 1, 2, 3, 4]).take(pa.array(at[i : i + 65536]))
                        code, error = (pa.nulls(len(t), pa.binary()), pa.nulls(len(t), pa.float64())) if asks else (t.column(2), t.column(3))
                        yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + 65536]), t.column(0), t.column(1), code, error, t.column(4)], ["cell", "id", "v", "code", "error", "list"])

    def cells(batches):
        """The tables of one cell after the other, of rows sorted by cell."""
        at, held = None, []
        for b in batches:
            own = b.column(0).to_numpy()
            for c in np.unique(own).tolist():
                if c != at and held:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                at = c
                held.append(b.filter(pa.array(own == c)))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def search(batches):
        centres, books = kept.value
        for t in cells(batches):
            member = t.column("code").is_valid()
            m, q = t.filter(member).sort_by("id"), t.filter(pa.compute.invert(member))
            if not m.num_rows or not q.num_rows:
                continue
            x = matrix(m.column("v").combine_chunks())
            first = first_of_equals(x, k + 1)  # of equal members, by id, no query has more among its best
            # members that are alike are ruled out together, queries that are alike need the same members
            first = first[np.argsort(m.column("list").to_numpy()[first], kind="stable")]
            m, x, q = m.take(pa.array(first)), x[first], q.sort_by("list")
            ids, at, error = (m.column(name).to_numpy() for name in ("id", "list", "error"))
            coded = decode(centres, at, books, np.frombuffer(b"".join(m.column("code").to_pylist()), np.uint8).reshape(len(ids), -1))
            asker, queries = q.column("id").to_numpy(), matrix(q.column("v").combine_chunks())
            for i in range(0, len(asker), QUERIES):
                who, y = asker[i : i + QUERIES], queries[i : i + QUERIES]
                best = np.zeros((len(who), k), np.int64), np.full((len(who), k), -np.inf)
                for j in range(0, len(ids), SLICE):
                    best = best_so_far(who, y, coded[j : j + SLICE], ids[j : j + SLICE], x[j : j + SLICE], error[j : j + SLICE], rerank, best)
                there = best[1] > -np.inf
                cuts = pa.array(np.append(0, there.sum(axis=1).cumsum()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.ListArray.from_arrays(cuts, pa.array(best[0][there])), pa.ListArray.from_arrays(cuts, pa.array(best[1][there]))], ["vec_id", "ids", "scores"])

    # cells beyond TASKS share tasks, which take one cell after the other
    routed = placed.mapInArrow(route, "cell bigint, id bigint, v binary, code binary, error double, list bigint")
    found = routed.repartitionById(max(1, min(cells_in_all, TASKS)), F.col("cell").cast("int")).sortWithinPartitions("cell").mapInArrow(search, "vec_id bigint, ids array<bigint>, scores array<double>")
    pairs = F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    best = found.groupBy("vec_id").agg(F.filter(F.array_sort(F.flatten(F.collect_list(pairs))), lambda x, i: i < k).alias("best"))
    return best.select("vec_id", F.posexplode("best").alias("r", "b")).select("vec_id", (F.col("r") + 1).alias("rank"), F.col("b.i").alias("neighbour_id"), (-F.col("b.s")).alias("score"))

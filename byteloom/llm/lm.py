"""Language-model scores by deleted interpolation.

The model is counted on the corpus itself: n-gram counts of all documents but a tenth, which is held out. A word's probability mixes the maximum-likelihood estimates of
all orders, and a uniform one, with weights that depend on how often the context was seen (by powers of two); expectation-maximisation fits the weights to the held-out
documents. When a place of a document that was counted is scored, its own occurrence is first deleted from the counts it is scored with; what else the document has of the same
n-gram stays counted.

Text is worked on in chunks of about CHUNK_TOKENS tokens. Of each order a chunk sends its distinct n-grams, as sorted hashes with counts, to buckets by their first bits;
a bucket adds up what it gets and answers each chunk. An n-gram travels once for each chunk that has it, however often it occurs: there are no hot keys, and nothing is broadcast."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom._ship import by_value
from byteloom.llm.common import drop_tables, table, tables_so_far, whole_number, words

by_value(__name__)

#: The order of ``score`` unless it's told another; the query op3_lm_score has order 3.
ORDER = 2
CHUNK_TOKENS = 1_000_000
#: N-grams of one bucket, about.
BUCKET_TOKENS = 2_000_000
#: Tasks that answer, at most; of more buckets each takes several, one after the other.
TASKS = 65_536
HELD_OUT = 10
ROUNDS, SETTLED = 25, 1e-4
#: Contexts are told apart by floor(log2(1 + count)), for all counts that a 64-bit number can be.
CLASSES = 64
BEGIN, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _pack(a: np.ndarray) -> bytes:
    """Compressed, the bytes of equal weight together."""
    import zstandard

    raw = np.ascontiguousarray(a)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes() if raw.size else b""
    return zstandard.ZstdCompressor(level=1).compress(raw.dtype.char.encode() + planes)


def _unpack(b: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    kind = np.dtype(raw[:1].decode())
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def held_out(doc_id) -> bool:
    import xxhash

    return doc_id is not None and xxhash.xxh3_64_intdigest(str(doc_id), 11) % HELD_OUT == 0


def _chunks(part_tokens: int):
    def run(batches):
        import xxhash
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        at: dict[str, int] = {}
        ids, lens, seq, size = [], [], [], 0

        def row():
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in at], np.uint64)
            cols = [[(part << 32) + k], [ids], [lens], [[held_out(i) for i in ids]], [_pack(hashes)], [_pack(np.concatenate(seq))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["chunk", "ids", "lens", "held", "words", "seq"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = [at.setdefault(w, len(at)) for w in words(text)] if text else []
                ids.append(i)
                lens.append(len(own) + 1)
                own.append(-1)  # the end
                seq.append(np.array(own, np.int32))
                size += len(own)
                if size >= part_tokens:
                    yield row()
                    at, ids, lens, seq, size, k = {}, [], [], [], 0, k + 1
        if ids:
            yield row()

    return run


def ngrams(hashes: np.ndarray, seq: np.ndarray, lens: np.ndarray, order: int) -> list[np.ndarray]:
    """Of each order from 1 a hash for the n-gram that ends at each place; before a document's first word stand ``order`` - 1 begins."""
    word = np.append(hashes, END)[seq]
    starts = np.cumsum(lens) - lens
    out = [word]
    for n in range(2, order + 1):
        back = np.empty_like(word)
        back[n - 1 :] = word[: max(0, len(word) - n + 1)]
        for i in range(n - 1):  # places from which n - 1 back is before the document
            at = starts[lens > i] + i
            back[at] = BEGIN
        with np.errstate(over="ignore"):
            mixed = (out[-1] ^ np.uint64(n)) * _M1
            mixed ^= mixed >> np.uint64(29)
            mixed = (mixed + back) * _M2
            mixed ^= mixed >> np.uint64(32)
        out.append(mixed)
    return out


def _send(order: int, n: int, bits: int):
    """Sends the n-grams of the one order ``n``."""

    def run(batches):
        for b in batches:
            for chunk, lens, held, hashes, seq in zip(*(b.column(k).to_pylist() for k in range(5))):
                lens, hashes, seq = np.array(lens, np.int64), _unpack(hashes), _unpack(seq)
                counted = np.repeat(~np.array(held, bool), lens)
                rows = []
                uniq, inverse = np.unique(ngrams(hashes, seq, lens, n)[-1], return_inverse=True)
                times = np.bincount(inverse[counted], minlength=len(uniq)).astype(np.uint32)
                bucket = (uniq >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                for a, z in zip(cuts, np.r_[cuts[1:], len(uniq)]):
                    rows.append((int(bucket[a]) * order + n - 1, chunk, _pack(np.diff(uniq[a:z], prepend=np.uint64(0))), _pack(times[a:z])))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["bucket", "chunk", "keys", "times"])

    return run


def _answer(batches):
    """For each bucket the sums, to each chunk in the order in which it sent its n-grams; and a row with the bucket's n-grams and their occurrences.

    Takes rows sorted by bucket and chunk, and holds one bucket at a time."""

    def answered(bucket: int, own: list):
        keys = [np.cumsum(_unpack(k), dtype=np.uint64) for _, k, _ in own]
        times = [_unpack(t) for _, _, t in own]
        uniq, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(times), minlength=len(uniq)).astype(np.int64)
        answers = np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])
        chunks = [c for c, _, _ in own] + [None]
        sums = [_pack(a if a.max(initial=0) >= 1 << 32 else a.astype(np.uint32)) for a in answers] + [None]
        nothing = [None] * len(own)
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket] * len(chunks), pa.int64()), pa.array(chunks, pa.int64()), pa.array(sums, pa.binary()), pa.array([*nothing, int((total > 0).sum())], pa.int64()), pa.array([*nothing, int(total.sum())], pa.int64())],
            ["bucket", "chunk", "sums", "types", "tokens"],
        )

    at, held = None, []
    for b in batches:
        for bucket, chunk, keys, times in zip(*(b.column(k).to_pylist() for k in range(4))):
            if bucket != at and held:
                yield answered(at, held)
                held = []
            at = bucket
            held.append((chunk, keys, times))
    if held:
        yield answered(at, held)


def _place(order: int):
    """The total of the n-gram of each order that ends at each place."""

    def run(batches):
        for b in batches:
            out = []
            for lens, hashes, seq, got in zip(*(b.column(k).to_pylist() for k in (2, 4, 5, 6))):
                grams = ngrams(_unpack(hashes), _unpack(seq), np.array(lens, np.int64), order)
                by: dict[int, list] = {n: [] for n in range(order)}
                for x in sorted(got, key=lambda x: x["bucket"]):
                    by[x["bucket"] % order].append(_unpack(x["sums"]).astype(np.int64))
                totals = []
                for n, keys in enumerate(grams):
                    _, inverse = np.unique(keys, return_inverse=True)
                    at = np.concatenate(by[n])[inverse]
                    totals.append(_pack(at if at.max(initial=0) >= 1 << 32 else at.astype(np.uint32)))
                out.append(totals)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(out, pa.list_(pa.binary()))], ["chunk", "ids", "lens", "held", "totals"])

    return run


def estimates(totals: list[np.ndarray], lens: np.ndarray, held: np.ndarray, tokens: int, docs: int, types: int) -> tuple[np.ndarray, np.ndarray]:
    """Each place's context class and (order + 1) estimates, the highest order first and the uniform one last; a counted document's own occurrences are deleted."""
    starts = np.cumsum(lens) - lens
    own = np.repeat(~held, lens).astype(np.int64)
    cols = []
    context = np.maximum(np.full(len(own), tokens, np.int64) - own, 0)
    highest = context
    for n, total in enumerate(totals):
        c = np.maximum(total.astype(np.int64) - own, 0)
        if n:
            context = np.empty_like(c)
            context[1:] = totals[n - 1][:-1]
            context[starts] = docs  # begins alone
            context = np.maximum(context - own, 0)
            highest = context
        cols.append(np.where(context > 0, c / np.maximum(context, 1), 0.0))
    cls = np.minimum(np.log2(1.0 + highest).astype(np.int64), CLASSES - 1) if len(totals) > 1 else np.zeros(len(own), np.int64)
    return cls, np.stack([*cols[::-1], np.full(len(own), 1 / (types + 1))], axis=1)


def _unpacked(row) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    return [_unpack(t) for t in row["totals"]], np.array(row["lens"], np.int64), np.array(row["held"], bool)


def _held_estimates(tokens: int, docs: int, types: int):
    def run(batches):
        for b in batches:
            rows = []
            for row in b.to_pylist():
                totals, lens, held = _unpacked(row)
                pick = np.repeat(held, lens)
                cls, p = estimates([t[pick] for t in totals], lens[held], held[held], tokens, docs, types)
                if len(cls):
                    rows.append((_pack(cls.astype(np.uint8)), [_pack(p[:, k]) for k in range(p.shape[1] - 1)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], ["cls", "p"])

    return run


def expect(cls: np.ndarray, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By class the sum of each estimate's share in the mixture."""
    share = weights[cls] * p
    share /= share.sum(axis=1, keepdims=True)
    return np.stack([np.bincount(cls, weights=share[:, k], minlength=CLASSES) for k in range(p.shape[1])], axis=1)


def maximise(sums: np.ndarray) -> np.ndarray:
    """A class without held-out places takes the weights of the nearest class below that has some, the first such class where none is below; uniform if none has any."""
    k = sums.shape[1]
    n = sums.sum(axis=1)
    have = np.flatnonzero(n > 0)
    if not len(have):
        return np.full(sums.shape, 1 / k)
    near = have[np.maximum(np.searchsorted(have, np.arange(len(n)), "right") - 1, 0)]
    # the uniform estimate keeps a share, so that every word has a probability
    w = np.maximum(sums[near] / n[near, None], [0.0] * (k - 1) + [1e-6])
    return w / w.sum(axis=1, keepdims=True)


def _learn(held: DataFrame, order: int, types: int) -> np.ndarray:
    """Expectation-maximisation over all held-out places: each round is one pass that sums shares by class."""
    weights = np.full((CLASSES, order + 1), 1 / (order + 1))
    for _ in range(ROUNDS):

        def run(batches, weights=weights):
            sums = np.zeros_like(weights)
            for b in batches:
                for row in b.to_pylist():
                    cls = _unpack(row["cls"]).astype(np.int64)
                    p = np.stack([*map(_unpack, row["p"]), np.full(len(cls), 1 / (types + 1))], axis=1)
                    sums += expect(cls, p, weights)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(CLASSES), order + 1)), pa.array(np.tile(np.arange(order + 1), CLASSES)), pa.array(sums.reshape(-1))], ["cls", "k", "s"])

        sums = np.zeros_like(weights)
        for r in held.mapInArrow(run, "cls bigint, k bigint, s double").groupBy("cls", "k").agg(F.sum("s").alias("s")).collect():
            sums[r.cls, r.k] = r.s
        new = maximise(sums)
        done = np.abs(new - weights).max() < SETTLED
        weights = new
        if done:
            break
    return weights


def _scores(weights: np.ndarray, tokens: int, docs: int, types: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                totals, lens, held = _unpacked(row)
                cls, p = estimates(totals, lens, held, tokens, docs, types)
                logs = np.log2((weights[cls] * p).sum(axis=1))
                sums = np.add.reduceat(logs, np.cumsum(lens) - lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(lens - 1), pa.array(sums), pa.array(-sums / lens), pa.array(np.exp2(np.minimum(-sums / lens, 1000.0))), pa.array(held)],
                    ["doc_id", "n_words", "log2_prob", "bits_per_token", "perplexity", "held_out"],
                )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS, order: int | None = None) -> DataFrame:
    """(doc_id, n_words, log2_prob, bits_per_token, perplexity, held_out) of every row, by a model of ``order`` words, ORDER by default.

    Orders are counted one after the other, so that the n-grams of one lie in shuffle files at a time; shuffle files and tables are deleted once what was made of them is written.
    Tokens are words in lower case and an end; null and empty texts are an end alone, which is scored. A document is held out by its id; rows without an id never are.
    Repeated rows are counted and scored each. Of a table without held-out documents the weights are equal; of one without words only the uniform estimate counts.
    Long texts are counted and scored whole. Ids must be integers. Other columns are ignored; an empty table gives an empty one."""
    whole_number(docs, id_col)
    order = order or ORDER
    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    spark = docs.sparkSession
    since = tables_so_far(spark)
    chunks = table(rows.mapInArrow(_chunks(chunk_tokens), "chunk bigint, ids array<bigint>, lens array<int>, held array<boolean>, words binary, seq binary"))
    known = chunks.select(F.expr("aggregate(lens, 0L, (a, x) -> a + x)").alias("n"), F.expr("size(filter(held, x -> not x))").alias("d")).agg(F.sum("n").alias("n"), F.sum("d").alias("d")).first()
    bits = max(4, math.ceil(math.log2(max(1, (known.n or 0) / BUCKET_TOKENS))))
    sums = None
    for n in range(1, order + 1):
        sent = chunks.select("chunk", "lens", "held", "words", "seq").mapInArrow(_send(order, n, bits), "bucket bigint, chunk bigint, keys binary, times binary")
        own = table(sent.repartition(min(1 << bits, TASKS), "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_answer, "bucket bigint, chunk bigint, sums binary, types bigint, tokens bigint"), free=True)
        sums = own if sums is None else sums.unionByName(own)
    whole = sums.where(f"chunk is null and bucket % {order} = 0").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    types, tokens, n_docs = whole.types or 0, whole.tokens or 0, known.d or 0
    answers = sums.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "sums")).alias("got"))
    placed = table(chunks.join(answers, "chunk").select("chunk", "ids", "lens", "held", "words", "seq", "got").mapInArrow(_place(order), "chunk bigint, ids array<bigint>, lens array<int>, held array<boolean>, totals array<binary>"), free=True)
    drop_tables(spark, since, placed)
    held = table(placed.mapInArrow(_held_estimates(tokens, n_docs, types), "cls binary, p array<binary>"))
    weights = _learn(held, order, types)
    drop_tables(spark, since, placed)
    return placed.mapInArrow(_scores(weights, tokens, n_docs, types), "doc_id bigint, n_words bigint, log2_prob double, bits_per_token double, perplexity double, held_out boolean")

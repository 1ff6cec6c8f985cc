"""Near-duplicates by SimHash and BK-trees.

A document's fingerprint has 256 bits: for each bit the majority over its distinct words' hashes. Two documents are near copies if their fingerprints differ in at most
RADIUS bits, or if a chain of such pairs links them.

Fingerprints are spread over shards: so many times (32, or more for very many fingerprints) some of the 256 bits, drawn once, are a shard's key, 16 bits or as many as
leave about MEMBERS unrelated fingerprints in a shard. Each shard has a BK-tree, whose children are keyed by their integer Hamming distance to the parent, and each of its
members is a query that follows only edges within RADIUS of its own distance to the node. Trees of a shard and its queries meet in one task, shard after shard: a tree goes to
the task that has all queries that can enter it, and nothing that grows with the corpus goes to all executors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom._ship import by_value
from byteloom.llm.common import once, table, whole_number, without, words

by_value(__name__)

BITS, RADIUS = 256, 40
#: Keys of a fingerprint and their bits, as long as shards have no more than MEMBERS fingerprints that are drawn at random.
TABLES, KEY_BITS, MEMBERS = 32, 16, 256
#: Rows of a task, about, once there are 200 tasks; fingerprints that are searched at once, but for a shard that has more.
TASK_ROWS, TOGETHER = 4_000_000, 1 << 17
#: Pairs of query and node that are held at once.
CHUNK = 1 << 20


def _word_hash(word: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(word) + xxhash.xxh3_128_digest(word, 1)


def fingerprint(text: str | None, cache: dict | None = None) -> bytes | None:
    """32 bytes; None for a text without words."""
    return fingerprints([text], cache)[0]


def fingerprints(texts: list[str | None], cache: dict | None = None) -> list[bytes | None]:
    cache = {} if cache is None else cache
    out: list[bytes | None] = []
    for text in texts:
        own = set(words(text)) if text else ()
        if not own:
            out.append(None)
            continue
        hashes = []
        for w in own:
            h = cache.get(w)
            if h is None:
                h = cache[w] = _word_hash(w)
            hashes.append(h)
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, BITS // 8), axis=1)
        ones = np.add.reduce(bits, axis=0, dtype=np.int32)
        out.append(np.packbits(2 * ones > len(own)).tobytes())
        if len(cache) > 500_000:
            cache.clear()
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between rows of four uint64."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


class BKForest:
    """The BK-trees of many shards, as arrays: each fingerprint is a node with a parent and its distance to it; a node's children are sorted by that distance.

    ``shard`` must be sorted. Trees grow level by level: all that hang below the same edge compete for it, the first becomes the node, the others descend."""

    def __init__(self, shard: np.ndarray, prints: np.ndarray):
        self.prints = prints
        n = len(prints)
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int32)
        first = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.roots = np.flatnonzero(first)
        self.root_of = self.roots[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        rest = np.flatnonzero(~first)
        at = self.root_of[rest]
        while len(rest):
            d = distance(prints[rest], prints[at])
            key = at * (BITS + 1) + d
            order = np.argsort(key, kind="stable")
            rest, at, d, key = rest[order], at[order], d[order], key[order]
            lead = np.r_[True, key[1:] != key[:-1]]
            self.parent[rest[lead]], self.edge[rest[lead]] = at[lead], d[lead]
            child = rest[lead][np.cumsum(lead) - 1]
            rest, at = rest[~lead], child[~lead]
        kids = np.flatnonzero(self.parent >= 0)
        self.kids = kids[np.lexsort((self.edge[kids], self.parent[kids]))]
        self.keys = self.parent[self.kids] * (BITS + 1) + self.edge[self.kids]

    def within(self, radius: int):
        """Yields arrays of pairs (query, node), query > node, at most ``radius`` apart, for all members of all trees."""
        yield from self._walk(radius, False)

    def links(self, radius: int):
        """Some of the pairs of ``within`` that connect the same members.

        A query at distance d from a node is within ``radius`` of all that hang below an edge up to ``radius`` - d; as it's linked to the node, and so are they, it needn't
        go there. So members of a dense group, thousands of near copies, aren't all compared with each other."""
        yield from self._walk(radius, True)

    def _walk(self, radius: int, spare: bool):
        n = len(self.prints)
        stack = [(np.arange(i, min(n, i + CHUNK)), self.root_of[i : i + CHUNK]) for i in range(0, n, CHUNK)]
        while stack:
            q, node = stack.pop()
            d = distance(self.prints[q], self.prints[node])
            hit = (d <= radius) & (q > node)
            if hit.any():
                yield q[hit], node[hit]
            least = np.maximum(d - radius, 0)
            if spare:
                least = np.maximum(least, np.where(d <= radius, radius - d + 1, 0))
            lo = np.searchsorted(self.keys, node * (BITS + 1) + least, "left")
            hi = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            k = np.maximum(hi - lo, 0)
            go = k > 0
            q, lo, k = q[go], lo[go], k[go]
            end = np.cumsum(k)
            while len(q):
                m = max(1, int(np.searchsorted(end, CHUNK, "right")))
                reps = k[:m]
                if m == 1 and reps[0] > CHUNK:
                    for i in range(0, int(reps[0]), CHUNK):
                        stack.append((np.full(min(CHUNK, reps[0] - i), q[0]), self.kids[lo[0] + i : lo[0] + min(i + CHUNK, reps[0])]))
                else:
                    off = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                    stack.append((np.repeat(q[:m], reps), self.kids[np.repeat(lo[:m], reps) + off]))
                q, lo, k = q[m:], lo[m:], k[m:]
                end = np.cumsum(k)


def components(n: int, pairs) -> np.ndarray:
    """The least member of each member's component."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            hi, lo = np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart])
            np.minimum.at(root, hi, lo)
            while (root[root] != root).any():
                root = root[root]
    return root


def shape(n: int) -> tuple[int, int]:
    """How many keys, of how many bits, ``n`` fingerprints have.

    A bit more in the key halves the unrelated members of a shard, and takes 1 / (1 - RADIUS / BITS) times as many keys for the same chance that two fingerprints at the radius meet.
    So the comparisons of a fingerprint are at most about MEMBERS times its keys, at every size, and its keys grow with n to the power 0.25."""
    bits = max(KEY_BITS, math.ceil(math.log2(max(1, n) / MEMBERS)))
    return math.ceil(TABLES * (1 - RADIUS / BITS) ** (KEY_BITS - bits)), bits


def shard_keys(prints: np.ndarray, tables: int = TABLES, key_bits: int = KEY_BITS) -> np.ndarray:
    """(n, tables) keys of (n, 32) bytes; a table's keys differ from all other tables'."""
    bits = np.unpackbits(prints, axis=1)
    weights = 1 << np.arange(key_bits)
    drawn = (np.random.default_rng(1000 + t).choice(BITS, key_bits, replace=False) for t in range(tables))
    return np.stack([bits[:, own].astype(np.int64) @ weights + (t << key_bits) for t, own in enumerate(drawn)], axis=1)


def _sketch(batches):
    cache: dict = {}
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1).to_pylist(), cache), pa.binary())], ["doc_id", "fp"])


def _spread(tables: int, key_bits: int):
    def run(batches):
        for b in batches:
            node = b.column(0).to_numpy(zero_copy_only=False)
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            keys = shard_keys(raw, tables, key_bits).reshape(-1)
            rows = np.repeat(np.arange(len(node)), tables)
            fp = b.column(1).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node[rows]), fp], ["shard", "node", "fp"])

    return run


def _edges(data: pa.Table, radius: int) -> pa.RecordBatch:
    """Of whole shards, sorted by shard and node: a pair of each member, but the least, and the least member of its component."""
    shard, node = data.column(0).to_numpy(), data.column(1).to_numpy()
    prints = np.frombuffer(b"".join(data.column(2).to_pylist()), np.uint64).reshape(-1, BITS // 64)
    root = components(len(node), BKForest(shard, prints).links(radius))
    far = np.flatnonzero(root != np.arange(len(node)))
    pairs = np.unique(np.stack([node[far], node[root[far]]], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _edges_within(radius: int):
    """Takes rows sorted by shard and node; holds some whole shards at a time."""

    def run(batches):
        held, size, due = [], 0, TOGETHER
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < due:
                continue
            data = pa.Table.from_batches(held)
            shard = data.column(0).to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            if cut:
                yield _edges(data.take(pa.array(np.arange(cut))), radius)
                data = data.take(pa.array(np.arange(cut, size)))
            held, size = data.to_batches(), data.num_rows
            due = max(TOGETHER, 2 * size)
        if size:
            yield _edges(pa.Table.from_batches(held), radius)

    return run


def connect(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component of the edges (a, b), a > b, without the roots themselves.

    Each round every node takes the least label around it and then that label's own label; rounds go on until none changes."""
    both = table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "root": "l"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        best = labels.join(near, "node").select("node", F.least("root", "l").alias("mid"), F.col("root").alias("old"))
        new = table(best.join(labels.select(F.col("node").alias("mid"), F.col("root").alias("far")), "mid", "left").select("node", F.coalesce("far", "mid").alias("root"), "old"))
        changed = not new.where("root <> old").isEmpty()
        labels = new.select("node", "root")
        if not changed:
            return labels.where("node <> root")


def find_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, n_docs, duplicate) of every document; group_id is the least doc_id of its group.

    Words are runs of letters, digits and underscores in lower case. Texts that are null or have no words are near copies of nothing. A row without an id is in no group.
    Rows that repeat a doc_id are one document, whose first fingerprint counts, and have one row here. Other columns are ignored; an empty table gives an empty one.

    Of very long texts all words count. A bit that as many words speak for as against is 0. Ids must be integers.

    Two documents within ``radius`` meet in a shard if they agree in all 16 bits of one of 32 keys, 998 in 1000 for those that differ in a tenth of all bits."""
    whole_number(docs, id_col)
    if radius >= BITS // 2:
        raise ValueError("the radius must be below half the bits")
    marked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t")).where("doc_id is not null").mapInArrow(_sketch, "doc_id bigint, fp binary")
    prints = table(marked.groupBy("doc_id").agg(F.min("fp").alias("fp")))
    nodes = table(prints.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    n = nodes.count()
    tables, key_bits = shape(n)
    parts = max(1, min(200, n * tables // 250_000), n * tables // TASK_ROWS)
    spread = nodes.select("node", "fp").mapInArrow(_spread(tables, key_bits), "shard bigint, node bigint, fp binary").repartition(parts, "shard").sortWithinPartitions("shard", "node")
    edges = table(spread.mapInArrow(_edges_within(radius), "a bigint, b bigint"))
    roots = connect(edges)
    by_print = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("group_id"))
    grouped = prints.join(by_print, "fp", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"))
    grouped = table(grouped)
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("n_docs"))
    return grouped.join(sizes, "group_id").select("doc_id", "group_id", "n_docs", (F.col("doc_id") != F.col("group_id")).alias("duplicate"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group, that of the least id, all columns kept. Rows without an id stay; rows that repeat a kept id with its text are one."""
    found = find_near_copies(docs, id_col, text_col, radius).where("duplicate").select("doc_id")
    kept = without(docs, id_col, table(found))
    return once(kept, id_col, table(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).count().where("count > 1").select("i")), [id_col, text_col])

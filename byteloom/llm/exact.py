"""Exact deduplication with counting quotient filters.

A filter of 64-bit fingerprints keeps a fingerprint's high bits (the quotient) in its slot's place and only the rest (the remainder) in the slot. Remainders of one
quotient are a sorted run; a run starts at its quotient's slot or right behind the run before it. So the slots, read in order, are the sorted fingerprints, and two
filters merge by merging their sorted remainders; nothing is lost. A repeated fingerprint is one remainder, followed by counter slots that hold its count's digits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom._ship import by_value
from byteloom.llm.common import BROADCAST_BYTES, once, sifted, small, table, without

by_value(__name__)

#: A filter is cut into ranges of quotients, of about so many fingerprints of the whole corpus each, which are merged apart from each other.
SEGMENT = 1 << 18
DIGIT = np.uint64(32)


class CountingQuotientFilter:
    """Sorted remainders at their quotients' runs: ``slots`` (remainders and counter digits), the bitmaps ``counter``, ``ends`` (last slot of a run) and ``occupied``.

    ``quotient_bits`` address the slots; the array is as much longer than that as its last runs need."""

    def __init__(self, quotient_bits: int, slots, used, counter, ends, occupied):
        self.quotient_bits, self.slots, self.used, self.counter, self.ends, self.occupied = quotient_bits, slots, used, counter, ends, occupied

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """Of uint64 fingerprints, each ``counts`` times (once, if not given)."""
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, np.int64)
        n = np.add.reduceat(np.ones(len(prints), np.int64) if counts is None else counts[order], first) if len(prints) else np.zeros(0, np.int64)
        return cls._sorted(prints[first], n)

    @classmethod
    def _sorted(cls, prints: np.ndarray, n: np.ndarray) -> CountingQuotientFilter:
        bits = max(1, int(np.ceil(np.log2(max(1, len(prints)) * 4 / 3 + 1))))
        shift = np.uint64(64 - bits)
        digits = np.zeros(len(prints), np.int64)
        rest = np.where(n > 1, n, 0).astype(np.uint64)
        while rest.any():
            digits += rest > 0
            rest >>= DIGIT
        width = 1 + digits
        item = np.repeat(np.arange(len(prints)), width)
        within = np.arange(len(item)) - np.repeat(np.cumsum(width) - width, width)
        q = (prints >> shift).astype(np.int64)
        at = np.maximum.accumulate(q[item] - np.arange(len(item))) + np.arange(len(item)) if len(item) else item
        size = max(1 << bits, int(at[-1]) + 1 if len(at) else 0)
        slots, used, counter, ends, occupied = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool), np.zeros(1 << bits, bool)
        low = prints & ((np.uint64(1) << shift) - np.uint64(1))
        digit = (n[item].astype(np.uint64) >> (DIGIT * np.maximum(within - 1, 0).astype(np.uint64))) & np.uint64((1 << 32) - 1)
        slots[at] = np.where(within == 0, low[item], digit)
        used[at] = True
        counter[at] = within > 0
        if len(item):
            ends[at[np.flatnonzero(np.r_[q[item][1:] != q[item][:-1], True])]] = True
        occupied[q] = True
        return cls(bits, slots, used, counter, ends, occupied)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts, read from the slots alone."""
        at = np.flatnonzero(self.used)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        run = np.cumsum(np.r_[0, self.ends[at][:-1]])
        q = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        value, is_counter = self.slots[at], self.counter[at]
        first = np.flatnonzero(~is_counter)
        prints = (q[first] << np.uint64(64 - self.quotient_bits)) | value[first]
        back = np.arange(len(at)) - np.maximum.accumulate(np.where(is_counter, 0, np.arange(len(at))))
        add = np.where(is_counter, value << (DIGIT * np.maximum(back - 1, 0).astype(np.uint64)), np.uint64(0)).astype(np.int64)
        n = np.add.reduceat(add, first)
        return prints, np.where(n == 0, 1, n)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        (a, m), (b, n) = self.items(), other.items()
        return type(self).of(np.concatenate([a, b]), np.concatenate([m, n]))

    def count(self, prints: np.ndarray) -> np.ndarray:
        have, n = self.items()
        at = np.searchsorted(have, prints)
        ok = (at < len(have)) & (have[np.minimum(at, max(0, len(have) - 1))] == prints) if len(have) else np.zeros(len(prints), bool)
        return np.where(ok, n[np.minimum(at, max(0, len(have) - 1))] if len(have) else 0, 0)

    def to_bytes(self) -> bytes:
        """Used slots only, at the width that the remainders need, with the bitmaps packed."""
        head = np.array([self.quotient_bits, len(self.slots), int(self.used.sum())], np.int64)
        width = max(4, -(-(64 - self.quotient_bits) // 8))
        body = self.slots[self.used].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return b"".join(x.tobytes() for x in (head, body, np.packbits(self.used), np.packbits(self.counter), np.packbits(self.ends), np.packbits(self.occupied)))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, size, n = np.frombuffer(raw, np.int64, 3).tolist()
        width, at = max(4, -(-(64 - bits) // 8)), 24
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        maps = []
        for m in (size, size, size, 1 << bits):
            maps.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-m // 8), at), count=m).astype(bool))
            at += -(-m // 8)
        slots = np.zeros(size, np.uint64)
        slots[maps[0]] = wide.reshape(-1).view("<u8")
        return cls(bits, slots, *maps)


def _segments(bits: int):
    """The partition's filter, cut by the fingerprints' first bits."""

    def run(batches):
        found = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        prints = np.concatenate(found).astype(np.int64).view(np.uint64) if found else np.zeros(0, np.uint64)
        segment = (prints >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        prints, segment = prints[order] << np.uint64(bits), segment[order]
        cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else []
        if len(cuts):
            raw = [CountingQuotientFilter.of(p).to_bytes() for p in np.split(prints, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(segment[cuts], pa.int32()), pa.array(raw, pa.binary())], ["segment", "filter"])

    return run


def _merged(bits: int):
    """Fingerprints that occur more than once, from each segment's filters, merged; takes rows sorted by segment, and holds one segment at a time."""

    def merged(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        runs = [f.items() for f in filters]
        return CountingQuotientFilter.of(np.concatenate([p for p, _ in runs]), np.concatenate([n for _, n in runs]))

    def repeated(s: int, filters: list[CountingQuotientFilter]):
        prints, n = merged(filters).items()
        prints = (prints[n > 1] >> np.uint64(bits)) | (np.uint64(s) << np.uint64(64 - bits))
        return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n[n > 1])], ["fp", "n"])

    def run(batches):
        at, held = None, []
        for b in batches:
            for s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != at and held:
                    yield repeated(at, held)
                    held = []
                at = s
                held.append(CountingQuotientFilter.from_bytes(raw))
                if len(held) >= 64:
                    held = [merged(held)]
        if held:
            yield repeated(at, held)

    return run


def repeated_prints(prints: DataFrame, n: int) -> DataFrame:
    """(fp, n) of the fingerprints that the single bigint column of ``prints``, of about ``n`` rows, has more than once."""
    bits = max(1, math.ceil(math.log2(max(1, n / SEGMENT))))
    filters = prints.mapInArrow(_segments(bits), "segment int, filter binary").repartition(max(4, (1 << bits) // 4), "segment").sortWithinPartitions("segment")
    return filters.mapInArrow(_merged(bits), "fp bigint, n bigint")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", _print=None) -> DataFrame:
    """(doc_id, keep_id, n_copies, duplicate) of every row: rows of the same text, byte by byte, share the least id as keep_id.

    Null texts are no copies of each other: such a row keeps itself. Empty texts are equal. Rows without an id count as copies and are never kept in place of a row
    with one; if a whole group has none, keep_id is null. Repeated rows all appear, with ``duplicate`` false for each that has the kept id. Other columns are ignored.

    Only texts whose fingerprint the filters count more than once are compared, by grouping on the text itself; where texts differ under one fingerprint, each text is
    its own group. Before they move, all others are left out: by a broadcast of the repeated fingerprints if they're few, else by a Bloom filter of them of bounded size. Very long texts
    are compared whole. Ids of equal rank are no tie: the least id is kept, whatever its type. An empty table has no rows. ``_print`` replaces the fingerprint, for tests of collisions."""
    fp = (_print or F.xxhash64)(F.col("t"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).withColumn("fp", F.when(F.col("t").isNotNull(), fp))
    again = table(repeated_prints(rows.where("fp is not null").select("fp"), docs.count())).select("fp")
    n = again.count()
    if n * 16 <= BROADCAST_BYTES:
        maybe = rows.join(F.broadcast(again), "fp")
    else:  # never a broadcast of texts, whose compressed files may look small
        maybe = sifted(rows, F.col("fp"), again, n, True).join(again.hint("merge"), "fp")
    by_text = maybe.groupBy("fp", "t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n_copies"))
    groups = table(by_text.withColumn("h", F.sha2("t", 256)).drop("t"))
    texts = groups.groupBy("fp").agg(F.count("*").alias("k"), F.first("keep_id").alias("keep_id"), F.first("n_copies").alias("n_copies"))
    alone = texts.where("k = 1").select("fp", "keep_id", "n_copies")
    mixed = table(texts.where("k > 1").select("fp"))
    plain, alone, n_mixed = rows.select("doc_id", "fp"), small(alone, n, 48), mixed.count()
    if not n_mixed:
        out = plain.join(alone, "fp", "left")
    else:  # different texts under one fingerprint
        mixed = small(mixed, n_mixed, 16)
        exact = rows.join(mixed, "fp").select("doc_id", "fp", F.sha2("t", 256).alias("h")).join(groups, ["fp", "h"]).select("fp", "doc_id", "keep_id", "n_copies")
        out = plain.join(mixed, "fp", "left_anti").join(alone, "fp", "left").unionByName(exact)
    return out.select("doc_id", F.when(F.col("n_copies").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")).withColumn("duplicate", F.col("n_copies").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each text: that of the least id, all columns kept. Rows with null text or null id stay. Of repeated rows one stays."""
    found = find_copies(docs, id_col, text_col)
    found = table(found.where("n_copies > 1 and doc_id is not null").groupBy("doc_id").agg(F.min("duplicate").alias("gone"), F.count("*").alias("k")))
    kept = without(docs, id_col, found.where("gone").select("doc_id"))
    return once(kept, id_col, found.where("k > 1 and not gone").select("doc_id"), [id_col, text_col])

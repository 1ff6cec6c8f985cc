"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to occur e times, e the source's target over its documents. The whole part is given to all; the fractions are rounded dependently: units
are paired, and mass moves at random from one to the other until one of them is 0 or 1. Each keeps its chance of a further copy, and the sum over a source is off by less than one.
A task rounds the units of its bucket, and leaves one unit that isn't integral; these residuals are combined in the same way up a reduction tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom._ship import by_value
from byteloom.llm.common import free, small, table, whole_number

by_value(__name__)

#: Documents a bucket holds, about, and residuals that one node of the tree combines.
BUCKET, FAN_IN = 4096, 16
TEMPERATURE = 0.8
EPS = 1e-9


def pivotal(p: list[float], draws: list[float]) -> tuple[list[float], int]:
    """Rounds the probabilities to 0 or 1, but for one at most: returns all, and the place of that one or -1. ``draws``: uniform, one for each unit."""
    p = list(p)
    held = -1
    for i, u in enumerate(draws):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        if held < 0:
            held = i
            continue
        a, b = p[held], p[i]
        s = a + b
        if s < 1:
            if u * s < a:
                p[held], p[i] = s, 0.0
            else:
                p[held], p[i] = 0.0, s
        elif u * (2 - s) < 1 - b:
            p[held], p[i] = 1.0, s - 1
        else:
            p[held], p[i] = s - 1, 1.0
        j = i if EPS < p[i] < 1 - EPS else held
        for k in (held, i):
            if k != j or not EPS < p[k] < 1 - EPS:
                p[k] = float(round(p[k]))
        held = j if EPS < p[j] < 1 - EPS else -1
    return p, held


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    if not len(keys[0]):
        return []
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(change)
    return list(zip(at.tolist(), np.r_[at[1:], len(keys[0])].tolist()))


def _round(batches):
    """Rows sorted by source and node within the task, each group whole in it: rounds every group's units."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    data = pa.Table.from_batches(batches)
    s, node, p, u = (data.column(k).to_numpy() for k in ("s", "node", "p", "u"))
    p = p.copy()
    left = np.zeros(len(p), bool)
    for a, b in _runs(s, node):
        p[a:b], held = pivotal(p[a:b].tolist(), u[a:b].tolist())
        if held >= 0:
            left[a + held] = True
    out = data.set_column(data.schema.get_field_index("p"), "p", pa.array(p)).append_column("pending", pa.array(left))
    yield from out.to_batches()


def _rounded(units: DataFrame) -> DataFrame:
    """(unit, i, s, node, p, u, pending); a group's order is that of ``u`` and ``i``, not that in which rows arrive, so that a task run again decides the same."""
    sorted_ = units.repartition("s", "node").sortWithinPartitions("s", "node", "u", "i")
    return sorted_.mapInArrow(_round, "i bigint, s bigint, node bigint, p double, u double, pending boolean")


def _draw(seed: int, *cols):
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str | None, float] | None = None, total: float | None = None, temperature: float = TEMPERATURE, seed: int = 7) -> DataFrame:
    """(doc_id, source, expected, copies) of every document: how many times it's to be in the mixture.

    ``weights``: of each source, in proportion; a source that isn't in it has weight 0. Without them a source of n documents weighs n ** temperature.
    ``total``: documents of the mixture; without it the least at which no source with a weight loses documents.
    A null source is a source of its own. Rows that repeat an id within a source are one unit; rows without an id occur once and count for no source. Ties of the draw
    go by id. Ids must be integers. Texts don't matter. Other columns are ignored; an empty table gives an empty one. Negative weights, or none above 0, raise ValueError."""
    whole_number(docs, id_col)
    spark = docs.sparkSession
    if weights is not None and (min(weights.values(), default=0) < 0 or not sum(weights.values())):
        raise ValueError("weights must not be negative, and one must be above 0")
    units = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(source_col).cast("string").alias("source")).where("i is not null").distinct()
    # a source's key is its hash; null has one too, as its own value
    units = table(units.withColumn("s", F.xxhash64(F.col("source").isNull(), F.col("source"))))
    sizes = units.groupBy("s").agg(F.first("source").alias("source"), F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        sizes = sizes.join(given.select(F.col("source").alias("g"), "w"), F.col("source").eqNullSafe(F.col("g")), "left").select("s", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sizes = table(sizes.select("s", "n", "w"))
    whole = sizes.where("w > 0").agg(F.sum("w").alias("all_w"), F.max(F.col("n") / F.col("w")).alias("r"))
    whole = whole.select("all_w", (F.lit(float(total)) if total is not None else F.col("r") * F.col("all_w")).alias("goal"))
    share = sizes.join(F.broadcast(whole)).select("s", F.coalesce(F.col("goal") * F.col("w") / F.col("all_w") / F.col("n"), F.lit(0.0)).alias("e0"), F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).alias("k"))
    share = share.withColumn("e", F.when(F.abs(F.col("e0") - F.round("e0")) < EPS, F.round("e0")).otherwise(F.col("e0"))).select("s", "e", "k")
    level = units.join(small(share, sizes.count(), 64), "s").select(
        "i", "s", F.pmod(F.xxhash64(F.lit(seed + 1), "i"), F.col("k")).alias("node"), (F.col("e") - F.floor("e")).alias("p"), _draw(seed, F.col("i"), F.col("s")).alias("u"), "k"
    )
    top = sizes.agg(F.max(F.ceil(F.col("n") / BUCKET)).alias("k")).first().k or 1
    first = table(_rounded(level.select("i", "s", "node", "p", "u")))
    decided, rest, depth = [first.where("not pending")], first.where("pending"), 0
    while top > 1:
        depth, top = depth + 1, -(-top // FAN_IN)
        up = rest.select("i", "s", F.floor(F.col("node") / FAN_IN).alias("node"), "p", _draw(seed + 100 + depth, F.col("i"), F.col("s")).alias("u"))
        done = table(_rounded(up))
        decided.append(done.where("not pending"))
        rest = done.where("pending")
    decided.append(rest.withColumn("p", (_draw(seed + 99, F.col("i"), F.col("s")) < F.col("p")).cast("double")))  # the root's last unit
    bits = decided[0].select("i", "s", "p")
    for x in decided[1:]:
        bits = bits.unionByName(x.select("i", "s", "p"))
    out = units.join(bits, ["i", "s"]).join(small(share, sizes.count(), 64), "s")
    return out.select(F.col("i").alias("doc_id"), "source", F.col("e").alias("expected"), (F.floor("e") + F.col("p")).cast("bigint").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with each row as often as ``copies`` has it, all columns kept. Rows without an id occur once."""
    i, s, n, k = (free(x, docs) for x in ("mix_id", "mix_source", "mix_copies", "mix_k"))
    found = copies(docs, id_col, source_col, **how).where("copies <> 1").select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("copies").alias(n))
    found = table(found)
    found = small(found, found.count(), 48)
    joined = docs.join(found, (F.col(id_col).cast("bigint") == F.col(i)) & F.col(source_col).cast("string").eqNullSafe(F.col(s)), "left")
    times = F.coalesce(F.col(n), F.lit(1))
    return joined.where(times > 0).withColumn(k, F.explode(F.sequence(F.lit(1).cast("bigint"), times))).select(*docs.columns)

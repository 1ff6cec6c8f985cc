"""What the corpus operators share: the shared folder, checked broadcasts, tokens, keeping rows by id."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from byteloom._ship import by_value

by_value(__name__)

#: A side is broadcast only while it is known to have no more bytes than this.
BROADCAST_BYTES = 32 << 20
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it's unset, a folder of this session's own, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc = spark.sparkContext
    if not getattr(sc, "_byteloom_dir", None):
        sc._byteloom_dir = tempfile.mkdtemp(prefix="byteloom-")
        atexit.register(shutil.rmtree, sc._byteloom_dir, ignore_errors=True)
    return "file://" + sc._byteloom_dir


#: Spark's setting by which a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, it survives the loss of executors and isn't computed twice.

    With ``free`` its shuffle files are deleted once it is written, else when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/byteloom-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_byteloom_tables", []).append(path)
    before = spark.conf.get(CLEANUP, None)
    try:
        if free:
            spark.conf.set(CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def tables_so_far(spark: SparkSession) -> int:
    return len(spark.sparkContext.__dict__.setdefault("_byteloom_tables", []))


def drop_tables(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes what ``table`` wrote in this session, from the ``since``-th table on; for when no result that was made with it is read any more but ``keep``, itself a table."""
    every = spark.sparkContext.__dict__.setdefault("_byteloom_tables", [])
    spared = [] if keep is None else [p for p in every[since:] if any(p.rpartition("/")[2] in f for f in keep.inputFiles()[:1])]
    paths = [p for p in every[since:] if p not in spared]
    every[since:] = spared
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint for a side of ``rows`` counted rows, where its size permits; else Spark joins by its own choice."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def below(share: float) -> int:
    """What a signed 64-bit hash is at most with probability ``share``; above 0 rows, never a test that no hash can pass."""
    return min((1 << 63) - 1, max(0, int(share * 2.0**64)) - (1 << 63))


def whole_number(df: DataFrame, col: str) -> None:
    """Raises TypeError unless the column holds integers, or nulls alone; ids of another type would fail or become null where they're needed as numbers."""
    kind = df.schema[col].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"the ids in {col!r} must be integers, not {kind.simpleString()}")


def free(name: str, df: DataFrame) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Bits of a Bloom filter for each key, while they fit into BROADCAST_BYTES, and how many of them a key sets.
BLOOM_BITS, BLOOM_HASHES = 12, 4


def bloom(keys: DataFrame, n: int) -> DataFrame | None:
    """One row with a Bloom filter of the ``n`` bigints in the one column of ``keys``, as an array of longs; None where it would be too full to sort anything out.

    It never has more than BROADCAST_BYTES: with more keys it lets more through that isn't in it, and above two bits a key there's none."""
    size = 1 << max(10, math.ceil(math.log2(max(1, n) * BLOOM_BITS)))
    size = min(size, BROADCAST_BYTES * 8)
    if n * 2 > size:
        return None
    longs = size // 64
    slots = F.explode(F.array(*(_slot(F.col("key"), k, size) for k in range(BLOOM_HASHES)))).alias("slot")
    ones = keys.select(F.col(keys.columns[0]).alias("key")).select(slots).groupBy(F.floor(F.col("slot") / 64).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))

    def gather(batches):
        whole = np.zeros(longs, np.int64)
        for b in batches:
            whole[b.column(0).to_numpy()] = b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, longs], pa.int32()), pa.array(whole))], ["bloom"])

    return ones.repartition(1).mapInArrow(gather, "bloom array<bigint>")


def _slot(key, k: int, size: int):
    return F.xxhash64(key, F.lit(101 + k)).bitwiseAND(F.lit(size - 1))


def maybe_in(filter_: DataFrame, name: str, key, n: int):
    """Whether the bigint ``key`` may be among the ``n`` keys of the Bloom filter in the column ``name``; false for null."""
    size = min(1 << max(10, math.ceil(math.log2(max(1, n) * BLOOM_BITS))), BROADCAST_BYTES * 8)
    hit = key.isNotNull()
    for k in range(BLOOM_HASHES):
        slot = _slot(key, k, size)
        word = F.get(F.col(name), F.shiftright(slot, 6).cast("int"))
        hit = hit & (F.expr("1L") == F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)))
    return hit


def sifted(rows: DataFrame, key, keys: DataFrame, n: int, among: bool) -> DataFrame:
    """The rows whose bigint ``key`` may be among the ``n`` distinct bigints of ``keys`` (``among``), or isn't for sure; a null is not among them. No row is moved for it.

    Where ``keys`` are too many for a filter of BROADCAST_BYTES, all rows may be among them."""
    name = free("bloom", rows)
    found = bloom(keys, n)
    if found is None:
        return rows if among else rows.where("false")
    columns = rows.columns
    joined = rows.crossJoin(F.broadcast(found.withColumnRenamed("bloom", name)))
    hit = maybe_in(found, name, key, n)
    return joined.where(hit if among else ~hit).select(*[F.col(f"`{c}`") for c in columns])


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``gone`` (one column of distinct ids, a table that is cheap to count). Rows without an id stay.

    Ids that are few are broadcast. Else a Bloom filter, broadcast, lets all rows stay where they are that it rules out, and only the others are joined."""
    name = free("gone", docs)
    gone = gone.select(F.col(gone.columns[0]).alias(name))
    n = gone.count()
    on = F.col(id_col) == F.col(name)
    if n * 16 <= BROADCAST_BYTES:
        return docs.join(F.broadcast(gone), on, "left_anti")
    key, keys = F.xxhash64(id_col), gone.select(F.xxhash64(name).alias("key"))
    maybe = F.when(F.col(id_col).isNotNull(), key)
    return sifted(docs, maybe, keys, n, False).unionByName(sifted(docs, maybe, keys, n, True).join(gone, on, "left_anti"))


def once(docs: DataFrame, id_col: str, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` with one row for each ``keys`` among the ids in ``repeated``, which holds the few ids that have several rows; other rows aren't moved."""
    n = repeated.count()
    if not n:
        return docs
    name = free("again", docs)
    repeated = small(repeated.select(F.col(repeated.columns[0]).alias(name)), n, 16)
    on = F.col(id_col) == F.col(name)
    return docs.join(repeated, on, "left_anti").unionByName(docs.join(repeated, on, "left_semi").dropDuplicates(keys))

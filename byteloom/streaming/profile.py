"""The column functions keep no state, so they run on streams as they are; these are a stateless and a windowed use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom.functions import hashing, utf8


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, xxh64, code_points, ascii) of each row, batch or stream."""
    return docs.select(id_col, hashing.xxh64(text_col).alias("xxh64"), utf8.count_code_points(text_col).alias("code_points"), utf8.is_ascii(text_col).alias("ascii"))


def windowed_buckets(events: DataFrame, time_col: str = "ts", key_col: str = "user_id", window: str = "1 hour", late: str = "2 hours", buckets: int = 16) -> DataFrame:
    """Events by time window and hash bucket of the key; on a stream late events are waited for as long as ``late``."""
    bucket = F.pmod(hashing.xxh64_long(key_col), F.lit(buckets)).cast("int")
    own = events.withColumn(time_col, F.col(time_col).cast("timestamp"))  # a watermark needs a time zone
    own = own.withWatermark(time_col, late) if events.isStreaming else own
    return own.groupBy(F.window(time_col, window).alias("w"), bucket.alias("bucket")).count().select(F.col("w.start").alias("start"), "bucket", F.col("count").alias("n"))

"""Columns that decode and encode fixed-width little-endian records, and the positions in them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from byteloom.functions import binary as B
from byteloom.functions._arrow import binary, spans
from byteloom.functions.errors import ColumnOrName, col, num, strict
from byteloom.operators.layout import END_OF_STREAM, Layout, from_arrow, to_arrow


def _decoder(layout: Layout):
    """All fields in one pass over the records' bytes."""

    @F.arrow_udf(layout.schema)
    def run(a: pa.Array) -> pa.Array:
        data, off = spans(a.fill_null(b"\0" * layout.width) if a.null_count else a)
        batch = to_arrow(np.frombuffer(data[off[0] : off[-1]].tobytes(), layout.dtype), layout)
        return pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)

    return run


def _encoder(layout: Layout):
    @F.arrow_udf(T.BinaryType())
    def run(a: pa.Array) -> pa.Array:
        raw = np.zeros((len(a), layout.width), np.uint8)
        there = np.asarray(a.is_valid())
        kept = a.filter(a.is_valid()) if a.null_count else a
        raw[there] = from_arrow(pa.RecordBatch.from_arrays(kept.flatten(), [f.name for f in kept.type]), layout).view(np.uint8).reshape(-1, layout.width)
        return binary(raw.reshape(-1), np.arange(len(a) + 1) * layout.width, a)

    return run


class RecordLayout(Layout):
    """A layout that compiles to columns."""

    def decode(self, b: ColumnOrName, offset: Column | int = 0) -> list[Column]:
        """A column for each field of the record at byte ``offset``; a record that isn't whole is an error."""
        b, at = col(b), num(offset)
        whole = strict((at >= 0) & (at.cast("bigint") + self.width <= F.octet_length(b)), B.part(b, at, self.width), END_OF_STREAM)
        record = _decoder(Layout(self.fields))(whole)
        return [F.when(b.isNotNull(), record[f.name]).alias(f.name) for f in self.fields if f.kind != "skip"]

    def encode(self, columns: dict[str, ColumnOrName] | None = None) -> Column:
        """The record of a row's columns, by name or as given. Integers are cut to their width; NULL in any makes NULL; arrays and bytes of another length are an error."""
        own = [col((columns or {}).get(f.name, f.name)) for f in self.fields if f.kind != "skip"]
        there = F.lit(True)
        for f, v in zip((f for f in self.fields if f.kind != "skip"), own):
            if f.kind == "bytes":
                v = strict(F.octet_length(v) == f.count, v, f"{f.name} must have {f.count} bytes")
            elif f.count is not None:
                v = strict(F.size(v) == f.count, v, f"{f.name} must have {f.count} values")
            there = there & v.isNotNull()
        typed = [v.cast(f.type if f.kind in ("bytes", "boolean", "float", "double") or f.count is not None else "bigint").alias(f.name) for f, v in zip((f for f in self.fields if f.kind != "skip"), own)]
        return F.when(there, _encoder(Layout(self.fields))(F.when(there, F.struct(*typed))))


def explode_records(df: DataFrame, b: str, layout: RecordLayout, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each record of each binary value, with its number; bytes that make no whole record at the end are an error. Empty values have no records."""
    n = F.octet_length(b)
    count = strict(n % layout.width == 0, (n / layout.width).cast("int"), END_OF_STREAM)
    own = df.select(*keep, F.col(b), count.alias("records__")).where("records__ > 0")
    rows = own.select(*keep, F.col(b), F.explode(F.sequence(F.lit(0), F.col("records__") - 1)).alias("record"))
    one = rows.select(*keep, "record", B.part(F.col(b), F.col("record") * layout.width, layout.width).alias("bytes__"))
    return one.select(*keep, "record", *layout.decode("bytes__"))


def write_bounded(parts: Sequence[ColumnOrName], capacity: int | Column) -> Column:
    """The parts one after the other, if they fit into the capacity; else an error."""
    out = F.concat(*map(col, parts))
    return strict(F.octet_length(out) <= num(capacity), out, "index out of bounds")


def rewind(b: ColumnOrName, position: Column | int = 0) -> Column:
    """What was written before the position; a position beyond the end is an error."""
    b, p = col(b), num(position)
    return strict((p >= 0) & (p <= F.octet_length(b)), B.part(b, 0, p), "index out of bounds")


def skip(b: ColumnOrName, position: Column | int, n: Column | int) -> Column:
    """The position after skipping ``n`` bytes, at most to the end; negative ``n`` skips none."""
    p = num(position)
    return F.least(p + F.greatest(num(n), F.lit(0)), F.octet_length(col(b)))


def remaining(b: ColumnOrName, position: Column | int) -> Column:
    return F.octet_length(col(b)) - num(position)


def read(b: ColumnOrName, position: Column | int) -> Column:
    """The unsigned byte at the position, -1 at the end."""
    b, p = col(b), num(position)
    return strict((p >= 0) & (p <= F.octet_length(b)), F.when(p < F.octet_length(b), B.byte_at(b, p)).otherwise(-1), "index out of bounds")


def read_up_to(b: ColumnOrName, position: Column | int, n: Column | int) -> Column:
    """At most ``n`` bytes from the position on, as many as there are."""
    return B.part(col(b), num(position), num(n))

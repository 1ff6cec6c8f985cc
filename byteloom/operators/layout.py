"""Layouts of fixed-width little-endian records: an ordered list of fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from byteloom._ship import by_value

by_value(__name__)

END_OF_STREAM = "End of stream"
#: Bytes, type and numpy code of each primitive.
PRIMITIVES: dict[str, tuple[int, T.DataType, str]] = {
    "boolean": (1, T.BooleanType(), "?"), "byte": (1, T.ByteType(), "i1"), "unsigned_byte": (1, T.ShortType(), "u1"), "short": (2, T.ShortType(), "<i2"), "unsigned_short": (2, T.IntegerType(), "<u2"),
    "int": (4, T.IntegerType(), "<i4"), "unsigned_int": (4, T.LongType(), "<u4"), "long": (8, T.LongType(), "<i8"), "float": (4, T.FloatType(), "<f4"), "double": (8, T.DoubleType(), "<f8"),
}
BULK = {"short": "shorts", "int": "ints", "long": "longs", "float": "floats", "double": "doubles"}


@dataclass(frozen=True)
class Field:
    """``count`` None: one value; else an array of so many, for shorts, ints, longs, floats and doubles. ``bytes`` is a binary of ``count`` bytes, ``skip`` is left out."""

    name: str
    kind: str
    count: int | None = None

    @property
    def width(self) -> int:
        return (self.count or 0) if self.kind in ("bytes", "skip") else PRIMITIVES[self.kind][0] * (1 if self.count is None else self.count)

    @property
    def type(self) -> T.DataType:
        if self.kind == "bytes":
            return T.BinaryType()
        own = PRIMITIVES[self.kind][1]
        return own if self.count is None else T.ArrayType(own)


class Layout:
    def __init__(self, fields: Sequence[Field | tuple]):
        self.fields = [f if isinstance(f, Field) else Field(*f) for f in fields]
        for f in self.fields:
            if f.kind not in (*PRIMITIVES, "bytes", "skip") or (f.kind in ("bytes", "skip") and f.count is None) or (f.count is not None and f.kind in PRIMITIVES and f.kind not in BULK) or (f.count or 0) < 0:
                raise ValueError(f"no such field: {f}")
        self.width = sum(f.width for f in self.fields)
        if not self.width:
            raise ValueError("a record must have bytes")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type) for f in self.fields if f.kind != "skip"])

    @property
    def dtype(self) -> np.dtype:
        """Of numpy, for whole files of records."""
        own = [(f.name or f"skip{k}", f"V{f.count}" if f.kind in ("bytes", "skip") else (PRIMITIVES[f.kind][2] if f.count is None else (PRIMITIVES[f.kind][2], (f.count,)))) for k, f in enumerate(self.fields)]
        return np.dtype(own)

    def __str__(self) -> str:
        return ",".join(f"{f.name}:{f.kind}" + (f":{f.count}" if f.count is not None else "") for f in self.fields)

    @classmethod
    def parse(cls, text: str) -> Layout:
        """``name:kind[:count],...``"""
        return cls([Field(p[0], p[1], int(p[2]) if len(p) > 2 else None) for p in (x.strip().split(":") for x in text.split(","))])


def to_arrow(records: np.ndarray, layout: Layout) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    arrays, names = [], []
    for f, name in zip(layout.fields, records.dtype.names):
        if f.kind == "skip":
            continue
        own = np.ascontiguousarray(records[name])
        if f.kind == "bytes":
            arrays.append(pa.array([x.tobytes() for x in own], pa.binary()))
        elif f.count is not None:
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(records) + 1, dtype=np.int32) * f.count), pa.array(own.reshape(-1), to_arrow_type(f.type.elementType))))
        else:
            own = own.view(np.uint8) != 0 if f.kind == "boolean" else own
            arrays.append(pa.array(own).cast(to_arrow_type(f.type)))
        names.append(f.name)
    return pa.RecordBatch.from_arrays(arrays, names)


def from_arrow(batch: pa.RecordBatch, layout: Layout) -> np.ndarray:
    out = np.zeros(batch.num_rows, layout.dtype)
    for f, name in zip(layout.fields, out.dtype.names):
        if f.kind == "skip":
            continue
        own = batch.column(batch.schema.get_field_index(f.name))
        if own.null_count:
            raise ValueError(f"{f.name} is NULL, which a record can't hold")
        if f.kind == "bytes":
            values = own.to_pylist()
            if any(len(v) != f.count for v in values):
                raise ValueError(f"{f.name} must have {f.count} bytes")
            out[name] = np.frombuffer(b"".join(values), f"V{f.count}")
        elif f.count is not None:
            if any(n != f.count for n in own.value_lengths().to_pylist()) or own.flatten().null_count:
                raise ValueError(f"{f.name} must have {f.count} values")
            out[name] = np.asarray(own.flatten()).reshape(-1, f.count)
        else:
            values = np.asarray(own.to_numpy(zero_copy_only=False))
            with np.errstate(over="ignore"):
                out[name] = values.astype(np.int64).astype(out.dtype[name]) if f.kind not in ("boolean", "float", "double") else values
    return out

"""Estimates of the heap that values take in a JVM of 64 bits with compressed references and objects aligned to 8 bytes.

The layout is fixed here, so that estimates don't depend on where they are made. A null takes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from byteloom.functions.errors import ColumnOrName, col, num

ARRAY_HEADER, OBJECT_HEADER, REFERENCE, ALIGNMENT = 16, 12, 4, 8
WIDTHS = {"boolean": 1, "byte": 1, "short": 2, "char": 2, "int": 4, "long": 8, "float": 4, "double": 8, "reference": REFERENCE}


def aligned(n: int) -> int:
    return -(-n // ALIGNMENT) * ALIGNMENT


BOXED = {k: aligned(-(-OBJECT_HEADER // w) * w + w) for k, w in WIDTHS.items() if k != "reference"}
STRING, ENTRY, OPTIONAL = aligned(OBJECT_HEADER + 4 + 4 + 1 + 1), aligned(OBJECT_HEADER + 2 * REFERENCE), aligned(OBJECT_HEADER + REFERENCE)
OPTIONALS = {"int": aligned(OBJECT_HEADER + 1 + 4), "long": 24, "double": 24}


def size_of_array(n: Column | int, kind: str) -> Column:
    """Of an array of ``n`` elements of a kind in WIDTHS."""
    raw = num(n).cast("bigint") * WIDTHS[kind] + ARRAY_HEADER
    return (raw + (ALIGNMENT - 1)).bitwiseAND(F.lit(-ALIGNMENT))


def size_of(value: ColumnOrName, kind: str) -> Column:
    """Of an array column's values of the kind; binary counts as an array of bytes."""
    v = col(value)
    n = F.octet_length(v) if kind == "binary" else F.size(v)
    return F.when(v.isNull(), F.lit(0)).otherwise(size_of_array(n, "byte" if kind == "binary" else kind)).cast("bigint")


def size_of_boxed(value: ColumnOrName, kind: str) -> Column:
    return F.when(col(value).isNull(), 0).otherwise(BOXED[kind]).cast("bigint")


def size_of_optional(value: ColumnOrName, kind_or_size: str | Callable[[Column], Column]) -> Column:
    """Of an optional int, long or double; or of an optional object with the size that a function gives. An absent value is null and takes nothing."""
    v = col(value)
    held = F.lit(OPTIONALS[kind_or_size]) if isinstance(kind_or_size, str) else kind_or_size(v) + OPTIONAL
    return F.when(v.isNull(), 0).otherwise(held).cast("bigint")


def estimated_size_of_string(s: ColumnOrName) -> Column:
    """Two bytes for each UTF-16 unit."""
    s = col(s)
    return F.when(s.isNull(), 0).otherwise(F.octet_length(F.encode(s, "UTF-16BE")) + STRING).cast("bigint")


def estimated_size_of_list(values: ColumnOrName, value_size: Callable[[Column], Column]) -> Column:
    v = col(values)
    return F.when(v.isNull(), 0).otherwise(F.aggregate(v, size_of_array(F.size(v), "reference"), lambda acc, x: acc + value_size(x).cast("bigint"))).cast("bigint")


estimated_size_of_queue = estimated_size_of_list


def estimated_size_of_set(values: ColumnOrName, value_size: Callable[[Column], Column]) -> Column:
    return estimated_size_of_list(values, lambda x: value_size(x) + ENTRY)


def estimated_size_of_map(m: ColumnOrName, key_size: Callable[[Column], Column] | int, value_size: Callable[[Column], Column] | int) -> Column:
    m = col(m)
    k, v = (f if callable(f) else (lambda _, f=f: F.lit(f)) for f in (key_size, value_size))
    return F.when(m.isNull(), 0).otherwise(F.aggregate(F.map_entries(m), size_of_array(F.size(m), "reference"), lambda acc, e: acc + (k(e["key"]) + v(e["value"]) + ENTRY).cast("bigint"))).cast("bigint")

"""Zero-copy steps between Arrow binary arrays and numpy, shared by the Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from byteloom._ship import by_value

by_value(__name__)


def spans(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string array, and the int64 offsets of its values in them; nulls are empty."""
    if a.null_count:
        a = a.fill_null(b"" if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type) else "")
    kind = np.int64 if pa.types.is_large_binary(a.type) or pa.types.is_large_string(a.type) else np.int32
    off = np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data, off


def masked(values: np.ndarray, like: pa.Array, kind: pa.DataType) -> pa.Array:
    """``values`` with NULL where ``like`` has it."""
    return pa.array(values, kind, mask=np.asarray(like.is_null()) if like.null_count else None)


def binary(data: np.ndarray, off: np.ndarray, like: pa.Array) -> pa.Array:
    """A binary array of contiguous ``data``."""
    valid = None
    if like.null_count:
        valid = pa.array(np.asarray(like.is_valid())).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [valid, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))], like.null_count)


def longest_first(size: np.ndarray):
    """Yields (step, rows) for steps 0, 1, ...: the rows whose ``size`` is above the step."""
    order = np.argsort(-size, kind="stable")
    ordered = -size[order]
    for k in range(int(size.max(initial=0))):
        yield k, order[: np.searchsorted(ordered, -k, "left")]

"""Seedable non-cryptographic hashes: XXH64, Murmur3 of 32 and 128 bits, SpookyHash V2, FNV.

XXH64 and Murmur3 of 32 bits are built-in expressions that stay in generated code: the built-ins start from seed 42, but chain columns, each value's hash being the next one's
seed, and each step can be inverted. So a literal goes first whose hash is the wanted seed. The others are Arrow functions in numpy, whose 64-bit products wrap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from byteloom._ship import by_value
from byteloom.functions._arrow import binary, longest_first, masked, spans
from byteloom.functions.binary import byte_at, chars, part, unchars
from byteloom.functions.errors import OUT_OF_BOUNDS, ColumnOrName, col, num, strict, within

by_value(__name__)

M64, M32 = (1 << 64) - 1, (1 << 32) - 1
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _rotl(x: int, r: int, bits: int) -> int:
    r %= bits
    return ((x << r) | (x >> (bits - r))) & ((1 << bits) - 1)


def _unshift(x: int, r: int, bits: int) -> int:
    """Inverse of x ^ (x >> r)."""
    out = x
    for _ in range(bits // r):
        out = x ^ (out >> r)
    return out


def _signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


def xxh64_seed_literal(seed: int) -> int:
    """The bigint whose built-in hash, from seed 42, is ``seed``."""
    h = _unshift(seed & M64, 32, 64) * pow(_P3, -1, 1 << 64) & M64
    h = _unshift(h, 29, 64) * pow(_P2, -1, 1 << 64) & M64
    h = _unshift(h, 33, 64)
    h = _rotl((h - _P4) * pow(_P1, -1, 1 << 64) & M64, 64 - 27, 64) ^ ((42 + _P5 + 8) & M64)
    k = _rotl(h * pow(_P1, -1, 1 << 64) & M64, 64 - 31, 64) * pow(_P2, -1, 1 << 64) & M64
    return _signed(k, 64)


_C1, _C2 = 0xCC9E2D51, 0x1B873593
_F1, _F2 = 0x85EBCA6B, 0xC2B2AE35


def _unfmix32(h: int) -> int:
    h = _unshift(h, 16, 32) * pow(_F2, -1, 1 << 32) & M32
    h = _unshift(h, 13, 32) * pow(_F1, -1, 1 << 32) & M32
    return _unshift(h, 16, 32)


def murmur3_seed_literal(seed: int) -> int:
    """The int whose built-in hash, from seed 42, is ``seed``."""
    h = _unfmix32(seed & M32) ^ 4
    h = _rotl((h - 0xE6546B64) * pow(5, -1, 1 << 32) & M32, 32 - 13, 32) ^ 42
    k = _rotl(h * pow(_C2, -1, 1 << 32) & M32, 32 - 15, 32) * pow(_C1, -1, 1 << 32) & M32
    return _signed(k, 32)


def xxh64(value: ColumnOrName, seed: int = 0) -> Column:
    """XXH64 of a binary or string's bytes."""
    v = col(value)
    return F.when(v.isNotNull(), F.xxhash64(F.lit(xxh64_seed_literal(seed)).cast("bigint"), v))


def xxh64_long(value: ColumnOrName, seed: int = 0) -> Column:
    """XXH64 of a bigint's 8 little-endian bytes."""
    return xxh64(col(value).cast("bigint"), seed)


def xxh64_range(b: ColumnOrName, i: Column | int, n: Column | int, seed: int = 0) -> Column:
    b, i, n = col(b), num(i), num(n)
    return strict(within(i, n, F.octet_length(b)), xxh64(part(b, i, n), seed), OUT_OF_BOUNDS)


def ordered_concat(order: ColumnOrName, chunk: ColumnOrName) -> Column:
    """An aggregate: the binary chunks of a group one after the other."""
    own = F.array_sort(F.collect_list(F.struct(col(order).alias("o"), col(chunk).alias("c"))))
    return unchars(F.array_join(F.transform(own, lambda x: chars(x["c"])), ""))


def xxh64_chunks(order: ColumnOrName, chunk: ColumnOrName, seed: int = 0) -> Column:
    """An aggregate: XXH64 of a group's chunks in order, as if they were one value; of no chunks that of no bytes."""
    return xxh64(ordered_concat(order, chunk), seed)


def hash_code(b: ColumnOrName) -> Column:
    """The low 32 bits of XXH64 with seed 0."""
    return F.shiftright(F.shiftleft(xxh64(b), 32), 32).cast("int")


def hash_code_range(b: ColumnOrName, i: Column | int, n: Column | int) -> Column:
    return F.shiftright(F.shiftleft(xxh64_range(b, i, n), 32), 32).cast("int")


def _mul32(x: Column, k: int) -> Column:
    """Low 32 bits of a product; in halves, so that nothing overflows."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    return (low * F.lit(k) + F.shiftleft((high * F.lit(k)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(M32))


def _rot32(x: Column, r: int) -> Column:
    return F.shiftleft(x, r).bitwiseOR(F.shiftright(x, 32 - r)).bitwiseAND(F.lit(M32))


def _down(x: Column, r: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, r))


def _int32(x: Column) -> Column:
    return F.shiftright(F.shiftleft(x, 32), 32).cast("int")


def murmur3_32(value: ColumnOrName, seed: int = 0) -> Column:
    """Murmur3 for x86 of 32 bits, of a binary or string's bytes.

    The built-in hashes the whole words; its last mixing is undone, the up to 3 bytes of the tail are mixed in as the standard has it, and the last mixing done again."""
    b = col(value).cast("binary")
    n = F.octet_length(b)
    whole = n - n % 4
    start = F.hash(F.lit(murmur3_seed_literal(seed)), part(b, 0, whole))
    at = lambda k: F.when(whole + k < n, F.shiftleft(byte_at(b, whole + k).cast("bigint"), 8 * k)).otherwise(F.lit(0).cast("bigint"))
    # one-element arrays bind what is used more than once
    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    h = bind(start.cast("bigint").bitwiseAND(F.lit(M32)), lambda x: _mul32(_down(x, 16), pow(_F2, -1, 1 << 32)))
    h = bind(h, lambda x: _mul32(x.bitwiseXOR(F.shiftright(x, 13)).bitwiseXOR(F.shiftright(x, 26)), pow(_F1, -1, 1 << 32)))
    h = bind(h, lambda x: _down(x, 16)).bitwiseXOR(whole.cast("bigint"))
    k = bind(at(0).bitwiseOR(at(1)).bitwiseOR(at(2)), lambda x: _mul32(x, _C1))
    h = h.bitwiseXOR(bind(bind(k, lambda x: _rot32(x, 15)), lambda x: _mul32(x, _C2))).bitwiseXOR(n.cast("bigint"))
    h = bind(h, lambda x: _mul32(_down(x, 16), _F1))
    h = bind(h, lambda x: _mul32(_down(x, 13), _F2))
    return F.when(n % 4 == 0, start).when(n.isNotNull(), _int32(bind(h, lambda x: _down(x, 16))))


def murmur3_32_range(b: ColumnOrName, i: Column | int, n: Column | int, seed: int = 0) -> Column:
    b, i, n = col(b), num(i), num(n)
    return strict(within(i, n, F.octet_length(b)), murmur3_32(part(b, i, n), seed), OUT_OF_BOUNDS)


def murmur3_32_int(value: ColumnOrName, seed: int = 0) -> Column:
    """Of an int's 4 little-endian bytes."""
    v = col(value).cast("int")
    return F.when(v.isNotNull(), F.hash(F.lit(murmur3_seed_literal(seed)), v))


def murmur3_32_long(value: ColumnOrName, seed: int = 0) -> Column:
    """Of a bigint's 8 little-endian bytes."""
    v = col(value).cast("bigint")
    return F.when(v.isNotNull(), F.hash(F.lit(murmur3_seed_literal(seed)), v))


U = np.uint64


def _r64(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _words(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """``n`` little-endian words from each place on."""
    own = data[at[:, None] + np.arange(8 * n)]
    return list(np.ascontiguousarray(own).view("<u8").T.copy()) if len(at) else [np.zeros(0, U)] * n


def _tails(data: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The ``size`` < width last bytes from each place on, padded by zeros to width."""
    out = np.zeros((len(at), width), np.uint8)
    cols = np.arange(width)
    keep = cols[None] < size[:, None]
    out[keep] = data[(at[:, None] + cols)[keep]]
    return out


_K1, _K2 = U(0x87C37B91114253D5), U(0x4CF5AD432745937F)


def _fmix64(k: np.ndarray) -> np.ndarray:
    k = (k ^ (k >> U(33))) * U(0xFF51AFD7ED558CCD)
    k = (k ^ (k >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return k ^ (k >> U(33))


def murmur3_128_numpy(data: np.ndarray, off: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves for values that are spans of ``data``; longer values take more steps, each for all that have them."""
    size = np.diff(off)
    h1, h2 = np.full(len(size), seed & M64, U), np.full(len(size), seed & M64, U)
    with np.errstate(over="ignore"):
        for step, rows in longest_first(size // 16):
            k1, k2 = _words(data, off[rows] + 16 * step, 2)
            a = h1[rows] ^ (_r64(k1 * _K1, 31) * _K2)
            a = (_r64(a, 27) + h2[rows]) * U(5) + U(0x52DCE729)
            b = h2[rows] ^ (_r64(k2 * _K2, 33) * _K1)
            h2[rows] = (_r64(b, 31) + a) * U(5) + U(0x38495AB5)
            h1[rows] = a
        tail = _tails(data, off[:-1] + size // 16 * 16, size % 16, 16).view("<u8")
        h2 ^= _r64(tail[:, 1] * _K2, 33) * _K1
        h1 ^= _r64(tail[:, 0] * _K1, 31) * _K2
        h1, h2 = h1 ^ size.astype(U), h2 ^ size.astype(U)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _fmix64(h1), _fmix64(h2)
        h1 = h1 + h2
        return h1, h2 + h1


def _spooky_mix(h: list[np.ndarray]) -> None:
    for k, r in enumerate((50, 52, 30, 41, 54, 48, 38, 37, 62, 34, 5, 36)):
        a, b, c = (k + 2) % 4, (k + 3) % 4, k % 4
        h[a] = _r64(h[a], r) + h[b]
        h[c] = h[c] ^ h[a]


def _spooky_end(h: list[np.ndarray]) -> None:
    for k, r in enumerate((15, 52, 26, 51, 28, 9, 47, 54, 32, 25, 63)):
        a, b = (k + 3) % 4, (k + 2) % 4
        h[a] = h[a] ^ h[b]
        h[b] = _r64(h[b], r)
        h[a] = h[a] + h[b]


_LONG_MIX = (11, 32, 43, 31, 17, 28, 39, 57, 55, 54, 22, 46)
_LONG_END = (44, 15, 34, 21, 38, 33, 10, 13, 38, 53, 42, 54)
_MAGIC = U(0xDEADBEEFDEADBEEF)


def _spooky_short(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    h = [np.full(len(size), x, U) for x in (seed & M64, seed & M64, int(_MAGIC), int(_MAGIC))]
    for step, rows in longest_first(size // 32):
        w = _words(data, start[rows] + 32 * step, 4)
        own = [x[rows] for x in h]
        own[2], own[3] = own[2] + w[0], own[3] + w[1]
        _spooky_mix(own)
        own[0], own[1] = own[0] + w[2], own[1] + w[3]
        for k in range(4):
            h[k][rows] = own[k]
    at, rest = start + size // 32 * 32, size % 32
    rows = np.flatnonzero(rest >= 16)
    if len(rows):
        w = _words(data, at[rows], 2)
        own = [x[rows] for x in h]
        own[2], own[3] = own[2] + w[0], own[3] + w[1]
        _spooky_mix(own)
        for k in range(4):
            h[k][rows] = own[k]
        at, rest = at + 16 * (rest >= 16), rest % 16
    tail = _tails(data, at, rest, 16).view("<u8")
    h[3] = h[3] + (size.astype(U) << U(56)) + np.where(rest == 0, _MAGIC, tail[:, 1])
    h[2] = h[2] + np.where(rest == 0, _MAGIC, tail[:, 0])
    _spooky_end(h)
    return h[0]


def _spooky_long(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    h = [np.full(len(size), int(_MAGIC) if k % 3 == 2 else seed & M64, U) for k in range(12)]
    for step, rows in longest_first(size // 96):
        w = _words(data, start[rows] + 96 * step, 12)
        own = [x[rows] for x in h]
        for k, r in enumerate(_LONG_MIX):
            own[k] = own[k] + w[k]
            own[(k + 2) % 12] = own[(k + 2) % 12] ^ own[(k + 10) % 12]
            own[(k + 11) % 12] = own[(k + 11) % 12] ^ own[k]
            own[k] = _r64(own[k], r)
            own[(k + 11) % 12] = own[(k + 11) % 12] + own[(k + 1) % 12]
        for k in range(12):
            h[k][rows] = own[k]
    tail = _tails(data, start + size // 96 * 96, size % 96, 96)
    tail[:, 95] = size % 96
    w = tail.view("<u8")
    h = [x + w[:, k] for k, x in enumerate(h)]
    for _ in range(3):
        for k, r in enumerate(_LONG_END):
            h[(k + 11) % 12] = h[(k + 11) % 12] + h[(k + 1) % 12]
            h[(k + 2) % 12] = h[(k + 2) % 12] ^ h[(k + 11) % 12]
            h[(k + 1) % 12] = _r64(h[(k + 1) % 12], r)
    return h[0]


def spooky_numpy(data: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    size, out = np.diff(off), np.zeros(len(off) - 1, U)
    with np.errstate(over="ignore"):
        for rows, f in ((np.flatnonzero(size < 192), _spooky_short), (np.flatnonzero(size >= 192), _spooky_long)):
            if len(rows):
                out[rows] = f(data, off[:-1][rows], size[rows], seed)
    return out


#: The last, longest values are hashed one by one when fewer are left.
FEW = 40


def fnv_numpy(data: np.ndarray, off: np.ndarray, bits: int) -> np.ndarray:
    """Each byte is sign-extended before it is mixed in, so values differ from the textbook's for bytes above 127."""
    kind, basis, prime = (np.uint32, 0x811C9DC5, 0x01000193) if bits == 32 else (U, 0xCBF29CE484222325, 0x100000001B3)
    mask = (1 << bits) - 1
    h = np.full(len(off) - 1, basis, kind)
    wide = data.view(np.int8).astype(np.int32 if bits == 32 else np.int64).view(kind)
    with np.errstate(over="ignore"):
        for step, rows in longest_first(np.diff(off)):
            if len(rows) < FEW:
                for i in rows.tolist():
                    x = int(h[i])
                    for v in wide[off[i] + step : off[i + 1]].tolist():
                        x = (x ^ v) * prime & mask
                    h[i] = x
                break
            h[rows] = (h[rows] ^ wide[off[rows] + step]) * kind(prime)
    return h


def _arrow_hash(value: ColumnOrName, out: T.DataType, kernel) -> Column:
    @F.arrow_udf(out)
    def run(a: pa.Array) -> pa.Array:
        data, off = spans(a)
        return kernel(data, off, a)

    return run(col(value).cast("binary"))


def murmur3_128(value: ColumnOrName, seed: int = 0) -> Column:
    """Murmur3 for x64 of 128 bits, both halves little-endian, 16 bytes."""

    def kernel(data, off, a):
        both = np.stack(murmur3_128_numpy(data, off, seed), axis=1).astype("<u8")
        return binary(both.view(np.uint8).reshape(-1), np.arange(len(both) + 1) * 16, a)

    return _arrow_hash(value, T.BinaryType(), kernel)


def murmur3_hash64(value: ColumnOrName, seed: int = 0) -> Column:
    """The first half of ``murmur3_128``."""
    return _arrow_hash(value, T.LongType(), lambda data, off, a: masked(murmur3_128_numpy(data, off, seed)[0].view(np.int64), a, pa.int64()))


def murmur3_hash64_long(value: ColumnOrName, seed: int = 0) -> Column:
    """``murmur3_hash64`` of a bigint's 8 little-endian bytes."""

    @F.arrow_udf(T.LongType())
    def run(a: pa.Array) -> pa.Array:
        x = np.asarray(a.fill_null(0)).astype("<i8")
        return masked(murmur3_128_numpy(x.view(np.uint8), np.arange(len(x) + 1, dtype=np.int64) * 8, seed)[0].view(np.int64), a, pa.int64())

    return run(col(value).cast("bigint"))


def spooky_hash64(value: ColumnOrName, seed: int = 0) -> Column:
    """SpookyHash V2, 64 bits."""
    return _arrow_hash(value, T.LongType(), lambda data, off, a: masked(spooky_numpy(data, off, seed).view(np.int64), a, pa.int64()))


def spooky_hash32(value: ColumnOrName, seed: int = 0) -> Column:
    """The low 32 bits of ``spooky_hash64``."""
    return _arrow_hash(value, T.IntegerType(), lambda data, off, a: masked(spooky_numpy(data, off, seed).astype(np.uint32).view(np.int32), a, pa.int32()))


def fnv_hash32(value: ColumnOrName) -> Column:
    return _arrow_hash(value, T.IntegerType(), lambda data, off, a: masked(fnv_numpy(data, off, 32).view(np.int32), a, pa.int32()))


def fnv_hash64(value: ColumnOrName) -> Column:
    return _arrow_hash(value, T.LongType(), lambda data, off, a: masked(fnv_numpy(data, off, 64).view(np.int64), a, pa.int64()))

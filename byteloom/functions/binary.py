"""Functions over binary values: little-endian access, copies, searches, comparison.

Positions count bytes from 0. Binary values are never cast to strings; where a string function is of use, bytes are mapped one to one to the first 256 code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from byteloom._ship import by_value
from byteloom.functions._arrow import binary as _binary
from byteloom.functions._arrow import masked, spans
from byteloom.functions.errors import OUT_OF_BOUNDS, ColumnOrName, both, check_size, col, num, strict, within

by_value(__name__)

LATIN1 = "ISO-8859-1"


def chars(b: ColumnOrName) -> Column:
    """One character for each byte."""
    return F.decode(col(b), LATIN1)


def unchars(s: Column) -> Column:
    return F.encode(s, LATIN1)


def length(b: ColumnOrName) -> Column:
    return F.octet_length(col(b))


def part(b: Column, i: Column | int, n: Column | int) -> Column:
    """Bytes i..i+n-1, unchecked."""
    return F.substring(b, num(i).cast("int") + 1, num(n).cast("int"))


def byte_at(b: Column, i: Column | int) -> Column:
    """The unsigned byte at a place that exists."""
    return F.ascii(chars(part(b, i, 1)))


def little_endian(b: Column, i: Column | int, width: int) -> Column:
    """Little-endian bits as bigint, unchecked; unsigned, but for a width of 8."""
    if width == 1:
        return byte_at(b, i).cast("bigint")
    return F.conv(F.hex(unchars(F.reverse(chars(part(b, i, width))))), 16, -10).cast("bigint")


def signed(x: Column, width: int) -> Column:
    return x if width == 8 else F.shiftright(F.shiftleft(x, 64 - 8 * width), 64 - 8 * width)


INTEGERS = {"byte": (1, True, "tinyint"), "unsigned_byte": (1, False, "smallint"), "short": (2, True, "smallint"), "unsigned_short": (2, False, "int"), "int": (4, True, "int"), "unsigned_int": (4, False, "bigint"), "long": (8, True, "bigint")}


def _getter(width: int, sign: bool, kind: str):
    def rule(b: ColumnOrName, i: Column | int):
        b, i = col(b), num(i)
        x = little_endian(b, i, width)
        return within(i, width, length(b)), (signed(x, width) if sign else x).cast(kind), OUT_OF_BOUNDS

    rule.__doc__ = f"The little-endian {kind} of {width} bytes at byte ``i``."
    return rule


get_byte, try_get_byte = both(_getter(*INTEGERS["byte"]), "get_byte")
get_unsigned_byte, try_get_unsigned_byte = both(_getter(*INTEGERS["unsigned_byte"]), "get_unsigned_byte")
get_short, try_get_short = both(_getter(*INTEGERS["short"]), "get_short")
get_unsigned_short, try_get_unsigned_short = both(_getter(*INTEGERS["unsigned_short"]), "get_unsigned_short")
get_int, try_get_int = both(_getter(*INTEGERS["int"]), "get_int")
get_unsigned_int, try_get_unsigned_int = both(_getter(*INTEGERS["unsigned_int"]), "get_unsigned_int")
get_long, try_get_long = both(_getter(*INTEGERS["long"]), "get_long")


def _from_bits(kind: str, size: int, arrow: pa.DataType):
    @F.arrow_udf(arrow_type_name(arrow))
    def run(a: pa.Array) -> pa.Array:
        data, off = spans(a.fill_null(b"\0" * size) if a.null_count else a)
        return masked(np.frombuffer(data[off[0] : off[-1]].tobytes(), kind), a, arrow)

    return run


def arrow_type_name(t: pa.DataType) -> T.DataType:
    return {pa.float32(): T.FloatType(), pa.float64(): T.DoubleType(), pa.int16(): T.ShortType(), pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.int8(): T.ByteType()}[t]


_bits_float, _bits_double = _from_bits("<f4", 4, pa.float32()), _from_bits("<f8", 8, pa.float64())


def _get_float(b: ColumnOrName, i: Column | int):
    """The float whose bits are the 4 little-endian bytes at byte ``i``."""
    b, i = col(b), num(i)
    ok = within(i, 4, length(b))
    return ok, _bits_float(F.when(ok, part(b, i, 4))), OUT_OF_BOUNDS


def _get_double(b: ColumnOrName, i: Column | int):
    """The double whose bits are the 8 little-endian bytes at byte ``i``."""
    b, i = col(b), num(i)
    ok = within(i, 8, length(b))
    return ok, _bits_double(F.when(ok, part(b, i, 8))), OUT_OF_BOUNDS


get_float, try_get_float = both(_get_float, "get_float")
get_double, try_get_double = both(_get_double, "get_double")

ARRAYS = {"shorts": ("<i2", 2, pa.int16()), "ints": ("<i4", 4, pa.int32()), "longs": ("<i8", 8, pa.int64()), "floats": ("<f4", 4, pa.float32()), "doubles": ("<f8", 8, pa.float64())}


def _array_decoder(kind: str, size: int, arrow: pa.DataType):
    @F.arrow_udf(T.ArrayType(arrow_type_name(arrow)))
    def run(a: pa.Array) -> pa.Array:
        data, off = spans(a)
        values = pa.array(np.frombuffer(data[off[0] : off[-1]].tobytes(), kind), arrow)
        starts = pa.array(((off - off[0]) // size).astype(np.int32), mask=np.append(np.asarray(a.is_null()), False) if a.null_count else None)
        return pa.ListArray.from_arrays(starts, values)

    return run


def _array_encoder(kind: str, size: int, arrow: pa.DataType):
    @F.arrow_udf(T.BinaryType())
    def run(a: pa.Array) -> pa.Array:
        if a.null_count:
            a2 = a.fill_null(pa.scalar([], a.type))
        else:
            a2 = a
        values = a2.flatten()
        if values.null_count:
            raise ValueError("an array with a NULL element can't be encoded")
        n = np.asarray(a2.value_lengths()).astype(np.int64)
        return _binary(np.asarray(values).astype(kind).view(np.uint8), np.append(0, np.cumsum(n)) * size, a)

    return run


_decoders = {k: _array_decoder(*v) for k, v in ARRAYS.items()}
_encoders = {k: _array_encoder(*v) for k, v in ARRAYS.items()}


def _arrays(name: str):
    size = ARRAYS[name][1]

    def rule(b: ColumnOrName, i: Column | int, n: Column | int):
        b, i, n = col(b), num(i), num(n)
        ok = within(i, n.cast("bigint") * size, length(b))
        return ok, _decoders[name](F.when(ok, part(b, i, n * size))), OUT_OF_BOUNDS

    rule.__doc__ = f"``n`` little-endian {name} from byte ``i`` on."
    return rule


get_shorts, try_get_shorts = both(_arrays("shorts"), "get_shorts")
get_ints, try_get_ints = both(_arrays("ints"), "get_ints")
get_longs, try_get_longs = both(_arrays("longs"), "get_longs")
get_floats, try_get_floats = both(_arrays("floats"), "get_floats")
get_doubles, try_get_doubles = both(_arrays("doubles"), "get_doubles")


def encode_integer(v: Column, width: int) -> Column:
    """The low ``width`` bytes, little-endian; higher bits are cut off."""
    v = v.cast("bigint")
    if width < 8:
        v = v.bitwiseAND(F.lit((1 << (8 * width)) - 1))
    return unchars(F.reverse(chars(F.unhex(F.lpad(F.hex(v), 2 * width, "0")))))


def encode_boolean(v: ColumnOrName) -> Column:
    return F.when(col(v), F.lit(b"\1")).when(~col(v), F.lit(b"\0"))


def encode_float(v: ColumnOrName) -> Column:
    v = col(v)
    return F.when(v.isNotNull(), _encoders["floats"](F.when(v.isNotNull(), F.array(v.cast("float")))))


def encode_double(v: ColumnOrName) -> Column:
    v = col(v)
    return F.when(v.isNotNull(), _encoders["doubles"](F.when(v.isNotNull(), F.array(v.cast("double")))))


def encode_array(v: ColumnOrName, name: str) -> Column:
    """Shorts, ints, longs, floats or doubles of an array, little-endian."""
    return _encoders[name](col(v).cast(T.ArrayType(arrow_type_name(ARRAYS[name][2]))))


def _set_bytes(b: ColumnOrName, i: Column | int, value: ColumnOrName):
    """``b`` with the bytes from ``i`` on replaced by ``value``, which must fit in."""
    b, i, value = col(b), num(i), col(value)
    n = length(value)
    return within(i, n, length(b)), F.when(n == 0, b).otherwise(F.overlay(b, value, i.cast("int") + 1, n)), OUT_OF_BOUNDS


set_bytes, try_set_bytes = both(_set_bytes, "set_bytes")


def set_byte(b: ColumnOrName, i: Column | int, v: Column | int) -> Column:
    return set_bytes(b, i, encode_integer(num(v), 1))


def set_short(b: ColumnOrName, i: Column | int, v: Column | int) -> Column:
    return set_bytes(b, i, encode_integer(num(v), 2))


def set_int(b: ColumnOrName, i: Column | int, v: Column | int) -> Column:
    return set_bytes(b, i, encode_integer(num(v), 4))


def set_long(b: ColumnOrName, i: Column | int, v: Column | int) -> Column:
    return set_bytes(b, i, encode_integer(num(v), 8))


def set_float(b: ColumnOrName, i: Column | int, v: ColumnOrName) -> Column:
    return set_bytes(b, i, encode_float(v))


def set_double(b: ColumnOrName, i: Column | int, v: ColumnOrName) -> Column:
    return set_bytes(b, i, encode_double(v))


def set_array(b: ColumnOrName, i: Column | int, v: ColumnOrName, name: str) -> Column:
    """``b`` with an array's shorts, ints, longs, floats or doubles from byte ``i`` on."""
    return set_bytes(b, i, encode_array(v, name))


def zeros(n: Column | int) -> Column:
    """``n`` zero bytes; a negative or too large ``n`` is an error."""
    n = num(n)
    return F.when(n.isNotNull(), unchars(F.repeat(F.lit("\0"), check_size(n.cast("bigint")).cast("int"))))


allocate = zeros


def fill(b: ColumnOrName, v: Column | int) -> Column:
    """As many bytes, all the low byte of ``v``."""
    return unchars(F.repeat(chars(encode_integer(num(v), 1)), length(b)))


def clear(b: ColumnOrName) -> Column:
    return fill(b, 0)


def clear_range(b: ColumnOrName, i: Column | int, n: Column | int) -> Column:
    """``b`` with zeros at i..i+n-1, which must be inside."""
    b, i, n = col(b), num(i), num(n)
    return strict(within(i, n, length(b)), F.when(n == 0, b).otherwise(F.overlay(b, unchars(F.repeat(F.lit("\0"), n.cast("int"))), i.cast("int") + 1, n.cast("int"))), OUT_OF_BOUNDS)


def _byte_range(b: ColumnOrName, i: Column | int, n: Column | int):
    """Bytes i..i+n-1, which must be inside."""
    b, i, n = col(b), num(i), num(n)
    return within(i, n, length(b)), part(b, i, n), OUT_OF_BOUNDS


byte_range, try_byte_range = both(_byte_range, "byte_range")
get_bytes, try_get_bytes = byte_range, try_byte_range


def copy(b: ColumnOrName, i: Column | int | None = None, n: Column | int | None = None) -> Column:
    return col(b) if i is None else byte_range(b, i, n)


def random_bytes(n: Column | int, seed: int) -> Column:
    """``n`` bytes drawn anew for each row."""
    n = num(n)
    return F.when(n == 0, F.lit(b"")).otherwise(F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda _: F.lpad(F.hex(F.floor(F.rand(seed) * 256).cast("int")), 2, "0")), "")))


def to_text(b: ColumnOrName, charset: str = "UTF-8") -> Column:
    """Decoded text; malformed input is replaced by U+FFFD for UTF-8 and ASCII, as often as a decoder that reports each malformed unit once."""
    b = col(b)
    if charset.upper() in ("US-ASCII", "ASCII"):
        return F.regexp_replace(chars(b), "[\u0080-ÿ]", "�")
    if charset.upper() in ("UTF-8", "UTF8"):
        # a surrogate half is one malformed unit
        once = F.regexp_replace(chars(b), "í[ -¿][\u0080-¿]", "ÿ")
        return F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(F.make_valid_utf8(unchars(once).cast("string")))
    return F.decode(b, charset)


def from_text(s: ColumnOrName, charset: str = "UTF-8") -> Column:
    return F.encode(col(s), charset)


def _byte_char(v: Column) -> Column:
    return F.char(v.cast("bigint"))


NOT_A_BYTE = "a byte must be from 0 to 255"


def _index_of_byte(b: ColumnOrName, v: Column | int):
    """The first place of the byte ``v``, or -1."""
    b, v = col(b), num(v)
    return (v >= 0) & (v <= 255) & length(b).isNotNull(), F.position(_byte_char(v), chars(b)) - 1, NOT_A_BYTE


index_of_byte, try_index_of_byte = both(_index_of_byte, "index_of_byte")


def _last_index_of_byte(b: ColumnOrName, v: Column | int, start: Column | int | None = None):
    """The last place, at ``start`` or before, of the byte ``v``, or -1; a start beyond the end means the end."""
    b, v = col(b), num(v)
    n = length(b)
    head = chars(b) if start is None else F.left(chars(b), F.greatest(F.least(num(start), n - 1) + 1, F.lit(0)))
    back = F.position(_byte_char(v), F.reverse(head))
    return (v >= 0) & (v <= 255) & n.isNotNull(), F.when(back == 0, -1).otherwise(F.char_length(head) - back), NOT_A_BYTE


last_index_of_byte, try_last_index_of_byte = both(_last_index_of_byte, "last_index_of_byte")


def index_of(b: ColumnOrName, pattern: ColumnOrName, offset: Column | int = 0) -> Column:
    """The first place, from ``offset`` on, of the pattern. An empty pattern is at the offset; empty data, and an offset outside of the data, give -1."""
    b, p, o = col(b), col(pattern), num(offset).cast("int")
    n = length(b)
    found = F.position(chars(p), chars(b), F.greatest(o, F.lit(0)) + 1) - 1
    return F.when(p.isNotNull(), F.when((n == 0) | (o < 0) | (o >= n), -1).when(length(p) == 0, o).when(n.isNotNull() & o.isNotNull(), found))


def last_index_of(b: ColumnOrName, pattern: ColumnOrName, offset: Column | int | None = None) -> Column:
    """The last place, at ``offset`` or before, of the pattern, or -1. An empty pattern is at the offset, at most the end; in empty data at 0."""
    b, p = col(b), col(pattern)
    n, m = length(b), length(p)
    o = n if offset is None else num(offset)
    head = F.left(chars(b), F.greatest(F.least(o, n - m) + m, F.lit(0)))
    back = F.position(F.reverse(chars(p)), F.reverse(head))
    found = F.when(back == 0, -1).otherwise(F.char_length(head) - (back - 1) - m)
    return F.when(n.isNotNull() & m.isNotNull() & o.isNotNull(), F.when((n == 0) & (m == 0), 0).when((n == 0) | (o < 0), -1).when(m == 0, F.least(o, n)).when(m > n, -1).otherwise(found).cast("int"))


def compare(a: ColumnOrName, b: ColumnOrName) -> Column:
    """-1, 0 or 1: bytes as unsigned numbers, the shorter first if one begins the other."""
    a, b = col(a), col(b)
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def compare_ranges(a: ColumnOrName, i: Column | int, n: Column | int, b: ColumnOrName, j: Column | int, m: Column | int) -> Column:
    return compare(byte_range(a, i, n), byte_range(b, j, m))


def equals(a: ColumnOrName, b: ColumnOrName) -> Column:
    return col(a) == col(b)


def equals_range(a: ColumnOrName, i: Column | int, n: Column | int, b: ColumnOrName, j: Column | int, m: Column | int) -> Column:
    return (num(n) == num(m)) & (byte_range(a, i, n) == byte_range(b, j, m))

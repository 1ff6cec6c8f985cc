import random
import struct

import oracles as O
import pytest
from pyspark.sql import functions as F

from byteloom.functions import binary as B

r = random.Random(5)
VALUES = [bytes(r.randrange(256) for _ in range(n)) for n in [0, 1, 2, 3, 7, 8, 9, 15, 16, 40, 129]] + [b"\xff" * 9, b"\x80" * 9, b"\0" * 9, struct.pack("<2d", float("inf"), -0.0), struct.pack("<d", 1.5)]
FORMATS = {"byte": "b", "unsigned_byte": "B", "short": "h", "unsigned_short": "H", "int": "i", "unsigned_int": "I", "long": "q", "float": "f", "double": "d"}


def fails(df, e):
    with pytest.raises(Exception) as x:
        df.select(e).collect()
    return str(x.value)


def same(a, b):
    return a is None and b is None or struct.pack("<d", a) == struct.pack("<d", b) if isinstance(a, float) and isinstance(b, float) else a == b


def test_getters(spark):
    df = spark.createDataFrame([(b, i) for b in [*VALUES, None] for i in (-1, 0, 1, 3, 8)], "b binary, i int")
    rows = df.select("b", "i", *[getattr(B, f"try_get_{k}")("b", F.col("i")).alias(k) for k in FORMATS]).collect()
    for row in rows:
        for k, f in FORMATS.items():
            n = struct.calcsize(f)
            want = None if row.b is None or row.i < 0 or row.i + n > len(row.b) else struct.unpack_from("<" + f, row.b, row.i)[0]
            if isinstance(want, float) and want != want:
                assert row[k] != row[k]
            else:
                assert same(row[k], want), (row, k)
    for k in FORMATS:
        assert "out of bounds" in fails(spark.createDataFrame([(b"",)], "b binary"), getattr(B, f"get_{k}")("b", 0))


def test_arrays(spark):
    df = spark.createDataFrame([(b,) for b in [*VALUES, None]], "b binary").coalesce(1)
    for name, f in (("shorts", "h"), ("ints", "i"), ("longs", "q"), ("floats", "f"), ("doubles", "d")):
        size = struct.calcsize(f)
        for i, n in ((0, 0), (1, 1), (0, 2)):
            got = df.select(getattr(B, "try_get_" + name)("b", i, n).alias("x")).collect()
            for b, x in zip([*VALUES, None], got):
                want = None if b is None or i + n * size > len(b) else list(struct.unpack_from(f"<{n}{f}", b, i))
                assert (x.x is None) == (want is None) and (want is None or repr(x.x) == repr(want))
        back = df.select("b", B.encode_array(getattr(B, "try_get_" + name)("b", 0, 2), name).alias("x")).collect()
        assert all(x.x is None if x.b is None or len(x.b) < 2 * size else bytes(x.x) == bytes(x.b[: 2 * size]) or f in "fd" for x in back)


def test_setters_and_encoders(spark):
    df = spark.createDataFrame([(v, float(v)) for v in (0, 1, -2, 258, 2**31, -(2**63), 2**63 - 1)] + [(None, None)], "v bigint, d double")
    rows = df.select("v", "d", *[B.encode_integer(F.col("v"), w).alias(f"w{w}") for w in (1, 2, 4, 8)], B.encode_double("d").alias("e"), B.encode_float("d").alias("f"), B.set_long(F.lit(b"." * 10), 1, F.col("v")).alias("s"), B.set_double(F.lit(b"." * 8), 0, "d").alias("t")).collect()
    for x in rows[:-1]:
        b8 = x.v.to_bytes(8, "little", signed=True)
        assert [bytes(x[f"w{w}"]) for w in (1, 2, 4, 8)] == [b8[:w] for w in (1, 2, 4, 8)]
        assert bytes(x.e) == struct.pack("<d", x.d) == bytes(x.t) and bytes(x.f) == struct.pack("<f", x.d)
        assert bytes(x.s) == b"." + b8 + b"."
    assert all(v is None for v in rows[-1])
    one = spark.createDataFrame([(b"abcdef", [1, -1])], "b binary, a array<int>")
    for e, want in (
        (B.set_byte("b", 0, 0x141), b"Abcdef"), (B.set_short("b", 4, -1), b"abcd\xff\xff"), (B.set_int("b", 1, 1), b"a\1\0\0\0f"), (B.set_bytes("b", 6, F.lit(b"")), b"abcdef"), (B.set_array("b", 1, "a", "shorts"), b"a\1\0\xff\xfff"),
        (B.fill("b", 0x41), b"AAAAAA"), (B.clear("b"), bytes(6)), (B.clear_range("b", 1, 2), b"a\0\0def"), (B.clear_range("b", 6, 0), b"abcdef"), (B.byte_range("b", 2, 3), b"cde"), (B.byte_range("b", 6, 0), b""), (B.copy("b"), b"abcdef"),
        (B.copy("b", 1, 2), b"bc"), (B.zeros(3), bytes(3)), (B.allocate(0), b""), (B.fill(F.lit(b""), 1), b""), (B.set_float(F.lit(b"...."), 0, F.lit(1.5)), struct.pack("<f", 1.5)),
    ):
        assert bytes(one.select(e).first()[0]) == want
    for e in (B.byte_range("b", 5, 2), B.byte_range("b", -1, 2), B.byte_range("b", 0, -1), B.set_int("b", 3, 0), B.clear_range("b", 5, 2), B.zeros(-1), B.zeros(2**31 - 1)):
        fails(one, e)
    got = one.select(B.random_bytes(9, 1)).first()[0]
    assert len(got) == 9 and len(one.select(B.random_bytes(0, 1)).first()[0]) == 0


def test_searches(spark):
    pool = [b"", b"a", b"ab", b"test", b"this-test-is-a-test", b"\x80", b"\xc2\x80", b"\xc2", b"aaaa", b"abab", b"\0\0"] + [bytes(r.choice(b"ab\x80\xc2") for _ in range(r.randint(0, 7))) for _ in range(40)]
    rows = [(b, p, o) for b in pool for p in pool[:11] for o in (-1, 0, 1, 2, 5, 14, 99)]
    df = spark.createDataFrame(rows, "b binary, p binary, o int").repartition(4)
    for x in df.select("*", B.index_of("b", "p", F.col("o")).alias("i"), B.last_index_of("b", "p", F.col("o")).alias("j"), B.last_index_of("b", "p").alias("e"), B.compare("b", "p").alias("c"), B.equals("b", "p").alias("q")).collect():
        b, p = bytes(x.b), bytes(x.p)
        assert x.i == O.index_of(b, p, x.o) and x.j == O.last_index_of(b, p, x.o) and x.e == O.last_index_of(b, p, len(b)), x
        assert x.c == (b > p) - (b < p) and x.q == (b == p)
    nulls = spark.createDataFrame([(None, b"a", 0), (b"a", None, 0)], "b binary, p binary, o int").select(B.index_of("b", "p"), B.last_index_of("b", "p"), B.compare("b", "p")).collect()
    assert all(v is None for x in nulls for v in x)


def test_bytes_and_ranges(spark):
    df = spark.createDataFrame([(b,) for b in (b"apple" * 15 + b"!", b"", b"\x80a\xff\0", b"a")], "b binary")
    for v in (0, 33, 97, 101, 128, 255):
        for x in df.select("b", B.index_of_byte("b", v).alias("i"), B.last_index_of_byte("b", v).alias("j"), B.last_index_of_byte("b", v, 20).alias("k"), B.last_index_of_byte("b", v, -1).alias("l")).collect():
            b = bytes(x.b)
            assert (x.i, x.j, x.k, x.l) == (b.find(bytes([v])), b.rfind(bytes([v])), b[:21].rfind(bytes([v])), -1)
    for v in (-1, -123, 256, 500):
        assert "from 0 to 255" in fails(df, B.index_of_byte("b", v)) and df.select(B.try_index_of_byte("b", v)).first()[0] is None
    x = df.limit(1).select(B.compare_ranges("b", 0, 2, "b", 5, 3), B.equals_range("b", 0, 3, "b", 5, 3), B.equals_range("b", 0, 3, "b", 5, 2), B.length("b")).first()
    assert tuple(x) == (-1, True, False, 76)


def test_text(spark):
    raw = ["C0AF", "F08FBFBF", "E28241", "FBBFBFBFBF", "E081BF", "FF", "EDA080", "61C3A9", "", "E282AC"]
    want = ["��", "�" * 4, "�A", "�" * 5, "�" * 3, "�", "�", "aé", "", "€"]
    df = spark.createDataFrame([(bytes.fromhex(x),) for x in raw], "b binary").coalesce(1)
    assert [x[0] for x in df.select(B.to_text("b")).collect()] == want
    assert [x[0] for x in df.select(B.to_text("b", "US-ASCII")).collect()] == ["".join(chr(c) if c < 128 else "�" for c in bytes.fromhex(x)) for x in raw]
    assert [x[0] for x in df.select(B.to_text("b", "ISO-8859-1")).collect()] == [bytes.fromhex(x).decode("latin-1") for x in raw]
    assert bytes(spark.sql("select 'é€' s").select(B.from_text("s", "UTF-16BE")).first()[0]) == "é€".encode("utf-16-be")

import random

import oracles as O
import pytest
from pyspark.sql import functions as F

from byteloom.functions import casemap
from byteloom.functions import utf8 as U

UPPER, LOWER = (dict(zip(a, b)) for a, b in ((casemap.UPPER_FROM, casemap.UPPER_TO), (casemap.LOWER_FROM, casemap.LOWER_TO)))
WS = casemap.WHITESPACE


def corpus():
    r = random.Random(11)
    out = list(O.INVALID) + [t.encode() for t in O.TEXTS] + [bytes.fromhex(x) for x in ("81", "20812220", "C8BAFF", "BFE28083BF", "E2808320", "20E28083C3")]
    out += [b"a" + x for x in O.INVALID] + [x + "é ".encode() for x in O.INVALID] + [b" " + x + b"\t" for x in O.INVALID]
    pool = [bytes([x]) for x in (0x20, 0x41, 0x7A, 0x80, 0xBF, 0xC0, 0xC3, 0xDF, 0xE0, 0xE2, 0xED, 0xEF, 0xF0, 0xF4, 0xF5, 0xF8, 0xFC, 0xFE, 0xFF, 0x0A, 0x0D)] + [c.encode() for c in "éßİ 信\U0001042d"]
    return out + [b"".join(r.choice(pool) for _ in range(r.randint(0, 9))) for _ in range(400)]


CORPUS = corpus()


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(k, b) for k, b in enumerate(CORPUS)] + [(len(CORPUS), None)], "k int, b binary").repartition(4).cache()


def column(df, e):
    rows = df.select("k", e.alias("x")).orderBy("k").collect()
    assert rows[-1].x is None
    return [bytes(r.x) if isinstance(r.x, bytearray) else r.x for r in rows[:-1]]


@pytest.mark.parametrize(
    "f,want",
    [
        (U.is_ascii, bytes.isascii), (U.is_valid, O.is_valid), (U.count_code_points_bytes, O.count), (U.reverse_bytes, lambda b: b"".join(reversed(O.tokens(b)))),
        (U.fix_invalid, lambda b: O.fix(b, "�".encode())), (lambda b: U.fix_invalid(b, None), lambda b: O.fix(b, b"")), (lambda b: U.fix_invalid(b, 0x3F), lambda b: O.fix(b, b"?")),
        (U.upper_bytes, lambda b: O.map_case(b, UPPER)), (U.lower_bytes, lambda b: O.map_case(b, LOWER)), (U.left_trim_bytes, lambda b: O.left_trim(b, WS)), (U.right_trim_bytes, lambda b: O.right_trim(b, WS)),
        (U.trim_bytes, lambda b: O.right_trim(O.left_trim(b, WS), WS)), (U.try_code_point_byte_lengths, O.byte_lengths), (U.try_to_code_points, lambda b: [ord(c) for c in b.decode()] if O.is_valid(b) else None),
    ],
)
def test_malformed(df, f, want):
    for b, got in zip(CORPUS, column(df, f(F.col("b")))):
        assert got == want(b), b.hex()


def test_at_every_place(spark):
    places = [(k, b, i) for k, b in enumerate(CORPUS) for i in range(-1, len(b) + 2)]
    df = spark.createDataFrame(places, "k int, b binary, i int").repartition(4)
    fs = [U.try_code_point_or_length("b", F.col("i")), U.try_code_point_at("b", F.col("i")), U.try_length_of_code_point_safe("b", F.col("i")), U.try_code_point_before("b", F.col("i"))]
    for r in df.select("b", "i", *[f.alias(f"x{k}") for k, f in enumerate(fs)]).collect():
        b, i = bytes(r.b), r.i
        inside = 0 <= i < len(b)
        assert r.x0 == (O.try_code_point(b, i) if inside else None), (b.hex(), i)
        assert r.x1 == (O.raw_code_point(b, i) if inside else None), (b.hex(), i)
        assert r.x2 == (len(O.token(b, i)) if inside else None), (b.hex(), i)
        assert r.x3 == (O.code_point_before(b, i) if 1 <= i <= len(b) else None), (b.hex(), i)


def test_substring_and_offsets_of_bytes(spark):
    rows = [(b, n, p) for b in CORPUS[::3] for n in range(0, 5) for p in range(0, min(4, len(b)) + 1)]
    df = spark.createDataFrame(rows, "b binary, n int, p int").repartition(4)
    for r in df.select("*", U.offset_of_code_point_bytes("b", F.col("n"), F.col("p")).alias("o"), U.try_substring_bytes("b", F.col("p"), F.col("n")).alias("s")).collect():
        b = bytes(r.b)
        assert r.o == O.offset_of(b, r.n, r.p), (b.hex(), r.n, r.p)
        assert (None if r.s is None else bytes(r.s)) == O.substring(b, r.p, r.n), (b.hex(), r.p, r.n)


def test_all_code_points(spark):
    cps = spark.range(0, 0x110000).where("id not between 55296 and 57343").select(F.col("id").cast("int").alias("cp")).cache()
    one = cps.select("cp", U.code_point_to_utf8("cp").alias("b"))
    s = one.select("cp", "b", F.col("b").cast("string").alias("s"))
    bad = s.where(
        (U.code_point_at("b", 0) != F.col("cp")) | (U.code_point_or_length("b", 0) != F.col("cp")) | (U.length_of_code_point("cp") != F.octet_length("b")) | (U.length_of_code_point_safe("b", 0) != F.octet_length("b"))
        | (U.length_of_code_point_at("b", 0) != F.octet_length("b")) | (U.code_point_before("b", F.octet_length("b")) != F.col("cp")) | (F.char_length("s") != 1) | (F.ascii("s") != F.col("cp"))
    )
    assert s.count() == 1_112_064 and bad.count() == 0
    cased = s.where(F.ascii(U.upper("s")) != F.col("cp")).count(), s.where(F.ascii(U.lower("s")) != F.col("cp")).count()
    assert cased == (len(UPPER), len(LOWER)) == (1410, 1393)
    assert s.where((F.char_length(U.upper("s")) != 1) | (F.char_length(U.lower("s")) != 1)).count() == 0
    assert s.where(U.trim(F.concat("s", F.lit("x"), "s")) == "x").count() == 25 == len(WS)


def test_text(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(O.TEXTS)] + [(99, None)], "k int, s string")
    for e, want in (
        (U.count_code_points("s"), len), (U.reverse("s"), lambda t: t[::-1]), (U.trim("s"), lambda t: t.strip(WS)), (U.left_trim("s"), lambda t: t.lstrip(WS)), (U.right_trim("s"), lambda t: t.rstrip(WS)),
        (U.trim("s", U.code_point_set([104, 111, 0xF6])), lambda t: t.strip("hoö")), (U.upper("s"), lambda t: "".join(UPPER.get(c, c) for c in t)), (U.lower("s"), lambda t: "".join(LOWER.get(c, c) for c in t)),
        (U.to_code_points("s"), lambda t: [ord(c) for c in t]), (U.code_point_byte_lengths("s"), lambda t: [len(c.encode()) for c in t]), (U.from_code_points(U.to_code_points("s")), str.encode),
        (U.offset_of_code_point("s", 3), lambda t: len(t[:3].encode()) if len(t) > 3 else -1), (U.try_substring("s", 1, 2), lambda t: t[1:3] if len(t) >= 3 else None), (U.is_ascii("s"), str.isascii),
    ):
        assert column(df, e) == [want(t) for t in O.TEXTS]


def test_utf16_order(spark):
    cps = [0, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF]
    own = [p + chr(a) + s for p in ("", "a") for a in cps for s in ("", "a", "\U0001042d")]
    df = spark.createDataFrame([(a, b) for a in own for b in own], "a string, b string")
    for r in df.select("a", "b", U.compare_utf16("a", "b").alias("x")).collect():
        x, y = r.a.encode("utf-16-be"), r.b.encode("utf-16-be")
        assert r.x == (x > y) - (x < y)


def fails(df, e):
    with pytest.raises(Exception) as x:
        df.select(e).collect()
    return str(x.value)


def test_messages(spark):
    one = lambda b: spark.createDataFrame([(b,)], "b binary")
    hello = spark.createDataFrame([("hello",)], "s string")
    assert "UTF-8 does not contain 10 code points" in fails(hello, U.substring("s", 10, 2))
    assert "UTF-8 does not contain 7 code points" in fails(hello, U.substring("s", 0, 7))
    assert "codePointStart is negative" in fails(hello, U.substring("s", -1, 2)) and "codePointLength is negative" in fails(hello, U.substring("s", 0, -1))
    assert "UTF-8 is not well formed" in fails(one(b"foo\xef\xbf"), U.substring_bytes("b", 0, 4))
    assert "UTF-8 does not contain 5 code points" in fails(one(b"hello"), U.substring_bytes("b", 5, 0))
    assert "Invalid UTF-8 sequence at position 3" in fails(one("aé".encode() + b"\xff"), U.to_code_points("b"))
    assert "Invalid UTF-8 sequence at position 1" in fails(one(b"a\xe2\x82"), U.code_point_byte_lengths("b"))
    assert "Illegal start 0xBF of code point" in fails(one(b"\xbf"), U.code_point_at("b", 0)) and "truncated" in fails(one(b"\xe2\x82"), U.code_point_at("b", 0))
    assert "Illegal start 0xF8 of code point" in fails(one(b"\xf8"), U.length_of_code_point_at("b", 0))
    for cp, text in ((-1, "0xFFFFFFFF"), (0xD800, "0xD800"), (0x110000, "0x110000")):
        df = spark.createDataFrame([([65, cp],)], "a array<int>")
        assert f"Invalid code point {text}" in fails(df, U.from_code_points("a")) and df.select(U.try_from_code_points("a")).first()[0] is None
    with pytest.raises(ValueError):
        U.code_point_set([-1])


def test_set_code_point(spark):
    df = spark.createDataFrame([(b"abcdef", 0x20AC, 1), (b"abcdef", 0x41, 5), (b"abcdef", 0x20AC, 4), (b"abcdef", 0xD800, 0), (None, 65, 0)], "b binary, cp int, i int")
    got = [None if r.x is None else (bytes(r.x.buffer), r.x.length) for r in df.select(U.try_set_code_point_at("cp", "b", F.col("i")).alias("x")).collect()]
    assert got == [("a€ef".encode(), 3), (b"abcdeA", 1), None, None, None]
    assert bytes(df.limit(1).select(U.set_code_point_at("cp", "b", F.col("i")).alias("x")).first().x.buffer) == "a€ef".encode()
    assert "out of bounds" in fails(df.where("i = 4"), U.set_code_point_at("cp", "b", F.col("i")))

import random

import numpy as np
import oracles as O
import xxhash

from byteloom.functions import hashing as H

SEEDS = [0, 42, 2654435761, -91085370, 2**63 - 1, -(2**63)]
r = random.Random(7)
VALUES = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(0, 70), 95, 96, 97, 191, 192, 193, 255, 287, 288, 289, 1000, 20_000]]


def signed(x, bits=64):
    return x - (1 << bits) if x >> (bits - 1) else x


def frame(spark, values=VALUES):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(len(values), None)], "k int, b binary")


def column(df, *exprs):
    rows = df.select("k", *exprs).orderBy("k").collect()
    assert all(x is None for x in rows[-1][1:])
    return [tuple(x)[1:] for x in rows[:-1]]


def test_xxh64(spark):
    df = frame(spark)
    for (k, got), v in zip(enumerate(column(df, *[H.xxh64("b", s) for s in SEEDS])), VALUES):
        assert got == tuple(signed(xxhash.xxh64_intdigest(v, s % 2**64)) for s in SEEDS), k
    assert [x[0] for x in column(df, H.hash_code("b"))] == [signed(xxhash.xxh64_intdigest(v) % 2**32, 32) for v in VALUES]
    v = bytearray()
    x = 2654435761
    for _ in range(101):
        v.append(x >> 24 & 255)
        x = x * x % 2**64
    v = bytes(v)
    golden = {0: "EF46DB3751D8E999", 1: "4FCE394CC88952D8", 4: "9256E58AA397AEF1", 8: "F74CB1451B32B8CF", 14: "CFFA8DB881BC3A3D", 32: "AF5753D39159EDEE", 101: "0EAB543384F878AD"}
    got = column(frame(spark, [v[:n] for n in golden]), H.xxh64("b"))
    assert [f"{x[0] % 2**64:016X}" for x in got] == list(golden.values())


def test_xxh64_of_longs_ranges_and_chunks(spark):
    longs = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(longs)] + [(9, None)], "k int, v bigint")
    assert [x[0] for x in column(df, H.xxh64_long("v", 7))] == [signed(xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), 7)) for v in longs]
    assert [x[0] for x in column(frame(spark, VALUES[20:40]), H.xxh64_range("b", 3, 11))] == [signed(xxhash.xxh64_intdigest(v[3:14])) for v in VALUES[20:40]]
    chunks = [(g, i, v[i * 37 : i * 37 + 37]) for g, v in enumerate(VALUES) for i in range(len(v) // 37 + 1)]
    r.shuffle(chunks)
    got = spark.createDataFrame(chunks, "g int, i int, c binary").repartition(3).groupBy("g").agg(H.xxh64_chunks("i", "c", 5).alias("h")).collect()
    assert {x.g: x.h for x in got} == {g: signed(xxhash.xxh64_intdigest(v, 5)) for g, v in enumerate(VALUES)}


def test_murmur3(spark):
    df = frame(spark)
    for got, v in zip(column(df, *[H.murmur3_32("b", s) for s in (0, 123456789, -5)], H.murmur3_128("b"), H.murmur3_128("b", -91085370), H.murmur3_hash64("b", 3)), VALUES):
        assert got[:3] == tuple(O.murmur32(v, s) for s in (0, 123456789, -5))
        assert (bytes(got[3]), bytes(got[4])) == (O.murmur128(v, 0), O.murmur128(v, -91085370))
        assert got[5] == int.from_bytes(O.murmur128(v, 3)[:8], "little", signed=True)
    assert O.murmur32(b"test", 0x9747B28C) % 2**32 == 0x704B81DC and O.murmur128(b"", 0) == bytes(16)  # public vectors
    ints = [0, 1, -1, 2**31 - 1, -(2**31)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(ints)] + [(9, None)], "k int, v int")
    for got, v in zip(column(df, H.murmur3_32_int("v", 9), H.murmur3_32_long("v", 9), H.murmur3_hash64_long("v", 9)), ints):
        b8 = v.to_bytes(8, "little", signed=True)
        assert got == (O.murmur32(v.to_bytes(4, "little", signed=True), 9), O.murmur32(b8, 9), int.from_bytes(O.murmur128(b8, 9)[:8], "little", signed=True))


def test_spooky(spark):
    data = bytes((i + 128) & 255 for i in range(8))
    golden = [0x232706FC6BF50919, 0xA3BF77D970DE1D26, 0x46BB8F57A2B37298, 0x9451E1C935BC5FBF]
    seeded = [0x405135088E86FD8A, 0xA93B1CA7A5A43DF9, 0xB2D39A5371ED9B62, 0x66F3EC93F69A8476]
    got = column(frame(spark, [data[:n] for n in range(4)]), H.spooky_hash64("b"), H.spooky_hash64("b", -6871704374924842416), H.spooky_hash32("b"), H.spooky_hash32("b", -91085370))
    assert [x[0] % 2**64 for x in got] == golden and [x[1] % 2**64 for x in got] == seeded
    assert [x[2] % 2**32 for x in got] == [x % 2**32 for x in golden]
    assert [x[3] % 2**32 for x in got] == [0xFB177632, 0xDA4D8A9F, 0xFEE53A57, 0x5AF3DDBB]
    # a batch of mixed lengths gives what each value gives alone
    whole = [x[0] for x in column(frame(spark), H.spooky_hash64("b", 3))]
    alone = [int(H.spooky_numpy(np.frombuffer(v, np.uint8), np.array([0, len(v)]), 3).view(np.int64)[0]) for v in VALUES]
    assert whole == alone and len(set(whole)) == len(VALUES)


def test_fnv(spark):
    values = [b"", b"foobar", b"foobar!\n", b"line 1\nline 2\nline 3", b"\x80", b"128"]
    g32, g64 = [0x811C9DC5, 0xBF9CF968, 0x24C0F933, 0x97B4EA23, 0x04F3B29F, 0x6B385816], [0xCBF29CE484222325, 0x85944171F73967E8, 0x745F83EB4ECAC933, 0x7829851FAC17B143, 0x509C0CB379FDEC5F, 0x456FBB181822B8F6]
    got = column(frame(spark, values), H.fnv_hash32("b"), H.fnv_hash64("b"))
    assert [x[0] % 2**32 for x in got] == g32 and [x[1] % 2**64 for x in got] == g64
    got = column(frame(spark), H.fnv_hash32("b"), H.fnv_hash64("b"))
    assert [(x[0] % 2**32, x[1] % 2**64) for x in got] == [(O.fnv(v, 32), O.fnv(v, 64)) for v in VALUES]

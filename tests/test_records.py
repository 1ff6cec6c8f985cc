import struct

import pytest
from pyspark.sql import functions as F

from byteloom.functions import binary as B
from byteloom.functions import sizes as Z
from byteloom.operators import records as R
from byteloom.sources.records import ChunkedReader, RecordSource

LAYOUT = R.RecordLayout.parse("ok:boolean,b:byte,ub:unsigned_byte,s:short,us:unsigned_short,i:int,ui:unsigned_int,l:long,f:float,d:double,xs:int:3,ds:double:2,raw:bytes:5,gap:skip:2")
FORMAT = "<?bBhHiIqfd3i2d5s2x"
ROWS = [
    (True, -1, 255, -2, 65535, -3, 2**32 - 1, -(2**63), 1.5, -0.0, [1, -1, 2**31 - 1], [0.1, float("inf")], b"abcde"),
    (False, 127, 0, 32767, 1, 2**31 - 1, 0, 2**63 - 1, -2.25, 1e300, [0, 0, -(2**31)], [-1.0, 5e-324], b"\0\xff\x80\0\0"),
]


def packed(x):
    return struct.pack(FORMAT, *x[:10], *x[10], *x[11], x[12])


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, LAYOUT.schema)


def test_encode_and_decode(spark):
    assert LAYOUT.width == struct.calcsize(FORMAT) == LAYOUT.dtype.itemsize and str(LAYOUT) == str(R.RecordLayout.parse(str(LAYOUT)))
    got = [bytes(x[0]) for x in frame(spark).coalesce(1).select(LAYOUT.encode()).collect()]
    assert got == [packed(x) for x in ROWS]
    df = spark.createDataFrame([(b"##" + packed(x),) for x in ROWS], "b binary")
    assert sorted(map(str, df.select(*LAYOUT.decode("b", 2)).collect())) == sorted(map(str, frame(spark).collect()))
    with pytest.raises(Exception, match="End of stream"):
        df.select(*LAYOUT.decode("b", 3)).collect()
    both = spark.createDataFrame([(7, b"".join(map(packed, ROWS))), (8, b"")], "id int, b binary")
    rows = R.explode_records(both, "b", LAYOUT, ["id"]).orderBy("record").collect()
    assert [(x.id, x.record, x.l) for x in rows] == [(7, 0, -(2**63)), (7, 1, 2**63 - 1)]
    with pytest.raises(Exception, match="End of stream"):
        R.explode_records(both.select("id", F.concat("b", F.lit(b"x")).alias("b")), "b", LAYOUT).collect()
    for bad in ("x:int:-1", "x:bytes", "x:what", "x:boolean:3", "x:ints"):
        with pytest.raises((ValueError, IndexError)):
            R.RecordLayout.parse(bad)


def test_source_and_sink(spark, tmp_path):
    spark.dataSource.register(RecordSource)
    path, how = str(tmp_path / "out"), {"layout": str(LAYOUT)}
    many = [(k % 2 == 0, k % 100, k % 256, k % 30000, k % 60000, k, k, k * 10**9, float(k), k / 3, [k, -k, 0], [float(k), 0.5], struct.pack("<IB", k, 1)) for k in range(3000)]
    df = frame(spark, many).repartition(3)
    df.write.format("records").options(**how).mode("append").save(path)
    for split in (64 << 20, 1000):
        back = spark.read.format("records").options(**how, splitBytes=split).load(path)
        assert back.schema == LAYOUT.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert back.rdd.getNumPartitions() > 100
    df.limit(10).write.format("records").options(**how).mode("overwrite").save(path)
    assert spark.read.format("records").options(**how).load(path).count() == 10
    # the same bytes as a binary file, and as what plain Python reads
    one = tmp_path / "one.bin"
    one.write_bytes(b"".join(map(packed, ROWS)))
    files = spark.read.format("binaryFile").load(str(one))
    assert sorted(map(str, R.explode_records(files, "content", LAYOUT).drop("record").collect())) == sorted(map(str, spark.read.format("records").options(**how).load(str(one)).collect()))
    one.write_bytes(packed(ROWS[0])[:-1])
    with pytest.raises(Exception, match="End of stream"):
        spark.read.format("records").options(**how).load(str(one)).collect()
    one.write_bytes(b"")
    assert spark.read.format("records").options(**how).load(str(one)).count() == 0
    with pytest.raises(Exception, match="NULL"):
        frame(spark, [(*ROWS[0][:5], None, *ROWS[0][6:])]).write.format("records").options(**how).mode("append").save(path)


def test_chunked_reader():
    data = bytes(i % 251 for i in range(160))
    r = ChunkedReader(lambda at, n: data[at : at + n], 160, 130)
    assert b"".join(r.read(i, 1) for i in range(160)) == data and r.loads == 2
    for size in (1, 7, 15, 128, 129, 130, 142):
        r = ChunkedReader(lambda at, n: data[at : at + n], 160, 130)
        assert b"".join(r.read(i, min(size, 160 - i)) for i in range(0, 160, size)) == data
        assert [r.read(i, 1) for i in (150, 3, 149, 0)] == [data[i : i + 1] for i in (150, 3, 149, 0)]
        with pytest.raises(IndexError, match="End of stream"):
            r.read(159, 2)


def test_positions(spark):
    df = spark.createDataFrame([(b"abc",)], "b binary")
    got = df.select(R.skip("b", 1, 9), R.skip("b", 1, -1), R.remaining("b", 1), R.read("b", 2), R.read("b", 3), R.read_up_to("b", 1, 9), R.read_up_to("b", 3, 1), R.rewind("b", 2), R.rewind("b"), R.write_bounded(["b", F.lit(b"d")], 4)).first()
    assert [bytes(x) if isinstance(x, bytearray) else x for x in got] == [3, 1, 2, 99, -1, b"bc", b"", b"ab", b"", b"abcd"]
    for e in (R.rewind("b", 4), R.write_bounded(["b", "b"], 5), R.read("b", 4)):
        with pytest.raises(Exception, match="out of bounds"):
            df.select(e).collect()


def test_sizes(spark):
    df = spark.createDataFrame([(b"abc", [1, 2, 3], "aé\U0001f600", {"k": 1, "long": 2}, 5), (None, None, None, None, None)], "b binary, a array<int>, s string, m map<string,int>, i int")
    string = lambda c: Z.estimated_size_of_string(c)
    e = [
        Z.size_of("b", "binary"), Z.size_of("a", "int"), Z.size_of("a", "reference"), Z.size_of_boxed("i", "int"), Z.size_of_boxed("i", "long"), string("s"), Z.estimated_size_of_list("a", lambda x: x * 8), Z.estimated_size_of_queue("a", lambda x: F.lit(16)),
        Z.estimated_size_of_set("a", lambda x: F.lit(16)), Z.estimated_size_of_map("m", string, 16), Z.estimated_size_of_map("m", 8, lambda v: v), Z.size_of_optional("i", "int"), Z.size_of_optional("s", string),
    ]
    first, second = (tuple(x) for x in df.select(*[x.alias(f"x{k}") for k, x in enumerate(e)]).collect())
    assert first == (24, 32, 32, 16, 24, 24 + 8, 32 + 48, 32 + 48, 32 + 3 * (24 + 16), 24 + (24 + 2) + (24 + 8) + 2 * (24 + 16), 24 + 3 + 2 * (24 + 8), 24, 32 + 16)
    assert second == (0,) * 13
    assert [x[0] for x in spark.range(1).select(Z.size_of_array(9, "boolean")).collect()] == [32]


def test_random_values_round_trip(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    own = df.select("l_orderkey", "l_linenumber", "l_extendedprice")
    layout = R.RecordLayout([("l_orderkey", "long"), ("l_linenumber", "int"), ("l_extendedprice", "double")])
    back = own.select(layout.encode().alias("b")).select(*layout.decode("b"))
    assert back.exceptAll(own).isEmpty() and own.exceptAll(back).isEmpty() and B

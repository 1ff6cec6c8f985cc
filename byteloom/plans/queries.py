"""Queries that apply the column functions to the test tables, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.functions import binary as B
from byteloom.functions import hashing as H
from byteloom.functions import sizes as Z
from byteloom.functions import utf8 as U
from byteloom.operators.records import RecordLayout, explode_records, read, read_up_to, remaining, rewind, skip, write_bounded

#: Int columns that are int in SQL as well.
KEPT = {"l_linenumber", "lines", "us", "first", "last"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            """Counts and places as bigint, as SQL has them; columns of the tables keep their types."""
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("bigint") for c, kind in df.dtypes if kind == "int" and c not in KEPT})

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(c: str = "text") -> Column:
    return F.col(c).cast("binary")


def cut() -> Column:
    """A document's first bytes, often cut in the midst of a code point."""
    return F.substring(raw(), F.lit(1), F.pmod(F.col("doc_id"), F.lit(300)).cast("int") + 40)


LAYOUT = RecordLayout([("l_orderkey", "long"), ("l_partkey", "long"), ("l_suppkey", "unsigned_int"), ("l_linenumber", "short"), ("l_quantity", "float"), ("l_extendedprice", "double")])


@query("SELECT lang, count(*) AS docs, sum(length(text))::BIGINT AS code_points, sum(strlen(text))::BIGINT AS bytes, count_if(strlen(text) = length(text))::BIGINT AS ascii_docs FROM documents GROUP BY lang")
def utf8_profile_by_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "text")
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(U.count_code_points_bytes(raw())).alias("code_points"), F.sum(B.length(raw())).alias("bytes"), F.count_if(U.is_ascii("text")).alias("ascii_docs"))


@query("SELECT doc_id, replace(upper(replace(text, 'ß', chr(57344))), chr(57344), 'ß') AS x FROM documents")
def utf8_upper(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", U.upper("text").alias("x"))


@query("SELECT doc_id, lower(text) AS x FROM documents")
def utf8_lower(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", U.lower("text").alias("x"))


@query("SELECT doc_id, replace(upper(replace(text, 'ß', chr(57344))), chr(57344), 'ß') AS u, lower(text) AS l FROM documents")
def utf8_case_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", U.upper_bytes(raw()).cast("string").alias("u"), U.lower_bytes(raw()).cast("string").alias("l"))


@query("SELECT doc_id, reverse(text) AS x FROM documents")
def utf8_reverse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", U.reverse_bytes(raw()).cast("string").alias("x"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 3 AND length(text) >= 10 THEN substring(text, 4, 7) END AS x, CASE WHEN length(text) > 5 THEN strlen(substring(text, 1, 5)) ELSE -1 END AS o FROM conversations")
def utf8_substring(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", U.try_substring("text", 3, 7).alias("x"), U.offset_of_code_point("text", 5).alias("o"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 3 AND length(text) >= 10 THEN substring(text, 4, 7) END AS x, CASE WHEN length(text) > 5 THEN strlen(substring(text, 1, 5)) ELSE -1 END AS o FROM conversations")
def utf8_substring_bytes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", U.try_substring_bytes(raw(), 3, 7).cast("string").alias("x"), U.offset_of_code_point_bytes(raw(), 5).alias("o"))


_WS = ", ".join(f"chr({ord(c)})" for c in U.WHITESPACE)


@query(f"SELECT doc_id, trim(p, w) AS a, ltrim(p, w) AS l, rtrim(p, w) AS r, trim(p, w || '.o') AS o FROM (SELECT doc_id, concat({_WS}) AS w, concat(chr(8195), ' ', text, chr(10), chr(8232)) AS p FROM documents)")
def utf8_trim(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("  "), "text", F.lit("\n ")).alias("p"))
    return p.select("doc_id", U.trim("p").alias("a"), U.left_trim_bytes(F.col("p").cast("binary")).cast("string").alias("l"), U.right_trim_bytes(F.col("p").cast("binary")).cast("string").alias("r"), U.trim("p", U.WHITESPACE + ".o").alias("o"))


@query("SELECT item_id, array_to_string(list_transform(range(1, length(text) + 1), lambda i: unicode(substring(text, i::int, 1))), ',') AS points, array_to_string(list_transform(range(1, length(text) + 1), lambda i: strlen(substring(text, i::int, 1))), ',') AS lengths, text AS back FROM benchmark")
def utf8_code_points(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    points = U.to_code_points("text")
    return b.select("item_id", F.array_join(points.cast("array<string>"), ",").alias("points"), F.array_join(U.code_point_byte_lengths("text").cast("array<string>"), ",").alias("lengths"), U.from_code_points(points).cast("string").alias("back"))


@query(
    "SELECT doc_id, text AS p FROM documents ORDER BY list_transform(range(1, least(length(text), 40) + 1), lambda i: CASE WHEN unicode(substring(text, i::int, 1)) >= 65536 THEN unicode(substring(text, i::int, 1)) - 65536 + 55296"
    " WHEN unicode(substring(text, i::int, 1)) >= 57344 THEN unicode(substring(text, i::int, 1)) + 1048576 ELSE unicode(substring(text, i::int, 1)) END), doc_id LIMIT 50"
)
def utf16_top(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("p"))
    return d.orderBy(U.utf16_key(F.substring("p", 1, 40)), "doc_id").limit(50)


@query("SELECT a.doc_id, CASE WHEN a.lang < b.lang THEN -1 WHEN a.lang = b.lang THEN 0 ELSE 1 END::BIGINT AS c FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def utf16_compare(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("other")), "doc_id").select("doc_id", U.compare_utf16("lang", "other").alias("c"))


@query(
    "SELECT doc_id, unicode(substring(text, 1, 1)) AS first, strlen(substring(text, 1, 1)) AS n, unicode(substring(text, -1, 1)) AS last FROM documents WHERE text <> ''"
)
def utf8_code_point_at(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text <> ''")
    b = raw()
    same = U.try_code_point_or_length(b, 0)
    return d.select("doc_id", F.when(same == U.code_point_at(b, 0), same).alias("first"), F.greatest(U.length_of_code_point_safe(b, 0), U.length_of_code_point_at(b, 0), U.length_of_code_point(same)).alias("n"), U.code_point_before(b, B.length(b)).alias("last"))


@query("SELECT doc_id, concat(substring(text, 1, 4), '€', substring(text, 8)) AS x FROM documents WHERE strlen(substring(text, 1, 8)) = 8 AND length(text) >= 8")
def utf8_set_code_point(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(U.is_ascii(F.substring("text", 1, 8)) & (F.char_length("text") >= 8))
    return d.select("doc_id", U.set_code_point_at(F.lit(0x20AC), raw(), 4)["buffer"].cast("string").alias("x"))


@query()
def utf8_fix_invalid(spark, sf_dir):
    b = table(spark, sf_dir, "documents").select("doc_id", cut().alias("b"))
    return b.select("doc_id", U.is_valid("b").alias("valid"), U.fix_invalid("b").cast("string").alias("fixed"), U.fix_invalid("b", None).cast("string").alias("dropped"), B.to_text("b").alias("text"), U.reverse_bytes("b").alias("reversed"), U.trim_bytes("b").alias("trimmed"))


@query(
    "SELECT page_id, coalesce(nullif(instr(html, '<p>'), 0) - 1, -1) AS c, strlen(html) AS n, CASE WHEN instr(html, '<p>') > 0 THEN strlen(substring(html, 1, instr(html, '<p>') - 1)) ELSE -1 END AS i,"
    " CASE WHEN instr(html, '</p>') > 0 THEN strlen(html) - strlen(substring(reverse(html), 1, instr(reverse(html), '>p/<') - 1)) - 4 ELSE -1 END AS j,"
    " strlen(substring(html, 1, instr(html, '>') - 1)) AS b, strlen(html) - strlen(substring(reverse(html), 1, instr(reverse(html), '<') - 1)) - 1 AS e FROM pages"
)
def bin_index_of(spark, sf_dir):
    b = raw("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", (F.instr("html", "<p>") - 1).alias("c"), B.length(b).alias("n"), B.index_of(b, F.lit(b"<p>")).alias("i"), B.last_index_of(b, F.lit(b"</p>")).alias("j"), B.index_of_byte(b, ord(">")).alias("b"), B.last_index_of_byte(b, ord("<")).alias("e")
    )


@query("SELECT p_partkey, p_name < p_type AS less, CASE WHEN p_name < p_type THEN -1 WHEN p_name = p_type THEN 0 ELSE 1 END::BIGINT AS c, p_name = p_type AS q, substring(p_name, 1, 3) = substring(p_type, 1, 3) AS r FROM part")
def bin_compare(spark, sf_dir):
    a, b = raw("p_name"), raw("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", (a < b).alias("less"), B.compare(a, b).alias("c"), B.equals(a, b).alias("q"), B.equals_range(a, 0, 3, b, 0, 3).alias("r"))


@query("SELECT doc_id, substring(text, 3, 5) AS s, concat('#', substring(text, 2, 1), '##', substring(text, 5)) AS p, strlen(text) AS n FROM documents WHERE length(text) >= 10 AND strlen(substring(text, 1, 10)) = 10")
def bin_range_and_set(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where((F.char_length("text") >= 10) & U.is_ascii(F.substring("text", 1, 10)))
    b = raw()
    return d.select("doc_id", B.byte_range(b, 2, 5).cast("string").alias("s"), B.set_short(B.set_byte(b, 0, 35), 2, 35 * 257).cast("string").alias("p"), B.length(B.clear(b)).alias("n"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_linenumber AS SMALLINT) AS line, CAST(l_quantity AS FLOAT) AS quantity, l_extendedprice AS price, 38 AS width FROM lineitem".replace("38", str(LAYOUT.width))
)
def record_round_trip(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", LAYOUT.encode().alias("b"))
    key, part_, supp, line, quantity, price = LAYOUT.decode("b")
    return own.select(key, F.col("l_linenumber"), part_, supp, line.alias("line"), quantity.alias("quantity"), price.alias("price"), B.length("b").alias("width"))


@query("SELECT l_orderkey AS k, count(*) AS n, sum(l_partkey)::BIGINT AS parts, max(l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey")
def record_explode(spark, sf_dir):
    """Each order's records in one value, taken apart again."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", LAYOUT.encode().alias("b"))
    packed = own.groupBy(F.col("l_orderkey").alias("k")).agg(H.ordered_concat("l_linenumber", "b").alias("b"))
    return explode_records(packed, "b", LAYOUT, ["k"]).groupBy("k").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"), F.max("l_linenumber").cast("int").alias("lines"))


@query(
    "SELECT o_orderkey, o_orderkey AS l, (o_orderkey % 4294967296)::BIGINT AS ui, (o_custkey % 65536)::INTEGER AS us, (o_custkey % 256)::SMALLINT AS ub, o_totalprice AS d, o_totalprice::FLOAT AS f FROM orders"
)
def bin_little_endian(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(b"#"), B.encode_integer(F.col("o_orderkey"), 8), B.encode_integer(F.col("o_custkey"), 4), B.encode_double("o_totalprice"), B.encode_float("o_totalprice")).alias("b"))
    return own.select("o_orderkey", B.get_long("b", 1).alias("l"), B.get_unsigned_int("b", 1).alias("ui"), B.get_unsigned_short("b", 9).alias("us"), B.get_unsigned_byte("b", 9).alias("ub"), B.get_double("b", 13).alias("d"), B.get_float("b", 21).alias("f"))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: x = x), ',') = array_to_string(list_transform(embedding, lambda x: true), ',') AS same, len(embedding) AS n, 4 * len(embedding) AS bytes, embedding[1]::DOUBLE AS first FROM embeddings")
def bin_float_arrays(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", B.encode_array("embedding", "floats").alias("b"))
    back = B.get_floats("b", 0, F.size("embedding"))
    return own.select("vec_id", (back == F.col("embedding")).alias("same"), F.size(back).alias("n"), B.length("b").alias("bytes"), B.get_float("b", 0).cast("double").alias("first"))


@query("SELECT conv_id, turn, strlen(text) - 3 AS left_over, least(3 + 5, strlen(text)) AS at, CASE WHEN strlen(text) > 3 THEN strlen(substring(text, 1, 3)) - 3 ELSE 0 END AS z, strlen(text) + 2 AS n FROM conversations WHERE length(text) > 8 AND strlen(substring(text, 1, 9)) = 9")
def stream_positions(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").where((F.char_length("text") > 8) & U.is_ascii(F.substring("text", 1, 9)))
    b = raw()
    return d.select("conv_id", "turn", remaining(b, 3).alias("left_over"), skip(b, 3, 5).alias("at"), (B.length(rewind(b, 3)) - B.length(read_up_to(b, 0, 3)) + 0 * read(b, 2)).alias("z"), B.length(write_bounded([b, B.zeros(2)], 1 << 30)).alias("n"))


def _sql_fnv() -> str:
    byte = "('0x' || substring(hex(encode(text)), (2 * i + 1)::int, 2))::ubigint"
    step = "(xor(h, CASE WHEN x > 127 THEN x | 4294967040::ubigint ELSE x END) * 16777619) % 4294967296::ubigint"
    h = f"list_reduce(list_transform(range(0, octet_length(encode(text))), lambda i: {byte}), lambda h, x: {step}, 2166136261::ubigint)"
    return f"SELECT item_id, CASE WHEN {h} >= 2147483648 THEN {h}::BIGINT - 4294967296 ELSE {h}::BIGINT END AS h FROM benchmark"


@query(_sql_fnv())
def hash_fnv32(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", H.fnv_hash32("text").cast("bigint").alias("h"))


def _mod(x: str, bits: int) -> str:
    return f"(({x}) % {1 << bits}::UHUGEINT)"


def _steps(start: str, steps: list[str], last: str, bits: int) -> str:
    """A chain of subqueries over h, which each step replaces."""
    sql = f"SELECT o_orderkey, {start} AS h FROM orders"
    for s in steps:
        sql = f"SELECT o_orderkey, {s} AS h FROM ({sql})"
    return f"SELECT o_orderkey, CASE WHEN h >= {1 << (bits - 1)}::UHUGEINT THEN (h::HUGEINT - {1 << bits}::HUGEINT)::BIGINT ELSE h::BIGINT END AS {last} FROM ({sql})"


def _rotl(x: str, r: int, bits: int) -> str:
    return f"({_mod(f'({x}) * {1 << r}::UHUGEINT', bits)} + (({x}) >> {bits - r}))"


def _sql_xxh64() -> str:
    c = lambda x: f"{x}::UHUGEINT"
    up = lambda k: _mod(f"h * {c(k)}", 64)
    first = _mod(f"o_orderkey::UHUGEINT * {c(H._P2)}", 64)
    steps = [_rotl("h", 31, 64), up(H._P1), f"xor(h, {c((H._P5 + 8) % 2**64)})", _rotl("h", 27, 64), _mod(f"{up(H._P1)} + {c(H._P4)}", 64), "xor(h, h >> 33)", up(H._P2), "xor(h, h >> 29)", up(H._P3), "xor(h, h >> 32)"]
    return _steps(first, steps, "h", 64)


@query(_sql_xxh64())
def hash_xxh64_long(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", H.xxh64_long("o_orderkey").alias("h"))


def _sql_murmur_int() -> str:
    c = lambda x: f"{x}::UHUGEINT"
    up = lambda k: _mod(f"h * {c(k)}", 32)
    first = _mod(f"o_custkey::UHUGEINT * {c(H._C1)}", 32)
    steps = [_rotl("h", 15, 32), up(H._C2), _rotl("h", 13, 32), _mod(f"h * {c(5)} + {c(0xE6546B64)}", 32), f"xor(h, {c(4)})", "xor(h, h >> 16)", up(H._F1), "xor(h, h >> 13)", up(H._F2), "xor(h, h >> 16)"]
    return _steps(first, steps, "h", 32)


@query(_sql_murmur_int())
def hash_murmur32_int(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", H.murmur3_32_int("o_custkey").cast("bigint").alias("h"))


@query(_sql_xxh64())
def hash_xxh64_bytes(spark, sf_dir):
    """The hash of the eight bytes of each key."""
    return table(spark, sf_dir, "orders").select("o_orderkey", H.xxh64(B.set_long(B.zeros(8), 0, F.col("o_orderkey"))).alias("h"))


@query(_sql_murmur_int())
def hash_murmur32_bytes(spark, sf_dir):
    """The hash of the four bytes of each key."""
    return table(spark, sf_dir, "orders").select("o_orderkey", H.murmur3_32(B.set_int(B.zeros(4), 0, F.col("o_custkey").cast("int"))).cast("bigint").alias("h"))


@query(
    f"SELECT item_id, CASE WHEN h >= {1 << 63}::UHUGEINT THEN (h::HUGEINT - {1 << 64}::HUGEINT)::BIGINT ELSE h::BIGINT END AS h FROM (SELECT item_id,"
    f" list_reduce(list_prepend({0xCBF29CE484222325}::UHUGEINT, list_transform(range(1, length(text) + 1), lambda i: unicode(substring(text, i::int, 1))::UHUGEINT)), lambda a, b: (xor(a, b) * {0x100000001B3}::UHUGEINT) % {1 << 64}::UHUGEINT) AS h"
    " FROM benchmark WHERE strlen(text) = length(text))"
)
def hash_fnv64(spark, sf_dir):
    """Of ASCII texts, whose bytes SQL can name."""
    items = table(spark, sf_dir, "benchmark").where(F.octet_length("text") == F.length("text"))
    return items.select("item_id", H.fnv_hash64("text").alias("h"))


@query()
def hash_text(spark, sf_dir):
    """All families over whole texts."""
    b = raw()
    return table(spark, sf_dir, "documents").select(
        "doc_id", H.xxh64(b).alias("xxh64"), H.hash_code(b).alias("hash_code"), H.murmur3_32(b).alias("murmur32"), H.murmur3_128(b).alias("murmur128"), H.murmur3_hash64(b).alias("murmur64"), H.spooky_hash64(b).alias("spooky64"), H.spooky_hash32(b).alias("spooky32"), H.fnv_hash64(b).alias("fnv64")
    )


@query("SELECT o_custkey % 64 AS bucket, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def hash_buckets(spark, sf_dir):
    """Hashes as keys: the customers of 64 hash buckets, counted by what the buckets came from."""
    o = table(spark, sf_dir, "orders").select("o_custkey", H.xxh64_long("o_custkey").alias("h"))
    by = o.groupBy("h").agg(F.first("o_custkey").alias("k"), F.count("*").alias("n"))
    return by.groupBy(F.pmod("k", F.lit(64)).alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("customers"))


@query("SELECT conv_id, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM conversations GROUP BY conv_id")
def hash_chunks(spark, sf_dir):
    """The hash of each conversation's turns in order, where it's that of their concatenation."""
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(H.xxh64_chunks("turn", raw()).alias("h"), H.ordered_concat("turn", raw()).alias("b"), F.count("*").alias("n"))
    return own.where(F.col("h") == H.xxh64("b")).select("conv_id", "n", B.length("b").cast("bigint").alias("bytes"))


@query(
    "SELECT doc_id, 24 + 2 * (length(text) + len(list_filter(range(1, length(text) + 1), lambda i: unicode(substring(text, i::int, 1)) > 65535))) AS s, (16 + strlen(text) + 7) // 8 * 8 AS b,"
    " ((16 + 4 * 3 + 7) // 8 * 8 + 3 * 16)::BIGINT AS l, 24::BIGINT AS o FROM documents WHERE doc_id < 300"
)
def size_estimates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id < 300")
    three = F.array(F.lit(1), F.lit(2), F.lit(3))
    return d.select("doc_id", Z.estimated_size_of_string("text").alias("s"), Z.size_of(raw(), "binary").alias("b"), Z.estimated_size_of_list(three, lambda x: Z.size_of_boxed(x, "int")).alias("l"), Z.size_of_optional("doc_id", "long").alias("o"))

import random

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside; tables may have them as well.
CLASHES = "i t s k u p id fp node shard bucket group_id keep_id root count n w e source_key path votes host paths text_ segment chunk __gone __n rank list block".split()


def table(spark, rows, schema="doc_id bigint, text string, lang string, source string"):
    """The rows with further columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, schema)
    for c in CLASHES:
        if c not in df.columns:
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("x"))
    return df


def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    long = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta"]) + str(i % 997) for i in range(40_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a"), (2, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a"), (3, None, "en", "a"), (4, "", None, "b"), (5, "", "de", None),
        (None, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a"), (None, None, None, None), (6, long, "en", "b"), (7, "x" * 300_000, "en", "b"),
        (8, "\n \t", "fr", "b"), (9, "12 34 %% --", "fr", None), (10, "日本語 のテキスト \U0001f600", "de", "c"), (11, "der hund läuft schnell über die straße und die brücke", "de", "c"),
    ]
    return table(spark, rows)


def empty(spark):
    return table(spark, [])


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")

"""Packing documents into batches of equal token budget, by length buckets whose boundaries are optimal for the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from byteloom._ship import by_value
from byteloom.llm.common import small, table

by_value(__name__)

BUCKETS, TOKEN_BUDGET = 16, 8192
#: Documents of one numbered run, about.
RUN = 65_536


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """The upper lengths of at most ``buckets`` buckets that minimise the padding, each document padded to its bucket's upper length.

    Dynamic programming over the sorted distinct lengths: with C and S the cumulated documents and tokens, a bucket of the lengths i+1..j costs len[j] * (C[j] - C[i]) - (S[j] - S[i]).
    As a function of len[j] each i is a line of slope -C[i], so the best i of every j comes from a hull of lines: buckets x lengths steps."""
    rows = sorted((n, c) for n, c in histogram if c > 0)
    if not rows:
        return []
    lens = [n for n, _ in rows]
    cum, tok = [0], [0]
    for n, c in rows:
        cum.append(cum[-1] + c)
        tok.append(tok[-1] + n * c)
    m = len(rows)
    best: list[float] = [0.0] + [float("inf")] * m
    back = []
    for _ in range(min(buckets, m)):
        new: list[float] = [float("inf")] * (m + 1)
        new[0] = 0.0
        came = [0] * (m + 1)
        hull: list[int] = []  # of line i: value(x) = best[i] + S[i] - C[i] * x; slopes fall
        at = 0

        def value(i, x):
            return best[i] + tok[i] - cum[i] * x

        for j in range(1, m + 1):
            i = j - 1
            if best[i] < float("inf"):
                while len(hull) > 1:
                    a, b = hull[-2], hull[-1]
                    # b is never best if the crossing of a and i comes no later than that of a and b
                    if (value(i, 0) - value(a, 0)) * (cum[b] - cum[a]) <= (value(b, 0) - value(a, 0)) * (cum[i] - cum[a]):
                        hull.pop()
                    else:
                        break
                hull.append(i)
                at = min(at, len(hull) - 1)
            x = lens[j - 1]
            while at + 1 < len(hull) and value(hull[at + 1], x) <= value(hull[at], x):
                at += 1
            if hull:
                came[j] = hull[at]
                new[j] = value(hull[at], x) + x * cum[j] - tok[j]
        back.append(came)
        best = new
    out, j = [], m
    for came in reversed(back):
        if j == 0:
            break
        out.append(lens[j - 1])
        j = came[j]
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, pad_to, batch, slot) of every row.

    Tokens are runs of what isn't white space. Buckets are numbered by length from 0; pad_to is a bucket's longest length. A batch of a bucket holds
    max(1, token_budget // pad_to) documents in slots from 0, so that batches keep the budget, but for a document that is longer than the budget, which is alone in its batch.
    Only the last batch of a bucket may have empty slots. Null and empty texts have 0 tokens, and a bucket of length 0 is counted as length 1 against the budget.
    Repeated rows each have a slot. A null id stays null. Other columns are ignored; an empty table gives an empty one."""
    if buckets < 1 or token_budget < 1:
        raise ValueError("buckets and token_budget must be at least 1")
    lens = table(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("n_tokens")))
    histogram = [(r.n_tokens, r["count"]) for r in lens.groupBy("n_tokens").count().collect()]  # as many rows as there are lengths
    tops = boundaries(histogram, buckets) or [0]
    bucket, pad, per = F.lit(len(tops) - 1), F.lit(tops[-1]), F.lit(max(1, token_budget // max(1, tops[-1])))
    for b in range(len(tops) - 2, -1, -1):
        here = F.col("n_tokens") <= tops[b]
        bucket, pad, per = F.when(here, b).otherwise(bucket), F.when(here, tops[b]).otherwise(pad), F.when(here, max(1, token_budget // max(1, tops[b]))).otherwise(per)
    runs = max(1, -(-sum(c for _, c in histogram) // RUN))
    placed = lens.select("doc_id", "n_tokens", bucket.cast("int").alias("bucket"), pad.cast("bigint").alias("pad_to"), per.cast("bigint").alias("per"), F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(runs)).alias("run"))
    # a bucket's documents are numbered run by run: the runs' sizes, summed up, are where each starts
    starts = placed.groupBy("bucket", "run").agg(F.count("*").alias("k")).withColumn("start", F.sum("k").over(Window.partitionBy("bucket").orderBy("run")) - F.col("k")).drop("k")
    ranked = placed.withColumn("rn", F.row_number().over(Window.partitionBy("bucket", "run").orderBy("doc_id", "n_tokens")) - 1)
    place = F.col("start") + F.col("rn")
    return ranked.join(small(starts, runs * len(tops), 32), ["bucket", "run"]).select("doc_id", "n_tokens", "bucket", "pad_to", F.floor(place / F.col("per")).cast("bigint").alias("batch"), F.pmod(place, F.col("per")).cast("bigint").alias("slot"))

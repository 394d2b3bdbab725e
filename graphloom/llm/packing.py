"""Packing: optimal length buckets from the global histogram, token-budget batches inside."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, n_words, table, text_of

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Lengths below this are histogram bins of their own; above, a power of two has FINE bins.
EXACT, FINE = 65_536, 4_096
#: About as many rows are ordered in one task.
ROWS_A_SHELF = 20_000


def length_bin(length: Column) -> Column:
    """The histogram bin: the length itself, or from EXACT on rounded up to a multiple of 2**k.

    A bin is at most 1/FINE longer than the lengths in it, and the number of bins is bounded by
    EXACT + FINE * log2(longest / EXACT) for any corpus.
    """
    k = F.floor(F.log2(F.greatest(length, F.lit(EXACT)))) - F.lit(FINE.bit_length() - 1)
    step = F.pow(F.lit(2.0), k).cast("long")
    return F.when(length < EXACT, length).otherwise(F.ceil(length / step) * step).cast("long")


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """The at most ``buckets`` upper bounds with least padding over (length, documents) pairs.

    cost(i, j) of one bucket for the lengths i+1..j is length[j] * documents - tokens. With prefix
    sums the best last cut is a minimum over lines in length[j]; slopes fall and lengths rise, so
    a hull finds it in constant amortised time: O(buckets * lengths), in exact integers.
    """
    pairs = sorted((n, c) for n, c in histogram if c > 0)
    if not pairs:
        return []
    lengths = [n for n, _ in pairs]
    docs, tokens = [0], [0]
    for n, c in pairs:
        docs.append(docs[-1] + c)
        tokens.append(tokens[-1] + n * c)
    m = len(pairs)
    best: list[int | None] = [0] + [None] * m
    back: list[list[int]] = []
    for _ in range(min(buckets, m)):
        new: list[int | None] = [None] * (m + 1)
        came = [0] * (m + 1)
        hull: list[int] = []
        at = 0

        def line(i: int, x: int, best=best) -> int:
            return best[i] + tokens[i] - x * docs[i]

        def useless(a: int, b: int, c: int, best=best) -> bool:
            """Line b is nowhere below both a and c (slopes -docs fall from a to c)."""
            ya, yb, yc = (best[i] + tokens[i] for i in (a, b, c))
            return (yc - ya) * (docs[b] - docs[a]) <= (yb - ya) * (docs[c] - docs[a])

        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None:
                while len(hull) - at >= 2 and useless(hull[-2], hull[-1], i):
                    hull.pop()
                hull.append(i)
            x = lengths[j - 1]
            while at + 1 < len(hull) and line(hull[at + 1], x) <= line(hull[at], x):
                at += 1
            if at < len(hull):
                new[j] = line(hull[at], x) + x * docs[j] - tokens[j]
                came[j] = hull[at]
        back.append(came)
        best = new
        if best[m] == 0:
            break
    out, j = [], m
    for came in reversed(back):
        out.append(lengths[j - 1])
        j = came[j]
        if j == 0:
            break
    return out[::-1]


def padding(histogram: list[tuple[int, int]], bounds: list[int]) -> int:
    return sum((bounds[bisect_left(bounds, n)] - n) * c for n, c in histogram)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """For each row: doc_id, length, bucket, bucket_length, batch, slot, padding.

    length is the number of words; null and empty texts have length 0 and are packed like others.
    Bucket bounds minimise the total padding exactly over the histogram's bins. A batch of a
    bucket holds max(1, budget // bucket_length) documents (bucket_length 0: budget of them), in
    hash-random order, so that its padded tokens stay within the budget; only a document longer
    than the budget is a batch of its own. batch counts from 0 inside a bucket, slot inside a
    batch. Rows that share an id are rows of their own, in any order among themselves. An empty
    table gives an empty result.

    A row's rank in its bucket is the start of its shelf plus its place on it. Shelves are ranges
    of the hash, about ROWS_A_SHELF rows each, so no task orders a whole bucket.
    """
    rows = cut(
        docs.select(F.col(id_col).alias("doc_id"), n_words(text_of(text_col)).alias("length")).withColumn(
            "hash", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
        ),
        "pack-rows",
    )
    binned = rows.withColumn("bin", length_bin(F.col("length")))
    histogram = [(r[0], r[1]) for r in binned.groupBy("bin").count().collect()]
    bounds = optimal_boundaries(histogram, buckets)
    if not bounds:
        bounds = [0]
    shelves = max(1, sum(c for _, c in histogram) // (ROWS_A_SHELF * len(bounds)))
    bucket = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("bin") <= bounds[k], k).otherwise(bucket)
    binned = binned.withColumn("bucket", bucket).withColumn("shelf", F.pmod(F.shiftrightunsigned("hash", 20), F.lit(shelves)))
    counts = binned.groupBy("bucket", "shelf").count()
    before = Window.partitionBy("bucket").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "shelf", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    on_shelf = Window.partitionBy("bucket", "shelf").orderBy("hash", "doc_id", "length")
    ranked = binned.withColumn("place", F.row_number().over(on_shelf) - 1).join(starts, ["bucket", "shelf"])
    size = F.get(F.array(*map(F.lit, map(int, bounds))), F.col("bucket")).cast("long")
    fit = F.when(F.col("bucket_length") == 0, budget).otherwise(F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length"))))
    ranked = ranked.withColumn("rank", F.col("start") + F.col("place")).withColumn("bucket_length", size)
    ranked = ranked.withColumn("fit", fit.cast("long"))
    return ranked.select(
        "doc_id",
        "length",
        "bucket",
        "bucket_length",
        F.floor(F.col("rank") / F.col("fit")).alias("batch"),
        F.pmod("rank", "fit").alias("slot"),
        (F.col("bucket_length") - F.col("length")).alias("padding"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack on documents."""
    return pack(table(spark, sf_dir, "documents"))

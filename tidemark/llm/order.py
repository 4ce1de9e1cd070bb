"""Neighbours in the order of doc_id without a global sort in one task.

Quantiles of doc_id (a bounded list) cut the ids into buckets. Where there are too many rows for that list, the quantiles
within each bucket cut it again, so buckets hold about ROWS_PER_BUCKET rows up to MAX_BUCKETS ** 2 of them. Each bucket's
first rows also go to the bucket before it as guests, and the very first rows to the last bucket, so a window within a
bucket sees every row's successor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_BUCKET = 500
MAX_BUCKETS = 4096
LOWEST = -(1 << 63)


def bounds(docs: DataFrame, id_col: str = "doc_id", rows_per_bucket: int = ROWS_PER_BUCKET) -> list[int]:
    """The least id of each bucket, ascending; at most MAX_BUCKETS of them. Null ids come first."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    n, least = docs.agg(F.count(F.lit(1)), F.min(key)).first()
    if not n:
        return []
    k = min(MAX_BUCKETS, math.ceil(n / rows_per_bucket))
    if k == 1:
        return [least]
    cuts = docs.agg(F.percentile_approx(key, [i / k for i in range(1, k)], 20 * k)).first()[0]
    return sorted({least, *cuts})


def finer(docs: DataFrame, cuts: list[int], id_col: str = "doc_id", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame | None:
    """_own, _inner (ascending ids that cut a bucket of `cuts` again) and _before (how many parts the bucket before has),
    a row for each bucket; None if the buckets are small enough as they are."""
    n = docs.count()
    m = min(MAX_BUCKETS, math.ceil(n / (rows_per_bucket * max(len(cuts), 1))))
    if len(cuts) < MAX_BUCKETS or m == 1:
        return None
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    placed = docs.select(key.alias("_key")).withColumn("_own", bucket_of(F.col("_key"), cuts))
    inner = F.array_sort(F.array_distinct(F.percentile_approx("_key", [i / m for i in range(1, m)], 20 * m)))
    found = placed.groupBy("_own").agg(inner.alias("_inner"), F.min("_key").alias("_least"))
    found = found.withColumn("_inner", F.filter("_inner", lambda x: x > F.col("_least"))).drop("_least")
    parts = F.size("_inner") + 1
    # MAX_BUCKETS rows
    return found.withColumn("_before", F.coalesce(F.lag(parts).over(Window.orderBy("_own")), F.lit(1)))


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """Index of the last cut that isn't above the key, by binary search in a literal array."""
    steps = [1 << i for i in reversed(range(max(1, (len(cuts) - 1).bit_length())))]
    held = F.lit(cuts) if len(cuts) > 1 else F.array(F.lit(cuts[0]))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), _reaching(held, key))


def _reaching(held: Column, key: Column):
    """A step by halving: on by `by` places if the value there isn't above the key."""

    def step(at, by):
        reaches = F.coalesce(F.get(held, at + by) <= key, F.lit(False))
        return F.when(reaches, at + by).otherwise(at)

    return step


PARTS = 1 << 20  # more than a bucket has parts


def with_guests(docs: DataFrame, cuts: list[int], id_col: str = "doc_id", inner: DataFrame | None = None) -> DataFrame:
    """docs with _key, _bucket and _guest: 0 for a bucket's own rows, 1 for those of the next bucket, 2 for the very
    first rows after the last. Order a bucket by (_guest, _key, ...). `inner`: what finer() gives."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    placed = docs.withColumn("_key", key).withColumn("_own", bucket_of(F.col("_key"), cuts))
    least = F.get(F.lit(cuts) if len(cuts) > 1 else F.array(F.lit(cuts[0])), F.col("_own"))
    if inner is None:
        starts, bucket, before = least == F.col("_key"), F.col("_own"), F.col("_own") - 1
        final = F.lit(len(cuts) - 1)
    else:
        last = inner.filter(F.col("_own") == len(cuts) - 1).select(F.size("_inner").alias("k")).first()["k"]
        placed = placed.join(inner, "_own")
        # how many inner cuts aren't above the key
        steps = F.array(*(F.lit(1 << i) for i in reversed(range(MAX_BUCKETS.bit_length()))))
        reach = _reaching(F.concat(F.array(F.lit(LOWEST)), F.col("_inner")), F.col("_key"))
        placed = placed.withColumn("_part", F.aggregate(steps, F.lit(0), reach))
        starts = F.when(F.col("_part") == 0, least).otherwise(F.get("_inner", F.col("_part") - 1)) == F.col("_key")
        # bucket numbers go beyond 32 bits
        own, parts = F.col("_own").cast("long"), F.lit(PARTS).cast("long")
        bucket = own * parts + F.col("_part")
        before = F.when(F.col("_part") > 0, bucket - 1).otherwise((own - 1) * parts + F.col("_before") - 1)
        final = F.lit((len(cuts) - 1) * PARTS + last)
    wide = "long" if inner is not None else "int"

    def place(b: Column, g: int) -> Column:
        return F.struct(b.cast(wide).alias("b"), F.lit(g).alias("g"))

    first = (F.col("_own") == 0) & ((F.col("_part") == 0) if inner is not None else F.lit(True))
    wraps = F.when(first, place(final, 2)).otherwise(place(before, 1))
    own = place(bucket, 0)
    dealt = placed.withColumn("_at", F.explode(F.when(starts, F.array(own, wraps)).otherwise(F.array(own))))
    return dealt.withColumns({"_bucket": F.col("_at.b"), "_guest": F.col("_at.g")}).drop("_at", "_own", *(("_inner", "_before", "_part") if inner is not None else ()))

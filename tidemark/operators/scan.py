"""Running values over an order of all rows, without all rows in one task.

Rows go to buckets along the order's first column. Windows run within buckets, and what comes before (or behind) a
bucket is added from a table of one row a bucket. That table is joined by the bucket that the rows are dealt out by
already, so that it needs no broadcast, however many buckets there are.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the buckets of a scan by arrival number: so many rows a task.
ROWS = 131_072

#: Buckets of a scan by quantiles, at most; beyond some 10^9 rows they get larger instead of more.
BUCKETS = 8_192

#: Width of the buckets of a scan by watermark: an hour. Watermarks differ by a millisecond at least.
SPAN_MS = 3_600_000


def by_width(df: DataFrame, col: str, width: int) -> DataFrame:
    """Adds _bucket: grows with col, and equal values share one. Null values come first, as in an ascending order."""
    return df.withColumn("_bucket", F.coalesce(F.floor(F.col(col) / width), F.lit(-(2**62))))


def by_quantiles(df: DataFrame, col: str, rows: int = ROWS) -> DataFrame:
    """As by_width, for values of unknown spread: of rows rows each, which takes a count and a sketch of the column."""
    wanted = min(BUCKETS, -(-df.count() // rows))
    bounds = sorted(set(df.approxQuantile(col, [i / wanted for i in range(1, wanted)], 0.2 / wanted))) if wanted > 1 else []
    if not bounds:
        return df.withColumn("_bucket", F.lit(0))
    found = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_at", outputCol="_bucket", handleInvalid="keep")
    rows_ = found.transform(df.withColumn("_at", F.col(col).cast("double"))).drop("_at")
    # Null values come first, as in an ascending order.
    return rows_.withColumn("_bucket", F.when(F.col(col).isNull(), -1).otherwise(F.col("_bucket").cast("int")))


def numbered(df: DataFrame, order: list[str], name: str, bucket_rows: int = ROWS) -> DataFrame:
    """Adds the row's number from 0 in the order given."""
    rows = by_quantiles(df, order[0], bucket_rows)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a bucket
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return rows.withColumn("_i", inside).join(starts, "_bucket").withColumn(name, F.col("_start") + F.col("_i") - 1).drop("_bucket", "_i", "_start")


def max_before(df: DataFrame, order: str, values: dict[str, Column], width: int = ROWS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds, under each name, the largest value of the rows (of the same keys) before this one; null for the first."""
    rows = by_width(df, order, width).withColumns({f"_v_{n}": v for n, v in values.items()})
    tops = rows.groupBy("_bucket", *keys).agg(*(F.max(f"_v_{n}").alias(f"_t_{n}") for n in values))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_bucket", *keys, *(F.max(f"_t_{n}").over(before).alias(f"_b_{n}") for n in values))  # a row a bucket
    inside = Window.partitionBy("_bucket", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_i_{n}": F.max(f"_v_{n}").over(inside) for n in values})
    rows = rows.join(tops.withColumnsRenamed({k: f"_k_{k}" for k in keys}), [rows["_bucket"] == tops["_bucket"], *(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)])
    return rows.select(*(rows[c] for c in df.columns), *(F.greatest(f"_i_{n}", f"_b_{n}").alias(n) for n in values))


def next_at_least(left: DataFrame, key: str, right: DataFrame, right_key: str, payload: str, name: str, width: int) -> DataFrame:
    """Adds to left the payload of the right row with the smallest key not below left's; null if there's none.

    Payloads have to grow with their keys, so that the smallest payload is that of the smallest key.
    """
    cols = left.columns
    rows = left.select(F.col(key).alias("_key"), F.lit(None).cast("bigint").alias("_p"), F.struct(*cols).alias("_row"))
    given = right.select(F.col(right_key).cast("bigint").alias("_key"), F.col(payload).cast("bigint").alias("_p"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    both = by_width(rows.unionByName(given), "_key", width)
    lows = both.groupBy("_bucket").agg(F.min("_p").alias("_low"))
    # From the end backwards: a frame that only grows is one pass, one that shrinks is a pass a row.
    behind = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    lows = lows.select(F.col("_bucket"), F.min("_low").over(behind).alias("_behind"))  # a row a bucket
    inside = F.min("_p").over(Window.partitionBy("_bucket").orderBy(F.desc("_key")).rangeBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("_inside", inside).where(F.col("_row").isNotNull()).join(lows, "_bucket")
    return met.select("_row.*", F.least("_inside", "_behind").alias(name))

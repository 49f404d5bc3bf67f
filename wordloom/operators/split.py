"""M1: exact, seeded, partition-independent train/test split.

Rows are ordered by a seeded hash ``h = first 60 bits of md5(seed ':' row_id)``
(ties by ``row_id``); the first ``floor(n * (1 - test_ratio))`` rows are the
training set, as in a seeded shuffle followed by a cut.  ``randomSplit`` is not
used: its sizes are inexact and depend on partitioning.

A global ``row_number`` would pull every row into one task.  Instead a
histogram over the top 16 hash bits (at most 65,536 rows — a proven bound, so it
is broadcast) gives, per bucket, the number of rows before it, and so the one
bucket that the last training row falls into; only that bucket (about n / 65,536
rows, uniform by construction) is ranked with a window, on keys alone. The last
training row's ``(hash, row_id)`` then decides every row in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 16


def shuffle_key(row: Column, seed: int) -> Column:
    """BIGINT seeded order key: the first 15 hex digits of md5(seed ':' row)."""
    h = F.md5(F.concat_ws(":", F.lit(str(int(seed))), row.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def duck_shuffle_key(row_sql: str, seed: int) -> str:
    return f"CAST(('0x' || substr(md5('{int(seed)}:' || CAST({row_sql} AS VARCHAR)), 1, 15)) AS BIGINT)"


def seeded_split(df: DataFrame, test_ratio: float = 0.2, seed: int = 42, row_col: str = "row_id") -> DataFrame:
    """Add ``shuffle_key`` and ``is_train`` (train = first floor(n*(1-ratio)) rows in hash order)."""
    if not 0.0 < test_ratio < 1.0:
        raise ValueError("test_ratio must be in (0, 1)")
    def keyed(d: DataFrame) -> DataFrame:
        return d.withColumn("shuffle_key", shuffle_key(F.col(row_col), seed))

    def bucket(d: DataFrame) -> DataFrame:
        return d.withColumn("_bucket", F.shiftright("shuffle_key", 60 - BUCKET_BITS).cast("int"))

    keys = bucket(keyed(df.select(row_col)))  # the cut needs no other column
    hist = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    everything = Window.partitionBy(F.lit(0))  # ≤ 65,536 rows: one small task
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    n_train = F.floor(F.sum("_cnt").over(everything) * F.lit(1.0 - float(test_ratio))).cast("long")
    hist = hist.select("_bucket", "_cnt", (n_train - F.coalesce(F.sum("_cnt").over(before), F.lit(0))).alias("_need"))
    hist = hist.where((F.col("_need") > 0) & (F.col("_need") <= F.col("_cnt")))  # the bucket of the last training row
    in_bucket = Window.partitionBy("_bucket").orderBy("shuffle_key", row_col)
    cut = keys.join(F.broadcast(hist), "_bucket").withColumn("_rn", F.row_number().over(in_bucket)).where("_rn = _need")
    cut = cut.select(F.lit(1).alias("_one"), F.col("shuffle_key").alias("_cut_key"), F.col(row_col).alias("_cut_row"))  # one row, or none
    out = keyed(df).withColumn("_one", F.lit(1)).join(F.broadcast(cut), "_one", "left")
    upto = (F.col("shuffle_key") < F.col("_cut_key")) | ((F.col("shuffle_key") == F.col("_cut_key")) & (F.col(row_col) <= F.col("_cut_row")))
    return out.withColumn("is_train", F.coalesce(upto, F.lit(False))).select(*df.columns, "shuffle_key", "is_train")


def duck_split_sql(base_sql: str, test_ratio: float = 0.2, seed: int = 42) -> str:
    """DuckDB twin: ``base_sql`` columns plus shuffle_key and is_train."""
    return f"""
SELECT *, rn <= floor(n * {1.0 - float(test_ratio)!r}) AS is_train FROM (
  SELECT *, row_number() OVER (ORDER BY shuffle_key, row_id) AS rn, count(*) OVER () AS n
  FROM (SELECT *, {duck_shuffle_key("row_id", seed)} AS shuffle_key FROM ({base_sql})))
"""

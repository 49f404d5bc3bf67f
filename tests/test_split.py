import math

import pytest

from wordloom.operators.split import seeded_split


@pytest.mark.parametrize("n", [0, 1, 5, 101])
def test_exact_sizes(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    rows = seeded_split(df, 0.2, 42).collect()
    assert len(rows) == n
    assert sum(r["is_train"] for r in rows) == int(math.floor(n * 0.8))


def test_partition_and_seed_stability(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    a = {r["row_id"] for r in seeded_split(df.repartition(1), 0.2, 7).where("is_train").collect()}
    b = {r["row_id"] for r in seeded_split(df.repartition(8), 0.2, 7).where("is_train").collect()}
    c = {r["row_id"] for r in seeded_split(df, 0.2, 8).where("is_train").collect()}
    assert a == b and len(a) == 400 and a != c


def test_rejects_bad_ratio(spark):
    with pytest.raises(ValueError):
        seeded_split(spark.range(3).withColumnRenamed("id", "row_id"), 1.0, 1)

import duckdb
import pytest
from pyspark.sql import functions as F

from wordloom.llm import mixing


def brute_targets(sizes, weights, cap):
    """Share by weight, stop at the cap, share the excess again until none is above."""
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        open_w = sum(w for i, w in enumerate(weights) if i not in full)
        for i, w in enumerate(weights):
            target[i] = cap * sizes[i] if i in full else rest * w / open_w
        above = {i for i in range(len(sizes)) if i not in full and target[i] > cap * sizes[i]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("sizes", [[10, 1000, 500, 4, 90], [5, 5, 5], [1, 100000], [7]])
def test_targets_against_resharing(spark, sizes):
    rows = [(0, f"s{i:02d}", n) for i, n in enumerate(sizes)]
    t = spark.createDataFrame(rows, "mix_null int, mix_src string, mix_total long")
    got = [r.mix_target for r in mixing.source_targets(t, (1, 2, 3), 3.0).orderBy("mix_src").collect()]
    assert got == pytest.approx(brute_targets(sizes, [1 + i % 3 for i in range(len(sizes))], 3.0))
    assert sum(got) == pytest.approx(sum(sizes))


def test_copies_follow_targets_and_rerun_alike(make_docs):
    rows = [(i, "w " * (i * 7 % 50 + 1), ("a", "b", "c", None)[i % 4] if i % 3 else "a") for i in range(3000)]
    d = mixing.copies(make_docs(rows))
    got = d.groupBy("source").agg(F.sum(F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.first("mix_target").alias("t"), F.max("mix_copies").alias("most")).collect()
    for r in got:
        assert r.taken == pytest.approx(r.t, abs=60)
        assert r.most <= 3
    key = lambda d: sorted((r.doc_id, r.mix_copies) for r in d.collect())
    assert key(d) == key(mixing.copies(make_docs(list(reversed(rows)))))


def test_mix_emits_each_copy(make_docs):
    d = mixing.mix(make_docs([(1, "a b c", "x"), (2, "a", "y"), (3, "a b", "y")]))
    n = {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.mix_copies for r in mixing.copies(make_docs([(1, "a b c", "x"), (2, "a", "y"), (3, "a b", "y")])).collect() if r.mix_copies}
    assert n == want


def test_edges(spark, make_docs, as_dir):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (None, "x y", None), (3, "x", "b"), (3, "x", "b"), (4, "p " * 5000, "é")]
    docs = make_docs(rows).withColumn("mix", F.lit(1)).withColumn("rate", F.lit(2))
    out = mixing.copies(docs)
    assert out.count() == len(rows) and set(docs.columns) < set(out.columns)
    assert mixing.copies(make_docs([])).count() == 0
    assert mixing.copies(make_docs([(1, None, None)])).collect()[0].mix_copies == 0
    sf = as_dir(documents=make_docs(rows))
    got = sorted(map(tuple, mixing.op1_mix(spark, sf).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    assert got == sorted(map(tuple, con.sql(mixing.OP1_SQL).fetchall()), key=repr)

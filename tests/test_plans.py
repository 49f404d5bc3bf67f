import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import compare, embed, freq
from wordloom.plans import classic, embedding


def _emb(spark, n=60):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.2, (n // 2, 6)), rng.normal(3, 0.2, (n // 2, 6))])
    rows = [(i, "a" if i < n // 2 else "b", f"text {i % 3} words here", x[i].astype(float).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, label string, text string, embedding array<double>")


def test_cluster_job_report_and_analyze(spark):
    spec = embedding.ClusterSpec("kmeans", {"n_clusters": 2, "n_init": 2}, 42, "pca", {}, 3)
    assign, meta = embedding.run_cluster(_emb(spark), spec)
    assert set(assign.columns) >= {"row_id", "label", "text", "reduced", "x", "y", "cluster_id"}
    rep = embedding.cluster_report(spec.run_id({}), assign, meta, {"provider": "local", "model": "m"}).first()
    top = rep["metrics"]["top_clusters"]
    assert len(top) == 2 and top[0]["accuracy"] == 1.0 and rep["config"]["cluster"]["algorithm"] == "KMeans" and rep["config"]["cluster"]["algorithm_id"] == "kmeans"
    ann = embedding.analyze(assign, n=2, top_k=2).collect()
    assert ann and all(8.0 <= r["font_size"] <= 14.0 for r in ann)


def test_default_algorithm_runs(spark):
    assign, meta = embedding.run_cluster(_emb(spark), embedding.ClusterSpec(dims=3))
    assert meta["cluster_algorithm"] == "HDBSCAN"
    assert len({r.cluster_id for r in assign.collect()} - {-1}) == 2


def test_pipelines_from_specs(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = {"ham": ["home", "dinner", "see", "later", "ok"], "spam": ["win", "prize", "cash", "claim", "now"]}
    lines = [f"{k}\t{' '.join(rng.choice(words[k], 12))} {i}" for i in range(60) for k in words]
    (tmp_path / "in.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    path = str(tmp_path / "in.txt")
    classic_spec = {"pipeline": ["words", "ngrams", "classifier"], "words": {"path": path, "top": 3}, "ngrams": {"path": path, "n": 2, "top": 3},
                    "classifier": {"path": path, "top_words": 50, "classifiers": ["nb", "svm", "logreg"]}}
    out = embedding.run_pipeline(spark, classic_spec, str(tmp_path / "classic"))
    assert list(out) == classic_spec["pipeline"] and out["words"].count() == 6
    doc = out["classifier"].first()
    assert (doc.train_size, doc.test_size) == (96, 24) and len(doc.results) == 3 and all(r.accuracy == 1.0 for r in doc.results)
    spec = {"pipeline": ["embeddings", "cluster", "visualize", "analyze"], "embeddings": {"path": path, "provider": "local", "model": "h", "batch_size": 16},
            "cluster": {"algorithm": "kmeans", "params": {"n_clusters": 2, "n_init": 2}, "reduce": {"algorithm": "svd", "dims": 4}},
            "visualize": {"coords_source": "reduce", "reduce": {"algorithm": "pca"}}, "analyze": {"n": 1, "top_k": 2, "remove_stopwords": False}}
    out = embedding.run_pipeline(spark, spec, str(tmp_path / "emb"), {"local": embed.LocalHashEmbedder(16, 3)})
    assert out["cluster"].count() == out["visualize"].count() == 120 and out["analyze"].count() == 4
    report, = compare.read_reports(spark, str(tmp_path / "emb" / "reports")).collect()
    assert report.config.embeddings.num_messages == 120 and report.config.embeddings.source_path == path
    tsv = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "emb" / "assignments" / "*"))
    assert tsv.columns == ["label", "cluster", "x", "y", "text"] and tsv.count() == 120
    with pytest.raises(ValueError, match="unknown steps"):
        embedding.run_pipeline(spark, {"pipeline": ["plot"]}, str(tmp_path))
    with pytest.raises(ValueError, match="no embedder"):
        embedding.run_pipeline(spark, spec, str(tmp_path / "none"))


def test_sweep_ids_do_not_collide(spark, tmp_path):
    specs = [embedding.ClusterSpec("kmeans", {"n_clusters": k, "n_init": 1}, 42, "pca", {}, 3) for k in (2, 3)]
    emb = _emb(spark)
    flat = embedding.run_sweep(spark, [(emb, {"provider": "openai"}), (emb, {"provider": "gemini"})], specs, str(tmp_path / "s")).collect()
    assert len(flat) == 4 and len({r.report_path for r in flat}) == 4
    compare.write_comparison(compare.flatten(compare.read_reports(spark, str(tmp_path / "s" / "reports"))), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert tuple(back.columns) == compare.COMPARISON_COLUMNS and back.count() == 4


def test_very_large_conversation_ids(spark):
    from wordloom.sources import text

    key = text.conversation_key(F.col("conv_id"), F.col("turn"))
    df = spark.createDataFrame([(10**18, 5, "user", "b a"), (10**18, 4, "user", "a b")], "conv_id long, turn long, role string, text string")
    got = freq.top_words_by_label(df.select(key.alias("row_id"), F.col("role").alias("label"), "text"), k=1).first()
    assert got.item == "a" and got.cnt == 2


def test_results_document(spark):
    df = spark.createDataFrame([(i, "toxic" if i % 4 == 0 else "clean", "bad words" if i % 4 == 0 else "nice text")
                                for i in range(40)], "row_id long, label string, text string")
    p = classic.prepare(df, 0.25, 42, 50)
    m = classic.compare_classifiers(p, ["naive_bayes"], "toxic")
    doc = classic.results_document(p, m, 50, False, 42).first()
    assert (doc["train_size"], doc["test_size"]) == (30, 10)
    assert doc["results"][0]["classifier_name"] == "Naive Bayes" and doc["results"][0]["accuracy"] == 1.0


def test_top_k_partition_invariant(spark):
    rows = [(i, "x" if i % 2 else "y", " ".join(f"w{(i * j) % 7}" for j in range(9))) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id long, label string, text string")
    a = freq.top_words_by_label(df.repartition(1), k=4).orderBy("label", "rank").collect()
    b = freq.top_words_by_label(df.repartition(7), k=4).orderBy("label", "rank").collect()
    assert a == b

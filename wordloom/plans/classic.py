"""Classic pipeline (P5 steps ``words``, ``ngrams``, ``classifier``; M6 comparison).

One tokenized DataFrame feeds every step; it is persisted because the split,
the vocabulary, the features and each model read it again.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import tokens
from ..operators import classify, features, freq, naive_bayes, split, svm


@dataclass
class Prepared:
    rows: DataFrame    # row_id, label, shuffle_key, is_train, tokens
    vocab: DataFrame   # term, cnt, freq_rank, feature_index
    bow: DataFrame     # row_id, term, feature_index, label, is_train
    labels: list[str]  # of the training rows, sorted
    n_train: int
    n_test: int

    def release(self) -> None:
        """Drop what ``prepare`` holds in memory."""
        self.rows.unpersist()
        self.vocab.unpersist()


def prepare(df: DataFrame, test_ratio: float = 0.2, seed: int = 42, top_words: int = 2000,
            stopwords=None, persist: bool = True) -> Prepared:
    """M1 + T1/T2 + A4 + T7 over ``row_id, label, text``."""
    rows = split.seeded_split(df.select("row_id", "label", "text"), test_ratio, seed)
    rows = rows.select("row_id", "label", "shuffle_key", "is_train", tokens("text", stopwords).alias("tokens"))
    if persist:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    vocab = features.vocabulary(rows.where("is_train"), top_words)
    if persist:
        vocab = vocab.persist(StorageLevel.MEMORY_AND_DISK)
    bow = features.bow_long(rows, vocab, carry=("label", "is_train"))
    sizes = rows.groupBy("is_train", "label").count().collect()  # two rows for each label
    n_train = sum(int(r["count"]) for r in sizes if r["is_train"])
    n_test = sum(int(r["count"]) for r in sizes if not r["is_train"])
    labels = sorted(r["label"] for r in sizes if r["is_train"])
    return Prepared(rows, vocab, bow, labels, n_train, n_test)


def naive_bayes_model(p: Prepared) -> DataFrame:
    return naive_bayes.fit(p.bow.where("is_train"), p.rows.where("is_train").select("row_id", "label"), p.vocab)


ROWS_PER_TASK = 5_000  # of a linear model's training vectors


def vectors(p: Prepared) -> tuple[DataFrame, DataFrame]:
    """Training and test vectors; the former persisted, as every iteration reads them, in as many partitions as they fill."""
    vec = features.bow_vectors(p.rows, features.vocab_terms(p.vocab)).select("row_id", "label", "is_train", "features")
    train = vec.where("is_train").coalesce(max(1, -(-p.n_train // ROWS_PER_TASK)))
    return train.persist(StorageLevel.MEMORY_AND_DISK), vec.where(~F.col("is_train"))


def predictions(p: Prepared, classifier_id: str, nb_params: DataFrame | None = None, vecs: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``row_id, label, predicted`` on the test rows for one classifier."""
    cid = classify.normalize_classifier_id(classifier_id)
    if cid == "naive_bayes":
        test = p.rows.where(~F.col("is_train")).select("row_id", "label")
        params = nb_params if nb_params is not None else naive_bayes_model(p)
        pred = naive_bayes.predict(params, p.bow.where(~F.col("is_train")), test)
        return test.join(pred, "row_id", "left").select("row_id", "label", "predicted")
    train, test = vecs or vectors(p)
    try:
        return classify.fit_predict_linear(train, test, cid, p.labels, p.n_train)
    finally:
        if vecs is None:
            train.unpersist()


def linear_residuals(p: Prepared, classifier_id: str) -> DataFrame:
    """``term, gradient`` of a fitted two-label linear model over the vocabulary and the intercept (null term)."""
    cid = classify.normalize_classifier_id(classifier_id)
    if len(p.labels) != 2:
        raise ValueError("the gradient is that of a model of two labels")
    train, _ = vectors(p)
    try:
        if cid == "svm":
            fitted = svm.fit(train, p.labels).weights[0]
        else:
            model = classify.fit_logistic(train, p.labels, p.n_train)
            fitted = [*model.coefficients.toArray(), model.intercept]
    finally:
        train.unpersist()
    pairs = zip([*features.vocab_terms(p.vocab), None], map(float, fitted), strict=True)
    weights = p.rows.sparkSession.createDataFrame(list(pairs), "term string, weight double")
    rows = p.rows.where("is_train").select("row_id", "label")
    return classify.residual_gradient(p.bow.where("is_train").select("row_id", "term"), rows, weights, p.labels[1], cid)


def compare_classifiers(p: Prepared, classifier_ids: Sequence[str], positive_label: str) -> DataFrame:
    """M6: one metrics row per classifier (``classifier_id, classifier_name, accuracy, …, train_size, test_size``)."""
    ids = [classify.normalize_classifier_id(c) for c in classifier_ids]
    vecs = vectors(p) if set(ids) - {"naive_bayes"} else None
    # model fits are independent (and eager): run them side by side
    with ThreadPoolExecutor(max_workers=max(1, len(ids))) as pool:
        parts = list(pool.map(lambda cid: predictions(p, cid, vecs=vecs).withColumn("classifier_id", F.lit(cid)), ids))
    if vecs:
        vecs[0].unpersist()
    preds = parts[0]
    for one in parts[1:]:
        preds = preds.unionByName(one)
    m = classify.confusion_metrics(preds, positive_label)
    names = F.create_map(*[x for k, v in classify.CLASSIFIER_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return m.select(
        "classifier_id",
        names[F.col("classifier_id")].alias("classifier_name"),
        "accuracy", "precision", "recall", "f1", "correct", "total",
        F.lit(p.n_train).cast("long").alias("train_size"),
        F.lit(p.n_test).cast("long").alias("test_size"),
    )


def results_document(p: Prepared, metrics: DataFrame, top_words: int, remove_stopwords: bool, seed: int) -> DataFrame:
    """K1: one row ``train_size, test_size, top_words, remove_stopwords, seed, results[]`` for ``write.json``."""
    res = metrics.agg(F.collect_list(F.struct(
        "classifier_id", "classifier_name", "accuracy", "precision", "recall", "f1",
        "correct", "total", "train_size", "test_size")).alias("results"))  # one row per classifier: bounded
    return res.select(
        F.lit(p.n_train).cast("long").alias("train_size"),
        F.lit(p.n_test).cast("long").alias("test_size"),
        F.lit(int(top_words)).cast("long").alias("top_words"),
        F.lit(bool(remove_stopwords)).alias("remove_stopwords"),
        F.lit(int(seed)).cast("long").alias("seed"),
        "results",
    )


def word_step(df: DataFrame, top: int = 25, stopwords=None, labels=None) -> DataFrame:
    return freq.top_words_by_label(df, k=top, stopwords=stopwords, labels=labels)


def ngram_step(df: DataFrame, n: int = 2, top: int = 25, stopwords=None, labels=None) -> DataFrame:
    return freq.top_ngrams_by_label(df, n=n, k=top, stopwords=stopwords, labels=labels)

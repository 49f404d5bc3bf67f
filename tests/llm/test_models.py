import numpy as np
from pyspark.sql import functions as F

from wordloom.llm import imatch, langid, quality
from wordloom.llm.common import held_out

SF = "/root/testdata/sf0.01"


# --------------------------------------------------------- quality (3)
def test_pairwise_sum_against_all_pairs():
    rng = np.random.default_rng(0)
    n = quality.SLOTS + len(quality.STATS) * quality.STEPS
    model = {"w0": np.array([0.3], np.float32), "w": rng.normal(size=n).astype(np.float32), "v": rng.normal(size=(n, quality.FACTORS)).astype(np.float32)}
    rows = [quality.features(t, 5) for t in ("a b c a", "", None, "Words AND 123 $$$\nlines\nlines", "x " * 3000)]
    for (idx, x), got in zip(rows, quality.raw_scores(model, rows), strict=True):
        want = model["w0"][0] + (model["w"][idx] * x).sum()
        want += sum(float(model["v"][i] @ model["v"][j]) * a * b for p, (i, a) in enumerate(zip(idx, x, strict=True)) for j, b in list(zip(idx, x, strict=True))[:p])
        assert abs(got - want) < 1e-3


def test_quality_held_out_accuracy(spark):
    d = quality.op3_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (d.predicted == d.quality).mean() > 0.97 and (d[d.quality == 1].predicted == 1).mean() > 0.98


def test_quality_edges(spark, make_docs):
    rows = [(i, ("good words here " * 9 + str(i)) if i % 2 else "JUNK!! " * 30) for i in range(60)] + [(100, None), (101, ""), (102, "long " * 50_000), (None, "x"), (100, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs(rows).withColumn("score", F.lit("s")).withColumn("y", F.lit(3))
    model = quality.train(spark, docs, labels)
    out = quality.score(docs, model, docs.columns, "fm")
    assert out.columns == [*docs.columns, "fm"] and out.count() == len(rows)
    assert out.where("fm < 0 or fm > 1 or fm is null").count() == 0
    got = {r.doc_id: r.fm for r in out.where("doc_id < 60").collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(60))
    again = quality.train(spark, docs.orderBy(F.desc("doc_id")), labels)
    assert all(np.array_equal(model[k], again[k]) for k in model)
    assert quality.score(make_docs([]), model, ["doc_id"]).count() == 0
    none = quality.score(docs, quality.train(spark, docs, labels.limit(0)), ["doc_id"])
    assert {round(r.score, 3) for r in none.collect()} == {0.5}
    kept = quality.accepted(spark, docs, labels)
    assert kept.columns == docs.columns


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = quality.train(spark, docs, labels)
    b = quality.train(spark, docs, labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert all(np.array_equal(a[k], b[k]) for k in a)


# --------------------------------------------------------- I-Match (5)
def test_imatch_against_brute_force(spark, make_docs, as_dir):
    import hashlib

    rng = np.random.default_rng(4)
    words = [f"t{i}" for i in range(300)]
    rows = [(int(i * 3 - 50), " ".join(rng.choice(words, rng.integers(0, 200)))) for i in range(120)]
    rows += [(None, "null id text"), (1000, None), (1001, ""), (1002, "é"), (1003, "v " * 40_000), (10, rows[20][1])]
    sf = as_dir(documents=make_docs(rows))
    got = imatch.op5_imatch(spark, sf).collect()
    assert len(got) == len(rows)
    lex = imatch.lexicon(spark, make_docs(rows))
    own = imatch.Fingerprinter(lex)
    order = sorted(((d is not None, d or 0, t or "", d) for d, t in rows))
    want = []
    for i, (_, _, t, d) in enumerate(order):
        nxt = order[(i + 1) % len(order)][2]
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), own(t), own(e), imatch.likeness(own(t), own(e)), imatch.likeness(own(t), own(nxt))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    df = {}
    for _, t in rows:
        for w in set(imatch._TERM.findall((t or "").lower())):
            df[w] = df.get(w, 0) + 1
    n = len(rows)
    assert len(lex) == sum(imatch.LOW * n <= c <= imatch.HIGH * n for c in df.values())


def test_imatch_tells_edits_from_others(spark):
    d = imatch.op5_imatch(spark, SF).toPandas()
    assert (d.near_edited > d.near_next).mean() > 0.95 and d.near_next.mean() < 0.05 and d.near_edited.mean() > 0.2


def test_imatch_edges(spark, make_docs, as_dir):
    one = imatch.op5_imatch(spark, as_dir(documents=make_docs([(1, "abcd efgh")]))).collect()
    assert one[0].n_chars == 9 and one[0].near_next == 1.0
    docs = make_docs([]).withColumn("slice", F.lit(1)).withColumn("at", F.lit(1))
    lex = imatch.lexicon(spark, docs)
    assert len(lex) == 0 and imatch.fingerprints(spark, docs, lex).count() == 0
    assert imatch.with_next(docs, lambda pairs: iter(()), "x int", 4).count() == 0


# --------------------------------------------------------- language (10)
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    d = langid.op10_langid(spark, SF).where("held_out").join(docs, "doc_id").toPandas()
    assert (d.lang == d.lang_pred).mean() > 0.97


def test_bundle_against_letters():
    """A bundle is the sum over all n-grams of the product of permuted letter vectors."""
    letters, _ = langid._vectors()
    codes = langid.ngram_codes("Ab, é a")
    sym = [0, 1, 2, 0, 27 + ord("é") % 37, 0, 1, 0]
    want = sum(letters[a] * np.roll(letters[b], 1) * np.roll(letters[c], 2) for a, b, c in zip(sym, sym[1:], sym[2:], strict=False))
    assert np.allclose(langid.bundle(*np.unique(codes, return_counts=True)), want)


def test_language_edges(spark, make_docs):
    rows = [(i, "the of and with this " * 3, None, "en") for i in range(20)] + [(i, "der und ist nicht ein " * 3, None, "de") for i in range(20, 40)]
    rows += [(50, None, None, "en"), (51, "", None, None), (52, "123 --- 456", None, "de"), (53, "X", None, None), (None, "the and", None, None), (54, "und nicht " * 30_000, None, None), (54, "日本語", None, None)]
    docs = make_docs(rows).withColumn("score", F.lit("x")).withColumn("code", F.lit(1))
    langs, protos = langid.prototypes(spark, docs)
    assert langs == ["de", "en"]
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.predict(docs, langs, protos).collect()}
    assert got[50, "und"] == got[51, "und"] == got[52, "und"] == 0.0
    assert all((i, "en" if i < 20 else "de") in got for i in range(40)) and (None, "en") in got and (54, "de") in got
    assert all(0 <= s <= 1 for s in got.values())
    assert langid.predict(make_docs([]), langs, protos).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, *langid.prototypes(spark, make_docs([]))).collect()} == {"und"}

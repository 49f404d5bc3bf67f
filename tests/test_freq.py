from wordloom.operators import freq


def test_ties_first_seen_and_k_above_distinct(spark):
    df = spark.createDataFrame(
        [(0, "ham", "b a"), (1, "ham", "a b c"), (2, "spam", "x"), (3, "other", "zzz")],
        "row_id long, label string, text string")
    top = freq.top_words_by_label(df, k=10, labels=["ham", "spam"]).orderBy("label", "rank").collect()
    assert [(r["label"], r["item"], r["cnt"]) for r in top] == [
        ("ham", "b", 2), ("ham", "a", 2), ("ham", "c", 1), ("spam", "x", 1)]


def test_bigrams_per_label(spark):
    df = spark.createDataFrame([(0, "ham", "a b a b"), (1, "ham", "a")], "row_id long, label string, text string")
    top = freq.top_ngrams_by_label(df, n=2, k=2).orderBy("rank").collect()
    assert [(r["item"], r["cnt"]) for r in top] == [("a b", 2), ("b a", 1)]


def _top_grams(rows, n, k):
    """Counted one by one; of equal counts the first by row and position, null rows first as in the window's order."""
    seen = {}
    for row, label, text in rows:
        words = text.split()
        for pos in range(len(words) - n + 1):
            key = (label, " ".join(words[pos:pos + n]))
            cnt, first = seen.get(key, (0, None))
            here = None if row is None else (row, pos)
            seen[key] = cnt + 1, here if first is None else first if here is None else min(first, here)
    out = {}
    for label in {x[0] for x in seen}:
        own = sorted((-cnt, first is not None, first or (), gram) for (x, gram), (cnt, first) in seen.items() if x == label)
        out[label] = [(gram, -cnt) for cnt, _, _, gram in own[:k]]
    return out


def test_ngrams_are_dealt_out_by_the_text(spark, monkeypatch):
    """As many tasks as the text needs, whatever the number of shuffle partitions; small parts in each."""
    import random

    rng = random.Random(5)
    monkeypatch.setattr(freq, "CHARS_PER_TASK", 400)
    monkeypatch.setattr(freq, "TOKENS", 30)
    monkeypatch.setattr(freq, "HELD", 30)
    rows = [(rng.randrange(150), rng.choice(["a", "b", None]), " ".join(rng.choice("pqrstuvw") for _ in range(rng.randint(0, 60)))) for _ in range(200)]
    rows += rows[:20] + [(None, "b", "p q x y")]
    df = spark.createDataFrame(rows, "row_id long, label string, text string").repartition(3)
    parts = -(-sum(len(r[2]) for r in rows) // 400)
    assert parts > 8
    for n in (2, 3):
        top = freq.top_ngrams_by_label(df, n=n, k=7)
        assert f"], {parts}" in next(x for x in top._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in x)
        got = {}
        for r in top.orderBy("rank").collect():
            got.setdefault(r["label"], []).append((r["item"], r["cnt"]))
        assert got == _top_grams(rows, n, 7)

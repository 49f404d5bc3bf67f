import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wordloom.llm import simhash


def brute_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def brute_components(items, k):
    """Smallest id reachable over fingerprints that differ in at most k bits."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= k:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [best.get(find(i)) for i in range(len(items))]


def test_fingerprint_against_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "Two words", "É À a", "a\x0bb\x0cc\x1cd e f", "x " * 5000]
    texts += [" ".join(rng.choice(["The", "of", "ñandú", "a", "zz"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t
    long = " ".join(str(i) for i in range(simhash._CHUNK + 50))
    assert simhash.fingerprint(long) == brute_fingerprint(long)


@pytest.mark.parametrize("parts", [None, 2, 3])
def test_links_against_brute_force(spark, monkeypatch, parts):
    rng = random.Random(5)
    fps = {0, 2**64 - 1}
    while len(fps) < 260:
        x = rng.getrandbits(64) if len(fps) < 60 else rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [int(np.uint64(x).astype(np.int64)) for x in sorted(fps)]
    if parts:  # each number of parts in turn is the only one that is tried
        whole = simhash._group_bits
        monkeypatch.setattr(simhash, "_group_bits", lambda gram, m: whole(gram, parts))
    d = simhash.link_groups(spark, spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r.fp: r.root for r in d.collect()}
    want = dict(zip(signed, brute_components([(x, x & (2**64 - 1)) for x in signed], 3), strict=True))
    assert got == want


def test_groups_and_edges(spark, make_docs):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(7, base), (3, base), (None, base), (9, base + " tail"), (1, None), (2, ""), (4, " \n"), (5, "lonely text of its own"), (5, "lonely text of its own"),
            (6, "z " * 30_000)]
    docs = make_docs(rows).withColumn("root", F.lit("mine")).withColumn("fp", F.lit(0))
    d = simhash.near_duplicates(spark, docs)
    got = sorted(((r.doc_id, r.component_id) for r in d.collect()), key=repr)
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    assert got == sorted(zip([r[0] for r in rows], brute_components(fps, 3), strict=True), key=repr)
    kept = simhash.one_of_each_group(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got})
    assert simhash.near_duplicates(spark, make_docs([])).count() == 0
    nulls = make_docs([(None, base), (None, base), (None, "other words entirely here")])
    assert simhash.one_of_each_group(spark, nulls).count() == 2


def test_allotment_is_exact():
    costs = [[5, 9, 30, 100], [1, 2, 3, 4], [7, 8, 50, 60]]
    from itertools import product
    want = min(sum(c[t] if t >= 0 else 0 for c, t in zip(costs, ts, strict=True)) for ts in product(range(-1, 4), repeat=3) if sum(ts) == 3 - 3 + 1)
    got, ts = simhash._allot(costs, 3)
    assert got == want and sum(ts) == 1


def test_empty_table_through_the_query(spark, make_docs, as_dir):
    sf = as_dir(documents=make_docs([]))
    assert simhash.op2_simhash(spark, sf).count() == 0 and simhash.one_of_each_group(spark, make_docs([])).count() == 0


def test_near_copies_in_linear_time(spark):
    """Many fingerprints around one: a probe inside their component makes no pairs."""
    rng = random.Random(1)
    fps = {0}
    while len(fps) < 12_000:
        fps.add(sum(1 << b for b in rng.sample(range(62), 3)))
    d = simhash.link_groups(spark, spark.createDataFrame([(x,) for x in fps], "fp long"))
    assert {r.root for r in d.select("root").distinct().collect()} == {0} and d.count() == len(fps)

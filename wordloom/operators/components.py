"""Connected components and minimum spanning forests of edge lists.

Both start in the tasks that hold the edges: each reduces its part to a forest (of ``n`` nodes at most
``n - 1`` edges are left), which keeps all connections, or all edges that a spanning tree can need. If what is left of all tasks is
small (``ONE_TASK`` edges, a bound on memory and not on the graph), one task merges the forests and is done: one pass over
the edges instead of a chain of rounds. Beyond that the rounds go on as joins and aggregations: large-star and
small-star (Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014) for components, Borůvka on the reduced
edges for forests. Lineage is cut with reliable ``checkpoint()`` into the shared checkpoint folder, so a lost executor never
replays a loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package

ONE_TASK = 2_000_000  # edges that one task finishes (48 MB)
_HELD = 1_000_000  # edges that a task gathers before it reduces them


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node (of ``0 .. n-1``) of each node's component, for edges ``a, b``."""
    lab = np.arange(n)
    while True:
        x, y = lab[a], lab[b]
        open_ = x != y
        if not open_.any():
            return lab
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(lab, lab[lab]):
            lab = lab[lab]


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges and the smallest node of the component of each."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    return ids, ids[_labels(len(ids), at[: len(u)], at[len(u):])]


def _reduced(batches: Iterator[pd.DataFrame], cols: list[str], reduce) -> pd.DataFrame:
    """All batches brought together, reduced whenever many rows are held."""
    held, size = [], 0
    for b in batches:
        held.append(b[cols])
        size += len(b)
        if size > _HELD:
            held = [reduce(pd.concat(held, ignore_index=True))]
            size = max(0, len(held[0]) - _HELD // 2)  # a large forest is not reduced again for every batch
    return reduce(pd.concat(held, ignore_index=True)) if held else pd.DataFrame({c: [] for c in cols})


def _stars(e: pd.DataFrame) -> pd.DataFrame:
    """An edge from each node to the smallest of its component."""
    nodes, roots = _roots(e["u"].to_numpy(np.int64), e["v"].to_numpy(np.int64))
    far = nodes != roots
    return pd.DataFrame({"u": nodes[far], "v": roots[far]})


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return sym.where(F.col("v") > F.col("u")).join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    o = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    m = o.groupBy("u").agg(F.min("v").alias("m"))
    linked = o.join(m, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(m.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    """Count and two hash digests of a set of edges."""
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def star_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """:func:`components` by joins and aggregations alone."""
    checkpoint_dir(spark)
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct().checkpoint()
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        e = _small_star(_large_star(e)).checkpoint()
        # converged when the (distinct) edge set no longer changes
        last, mark = mark, _mark(e)
        if mark == last:
            break
    else:
        raise RuntimeError("connected components did not converge")
    # after convergence every edge is (node, root) with root the component minimum
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return roots.unionByName(tops).groupBy("node").agg(F.min("root").alias("root"))


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of an edge (``u, v``) between two nodes; root = min id."""
    checkpoint_dir(spark)
    ship_package(spark)

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _reduced(batches, ["u", "v"], _stars).astype(np.int64)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _reduced(batches, ["u", "v"], _stars).astype(np.int64)
        nodes, roots = _roots(e["u"].to_numpy(), e["v"].to_numpy())
        yield pd.DataFrame({"node": nodes, "root": roots})

    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = e.mapInPandas(forest, "u long, v long").checkpoint()
    if e.count() <= ONE_TASK:
        return e.coalesce(1).mapInPandas(whole, "node long, root long").checkpoint()
    return star_components(spark, e, max_rounds)


# ------------------------------------------------------------- spanning forests
def spanning_edges(e: pd.DataFrame) -> pd.DataFrame:
    """The edges (``lo, hi, w``) of the minimum spanning forest, in ``(w, lo, hi)`` order, which leaves no ties."""
    e = e.sort_values(["w", "lo", "hi"], ignore_index=True).drop_duplicates(["lo", "hi"], ignore_index=True)
    ids, at = np.unique(np.concatenate([e["lo"], e["hi"]]), return_inverse=True)
    a, b = at[: len(e)], at[len(e):]
    taken, left, lab = [], np.arange(len(e)), np.arange(len(ids))
    while True:  # Borůvka: each component takes its first edge
        x, y = lab[a[left]], lab[b[left]]
        out = x != y
        left, x, y = left[out], x[out], y[out]
        if not len(left):
            break
        first = np.full(len(ids), len(e))
        np.minimum.at(first, x, left)
        np.minimum.at(first, y, left)
        picks = np.unique(first[first < len(e)])
        taken.append(picks)
        lab = _labels(len(ids), np.concatenate([np.arange(len(ids)), a[picks]]), np.concatenate([lab, b[picks]]))
    return e.iloc[np.sort(np.concatenate(taken))] if taken else e.iloc[:0]


def spanning_forest(spark: SparkSession, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``lo, hi, w``: the minimum spanning forest of ``edges``, of equal weights the smaller ``(lo, hi)`` first."""
    checkpoint_dir(spark)
    ship_package(spark)

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _reduced(batches, ["lo", "hi", "w"], spanning_edges)
        yield out.astype({"lo": np.int64, "hi": np.int64, "w": np.float64})

    schema = "lo long, hi long, w double"
    e = edges.select("lo", "hi", "w").mapInPandas(forest, schema).checkpoint()
    if e.count() <= ONE_TASK:
        return e.coalesce(1).mapInPandas(forest, schema).checkpoint()
    e, found = e.select("lo", "hi", "w", F.col("lo").alias("cu"), F.col("hi").alias("cv")), None
    for _ in range(max_rounds):
        ends = e.select(F.col("cu").alias("c"), "w", "lo", "hi", "cu", "cv").unionByName(e.select(F.col("cv").alias("c"), "w", "lo", "hi", "cu", "cv"))
        picks = ends.groupBy("c").agg(F.min(F.struct("w", "lo", "hi", "cu", "cv")).alias("e")).select("e.*").distinct().checkpoint()
        if not picks.limit(1).count():
            break
        found = picks.select("lo", "hi", "w") if found is None else found.unionByName(picks.select("lo", "hi", "w"))
        comp = components(spark, picks.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        for c in ("cu", "cv"):
            e = e.join(comp.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        e = e.where("cu <> cv").select("lo", "hi", "w", "cu", "cv").checkpoint()
    else:
        raise RuntimeError("the spanning forest did not finish")
    return found if found is not None else e.select("lo", "hi", "w")

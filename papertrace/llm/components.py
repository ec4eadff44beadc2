"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combine and two joins on a vertex; no vertex's neighbours are gathered
in a row or in memory, a partition of one that has very many is split by the adaptive plan, and nothing but two
numbers per round reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges: each vertex but the least of its tree, and that least one."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        old = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
        if (old == label).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(vertex, root) for each vertex of an edge, root being the least vertex that it reaches.

    Self loops and repeated edges are harmless, null ends are dropped; no edges give an empty table.
    Vertices may be of any orderable type. Raises if `rounds` do not suffice (each at least halves the
    depth of what is left, so that 60 suffice for any table)."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = cut(e)
    seen = _mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u")
        e1 = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e1 = cut(e1)
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        pairs = e1.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        new = cut(pairs.union(low.select("u", F.col("m").alias("v"))).distinct())
        drop(e1)
        drop(e)
        e, now = new, _mark(new)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    own = e.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return own.union(own.select(F.col("root").alias("vertex"), "root").distinct())

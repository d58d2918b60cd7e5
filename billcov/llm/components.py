"""Connected components of a link table by alternating large and small stars.

Every step is a grouped minimum and an equi-join on a node, both with partial aggregation or
splittable joins, so a node with very many links is no bottleneck; nothing is collected.  Before each
round every task contracts the links of its part of the table (a file split, so bounded) by
union-find to links to the smallest node, which saves rounds; rounds grow with the logarithm of the
component size at most.  Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billcov.llm.common import written


def stars(links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for all nodes of the links but these smallest ones."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, r) for x in up if (r := root(x)) != x]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = stars((u, v) for b in batches for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    moved = down.join(low, F.col("u") == F.col("w")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns u, v: long); component: its smallest node."""
    cur = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        cur = written(cur.mapInArrow(_contracted, "u long, v long"), "stars")
        now = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        cur = written(_small_star(_large_star(cur)), "links")
    # Converged: every edge leads from a node to the smallest of its component.
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

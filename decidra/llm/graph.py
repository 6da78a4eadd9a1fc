"""Connected components: smallest labels spread along edges by joins, and each label then takes its own label.

Graphs of at most ``ONE_TASK`` edges (a checked, fixed bound of 16 MB) are joined up in one task instead, as the rounds' many small
shuffles cost more than that; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

#: Edges that one task may join up.
ONE_TASK = 1_000_000


def _union(batches):
    """(node, root) of all edges of the partition, by union-find with the smallest node as root."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(k: int) -> int:
        top = k
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[k] != top:
            parent[k], k = top, parent[k]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for k in range(0, len(nodes), 10_000):
        part = nodes[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for all ends of ``edges`` (a, b): root is the smallest node that is reachable.

    Nulls link nothing, repeated edges and loops change nothing, no edges give no rows.  Every round is written to
    the shared folder; rounds grow with the logarithm of the longest path.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if edges.limit(one_task + 1).count() <= one_task:
        return written(arrow_map(edges.where("a is not null and b is not null").coalesce(1), _union, "node long, root long"), "roots")
    both = written(edges.select("a", "b").where("a is not null and b is not null").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        low = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        spread = labels.join(low, "node").select("node", F.least("root", "low").alias("now"), "root")
        up = labels.select(F.col("node").alias("now"), F.col("root").alias("above"))
        after = written(spread.join(up, "now").select("node", F.least("now", "above").alias("root"), (F.least("now", "above") < F.col("root")).alias("moved")), "labels")
        moved = after.where("moved").limit(1).count()
        labels = after.select("node", "root")
        if not moved:
            return labels

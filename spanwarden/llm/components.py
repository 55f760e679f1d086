"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize


def _forest(batches):
    """The edges of one task as a forest: each vertex with its root. Spanning edges only, so links stay whole."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def flush():
        pairs = [(v, root(v)) for v in parent]
        a, b = [v for v, r in pairs if v != r], [r for v, r in pairs if v != r]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 1_000_000:
            yield flush()
            parent.clear()
    yield flush()
    give_back()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): one row per vertex of an edge: id, component (the least vertex that can be reached)."""
    forest = edges.select("a", "b").filter("a <> b").mapInArrow(_forest, "a long, b long")
    both = materialize(forest.unionAll(forest.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("far"))
        step = materialize(step.join(jump, "to").select("id", F.col("component").alias("was"), F.least("to", "far").alias("component")), "labels")
        labels = step.select("id", "component")
        if not step.filter("was <> component").limit(1).count():
            return labels

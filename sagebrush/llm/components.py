"""Connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, shuffled, written, written_and_counted


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch as edges of its nodes to their smallest, so that what
    is joined later is flat and holds an edge for each node at most."""
    for batch in batches:
        up: dict[int, int] = {}

        def root(x: int, up=up) -> int:
            while (above := up.get(x, x)) != x:
                up[x] = up.get(above, above)
                x = above
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            up.setdefault(a, x)
            up.setdefault(b, y)
            if x != y:
                up[max(x, y)] = min(x, y)
        ends = np.array([(x, root(x)) for x in list(up) if root(x) != x], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of (a, b) edges.
    Each round takes the smallest label among neighbours, then the label's own
    label.  Only labels that the last round changed are sent along edges, as the
    others are known there.  A node with many
    neighbours sends and gets minima that are combined before the shuffle.  The
    table of a round goes once the next one is written."""
    made = edges.select("a", "b").mapInArrow(_forest, "a long, b long")
    both = written(made.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b"))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), (F.col("m") < F.col("node")).alias("moved"))
    moved, before = 1, None
    while moved:
        near = shuffled(both, labels.filter("moved").select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = shuffled(labels.drop("moved"), near, "node", "left").select("node", "label", F.least("label", "m").alias("new"))
        up = step.select(F.col("node").alias("new"), F.col("new").alias("r"))
        changed = shuffled(step, up, "new", "left").select("node", F.least("new", "r").alias("l2"), "label")
        labels, moved = written_and_counted(changed.select("node", F.col("l2").alias("label"), (F.col("l2") < F.col("label")).alias("moved")), F.col("moved"))
        if before is not None:
            dropped(before)
        before = labels
    dropped(both)
    return labels.select("node", "label")

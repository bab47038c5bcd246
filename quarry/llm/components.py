"""Connected components by local forests and label propagation with pointer jumping, on tables of long ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, write_table

#: links that a task joins up at once
FOREST_LINKS = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) of the links, for nodes that aren't the smallest themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        while (up := after[after] != after).any():
            after[up] = after[after[up]]
        if (after == root).all():
            break
        root = after
    own = root != np.arange(len(ids))
    return ids[own], ids[root[own]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def joined(waiting) -> pa.RecordBatch:
        got = forest(*(np.concatenate([w[k] for w in waiting]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["a", "b"])

    waiting, size = [], 0
    for r in batches:
        waiting.append([r.column(k).to_numpy() for k in (0, 1)])
        size += r.num_rows
        if size > FOREST_LINKS:
            yield joined(waiting)
            waiting, size = [], 0
    if waiting:
        yield joined(waiting)


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, label (smallest node of its component) of every linked node.

    Tasks first replace the links they hold by trees. Each round takes the smallest label
    among neighbours, then the label of the label, until nothing changes. Every round is
    written out; joins are on written tables, so that AQE can split hubs.
    """
    trees = links.select("a", "b").filter("a <> b").mapInArrow(_forests, "a long, b long")
    both = write_table(trees.unionByName(trees.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b")
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = write_table(labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = write_table(hooked.join(up.hint("merge"), "label").select("node", "old", F.col("up").alias("label")), "jumped")
        drop_table(hooked, labels)
        labels = after
        if after.filter("old <> label").isEmpty():
            drop_table(both)
            out = after.select("node", "label")
            out._scratch = after._scratch
            return out

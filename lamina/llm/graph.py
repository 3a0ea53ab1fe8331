"""Connected components of an edge list by alternating star contraction.

A round costs some twenty stages whatever the graph, so ``AT_ONCE`` edges or fewer are
contracted by one task instead; larger graphs go through rounds of all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import textkit as tk

EDGES = "a bigint, b bigint"
#: Edges that one task contracts (16 bytes each, some ten times that while it does).
AT_ONCE = 1_000_000


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the graph with these edges, for nodes that aren't the least."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = code[: len(a)], code[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (jump := new[new]) is not None and not np.array_equal(jump, new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


@tk.tidy
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning star for each component that the edges of a task make, in pieces of bounded size."""
    held: list[np.ndarray] = []

    def flush() -> tuple[np.ndarray, np.ndarray]:
        e = np.concatenate(held, 1) if held else np.zeros((2, 0), np.int64)
        return star(e[0], e[1])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        if sum(h.shape[1] for h in held) > 4_000_000:
            a, b = flush()
            held = [np.stack([a, b])]
            if len(a) > 2_000_000:  # they don't shrink: hand them on
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                held = []
    a, b = flush()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _is_settled(e: DataFrame) -> bool:
    """Whether the edges are stars: each node has one root, and no root has one itself."""
    ends = e.select(F.col("a").alias("n"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(e.select("b", F.lit(0), F.lit(1)))
    per = ends.groupBy("n").agg(F.sum("x").alias("x"), F.max("y").alias("y"))
    return per.where("x > 1 OR (x = 1 AND y = 1)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60, stars: bool = False) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint) but the least of each component.

    With ``stars``, the edges are few already: stars that some task has made.
    """
    e = edges.where("a != b") if stars else edges.where("a != b").mapInArrow(_forest, EDGES)
    e = tk.materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.count() <= AT_ONCE:
        return tk.materialize(e.coalesce(1).mapInArrow(_forest, EDGES)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        if _is_settled(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # a hub's edges are not dealt to one task
        both, size = e.union(e.select("b", "a")), 2 * e.count()
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select("a", F.least("a", "m").alias("m"), "degree")
        large = tk.materialize(tk.join_hot(both, least, ["a"], "degree", size).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        small = tk.join_hot(large, low, ["a"], "degree", size)
        e = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        e = tk.materialize(e)
    raise RuntimeError("the components did not settle")

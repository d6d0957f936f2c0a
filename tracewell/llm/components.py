"""Connected components of an edge table, without any node's neighbours meeting in one task.

Edges are first thinned to a spanning forest inside each partition, then the large-star and small-star steps of the core
run until nothing changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm.common import store
from tracewell.operators.components import components as settled


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) for the nodes that are not the smallest themselves."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


def _thin(most: int = 1 << 20):
    def run(batches):
        held, n = [], 0

        def out():
            u, v = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            held.append((np.asarray(b.column(0)), np.asarray(b.column(1))))
            n += b.num_rows
            if n >= most:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges in any direction -> (node, root): root is the smallest node reachable. Nodes that are their own root have no row; loops and repeated edges do no harm; no edges give no rows."""
    e = store(edges.select("u", "v").where("u <> v").mapInArrow(_thin(), "u long, v long"), "thinned")
    return settled(e).where("node <> root")

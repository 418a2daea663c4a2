"""Components of the pairs of vectors over a cosine, without the pairs: tasks pass on a spanning forest of what they find.

Vectors are dealt into blocks. First each block meets itself and the next one. What that joins needn't be compared within
itself again, so the greatest component is left out of the second step, in which every other vector meets all of them. That is
exact whatever the data: with no large component the second step compares all pairs, in memory bounded by two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import graph
from kindred.operators.joins import TILE, blocks_for, met_apart
from kindred.operators.storage import durable


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join i and j in root, which names the least member of each vertex's tree and does so afterwards."""
    a, b = root[i], root[j]
    while len(apart := np.flatnonzero(a != b)):
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]
        a, b = root[a], root[b]


def _unit(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _over(x: np.ndarray, y: np.ndarray, over: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in x and y of the pairs over the threshold, a tile at a time."""
    step = max(1, TILE // max(1, len(y)))
    for at in range(0, len(x), step):
        i, j = np.nonzero(np.minimum(x[at : at + step] @ y.T, 1.0) > over)  # rounding takes none over 1
        yield i + at, j


def forest(vectors: DataFrame, over: float) -> DataFrame:
    """(a, b): edges with the components of all pairs of vectors(rid, embedding) whose cosine is over the threshold, 0 or more;
    fewer edges than vectors from the first step, and than components of two blocks from each meeting of the second. Zero
    vectors have none."""
    if over < 0:
        raise ValueError("over must not be under 0")
    usable = durable(vectors.where(F.exists("embedding", lambda x: x != 0)).select("rid", "embedding"), "usable-vectors")
    n, dimension = usable.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = blocks_for(n, dimension or 1)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in b.column("rows"):
                ids, own = (rows.values.field(c).to_numpy(zero_copy_only=False) for c in ("rid", "own"))
                x = _unit(rows.values.field("embedding"))
                mine, root = np.flatnonzero(own), np.arange(len(ids))
                for i, j in _over(x[mine], x, over):
                    joined(root, mine[i], j)
                below = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[below]), pa.array(ids[root[below]])], ["a", "b"])

    at = F.pmod(F.xxhash64("rid"), F.lit(blocks))
    places = [F.struct(at.alias("block"), F.lit(True).alias("own"))]
    if blocks > 1:
        places.append(F.struct(F.pmod(at - 1, F.lit(blocks)).alias("block"), F.lit(False).alias("own")))
    dealt = usable.select("rid", "embedding", F.explode(F.array(*places)).alias("at")).select("at.block", F.struct("rid", "embedding", "at.own").alias("row"))
    edges = _packed(dealt, "block").select("rows").mapInArrow(near, "a long, b long")
    if blocks <= 3:  # each has met each
        return edges
    stars = durable(graph.components(edges), "near-components")
    named = durable(usable.join(stars.withColumnRenamed("id", "rid"), "rid", "left").select("rid", "embedding", F.coalesce("component", "rid").alias("cluster")), "named-vectors")
    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, more in zip(b.column("rows"), b.column("other_rows"), strict=True):
                of, to = (z.values.field("cluster").to_numpy(zero_copy_only=False) for z in (rows, more))
                x, y = (_unit(z.values.field("embedding")) for z in (rows, more))
                names, at = np.unique(np.concatenate([of, to]), return_inverse=True)
                root = np.arange(len(names))
                for i, j in _over(x, y, over):
                    joined(root, at[i], at[len(of) + j])
                below = np.flatnonzero(root != np.arange(len(names)))
                yield pa.RecordBatch.from_arrays([pa.array(names[below]), pa.array(names[root[below]])], ["a", "b"])

    met = met_apart(named).mapInArrow(far, "a long, b long")
    return stars.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a <> b").unionByName(met)


def _packed(dealt: DataFrame, key: str) -> DataFrame:
    """(key, rows) of dealt(key, row)."""
    return dealt.groupBy(key).agg(F.collect_list("row").alias("rows"))

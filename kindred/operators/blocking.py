"""Blocks of records that may be the same thing, thresholds for them, and anchors and representatives within them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions.vectors import centroids, euclidean
from kindred.operators import connected, graph, joins, lsh
from kindred.operators.storage import durable


def _blocks(vectors: DataFrame, over: float, pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(rid, cluster) by components of the two columns of pairs(distinct vectors). Copies of a vector are one vertex, the least of their
    ids, so a large group of copies makes no pairs; they share a block unless their cosine isn't over the threshold."""
    alone = ~F.exists("embedding", lambda x: x != 0) if over < 1 else F.lit(True)
    keyed = vectors.select("rid", "embedding", F.when(alone, F.col("rid")).alias("apart"))
    distinct = durable(keyed.groupBy("embedding", "apart").agg(F.min("rid").alias("least")), "distinct-vectors")
    edges = pairs(distinct.select(F.col("least").alias("rid"), "embedding")).toDF("a", "b")
    found = graph.components(edges).withColumnRenamed("id", "least")
    led = distinct.join(found, "least", "left").select("embedding", "apart", F.coalesce("component", "least").alias("cluster"))
    on = keyed["embedding"].eqNullSafe(led["embedding"]) & keyed["apart"].eqNullSafe(led["apart"])
    return keyed.join(led, on).select("rid", "cluster")


def exact_blocks(vectors: DataFrame, over: float) -> DataFrame:
    """(rid, cluster) by components of all pairs with a cosine over the threshold; alone where there is none. From a
    threshold of 0 on, tasks pass on spanning forests of their pairs, and the greatest component meets no more of itself
    (see connected)."""
    return _blocks(vectors, over, lambda distinct: connected.forest(distinct, over) if over >= 0 else joins.cosine_pairs(distinct, over).select("u", "v"))


def lsh_blocks(vectors: DataFrame, over: float, **how) -> DataFrame:
    """(rid, cluster) by components of the locality-sensitive join's pairs."""
    return _blocks(vectors, over, lambda distinct: lsh.lsh_pairs(distinct, over, **how).select("u", "v"))


def jaccard_blocks(records: DataFrame, columns: list[str], at_least: float, by: str) -> DataFrame:
    """(rid, cluster) by components of attribute Jaccard pairs; records like no other stay as clusters of their own."""
    pairs = joins.attribute_pairs(records, columns, at_least, by)
    return graph.partition(records, pairs.select(F.col("u").alias("a"), F.col("v").alias("b")))


def threshold(vectors: DataFrame, sigmas: float = 2.5, cap: float = 0.99) -> DataFrame:
    """One row (n, mean, sigma, threshold): mean + sigmas * population deviation of all N x N cosines, cap at most.

    No pair is formed: the mean is the squared length of the unit vectors' sum over N^2, and the second moment the
    squared Frobenius norm of their d x d Gram matrix over N^2. Tasks pass on one such matrix each."""

    def partial(batches):
        n, total, gram = 0, None, None
        for b in batches:
            x = np.asarray(b.column(0).flatten(), np.float64).reshape(b.num_rows, -1)
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(length > 0, length, 1)
            n += len(x)
            total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
            gram = x.T @ x if gram is None else gram + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([gram.ravel().tolist()])], ["n", "total", "gram"])

    parts = vectors.select("embedding").mapInArrow(partial, "n long, total array<double>, gram array<double>")

    def squares(column: str) -> DataFrame:
        sums = parts.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        return sums.agg(F.sum(F.col("x") * F.col("x")).alias(column))

    both = parts.agg(F.sum("n").alias("n")).crossJoin(squares("total")).crossJoin(squares("gram"))  # three single rows
    mean, second = F.col("total") / F.col("n") / F.col("n"), F.col("gram") / F.col("n") / F.col("n")
    rows = both.select("n", mean.alias("mean"), F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias("sigma"))
    return rows.withColumn("threshold", F.least(F.col("mean") + sigmas * F.col("sigma"), F.lit(float(cap))))


def threshold_for(name: str, thresholds: dict[str, float], default: float | None = None) -> float | None:
    """The threshold of the first key of thresholds that is part of a dataset's name or path, letter case aside."""
    return next((t for key, t in thresholds.items() if key.lower() in name.lower()), default)


def centroid_distances(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(rid, cluster, distance) to the centroid of the record's cluster, for members(rid, cluster)."""
    joined = vectors.select("rid", "embedding").join(members, "rid")
    return joined.join(centroids(joined, "cluster"), "cluster").select("rid", "cluster", euclidean(F.col("embedding"), F.col("centroid")).alias("distance"))


def nearest(distances: DataFrame, digits: int = 9) -> DataFrame:
    """distances with rank in the cluster from the centroid on; distances equal to so many digits tie, by rid."""
    order = W.partitionBy("cluster").orderBy(F.round("distance", digits), "rid")
    return distances.withColumn("rank", F.row_number().over(order))


def representatives(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, rid) of the record nearest to each cluster's centroid."""
    least = F.min_by("rid", F.struct(F.round("distance", 9), "rid"))
    return centroid_distances(vectors, members).groupBy("cluster").agg(least.alias("rid"))


def first_members(members: DataFrame) -> DataFrame:
    """(cluster, rid) of the smallest record id of each cluster."""
    return members.groupBy("cluster").agg(F.min("rid").alias("rid"))


def sampled_members(members: DataFrame, seed: int = 42) -> DataFrame:
    """(cluster, rid) of one record of each cluster, chosen by a seeded hash."""
    return members.groupBy("cluster").agg(F.min_by("rid", F.struct(F.xxhash64("rid", F.lit(seed)), "rid")).alias("rid"))


def block_anchors(vectors: DataFrame, members: DataFrame, fraction: float = 1.0, cap: int | None = None) -> DataFrame:
    """(rid, cluster) of each block's records nearest to its centroid: ceil(size * fraction) of them, 1 at least, cap at most."""
    ranked = nearest(centroid_distances(vectors, members)).join(members.groupBy("cluster").count(), "cluster")
    keep = F.greatest(F.lit(1), F.ceil(F.col("count") * fraction)) if fraction < 1 else F.col("count")
    keep = F.least(keep, F.lit(cap)) if cap is not None else keep
    return ranked.where(F.col("rank") <= keep).select("rid", "cluster")


def central_anchors(vectors: DataFrame, n: int) -> DataFrame:
    """(rid) of the n records nearest to the centroid of all, ties by rid."""
    everyone = centroid_distances(vectors, vectors.select("rid", F.lit(0).cast("long").alias("cluster")))
    return everyone.orderBy(F.round("distance", 9), "rid").limit(n).select("rid")


def hashed_anchors(records: DataFrame, text: str, n: int) -> DataFrame:
    """(rid) of the n records with the least SHA-1 of their text, ties by rid."""
    return records.select("rid", F.sha1(F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")).alias("hash")).orderBy("hash", "rid").limit(n).select("rid")


def small_and_large(members: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """members of clusters up to most records, which need no splitting, and the rest."""
    sized = members.join(members.groupBy("cluster").count(), "cluster")
    return sized.where(F.col("count") <= most).drop("count"), sized.where(F.col("count") > most).drop("count")

"""Vector arithmetic as Column expressions, in double precision, and vectors of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def variation(counts: Column) -> Column:
    """Population coefficient of variation of the positive elements of an array; 0 if there are none."""
    used = F.filter(counts, lambda x: x > 0)
    n = F.size(used)
    mean = F.aggregate(used, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.aggregate(used, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.when(n == 0, 0.0).otherwise(F.sqrt(spread) / mean)


def hashed_embedding(tokens: Column, dimension: int = 64) -> Column:
    """Signed hashing vector of an array of tokens: each token adds 1 or -1 to one of dimension places."""
    zero = F.array_repeat(F.lit(0.0), dimension)

    def signed(token: Column) -> Column:
        digest = F.md5(token.cast("binary"))  # which SQL engines compute alike
        place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimension
        sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
        return F.struct(place.alias("place"), sign.alias("sign"))

    def add(vector: Column, at: Column) -> Column:
        return F.transform(vector, lambda x, i: F.when(i == at["place"], x + at["sign"]).otherwise(x))

    return F.aggregate(F.transform(tokens, signed), zero, add)  # a token is hashed once, not for each dimension


def centroids(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys..., centroid) of vectors(keys..., embedding); partial sums per dimension are combined before the shuffle."""
    long = vectors.select(*keys, F.posexplode("embedding").alias("at", "x"))
    means = long.groupBy(*keys, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "x")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda p: p["x"]).alias("centroid"))


def embedded(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256) -> DataFrame:
    """(rid, embedding) of texts(rid, text) by a model: load() makes it, once in each task, and it turns a list of texts into a
    matrix with a row for each. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                model = model or load()
                x = np.asarray(model([t or "" for t in part.column(1).to_pylist()]), np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["rid", "embedding"])

    return texts.select(F.col("rid").cast("long").alias("rid"), "text").mapInArrow(run, "rid long, embedding array<double>")

"""Embedding near-duplicates by an inverted multi-index.

Independent codebooks on the two halves of the unit vectors form a product grid of cells. A vector visits cells from
the nearest on, merging the two sorted lists of half distances (multi-sequence traversal), until the distance to the
next cell's border exceeds what a near-duplicate moves by, at the target recall; vectors met in visited cells are then
verified by their cosine in double precision. Vectors that are equal are one vector with a multiplicity throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import components, durable
from kindred.llm.simhash import Groups

COSINE = 0.98
#: How many standard deviations of a near-duplicate's displacement along any direction the traversal covers: the
#: displacement has length sqrt(2 - 2 * COSINE) and is spread over all dimensions, so 4 reach nearly every cell.
REACH = 4.0
#: Vectors that codebooks are fitted on (the first in a fixed hash order; every vector is indexed).
SAMPLE = 20_000
#: Numbers of one dimension's sample that the driver holds in double precision at most: 160 MB.
SAMPLE_NUMBERS = 20_000_000
#: Vectors of one label that a cell should hold, and centroids of a half at least and at most.
CELL_ROWS, CENTROIDS = 32, (4, 256)
#: A cell's vectors are compared in parts of so many; rows of one Arrow group.
PART, GROUP_ROWS = 4096, 20_000


def kmeans(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k centroids by Lloyd's rounds from evenly spaced points in order of their first principal coordinate."""
    k = min(k, len(points))
    centred = points - points.mean(axis=0)
    axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    centroids = points[np.argsort(centred @ axis, kind="stable")[np.linspace(0, len(points) - 1, k).astype(int)]].copy()
    for _ in range(rounds):
        of = (-2 * points @ centroids.T + (centroids**2).sum(axis=1)).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, points)
        counts = np.bincount(of, minlength=k)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return np.unique(centroids, axis=0)


@dataclass
class Codebooks:
    """One codebook per half, for vectors of one dimension."""

    halves: tuple[np.ndarray, np.ndarray]
    reach: float

    @classmethod
    def fit(cls, unit: np.ndarray, k: int, cosine: float) -> Codebooks:
        d = unit.shape[1]
        return cls((kmeans(unit[:, : d // 2], k), kmeans(unit[:, d // 2 :], k)), REACH * sqrt((2 - 2 * cosine) / d))

    def bounds(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half (nearest centroid, squared distance to the border of every centroid's cell). A row's values
        don't depend on the other rows, so they can be computed again anywhere."""
        out, at = [], 0
        for book in self.halves:
            part = unit[:, at : at + book.shape[1]]
            at += book.shape[1]
            square = np.stack([((part - c) ** 2).sum(axis=1) for c in book], axis=1)
            own = square.argmin(axis=1)
            gap = np.sqrt(np.stack([((book - c) ** 2).sum(axis=1) for c in book]))[own]
            border = (square - square[np.arange(len(own)), own][:, None]) / np.where(gap > 0, 2 * gap, np.inf)
            out.append((own, np.maximum(border, 0) ** 2))
        return out

    def traverse(self, first: np.ndarray, second: np.ndarray) -> list[int]:
        """Cells in order of their border's distance, as far as reach: a heap merges the two sorted half lists."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        x, y = first[a].tolist(), second[b].tolist()
        limit, width, out = self.reach**2, len(second), []
        heap = [(x[0] + y[0], 0, 0)]
        while heap and heap[0][0] <= limit:
            _, i, j = heappop(heap)
            out.append(int(a[i]) * width + int(b[j]))
            if j + 1 < len(y):
                heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(x):
                heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        return out


def _unit(column: pa.ListArray) -> np.ndarray:
    rows = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def fit(classes: DataFrame, cosine: float) -> dict[int, Codebooks]:
    """Codebooks for each dimension in the bounded sample."""
    n, labels = classes.agg(F.count("*"), F.countDistinct("label")).first()
    k = int(min(max(sqrt(n / max(labels, 1) / CELL_ROWS), CENTROIDS[0]), CENTROIDS[1]))
    rows = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    size = rows.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(size[size > 1]).tolist():
        at = np.flatnonzero(size == d)
        out[d] = Codebooks.fit(_unit(rows.take(pa.array(at[: max(1, SAMPLE_NUMBERS // d)]))), k, cosine)
    return out


def indexed(classes: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    """classes with own (cell) and visits (cells, the own first). Dimensions without codebooks have one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("embedding")
            size = vectors.value_lengths().to_numpy(zero_copy_only=False)
            own, visits = np.zeros(b.num_rows, np.int32), [[0]] * b.num_rows
            for d in np.unique(size).tolist():
                if d in books:
                    at = np.flatnonzero(size == d)
                    (o1, b1), (o2, b2) = books[d].bounds(_unit(vectors.take(pa.array(at))))
                    own[at] = o1 * b2.shape[1] + o2
                    for i, r1, r2 in zip(at.tolist(), b1, b2, strict=True):
                        visits[i] = books[d].traverse(r1, r2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(visits, pa.list_(pa.int32()))], [*b.schema.names, "own", "visits"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{kinds}, own int, visits array<int>")


def _compare(rows: dict[str, np.ndarray], unit: np.ndarray, at: np.ndarray, book: Codebooks | None, cosine: float, groups: Groups, links: np.ndarray) -> None:
    """Count the links of one cell's rows (positions at, vectors unit) into links and join them in groups."""
    mine = rows["is_own"][at] & rows["indexed"][at]
    index, asking = at[mine], at[rows["asks"][at]]
    of = {p: i for i, p in enumerate(at.tolist())}
    v_index = unit[[of[p] for p in index.tolist()]]
    for block in np.array_split(asking, max(1, len(asking) // 1024)):
        if not len(block) or not len(index):
            continue
        hit_q, hit_i = np.nonzero(unit[[of[p] for p in block.tolist()]] @ v_index.T >= cosine)
        q, i = block[hit_q], index[hit_i]
        other = rows["cls"][q] != rows["cls"][i]
        q, i = q[other], i[other]
        if not len(q):
            continue
        np.add.at(links, q, rows["m"][i])
        # A member counts the asking vector itself when it visits that one's cell; else the link is counted here.
        away = rows["own"][q] != rows["own"][i]
        if away.any() and book is not None:
            width = len(book.halves[1])
            back = np.unique(i[away], return_inverse=True)
            (_, b1), (_, b2) = book.bounds(unit[[of[p] for p in back[0].tolist()]])
            cell = rows["own"][q[away]]
            silent = b1[back[1], cell // width] + b2[back[1], cell % width] > book.reach**2
            np.add.at(links, i[away][silent], rows["m"][q[away][silent]])
        groups.join_pairs(q, i)


def links(index: DataFrame, books: dict[int, Codebooks], cosine: float) -> DataFrame:
    """(cls, rep, links, lead): partial numbers of linked vectors, and a smaller rep linked or reachable."""
    spark = index.sparkSession
    counts = index.groupBy("label", "own").count()
    big = durable(counts.where(F.col("count") > PART).select("label", F.col("own").alias("cell"), F.ceil(F.col("count") / PART).cast("int").alias("parts")), "cell-parts")
    visits = index.select("*", F.explode("visits").alias("cell")).drop("visits").join(big, ["label", "cell"], "left")
    # Every vector asks in each part of a cell; a member of a large cell is indexed in one part only, and the
    # askers are dealt out too, so a group holds PART members at most.
    # A vector makes 2 x parts rows of a cell at most: what it asks in each part, and itself as a member of its own.
    parts = F.coalesce("parts", F.lit(1))
    each, mine = F.sequence(F.lit(0), parts - 1), lambda salt: F.pmod(F.xxhash64("cls", F.lit(salt)), parts).cast("int")
    asking = F.transform(each, lambda i: F.struct(i.alias("i"), mine(2).alias("j")))
    member = F.when(F.col("own") == F.col("cell"), F.transform(each, lambda j: F.struct(mine(1).alias("i"), j.alias("j"))))
    deal = F.explode(F.array_distinct(F.concat(asking, F.coalesce(member, F.slice(asking, 1, 0))))).alias("deal")
    dealt = visits.withColumn("parts", parts).select("*", deal)
    rows = dealt.withColumn("indexed", (F.col("own") == F.col("cell")) & (F.col("deal.i") == mine(1))).withColumn("asks", F.col("deal.j") == mine(2))
    total = index.agg(F.sum(F.size("visits"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / GROUP_ROWS))
    rows = rows.withColumn("is_own", F.col("own") == F.col("cell")).withColumn("bucket", F.pmod(F.xxhash64("label", "cell", "deal"), F.lit(buckets)))
    rows = rows.select("bucket", F.xxhash64("label", "deal").alias("part"), "cell", "own", "is_own", "indexed", "asks", "cls", "rep", "m", "embedding")

    def compare(table: pa.Table) -> pa.Table:
        rows = {c: table[c].to_numpy() for c in ("part", "cell", "own", "is_own", "indexed", "asks", "cls", "rep", "m")}
        vectors = table["embedding"].combine_chunks()
        size = vectors.value_lengths().to_numpy(zero_copy_only=False)
        order = np.lexsort((rows["rep"], size, rows["cell"], rows["part"]))
        key = np.stack([rows["part"], rows["cell"], size])[:, order]
        found, groups = np.zeros(len(order), np.int64), Groups(len(order))
        for at in np.split(order, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1):
            if len(at) > 1:
                _compare(rows, _unit(vectors.take(pa.array(at))), at, books.get(int(size[at[0]])), cosine, groups, found)
        root = groups.find(np.arange(len(order)))
        low = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(low, root, rows["rep"])
        lead = low[root]
        out = np.flatnonzero((found > 0) | (lead < rows["rep"]))
        frame = pd.DataFrame({"cls": rows["cls"][out], "rep": rows["rep"][out], "links": found[out], "lead": lead[out]})
        return pa.Table.from_pandas(frame.groupby(["cls", "rep"], as_index=False).agg({"links": "sum", "lead": "min"}), preserve_index=False)

    return rows.groupBy("bucket").applyInArrow(compare, "cls long, rep long, links long, lead long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each distinct row of vectors(vec_id, embedding, label).

    Only vectors of one label (not null) and one dimension link. Vectors that are null, zero or hold null or
    non-finite components, and rows with a null vec_id, link with nothing: no links, their own component, kept.
    Rows that are repeated in all three columns count once; an empty table gives no rows. Other columns are left out,
    whatever their names. Links are pairs of vec_ids' vectors: an id that is given to several vectors has a row for each.
    """
    rows = vectors.select("vec_id", "embedding", "label").distinct()
    fit_in = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    alone = rows.where(~fit_in).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = durable(rows.where(fit_in).withColumn("cls", F.xxhash64("label", "embedding")), "vectors")
    same = ["cls", "label", "embedding"]
    classes = durable(rows.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "vector-classes")
    books = fit(classes, cosine)
    found = durable(links(durable(indexed(classes, books), "multi-index"), books, cosine), "vector-links")
    counts = found.groupBy("cls", "rep").agg(F.sum("links").alias("links"))
    led = components(found.select(F.col("rep").alias("a"), F.col("lead").alias("b")))
    # Copies of a vector share its class: cls and rep are found again by the class's hash, verified by the vector.
    of_class = classes.join(counts, ["cls", "rep"], "left").join(led.withColumnRenamed("id", "rep"), "rep", "left")
    out = rows.join(of_class.withColumnRenamed("embedding", "_e").withColumnRenamed("label", "_l"), "cls").where("embedding = _e and label = _l")
    component = F.coalesce("component", "rep")
    out = out.select("vec_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(alone)


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector among the vectors of its label."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Exact cosine joins with pruning: vectors in pages on the unit sphere, and bounds that leave pairs of pages or vectors out.

Pivots partition the sphere: a vector belongs to its nearest pivot, and pages take a pivot's vectors in order of
their angle to it. An interval, a few consecutive pages, knows the least and the greatest angle of its vectors to every pivot. Angles obey the
triangle inequality, so two vectors are at least as far apart as their angles to any pivot differ: intervals whose
angles to some pivot lie too far apart are never compared. Within two pages that are compared, a head of the coordinates
(after a rotation that brings the greatest variance first) and the lengths of the rest bound each cosine from above, and
only pairs whose bound reaches the threshold are computed in full. Both bounds are exact: no pair is lost.

Which of the two helps depends on the data: clusters are told apart by pivots; vectors spread evenly over many dimensions
are all about 90 degrees apart and meet page by page, but at a high threshold few of their pairs are computed in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kindred.operators.ordering import ranked
from kindred.operators.storage import durable

#: Vectors of a page, of a large table's page at most, and pages of a table before these grow: each page is sent once for each other.
MOST_PAGE, PAGES = 8192, 24
#: Vectors of a page at least, intervals of the directory at most, right-hand intervals that one task takes for a page of the top-k search.
PAGE, INTERVALS, CHUNK = 2048, 4096, 64
#: Vectors that pivots and the rotation are fitted on, numbers that the driver holds of them at most, least and most pivots.
SAMPLE, SAMPLE_NUMBERS, PIVOTS = 10_000, 5_000_000, (8, 64)
#: What rounding can change in an angle or cosine.
SLACK = 1e-7


def _unit(column: pa.ListArray) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread_pivots(x: np.ndarray, k: int) -> np.ndarray:
    """k rows of x, each the furthest from those before it."""
    chosen = [0]
    near = x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


@dataclass
class Sphere:
    """What every task knows of the pages: bounded by PIVOTS, INTERVALS and the dimension."""

    pivots: np.ndarray
    rotation: np.ndarray  # columns by falling variance
    shares: np.ndarray  # of the variance, in that order
    keys: np.ndarray | None = None  # of the intervals
    low: np.ndarray | None = None  # intervals x pivots: least and greatest angle
    high: np.ndarray | None = None

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.pivots.T, -1, 1))

    def apart(self, interval: int) -> np.ndarray:
        """Least angle between a vector of the interval with that key and one of each interval."""
        interval = np.searchsorted(self.keys, interval)
        gaps = np.maximum(self.low - self.high[interval], self.low[interval] - self.high)
        return np.maximum(gaps.max(axis=1), 0)

    def head(self, over: float) -> int:
        """Coordinates of the head after which a bound of unrelated vectors is nearly always under `over`; all where that
        saves little."""
        d = len(self.shares)
        bound = 1 - np.cumsum(self.shares) + 3 * np.sqrt(np.cumsum(self.shares**2))
        enough = np.flatnonzero(bound <= over)
        return int(enough[0]) + 1 if len(enough) and enough[0] + 1 <= 0.75 * d else d


def build(vectors: DataFrame) -> tuple[DataFrame, Sphere]:
    """Pages (page, interval, rows) of vectors(rid, embedding) of one dimension, none of them zero, and their Sphere."""
    keyed = vectors.select("rid", "embedding")
    n = keyed.count()
    sample = keyed.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(sample):
        return keyed.select(F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("interval"), F.array(F.struct("rid", "embedding")).alias("rows")), Sphere(*(np.zeros((0, 0)),) * 6)
    x = _unit(sample.slice(0, max(1, SAMPLE_NUMBERS // max(1, len(sample[0])))))
    values, rotation = np.linalg.eigh(x.T @ x / len(x))
    page = max(PAGE, min(MOST_PAGE, n // PAGES))
    pages = -(-n // page)
    pivots = spread_pivots(x, min(max(2 * pages, PIVOTS[0]), PIVOTS[1]))
    shares = np.maximum(values[::-1], 0) / max(values.sum(), 1e-300)
    sphere = Sphere(pivots, rotation[:, ::-1].copy(), shares)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = sphere.angles(_unit(b.column(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a.argmin(axis=1).astype(np.int32)), pa.array(a.min(axis=1))], ["rid", "embedding", "pivot", "angle"])

    kind = keyed.schema["embedding"].dataType.simpleString()
    placed = ranked(keyed.mapInArrow(key, f"rid long, embedding {kind}, pivot int, angle double"), ["pivot", "angle"], "at")
    span = -(-pages // INTERVALS)
    # Neither pages nor intervals reach over from one pivot to the next.
    most = PIVOTS[1]
    keys = [F.expr(f"(at div {page}) * {most} + pivot").alias("page"), F.expr(f"(at div {page * span}) * {most} + pivot").alias("interval")]
    packed = placed.groupBy(*keys).agg(F.collect_list(F.struct("rid", "embedding")).alias("rows"))
    packed = durable(packed, "sphere-pages")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [sphere.angles(_unit(rows.values.field("embedding"))) for rows in b.column("rows")]
            lists = [pa.array([f(a, axis=0).tolist() for a in each], pa.list_(pa.float64())) for f in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([b.column("interval"), *lists], ["interval", "low", "high"])

    each = packed.select("interval", "rows").mapInArrow(bounds, "interval long, low array<double>, high array<double>").groupBy("interval")
    at = range(len(pivots))
    found = each.agg(F.array(*[F.min(F.col("low")[k]) for k in at]).alias("low"), F.array(*[F.max(F.col("high")[k]) for k in at]).alias("high")).orderBy("interval").collect()
    sphere.keys = np.array([r["interval"] for r in found])
    sphere.low, sphere.high = np.array([r["low"] for r in found]), np.array([r["high"] for r in found])
    return packed, sphere


def _meetings(packed: DataFrame, sphere: Sphere, over: float) -> DataFrame:
    """(page, other, rows, other_rows), page <= other, of all pages whose intervals may hold a pair over the threshold."""
    widest = acos(max(-1.0, min(1.0, over))) + SLACK

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = [np.flatnonzero(sphere.apart(i) <= widest) for i in b.column(1).to_pylist()]
            of = np.repeat(np.arange(b.num_rows), [len(x) for x in to])
            others = sphere.keys[np.concatenate([*to, np.zeros(0, np.int64)]).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(others)], ["page", "interval"])

    plan = packed.select("page", "interval").mapInArrow(near, "page long, interval long")
    pairs = plan.join(packed.select("interval", F.col("page").alias("other")), "interval").where("page <= other").select("page", "other")
    right = packed.select(F.col("page").alias("other"), F.col("rows").alias("other_rows"))
    return pairs.join(packed.select("page", "rows"), "page").join(right, "other")


def _compared(x: np.ndarray, y: np.ndarray, over: float, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(rows of x, rows of y, cosines) over the threshold, and how many cosines were computed in full; x and y are rotated."""
    d = x.shape[1]
    if head == d:
        sims = np.minimum(x @ y.T, 1.0)  # rounding takes none over 1
        i, j = np.nonzero(sims > over)
        return i, j, sims[i, j], sims.size
    rest = [np.linalg.norm(z[:, head:], axis=1) for z in (x, y)]
    i, j = np.nonzero(x[:, :head] @ y[:, :head].T + rest[0][:, None] * rest[1][None, :] > over - SLACK)
    sims = np.concatenate([(x[a] * y[b]).sum(axis=1) for a, b in zip(np.array_split(i, max(1, len(i) // 100_000)), np.array_split(j, max(1, len(j) // 100_000)), strict=True)])
    sims = np.minimum(sims, 1.0)
    found = sims > over
    return i[found], j[found], sims[found], len(i)


def _joined(vectors: DataFrame, over: float, tell: bool) -> DataFrame:
    if over < 0:
        raise ValueError("over must not be under 0")
    usable = durable(vectors.where(F.exists("embedding", lambda x: x != 0)).select("rid", "embedding"), "sphere-vectors")
    packed, sphere = build(usable)
    head = sphere.head(over)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                page, other, rows, more = (b.column(c)[k] for c in ("page", "other", "rows", "other_rows"))
                u, v = (z.values.field("rid").to_numpy(zero_copy_only=False) for z in (rows, more))
                x, y = (_unit(z.values.field("embedding")) @ sphere.rotation for z in (rows, more))
                compared = 0
                for at in range(0, len(x), 1024):
                    i, j, s, full = _compared(x[at : at + 1024], y, over, head)
                    compared += full
                    a, c = u[at + i], v[j]
                    keep = a < c if page.as_py() == other.as_py() else a != c
                    if not tell:
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)[keep]), pa.array(np.maximum(a, c)[keep]), pa.array(s[keep])], ["u", "v", "sim"])
                if tell:
                    yield pa.RecordBatch.from_arrays([pa.array([len(x) * len(y)]), pa.array([compared])], ["met", "compared"])

    rows = _meetings(packed, sphere, over).select("page", "other", "rows", "other_rows")
    return rows.mapInArrow(run, "met long, compared long" if tell else "u long, v long, sim double")


def pairs(vectors: DataFrame, over: float) -> DataFrame:
    """(u, v, sim), u < v, of all pairs of vectors(rid, embedding) whose cosine is strictly over the threshold, 0 or more. Zero
    vectors have none."""
    return _joined(vectors, over, False)


def work(vectors: DataFrame, over: float) -> DataFrame:
    """One row: vectors n, all pairs (each page meets itself whole), pairs of pages that met, and pairs computed in full."""
    told = _joined(vectors, over, True).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "compared")])
    n = vectors.where(F.exists("embedding", lambda x: x != 0)).agg(F.count("*").alias("n"))
    return n.crossJoin(told).select("n", F.expr("n * n div 2").alias("pairs"), "met", "compared")  # two single rows


def _best(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(others, sims) of the k greatest of each row, ties by the smaller other; columns must be in order of others."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return others[order] if others.ndim == 1 else np.take_along_axis(others, order, axis=1), np.take_along_axis(sims, order, axis=1)


class _TopK:
    """The k best others of a page's vectors, as pages stream past."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, bars: np.ndarray):
        self.ids, self.x, self.k, self.bars = ids, x, k, bars
        self.others, self.sims = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))

    def add(self, others: np.ndarray, y: np.ndarray) -> None:
        by = np.argsort(others, kind="stable")
        for at in range(0, len(self.ids), 512):
            part = slice(at, at + 512)
            sims = self.x[part] @ y[by].T
            sims[self.ids[part, None] == others[None, by]] = -np.inf
            sims[sims < self.bars[part, None]] = -np.inf  # k others are known that are better
            new, s = _best(self.ids[part], others[by], sims, self.k)
            self._merge(part, new, s)

    def _merge(self, part: slice, new: np.ndarray, s: np.ndarray) -> None:
        if self.others.shape[1] == 0:
            shape = (len(self.ids), self.k)
            self.others, self.sims = np.zeros(shape, np.int64), np.full(shape, -np.inf)
        others, sims = np.concatenate([self.others[part], new], axis=1), np.concatenate([self.sims[part], s], axis=1)
        by = np.argsort(others, axis=1, kind="stable")
        self.others[part], self.sims[part] = _best(self.ids[part], np.take_along_axis(others, by, axis=1), np.take_along_axis(sims, by, axis=1), self.k)
        self.bars[part] = np.maximum(self.bars[part], self.sims[part][:, -1] - SLACK)

    def rows(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.sims > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.others[i, j]), pa.array(self.sims[i, j])], ["u", "v", "sim"])


def top_k(vectors: DataFrame, k: int) -> DataFrame:
    """(u, v, sim, rank): the k most similar other vectors of each of vectors(rid, embedding), ties by the smaller v.

    A first pass compares each page with itself; a vector's k-th best cosine there is a bar. In the second a page meets the
    intervals that may hold a cosine over the lowest bar of its own, nearest first and CHUNK of them in a task; bars rise
    as pages pass, and k rows at most are passed on of each vector and task. A zero vector has the cosine 0 to all others."""
    zero = ~F.exists("embedding", lambda x: x != 0)
    usable = durable(vectors.where(~zero).select("rid", "embedding"), "sphere-vectors")
    packed, sphere = build(usable)

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in b.column("rows"):
                ids, x = rows.values.field("rid").to_numpy(zero_copy_only=False), _unit(rows.values.field("embedding"))
                top = _TopK(ids, x, k, np.full(len(ids), -np.inf))
                top.add(ids, x)
                yield top.rows()

    schema = "u long, v long, sim double"
    order = W.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    own = durable(packed.select("rows").mapInArrow(itself, schema).withColumn("rank", F.row_number().over(order)), "page-top")
    bars = own.where(F.col("rank") == k).select(F.col("u").alias("rid"), (F.col("sim") - SLACK).alias("bar"))
    placed = packed.select("page", "interval", F.explode("rows.rid").alias("rid")).join(bars, "rid", "left")
    barred = placed.groupBy("page", "interval").agg(F.map_from_entries(F.collect_list(F.struct("rid", F.coalesce("bar", F.lit(float("-inf"))).alias("bar")))).alias("bars"))
    barred = durable(barred, "page-bars")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for page, interval, bar in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                apart = sphere.apart(interval)
                at = np.flatnonzero(np.cos(np.minimum(apart, np.pi)) >= bar - SLACK)
                at = sphere.keys[at[np.argsort(apart[at], kind="stable")]].tolist()
                for column, values in zip(out, ([page] * len(at), at, [i // CHUNK for i in range(len(at))], range(1, len(at) + 1)), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["page", "interval", "chunk", "turn"])

    plan = barred.select("page", "interval", F.array_min(F.map_values("bars")).alias("bar")).mapInArrow(near, "page long, interval long, chunk long, turn long")
    plan = durable(plan, "page-plan")
    # A task gets the page itself first (turn 0, with its bars), then the others in turn.
    first = plan.select("page", "chunk").distinct().join(packed.select("page", "rows"), "page").join(barred.select("page", "bars"), "page")
    first = first.select("page", "chunk", F.lit(0).cast("long").alias("turn"), F.col("page").alias("other"), "rows", "bars")
    others = plan.join(packed.select("interval", F.col("page").alias("other"), "rows"), "interval").where("page <> other")
    others = others.select("page", "chunk", "turn", "other", "rows", F.lit(None).cast("map<bigint,double>").alias("bars"))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = first.unionByName(others).repartition(tasks, "page", "chunk").sortWithinPartitions("page", "chunk", "turn", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        for b in batches:
            for at in range(b.num_rows):
                rows = b.column("rows")[at].values
                ids, x = rows.field("rid").to_numpy(zero_copy_only=False), _unit(rows.field("embedding"))
                if b.column("turn")[at].as_py() == 0:
                    if top is not None:
                        yield top.rows()
                    bar = dict(b.column("bars")[at].as_py())
                    top = _TopK(ids, x, k, np.array([bar[i] for i in ids.tolist()]))
                else:
                    top.add(ids, x)
        if top is not None:
            yield top.rows()

    found = own.select("u", "v", "sim").unionByName(stream.mapInArrow(run, schema))
    zeros = vectors.where(zero).select("rid")
    if not zeros.isEmpty():
        found = found.unionByName(_beside_zeros(vectors.select("rid"), zeros, k))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _beside_zeros(everyone: DataFrame, zeros: DataFrame, k: int) -> DataFrame:
    """(u, v, sim) with cosine 0: the k + 1 least ids for each zero vector, and the k + 1 least zero vectors for all others."""
    least = lambda ids: [r["rid"] for r in ids.orderBy("rid").limit(k + 1).collect()]
    of = lambda rows, ids: rows.select(F.col("rid").alias("u"), F.explode(F.array(*[F.lit(i) for i in ids]).cast("array<bigint>")).alias("v"), F.lit(0.0).alias("sim"))
    both = of(zeros, least(everyone)).unionByName(of(everyone.join(zeros, "rid", "left_anti"), least(zeros)))
    return both.where("u <> v")

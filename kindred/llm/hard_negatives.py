"""Hard-negative mining by one-dimensional distance keys.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest length, and an anchor a zero: then the squared distance
between them is M^2 + |a|^2 - 2 <a, x>, and the greatest inner products are the nearest neighbours. Every augmented vector
belongs to its nearest pivot, and the table is stored sorted by (pivot, distance to the pivot) in pages; consecutive
pages form an interval of keys, an annulus around a pivot, and the intervals' bounds are a small directory.

By the triangle inequality an annulus bounds the distance, and so the score, of an anchor to all that lies in it. An
anchor scans its nearest annuli first; each further round expands over more of them, but only those that could still
hold a score that is wanted. It ends when no annulus is left that could: then the first k are certified. What is
wanted is the first k within windows of scores, so positives (no limits) and negatives (limits by the positive's score)
are searched alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.llm.common import durable, finite
from kindred.llm.embedding_dedup import kmeans
from kindred.llm.vector_codes import integers
from kindred.operators.ordering import ranked

SCALE, FIRST = 256, 5
#: A negative's score is at least so many hundredths of the positive's, and at most all of it.
LEAST_PERCENT = 80
#: Integer components go so far; a component beyond it, over 8,192 before scaling, counts as that.
LARGEST = 2**21
#: Vectors of a page, anchors that scan a page together, and intervals of the directory at most.
PAGE, ANCHORS, INTERVALS = 2048, 512, 4096
#: Vectors that pivots are fitted on, and numbers that the driver holds of them at most.
SAMPLE, SAMPLE_NUMBERS = 10_000, 5_000_000
#: Pivots of one dimension at most, and the least number.
PIVOTS = (4, 64)
#: Shares of all vectors that each round of expansion may reach, nearest annuli first.
EXPANSION = (1 / 16, 1 / 4, 1.0)
_LOWEST, _HIGHEST = -(2**62), 2**62


@dataclass
class Directory:
    """Intervals of keys, few enough to go with every task; one that crosses to another pivot or dimension is cut there."""

    size: int  # vectors
    square: int  # M^2
    pivots: dict[int, np.ndarray]  # by dimension, augmented; none: the origin
    intervals: dict[int, np.ndarray]  # by dimension: rows of (interval, pivot, least, greatest distance, vectors)

    def order(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """((interval, pivot) rows, vectors before each, upper bounds, lower bounds of the score), nearest annuli first."""
        d = len(query)
        rows = self.intervals[d]
        square = float(query @ query)
        pivots = self.pivots.get(d)
        if pivots is None:
            away = np.full(len(rows), sqrt(square))
        else:
            away = np.sqrt(((pivots[:, :-1] - query) ** 2).sum(axis=1) + pivots[:, -1] ** 2)[rows[:, 1].astype(np.int64)]
        near = np.maximum(np.maximum(rows[:, 2] - away, away - rows[:, 3]), 0)
        score = lambda distance: (self.square + square - distance**2) / 2
        slack = 1 + 1e-9 * (self.square + square)  # what rounding of the distances can add
        by = np.lexsort((rows[:, 1], rows[:, 0], near))
        before = np.concatenate([[0], np.cumsum(rows[by, 4])[:-1]])
        return rows[by, :2].astype(np.int64), before, score(near[by]) + slack, score(away[by] + rows[by, 3]) - slack


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: integer components, the label of every seventh id moved by one; one
    row for each vec_id."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    first = usable.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")
    return first.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), integers(F.col("embedding"), SCALE, LARGEST).alias("v"))


def _flat(column: pa.ListArray, at: np.ndarray, d: int) -> np.ndarray:
    return np.asarray(column.take(pa.array(at)).flatten(), np.float64).reshape(len(at), d)


def _augmented(x: np.ndarray, square: int) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1, keepdims=True), 0))], axis=1)


def build(rows: DataFrame) -> tuple[DataFrame, Directory]:
    """Pages (page, interval, d, pivot, rows) of rows(vec_id, label, v), a table that can be read several times, sorted by key, and
    their directory."""
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    size, square = rows.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0))).first()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sizes, pivots = sample.value_lengths().to_numpy(zero_copy_only=False), {}
    wanted = int(min(max(sqrt(size / PAGE), PIVOTS[0]), PIVOTS[1]))
    for d in np.unique(sizes[sizes > 0]).tolist():  # a dimension that the sample lacks is keyed by the origin
        at = np.flatnonzero(sizes == d)[: max(1, SAMPLE_NUMBERS // d)]
        pivots[d] = kmeans(_augmented(_flat(sample, at, d), square), wanted)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("v")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            pivot, distance = np.zeros(b.num_rows, np.int32), np.full(b.num_rows, sqrt(square))
            for d in np.unique(sizes).tolist():
                if d in pivots:
                    at = np.flatnonzero(sizes == d)
                    x = _augmented(_flat(vectors, at, d), square)
                    all_ = np.stack([((x - p) ** 2).sum(axis=1) for p in pivots[d]], axis=1)
                    pivot[at], distance[at] = all_.argmin(axis=1), np.sqrt(all_.min(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes.astype(np.int32)), pa.array(pivot), pa.array(distance)], [*b.schema.names, "d", "pivot", "distance"])

    keyed = rows.mapInArrow(key, "vec_id long, label long, v array<int>, d int, pivot int, distance double")
    placed = ranked(keyed, ["d", "pivot", "distance"], "at")
    span = -(-max(1, -(-size // PAGE)) // INTERVALS)  # pages of an interval
    page = (F.col("at") / PAGE).cast("long")
    placed = placed.withColumn("page", page).withColumn("interval", (F.col("page") / span).cast("long"))
    placed = durable(placed.select("page", "interval", "d", "pivot", "distance", "vec_id", "label", "v"), "distance-keys")
    bounds = placed.groupBy("d", "interval", "pivot").agg(F.min("distance").alias("least"), F.max("distance").alias("most"), F.count("*").alias("n"))
    found = bounds.collect()  # INTERVALS of them, and one more wherever an interval crosses from one pivot to the next
    intervals = {d: np.array([[r["interval"], r["pivot"], r["least"], r["most"], r["n"]] for r in found if r["d"] == d]) for d in {r["d"] for r in found}}
    pages = placed.groupBy("page", "interval", "d", "pivot").agg(F.collect_list(F.struct("vec_id", "label", "v")).alias("rows"))
    return durable(pages, "key-pages"), Directory(size, int(square), pivots, intervals)


_WANTS = "array<struct<key:long,low:long,high:long>>"


def _visits(asked: DataFrame, directory: Directory, since: float, until: float) -> DataFrame:
    """(interval, pivot, anchor_id, label, v, wants) of the intervals in this round's reach that may hold a wanted score."""
    order, size = directory.order, directory.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, to = [], [np.zeros((0, 2), np.int64)]
            for i in range(b.num_rows):
                intervals, before, most, least = order(np.array(b.column("v")[i].as_py(), np.float64))
                near = (before >= since * size) & (before < until * size)
                some = np.zeros(len(intervals), bool)
                for w in b.column("wants")[i].as_py():
                    some |= (most >= w["low"]) & (least <= w["high"])
                hit = intervals[near & some]
                of += [i] * len(hit)
                to.append(hit)
            at, to = pa.array(of, pa.int64()), np.concatenate(to)
            yield pa.RecordBatch.from_arrays([pa.array(to[:, 0]), pa.array(to[:, 1]), *[b.column(c).take(at) for c in ("anchor_id", "label", "v", "wants")]], ["interval", "pivot", "anchor_id", "label", "v", "wants"])

    return asked.select("anchor_id", "label", "v", "wants").mapInArrow(run, f"interval long, pivot long, anchor_id long, label long, v array<int>, wants {_WANTS}")


def _firsts(ids: np.ndarray, scores: np.ndarray, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k ids and scores within [low, high], greatest scores first, ties by id."""
    at = np.flatnonzero((scores >= low) & (scores <= high))
    if len(at) > 4 * k:
        bar = -np.partition(-scores[at], k - 1)[k - 1]
        at = at[scores[at] >= bar]
    at = at[np.lexsort((ids[at], -scores[at]))[:k]]
    return ids[at], scores[at]


def _scanned(visits: DataFrame, pages: DataFrame, exact_in_doubles: bool, anchors: int, same_label: bool, k: int) -> DataFrame:
    """(anchor_id, key, vec_id, score): of each visited page the first k in each of an anchor's windows."""
    parts = max(1, -(-anchors // ANCHORS))
    asking = visits.groupBy("interval", "pivot", F.size("v").alias("d"), F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).alias("part"))
    asking = asking.agg(F.collect_list(F.struct("anchor_id", "label", "v", "wants")).alias("asking")).drop("part")
    # An interval's pages and the blocks of anchors that visit it meet by its key, in a shuffle always: a file of visits has an
    # anchor's vector many times and is a hundredth of what its rows take in memory, so by its size it would be broadcast.
    units = pages.drop("page").hint("merge").join(asking, ["interval", "pivot", "d"]).select("rows", "asking")
    kind = np.float64 if exact_in_doubles else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in range(b.num_rows):
                rows, asked = b.column("rows")[u].values, b.column("asking")[u].values
                ids, labels = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                who, own = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("anchor_id", "label"))
                wants = asked.field("wants").to_pylist()
                out: list[list] = [[], [], [], []]
                vectors = [np.asarray(x.field("v").flatten(), kind).reshape(len(x), -1) for x in (asked, rows)]
                scores = (vectors[0] @ vectors[1].T).astype(np.int64)
                for i, s in enumerate(scores):
                    usable = np.flatnonzero(((labels == own[i]) == same_label) & (ids != who[i]))
                    for w in wants[i]:
                        found, score = _firsts(ids[usable], s[usable], w["low"], w["high"], k)
                        for column, values in zip(out, ([who[i]] * len(found), [w["key"]] * len(found), found.tolist(), score.tolist()), strict=True):
                            column += values
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["anchor_id", "key", "vec_id", "score"])

    return units.mapInArrow(run, "anchor_id long, key long, vec_id long, score long")


def first_in_windows(asked: DataFrame, pages: DataFrame, directory: Directory, same_label: bool, k: int = FIRST) -> DataFrame:
    """(anchor_id, key, vec_id, score, rank): for each window (key, low, high) of asked(anchor_id, label, v, wants) the
    first k other vectors of the same label, or of different ones, whose score lies in it."""
    order = W.partitionBy("anchor_id", "key").orderBy(F.col("score").desc(), "vec_id")
    anchors, since, found = asked.count(), 0.0, None
    tasks = max(1, -(-anchors // ANCHORS))  # the file of all that ask is small; what a task makes of it isn't
    for until in EXPANSION:
        visits = durable(_visits(asked.repartition(tasks, "anchor_id"), directory, since, until), "visits")
        if visits.isEmpty():
            since = until
            continue
        new = _scanned(visits, pages, directory.square < 2**53, anchors, same_label, k)
        merged = new if found is None else new.unionByName(found.drop("rank"))
        found = durable(merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
        full = found.where(F.col("rank") == k).select("anchor_id", "key", F.col("score").alias("bar"))
        raised = asked.select("anchor_id", F.explode("wants").alias("w")).select("anchor_id", "w.*").join(full, ["anchor_id", "key"], "left")
        raised = raised.select("anchor_id", F.struct("key", F.greatest("low", F.coalesce("bar", "low")).alias("low"), "high").alias("w"))
        wants = raised.groupBy("anchor_id").agg(F.collect_list("w").alias("wants"))
        asked, since = durable(asked.drop("wants").join(wants, "anchor_id"), "asked"), until
    return found if found is not None else asked.sparkSession.createDataFrame([], "anchor_id long, key long, vec_id long, score long, rank int")


def mine(vectors: DataFrame, every: int = 100, k: int = FIRST, percent: int = LEAST_PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for anchors whose vec_id is divisible by
    `every` among vectors(vec_id, embedding, label).

    Rows with a null id, label or vector, or a null or non-finite component take no part. A vec_id that stands on several
    rows is taken once, with its least label and vector. Only vectors of one dimension have a score. Ties go by the smaller
    vec_id. An anchor without positives, or a positive without negatives in its window, has no rows; nor has an empty
    table. Other columns are left out, whatever their names.
    """
    rows = durable(prepared(vectors), "integer-vectors")
    pages, directory = build(rows)
    anchors = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "anchor_id")
    window = lambda key, low, high: F.struct(key.cast("long").alias("key"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    positives = first_in_windows(anchors.withColumn("wants", F.array(window(F.lit(0), F.lit(_LOWEST), F.lit(_HIGHEST)))), pages, directory, True, k)
    positives = positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    least = F.ceil(F.col("positive_score") * percent / F.lit(100).cast("decimal(3,0)"))
    wants = positives.select("anchor_id", window(F.col("positive_id"), least, F.col("positive_score")).alias("w")).where("w.low <= w.high")
    wants = wants.groupBy("anchor_id").agg(F.collect_list("w").alias("wants"))
    negatives = first_in_windows(durable(anchors.join(wants, "anchor_id"), "asked"), pages, directory, False, k)
    negatives = negatives.select("anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return negatives.join(positives, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP11_SQL = f"""
WITH one AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) = 1
), v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM one
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {FIRST}
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND {LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= {FIRST}
"""

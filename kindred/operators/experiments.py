"""Audit of record tables and ground truth, blocking sweeps, and batching of clustering tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import blocking, graph, joins, metrics
from kindred.operators.ordering import ranked
from kindred.operators.storage import durable


def audit(records: DataFrame, key: str, truth: DataFrame | None = None) -> DataFrame:
    """One row on records' natural key: n, least, greatest, distinct, contiguous (0 to n - 1 once each), and with
    truth(rid, cluster) the ids outside that range and a verdict."""
    row = records.agg(F.count("*").alias("n"), F.min(key).cast("long").alias("least"), F.max(key).cast("long").alias("greatest"), F.countDistinct(key).alias("n_distinct"))
    row = row.withColumn("contiguous", (F.col("n_distinct") == F.col("n")) & (F.col("least") == 0) & (F.col("greatest") == F.col("n") - 1))
    if truth is None:
        return row
    used = truth.select(F.col("rid").cast("long").alias("rid")).distinct().crossJoin(F.broadcast(row.select("n")))  # n is one row
    outside = used.agg(F.count("*").alias("n_truth"), F.count_if((F.col("rid") < 0) | (F.col("rid") >= F.col("n"))).alias("n_outside"))
    return row.crossJoin(outside).withColumn("verdict", F.when(F.col("contiguous") & (F.col("n_outside") == 0), "KEEP").otherwise("DELETE"))


def blocking_sweep(vectors: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """One row per threshold: quality of the exact blocks against truth(rid, cluster).

    Pairs over the least threshold (under 1) are found once, between the first of equal vectors and from each other one to
    its first. The blocks at every threshold follow from one maximum spanning forest of those pairs."""
    pairs = joins.cosine_links(vectors, min(thresholds)).select(F.col("u").alias("a"), F.col("v").alias("b"), "sim")
    blocks = durable(graph.partitions_over(vectors, graph.spanning_forest(pairs), thresholds), "sweep-blocks")
    # A record that the blocks or the truth lack is alone there, at every threshold.
    steps = blocks.sparkSession.createDataFrame([(float(t),) for t in sorted(set(thresholds))], "threshold double")
    known = truth.select("rid", F.col("cluster").cast("string").alias("t"))
    labels = blocks.select("threshold", "rid", F.col("cluster").cast("string").alias("p")).join(known.crossJoin(F.broadcast(steps)), ["threshold", "rid"], "full_outer")
    alone = F.concat(F.lit("alone_"), F.col("rid").cast("string"))
    table = labels.groupBy("threshold", F.coalesce("p", alone).alias("p"), F.coalesce("t", alone).alias("t")).agg(F.count("*").alias("n"))
    return metrics.block_quality(table, "threshold")


def task_similarities(links: DataFrame) -> DataFrame:
    """(a, b, sim), both ways, of the linkage(cu, cv, sim) between tasks as clusters of records."""
    met = links.select(F.col("cu").alias("a"), F.col("cv").alias("b"), "sim")
    return met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


class TaskPool:
    """Tasks 0 to n - 1 in order of id, not all taken yet, and what is known of their similarities.

    near[m] lists (task, similarity to m). A batch costs the entries of its members, whatever number of tasks is left."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, sim: np.ndarray):
        order = np.argsort(b, kind="stable")
        self.n, self.a, self.sim, self.start = n, a[order], sim[order], np.searchsorted(b[order], np.arange(n + 1))
        self.after = np.arange(n + 1)  # a task that is left points to itself, another one further on; n: none

    def left_from(self, at: int) -> int:
        """The first task left from at on; n without one."""
        end = at
        while self.after[end] != end:
            end = self.after[end]
        while self.after[at] != end:
            self.after[at], at = end, self.after[at]
        return int(end)

    def take(self, task: int) -> int:
        self.after[task] = task + 1
        return task

    def next_of(self, members: list[int], sign: int) -> int:
        """The task left with the greatest sign * (greatest similarity to a member, 0 where none is known), the first of several."""
        known: dict[int, list[float]] = {}
        for m in members:
            for t, s in zip(self.a[self.start[m] : self.start[m + 1]].tolist(), self.sim[self.start[m] : self.start[m + 1]].tolist(), strict=True):
                if self.after[t] == t:
                    known.setdefault(t, []).append(s)
        value = {t: sign * max(s + [0.0] * (len(s) < len(members))) for t, s in known.items()}
        best = min(((-v, t) for t, v in value.items()), default=(0.0, self.n))
        if best[0] < 0:
            return best[1]
        plain = self.left_from(0)  # the first one that counts as 0: unknown to all members, or known and 0
        while plain < self.n and value.get(plain, 0.0) != 0:
            plain = self.left_from(plain + 1)
        return plain if plain < self.n else best[1]


def batches(tasks: DataFrame, sims: DataFrame, strategy: str, size: int = 3, seed: int = 0) -> DataFrame:
    """(batch, pos, task) of the distinct tasks, in batches of `size`.

    similar / dissimilar: the smallest task left, joined by the task with the greatest / least similarity to any in
    the batch, the smaller id of several. random: the order (7 * seed + 3) mod n onwards, reversed for an even seed.
    sims(a, b, sim): similarity of task a to member b; of a repeated one the greatest counts, a missing one is 0, those of a
    task to itself and null ones are left out. The first two strategies choose each batch from what all batches before it
    left, so one task goes through ids and similarities (24 bytes each) in order; its time grows with their number only."""
    ids = ranked(tasks.where("task IS NOT NULL").select("task").distinct(), ["task"], "at")
    if strategy == "random":
        rows = ids.crossJoin(F.broadcast(ids.agg(F.count("*").alias("n"))))  # n is one row
        turned = F.pmod(F.col("at") - (7 * seed + 3), F.col("n"))
        rows = rows.select("task", (F.col("n") - 1 - turned if seed % 2 == 0 else turned).alias("at"))
        return rows.select(F.floor(F.col("at") / size).alias("batch"), (F.col("at") % size).cast("long").alias("pos"), "task")
    sign = {"similar": 1, "dissimilar": -1}[strategy]
    placed = durable(ids.select("at", "task"), "tasks-in-order")
    of = lambda end: placed.select(F.col("task").alias(end), F.col("at").alias(f"at_{end}"))
    met = sims.where("a <> b AND sim IS NOT NULL").join(of("a"), "a").join(of("b"), "b")
    met = met.groupBy(F.col("at_a").alias("a"), F.col("at_b").alias("b")).agg(F.max("sim").cast("double").alias("sim"))
    listed = placed.select(F.col("at").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("sim"))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], []]
        n = 0
        for rows in found:
            known = rows.filter(pc.is_valid(rows["b"]))
            n += rows.num_rows - known.num_rows
            for kept, c in zip(columns, ("a", "b", "sim"), strict=True):
                kept.append(known[c].to_numpy())
        pool = TaskPool(n, *[np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(columns, (np.int64, np.int64, float), strict=True)])
        out: list[tuple[int, int, int]] = []
        first, batch = pool.left_from(0), 0
        while first < n:
            members = [pool.take(first)]
            while len(members) < size and (chosen := pool.next_of(members, sign)) < n:
                members.append(pool.take(chosen))
            out += [(batch, pos, t) for pos, t in enumerate(members)]
            first, batch = pool.left_from(0), batch + 1
            if len(out) > 50_000 or first == n:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["batch", "pos", "at"])
                out = []

    chosen = listed.unionByName(met).repartition(1).mapInArrow(run, "batch long, pos long, at long")
    return chosen.join(placed, "at").select("batch", "pos", "task")


def pooled(pool: DataFrame, predictions: DataFrame) -> DataFrame:
    """(rid, cluster) of pool(rid): the first of each record's predictions(pos, rid, cluster), alone without one."""
    first = predictions.groupBy("rid").agg(F.min_by("cluster", F.struct("pos", "cluster")).cast("string").alias("cluster"))
    alone = F.concat(F.lit("alone_"), F.col("rid").cast("string"))
    return pool.select("rid").distinct().join(first, "rid", "left").select("rid", F.coalesce("cluster", alone).alias("cluster"))


def repeats(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, mean, deviation) of a value over repeated runs; the deviation is the population's."""
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def restricted(truth: DataFrame, n: int, ids: DataFrame) -> DataFrame:
    """truth(rid, cluster) for exactly ids(rid): rows outside 0 to n - 1 go, a record without one is alone."""
    inside = truth.where((F.col("rid") >= 0) & (F.col("rid") < n)).select("rid", F.col("cluster").cast("string").alias("cluster"))
    rest = ids.select("rid").join(inside, "rid", "left_anti").select("rid", F.concat(F.lit("alone_"), F.col("rid").cast("string")).alias("cluster"))
    return inside.join(ids.select("rid"), "rid", "left_semi").unionByName(rest)


def anchors_by_mode(vectors: DataFrame, records: DataFrame, text: str, mode: str, n: int) -> DataFrame:
    """(rid) of n anchors: `centroid` nearest to the centroid of all, `hash` least hash of the text, `all`."""
    if mode == "all":
        return vectors.select("rid")
    return blocking.central_anchors(vectors, n) if mode == "centroid" else blocking.hashed_anchors(records, text, n)

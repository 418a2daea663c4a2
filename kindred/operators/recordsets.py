"""Record sets: each block is dealt into small ordered sets that a clusterer sees at a time."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions.vectors import centroids, euclidean
from kindred.operators.clustering import LARGEST_GROUP, SAMPLE, SEED, kmeans_groups, whole_group
from kindred.operators.ordering import ranked
from kindred.operators.storage import durable, release

#: Records of a set, and clusters that it should span.
SET_SIZE, SET_SPREAD = 9, 4
#: Share of the records of a k-means clustering that sets take before those left are clustered again.
TAKEN = 0.5
#: Records of the largest block whose vectors one task holds; the sets are the same on either side of it.
LARGEST_BLOCK = 20000
#: Digits of a distance to a centroid that count; equal ones are in order of rid.
DIGITS = 9


def chain(vectors: np.ndarray) -> list[int]:
    """Positions of the vectors from the first on, each followed by the most similar one left (the earliest of several)."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    sims, left, out = unit @ unit.T, list(range(1, len(vectors))), list(range(min(1, len(vectors))))
    while left:
        out.append(left.pop(int(sims[out[-1], left].argmax())))
    return out


@lru_cache(maxsize=4096)
def variation(counts: tuple[int, ...]) -> float:
    """Population coefficient of variation of the positive counts; 0 without any."""
    used = np.array([c for c in counts if c > 0], float)
    return float(used.std() / used.mean()) if len(used) else 0.0


def picked(labels: list[int], far: np.ndarray, size: int = SET_SIZE, spread: int = SET_SPREAD) -> list[list[int]]:
    """Sets of positions that one clustering of a block's records gives, none of them chained yet.

    A set takes a quota of each cluster with so many records left, nearest to the centroid first, and is filled up so that
    clusters stay even, with the first record of the cluster chosen. Sets end once TAKEN of all records are taken; up to
    `size` records that are left before that are the last set. Each cluster has two queues, by distance and by position,
    from which taken records go when they come to the front."""
    total, taken, gone, quota = len(labels), 0, bytearray(len(labels)), max(1, size // spread)
    of: dict[int, list[int]] = {}
    for i, label in enumerate(labels):
        of.setdefault(label, []).append(i)
    names = sorted(of)
    first = {n: deque(of[n]) for n in names}
    near = {n: deque(sorted(of[n], key=lambda i: (far[i], i))) for n in names}
    left = {n: len(of[n]) for n in names}

    def take(queue: deque, label: int) -> int:
        while gone[queue[0]]:
            queue.popleft()
        gone[queue[0]], left[label] = 1, left[label] - 1
        return queue.popleft()

    def front(label: int) -> int:
        while gone[first[label][0]]:
            first[label].popleft()
        return first[label][0]

    out = []
    while total - taken > size and (not taken or taken < TAKEN * total):
        chosen, counts = [], {}
        for n in names:
            want = min(quota, size - len(chosen))
            if want and left[n] >= quota:
                queue = first[n] if left[n] == quota else near[n]
                chosen += [take(queue, n) for _ in range(want)]
                counts[n] = want
        while len(chosen) < size:
            live = sorted((n for n in names if left[n]), key=front)
            n = min(live, key=lambda n: variation(tuple((counts | {n: counts.get(n, 0) + 1}).values())))
            chosen.append(take(first[n], n))
            counts[n] = counts.get(n, 0) + 1
        out.append(chosen)
        taken += size
    if 0 < total - taken <= size:
        out.append([i for i in range(total) if not gone[i]])
    return out


def sets_of(rids: Sequence[int], draws: Sequence[int], embeddings: Sequence | np.ndarray, size: int = SET_SIZE, spread: int = SET_SPREAD) -> list[list[int]]:
    """The record sets of a block whose vectors a task holds, given its records in order of rid."""
    x, draw, left, out = np.asarray(embeddings, float), np.array(draws, np.int64), np.arange(len(rids)), []
    while len(left):
        labels, far = np.zeros(len(left), np.int64), np.zeros(len(left))
        if len(left) > size:
            part = x[left]
            labels = whole_group(part, draw[left] % len(left) < SAMPLE, spread)[1]
            means = np.stack([part[labels == n].mean(axis=0) for n in range(labels.max() + 1)])
            far = np.round(np.linalg.norm(part - means[labels], axis=1), DIGITS)
        sets = [left[s] for s in picked(labels.tolist(), far, size, spread)]
        out += [[rids[s[i]] for i in chain(x[s])] for s in sets]
        left = np.setdiff1d(left, np.concatenate(sets))
    return out


def dealt(vectors: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, rid, draw, embedding) of blocks(rid, cluster); draw decides which records first centers are drawn from."""
    return blocks.select("rid", F.col("cluster").alias("block")).join(vectors.select("rid", "embedding"), "rid").select("block", "rid", F.xxhash64("rid", F.lit(SEED)).alias("draw"), "embedding")


def record_sets(vectors: DataFrame, blocks: DataFrame, size: int = SET_SIZE, spread: int = SET_SPREAD, largest: int = LARGEST_BLOCK) -> DataFrame:
    """(block, set_no, pos, rid): the record sets of each block of blocks(rid, cluster), set_no from 0 on in order of making.

    The records of a block are clustered by k-means, sets are picked from the clusters until half of the records are taken,
    and those left are clustered again, so that all clusterings of a block take in twice its records. Up to 2 * size records that
    is one clustering for each set. Blocks of any size have the same sets: one task makes those of a block of up to
    `largest` records, larger ones are clustered by rounds of jobs until so few are left."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid")
        found = sets_of(rows["rid"].tolist(), rows["draw"].tolist(), np.stack(rows["embedding"].to_list()), size, spread)
        out = [(rows["first"].iloc[0] + n, pos, rid) for n, chosen in enumerate(found) for pos, rid in enumerate(chosen)]
        return pd.DataFrame(out, columns=["set_no", "pos", "rid"]).assign(block=rows["block"].iloc[0])[["block", "set_no", "pos", "rid"]]

    blocks = durable(blocks.select("rid", "cluster"), "blocks")  # read several times, and often a long plan
    members = blocks.select("rid", F.col("cluster").alias("block")).join(vectors.select("rid"), "rid")
    sizes = durable(members.groupBy("block").agg(F.count("*").alias("n"), F.min("rid").alias("rid")), "block-sizes")
    zero = F.lit(0).cast("long")
    out = sizes.where("n = 1").select("block", zero.alias("set_no"), zero.alias("pos"), "rid")  # blocks of one record need no Python
    rows = dealt(vectors, blocks).withColumn("first", zero)
    small = rows.join(sizes.where(f"n > 1 AND n <= {largest}").select("block"), "block", "left_semi")
    large = sizes.where(F.col("n") > largest).select("block")
    if not large.isEmpty():
        made, rest = large_sets(rows.join(large, "block", "left_semi"), size, spread, largest)
        out, small = out.unionByName(made), small.unionByName(rest)
    return out.unionByName(small.groupBy("block").applyInPandas(run, "block long, set_no long, pos long, rid long"))


def large_sets(rows: DataFrame, size: int, spread: int, largest: int) -> tuple[DataFrame, DataFrame]:
    """(sets, rest) of rows(block, rid, draw, embedding, first): the sets that are made until a block has up to `largest`
    records left, and those records, first being the number of their block's next set.

    Vectors stay in Spark's partitions. Picking is sequential: a task has a label and a distance of each record of a block,
    about 200 bytes with the queues, and no vector."""

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rid")
        rids, first = part["rid"].to_numpy(), int(part["first"].iloc[0])
        sets = picked(part["cluster"].tolist(), part["far"].to_numpy(), size, spread)
        lengths = [len(s) for s in sets]
        return pd.DataFrame({"rid": rids[np.concatenate(sets)], "set_no": np.repeat(np.arange(first, first + len(sets)), lengths), "pos": np.concatenate([np.arange(n) for n in lengths])}).assign(block=part["block"].iloc[0])

    def chained(frames):
        for frame in frames:
            for block, set_no, members in zip(frame["block"], frame["set_no"], frame["members"], strict=True):
                order = chain(np.array([m["embedding"] for m in members], float))
                yield pd.DataFrame({"block": block, "set_no": set_no, "pos": range(len(order)), "rid": [members[i]["rid"] for i in order]})

    made, rest, left = [], [], durable(rows, "large-blocks")
    while True:
        clusters = durable(kmeans_groups(left.select("block", "rid", "embedding"), "block", spread, min(largest, LARGEST_GROUP)).select("block", "rid", "cluster"), "block-clusters")
        labelled = left.join(clusters, ["block", "rid"])
        middle = centroids(labelled, "block", "cluster")
        far = labelled.join(middle, ["block", "cluster"]).select("block", "first", "rid", "cluster", F.round(euclidean(F.col("embedding"), F.col("centroid")), DIGITS).alias("far"))
        sets = durable(far.groupBy("block").applyInPandas(pick, "rid long, set_no long, pos long, block long"), "picked-sets")
        members = F.array_sort(F.collect_list(F.struct("pos", "rid", "embedding"))).alias("members")  # of one set
        full = sets.join(left.select("block", "rid", "embedding"), ["block", "rid"]).groupBy("block", "set_no").agg(members)
        made.append(durable(full.mapInPandas(chained, "block long, set_no long, pos long, rid long"), "large-sets"))
        then = sets.groupBy("block").agg((F.max("set_no") + 1).alias("first"))
        kept = left.drop("first").join(sets.select("block", "rid"), ["block", "rid"], "left_anti").join(then, "block")
        kept = durable(kept, "large-blocks")
        release(left, clusters, sets)
        number = durable(kept.groupBy("block").count(), "block-sizes")
        few, more = number.where(F.col("count") <= largest), number.where(F.col("count") > largest)
        left = kept
        if not few.isEmpty():  # else the next round alone reads what is kept
            rest.append(kept.join(few, "block", "left_semi"))
            left = kept.join(more, "block", "left_semi")
        if more.isEmpty():
            break
    return reduce(DataFrame.unionByName, made), reduce(DataFrame.unionByName, rest)


def slices(members: DataFrame, size: int = 10) -> DataFrame:
    """(cluster, set_no, pos, rid): each cluster's records by rid in slices of a fixed size."""
    at = F.row_number().over(W.partitionBy("cluster").orderBy("rid")) - 1
    return members.withColumn("at", at).select("cluster", F.floor(F.col("at") / size).alias("set_no"), (F.col("at") % size).cast("long").alias("pos"), "rid")


def round_robin(members: DataFrame, size: int = 10) -> DataFrame:
    """(set_no, pos, rid): one record of each cluster in turn, by rid, in sets of a fixed size."""
    turn = members.withColumn("turn", F.row_number().over(W.partitionBy("cluster").orderBy("rid")))
    return ranked(turn, ["turn", "cluster"], "at").select(F.floor(F.col("at") / size).alias("set_no"), (F.col("at") % size).alias("pos"), "rid")

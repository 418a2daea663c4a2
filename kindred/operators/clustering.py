"""k-means and elbow on the groups of a record table: small ones as grouped functions, large ones by rounds of Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.storage import durable, release

SEED, STARTS, ROUNDS = 42, 10, 100
#: Records of the largest group that a task takes whole.
LARGEST_GROUP = 5000
#: Records, about, of a group that its first centers are drawn from, and of the parts that a large group is dealt into.
SAMPLE, PART_ROWS = 2000, 1024
#: Relative fall of the inertia under which a start of a group has settled, and by which starts differ.
SETTLED, ALIKE = 1e-4, 1e-9


def kmeans(x: np.ndarray, k: int, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(labels numbered by first appearance, inertia): best of STARTS k-means++ starts; all 0 for fewer than k rows.

    A round moves all starts that haven't settled by two matrix products; x is centered first, for precision."""
    if not len(x):
        return np.zeros(0, np.int64), 0.0
    x = x - x.mean(axis=0)
    length = (x * x).sum(axis=1)
    if k == 1 or len(x) < k:
        return np.zeros(len(x), np.int64), float(length.sum())
    rng = np.random.default_rng(seed)
    centers = np.stack([spread_centers(x, k, rng) for _ in range(STARTS)])
    labels, inertia, live = np.zeros((STARTS, len(x)), np.int64), np.full(STARTS, np.inf), np.arange(STARTS)
    for _ in range(ROUNDS):
        old = centers[live]
        square = length[:, None, None] - 2 * (x @ old.reshape(-1, x.shape[1]).T).reshape(len(x), -1, k) + (old * old).sum(axis=2)
        of = square.argmin(axis=2)
        labels[live], inertia[live] = of.T, np.maximum(square.min(axis=2), 0).sum(axis=0)
        member = (of[:, :, None] == np.arange(k)).astype(float)
        count = member.sum(axis=0)[:, :, None]
        sums = (member.reshape(len(x), -1).T @ x).reshape(old.shape)
        centers[live] = np.where(count > 0, sums / np.maximum(count, 1), old)
        live = live[~np.isclose(centers[live], old, atol=1e-12).all(axis=(1, 2))]
        if not len(live):
            break
    best = 0
    for s in range(1, STARTS):
        if inertia[s] < inertia[best] - 1e-12:
            best = s
    number: dict[int, int] = {}
    return np.array([number.setdefault(int(c), len(number)) for c in labels[best]]), float(inertia[best])


def spread_centers(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the rows, each drawn by its squared distance to those before it (k-means++)."""
    chosen, far = [int(rng.integers(len(x)))], np.full(len(x), np.inf)
    while len(chosen) < k:
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        weights = far / far.sum() if far.sum() > 0 else None
        chosen.append(int(rng.choice(len(x), p=weights)))
    return x[chosen]


def elbow(inertias: list[float]) -> int:
    """k (from 1) of the point farthest from the chord of both normalised ends; the first of several."""
    y = np.array(inertias, float)
    if y[0] <= 1e-12:
        return 1
    x = np.linspace(0, 1, len(y))
    y = (y - y.min()) / (np.ptp(y) or 1)
    chord = np.array([x[-1] - x[0], y[-1] - y[0]])
    distance = np.abs(chord[0] * (y - y[0]) - chord[1] * (x - x[0])) / np.hypot(*chord)
    return int(np.round(distance, 12).argmax()) + 1


def choose_k(x: np.ndarray, most: int) -> int:
    """Number of clusters by the elbow, up to most."""
    return elbow_kmeans(x, most)[0]


def elbow_kmeans(x: np.ndarray, most: int) -> tuple[int, np.ndarray]:
    """(k, labels) of k-means with as many clusters as the elbow asks for, up to most."""
    most = min(most, len(x))
    if len(x) < 2 or most <= 2:
        k = 1 if len(x) < 2 else most
        return k, kmeans(x, k)[0]
    runs = [kmeans(x, k) for k in range(1, most + 1)]
    k = elbow([inertia for _, inertia in runs])
    return k, runs[k - 1][0]


def runs_of(most: int) -> tuple[list[int], np.ndarray]:
    """Numbers of clusters of all runs, STARTS for each k from 1 to most, and where the centers of each run begin."""
    ks = [k for k in range(1, most + 1) for _ in range(STARTS)]
    return ks, np.concatenate([[0], np.cumsum(ks)])


def first_centers(x: np.ndarray, ks: list[int]) -> np.ndarray:
    """Centers of all runs, end to end, drawn from x."""
    rng = np.random.default_rng(SEED)
    return np.concatenate([spread_centers(x, k, rng) for k in ks])


def squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)


def lloyd_sums(x: np.ndarray, centers: np.ndarray, at: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Sums of each center's records, their numbers, and each run's inertia, end to end: of the live runs, 0 for the others."""
    sums, count, inertia = np.zeros(centers.shape), np.zeros(len(centers)), np.zeros(len(live))
    if live.any():  # else other groups move on
        moving, place, a = np.flatnonzero(np.repeat(live, np.diff(at))), np.arange(len(x)), 0
        far = squares(x, centers[moving])
        near = np.zeros(far.shape)
        for run in np.flatnonzero(live):
            z = a + at[run + 1] - at[run]
            of = a + far[:, a:z].argmin(axis=1)
            near[place, of], inertia[run], a = 1, far[place, of].sum(), z
        sums[moving], count[moving] = near.T @ x, near.sum(axis=0)
    return np.concatenate([sums.ravel(), count, inertia])


def lloyd_move(total: np.ndarray, centers: np.ndarray, before: np.ndarray, at: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centers, inertia, live runs) after a round. A run that has settled keeps its centers and inertia, and is summed up no more;
    a center without records stays too."""
    cut = centers.size
    count, inertia = total[cut : cut + at[-1], None], np.where(live, total[cut + at[-1] :], before)
    live = live & (inertia < np.where(np.isfinite(before), before * (1 - SETTLED), np.inf))
    moves = np.repeat(live, np.diff(at))[:, None] & (count > 0)
    return np.where(moves, total[:cut].reshape(centers.shape) / np.maximum(count, 1), centers), inertia, live


def chosen_run(inertia: np.ndarray, most: int) -> tuple[int, int]:
    """(k, run): as many clusters as the elbow asks for, most if that is 1 or 2, by the first start as good as the best."""
    table = inertia.reshape(most, STARTS)
    k = most if most <= 2 else elbow(table.min(axis=1).tolist())
    return k, (k - 1) * STARTS + int(np.flatnonzero(table[k - 1] <= table[k - 1].min() * (1 + ALIKE) + 1e-12)[0])


def whole_group(x: np.ndarray, drawn: np.ndarray, most: int) -> tuple[int, np.ndarray]:
    """(k, labels numbered by first appearance) of a group that one task takes whole; first centers are of the rows drawn."""
    most = min(most, len(x))
    ks, at = runs_of(most)
    centers, inertia, live = first_centers(x[drawn] if drawn.any() else x, ks), np.full(len(ks), np.inf), np.ones(len(ks), bool)
    for _ in range(ROUNDS):
        used = centers
        centers, inertia, live = lloyd_move(lloyd_sums(x, used, at, live), used, inertia, at, live)
        if not live.any():
            break
    k, run = chosen_run(inertia, most)
    number: dict[int, int] = {}
    return k, np.array([number.setdefault(c, len(number)) for c in squares(x, used[at[run] : at[run + 1]]).argmin(axis=1).tolist()], np.int64)


def kmeans_groups(vectors: DataFrame, by: str, most: int = 5, largest: int = LARGEST_GROUP) -> DataFrame:
    """(by, rid, k, cluster) of each group of vectors(by, rid, embedding), a null one included.

    Clusters are the same whatever the size of a group: first centers are drawn by k-means++ from the records whose hash
    is below SAMPLE of the group's number, and each start moves over all records until its inertia falls by less than
    SETTLED. Up to `largest` records a task does so for a whole group; larger ones take rounds of jobs, all such groups
    together, so no task has a group of them whole."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid")
        k, labels = whole_group(np.array(rows["embedding"].tolist(), float), rows["drawn"].to_numpy(), most)
        return pd.DataFrame({"group": rows["group"], "rid": rows["rid"], "k": k, "cluster": labels})

    groups = durable(vectors.groupBy(by).agg(F.count("*").alias("n"), F.min("rid").alias("group")), "kmeans-groups")
    rows = vectors.select(F.col(by).alias("_by"), "rid", "embedding")
    drawn = F.pmod(F.xxhash64("rid", F.lit(SEED)), F.col("n")) < SAMPLE
    rows = rows.join(groups, F.col("_by").eqNullSafe(F.col(by))).select("group", "n", "rid", "embedding", drawn.alias("drawn"))
    out = rows.where(F.col("n") <= largest).groupBy("group").applyInPandas(run, "group long, rid long, k long, cluster long")
    if not groups.where(F.col("n") > largest).isEmpty():
        out = out.unionByName(large_groups(rows.where(F.col("n") > largest), most))
    return out.join(groups.select(by, "group"), "group").select(by, "rid", "k", "cluster")


def large_groups(rows: DataFrame, most: int) -> DataFrame:
    """(group, rid, k, cluster) of rows(group, n, rid, embedding, drawn) by Lloyd's rounds over all records.

    A round assigns the records of every group to the centers of all k up to `most` and all starts at once; a task passes on
    one sum for each center of a group. Starts that have settled are left out. Only the first centers come from the rows drawn. Rounds end when no start of any
    group is live, after ROUNDS at most; a group must have `most` records."""
    ks, at = runs_of(most)
    salt = F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / PART_ROWS))
    packed = durable(rows.groupBy("group", salt.alias("part")).agg(F.collect_list("rid").alias("rids"), F.flatten(F.collect_list("embedding")).cast("array<double>").alias("x")), "kmeans-parts")

    def flags(live: pa.ListScalar) -> np.ndarray:
        return live.values.to_numpy(zero_copy_only=False)

    def start(sample: pd.DataFrame) -> pd.DataFrame:
        x = np.array(sample.sort_values("rid")["embedding"].tolist(), float)
        return pd.DataFrame({"group": sample["group"].iloc[:1], "centers": [first_centers(x, ks).ravel()], "inertia": [np.full(len(ks), np.inf)], "live": [np.ones(len(ks), bool)]})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each stretch of parts of one group: its lloyd_sums."""
        group, total = None, None
        for b in batches:
            for i in range(b.num_rows):
                d = len(b["x"][i]) // len(b["rids"][i])
                part = lloyd_sums(np.asarray(b["x"][i].values).reshape(-1, d), np.asarray(b["centers"][i].values).reshape(-1, d), at, flags(b["live"][i]))
                if group is not None and group != b["group"][i].as_py():
                    yield pa.RecordBatch.from_pydict({"group": [group], "total": [total]})
                    total = None
                group, total = b["group"][i].as_py(), part if total is None else total + part
        if group is not None:
            yield pa.RecordBatch.from_pydict({"group": [group], "total": [total]})

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                old = np.asarray(b["centers"][i].values)
                new, inertia, live = lloyd_move(np.asarray(b["total"][i].values), old.reshape(at[-1], -1), np.asarray(b["inertia"][i].values), at, flags(b["live"][i]))
                columns = {"group": [b["group"][i].as_py()], "centers": [new.ravel()], "used": [old], "inertia": [inertia], "live": [live]}
                yield pa.RecordBatch.from_pydict(columns)

    state = durable(rows.where("drawn").groupBy("group").applyInPandas(start, "group long, centers array<double>, inertia array<double>, live array<boolean>"), "kmeans-centers")
    for _ in range(ROUNDS):
        long = packed.join(state, "group").select("group", "rids", "x", "centers", "live").mapInArrow(sums, "group long, total array<double>")
        added = long.select("group", F.posexplode("total").alias("at", "v")).groupBy("group", "at").agg(F.sum("v").alias("v"))
        total = added.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias("total"))
        before, both = state, total.join(state, "group").select("group", "total", "centers", "inertia", "live")
        state = durable(both.mapInArrow(moved, "group long, centers array<double>, used array<double>, inertia array<double>, live array<boolean>"), "kmeans-centers")
        release(before)
        if state.where(F.exists("live", lambda run: run)).isEmpty():
            break

    def choice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                k, run = chosen_run(np.asarray(b["inertia"][i].values), most)
                used = np.asarray(b["used"][i].values).reshape(at[-1], -1)
                yield pa.RecordBatch.from_pydict({"group": [b["group"][i].as_py()], "k": [k], "centers": [used[at[run] : at[run + 1]].ravel()]})

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rids = b["rids"][i].values
                x, group, k = np.asarray(b["x"][i].values).reshape(len(rids), -1), b["group"][i].as_py(), b["k"][i].as_py()
                near = squares(x, np.asarray(b["centers"][i].values).reshape(k, -1)).argmin(axis=1)
                yield pa.RecordBatch.from_pydict({"group": pa.array([group] * len(rids), pa.int64()), "rid": rids, "k": pa.array([k] * len(rids), pa.int64()), "near": pa.array(near)})

    chosen = state.select("group", "used", "inertia").mapInArrow(choice, "group long, k long, centers array<double>")
    placed = durable(packed.join(chosen, "group").select("group", "rids", "x", "k", "centers").mapInArrow(assigned, "group long, rid long, k long, near long"), "kmeans-placed")
    # Clusters are numbered by their first record, like those of a small group: a group has `most` at most.
    number = placed.groupBy("group", "near").agg(F.min("rid").alias("least")).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("least", "near"))).alias("order"))
    number = number.select("group", F.posexplode("order").alias("cluster", "one")).select("group", F.col("one.near").alias("near"), F.col("cluster").cast("long").alias("cluster"))
    return placed.join(number, ["group", "near"]).select("group", "rid", "k", "cluster")

"""Hierarchical merge: clusters of a block's record sets are joined through their representatives, round by round."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kindred.operators import blocking, clusterers, graph
from kindred.operators.recordsets import SET_SIZE, SET_SPREAD
from kindred.operators.storage import durable

MAX_ROUNDS = 20
#: For complete merges: share of its clusters that a block keeps at most in a round of packing or dealing before another one,
#: sets of about MEAN in which dealing shows each cluster, and clusters of the largest block whose pairs all meet without dealing.
SHRUNK, TURNS, MEAN, ALL_PAIRS = 0.8, 8, 6, 128
#: Bits of a set's number within its run, and sets of a run before the first round; later runs are chunks of packing.
RUN, RUN_SETS = 32, 1024


def pack(sizes: list[int], sim: Callable[[tuple[int, int], tuple[int, int]], float], size: int = SET_SIZE, spread: int = SET_SPREAD) -> list[list[tuple[int, int]]]:
    """Sets of (set, cluster) for the next round, given the number of clusters of each set.

    Sets are taken in chunks of `size`, and a chunk in contiguous groups of ceil(chunk / spread). Until a chunk is
    empty, every pass makes one set: of each group the first cluster left, and from each of the group's other sets
    the cluster left that is most similar to it (the first of several)."""
    out = []
    for a in range(0, len(sizes), size):
        left = {s: list(range(sizes[s])) for s in range(a, min(a + size, len(sizes)))}
        step = max(1, -(-len(left) // spread))
        groups = [list(left)[g : g + step] for g in range(0, len(left), step)]
        while any(left.values()):
            packed = []
            for group in groups:
                live = [s for s in group if left[s]]
                if not live:
                    continue
                anchor = (live[0], left[live[0]].pop(0))
                packed.append(anchor)
                for s in live[1:]:
                    sims = [sim(anchor, (s, c)) for c in left[s]]
                    packed.append((s, left[s].pop(int(np.argmax(sims)))))
            out.append(packed)
    return out


def packed(set_nos: list[int], embeddings: list, size: int = SET_SIZE, spread: int = SET_SPREAD) -> list[list[int]]:
    """pack() of representatives in order of (set, cluster), as their positions."""
    x = np.array(embeddings, float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    of_set = [[i for i, s in enumerate(set_nos) if s == n] for n in dict.fromkeys(set_nos)]
    sim = lambda p, q: float(x[of_set[p[0]][p[1]]] @ x[of_set[q[0]][q[1]]])
    return [[of_set[s][c] for s, c in chosen] for chosen in pack([len(s) for s in of_set], sim, size, spread)]


def packed_sets(reps: DataFrame, size: int = SET_SIZE, spread: int = SET_SPREAD) -> DataFrame:
    """(set_id, pos, rid, chunk, nth) of representatives for the next round, (chunk, nth) being the set's order in its block;
    reps: block, set_no, cluster_no, rid, embedding.

    Sets are numbered within runs, which set_no has above its RUN lowest bits, and only the runs' counts of a block meet in one
    place. A block with up to `size` representatives is one set. Otherwise pack() takes chunks of `size` sets, each by itself, so
    a task has the representatives of one chunk at a time, whatever the block's size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["set_no", "cluster_no"]).reset_index(drop=True)
        block, chunk = rows["block"].iloc[0], rows["chunk"].iloc[0]
        whole = rows["count"].iloc[0] <= size
        sets = [list(range(len(rows)))] if whole else packed(rows["set_no"].tolist(), rows["embedding"].tolist(), size, spread)
        out = [(f"{block}-{chunk}-{k}", pos, rows["rid"][i], chunk, k) for k, s in enumerate(sets) for pos, i in enumerate(s)]
        return pd.DataFrame(out, columns=["set_id", "pos", "rid", "chunk", "nth"])

    sets = reps.select("block", "set_no").distinct().withColumn("run", F.shiftright("set_no", RUN))
    before = F.sum("count").over(W.partitionBy("block").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    runs = sets.groupBy("block", "run").count().select("block", "run", F.coalesce(before, F.lit(0)).alias("before"))
    within = sets.withColumn("within", F.row_number().over(W.partitionBy("block", "run").orderBy("set_no")) - 1)
    chunks = within.join(runs, ["block", "run"]).select("block", "set_no", F.floor((F.col("before") + F.col("within")) / size).alias("chunk"))
    placed = reps.join(chunks, ["block", "set_no"]).join(reps.groupBy("block").count(), "block")
    return placed.groupBy("block", "chunk").applyInPandas(run, "set_id string, pos long, rid long, chunk long, nth long")


def merged(state: DataFrame, vectors: DataFrame, clusterer, max_rounds: int = MAX_ROUNDS, size: int = SET_SIZE, spread: int = SET_SPREAD, complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members(block, rid, cluster), calls): clusters of state(block, set_no, place, rid, cluster) joined across sets.

    A round takes every block that still has several clusters and merged something in the round before: its
    clusters' representatives are packed, clustered under the guardrail, and clusters whose representatives fall
    together become one. Sets follow by set_no, and clusters of a set by place, that of their first record; after a round
    every cluster is a set of its own, in the order in which packing put the first of its representatives. cluster is a global
    id, the least of those joined. A representative is looked for again only if its cluster has grown.

    Packing keeps neighbours together, so rounds can end with clusters that never met. complete: a block leaves these rounds once
    one joins few of its clusters, and settled() lets all that it has left meet."""
    state, calls = durable(state, "merge-state"), []
    several = state.groupBy("block").agg(F.countDistinct("cluster").alias("n")).where("n > 1").select("block")
    done, apart = [state.join(several, "block", "left_anti").select("block", "rid", "cluster")], []
    live = state.join(several, "block", "left_semi").withColumn("rep", F.lit(None).cast("long"))
    live = durable(live.withColumn("set_no", F.shiftleft(F.floor(F.col("set_no") / RUN_SETS), RUN) + F.col("set_no") % RUN_SETS), "merge-state")
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        found = blocking.representatives(vectors, live.where("rep IS NULL").select("rid", "cluster")).withColumnRenamed("rid", "found")
        heads = live.groupBy("block", "set_no", "cluster").agg(F.min("place").alias("place"), F.min("rep").alias("rep")).join(found, "cluster", "left")
        heads = heads.withColumn("rep", F.coalesce("rep", "found")).drop("found")
        order = W.partitionBy("block", "set_no").orderBy("place", "cluster")
        heads = heads.withColumn("cluster_no", F.row_number().over(order)).join(vectors.select(F.col("rid").alias("rep"), "embedding"), "rep")
        heads = durable(heads, "representatives")
        sets = packed_sets(heads.select("block", "set_no", "cluster_no", F.col("rep").alias("rid"), "embedding"), size, spread)
        sets = durable(sets, "packed-sets")
        answer, log = clusterers.clustered(sets.select("set_id", "pos", "rid"), vectors, clusterer)
        calls.append(log)
        of_rep = answer.select("set_id", F.col("rid").alias("rep"), F.col("cluster").alias("group"))
        of_rep = of_rep.join(sets.withColumnRenamed("rid", "rep"), ["set_id", "rep"]).join(heads.select("block", "rep", "cluster"), "rep")
        group = W.partitionBy("set_id", "group")
        order = F.shiftleft("chunk", RUN) + F.shiftleft("nth", 16) + F.min("pos").over(group)
        rep = F.when(F.count("*").over(group) == 1, F.col("rep"))  # that of a cluster which stays as it is
        joined = durable(of_rep.select("block", F.col("cluster").alias("old"), F.min("cluster").over(group).alias("new"), order.alias("order"), rep.alias("rep")), "merged-clusters")
        changed = joined.groupBy("block").agg(F.bool_or(F.col("old") != F.col("new")).alias("moved"), F.countDistinct("new").alias("n"), F.countDistinct("old").alias("was"))
        again = F.col("moved") & (F.col("n") > 1)
        if complete:
            again = (F.col("n") > 1) & (F.col("was") > size) & (F.col("n") <= SHRUNK * F.col("was"))
        again = changed.select("block", again.alias("again"), ((F.col("n") > 1) & (F.col("was") > size)).alias("apart"))
        renamed = live.select("rid", F.col("cluster").alias("old")).join(joined.join(again, "block"), "old")
        renamed = durable(renamed.select("block", F.col("order").alias("set_no"), F.lit(0).cast("long").alias("place"), "rid", F.col("new").alias("cluster"), "rep", "again", "apart"), "merge-state")
        left = renamed.where(~F.col("again"))
        if complete:
            apart.append(left.where("apart").select("block", "rid", "cluster"))
            left = left.where(~F.col("apart"))
        done.append(left.select("block", "rid", "cluster"))
        live = renamed.where("again").drop("again", "apart")
    if complete:
        members, more = settled(_union([*apart, live.select("block", "rid", "cluster")]), vectors, clusterer, size)
        done, calls = [*done, members], calls + more
    else:
        done.append(live.select("block", "rid", "cluster"))
    return _union(done), _union(calls) if calls else None


def dealt_sets(heads: DataFrame, turn: int, size: int = SET_SIZE) -> DataFrame:
    """(set_id, pos, rid) of heads(block, cluster, rid, n): TURNS times, each block's are dealt by a hash into sets of up to `size`."""
    each = heads.withColumn("turn", F.explode(F.sequence(F.lit(turn * TURNS), F.lit((turn + 1) * TURNS - 1))))
    placed = each.withColumn("hash", F.xxhash64("cluster", "turn")).withColumn("bucket", F.pmod(F.col("hash"), F.ceil(F.col("n") / MEAN)))
    at = F.row_number().over(W.partitionBy("block", "turn", "bucket").orderBy("hash", "cluster")) - 1  # a bucket has a few
    placed = placed.withColumn("at", at)
    return placed.select(F.concat_ws("-", "block", "turn", "bucket", F.floor(F.col("at") / size)).alias("set_id"), (F.col("at") % size).cast("long").alias("pos"), "rid")


def paired_sets(heads: DataFrame, size: int = SET_SIZE) -> DataFrame:
    """(set_id, pos, rid) of heads(block, cluster, rid, n): sets of up to `size` in which every two of a block's meet."""
    half = max(1, size // 2)
    at = F.row_number().over(W.partitionBy("block").orderBy("cluster")) - 1
    placed = heads.withColumn("at", at).withColumn("group", F.floor(F.col("at") / half)).withColumn("groups", F.ceil(F.col("n") / half))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).where("other <> group OR groups = 1")
    name = F.concat_ws("-", "block", F.lit("pair"), F.least("group", "other"), F.greatest("group", "other"))
    return each.select(name.alias("set_id"), F.col("at").cast("long").alias("pos"), "rid")


def settled(members: DataFrame, vectors: DataFrame, clusterer, size: int = SET_SIZE) -> tuple[DataFrame, list[DataFrame]]:
    """(members(block, rid, cluster), calls of each round), every two clusters that are left of a block having met in a set.

    A cluster is shown in several sets of a round, and what falls together in any of them is joined. A block of up to ALL_PAIRS
    clusters has sets for all pairs of them. In a larger one clusters are dealt by hashes first, for as long as that joins many; the
    pairs of those that are left after it grow with the square of their number, which is that of the block's entities at least."""
    live, done, calls, turn = durable(members, "unsettled"), [], [], 0
    live = live.withColumn("paired", F.lit(False))
    while not live.isEmpty():
        least = live.select("block", "cluster", "paired").distinct()
        n = least.groupBy("block").agg(F.count("*").alias("n"), (F.first("paired") | (F.count("*") <= ALL_PAIRS)).alias("pairs"))
        heads = blocking.representatives(vectors, live.select("rid", "cluster")).join(least.select("block", "cluster"), "cluster").join(n, "block")
        heads = durable(heads, "representatives")
        sets = durable(dealt_sets(heads.where("NOT pairs"), turn, size).unionByName(paired_sets(heads.where("pairs"), size)), "settling-sets")
        answer, log = clusterers.clustered(sets, vectors, clusterer)
        calls.append(log)
        of = answer.select("set_id", "rid", F.col("cluster").alias("group")).join(heads.select("rid", "cluster"), "rid")
        links = of.select(F.col("cluster").alias("a"), F.min("cluster").over(W.partitionBy("set_id", "group")).alias("b")).where("a <> b")
        joined = durable(graph.union_clusters(live.select("block", "rid", "cluster"), links.distinct()).join(n, "block"), "settled")
        now = joined.groupBy("block").agg(F.countDistinct("cluster").alias("now"))
        joined = joined.join(now, "block")
        over = F.col("pairs") | (F.col("now") == 1)
        done.append(joined.where(over).select("block", "rid", "cluster"))
        live = durable(joined.where(~over).select("block", "rid", "cluster", (F.col("now") > SHRUNK * F.col("n")).alias("paired")), "unsettled")
        turn += 1
    return _union([members.where("false"), *done]), calls


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_by_pairs(members: DataFrame, same: DataFrame) -> DataFrame:
    """members(rid, cluster) with the clusters of same(a, b) record pairs joined."""
    of = lambda end: members.select(F.col("rid").alias(end), F.col("cluster").alias(f"c{end}"))
    links = same.join(of("a"), "a").join(of("b"), "b")
    return graph.union_clusters(members, links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))

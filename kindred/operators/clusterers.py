"""Clusterers of record sets, and the guarded rounds in which sets are clustered, checked and tried again.

A clusterer sees the records of one set and groups them. It is called inside Spark tasks, a batch of sets at a time;
everything around it (missing and foreign ids, the guardrail, the order of another try) is a DataFrame plan over all
sets of a round at once. One with ordered = False gives a set the same answer in any order of its records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import ClassVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kindred.operators import graph, guard, joins
from kindred.operators.storage import durable

#: Further tries after a rejected clustering.
MAX_TRIES = 2


@dataclass
class Oracle:
    """Groups records by a known entity: truth(rid, cluster). Records without one are alone. A join, no Python."""

    truth: DataFrame
    ordered: ClassVar[bool] = False

    def cluster(self, sets: DataFrame, attempt: int) -> DataFrame:
        known = sets.join(self.truth.select("rid", F.col("cluster").alias("entity")), "rid", "left")
        entity = F.coalesce(F.col("entity").cast("string"), F.concat(F.lit("alone_"), F.col("rid").cast("string")))
        return known.withColumn("cluster", F.dense_rank().over(W.partitionBy("set_id").orderBy(entity)).cast("long")).select("set_id", "rid", "cluster")


@dataclass
class Threshold:
    """Groups records by components of cosine similarity of at least `at_least` within the set."""

    vectors: DataFrame
    at_least: float
    ordered: ClassVar[bool] = False

    def cluster(self, sets: DataFrame, attempt: int) -> DataFrame:
        rows = sets.select("set_id", "rid", F.lit(0).alias("cluster"))
        close = guard.set_similarities(rows, self.vectors).where(F.col("sim") >= self.at_least)
        # A set has few records: the components of all sets are found at once over (set, record) vertices.
        vertex = lambda r: F.xxhash64("set_id", r)
        found = graph.components(close.select(vertex("u").alias("a"), vertex("v").alias("b")))
        led = rows.withColumn("id", vertex("rid")).join(found, "id", "left")
        return led.select("set_id", "rid", F.coalesce("component", "id").alias("cluster"))


@dataclass
class Callback:
    """Groups records by a function of (record ids, texts) to lists of ids, e.g. a call to a language model.

    The function runs in tasks; a retried task calls it again, so it should keep its own cache if calls cost."""

    records: DataFrame
    text: str
    call: Callable[[list[int], list[str]], list[list[int]]]

    def cluster(self, sets: DataFrame, attempt: int) -> DataFrame:
        call = self.call
        rows = sets.join(self.records.select("rid", F.col(self.text).alias("text")), "rid")

        def run(one: pd.DataFrame) -> pd.DataFrame:
            one = one.sort_values("pos")
            ids = [int(i) for i in one["rid"]]
            out = [(i, k) for k, group in enumerate(call(ids, one["text"].tolist())) for i in group]
            frame = pd.DataFrame(out, columns=["rid", "cluster"])
            return frame.assign(set_id=one["set_id"].iloc[0])[["set_id", "rid", "cluster"]]

        return rows.select("set_id", "pos", "rid", "text").groupBy("set_id").applyInPandas(run, "set_id string, rid long, cluster long")


def complete(sets: DataFrame, answers: DataFrame) -> DataFrame:
    """answers(set_id, rid, cluster) for exactly the records of sets(set_id, pos, rid): foreign ids go, an id named
    twice stays in its first cluster, and a missing one gets a cluster of its own after the others."""
    first = answers.groupBy("set_id", "rid").agg(F.min("cluster").alias("cluster"))
    return sets.join(first, ["set_id", "rid"], "left").select("set_id", "pos", "rid", F.coalesce("cluster", F.lit(1 << 62) + F.col("pos")).alias("cluster"))


def numbered(sets: DataFrame) -> DataFrame:
    """Clusters numbered from 0 within each set by first position."""
    start = F.min("pos").over(W.partitionBy("set_id", "cluster"))
    number = F.dense_rank().over(W.partitionBy("set_id").orderBy("start")) - 1
    return sets.withColumn("start", start).withColumn("cluster", number.cast("long")).drop("start")


def clustered(sets: DataFrame, vectors: DataFrame, clusterer, max_tries: int = MAX_TRIES) -> tuple[DataFrame, DataFrame]:
    """(sets with cluster, calls): sets(set_id, pos, rid) clustered under the guardrail.

    A set whose clustering is rejected is asked again, in a new order, up to max_tries times; the last answer stands
    whatever it is; sets is read several times. Sets of one record aren't asked. Where order is nothing to the clusterer, its first answer is that of
    all tries, which are counted without being made. calls: (set_id, calls, rejected)."""
    sized = sets.withColumn("count", F.count("*").over(W.partitionBy("set_id")))  # a set has few records
    alone = sized.where("count = 1").select("set_id", "pos", "rid", F.lit(0).cast("long").alias("cluster"))
    open_ = sized.where("count > 1").drop("count")
    done, calls = [alone], []
    ordered = getattr(clusterer, "ordered", True)
    for attempt in range(max_tries + 1):
        answer = durable(numbered(complete(open_, clusterer.cluster(open_, attempt))), "answers")
        judged = guard.intra_inter(guard.set_similarities(answer, vectors))
        last = attempt == max_tries or not ordered
        wrong = guard.offenders(judged if last else durable(judged, "judged"))  # the last ones are read by the count of calls only
        rejected = wrong.select("set_id").distinct()
        calls.append(answer.select("set_id").distinct().join(rejected.withColumn("rejected", F.lit(1)), "set_id", "left"))
        if last:
            done.append(answer)
            break
        done.append(answer.join(rejected, "set_id", "left_anti"))
        open_ = durable(guard.regenerated(answer.join(rejected, "set_id", "left_semi"), wrong), "open-sets")
        if open_.isEmpty():
            break
    out, log = done[0], calls[0]
    for x in done[1:]:
        out = out.unionByName(x)
    for x in calls[1:]:
        log = log.unionByName(x)
    if not ordered:
        tries = F.when(F.col("rejected") == 1, F.sequence(F.lit(0), F.lit(max_tries))).otherwise(F.array(F.lit(0)))
        log = log.withColumn("attempt", F.explode(tries)).drop("attempt")
    log = log.groupBy("set_id").agg(F.count("*").alias("calls"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"))
    return out, log


def banded_merge(members: DataFrame, links: DataFrame, low: float, high: float, vote: Callable[[DataFrame], DataFrame], width: float = 0.02, probes: int = 10, share: float = 0.5) -> DataFrame:
    """members(rid, cluster) with clusters joined band by band: of the cluster pairs whose linkage (cu, cv, sim) lies in a band of
    [low, high], up to `probes` are put to vote (cells to (cu, cv, yes)), and where the share of yes is reached all
    pairs of the band are joined."""
    links = durable(links, "links")
    votes = vote(joins.band_cells(links, low, high, width, probes))
    bands = joins.band_cells(links, low, high, width)
    accepted = bands.join(votes, ["cu", "cv"]).groupBy("band").agg(F.avg(F.col("yes").cast("int")).alias("share")).where(F.col("share") >= share)
    joined = bands.join(accepted.select("band"), "band", "left_semi")
    return graph.union_clusters(members, joined.select(F.col("cu").alias("a"), F.col("cv").alias("b")))

"""Entity resolution from vectors to a partition: blocks, record sets, guarded clustering, hierarchical merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import clusterers, merge, metrics, recordsets
from kindred.operators.storage import durable


@dataclass(frozen=True)
class Settings:
    """Size and spread of record sets, further tries, rounds of merging, and whether all clusters that these leave
    in a block meet afterwards."""

    set_size: int = recordsets.SET_SIZE
    set_spread: int = recordsets.SET_SPREAD
    max_tries: int = clusterers.MAX_TRIES
    max_rounds: int = merge.MAX_ROUNDS
    complete: bool = False


@dataclass
class Resolution:
    """members(block, rid, cluster) and calls(stage, set_id, calls, rejected)."""

    members: DataFrame
    calls: DataFrame

    def statistics(self) -> DataFrame:
        """One row: sets asked, calls, rejected answers."""
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
        return self.calls.agg(F.count("*").alias("sets"), zero("calls"), zero("rejected"))

    def evaluate(self, truth: DataFrame) -> DataFrame:
        """One row of all metrics against truth(rid, cluster)."""
        return metrics.report(self.members.select("rid", "cluster"), truth)


def resolve(vectors: DataFrame, blocks: DataFrame, clusterer, settings: Settings = Settings()) -> Resolution:
    """Resolve every block of blocks(rid, cluster); all blocks advance together, a round of Spark jobs at a time."""
    sets = recordsets.record_sets(vectors, blocks, settings.set_size, settings.set_spread)
    sets = durable(sets.withColumn("set_id", F.concat_ws("-", "block", "set_no")), "record-sets")
    answer, log = clusterers.clustered(sets.select("set_id", "pos", "rid"), vectors, clusterer, settings.max_tries)
    named = answer.select("set_id", "rid", "cluster").join(sets.select("set_id", "rid", "block", "set_no", "pos"), ["set_id", "rid"])
    least = named.groupBy("set_id", "cluster").agg(F.min("rid").alias("least"), F.min("pos").alias("place"))
    state = named.join(least, ["set_id", "cluster"]).select("block", "set_no", "place", "rid", F.col("least").alias("cluster"))
    members, merge_log = merge.merged(state, vectors, clusterer, settings.max_rounds, settings.set_size, settings.set_spread, settings.complete)
    calls = log.withColumn("stage", F.lit("sets"))
    if merge_log is not None:
        calls = calls.unionByName(merge_log.withColumn("stage", F.lit("merge")))
    return Resolution(durable(members, "resolved"), durable(calls, "calls"))

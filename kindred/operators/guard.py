"""Guardrail on clusterings of record sets: misplaced records, verdicts, and the order for another try."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kindred.functions.vectors import dot, norm


def set_similarities(sets: DataFrame, vectors: DataFrame) -> DataFrame:
    """(set_id, u, v, cu, cv, sim) of all ordered pairs within sets(set_id, rid, cluster), which hold a few records each."""
    rows = sets.join(vectors.select("rid", "embedding", norm(F.col("embedding")).alias("length")), "rid")
    side = lambda *names: rows.select("set_id", *[F.col(c).alias(n) for c, n in zip(("rid", "cluster", "embedding", "length"), names, strict=True)])
    pairs = side("u", "cu", "x", "p").join(side("v", "cv", "y", "q"), "set_id").where("u < v")
    # A pair's cosine is computed once for both of its orders; null for a zero vector.
    once = F.explode(F.array(dot(F.col("x"), F.col("y")) / F.nullif(F.col("p") * F.col("q"), F.lit(0.0)))).alias("sim")
    pairs = pairs.select("set_id", "u", "v", "cu", "cv", once)
    back = F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.col("cv").alias("cu"), F.col("cu").alias("cv"))
    return pairs.select("set_id", F.explode(F.array(F.struct("u", "v", "cu", "cv"), back)).alias("pair"), "sim").select("set_id", "pair.*", "sim")


def intra_inter(pairs: DataFrame) -> DataFrame:
    """(set_id, rid, cluster, intra, inter, target): least similarity to a peer, greatest to a record of another
    cluster, and that cluster (the smallest of several); intra is null without peers, inter without other clusters."""
    other = F.col("cu") != F.col("cv")
    return pairs.groupBy("set_id", F.col("u").alias("rid"), F.col("cu").alias("cluster")).agg(
        F.min(F.when(~other, F.col("sim"))).alias("intra"),
        F.max(F.when(other, F.col("sim"))).alias("inter"),
        F.min_by("cv", F.when(other, F.struct(-F.col("sim"), "cv"))).alias("target"),
    )


def offenders(judged: DataFrame) -> DataFrame:
    """Records less similar to a peer than to some record of another cluster (strictly)."""
    return judged.where(F.col("intra") < F.col("inter"))


def verdicts(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, n_offenders, accepted) for every set."""
    counts = offenders(intra_inter(pairs)).groupBy("set_id").agg(F.count("*").alias("n_offenders"))
    rows = sets.select("set_id").distinct().join(counts, "set_id", "left")
    n = F.coalesce("n_offenders", F.lit(0))
    return rows.select("set_id", n.cast("long").alias("n_offenders"), (n == 0).alias("accepted"))


def separated(pairs: DataFrame) -> DataFrame:
    """(set_id, separated): whether the least similarity within clusters is at least the greatest between them."""
    row = pairs.groupBy("set_id").agg(F.min(F.when(F.col("cu") == F.col("cv"), F.col("sim"))).alias("a"), F.max(F.when(F.col("cu") != F.col("cv"), F.col("sim"))).alias("b"))
    return row.select("set_id", F.coalesce(F.col("a") >= F.col("b"), F.lit(True)).alias("separated"))


def regenerated(sets: DataFrame, wrong: DataFrame) -> DataFrame:
    """sets(set_id, pos, rid, cluster) in the order for another try: offenders leave their cluster and follow the
    members of their target, in their old order; clusters come in order of their number. pos is numbered anew."""
    moved = sets.join(wrong.select("set_id", "rid", "target"), ["set_id", "rid"], "left")
    place = W.partitionBy("set_id").orderBy(F.coalesce("target", "cluster"), F.col("target").isNotNull(), "cluster", "pos")
    return moved.withColumn("pos", (F.row_number().over(place) - 1).cast("long")).select("set_id", "pos", "rid")

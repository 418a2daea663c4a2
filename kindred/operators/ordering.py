"""Global row numbers by an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.operators.storage import durable


def ranked(rows: DataFrame, order: list, name: str = "rid") -> DataFrame:
    """rows with their 0-based position by order, ties by all other columns (maps left out); a column called name is replaced.

    A range exchange deals rows by the keys and a hash of the row, and is written with the number of each row's
    partition before anything else reads it: partitions are cut once, so that counts and rows agree whatever adaptive
    execution does. Only the counts of partitions meet in one place."""
    keep = [c for c in rows.columns if c != name]
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    plain = [c for c, k in rows.dtypes if c in keep and "map<" not in k]
    tie = F.xxhash64(*[rows[f"`{c}`"] for c in plain]) if plain else F.lit(0).cast("long")
    keyed = rows.select(*[k.alias(f"key{i}") for i, k in enumerate(keys)], tie.alias("tie"), F.struct(*[rows[f"`{c}`"] for c in keep]).alias("row"))
    by = [f"key{i}" for i in range(len(keys))] + ["tie"]
    parts = durable(keyed.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("part").count()
    before = F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("offset"))  # a row for each partition
    within = W.partitionBy("part").orderBy(*by, *[F.col("row").getField(c) for c in plain])
    placed = parts.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(offsets), "part")
    return placed.select(*[F.col("row").getField(c).alias(c) for c in keep], (F.col("offset") + F.col("at")).alias(name))

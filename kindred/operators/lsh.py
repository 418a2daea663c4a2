"""Locality-sensitive self-join by signs of projections: candidates from equal signatures, verified by cosine."""

from __future__ import annotations

from functools import lru_cache
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.joins import TILE

#: Vectors of a signature that are compared in one task as they are; more are dealt into parts, each sent once for every other.
BLOCK_ROWS = 8192
BITS, TABLES, SEED = 15, 8, 42
#: The reference's parameters, made for near copies: at a cosine of 0.4 they find about one pair in a hundred.
REFERENCE = {"bits": BITS, "tables": TABLES}
#: Least expected share of found pairs at the threshold itself, and tables that tuned() spends on it at most.
RECALL, MOST_TABLES = 0.9, 64


def tables_for(over: float, bits: int, recall: float = RECALL) -> float:
    """Tables by which a pair with the cosine over has a signature in common with probability recall or more."""
    met = (1 - acos(max(-1.0, min(1.0, over))) / pi) ** bits
    return 1 if met >= recall else ceil(log(1 - recall) / log(1 - met)) if met > 1e-12 else float("inf")


def tuned(over: float, bits: int | None = None, tables: int | None = None, seed: int = SEED) -> dict:
    """Parameters by the lowest cosine asked for: the most bits, BITS at most, whose tables are few enough. What the
    caller names stays; for given bits alone there are as many tables as the threshold needs, TABLES at least.

    With 0 bits, for thresholds that no projection tells apart, every pair is a candidate."""
    if bits is None:
        bits = next(b for b in range(BITS, -1, -1) if b == 0 or tables_for(over, b) <= (tables or MOST_TABLES))
        tables = tables or tables_for(over, bits)
    return {"bits": bits, "tables": tables or max(TABLES, tables_for(over, bits)), "seed": seed}


@lru_cache(maxsize=8)
def planes(dimension: int, bits: int = BITS, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """tables x bits normal vectors, the same wherever they are made."""
    return np.random.default_rng(seed).standard_normal((tables, bits, dimension))


def signatures(vectors: DataFrame, bits: int = BITS, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """vectors(rid, embedding) with sigs: for each table an int of bits signs."""

    def run(batches):
        for b in batches:
            column = b.column(1)
            x = np.asarray(column.flatten(), np.float64).reshape(b.num_rows, -1)
            signs = np.einsum("nd,tbd->ntb", x, planes(x.shape[1], bits, tables, seed)) > 0 if b.num_rows else np.zeros((0, tables, bits), bool)
            codes = signs @ (1 << np.arange(bits))
            sigs = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables), pa.array(codes.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), column, sigs], ["rid", "embedding", "sigs"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("rid", "embedding").mapInArrow(run, f"rid long, embedding {kind}, sigs array<int>")


def lsh_pairs(vectors: DataFrame, over: float, **how) -> DataFrame:
    """(u, v, sim), u < v, of vectors that have a signature in common and a cosine strictly over the threshold.

    how: parameters, by default tuned() to the threshold. Vectors with the same signature in a table are compared in
    one task as a matrix; where there are many, in parts of about BLOCK_ROWS, each pair of parts by itself. A pair is
    made in the first table where both agree only, so no distinct over pairs is needed."""
    signed = signatures(vectors, **tuned(over, **how))
    long = signed.select("rid", "embedding", "sigs", F.posexplode("sigs").alias("table", "sig"))
    large = long.groupBy("table", "sig").count().where(F.col("count") > BLOCK_ROWS)
    sized = long.join(large.select("table", "sig", F.ceil(F.col("count") / BLOCK_ROWS).alias("parts")), ["table", "sig"], "left")
    parted = sized.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    cells = parted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    row = F.struct("rid", "embedding", "part", F.slice("sigs", F.lit(1), F.col("table")).alias("before"))
    cells = cells.select("table", "sig", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), row.alias("row"))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = cells.repartition(tasks, "table", "sig", "i", "j").groupBy("table", "sig", "i", "j").agg(F.collect_list("row").alias("rows"))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                table, i, j = (b.column(c)[k].as_py() for c in ("table", "i", "j"))
                values = b.column("rows")[k].values
                column = lambda name, values=values: values.field(name)
                ids, part = (column(c).to_numpy(zero_copy_only=False) for c in ("rid", "part"))
                x = np.asarray(column("embedding").flatten(), np.float64).reshape(len(ids), -1)
                before = np.asarray(column("before").flatten(), np.int32).reshape(len(ids), table)
                length = np.linalg.norm(x, axis=1)
                some = length > 0  # a zero vector has no cosine
                x = x / np.where(some, length, 1)[:, None]
                left, right = np.flatnonzero(some & (part == i)), np.flatnonzero(some & (part == j))
                step = max(1, TILE // max(1, len(right)))
                for at in range(0, len(left), step):
                    sims = x[left[at : at + step]] @ x[right].T
                    r, c = np.nonzero(sims > over)
                    a, z, sims = left[at + r], right[c], sims[r, c]
                    keep = ids[a] < ids[z] if i == j else ids[a] != ids[z]
                    a, z, sims = a[keep], z[keep], sims[keep]
                    new = ~(before[a] == before[z]).any(axis=1)
                    u, v = ids[a[new]], ids[z[new]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(sims[new])], ["u", "v", "sim"])

    several = packed.where(F.size("rows") > 1).select("table", "i", "j", "rows")
    return several.mapInArrow(run, "u long, v long, sim double")

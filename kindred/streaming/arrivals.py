"""Records that arrive as a stream, blocked against a stored table of known ones.

Known records are signed once and stored by signature; each micro-batch is signed and met with the stored buckets (a
stream-static equi-join), so known records are neither signed again nor shuffled. The pairs of all batches are closed to
clusters whenever they are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.vectors import cosine
from kindred.operators import lsh
from kindred.operators.storage import shared_dir


def buckets(vectors: DataFrame, over: float | None = None, **how) -> DataFrame:
    """(table, sig, rid, embedding, before) of vectors(rid, embedding): a row for each of a record's signatures, with those of
    the tables before it.

    over: the threshold of match_arrivals(), which has its parameters from it."""
    how = how if over is None else lsh.tuned(over, **how)
    rows = lsh.signatures(vectors, **how).select("rid", "embedding", "sigs", F.posexplode("sigs").alias("table", "sig"))
    return rows.select("table", "sig", "rid", "embedding", F.slice("sigs", F.lit(1), F.col("table")).alias("before"))


def store_buckets(vectors: DataFrame, over: float, files: int | None = None, **how) -> str:
    """Name of a new table of buckets(vectors, over), bucketed by (table, sig) into `files` (spark.sql.shuffle.partitions by
    default): a join with it shuffles arrivals only. More known records are inserted as buckets() with the same parameters."""
    spark = vectors.sparkSession
    name, files = f"known_{uuid.uuid4().hex}", files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}"
    out = buckets(vectors, over, **how).repartition(files, "table", "sig").write.bucketBy(files, "table", "sig").sortBy("table", "sig")
    out.option("path", path).option("compression", "zstd").saveAsTable(name)
    return name


def match_arrivals(stream: DataFrame, stored: DataFrame, over: float, **how) -> DataFrame:
    """(u, v, sim) of arrivals u and known records v with a signature in common and a cosine over the threshold.

    stored: buckets() of the known records, best as the table of store_buckets(), with the same threshold and parameters
    (how; by default tuned to the threshold). Works on streams and tables alike. A pair that meets in several tables is made
    in the first only, so the stream needs no state. Zero vectors match nothing; neither does a record itself."""
    arrived = buckets(stream, over, **how).select("table", "sig", F.col("rid").alias("u"), F.col("embedding").alias("x"), F.col("before").alias("a"))
    known = stored.select("table", "sig", F.col("rid").alias("v"), F.col("embedding").alias("y"), F.col("before").alias("b"))
    earlier = F.exists(F.zip_with("a", "b", lambda p, q: p == q), lambda same: same)
    met = arrived.join(known, ["table", "sig"]).where(~earlier & (F.col("u") != F.col("v")))
    return met.select("u", "v", cosine(F.col("x"), F.col("y")).alias("sim")).where(F.col("sim") > over)

"""From a file of records to a file of clusters and a report: every step of a resolution in one call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.functions import vectors as V
from kindred.operators import blocking, clusterers
from kindred.operators.storage import durable
from kindred.plans.resolve import Resolution, Settings, resolve
from kindred.sources import records as S


@dataclass
class Run:
    """What a run used and found."""

    records: DataFrame  # rid, combined_text and the file's columns
    vectors: DataFrame
    threshold: float
    blocks: DataFrame
    resolution: Resolution
    report: DataFrame | None


def hashed(texts: DataFrame) -> DataFrame:
    """(rid, embedding) of texts(rid, text) by hashing tokens, where there is no model."""
    return texts.select("rid", V.hashed_embedding(T.tokens(F.col("text"))).alias("embedding"))


def prepare(records: DataFrame, embed: Callable[[DataFrame], DataFrame] = hashed, over: float | None = None) -> tuple[DataFrame, DataFrame, float, DataFrame]:
    """(records with text, vectors, threshold, blocks) of records(rid, ...). over: a threshold instead of the one that follows
    from the distribution of all cosines."""
    described = durable(records.withColumn("combined_text", T.combined_text(*T.attributes(records))), "described")
    vectors = durable(embed(described.select("rid", F.col("combined_text").alias("text"))), "record-vectors")
    if over is None:
        over = blocking.threshold(vectors).first()["threshold"]
    over = 1.0 if over is None else over  # no records
    return described, vectors, over, durable(blocking.exact_blocks(vectors, over), "blocks")


def run(
    spark: SparkSession, path: str, out: str, embed: Callable[[DataFrame], DataFrame] = hashed, clusterer: Callable[[DataFrame, DataFrame], object] | None = None,
    truth: str | None = None, over: float | None = None, settings: Settings = Settings(),
) -> Run:
    """Resolve the record CSV at path: clusters as lines of ids in out/clusters, and with the path of a ground truth all metrics
    in out/report.

    embed: (rid, text) to (rid, embedding). clusterer: a function of (records, vectors) that makes one; by default records
    of a set are grouped by the threshold that blocks are made by."""
    records, vectors, over, blocks = prepare(S.with_rid(S.read_records(spark, path)), embed, over)
    judge = clusterer(records, vectors) if clusterer else clusterers.Threshold(vectors, over)
    resolution = resolve(vectors, blocks, judge, settings)
    S.write_clusters(resolution.members, f"{out}/clusters")
    report = None
    if truth is not None:
        report = durable(resolution.evaluate(S.read_truth(spark, truth)), "report")
        S.write_report(report, f"{out}/report")
    return Run(records, vectors, over, blocks, resolution, report)

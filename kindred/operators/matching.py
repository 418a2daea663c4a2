"""Matching by candidates: anchors get their top-k records, a selector or scorer judges them, and the closure of the
accepted pairs is the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kindred.operators import graph, joins

#: Questions that prompts begin with.
SELECT = "Which of these records is the same thing as the first one? Answer with its number in brackets, or [0].\n"
MATCH = "Are these the same thing? Answer Yes or No.\n"


def instances_of(vectors: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor, pos, candidate, sim) of the anchors' k candidates, pos from 1; anchors are rows of vectors."""
    rows = joins.top_k_of(anchors, vectors, k)
    return rows.select(F.col("u").alias("anchor"), F.col("rank").cast("long").alias("pos"), F.col("v").alias("candidate"), "sim")


def select_prompts(rows: DataFrame, records: DataFrame, text: str) -> DataFrame:
    """(anchor, prompt): one question per anchor that lists its candidates by number."""
    of = lambda key, name: records.select(F.col("rid").alias(key), F.col(text).alias(name))
    listed = rows.join(of("candidate", "text"), "candidate").groupBy("anchor")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.concat(F.lit("["), x["pos"].cast("string"), F.lit("] "), x["text"]))
    out = listed.agg(F.array_join(lines, "\n").alias("lines")).join(of("anchor", "head"), "anchor")
    return out.select("anchor", F.concat(F.lit(SELECT), F.lit("First: "), "head", F.lit("\n"), "lines").alias("prompt"))


def match_prompts(rows: DataFrame, records: DataFrame, text: str) -> DataFrame:
    """(anchor, candidate, prompt): one yes-or-no question per candidate."""
    of = lambda key, name: records.select(F.col("rid").alias(key), F.col(text).alias(name))
    joined = rows.join(of("anchor", "x"), "anchor").join(of("candidate", "y"), "candidate")
    return joined.select("anchor", "candidate", F.concat(F.lit(MATCH), F.lit("A: "), "x", F.lit("\nB: "), "y").alias("prompt"))


def select_best(rows: DataFrame, over: float) -> DataFrame:
    """Selector without a model: the first candidate, if its similarity is over the threshold. Adds is_match."""
    return rows.withColumn("is_match", (F.col("pos") == 1) & (F.col("sim") > over))


def match_scores(rows: DataFrame, score: Column, single: bool = False) -> DataFrame:
    """rows with score and is_match: a positive score; single: and the anchor's greatest, all that reach it."""
    scored = rows.withColumn("score", score)
    best = F.max("score").over(W.partitionBy("anchor"))
    accept = F.col("score") > 0
    return scored.withColumn("is_match", accept & (F.col("score") == best) if single else accept)


def pointwise_rank(rows: DataFrame) -> DataFrame:
    """rows(anchor, pos, score) with rank by score, the later position first among equals."""
    order = W.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("pos").desc())
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


def matched_clusters(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """(rid, cluster) of all ids by closure of the accepted pairs."""
    return graph.partition(ids, rows.where("is_match").select(F.col("anchor").alias("a"), F.col("candidate").alias("b")))


def confusion(rows: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (tp, fp, fn, tn, precision, recall, f1), or one for each value of `by` (a dataset, say), of is_match
    against equal clusters in truth(rid, cluster)."""
    of = lambda key, name: truth.select(F.col("rid").alias(key), F.col("cluster").alias(name))
    judged = rows.join(of("anchor", "x"), "anchor", "left").join(of("candidate", "y"), "candidate", "left")
    same = F.coalesce(F.col("x") == F.col("y"), F.lit(False))
    yes = F.col("is_match")
    row = judged.groupBy(*by).agg(
        F.count_if(yes & same).alias("tp"), F.count_if(yes & ~same).alias("fp"), F.count_if(~yes & same).alias("fn"), F.count_if(~yes & ~same).alias("tn")
    )
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    row = row.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return row.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_mean(reports: DataFrame) -> DataFrame:
    """One row: mean precision, recall and f1 over the rows of confusion(by=...)."""
    return reports.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def transitive(pairs: DataFrame, settled: DataFrame) -> DataFrame:
    """Of pairs(a, b) those that needn't be asked: some i between a and b - 1 has both (a, i) and (i, b) in settled(a, b)."""
    via = settled.select(F.col("a"), F.col("b").alias("i")).join(settled.select(F.col("a").alias("i"), F.col("b")), "i")
    known = via.where((F.col("i") > F.col("a")) & (F.col("i") < F.col("b") - 1)).select("a", "b").distinct()
    return pairs.join(known, ["a", "b"], "left_semi")


def with_cache(prompts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, open) of prompts(prompt, ...): answers found in cache(key, reply) by SHA-256 of the prompt, and the rest."""
    keyed = prompts.withColumn("key", F.sha2("prompt", 256))
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")

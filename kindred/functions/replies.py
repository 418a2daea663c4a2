"""Parsing of clusterer replies and usage costs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dollars per million tokens of input and of output.
PRICES = (
    ("gpt-3.5-turbo", 0.5, 1.5),
    ("gpt-3.5-turbo-0125", 0.5, 1.5),
    ("gpt-3.5-turbo-instruct", 1.5, 2.0),
    ("gpt-4o-mini", 0.15, 0.6),
    ("gpt-5.4-mini", 0.75, 4.5),
    ("gpt-4o", 5.0, 15.0),
    ("gpt-4o-2024-05-13", 5.0, 15.0),
    ("gpt-4-turbo", 10.0, 30.0),
    ("gpt-4-turbo-2024-04-09", 10.0, 30.0),
    ("gpt-4", 30.0, 60.0),
    ("gpt-3.5-turbo-0301", 1.5, 2.0),
    ("gpt-3.5-turbo-0613", 1.5, 2.0),
    ("gpt-3.5-turbo-16k-0613", 3.0, 4.0),
    ("gpt-3.5-turbo-1106", 1.0, 2.0),
)


def parsed_clusters(reply: Column) -> Column:
    """Array of int arrays from a reply: the innermost bracket groups of digits, empty ones left out."""
    bare = F.regexp_replace(F.regexp_replace(reply, r"[^0-9\[\],]", ""), ",+", ",")
    bare = F.regexp_replace(bare, r",\]", "]")
    groups = F.regexp_extract_all(bare, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    numbers = F.transform(groups, lambda g: F.filter(F.transform(F.split(g, ","), lambda x: F.try_to_number(x, F.lit("9" * 18)).cast("long")), lambda x: x.isNotNull()))
    return F.filter(numbers, lambda g: F.size(g) > 0)


def known_ids(clusters: Column, ids: Column) -> Column:
    """clusters without ids that weren't asked for and without repeats (the first place counts), empty ones left out."""
    start = F.struct(F.array().cast("array<array<bigint>>").alias("out"), F.array().cast("array<bigint>").alias("seen"))

    def step(acc: Column, group: Column) -> Column:
        fresh = F.array_distinct(F.filter(group, lambda i: F.array_contains(ids, i) & ~F.array_contains(acc["seen"], i)))
        return F.struct(F.concat(acc["out"], F.array(fresh)).alias("out"), F.concat(acc["seen"], fresh).alias("seen"))

    return F.aggregate(clusters, start, step, lambda acc: F.filter(acc["out"], lambda g: F.size(g) > 0))


def completed(clusters: Column, ids: Column) -> Column:
    """clusters with every id of ids that is in none as a cluster of its own, in order."""
    missing = F.array_except(ids, F.flatten(clusters))
    return F.concat(clusters, F.transform(missing, lambda i: F.array(i)))


def parsed_batch(reply: Column) -> Column:
    """Map from task `T<n>` to its clusters, from the reply's outermost JSON object; null if it can't be read."""
    return F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "map<string,array<array<bigint>>>")


def selected(reply: Column, n: Column) -> Column:
    """Array of n booleans, true at the first `[k]` of the reply (1-based; none where k is 0 or over n)."""
    k = F.nullif(F.regexp_extract(reply, r"\[(\d+)\]", 1), F.lit("")).try_cast("int")
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(i == k, F.lit(False)))


def yes_no(reply: Column, logprob: Column | None = None) -> Column:
    """1 for a reply with `yes`, else -1 for one with `no`, else 0; with the answer's log-probability, that
    probability instead of 1."""
    low = F.lower(reply)
    sign = F.when(low.contains("yes"), 1).when(low.contains("no"), -1).otherwise(0)
    return sign if logprob is None else sign * F.exp(logprob)


def price_table(spark: SparkSession, prices: tuple = PRICES) -> DataFrame:
    return spark.createDataFrame(list(prices), "model string, prompt double, completion double")


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage(model, in_tokens, out_tokens, ...) with cost in dollars; null for a model without price."""
    cost = (F.col("prompt") * F.col("in_tokens") + F.col("completion") * F.col("out_tokens")) / 1e6
    return usage.join(prices, "model", "left").withColumn("cost", cost).drop("prompt", "completion")

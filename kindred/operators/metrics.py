"""Agreement of two clusterings, all from the sparse contingency table; pairs are counted in closed form."""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.operators import graph
from kindred.operators.storage import durable


def aligned(pred: DataFrame, truth: DataFrame, missing: str = "alone") -> DataFrame:
    """(rid, p, t): labels of both as text; a record that one side lacks is a cluster of its own there (missing="alone")
    or left out (missing="drop")."""
    how = {"alone": "full_outer", "drop": "inner"}[missing]
    both = pred.select("rid", F.col("cluster").cast("string").alias("p")).join(truth.select("rid", F.col("cluster").cast("string").alias("t")), "rid", how)
    alone = F.concat(F.lit("alone_"), F.col("rid").cast("string"))
    return both.select("rid", F.coalesce("p", alone).alias("p"), F.coalesce("t", alone).alias("t"))


def contingency(labels: DataFrame) -> DataFrame:
    """(p, t, n) of labels(rid, p, t)."""
    return labels.groupBy("p", "t").agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def f_measure(a: Column, b: Column, beta: float = 1.0) -> Column:
    """F-beta of precision-like a and recall-like b; 0 if both are."""
    return F.when((beta * beta * a + b) == 0, 0.0).otherwise((1 + beta * beta) * a * b / (beta * beta * a + b))


def purity(table: DataFrame, by: str = "p") -> DataFrame:
    """One row: share of records in the largest cell of their cluster (by p: purity, by t: inverse purity)."""
    tops = table.groupBy(by).agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    return tops.agg(_ratio(F.sum("top"), F.sum("size")).alias("purity" if by == "p" else "inverse_purity"))


def f_purity(table: DataFrame, beta: float = 1.0) -> DataFrame:
    """One row: purity, inverse purity and their F-beta."""
    both = purity(table, "p").crossJoin(purity(table, "t"))  # two single rows
    return both.withColumn("f_measure", f_measure(F.col("purity"), F.col("inverse_purity"), beta))


def bcubed(table: DataFrame) -> DataFrame:
    """One row: mean share of a record's cluster, and of its true cluster, that is in both; and the F1 of the means."""
    sized = table.join(table.groupBy("p").agg(F.sum("n").alias("size_p")), "p").join(table.groupBy("t").agg(F.sum("n").alias("size_t")), "t")
    square = F.col("n") * F.col("n")
    means = sized.agg((F.sum(square / F.col("size_p")) / F.sum("n")).alias("precision"), (F.sum(square / F.col("size_t")) / F.sum("n")).alias("recall"))
    return means.withColumn("f1", f_measure(F.col("precision"), F.col("recall")))


def cluster_purity(table: DataFrame, tolerance: int = 1) -> DataFrame:
    """One row over predicted clusters: mean of their purities, share with a single label, and purity with up to
    `tolerance` strangers a cluster forgiven."""
    each = table.groupBy("p").agg(F.max("n").alias("top"), F.sum("n").alias("size"), F.count("*").alias("labels"))
    forgiven = F.when(F.col("size") - F.col("top") <= tolerance, F.col("size")).otherwise(F.col("top"))
    return each.agg(
        F.avg(F.col("top") / F.col("size")).alias("macro_purity"),
        (F.count_if(F.col("labels") == 1) / F.count("*")).alias("pure_ratio"),
        (F.sum(forgiven) / F.sum("size")).alias("tolerant_purity"),
    )


def pair_counts(table: DataFrame, *by: str) -> DataFrame:
    """One row (tp, fp, fn, tn, n) of record pairs, or one (by..., tp, ...) for each value of columns of the table."""
    total = lambda df, name: df.groupBy(*by).agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias(name))
    sums = lambda side: table.groupBy(*by, side).agg(F.sum("n").alias("n"))
    row = table.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    for one in (total(table, "tp"), total(sums("p"), "sp"), total(sums("t"), "st")):
        row = row.join(one, list(by)) if by else row.crossJoin(one)  # single rows
    whole = _pairs(F.col("n"))
    as_long = lambda c: c.cast("long")
    return row.select(
        *by,
        as_long(F.col("tp")).alias("tp"),
        as_long(F.col("sp") - F.col("tp")).alias("fp"),
        as_long(F.col("st") - F.col("tp")).alias("fn"),
        as_long(whole - F.col("sp") - F.col("st") + F.col("tp")).alias("tn"),
        "n",
    )


def pairwise(table: DataFrame) -> DataFrame:
    """pair_counts with accuracy, precision, recall and f1."""
    c = pair_counts(table)
    c = c.withColumn("accuracy", _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
    c = c.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", f_measure(F.col("precision"), F.col("recall")))


def block_quality(table: DataFrame, *by: str) -> DataFrame:
    """One row for blocks as p, or one for each value of columns of the table: pair completeness, pair quality, their F1,
    and the share of pairs that blocking spares."""
    c = pair_counts(table, *by)
    whole = _pairs(F.col("n"))
    c = c.select(
        *by,
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("completeness"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("quality"),
        F.when(whole == 0, 0.0).otherwise(1 - (F.col("tp") + F.col("fp")) / whole).alias("reduction"),
    )
    return c.withColumn("f1", f_measure(F.col("completeness"), F.col("quality")))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row: adjusted Rand index; 1 where both clusterings are trivial and alike."""
    c = pair_counts(table)
    p, t, whole = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"), F.greatest(_pairs(F.col("n")), F.lit(1.0))
    expected = p.cast("double") * t / whole  # longs overflow from some 250,000 records in ten equal clusters on
    spread = (p + t) / 2 - expected
    return c.select(F.when(spread == 0, 1.0).otherwise((F.col("tp") - expected) / spread).alias("ari"))


def mutual_information(table: DataFrame) -> DataFrame:
    """One row: mutual information over the arithmetic mean of both entropies; 1 if both are 0."""
    total = table.agg(F.sum("n").alias("all"))
    sized = table.join(table.groupBy("p").agg(F.sum("n").alias("np")), "p").join(table.groupBy("t").agg(F.sum("n").alias("nt")), "t").crossJoin(total)
    share = F.col("n") / F.col("all")
    log = lambda x: F.log(F.col(x) / F.col("all"))
    row = sized.agg(
        F.sum(share * (F.log(share) - log("np") - log("nt"))).alias("mi"),
        (-F.sum(share * log("np"))).alias("hp"),
        (-F.sum(share * log("nt"))).alias("ht"),
    )
    mean = (F.col("hp") + F.col("ht")) / 2
    return row.select(F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean).alias("nmi"))


def best_matching(cells: dict[int, list[tuple[int, float]]]) -> float:
    """Greatest total of a one-to-one choice among cells, given as row to (column, gain) with gains of 0 or more: shortest
    augmenting paths with potentials, row by row, over the given cells only. A row may stay without one."""
    u: dict[int, float] = {}
    v: defaultdict[object, float] = defaultdict(float)
    owner: dict[object, int] = {}
    column_of: dict[int, object] = {}
    edges = {r: [*row, ((r,), 0.0)] for r, row in cells.items()}  # (r,): the row's own way out
    for first in edges:
        u[first] = min(-gain - v[c] for c, gain in edges[first])
        dist, back, done, heap = {}, {}, {}, []
        row, base = first, 0.0
        while True:
            for c, gain in edges[row]:
                d = base - gain - u[row] - v[c]
                if c not in done and d < dist.get(c, float("inf")):
                    dist[c], back[c] = d, row
                    heappush(heap, (d, str(c), c))
            while True:
                d, _, c = heappop(heap)
                if c not in done and d == dist[c]:
                    break
            done[c] = d
            if c not in owner:
                break
            row, base = owner[c], d
        for k, at in done.items():
            v[k] += at - d
            if k in owner:
                u[owner[k]] += d - at
        u[first] += d
        while True:
            row = back[c]
            owner[c], column_of[row], c = row, c, column_of.get(row)
            if row == first:
                break
    return sum(dict(edges[r])[c] for r, c in column_of.items())


def accuracy(table: DataFrame) -> DataFrame:
    """One row: share of records in cells of the best one-to-one matching of predicted and true clusters.

    Cells outside a connected component of the table are 0, so each component is matched by itself. With m clusters on
    its smaller side, a best matching exists among the m largest cells of each of them, as at most m - 1 of those can be
    taken by others; so a task holds m * m cells at most, however many clusters the other side has."""
    edges = table.select(F.xxhash64(F.lit("p"), "p").alias("a"), F.xxhash64(F.lit("t"), "t").alias("b"), "n")
    roots = graph.components(edges.select("a", "b")).withColumnRenamed("id", "a")
    cells = durable(edges.join(roots, "a"), "cells")
    sides = cells.groupBy("component").agg(F.countDistinct("a").alias("as"), F.countDistinct("b").alias("bs"))
    sized = cells.join(sides, "component").select("component", "as", "bs", "n", *[F.when(F.col("as") <= F.col("bs"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "few"), ("b", "a", "many"))])
    rank = F.row_number().over(W.partitionBy("few").orderBy(F.col("n").desc(), "many"))
    largest = sized.withColumn("rank", rank).where(F.col("rank") <= F.least("as", "bs")).select("component", "few", "many", "n")

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, list] = {}
        for few, many, n in zip(rows["few"].tolist(), rows["many"].tolist(), rows["n"].tolist(), strict=True):
            found.setdefault(few, []).append((many, float(n)))
        return pd.DataFrame({"matched": [best_matching(found)]})

    matched = largest.groupBy("component").applyInPandas(match, "matched double").agg(F.coalesce(F.sum("matched"), F.lit(0.0)).alias("m"))
    return matched.crossJoin(table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))).select(_ratio(F.col("m"), F.col("all")).alias("accuracy"))


def report(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """One row with all metrics of pred(rid, cluster) against truth(rid, cluster)."""
    table = durable(contingency(aligned(pred, truth)), "contingency")  # read by every metric
    parts = [
        accuracy(table),
        f_purity(table),
        bcubed(table).select(F.col("precision").alias("bcubed_precision"), F.col("recall").alias("bcubed_recall"), F.col("f1").alias("bcubed_f1")),
        cluster_purity(table),
        pairwise(table).select("tp", "fp", "fn", "tn", F.col("accuracy").alias("pair_accuracy"), F.col("precision").alias("pair_precision"), F.col("recall").alias("pair_recall"), F.col("f1").alias("pair_f1")),
        adjusted_rand(table),
        mutual_information(table),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(p)  # single rows
    return row

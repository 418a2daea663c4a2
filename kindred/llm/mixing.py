"""Mixing sources to target weights by nested hash-threshold histograms (DataFrame functions only).

Each document has a uniform 60-bit hash. For every source the words are summed per hash bucket; the running
sum shows in which bucket the word budget is reached, and only that bucket is refined, twice, down to single
hash values. A document is taken if its hash is at or below its source's threshold, so nothing is sorted and
the final filter needs one small row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.llm.common import SPACE_CLASS, durable

#: Bits of the hash, and of each of the two histogram levels.
HASH_BITS, BITS = 60, 12


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than SPACE_CLASS; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    edges = (parts[0] == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - edges).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, get the weights in turn and share `share` of all words; a target
    stops at cap times its source's size and the excess goes to the others by weight. That fixed point is
    min(cap * size, level * weight) for one level, found from running sums over cap * size / weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("top", F.lit(float(cap)) * F.col("source_size"))
    by_need = W.orderBy(F.col("top") / F.col("weight"), "rank")
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    after = by_need.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(W.partitionBy())
    level = (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("top") / F.col("weight"), F.col("level"))
    # From the first source that isn't capped on the levels only fall, so the first that fits is the largest.
    leveled = leveled.withColumn("level", F.coalesce(F.max(fits).over(W.partitionBy()), F.lit(float("inf"))))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("top", F.col("level") * F.col("weight")))
    return leveled.select("source", "source_size", target.alias("target"))


def _boundary(hist: DataFrame, bucket: str) -> DataFrame:
    """Per source the first bucket at which the running words reach `left`, and what is left before it.

    hist: (source, bucket, words, left), at most 2 ** BITS buckets a source."""
    order = W.partitionBy("source").orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = hist.withColumn("run", F.sum("words").over(order)).where(F.col("run") >= F.col("left"))
    first = run.groupBy("source").agg(F.min_by(F.struct(bucket, "run", "words", "left"), F.col(bucket)).alias("at"))
    return first.select("source", F.col(f"at.{bucket}"), (F.col("at.left") - (F.col("at.run") - F.col("at.words"))).alias("left"))


def plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per source: source, source_size, target, copies, cut (a document with ordered hash <= cut gets one more)."""
    key = docs.select("source", _ordered_hash(docs).alias("h"), n_words(docs["text"]).alias("size"))
    key = durable(key, "mix-keys")
    key = key.withColumn("b1", F.shiftright("h", HASH_BITS - BITS)).withColumn("b2", F.shiftright("h", HASH_BITS - 2 * BITS))
    first = durable(key.groupBy("source", "b1").agg(F.sum("size").alias("words")), "mix-histogram")
    goal = targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    copies = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size")))
    goal = goal.withColumn("copies", copies.cast("long"))
    goal = durable(goal.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets")
    need = goal.where("left > 0").select(F.col("source").alias("s"), "left")

    def of_need(rows: DataFrame, need: DataFrame, *also: str) -> DataFrame:
        on = rows["source"].eqNullSafe(need["s"])
        for c in also:
            on = on & (rows[c] == need[f"{c}_at"])
        return rows.join(need, on).drop("s", *[f"{c}_at" for c in also])

    def renamed(found: DataFrame, bucket: str) -> DataFrame:
        return durable(found.select(F.col("source").alias("s"), F.col(bucket).alias(f"{bucket}_at"), "left"), "mix-boundary")

    at1 = renamed(_boundary(of_need(first, need), "b1"), "b1")
    second = of_need(key, at1, "b1").groupBy("source", "b2").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    at2 = renamed(_boundary(second, "b2"), "b2")
    third = of_need(key, at2, "b2").groupBy("source", "h").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    # Of the boundary bucket's few hash values, the last taken is the one that ends nearest to the budget.
    order = W.partitionBy("source").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow)
    third = third.withColumn("run", F.sum("words").over(order))
    none = third.groupBy("source").agg(F.min_by("left", "h").alias("miss"), (F.min("h") - 1).alias("h"))
    miss = F.abs(F.col("run") - F.col("left"))
    ends = third.select("source", "h", miss.alias("miss")).unionByName(none.select("source", "h", "miss"))
    cuts = ends.groupBy(F.col("source").alias("s")).agg(F.min_by("h", F.struct("miss", "h")).alias("cut"))
    plan = goal.join(cuts, goal["source"].eqNullSafe(cuts["s"]), "left")
    return durable(plan.select("source", "source_size", "target", "copies", "cut"), "mix-plan")


def _ordered_hash(docs: DataFrame) -> Column:
    """The first HASH_BITS bits of the MD5 of id and text, which SQL engines compute alike."""
    key = F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(docs["text"], F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _with_mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(row, mix): each row of docs as a struct, so that no column of it can clash, and its size, source_size, target and copies."""
    by = plan(docs, weights, share, cap).select(F.struct("*").alias("plan"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["source"], _ordered_hash(docs).alias("hash"), n_words(docs["text"]).alias("size"))
    rows = rows.join(by, rows["source"].eqNullSafe(by["plan"]["source"]), "left")
    more = F.coalesce((F.col("hash") <= F.col("plan.cut")).cast("int"), F.lit(0))
    copies = F.least(F.col("plan.copies") + more, F.lit(cap)).cast("long")
    return rows.select("row", F.struct("size", "plan.source_size", "plan.target", copies.alias("copies")).alias("mix"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with size, source_size, target (its source's) and copies (0 to cap): how often the mix takes each row.

    Needs columns doc_id, source, text; other columns pass through unless named like an added one, which is
    replaced. Null text has size 0; texts of any length are counted whole; a null source is a source of its own, the
    last in order. Sources are names of collections, a few thousand at most: one task orders them. Rows alike in
    doc_id and text hash alike and are taken together. Sources without words have target 0. An empty table
    gives an empty result. Reruns agree: only the rows decide, not their order or partitioning.
    """
    added = ("size", "source_size", "target", "copies")
    return _with_mix(docs, **how).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], "mix.*")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of docs as often as mix() takes it, with the columns of docs."""
    taken = _with_mix(docs, **how)
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix.copies").cast("int")))).select("row.*")


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Words of every document that the mix of all sources takes, repeats counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: Without histograms: the running sum over all hash values of a source.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents
), ranked AS (
  SELECT *, CAST([3, 1, 2][1 + rank % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS top
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source)
), levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM ranked) - coalesce(sum(top) OVER (ORDER BY top / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY top / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), goal AS (
  SELECT source, source_size,
    CASE WHEN source_size = 0 THEN 0 ELSE least(top, coalesce((SELECT max(level) FROM levels WHERE level <= top / weight), CAST('inf' AS DOUBLE)) * weight) END AS target FROM levels
), need AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS copies FROM goal
), runs AS (
  SELECT source, h, sum(words) OVER (PARTITION BY source ORDER BY h) AS run FROM (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h)
  UNION ALL SELECT source, -1, 0 FROM need
), cuts AS (
  SELECT source, h AS cut FROM (SELECT r.source, h, row_number() OVER (PARTITION BY r.source ORDER BY abs(run - (target - copies * source_size)), h) AS place
    FROM runs r JOIN need n ON r.source IS NOT DISTINCT FROM n.source) WHERE place = 1
)
SELECT doc_id, size, source_size, target, CAST(size * least(copies + CASE WHEN target > copies * source_size AND h <= cut THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM d JOIN need n ON d.source IS NOT DISTINCT FROM n.source JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""

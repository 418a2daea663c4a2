"""Queries of the entity-resolution operators by name, each with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kindred.functions import replies as R
from kindred.functions import text as T
from kindred.functions import vectors as V
from kindred.operators import asking, blocking, clusterers, clustering, experiments, graph, guard, joins, lsh, matching, merge, metrics, recordsets, sphere
from kindred.operators.ordering import ranked
from kindred.operators.storage import durable, shared_dir
from kindred.plans import tables
from kindred.plans.resolve import Settings, resolve
from kindred.sources import formats
from kindred.sources import records as S
from kindred.streaming import arrivals

#: Cosine over which records share a block in the queries.
OVER = 0.4
#: Cosine of parts with nearly the same tokens, and the thresholds that a sweep tries.
NEAR, SWEEP = 0.79, (0.4, 0.42, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9)
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return S.as_vectors(_table(spark, sf, "embeddings"))


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("rid"), F.col("label").cast("long").alias("cluster"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("rid"), "p_name", "p_brand", "p_type", "p_size")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.exact_blocks(_vectors(spark, sf), OVER)


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.contingency(metrics.aligned(_blocks(spark, sf), _truth(spark, sf)))


#: SQL parts that several oracles share.
_PAIRS = f"""pairs AS (SELECT a.vec_id AS u, b.vec_id AS v, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > {OVER})"""
_BLOCKS = f"""{_PAIRS}, both_ways AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(rid, hit) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.rid, e.v FROM reach r JOIN both_ways e ON r.hit = e.u),
blocks AS (SELECT rid, min(hit) AS cluster FROM reach GROUP BY rid)"""
_TABLE = f"""{_BLOCKS}, cells AS (SELECT b.cluster AS p, e.label AS t, count(*) AS n FROM blocks b JOIN embeddings e ON b.rid = e.vec_id GROUP BY 1, 2),
ps AS (SELECT p, max(n) AS top, sum(n) AS size, count(*) AS labels FROM cells GROUP BY 1),
ts AS (SELECT t, max(n) AS top, sum(n) AS size FROM cells GROUP BY 1),
counts AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS tp, (SELECT sum(size * (size - 1) / 2) FROM ps) AS sp,
  (SELECT sum(size * (size - 1) / 2) FROM ts) AS st, (SELECT sum(n) FROM cells) AS n),
pc AS (SELECT tp, sp - tp AS fp, st - tp AS fn, n * (n - 1) / 2 - sp - st + tp AS tn, n FROM counts)"""


# Record text


@query("SELECT p_partkey AS rid, concat_ws(' ', p_name, p_brand, p_type, CAST(p_size AS VARCHAR)) AS combined_text FROM part")
def combined_text(spark, sf):
    return _parts(spark, sf).select("rid", T.combined_text("p_name", "p_brand", "p_type", "p_size").alias("combined_text"))


@query("SELECT p_partkey AS rid, 'Record ' || p_partkey || ': ' || concat_ws(',', p_name, p_brand, p_type, CAST(p_size AS VARCHAR)) AS line FROM part")
def prompt_lines(spark, sf):
    return _parts(spark, sf).select("rid", T.prompt_line("rid", "p_name", "p_brand", "p_type", "p_size").alias("line"))


@query("""SELECT p_partkey // 9 AS set_id, string_agg('Record ' || p_partkey || ': ' || concat_ws(',', p_name, p_brand), chr(10) ORDER BY p_partkey) AS prompt
FROM part GROUP BY 1""")
def set_prompts(spark, sf):
    parts = _parts(spark, sf)
    members = parts.select(F.floor(F.col("rid") / 9).alias("set_id"), F.col("rid").alias("pos"), "rid")
    return T.prompts(parts, members, ["p_name", "p_brand"])


@query("""WITH s AS (SELECT p_partkey // 9 AS set_id, string_agg('Record ' || p_partkey || ': ' || concat_ws(',', p_name, p_brand), chr(10) ORDER BY p_partkey) AS prompt FROM part GROUP BY 1)
SELECT set_id // 3 AS batch, 'Tasks:' || chr(10) || string_agg(chr(10) || '### Task T' || set_id || ' ###' || chr(10) || prompt, chr(10) ORDER BY set_id) AS prompt FROM s GROUP BY 1""")
def batched_prompts(spark, sf):
    tasks = set_prompts(spark, sf).select(F.floor(F.col("set_id") / 3).alias("batch"), F.col("set_id").alias("pos"), F.col("set_id").alias("task"), "prompt")
    return T.batched_prompts(tasks, "Tasks:")


@query(r"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])[^\p{L}\p{N}_\s]+([\p{L}\p{N}_])', '\1 \2', 'g'),
  '([\p{L}\p{N}_])[^\p{L}\p{N}_\s]+([\p{L}\p{N}_])', '\1 \2', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS text FROM documents""")
def normalized_text(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.normalized(F.col("text")).alias("text"))


_TOKENS = r"list_distinct(list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> ''))"


@query(f"""WITH t AS (SELECT p_partkey AS rid, p_brand, {_TOKENS.format("p_name || ' ' || p_type")} AS k FROM part),
c AS (SELECT *, min(rid) OVER (PARTITION BY p_brand, list_sort(k)) AS rep FROM t)
SELECT a.rid AS u, b.rid AS v, round(len(list_intersect(a.k, b.k)) / CAST(len(list_distinct(a.k || b.k)) AS DOUBLE), 6) AS sim
FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.rid < b.rid AND a.rid = a.rep AND b.rid = b.rep
WHERE len(list_intersect(a.k, b.k)) / CAST(len(list_distinct(a.k || b.k)) AS DOUBLE) >= 0.5
UNION ALL SELECT rep, rid, 1.0 FROM c WHERE rid <> rep AND len(k) > 0 AND p_brand IS NOT NULL""")
def token_jaccard_pairs(spark, sf):
    parts = _parts(spark, sf).withColumn("text", F.concat_ws(" ", "p_name", "p_type"))
    return _rounded(joins.jaccard_pairs(parts, "text", 0.5, by="p_brand"))


@query("""SELECT a.s_suppkey AS u, b.s_suppkey AS v, round(len(list_filter(range(1, 1 + least(length(x), length(y))), lambda i: substr(x, i, 1) = substr(y, i, 1)))
  / CAST(greatest(length(x), length(y)) AS DOUBLE), 6) AS ratio
FROM (SELECT s_suppkey, CAST(s_acctbal AS VARCHAR) AS x FROM supplier) a JOIN (SELECT s_suppkey, CAST(s_acctbal AS VARCHAR) AS y FROM supplier) b
ON b.s_suppkey = a.s_suppkey + 1""")
def char_match_ratios(spark, sf):
    rows = _table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").cast("string").alias("t"))
    a, b = rows.select(F.col("s_suppkey").alias("u"), F.col("t").alias("x")), rows.select(F.col("s_suppkey").alias("v"), F.col("t").alias("y"))
    pairs = a.join(b, F.col("v") == F.col("u") + 1)
    return _rounded(pairs.select("u", "v", T.char_match_ratio(F.col("x"), F.col("y")).alias("ratio")))


_ATTRIBUTES = f"""a AS (SELECT p_partkey AS rid, p_brand, {_TOKENS.format('p_name')} AS k1, {_TOKENS.format('p_type')} AS k2, CAST(p_size AS VARCHAR) AS k3,
  min(p_partkey) OVER (PARTITION BY p_brand, p_name, p_type, p_size) AS rep FROM part),
ap AS (SELECT x.rid AS u, y.rid AS v, (len(list_intersect(x.k1, y.k1)) / CAST(len(list_distinct(x.k1 || y.k1)) AS DOUBLE)
  + len(list_intersect(x.k2, y.k2)) / CAST(len(list_distinct(x.k2 || y.k2)) AS DOUBLE) + CASE WHEN x.k3 = y.k3 THEN 1.0 ELSE 0.0 END) / 3 AS sim
  FROM a x JOIN a y ON x.p_brand = y.p_brand AND x.rid < y.rid AND x.rid = x.rep AND y.rid = y.rep UNION ALL SELECT rep, rid, 1.0 FROM a WHERE rid <> rep)"""


@query(f"WITH {_ATTRIBUTES} SELECT u, v, round(sim, 6) AS sim FROM ap WHERE sim >= 0.6")
def attribute_jaccard_pairs(spark, sf):
    return _rounded(joins.attribute_pairs(_parts(spark, sf), ["p_name", "p_type", "p_size"], 0.6, by="p_brand"))


@query(f"""WITH RECURSIVE {_ATTRIBUTES}, e AS (SELECT u, v FROM ap WHERE sim >= 0.75 UNION ALL SELECT v, u FROM ap WHERE sim >= 0.75),
reach(rid, hit) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.rid, e.v FROM reach r JOIN e ON r.hit = e.u)
SELECT rid, min(hit) AS cluster FROM reach GROUP BY rid""")
def jaccard_blocks(spark, sf):
    return blocking.jaccard_blocks(_parts(spark, sf), ["p_name", "p_type", "p_size"], 0.75, by="p_brand")


@query("""SELECT * FROM (SELECT count(*) AS n, CAST(min(vec_id) AS BIGINT) AS least, CAST(max(vec_id) AS BIGINT) AS greatest, count(DISTINCT vec_id) AS n_distinct,
  count(DISTINCT vec_id) = count(*) AND min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AS contiguous FROM embeddings),
(SELECT count(*) AS n_truth, CAST(0 AS BIGINT) AS n_outside, 'KEEP' AS verdict FROM embeddings)""")
def dataset_audit(spark, sf):
    return experiments.audit(_table(spark, sf, "embeddings"), "vec_id", _truth(spark, sf))


@query("SELECT min(vec_id) AS cluster, count(*) AS n_records, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_pairs FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def truth_pairs(spark, sf):
    """Clusters of a truth file of pairs, written from the labels (each record with its label's first one) and closed by its reader."""
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/truth-pairs-{uuid.uuid4().hex}"
    truth = _truth(spark, sf).where("cluster IS NOT NULL")
    firsts = truth.groupBy("cluster").agg(F.min("rid").alias("first"))
    truth.join(firsts, "cluster").select("rid", "first").write.option("header", True).csv(path)
    n = F.count("*")
    return S.read_truth_pairs(spark, path).groupBy("cluster").agg(n.alias("n_records"), (n * (n - 1) / 2).cast("long").alias("n_pairs"))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT o_orderkey AS a, -o_custkey AS b FROM orders),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(rid, hit) AS (SELECT a, a FROM e UNION SELECT r.rid, e.b FROM reach r JOIN e ON r.hit = e.a)
SELECT rid, min(hit) AS cluster FROM reach GROUP BY rid""")
def pair_closure(spark, sf):
    """Orders and customers (negative ids) that pairs of the two join."""
    return graph.closure(_table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), (-F.col("o_custkey")).alias("b")))


# Similarity joins and blocks


@query(f"""WITH {_PAIRS}, c AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding) AS rep, len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings)
SELECT u, v, round(sim, 6) AS sim FROM pairs JOIN c a ON u = a.vec_id AND u = a.rep JOIN c b ON v = b.vec_id AND v = b.rep
UNION ALL SELECT rep, vec_id, 1.0 FROM c WHERE vec_id <> rep AND usable""")
def cosine_pairs(spark, sf):
    """Pairs between the first vectors of all classes of equal ones, and every member's pair with its first."""
    return _rounded(joins.cosine_links(_vectors(spark, sf), OVER))


@query("""WITH s AS (SELECT a.vec_id AS u, b.vec_id AS v, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS rank FROM s)
SELECT u, v, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def topk_candidates(spark, sf):
    return _rounded(sphere.top_k(_vectors(spark, sf), 10))


@query("""WITH s AS (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a, embeddings b)
SELECT (SELECT count(*) FROM embeddings) AS n, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS sigma, round(least(avg(sim) + 2.5 * stddev_pop(sim), 0.99), 6) AS threshold FROM s""")
def dynamic_threshold(spark, sf):
    return _rounded(blocking.threshold(_vectors(spark, sf)))


@query(f"WITH RECURSIVE {_BLOCKS} SELECT rid, cluster FROM blocks")
def blocks_exact(spark, sf):
    return _blocks(spark, sf)


@query(f"WITH RECURSIVE {_BLOCKS} SELECT size, count(*) AS n_blocks FROM (SELECT count(*) AS size FROM blocks GROUP BY cluster) GROUP BY size")
def block_sizes(spark, sf):
    return _blocks(spark, sf).groupBy("cluster").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_blocks"))


@query()
def lsh_pairs(spark, sf):
    """Pairs of the locality-sensitive join: a part of cosine_pairs."""
    return _rounded(lsh.lsh_pairs(_vectors(spark, sf), OVER))


@query(f"""WITH {_PAIRS}, c AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding) AS rep FROM embeddings)
SELECT count(*) AS n_pairs, true AS enough FROM pairs JOIN c a ON u = a.vec_id AND u = a.rep JOIN c b ON v = b.vec_id AND v = b.rep""")
def lsh_recall(spark, sf):
    """Pairs of distinct vectors over the threshold, and whether the locality-sensitive join finds nine in ten of them."""
    firsts = durable(joins.classes(_vectors(spark, sf), ["embedding"])[0], "distinct-vectors")
    exact = joins.cosine_pairs(firsts, OVER).select("u", "v")
    found = lsh.lsh_pairs(firsts, OVER).select("u", "v", F.lit(1).alias("found"))
    row = exact.join(found, ["u", "v"], "left").agg(F.count("*").alias("n_pairs"), F.count("found").alias("n_found"))
    return row.select("n_pairs", (F.col("n_found") >= lsh.RECALL * F.col("n_pairs")).alias("enough"))


@query()
def lsh_blocks(spark, sf):
    return blocking.lsh_blocks(_vectors(spark, sf), OVER)


@query(f"""WITH RECURSIVE {_BLOCKS}, wide AS (SELECT vec_id, label, embedding FROM embeddings),
links AS (SELECT least(a.label, b.label) AS cu, greatest(a.label, b.label) AS cv, greatest(0, max(sim)) AS sim
  FROM pairs JOIN wide a ON u = a.vec_id JOIN wide b ON v = b.vec_id WHERE a.label <> b.label GROUP BY 1, 2)
SELECT CAST(cu AS BIGINT) AS cu, CAST(cv AS BIGINT) AS cv, round(sim, 6) AS sim FROM links""")
def cluster_linkage(spark, sf):
    return _rounded(joins.class_linkage(_vectors(spark, sf), OVER, _truth(spark, sf)))


@query(f"""WITH {_PAIRS}, links AS (SELECT least(a.label, b.label) AS cu, greatest(a.label, b.label) AS cv, greatest(0, max(sim)) AS sim
  FROM pairs JOIN embeddings a ON u = a.vec_id JOIN embeddings b ON v = b.vec_id WHERE a.label <> b.label GROUP BY 1, 2),
bands AS (SELECT *, least(CAST(floor((sim - 0.4) / 0.02) AS BIGINT), 4) AS band FROM links WHERE sim BETWEEN 0.4 AND 0.5)
SELECT CAST(cu AS BIGINT) AS cu, CAST(cv AS BIGINT) AS cv, round(sim, 6) AS sim, band FROM
(SELECT *, row_number() OVER (PARTITION BY band ORDER BY cu, cv) AS n FROM bands) WHERE n <= 10""")
def band_probes(spark, sf):
    links = joins.class_linkage(_vectors(spark, sf), OVER, _truth(spark, sf))
    return _rounded(joins.band_cells(links, 0.4, 0.5, 0.02, 10))


# Metrics of the blocks against the labels


@query(f"WITH RECURSIVE {_TABLE} SELECT CAST(p AS VARCHAR) AS p, CAST(t AS VARCHAR) AS t, n FROM cells")
def contingency(spark, sf):
    return _labels(spark, sf)


@query(f"""WITH RECURSIVE {_TABLE}, r AS (SELECT (SELECT sum(top) / sum(size) FROM ps) AS a, (SELECT sum(top) / sum(size) FROM ts) AS b)
SELECT round(a, 6) AS purity, round(b, 6) AS inverse_purity, round(2 * a * b / (a + b), 6) AS f_measure FROM r""")
def purity_measures(spark, sf):
    return _rounded(metrics.f_purity(_labels(spark, sf)))


@query(f"""WITH RECURSIVE {_BLOCKS}, cells AS (SELECT b.cluster AS p, e.label AS t, count(*) AS n FROM blocks b JOIN embeddings e ON b.rid = e.vec_id WHERE e.vec_id % 7 <> 0 GROUP BY 1, 2),
r AS (SELECT (SELECT sum(top) / sum(size) FROM (SELECT max(n) AS top, sum(n) AS size FROM cells GROUP BY p)) AS a,
  (SELECT sum(top) / sum(size) FROM (SELECT max(n) AS top, sum(n) AS size FROM cells GROUP BY t)) AS b)
SELECT round(a, 6) AS purity, round(b, 6) AS inverse_purity, round(2 * a * b / (a + b), 6) AS f_measure FROM r""")
def purity_of_known(spark, sf):
    """Purity over the records that both sides know, where the truth lacks every seventh."""
    known = _truth(spark, sf).where("rid % 7 <> 0")
    return _rounded(metrics.f_purity(metrics.contingency(metrics.aligned(_blocks(spark, sf), known, missing="drop"))))


@query(f"""WITH RECURSIVE {_TABLE}, r AS (SELECT sum(c.n * c.n / CAST(ps.size AS DOUBLE)) / sum(c.n) AS a, sum(c.n * c.n / CAST(ts.size AS DOUBLE)) / sum(c.n) AS b
FROM cells c JOIN ps ON c.p = ps.p JOIN ts ON c.t = ts.t)
SELECT round(a, 6) AS precision, round(b, 6) AS recall, round(2 * a * b / (a + b), 6) AS f1 FROM r""")
def bcubed(spark, sf):
    return _rounded(metrics.bcubed(_labels(spark, sf)))


@query(f"""WITH RECURSIVE {_TABLE} SELECT round(avg(top / CAST(size AS DOUBLE)), 6) AS macro_purity,
round(count(*) FILTER (labels = 1) / CAST(count(*) AS DOUBLE), 6) AS pure_ratio,
round(sum(CASE WHEN size - top <= 1 THEN size ELSE top END) / CAST(sum(size) AS DOUBLE), 6) AS tolerant_purity FROM ps""")
def cluster_purity(spark, sf):
    return _rounded(metrics.cluster_purity(_labels(spark, sf)))


@query(f"""WITH RECURSIVE {_TABLE}, r AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM pc)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy,
round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM r""")
def pairwise_metrics(spark, sf):
    return _rounded(metrics.pairwise(_labels(spark, sf)))


@query(f"""WITH RECURSIVE {_TABLE}, r AS (SELECT tp / (tp + fn) AS a, tp / (tp + fp) AS b, 1 - (tp + fp) / (n * (n - 1) / 2) AS c FROM pc)
SELECT round(a, 6) AS completeness, round(b, 6) AS quality, round(c, 6) AS reduction, round(2 * a * b / (a + b), 6) AS f1 FROM r""")
def block_quality(spark, sf):
    return _rounded(metrics.block_quality(_labels(spark, sf)))


@query(f"""WITH RECURSIVE {_TABLE}, r AS (SELECT tp, sp, st, sp * st / (n * (n - 1) / 2) AS expected FROM counts)
SELECT round((tp - expected) / ((sp + st) / 2 - expected), 6) AS ari FROM r""")
def adjusted_rand(spark, sf):
    return _rounded(metrics.adjusted_rand(_labels(spark, sf)))


@query(f"""WITH RECURSIVE {_TABLE}, z AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM cells),
mi AS (SELECT sum(c.n / z.n * ln(c.n * z.n / (CAST(ps.size AS DOUBLE) * ts.size))) AS x FROM cells c JOIN ps ON c.p = ps.p JOIN ts ON c.t = ts.t, z),
hp AS (SELECT -sum(size / z.n * ln(size / z.n)) AS x FROM ps, z), ht AS (SELECT -sum(size / z.n * ln(size / z.n)) AS x FROM ts, z)
SELECT round(mi.x / ((hp.x + ht.x) / 2), 6) AS nmi FROM mi, hp, ht""")
def mutual_information(spark, sf):
    return _rounded(metrics.mutual_information(_labels(spark, sf)))


@query()
def matching_accuracy(spark, sf):
    """Accuracy under the best one-to-one matching; tests compare it with all permutations."""
    return _rounded(metrics.accuracy(_labels(spark, sf)))


_SWEEP = " UNION ALL ".join(
    f"""SELECT CAST({t} AS DOUBLE) AS threshold, * FROM (WITH RECURSIVE e AS (SELECT u, v FROM pairs WHERE sim > {t} UNION ALL SELECT v, u FROM pairs WHERE sim > {t}),
reach(rid, hit) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.rid, e.v FROM reach r JOIN e ON r.hit = e.u),
cells AS (SELECT b.cluster AS p, label AS t, count(*) AS n FROM (SELECT rid, min(hit) AS cluster FROM reach GROUP BY rid) b JOIN embeddings ON rid = vec_id GROUP BY 1, 2),
k AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS tp, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM cells GROUP BY p)) AS sp,
(SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM cells GROUP BY t)) AS st, (SELECT sum(n) FROM cells) AS n),
r AS (SELECT tp / st AS a, CASE WHEN sp = 0 THEN 0 ELSE tp / sp END AS b, 1 - sp / (n * (n - 1) / 2) AS c FROM k)
SELECT round(a, 6) AS completeness, round(b, 6) AS quality, round(c, 6) AS reduction, round(CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END, 6) AS f1 FROM r)"""
    for t in SWEEP
)


@query(f"WITH {_PAIRS} {_SWEEP}")
def blocking_sweep(spark, sf):
    return _rounded(experiments.blocking_sweep(_vectors(spark, sf), _truth(spark, sf), list(SWEEP)))


# Centroids, representatives, guardrail

_DISTANCES = """x AS (SELECT vec_id AS rid, CAST(label AS BIGINT) AS cluster, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
c AS (SELECT cluster, dim, avg(x) AS m FROM x GROUP BY 1, 2),
d AS (SELECT x.rid, x.cluster, sqrt(sum((x.x - c.m) * (x.x - c.m))) AS distance FROM x JOIN c ON x.cluster = c.cluster AND x.dim = c.dim GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(distance, 9), rid) AS rank, count(*) OVER (PARTITION BY cluster) AS size FROM d)"""


@query(f"WITH {_DISTANCES} SELECT rid, cluster, round(distance, 6) AS distance FROM d")
def centroid_distances(spark, sf):
    return _rounded(blocking.centroid_distances(_vectors(spark, sf), _truth(spark, sf)))


@query(f"WITH {_DISTANCES} SELECT cluster, rid FROM ranked WHERE rank = 1")
def representatives(spark, sf):
    return blocking.representatives(_vectors(spark, sf), _truth(spark, sf))


@query(f"WITH {_DISTANCES} SELECT rid, cluster FROM ranked WHERE rank <= least(greatest(1, ceil(size * 0.15)), 8)")
def block_anchors(spark, sf):
    return blocking.block_anchors(_vectors(spark, sf), _truth(spark, sf), 0.15, 8)


@query("""WITH x AS (SELECT vec_id AS rid, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
c AS (SELECT dim, avg(x) AS m FROM x GROUP BY 1), d AS (SELECT rid, sqrt(sum((x.x - c.m) * (x.x - c.m))) AS distance FROM x JOIN c ON x.dim = c.dim GROUP BY 1)
SELECT rid FROM d ORDER BY round(distance, 9), rid LIMIT 50""")
def central_anchors(spark, sf):
    return blocking.central_anchors(_vectors(spark, sf), 50)


@query("SELECT doc_id AS rid FROM documents ORDER BY sha1(text), doc_id LIMIT 50")
def hashed_anchors(spark, sf):
    return blocking.hashed_anchors(_table(spark, sf, "documents").withColumnRenamed("doc_id", "rid"), "text", 50)


_JUDGED = """m AS (SELECT vec_id // 9 AS set_id, vec_id AS rid, label AS cluster, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.set_id, a.rid AS u, a.cluster AS cu, b.cluster AS cv, list_cosine_similarity(a.e, b.e) AS sim FROM m a JOIN m b ON a.set_id = b.set_id AND a.rid <> b.rid),
j AS (SELECT set_id, u AS rid, cu AS cluster, min(sim) FILTER (cu = cv) AS intra, max(sim) FILTER (cu <> cv) AS inter,
  arg_min(cv, (-sim, cv)) FILTER (cu <> cv) AS target FROM s GROUP BY 1, 2, 3)"""


def _sets(spark, sf) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 9).alias("set_id"), F.col("vec_id").alias("rid"), F.col("label").alias("cluster"))


def _judged(spark, sf) -> DataFrame:
    return guard.intra_inter(guard.set_similarities(_sets(spark, sf), _vectors(spark, sf)))


@query(f"WITH {_JUDGED} SELECT set_id, rid, cluster, round(intra, 6) AS intra, round(inter, 6) AS inter, target FROM j")
def guard_similarities(spark, sf):
    return _rounded(_judged(spark, sf))


@query(f"WITH {_JUDGED} SELECT set_id, rid, cluster, target FROM j WHERE intra < inter")
def guard_offenders(spark, sf):
    return guard.offenders(_judged(spark, sf)).select("set_id", "rid", "cluster", "target")


@query(f"WITH {_JUDGED} SELECT set_id, count(*) FILTER (intra < inter) AS n_offenders, count(*) FILTER (intra < inter) = 0 AS accepted FROM j GROUP BY 1 UNION ALL SELECT set_id, 0, true FROM m GROUP BY 1 HAVING count(*) = 1")
def guard_verdicts(spark, sf):
    sets = _sets(spark, sf)
    return guard.verdicts(sets, guard.set_similarities(sets, _vectors(spark, sf)))


@query(f"""WITH {_JUDGED} SELECT set_id, rid, row_number() OVER (PARTITION BY set_id ORDER BY coalesce(target2, cluster), target2 IS NOT NULL, cluster, rid) - 1 AS pos
FROM (SELECT set_id, rid, cluster, CASE WHEN intra < inter THEN target END AS target2 FROM j)""")
def guard_regenerated(spark, sf):
    sets = _sets(spark, sf).withColumn("pos", F.col("rid"))
    return guard.regenerated(sets, guard.offenders(_judged(spark, sf))).select("set_id", "rid", "pos")


# Matching


def _candidates(spark, sf) -> DataFrame:
    vectors = _vectors(spark, sf)
    queries = vectors.where("rid % 100 = 0")  # the query set of searches; candidates are all rows
    return matching.select_best(matching.instances_of(vectors, queries, 10), OVER)


_SELECTED = f"""s AS (SELECT a.vec_id AS u, b.vec_id AS v, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS pos FROM s),
q AS (SELECT u, v, sim, pos, pos = 1 AND sim > {OVER} AS is_match FROM r WHERE pos <= 10)"""


@query(f"WITH {_SELECTED} SELECT u AS anchor, pos, v AS candidate, round(sim, 6) AS sim, is_match FROM q")
def match_instances(spark, sf):
    return _rounded(_candidates(spark, sf))


def _described(spark, sf) -> DataFrame:
    """Vectors with the whole text of the document of the same number; empty without one."""
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("rid"), "text")
    return _vectors(spark, sf).select("rid").join(docs, "rid", "left").select("rid", F.coalesce("text", F.lit("")).alias("text"))


_TEXTS = "t AS (SELECT vec_id, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON vec_id = doc_id)"


@query(f"""WITH {_SELECTED}, {_TEXTS} SELECT u AS anchor, '{matching.SELECT}' || 'First: ' || any_value(a.text) || chr(10)
  || string_agg('[' || pos || '] ' || b.text, chr(10) ORDER BY pos) AS prompt FROM q JOIN t a ON u = a.vec_id JOIN t b ON v = b.vec_id GROUP BY u""")
def select_prompts(spark, sf):
    return matching.select_prompts(_candidates(spark, sf), _described(spark, sf), "text")


@query(f"""WITH {_SELECTED}, {_TEXTS} SELECT u AS anchor, v AS candidate, '{matching.MATCH}' || 'A: ' || a.text || chr(10) || 'B: ' || b.text AS prompt
FROM q JOIN t a ON u = a.vec_id JOIN t b ON v = b.vec_id""")
def match_prompts(spark, sf):
    return matching.match_prompts(_candidates(spark, sf), _described(spark, sf), "text")


@query("""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label <> b.label AS apart FROM embeddings a JOIN embeddings b ON a.vec_id // 9 = b.vec_id // 9 AND a.vec_id < b.vec_id)
SELECT a, b FROM p WHERE EXISTS (SELECT 1 FROM p x JOIN p y ON x.b = y.a WHERE x.a = p.a AND y.b = p.b AND x.apart AND y.apart AND x.b < p.b - 1)""")
def transitive_pairs(spark, sf):
    """Pairs within sets of nine that needn't be asked, once pairs of different labels are settled."""
    sets = _sets(spark, sf)
    side = lambda r: sets.select("set_id", F.col("rid").alias(r), F.col("cluster").alias(f"c{r}"))
    pairs = side("a").join(side("b"), "set_id").where("a < b")
    return matching.transitive(pairs.select("a", "b"), pairs.where("ca <> cb").select("a", "b"))


@query(f"""WITH RECURSIVE {_SELECTED}, e AS (SELECT u, v FROM q WHERE is_match UNION ALL SELECT v, u FROM q WHERE is_match),
reach(rid, hit) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.rid, e.v FROM reach r JOIN e ON r.hit = e.u)
SELECT rid, min(hit) AS cluster FROM reach GROUP BY rid""")
def select_closure(spark, sf):
    return matching.matched_clusters(_vectors(spark, sf), _candidates(spark, sf))


@query(f"""WITH {_SELECTED}, j AS (SELECT is_match AS y, a.label = b.label AS s FROM q JOIN embeddings a ON u = a.vec_id JOIN embeddings b ON v = b.vec_id),
k AS (SELECT count(*) FILTER (y AND s) AS tp, count(*) FILTER (y AND NOT s) AS fp, count(*) FILTER (NOT y AND s) AS fn, count(*) FILTER (NOT y AND NOT s) AS tn FROM j),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS a, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS b FROM k)
SELECT tp, fp, fn, tn, round(a, 6) AS precision, round(b, 6) AS recall, round(CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END, 6) AS f1 FROM m""")
def candidate_confusion(spark, sf):
    return _rounded(matching.confusion(_candidates(spark, sf), _truth(spark, sf)))


@query(f"""WITH {_SELECTED}, z AS (SELECT u AS anchor, pos, v AS candidate, round(sim * 10) - 3 AS score FROM q)
SELECT anchor, pos, candidate, score, score > 0 AND score = max(score) OVER (PARTITION BY anchor) AS is_match,
row_number() OVER (PARTITION BY anchor ORDER BY score DESC, pos DESC) AS rank FROM z""")
def pointwise_matches(spark, sf):
    scored = matching.match_scores(_candidates(spark, sf).drop("is_match"), F.round(F.col("sim") * 10) - 3, single=True)
    return matching.pointwise_rank(scored).drop("sim")


# Replies and costs

_COSTS = " UNION ALL ".join(f"SELECT '{m}' AS model, {p} AS prompt, {c} AS completion" for m, p, c in R.PRICES)


@query(f"""WITH prices AS ({_COSTS}), w AS (SELECT role, len(regexp_extract_all(text, '[^ \\n\\t]+')) AS words FROM conversations),
u AS (SELECT CAST(coalesce(sum(words) FILTER (role = 'user'), 0) AS BIGINT) AS i, CAST(coalesce(sum(words) FILTER (role = 'assistant'), 0) AS BIGINT) AS o FROM w)
SELECT model, i AS in_tokens, o AS out_tokens, round((prompt * i + completion * o) / 1e6, 6) AS cost FROM u, prices""")
def token_costs(spark, sf):
    """What all conversations would cost with each model of the price list, words of users' turns in and of answers out."""
    turns = _table(spark, sf, "conversations").select("role", F.size(F.regexp_extract_all("text", F.lit("[^ \\n\\t]+"), F.lit(0))).alias("words"))
    said = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("words"))), F.lit(0))
    usage = turns.agg(said("user").alias("in_tokens"), said("assistant").alias("out_tokens"))  # one row
    prices = R.price_table(spark)
    return _rounded(R.token_cost(prices.select("model").crossJoin(F.broadcast(usage)), prices))


_BARE = r"regexp_replace(regexp_replace(regexp_replace({0}, '[^0-9\[\],]', '', 'g'), ',+', ',', 'g'), ',\]', ']', 'g')"


@query(rf"""WITH s AS (SELECT 'page' AS kind, page_id AS key, '[[' || replace(html, '<', '], [') || ']]' AS reply FROM pages
UNION ALL SELECT 'document', doc_id, '[[' || replace(text, '. ', '], [') || ']]' FROM documents),
b AS (SELECT kind, key, regexp_extract_all({_BARE.format("reply")}, '\[([^\[\]]*)\]', 1) AS groups FROM s),
n AS (SELECT kind, key, list_filter(list_transform(groups, lambda g: list_filter(list_transform(string_split(g, ','), lambda x: CASE WHEN length(x) BETWEEN 1 AND 18 THEN TRY_CAST(x AS BIGINT) END),
  lambda x: x IS NOT NULL)), lambda g: len(g) > 0) AS found FROM b),
k AS (SELECT kind, key, unnest(found) AS ids, generate_subscripts(found, 1) - 1 AS k FROM n)
SELECT kind, key, k, generate_subscripts(ids, 1) - 1 AS i, unnest(ids) AS id FROM k""")
def parsed_replies(spark, sf):
    """Groups of numbers read from whole texts as replies: sentences of documents and elements of pages stand in brackets."""
    said = lambda table, kind, key, text, at: _table(spark, sf, table).select(
        F.lit(kind).alias("kind"), F.col(key).alias("key"), F.concat(F.lit("[["), F.replace(F.col(text), F.lit(at), F.lit("], [")), F.lit("]]")).alias("reply"))
    replies = said("pages", "page", "page_id", "html", "<").unionByName(said("documents", "document", "doc_id", "text", ". "))
    groups = replies.select("kind", "key", F.posexplode(R.parsed_clusters(F.col("reply"))).alias("k", "ids"))
    return groups.select("kind", "key", "k", F.posexplode("ids").alias("i", "id"))


@query(r"""WITH r AS (SELECT doc_id, '[' || regexp_replace(regexp_replace(text, '[.,;:!?()+-]', '', 'g'), '[ \n]+', '] [', 'g') || ']' AS reply FROM documents),
k AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(reply, '\[([0-9]+)\]', 1), '') AS INTEGER) AS choice FROM r) SELECT doc_id, choice FROM k WHERE choice BETWEEN 1 AND 20""")
def parsed_selections(spark, sf):
    """The candidate of twenty that a document names first, if its words were put in brackets."""
    words = F.regexp_replace(F.regexp_replace("text", "[.,;:!?()+-]", ""), r"[ \n]+", "] [")
    rows = _table(spark, sf, "documents").select("doc_id", F.posexplode(R.selected(F.concat(F.lit("["), words, F.lit("]")), F.lit(20))).alias("i", "yes"))
    return rows.where("yes").select("doc_id", (F.col("i") + 1).alias("choice"))


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'yes') THEN 1 WHEN contains(lower(text), 'no') THEN -1 ELSE 0 END AS answer FROM conversations""")
def yes_no_replies(spark, sf):
    return _table(spark, sf, "conversations").select("conv_id", "turn", R.yes_no(F.col("text")).alias("answer"))


@query("""WITH p AS (SELECT p_partkey // 9 AS task, p_partkey AS rid, p_brand AS word FROM part),
g AS (SELECT task, word, row_number() OVER (PARTITION BY task ORDER BY min(rid)) - 1 AS cluster FROM p GROUP BY 1, 2)
SELECT p.task, p.rid, cluster FROM p JOIN g ON p.task = g.task AND p.word = g.word""")
def parsed_batches(spark, sf):
    """Clusters of parts read from one reply for three tasks; a stand-in for a model answers the batched prompts as they are."""

    def answers(prompts: pd.Series) -> pd.Series:
        def answer(prompt: str) -> str:
            tasks: dict[str, dict[str, list[int]]] = {}
            for line in prompt.split("\n"):
                if line.startswith("### Task "):
                    groups = tasks.setdefault(line.split(" ")[2], {})
                elif line.startswith("Record "):
                    number, _, rest = line[len("Record "):].partition(": ")
                    groups.setdefault(rest.rsplit(",", 1)[-1], []).append(int(number))
            return "Here it is:\n" + json.dumps({t: list(g.values()) for t, g in tasks.items()}, indent=1) + "\nDone."

        return prompts.map(answer)

    replies = batched_prompts(spark, sf).select(F.pandas_udf(answers, "string")("prompt").alias("reply"))
    tasks = replies.select(F.explode(R.parsed_batch(F.col("reply"))).alias("task", "clusters"))
    groups = tasks.select(F.substring("task", 2, 20).cast("long").alias("task"), F.posexplode("clusters").alias("cluster", "ids"))
    return groups.select("task", F.explode("ids").alias("rid"), "cluster")


def _answered_by_last_word(prompt: str) -> asking.Reply:
    """A stand-in for a language model: groups the records shown by the last word of their line. It fails at the first attempt for
    one prompt in four, and adds an id that nobody asked about."""
    import hashlib

    key = hashlib.sha256(prompt.encode()).hexdigest()
    if key[0] in "0123" and key not in _FAILED:
        _FAILED.add(key)
        raise ConnectionError("busy")
    groups: dict[str, list[str]] = {}
    for line in prompt.split("\n"):
        if line.startswith("Record "):
            number, _, rest = line[len("Record "):].partition(": ")
            groups.setdefault(rest.replace(",", " ").rsplit(" ", 1)[-1], []).append(number)
    text = f"Here you are: [{', '.join('[' + ', '.join(g) + ']' for g in groups.values())}, [999999999999]]"
    return asking.Reply(text, len(prompt) // 4, len(text) // 4)


_FAILED: set[str] = set()
_ASK = "Group the records.\n"


def _asked(spark: SparkSession, sf: str) -> tuple[asking.Prompted, DataFrame]:
    """Parts in sets of nine by key, and a clusterer that asks about them."""
    parts = _parts(spark, sf).select("rid", "p_name", "p_type")
    store = asking.new_store(spark, 16)
    sets = ranked(parts.select("rid"), ["rid"], "at").select(F.expr("CAST(at div 9 AS STRING)").alias("set_id"), (F.col("at") % 9).alias("pos"), "rid")
    return asking.Prompted(parts, ["p_name", "p_type"], _answered_by_last_word, store, "gpt-4o-mini", _ASK, {"waits": (0.0, 0.0)}), durable(sets, "nines")


_NINES = """r AS (SELECT p_partkey AS rid, p_name || ',' || p_type AS line, string_split(p_type, ' ')[-1] AS word, row_number() OVER (ORDER BY p_partkey) - 1 AS at_ FROM part),
p AS (SELECT at_ // 9 AS set_id, rid, line, word, at_ % 9 AS pos FROM r)"""


@query(f"""WITH {_NINES}, g AS (SELECT set_id, word, min(pos) AS start FROM p GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY start) - 1 AS cluster FROM g)
SELECT CAST(p.set_id AS VARCHAR) AS set_id, rid, cluster FROM p JOIN n ON p.set_id = n.set_id AND p.word = n.word""")
def prompted_clusters(spark, sf):
    """Sets of parts clustered by prompts and replies of a model that fails at times."""
    clusterer, sets = _asked(spark, sf)
    return clusterers.numbered(clusterers.complete(sets, clusterer.cluster(sets, 0))).select("set_id", "rid", "cluster")


@query(f"""WITH {_NINES}, w AS (SELECT set_id, word, min(pos) AS start, '[' || string_agg(CAST(rid AS VARCHAR), ', ' ORDER BY pos) || ']' AS members FROM p GROUP BY 1, 2),
q AS (SELECT set_id, {len(_ASK)} + sum(length('Record ' || rid || ': ' || line) + 1) - 1 AS asked FROM p GROUP BY 1),
a AS (SELECT set_id, length('Here you are: [' || string_agg(members, ', ' ORDER BY start) || ', [999999999999]]') AS told FROM w GROUP BY 1)
SELECT 'gpt-4o-mini' AS model, count(*) AS calls, CAST(sum(asked // 4) AS BIGINT) AS in_tokens, CAST(sum(told // 4) AS BIGINT) AS out_tokens,
  round((0.15 * sum(asked // 4) + 0.6 * sum(told // 4)) / 1e6, 6) AS cost FROM q JOIN a USING (set_id)""")
def prompted_costs(spark, sf):
    """What those prompts cost, each counted once, asked twice over."""
    clusterer, sets = _asked(spark, sf)
    for attempt in range(2):
        durable(clusterer.cluster(sets, attempt), "answers")
    return _rounded(asking.cost(clusterer.store, spark))


# Clustering, record sets, resolution


@query()
def kmeans_elbow(spark, sf):
    rows = _table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("rid"), "embedding")
    return clustering.kmeans_groups(rows, "label")


@query()
def record_sets(spark, sf):
    return recordsets.record_sets(_vectors(spark, sf), _blocks(spark, sf))


_SET_SIZES = f"""WITH RECURSIVE {_BLOCKS} SELECT cluster AS block, count(*) AS n_records, count(*) AS n_distinct, CAST(ceil(count(*) / 9) AS BIGINT) AS n_sets FROM blocks GROUP BY 1"""


@query(_SET_SIZES)
def record_set_sizes(spark, sf):
    """Each record is in one set of its block, and blocks have as few sets of nine as hold them."""
    sets = record_sets(spark, sf)
    return sets.groupBy("block").agg(F.count("*").alias("n_records"), F.countDistinct("rid").alias("n_distinct"), F.countDistinct("set_no").alias("n_sets"))


@query(_SET_SIZES)
def sql_record_sets(spark, sf):
    """record_set_sizes by the SQL table function."""
    tables.register(spark)
    recordsets.dealt(_vectors(spark, sf), _blocks(spark, sf)).createOrReplaceTempView("kindred_dealt")
    return spark.sql("""SELECT block, count(*) AS n_records, count(DISTINCT rid) AS n_distinct, count(DISTINCT set_no) AS n_sets
        FROM record_sets(TABLE(kindred_dealt)) GROUP BY block""")


@query("SELECT vec_id AS rid, min(vec_id) OVER (PARTITION BY label) AS cluster FROM embeddings WHERE label IS NOT NULL")
def cluster_files(spark, sf):
    """A partition written and read as lines of ids in the format `clusters`."""
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/cluster-lines-{uuid.uuid4().hex}"
    formats.save_clusters(_truth(spark, sf).where("cluster IS NOT NULL"), path)
    lines = spark.read.format("clusters").load(path)
    return lines.join(lines.groupBy("file", "line").agg(F.min("rid").alias("cluster")), ["file", "line"]).select("rid", "cluster")


@query("""SELECT CAST(label AS BIGINT) AS cluster, (n - 1) // 10 AS set_no, (n - 1) % 10 AS pos, vec_id AS rid
FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)""")
def sliced_sets(spark, sf):
    return recordsets.slices(_truth(spark, sf))


@query("""WITH t AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS turn FROM embeddings),
n AS (SELECT vec_id, row_number() OVER (ORDER BY turn, label) - 1 AS dim FROM t) SELECT dim // 10 AS set_no, dim % 10 AS pos, vec_id AS rid FROM n""")
def round_robin_sets(spark, sf):
    return recordsets.round_robin(_truth(spark, sf))


@query()
def resolve_oracle(spark, sf):
    """Resolution of the blocks with the labels as oracle: all records of a block and label are one cluster."""
    return resolve(_vectors(spark, sf), _blocks(spark, sf), clusterers.Oracle(_truth(spark, sf)), Settings(complete=True)).members


@query(f"""WITH RECURSIVE {_BLOCKS} SELECT count(*) AS n_records, count(DISTINCT rid) AS n_distinct, 0 AS n_mixed, count(DISTINCT (b.cluster, label)) AS n_clusters
FROM blocks b JOIN embeddings e ON b.rid = e.vec_id""")
def resolve_properties(spark, sf):
    """Every record is in one cluster, with the labels as oracle no cluster mixes blocks or labels, and all records of a
    block and label come together."""
    rows = durable(resolve_oracle(spark, sf), "resolved-oracle").join(_truth(spark, sf).withColumnRenamed("cluster", "label"), "rid")
    per = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("block", "label").alias("kinds"))
    both = per.agg(F.sum("n").alias("n_records"), F.count_if(F.col("kinds") > 1).cast("int").alias("n_mixed"), F.count("*").alias("n_clusters"))
    return both.crossJoin(rows.agg(F.countDistinct("rid").alias("n_distinct"))).select("n_records", "n_distinct", "n_mixed", "n_clusters")  # single rows


@query()
def resolve_threshold(spark, sf):
    vectors = _vectors(spark, sf)
    return resolve(vectors, _blocks(spark, sf), clusterers.Threshold(vectors, 0.45)).members


@query()
def resolution_report(spark, sf):
    truth = _truth(spark, sf)
    return _rounded(resolve(_vectors(spark, sf), _blocks(spark, sf), clusterers.Oracle(truth), Settings(complete=True)).evaluate(truth))


@query(f"""WITH RECURSIVE {_PAIRS}, links AS (SELECT least(x, y) AS cu, greatest(x, y) AS cv, max(sim) AS sim
  FROM (SELECT u - u % 10 AS x, v - v % 10 AS y, sim FROM pairs) WHERE x <> y GROUP BY 1, 2),
bands AS (SELECT *, least(CAST(floor((sim - 0.4) / 0.02) AS BIGINT), 4) AS band FROM links WHERE sim BETWEEN 0.4 AND 0.5),
probes AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY cu, cv) AS n FROM bands),
accepted AS (SELECT band FROM probes WHERE n <= 10 GROUP BY band HAVING avg(CASE WHEN sim > 0.45 THEN 1 ELSE 0 END) >= 0.5),
e AS (SELECT cu AS a, cv AS b FROM bands WHERE band IN (SELECT band FROM accepted) UNION ALL SELECT cv, cu FROM bands WHERE band IN (SELECT band FROM accepted)),
reach(c, hit) AS (SELECT DISTINCT vec_id - vec_id % 10, vec_id - vec_id % 10 FROM embeddings UNION SELECT r.c, e.b FROM reach r JOIN e ON r.hit = e.a),
least AS (SELECT c, min(hit) AS cluster FROM reach GROUP BY c)
SELECT vec_id AS rid, cluster FROM embeddings JOIN least ON c = vec_id - vec_id % 10""")
def banded_merge(spark, sf):
    """Clusters of ten records each joined band by band; two clusters are voted the same over 0.45."""
    members = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("rid"), (F.col("vec_id") - F.col("vec_id") % 10).alias("cluster"))
    links = joins.class_linkage(_vectors(spark, sf), OVER, members)
    return clusterers.banded_merge(members, links, 0.4, 0.5, lambda cells: cells.select("cu", "cv", (F.col("sim") > 0.45).alias("yes")))


@query(f"""WITH RECURSIVE {_PAIRS}, l AS (SELECT a.label AS x, b.label AS y FROM pairs JOIN embeddings a ON u = a.vec_id JOIN embeddings b ON v = b.vec_id WHERE sim > 0.45),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach(c, hit) AS (SELECT DISTINCT label, label FROM embeddings UNION SELECT r.c, e.y FROM reach r JOIN e ON r.hit = e.x),
least AS (SELECT c, min(hit) AS cluster FROM reach GROUP BY c)
SELECT vec_id AS rid, CAST(cluster AS BIGINT) AS cluster FROM embeddings JOIN least ON c = label""")
def merge_by_pairs(spark, sf):
    """The labels' clusters joined along the most similar pairs."""
    edges = joins.cosine_links(_vectors(spark, sf), 0.45).select(F.col("u").alias("a"), F.col("v").alias("b"))
    return merge.merge_by_pairs(_truth(spark, sf), edges)


@query()
def task_batches(spark, sf):
    """Batches of the tasks that blocks of several records are, by each strategy."""
    blocks = _blocks(spark, sf)
    several = blocks.groupBy("cluster").count().where("count > 1").select("cluster")
    tasks = blocks.join(several, "cluster")
    sims = durable(experiments.task_similarities(joins.class_linkage(_vectors(spark, sf), 0.2, tasks.select("rid", "cluster"))), "task-similarities")
    tasks = durable(several.select(F.col("cluster").alias("task")), "tasks")
    out = None
    for strategy in ("similar", "random", "dissimilar"):
        rows = experiments.batches(tasks, sims, strategy, seed=1).withColumn("strategy", F.lit(strategy))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH l AS (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT DISTINCT d.doc_id AS rid, coalesce(CAST(quality AS VARCHAR), 't' || toxic, 'alone_' || d.doc_id) AS cluster FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id""")
def pooled_predictions(spark, sf):
    """Documents by their quality label, else by the toxic one; those without labels alone."""
    labels = _table(spark, sf, "labels").groupBy(F.col("doc_id").alias("rid")).agg(F.min("quality").cast("string").alias("q"), F.concat(F.lit("t"), F.min("toxic").cast("string")).alias("t"))
    said = lambda pos, column: labels.select(F.lit(pos).alias("pos"), "rid", F.col(column).alias("cluster")).where("cluster is not null")
    return experiments.pooled(_table(spark, sf, "documents").select(F.col("doc_id").alias("rid")), said(1, "q").unionByName(said(2, "t")))


@query(f"""WITH {_SELECTED} SELECT pos, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS deviation FROM q GROUP BY pos""")
def repeated_runs(spark, sf):
    """Mean and deviation of the similarity at each place of the candidate lists, a list being a run."""
    return _rounded(experiments.repeats(_candidates(spark, sf), "pos", "sim"))


@query("SELECT CAST(label AS BIGINT) AS cluster, min(vec_id) AS rid FROM embeddings GROUP BY 1")
def first_members(spark, sf):
    return blocking.first_members(_truth(spark, sf))


@query("""SELECT doc_id AS rid, row_number() OVER (ORDER BY text, doc_id) - 1 AS pos FROM documents""")
def ranked_records(spark, sf):
    rows = _table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    return ranked(rows, ["text", "key"], "pos").select(F.col("key").alias("rid"), "pos")


@query(f"""WITH t AS (SELECT p_partkey AS rid, unnest({_TOKENS.format("p_name || ' ' || p_type")}) AS token FROM part),
d AS (SELECT rid, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 32 AS "at", CASE WHEN CAST('0x' || substr(md5(token), 9, 1) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END AS x FROM t)
SELECT rid, CAST("at" AS INTEGER) AS "at", CAST(sum(x) AS DOUBLE) AS x FROM d GROUP BY rid, "at" HAVING sum(x) <> 0""")
def hashed_embeddings(spark, sf):
    """Signed hashing vectors of parts' tokens, by dimension."""
    rows = _parts(spark, sf).select("rid", V.hashed_embedding(T.tokens(F.concat_ws(" ", "p_name", "p_type")), 32).alias("e"))
    return rows.select("rid", F.posexplode("e").alias("at", "x")).where("x <> 0")


_NEAR_PAIRS = f"""t AS (SELECT p_partkey AS rid, unnest({_TOKENS.format("p_name || ' ' || p_type")}) AS token FROM part),
d AS (SELECT rid, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 32 AS pos, sum(CASE WHEN CAST('0x' || substr(md5(token), 9, 1) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM t GROUP BY 1, 2),
v AS (SELECT rid, list(pos ORDER BY pos) AS places, list(x ORDER BY pos) AS xs, sqrt(sum(x * x)) AS length FROM d WHERE x <> 0 GROUP BY rid),
f AS (SELECT min(rid) AS rid, any_value(length) AS length FROM v GROUP BY places, xs),
s AS (SELECT a.rid AS u, b.rid AS v, sum(a.x * b.x) AS dot FROM d a JOIN d b ON a.pos = b.pos AND a.rid < b.rid GROUP BY 1, 2),
near AS (SELECT u, v, round(dot / (a.length * b.length), 6) AS sim FROM s JOIN f a ON u = a.rid JOIN f b ON v = b.rid WHERE dot / (a.length * b.length) > {NEAR})"""


def _part_vectors(spark, sf) -> DataFrame:
    """The first of parts with equal token vectors."""
    rows = _parts(spark, sf).select("rid", V.hashed_embedding(T.tokens(F.concat_ws(" ", "p_name", "p_type")), 32).alias("embedding"))
    return joins.classes(durable(rows, "part-vectors"), ["embedding"])[0]


@query(f"WITH {_NEAR_PAIRS} SELECT * FROM near")
def near_pairs(spark, sf):
    """Pairs of distinct token vectors of parts, at a threshold where bounds spare most cosines."""
    return _rounded(sphere.pairs(_part_vectors(spark, sf), NEAR))


def _recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: exact pairs, whether nine in ten of them are found, and pairs found that aren't exact ones."""
    both = exact.select("u", "v", F.lit(1).alias("is")).join(found.select("u", "v", F.lit(1).alias("met")), ["u", "v"], "full_outer")
    row = both.agg(F.count("is").alias("n_pairs"), F.count_if(F.expr("is = 1 AND met = 1")).alias("n_met"), F.count_if(F.expr("is IS NULL")).alias("n_wrong"))
    return row.select("n_pairs", (F.col("n_met") >= lsh.RECALL * F.col("n_pairs")).alias("enough"), "n_wrong")


@query(f"WITH {_NEAR_PAIRS} SELECT count(*) AS n_pairs, true AS enough, 0 AS n_wrong FROM near")
def lsh_near_recall(spark, sf):
    """The locality-sensitive join of parts' token vectors, at a threshold that it is made for, against the exact pairs."""
    firsts = durable(_part_vectors(spark, sf), "distinct-parts")
    return _recall(sphere.pairs(firsts, NEAR), lsh.lsh_pairs(firsts, NEAR))


@query(f"""WITH {_NEAR_PAIRS}, met AS (SELECT u, v FROM near UNION ALL SELECT v, u FROM near)
SELECT count(*) AS n_pairs, true AS enough, 0 AS n_wrong FROM met WHERE u % 100 = 0 AND v % 100 <> 0""")
def arrival_recall(spark, sf):
    """Parts whose number is divisible by 100 matched, as arrivals, against the stored buckets of all others."""
    firsts = durable(_part_vectors(spark, sf), "distinct-parts")
    stored = arrivals.store_buckets(firsts.where("rid % 100 <> 0"), NEAR)
    near = durable(sphere.pairs(firsts, NEAR).select("u", "v"), "near-parts")
    exact = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u % 100 = 0 AND v % 100 <> 0")
    return _recall(exact, arrivals.match_arrivals(firsts.where("rid % 100 = 0"), spark.table(stored), NEAR))


@query("""SELECT source, round(stddev_pop(n) / avg(n), 6) AS variation FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1""")
def count_variation(spark, sf):
    """How unevenly the languages of each source's documents are spread."""
    counts = _table(spark, sf, "documents").groupBy("source", "lang").count()
    return _rounded(counts.groupBy("source").agg(F.collect_list("count").alias("c")).select("source", V.variation(F.col("c")).alias("variation")))

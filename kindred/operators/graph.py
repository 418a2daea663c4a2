"""Connected components and closures over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.storage import durable, release


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over the undirected edges (a, b), for every id with an edge to another.

    Rounds of large-star and small-star (Kiveris et al., 2014), each written to the shared folder. Every step is a
    grouped minimum, combined before the shuffle, and an equi-join, so a hub never has to fit one task.
    """
    now = durable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()  # both uses below read one exchange
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        before, now = now, durable(small.where("a <> b").distinct(), "components")
        release(before)
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex of the distinct edges (a, b), b < a, has either one edge to a lesser vertex or none but edges to
    greater ones. Then each component is a star around its least vertex, and another round would change nothing."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up")))).alias("end"))
    ups = ends.groupBy("end.id").agg(F.sum("end.up").alias("ups"), F.count("*").alias("n"))
    return ups.where("ups > 1 or (ups > 0 and ups < n)").isEmpty()


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, sim), a < b: a maximum spanning forest of the undirected edges (a, b, sim); of equal ones the least ids go first.

    Boruvka's rounds: every tree takes its best edge to another tree, trees that are joined get one name, and of the edges
    between two trees only the best stays. A round at least halves the trees; every step is a grouped maximum or
    an equi-join. Whatever the threshold, the components of all edges over it are those of the forest's edges over it."""
    best = F.max(F.struct("sim", (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))).alias("best")
    ends = [F.least("a", "b"), F.greatest("a", "b")]
    plain = edges.where("a <> b and sim is not null").groupBy(ends[0].alias("p"), ends[1].alias("q")).agg(F.max("sim").alias("sim"))
    live, forest = durable(plain.withColumn("x", F.col("p")).withColumn("y", F.col("q")), "forest-edges"), []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("q").alias("p"), F.col("p").alias("q"), "sim", "x", "y"))
        taken = both.groupBy("p").agg(F.max_by("q", F.struct("sim", -F.col("x"), -F.col("y"))).alias("q"), best)
        taken = taken.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), (-F.col("best.x")).alias("x"), (-F.col("best.y")).alias("y"), "best.sim")
        taken = durable(taken.distinct(), "forest")  # two trees may take the same edge
        forest.append(taken)
        names = durable(components(taken), "forest-trees")
        of = lambda end, name, names=names: names.select(F.col("id").alias(end), F.col("component").alias(name))
        between = live.join(of("p", "r"), "p").join(of("q", "s"), "q").where("r <> s")
        fewer = between.groupBy(F.least("r", "s").alias("p"), F.greatest("r", "s").alias("q")).agg(best)
        before, live = live, durable(fewer.select("p", "q", "best.sim", (-F.col("best.x")).alias("x"), (-F.col("best.y")).alias("y")), "forest-edges")
        release(before, names)
    out = live.select(F.col("x").alias("a"), F.col("y").alias("b"), "sim")
    for taken in forest:
        out = out.unionByName(taken.select(F.col("x").alias("a"), F.col("y").alias("b"), "sim"))
    return out


def partitions_over(ids: DataFrame, forest: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, rid, cluster) for all of ids(rid) and each threshold: components of the forest's edges (a, b, sim) over it,
    found for all thresholds at once."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])).alias("threshold")
    over = forest.select("a", "b", "sim", each).where(F.col("sim") > F.col("threshold"))
    vertex = lambda end: F.struct("threshold", F.col(end).alias("rid"))
    found = components(over.select(vertex("a").alias("a"), vertex("b").alias("b")))
    led = found.select("id.threshold", "id.rid", F.col("component.rid").alias("cluster"))
    return ids.select("rid", each).join(led, ["threshold", "rid"], "left").select("threshold", "rid", F.coalesce("cluster", "rid").alias("cluster"))


def partition(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(rid, cluster) for all of ids(rid): component of edges(a, b), alone where a record has no edge."""
    found = components(edges).withColumnRenamed("id", "rid")
    return ids.select("rid").join(found, "rid", "left").select("rid", F.coalesce("component", "rid").alias("cluster"))


def closure(pairs: DataFrame) -> DataFrame:
    """(rid, cluster) of pairs(a, b), vertices of pairs (i, i) included as clusters of their own."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rid")).where("rid is not null").distinct()
    return partition(ids, pairs.where("a is not null and b is not null"))


def union_clusters(members: DataFrame, links: DataFrame) -> DataFrame:
    """members(rid, cluster, ...) with clusters joined along links(a, b) between cluster ids; the least id stays."""
    roots = components(links).select(F.col("id").alias("cluster"), "component")
    joined = members.join(roots, "cluster", "left")
    return joined.select(*[c for c in members.columns if c != "cluster"], F.coalesce("component", "cluster").alias("cluster"))

"""Pruned cosine joins and the spanning forest against exhaustive ones."""

import itertools

import numpy as np
import pytest

from kindred.operators import blocking, connected, experiments, graph, guard, joins, lsh, sphere


def vectors(spark, x):
    return spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "rid long, embedding array<float>")


def clustered(n=600, groups=12, spread=0.05, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centers = np.linalg.qr(rng.normal(size=(d, d)))[0][:groups]
    return centers[rng.integers(0, groups, n)] * rng.uniform(0.5, 2, (n, 1)) + rng.normal(size=(n, d)) * spread


@pytest.fixture(autouse=True)
def small_pages(monkeypatch):
    monkeypatch.setattr(sphere, "PAGE", 40)


def exact(x, over):
    u = x.astype(np.float32).astype(float)
    size = np.linalg.norm(u, axis=1)
    s = u @ u.T / np.where(size > 0, size, 1)[:, None] / np.where(size > 0, size, 1)[None]
    return {(i, j) for i, j in zip(*np.nonzero(s > over), strict=True) if i < j}


@pytest.mark.parametrize("over", [0.0, 0.4, 0.8])
def test_pairs_lose_nothing_and_spare_work(spark, over):
    for x in (clustered(), np.random.default_rng(1).normal(size=(300, 48))):
        x[7], x[8] = x[9], 0
        df = vectors(spark, x)
        got = sphere.pairs(df, over).collect()
        assert {(r.u, r.v) for r in got} == exact(x, over) and len({(r.u, r.v) for r in got}) == len(got)
        row = sphere.work(df, over).first()
        assert row.n == len(x) - 1 and row.compared <= row.met
        if over >= 0.8:  # at 0.4 groups 90 degrees apart can still hold such pairs
            assert row.compared < row.pairs / 2  # half of all pairs, of which each page's own are met twice
    assert sphere.pairs(df.where("false"), over).count() == 0


def test_pruned_intervals_are_not_met(spark):
    row = sphere.work(vectors(spark, clustered()), 0.8).first()
    assert row.met < 0.5 * row.n * row.n / 2


@pytest.mark.parametrize("chunk", [2])
def test_top_k(spark, monkeypatch, chunk):
    monkeypatch.setattr(sphere, "CHUNK", chunk)
    for x in (clustered(250), np.random.default_rng(2).normal(size=(130, 24)), np.ones((50, 4))):
        if len(x) > 50:
            x[3], x[4], x[100:115] = 0, 0, x[5]
        df = vectors(spark, x)
        want = sorted((r.u, r.v, r.rank, round(r.sim, 9)) for r in joins.top_k(df, 4).collect())
        assert sorted((r.u, r.v, r.rank, round(r.sim, 9)) for r in sphere.top_k(df, 4).collect()) == want
    assert sphere.top_k(df.where("false"), 4).count() == 0
    assert sphere.top_k(df.where("rid < 2"), 4).count() == 2  # fewer others than k


def plain_components(n, edges):
    name = list(range(n))
    for a, b in edges:
        x, y = name[a], name[b]
        name = [min(x, y) if c in (x, y) else c for c in name]
    return name


def test_one_forest_gives_the_components_of_every_threshold(spark):
    rng = np.random.default_rng(3)
    n = 60
    edges = [(int(a), int(b), round(float(rng.integers(1, 12)) / 12, 3)) for a, b in rng.integers(0, n, (150, 2))]  # ties, loops, repeats
    df = spark.createDataFrame([*edges, edges[0], (5, 5, 1.0), (1, 2, None)], "a long, b long, sim double")
    forest = graph.spanning_forest(df).collect()
    whole = plain_components(n, [(a, b) for a, b, _ in edges])
    assert len(forest) == n - len(set(whole))  # no cycle
    best = {}
    for a, b, s in edges:
        if a != b:
            best[min(a, b), max(a, b)] = max(best.get((min(a, b), max(a, b)), 0), s)
    assert all(best[r.a, r.b] == r.sim for r in forest)
    thresholds = [0.0, 0.2, 0.5, 0.9, 1.0]
    found = graph.partitions_over(spark.createDataFrame([(i,) for i in range(n)], "rid long"), graph.spanning_forest(df), thresholds)
    got = {(r.threshold, r.rid): r.cluster for r in found.collect()}
    for t, (_, want) in itertools.product(thresholds, [(0, 0)]):
        want = plain_components(n, [(a, b) for a, b, s in edges if s > t])
        assert [got[t, i] for i in range(n)] == want
    assert graph.spanning_forest(df.where("false")).count() == 0


def test_sweep_counts_records_that_one_side_lacks(spark):
    df = vectors(spark, np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1], [1, 1]]))
    truth = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (9, 2)], "rid long, cluster long")
    rows = {r.threshold: r for r in experiments.blocking_sweep(df, truth, [0.6, 0.9]).collect()}
    assert rows[0.9].completeness == 0.5 and rows[0.9].quality == 0.5 and rows[0.6].quality == 0.1
    assert round(rows[0.6].reduction, 9) == round(1 - 10 / 15, 9)


def test_attribute_pairs_prepare_no_copy(spark):
    """The similarity of a class's other members to its first is that of the class: no text of theirs is prepared."""
    rows = [(i, "b", f"name {i % 3}", None if i % 3 else "3.5") for i in range(12)]
    found = joins.attribute_pairs(spark.createDataFrame(rows, "rid long, by string, n string, x string"), ["n", "x"], 0.6, by="by")
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.u, r.v, r.sim) for r in found.where("sim = 1").collect()) == sorted((i % 3, i, 1.0) for i in range(3, 12))


@pytest.mark.parametrize("over", [0.3, 0.6, 0.95])
def test_blocks_without_pairs(spark, monkeypatch, over):
    """A forest of few edges has the components of all pairs, with and without a large one, and in many small blocks."""
    monkeypatch.setattr(joins, "BLOCK_ROWS", 12)
    x = np.random.default_rng(4).standard_normal((180, 5))
    x[7] = 0
    df = vectors(spark, x)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    root = np.arange(len(x))
    i, j = np.nonzero(np.triu(unit @ unit.T, 1) > over)
    connected.joined(root, i, j)
    assert {r.rid: r.cluster for r in blocking.exact_blocks(df, over).collect()} == dict(enumerate(root.tolist()))
    if over == 0.3:  # before, an edge for each pair
        assert connected.forest(df, over).count() < 5 * len(x) < len(i)
    assert connected.forest(df.where("false"), over).count() == 0


def test_class_linkage_passes_on_pairs_of_clusters(spark, monkeypatch):
    """Clusters' linkage by brute force, in many blocks, a copy in two clusters; no pair of records is shuffled."""
    monkeypatch.setattr(joins, "BLOCK_ROWS", 12)
    rng = np.random.default_rng(9)
    x, of = rng.standard_normal((120, 4)), np.minimum(rng.integers(0, 9, 120), 4)  # cluster 4 is the largest
    x = x.astype(np.float32).astype(float)
    x[3], of[3], of[5] = x[5], 0, 1
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i, j in zip(*np.nonzero(unit @ unit.T > 0.2), strict=True):
        if of[i] < of[j]:
            want[int(of[i]), int(of[j])] = max(want.get((int(of[i]), int(of[j])), 0.0), float((unit @ unit.T)[i, j]))
    members = spark.createDataFrame([(i, int(c)) for i, c in enumerate(of)], "rid long, cluster long")
    found = joins.class_linkage(vectors(spark, x), 0.2, members)
    assert {(r.cu, r.cv): round(r.sim, 6) for r in found.collect()} == {k: round(s, 6) for k, s in want.items()}
    assert "u#" not in found._jdf.queryExecution().optimizedPlan().toString().replace("cu#", "")  # before, a row for each pair of records


def test_large_tables_send_a_vector_to_few_others(spark):
    """How often a vector is sent doesn't grow with the table as long as blocks fit a task: before, once for each 1,024 vectors."""
    assert joins.blocks_for(200_000, 64) == joins.blocks_for(20_000, 64) == 16 and joins.blocks_for(5_000, 64) == 5
    assert joins.blocks_for(2_000_000, 64) == 123 and joins.blocks_for(20_000, 4096) == 41  # what one task holds is bounded
    assert lsh.BLOCK_ROWS > 600_000 / 2**7  # vectors of a signature of 7 bits


def test_a_pair_of_a_set_is_compared_once(spark):
    sets = spark.createDataFrame([(0, r, r % 2) for r in range(4)], "set_id long, rid long, cluster long")
    x = np.random.default_rng(1).standard_normal((4, 3))
    x[3] = 0
    found = guard.set_similarities(sets, vectors(spark, x))
    assert "(u#" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and " < v#" in plan
    got = {(r.u, r.v): (r.cu, r.cv, r.sim) for r in found.collect()}
    assert len(got) == 12 and all((cu, cv) == (u % 2, v % 2) and sim == got[v, u][2] for (u, v), (cu, cv, sim) in got.items())
    assert got[0, 3][2] is None and abs(got[0, 1][2] - x[0] @ x[1] / np.linalg.norm(x[0]) / np.linalg.norm(x[1])) < 1e-6

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators import blocking, clusterers, clustering, experiments, graph, guard, joins, lsh, matching, merge, metrics, recordsets
from kindred.operators.storage import durable
from kindred.plans.resolve import Settings, resolve


def members(spark, clusters):
    rows = [(r, k) for k, c in enumerate(clusters) for r in c]
    return spark.createDataFrame(rows, "rid long, cluster long")


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "rid long, embedding array<double>")


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)] + [(i, i + 1) for i in range(100, 130)]
    found = dict(graph.closure(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {i: found[i] for i in (1, 2, 3, 7, 8, 9)} == dict.fromkeys((1, 2, 3, 7, 8, 9), 1)
    assert (found[20], found[21], found[5], found[130]) == (20, 20, 5, 100)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    star, path = [(5, i) for i in range(20)], [(100 + i, 101 + i) for i in range(40)]
    edges = star + path + [(3, 3), (200, 201), (201, 200)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(20)} | {100 + i: 100 for i in range(41)} | {200: 200, 201: 200}


def test_metrics(spark):
    table = metrics.contingency(metrics.aligned(members(spark, [[1, 2], [3, 4], [5]]), members(spark, [[1, 2, 3], [4, 5]])))
    row = lambda f: f(table).first().asDict()
    assert row(metrics.f_purity) == pytest.approx({"purity": 0.8, "inverse_purity": 0.6, "f_measure": 0.685714}, abs=1e-6)
    assert row(metrics.bcubed) == pytest.approx({"precision": 0.8, "recall": 0.533333, "f1": 0.64}, abs=1e-6)
    assert row(metrics.cluster_purity) == pytest.approx({"macro_purity": 0.833333, "pure_ratio": 0.666667, "tolerant_purity": 1.0}, abs=1e-6)
    pair = row(metrics.pairwise)
    assert [pair[k] for k in ("tp", "fp", "fn", "tn")] == [1, 1, 3, 5]
    assert [round(pair[k], 6) for k in ("accuracy", "precision", "recall", "f1")] == [0.6, 0.5, 0.25, 0.333333]
    assert round(row(metrics.adjusted_rand)["ari"], 6) == 0.090909
    assert row(metrics.accuracy)["accuracy"] == 0.6
    assert row(metrics.block_quality) == pytest.approx({"completeness": 0.25, "quality": 0.5, "reduction": 0.8, "f1": 1 / 3})


def test_metrics_of_many_records(spark):
    """Numbers of pairs fit 64 bits, their products don't."""
    cells = [(str(p), str(t), 300_000 if p == t else 20_000) for p in range(10) for t in range(10)]
    table = spark.createDataFrame(cells, "p string, t string, n long")
    pairs = lambda n: n * (n - 1) // 2
    tp, side, whole = sum(pairs(n) for *_, n in cells), 10 * pairs(480_000), pairs(4_800_000)
    expected = side * side / whole
    assert metrics.adjusted_rand(table).first()["ari"] == pytest.approx((tp - expected) / (side - expected), abs=1e-9)
    pair = metrics.pairwise(table).first()
    assert [pair[k] for k in ("tp", "fp", "fn", "tn")] == [tp, side - tp, side - tp, whole - 2 * side + tp]
    row = metrics.report(spark.range(600_000).selectExpr("id AS rid", "id % 2 AS cluster"), spark.range(600_000).selectExpr("id AS rid", "id % 10 AS cluster")).first()
    assert (row["purity"], row["inverse_purity"], row["accuracy"], row["bcubed_recall"]) == pytest.approx((0.2, 1.0, 0.2, 1.0))
    assert 0 < row["ari"] < 1


def test_missing_records_are_alone(spark):
    labels = metrics.aligned(members(spark, [[1, 2]]), members(spark, [[2, 3]]))
    assert {(r.rid, r.p, r.t) for r in labels.collect()} == {(1, "0", "alone_1"), (2, "0", "0"), (3, "alone_3", "0")}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment(rows, cols, seed):
    gain = np.random.default_rng(seed).integers(0, 6, (rows, cols)).astype(float)
    wide = gain if rows <= cols else gain.T
    best = max(sum(wide[i, c] for i, c in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
    cells = {i: [(c, g) for c, g in enumerate(row) if g] for i, row in enumerate(gain)}
    assert metrics.best_matching(cells) == best


S = np.array([[1, 0.9, 0.3, 0.2], [0.9, 1, 0.4, 0.1], [0.3, 0.4, 1, 0.8], [0.2, 0.1, 0.8, 1]])


def pairs_of(spark, clusters):
    of = {r: k for k, c in enumerate(clusters) for r in c}
    rows = [(0, u, v, of[u], of[v], float(S[u, v])) for u in of for v in of if u != v]
    return spark.createDataFrame(rows, "set_id long, u long, v long, cu long, cv long, sim double")


def test_guard(spark):
    sets = lambda cs: spark.createDataFrame([(0, p, r, k) for p, (r, k) in enumerate((r, k) for k, c in enumerate(cs) for r in c)], "set_id long, pos long, rid long, cluster long")
    good, bad = [[0, 1], [2, 3]], [[0, 1, 2], [3]]
    assert guard.verdicts(sets(good), pairs_of(spark, good)).first().accepted
    wrong = guard.offenders(guard.intra_inter(pairs_of(spark, bad)))
    assert [(r.rid, r.cluster, r.target) for r in wrong.collect()] == [(2, 0, 1)]
    again = guard.regenerated(sets(bad), wrong).orderBy("pos").collect()
    assert [r.rid for r in again] == [0, 1, 3, 2]
    assert not guard.separated(pairs_of(spark, bad)).first().separated


def test_large_groups_by_rounds_equal_groups_in_a_task(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g, (n, k) in enumerate(((300, 3), (200, 2), (5, 1))):
        centers = rng.normal(size=(k, 4)) * 20
        rows += [(g if g else None, 1000 * g + i, (centers[i % k] + rng.normal(size=4) * 0.1).tolist()) for i in range(n)]
    rows += [(7, 9000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]  # equal ones
    # Groups that overlap, up to no structure at all, and one that is drawn from in part
    rows += [(8, 20000 + i, (rng.normal(size=4) + (i % 4) * 0.8).tolist()) for i in range(400)]
    rows += [(9, 30000 + i, rng.uniform(size=4).tolist()) for i in range(3000)]
    table = spark.createDataFrame(rows, "label int, rid long, embedding array<double>")
    got = {largest: sorted(map(str, clustering.kmeans_groups(table, "label", largest=largest).collect())) for largest in (50, 5000)}
    assert got[50] == got[5000] and len(got[50]) == len(rows)
    plain = clustering.elbow_kmeans(np.array([r[2] for r in rows[:300]]), 5)  # to the last move, from other starts
    assert [(r.k, r.cluster) for r in clustering.kmeans_groups(table.where("label is null"), "label").orderBy("rid").collect()] == [(plain[0], c) for c in plain[1].tolist()]
    assert clustering.kmeans_groups(table.limit(0), "label").count() == 0


def test_sequential_helpers():
    assert recordsets.chain(np.linalg.cholesky(S)[[0, 2, 1, 3]]) == [0, 2, 1, 3] and recordsets.chain(np.zeros((0, 2))) == []
    assert clustering.elbow([10, 2, 1, 0]) == 2 and clustering.elbow([0, 0]) == 1
    assert clustering.choose_k(np.zeros((1, 2)), 4) == 1
    assert merge.pack([2, 3], lambda a, b: 0.0) == [[(0, 0), (1, 0)], [(0, 1), (1, 1)], [(1, 2)]]
    labels, inertia = clustering.kmeans(np.array([[0.0], [0.1], [5.0], [5.1]]), 2)
    assert labels.tolist() == [0, 0, 1, 1] and inertia == pytest.approx(0.01)
    assert clustering.kmeans(np.ones((1, 2)), 3)[0].tolist() == [0]


def test_joins_agree(spark):
    x = np.random.default_rng(1).standard_normal((60, 4))
    x[1] = x[0]
    df = vectors(spark, x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if unit[i] @ unit[j] > 0.9}
    assert {(r.u, r.v) for r in joins.cosine_pairs(df, 0.9).collect()} == want
    met = {(r.u, r.v) for r in lsh.lsh_pairs(df, 0.9, bits=4).collect()}
    assert met <= want and (0, 1) in met
    top = joins.top_k(df, 3).collect()
    for i in (0, 5):
        sims = np.where(np.arange(60) == i, -9, unit @ unit[i])
        best = sorted(range(60), key=lambda j: (-round(sims[j], 12), j))[:3]
        assert [r.v for r in sorted((r for r in top if r.u == i), key=lambda r: r.rank)] == best
    row = blocking.threshold(df).first()
    full = unit @ unit.T
    assert (row.n, row.mean, row.sigma) == pytest.approx((60, full.mean(), full.std()))


def test_jaccard_prefix_filter(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"t{k}" for k in rng.integers(0, 12, rng.integers(1, 7))) for _ in range(80)] + ["", "!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    sets = [set(t.split()) - {"!!"} for t in texts]
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]) - 1e-9}
    assert expanded(joins.jaccard_pairs(df, "text", 0.6).collect(), lambda i: frozenset(sets[i])) == want


def expanded(pairs, key):
    """All pairs of records that follow from pairs between classes of equal key and from membership."""
    members = {}
    for i in {i for r in pairs for i in (r.u, r.v)}:
        members.setdefault(key(i), set()).add(i)
    of = lambda i: members[key(i)]
    assert all(r.u < r.v and r.u == min(of(r.u)) for r in pairs)  # the first of a class stands for it
    return {(min(i, j), max(i, j)) for r in pairs for i in of(r.u) for j in of(r.v) if i != j}


def test_attribute_pairs_lose_nothing(spark):
    rng = np.random.default_rng(4)
    names = ["red car", "red  bike", "car", "Red", "a b c", "a b d", "", "nan", None]
    sizes = ["3.14", "3.15", "314", "13.1", "3.1", "3", "x.y z", None]
    rows = [(i, "b", names[a], sizes[b]) for i, (a, b) in enumerate(sorted({(int(a), int(b)) for a, b in rng.integers(0, [9, 8], (70, 2))}))]
    df = spark.createDataFrame(rows, "rid long, b string, x string, y string")
    prepared = df.select("rid", *[T.prepared_attribute(F.col(c)).alias(c) for c in "xy"])
    u, v = (prepared.select(*[F.col(c).alias(p + c) for c in prepared.columns]) for p in "uv")
    sim = T.attribute_similarity([F.col("ux"), F.col("uy")], [F.col("vx"), F.col("vy")])
    every = u.join(v, F.col("urid") < F.col("vrid")).select("urid", "vrid", sim.alias("sim")).collect()
    for at_least in (0.3, 0.6, 0.75, 1.0):
        want = {(r.urid, r.vrid, r.sim) for r in every if r.sim >= at_least}
        assert {tuple(r) for r in joins.attribute_pairs(df, ["x", "y"], at_least, "b").collect()} == want


def test_copies_make_no_pairs_among_themselves(spark):
    x = np.random.default_rng(2).standard_normal((12, 4))
    x = np.concatenate([np.zeros((2, 4)), x[[0] * 30], x])
    df = vectors(spark, x)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if unit[i] @ unit[j] > 0.5}
    got = joins.cosine_links(df, 0.5).collect()
    assert len(got) < 100 and expanded(got, lambda i: tuple(np.round(x[i], 6))) == want
    rows = [(i, "b" if i < 40 else None, "red car" if i % 2 else "red bike", "3.14") for i in range(45)]
    found = joins.attribute_pairs(spark.createDataFrame(rows, "rid long, b string, x string, y string"), ["x", "y"], 0.6, "b").collect()
    assert len(found) == 39 and expanded(found, lambda i: i % 2) == {(i, j) for i in range(40) for j in range(i + 1, 40)}
    queries = joins.top_k_of(df.where("rid % 9 = 4"), df, 3).collect()
    assert sorted(queries) == sorted(joins.top_k(df, 3).where("u % 9 = 4").collect())
    assert joins.top_k_of(df.where("false"), df, 3).count() == 0 and joins.cosine_links(df.where("false"), 0.5).count() == 0


def test_record_sets_cover(spark):
    x = np.random.default_rng(5).standard_normal((40, 3))
    blocks = spark.createDataFrame([(i, 0 if i < 38 else i) for i in range(40)], "rid long, cluster long")
    rows = recordsets.record_sets(vectors(spark, x), blocks).collect()
    assert sorted(r.rid for r in rows) == list(range(40))
    sizes = {}
    for r in rows:
        sizes[(r.block, r.set_no)] = sizes.get((r.block, r.set_no), 0) + 1
    assert sorted(sizes.values()) == [1, 1, 2, 9, 9, 9, 9]


def test_clustered_completes_and_retries(spark):
    df = vectors(spark, [(1, 0), (1, 0.1), (0, 1), (0.1, 1)])
    records = spark.createDataFrame([(i, str(i)) for i in range(4)], "rid long, text string")
    sets = spark.createDataFrame([("s", i, i) for i in range(4)], "set_id string, pos long, rid long")
    good = clusterers.Callback(records, "text", lambda ids, texts: [[0, 1, 1, 77], [2, 1]])
    out, log = clusterers.clustered(sets, df, good)
    groups = {}
    for r in out.collect():
        groups.setdefault(r.cluster, set()).add(r.rid)
    assert sorted(map(sorted, groups.values())) == [[0, 1], [2], [3]]
    assert log.first().calls == 1
    bad = clusterers.Callback(records, "text", lambda ids, texts: [[0, 2], [1, 3]])
    assert clusterers.clustered(sets, df, bad)[1].first().asDict() == {"set_id": "s", "calls": 3, "rejected": 3}


def test_clustered_counts_tries_that_cannot_differ(spark):
    df = vectors(spark, [(1, 0), (1, 0.1), (0, 1), (0.1, 1), (1, 0), (0, 1)])
    truth = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1), (4, 0), (5, 1)], "rid long, cluster long")
    sets = spark.createDataFrame([("s", i, i) for i in range(4)] + [("t", 0, 4), ("t", 1, 5)], "set_id string, pos long, rid long")
    asked = clusterers.Oracle(truth)
    asked.ordered = True
    results = []
    for clusterer in (clusterers.Oracle(truth), asked):
        out, log = clusterers.clustered(sets, df, clusterer)
        groups = {}
        for r in out.collect():
            groups.setdefault((r.set_id, r.cluster), []).append(r.rid)
        results.append((sorted(map(sorted, groups.values())), sorted(map(tuple, log.select("set_id", "calls", "rejected").collect()))))
    assert results[0] == results[1] == ([[0, 2], [1, 3], [4], [5]], [("s", 3, 3), ("t", 1, 0)])


def test_kmeans_of_copies_and_separate_groups():
    x = np.repeat(np.array([[0.0, 1.0], [5.0, 1.0], [0.0, 9.0]]), 6, axis=0)
    k, labels = clustering.elbow_kmeans(x, 5)
    assert k == 2 and labels.tolist() == [0] * 12 + [1] * 6  # the third cluster saves less than the second
    assert clustering.kmeans(x, 3)[0].tolist() == [0] * 6 + [1] * 6 + [2] * 6
    assert clustering.elbow_kmeans(x[:6], 4)[0] == 1  # copies of one vector
    labels, inertia = clustering.kmeans(x + 1e6, 3)  # far from the origin
    assert len(set(labels.tolist())) == 3 and inertia < 1e-9


def test_resolution(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((6, 8))
    x = np.concatenate([c + 0.01 * rng.standard_normal((5, 8)) for c in centers])
    truth = spark.createDataFrame([(i, i // 5) for i in range(30)], "rid long, cluster long")
    blocks = spark.createDataFrame([(i, 0) for i in range(30)], "rid long, cluster long")
    done = resolve(vectors(spark, x), blocks, clusterers.Oracle(truth))
    rows = done.members.collect()
    assert sorted(r.rid for r in rows) == list(range(30))
    entities = {}
    for r in rows:
        entities.setdefault(r.cluster, set()).add(r.rid // 5)
    assert all(len(e) == 1 for e in entities.values())  # never joins two entities
    assert done.statistics().first().calls > 0
    by_threshold = resolve(vectors(spark, x), blocks, clusterers.Threshold(vectors(spark, x), 0.95)).members
    assert by_threshold.select("cluster").distinct().count() >= 6


def plain_merge(sets, entity, x, rounds=20, size=9):
    """Partition by the merge loop as it is defined: round by round over lists, sets in packing order, an oracle as clusterer."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def grouped(clusters, reps):
        found = {}
        for c, r in zip(clusters, reps, strict=True):
            found.setdefault(entity[r], []).extend(c)
        return list(found.values())

    def middle(cluster):
        far = np.linalg.norm(x[cluster] - x[cluster].mean(axis=0), axis=1)
        return min(zip(np.round(far, 9), cluster, strict=True))[1]

    state = [grouped([[r] for r in s], s) for s in sets]
    for _ in range(rounds):
        clusters = [c for s in state for c in s]
        reps = [[middle(c) for c in s] for s in state]
        if len(clusters) <= size:
            packed = [[(k, i) for k, s in enumerate(state) for i in range(len(s))]]
        else:
            packed = merge.pack([len(s) for s in state], lambda p, q: float(unit[reps[p[0]][p[1]]] @ unit[reps[q[0]][q[1]]]))
        after = [[c] for chosen in packed for c in grouped([state[k][i] for k, i in chosen], [reps[k][i] for k, i in chosen])]
        if len(after) == len(clusters):
            break
        state = after
    return sorted(sorted(c) for s in state for c in s)


def test_merge_equals_the_plain_loop(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((80, 6))
    of = [0] * 50 + [1] * 20 + [2] * 7 + [3, 4, 5]  # blocks
    entity = [int(e) for e in rng.integers(0, 12, 80)]  # members that aren't alike
    df = vectors(spark, x).cache()
    blocks = spark.createDataFrame(list(enumerate(of)), "rid long, cluster long")
    done = resolve(df, blocks, clusterers.Oracle(spark.createDataFrame(list(enumerate(entity)), "rid long, cluster long")))
    got, sets, want = {}, {}, []
    for r in done.members.collect():
        got.setdefault((r.block, r.cluster), []).append(r.rid)
    for r in recordsets.record_sets(df, blocks).orderBy("block", "set_no", "pos").collect():
        sets.setdefault(r.block, {}).setdefault(r.set_no, []).append(r.rid)
    for block in sets.values():
        want += plain_merge(list(block.values()), entity, x)
    assert sorted(map(sorted, got.values())) == sorted(want)
    assert 12 < len(want) < 70  # some is merged, and not all that could be


@pytest.mark.parametrize("all_pairs", [128, 10])
def test_a_complete_merge_joins_all_of_an_entity(spark, monkeypatch, all_pairs):
    """With unlike members rounds of packing end early; all that is left meets, in sets of pairs or dealt by hashes before."""
    monkeypatch.setattr(merge, "ALL_PAIRS", all_pairs)
    rng = np.random.default_rng(11)
    of = [0] * 150 + [1] * 20 + [2] * 7 + [3, 4, 5]  # blocks
    entity = [int(e) for e in rng.integers(0, 12, len(of))]
    df = vectors(spark, rng.standard_normal((len(of), 6))).cache()
    blocks = spark.createDataFrame(list(enumerate(of)), "rid long, cluster long")
    truth = clusterers.Oracle(spark.createDataFrame(list(enumerate(entity)), "rid long, cluster long"))
    got, want = {}, {}
    done = resolve(df, blocks, truth, Settings(complete=True))
    for r in done.members.collect():
        got.setdefault((r.block, r.cluster), []).append(r.rid)
        want.setdefault((of[r.rid], entity[r.rid]), []).append(r.rid)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(c == min(rids) for (_, c), rids in got.items()) and done.statistics().first().sets > 20


def test_batches(spark):
    tasks = spark.createDataFrame([(t, t) for t in range(5)], "task long, rid long")
    sims = spark.createDataFrame([(a, b, 1.0 / (1 + abs(a - b))) for a in range(5) for b in range(5) if a != b], "a long, b long, sim double")
    got = lambda s: [r.task for r in experiments.batches(tasks, sims, s, size=2).orderBy("batch", "pos").collect()]
    assert got("similar") == [0, 1, 2, 3, 4] and got("dissimilar") == [0, 4, 1, 3, 2]
    assert sorted(got("random")) == list(range(5))


def test_anchor_modes(spark):
    df = vectors(spark, [(0, 0.0), (1, 0), (10, 0), (2, 0)])
    assert [r.rid for r in blocking.central_anchors(df, 1).collect()] == [3]
    chosen = blocking.block_anchors(df, spark.createDataFrame([(i, 0) for i in range(4)], "rid long, cluster long"), 0.3).collect()
    assert len(chosen) == 2


def test_copies_share_a_block_without_pairs(spark):
    df = vectors(spark, [(1, 0)] * 40 + [(0.99, 0.05), (0, 1), (0, 0), (0, 0)])
    for blocks in (blocking.exact_blocks(df, 0.9), blocking.lsh_blocks(df, 0.9, bits=2)):
        found = dict(blocks.collect())
        assert {found[i] for i in range(41)} == {0} and [found[i] for i in (41, 42, 43)] == [41, 42, 43]
    assert blocking.exact_blocks(df, 1.0).select("cluster").distinct().count() == 44


def test_reports_by_dataset(spark):
    rows = spark.createDataFrame([("a", 0, 1, True), ("a", 0, 2, True), ("b", 3, 4, False)], "set string, anchor long, candidate long, is_match boolean")
    truth = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 3), (4, 3)], "rid long, cluster long")
    by = {r["set"]: (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) for r in matching.confusion(rows, truth, ("set",)).collect()}
    assert by == {"a": (1, 1, 0, 0, 0.5, 1.0), "b": (0, 0, 1, 0, 0.0, 0.0)}
    assert matching.macro_mean(matching.confusion(rows, truth, ("set",))).first().recall == 0.5
    open_, done = spark.createDataFrame([("p",), ("q",)], "prompt string"), spark.createDataFrame([("p", "yes")], "prompt string, reply string")
    cache = done.selectExpr("sha2(prompt, 256) as key", "reply")
    answered, rest = matching.with_cache(open_, cache)
    assert [r.reply for r in answered.collect()] == ["yes"] and [r.prompt for r in rest.collect()] == ["q"]


def near_threshold(pairs=250, seed=5):
    """Pairs of 64-dimensional unit vectors with cosines from 0.41 to 0.55."""
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((2, pairs, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    t = np.linspace(0.41, 0.55, pairs)[:, None]
    return np.concatenate([x, t * x + np.sqrt(1 - t * t) * y])


def test_lsh_recall_at_production_parameters(spark, monkeypatch):
    from kindred.plans import catalog
    from kindred.streaming import arrivals

    df = vectors(spark, near_threshold()).cache()
    want = {(r.u, r.v) for r in joins.cosine_pairs(df, catalog.OVER).collect()}
    rows = [(r.u, r.v) for r in lsh.lsh_pairs(df, catalog.OVER).collect()]
    assert len(rows) == len(set(rows)) and set(rows) <= want
    assert len(want) >= 250 and len(rows) >= 0.9 * len(want)
    assert len(lsh.lsh_pairs(df, catalog.OVER, **lsh.REFERENCE).collect()) < 0.1 * len(want)
    monkeypatch.setattr(lsh, "BLOCK_ROWS", 3)  # buckets in many parts give the same pairs
    assert sorted((r.u, r.v) for r in lsh.lsh_pairs(df, catalog.OVER).collect()) == sorted(rows)
    new, known = df.where("rid >= 250"), df.where("rid < 250")
    across = {(v, u) for u, v in want if u < 250 <= v}
    met = [(r.u, r.v) for r in arrivals.match_arrivals(new, arrivals.buckets(known, catalog.OVER), catalog.OVER).collect()]
    assert len(met) == len(set(met)) and set(met) <= across and len(met) >= 0.9 * len(across)


def test_lsh_parameters_by_threshold(spark):
    for over in (-0.5, 0.0, 0.2, 0.4, 0.6, 0.9, 0.99):
        how = lsh.tuned(over)
        p = 1 - np.arccos(over) / np.pi
        assert 1 - (1 - p ** how["bits"]) ** how["tables"] >= 0.9 and how["tables"] <= lsh.MOST_TABLES
    assert lsh.tuned(0.4, **lsh.REFERENCE) == {"bits": 15, "tables": 8, "seed": 42}
    df = vectors(spark, [(1, 0), (-1, 0.1), (0, 0), (1, 0)])
    assert {(r.u, r.v) for r in lsh.lsh_pairs(df, -1.0).collect()} == {(0, 1), (0, 3), (1, 3)}


def plain_record_sets(x, draws, size=9, spread=4):
    """Record sets of one block, straight from their definition: lists, no queues."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    left, out = list(range(len(x))), []
    spent, of, far = 1.0, {}, {}
    while left:
        if len(left) <= size:
            chosen = list(left)
        else:
            if spent >= 0.5:
                labels = clustering.whole_group(x[left], np.array([draws[i] % len(left) < clustering.SAMPLE for i in left]), spread)[1]
                of, held = dict(zip(left, labels.tolist(), strict=True)), len(left)
                means = {n: x[[i for i in left if of[i] == n]].mean(axis=0) for n in set(of.values())}
                far = {i: round(float(np.linalg.norm(x[i] - means[of[i]])), 9) for i in left}
            chosen = []
            for n in sorted(means):
                members = [i for i in left if of[i] == n]
                if len(members) >= size // spread:
                    best = members if len(members) == size // spread else sorted(members, key=lambda i: (far[i], i))
                    chosen += best[: size // spread][: size - len(chosen)]
            while len(chosen) < size:
                def uneven(i):
                    counts = np.array([sum(of[j] == n for j in [*chosen, i]) for n in {of[j] for j in [*chosen, i]}], float)
                    return counts.std() / counts.mean()
                chosen.append(min((i for i in left if i not in chosen), key=uneven))
            spent = 1 - (len(left) - len(chosen)) / held
        order, more = chosen[:1], chosen[1:]
        while more:
            order.append(more.pop(int(np.argmax([unit[order[-1]] @ unit[i] for i in more]))))
        out.append(order)
        left = [i for i in left if i not in chosen]
    return out


def test_record_sets_are_the_same_in_a_task_and_by_jobs_and_plain(spark):
    rng = np.random.default_rng(7)
    sizes = [170, 61, 40, 12, 1]
    x = np.concatenate([rng.standard_normal((n, 4)) + 3 * (np.arange(n) % 3)[:, None] for n in sizes])
    x[100:130] = x[100]  # copies
    of = [b for b, n in enumerate(sizes) for _ in range(n)]
    df = vectors(spark, x).cache()
    blocks = spark.createDataFrame(list(enumerate(of)), "rid long, cluster long")
    draws = {r.rid: r.draw for r in recordsets.dealt(df, blocks).collect()}
    want, start = [], 0
    for b, n in enumerate(sizes):
        for k, s in enumerate(plain_record_sets(x[start : start + n], [draws[start + i] for i in range(n)])):
            want += [(b, k, pos, start + i) for pos, i in enumerate(s)]
        start += n
    for largest in (30, recordsets.LARGEST_BLOCK):
        assert sorted(map(tuple, recordsets.record_sets(df, blocks, largest=largest).collect())) == sorted(want)
    assert recordsets.record_sets(df, blocks.limit(0)).count() == 0


def test_record_sets_of_large_blocks(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((5200, 4)) * 0.2 + 1
    x[:1800] = x[0]  # copies, as many as a third
    df = vectors(spark, x).cache()
    blocks = df.select("rid", (F.col("rid") * 0).alias("cluster"))
    whole = sorted(map(tuple, recordsets.record_sets(df, blocks).collect()))
    assert sorted(r[3] for r in whole) == list(range(5200)) and {r[0] for r in whole} == {0}
    sets: dict = {}
    for _, n, pos, _ in whole:
        sets.setdefault(n, []).append(pos)
    assert sorted(map(len, sets.values())) == [7] + [9] * 577 and all(sorted(p) == list(range(len(p))) for p in sets.values())
    assert sorted(map(tuple, recordsets.record_sets(df, blocks, largest=2000).collect())) == whole


def test_record_sets_read_the_blocks_once_and_write_what_is_left_once_a_round(spark, monkeypatch):
    x = np.random.default_rng(3).standard_normal((130, 4))
    df, seen, labels = vectors(spark, x).cache(), spark.sparkContext.accumulator(0), []

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    blocks = df.selectExpr("rid", "CAST(rid >= 120 AS LONG) AS cluster").mapInArrow(counted, "rid long, cluster long")
    monkeypatch.setattr(recordsets, "durable", lambda rows, label: labels.append(label) or durable(rows, label))
    assert recordsets.record_sets(df, blocks, largest=30).count() == 130
    assert seen.value == 130
    assert labels.count("picked-sets") == 2 and labels.count("large-blocks") == 3  # 120, 57 and 21 records of the large block


def test_settled_starts_are_compared_no_more(monkeypatch):
    rng = np.random.default_rng(5)
    x, drawn, compared, plain = rng.standard_normal((3000, 6)), np.arange(3000) < 2000, [], clustering.squares
    ks, at = clustering.runs_of(4)
    centers, before, used = clustering.first_centers(x[drawn], ks), np.full(len(ks), np.inf), None
    for rounds in range(1, clustering.ROUNDS + 1):  # all starts in every round
        used, far, inertia, moved = centers, plain(x, centers), [], centers.copy()
        for a, z in zip(at, at[1:], strict=False):
            of = far[:, a:z].argmin(axis=1)
            inertia.append(far[np.arange(len(x)), a + of].sum())
            for c in set(of.tolist()):
                moved[a + c] = x[of == c].mean(axis=0)
        live = np.array(inertia) < np.where(np.isfinite(before), before * (1 - clustering.SETTLED), np.inf)
        centers, before = np.where(np.repeat(live, np.diff(at))[:, None], moved, used), np.array(inertia)
        if not live.any():
            break
    k, run = clustering.chosen_run(before, 4)
    near, number = plain(x, used[at[run] : at[run + 1]]).argmin(axis=1), {}
    monkeypatch.setattr(clustering, "squares", lambda x, centers: compared.append(len(centers)) or plain(x, centers))
    got = clustering.whole_group(x, drawn, 4)
    assert got[0] == k and got[1].tolist() == [number.setdefault(c, len(number)) for c in near.tolist()]
    assert compared[0] == at[-1] and compared == sorted(compared[:-1], reverse=True) + compared[-1:]
    assert len(compared) == rounds + 1 and sum(compared[:-1]) < 0.8 * rounds * at[-1]


def test_packed_sets_by_chunks(spark):
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 4, 31).tolist()
    x = rng.standard_normal((sum(sizes), 3))
    at = [(s, c) for s, n in enumerate(sizes) for c in range(n)]
    rows = [(5, s << 31, c, i, x[i].tolist()) for i, (s, c) in enumerate(at)]  # runs of two sets
    found = merge.packed_sets(spark.createDataFrame(rows, "block long, set_no long, cluster_no int, rid long, embedding array<double>")).collect()
    got: dict = {}
    for r in sorted(found, key=lambda r: r.pos):
        got.setdefault(r.set_id, []).append(r.rid)
    unit, number = x / np.linalg.norm(x, axis=1, keepdims=True), {p: i for i, p in enumerate(at)}
    want = merge.pack(sizes, lambda p, q: float(unit[number[p]] @ unit[number[q]]))
    assert sorted(got.values()) == sorted([number[p] for p in chosen] for chosen in want)
    assert max(len({at[i][0] // 9 for i in ids}) for ids in got.values()) == 1


def test_accuracy_of_wide_tables(spark):
    rng = np.random.default_rng(5)
    for rows, cols in ((3, 40), (40, 3), (12, 12)):
        gain = rng.integers(0, 5, (rows, cols))
        cells = [(f"p{i}", f"t{j}", int(n)) for i, row in enumerate(gain) for j, n in enumerate(row) if n]
        got = metrics.accuracy(spark.createDataFrame(cells, "p string, t string, n long")).first().accuracy
        every = {i: [(j, float(n)) for j, n in enumerate(row) if n] for i, row in enumerate(gain)}  # without leaving small cells out
        assert got == pytest.approx(metrics.best_matching(every) / gain.sum())
    assert metrics.accuracy(spark.createDataFrame([], "p string, t string, n long")).first().accuracy == 0


def test_ranked_keeps_every_row(spark):
    from kindred.operators.ordering import ranked

    wide = F.concat(*[F.sha2((F.col("id") * k).cast("string"), 256) for k in (3, 5, 7, 11)])
    rows = spark.range(0, 1_000_000, 1, 16).select((F.col("id") % 400_000).alias("key"), wide.alias("text"), F.col("id").alias("rid"))
    got = ranked(rows, ["key"], "place")
    n, distinct, least, most = got.agg(F.count("*"), F.countDistinct("place"), F.min("place"), F.max("place")).first()
    assert (n, distinct, least, most) == (1_000_000, 1_000_000, 0, 999_999)
    assert got.agg(F.countDistinct("rid")).first()[0] == 1_000_000
    assert got.where(F.col("key") == 77).agg(F.min("place"), F.max("place")).first() == (77 * 3, 77 * 3 + 2)
    few = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (1, "a")], "k long, rid string")
    assert sorted((r.rid, r.k or 0) for r in ranked(few, ["k"]).collect()) == [(0, 0), (1, 1), (2, 1), (3, 1)]  # rid is replaced
    assert ranked(few.where("false"), ["k"]).count() == 0
    ties = lambda parts: [(r.t, r.at) for r in ranked(spark.createDataFrame([(1, f"x{i}") for i in range(50)], "k long, t string").repartition(parts), ["k"], "at").orderBy("at").collect()]
    assert ties(3) == ties(7)


def test_class_linkage_is_linkage_of_all_pairs(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((40, 4))[rng.integers(0, 40, 90)]
    x[5] = 0
    df, of = vectors(spark, x), members(spark, [[i for i in range(90) if i % 11 == k] for k in range(11)])
    for over in (0.5, 0.9):
        plain = {(r.cu, r.cv): round(r.sim, 9) for r in joins.linkage(joins.cosine_pairs(df, over), of).collect()}
        assert {(r.cu, r.cv): round(r.sim, 9) for r in joins.class_linkage(df, over, of).collect()} == plain


def plain_batches(n, sim, sign, size=3):
    """Batches of tasks 0 to n - 1 as the definition says, all tasks left looked at each time."""
    table = np.full((n, n), np.nan)
    for (a, b), s in sim.items():
        table[a, b] = s
    table, left, out = np.nan_to_num(table), np.arange(n), []
    while len(left):
        members, left = [int(left[0])], left[1:]
        while len(left) and len(members) < size:
            at = int((sign * table[np.ix_(left, members)].max(axis=1)).argmax())
            members.append(int(left[at]))
            left = np.delete(left, at)
        out.append(members)
    return out


def test_batches_of_many_tasks_equal_the_plain_greedy(spark):
    rng = np.random.default_rng(8)
    for n, edges in ((1, 0), (7, 0), (40, 900), (60, 100), (5000, 20000)):
        sim = {}
        for a, b in rng.integers(0, n, (edges, 2)).tolist():
            if a != b:
                sim[a, b] = sim[b, a] = round(float(rng.uniform(-0.3, 1)), 1)  # ties, zeros and negative ones
        rows = [(3 * a + 5, 3 * b + 5, s) for (a, b), s in sim.items()] + [(5, 5, 1.0), (5, 999999, 1.0)]
        sims = spark.createDataFrame(rows + [(8, 5, None)] * (n == 7), "a long, b long, sim double")
        tasks = spark.range(n).select((3 * F.col("id") + 5).alias("task"))
        for strategy, sign in (("similar", 1), ("dissimilar", -1)):
            got = {}
            for r in experiments.batches(tasks.union(tasks), sims, strategy).collect():
                got.setdefault(r.batch, {})[r.pos] = (r.task - 5) // 3
            assert [[m[p] for p in sorted(m)] for _, m in sorted(got.items())] == plain_batches(n, sim, sign)
        rows = experiments.batches(tasks, sims, "random", seed=2).collect()
        assert sorted(r.task for r in rows) == [3 * i + 5 for i in range(n)] and len({(r.batch, r.pos) for r in rows}) == n
    assert experiments.batches(tasks.limit(0), sims, "similar").count() == 0


def test_small_additions(spark):
    assert blocking.threshold_for("data/Cora/x.csv", {"song": 0.7, "cora": 0.9}) == 0.9
    assert blocking.threshold_for("other", {"song": 0.7}) is None
    known = metrics.aligned(members(spark, [[1, 2]]), members(spark, [[2, 3]]), missing="drop")
    assert [tuple(r) for r in known.collect()] == [(2, "0", "0")]
    pairs = spark.createDataFrame([(1, 5), (1, 4), (2, 9)], "a long, b long")
    settled = spark.createDataFrame([(1, 3), (3, 5), (3, 4), (2, 8), (8, 9)], "a long, b long")
    assert [tuple(r) for r in matching.transitive(pairs, settled).collect()] == [(1, 5)]  # 3 is next to 4, and 8 next to 9


def test_missing_parts_only():
    """The entry goes on without the training-data parts, but not without a library that they need."""
    import builtins
    import importlib

    import __spark_entry__

    real = builtins.__import__

    def without(missing):
        def load(name, *args, **kw):
            if name == missing[0] or (name == missing[0].rpartition(".")[0] and missing[0].rpartition(".")[2] in (args[2] or ())):
                raise ModuleNotFoundError(f"No module named {missing[1]!r}", name=missing[1])
            return real(name, *args, **kw)

        return load

    try:
        for name in ("kindred.llm", "corpus_pipeline"):
            builtins.__import__ = without((name, name))
            assert "pipeline" not in importlib.reload(__spark_entry__).queries()
        builtins.__import__ = without(("kindred.llm", "tiktoken"))
        with pytest.raises(ModuleNotFoundError):
            importlib.reload(__spark_entry__)
    finally:
        builtins.__import__ = real
        importlib.reload(__spark_entry__)

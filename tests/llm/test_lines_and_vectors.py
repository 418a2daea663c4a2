"""Line dedup, vector codes and hard negatives against brute force, with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import hard_negatives, line_dedup, vector_codes
from kindred.llm.common import HOT, durable, split_hot
from kindred.llm.oracles import SQL

FRAME = "\n".join(["  Menu ", "HOME", "(c) all rights"])
LINE_ROWS = (
    [(i, f"{FRAME}\nown line {i}\n\n" + ("only three" if i < 3 else "hot\thot")) for i in range(40)]
    + [(40 + i, f"menu\r\n\x0b home\x0c\nX{i}") for i in range(5)]
    + [(50, None), (51, ""), (52, "\n\n"), (53, "É\né"), (54, "HOT\thot\nhot\tHOT"), (55, "Z" * 300_000 + "\nmenu"), (None, "menu\nnull id"), (7, f"{FRAME}\nother text of id 7")]
)


def brute_lines(rows, at_least, min_chars=1):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(fold)
    held = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < at_least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("at_least", "min_chars", "batches", "fanout"), [(10, 1, 8, 2), (3, 6, 3, 4), (2, 1, 1, 4)])
def test_line_dedup(spark, at_least, min_chars, batches, fanout):
    rows = [*LINE_ROWS, LINE_ROWS[3], LINE_ROWS[3]]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lost string, r1 int")
    got = line_dedup.dedup(docs, at_least, min_chars, batches, fanout)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lines(rows, at_least, min_chars)
    assert line_dedup.dedup(docs.where("false")).count() == 0


def test_runs_are_levelled_and_know_what_they_hold(spark):
    runs = line_dedup.Runs(spark, at_least=1, fanout=2, buckets=4)
    seen = set()
    for batch in range(5):  # with at_least 1 a batch's known lines are all that an earlier one held
        lines = [(bytearray(f"{x:016d}".encode()),) for x in range(batch * 3, batch * 3 + 6)]
        df = durable(spark.createDataFrame(lines, "h binary"), "batch")
        fresh = {bytes(r.h) for r in runs.unsettled(df).collect()}
        assert fresh == {bytes(x[0]) for x in lines} - seen
        runs.add(df)
        seen |= {bytes(x[0]) for x in lines}
    assert [len(level) for level in runs.levels] == [1, 0, 1]  # five batches in base two
    assert {bytes(r.h) for r in runs.settled().collect()} == seen
    plan = runs.unsettled(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    runs.drop()


def test_split_hot(spark):
    rows = durable(spark.createDataFrame([(None if i % 3 == 0 else i % 500, i) for i in range(4 * HOT)], "k int, i int"), "rows")
    keys = durable(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("most")).where("k is null or k < 400"), "keys")
    most = collections.defaultdict(int)
    for k, i in rows.collect():
        most[k] = max(most[k], i)
    want = sorted((str(k), i, most[k] if k is None or k < 400 else None) for k, i in rows.collect())
    assert sorted((str(r.k), r.i, r.most) for r in split_hot(rows, keys, "k").collect()) == want
    assert sorted((str(r.k), r.i, r.most) for r in split_hot(rows, keys, "k", how="inner").collect()) == [w for w in want if w[2] is not None]


VECTOR_SCHEMA = "vec_id long, embedding array<float>, label int, code string, d int"


def vector_rows(n=400, d=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=d) / 3).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[5][1], i % 2) for i in range(30)]  # copies
    rows += [(900, None, 1), (901, [0.0] * d, 1), (902, [float("nan")] * d, 1), (903, [1.0, None] * (d // 2), 2), (904, [float("inf")] + [0.0] * (d - 1), 0), (905, rows[7][1], None)]
    return rows


def floors(v, scale):
    return [math.floor(scale * x) for x in v]


def plain(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_codes(rows):
    kept = sorted((r for r in rows if plain(r[1])), key=lambda r: (r[0] is None, r[0] or 0))
    ints = np.array([floors(v, 1024) for _, v, _ in kept])
    parts = np.split(ints, 4, axis=1)
    books = [p[:256].copy() for p in parts]
    for _ in range(5):
        square = [((p[:, None, :] - b[None]) ** 2).sum(axis=2) for p, b in zip(parts, books, strict=True)]
        of = [s.argmin(axis=1) for s in square]
        final = [b.copy() for b in books]
        for p, b, o in zip(parts, books, of, strict=True):
            for e in set(o.tolist()):
                b[e] = [int(x) // int((o == e).sum()) for x in p[o == e].sum(axis=0)]
    error = sum(s.min(axis=1) for s in square)
    sums = collections.Counter()
    for (_, _, label), e in zip(kept, error.tolist(), strict=True):
        sums[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in final for x in b.ravel().tolist()).encode()).hexdigest()
    return sorted((r[0], "".join(f"{o[i]:02x}" for o in of), int(error[i]), sums[r[2]], digest) for i, r in enumerate(kept))


def test_vector_codes(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], VECTOR_SCHEMA)
    coded, books = vector_codes.compress(df)
    got = vector_codes.with_label_error(coded)
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == brute_codes(rows)
    assert [b.shape for b in books[8]] == [(256, 2)] * 4
    assert vector_codes.with_label_error(vector_codes.compress(df.where("false"))[0]).count() == 0


def test_vector_codes_of_few_repeated_and_odd_vectors(spark):
    rows = [(1, [0.5, 0.25, 0.125, 1.0], 1), (1, [0.5, 0.25, 0.125, 1.0], 1), (None, [0.1, 0.2, 0.3, 0.4], None), (3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1), (4, [1e30, -1e30, 0.0, 0.0], 2), (5, [], 2)]
    coded, books = vector_codes.compress(spark.createDataFrame([(*r, "c", 0) for r in rows], VECTOR_SCHEMA))
    got = vector_codes.with_label_error(coded).collect()
    assert len(got) == 6 and set(books) == {0, 4, 6} and all(r.error == 0 for r in got)
    assert [b.shape[1] for b in books[6]] == [2, 2, 1, 1] and int(books[4][0].max()) == vector_codes.LARGEST
    assert {r.code for r in got if r.vec_id == 1} == {"00000000"}  # ties go to the lower of equal entries


@pytest.mark.parametrize("spread", [3, 1000, 10**8])
def test_va_file_finds_the_nearest_entry_and_skips_most(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread, (200, 12))
    entries[50:60] = entries[40]
    queries = np.concatenate([entries[::7], rng.integers(-spread, spread, (700, 12)), entries[40:60] + 1])
    index, distance, refined = vector_codes.VAFile(entries).nearest(queries)
    square = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == square.argmin(axis=1)).all() and (distance == square.min(axis=1)).all()
    assert refined < (0.9 if spread == 3 else 0.5) * square.size


def brute_negatives(rows, every=100):
    kept = {}
    for i, v, label in rows:
        if plain(v) and label is not None and i is not None:
            kept[i] = min(kept.get(i, (label, v)), (label, v))
    kept = {i: ((label + 1) % 10 if i % 7 == 0 else label, floors(v, 256)) for i, (label, v) in kept.items()}
    out = []
    for a in (i for i in kept if i % every == 0):
        score = {i: sum(x * y for x, y in zip(kept[a][1], v, strict=True)) for i, (_, v) in kept.items() if len(v) == len(kept[a][1])}
        order = sorted((i for i in score if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == kept[a][0]][:5]:
            fit = [i for i in order if kept[i][0] != kept[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(fit[:5])]
    return sorted(out)


@pytest.mark.parametrize("page", [16, 2048])
def test_hard_negatives(spark, monkeypatch, page):
    monkeypatch.setattr(hard_negatives, "PAGE", page)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    rows = [*vector_rows(seed=3), (100, [9.0] * 8, 9), (None, [0.1] * 8, 1), (2000, [-0.4] * 8, 0), (2100, [1.0, 2.0], 1), (2101, [1.0, 2.0], 1), (2102, [1.0, 1.9], 0)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in [*rows, rows[200]]], VECTOR_SCHEMA)
    got = hard_negatives.mine(df, every=20)
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()) == brute_negatives(rows, 20)
    assert hard_negatives.mine(df.where("false")).count() == 0


def test_hard_negatives_scan_few_annuli_where_vectors_cluster(spark, monkeypatch):
    """Of twelve groups of directions an anchor needs its own only; copies of a vector fill whole pages."""
    monkeypatch.setattr(hard_negatives, "PAGE", 16)
    rng = np.random.default_rng(1)
    centers = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = []
    for i in range(1200):
        x = centers[i % 12] + rng.normal(size=12) * 0.03
        rows.append((i, (x / np.linalg.norm(x)).tolist(), int(i % 5)))
    rows += [(1200 + i, rows[100][1], i % 5) for i in range(600)]
    df = spark.createDataFrame([(*r, "c", 0) for r in rows], VECTOR_SCHEMA)
    seen, visits = [], hard_negatives._visits
    monkeypatch.setattr(hard_negatives, "_visits", lambda *a: seen.append(visits(*a)) or seen[-1])
    got = hard_negatives.mine(df)
    assert sorted(map(tuple, got.collect())) == brute_negatives([(i, np.float32(v).tolist(), c) for i, v, c in rows])
    prepared = durable(hard_negatives.prepared(df), "t")
    pages, directory = hard_negatives.build(prepared)
    pieces = sum(len(x) for x in directory.intervals.values())
    first_search = sum(v.count() for v in seen[:3])
    assert first_search < 0.5 * pieces * prepared.where("vec_id % 100 = 0").count()


def test_hard_negatives_broadcast_no_visits(spark, monkeypatch):
    """A file of visits repeats each anchor's vector, so its size says little of its rows: they are shuffled, and come from several tasks."""
    monkeypatch.setattr(hard_negatives, "PAGE", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    seen = {}
    for name in ("_visits", "_scanned"):
        monkeypatch.setattr(hard_negatives, name, lambda *a, of=getattr(hard_negatives, name), to=seen.setdefault(name, []): to.append((a, of(*a))) or to[-1][1])
    df = spark.createDataFrame([(*r, "c", 0) for r in vector_rows(seed=5)], VECTOR_SCHEMA)
    assert hard_negatives.mine(df, every=20).count() > 0
    for _, found in seen["_scanned"]:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    for (asked, *_), _ in seen["_visits"]:
        assert asked.rdd.getNumPartitions() == -(-asked.count() // 4) > 1


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_codes", "op13_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    from kindred.llm import catalog

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = con.execute(SQL[name]).fetchdf(), catalog.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)

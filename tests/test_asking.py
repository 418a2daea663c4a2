"""Prompts, replies and their store; and a run from a record file to clusters."""

import collections
import csv
import os
import threading
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import vectors as V
from kindred.operators import asking, clusterers
from kindred.operators.asking import Reply, Store
from kindred.plans import files
from kindred.sources import records as S


@pytest.fixture
def store(tmp_path):
    return Store(str(tmp_path / "replies"), 4)


def rows(n, buckets=4):
    return sorted((i % buckets, f"k{i}", f"prompt {i}") for i in range(n))


def test_growing_waits(monkeypatch):
    slept, calls = [], []
    monkeypatch.setattr(asking.time, "sleep", slept.append)

    def call(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise ConnectionError
        return Reply("yes", 3, 1)

    assert asking.patient(call, "p") == (Reply("yes", 3, 1), 3)
    assert slept == [0.5, 1.0]

    def never(prompt):
        raise TimeoutError

    with pytest.raises(TimeoutError):
        asking.patient(never, "p", (0.1, 0.2))
    assert slept[2:] == [0.1, 0.2]


def test_a_task_that_starts_again_asks_only_what_is_open(store):
    calls, lock = collections.Counter(), threading.Lock()
    broken = {"on": True}

    def call(prompt):
        with lock:
            calls[prompt] += 1
        if broken["on"] and prompt in ("prompt 13", "prompt 22"):
            raise ConnectionError
        return Reply(prompt.upper(), 2, 2)

    with pytest.raises(ConnectionError):
        asking.answer(rows(40), call, store, "m", 4, 3, ())
    answered = {k for b in range(4) for k in store.keys(b)}
    assert 0 < len(answered) < 40
    broken["on"] = False
    assert asking.answer(rows(40), call, store, "m", 4, 3, ()) == 40 - len(answered)
    assert all(n == 1 for p, n in calls.items() if p not in ("prompt 13", "prompt 22")) and len(calls) == 40
    assert asking.answer(rows(40), call, store, "m", 4, 3, ()) == 0


def test_calls_are_bounded(store):
    now, most, lock = [0], [0], threading.Lock()

    def call(prompt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        threading.Event().wait(0.01)
        with lock:
            now[0] -= 1
        return Reply("x")

    asking.answer(rows(30, 1), call, store, "m", 3, 30, ())
    assert most[0] == 3


def test_no_prompt_is_asked_twice_over_two_runs(spark, store, tmp_path):
    calls = str(tmp_path / "calls")
    os.mkdir(calls)

    def log(prompt):
        with open(os.path.join(calls, uuid.uuid4().hex), "w") as f:
            f.write(prompt)

    def call(prompt):
        log(prompt)
        if prompt.endswith("7") and len(os.listdir(calls)) < 30:
            raise ConnectionError("busy")
        return Reply(f"re: {prompt}", len(prompt), 1)

    df = spark.createDataFrame([(f"p{i % 40}",) for i in range(100)] + [(None,)], "prompt string")
    with pytest.raises(Exception, match="busy"):
        asking.replies(df, call, store, "gpt-4o", waits=(), flush=2).collect()
    for _ in range(30):
        log("filler")
    before = collections.Counter(open(os.path.join(calls, f)).read() for f in os.listdir(calls))
    answered = {r.reply[4:] for r in store.read(spark).collect()}
    got = asking.replies(df, call, store, "gpt-4o", waits=()).collect()
    assert {r.reply for r in got} == {f"re: p{i}" for i in range(40)} and len(got) == 40
    after = collections.Counter(open(os.path.join(calls, f)).read() for f in os.listdir(calls))
    assert all(after[p] == before[p] for p in answered)
    use = asking.cost(store, spark).first()
    assert (use.calls, use.in_tokens, use.out_tokens) == (40, sum(len(f"p{i}") for i in range(40)), 40)
    assert round(use.cost, 9) == round((5.0 * use.in_tokens + 15.0 * 40) / 1e6, 9)
    assert asking.replies(df.where("false"), call, store, "gpt-4o").count() == 0


def test_prompted_clusterer_under_the_guardrail(spark, store):
    """A model that answers nonsense for a set leaves its records alone, and one that groups badly is asked in a new order."""
    records = spark.createDataFrame([(i, f"thing {i // 3}") for i in range(9)], "rid long, name string")
    vectors = spark.createDataFrame([(i, [float(i // 3 == k) + 0.01 * (i % 3) for k in range(3)]) for i in range(9)], "rid long, embedding array<double>")
    sets = spark.createDataFrame([("a", i, i) for i in range(6)] + [("b", i, 6 + i) for i in range(3)], "set_id string, pos long, rid long")

    def call(prompt):
        lines = [x for x in prompt.split("\n") if x.startswith("Record ")]
        ids = [x[7:].split(":")[0] for x in lines]
        if "6" in ids:
            return Reply("I can't tell.")
        if ids == list("012345"):
            return Reply("[[0, 3], [1, 4, 77], [2, 5, 0]]")
        groups = collections.defaultdict(list)
        for i in ids:
            groups[int(i) // 3].append(i)
        return Reply(str([list(map(int, g)) for g in groups.values()]))

    model = asking.Prompted(records, ["name"], call, store, "gpt-4o-mini")
    out, calls = clusterers.clustered(sets, vectors, model)
    groups = collections.defaultdict(set)
    for r in out.collect():
        groups[r.set_id, r.cluster].add(r.rid)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3, 4, 5], [6], [7], [8]]
    assert {r.set_id: r.calls for r in calls.collect()}["a"] == 2


def test_embedding_by_a_model(spark):
    texts = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(10)], "rid int, text string")
    got = V.embedded(texts, lambda: lambda batch: np.array([[len(t), 1.0] for t in batch]), batch=3).collect()
    assert {r.rid: r.embedding for r in got} == {i: [0.0 if i == 3 else float(i), 1.0] for i in range(10)}


@pytest.mark.parametrize("how", ["threshold", "model"])
def test_from_a_record_file_to_clusters_and_report(spark, tmp_path, store, how):
    names = ["red steel bolt large", "blue copper pipe", "green glass jar with lid"]
    path, truth, out = str(tmp_path / "records.csv"), str(tmp_path / "gt.csv"), str(tmp_path / "out")
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["id", "name", "note"])
        w.writerows([i, names[i % 3], "same note" if i % 2 else "same  note"] for i in range(12))
    with open(truth, "w") as f:
        f.write("id1,id2\n" + "".join(f"{i},{i + 3}\n" for i in range(9)))

    def call(prompt):
        lines = [x[7:].split(": ") for x in prompt.split("\n") if x.startswith("Record ")]
        return Reply(str([[int(i) for i, text in lines if n in text] for n in names]), 10, 10)

    judge = (lambda records, vectors: asking.Prompted(records, ["name", "note"], call, store, "gpt-4o-mini")) if how == "model" else None
    run = files.run(spark, path, out, clusterer=judge, truth=truth, over=0.7)
    lines = sorted(r.value for r in spark.read.text(f"{out}/clusters").collect())
    assert lines == sorted(" ".join(str(i) for i in range(k, 12, 3)) for k in range(3))
    assert run.report.first().accuracy == 1.0 if "accuracy" in run.report.columns else run.report.count() == 1
    assert S.read_cluster_rows(spark, f"{out}/clusters").count() > 0
    if how == "model":
        assert asking.usage(store, spark).first().calls >= 3
    described, vectors, over, blocks = files.prepare(run.records.drop("combined_text"))
    assert 0 < over <= 0.99 and blocks.count() == 12 and vectors.agg(F.max(F.size("embedding"))).first()[0] == 64

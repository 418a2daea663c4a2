"""Data sources, SQL table functions, and a resolution that must merge."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import clusterers, merge, recordsets
from kindred.plans import tables
from kindred.plans.resolve import resolve
from kindred.sources import formats


def test_clusters_round_trip(spark, tmp_path):
    members = spark.createDataFrame([(i, i % 7) for i in range(40)] + [(100, 100)], "rid long, cluster long").repartition(3)
    path = str(tmp_path / "clusters")
    for _ in range(2):  # the second time in place of the first
        formats.save_clusters(members, path)
    files = os.listdir(path)
    assert files and all(f.startswith("part-") for f in files)
    rows = spark.read.format("clusters").load(path)
    assert rows.rdd.getNumPartitions() == len(files)
    got = sorted(sorted(r.ids) for r in rows.groupBy("file", "line").agg(F.collect_list("rid").alias("ids")).collect())
    assert got == sorted([*([i for i in range(40) if i % 7 == k] for k in range(7)), [100]])
    lines = sorted(x.value for x in spark.read.text(path).collect())
    assert "100" in lines and "0 7 14 21 28 35" in lines
    with pytest.raises(Exception, match="holds files already"):
        members.groupBy("cluster").agg(F.collect_list("rid").alias("ids")).write.format("clusters").mode("append").save(path)
    assert sorted(os.listdir(path)) == sorted(files)  # nothing is left of it


def test_a_failed_task_leaves_no_files(spark, tmp_path):
    formats.register(spark)
    path = str(tmp_path / "clusters")
    bad = spark.range(20).select(F.when(F.col("id") == 13, F.array(F.raise_error(F.lit("no")).cast("long"))).otherwise(F.array("id")).alias("ids"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("clusters").mode("overwrite").save(path)
    assert not [f for f in (os.listdir(path) if os.path.isdir(path) else []) if not f.startswith("_")]


def test_records_of_mixed_encodings(spark, tmp_path):
    formats.register(spark)
    for name, encoding, text in (("a.csv", "utf-8", 'id,name\n1,"Zoë,\nsecond line"\n2,\n'), ("b.csv", "mac_roman", "name,id,extra\nMünchen,3,x\n"), ("c.csv", "utf-8-sig", "id,name\n4,Ünal\n"), ("_hidden.csv", "utf-8", "id,name\n9,no\n")):
        (tmp_path / name).write_bytes(text.encode(encoding))
    got = {r.id: (r.name, r._file, r._encoding) for r in spark.read.format("records").load(str(tmp_path)).collect()}
    assert got == {"1": ("Zoë,\nsecond line", "a.csv", "UTF-8"), "2": (None, "a.csv", "UTF-8"), "3": ("München", "b.csv", "mac_roman"), "4": ("Ünal", "c.csv", "UTF-8")}


def blocks_of(spark, n=90, blocks=3, entities=5, d=12, seed=0):
    """Blocks of many records: each has some entities, whose vectors lie close together."""
    rng = np.random.default_rng(seed)
    centers = np.linalg.qr(rng.normal(size=(d, d)))[0]
    rows = [(i, (centers[i % entities] + rng.normal(size=d) * 0.05).tolist(), i % blocks, i % entities) for i in range(n)]
    df = spark.createDataFrame(rows, "rid long, embedding array<double>, cluster long, entity long")
    return df.select("rid", "embedding"), df.select("rid", "cluster"), df.select("rid", F.col("entity").alias("cluster")), rows


def test_table_functions_equal_the_dataframe_way(spark):
    vectors, blocks, _, rows = blocks_of(spark)
    tables.register(spark)
    recordsets.dealt(vectors, blocks).createOrReplaceTempView("dealt")
    want = sorted(map(tuple, recordsets.record_sets(vectors, blocks).collect()))
    assert sorted(map(tuple, spark.sql("SELECT block, set_no, pos, rid FROM record_sets(TABLE(dealt))").collect())) == want
    small = spark.sql("SELECT * FROM record_sets(TABLE(dealt), 4)").groupBy("block", "set_no").count().collect()
    assert max(r["count"] for r in small) == 4
    reps = spark.createDataFrame([(r[2], r[0] // 9, r[0] % 9, r[0], r[1]) for r in rows], "block long, set_no long, cluster_no long, rid long, embedding array<double>")
    reps.createOrReplaceTempView("representatives")
    plain = merge.packed_sets(reps.where("set_no < 9"), 9).withColumn("n", F.element_at(F.split("set_id", "-"), -1).cast("long"))
    got = spark.sql("SELECT block, set_no, pos, rid FROM pack_sets(TABLE(SELECT * FROM representatives WHERE set_no < 9))")
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(got.collect()) == key(plain.select(F.split("set_id", "-")[0].cast("long"), "n", "pos", "rid").collect())
    with pytest.raises(Exception, match="lacks"):
        spark.sql("SELECT * FROM record_sets(TABLE(representatives))").collect()


def test_a_resolution_merges_all_sets_of_an_entity(spark):
    vectors, blocks, truth, rows = blocks_of(spark)
    sets = recordsets.record_sets(vectors, blocks).groupBy("block").agg(F.countDistinct("set_no").alias("n")).collect()
    assert min(r.n for r in sets) >= 3  # no block is a single set, so what isn't merged would stay apart
    members = resolve(vectors, blocks, clusterers.Oracle(truth)).members.collect()
    found = {}
    for r in members:
        found.setdefault((r.block, r.cluster), set()).add(r.rid)
    want = {}
    for rid, _, block, entity in rows:
        want.setdefault((block, entity), set()).add(rid)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_the_table_function_keeps_numbers_not_objects():
    """A record of 64 numbers takes about their bytes; before, each number was an object (2,000 bytes a record and more)."""
    import tracemalloc

    from kindred.plans.tables import RecordSets

    table, rows = RecordSets.func(), [{"block": 1, "rid": i, "draw": i} for i in range(2000)]
    tracemalloc.start()
    for i, row in enumerate(rows):
        table.eval(row | {"embedding": [i + k / 64 for k in range(64)]})
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 2000 * 64 * 8 * 1.5

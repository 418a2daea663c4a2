import pytest

from kindred.operators import lsh
from kindred.sources import records as S
from kindred.streaming import arrivals


def clusters(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster, set()).add(r.rid)
    return {k: v for k, v in out.items()}


def test_truth_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id1,id2\n1,2\n2,3\n7,7\nx,4\n")
    (tmp_path / "b.csv").write_text("987,990\n990,5\n")
    (tmp_path / "c.txt").write_bytes(b"3 1 2\r\n7\r\n\r\n")
    assert clusters(S.read_truth(spark, str(tmp_path / "a.csv"))) == {1: {1, 2, 3}, 7: {7}}
    assert clusters(S.read_truth(spark, str(tmp_path / "b.csv"))) == {5: {5, 987, 990}}
    assert clusters(S.read_truth(spark, str(tmp_path / "c.txt"))) == {1: {1, 2, 3}, 7: {7}}


def test_records(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("id,name\n2,café\n0,b\n1,c\n".encode("mac_roman"))
    rows = {r.rid: r.name for r in S.read_records(spark, str(tmp_path / "r.csv")).collect()}
    assert rows == {0: "b", 1: "c", 2: "café"}
    (tmp_path / "g.csv").write_text("ID,name\n9,x\n5,y\n")
    assert {r.rid: r.name for r in S.read_records(spark, str(tmp_path / "g.csv")).collect()} == {0: "y", 1: "x"}


def test_small_readers_and_sink(spark, tmp_path):
    (tmp_path / "m.txt").write_text(" 1 2\n\n3\n")
    assert [r.row for r in S.read_matrix(spark, str(tmp_path / "m.txt")).collect()] == [[1, 2], [3]]
    (tmp_path / "k.csv").write_text("a,,b\n,,\nc\n")
    assert [r.row for r in S.read_cluster_rows(spark, str(tmp_path / "k.csv")).collect()] == [["a", "b"], ["c"]]
    (tmp_path / "p.csv").write_text('id_left,record_left,record_right,label\n1,"a, b",c,1\n1,"a, b",d,0\n')
    row = S.read_pair_instances(spark, str(tmp_path / "p.csv")).first()
    assert (row.anchor, row.candidates, row.labels) == ("a, b", ["c", "d"], [True, False])
    S.write_clusters(spark.createDataFrame([(3, 1), (1, 1), (2, 2)], "rid long, cluster long"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1 3", "2"]


def test_stream_of_arrivals(spark, tmp_path):
    known = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "rid long, embedding array<double>")
    new = spark.createDataFrame([(10, [1.0, 0.01]), (11, [-1.0, 0.0]), (12, [0.0, 0.0]), (1, [1.0, 0.0])], "rid long, embedding array<double>")
    new.write.parquet(str(tmp_path / "in"))
    stored = spark.table(arrivals.store_buckets(known, 0.9, bits=3))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    q = arrivals.match_arrivals(stream, stored, 0.9, bits=3).writeStream.format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.u, r.v) for r in spark.table("arrived").collect()} == {(10, 1)}
    assert arrivals.match_arrivals(new, stored, 0.9, bits=3).count() == 1
    assert stored.count() == 3 * lsh.TABLES and arrivals.match_arrivals(new.limit(0), stored, 0.9, bits=3).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:  # the known side is read as it lies
        plan = arrivals.match_arrivals(new, stored, 0.9, bits=3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1


def test_shared_dir_must_be_set_on_a_cluster():
    from kindred.operators.storage import shared_dir

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())

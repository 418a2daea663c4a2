from pyspark.sql import functions as F

from kindred.functions import replies as R
from kindred.functions import text as T
from kindred.functions import vectors as V


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text(spark):
    row = one(
        spark,
        a=T.normalized(F.lit("Deep-Learning, for ER.")),
        b=T.token_jaccard(F.lit("Deep-Learning, for ER."), F.lit("deep learning")),
        c=T.char_match_ratio(F.lit("3.14"), F.lit("3.15")),
        d=T.token_jaccard(F.lit("..."), F.lit("x")),
        e=T.token_jaccard(F.lit("3.14"), F.lit("3.15")),
        f=T.token_jaccard(F.lit("a.14"), F.lit("a.15"), numeric_guard=True),
    )
    assert (row.a, row.b, row.c, row.d, row.e) == ("deep learning for er", 0.5, 0.75, -1.0, 0.75)
    assert row.f == 1 / 3  # tokens a, 14 and a, 15


def test_attributes(spark):
    assert T.id_column(["x", "Id"]) == "Id" and T.id_column(["id", "ID"]) == "ID" and T.id_column(["x"]) is None
    df = spark.createDataFrame([(1, "a", None, 2)], "id int, n string, m string, rid int")
    assert T.attributes(df) == ["n", "m"]
    row = df.select(T.combined_text("n", "m").alias("t"), T.prompt_line("rid", "n", "m").alias("p")).first()
    assert (row.t, row.p) == ("a nan", "Record 2: a,nan")
    pair = T.attribute_similarity(
        [T.prepared_attribute(F.lit(x)) for x in ("a b", "nan", "q")], [T.prepared_attribute(F.lit(x)) for x in ("a", "z", "q")]
    )
    assert one(spark, s=pair).s == 0.75


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    row = one(spark, c=V.cosine(a, b), d=V.euclidean(a, b), z=V.cosine(a, F.array(F.lit(0.0), F.lit(0.0))))
    assert abs(row.c - 0.96) < 1e-12 and abs(row.d - 2**0.5) < 1e-12 and row.z is None
    for counts, want in (([2, 2, 2], 0), ([3, 1], 0.5), ([2, 0], 0)):
        assert abs(one(spark, v=V.variation(F.array(*map(F.lit, counts)))).v - want) < 1e-12
    assert one(spark, v=V.variation(F.array().cast("array<int>"))).v == 0


def test_replies(spark):
    for reply, want in (
        ("[[1, 2],\n[3]]", [[1, 2], [3]]),
        ("Group A: [1,2] and [3]", [[1, 2], [3]]),
        ("[[1,,2,]", [[1, 2]]),
        ("[]", []),
        ("[[1;2]]", [[12]]),
    ):
        assert one(spark, c=R.parsed_clusters(F.lit(reply))).c == want
    ids = F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])
    groups = R.parsed_clusters(F.lit("[[1,2,1],[2,9],[12]]"))
    assert one(spark, c=R.completed(R.known_ids(groups, ids), ids)).c == [[1, 2], [3]]
    assert one(spark, c=R.selected(F.lit("it is [2]."), F.lit(3))).c == [False, True, False]
    assert one(spark, c=R.selected(F.lit("[0] or [4]"), F.lit(3))).c == [False] * 3
    assert one(spark, c=R.parsed_batch(F.lit('so: {"T1": [[1, 2]], "T2": [[3]]} ok'))).c == {"T1": [[1, 2]], "T2": [[3]]}
    assert [one(spark, c=R.yes_no(F.lit(x))).c for x in ("Yes.", "no", "?")] == [1, -1, 0]
    assert one(spark, c=R.yes_no(F.lit("no"), F.lit(0.0))).c == -1.0


def test_hashed_embedding_hashes_a_token_once(spark):
    """The loop over dimensions holds no digest, and vectors are those of the definition."""
    import hashlib

    df = spark.createDataFrame([(["red", "ring", "bolt", "ring"],), ([],)], "t array<string>")
    found = df.select(V.hashed_embedding(F.col("t"), 8).alias("e"))
    loop = found._jdf.queryExecution().analyzed().toString().split("array_repeat")[-1].split("\n")[0]
    assert "CASE WHEN" in loop and "md5" not in loop
    want = [0.0] * 8
    for t in ["red", "ring", "bolt", "ring"]:
        digest = hashlib.md5(t.encode()).hexdigest()
        want[int(digest[:8], 16) % 8] += 1 if int(digest[8], 16) % 2 == 0 else -1
    assert [r.e for r in found.collect()] == [want, [0.0] * 8]

"""Record tables and ground truth from text files, and partitions to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators import graph
from kindred.operators.ordering import ranked

#: Encodings of record files: UTF-8 if every line is valid, else MacRoman, in which every byte has a meaning.
UTF_8, MAC_ROMAN = "UTF-8", "mac_roman"
#: Spark reads no MacRoman: such files are read byte for byte as Latin-1, and their upper half is put right afterwards.
_LATIN = bytes(range(128, 256)).decode("latin-1")
_MAC = bytes(range(128, 256)).decode("mac_roman")


def encoding_of(spark: SparkSession, path: str) -> str:
    """The encoding of a text file, found from its lines."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return UTF_8 if broken.isEmpty() else MAC_ROMAN


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, **options) -> DataFrame:
    """A CSV in the given encoding (of Spark's, or mac_roman), by default the one that is found out."""
    encoding = encoding or encoding_of(spark, path)
    rows = spark.read.csv(path, encoding="ISO-8859-1" if encoding == MAC_ROMAN else encoding, **options)
    if encoding != MAC_ROMAN:
        return rows
    right = str.maketrans(_LATIN, _MAC)
    return rows.select(*[(F.translate(rows[c], _LATIN, _MAC) if k == "string" else rows[c]).alias(c.translate(right)) for c, k in rows.dtypes])


def read_records(spark: SparkSession, path: str, encoding: str | None = None, header: bool = True, infer: bool = True) -> DataFrame:
    """Record table of a CSV with a header. Adds rid, the natural id if it is contiguous from 0, else the row's rank
    by it (by all columns without an id)."""
    return with_rid(read_csv(spark, path, encoding, header=header, inferSchema=infer, multiLine=True, escape='"'))


def with_rid(rows: DataFrame) -> DataFrame:
    """rows with rid: 0-based position in order of the natural id."""
    key = T.id_column(rows.columns)
    if key is not None:
        at = F.try_to_number(F.col(key).cast("string"), F.lit("9" * 18)).cast("long")
        n, distinct, least, greatest, known = rows.agg(F.count("*"), F.countDistinct(at), F.min(at), F.max(at), F.count(at)).first()
        if n == distinct == known and least == 0 and greatest == n - 1:
            return rows.withColumn("rid", at)
    order = [F.col(key)] if key is not None else [F.col(c) for c in rows.columns]
    return ranked(rows, order)


def is_int_pair(a, b):
    """Whether both fields are whole numbers."""
    return F.coalesce(F.trim(a).rlike(r"^[+-]?\d+$") & F.trim(b).rlike(r"^[+-]?\d+$"), F.lit(False))


def read_truth_pairs(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(rid, cluster) by closure of a CSV's first two columns; rows that aren't two whole numbers, such as a header,
    are left out, and a pair (i, i) is a cluster of one."""
    rows = read_csv(spark, path, encoding, header=False, inferSchema=False)
    a, b = F.col(rows.columns[0]), F.col(rows.columns[1])
    pairs = rows.where(is_int_pair(a, b)).select(F.trim(a).cast("long").alias("a"), F.trim(b).cast("long").alias("b"))
    return graph.closure(pairs)


def read_truth_lines(spark: SparkSession, path: str) -> DataFrame:
    """(rid, cluster) of a text file with one blank-separated cluster per line; cluster is its least id."""
    ids = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x.rlike(r"^[+-]?\d+$"))
    rows = spark.read.text(path).select(F.transform(ids, lambda x: x.cast("long")).alias("ids")).where(F.size("ids") > 0)
    return rows.select(F.explode("ids").alias("rid"), F.array_min("ids").alias("cluster"))


def read_truth_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(rid, cluster) by closure of a spreadsheet's first two columns. Needs pandas' Excel reader on the driver."""
    import pandas as pd

    sheet = pd.read_excel(path, header=None).iloc[:, :2].astype(str)
    rows = spark.createDataFrame(sheet.values.tolist(), "x string, y string")
    pairs = rows.where(is_int_pair(F.col("x"), F.col("y"))).select(F.trim("x").cast("long").alias("a"), F.trim("y").cast("long").alias("b"))
    return graph.closure(pairs)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth by the file's ending: .txt cluster lines, .xlsx or .csv pairs."""
    if path.endswith(".txt"):
        return read_truth_lines(spark, path)
    return read_truth_sheet(spark, path) if path.endswith(".xlsx") else read_truth_pairs(spark, path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row array<long>) of whole numbers separated by white space, one array per line with any."""
    numbers = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return spark.read.text(path).select(F.transform(numbers, lambda x: x.cast("long")).alias("row")).where(F.size("row") > 0)


def read_cluster_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row array<string>) of a ragged CSV, empty cells left out."""
    cells = F.transform(F.split("value", ","), lambda x: F.trim(x))
    return spark.read.text(path).select(F.filter(cells, lambda x: x != "").alias("row")).where(F.size("row") > 0)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(row array<string>) of a CSV without header."""
    rows = spark.read.csv(path, header=False, inferSchema=False)
    return rows.select(F.array(*rows.columns).alias("row"))


def read_pair_instances(spark: SparkSession, path: str) -> DataFrame:
    """(id_left, anchor, candidates array<string>, labels array<boolean>) of a CSV of labelled record pairs."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    each = F.array_sort(F.collect_list(F.struct("record_right", (F.lower("label").isin("1", "true")).alias("label"))))
    grouped = rows.groupBy("id_left", F.col("record_left").alias("anchor")).agg(each.alias("c"))
    return grouped.select("id_left", "anchor", F.col("c.record_right").alias("candidates"), F.col("c.label").alias("labels"))


def write_clusters(members: DataFrame, path: str) -> None:
    """One line per cluster of members(rid, cluster): its ids in order, blank-joined."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list("rid")), lambda x: x.cast("string")), " ")
    members.groupBy("cluster").agg(line.alias("value")).select("value").write.mode("overwrite").text(path)


def write_report(row: DataFrame, path: str) -> None:
    """A metrics row as CSV with a header."""
    row.coalesce(1).write.mode("overwrite").csv(path, header=True)


def as_vectors(table: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(rid, embedding) of a table with a vector column."""
    return table.select(F.col(key).alias("rid"), F.col(embedding).alias("embedding"))

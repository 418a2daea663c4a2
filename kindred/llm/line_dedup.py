"""Line dedup by levelled sorted runs of line hashes.

A line is known by the 128-bit hash of its key. A run is a table of hashes and the number of documents that hold each,
bucketed by the hash and sorted within buckets; level 0 takes one run for every batch of documents, and as soon as a
level has FANOUT runs they are compacted into one run of the next level, counts added up. A hash whose count in a run
reaches `at_least` is settled. A new batch is merge-anti-joined with the settled hashes of every run, bucket by
bucket and without moving the runs, and adds a run of what is left: a settled line needs no more counting.

In the end the runs' counts are added up, and lines that reach `at_least` documents go from every document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import durable, shared_dir, split_hot

AT_LEAST, MIN_CHARS = 10, 1
#: Batches that one call cuts its documents into, and runs of a level that are compacted into one of the next.
BATCHES, FANOUT = 8, 4
#: Fixed: what is stripped from both ends of a line.
_SPACE = b" \t\n\x0b\x0c\r"


def keyed(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """For each line of a text the hash of its key: stripped, A-Z lower-cased; None for keys under min_chars code points."""
    lines = (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")  # bytes: only A-Z fold
    keys = [x.strip(_SPACE) for x in lines]
    if min_chars > 1:
        keys = [k if len(k.decode("utf-8", "surrogatepass")) >= min_chars else b"" for k in keys]
    return [xxhash.xxh3_128_digest(k) if k or min_chars < 1 else None for k in keys]


def _row_id() -> list[Column]:
    """128 bits of a row's id and text: rows that are alike in both keep and lose the same lines."""
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("r2")]


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(r1, r2, h): the distinct line hashes of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({h for h in keyed(t.as_py(), min_chars) if h is not None}) for t in b.column(2)]
            of = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            hashes = pa.array([h for x in found for h in x], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), hashes], ["r1", "r2", "h"])

    return docs.select(*_row_id(), "text").mapInArrow(run, "r1 long, r2 long, h binary")


class Runs:
    """Levelled sorted runs of (h, n): hashes and numbers of documents.

    The tables lie in the shared folder; this object holds only their names, a few for each level."""

    def __init__(self, spark: SparkSession, at_least: int = AT_LEAST, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.at_least, self.fanout = spark, at_least, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, counts: DataFrame) -> str:
        """counts as a run: a file for each bucket, sorted by hash."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark).rstrip('/')}/{self.spark.sparkContext.applicationId}/{name}"
        out = counts.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h")
        out.option("path", path).option("compression", "zstd").saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """(h, n) of several runs, counts added up: runs merge bucket by bucket. (A union of them must not be grouped:
        Spark 4.1 takes it for bucketed as its inputs are, and then splits hashes.)"""
        runs = [self.spark.table(name) for name in names] or [self.spark.createDataFrame([], "h binary, n long")]
        out = runs[0]
        for r in runs[1:]:
            both = out.hint("merge").join(r.withColumnRenamed("n", "more"), "h", "full")
            out = both.select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        return out

    def unsettled(self, lines: DataFrame) -> DataFrame:
        """The rows of lines(h, ...) whose hash no run has settled: one merge anti-join with each run."""
        for name in self.names():
            lines = lines.hint("merge").join(self.spark.table(name).where(F.col("n") >= self.at_least), "h", "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Add a batch of lines(h), a row for each document and distinct hash."""
        self.levels[0].append(self._write(self.unsettled(lines.groupBy("h").agg(F.count("*").alias("n")))))
        for level, runs in enumerate(self.levels):
            if len(runs) < self.fanout:
                break
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(runs)))
            self.drop(runs)
            runs.clear()

    def settled(self) -> DataFrame:
        """(h, n) of the hashes that at least at_least documents hold; n counts no further than it had to."""
        return self._merged(self.names()).where(F.col("n") >= self.at_least)

    def drop(self, names: list[str] | None = None) -> None:
        """Forget the given runs, or all; their files stay with the application's other tables."""
        for name in self.names() if names is None else names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_lines(docs: DataFrame, lines: DataFrame, known: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: docs(doc_id, text) without the lines whose hash is in known(h, n), for
    lines = line_hashes(docs); n is the number of rows that hold a hash, or a lower bound of it.

    Hashes are matched apart from the texts; a text moves once, to the hashes that its row loses."""
    hits = split_hot(lines, known, "h", how="inner").select("r1", "r2", "h")
    lost = durable(hits.groupBy("r1", "r2").agg(F.collect_list("h").alias("lost")), "lost-lines")
    joined = docs.select("doc_id", "text", *_row_id()).join(lost, ["r1", "r2"], "left").select("doc_id", "text", "lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes, dropped = [], [], []
            for t, lost in zip(b.column(1), b.column(2), strict=True):
                lines = (t.as_py() or "").split("\n")
                kept = lines
                if lost.is_valid:
                    gone = set(lost.as_py())
                    kept = [x for x, h in zip(lines, keyed(t.as_py(), min_chars), strict=True) if h not in gone]
                texts.append("\n".join(kept))
                sizes.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = [b.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_lines", "n_dropped"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, text string, n_lines long, n_dropped long")


def dedup(docs: DataFrame, at_least: int = AT_LEAST, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, text, n_lines, n_dropped for every row of docs(doc_id, text): lines whose key stands in at least at_least
    rows are gone, the others are joined by line feeds as they were.

    A null text counts as empty and has one empty line, which has no key of min_chars (1 or more) code points and
    stays; a text that loses all its lines becomes empty. Every row is a document, so a row that is repeated counts
    and is returned as often as it stands there; null ids stay. Texts of any length are read whole. An empty table
    gives no rows. Other columns are left out, whatever their names.
    """
    lines = line_hashes(docs, min_chars).withColumn("batch", F.pmod("r1", F.lit(batches)).cast("int"))
    lines = durable(lines, "line-hashes", by="batch")
    runs = Runs(docs.sparkSession, at_least, fanout)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    known = durable(runs.settled(), "settled-lines")
    runs.drop()
    return drop_lines(docs, lines, known, min_chars)


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's lines that at least ten documents hold are dropped."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (
  SELECT rid, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), often AS (SELECT key FROM (SELECT DISTINCT rid, key FROM k WHERE length(key) >= {MIN_CHARS}) GROUP BY key HAVING count(*) >= {AT_LEAST}),
marked AS (SELECT k.*, often.key IS NOT NULL AS gone FROM k LEFT JOIN often ON k.key = often.key),
kept AS (SELECT rid, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text FROM marked GROUP BY rid)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, n_dropped, sha256(coalesce(text, '')) AS kept_sha256 FROM d JOIN kept ON d.rid = kept.rid
"""

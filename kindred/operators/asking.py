"""Prompts put to a language model from Spark tasks: a bounded pool of calls, growing waits, and a table of replies.

A reply is a row of the store, a Parquet folder with a sub-folder for each bucket of prompt hashes. A task has the prompts of
whole buckets. Before it calls it reads the keys that its buckets already hold, and it appends what has been answered
after every few calls, so a task that is run again, or a later run over the same store, asks only what is still open. (Two
attempts that run at the same time may both ask; speculation should be off.) Usage is part of the reply's row and counts
once for each prompt, however often a task had to start.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import replies as R
from kindred.functions import text as T
from kindred.operators.storage import durable, shared_dir

#: Calls that one task makes at a time, replies that it holds before it appends them, and buckets of a store.
WORKERS, FLUSH, BUCKETS = 8, 64, 256
#: Seconds before each further attempt at a call that failed.
WAITS = (0.5, 1.0, 2.0)
_SCHEMA = pa.schema([("key", pa.string()), ("model", pa.string()), ("reply", pa.string()), ("in_tokens", pa.int64()), ("out_tokens", pa.int64()), ("attempts", pa.int64())])


@dataclass(frozen=True)
class Reply:
    """What a model returns for a prompt."""

    text: str
    in_tokens: int = 0
    out_tokens: int = 0


def patient(call: Callable[[str], Reply], prompt: str, waits: tuple[float, ...] = WAITS) -> tuple[Reply, int]:
    """(reply, attempts) of call(prompt), tried again after each of the waits; the last failure is raised."""
    for attempt, wait in enumerate((*waits, None), 1):
        try:
            return call(prompt), attempt
        except Exception:
            if wait is None:
                raise
            time.sleep(wait)
    raise AssertionError


@dataclass(frozen=True)
class Store:
    """Replies in a folder that the driver and all tasks reach by its path or URI."""

    uri: str
    buckets: int = BUCKETS

    def _place(self, *parts: object) -> tuple[pafs.FileSystem, str]:
        fs, path = pafs.FileSystem.from_uri(self.uri)
        return fs, "/".join([path.rstrip("/"), *map(str, parts)])

    def keys(self, bucket: int) -> set[str]:
        """The prompt hashes that are answered in a bucket."""
        fs, path = self._place(f"bucket={bucket}")
        files = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        whole = [f.path for f in files if not f.base_name.startswith("_")]
        return {k for p in whole for k in pq.read_table(p, filesystem=fs, columns=["key"], partitioning=None)["key"].to_pylist()}

    def append(self, bucket: int, rows: list[tuple]) -> None:
        """Add rows as a file, which appears as a whole or not at all."""
        fs, path = self._place(f"bucket={bucket}")
        fs.create_dir(path)
        name = uuid.uuid4().hex
        pq.write_table(pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA), f"{path}/_{name}", filesystem=fs)
        fs.move(f"{path}/_{name}", f"{path}/{name}.parquet")

    def read(self, spark: SparkSession) -> DataFrame:
        """(key, model, reply, in_tokens, out_tokens, attempts), one row for each key."""
        fs, path = self._place()
        fs.create_dir(path)
        rows = spark.read.schema("key string, model string, reply string, in_tokens long, out_tokens long, attempts long, bucket int").parquet(self.uri)
        one = rows.groupBy("key").agg(F.min(F.struct(*_SCHEMA.names[1:])).alias("row"))
        return one.select("key", "row.*")


def new_store(spark: SparkSession, buckets: int = BUCKETS) -> Store:
    """A store of this application in the shared folder; name one's own URI to keep replies for later runs."""
    return Store(f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/replies-{uuid.uuid4().hex}", buckets)


def answer(rows: Iterable[tuple[int, str, str]], call: Callable[[str], Reply], store: Store, model: str, workers: int, flush: int, waits: tuple[float, ...]) -> int:
    """Ask the prompts of rows (bucket, key, prompt), in order of buckets, that the store lacks; returns how many."""
    asked, bucket, known, open_ = 0, None, set(), []

    def put() -> int:
        if not open_:
            return 0
        futures = [pool.submit(patient, call, prompt, waits) for _, prompt in open_]
        done, failure = [], None
        for (key, _), f in zip(open_, futures, strict=True):
            try:
                reply, attempts = f.result()
                done.append((key, model, reply.text, reply.in_tokens, reply.out_tokens, attempts))
            except Exception as e:
                failure = e
        open_.clear()
        if done:
            store.append(bucket, done)
        if failure is not None:  # what was answered is kept
            raise failure
        return len(done)

    with ThreadPoolExecutor(workers) as pool:
        for b, key, prompt in rows:
            if b != bucket:
                asked += put()
                bucket, known = b, store.keys(b)
            if key not in known:
                known.add(key)
                open_.append((key, prompt))
            if len(open_) >= flush:
                asked += put()
        asked += put()
    return asked


def replies(prompts: DataFrame, call: Callable[[str], Reply], store: Store, model: str, workers: int = WORKERS, flush: int = FLUSH, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """(key, reply, ...) of the store for every distinct prompt of prompts(prompt), after asking what it lacks.

    key is the SHA-256 of the prompt. call runs in tasks, on `workers` threads of each. Null prompts are left out."""
    spark = prompts.sparkSession
    keyed = durable(prompts.where("prompt is not null").select("prompt").distinct().withColumn("key", F.sha2("prompt", 256)), "prompts")
    lacking = keyed.join(store.read(spark).select("key"), "key", "left_anti")
    dealt = lacking.select(F.pmod(F.xxhash64("key"), F.lit(store.buckets)).cast("int").alias("bucket"), "key", "prompt")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array([answer(rows, call, store, model, workers, flush, waits)])], ["asked"])

    dealt.mapInArrow(run, "asked long").agg(F.sum("asked")).collect()  # one number from each task
    return store.read(spark).join(keyed.select("key"), "key", "left_semi")


def usage(store: Store, spark: SparkSession) -> DataFrame:
    """(model, calls, in_tokens, out_tokens) of all replies of a store."""
    return store.read(spark).groupBy("model").agg(F.count("*").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"))


def cost(store: Store, spark: SparkSession) -> DataFrame:
    """usage() with cost in dollars by the price table."""
    return R.token_cost(usage(store, spark), R.price_table(spark))


@dataclass
class Prompted:
    """Clusterer that shows a model the records of a set, one line each, and reads groups of ids from its reply.

    Ids that weren't shown, and repeats, go; a missing id is made a cluster of its own by the round that asks. Another try
    comes in another order of records, which is another prompt."""

    records: DataFrame
    columns: list[str]
    call: Callable[[str], Reply]
    store: Store
    model: str
    preamble: str = "Group the records that describe the same thing. Answer with lists of record numbers only, as [[1, 2], [3]].\n"
    options: dict = field(default_factory=dict)

    def prompts(self, sets: DataFrame) -> DataFrame:
        """(set_id, prompt) of sets(set_id, pos, rid)."""
        return T.prompts(self.records, sets, self.columns).select("set_id", F.concat(F.lit(self.preamble), "prompt").alias("prompt"))

    def cluster(self, sets: DataFrame, attempt: int) -> DataFrame:
        prompts = durable(self.prompts(sets), "set-prompts")
        found = replies(prompts, self.call, self.store, self.model, **self.options)
        shown = sets.groupBy("set_id").agg(F.collect_list("rid").alias("ids"))  # a set has few records
        read = prompts.withColumn("key", F.sha2("prompt", 256)).join(found.select("key", "reply"), "key").join(shown, "set_id")
        groups = R.known_ids(R.parsed_clusters(F.col("reply")), F.col("ids"))
        rows = read.select("set_id", F.posexplode(groups).alias("cluster", "members"))
        return rows.select("set_id", F.explode("members").alias("rid"), F.col("cluster").cast("long").alias("cluster"))

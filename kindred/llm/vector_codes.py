"""Vector code compression: each quarter of a vector becomes the number of its nearest codebook entry.

Components are integers. Nearest entries are found by a VA-file over a codebook: every coordinate of an entry is
quantised to a few bits, a cell between two of that coordinate's values over all entries. For each query a lookup table
of a coordinate's cells holds the least and the greatest squared difference to a value in the cell; sums over the
coordinates give a lower and an upper bound of the distance to each entry. Only entries whose lower bound doesn't exceed the
least upper bound are compared, in integers. Codebooks start from the first vectors and move by a few rounds of means,
whose sums Spark adds up from one partial sum for each task and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import durable, finite, split_hot

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bits of a coordinate's cell.
BITS = 4
#: Integer components go so far; a component beyond it, over 131,072 before scaling, counts as that.
LARGEST = 2**27
#: Vectors that are compared with a codebook at once.
BLOCK = 512
#: Dimensions that one table can have: each has codebooks of its own.
DIMENSIONS = 100


def integers(vector: Column, scale: int = SCALE, largest: int = LARGEST) -> Column:
    """floor(scale * x) of each component, in double precision, from -largest to largest."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(largest)), F.least(F.lit(float(largest)), x.cast("double") * scale))).cast("int"))


class VAFile:
    """Codebook entries as cells of a few bits for each coordinate, and the entries themselves."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries.astype(np.int64)
        n, d = self.entries.shape
        order = np.argsort(self.entries, axis=0, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
        #: The cell of each entry's coordinate: as many entries in each as in any other.
        self.cells = (place * 2**bits // max(n, 1)).astype(np.intp)
        sizes = (2**bits, d)
        self.low, self.high = np.full(sizes, np.iinfo(np.int64).max), np.full(sizes, np.iinfo(np.int64).min)
        for j in range(d):
            np.minimum.at(self.low[:, j], self.cells[:, j], self.entries[:, j])
            np.maximum.at(self.high[:, j], self.cells[:, j], self.entries[:, j])
        empty = self.low > self.high  # no entry looks these cells up
        self.low[empty] = self.high[empty] = 0
        self.extent = int(np.abs(self.entries).max(initial=0))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper), entries x queries: bounds of the squared distances."""
        n, d = queries.shape
        reach = self.extent + int(np.abs(queries).max(initial=0))
        kind = np.int32 if d * reach * reach < 2**31 else np.int64
        lower, upper = (np.zeros((len(self.entries), n), kind) for _ in range(2))
        for j in range(d):
            q = queries[:, j].astype(np.int64)
            below, above = self.low[:, j, None] - q, q - self.high[:, j, None]
            nearest, furthest = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            lower += (nearest * nearest).astype(kind)[self.cells[:, j]]
            upper += (furthest * furthest).astype(kind)[self.cells[:, j]]
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each query's nearest entry, ties to the lower index, and the number of distances
        that had to be computed."""
        index, distance, refined = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), 0
        for at in range(0, len(queries), BLOCK):
            block = queries[at : at + BLOCK].astype(np.int64)
            lower, upper = self.bounds(block)
            entry, query = np.nonzero(lower <= upper.min(axis=0))
            refined += len(entry)
            difference = block[query] - self.entries[entry]
            exact = np.full((len(self.entries), len(block)), np.iinfo(np.int64).max)
            exact[entry, query] = (difference * difference).sum(axis=1)
            index[at : at + BLOCK] = exact.argmin(axis=0)
            distance[at : at + BLOCK] = exact.min(axis=0)
        return index, distance, refined


def quarters(dimension: int) -> list[slice]:
    """Consecutive parts of a vector, PARTS of them, equal where the dimension allows it; else the first are longer by one."""
    sizes = [dimension // PARTS + (i < dimension % PARTS) for i in range(PARTS)]
    ends = np.cumsum(sizes).tolist()
    return [slice(e - n, e) for n, e in zip(sizes, ends, strict=True)]


def encoded(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x PARTS) and errors of integer vectors of one dimension."""
    codes, errors = np.zeros((len(vectors), PARTS), np.uint8), np.zeros(len(vectors), np.int64)
    for p, part in enumerate(quarters(vectors.shape[1])):
        index, distance, _ = VAFile(books[p]).nearest(vectors[:, part])
        codes[:, p] = index
        errors += distance
    return codes, errors


def _by_dimension(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, positions, vectors) of a list column without nulls."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, at, np.asarray(column.take(pa.array(at)).flatten()).reshape(len(at), d)


def _moved(rows: DataFrame, books: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """Codebooks whose used entries are the floors of the means of the parts assigned to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {(d, p): np.zeros(len(b), np.int64) for d in books for p, b in enumerate(books[d])}
        sums = {(d, p): np.zeros(b.shape, np.int64) for d in books for p, b in enumerate(books[d])}
        for b in batches:
            for d, _, vectors in _by_dimension(b.column(0)):
                codes, _ = encoded(vectors, books[d])
                for p, part in enumerate(quarters(d)):
                    counts[d, p] += np.bincount(codes[:, p], minlength=len(books[d][p]))
                    np.add.at(sums[d, p], codes[:, p], vectors[:, part])
        for (d, p), n in counts.items():
            used = np.flatnonzero(n)
            if len(used):
                fixed = [pa.array(np.full(len(used), x, np.int32)) for x in (d, p)]
                columns = [*fixed, pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(sums[d, p][used].tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["d", "part", "entry", "n", "sums"])

    partial = rows.select("v").mapInArrow(run, "d int, part int, entry int, n long, sums array<long>")
    long = partial.select("d", "part", "entry", "n", F.posexplode_outer("sums").alias("at", "x"))
    means = long.groupBy("d", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
    out = {d: [b.copy() for b in books[d]] for d in books}
    for r in means.collect():  # one number for each component of an entry
        if r["at"] is not None:
            out[r["d"]][r["part"]][r["entry"], r["at"]] = int(r["x"]) // r["n"]
    return out


def first_books(rows: DataFrame, entries: int = ENTRIES) -> dict[int, list[np.ndarray]]:
    """For each dimension the parts of the vectors with the least ids, nulls last, ties by the vector."""
    sizes = [r["d"] for r in rows.select(F.size("v").alias("d")).groupBy("d").count().limit(DIMENSIONS + 1).collect()]
    if len(sizes) > DIMENSIONS:
        raise ValueError(f"more than {DIMENSIONS} dimensions")
    out = {}
    for d in sizes:
        first = rows.where(F.size("v") == d).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
        x = np.array([r["v"] for r in first], np.int64).reshape(len(first), d)
        out[d] = [x[:, part].copy() for part in quarters(d)]
    return out


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries' decimal components by part, entry and position within the part."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(vec_id, label, code, error, codebooks_sha256) of vectors(vec_id, embedding, label), and the codebooks by dimension.

    Rows whose vector is null or holds null or non-finite components are left out. Vectors of another dimension have
    codebooks of their own; where it isn't a multiple of four the first parts are longer by one. Null ids come
    last in the order that codebooks start by; repeated rows stay repeated and count as often. Fewer rows than entries
    make that many entries; an empty table gives no rows and no codebooks. Other columns are left out, whatever their names.
    """
    usable = vectors.where(finite(F.col("embedding")))
    rows = durable(usable.select("vec_id", "label", integers(F.col("embedding")).alias("v")), "integer-vectors")
    books = first_books(rows, entries)
    for _ in range(rounds):
        books = _moved(rows, books)
    digests = {d: codebooks_sha256(b) for d, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, error, digest = np.empty(b.num_rows, object), np.zeros(b.num_rows, np.int64), np.empty(b.num_rows, object)
            for d, at, x in _by_dimension(b.column(2)):
                codes, error[at] = encoded(x, books[d])
                text[at], digest[at] = [c.tobytes().hex() for c in codes], digests[d]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(error), pa.array(digest, pa.string())], names)

    names = ["vec_id", "label", "code", "error", "codebooks_sha256"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string"
    return rows.mapInArrow(run, schema), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: the sum of error over the rows of the same label, nulls together."""
    coded = durable(coded, "vector-codes")
    sums = durable(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return split_hot(coded, sums, "label").drop("n")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Code, error and label's error of every vector."""
    coded, _ = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql_rounds() -> str:
    """Assignments a0 to a4 and codebooks b0 to b4; squared distances of integers under 2 ** 53 are exact in doubles."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS (
  SELECT rid, part, any_value(x) AS x, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance FROM (
    SELECT rid, p.part, entry, x, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS distance FROM p JOIN b{r} b ON p.part = b.part
  ) GROUP BY rid, part
)""")
        if r < ROUNDS:
            steps.append(f"""b{r + 1} AS (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY pos) AS c FROM (
      SELECT part, entry, pos, floor(sum(value) / count(*)) AS mean FROM (SELECT part, entry, unnest(x) AS value, unnest(range(len(x))) AS pos FROM a{r}) GROUP BY ALL
    ) GROUP BY part, entry
  ) m ON b.part = m.part AND b.entry = m.entry
)""")
    return ",\n".join(steps)


OP12_SQL = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT rid, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM k, range({PARTS}) t(part)),
b0 AS (SELECT part, rid - 1 AS entry, x AS c FROM p WHERE rid <= {ENTRIES}),
{_sql_rounds()},
digest AS (
  SELECT sha256(string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(c) AS value, unnest(range(len(c))) AS pos FROM b{ROUNDS})
), coded AS (
  SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid
), labelled AS (SELECT vec_id, label, code, error FROM k JOIN coded ON k.rid = coded.rid),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM labelled GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM labelled l JOIN sums s ON l.label IS NOT DISTINCT FROM s.label, digest
"""

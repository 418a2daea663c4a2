"""Record sets and merge packing as SQL table functions.

register(spark) makes record_sets and pack_sets known:

    SELECT * FROM record_sets(TABLE(dealt))
    SELECT * FROM pack_sets(TABLE(representatives))

`dealt` has block, rid, draw, embedding (recordsets.dealt); `representatives` has block, set_no, cluster_no, rid, embedding. The
functions ask for a partition of each block and for its order themselves, and a task holds a block; a second argument is the
size of a set."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import LongType, StructType

from kindred.operators.merge import packed
from kindred.operators.recordsets import SET_SIZE, SET_SPREAD, sets_of


def _analysed(table: AnalyzeArgument, needed: tuple, names: tuple, by: tuple, order: tuple) -> AnalyzeResult:
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    lacking = set(needed) - set(table.dataType.fieldNames())
    if lacking:
        raise ValueError(f"the table lacks {', '.join(sorted(lacking))}")
    schema = StructType()
    for n in names:
        schema = schema.add(n, LongType())
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn(c) for c in by], orderBy=[OrderingColumn(c) for c in order])


@udtf
class RecordSets:
    """(block, set_no, pos, rid) of each block."""

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument = None) -> AnalyzeResult:
        return _analysed(table, ("block", "rid", "draw", "embedding"), ("block", "set_no", "pos", "rid"), ("block",), ("rid",))

    def __init__(self):
        # Plain numbers: lists of Python's would take several times the memory of the vectors.
        self.block, self.rids, self.draws, self.numbers, self.size = None, array("q"), array("q"), array("d"), SET_SIZE

    def eval(self, row: Row, size: int = SET_SIZE) -> None:
        self.block, self.size = row["block"], size
        self.rids.append(row["rid"])
        self.draws.append(row["draw"])
        self.numbers.extend(row["embedding"])

    def terminate(self) -> Iterator[tuple]:
        if self.rids:
            x = np.frombuffer(self.numbers).reshape(len(self.rids), -1)
            found = sets_of(self.rids, self.draws, x, self.size, min(SET_SPREAD, self.size))
            for n, chosen in enumerate(found):
                for pos, rid in enumerate(chosen):
                    yield self.block, n, pos, rid


@udtf
class PackSets:
    """(block, set_no, pos, rid) of the next round's sets of each block, all its representatives being in one task."""

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument = None) -> AnalyzeResult:
        return _analysed(table, ("block", "set_no", "cluster_no", "rid", "embedding"), ("block", "set_no", "pos", "rid"), ("block",), ("set_no", "cluster_no"))

    def __init__(self):
        self.rows, self.size = [], SET_SIZE

    def eval(self, row: Row, size: int = SET_SIZE) -> None:
        self.rows.append(row)
        self.size = size

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            whole = len(self.rows) <= self.size
            found = [range(len(self.rows))] if whole else packed([r["set_no"] for r in self.rows], [r["embedding"] for r in self.rows], self.size)
            for n, chosen in enumerate(found):
                for pos, i in enumerate(chosen):
                    yield self.rows[i]["block"], n, pos, self.rows[i]["rid"]


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session."""
    spark.udtf.register("record_sets", RecordSets)
    spark.udtf.register("pack_sets", PackSets)

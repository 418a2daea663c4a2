"""Helpers shared by the training-data operators: lambda-local values, words, joins with hot keys, and the core's durable
tables and components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.graph import components
from kindred.operators.storage import durable, release, shared_dir

__all__ = ["SPACE_CLASS", "components", "durable", "finite", "let", "release", "shared_dir", "split_hot", "words_of"]

#: What separates words everywhere in this subpackage: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: A key is hot with more than one in so many of all rows; there are fewer than HOT such keys, so they may be broadcast.
HOT = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it within other lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than SPACE_CLASS; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def finite(vector: Column) -> Column:
    """Whether an array is there and all of its components are numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def split_hot(rows: DataFrame, keys: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined (left or inner) with keys(key, n, ...), which has each key once and the number n of its rows, or fewer;
    nulls are alike. Both are tables that can be read twice.

    Keys with more than a HOT-th of all rows are fewer than HOT, whatever the data: they are broadcast, so no task
    gets a hot key's rows. All other keys have at most a HOT-th of the rows and meet by a shuffle."""
    most = rows.count() // HOT
    hot = F.broadcast(keys.where(F.col("n") > most).withColumnRenamed(key, "_key"))
    rest = keys.where(F.col("n") <= most).withColumnRenamed(key, "_key")
    same = rows[key].eqNullSafe(F.col("_key"))
    return rows.join(hot, same, "inner").unionByName(rows.join(hot, same, "left_anti").join(rest, same, how)).drop("_key")

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contentmark
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentmark.session import materialize

# Functions travel with their task closures; executors need no install.
cloudpickle.register_pickle_by_value(contentmark)

# Word = run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text (none for null) as an array."""
    body = F.btrim(text_or_empty(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(
        F.split(body, r"[\x20\x09-\x0D]+"))


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Identity of a document row: its id and a digest of its text, so null
    or repeated ids with different texts stay apart and equal rows agree."""
    return F.struct(F.col(id_col).cast("bigint").alias("id"),
                    F.xxhash64(text_or_empty(F.col(text_col))).alias("h"))


def with_row_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a gapless 0-based global index by ``order`` without a one-task
    sort: range partitions are sorted apart, and only one row count per
    partition is summed in one place (a bound set by the partition number)."""
    parts = materialize(
        df.repartitionByRange(*order).withColumn("_x_part", F.spark_partition_id()), "ranked")
    per_part = parts.groupBy("_x_part").agg(F.count(F.lit(1)).alias("_x_n"))
    before = Window.orderBy("_x_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_x_part", F.coalesce(F.sum("_x_n").over(before),
                                                    F.lit(0)).alias("_x_off"))
    inside = F.row_number().over(Window.partitionBy("_x_part").orderBy(*order))
    return (parts.withColumn("_x_rn", inside)
            .join(F.broadcast(offsets), "_x_part")
            .withColumn(name, F.col("_x_off") + F.col("_x_rn") - 1)
            .drop("_x_part", "_x_rn", "_x_off"))


def join_heavy(rows: DataFrame, unique: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with a table of unique ``key``s, without a hot task:
    keys that hold over 1 / ``share`` of the rows (fewer than ``share`` keys,
    whatever the data) are broadcast, and no other key is hot."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_x_n"))
    total = rows.count()
    heavy = F.broadcast(materialize(counts.where(F.col("_x_n") * share > total).select(key), "heavy"))
    few = F.broadcast(unique.join(heavy, key))
    rest = rows.join(heavy, key, "left_anti").join(unique.join(heavy, key, "left_anti"), key)
    return rest.unionByName(rows.join(few, key))

"""Block tables as CSV (the reference's interchange format)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contentmark.functions.text import render_seq
from contentmark.operators.blocks import rename_columns
from contentmark.schema import BLOCK_CSV_COLUMNS

# Reverse of schema.BLOCK_CSV_COLUMNS: our names -> contract names.
CONTRACT_NAMES = {v: k for k, v in BLOCK_CSV_COLUMNS.items()}
BASE_COLUMNS = ("page_id", "part", "class_seq", "tag_seq", "text_seq", "label")


def read_blocks(spark: SparkSession, paths, mapping: dict | None = None) -> DataFrame:
    """One CSV or a list of CSVs -> block table with canonical names.

    Files with differing columns are unioned by name (missing -> null);
    sequences stay list-like strings until ``parse_sequences``.  Files without
    a ``pos`` column, as the contract has them, get it from the order of their
    lines: 0, 1, .. within (page_id, part), files by name."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    frames = [spark.read.option("header", True).option("multiLine", True)
              .option("escape", '"').option("inferSchema", False).csv(p)
              .select("*", F.struct(F.lit(k), F.col("_metadata.file_path"),
                                    F.monotonically_increasing_id()).alias("_line"))
              for k, p in enumerate(paths)]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    df = rename_columns(df, mapping or BLOCK_CSV_COLUMNS)
    if "pos" not in df.columns and "page_id" in df.columns:
        sample = [c for c in ("page_id", "part") if c in df.columns]
        df = df.withColumn("pos", F.row_number().over(Window.partitionBy(*sample).orderBy("_line")) - 1)
    df = df.drop("_line")
    for c, t in (("part", "int"), ("pos", "int"), ("label", "int"), ("prediction", "int")):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast(t))
    return df


def to_contract(blocks: DataFrame, with_ids: bool = True,
                prediction_col: str = "prediction") -> DataFrame:
    """Blocks with arrays rendered as ``[a, b]`` strings and contract names.

    ``with_ids=False`` keeps the 7 base columns (id, part, class, tag, text,
    label, prediction); ``pos`` is always kept - Spark has no row order."""
    cols = list(blocks.columns) if with_ids else [
        c for c in (*BASE_COLUMNS, prediction_col) if c in blocks.columns]
    if "pos" not in cols:
        cols.insert(2, "pos")
    out = []
    for c in cols:
        t = dict(blocks.dtypes)[c]
        col = render_seq(c) if t.startswith("array") else F.col(c)
        out.append(col.alias(CONTRACT_NAMES.get(c, c)))
    return blocks.select(*out)


def write_blocks(blocks: DataFrame, path: str, with_ids: bool = True,
                 prediction_col: str = "prediction") -> None:
    """S7 / S5 sink: block table (with predictions) as CSV with header."""
    (to_contract(blocks, with_ids, prediction_col)
     .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))

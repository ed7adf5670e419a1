"""A1-A5: gold-text alignment and positional attach, as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentmark.functions.text import normalize_ws


def gold_keys(gold: DataFrame, n_chars: int = 50) -> DataFrame:
    """A1: search keys of each gold line - the first ``n_chars`` characters,
    raw (``key_raw``) and with double quotes dropped (``key_own``)."""
    k = F.substring("text", 1, n_chars)
    return gold.withColumn("key_raw", k).withColumn("key_own", F.replace(k, F.lit('"'), F.lit("")))


def candidates(dom: DataFrame, gold: DataFrame, n_chars: int = 50) -> DataFrame:
    """A2: (page_id, line_no, i, node) text runs holding a gold line's key
    (raw prefix or the prefix without double quotes).

    Keys are found by ``textscan.occurrences``; a run holds a key when an
    occurrence lies inside it - an equi-join on (page, key).  An empty key is in every
    run."""
    from contentmark.operators.shred import texts as text_runs
    from contentmark.operators.textscan import occurrences

    g = gold_keys(gold, n_chars)
    keys = (g.select("page_id", "line_no", F.col("key_raw").alias("needle"))
            .unionByName(g.select("page_id", "line_no", F.col("key_own").alias("needle"))).distinct())
    occ = occurrences(dom, keys.select("page_id", "needle").distinct())
    hit = (keys.where(F.col("needle") != "")
           .join(occ.where(F.col("run_i").isNotNull())
                 .select("page_id", "needle", F.col("run_i").alias("i"), F.col("run_node").alias("node")),
                 ["page_id", "needle"])
           .where(F.col("node").isNotNull())
           .select("page_id", "line_no", "i", "node"))
    runs = text_runs(dom).select("page_id", "i", "node")
    empty = keys.where(F.col("needle") == "").select("page_id", "line_no").join(runs, "page_id")
    return hit.unionByName(empty).distinct()


def align(texts: DataFrame, gold: DataFrame) -> DataFrame:
    """A3: text runs whose white-space-normalised text equals a normalised
    gold line - an equi-join on (page_id, normalised text)."""
    g = gold if "norm" in gold.columns else gold.select("page_id", "line_no", normalize_ws("text").alias("norm"))
    own = F.coalesce("norm", "text") if "norm" in texts.columns else normalize_ws("text")
    t = texts.select("page_id", "i", "node", own.alias("norm"))
    return t.join(g, ["page_id", "norm"]).select("page_id", "line_no", "i", "node")


def distinct_lines(gold: DataFrame) -> DataFrame:
    """Gold lines for ``align`` where only the runs count: the first of a page's equal
    lines (``norm``), so a line that a page repeats does not meet each of its runs again."""
    g = gold.select("page_id", "line_no", normalize_ws("text").alias("norm"))
    return g.groupBy("page_id", "norm").agg(F.min("line_no").alias("line_no"))


def owners(hits: DataFrame) -> DataFrame:
    """A4: (page_id, pre) of the elements owning the hits, de-duplicated."""
    return hits.select("page_id", F.col("node").alias("pre")).distinct()


def attach(blocks: DataFrame, predictions: DataFrame,
           prediction_col: str = "prediction") -> DataFrame:
    """A5: attach predictions to block rows by (page_id, part, pos)."""
    p = predictions.select("page_id", "part", "pos", F.col(prediction_col))
    return blocks.join(p, ["page_id", "part", "pos"], "left")


def attach_audit(blocks: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows present on one side only (the reference fails on a length
    mismatch): (page_id, part, pos, side)."""
    b = blocks.select("page_id", "part", "pos").withColumn("_b", F.lit(1))
    p = predictions.select("page_id", "part", "pos").withColumn("_p", F.lit(1))
    return (b.join(p, ["page_id", "part", "pos"], "full_outer")
            .where(F.col("_b").isNull() | F.col("_p").isNull())
            .select("page_id", "part", "pos",
                    F.when(F.col("_b").isNull(), "prediction").otherwise("block").alias("side")))

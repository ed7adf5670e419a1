"""Mix sources to target weights by capped water-filling (DataFrame only).

A budget of words is shared by source weight.  A source that would be read
more than ``max_epochs`` times stops there and its excess goes to the others
by weight, until no source is above its cap.  The fixed point is
``target = min(cap, level * weight)``; the level is found by repeating one
small aggregate over the source table (each round clamps more sources).

Sampling is seeded: documents of a source stand in the order of a digest of
seed and id.  Every document is taken ``floor(target / size)`` times whole;
the rest of the target is one fractional repetition, the start of that order,
whose last document is cut so the source meets its target to the word.

The order is cut into digest buckets, so a hot source is summed by partial
aggregates; only the bucket in which the fractional repetition ends is
ranked row by row (1/65536 of a source).

Defined cases: null text has size 0; a null source is a source of its own;
null ids share one digest and are ordered by size; equal rows are
interchangeable, each is a document; an empty table gives no rows; an all-empty
source gets target 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentmark.llm.common import WORD, text_or_empty, with_row_index, words
from contentmark.session import materialize

BUCKET_HEX = 4  # hex digits of the digest that name a bucket


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def cyclic_weights(cycle: Sequence[float]) -> Callable[[DataFrame], DataFrame]:
    """Weights repeating ``cycle`` over the sources by code point, null last."""
    def add(sources: DataFrame) -> DataFrame:
        ranked = with_row_index(sources, [F.col("_x_src").asc_nulls_last()], "_x_i")
        pick = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]),
                            (F.col("_x_i") % len(cycle) + 1).cast("int"))
        return ranked.withColumn("_x_w", pick).drop("_x_i")
    return add


def weight_table(weights: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Weights from a table (source, weight); sources it lacks weigh 0."""
    w = weights.select(F.col("source").alias("_x_s"), F.col("weight").cast("double").alias("_x_w"))
    return lambda sources: (sources.join(w, F.col("_x_src").eqNullSafe(F.col("_x_s")), "left")
                            .drop("_x_s").fillna(0.0, ["_x_w"]))


def water_level(sources: DataFrame, budget: float) -> float:
    """Level at which sum(min(cap, level * weight)) meets the budget; infinite
    when all caps together stay below it.  ``sources``: _x_cap, _x_w."""
    cap, w = F.col("_x_cap"), F.col("_x_w")
    level, clamped = 0.0, -1
    while True:
        full = cap <= F.lit(level) * w if clamped >= 0 else F.lit(False)
        r = sources.where(w > 0).agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(w)).alias("free"),
            F.sum(full.cast("bigint")).alias("n")).first()
        if r["n"] is None:
            return 0.0
        if r["free"] <= 0:
            return float("inf")
        if r["n"] == clamped:
            return level
        level, clamped = (budget - r["capped"]) / r["free"], r["n"]


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return (docs.withColumn("_x_size", word_count(F.col(text_col)))
            .withColumn("_x_src", F.col(source_col).cast("string"))
            .withColumn("_x_h", digest)
            .withColumn("_x_b", F.conv(F.substring("_x_h", 1, BUCKET_HEX), 16, 10).cast("int")))


def _crossing(parts: DataFrame, at: str, size: str, need: str) -> DataFrame:
    """(_x_s, _x_at, _x_rem): the part in which a source's running size passes
    its need, and what of the need is left there; none for sources that never do."""
    upto = Window.partitionBy("_x_src").orderBy(at)
    cum = F.col("_x_cum")
    return (parts.withColumn("_x_cum", F.sum(size).over(upto)).where(cum > F.col(need))
            .groupBy(F.col("_x_src").alias("_x_s"))
            .agg(F.min(F.struct(F.col(at).alias("at"), (F.col(need) - cum + F.col(size)).alias("rem"))).alias("_x_end"))
            .select("_x_s", F.col("_x_end.at").alias("_x_at"), F.col("_x_end.rem").alias("_x_rem")))


def plan(docs: DataFrame, weights: Callable[[DataFrame], DataFrame], *, budget_ratio: float = 1.5,
         max_epochs: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source") -> DataFrame:
    """``docs`` with _x_size, _x_source_size, _x_target, _x_whole (whole
    repetitions) and _x_extra (words of the fractional one).

    ``weights`` adds a column _x_w to a table of sources (_x_src); see
    ``cyclic_weights`` and ``weight_table``.  ``budget_ratio``: words of the
    mix as a share of all words."""
    rows = _prepared(docs, id_col, text_col, source_col, seed)
    buckets = materialize(rows.groupBy("_x_src", "_x_b").agg(F.sum("_x_size").alias("_x_bsize")),
                          "mix-buckets")
    sources = buckets.groupBy("_x_src").agg(F.sum("_x_bsize").alias("_x_source_size"))
    sources = materialize(
        weights(sources).withColumn("_x_cap", F.lit(float(max_epochs)) * F.col("_x_source_size")),
        "mix-sources")
    total = sources.agg(F.sum("_x_source_size")).first()[0] or 0
    level = water_level(sources, budget_ratio * total)
    share = F.least("_x_cap", F.when(F.col("_x_w") > 0, F.lit(level) * F.col("_x_w")).otherwise(0.0))
    whole = F.when(F.col("_x_source_size") > 0,
                   F.floor(F.col("_x_target") / F.col("_x_source_size"))).otherwise(F.lit(0)).cast("bigint")
    sources = (sources.withColumn("_x_target", share).withColumn("_x_whole", whole)
               .withColumn("_x_need", F.round("_x_target").cast("bigint")
                           - F.col("_x_whole") * F.col("_x_source_size")))
    # the bucket in which a source's fractional repetition ends: first among
    # ranges of buckets, then within that range, so few rows of a source meet
    wide = F.floor(F.col("_x_b") / 16 ** (BUCKET_HEX // 2)).cast("int")
    ranges = (buckets.groupBy("_x_src", wide.alias("_x_r")).agg(F.sum("_x_bsize").alias("_x_rsize"))
              .join(sources.select(F.col("_x_src").alias("_x_s"), "_x_need"),
                    F.col("_x_src").eqNullSafe(F.col("_x_s"))))
    within = buckets.join(_crossing(ranges, "_x_r", "_x_rsize", "_x_need"),
                          F.col("_x_src").eqNullSafe(F.col("_x_s")) & (wide == F.col("_x_at")))
    ends = _crossing(within, "_x_b", "_x_bsize", "_x_rem")
    table = (sources.join(ends, F.col("_x_src").eqNullSafe(F.col("_x_s")), "left")
             .select(F.col("_x_src").alias("_x_s"), "_x_source_size", "_x_target", "_x_whole",
                     F.coalesce("_x_at", F.lit(16 ** BUCKET_HEX)).alias("_x_end_b"),
                     F.coalesce("_x_rem", F.lit(0)).alias("_x_rem")))
    table = materialize(table, "mix-targets")
    joined = rows.join(table, F.col("_x_src").eqNullSafe(F.col("_x_s"))).drop("_x_s")
    sure = joined.where(F.col("_x_b") != F.col("_x_end_b")).withColumn(
        "_x_extra", F.when(F.col("_x_b") < F.col("_x_end_b"), F.col("_x_size")).otherwise(0))
    before = (Window.partitionBy("_x_src").orderBy("_x_h", id_col, "_x_size")
              .rowsBetween(Window.unboundedPreceding, -1))
    ranked = joined.where(F.col("_x_b") == F.col("_x_end_b")).withColumn(
        "_x_extra", F.greatest(F.lit(0), F.least(
            F.col("_x_size"), F.col("_x_rem") - F.coalesce(F.sum("_x_size").over(before), F.lit(0)))))
    return sure.unionByName(ranked)


def taken() -> Column:
    """Words the mix takes of a planned document, repeats counted."""
    return F.col("_x_whole") * F.col("_x_size") + F.col("_x_extra")


def mix(docs: DataFrame, weights: Callable[[DataFrame], DataFrame], *, text_col: str = "text",
        **options) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: each document as
    often as the plan takes it whole, and once cut to its first words where
    the fractional repetition of its source ends.  ``n_chars`` follows the
    cut text when there is such a column.  A document without words comes as
    often as its source's whole repetitions."""
    p = plan(docs, weights, text_col=text_col, **options)
    whole_extra = ((F.col("_x_extra") > 0) & (F.col("_x_extra") == F.col("_x_size"))).cast("int")
    cut = ((F.col("_x_extra") > 0) & (F.col("_x_extra") < F.col("_x_size"))).cast("int")
    copies = F.concat(F.array_repeat(F.lit(False), (F.col("_x_whole") + whole_extra).cast("int")),
                      F.array_repeat(F.lit(True), cut))
    pieces = F.regexp_extract_all(text_or_empty(F.col(text_col)),
                                  F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    out = p.withColumn("_x_cut", F.explode(copies)).withColumn(
        text_col, F.when(F.col("_x_cut"), F.array_join(
            F.slice(pieces, F.lit(1), F.col("_x_extra").cast("int")), "")).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(
            F.col("_x_cut"), F.length(text_col).cast(docs.schema["n_chars"].dataType))
            .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

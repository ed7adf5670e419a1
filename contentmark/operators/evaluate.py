"""Flatten predictions and targets, metrics and class report.

Everything is one confusion-count aggregate (label x prediction) followed by
arithmetic on at most n_classes^2 rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "f1")
AVERAGES = ("micro", "macro", "weighted")


def pairs(samples: DataFrame, pred: str = "prediction", label: str = "label",
          mask: str = "mask") -> DataFrame:
    """(label, prediction) rows of real blocks only (the first
    ``sum(mask)`` positions of each sample)."""
    n = F.aggregate(F.col(mask), F.lit(0), lambda a, x: a + x)
    z = F.arrays_zip(F.slice(F.col(label), F.lit(1), n).alias("label"),
                     F.slice(F.col(pred), F.lit(1), n).alias("prediction"))
    return samples.select(F.inline(z))


def confusion(pairs_df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return pairs_df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _per_class(conf: DataFrame, classes=(0, 1)) -> DataFrame:
    """(cls, tp, fp, fn, precision, recall, f1, support) in one aggregate
    over the (at most n_classes^2) confusion rows."""
    c = conf.withColumn("cls", F.explode(F.array(*[F.lit(k) for k in classes])))
    hit_l, hit_p = F.col("label") == F.col("cls"), F.col("prediction") == F.col("cls")
    out = c.groupBy("cls").agg(
        F.sum(F.when(hit_l & hit_p, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~hit_l & hit_p, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit_l & ~hit_p, F.col("n")).otherwise(0)).alias("fn"))

    def div(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p = div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = div(F.col("tp"), F.col("tp") + F.col("fn"))
    return (out.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", div(2 * F.col("precision") * F.col("recall"),
                                  F.col("precision") + F.col("recall")))
            .withColumn("support", F.col("tp") + F.col("fn")))


def metrics(pairs_df: DataFrame, split: str = "test", classes=(0, 1)) -> DataFrame:
    """(metric, value) - precision / recall / F1, each micro, macro and
    weighted, named with the split prefix (``train_``, ``val_``, ``test``).
    Zero denominators give 0."""
    pc = _per_class(confusion(pairs_df), classes)
    def div(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    micro_p, micro_r = div(tp, tp + fp), div(tp, tp + fn)
    sup = F.sum("support")
    cols = {
        "precision_micro": micro_p, "recall_micro": micro_r,
        "f1_micro": div(2 * micro_p * micro_r, micro_p + micro_r),
        "precision_macro": F.avg("precision"), "recall_macro": F.avg("recall"),
        "f1_macro": F.avg("f1"),
        "precision_weighted": div(F.sum(F.col("precision") * F.col("support")), sup),
        "recall_weighted": div(F.sum(F.col("recall") * F.col("support")), sup),
        "f1_weighted": div(F.sum(F.col("f1") * F.col("support")), sup),
    }
    wide = pc.agg(*[v.alias(k) for k, v in cols.items()])
    stack = ", ".join(f"'{split}{k}', `{k}`" for k in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (metric, value)")


def report(pairs_df: DataFrame, classes=(0, 1)) -> DataFrame:
    """Classification report rows (row, precision, recall, f1, support):
    one per class, ``accuracy`` (f1 column), ``macro avg``, ``weighted avg``.
    Truth first, prediction second."""
    pc = _per_class(confusion(pairs_df), classes)
    per = pc.select(F.col("cls").cast("string").alias("row"), "precision", "recall", "f1",
                    F.col("support").cast("bigint").alias("support"))
    sup = F.sum("support")
    acc = pc.agg(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"),
                 F.when(sup > 0, F.sum("tp") / sup).otherwise(0.0).alias("f1"),
                 sup.cast("bigint").alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                   sup.cast("bigint").alias("support"))
    def wavg(c):
        return F.when(sup > 0, F.sum(F.col(c) * F.col("support")) / sup).otherwise(0.0)
    weighted = pc.agg(F.lit("weighted avg").alias("row"), wavg("precision").alias("precision"),
                      wavg("recall").alias("recall"), wavg("f1").alias("f1"),
                      sup.cast("bigint").alias("support"))
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)

"""M2 over all three sequences and the neighbours: sparse block vectors and a
distributed logistic regression.

A block is the set of its class, tag and text tokens and of those of the blocks before
and after it in its sample (V7).  Every token, marked with its sequence and place, is
hashed to one of ``16 ** digits`` slots by the head of its MD5 digest, so a model has a
fixed size however large the corpus is, and any SQL engine can name the slots.
The solver is MLlib's L-BFGS: gradients are tree-aggregated, so only
vectors of that size reach the driver.

A fit can be checked without its solver: at the optimum of the penalised likelihood
the weighted count of positive blocks of every slot equals what the model expects plus
the slot's penalty term (``moments``).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentmark.operators.blocks import _seq_string, tokenize
from contentmark.session import materialize

MARKS = {"class_seq": "c", "tag_seq": "g", "text_seq": "t"}
OWN, BEFORE, AFTER = "", "<", ">"
DIGITS = 4
INTERCEPT = -1      # the slot of the moments row that every block counts in
TINY = 1e-300


def marked(tokens: Column, mark: str) -> Column:
    return F.transform(tokens, lambda t: F.concat(F.lit(mark), t))


def slots(tokens: Column, place: str, digits: int = DIGITS) -> Column:
    """Slots (hexadecimal strings) of marked tokens, seen from ``place``."""
    return F.transform(tokens, lambda t: F.substring(F.md5(F.concat(F.lit(place), t)), 1, digits))


def block_features(blocks: DataFrame, digits: int = DIGITS, keys=("page_id", "part"), order: str = "pos",
                   out: str = "features") -> DataFrame:
    """``blocks`` + ``out``: the distinct slots of a block and its neighbours.

    Null sequences count as empty; the first and last block of a sample lack a
    neighbour.  One shuffle by sample, which fold and decoding need as well."""
    none = F.array().cast("array<string>")
    own = [F.coalesce(marked(tokenize(_seq_string(blocks, c)), m + ":"), none) for c, m in MARKS.items()]
    w = W.partitionBy(*keys).orderBy(order)
    b = blocks.withColumn("_own", F.array_distinct(F.concat(*own)))
    b = b.withColumn("_before", F.coalesce(F.lag("_own").over(w), none))
    b = b.withColumn("_after", F.coalesce(F.lead("_own").over(w), none))
    seen = F.concat(slots(F.col("_own"), OWN, digits), slots(F.col("_before"), BEFORE, digits),
                    slots(F.col("_after"), AFTER, digits))
    return b.withColumn(out, F.array_distinct(seen)).drop("_own", "_before", "_after")


def fit_logistic(rows: DataFrame, label: str = "label", weight: str | None = None, reg: float = 1e-3,
                 digits: int = DIGITS, max_iter: int = 500, tol: float = 1e-10) -> PipelineModel:
    """Weights of ``reg``-penalised logistic regression over ``features`` (the intercept is
    free); ``weight`` names a column of row weights."""
    names = [format(k, f"0{digits}x") for k in range(16 ** digits)]
    vector = CountVectorizerModel.from_vocabulary(names, inputCol="features", outputCol="slots", binary=True)
    lr = LogisticRegression(featuresCol="slots", labelCol=label, family="binomial", regParam=reg,
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)
    if weight:
        lr.setWeightCol(weight)
    # the solver reads the vectors more than once
    vectors = materialize(vector.transform(rows).select("slots", label, *([weight] if weight else [])), "slots")
    return PipelineModel(stages=[vector, lr.fit(vectors)])


def emissions(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """``rows`` + ``em`` = [log P(0), log P(1)] of every block."""
    p = vector_to_array(F.col("probability"))
    return (model.transform(rows).withColumn("em", F.transform(p, lambda x: F.log(F.greatest(x, F.lit(TINY)))))
            .drop("slots", "rawPrediction", "probability", "prediction"))


def moments(rows: DataFrame, model: PipelineModel, label: str = "label", weight: str | None = None) -> DataFrame:
    """(slot, n, observed, fitted) for every slot in use and the intercept: its blocks, the
    weight of the positive ones, and what the model gives for them.  The fit is optimal
    where ``fitted`` equals ``observed``.  Coefficients travel as one small table."""
    lr = model.stages[-1]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    p = vector_to_array(F.col("probability"))[1]
    seen = F.transform("features", lambda s: F.conv(s, 16, 10).cast("bigint"))
    flat = model.transform(rows).select(
        F.explode(F.concat(seen, F.array(F.lit(INTERCEPT).cast("bigint")))).alias("slot"),
        w.alias("w"), (w * F.col(label)).alias("y"), (w * p).alias("p"))
    sums = flat.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("observed"), F.sum("p").alias("p"))
    total = rows.agg(F.sum(w)).first()[0] or 0.0
    table = [(INTERCEPT, 0.0), *((k, float(c)) for k, c in enumerate(lr.coefficients.toArray()) if c)]
    coef = F.broadcast(rows.sparkSession.createDataFrame(table, "slot bigint, c double"))
    pull = F.lit(lr.getRegParam() * total) * F.coalesce("c", F.lit(0.0))
    return sums.join(coef, "slot", "left").select("slot", "n", "observed", (F.col("p") + pull).alias("fitted"))

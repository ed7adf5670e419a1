"""M6, M7: the block-sequence labeller as a ``pyspark.ml`` estimator and model.

``BlockLabeler.fit(blocks)`` splits the blocks, fits emission scores (``nb``: naive
Bayes over text tokens; ``lr``: logistic regression over class, tag and text tokens
of a block and its neighbours) and the label chain; ``transform`` scores and
decodes every sample.  Both take part in a ``Pipeline`` and a ``CrossValidator``
(folds by page: give it a ``foldCol``, and ``BlockEvaluator``) and are written and read
like any other stage: fitted tables as Parquet, the solver's model with its own writer.
"""

from __future__ import annotations

import os

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable,
                             DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentmark.operators import blockfeat as BF
from contentmark.operators import blocks as B
from contentmark.operators import chain as C
from contentmark.operators import evaluate as E
from contentmark.operators import model as M
from contentmark.operators import tokenscore as TS
from contentmark.session import materialize

KEYS = ["page_id", "part", "pos"]
EMISSIONS = ("nb", "lr")


def _optional_int(value):
    return None if value is None else TypeConverters.toInt(value)


def _emissions(value):
    if value not in EMISSIONS:
        raise ValueError(f"emissions must be one of {EMISSIONS}")
    return value


class LabelerParams(Params):
    """Parameters that estimator and model share."""

    vocab_size = Param(Params._dummy(), "vocab_size", "most frequent tokens kept (nb); None: all", _optional_int)
    max_length = Param(Params._dummy(), "max_length", "ids of a text read (nb); None: all", _optional_int)
    max_blocks = Param(Params._dummy(), "max_blocks", "blocks of a sample", TypeConverters.toInt)
    emissions = Param(Params._dummy(), "emissions", "nb or lr", _emissions)
    class_weighted = Param(Params._dummy(), "class_weighted", "balance the classes", TypeConverters.toBoolean)
    reg = Param(Params._dummy(), "reg", "penalty of the weights (lr)", TypeConverters.toFloat)
    slot_digits = Param(Params._dummy(), "slot_digits", "hexadecimal digits of a feature slot (lr)", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(vocab_size=None, max_length=None, max_blocks=85, emissions="nb", class_weighted=False,
                         reg=1e-3, slot_digits=BF.DIGITS)

    def _get(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def _prepare(self, blocks: DataFrame) -> DataFrame:
        b = blocks.withColumn("part0", F.col("part")).withColumn("pos0", F.col("pos"))
        split = B.split_parts(b, self._get("max_blocks"))
        if self._get("emissions") == "lr":
            split = BF.block_features(split, self._get("slot_digits"))
        return materialize(split, "split")


class BlockLabeler(Estimator, LabelerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, vocab_size=None, max_length=None, max_blocks=85, emissions="nb", class_weighted=False,
                 reg=1e-3, slot_digits=BF.DIGITS):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "BlockLabelerModel":
        train = self._prepare(dataset)
        weights = M.class_weights(train) if self._get("class_weighted") else None
        trans = M.fit_transitions(train)
        if self._get("emissions") == "nb":
            em_model = TS.fit_token_scores(train, max_size=self._get("vocab_size"),
                                           max_length=self._get("max_length"), weights=weights)
        else:
            rows = train
            if weights is not None:     # a row per class
                rows = rows.join(F.broadcast(weights.select("label", F.col("weight").alias("w"))), "label")
            em_model = BF.fit_logistic(rows, weight=None if weights is None else "w", reg=self._get("reg"),
                                       digits=self._get("slot_digits"), max_iter=100, tol=1e-6)
        return self._copyValues(BlockLabelerModel(em_model, trans))


class BlockLabelerModel(Model, LabelerParams, MLReadable, MLWritable):
    def __init__(self, em_model=None, trans: DataFrame | None = None):
        super().__init__()
        self.em_model, self.trans = em_model, trans

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Blocks (split into parts of at most ``max_blocks``) with
        ``prediction``; ``part0`` / ``pos0`` keep the input coordinates."""
        enc = self._prepare(dataset)
        if self._get("emissions") == "nb":
            scored = TS.score_tokens(enc, self.em_model, self._get("max_length"), carry=())
        else:
            scored = BF.emissions(enc, self.em_model)
        preds = C.decode_blocks(scored, self.trans, longest=self._get("max_blocks"))
        return enc.drop("features").join(preds, KEYS, "left")

    def evaluate(self, blocks: DataFrame, split: str = "test") -> DataFrame:
        """E1-E2 on the model's predictions: (metric, value)."""
        return E.metrics(self.transform(blocks).select("label", "prediction"), split)

    def evaluate_splits(self, splits: dict[str, DataFrame]) -> DataFrame:
        """E2 on several tables (``{"train_": .., "val_": .., "test": ..}``), each predicted
        and stored once: (metric, value), the names with their prefix."""
        out = None
        for split, blocks in splits.items():
            stored = materialize(self.transform(blocks).select("label", "prediction"), "predictions")
            rows = E.metrics(stored, split)
            out = rows if out is None else out.unionAll(rows)
        return out

    def write(self) -> "LabelerWriter":
        return LabelerWriter(self)

    @classmethod
    def read(cls) -> "LabelerReader":
        return LabelerReader(cls)

    @classmethod
    def load(cls, *where) -> "BlockLabelerModel":
        """``load(path)``, or ``load(spark, path)``."""
        reader = cls.read()
        if isinstance(where[0], SparkSession):
            reader.session(where[0])
        return reader.load(where[-1])


class LabelerWriter(MLWriter):
    def __init__(self, instance: BlockLabelerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        model = self.instance
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession)
        model.trans.write.parquet(os.path.join(path, "transitions"))
        emissions = os.path.join(path, "emissions")
        if model._get("emissions") == "nb":
            model.em_model.write.parquet(emissions)
        else:
            model.em_model.write().save(emissions)


class LabelerReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BlockLabelerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.trans = self.sparkSession.read.parquet(os.path.join(path, "transitions"))
        emissions = os.path.join(path, "emissions")
        if model._get("emissions") == "nb":
            model.em_model = self.sparkSession.read.parquet(emissions)
        else:
            model.em_model = PipelineModel.load(emissions)
        return model


class BlockEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """One of the metrics of E2, larger is better."""

    metric = Param(Params._dummy(), "metric", "name of a metric of E2", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, metric="f1_macro"):
        super().__init__()
        self._setDefault(metric="f1_macro")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = E.metrics(dataset.select("label", "prediction"), "")
        name = self.getOrDefault(self.metric)
        value = rows.where(F.col("metric") == name).first()
        if value is None:
            raise ValueError(f"no metric {name}")
        return value["value"]

    def isLargerBetter(self) -> bool:
        return True

"""Block features, the solver's optimality, and the labeller as a pyspark.ml stage."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from contentmark.operators import blockfeat as BF
from contentmark.plans.labeller import BlockEvaluator, BlockLabeler, BlockLabelerModel

SCHEMA = "page_id bigint, part int, pos int, class_seq string, tag_seq string, text_seq string, label int"


def blocks(spark, pages=6, size=5):
    rows = [(p, 0, k, "[ad]" if (p + k) % 3 == 0 else "[]", "[body, p]" if k % 2 else "[body, div]",
             f"[word{k} {'sale buy' if (p + k) % 3 == 0 else 'story told'} {p}]", int((p + k) % 3 != 0))
            for p in range(pages) for k in range(size)]
    return spark.createDataFrame(rows, SCHEMA)


def slot(token):
    return hashlib.md5(token.encode()).hexdigest()[:4]


def test_features_of_block_and_neighbours(spark):
    rows = [(1, 0, 0, "[a]", "[p]", "[x x]", 1), (1, 0, 1, None, "[p]", "[]", 0), (1, 0, 2, "[]", None, None, 1),
            (1, 1, 0, "[]", "[q]", "[y]", 0)]
    got = {(r["part"], r["pos"]): r["features"]
           for r in BF.block_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    first = ["c:a", "g:p", "t:x"]
    want = {(0, 0): first + [">g:p"], (0, 1): ["g:p"] + ["<" + t for t in first], (0, 2): ["<g:p"],
            (1, 0): ["g:q", "t:y"]}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(map(slot, v)) for k, v in want.items()}


@pytest.mark.parametrize("weighted", [False, True])
def test_moments_are_the_gradient(spark, weighted):
    data = BF.block_features(blocks(spark)).withColumn("w", F.when(F.col("label") == 1, 1.0).otherwise(2.0)).cache()
    weight = "w" if weighted else None
    model = BF.fit_logistic(data, weight=weight, reg=0.01)
    rows = data.collect()
    coef, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    total = sum(r["w"] if weighted else 1.0 for r in rows)
    plain = {}
    for r in rows:
        ids = [int(s, 16) for s in r["features"]]
        w = r["w"] if weighted else 1.0
        p = 1 / (1 + math.exp(-(b + sum(coef[i] for i in ids))))
        for i in [*ids, BF.INTERCEPT]:
            n, y, e = plain.get(i, (0, 0.0, 0.0 if i < 0 else 0.01 * total * coef[i]))
            plain[i] = (n + 1, y + w * r["label"], e + w * p)
    got = {r["slot"]: (r["n"], r["observed"], r["fitted"]) for r in BF.moments(data, model, weight=weight).collect()}
    assert got.keys() == plain.keys()
    for k, (n, y, e) in plain.items():
        assert got[k][0] == n and abs(got[k][1] - y) < 1e-9 and abs(got[k][2] - e) < 1e-6
        assert abs(y - e) < 0.01        # near the optimum
    # a model that is not at its optimum is told apart
    rough = BF.fit_logistic(data, weight=weight, reg=0.01, max_iter=1)
    assert any(abs(r["observed"] - r["fitted"]) > 0.1 for r in BF.moments(data, rough, weight=weight).collect())


def test_labeller_in_a_pipeline(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    data = blocks(spark)
    for emissions in ("nb", "lr"):
        stage = BlockLabeler(max_blocks=4, emissions=emissions, class_weighted=True, vocab_size=None)
        stage.write().overwrite().save(str(tmp_path / f"{emissions}-est"))
        stage = BlockLabeler.load(str(tmp_path / f"{emissions}-est"))
        assert stage.getOrDefault("max_blocks") == 4 and stage.getOrDefault("vocab_size") is None
        model = Pipeline(stages=[stage]).fit(data)
        path = str(tmp_path / emissions)
        for _ in range(2):
            model.write().overwrite().save(path)
        again = PipelineModel.load(path)
        assert isinstance(again.stages[0], BlockLabelerModel) and again.stages[0].uid == model.stages[0].uid
        key = ("page_id", "part0", "pos0", "label", "prediction")
        want = sorted(tuple(r) for r in model.transform(data).select(*key).collect())
        assert sorted(tuple(r) for r in again.transform(data).select(*key).collect()) == want
        assert len(want) == 30 and sum(r[3] == r[4] for r in want) >= 27
    with pytest.raises(ValueError):
        BlockLabeler(emissions="other")


def test_cross_validation_by_page(spark):
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    data = blocks(spark).withColumn("fold", F.pmod("page_id", F.lit(2)).cast("int"))
    stage = BlockLabeler(max_blocks=5)
    grid = ParamGridBuilder().addGrid(stage.vocab_size, [50]).build()
    best = CrossValidator(estimator=stage, estimatorParamMaps=grid, evaluator=BlockEvaluator(metric="f1_macro"),
                          numFolds=2, foldCol="fold").fit(data)
    assert best.bestModel.getOrDefault("vocab_size") == 50 and best.avgMetrics[0] > 0.9
    with pytest.raises(ValueError):
        BlockEvaluator(metric="none").evaluate(best.transform(data))


def test_splits_equal_each_alone(spark):
    data = blocks(spark)
    train, test = data.where("page_id > 1"), data.where("page_id <= 1")
    model = BlockLabeler().fit(train)
    got = {r["metric"]: r["value"] for r in model.evaluate_splits({"train_": train, "test": test}).collect()}
    for name, part in (("train_", train), ("test", test)):
        for r in model.evaluate(part, name).collect():
            assert got.pop(r["metric"]) == r["value"]
    assert not got


def test_gold_of_a_hot_document(spark):
    from contentmark.sources import gold as G
    n = 1500
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.format_string(
        "http://x.example/en/%d", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") + 100)).alias("url"))
    docs = spark.createDataFrame([(7, "one\n\ntwo\nthree"), (101, "four"), (5, "unused")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in G.gold_for_pages(pages, docs).collect())
    want = [(p, k, t) for p in range(0, n, 2) for k, t in ((0, "one"), (2, "two"), (3, "three"))] + [(1, 0, "four")]
    assert got == sorted(want)
    pairs = G.page_source_doc(pages)
    hot = [tuple(r) for r in G.hot_documents(pairs).collect()]
    assert hot == [(7, -(-n // 2 // G.HOT_PAGES))]
    sizes = [r["n"] for r in pairs.where("doc_id = 7").groupBy(
        F.pmod(F.xxhash64("page_id"), F.lit(hot[0][1])).alias("salt")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == hot[0][1] and max(sizes) < 2 * G.HOT_PAGES
    empty = pages.where("page_id < 0")
    assert G.gold_for_pages(empty, docs).count() == 0

"""Decoding and loss against brute force (FIXTURES.md section 6)."""

import itertools
import math
import random

from contentmark.operators import blocks as B
from contentmark.operators import model as M


def _trans(spark, t, start=(0.0, 0.0), end=(0.0, 0.0)):
    rows = [("trans", f, to, t[f][to]) for f in range(2) for to in range(2)]
    rows += [("start", None, k, start[k]) for k in range(2)] + [("end", None, k, end[k]) for k in range(2)]
    return spark.createDataFrame(rows, "kind string, from_label int, to_label int, score double")


def _score(em, path, t, start, end):
    s = start[path[0]] + em[0][path[0]] + end[path[-1]]
    for i in range(1, len(path)):
        s += t[path[i - 1]][path[i]] + em[i][path[i]]
    return s


def test_decode_fixture(spark):
    em = [[0.9, 0.1], [0.2, 0.8], [0.6, 0.5]]
    t = [[0.5, -0.5], [-0.2, 0.6]]
    s = spark.createDataFrame([(0, em)], "id int, em array<array<double>>")
    r = M.decode(s, _trans(spark, t)).first()
    assert r["prediction"] == [0, 0, 0]
    assert abs(r["path_score"] - 2.7) < 1e-9


def test_decode_and_nll_brute_force(spark):
    rnd = random.Random(7)
    cases = []
    for k in range(25):
        n = rnd.randint(1, 6)
        cases.append((k, [[rnd.uniform(-2, 2), rnd.uniform(-2, 2)] for _ in range(n)],
                      [rnd.randint(0, 1) for _ in range(n)]))
    t = [[rnd.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
    start, end = (rnd.uniform(-1, 1), rnd.uniform(-1, 1)), (rnd.uniform(-1, 1), rnd.uniform(-1, 1))
    tr = _trans(spark, t, start, end)
    df = spark.createDataFrame(cases, "id int, em array<array<double>>, label array<int>")
    dec = {r["id"]: r["prediction"] for r in M.decode(df, tr).collect()}
    nll = {r["id"]: r["nll"] for r in M.sequence_nll(df, tr).collect()}
    for k, em, y in cases:
        paths = list(itertools.product((0, 1), repeat=len(em)))
        scores = [_score(em, p, t, start, end) for p in paths]
        best = max(scores)
        assert abs(_score(em, dec[k], t, start, end) - best) < 1e-9
        log_z = math.log(sum(math.exp(s) for s in scores))
        assert abs(nll[k] - (log_z - _score(em, y, t, start, end))) < 1e-9


def test_pairs_use_real_blocks_only(spark):
    from contentmark.operators import evaluate as E
    s = spark.createDataFrame([([1, 0, 1, 0], [1, 1, 0, 0], [1, 1, 1, 0]), ([0, 0], [0, 1], [1, 0])],
                              "label array<int>, prediction array<int>, mask array<int>")
    got = sorted(tuple(r) for r in E.pairs(s).collect())
    assert got == sorted([(1, 1), (0, 1), (1, 0), (0, 0)])
    m = {r["metric"]: r["value"] for r in E.metrics(E.pairs(s), "val_").collect()}
    assert abs(m["val_precision_micro"] - 0.5) < 1e-12 and abs(m["val_f1_macro"] - 0.5) < 1e-12
    rep = {r["row"]: r for r in E.report(E.pairs(s)).collect()}
    assert rep["accuracy"]["support"] == 4 and rep["accuracy"]["precision"] is None


def test_class_weighted_emissions(spark):
    from contentmark.operators import model as M
    b = spark.createDataFrame([(0, 0, 0, [0, 5, 2], 1), (0, 0, 1, [0, 6, 2], 0), (0, 0, 2, [0, 6, 2], 0)],
                              "page_id int, part int, pos int, text_ids array<int>, label int")
    plain = M.fit_emissions(b, 10).where(f"id = {M.PRIOR}").first()
    w = M.class_weights(b)
    weighted = M.fit_emissions(b, 10, weights=w).where(f"id = {M.PRIOR}").first()
    # balanced weights equalise the class priors
    assert abs(weighted["s0"] - weighted["s1"]) < 1e-9 and abs(plain["s0"] - plain["s1"]) > 0.1


def test_masked_pooling(spark):
    from contentmark.operators import vectors as V
    rows = [("a", 0, [1.0, 2.0], 1), ("a", 1, [3.0, -4.0], 1), ("a", 2, [100.0, 100.0], 0),
            ("b", 0, [5.0, 5.0], 0)]
    t = spark.createDataFrame(rows, "k string, pos int, vec array<double>, m int")
    mean = {r["k"]: r["pooled"] for r in V.pool(t, "k", "vec", "mean", mask="m").collect()}
    mx = {r["k"]: r["pooled"] for r in V.pool(t, "k", "vec", "max", mask="m").collect()}
    first = {r["k"]: r["pooled"] for r in V.pool(t, "k", "vec", "first", order="pos").collect()}
    assert mean == {"a": [2.0, -1.0], "b": [0.0, 0.0]}          # all-pad -> clamp -> zeros
    assert mx == {"a": [3.0, 2.0], "b": [-1e9, -1e9]}           # pads count as -1e9
    assert first == {"a": [1.0, 2.0], "b": [5.0, 5.0]}
    c = t.groupBy("k").agg(__import__("pyspark.sql.functions", fromlist=["F"]).first("vec").alias("v"))
    r = c.select(V.combine(["v", "v", "v"], "mean").alias("x"), V.combine(["v", "v"], "concat").alias("y")).first()
    assert len(r["y"]) == 2 * len(r["x"])


def test_one_class_training_never_predicts_the_other(spark):
    rows = [(1, 0, k, [0, 10 + k, 11 + k, 2], 0) for k in range(4)]
    b = spark.createDataFrame(rows, "page_id bigint, part int, pos int, text_ids array<int>, label int")
    em = M.score(b, M.fit_emissions(b, 20))
    assert all(r["em"][0] > r["em"][1] for r in em.collect())
    d = M.decode(B.fold(em.select("page_id", "part", "pos", "em")), M.fit_transitions(b)).first()
    assert d["prediction"] == [0, 0, 0, 0]

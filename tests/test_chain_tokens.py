"""Chain products and token scores against plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from contentmark.operators import blocks as B
from contentmark.operators import chain as C
from contentmark.operators import model as M
from contentmark.operators import tokenscore as TS


def chain_table(spark, t, start, end):
    rows = [("trans", f, to, t[f][to]) for f in range(2) for to in range(2)]
    rows += [("start", None, k, start[k]) for k in range(2)] + [("end", None, k, end[k]) for k in range(2)]
    return spark.createDataFrame(rows, "kind string, from_label int, to_label int, score double")


@pytest.mark.parametrize("fan, longest", [(128, None), (2, None), (3, 9)])
def test_decode_and_loss_match_all_paths(spark, fan, longest):
    rng = random.Random(fan)
    t = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
    start, end = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
    parts = {(p, q): [([rng.uniform(-2, 2), rng.uniform(-2, 2)], rng.randint(0, 1)) for _ in range(rng.randint(1, 9))]
             for p in range(8) for q in range(2)}
    rows = [(p, q, k, em, y) for (p, q), part in parts.items() for k, (em, y) in enumerate(part)]
    df = spark.createDataFrame(rows, "page_id bigint, part int, pos int, em array<double>, label int")
    tr = chain_table(spark, t, start, end)
    got = {}
    for r in C.decode_blocks(df, tr, longest=longest, fan=fan).orderBy("pos").collect():
        got.setdefault((r["page_id"], r["part"]), []).append(r["prediction"])
    loss = {(r["page_id"], r["part"]): (r["nll"], r["n"]) for r in C.chain_loss(df, tr, longest=longest, fan=fan).collect()}

    def score(part, path):
        s = start[path[0]] + end[path[-1]] + sum(em[y] for (em, _), y in zip(part, path))
        return s + sum(t[a][b] for a, b in itertools.pairwise(path))
    for key, part in parts.items():
        scores = {p: score(part, p) for p in itertools.product((0, 1), repeat=len(part))}
        assert abs(scores[tuple(got[key])] - max(scores.values())) < 1e-9
        nll = math.log(sum(map(math.exp, scores.values()))) - scores[tuple(y for _, y in part)]
        assert abs(loss[key][0] - nll) < 1e-9 and loss[key][1] == len(part)


def test_a_long_part_is_decoded_like_a_plain_viterbi(spark):
    n = 5000
    em = [[math.sin(k * 0.7) * 2, math.cos(k * 1.3) * 2] for k in range(n)]
    t = [[0.6, -0.6], [-0.4, 0.5]]
    df = spark.createDataFrame([(1, 0, k, e) for k, e in enumerate(em)], "page_id int, part int, pos int, em array<double>")
    got = [r[0] for r in C.decode_blocks(df, chain_table(spark, t, (0.0, 0.0), (0.0, 0.0)), fan=16).orderBy("pos").select("prediction").collect()]
    best, back = list(em[0]), []
    for e in em[1:]:
        back.append([0 if best[0] + t[0][j] >= best[1] + t[1][j] else 1 for j in range(2)])
        best = [max(best[0] + t[0][j], best[1] + t[1][j]) + e[j] for j in range(2)]
    path = [0 if best[0] >= best[1] else 1]
    for b in back[::-1]:
        path.append(b[path[-1]])
    assert got == path[::-1]


def token_blocks(spark, n=60):
    rng = random.Random(4)
    words = ["the"] * 40 + [f"w{k}" for k in range(30)] + ["Élan", "x!"]
    rows = [(k // 5, 0, k % 5, ["c"], ["body", "p"], [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))],
             rng.randint(0, 1)) for k in range(n)]
    return spark.createDataFrame(rows, "page_id bigint, part int, pos int, class_seq array<string>, "
                                       "tag_seq array<string>, text_seq array<string>, label int")


@pytest.mark.parametrize("size, length", [(None, None), (12, None), (None, 6), (9, 5)])
def test_token_scores_are_those_of_ids(spark, monkeypatch, size, length):
    monkeypatch.setattr(TS, "HOT", 10)   # some tokens are hot, some are not
    blocks = token_blocks(spark)
    vocab = B.fit_vocab(blocks, size)
    ids = B.encode(blocks, vocab, length)
    w = M.class_weights(blocks)
    want = {tuple(r)[:3]: r["em"] for r in M.score(ids, M.fit_emissions(ids, vocab.count(), weights=w)).select(
        "page_id", "part", "pos", "em").collect()}
    model = TS.fit_token_scores(blocks, max_size=size, max_length=length, weights=w)
    got = {tuple(r)[:3]: r["em"] for r in TS.score_tokens(blocks, model, length).select(
        "page_id", "part", "pos", "em").collect()}
    assert set(got) == set(want)
    assert all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k]))


def test_unseen_tokens_and_empty_blocks(spark):
    blocks = token_blocks(spark)
    model = TS.fit_token_scores(blocks)
    rest = model.where(F.col("kind") == "rest").first()
    prior = model.where(F.col("kind") == "prior").first()
    new = blocks.limit(2).withColumn("text_seq", F.when(F.col("pos") == 0, F.array(F.lit("zzz zzz"))).otherwise(
        F.array().cast("array<string>")))
    got = {r["pos"]: r["em"] for r in TS.score_tokens(new, model).collect()}
    assert got[0] == pytest.approx([prior["s0"] + 2 * rest["s0"], prior["s1"] + 2 * rest["s1"]])
    assert got[1] == pytest.approx([prior["s0"], prior["s1"]])
    assert TS.score_tokens(blocks.limit(0), model).count() == 0

"""M2 straight from tokens: naive-Bayes emissions without id arrays.

Fitting counts tokens once.  Scoring joins token rows with log-probabilities
and sums them per block: tokens that make up over ``1 / HOT`` of the training text
(fewer than ``HOT`` of them, whatever the data) are broadcast and summed where
the text is read, and only the rest, none of them hot, is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentmark.operators.blocks import SEQ_COLS, _seq_string, tokenize
from contentmark.operators.model import ABSENT, N_CLASSES
from contentmark.session import materialize

HOT = 2000
SPECIALS = 4        # special ids count as part of the vocabulary
KEYS = ("page_id", "part", "pos")
TOKEN, PRIOR, REST = "token", "prior", "rest"


def _kept(max_length: int | None, place: Column) -> Column:
    """Is the token inside a sequence cut to ``max_length`` ids (begin and end included)?"""
    return F.lit(True) if max_length is None else place < max_length - 2


def fit_token_scores(blocks: DataFrame, label: str = "label", max_size: int | None = None,
                     max_length: int | None = None, weights: DataFrame | None = None) -> DataFrame:
    """M2 (fit): (kind, token, n, s0, s1) - the log-probability of each token of
    the vocabulary in both classes, add-one smoothed, a row ``prior`` with the
    class scores (scaled by ``weights``: label, weight) and a row ``rest`` for all
    other tokens.  The vocabulary is taken from all three sequences, the
    counts from the text.  A class without blocks is never chosen.  Totals of
    the two classes are all that passes through the driver."""
    seqs = F.array(*[F.struct(F.lit(c == "text_seq").alias("own"), _seq_string(blocks, c).alias("s")) for c in SEQ_COLS])
    toks = (blocks.select(F.col(label).alias("y"), F.inline(seqs))
            .select("y", "own", F.posexplode(tokenize("s")).alias("k", "token")))
    mine = F.col("own") & _kept(max_length, F.col("k"))
    counts = materialize(toks.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"), *[
        F.sum((mine & (F.col("y") == c)).cast("bigint")).alias(f"c{c}") for c in range(N_CLASSES)]), "token-counts")
    total = counts.agg(F.count(F.lit(1)).alias("size"), *[
        F.coalesce(F.sum(f"c{c}"), F.lit(0)).alias(f"c{c}") for c in range(N_CLASSES)]).first()
    known, size, out = counts, total["size"], [0] * N_CLASSES
    if max_size is not None:
        known = materialize(counts.orderBy(F.desc("cnt"), "token").limit(max_size), "vocab")
        size = min(size, max_size)
        held = known.agg(*[F.coalesce(F.sum(f"c{c}"), F.lit(0)) for c in range(N_CLASSES)]).first()
        out = [total[f"c{c}"] - held[c] for c in range(N_CLASSES)]
    n_doc = blocks.agg(*[F.coalesce(F.sum((F.col(label) == c).cast("bigint")), F.lit(0)) for c in range(N_CLASSES)]).first()
    scale = {r["label"]: r["weight"] for r in weights.collect()} if weights is not None else {}
    whole = [total[f"c{c}"] + size + SPECIALS for c in range(N_CLASSES)]
    prior = [math.log(n / sum(n_doc)) + math.log(scale.get(c, 1.0)) if n else ABSENT for c, n in enumerate(n_doc)]
    rest = [math.log((out[c] + 1.0) / whole[c]) for c in range(N_CLASSES)]
    rows = known.select(F.lit(TOKEN).alias("kind"), "token", (F.col("c0") + F.col("c1")).alias("n"), *[
        F.log((F.col(f"c{c}") + 1.0) / F.lit(float(whole[c]))).alias(f"s{c}") for c in range(N_CLASSES)])
    n = total["c0"] + total["c1"]
    special = blocks.sparkSession.createDataFrame([(PRIOR, None, n, *prior), (REST, None, n, *rest)],
                                                  "kind string, token string, n bigint, s0 double, s1 double")
    return materialize(rows.unionByName(special), "emissions")


def score_tokens(blocks: DataFrame, model: DataFrame, max_length: int | None = None, keys=KEYS,
                 carry=("label",)) -> DataFrame:
    """M2 (apply): (keys, carry, em) - ``em`` = [score(class 0), score(class 1)] of
    every block, blocks without text included."""
    keys, carry = list(keys), [c for c in carry if c in blocks.columns]
    fixed = {r["kind"]: r for r in model.where(F.col("kind") != TOKEN).collect()}   # two rows
    table = model.where(F.col("kind") == TOKEN)
    is_hot = F.col("n") * HOT > fixed[REST]["n"]
    scores = [f"s{c}" for c in range(N_CLASSES)]
    hot = F.broadcast(table.where(is_hot).select("token", *scores))
    toks = (blocks.select(*keys, F.posexplode(tokenize(_seq_string(blocks, "text_seq"))).alias("k", "token"))
            .where(_kept(max_length, F.col("k"))).select(*keys, "token"))
    none = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in carry]
    often = toks.join(hot, "token").groupBy(*keys).agg(*[F.sum(s).alias(s) for s in scores])
    seldom = toks.join(hot, "token", "left_anti").join(table.where(~is_hot).select("token", *scores), "token", "left")
    seldom = seldom.select(*keys, *[F.coalesce(s, F.lit(fixed[REST][s])).alias(s) for s in scores])
    base = blocks.select(*keys, *carry, *[F.lit(fixed[PRIOR][s]).alias(s) for s in scores])
    parts = base.unionAll(often.select(*keys, *none, *scores)).unionAll(seldom.select(*keys, *none, *scores))
    return parts.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carry], F.array(*[F.sum(s) for s in scores]).alias("em"))

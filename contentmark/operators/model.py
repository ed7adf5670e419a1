"""M1-M5: class weights, emission and transition scores, decoding, loss.

The block-sequence labeller keeps the reference's shape - per-block emission
scores plus a two-state chain decoded per sample - with every part a Spark
job: counts are partial aggregates, per-sample decoding is a higher-order
``aggregate`` over the sample's arrays (samples are bounded by
``split_parts``), and model tables small by construction (vocabulary-sized)
travel as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentmark.schema import BOS, EOS, PAD
from contentmark.session import materialize

N_CLASSES = 2


def class_weights(labels: DataFrame, label: str = "label", n_classes: int | None = None) -> DataFrame:
    """M1: balanced weights n / (n_classes * n_c) over the classes present:
    (label, n, weight)."""
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy()
    total = F.sum("n").over(w)
    k = F.lit(n_classes) if n_classes else F.count(F.lit(1)).over(w)
    return counts.select(F.col(label).alias("label"), "n", (total / (k * F.col("n"))).alias("weight"))


def padded_labels(samples: DataFrame, label: str = "label") -> DataFrame:
    """Label rows of padded samples (padding counts as class 0, the
    reference's ``include_padding`` behaviour)."""
    return samples.select(F.explode(label).alias("label"))


# --- M2: emissions -----------------------------------------------------------------

def _real_ids(ids="text_ids") -> Column:
    return F.filter(F.col(ids), lambda i: ~i.isin(BOS, EOS, PAD))


PRIOR, REST = -1, -2   # ids of the model rows that hold class-wide scores
ABSENT = -1e9          # score of a class without training blocks


def fit_emissions(blocks: DataFrame, vocab_size: int, label: str = "label",
                  ids: str = "text_ids", weights: DataFrame | None = None) -> DataFrame:
    """M2 (fit): multinomial naive Bayes over the block's token ids, add-one
    smoothed: one row per seen id with its log-probability in both classes
    (``s0``, ``s1``), a row PRIOR with the class scores and a row REST for ids
    never seen.  ``weights`` (label, weight) scales the classes.  A class
    without blocks is never chosen.  The counts of a class are the only values
    that pass through the driver."""
    import math
    toks = blocks.select(F.col(label).alias("y"), F.explode(_real_ids(ids)).alias("id"))
    counts = toks.groupBy("id").agg(*[F.sum((F.col("y") == k).cast("bigint")).alias(f"c{k}")
                                      for k in range(N_CLASSES)])
    counts = materialize(counts, "id-counts")
    n_tok = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(N_CLASSES)]).first()
    n_doc = blocks.agg(*[F.coalesce(F.sum((F.col(label) == k).cast("bigint")), F.lit(0))
                         for k in range(N_CLASSES)]).first()
    scale = {r["label"]: r["weight"] for r in weights.collect()} if weights is not None else {}
    size = vocab_size + 4
    prior = [math.log(n / sum(n_doc)) + math.log(scale.get(k, 1.0)) if n else ABSENT
             for k, n in enumerate(n_doc)]
    rest = [-math.log(n + size) for n in n_tok]
    rows = counts.select(F.col("id").cast("bigint").alias("id"), *[
        F.log((F.col(f"c{k}") + 1.0) / F.lit(float(n_tok[k] + size))).alias(f"s{k}") for k in range(N_CLASSES)])
    special = blocks.sparkSession.createDataFrame([(PRIOR, *prior), (REST, *rest)],
                                                  "id bigint, s0 double, s1 double")
    return materialize(rows.unionByName(special), "emissions")


def score(blocks: DataFrame, model: DataFrame, ids: str = "text_ids",
          keys=("page_id", "part", "pos")) -> DataFrame:
    """M2 (apply): ``em`` = [score(class 0), score(class 1)] per block: token
    rows are joined with the model and summed per block."""
    keys = list(keys)
    fixed = {r["id"]: (r["s0"], r["s1"]) for r in model.where("id < 0").collect()}   # two rows
    known = model.where("id >= 0").select(F.col("id").alias("_id"), "s0", "s1")
    toks = blocks.select(*keys, F.explode(_real_ids(ids)).alias("_tok"))
    sums = (toks.join(known, F.col("_tok") == F.col("_id"), "left")
            .groupBy(*keys).agg(*[F.sum(F.coalesce(f"s{k}", F.lit(fixed[REST][k]))).alias(f"_s{k}")
                                  for k in range(N_CLASSES)]))
    em = F.array(*[F.lit(fixed[PRIOR][k]) + F.coalesce(f"_s{k}", F.lit(0.0)) for k in range(N_CLASSES)])
    return (blocks.join(sums, keys, "left").withColumn("em", em)
            .drop(*[f"_s{k}" for k in range(N_CLASSES)]))


# --- M3: transitions ----------------------------------------------------------------

def fit_transitions(blocks: DataFrame, label: str = "label", keys=("page_id", "part"),
                    order: str = "pos") -> DataFrame:
    """M3: log-probability chain scores from label counts, add-one smoothed:
    (kind, from_label, to_label, score) with kind in start / trans / end.

    One window pass tags each block with its successor; every block emits
    its events (a transition, a start, an end) and a single partial
    aggregate counts them all."""
    w = W.partitionBy(*keys).orderBy(order)
    b = (blocks.select(*keys, order, F.col(label).cast("int").alias("y"))
         .withColumn("nxt", F.lead("y").over(w))
         .withColumn("first", F.row_number().over(w) == 1))
    none = F.lit(-1)  # "from" of start / end events (a null key would not join)
    events = F.filter(F.array(
        F.when(F.col("nxt").isNotNull(), F.struct(F.lit("trans").alias("kind"), F.col("y").alias("f"),
                                                  F.col("nxt").alias("t"))),
        F.when(F.col("first"), F.struct(F.lit("start").alias("kind"), none.alias("f"), F.col("y").alias("t"))),
        F.when(F.col("nxt").isNull(), F.struct(F.lit("end").alias("kind"), none.alias("f"),
                                               F.col("y").alias("t")))), lambda e: e.isNotNull())
    counts = (b.select(F.inline(events)).groupBy("kind", "f", "t").agg(F.count(F.lit(1)).alias("c")))
    # full grid of the 8 scores (missing counts are 0), as a tiny constant table
    spark = blocks.sparkSession
    grid = spark.range(N_CLASSES * N_CLASSES).select(
        F.lit("trans").alias("kind"), (F.col("id") / N_CLASSES).cast("int").alias("f"),
        (F.col("id") % N_CLASSES).cast("int").alias("t"))
    for kind in ("start", "end"):
        grid = grid.unionByName(spark.range(N_CLASSES).select(
            F.lit(kind).alias("kind"), none.alias("f"), F.col("id").cast("int").alias("t")))
    j = grid.join(counts, ["kind", "f", "t"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    # trans rows normalise per from-label, start / end rows per kind
    grp = F.when(F.col("kind") == "trans", F.col("f").cast("string")).otherwise(F.col("kind"))
    j = j.withColumn("_g", grp)
    score = F.log((F.col("c") + 1.0) / (F.sum("c").over(W.partitionBy("kind", "_g")) + N_CLASSES))
    return materialize(j.select(
        "kind", F.when(F.col("kind") == "trans", F.col("f")).cast("int").alias("from_label"),
        F.col("t").alias("to_label"), score.alias("score")))


def transition_scalars(trans: DataFrame) -> dict:
    """The 8 chain scores of a fitted chain as literal parameters (a fitted
    model's parameters live with the driver, as for MLlib models): t<from><to>,
    s<label> (start), e<label> (end)."""
    out = {}
    for r in trans.collect():  # exactly 8 rows
        if r["kind"] == "trans":
            out[f"t{r['from_label']}{r['to_label']}"] = F.lit(float(r["score"]))
        else:
            out[f"{r['kind'][0]}{r['to_label']}"] = F.lit(float(r["score"]))
    return out


# --- M4, M5: decode and loss ---------------------------------------------------------

def _bind(samples: DataFrame, trans: DataFrame) -> DataFrame:
    for k, v in transition_scalars(trans).items():
        samples = samples.withColumn(f"_{k}", v)
    return samples


def _drop_bound(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c[:2] in ("_t", "_s", "_e") and len(c) in (3, 4)])


def decode(samples: DataFrame, trans: DataFrame, em: str = "em", out: str = "prediction") -> DataFrame:
    """M4: best label path per sample (two-state Viterbi) as an ``aggregate``
    over the emission array; ties go to the lower label."""
    s = _bind(samples, trans)
    T = {k: F.col(f"_{k}") for k in ("t00", "t01", "t10", "t11", "s0", "s1", "e0", "e1")}
    first = F.try_element_at(F.col(em), F.lit(1))
    init = F.struct((T["s0"] + first[0]).alias("a"), (T["s1"] + first[1]).alias("b"),
                    F.array(F.lit(0)).alias("pa"), F.array(F.lit(1)).alias("pb"))

    def step(acc, e):
        a0, b0 = acc["a"] + T["t00"], acc["b"] + T["t10"]
        a1, b1 = acc["a"] + T["t01"], acc["b"] + T["t11"]
        return F.struct(
            (F.greatest(a0, b0) + e[0]).alias("a"), (F.greatest(a1, b1) + e[1]).alias("b"),
            F.when(a0 >= b0, F.concat(acc["pa"], F.array(F.lit(0))))
             .otherwise(F.concat(acc["pb"], F.array(F.lit(0)))).alias("pa"),
            F.when(a1 >= b1, F.concat(acc["pa"], F.array(F.lit(1))))
             .otherwise(F.concat(acc["pb"], F.array(F.lit(1)))).alias("pb"))

    rest = F.slice(F.col(em), 2, F.greatest(F.size(em) - 1, F.lit(0)))
    fin = F.aggregate(rest, init, step)
    best = F.when(fin["a"] + T["e0"] >= fin["b"] + T["e1"], fin["pa"]).otherwise(fin["pb"])
    score = F.greatest(fin["a"] + T["e0"], fin["b"] + T["e1"])
    res = s.withColumn(out, F.when(F.size(em) > 0, best).otherwise(F.array().cast("array<int>"))) \
           .withColumn("path_score", score)
    return _drop_bound(res)


def _lse(x: Column, y: Column) -> Column:
    m = F.greatest(x, y)
    return m + F.log(F.exp(x - m) + F.exp(y - m))


def sequence_nll(samples: DataFrame, trans: DataFrame, em: str = "em",
                 label: str = "label") -> DataFrame:
    """M5: per-sample negative log-likelihood of the gold label path under
    the chain (forward algorithm in log space) and its length."""
    s = _bind(samples, trans)
    T = {k: F.col(f"_{k}") for k in ("t00", "t01", "t10", "t11", "s0", "s1", "e0", "e1")}
    first = F.try_element_at(F.col(em), F.lit(1))
    init = F.struct((T["s0"] + first[0]).alias("a"), (T["s1"] + first[1]).alias("b"))

    def fwd(acc, e):
        return F.struct((_lse(acc["a"] + T["t00"], acc["b"] + T["t10"]) + e[0]).alias("a"),
                        (_lse(acc["a"] + T["t01"], acc["b"] + T["t11"]) + e[1]).alias("b"))

    rest = F.slice(F.col(em), 2, F.greatest(F.size(em) - 1, F.lit(0)))
    fin = F.aggregate(rest, init, fwd)
    log_z = _lse(fin["a"] + T["e0"], fin["b"] + T["e1"])
    y = F.col(label)
    gold = F.aggregate(
        F.sequence(F.lit(1), F.size(em)), F.lit(0.0),
        lambda acc, i: acc + F.element_at(F.element_at(F.col(em), i), F.element_at(y, i) + 1)
        + F.when(i > 1, F.when(F.element_at(y, i - 1) == 0,
                               F.when(F.element_at(y, i) == 0, T["t00"]).otherwise(T["t01"]))
                 .otherwise(F.when(F.element_at(y, i) == 0, T["t10"]).otherwise(T["t11"])))
        .otherwise(F.when(F.element_at(y, 1) == 0, T["s0"]).otherwise(T["s1"])))
    gold = gold + F.when(F.element_at(y, -1) == 0, T["e0"]).otherwise(T["e1"])
    res = s.withColumn("nll", log_z - gold).withColumn("n", F.size(em))
    return _drop_bound(res)


def sequence_loss(samples: DataFrame, trans: DataFrame, em: str = "em",
                  label: str = "label") -> DataFrame:
    """M5: token-mean negative log-likelihood over all samples (one row)."""
    per = sequence_nll(samples, trans, em, label)
    return per.agg((F.sum("nll") / F.sum("n")).alias("loss"), F.sum("n").alias("n_blocks"))

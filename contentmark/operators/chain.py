"""M4, M5: decoding and likelihood of a two-state chain over parts of any length.

A block is a 2 x 2 matrix (score of going from state i to state j and emitting
there).  Matrices multiply associatively - (max, +) for the best path, (log-sum,
+) for the likelihood - so a part is folded as a tree: ``fan`` blocks to one
matrix, ``fan`` of those to the next, until one is left.  Decoding walks
down again: with the states at both ends of a node known, a small best-path pass
over its at most ``fan`` children gives the states between them.  No row ever holds
more than ``fan`` children, and a very long part is many tasks.

Blocks are rows (keys, ``order`` = 0, 1, 2 .. in each part, ``em``); ties go to
the lower label, from the end of a part backwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentmark.operators.model import _lse, transition_scalars
from contentmark.session import materialize

FAN = 128
KEYS = ("page_id", "part")


def _blocks(scored: DataFrame, scores: dict, keys: list, order: str, em: str) -> DataFrame:
    """(keys, idx, m): the matrix of each block; the first holds the start scores."""
    first = F.col(order) == 0
    t = [F.when(first, scores[f"s{j}"]).otherwise(scores[f"t{i}{j}"]).alias(f"t{i}{j}") for i in range(2) for j in range(2)]
    e = [F.col(em)[j].alias(f"e{j}") for j in range(2)]
    return scored.select(*keys, F.col(order).cast("bigint").alias("idx"), F.struct(*t, *e).alias("m"))


def _product(ms: Column, add) -> Column:
    """The product of a node's matrices, in order."""
    def go(a: Column, b: Column, m: Column, j: int) -> Column:
        return add(a + m[f"t0{j}"], b + m[f"t1{j}"]) + m[f"e{j}"]
    head = F.element_at(ms, 1)["m"]
    init = F.struct(*[(head[f"t{i}{j}"] + head[f"e{j}"]).alias(f"t{i}{j}") for i in range(2) for j in range(2)])
    out = F.aggregate(F.slice(ms, 2, F.size(ms)), init, lambda acc, x: F.struct(*[
        go(acc[f"t{i}0"], acc[f"t{i}1"], x["m"], j).alias(f"t{i}{j}") for i in range(2) for j in range(2)]))
    return F.struct(*[out[f"t{i}{j}"].alias(f"t{i}{j}") for i in range(2) for j in range(2)],
                    F.lit(0.0).alias("e0"), F.lit(0.0).alias("e1"))


def _tree(rows: DataFrame, keys: list, add, longest: int | None, fan: int) -> list[DataFrame]:
    """Levels (keys, g, ms, m) from the blocks up to one node per part."""
    if longest is None:
        rows = materialize(rows, "chain")
        longest = (rows.agg(F.max("idx")).first()[0] or 0) + 1
    levels = []
    while True:
        node = rows.groupBy(*keys, F.floor(F.col("idx") / fan).alias("g")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "m"))).alias("ms"))
        node = node.withColumn("m", _product(F.col("ms"), add))
        longest = -(-longest // fan)
        if longest > 1:
            node = materialize(node, "chain")
        levels.append(node)
        if longest <= 1:
            return levels
        rows = node.select(*keys, F.col("g").alias("idx"), "m")


def _states(ms: Column, start: Column, end: Column) -> Column:
    """The best states after each of a node's children, from ``start`` to ``end``."""
    head = F.element_at(ms, 1)["m"]
    init = F.struct(*[(F.when(start == 0, head[f"t0{j}"]).otherwise(head[f"t1{j}"]) + head[f"e{j}"]).alias(n)
                      for j, n in enumerate("ab")],
                    F.array(F.lit(0)).alias("pa"), F.array(F.lit(1)).alias("pb"))

    def step(acc: Column, x: Column) -> Column:
        m = x["m"]
        a0, b0 = acc["a"] + m["t00"], acc["b"] + m["t10"]
        a1, b1 = acc["a"] + m["t01"], acc["b"] + m["t11"]
        return F.struct(
            (F.greatest(a0, b0) + m["e0"]).alias("a"), (F.greatest(a1, b1) + m["e1"]).alias("b"),
            F.concat(F.when(a0 >= b0, acc["pa"]).otherwise(acc["pb"]), F.array(F.lit(0))).alias("pa"),
            F.concat(F.when(a1 >= b1, acc["pa"]).otherwise(acc["pb"]), F.array(F.lit(1))).alias("pb"))
    out = F.aggregate(F.slice(ms, 2, F.size(ms)), init, step)
    return F.when(end == 0, out["pa"]).otherwise(out["pb"])


def decode_blocks(scored: DataFrame, trans: DataFrame, keys=KEYS, order: str = "pos", em: str = "em",
                  out: str = "prediction", longest: int | None = None, fan: int = FAN) -> DataFrame:
    """M4: (keys, order, ``out``) - the best label of every block.  ``longest`` is a
    known bound of the blocks of a part (measured if not given)."""
    keys, scores = list(keys), transition_scalars(trans)
    levels = _tree(_blocks(scored, scores, keys, order, em), keys, F.greatest, longest, fan)
    best = F.when(F.col("m.t00") + scores["e0"] >= F.col("m.t01") + scores["e1"], 0).otherwise(1)
    at = levels[-1].select(*keys, "ms", F.lit(0).alias("start"), best.alias("end"))
    for lower in [*levels[-2::-1], None]:
        at = at.withColumn("states", _states(F.col("ms"), F.col("start"), F.col("end")))
        before = F.concat(F.array("start"), F.col("states"))
        at = at.select(*keys, F.inline(F.transform("ms", lambda x, k: F.struct(
            x["idx"].alias("idx"), F.get(before, k).alias("start"), F.get(before, k + 1).alias("end")))))
        if lower is not None:
            at = at.join(lower.select(*keys, F.col("g").alias("idx"), "ms"), [*keys, "idx"])
    return at.select(*keys, F.col("idx").cast("int").alias(order), F.col("end").alias(out))


def chain_loss(scored: DataFrame, trans: DataFrame, keys=KEYS, order: str = "pos", em: str = "em",
               label: str = "label", longest: int | None = None, fan: int = FAN) -> DataFrame:
    """M5: (keys, nll, n) - negative log-likelihood of each part's gold labels and
    its number of blocks."""
    keys, scores = list(keys), transition_scalars(trans)
    top = _tree(_blocks(scored, scores, keys, order, em), keys, _lse, longest, fan)[-1]
    log_z = top.select(*keys, _lse(F.col("m.t00") + scores["e0"], F.col("m.t01") + scores["e1"]).alias("log_z"))
    along = Window.partitionBy(*keys).orderBy(order)
    y, last = F.col("y"), F.lag(label).over(along)

    def pick(name: str) -> Column:
        return F.when(y == 0, scores[f"{name}0"]).otherwise(scores[f"{name}1"])
    rows = scored.select(*keys, F.col(label).alias("y"), F.get(em, F.col(label).cast("int")).alias("e"),
                         last.alias("was"), (F.lead(label).over(along).isNull()).alias("ends"))
    step = F.when(F.col("was").isNull(), pick("s")).when(F.col("was") == 0, pick("t0")).otherwise(pick("t1"))
    gold = rows.groupBy(*keys).agg(
        F.sum(F.col("e") + step + F.when(F.col("ends"), pick("e")).otherwise(0.0)).alias("gold"),
        F.count(F.lit(1)).alias("n"))
    return gold.join(log_z, keys).select(*keys, (F.col("log_z") - F.col("gold")).alias("nll"), "n")

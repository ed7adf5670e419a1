"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear scorer by minimising
the non-negative unbiased risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

(Kiryo et al. 2017) with the logistic loss; when the bracket is negative, the
step goes against it.  The class prior is estimated from the
positives and the unlabelled rows by the best-bin rule: a first classifier
orders both, and the prior is the smallest ratio of their upper shares, with a
margin for the sample size.

Features come from the whole text: shares of letters, capitals, digits, symbols and
punctuation, word-length and line statistics, repetition (share of distinct
words, compression by repeated 3-word windows), all independent of the
language, and no id, label, language or source.

Bounded part: the fit uses at most ``MAX_POSITIVE`` positives and
``MAX_UNLABELLED`` unlabelled rows, those with the smallest seeded digests; each
is ``len(FEATURES)`` numbers.  Scoring reads every text.

Defined cases: null text equals the empty text and gets a score like any
other; a training set without positives gives every row the score 0.5; repeated
rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_POSITIVE, MAX_UNLABELLED = 6000, 12000
STEPS, RATE, L2 = 600, 0.05, 1e-4
FEATURES = ("letters", "capitals", "digits", "marks", "stops", "excl", "bars", "word_len", "word_len_spread",
            "short", "distinct", "windows", "same_next", "lines", "line_dup", "log_words", "caps_words",
            "symbol_words", "plain_words", "empty")


class _Kinds(dict):
    """str.translate table: characters by kind, filled as they come."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c.isspace():
            kind = " "
        elif c.isalpha():
            kind = "A" if c != c.lower() else "a"
        elif c.isdigit():
            kind = "0"
        else:
            kind = "." if c in ".,;:?!'\"()-\u2019\u201c\u201d\u00ab\u00bb\u2013\u2014\u3002\u3001\u2026" else "#"
        self[code] = kind
        return kind


def features(text: str | None, kinds: dict) -> list[float]:
    """The feature vector of one whole text."""
    import math
    from collections import Counter

    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    lengths = list(map(len, words))
    chars = sum(lengths)
    mean = chars / n
    var = sum(x * x for x in lengths) / n - mean * mean
    windows = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 1
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    mapped = text.translate(kinds)
    upper, lower = mapped.count("A"), mapped.count("a")
    shapes = Counter(mapped.split())
    plain = sum(k for s, k in shapes.items() if s.rstrip(".").lower() == "a" * len(s.rstrip(".")) != ""
                and "A" not in s[1:])
    caps = sum(k for s, k in shapes.items() if "A" in s and "a" not in s and len(s) > 2)
    marked = sum(k for s, k in shapes.items() if "#" in s)
    return [(upper + lower) / chars, upper / chars, mapped.count("0") / chars, min(4.0, mapped.count("#") / n),
            min(2.0, (text.count(".") + text.count(",") + text.count("?")) / n),
            min(2.0, text.count("!") / n), min(2.0, text.count("|") / n),
            min(20.0, mean) / 10, min(10.0, math.sqrt(max(0.0, var))) / 10,
            sum(1 for x in lengths if x <= 3) / n, len(set(words)) / n ** 0.9, windows / max(1, n - 2),
            sum(1 for a, b in zip(words, words[1:]) if a == b) / n, min(2.0, 20 * len(lines) / n),
            1 - len(set(lines)) / max(1, len(lines)), math.log(n) / 10,
            caps / n, marked / n, plain / n, 0.0]


def _expand(x):
    import numpy as np
    return np.concatenate((x, x * x, np.ones((len(x), 1))), axis=1)


def _feature_rows(batches):
    import pyarrow as pa
    kinds = _Kinds()
    for batch in batches:
        rows = [features(t, kinds) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))],
                                         names=["id", "x"])


def _sample(docs: DataFrame, ids: DataFrame, most: int, seed: int):
    """Feature matrix of at most ``most`` documents among ``ids``, by the
    smallest digests (a bounded list of ids, so it may be broadcast)."""
    import numpy as np
    picked = (ids.where("id is not null").distinct()
              .orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(most))
    rows = (docs.join(F.broadcast(picked.withColumnRenamed("id", "pid")), F.col("id") == F.col("pid"),
                      "left_semi")
            .mapInArrow(_feature_rows, "id bigint, x array<double>")
            .groupBy("id").agg(F.min("x").alias("x")).collect())
    rows.sort(key=lambda r: r["id"])
    x = np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(FEATURES))
    return x[np.random.default_rng(seed).permutation(len(x))]   # halves are random, too


def _descend(value_grad, size: int):
    """Adam with fixed steps from zero."""
    import numpy as np
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        g = value_grad(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def _sigmoid(z):
    import numpy as np
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(p, u, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among the unlabelled rows (best-bin estimate):
    fit positive against unlabelled on one half, read the other half."""
    import numpy as np
    p1, p2, u1, u2 = p[::2], p[1::2], u[::2], u[1::2]
    if not len(p1) or not len(p2) or not len(u1) or not len(u2):
        return 0.5

    def grad(w):
        return (-(p1.T @ (1 - _sigmoid(p1 @ w))) / len(p1) + u1.T @ _sigmoid(u1 @ w) / len(u1)) / 2 + L2 * w
    w = _descend(grad, p.shape[1])
    sp, su = np.sort(p2 @ w), np.sort(u2 @ w)
    cut = sp[: max(1, int(0.99 * len(sp)))]
    qp = 1 - np.searchsorted(sp, cut) / len(sp)
    qu = 1 - np.searchsorted(su, cut) / len(su)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(sp)) + np.sqrt(np.log(4 / delta) / 2 / len(su))
    best = np.argmin(qu / qp + (1 + gamma) / qp * slack)
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


def fit(docs: DataFrame, positive_ids: DataFrame, unlabelled_ids: DataFrame, id_col: str = "doc_id",
        text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
        prior: float | None = None, seed: int = 42) -> dict:
    """The model: {"w", "mean", "scale", "prior"}; ``w`` is None without
    positives or unlabelled rows.  Both id tables have a column id."""
    import numpy as np
    t = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    p, u = _sample(t, positive_ids, max_positive, seed), _sample(t, unlabelled_ids, max_unlabelled, seed + 1)
    if not len(p) or not len(u):
        return {"w": None, "prior": prior}
    mean, scale = u.mean(axis=0), np.maximum(u.std(axis=0), 1e-6)
    p, u = (_expand(np.clip((x - mean) / scale, -5, 5)) for x in (p, u))
    prior = estimate_prior(p, u) if prior is None else prior

    def grad(w):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        up = -(p.T @ (1 - sp)) / len(p)            # gradient of R_P(+)
        down = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        excess = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        return (prior * up + down if excess >= 0 else -down) + L2 * w
    return {"w": _descend(grad, p.shape[1]), "mean": mean, "scale": scale, "prior": prior}


def score(model: dict, text: Column) -> Column:
    """Probability-like score of the positive class, from the whole text."""
    if model["w"] is None:
        return F.lit(0.5)

    @F.pandas_udf(T.DoubleType())
    def run(texts):
        import numpy as np
        import pandas as pd
        kinds = _Kinds()
        x = np.array([features(t, kinds) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        x = _expand(np.clip((x - model["mean"]) / model["scale"], -5, 5))
        # a matrix product sums a row in an order that depends on its place in the batch
        return pd.Series(_sigmoid((x * model["w"]).sum(axis=1)))
    return run(text.cast("string"))

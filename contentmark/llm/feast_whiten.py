"""Embedding whitening by FEAST contour integration.

The covariance of the fit list is summed in tasks; what follows works on one
d x d matrix (its size is set by the vector length, not by the rows).

* Inertia counts (signs of the pivots of a symmetric factorisation of V - s I)
  give the number of eigenvalues above any s.  Bisection on them brackets the
  wanted eigenvalues and cuts the bracket into intervals of few eigenvalues,
  with ends in gaps.
* Each interval is a circle in the complex plane.  Gauss-Legendre quadrature of
  (z I - V)^-1 Y over its nodes, one Spark task each, projects a random block Y
  onto the interval's eigenvectors; Rayleigh-Ritz on the projected block gives
  the pairs, and the step is repeated with them until residuals vanish.
* An interval is done only when the pairs inside are as many as the
  inertia counts say, so none is missed; otherwise the block grows.

Rows are then projected on sqrt-scaled components in tasks.

Defined cases: a vector that is null, or holds a null or non-finite entry, is
dropped, as is one whose entries are too large for an exact long
(over 2^30) or whose length is not the commonest (of equally common ones the
longest); repeated rows and ids count each; a null id keeps its rows.
Directions without variance (an eigenvalue below 1e-12 of the trace) have no
component, so fewer than ``k`` may come back; with no variance at all, or no
rows, the result is empty.  A deviation beyond a long is null.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentmark.session import materialize

SCALE, SHIFT = 1024, 100_000
NODES = 8            # quadrature nodes on the upper half circle
CROWD = 4            # eigenvalues an interval may hold
LARGEST = float(1 << 30)
RANK = 1e-12         # an eigenvalue below this share of the trace is none
TOLERANCE = 2e-15    # residual for each dimension, as a share of the largest eigenvalue
SEED = 42


# --- one symmetric matrix ---------------------------------------------------

def count_above(v, s: float) -> int:
    """Eigenvalues of the symmetric matrix ``v`` above ``s``: the inertia of
    v - s I from its factorisation with 1 x 1 and 2 x 2 pivots, the largest first."""
    import numpy as np
    a = v - s * np.eye(len(v))
    above = 0
    while len(a):
        diag = np.abs(np.diag(a))
        p = int(diag.argmax())
        off = np.abs(a)
        q = int(off.argmax())
        r, c = divmod(q, len(a))
        if off[r, c] == 0:
            break
        if diag[p] >= 0.64 * off[r, c]:
            pivot = [p]
            above += a[p, p] > 0
        else:                # an indefinite pair: one eigenvalue on each side
            pivot = [r, c]
            above += 1
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
        a = (a + a.T) / 2
    return int(above)


def intervals(v, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top down, together holding the
    ``k`` largest eigenvalues above the rank bound (and what cannot be told apart
    from the last)."""
    import numpy as np
    trace = float(np.trace(v))
    if not len(v) or trace <= 0:
        return []
    floor = RANK * trace
    total = count_above(v, floor)
    want = min(k, total)
    if not want:
        return []

    below, top = floor, trace * (1 + 1e-9)
    while top - below > 1e-3 * top:   # no eigenvalue above, and not far below
        mid = math.sqrt(below * top) if top > 8 * below else (below + top) / 2
        below, top = (mid, top) if count_above(v, mid) else (below, mid)
    top *= 1 + 1e-3

    def gap(low: float, high: float, n_low: int, n_high: int, target: int):
        """A point between with ``target`` eigenvalues above, or the closest
        point below a cluster that holds the target."""
        while n_low > target and high - low > 1e-11 * high:
            mid = (low + high) / 2 if high < 8 * low else math.sqrt(low * high)
            n = count_above(v, mid)
            if n >= target:
                low, n_low = mid, n
            else:
                high, n_high = mid, n
        return low, n_low
    out, high, done = [], top, 0
    while done < want:
        low, n = gap(floor, high, total, done, min(done + CROWD, want))
        # move the end well into the gap below the last eigenvalue inside
        under, over = floor, low
        if n < total:
            a, b = floor, low
            while b - a > 1e-3 * b:
                mid = (a + b) / 2
                if count_above(v, mid) > n:
                    a = mid
                else:
                    b = mid
            under, over = b, low
        low = (under + over) / 2
        out.append((low, high, n - done))
        high, done = low, n
    return out


def _ritz(v, block):
    """Rayleigh-Ritz over the span of ``block``: eigenvalues, vectors, residuals."""
    import numpy as np
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    basis = u[:, s > 1e-13 * s[0]] if len(s) and s[0] > 0 else u[:, :0]
    basis = np.linalg.qr(basis)[0]
    small = basis.T @ v @ basis
    values, turn = np.linalg.eigh((small + small.T) / 2)
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(v @ vectors - vectors * values, axis=0)


def _solver(v, names):
    """Tasks of rows (interval, node, centre, radius, width, block): weighted
    solves at one quadrature node."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        points, weights = np.polynomial.legendre.leggauss(NODES)
        for batch in batches:
            for row in batch.to_pylist():
                angle = (points[row["node"]] + 1) * np.pi / 2
                turn = np.exp(1j * angle)
                block = np.frombuffer(row["block"]).reshape(len(v), row["width"])
                z = row["centre"] + row["radius"] * turn
                solved = np.linalg.solve(z * np.eye(len(v)) - v, block.astype(complex))
                part = weights[row["node"]] / 2 * row["radius"] * (turn * solved).real
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["interval"]], pa.int32()), pa.array([row["node"]], pa.int32()),
                     pa.array([part.tobytes()], pa.binary())], names=names)
    return run


def eigenpairs(spark, v, k: int, rounds: int = 30):
    """The ``k`` largest eigenvalues and vectors (columns) of ``v``, each
    interval checked against its inertia count."""
    import numpy as np
    parts = intervals(v, k)
    scale = max((p[1] for p in parts), default=0.0)
    rng = np.random.default_rng(SEED)
    blocks = {i: rng.standard_normal((len(v), min(len(v), max(n + 2, 2 * n)))) for i, (_, _, n) in enumerate(parts)}
    found = {}
    for turn in range(rounds):
        if not blocks:
            break
        tasks = [(i, node, (parts[i][0] + parts[i][1]) / 2, (parts[i][1] - parts[i][0]) / 2, b.shape[1], b.tobytes())
                 for i, b in sorted(blocks.items()) for node in range(NODES)]
        df = spark.createDataFrame(tasks, "interval int, node int, centre double, radius double, width int, block binary")
        got = (df.repartition(len(tasks)).mapInArrow(_solver(v, ["interval", "node", "part"]),
                                                     "interval int, node int, part binary").collect())
        for i in list(blocks):
            low, high, n = parts[i]
            # sum in the order of the nodes, so reruns agree to the last bit
            block = sum(np.frombuffer(r["part"]).reshape(len(v), -1)
                        for r in sorted((r for r in got if r["interval"] == i), key=lambda r: r["node"]))
            values, vectors, residual = _ritz(v, block)
            # Ritz values without an eigenvalue behind them have large residuals
            inside = (values > low) & (values <= high) & (residual <= TOLERANCE * scale * len(v))
            if inside.sum() == n:
                found[i] = values[inside][::-1], vectors[:, inside][:, ::-1]
                del blocks[i]
                continue
            wide = min(len(v), max(len(values), n + 2) + (0 if turn % 3 < 2 else n))
            more = rng.standard_normal((len(v), max(0, wide - vectors.shape[1])))
            blocks[i] = np.concatenate((vectors, more), axis=1)
    if blocks:
        raise ArithmeticError("contour integration found fewer eigenpairs than the inertia counts")
    if not found:
        return np.zeros(0), np.zeros((len(v), 0))
    # one more Rayleigh-Ritz step over all intervals makes their vectors orthonormal
    values, vectors, _ = _ritz(v, np.concatenate([found[i][1] for i in sorted(found)], axis=1))
    return values[::-1][:k], vectors[:, ::-1][:, :k]


# --- over rows ----------------------------------------------------------------

def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the scaled longs of every vector that takes part."""
    v = F.col(vec_col).cast("array<double>")
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= LARGEST), F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT)
    df = rows.where(whole).select(F.col(id_col).alias("vec_id"), x.cast("array<bigint>").alias("x"))
    length = df.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("d")).limit(1).collect()
    return df.where(F.size("x") == (length[0]["d"] if length else 0))


def _matrix(column):
    import numpy as np
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), flat.dtype)


def _sum_parts(batches):
    import pyarrow as pa
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            n += len(x)
            total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()),
             pa.array(total, pa.int64())], names=["i", "n", "s"])


def _gram_parts(mean):
    def run(batches):
        import pyarrow as pa
        total = 0.0
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                y = _matrix(batch.slice(k, 4096).column(0)) - mean
                total = total + y.T @ y
        if not isinstance(total, float):
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())],
                names=["i", "row"])
    return run


def _add_rows(key, frame):
    import numpy as np
    import pandas as pd
    total = sum(np.frombuffer(r) for r in sorted(frame["row"]))
    return pd.DataFrame({"i": [key[0]], "row": [total.tobytes()]})


def fit(x: DataFrame, k: int):
    """n, exact sums, eigenvalues, components and trace of the rows' covariance."""
    import numpy as np
    sums = x.select("x").mapInArrow(_sum_parts, "i int, n bigint, s bigint").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    if not sums:
        return None
    n, s = sums[0]["n"], np.array([r["s"] for r in sums], dtype=np.int64)
    rows = (x.select("x").mapInArrow(_gram_parts(s / n), "i int, row binary")
            .groupBy("i").applyInPandas(_add_rows, "i int, row binary").orderBy("i").collect())
    v = np.stack([np.frombuffer(r["row"]) for r in rows]) / n
    v = (v + v.T) / 2
    values, vectors = eigenpairs(x.sparkSession, v, k)
    return {"n": n, "s": s, "values": values, "vectors": vectors, "trace": float(np.trace(v))}


def _project(model, names):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        n, s = model["n"], model["s"]
        scaled = model["vectors"] / np.sqrt(model["values"])
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                x = _matrix(part.column(1))
                rough = np.abs(n * x.astype(float) - s)
                if rough.max() < 1 << 31 and (rough ** 2).sum(axis=1).max() < 1 << 62:
                    dev = pa.array(((n * x - s) ** 2).sum(axis=1), pa.int64())
                else:
                    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
                    dev = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
                w = (x - s / n) @ scaled
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), dev, pa.ListArray.from_arrays(
                        pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))], names=names)
    return run


def whiten(rows: DataFrame, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error):
    one row for each vector and component."""
    import numpy as np
    x = materialize(usable(rows, id_col, vec_col), "vectors")
    model = fit(x, k)
    found = 0 if model is None else len(model["values"])
    kind = x.schema["vec_id"].dataType.simpleString()
    if not found:
        return x.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, "
                                                  "whitened double, explained double, identity_error double")
    names = ["vec_id", "deviation", "w"]
    white = materialize(x.mapInArrow(_project(model, names), f"vec_id {kind}, deviation bigint, w array<double>"), "white")
    means = white.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(found)]).first()
    pairs = [(i, j) for i in range(found) for j in range(i, found)]
    cov = white.agg(*[F.avg((F.col("w")[i] - means[i]) * (F.col("w")[j] - means[j])).alias(f"c{i}_{j}")
                      for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))
    explained = np.asarray(model["values"]) / model["trace"]
    share = F.element_at(F.array(*[F.lit(float(e)) for e in explained]), F.col("component"))
    return (white.select("vec_id", "deviation", F.posexplode("w").alias("p", "whitened"))
            .withColumn("component", (F.col("p") + 1).cast("int"))
            .select("vec_id", "component", F.lit(int(model["n"])).cast("bigint").alias("n"), "deviation", "whitened",
                    share.alias("explained"), F.lit(float(error)).alias("identity_error")))

"""Calibration fits by Spark ML or by grids whose losses Spark aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorwise.functions.maths import clip, logit, sigmoid
from priorwise.operators.evaluate import ece, log_loss


def isotonic(train: DataFrame, rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """``rows`` with ``calibrated``: the rising step fit of y on p, constant beyond the training range."""
    model = IsotonicRegression(featuresCol=p, labelCol=y, predictionCol="calibrated").fit(train.select(F.col(p).cast("double").alias(p), F.col(y).cast("double").alias(y)))
    return model.transform(rows.withColumn(p, F.col(p).cast("double"))).withColumn("calibrated", clip(F.col("calibrated"), 0.0, 1.0))


def platt(train: DataFrame, rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """``rows`` with ``calibrated``: a logistic fit on the logit of p."""
    assemble = VectorAssembler(inputCols=["__z"], outputCol="__f")
    fit = assemble.transform(train.select(logit(F.col(p), 1e-6).alias("__z"), F.col(y).cast("double").alias("__y")))
    model = LogisticRegression(featuresCol="__f", labelCol="__y", regParam=0.0, maxIter=50).fit(fit)
    a, b = float(model.coefficients[0]), float(model.intercept)
    return rows.withColumn("calibrated", sigmoid(a * logit(F.col(p), 1e-6) + b))


def _best(df: DataFrame, grid: Sequence[float], loss) -> float:
    """Grid value with the least mean loss, all values in one aggregation; ties go to the first."""
    row = df.agg(*(F.avg(loss(F.lit(float(g)))).alias(f"g{k}") for k, g in enumerate(grid))).first()
    return min(zip(row, range(len(grid))))[1]


def temperature(df: DataFrame, p: str = "p", y: str = "y", low: float = 0.1, high: float = 10.0) -> float:
    """Temperature with the least log loss: a coarse grid in the logarithm, then a finer one around the best."""
    loss = lambda t: log_loss(sigmoid(logit(F.col(p)) / t), F.col(y), 1e-12)
    grid = [low * (high / low) ** (k / 24) for k in range(25)]
    for _ in range(2):
        k = _best(df, grid, loss)
        a, b = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
        grid = [a + (b - a) * i / 20 for i in range(21)]
    return grid[_best(df, grid, loss)]


def symmetric_cap(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> float:
    """Cap from 0.65 to 1 with the least calibration error; 1 unless another is strictly better."""
    caps = [round(0.65 + 0.05 * k, 2) for k in range(8)]
    long = df.select(p, y, F.explode(F.array(*(F.lit(c) for c in caps))).alias("cap")).withColumn("__p", F.least(F.greatest(p, 1 - F.col("cap")), F.col("cap")))
    found = {round(r.cap, 2): r.ece for r in ece(long, ["cap"], bins, "__p", y).collect()}
    best = min(caps, key=lambda c: (found[c], -c))
    return best if found[best] < found[1.0] else 1.0


def blend_weight(df: DataFrame, a: str, b: str, y: str = "y", steps: int = 20) -> float:
    """Weight of a in the mean of two scores with the least log loss."""
    grid = [k / steps for k in range(steps + 1)]
    return grid[_best(df, grid, lambda w: log_loss(w * F.col(a) + (1 - w) * F.col(b), F.col(y), 1e-12))]


def blended(columns: Sequence[str], weights: Sequence[float], in_logits: bool = False) -> Column:
    total = sum(weights)
    parts = [(logit(F.col(c)) if in_logits else F.col(c)) * (w / total) for c, w in zip(columns, weights)]
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return sigmoid(out) if in_logits else out


def _nearest_weights(w: np.ndarray) -> np.ndarray:
    """The nearest point (in squares) of the weights that are not negative and sum to one."""
    u = np.sort(w)[::-1]
    over = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(w - over[np.flatnonzero(u > over)[-1]], 0.0)


def _least_quadratic(gradient: np.ndarray, hessian: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weights with the least value of the quadratic model around ``at``; a few numbers, so on the driver."""
    step, w = 1 / (np.linalg.eigvalsh(hessian)[-1] + 1e-12), at
    for _ in range(5000):
        new = _nearest_weights(w - step * (gradient + hessian @ (w - at)))
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w


def blend_weights(df: DataFrame, columns: Sequence[str], y: str = "y", in_logits: bool = False, rounds: int = 40, tolerance: float = 1e-7) -> list[float]:
    """Weights of several scores, none negative, with sum 1, whose blend has the least log loss.

    The loss is convex in the weights, for means of probabilities as for means
    of logits. Each step is one aggregate over the rows: the loss, its gradient
    and its curvature at the weights, from which the next ones follow; a step
    that did not help is halved. Rows with a null are left out.
    """
    k, tiny = len(columns), 1e-12
    inside = [F.least(F.greatest(F.col(c).cast("double"), F.lit(tiny)), F.lit(1 - tiny)) for c in columns]
    rows = df.dropna(subset=[*columns, y]).select(F.col(y).cast("double").alias("__y"), *((logit(x) if in_logits else x).alias(f"__x{i}") for i, x in enumerate(inside)))
    x = [F.col(f"__x{i}") for i in range(k)]
    is_hit = F.col("__y")

    def seen(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        total = sum((F.lit(float(v)) * c for v, c in zip(w, x)), F.lit(0.0))
        p = sigmoid(total) if in_logits else F.least(F.greatest(total, F.lit(tiny)), F.lit(1 - tiny))
        loss = -(is_hit * F.log(F.greatest(p, F.lit(tiny))) + (1 - is_hit) * F.log(F.greatest(1 - p, F.lit(tiny))))
        slope = p - is_hit if in_logits else (p - is_hit) / (p * (1 - p))
        bend = p * (1 - p) if in_logits else is_hit / (p * p) + (1 - is_hit) / ((1 - p) * (1 - p))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        r = rows.agg(F.avg(loss).alias("loss"), *(F.avg(slope * x[i]).alias(f"g{i}") for i in range(k)), *(F.avg(bend * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs)).first()
        hessian = np.zeros((k, k))
        for i, j in pairs:
            hessian[i, j] = hessian[j, i] = r[f"h{i}_{j}"] or 0.0
        return r.loss or 0.0, np.array([r[f"g{i}"] or 0.0 for i in range(k)]), hessian

    w = np.full(k, 1 / k)
    loss, gradient, hessian = seen(w)
    share, aim = 1.0, _least_quadratic(gradient, hessian, w)
    for _ in range(rounds):
        if np.abs(aim - w).max() * share < tolerance:
            break
        new = w + share * (aim - w)
        found = seen(new)
        if found[0] > loss:
            share /= 2
            continue
        w, (loss, gradient, hessian), share = new, found, 1.0
        aim = _least_quadratic(gradient, hessian, w)
    return [float(v) for v in w]


def zero_rate_shift(df: DataFrame, p: str, target: float, points: int = 64, tolerance: float = 1e-6) -> float:
    """Shift of the logit that makes the mean probability the target.

    The mean rises with the shift, so an aggregate over a grid of shifts leaves
    one gap, which the next one divides; a handful of them is enough.
    """
    low, high = -20.0, 20.0
    while high - low >= tolerance:
        grid = [low + (high - low) * (i + 1) / (points + 1) for i in range(points)]
        z = logit(F.col(p))
        means = df.agg(*(F.avg(sigmoid(z + g)).alias(f"m{i}") for i, g in enumerate(grid))).first()
        below = sum((m or 0.0) < target for m in means)
        low, high = (grid[below - 1] if below else low), (grid[below] if below < points else high)
    return (low + high) / 2


def best_factor(df: DataFrame, value: str, cdf, grid: Sequence[float], refinements: int = 2) -> float:
    """Factor on the value whose transform is nearest to uniform (least Kolmogorov-Smirnov statistic).

    After the grid, the gaps beside its best factor are divided as finely again,
    ``refinements`` times; of equal statistics the smaller factor is taken.
    """
    from priorwise.operators.evaluate import ks_uniform

    grid, best = sorted(map(float, grid)), None
    for turn in range(refinements + 1):
        long = df.withColumn("factor", F.explode(F.array(*map(F.lit, grid)))).withColumn("u", cdf(F.col(value) * F.col("factor")))
        found = ks_uniform(long, ["factor"], "u", 1).orderBy("ks", "factor").first().factor
        at = grid.index(found)
        low, high = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
        best = found
        if turn == refinements or high <= low:
            break
        grid = sorted({low + (high - low) * i / (len(grid) + 1) for i in range(len(grid) + 2)} | {found})
    return best

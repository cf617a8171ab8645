"""Fits with Spark's own learners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorwise.functions.maths import recency_weight, shrink_to_prior, softmax
from priorwise.operators.dist import stratum_quantiles
from priorwise.operators.lineage import checkpointed
from priorwise.operators.sized import small

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [c for c, kind in df.dtypes if kind in _NUMERIC and c not in exclude]


def filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles with nulls at 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def standard_pca(df: DataFrame, features: Sequence[str], train: Column, k: int = 5) -> DataFrame:
    """``df`` with components pc_1..pc_k fitted on the training rows; the signs of components are arbitrary."""
    df = filled(df, features)
    return with_components(df, fitted_components(df.where(train), features, k))


def _learner(kind: str, label: str, weight: str | None):
    options = {"featuresCol": "__v", "labelCol": label} | ({"weightCol": weight} if weight else {})
    return GBTClassifier(maxIter=20, maxDepth=4, seed=7, **options) if kind == "gbt" else LogisticRegression(maxIter=50, regParam=1e-3, **options)


def fit_scores(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str, kind: str = "logistic", weight: str | None = None) -> DataFrame:
    """``rows`` with the score of a model of the training rows.

    A logistic model of two labels is an expression of its coefficients: rows
    are scored without the model itself, so no plan has to carry it to the tasks.
    """
    columns = rows.columns
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__v"), _learner(kind, label, weight)]).fit(filled(train, features).withColumn(label, F.col(label).cast("double")))
    if kind != "gbt" and model.stages[-1].numClasses <= 2:
        return rows.select(*(F.col(f"`{c}`") for c in columns), _logistic_score(model.stages[-1], features).alias("score"))
    out = model.transform(filled(rows, features))
    return out.select(*columns, vector_to_array("probability")[1].alias("score"))


def _logistic_score(fitted: LogisticRegressionModel, features: Sequence[str]) -> Column:
    """Probability of label 1; null features are 0, as in training."""
    factors = F.array(*(F.lit(float(c)) for c in fitted.coefficients.toArray()))
    values = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features))
    terms = F.zip_with(factors, values, lambda a, b: a * b)
    z = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b, lambda a: a + F.lit(float(fitted.intercept)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def out_of_fold(df: DataFrame, key: str, features: Sequence[str], label: str, folds: int = 3, kind: str = "logistic") -> DataFrame:
    """Every row scored by a model that did not see it; folds come from a hash of the key."""
    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    out = None
    for k in range(folds):
        part = fit_scores(df.where(fold != k), df.where(fold == k), features, label, kind)
        out = part if out is None else out.unionByName(part)
    return out


def time_folds(df: DataFrame, date: str, folds: int = 5) -> DataFrame:
    """``df`` with ``fold``, 0 to ``folds``: blocks of dates in order with about as many rows each; a date is never split.

    A null date has no fold. Numbers come from the distinct dates.
    """
    sizes = df.where(F.col(date).isNotNull()).groupBy(F.col(date).alias("__d")).agg(F.count("*").alias("__n"))
    before, whole = F.sum("__n").over(Window.orderBy("__d")) - F.col("__n"), F.sum("__n").over(Window.partitionBy())
    numbered = sizes.select("__d", F.floor(before * (folds + 1) / whole).cast("int").alias("fold"))
    return df.join(small(numbered), F.col(date) == F.col("__d"), "left").drop("__d")


def out_of_time(df: DataFrame, features: Sequence[str], label: str, date: str, folds: int = 5, embargo: int = 0, kind: str = "logistic", half_life: float | None = None) -> DataFrame:
    """Rows with the score of a model that saw only dates before those of their fold, less ``embargo`` days.

    Folds are ``time_folds``; the first has nothing before it and a null score,
    as have folds of which the earlier rows hold one label only, and rows
    without date. With a half-life, training rows weigh less the older they are.
    """
    rows = checkpointed(time_folds(df, date, folds))
    starts = {r.fold: (r.first, r.last) for r in rows.where("fold IS NOT NULL").groupBy("fold").agg(F.min(date).alias("first"), F.max(date).alias("last")).collect()}  # a row a fold
    out = rows.where("fold IS NULL OR fold = 0").withColumn("score", F.lit(None).cast("double"))
    for fold, (first, _) in sorted(starts.items()):
        if fold == 0:
            continue
        known = rows.where(F.col(date) < F.date_sub(F.lit(first), embargo)).where(F.col(label).isNotNull())
        weight = recency_weight(F.datediff(F.lit(first), F.col(date)), half_life, 0.0) if half_life else F.lit(1.0)
        held = rows.where(F.col("fold") == fold)
        if known.select(label).distinct().limit(2).count() < 2:
            out = out.unionByName(held.withColumn("score", F.lit(None).cast("double")))
            continue
        out = out.unionByName(fit_scores(known.withColumn("__w", weight), held, features, label, kind, "__w"))
    return out


def fitted_components(train: DataFrame, features: Sequence[str], k: int = 5) -> PipelineModel:
    """Scaling and components fitted on training rows, as one model that ``save`` keeps and ``PipelineModel.load`` brings back."""
    steps = [VectorAssembler(inputCols=list(features), outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__s", withMean=True), PCA(k=k, inputCol="__s", outputCol="__p")]
    return Pipeline(stages=steps).fit(filled(train, features))


def with_components(df: DataFrame, model: PipelineModel) -> DataFrame:
    """``df`` with pc_1, pc_2, ... of a fitted model, which knows its features and their number."""
    features, k = model.stages[0].getInputCols(), model.stages[-1].getK()
    out = model.transform(filled(df, features)).withColumn("__a", vector_to_array("__p"))
    return out.select(*df.columns, *(F.col("__a")[i].alias(f"pc_{i + 1}") for i in range(k)))


def served_classes(scored: DataFrame, held: DataFrame, label: str, prior: Sequence[float], probs: str = "probs", share: float = 0.05, grid: Sequence[float] = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)) -> DataFrame:
    """``scored`` with ``served``: class probabilities at the temperature with the least log loss on held rows, shrunk to a prior.

    One aggregate tries the grid of temperatures, a second one finer steps beside its best.
    """
    logs = lambda: F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(1e-12))))

    def best(values: Sequence[float]) -> float:
        loss = lambda t: F.avg(-F.log(F.greatest(F.get(softmax(logs(), t), F.col(label).cast("int")), F.lit(1e-12))))
        row = held.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(values))).first()
        return min(values, key=lambda t: (row[f"t{list(values).index(t)}"] if row[f"t{list(values).index(t)}"] is not None else 0.0, abs(t - 1)))

    first = best(grid)
    fine = best([first * 2 ** (i / 16) for i in range(-8, 9)])
    return scored.withColumn("served", shrink_to_prior(softmax(logs(), fine), F.array(*(F.lit(float(p)) for p in prior)), share))


def class_scores(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``rows`` with an array of probabilities of a multinomial model."""
    columns = rows.columns
    stage = LogisticRegression(featuresCol="__v", labelCol=label, family="multinomial", maxIter=50, regParam=1e-3)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__v"), stage]).fit(filled(train, features).withColumn(label, F.col(label).cast("double")))
    return model.transform(filled(rows, features)).select(*columns, vector_to_array("probability").alias("probs"))


def importance(train: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, importance of a boosted model."""
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__v"), _learner("gbt", label, None)]).fit(filled(train, features).withColumn(label, F.col(label).cast("double")))
    values = model.stages[-1].featureImportances
    return train.sparkSession.createDataFrame([(c, float(values[i])) for i, c in enumerate(features)], "feature string, importance double")


def occlusion(rows: DataFrame, key: str, groups: dict[str, Sequence[str]], score) -> DataFrame:
    """Change of the score when a group's ``_a`` and ``_b`` columns are both set to their middle.

    ``score`` maps a DataFrame to one with a column score; all groups are scored in one pass.
    """
    base = rows.withColumn("group", F.lit("none"))
    out = base
    for name, features in groups.items():
        middle = {f"{f}_{s}": (F.col(f"{f}_a") + F.col(f"{f}_b")) / 2 for f in features for s in "ab"}
        out = out.unionByName(base.withColumns(middle).withColumn("group", F.lit(name)))
    scored = score(out)
    plain = scored.where("group = 'none'").select(key, F.col("score").alias("__base"))
    return scored.where("group <> 'none'").join(plain, key).select(key, "group", (F.col("__base") - F.col("score")).alias("effect"))


def half_life_scores(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str, date: str, grid: Sequence[float], floor: float = 0.0) -> DataFrame:
    """``half_life, brier`` of a probe fitted with weights that halve every so many days before the last training date; null is without weights."""
    end = train.agg(F.max(date)).first()[0]
    out = None
    for h in (None, *grid):
        weight = recency_weight(F.datediff(F.lit(end), F.col(date)), h, floor)
        scored = fit_scores(train.withColumn("__w", weight), rows, features, label, weight="__w")
        part = scored.agg(F.lit(h).cast("double").alias("half_life"), F.avg((F.col("score") - F.col(label)) * (F.col("score") - F.col(label))).alias("brier"))
        out = part if out is None else out.unionByName(part)
    return out


def best_half_life(scores: DataFrame, margin: float = 0.001) -> float | None:
    """Half-life with the least score, if it beats that without weights by more than the margin; else None."""
    found = {r.half_life: r.brier for r in scores.collect()}  # a row for each candidate
    tried = {h: b for h, b in found.items() if h is not None and b is not None}
    best = min(tried, key=lambda h: (tried[h], h), default=None)
    return best if best is not None and tried[best] < found[None] - margin else None


def hurdle(train: DataFrame, rows: DataFrame, features: Sequence[str], count: str, strata: Sequence[str], levels: Sequence[float], kind: str = "gbt") -> DataFrame:
    """``rows`` with ``p_positive`` of a model of count > 0, and the quantile grid ``qs, qv`` of the stratum's positive training counts."""
    known = train.where(F.col(count).isNotNull())
    scored = fit_scores(known.withColumn("__y", (F.col(count) > 0).cast("double")), rows, features, "__y", kind).withColumnRenamed("score", "p_positive")
    grids = stratum_quantiles(known.where(F.col(count) > 0), strata, count, levels).drop("n")
    return scored.join(grids, list(strata), "left")

"""Models on Spark ML: linear and tree scores, event probabilities, calibration, walk-forward prediction."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import col
from barloom.operators.metrics import bins_of, edges_of, exact_quantiles, rank_ic


def _inputs(features: list[str], scaled: bool) -> list:
    filled = [f"{f}_filled" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw_vector")]
    return [*stages, StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True) if scaled else VectorAssembler(inputCols=filled, outputCol="vector")]


def fit_linear(train: DataFrame, features: list[str], label: str, penalty: float, mix: float = 0.0) -> PipelineModel:
    """Median-filled, standardised ridge (mix 0) or elastic net."""
    return Pipeline(stages=[*_inputs(features, True), LinearRegression(featuresCol="vector", labelCol=label, predictionCol="score_ml", regParam=penalty, elasticNetParam=mix, standardization=False)]).fit(train)


def linear_contributions(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """Score and each feature's z times coefficient."""
    beta = F.array(*[F.lit(float(b)) for b in model.stages[-1].coefficients])
    out = model.transform(rows)
    return out.withColumn("contributions", F.zip_with(vector_to_array("vector"), beta, lambda z, b: z * b)).drop("raw_vector", "vector", *[f"{f}_filled" for f in features])


def fit_rank_trees(train: DataFrame, features: list[str], label: str, trees: int = 10, depth: int = 3, seed: int = 1, validation: str | None = None) -> PipelineModel:
    """Boosted trees; rows where the `validation` column is true aren't fitted but stop the boosting once they gain no more."""
    trees_ = GBTRegressor(featuresCol="vector", labelCol=label, predictionCol="score_ml", maxIter=trees, maxDepth=depth, seed=seed, validationTol=0.0)
    return Pipeline(stages=[*_inputs(features, False), trees_.setValidationIndicatorCol(validation) if validation else trees_]).fit(train)


def forward_rank(rows: DataFrame, label: str, out: str) -> DataFrame:
    """Place of the outcome among those of its date, 0 to 1."""
    return rows.withColumn(out, F.when(col(label).isNotNull(), F.percent_rank().over(Window.partitionBy("trade_date", F.col(label).isNull()).orderBy(label))))


def tune(fit: DataFrame, validation: DataFrame, features: list[str], label: str, outcome: str, grid: list[tuple[float, float]]) -> DataFrame:
    """A row per grid point (penalty, mix): its mean daily rank correlation on the validation rows, and whether it is the best of its family (ridge, elastic net);
    a point that scores all alike has none.

    A dozen points at most; each is fitted once and all score the validation rows in one pass.
    """
    scored = validation
    for i, (penalty, mix) in enumerate(grid):
        scored = fit_linear(fit, features, label, penalty, mix).transform(scored).withColumnRenamed("score_ml", f"score_{i}").drop("raw_vector", "vector", *[f"{f}_filled" for f in features])
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.col(f"score_{i}").alias("score")) for i in range(len(grid))]))
    rows = scored.select("trade_date", col(outcome).alias("outcome"), points.alias("x")).select("trade_date", "outcome", "x.*")
    daily = rank_ic(rows, "score", "outcome", by=("point", "trade_date"))
    table = daily.groupBy("point").agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("days"))
    listed = fit.sparkSession.createDataFrame([(i, "ridge" if mix == 0 else "elastic", float(penalty), float(mix)) for i, (penalty, mix) in enumerate(grid)], "point int, family string, penalty double, mix double")
    best = F.col("mean_ic").isNotNull() & (F.row_number().over(Window.partitionBy("family").orderBy(F.desc_nulls_last("mean_ic"), "point")) == 1)  # one row per point
    return listed.join(table, "point", "left").withColumn("best", best)


def meta_filter(trades: DataFrame, features: list[str], outcome: str, cut: str, keep: float = 0.6) -> DataFrame:
    """Later trades with `p` and `kept`: a logistic filter fitted on those before the cut date, which keeps what scores above their (1 - keep) quantile."""
    earlier = trades.where(F.col("trade_date") < F.lit(cut).cast("date")).withColumn("win", (F.col(outcome) > 0).cast("double"))
    model = Pipeline(stages=[*_inputs(features, True), LogisticRegression(featuresCol="vector", labelCol="win", regParam=0.01)]).fit(earlier)
    scored = lambda df: model.transform(df).withColumn("p", vector_to_array("probability")[1])
    threshold = exact_quantiles(scored(earlier), "p", [1 - keep]).agg(F.first("quantiles")[0].alias("threshold"))
    later = scored(trades.where(F.col("trade_date") >= F.lit(cut).cast("date"))).crossJoin(F.broadcast(threshold))  # one row
    return later.withColumn("kept", F.col("p") >= F.col("threshold")).select(*trades.columns, "p", "threshold", "kept")


def filter_gain(later: DataFrame, outcome: str, resamples: int, seed: int, level: float = 0.05) -> DataFrame:
    """One row: trades and kept ones, their mean outcomes, the gain of the kept and its lower bound over resamples of whole dates.

    A date's trades are drawn together, each date as often as a Poisson count of its hash says, so that no resample needs a shuffle of trades.
    """
    day = later.groupBy("trade_date").agg(F.count("*").alias("n"), F.sum(outcome).alias("s"), F.count_if("kept").alias("nk"), F.sum(F.when(F.col("kept"), F.col(outcome)).otherwise(0.0)).alias("sk"))
    draws = day.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples))))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "b", "trade_date")), 1, 8), 16, 10).cast("double") / 4294967296.0
    steps, mass, term = F.lit(0), 0.0, math.exp(-1.0)
    for k in range(1, 9):  # Poisson of mean 1 by inversion: a count above 8 has a chance of 1e-6
        mass += term
        term /= k
        steps = steps + (u >= mass).cast("int")
    draws = draws.withColumn("w", F.when(F.col("b") == 0, F.lit(1)).otherwise(steps))  # b = 0: as it was
    means = draws.groupBy("b").agg((F.try_divide(F.sum(F.col("w") * F.col("sk")), F.sum(F.col("w") * F.col("nk"))) - F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n")))).alias("gain"))
    bound = means.agg(F.max(F.when(F.col("b") == 0, F.col("gain"))).alias("gain"), F.percentile(F.when(F.col("b") > 0, F.col("gain")), F.lit(level)).alias("lower_bound"))
    seen = day.agg(F.sum("n").alias("trades"), F.sum("nk").alias("kept"), (F.sum("s") / F.sum("n")).alias("mean_all"), F.try_divide(F.sum("sk"), F.sum("nk")).alias("mean_kept"))
    return seen.crossJoin(F.broadcast(bound))  # one row each


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def score_range(spark: SparkSession, path: str, rows: DataFrame, start: str, end: str) -> DataFrame:
    """Scores and ranks by a stored model for all rows dated in the range; it must have `score_ml`."""
    asked = rows.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    place = Window.partitionBy("trade_date").orderBy(F.desc("score_ml"), "instrument_id")
    return PipelineModel.load(path).transform(asked).withColumn("rank", F.row_number().over(place)).select(*rows.columns, "score_ml", "rank")


def fit_event_trees(train: DataFrame, features: list[str], label: str, trees: int = 10, depth: int = 3, seed: int = 1) -> PipelineModel:
    return Pipeline(stages=[*_inputs(features, False), GBTClassifier(featuresCol="vector", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)]).fit(train)


def event_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("proba_ml", vector_to_array("probability")[1])


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Gain share by feature, highest first."""
    return sorted(zip(features, (float(x) for x in model.stages[-1].featureImportances.toArray())), key=lambda r: (-r[1], r[0]))


def fit_isotonic(rows: DataFrame, p: str, y: str, bins: int = 50):
    """Isotonic calibration on equal-count bins of the probabilities."""
    table = bins_of(rows, p, bins).groupBy("bin").agg(F.avg(p).alias("p"), F.avg(F.col(y).cast("double")).alias("y"), F.count("*").cast("double").alias("w"))
    return IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w", predictionCol="calibrated").fit(table)


def fit_platt(rows: DataFrame, p: str, y: str) -> PipelineModel:
    """Logistic regression on the log-odds."""
    odds = logit(rows, p)
    return Pipeline(stages=[VectorAssembler(inputCols=["logit"], outputCol="logit_vector"), LogisticRegression(featuresCol="logit_vector", labelCol=y)]).fit(odds)


def logit(rows: DataFrame, p: str) -> DataFrame:
    q = F.least(F.greatest(col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return rows.withColumn("logit", F.ln(q / (1 - q)))


def walk_forward(rows: DataFrame, folds: list[int], fold: str, fit, score) -> DataFrame:
    """One model per fold, fitted on earlier folds only; the test rows' scores together. A dozen folds at most."""
    out = None
    for k in folds:
        part = score(fit(rows.where(F.col(fold) < k)), rows.where(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


def scenario_quantiles(fitted: DataFrame, rows: DataFrame, score: str, outcome: str, buckets: int, levels: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Quantiles of the outcome in the score bucket of the fitted rows, sorted, for each row."""
    edges = edges_of(fitted, score, buckets)
    at = lambda df: df.crossJoin(F.broadcast(edges)).withColumn("bucket", F.size(F.filter("edges", lambda e: e <= F.col(score)))).drop("edges")  # noqa: E731  one row
    table = exact_quantiles(at(fitted), outcome, list(levels), "bucket").select("bucket", F.array_sort("quantiles").alias("scenarios"))
    return at(rows).join(F.broadcast(table), "bucket", "left")  # one row per bucket

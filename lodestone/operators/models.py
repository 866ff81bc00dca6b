"""A default model for active learning: an ensemble whose members' spread is the uncertainty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

#: (train, pool) -> (row_id, y_pred, y_pred_sd): what a model must give.
FitPredict = Callable[[DataFrame, DataFrame], DataFrame]

KINDS = {"forest": lambda seed: RandomForestRegressor(seed=seed, numTrees=20, maxDepth=6), "boosted": lambda seed: GBTRegressor(seed=seed, maxIter=10, maxDepth=4, subsamplingRate=0.8), "linear": lambda seed: LinearRegression(regParam=0.1)}


def ensemble(columns: list[str], y: str = "y", kind: str = "forest", members: int = 3, fraction: float = 0.8, key: str = "row_id") -> FitPredict:
    """Members are trained on different parts of the labeled rows, chosen by a hash of the key.

    A missing feature (NULL or NaN) takes the training rows' mean of its column, 0 if they have none: no row of the pool is dropped.
    """

    def fit_predict(train: DataFrame, pool: DataFrame) -> DataFrame:
        a = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error")
        known = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns}
        means = train.agg(*[F.avg(known[c]).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        filled = [F.coalesce(known[c], F.lit(means[i]), F.lit(0.0)).alias(c) for i, c in enumerate(columns)]
        rows, ask = a.transform(train.select(key, *filled, F.col(y).cast("double").alias("label"))).cache(), a.transform(pool.select(key, *filled))
        for m in range(members):
            part = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(m)), F.lit(1000)) < int(1000 * fraction))
            model = KINDS[kind](m).fit(part if part.limit(1).count() else rows)
            ask = model.setPredictionCol(f"__p{m}").transform(ask)
        rows.unpersist()
        p = F.array(*[f"__p{m}" for m in range(members)])
        mean = F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / members
        out = ask.select(key, mean.alias("y_pred"), p.alias("p"))
        sd = F.sqrt(F.aggregate(F.transform("p", lambda x: (x - F.col("y_pred")) * (x - F.col("y_pred"))), F.lit(0.0), lambda s, x: s + x) / max(members - 1, 1))
        return out.select(key, "y_pred", sd.alias("y_pred_sd"))

    return fit_predict


def model_metrics(fit_predict: FitPredict, train: DataFrame, y: str = "y", key: str = "row_id", folds: int = 4) -> dict:
    """RMSE, mean sd and R2 on a held-out fold by a hash of the key, and a score of 0 to 10 from R2."""
    held = F.pmod(F.xxhash64(key), F.lit(folds)) == 0
    test = train.where(held)
    p = fit_predict(train.where(~held), test).join(test.select(key, F.col(y).cast("double").alias("__y")), key)
    r = p.agg(F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col("__y"), 2))).alias("rmse"), F.avg("y_pred_sd").alias("SD"), F.var_pop("__y").alias("v"), F.count("*").alias("n")).first()
    r2 = 1 - r.rmse**2 / r.v if r.v else 0.0
    return {"rmse": r.rmse, "SD": r.SD, "score": int(min(10, max(0, round(10 * r2)))), "test_points": r.n}

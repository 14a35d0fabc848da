"""Model benchmark on the driver tables (rows-only checks: MLlib's binned
forest is not expected to equal another library's exact-split forest).

Feature matrix = ``embeddings`` (64 floats), attack class = label 0.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model, sampling, scoring
from ..session import table

N_DIMS = 64


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    base = emb.select("vec_id", array_to_vector("embedding").alias("features"),
                      F.when(F.col("label") == 0, F.lit(1)).otherwise(F.lit(0)).alias("target"))
    weighted = sampling.class_weights(base, "target")
    return sampling.stratified_split(weighted, "target", "vec_id")


def _fit(spark, sf):
    data = _prepared(spark, sf)
    train, test = data.filter(~F.col("is_test")), data.filter(F.col("is_test"))
    return model.fit_forest(model.laid_out(train, train.count(), "vec_id")), test


def q_rf_scores(spark, sf):
    forest, test = _fit(spark, sf)
    scores = scoring.weighted_scores(scoring.confusion(model.predict(forest, test)))
    return scores.select(F.lit("embeddings").alias("scenario"),
                         F.lit("Split").alias("strategy"), "*")


def q_rf_top_features(spark, sf):
    forest, _ = _fit(spark, sf)
    names = [f"dim_{i:02d}" for i in range(N_DIMS)]
    return model.top_features(model.importances(spark, forest, names))


def queries():
    return {"rf_scores": q_rf_scores, "rf_top_features": q_rf_top_features}

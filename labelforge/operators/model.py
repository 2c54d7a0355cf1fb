"""Classifier fitting and selection on pooled text vectors (M4, M6, M7) with Spark ML.

The neural classifier of the reference is re-aimed as a distributed logistic regression with
class weights (positive weight (1-p)/p as in A7); scoring stays a DataFrame column, metrics use
the exact AUC of ``evaluate.auc`` (Spark's evaluator bins scores).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.operators.evaluate import auc


def with_class_weight(df: DataFrame, y: str = "y", name: str = "w") -> DataFrame:
    """A7 as a row weight: positives weigh (1-p)/max(p,1e-6), negatives 1 (p from a scalar subquery)."""
    p = df.agg(F.avg(F.col(y).cast("double"))).scalar()
    pw = (1 - p) / F.greatest(p, F.lit(1e-6))
    return df.withColumn(name, F.when(F.col(y) == 1, pw).otherwise(F.lit(1.0)))


def fit_logistic(train: DataFrame, features: str = "vector", y: str = "y", weight: str | None = "w",
                 reg: float = 0.0, max_iter: int = 50):
    """M4: logistic regression on an array<double> feature column."""
    data = train.select(array_to_vector(features).alias("features"), F.col(y).cast("double").alias("label"),
                        *([F.col(weight)] if weight else []))
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, maxIter=max_iter,
                            weightCol=weight or "", standardization=True)
    return lr.fit(data)


def score(model, df: DataFrame, features: str = "vector", name: str = "prob") -> DataFrame:
    """M5 for a fitted model: P(Search) per row."""
    t = model.transform(df.withColumn("features", array_to_vector(features)))
    return t.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction",
                                                                       "probability", "prediction")


def select_best(fits: DataFrame, fit: str = "fit", metric: str = "auc", min_gain: float = 1e-4) -> DataFrame:
    """M7: walk the fits in order, keep a new best only when it beats the best so far by more
    than ``min_gain`` (the fits table is one row per grid point: bounded)."""
    arr = F.array_sort(F.collect_list(F.struct(F.col(fit).alias("f"), F.col(metric).alias("m"))))
    init = F.struct(F.lit(-1).cast("long").alias("f"), F.lit(-1.0).alias("m"))
    best = F.aggregate(arr, init, lambda acc, x: F.when(F.coalesce(x["m"], F.lit(-1.0)) > acc["m"] + min_gain,
                                                        F.struct(x["f"].cast("long").alias("f"), x["m"].alias("m")))
                       .otherwise(acc))
    return fits.agg(best.alias("_b")).select(F.col("_b.f").alias("best_fit"), F.col("_b.m").alias("best_auc"))


def grid_search(train: DataFrame, valid: DataFrame, regs: Sequence[float], features: str = "vector",
                y: str = "y") -> tuple[DataFrame, DataFrame]:
    """M7: one fit per regularisation value, exact validation AUC per fit, and the selection."""
    rows = []
    tw = with_class_weight(train, y)
    for i, r in enumerate(regs):
        m = fit_logistic(tw, features, y, "w", reg=r)
        s = score(m, valid, features).withColumn("fit", F.lit(i)).withColumn("reg", F.lit(float(r)))
        rows.append(auc(s, ["fit", "reg"], y, "prob"))
    fits = rows[0]
    for r in rows[1:]:
        fits = fits.unionByName(r)
    return fits, select_best(fits)


def pca_variance(vectors: DataFrame, k: int, vec: str = "embedding") -> DataFrame:
    """M6: centre the vectors (Spark's PCA does not), fit k components; returns the explained
    variance ratio per component (signs of components are arbitrary, their variance is not)."""
    v = vectors.select(array_to_vector(F.col(vec).cast("array<double>")).alias("x"))
    sc = StandardScaler(inputCol="x", outputCol="xc", withMean=True, withStd=False).fit(v)
    pca = PCA(k=k, inputCol="xc", outputCol="p").fit(sc.transform(v))
    ev = [float(x) for x in pca.explainedVariance.toArray()]
    return vectors.sparkSession.createDataFrame(list(enumerate(ev)), "component int, explained_variance double")


def project(vectors: DataFrame, k: int, vec: str = "embedding", keep: Sequence[str] = ("vec_id",)) -> DataFrame:
    """M6 transform: centred vectors projected on k principal components, as array<double>."""
    v = vectors.select(*keep, array_to_vector(F.col(vec).cast("array<double>")).alias("x"))
    sc = StandardScaler(inputCol="x", outputCol="xc", withMean=True, withStd=False).fit(v)
    c = sc.transform(v)
    pca = PCA(k=k, inputCol="xc", outputCol="p").fit(c)
    return pca.transform(c).select(*keep, vector_to_array("p").alias("projected"))

"""Model fits against closed forms: AUC floors, chosen grid point, variances against the trace."""
import random

import numpy as np
from pyspark.sql import functions as F

from labelforge.operators import model as M
from labelforge.operators.evaluate import auc


def separable(spark, n, noise, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(r.random() < 0.2)
        rows.append((i, y, [y + r.gauss(0, noise), r.gauss(0, 1), r.gauss(0, 1)]))
    return spark.createDataFrame(rows, "id long, y int, vector array<double>")


def test_logistic_regression_beats_an_auc_floor_and_weighs_classes(spark):
    train, test = separable(spark, 800, 0.4, 1), separable(spark, 800, 0.4, 2)
    model = M.fit_logistic(M.with_class_weight(train), reg=0.01)
    scored = M.score(model, test)
    assert auc(scored.withColumn("g", F.lit(1)), ["g"]).first().auc > 0.93
    # the weights balance the classes: about as many rows are scored above one half as below for each class
    hit = scored.groupBy("y").agg(F.avg((F.col("prob") >= 0.5).cast("double")).alias("hi")).collect()
    rate = {r.y: r.hi for r in hit}
    assert rate[1] > 0.8 and rate[0] < 0.2
    w = {r.y: r.w for r in M.with_class_weight(train).select("y", "w").distinct().collect()}
    p = train.agg(F.avg("y")).first()[0]
    assert w[0] == 1.0 and abs(w[1] - (1 - p) / p) < 1e-9


def test_grid_keeps_the_first_of_equal_fits(spark):
    fits, best = M.grid_search(separable(spark, 500, 0.5, 3), separable(spark, 500, 0.5, 4), [0.0, 0.0, 5.0])
    rows = {r.fit: r.auc for r in fits.collect()}
    b = best.first()
    assert rows[0] == rows[1] and min(rows.values()) > 0.85
    assert b.best_fit == (0 if rows[2] <= rows[0] + 1e-4 else 2) and abs(b.best_auc - rows[b.best_fit]) < 1e-12


def test_pca_variances_match_the_covariance(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 5)) @ np.diag([3.0, 2.0, 1.0, 0.5, 0.1]) + 7
    v = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = [r.explained_variance for r in M.pca_variance(v, 5).orderBy("component").collect()]
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(got, want / want.sum(), atol=1e-8) and abs(sum(got) - 1) < 1e-9  # shares of the trace
    p = np.array([r.projected for r in M.project(v, 2).orderBy("vec_id").collect()])
    # variances of the projected vectors are the largest eigenvalues, whatever the signs
    assert np.allclose(np.sort((p - p.mean(0)).var(0, ddof=1))[::-1], want[:2])


def test_scratch_of_an_application_can_be_cleared(spark, tmp_dir):
    from labelforge import session

    other = session.written(spark.range(3), "mine")
    assert other.count() == 3 and spark.sparkContext.applicationId in other.inputFiles()[0]
    assert session.clear_scratch(spark) and not session.clear_scratch(spark)

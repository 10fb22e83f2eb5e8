"""Classifiers find what there is to find, on rows they were not fitted on."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tagshift.catalog import QUERIES, models
from tagshift.constants import METHOD_IDS
from tagshift.operators import split as SP
from tagshift.operators.metrics import auc
from tagshift.plans import learning as L
from tagshift.plans import models as M
from tagshift.plans import softmax as SX


@pytest.fixture(scope="module")
def separable(spark):
    """Label 1 where the first of three features is above a noisy border; weights differ by row."""
    x = [(F.rand(i) - 0.5).alias(f"x{i}") for i in range(3)]
    rows = spark.range(3000).select(F.col("id").alias("event_id"), *x)
    label = (F.col("x0") + 0.1 * (F.rand(9) - 0.5) > 0).cast("int")
    return rows.select("event_id", array_to_vector(F.array("x0", "x1", "x2")).alias("features"), label.alias("label"), (0.5 + F.col("event_id") % 3).alias("train_weight")).cache()


@pytest.mark.parametrize("kind", ["logistic", "boosted", "forest"])
def test_separable_sample(separable, kind):
    parts = SP.hashed_split(separable)
    model = L.train(parts.where("split = 'train'"), kind)
    assert auc(L.score(model, parts.where("split = 'valid'")), "score", "label", "train_weight").first()["auc"] > 0.95


def test_mean_score_of_a_logistic_fit_is_the_share_of_its_label(separable):
    """The intercept of an unregularised fit makes weighted sums of scores and labels equal."""
    model = L.train(separable, "logistic", maxIter=100, tol=1e-10)
    w = F.col("train_weight")
    got = L.score(model, separable).agg(F.sum(w * F.col("score")) / F.sum(w), F.sum(w * F.col("label")) / F.sum(w)).first()
    assert got[0] == pytest.approx(got[1], abs=1e-4)


def test_signal_is_told_from_background(spark, sf_dir):
    rows = QUERIES["k01_signal_classifier"](spark, sf_dir).collect()
    assert {r["region"] for r in rows} == {"CR", "SR"} and all(r["auc"] > 0.7 for r in rows)


def test_stored_model_scores_alike(spark, sf_dir):
    assert QUERIES["k05_saved_model"](spark, sf_dir).first()["largest_gap"] == 0.0


def test_validation_uses_other_rows(spark, sf_dir):
    got = QUERIES["i15_validation_classifier"](spark, sf_dir).first()
    assert got["region"] == "SR" and 0 < got["n"] < 200


def test_gradient_is_that_of_the_loss():
    """Against differences, with weights of either sign."""
    rng = np.random.default_rng(4)
    x, y, w = rng.normal(size=(50, 3)), rng.integers(0, 4, 50), rng.normal(1, 1, 50)
    at, h = rng.normal(size=(4, 4)), 1e-6
    _, gradient = SX.loss_and_gradient(x, y, w, at)
    for i in np.ndindex(at.shape):
        up, down = at.copy(), at.copy()
        up[i] += h
        down[i] -= h
        assert (SX.loss_and_gradient(x, y, w, up)[0] - SX.loss_and_gradient(x, y, w, down)[0]) / (2 * h) == pytest.approx(gradient[i], abs=1e-5)


@pytest.fixture(scope="module")
def three_classes(spark):
    x = [(F.rand(20 + i) - 0.5).alias(f"x{i}") for i in range(3)]
    rows = spark.range(4000, numPartitions=5).select(F.col("id").alias("event_id"), *x)
    label = F.when(F.col("x0") + 0.3 * F.rand(7) > 0.2, 0).when(F.col("x1") + 0.3 * F.rand(8) > 0.1, 1).otherwise(2)
    return rows.select("event_id", F.array("x0", 100 * F.col("x1"), "x2").alias("features"), label.alias("label"), (0.5 + F.col("event_id") % 3).alias("train_weight")).cache()


def test_optimum_is_that_of_spark_ml(three_classes):
    (model,) = SX.train(three_classes, 3, [0.01])
    scaled = StandardScaler(inputCol="v", outputCol="s", withMean=True)
    f = three_classes.withColumn("v", array_to_vector("features"))
    f = scaled.fit(f).transform(f)
    ml = LogisticRegression(featuresCol="s", weightCol="train_weight", regParam=0.01, standardization=False, maxIter=200, tol=1e-10, family="multinomial").fit(f)
    both = SX.with_probabilities(ml.transform(f).withColumn("q", vector_to_array("probability")), model).select(
        F.array_max(F.zip_with("q", "probabilities", lambda a, b: F.abs(a - b))).alias("off"), F.abs(F.aggregate("probabilities", F.lit(-1.0), lambda a, b: a + b)).alias("one"))
    worst = both.agg(F.max("off"), F.max("one")).first()
    assert worst[0] < 1e-3 and worst[1] < 1e-12


def test_settings_share_their_scans(three_classes, monkeypatch):
    scans = []
    plain = SX._evaluate
    monkeypatch.setattr(SX, "_evaluate", lambda *a: scans.append(len(a[1])) or plain(*a))
    models = SX.train(three_classes, 3, [0.0, 0.1, 10.0], rounds=15)
    assert len(scans) == max(m.evaluations for m in models) and scans[0] == 3
    alone = SX.train(three_classes, 3, [0.1], rounds=15)[0]
    assert models[1].weights == pytest.approx(alone.weights, abs=1e-6)
    assert models[0].loss < models[1].loss < models[2].loss < np.log(3)


def test_the_sweep_trains_once(spark, monkeypatch):
    asked, plain = [], SX.train
    monkeypatch.setattr(SX, "train", lambda df, classes, l2, **more: asked.append(l2) or plain(df, classes, l2, **more))
    rows = QUERIES["k06_sweep_in_one_scan"](spark, "/root/testdata/sf0.001").collect()
    assert asked == [[0.0, 0.01, 0.1, 1.0, 1e6]]
    assert [tuple(r) for r in rows] == [(h, True, True) for h in (0.0, 0.01, 0.1, 1.0)]


def test_signed_weights_and_odd_tables(spark, three_classes):
    signed = three_classes.withColumn("train_weight", F.when(F.col("event_id") % 9 == 0, -1.0).otherwise(1.0))
    (model,) = SX.train(signed, 3, [1e-3])
    p = SX.with_probabilities(signed, model)
    got = p.agg(*[F.sum(F.col("train_weight") * (F.get("probabilities", F.lit(k)) - (F.col("label") == k).cast("int"))) / F.sum("train_weight") for k in range(3)]).first()
    assert max(abs(x) for x in got) < 1e-4
    same = three_classes.withColumn("features", F.array(F.lit(2.0), F.lit(0.0))).limit(30)
    (flat,) = SX.train(same, 3, [0.0])
    assert np.isfinite(flat.weights).all()
    for bad in (three_classes.where("event_id < 0"), three_classes.withColumn("train_weight", F.lit(-1.0))):
        with pytest.raises(ValueError, match="more than 0"):
            SX.train(bad, 3, [0.0])


def test_correlated_features_cost_few_questions():
    """The curvature of correlated features is known from the start; the optimum is the same without it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 1)) + 0.3 * rng.normal(size=(1500, 20))
    y, w = np.clip(np.round(x[:, 0] + rng.normal(size=1500)) + 1, 0, 2).astype(int), np.ones(1500)
    x = (x - x.mean(axis=0)) / x.std(axis=0)

    def asked(*more):
        run = SX._minimise(np.zeros((3, 21)), 60, 1e-7, *more)
        at = next(run)
        while True:
            loss, gradient = SX.loss_and_gradient(x, y, w, at)
            free = at.copy()
            free[:, -1] = 0
            try:
                at = run.send((loss / 1500 + 0.005 * (free * free).sum(), gradient / 1500 + 0.01 * free))
            except StopIteration as end:
                return end.value

    (_, plain, many), (_, loss, few) = asked(), asked(SX._curvature(x.T @ x / 1500, 3, 0.01))
    assert few < many and loss == pytest.approx(plain, abs=1e-8)


def test_models_share_their_blocks_and_coupling(spark, sf_dir, monkeypatch):
    found, plain = [], M.monotone_coupling
    monkeypatch.setattr(M, "monotone_coupling", lambda *a: found.append(a) or plain(*a))
    e = models.events(spark, sf_dir)
    shared = models.all_models(e)
    assert len(found) == 1
    alone = {METHOD_IDS["ot5"]: M.ot_knn(e, 5, models.BLOCK), METHOD_IDS["comb"]: M.ot_classifier(e, models.scores(e), block_targets=models.BLOCK)}
    for name, model in alone.items():
        rows = lambda m: m.select("event_id", "region", F.round("model_weight", 9).alias("w"))
        assert rows(model).exceptAll(rows(shared[name])).isEmpty()

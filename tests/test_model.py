"""The denial model on the smallest tables, with a small forest."""

import pytest

from ledgerloom.plans import denial_model as dm
from ledgerloom.session import fresh_path


@pytest.fixture(scope="module")
def fitted(tables):
    train, test = dm.split(dm.training_frame(tables.claims_core))
    return dm.train(train, trees=8, depth=5), test


def test_split_is_whole_and_stratified(tables):
    frame = dm.training_frame(tables.claims_core)
    train, test = dm.split(frame)
    assert train.count() + test.count() == frame.count()
    rate = lambda df: df.agg({"is_denied": "avg"}).first()[0]
    assert rate(train) == pytest.approx(rate(test), abs=0.06)


def test_label_follows_from_error_code(fitted):
    model, test = fitted
    row = dm.metrics(model, test).first()
    assert row.auc_roc > 0.95 and row.true_positive + row.false_negative + row.true_negative + row.false_positive == test.count()


def test_unseen_category_is_scored(spark, fitted, tables):
    from pyspark.sql import functions as F

    model, test = fitted
    odd = dm.score(test.withColumn("main_fund", F.lit("NEW")), model)
    assert odd.count() == test.count()
    assert odd.filter("risk_score < 0 OR risk_score > 1 OR confidence < 0.5").count() == 0


def test_high_risk_is_ordered(fitted, tables):
    rows = dm.high_risk(tables.claims_core, fitted[0], threshold=0.0).collect()
    scores = [r.risk_score for r in rows]
    assert len(rows) == 20 and scores == sorted(scores, reverse=True)


def test_a_claim_is_scored_once(fitted, tables):
    """A threshold that is pushed below the scores makes the forest look up every claim twice."""
    plan = dm.high_risk(tables.claims_core, fitted[0], threshold=0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "UDF" in line]
    assert sum("AS probability#" in line for line in plan.splitlines()) == 1


def test_threshold_cuts_the_riskiest(fitted, tables):
    whole = [(r.tran_id, r.risk_score) for r in dm.high_risk(tables.claims_core, fitted[0], threshold=0.0, k=50).collect()]
    middle = whole[20][1]
    assert [(r.tran_id, r.risk_score) for r in dm.high_risk(tables.claims_core, fitted[0], threshold=middle, k=50).collect()] == [x for x in whole if x[1] >= middle]


def test_saved_model_scores_alike(spark, fitted, tables):
    model, test = fitted
    path = fresh_path(spark, "model")
    dm.save(model, path, dm.metrics(model, test), dm.importances(model, test, dm.feature_names()))
    a = dm.score(test, model).select("tran_id", "risk_score")
    b = dm.score(test, dm.load(path)).select("tran_id", "risk_score")
    assert a.exceptAll(b).count() == 0


def test_cross_validation_runs(tables):
    mean, deviation = dm.cross_validate(dm.training_frame(tables.claims_core), folds=2, trees=3, depth=3)
    assert 0 <= mean <= 1 and deviation >= 0


def test_forest_learns_in_bounded_tasks(spark, tables, monkeypatch):
    """Tasks follow from the rows, not from the row groups of a file, and no row is lost."""
    frame = dm.training_frame(tables.claims_core)
    n = frame.count()
    monkeypatch.setattr(dm, "LEARN_ROWS", n // 40)
    rows = dm.learning_rows(frame)
    sizes = [r["count"] for r in rows.groupBy(dm.F.spark_partition_id().alias("p")).count().collect()]
    rows.unpersist()
    assert sum(sizes) == n and len(sizes) >= 40 and max(sizes) < n / 10


def test_forest_is_the_same_whatever_the_files(tables):
    frame = dm.training_frame(tables.claims_core)
    found = [dm.train(x, trees=3, depth=4).stages[-1].toDebugString.split("\n", 1)[1] for x in (frame, frame.repartition(5))]
    assert found[0] == found[1]

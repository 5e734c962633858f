"""Folds of the age models run side by side, with the scores in their order."""

from __future__ import annotations

import threading

import pytest

from beatloom.operators import age_model as AM


def test_fits_overlap(spark, monkeypatch):
    together = threading.Barrier(3, timeout=30)

    def fitted(train, test, features, top_k, models, metrics):
        together.wait()
        return [], {name: (None, [float(test.count())] * len(metrics)) for name in models}

    monkeypatch.setattr(AM, "_fitted", fitted)
    people = spark.range(60).selectExpr("id as subject", "cast(id as double) as age", "'M' as sex", "cast(id as double) as f")
    scores, models = AM.evaluate_models(people, ["f"], folds=5, models=("ridge",))
    row = scores.first()
    assert row["cv_mae"] * 5 + row["mae"] == 60 and list(models) == ["ridge"]


def test_a_failed_fit_is_an_error(spark, monkeypatch):
    def fitted(*_):
        raise ValueError("no fit")

    monkeypatch.setattr(AM, "_fitted", fitted)
    people = spark.range(9).selectExpr("id as subject", "1.0 as age", "'M' as sex", "1.0 as f")
    with pytest.raises(ValueError, match="no fit"):
        AM.evaluate_models(people, ["f"], folds=2)

"""Models by period: fitted once, kept, refused when they do not belong."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.plans.refit import ModelStore, Setting, scores


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    days = [dt.date(2020, 1, 1) + dt.timedelta(7 * i) for i in range(60)]
    rows = [(p, d, c, *map(float, rng.normal(size=3))) for p, d in enumerate(days) for c in range(12)]
    df = spark.createDataFrame(rows, "pos int, date date, code int, x1 double, x2 double, y double")
    return df, spark.createDataFrame([(p, d) for p, d in enumerate(days)], "pos int, date date"), days, rows


def ridge(rows, lo, hi, alpha):
    m = np.array([r[3:] for r in rows if lo <= r[0] < hi])
    x, y = m[:, :2] - m[:, :2].mean(0), m[:, 2] - m[:, 2].mean()
    w = np.linalg.solve(x.T @ x + alpha * np.eye(2), x.T @ y)
    return [*w, m[:, 2].mean() - m[:, :2].mean(0) @ w]


def test_refit_on_the_first_day_of_a_period_and_reuse_after(spark, data):
    df, cal, days, rows = data
    setting = Setting(("x1", "x2"), "month", 4, 3, 5.0, 100)
    store = ModelStore(spark)
    first = store.refit_or_reuse(df, cal, cal.where("pos between 30 and 40"), "y", F.lit(True), setting).collect()
    fits = {r.asof: (r.w, r.b) for r in first}
    assert sorted(r.pos for r in first if r.refit) == sorted({min(p for p in range(30, 41) if days[p].replace(day=1) == days[q].replace(day=1)) for q in range(30, 41)})
    for r in first:
        start = days.index(r.asof)
        y, m = divmod(r.asof.year * 12 + r.asof.month - 1 - 4, 12)
        lo = next(p for p, d in enumerate(days) if d >= r.asof.replace(year=y, month=m + 1, day=min(r.asof.day, 28)))
        np.testing.assert_allclose([*r.w, r.b], ridge(rows, lo, start - 3, 5.0), rtol=1e-9)
    changed = df.withColumn("y", F.col("y") * 3)
    again = store.refit_or_reuse(changed, cal, cal.where("pos between 30 and 50"), "y", F.lit(True), setting).collect()
    assert len(again) == 21 and all((r.w, r.b) == fits[r.asof] for r in again if r.asof in fits)
    assert store.models().groupBy("period").count().where("count > 1").isEmpty()
    files = set(store.models().inputFiles())
    w = store.refit_or_reuse(changed, cal, cal.where("pos between 30 and 50"), "y", F.lit(True), setting)
    assert set(store.models().inputFiles()) == files  # nothing was written
    s = scores(df, w, ["x1", "x2"]).where("pos = 33 and code = 4").first()
    model = next(r for r in again if r.pos == 33)
    assert abs(s.score - (model.b + model.w[0] * s.x1 + model.w[1] * s.x2)) < 1e-12


def test_foreign_models_are_refused(spark, data):
    df, cal, days, _ = data
    setting = Setting(("x1", "x2"), "month", 4, 3, 5.0, 100)
    store = ModelStore(spark)
    late = next(p for p in range(30, 60) if days[p].replace(day=1) == days[p - 1].replace(day=1))
    store.refit_or_reuse(df, cal, cal.where(f"pos = {late}"), "y", F.lit(True), setting)
    with pytest.raises(ValueError, match="before the model"):
        store.refit_or_reuse(df, cal, cal.where(f"pos = {late - 1}"), "y", F.lit(True), setting)
    with pytest.raises(ValueError, match="another setting"):
        store.refit_or_reuse(df, cal, cal.where(f"pos = {late}"), "y", F.lit(True), Setting(("x1", "x2"), "month", 4, 3, 6.0, 100))


def test_too_few_rows_give_no_model(spark, data):
    df, cal, _, _ = data
    got = ModelStore(spark).refit_or_reuse(df, cal, cal.where("pos < 3"), "y", F.lit(True), Setting(("x1", "x2"), "month", 4, 3, 5.0, 100))
    assert got.count() == 0

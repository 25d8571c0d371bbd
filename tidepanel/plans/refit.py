"""Ridge models kept by period: the first trading day of a period fits one, later days use the stored model.

A store is a folder of model rows.  A run writes the rows of all periods it had to fit in one job, so they appear
together when the job commits or not at all, and a repeated run finds them and fits nothing.  What was fitted
once is never changed by later data.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators.staging import folder
from tidepanel.plans.models import fold_stats, ridge_stats, solve_ridge

SCHEMA = "period date, asof date, start int, n double, w array<double>, b double, setting string"


@dataclass(frozen=True)
class Setting:
    features: tuple[str, ...]
    period: str = "month"
    train_months: int = 60
    gap: int = 6  # days between the last training day and the as-of day, the label's horizon included
    alpha: float = 10.0
    min_rows: int = 1000

    @property
    def digest(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()[:32]


class ModelStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{folder(spark)}/models-{uuid.uuid4().hex}"

    def models(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.root)
        except Exception as e:  # noqa: BLE001 - only a missing folder means that nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def refit_or_reuse(self, df: DataFrame, cal: DataFrame, days: DataFrame, y: str, train: Column, setting: Setting) -> DataFrame:
        """(pos, date, asof, w, b, refit) for each of ``days``: fits the periods that have no model, keeps all others.

        Training rows are those with ``train`` from ``train_months`` before the as-of day up to ``gap`` days before it.  A
        period with too few rows gets no model and its days no row.  A store of another setting, or with a
        model of the period from after one of ``days``, is refused.
        """
        period = lambda c: F.trunc(c, setting.period)
        days = days.select("pos", "date", period("date").alias("period"))
        wanted = days.groupBy("period").agg(F.min("date").alias("asof"), F.min("pos").alias("start"))
        stored = self.models()
        other = stored.where(F.col("setting") != setting.digest)
        future = stored.select("period", F.col("asof").alias("_fitted")).join(wanted, "period").where(F.col("_fitted") > F.col("asof"))
        if not other.isEmpty():
            raise ValueError("the store holds models of another setting")
        if not future.isEmpty():
            raise ValueError("a day lies before the model of its period was fitted")
        fresh = wanted.join(stored.select("period"), "period", "left_anti")
        if not fresh.isEmpty():
            self._fit(df, cal, fresh, y, train, setting)
        models = self.models().select("period", "asof", "w", "b")
        return days.join(F.broadcast(models), "period").select("pos", "date", "asof", "w", "b", (F.col("date") == F.col("asof")).alias("refit"))

    def _fit(self, df: DataFrame, cal: DataFrame, fresh: DataFrame, y: str, train: Column, setting: Setting) -> None:
        earliest = F.add_months("asof", -setting.train_months)
        lo = fresh.join(F.broadcast(cal.select(F.col("date").alias("_d"), F.col("pos").alias("_p"))), F.col("_d") >= earliest)
        folds = lo.groupBy("period", "asof", "start").agg(F.min("_p").alias("lo"))
        folds = folds.withColumn("hi", F.greatest(F.col("start") - setting.gap, F.col("lo")))
        xs = list(setting.features)
        fs = fold_stats(ridge_stats(df.where(train), xs, y), folds, ["period", "asof", "start"]).where(F.col("n") >= setting.min_rows)
        solved = solve_ridge(fs, len(xs), F.lit(setting.alpha))
        rows = solved.select("period", "asof", F.col("start").cast("int").alias("start"), "n", "w", "b", F.lit(setting.digest).alias("setting"))
        rows.coalesce(1).write.mode("append").parquet(self.root)  # a row for each period


def scores(df: DataFrame, weights: DataFrame, xs: Sequence[str], out: str = "score") -> DataFrame:
    """Rows of the days in ``weights`` (one row for each day) with their score."""
    d = df.join(F.broadcast(weights.select("pos", "asof", "refit", "w", "b")), "pos")
    s = F.col("b")
    for i, x in enumerate(xs):
        s = s + F.col("w")[i] * F.col(x)
    return d.withColumn(out, s).drop("w", "b")

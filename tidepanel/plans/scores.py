"""Diagnostics of a score against forward returns, and calibration of the gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import rolling as R
from tidepanel.operators.ordering import position
from tidepanel.operators.staging import materialize
from tidepanel.plans.metrics import decile, rank_ic


def diagnostics(df: DataFrame, score: str, target: str, valid: Column, lags=(1,), min_names=10, min_decile=50) -> DataFrame:
    """Rank IC, its ratio, decile spread, decay by lag and rank autocorrelation: one row."""
    d = df.withColumns({f"_lag{k}": R.ts_delay(score, k) for k in {1, *lags}}).where(valid)
    d = materialize(d.select("date", "code", score, target, *[f"_lag{k}" for k in {1, *lags}]))
    cases = [("now", score, target), *[(f"lag{k}", f"_lag{k}", target) for k in lags], ("auto", score, "_lag1")]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("case"), F.col(a).alias("a"), F.col(b).alias("b")) for n, a, b in cases]))
    long = d.select("date", "code", rows.alias("_x")).select("date", "code", "_x.*")
    ic = rank_ic(long, "a", "b", ("case", "date"), min_names=min_names)
    pick = lambda n, e: F.when(F.col("case") == n, e)
    ok = F.col("ic").isNotNull()
    stats = ic.where(ok).agg(
        F.avg(pick("now", F.col("ic"))).alias("rank_ic"), (F.avg(pick("now", F.col("ic"))) / F.nullif(F.stddev_pop(pick("now", F.col("ic"))), F.lit(0.0))).alias("icir"),
        F.avg(pick("now", (F.col("ic") > 0).cast("double"))).alias("positive"), *[F.avg(pick(f"lag{k}", F.col("ic"))).alias(f"ic_lag{k}") for k in lags],
        F.avg(pick("auto", F.col("ic"))).alias("autocorr"))
    p = position(d.where(F.col(score).isNotNull() & F.col(target).isNotNull()), ["date"], [score, "code"], "_p", "_n", write=False)
    p = p.where(F.col("_n") >= min_decile).withColumn("_b", decile(F.col("_p"), F.col("_n")))
    spread = p.groupBy("date").agg((F.avg(F.when(F.col("_b") == 9, F.col(target))) - F.avg(F.when(F.col("_b") == 0, F.col(target)))).alias("s"))
    return stats.join(F.broadcast(spread.agg(F.avg("s").alias("decile_spread"))))


def calibration(df: DataFrame, target: str, factors: int, planted_from: int, min_names=20, scale: float = 150000.0,
                min_ic=0.02, min_icir=0.25) -> DataFrame:
    """Gate pass rates of noise factors and of factors with a planted share of the label, in one job."""
    fid = F.explode(F.sequence(F.lit(0), F.lit(factors - 1)))
    d = df.withColumn("fid", fid)
    noise = ((F.col("code") * 7919 + F.col("pos") * 104729 + F.col("fid") * 15485863 + F.col("code") * F.col("pos") * (F.col("fid") + 3) * 31) % 100003).cast("double")
    d = d.withColumn("value", noise + F.when(F.col("fid") >= planted_from, F.col(target) * scale).otherwise(0.0))
    ic = rank_ic(d.select("fid", "date", "code", "value", target), "value", target, ("fid", "date"), min_names=min_names)
    st = ic.groupBy("fid").agg(F.avg("ic").alias("m"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("ir"))
    kind = F.when(F.col("fid") >= planted_from, "planted").otherwise("null")
    return st.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("factors"), F.avg(((F.col("m") >= min_ic) & (F.col("ir") >= min_icir)).cast("double")).alias("pass_rate"),
        F.percentile("ir", 0.5).alias("icir_p50"), F.percentile("ir", 0.9).alias("icir_p90"))

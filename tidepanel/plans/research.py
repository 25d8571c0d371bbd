"""Exploratory probes on the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.columns import div
from tidepanel.operators import rolling as R
from tidepanel.operators.cross import with_stats
from tidepanel.operators.ordering import position, with_rank, with_ranks
from tidepanel.operators.staging import materialize

PROBES = ("vol", "ret", "off_high", "turn", "size", "bp")


def probe_features(df: DataFrame, month=20, vol_n=60, vol_least=40, year=250, year_least=120) -> DataFrame:
    """Six percentile ranks among valid names: volatility, return, distance to high, turnover, size, B/P."""
    d = df.withColumn("_px", R.ffill("close")).withColumn("_lr", F.log1p("ret_1d"))
    d = d.withColumns({
        "_vol": R.ts_std("_lr", vol_n, vol_least), "_ret": div("_px", R.ts_delay("_px", month)) - 1, "_off_high": div("_px", R.ts_max("_px", year, year_least)) - 1,
        "_turn": R.ts_mean("turnover", month, max(1, month // 2)), "_size": F.ln("circ_mv"), "_bp": div(F.lit(1.0), "pb_mrq")})
    return with_ranks(d, ["date"], {f: F.when(F.col("in_universe"), F.col(f"_{f}")) for f in PROBES})


def drop_model(df: DataFrame, features: list[str], fwd: str, limit: float, split: str) -> DataFrame:
    """Logistic model of a large fall fitted before the split, scored after it."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ok = F.col(fwd).isNotNull()
    for f in features:
        ok = ok & F.col(f).isNotNull()
    d = df.where(ok).withColumn("label", (F.col(fwd) <= limit).cast("double"))
    d = VectorAssembler(inputCols=features, outputCol="features").transform(d)
    d = materialize(d.select("date", "code", "label", fwd, "features", *features))
    cut = F.lit(split).cast("date")
    model = LogisticRegression(maxIter=100).fit(d.where(F.col("date") < cut))
    out = model.transform(d.where(F.col("date") >= cut))
    return out.select("date", "code", "label", fwd, *features, vector_to_array("probability")[1].alias("p"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by rank sum with average ties."""
    d = with_rank(df.withColumn("_one", F.lit(1)), ["_one"], score, "_r", pct=False, keys=("date", "code"))
    pos = F.sum(label)
    neg = F.count("*") - pos
    return d.agg((div(F.sum(F.when(F.col(label) == 1, F.col("_r"))) - pos * (pos + 1) / 2, pos * neg)).alias("auc"), F.avg(label).alias("base_rate"))


def probability_report(df: DataFrame, top: float = 0.1) -> DataFrame:
    """Brier score, base rate and lift of the highest scored tenth, by year."""
    d = position(df.withColumn("year", F.year("date")), ["year"], [-F.col("p"), "date", "code"], "_k", "_n", keys=("date", "code"))
    hit = F.col("_k") <= F.greatest(F.floor(F.col("_n") * top), F.lit(1))
    return d.groupBy("year").agg(F.count("*").alias("rows"), F.avg("label").alias("base_rate"), F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2.0))).alias("brier"),
                                 div(F.avg(F.when(hit, F.col("label"))), F.avg("label")).alias("top_lift"))


def pair_switches(df: DataFrame, score: str, fwd: str, draws: int) -> DataFrame:
    """Sampled pairs per date: a name meets the names at ``draws`` pseudo-random places of its date.

    Places are a function of the name's own place, so each name emits a fixed number
    of pairs and the join is an equi join on (date, place).
    """
    ok = F.col(score).isNotNull() & F.col(fwd).isNotNull()
    d = materialize(position(df.where(ok).select("date", "code", score, fwd), ["date"], ["code"], "place", "n"))
    k = F.explode(F.sequence(F.lit(1), F.lit(draws)))
    a = d.withColumn("draw", k).withColumn("other", (F.col("place") * 7919 + F.col("draw") * 104729) % F.col("n") + 1).where("other <> place")
    b = d.select("date", F.col("place").alias("other"), F.col(score).alias("_s2"), F.col(fwd).alias("_f2"))
    j = a.join(b, ["date", "other"])
    return j.select("date", "code", "draw", (F.col(fwd) - F.col("_f2")).alias("diff"), (F.col(score) - F.col("_s2")).alias("gap"))


def switch_report(pairs: DataFrame, buckets: int = 5) -> DataFrame:
    """Sign agreement and mean signed difference by size of the score gap."""
    d = position(pairs.withColumn("_one", F.lit(1)), ["_one"], [F.abs("gap"), "date", "code", "draw"], "_k", "_n", keys=("date", "code", "draw"))
    b = F.least(F.floor((F.col("_k") - 1) * buckets / F.col("_n")) + 1, F.lit(buckets))
    d = d.withColumn("quintile", b.cast("int"))
    return d.groupBy("quintile").agg(F.count("*").alias("pairs"), F.avg((F.signum("diff") == F.signum("gap")).cast("double")).alias("hit_rate"), F.avg(F.signum("gap") * F.col("diff")).alias("signed_difference"))


def cycle_aggregates(df: DataFrame, group: str, window: int, least: int, min_names: int = 3) -> DataFrame:
    """Group book and earnings yield of a date with their share of earlier values in the trailing window."""
    ok = F.col("in_universe") & (F.col("circ_mv") > 0) & F.col("pb_mrq").isNotNull() & F.col("pe_ttm").isNotNull()
    d = with_stats(df, "date", {"_m": F.avg(F.when(F.col("in_universe"), F.col("fwd")))}).where(ok)
    mv = F.sum("circ_mv")
    g = d.groupBy("date", "pos", F.col(group).alias("code")).agg(
        F.count("*").alias("names"), div(F.sum(div("circ_mv", "pb_mrq")), mv).alias("bp"), div(F.sum(div("circ_mv", "pe_ttm")), mv).alias("ep"), (F.avg("fwd") - F.max("_m")).alias("excess"))
    g = g.where(F.col("names") >= min_names)
    w = R.by_code().rowsBetween(-(window - 1), 0)
    for c in ("bp", "ep"):
        seen = F.collect_list(c).over(w)
        lower = F.size(F.filter(seen, lambda v: v < F.col(c)))
        n = F.size(seen)
        g = g.withColumn(f"{c}_pct", F.when(n >= least, lower / F.nullif(n - 1, F.lit(0))))
    return g.withColumnRenamed("code", group)


def announcement_car(events: DataFrame, panel: DataFrame, horizon: int) -> DataFrame:
    """Return from the entry day's open to the carried close ``horizon`` days on, over the pool mean.

    ``events``: event_id, kind, code, pos (entry); ``panel``: dense grid.
    """
    d = panel.withColumn("_px", R.ffill("close"))
    d = d.withColumn("_r", div(R.ts_lead("_px", horizon - 1) if horizon > 1 else F.col("_px"), "open") - 1)
    d = with_stats(d, "pos", {"_pool": F.avg(F.when(F.col("in_universe"), F.col("_r")))})
    d = d.select("code", "pos", "date", (F.col("_r") - F.col("_pool")).alias("car"))
    return events.join(d, ["code", "pos"]).withColumn("month", F.date_format("date", "yyyy-MM"))


def screen_vs_random(df: DataFrame, score: Column, fwd: str, top: int, k: int, draws: int) -> DataFrame:
    """Outcome of k picks from the screen's top names against k picks from the whole pool.

    A draw reads k places of an ordered list through an equi join on (date, place);
    places are a function of the draw number.
    """
    d = df.where(F.col(fwd).isNotNull()).withColumn("_score", score)
    d = materialize(d.select("date", "code", fwd, "_score"))
    pool = position(d, ["date"], ["code"], "place", "n", write=False).withColumn("kind", F.lit("random"))
    best = position(d.where("_score is not null"), ["date"], [-F.col("_score"), "code"], "place", "n", write=False).where(F.col("place") <= top)
    best = best.withColumns({"kind": F.lit("screen"), "n": F.least("n", F.lit(top))})
    both = materialize(pool.unionByName(best).select("date", "kind", "place", "n", F.col(fwd).alias("f")))
    sizes = both.groupBy("date", "kind").agg(F.max("n").alias("n")).where(F.col("n") >= k)
    picks = sizes.select("date", "kind", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    # Consecutive strides from a drawn start never repeat a place inside one draw.
    start = (F.col("draw") * 7919 + 13) % F.col("n")
    step = F.floor(F.col("n") / k)
    picks = picks.withColumn("place", (start + F.col("i") * step) % F.col("n") + 1)
    j = picks.join(both.drop("n"), ["date", "kind", "place"]).groupBy("date", "kind", "draw").agg(F.avg("f").alias("ret"))
    market = d.groupBy("date").agg(F.avg(fwd).alias("_m"))
    j = j.join(F.broadcast(market), "date").withColumn("excess", F.col("ret") - F.col("_m"))
    return j.groupBy("kind").agg(F.count("*").alias("draws"), F.percentile("excess", 0.5).alias("median_excess"), F.avg((F.col("excess") > 0).cast("double")).alias("p_beat"), F.avg((F.col("ret") < -0.3).cast("double")).alias("p_loss_30"))

"""Search-aware inference on trials and daily series."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions import normal
from tidepanel.functions.columns import div
from tidepanel.operators.ordering import position, running

# Fixed value: Euler-Mascheroni constant.
EULER_GAMMA = 0.5772156649015329


def expected_max_ratio(n: Column, variance: Column) -> Column:
    """Expected best of n independent null ratios with the given variance."""
    g = EULER_GAMMA
    many = F.greatest(n, F.lit(2)).cast("double")
    z = (1 - g) * normal.ppf(1 - 1 / many) + g * normal.ppf(1 - 1 / (many * math.e))
    return F.when((n >= 2) & (variance > 0), F.sqrt(variance) * z).otherwise(0.0)


def deflated_probability(ratio: Column, hurdle: Column, t_obs: Column, skew: Column, kurt: Column) -> Column:
    den = 1 - skew * ratio + (kurt - 1) / 4 * ratio * ratio
    ok = (t_obs > 1) & (den > 0) & ratio.isNotNull()
    z = F.when(ok, (ratio - hurdle) * F.sqrt(F.greatest(t_obs - 1, F.lit(0.0))) / F.sqrt(F.when(den > 0, den)))
    return F.coalesce(normal.cdf(z), F.lit(0.0))


def effective_observations(days: Column, horizon: Column) -> Column:
    """Labels of neighbouring days overlap over the horizon, so days count divided by it."""
    return days / F.greatest(horizon, F.lit(1)).cast("double")


def search_discount(trials: DataFrame, by: list[str]) -> DataFrame:
    """Trials, variance of their ratios and the null hurdle, per campaign."""
    d = trials.groupBy(*by).agg(F.count("*").alias("n_trials"), F.coalesce(F.var_samp("icir"), F.lit(0.0)).alias("variance"))
    return d.withColumn("hurdle", expected_max_ratio(F.col("n_trials"), F.col("variance")))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, key: str, q: float) -> DataFrame:
    """Step-up test over each family; a missing p counts as one."""
    d = df.withColumn("p", F.coalesce(F.col(p), F.lit(1.0)))
    d = position(d, by, ["p", key], "rank", "_m", keys=(key,))
    d = d.withColumn("threshold", F.lit(q) * F.col("rank") / F.col("_m"))
    top = d.groupBy(*by).agg(F.max(F.when(F.col("p") <= F.col("threshold"), F.col("rank"))).alias("_top"))
    return d.join(top, by, "left").withColumn("passed", F.coalesce(F.col("rank") <= F.col("_top"), F.lit(False))).drop("_m", "_top")


def holm(df: DataFrame, by: list[str], p: str, key: str) -> DataFrame:
    """Holm-adjusted p: running maximum of (m - rank + 1) p, at most one."""
    d = position(df, by, [p, key], "_rank", "_m", keys=(key,))
    d = d.withColumn("_s", (F.col("_m") - F.col("_rank") + 1) * F.col(p))
    d = running(d, by, ["_rank"], {"_a": ("max", "_s")}, keys=(key,))
    return d.withColumn("adjusted", F.least(F.col("_a"), F.lit(1.0))).drop("_rank", "_m", "_s", "_a")


def hac_mean(series: DataFrame, by: list[str], horizon: int = 1) -> DataFrame:
    """Newey-West test of the mean; lags count trading-day ordinals, gaps stay gaps.

    A series has one value per trading day; each value meets the ones up to ``lag``
    ordinals before it through an equi join on the shifted ordinal.
    """
    d = series.where(F.col("value").isNotNull())
    base = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    lag = F.greatest(F.lit(horizon - 1), F.ceil(4 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9)))).cast("int")
    base = base.withColumn("lag", lag)
    e = d.join(base, by).select(*by, "ordinal", "n", "lag", (F.col("value") - F.col("mean")).alias("e"))
    back = e.select(*by, F.explode(F.sequence(F.lit(0), F.col("lag"))).alias("k"), "ordinal", "e")
    back = back.select(*by, "k", (F.col("ordinal") + F.col("k")).alias("ordinal"), F.col("e").alias("e0"))
    j = e.join(back, [*by, "ordinal"])
    w = F.when(F.col("k") == 0, 1.0).otherwise(2 * (1 - F.col("k") / (F.col("lag") + 1)))
    lr = j.groupBy(*by).agg(F.sum(w * F.col("e") * F.col("e0")).alias("_lr"))
    d = base.join(lr, by)
    two = F.col("n") >= 2
    d = d.withColumn("se", F.when(two, F.sqrt(F.greatest(F.col("_lr") / F.col("n"), F.lit(0.0)) / F.col("n"))))
    z = div("mean", "se")
    flat = F.when(F.col("mean") > 0, 0.0).when(F.col("mean") < 0, 1.0).otherwise(0.5)
    half = NormalDist().inv_cdf(0.975)
    return d.withColumns({
        "p_one_sided": F.when(two, F.when(F.col("se") == 0, flat).otherwise(normal.sf(z))),
        "ci_low": F.col("mean") - half * F.col("se"), "ci_high": F.col("mean") + half * F.col("se")}).drop("_lr")


def intensity_curve(trials: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """Best ratio so far and the null hurdle of the search so far."""
    d = trials.withColumns({"_one": F.lit(1), "_has": F.col("icir").isNotNull().cast("int"), "_sq": F.col("icir") * F.col("icir")})
    d = running(d, by, [order], {"n": ("sum", "_one"), "_k": ("sum", "_has"), "best": ("max", "icir"), "_s": ("sum", "icir"), "_q": ("sum", "_sq")}, keys=(key,))
    k = F.col("_k")
    var = F.when(k > 1, (F.col("_q") - F.col("_s") * F.col("_s") / k) / F.nullif(k - 1, F.lit(0))).otherwise(0.0)
    return d.withColumn("threshold", expected_max_ratio(F.col("n"), var)).drop("_one", "_has", "_sq", "_k", "_s", "_q")


def trial_funnel(trials: DataFrame, levels=("L0", "L1", "L2", "L3")) -> DataFrame:
    """Candidates that reached each level or higher, per campaign; ``level`` is the highest passed one."""
    best = trials.groupBy("campaign", "candidate").agg(F.max("level").alias("level"))
    return best.groupBy("campaign").agg(*[F.count(F.when(F.col("level") >= i, 1)).alias(n) for i, n in enumerate(levels)])


def failure_reasons(trials: DataFrame, schema: str) -> DataFrame:
    """Failed check names of each trial's gate JSON, counted."""
    checks = F.from_json("gate_json", schema)["checks"]
    failed = F.explode(F.filter(checks, lambda c: ~c["passed"]))
    return trials.select("campaign", failed.alias("c")).groupBy("campaign", F.col("c.name").alias("reason")).agg(F.count("*").alias("trials"))


def cell_memory(trials: DataFrame, dead: int = 5) -> DataFrame:
    d = trials.groupBy("domain", "form").agg(F.count("*").alias("trials"), F.sum((F.col("level") >= 1).cast("int")).alias("passes"))
    return d.withColumn("dead", ((F.col("trials") >= dead) & (F.col("passes") == 0)).cast("int"))


def trailing_streak(turns: DataFrame, by: str, order: str, ok: Column) -> DataFrame:
    """Length of the run of not-ok rows at the end of each series: two aggregates, no window."""
    d = turns.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    last = d.where("_ok").groupBy(by).agg(F.max(order).alias("_last"))
    return d.join(last, by, "left").groupBy(by).agg(
        F.count(F.when(F.col("_last").isNull() | (F.col(order) > F.col("_last")), 1)).alias("streak"), F.count("*").alias("used"))


def brier(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"))


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Every bin is reported, also the empty ones."""
    spark = df.sparkSession
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("hit_rate"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(g, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def chain_check(rows: DataFrame, by: list[str], order: str, payload: list[str]) -> DataFrame:
    """Rows whose link or own hash does not hold.

    The predecessor is found by an equi join on the sequence number, so a ledger of
    any length is checked in parallel.
    """
    canon = F.to_json(F.struct(*sorted(payload)))
    prev = rows.select(*by, (F.col(order) + 1).alias(order), F.col("hash").alias("_p"))
    d = rows.join(prev, [*by, order], "left")
    link = F.col("prev_hash") == F.coalesce("_p", F.lit(""))
    own = F.col("hash") == F.sha2(F.concat("prev_hash", canon), 256)
    return d.select(*by, order, link.cast("int").alias("link_ok"), own.cast("int").alias("hash_ok"))


def record_pairing(records: DataFrame) -> DataFrame:
    """Starts and results of each trial's records (trial, seq, kind, voids), with its state.

    A void record takes back the result with the number ``voids`` of its own trial.  A void and the record it names
    meet in one group of (trial, number), so nothing is joined.  State: ``bad_start`` without exactly one
    start, ``many_results`` with more than one standing result, ``open`` with none, else ``ok``.
    """
    void = F.col("kind") == "void"
    named = F.when(void, F.col("voids")).otherwise(F.col("seq")).alias("seq")
    d = records.select("trial", named, void.cast("int").alias("void"), (F.col("kind") == "started").cast("int").alias("start"),
                       F.col("kind").isin("completed", "failed").cast("int").alias("result"))
    g = d.groupBy("trial", "seq").agg(F.sum("start").alias("starts"), F.sum("result").alias("results"), F.max("void").alias("void"), F.sum(1 - F.col("void")).alias("own"))
    g = g.groupBy("trial").agg(F.sum("starts").alias("starts"), F.sum(F.when(F.col("void") == 0, F.col("results")).otherwise(0)).alias("results"), F.sum("own").alias("own"))
    state = F.when(F.col("starts") != 1, "bad_start").when(F.col("results") > 1, "many_results").when(F.col("results") == 0, "open").otherwise("ok")
    return g.where("own > 0").select("trial", "starts", "results", state.alias("state"))


def verdict(df: DataFrame, p_limit=0.05, coverage_min=0.95, floor=-0.08, te=(0.04, 0.06)) -> DataFrame:
    """Class of a finished forward test from its statistics."""
    c = F.col
    cover = F.coalesce(div(c("n"), c("eligible")), F.lit(0.0))
    strat = c("kind") == "strategy"
    dd_bad = strat & (c("drawdown") < floor)
    te_bad = strat & ~c("tracking_error").between(*te)
    reasons = F.array_compact(F.array(
        F.when(c("n") < c("required"), "insufficient_days"), F.when(cover < coverage_min, "low_coverage"),
        F.when(c("p_one_sided").isNull(), "statistics_unavailable"), F.when(c("violation"), "hard_violation"),
        F.when(dd_bad, "drawdown_limit"), F.when(te_bad, "tracking_error_limit"),
        F.when(strat & (c("drawdown").isNull() | c("tracking_error").isNull()), "risk_unavailable")))
    d = df.withColumns({"coverage": cover, "reasons": reasons})
    hard = F.coalesce(c("violation") | dd_bad | te_bad, F.lit(False))
    good = (c("mean") > 0) & (c("p_one_sided") <= p_limit) & c("bh_pass") & (strat | F.coalesce(c("marginal_ic") > 0, F.lit(False)))
    out = (F.when(~c("endpoint"), "observing").when(c("mode") == "diagnostic_shadow", "shadow_complete")
           .when(hard | F.coalesce(c("ci_high") < 0, F.lit(False)), "fresh_failed").when(F.size("reasons") > 0, "fresh_inconclusive")
           .when(F.coalesce(good, F.lit(False)), "fresh_supported").otherwise("fresh_inconclusive"))
    return d.withColumn("verdict", out)


def greedy_keep(corr: DataFrame, coverage: DataFrame, order: list[str], existing: list[str], min_cover: float, max_corr: float) -> DataFrame:
    """Sequential keep rule over the candidate list.

    The rule looks at the candidates kept so far, so it is a fold over the ordered list; the correlations and
    coverages it needs are one map each, whose size the registry of definitions fixes.
    """
    both = corr.select("a", "b", "corr").union(corr.select("b", "a", "corr"))
    known = both.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "a", "b"), "corr"))).alias("m"))
    cov = coverage.agg(F.map_from_entries(F.collect_list(F.struct("factor", "coverage"))).alias("c"))
    kind = "struct<factor:string,coverage:double,max_with:string,max_abs_corr:double,decision:string>"

    def step(done, name):
        peers = F.concat(F.array(*[F.lit(x) for x in existing]).cast("array<string>"), F.transform(F.filter(done, lambda x: x["decision"] == "keep"), lambda x: x["factor"]))
        far = F.transform(peers, lambda p: F.struct(F.coalesce(F.abs(F.element_at("m", F.concat_ws("|", name, p))), F.lit(0.0)).alias("v"), p.alias("p")))
        worst, share = F.array_max(far), F.coalesce(F.element_at("c", name), F.lit(0.0))
        top = F.coalesce(worst["v"], F.lit(0.0))
        decision = F.when(share < min_cover, "drop_coverage").when(top > max_corr, "drop_correlation").otherwise("keep")
        return F.concat(done, F.array(F.struct(name.alias("factor"), share.alias("coverage"), worst["p"].alias("max_with"), top.alias("max_abs_corr"), decision.alias("decision")).cast(kind)))

    names = F.array(*[F.lit(x) for x in order])
    return known.crossJoin(F.broadcast(cov)).select(F.inline(F.aggregate(names, F.array().cast(f"array<{kind}>"), step)))

"""Rolling, cross-section and within-group operators."""

from pyspark.sql import functions as F

from tidepanel.catalog.registry import dense, labelled, query
from tidepanel.functions.columns import day, r
from tidepanel.operators import cross as X
from tidepanel.operators import ordering as O
from tidepanel.operators import rolling as R
from tidepanel.operators.staging import materialize

KEY = "code, strftime(date, '%Y-%m-%d') AS date"


def report(d, cols, digits=6):
    return d.select("code", day("date").alias("date"), *[r(c, digits).alias(c) for c in cols])


def full(agg, x, n):
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {agg} OVER w{n} END"


W = lambda *ns: "WINDOW w AS (PARTITION BY code ORDER BY pos), " + ", ".join(
    f"w{n} AS (PARTITION BY code ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ns)


@query("ts_moving_stats", "W1 W2 W3 W4 W5 P33", dense(f"""
SELECT {KEY}, round({full('avg(close)', 'close', 5)}, 6) AS mean_5, round({full('stddev_samp(close)', 'close', 5)}, 6) AS std_5,
 round({full('sum(volume)', 'volume', 5)}, 6) AS sum_5, round({full('max(high)', 'high', 12)}, 6) AS max_12, round({full('min(low)', 'low', 12)}, 6) AS min_12
FROM dense {W(5, 12)}"""))
def _(s):
    d = s.dense.withColumns({"mean_5": R.ts_mean("close", 5), "std_5": R.ts_std("close", 5), "sum_5": R.ts_sum("volume", 5),
                             "max_12": R.ts_max("high", 12), "min_12": R.ts_min("low", 12)})
    return report(d, ["mean_5", "std_5", "sum_5", "max_12", "min_12"])


@query("ts_rank_window", "W6", dense(f"""
, d AS (SELECT *, list(n_lines) OVER w6 AS seen, count(n_lines) OVER w6 AS c FROM dense {W(6)})
SELECT {KEY}, CASE WHEN c = 6 THEN round((len(list_filter(seen, lambda v: v < n_lines)) + (len(list_filter(seen, lambda v: v = n_lines)) + 1) / 2.0) / 6, 6) END AS rank_6 FROM d"""))
def _(s):
    return report(s.dense.withColumn("rank_6", R.ts_rank("n_lines", 6)), ["rank_6"])


@query("ts_lags", "W7 W8 W9 W10 W38 W41", dense(f"""
, d AS (SELECT *, ln(1 + ret_1d) AS lr FROM dense)
SELECT {KEY}, round(close - lag(close, 3) OVER w, 6) AS delta_3, round(lag(close, 2) OVER w, 6) AS delay_2,
 round((close - {full('avg(close)', 'close', 6)}) / nullif({full('stddev_samp(close)', 'close', 6)}, 0), 6) AS zscore_6,
 round((4 * close + 3 * lag(close, 1) OVER w + 2 * lag(close, 2) OVER w + lag(close, 3) OVER w) / 10, 6) AS decay_4,
 round(CASE WHEN count(lr) OVER w12 >= 8 THEN stddev_samp(lr) OVER w12 END, 6) AS logvol_12
FROM d {W(6, 12)}"""))
def _(s):
    d = s.dense.withColumn("lr", F.ln(1 + F.col("ret_1d")))
    d = d.withColumns({"delta_3": R.ts_delta("close", 3), "delay_2": R.ts_delay("close", 2), "zscore_6": R.ts_zscore("close", 6),
                       "decay_4": R.ts_decay_linear("close", 4), "logvol_12": R.ts_std("lr", 12, 8)})
    return report(d, ["delta_3", "delay_2", "zscore_6", "decay_4", "logvol_12"])


@query("ts_pair_stats", "W11 W12 W24 W25 W26", dense(f"""
, m AS (SELECT date, avg(ret_1d) AS mkt FROM dense GROUP BY date), d0 AS (SELECT d.*, m.mkt FROM dense d JOIN m USING (date)),
d AS (SELECT *, CASE WHEN close IS NOT NULL AND volume IS NOT NULL THEN close END AS a, CASE WHEN close IS NOT NULL AND volume IS NOT NULL THEN volume END AS b,
  CASE WHEN ret_1d IS NOT NULL AND mkt IS NOT NULL THEN mkt END AS m2 FROM d0)
SELECT {KEY}, round(CASE WHEN count(a) OVER w8 = 8 THEN (CASE WHEN isnan(corr(a, b) OVER w8) THEN NULL ELSE corr(a, b) OVER w8 END) END, 6) AS corr_8,
 round(CASE WHEN count(a) OVER w8 = 8 THEN covar_samp(a, b) OVER w8 END, 4) AS cov_8,
 round(CASE WHEN count(ret_1d) OVER w24 >= 12 THEN covar_pop(ret_1d, m2) OVER w24 / nullif(var_pop(m2) OVER w24, 0) END, 6) AS beta_24,
 round(CASE WHEN count(ret_1d) OVER w12 >= 6 THEN stddev_samp(ret_1d) OVER w12 END, 6) AS vol_12,
 round(lag(CASE WHEN count(amount) OVER w12 >= 5 THEN avg(amount) OVER w12 END) OVER w, 2) AS adv_prev
FROM d {W(8, 12, 24)}""".replace("lag(CASE WHEN count(amount) OVER w12 >= 5 THEN avg(amount) OVER w12 END) OVER w", "adv").replace(
    "FROM d WINDOW", "FROM (SELECT *, lag(adv0) OVER (PARTITION BY code ORDER BY pos) AS adv FROM (SELECT *, CASE WHEN count(amount) OVER v >= 5 THEN avg(amount) OVER v END AS adv0 FROM d WINDOW v AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))) WINDOW")))
def _(s):
    d = X.with_stats(s.stored, "date", {"mkt": F.avg("ret_1d")})
    d = d.withColumns({"corr_8": R.ts_corr("close", "volume", 8), "cov_8": R.ts_cov("close", "volume", 8),
                       "beta_24": R.ts_beta("ret_1d", "mkt", 24, 12), "vol_12": R.ts_std("ret_1d", 12, 6), "adv0": R.ts_mean("amount", 12, 5)})
    d = d.withColumn("adv_prev", R.ts_delay("adv0", 1))
    return d.select("code", day("date").alias("date"), *[r(c).alias(c) for c in ("corr_8", "beta_24", "vol_12")],
                    r("cov_8", 4).alias("cov_8"), r("adv_prev", 2).alias("adv_prev"))


AVG = lambda x, by: (f"(rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)")
PCT = lambda x, by: f"CASE WHEN {x} IS NOT NULL THEN {AVG(x, by)} / count({x}) OVER (PARTITION BY {by}) END"


@query("cs_rank", "W13 W20", dense(f"""
SELECT {KEY}, round({PCT('n_lines', 'date')}, 6) AS rank_lines, round({PCT('close', 'date')}, 6) AS rank_close,
 round(coalesce({PCT('close', 'date')} - 0.5, 0), 6) AS centred FROM dense"""))
def _(s):
    d = O.with_ranks(s.dense.select("code", "date", "n_lines", "close"), ["date"], {"rank_lines": "n_lines", "rank_close": "close"})
    d = d.withColumn("centred", F.coalesce(F.col("rank_close") - 0.5, F.lit(0.0)))
    return report(d, ["rank_lines", "rank_close", "centred"])


@query("cs_moments", "W14 W15 W37 M5", labelled(f"""
SELECT {KEY}, round((close - avg(close) OVER d) / nullif(stddev_samp(close) OVER d, 0), 6) AS z, round(close - avg(close) OVER d, 6) AS demean,
  round((close - avg(close) OVER g) / nullif(stddev_samp(close) OVER g, 0), 6) AS group_z,
  round(CASE WHEN in_universe THEN label_1 - avg(label_1) FILTER (WHERE in_universe) OVER d END, 6) AS rel_label
FROM labelled WINDOW d AS (PARTITION BY date), g AS (PARTITION BY date, grp)"""))
def _(s):
    d = materialize(s.labelled.withColumn("lab", F.when(F.col("in_universe"), F.col("label_1"))))
    d = X.cs_zscore(d, {"z": "close"})
    d = X.cs_demean(d, {"demean": "close", "rel_label": "lab"})
    d = X.cs_zscore(d, {"group_z": "close"}, ("date", "grp"))
    return report(d, ["z", "demean", "group_z", "rel_label"])


@query("cs_winsorize", "W16 W21", dense(f"""
, q AS (SELECT *, quantile_cont(close, 0.01) OVER d AS lo, quantile_cont(close, 0.99) OVER d AS hi FROM dense WINDOW d AS (PARTITION BY date)),
c AS (SELECT *, CASE WHEN close IS NOT NULL THEN least(greatest(close, lo), hi) END AS clipped FROM q)
SELECT {KEY}, round(clipped, 6) AS clipped, round(CASE WHEN count(clipped) OVER d >= 3 AND stddev_pop(clipped) OVER d > 0 THEN (clipped - avg(clipped) OVER d) / stddev_pop(clipped) OVER d END, 6) AS winsor_z
FROM c WINDOW d AS (PARTITION BY date)"""))
def _(s):
    d = X.cs_winsorize(s.dense.select("code", "date", "close"), {"clipped": "close"})
    return report(X.winsor_z(d, {"winsor_z": "close"}), ["clipped", "winsor_z"])


NEUTRAL = """
, v AS (SELECT *, CASE WHEN close IS NOT NULL AND circ_mv > 0 THEN close END AS x, CASE WHEN close IS NOT NULL AND circ_mv > 0 THEN ln(circ_mv) END AS z FROM dense),
g AS (SELECT *, x - avg(x) OVER (PARTITION BY date, region) AS xt, z - avg(z) OVER (PARTITION BY date, region) AS zt FROM v),
n AS (SELECT *, CASE WHEN count(xt) OVER d >= {need} THEN xt - coalesce(sum(xt * zt) OVER d / nullif(sum(zt * zt) OVER d, 0), 0) * zt END AS resid FROM g WINDOW d AS (PARTITION BY date))"""


@query("cs_neutralize", "W17", dense(NEUTRAL.format(need="(SELECT count(DISTINCT region) FROM suppliers) + 5") + f"""
SELECT {KEY}, round(resid, 4) AS resid FROM n"""))
def _(s):
    d = s.dense.withColumn("lmv", F.when(F.col("circ_mv") > 0, F.ln("circ_mv")))
    return report(X.cs_neutralize(materialize(d), {"resid": "close"}, "lmv", "region"), ["resid"], 4)


@query("group_rank", "W18 W19", dense(f"""
SELECT {KEY}, round({PCT('close', 'date, region')}, 6) AS grank, round(close - avg(close) OVER (PARTITION BY date, region), 6) AS gdemean FROM dense"""))
def _(s):
    d = X.group_rank(s.dense.select("code", "date", "region", "close"), "close", "grank", "region")
    return report(X.group_demean(d, "close", "gdemean", "region"), ["grank", "gdemean"])


@query("rank_zscore", "W22", dense(f"""
, k AS (SELECT grp, count(*) AS gs FROM suppliers WHERE code IN (SELECT code FROM bars) GROUP BY grp),
a AS (SELECT d.*, k.gs, CASE WHEN in_universe THEN close END AS x FROM dense d JOIN k USING (grp)),
b AS (SELECT *, {PCT('x', 'date')} AS r1, CASE WHEN x IS NULL THEN NULL WHEN gs < 2 THEN 0.5 ELSE {PCT('x', 'date, grp')} END AS r2 FROM a)
SELECT {KEY}, round((r1 - avg(r1) OVER d) / nullif(stddev_pop(r1) OVER d, 0), 6) AS rz, round((r2 - avg(r2) OVER d) / nullif(stddev_pop(r2) OVER d, 0), 6) AS group_rz
FROM b WINDOW d AS (PARTITION BY date)"""))
def _(s):
    d = s.dense.select("code", "date", "grp", "close", "in_universe")
    d = X.rank_z(d, {"rz": "close"}, valid=F.col("in_universe"))
    d = X.rank_z(d, {"group_rz": "close"}, group="grp", valid=F.col("in_universe"))
    return report(d, ["rz", "group_rz"])


@query("residualize_two", "W23", dense(f"""
, v AS (SELECT *, CASE WHEN ok THEN close END AS y, CASE WHEN ok THEN ln(circ_mv) END AS s1, CASE WHEN ok THEN n_lines::DOUBLE END AS s2
   FROM (SELECT *, in_universe AND close IS NOT NULL AND circ_mv > 0 AS ok FROM dense)),
g AS (SELECT *, y - avg(y) OVER gg AS yt, s1 - avg(s1) OVER gg AS a, s2 - avg(s2) OVER gg AS b FROM v WINDOW gg AS (PARTITION BY date, region)),
m AS (SELECT *, sum(a*a) OVER d AS saa, sum(b*b) OVER d AS sbb, sum(a*b) OVER d AS sab, sum(a*yt) OVER d AS say, sum(b*yt) OVER d AS sby, count(yt) OVER d AS k FROM g WINDOW d AS (PARTITION BY date))
SELECT {KEY}, round(CASE WHEN k >= 20 THEN yt - (say*sbb - sby*sab) / nullif(saa*sbb - sab*sab, 0) * a - (sby*saa - say*sab) / nullif(saa*sbb - sab*sab, 0) * b WHEN k >= 3 THEN yt END, 4) AS resid FROM m"""))
def _(s):
    from tidepanel.plans.models import residualize

    d = s.dense.withColumns({"s1": F.when(F.col("circ_mv") > 0, F.ln("circ_mv")), "s2": F.col("n_lines").cast("double")})
    return report(residualize(materialize(d), "close", ["s1", "s2"], "resid", "region", F.col("in_universe"), 20), ["resid"], 4)


@query("fill_and_forward", "W28 W42", dense(f"""
, f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos) AS held FROM dense)
SELECT {KEY}, round(held, 6) AS held, round(lead(held, 6) OVER w / lead(open) OVER w - 1, 6) AS fwd_6 FROM f WINDOW w AS (PARTITION BY code ORDER BY pos)"""))
def _(s):
    d = s.dense.withColumn("held", R.ffill("close"))
    d = d.withColumn("fwd_6", R.ts_lead("held", 6) / F.nullif(R.ts_lead("open", 1), F.lit(0.0)) - 1)
    return report(d, ["held", "fwd_6"])


@query("score_ema", "W34", dense(f"""
, v AS (SELECT *, count(*) FILTER (WHERE ret_1d IS NULL) OVER (PARTITION BY code ORDER BY pos) AS run FROM dense),
n AS (SELECT *, row_number() OVER (PARTITION BY code, run ORDER BY pos) - 1 AS i FROM v WHERE ret_1d IS NOT NULL),
e AS (SELECT code, pos, pow(2, -i / 5.0) * sum(CASE WHEN i = 0 THEN ret_1d ELSE (1 - pow(2, -0.2)) * pow(2, i / 5.0) * ret_1d END) OVER (PARTITION BY code, run ORDER BY pos) AS ema FROM n)
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(ema, 6) AS ema FROM dense LEFT JOIN e USING (code, pos)"""))
def _(s):
    d = s.dense.select("code", "pos", "date", "ret_1d")
    e = R.ema_reset(d, "ret_1d", 5, "ema").join(F.broadcast(s.cal), "pos")
    return report(e, ["ema"])


@query("style_windows", "W27", dense(f"""
, m AS (SELECT date, sum(ret_1d * circ_mv) / nullif(sum(circ_mv) FILTER (WHERE ret_1d IS NOT NULL), 0) AS mkt FROM dense GROUP BY date),
d AS (SELECT x.*, CASE WHEN ret_1d IS NOT NULL THEN mkt END AS m FROM dense x JOIN m USING (date)),
e AS (SELECT {KEY}, ln(circ_mv) AS size, CASE WHEN count(m) OVER w24 >= 12 THEN covar_pop(ret_1d, m) OVER w24 / nullif(var_pop(m) OVER w24, 0) END AS beta,
 ln(lag(close, 1) OVER w / lag(close, 12) OVER w) AS momentum, CASE WHEN count(ret_1d) OVER w24 >= 16 THEN ln(nullif(stddev_pop(ret_1d) OVER w24, 0) * sqrt(12)) END AS volatility,
 CASE WHEN count(amount) OVER w12 >= 9 THEN ln(avg(amount) OVER w12) END AS liquidity, CASE WHEN pb_mrq > 0 THEN ln(1 / pb_mrq) END AS value FROM d {W(12, 24)})
SELECT code, date, round(size, 6) AS size, round(beta, 6) AS beta, round(momentum, 6) AS momentum, round(volatility, 6) AS volatility, round(liquidity, 6) AS liquidity, round(value, 6) AS value FROM e"""))
def _(s):
    from tidepanel.plans.risk import style_windows

    return report(style_windows(s.dense), ["size", "beta", "momentum", "volatility", "liquidity", "value"])


@query("ordered_running", "A24", """
WITH d AS (SELECT user_id, event_id, value, max(value) OVER w AS best, sum(CAST(value AS DECIMAL(18,4))) OVER w AS total FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, best, round(CAST(total AS DOUBLE), 4) AS total FROM d""")
def _(s):
    d = s.table("events").withColumn("dv", F.col("value").cast("decimal(18,4)"))
    d = O.running(d, ["event_type"], ["ts", "event_id"], {"best": ("max", "value"), "total": ("sum", "dv")}, keys=("event_id",))
    return d.select("event_id", "best", r("total", 4).alias("total"))

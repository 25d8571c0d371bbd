"""Probe queries and the larger factor sets."""

from pyspark.sql import functions as F

from tidepanel.catalog.evaluation import AR
from tidepanel.catalog.registry import dense, query
from tidepanel.functions.columns import corr, day, div, r
from tidepanel.operators import rolling as R
from tidepanel.operators.cross import with_stats
from tidepanel.operators.grid import next_trading_day
from tidepanel.operators.staging import materialize
from tidepanel.plans import book as B, factors as FA, research as Q

PCTU = lambda x: f"CASE WHEN {x} IS NOT NULL THEN {AR(x, 'date, (' + x + ' IS NULL)')} / count({x}) OVER (PARTITION BY date) END"
FEAT = f""", p0 AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos) AS px, ln(1 + ret_1d) AS lr FROM dense),
p1 AS (SELECT *, CASE WHEN count(lr) OVER w12 >= 8 THEN stddev_samp(lr) OVER w12 END AS vol0, px / lag(px, 6) OVER w - 1 AS ret0, px / CASE WHEN count(px) OVER w24 >= 12 THEN max(px) OVER w24 END - 1 AS oh0, CASE WHEN count(turnover) OVER w6 >= 3 THEN avg(turnover) OVER w6 END AS tn0, ln(circ_mv) AS sz0, 1 / pb_mrq AS bp0, lead(px, 6) OVER w / lead(open) OVER w - 1 AS fwd FROM p0
 WINDOW w AS (PARTITION BY code ORDER BY pos), w6 AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), w12 AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), w24 AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
p2 AS (SELECT code, date, pos, in_universe, fwd, pe_ttm, pb_mrq, circ_mv, region, """ + ", ".join(f"CASE WHEN in_universe THEN {a}0 END AS {a}" for a in ("vol", "ret", "oh", "tn", "sz", "bp")) + "), pf AS (SELECT code, date, pos, in_universe, fwd, pe_ttm, pb_mrq, circ_mv, region, " .replace("), pf", " FROM p1), pf") + ", ".join(f"{PCTU(a)} AS {b}" for a, b in zip(("vol", "ret", "oh", "tn", "sz", "bp"), Q.PROBES)) + " FROM p2)"


def features(s):
    d = s.dense.withColumn("_f", R.ffill("close"))
    d = d.withColumn("fwd", div(R.ts_lead("_f", 6), R.ts_lead("open", 1)) - 1)
    return Q.probe_features(d, 6, 12, 8, 24, 12)


@query("probe_features", "W43 W41 W42", dense(FEAT + " SELECT code, strftime(date, '%Y-%m-%d') AS date, round(fwd, 6) AS fwd, " + ", ".join(f"round({c}, 6) AS {c}" for c in Q.PROBES) + " FROM pf"))
def _(s):
    return features(s).select("code", day("date").alias("date"), r("fwd").alias("fwd"), *[r(c).alias(c) for c in Q.PROBES])


@query("drop_risk_by_year", "A33")
def _(s):
    d = Q.drop_model(features(s).where("in_universe"), list(Q.PROBES), "fwd", -0.15, "1999-01-01")
    return Q.probability_report(d).select("year", "rows", *[r(c, 4).alias(c) for c in ("base_rate", "brier", "top_lift")])


@query("volatility_auc", "A33", dense(FEAT + """, t AS (SELECT (fwd <= -0.15::DOUBLE)::INT AS label, rank() OVER (ORDER BY vol) + (count(*) OVER (PARTITION BY vol) - 1) / 2.0 AS r FROM pf WHERE in_universe AND fwd IS NOT NULL AND vol IS NOT NULL)
SELECT round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) AS auc, round(avg(label), 6) AS base_rate FROM t"""))
def _(s):
    d = features(s).where("in_universe and fwd is not null and vol is not null").select("date", "code", "vol", (F.col("fwd") <= -0.15).cast("int").alias("label"))
    return Q.auc(d, "vol", "label").select(r("auc").alias("auc"), r("base_rate").alias("base_rate"))


SWITCH = dense(FEAT + """, sc AS (SELECT date, code, (1 - ret) + (1 - vol) AS score, fwd FROM pf WHERE in_universe AND ret IS NOT NULL AND vol IS NOT NULL AND fwd IS NOT NULL), pl AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY code) AS place, count(*) OVER (PARTITION BY date) AS n FROM sc),
pr AS (SELECT a.date, a.code, d AS draw, a.fwd - b.fwd AS diff, a.score - b.score AS gap FROM pl a, (SELECT unnest([1, 2, 3, 4]) AS d) x JOIN pl b ON b.date = a.date AND b.place = (a.place * 7919 + d * 104729) % a.n + 1 WHERE b.place <> a.place), rg AS (SELECT *, round(gap, 9) AS g FROM pr),
qk AS (SELECT *, row_number() OVER (ORDER BY abs(g), date, code, draw) AS k, count(*) OVER () AS n FROM rg) SELECT least(floor((k - 1) * 5 / n) + 1, 5)::INT AS quintile, count(*) AS pairs, round(avg((sign(diff) = sign(g))::INT), 6) AS hit_rate, round(avg(sign(g) * diff), 6) AS signed_difference FROM qk GROUP BY 1""")


@query("pair_switch_report", "A34", SWITCH)
def _(s):
    d = features(s).where("in_universe").withColumn("score", (1 - F.col("ret")) + (1 - F.col("vol")))
    p = Q.pair_switches(d, "score", "fwd", 4).withColumn("gap", F.round("gap", 9))
    return Q.switch_report(p).select("quintile", "pairs", r("hit_rate").alias("hit_rate"), r("signed_difference").alias("signed_difference"))


CYC = dense(FEAT + """, mk AS (SELECT *, avg(fwd) FILTER (WHERE in_universe) OVER (PARTITION BY date) AS m FROM pf), g AS (SELECT date, pos, region, count(*) AS names, sum(circ_mv / pb_mrq) / sum(circ_mv) AS bp, sum(circ_mv / pe_ttm) / sum(circ_mv) AS ep, avg(fwd) - max(m) AS excess FROM mk WHERE in_universe AND circ_mv > 0 AND pb_mrq IS NOT NULL AND pe_ttm IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
w AS (SELECT *, list(bp) OVER v AS lb, list(ep) OVER v AS le FROM g WINDOW v AS (PARTITION BY region ORDER BY pos ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, CASE WHEN len(lb) >= 12 THEN len(list_filter(lb, lambda x: x < bp)) * 1.0 / (len(lb) - 1) END AS bp_pct, CASE WHEN len(le) >= 12 THEN len(list_filter(le, lambda x: x < ep)) * 1.0 / (len(le) - 1) END AS ep_pct FROM w)""")


def cycle(s):
    d = s.dense.withColumn("_f", R.ffill("close")).withColumn("fwd", div(R.ts_lead("_f", 6), R.ts_lead("open", 1)) - 1)
    return Q.cycle_aggregates(d, "region", 36, 12)


@query("cycle_aggregates", "A31", CYC + " SELECT strftime(date, '%Y-%m-%d') AS date, region, names, round(bp, 6) AS bp, round(ep, 6) AS ep, round(excess, 6) AS excess, round(bp_pct, 6) AS bp_pct, round(ep_pct, 6) AS ep_pct FROM c")
def _(s):
    return cycle(s).select(day("date").alias("date"), "region", "names", *[r(c).alias(c) for c in ("bp", "ep", "excess", "bp_pct", "ep_pct")])


@query("cycle_rank_correlation", "A31", CYC + f", u AS (SELECT * FROM c WHERE bp_pct IS NOT NULL AND ep_pct IS NOT NULL AND excess IS NOT NULL), rk AS (SELECT region, {AR('bp_pct', 'region')} AS a, {AR('ep_pct', 'region')} AS b, {AR('excess', 'region')} AS e FROM u) SELECT region, count(*) AS months, round(corr(a, e), 6) AS corr_bp, round(corr(b, e), 6) AS corr_ep FROM rk GROUP BY region")
def _(s):
    from tidepanel.operators.ordering import with_ranks

    u = cycle(s).where("bp_pct is not null and ep_pct is not null and excess is not null")
    u = with_ranks(u, ["region"], {"a": "bp_pct", "b": "ep_pct", "e": "excess"}, pct=False, keys=("date",))
    return u.groupBy("region").agg(F.count("*").alias("months"), r(corr("a", "e")).alias("corr_bp"), r(corr("b", "e")).alias("corr_ep"))


@query("announcement_car", "A32 J15", dense("""
, ev AS (SELECT o_orderkey AS event_id, o_orderpriority AS kind, o_custkey % (SELECT count(*) FROM supplier) AS code, (SELECT min(pos) FROM cal WHERE cal.date > o_orderdate) AS pos FROM orders), p0 AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos) AS px FROM dense), p1 AS (SELECT *, lead(px, 4) OVER (PARTITION BY code ORDER BY pos) / open - 1 AS r FROM p0),
p2 AS (SELECT code, pos, date, r - avg(r) FILTER (WHERE in_universe) OVER (PARTITION BY pos) AS car FROM p1), j AS (SELECT kind, car, strftime(date, '%Y-%m') AS month FROM ev JOIN p2 USING (code, pos) WHERE car IS NOT NULL), m AS (SELECT kind, month, avg(car) AS m, count(*) AS n, sum(car) AS s FROM j GROUP BY ALL)
SELECT kind, sum(n)::BIGINT AS n, round(sum(s) / sum(n), 6) AS mean, round(CASE WHEN sum(n) >= 30 AND count(*) >= 6 THEN avg(m) / (stddev_samp(m) / sqrt(count(*))) END, 5) AS t FROM m GROUP BY kind"""))
def _(s):
    n = s.table("supplier").agg(F.count("*").alias("_n"))
    ev = s.table("orders").join(F.broadcast(n)).select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % F.col("_n")).alias("code"), F.col("o_orderdate").cast("date").alias("d"))
    ev = next_trading_day(ev, s.cal, "d", "_e", "pos").select("event_id", "kind", "code", "pos")
    d = B.clustered_t(Q.announcement_car(ev, s.stored, 5), "car", "month", ["kind"], 30, 6)
    return d.select("kind", "n", r("mean").alias("mean"), r("t", 5).alias("t"))


@query("screen_vs_random", "A35", dense(FEAT + """, sc AS (SELECT date, code, fwd, CASE WHEN pe_ttm > 0 AND pb_mrq > 0 THEN 1 / pe_ttm + pb_mrq / pe_ttm / 100 END AS score FROM pf WHERE in_universe AND fwd IS NOT NULL),
po AS (SELECT date, 'random' AS kind, fwd, row_number() OVER (PARTITION BY date ORDER BY code) AS place, count(*) OVER (PARTITION BY date) AS n FROM sc), bs AS (SELECT date, 'screen' AS kind, fwd, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS place, least(count(*) OVER (PARTITION BY date), 20) AS n FROM sc WHERE score IS NOT NULL),
bo AS (SELECT * FROM po UNION ALL SELECT * FROM bs WHERE place <= 20), sz AS (SELECT date, kind, max(n) AS n FROM bo GROUP BY ALL HAVING max(n) >= 3), pk AS (SELECT date, kind, d AS draw, (((d * 7919 + 13) % n) + i * (n // 3)) % n + 1 AS place FROM sz, (SELECT unnest(range(20)) AS d), (SELECT unnest([0, 1, 2]) AS i)),
dr AS (SELECT date, kind, draw, avg(fwd) AS ret FROM pk JOIN bo USING (date, kind, place) GROUP BY ALL), mk AS (SELECT date, avg(fwd) AS m FROM sc GROUP BY date), ex AS (SELECT kind, ret, ret - m AS excess FROM dr JOIN mk USING (date))
SELECT kind, count(*) AS draws, round(quantile_cont(excess, 0.5), 6) AS median_excess, round(avg((excess > 0)::INT), 6) AS p_beat, round(avg((ret < -0.3::DOUBLE)::INT), 6) AS p_loss_30 FROM ex GROUP BY kind"""))
def _(s):
    d = s.dense.withColumn("_f", R.ffill("close")).withColumn("fwd", div(R.ts_lead("_f", 6), R.ts_lead("open", 1)) - 1)
    score = F.when((F.col("pe_ttm") > 0) & (F.col("pb_mrq") > 0), 1 / F.nullif("pe_ttm", F.lit(0.0)) + F.col("pb_mrq") / F.nullif("pe_ttm", F.lit(0.0)) / 100)
    out = Q.screen_vs_random(d.where("in_universe"), score, "fwd", 20, 3, 20)
    return out.select("kind", "draws", r("median_excess").alias("median_excess"), r("p_beat").alias("p_beat"), r("p_loss_30").alias("p_loss_30"))


W12 = lambda agg, x, k=3: f"CASE WHEN count({x}) OVER w6 >= {k} THEN {agg} OVER w6 END"


@query("candidate_factors", "N-F4", dense("""
, mk AS (SELECT *, avg(ret_1d) OVER (PARTITION BY date) AS mkt FROM dense), a AS (SELECT *, CASE WHEN ret_1d IS NOT NULL THEN least(ret_1d, 0) END AS dn, CASE WHEN ret_1d IS NOT NULL THEN mkt END AS m2 FROM mk),
b AS (SELECT *, CASE WHEN count(ret_1d) OVER w12 >= 6 THEN covar_samp(ret_1d, mkt) OVER w12 END / var_samp(mkt) OVER w12 AS bm FROM a WINDOW w12 AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), c AS (SELECT *, ret_1d - bm * mkt AS eps FROM b)
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(close / lag(close, 12) OVER w - 1, 6) AS mom_quarter, round(lag(close, 6) OVER w / lag(close, 24) OVER w - 1, 6) AS mom_year_skip, round(close / CASE WHEN count(close) OVER w24 >= 12 THEN max(close) OVER w24 END - 1, 6) AS dist_high,
 round(CASE WHEN count(ret_1d) OVER w12 >= 6 THEN skewness(ret_1d) OVER w12 END, 5) AS ret_skew, round(CASE WHEN count(dn) OVER w12 >= 6 THEN stddev_samp(dn) OVER w12 END, 6) AS downside_vol,
 round(CASE WHEN count(turnover) OVER w6 >= 3 THEN stddev_samp(turnover) OVER w6 / avg(turnover) OVER w6 END, 6) AS turnover_cv, round(ln(greatest(close, 0.01)) + CASE WHEN close IS NULL THEN NULL ELSE 0 END, 6) AS log_price, round(CASE WHEN count(eps) OVER w12 >= 6 THEN stddev_samp(eps) OVER w12 END, 6) AS idio_vol
FROM c WINDOW w AS (PARTITION BY code ORDER BY pos), w6 AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), w12 AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), w24 AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""))
def _(s):
    want = ["mom_quarter", "mom_year_skip", "dist_high", "ret_skew", "downside_vol", "turnover_cv", "log_price", "idio_vol"]
    d = with_stats(s.stored, "date", {"mkt": F.avg("ret_1d")})
    d = FA.evaluate(d, [f for f in FA.candidate_factors(6, 12, 24) if f.name in want])
    return d.select("code", day("date").alias("date"), *[r(c, 5 if c == "ret_skew" else 6).alias(c) for c in want])


@query("candidate_factors_statement", "N-F4")
def _(s):
    """Statement, value and flow candidates on fields attached to the panel."""
    from tidepanel.plans import pit
    from tidepanel.sources import lookalikes as L

    st = materialize(pit.statement_ratios(**L.statements(s)))
    right = pit.align_statements(st, s.cal).withColumn("eff", F.col("date"))
    cols = ["roe", "gross_margin", "cash_to_assets", "debt_to_assets", "debt_to_equity", "goodwill_to_equity", "equity_growth", "rev_growth"]
    from tidepanel.operators.joins import asof_join

    d = asof_join(s.dense, right, fields=cols).withColumnRenamed("equity_growth", "yoy_equity")
    d = d.withColumns({"limit_up": F.col("close") * 1.01, "ps_ttm": F.col("pe_ttm") * 2, "ocf": F.col("amount") * 0.1, "profit": F.col("amount") * 0.08, "op_margin_ttm": F.col("gross_margin") - 0.1,
                       "rd_to_rev": F.col("cash_to_assets") / 2, "main_ratio": F.col("turnover"), "block_ratio": F.col("turnover") / 2})
    want = [f for f in FA.candidate_factors(6, 12, 24) if f.name not in ("idio_vol",)]
    d = FA.evaluate(d, want)
    return d.select("code", day("date").alias("date"), *[r(f.name).alias(f.name) for f in want])


PCT = "CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date, ({x} IS NULL) ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"


@query("value_mix", "N-F4", dense(f"""
, v AS (SELECT code, date, CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END AS a, CASE WHEN pb_mrq > 0 THEN 1 / pb_mrq END AS b, CASE WHEN volume * (code % 41 - 4) > 0 THEN 1 / (amount / (volume * (code % 41 - 4))) END AS c FROM dense)
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(({PCT.format(x='a')} + {PCT.format(x='b')} + {PCT.format(x='c')}) / 3, 6) AS value_mix FROM v"""))
def _(s):
    d = s.dense.withColumn("ps_ttm", F.col("amount") / F.nullif(F.col("volume") * (F.col("code") % 41 - 4), F.lit(0)))
    return FA.value_mix(d).select("code", day("date").alias("date"), r("value_mix").alias("value_mix"))


@query("fund_factors", "N-F5", dense("""
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(close / lag(close, 6) OVER w - 1, 6) AS mom_a, round(lag(close, 6) OVER w / lag(close, 24) OVER w - 1, 6) AS mom_skip, round(-(close / lag(close, 5) OVER w - 1), 6) AS rev_5, round(CASE WHEN count(ret_1d) OVER w6 >= 4 THEN stddev_samp(ret_1d) OVER w6 END, 6) AS fvol_a,
 round(close / CASE WHEN count(close) OVER w12 >= 8 THEN max(close) OVER w12 END - 1, 6) AS drawdown, round(close / CASE WHEN count(close) OVER w12 >= 8 THEN avg(close) OVER w12 END - 1, 6) AS ma_gap,
 round(CASE WHEN count(amount) OVER w5 >= 3 THEN avg(amount) OVER w5 END / CASE WHEN count(amount) OVER w12 >= 6 THEN avg(amount) OVER w12 END, 6) AS amount_ratio
FROM dense WINDOW w AS (PARTITION BY code ORDER BY pos), w5 AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w6 AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), w12 AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""))
def _(s):
    want = ["mom_a", "mom_skip", "rev_5", "fvol_a", "drawdown", "ma_gap", "amount_ratio"]
    d = FA.evaluate(s.dense, FA.fund_factors(6, 12, 24, 24))
    return d.select("code", day("date").alias("date"), *[r(c).alias(c) for c in want])

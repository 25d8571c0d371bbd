"""Portfolio construction, diagnostics and mapped features."""

from pyspark.sql import functions as F

from tidepanel.catalog.evaluation import AR, DAILY, daily
from tidepanel.catalog.registry import dense, labelled, query
from tidepanel.catalog.panelbuild import PROXY
from tidepanel.functions.columns import corr, day, r
from tidepanel.operators import cross as X, rolling as R
from tidepanel.operators.staging import materialize
from tidepanel.plans import metrics as M, panel as PN, portfolio as P

PCTU = lambda x, by="date": f"CASE WHEN {x} IS NOT NULL THEN {AR(x, by + ', (' + x + ' IS NULL)')} / count({x}) OVER (PARTITION BY {by}) END"


TARGET_SQL = f"""
, v AS (SELECT date, code, region, vwap, circ_mv, {AR('vwap', 'date')} / count(*) OVER (PARTITION BY date) - 0.5::DOUBLE AS t, row_number() OVER (PARTITION BY date, region ORDER BY vwap DESC, code) AS place, count(*) OVER (PARTITION BY date, region) AS size
  FROM dense WHERE in_universe AND vwap IS NOT NULL AND circ_mv > 0),
g AS (SELECT date, region, sum(circ_mv) / sum(sum(circ_mv)) OVER (PARTITION BY date) AS b, avg(t) AS tilt FROM v GROUP BY date, region),
c AS (SELECT *, greatest(b - 0.05::DOUBLE, 0) AS lo, b + 0.05::DOUBLE AS hi, least(greatest(b + 0.05::DOUBLE * least(greatest(2 * tilt, -1), 1), greatest(b - 0.05::DOUBLE, 0)), b + 0.05::DOUBLE) AS x FROM g),
m AS (SELECT *, 1 - sum(x) OVER d AS gap, CASE WHEN 1 - sum(x) OVER d > 0 THEN hi - x ELSE lo - x END AS room FROM c WINDOW d AS (PARTITION BY date)),
k AS (SELECT *, x + room * least(coalesce(abs(gap) / nullif(abs(sum(room) OVER (PARTITION BY date)), 0), 0), 1) AS y FROM m),
n AS (SELECT date, region, y / sum(y) OVER (PARTITION BY date) AS target FROM k),
h AS (SELECT v.*, target, least(size, greatest(1, ceil(target / 0.08::DOUBLE - 1e-9))) AS held FROM v JOIN n USING (date, region)),
w AS (SELECT *, CASE WHEN place <= held THEN least(0.08::DOUBLE, target / held) ELSE 0 END AS w FROM h),
o AS (SELECT *, CASE WHEN w > 0 THEN greatest(0.08::DOUBLE - w, 0) ELSE 0 END AS rm FROM w),
f AS (SELECT *, w + rm * least(coalesce(greatest(1 - sum(w) OVER (PARTITION BY date), 0) / nullif(sum(rm) OVER (PARTITION BY date), 0), 0), 1) AS z FROM o)
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(z / sum(z) OVER (PARTITION BY date), 8) AS weight FROM f"""


@query("target_weights", "M7 D14", dense(TARGET_SQL))
def _(s):
    d = P.target_weights(s.dense, "vwap", "region", 0.05, 0.08)
    return d.select("code", day("date").alias("date"), r("weight", 8).alias("weight"))


ACC = """acc AS (SELECT o_custkey AS account, o_orderkey % 5 AS code, max(o_totalprice) AS v FROM orders GROUP BY ALL), vol AS (SELECT account, code, CASE WHEN (account + code) % 7 = 0 THEN NULL ELSE 0.1::DOUBLE + v / 1000000 END AS vol FROM acc),
iv AS (SELECT account, code, 1 / CASE WHEN vol > 0 THEN vol ELSE coalesce(avg(vol) OVER (PARTITION BY account), 1) END AS raw FROM vol)"""


@query("capped_weights", "M15", f"""WITH {ACC}, a AS (SELECT *, row_number() OVER p - 1 AS j, sum(raw) OVER (PARTITION BY account ORDER BY raw DESC, code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM iv WINDOW p AS (PARTITION BY account ORDER BY raw DESC, code)),
p AS (SELECT *, raw * (1 - 0.3::DOUBLE * j) > (0.3::DOUBLE + 1e-12) * rest AS pin FROM a)
SELECT account, code, round(CASE WHEN pin THEN 0.3::DOUBLE ELSE raw / sum(CASE WHEN NOT pin THEN raw END) OVER (PARTITION BY account) * greatest(1 - 0.3::DOUBLE * count(*) FILTER (WHERE pin) OVER (PARTITION BY account), 0) END, 8) AS weight FROM p""")
def _(s):
    o = s.table("orders").groupBy(F.col("o_custkey").alias("account"), (F.col("o_orderkey") % 5).alias("code")).agg(F.max("o_totalprice").alias("v"))
    o = o.withColumn("vol", F.when((F.col("account") + F.col("code")) % 7 != 0, 0.1 + F.col("v") / 1000000))
    return P.capped_weights(P.inverse_vol(o, ["account"], "vol"), ["account"], "raw", 0.3).select("account", "code", r("weight", 8).alias("weight"))


HIST = """, wt AS (SELECT code, date, pos, region, in_universe, CASE WHEN in_universe THEN n_lines ELSE 0 END * 1.0::DOUBLE / nullif(sum(CASE WHEN in_universe THEN n_lines END) OVER (PARTITION BY date), 0) AS weight, CASE WHEN in_universe THEN circ_mv ELSE 0 END / nullif(sum(CASE WHEN in_universe THEN circ_mv END) OVER (PARTITION BY date), 0) AS bench, ln(circ_mv) AS size, 1 + (code % 5 - 2) / 10.0::DOUBLE AS beta FROM dense WHERE pos % 3 = 0)"""


@query("weight_diagnostics", "A56", dense(HIST + """
, z AS (SELECT *, coalesce((size - avg(size) FILTER (WHERE in_universe) OVER d) / nullif(stddev_samp(size) FILTER (WHERE in_universe) OVER d, 0), 0) AS z, abs(weight - lag(weight) OVER (PARTITION BY code ORDER BY pos)) AS mv FROM wt WINDOW d AS (PARTITION BY date)),
g AS (SELECT date, count(*) FILTER (WHERE weight > 0) AS names, max(weight) AS mx, max(abs(weight - bench)) AS act, 0.5 * sum(mv) AS turn, sum((weight - bench) * z) AS asz, sum(weight * beta) AS beta FROM z GROUP BY date), i AS (SELECT max(v) AS v FROM (SELECT abs(sum(weight) - sum(bench)) AS v FROM z GROUP BY date, region))
SELECT count(*) AS rebalances, round(avg(names), 6) AS names_held_mean, round(max(mx), 6) AS max_name_weight, round(max(act), 6) AS max_active_name_weight, round(avg(turn), 6) AS one_way_turnover_mean, round(max(turn), 6) AS one_way_turnover_max, round(avg(asz), 6) AS active_size_mean, round(max(abs(asz)), 6) AS active_size_max_abs, round(avg((turn > 0.3::DOUBLE + 1e-6)::INT), 6) AS over_cap_share, round(avg(beta), 6) AS beta_mean, (SELECT round(v, 6) FROM i) AS max_industry_deviation FROM g"""))
def _(s):
    d = s.stored.where("pos % 3 = 0")
    d = X.with_stats(d, "date", {"_n": F.sum(F.when(F.col("in_universe"), F.col("n_lines"))), "_c": F.sum(F.when(F.col("in_universe"), F.col("circ_mv")))})
    d = d.select("code", "date", "pos", "region", "in_universe", (F.when(F.col("in_universe"), F.col("n_lines")).otherwise(0) / F.nullif("_n", F.lit(0))).alias("weight"),
                 (F.when(F.col("in_universe"), F.col("circ_mv")).otherwise(0.0) / F.nullif("_c", F.lit(0.0))).alias("bench"), F.ln("circ_mv").alias("size"), (1 + (F.col("code") % 5 - 2) / 10.0).alias("beta"))
    out = P.weight_diagnostics(materialize(d), "region", 0.3)
    return out.select("rebalances", *[r(c).alias(c) for c in out.columns if c != "rebalances"])


EXPO = HIST + """, ex AS (SELECT 't' || (code % 2) AS trial, date, region, sum(weight - bench) AS active FROM wt GROUP BY ALL)"""


def expo(s):
    d = s.stored.where("pos % 3 = 0")
    d = X.with_stats(d, "date", {"_n": F.sum(F.when(F.col("in_universe"), F.col("n_lines"))), "_c": F.sum(F.when(F.col("in_universe"), F.col("circ_mv")))})
    w = F.when(F.col("in_universe"), F.col("n_lines")).otherwise(0) / F.nullif("_n", F.lit(0)) - F.when(F.col("in_universe"), F.col("circ_mv")).otherwise(0.0) / F.nullif("_c", F.lit(0.0))
    return d.groupBy(F.concat(F.lit("t"), (F.col("code") % 2).cast("string")).alias("trial"), "date", "region").agg(F.sum(w).alias("active"))


@query("active_summary", "A53", dense(EXPO + """, m AS (SELECT trial, date, max(abs(active)) AS m FROM ex GROUP BY ALL) SELECT trial, count(*) AS rebalances, round(avg(m), 6) AS mean_max, round(quantile_cont(m, 0.5), 6) AS median_max, round(quantile_cont(m, 0.9), 6) AS p90_max, round(max(m), 6) AS worst_max, round(avg((m > 0.02::DOUBLE + 1e-8)::INT), 6) AS breach_share FROM m GROUP BY trial"""))
def _(s):
    d = P.active_summary(expo(s), ["trial"])
    return d.select("trial", "rebalances", *[r(c).alias(c) for c in ("mean_max", "median_max", "p90_max", "worst_max", "breach_share")])


@query("active_drivers", "A53 T3", dense(EXPO + """, g AS (SELECT trial, region, sum((abs(active) > 0.02::DOUBLE + 1e-8)::INT) AS exceed_days, max(abs(active)) AS mx FROM ex GROUP BY ALL) SELECT trial, region, exceed_days::BIGINT AS exceed_days, round(mx, 6) AS max_abs, row_number() OVER (PARTITION BY trial ORDER BY exceed_days DESC, mx DESC, region)::INT AS place FROM g QUALIFY place <= 3"""))
def _(s):
    d = P.active_drivers(expo(s), ["trial"], "region", 3)
    return d.select("trial", "region", "exceed_days", r("max_abs").alias("max_abs"), "place")


HOLD = """, holdings AS (SELECT l_partkey % 12 AS fund, l_suppkey AS code, CAST(sum(CAST(l_extendedprice AS DECIMAL(24,4))) AS DOUBLE) AS v FROM lineitem GROUP BY ALL), hw AS (SELECT fund, code, v / sum(v) OVER (PARTITION BY fund) AS weight FROM holdings),
iw0 AS (SELECT fund, grp, sum(weight) AS w FROM hw JOIN suppliers USING (code) GROUP BY ALL), iw1 AS (SELECT *, sum(w) OVER (PARTITION BY fund ORDER BY w DESC, grp) AS acc, sum(w) OVER (PARTITION BY fund) AS t FROM iw0),
iw AS (SELECT fund, grp, w / sum(w) OVER (PARTITION BY fund) AS weight FROM iw1 WHERE acc - w < 0.8::DOUBLE * t)"""


def holdings(s):
    h = s.table("lineitem").groupBy((F.col("l_partkey") % 12).alias("fund"), F.col("l_suppkey").alias("code")).agg(F.sum(F.col("l_extendedprice").cast("decimal(24,4)")).cast("double").alias("v"))
    h = X.with_stats(h, "fund", {"_t": F.sum("v")})
    return h.select("fund", "code", (F.col("v") / F.nullif("_t", F.lit(0.0))).alias("weight"))


def industry_weights(s):
    h = holdings(s).join(s.suppliers, "code").groupBy("fund", "grp").agg(F.sum("weight").alias("w"))
    return P.cover_to_share(h, "fund", "grp", "w", 0.8)


@query("cover_to_share", "T6", dense(HOLD + " SELECT fund, grp, round(weight, 6) AS weight FROM iw"))
def _(s):
    return industry_weights(s).select("fund", "grp", r("weight").alias("weight"))


FEATS = ["mom_20", "mom_60", "mom_120", "rev_5", "dist_high_250", "flow_5", "flow_20", "surprise_in", "growth_pos", "ep", "bp", "turnover_rel", "limit_up_20"]
FSQL = f"""
, fi AS (SELECT *, close / open - 1 AS flow, vwap / close - 1 AS surprise_in, (ret_1d > 0)::INT::DOUBLE AS growth_pos, (close >= lag(close) OVER (PARTITION BY code ORDER BY pos) * 1.1::DOUBLE * 0.9995::DOUBLE)::INT::DOUBLE AS hit FROM dense),
ft AS (SELECT *, close / lag(close, 6) OVER w - 1 AS mom_20, close / lag(close, 12) OVER w - 1 AS mom_60, close / lag(close, 24) OVER w - 1 AS mom_120, -(close / lag(close, 2) OVER w - 1) AS rev_5,
 close / CASE WHEN count(close) OVER w24 >= 11 THEN max(close) OVER w24 END - 1 AS dist_high_250, avg(flow) OVER w2 AS flow_5, CASE WHEN count(flow) OVER w6 >= 3 THEN avg(flow) OVER w6 END AS flow_20,
 CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END AS ep, CASE WHEN pb_mrq > 0 THEN 1 / pb_mrq END AS bp, CASE WHEN count(turnover) OVER w6 >= 3 THEN avg(turnover) OVER w6 END / CASE WHEN count(turnover) OVER w24 >= 11 THEN avg(turnover) OVER w24 END AS turnover_rel,
 CASE WHEN count(hit) OVER w6 >= 3 THEN sum(hit) OVER w6 END AS limit_up_20, CASE WHEN in_universe AND circ_mv > 0 THEN circ_mv END AS c FROM fi
 WINDOW w AS (PARTITION BY code ORDER BY pos), w2 AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), w6 AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), w24 AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
fu AS (SELECT code, date, pos, grp, c, """ + ", ".join(f"CASE WHEN in_universe THEN {f} END AS {f}" for f in FEATS) + """ FROM ft), fp AS (SELECT code, date, pos, grp, c, """ + ", ".join(f"{PCTU(f)} AS {f}" for f in FEATS) + """ FROM fu),
im AS (SELECT date, grp, count(c) AS names, """ + ", ".join(f"CASE WHEN count(c) >= 2 THEN sum({f} * c) / nullif(sum(CASE WHEN {f} IS NOT NULL THEN c END), 0) END AS {f}" for f in FEATS) + ", CASE WHEN count(c) >= 2 THEN stddev_pop(mom_20) FILTER (WHERE c IS NOT NULL) END AS dispersion FROM fp GROUP BY ALL)"


def features(s):
    """Flow, surprise, growth and limit stand-ins come from the panel's own prices."""
    d = s.dense.withColumns({"flow": F.col("close") / F.nullif("open", F.lit(0.0)) - 1, "surprise": F.col("vwap") / F.nullif("close", F.lit(0.0)) - 1, "growth": F.col("ret_1d"), "limit_up": R.ts_delay("close", 1) * 1.1})
    d = P.stock_features(d, 6, 12, 24, 24, 2)
    return d.select("code", "date", "pos", "grp", "in_universe", "circ_mv", *FEATS)


@query("stock_feature_ranks", "N-F6", dense(FSQL + " SELECT code, strftime(date, '%Y-%m-%d') AS date, " + ", ".join(f"round({f}, 6) AS {f}" for f in FEATS) + " FROM fp"))
def _(s):
    from tidepanel.operators.ordering import with_ranks

    d = with_ranks(features(s), ["date"], {f"r_{f}": F.when(F.col("in_universe"), F.col(f)) for f in FEATS})
    return d.select("code", day("date").alias("date"), *[r(f"r_{f}").alias(f) for f in FEATS])


@query("industry_features", "N-F7 W35", dense(FSQL + """, hz AS (SELECT i.*, (ep - avg(ep) OVER w) / nullif(stddev_samp(ep) OVER w, 0) AS hz, count(ep) OVER w AS k FROM im i WINDOW w AS (PARTITION BY grp ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW))
SELECT strftime(date, '%Y-%m-%d') AS date, grp, names, """ + ", ".join(f"round({f}, 6) AS {f}" for f in FEATS) + ", round(dispersion, 6) AS dispersion, round(CASE WHEN k >= 12 THEN hz END, 5) AS ep_hist_z FROM hz"))
def _(s):
    d = P.industry_means(features(s), FEATS, "grp", 2, "mom_20").join(F.broadcast(s.cal), "date").withColumn("code", F.col("grp"))
    d = d.withColumn("z", F.when(F.count("ep").over(R.trailing(36)) >= 12, (F.col("ep") - F.avg("ep").over(R.trailing(36))) / F.nullif(F.stddev_samp("ep").over(R.trailing(36)), F.lit(0.0))))
    return d.select(day("date").alias("date"), "grp", "names", *[r(f).alias(f) for f in FEATS], r("dispersion").alias("dispersion"), r("z", 5).alias("ep_hist_z"))


RZ = lambda f, src, by: f"CASE WHEN {f} IS NOT NULL AND count({f}) OVER (PARTITION BY {by}) >= 3 THEN ({AR(f'round({f}, 10)', by + f', ({f} IS NULL)')} - (count({f}) OVER (PARTITION BY {by}) + 1) / 2.0) / sqrt(greatest(count({f}) OVER (PARTITION BY {by}) * count({f}) OVER (PARTITION BY {by}) - 1, 1) / 12.0::DOUBLE) END"
MAP = HOLD + FSQL + ", iz AS (SELECT date, grp, " + ", ".join(f"{RZ(f, 'im', 'date')} AS {f}" for f in ("mom_20", "ep")) + """ FROM im),
mi AS (SELECT date, fund, """ + ", ".join(f"CASE WHEN sum(CASE WHEN {f} IS NOT NULL THEN weight ELSE 0 END) >= 0.5 THEN sum(weight * {f}) / sum(CASE WHEN {f} IS NOT NULL THEN weight END) END AS {f}" for f in ("mom_20", "ep")) + """ FROM iw JOIN iz USING (grp) GROUP BY ALL),
mb AS (SELECT date, fund, """ + ", ".join(f"CASE WHEN sum(CASE WHEN {f} IS NOT NULL THEN weight ELSE 0 END) >= 0.2::DOUBLE THEN sum(weight * {f}) / sum(CASE WHEN {f} IS NOT NULL THEN weight END) END AS {f}" for f in ("mom_20", "ep")) + " FROM hw JOIN fp USING (code) GROUP BY ALL)"


def mapped(s):
    ft = materialize(features(s))
    im = P.industry_means(ft, ["mom_20", "ep"], "grp", 2)
    iz = P.rank_z_rows(im.select("date", "grp", "mom_20", "ep"), {"z_mom": "mom_20", "z_ep": "ep"}).select("date", "grp", F.col("z_mom").alias("mom_20"), F.col("z_ep").alias("ep"))
    a = P.map_by_weights(iz, industry_weights(s), "grp", ["mom_20", "ep"])
    from tidepanel.operators.ordering import with_ranks

    fp = with_ranks(ft, ["date"], {f"r_{f}": F.when(F.col("in_universe"), F.col(f)) for f in ("mom_20", "ep")}, write=False)
    b = P.map_by_weights(fp.select("date", "code", F.col("r_mom_20").alias("mom_20"), F.col("r_ep").alias("ep")), holdings(s), "code", ["mom_20", "ep"], least=0.2)
    return a, b


@query("mapped_features", "J20 N-F7", dense(MAP + """ SELECT strftime(date, '%Y-%m-%d') AS date, fund, round(mi.mom_20, 6) AS ind_mom, round(mi.ep, 6) AS ind_ep, round(mb.mom_20, 6) AS basket_mom, round(mb.ep, 6) AS basket_ep FROM mi JOIN mb USING (date, fund)"""))
def _(s):
    a, b = mapped(s)
    a = a.select("date", "fund", F.col("mom_20").alias("ind_mom"), F.col("ep").alias("ind_ep"))
    b = b.select("date", "fund", F.col("mom_20").alias("basket_mom"), F.col("ep").alias("basket_ep"))
    return a.join(b, ["date", "fund"]).select(day("date").alias("date"), "fund", *[r(c).alias(c) for c in ("ind_mom", "ind_ep", "basket_mom", "basket_ep")])


@query("mapping_agreement", "A54", dense(MAP + f""", bt AS (SELECT date, fund, mi.mom_20 AS a, mb.mom_20 AS b FROM mi JOIN mb USING (date, fund) WHERE mi.mom_20 IS NOT NULL AND mb.mom_20 IS NOT NULL), z AS (SELECT date, {RZ('a', 'bt', 'date')} AS za, {RZ('b', 'bt', 'date')} AS zb FROM bt),
c AS (SELECT date, corr(za, zb) AS c FROM z GROUP BY date HAVING count(za) >= 5) SELECT (SELECT round(avg(c), 5) FROM c) AS rank_corr_mean, round(avg(abs(za - zb)), 5) AS abs_gap FROM z"""))
def _(s):
    a, b = mapped(s)
    j = a.select("date", "fund", F.col("mom_20").alias("a")).join(b.select("date", "fund", F.col("mom_20").alias("b")), ["date", "fund"]).where("a is not null and b is not null")
    z = P.rank_z_rows(j, {"za": "a", "zb": "b"}, keys=("fund",))
    c = z.groupBy("date").agg(F.when(F.count("za") >= 5, corr("za", "zb")).alias("c"), F.sum(F.abs(F.col("za") - F.col("zb"))).alias("g"), F.count(F.col("za")).alias("n"))
    return c.agg(r(F.avg("c"), 5).alias("rank_corr_mean"), r(F.sum("g") / F.sum("n"), 5).alias("abs_gap"))


@query("impact_cost", "X22 W26", dense("""
, t AS (SELECT code, date, (turnover - 1.0::DOUBLE / count(*) OVER (PARTITION BY date)) AS delta, CASE WHEN count(amount) OVER w >= 5 THEN avg(amount) OVER w END AS adv, CASE WHEN count(ret_1d) OVER w >= 5 THEN stddev_samp(ret_1d) OVER w END AS vol FROM dense WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
u AS (SELECT *, 0.1::DOUBLE * coalesce(adv, 0) / 1e6 AS lim FROM t WHERE delta IS NOT NULL), v AS (SELECT *, CASE WHEN abs(delta) > lim + 1e-12 THEN sign(delta) * lim ELSE delta END AS traded FROM u)
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(traded, 8) AS traded, round(0.5::DOUBLE * coalesce(vol, 0.02::DOUBLE) * sqrt(CASE WHEN adv > 0 THEN abs(traded) * 1e6 / adv ELSE 0 END) * abs(traded), 9) AS impact FROM v"""))
def _(s):
    d = X.with_stats(s.dense, "date", {"_k": F.count("*")})
    d = d.select("code", "date", (F.col("turnover") - 1.0 / F.nullif("_k", F.lit(0))).alias("delta"), R.ts_mean("amount", 12, 5).alias("adv"), R.ts_std("ret_1d", 12, 5).alias("vol"))
    d = P.impact_cost(d.where("delta is not null"), 0.5, 0.1, 1e6)
    return d.select("code", day("date").alias("date"), r("traded", 8).alias("traded"), r("impact", 9).alias("impact"))


HEDGE = DAILY + """, hd AS (SELECT date, ret, bench AS index_ret, bench * 0.9::DOUBLE + 0.001::DOUBLE AS fut_ret, 0.8::DOUBLE + (month(date) % 5) / 10.0::DOUBLE AS beta, (month(date) % 3 = 0)::INT AS roll, CASE WHEN year(date) >= 1997 THEN 'exact' ELSE 'proxy' END AS segment FROM daily)"""


def hedge(s):
    d = daily(s)
    return d.select("date", "ret", F.col("bench").alias("index_ret"), (F.col("bench") * 0.9 + 0.001).alias("fut_ret"), (0.8 + F.month("date") % 5 / 10.0).alias("beta"),
                    (F.month("date") % 3 == 0).cast("int").alias("roll"), F.when(F.year("date") >= 1997, "exact").otherwise("proxy").alias("segment"))


@query("hedged_return_stats", "A55 A14", labelled(HEDGE + """, h AS (SELECT segment, ratio, date, 0.8::DOUBLE * (ret - ratio * beta * (fut_ret + 0.0005::DOUBLE * roll)) AS ret FROM hd, (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE]) AS ratio)),
c AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS curve FROM h WINDOW w AS (PARTITION BY segment, ratio ORDER BY date)), m AS (SELECT *, curve / max(curve) OVER (PARTITION BY segment, ratio ORDER BY date) - 1 AS dd FROM c)
SELECT segment, ratio, count(*) AS days, round(exp(sum(ln(1 + ret)) * 12 / count(*)) - 1, 6) AS annual_return, round(stddev_samp(ret) * sqrt(12), 6) AS annual_vol, round(min(dd), 6) AS max_drawdown FROM m GROUP BY ALL"""))
def _(s):
    d = M.return_stats(P.hedged_returns(hedge(s), [0.5, 1.0], 0.8, 0.0005), 12, ["segment", "ratio"])
    return d.select("segment", "ratio", "days", *[r(c).alias(c) for c in ("annual_return", "annual_vol", "max_drawdown")])


@query("hedge_attribution", "A55", labelled(HEDGE + """ SELECT round(avg(0.8::DOUBLE * ret) * 12, 6) AS long_leg, round(avg(-0.8::DOUBLE * beta * index_ret) * 12, 6) AS short_index, round(avg(-0.8::DOUBLE * beta * (fut_ret - index_ret)) * 12, 6) AS basis_carry, round(avg(-0.8::DOUBLE * beta * 0.0005::DOUBLE * roll) * 12, 8) AS roll_cost FROM hd WHERE segment = 'exact'"""))
def _(s):
    d = P.hedge_attribution(hedge(s), 0.8, 0.0005, 12)
    return d.select(*[r(c).alias(c) for c in ("long_leg", "short_index", "basis_carry")], r("roll_cost", 8).alias("roll_cost"))


@query("proxy_gap_by_year", "A52", dense(PROXY + """, g AS (SELECT date, proxy, bret, proxy - bret AS gap FROM proxy JOIN bret USING (date) WHERE proxy IS NOT NULL AND bret IS NOT NULL)
SELECT coalesce(year(date)::VARCHAR, 'all') AS year, count(*) AS days, round(avg(gap) * 12, 6) AS annual_gap, round(stddev_samp(gap) * sqrt(12), 6) AS tracking_error, round(corr(proxy, bret), 6) AS correlation FROM g GROUP BY ROLLUP (year(date))"""))
def _(s):
    b = s.bars.join(F.broadcast(s.cal), "date").where("code % 2 = 0 and pos % 10 <> 3").groupBy("date").agg(F.avg("close").alias("px"))
    j = PN.cap_weighted(s.dense, F.col("in_universe")).join(M.benchmark_returns(b, s.cal), "date")
    d = P.series_gap(j, "proxy", "bret", 12)
    return d.select("year", "days", *[r(c).alias(c) for c in ("annual_gap", "tracking_error", "correlation")])


@query("top_k_weights", "T2 T1", dense("""
, k AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY vwap DESC, code) AS place, count(*) OVER (PARTITION BY date) AS n FROM dense WHERE in_universe AND vwap IS NOT NULL AND pos % 4 = 0) SELECT code, strftime(date, '%Y-%m-%d') AS date, round(1.0::DOUBLE / least(10, n), 6) AS weight FROM k WHERE place <= 10"""))
def _(s):
    from tidepanel.operators.ordering import position

    d = s.dense.where("in_universe and vwap is not null and pos % 4 = 0").select("code", "date", "vwap")
    d = position(d, ["date"], [-F.col("vwap"), "code"], "place", "n").where("place <= 10")
    return d.select("code", day("date").alias("date"), r(1.0 / F.least(F.lit(10), F.col("n"))).alias("weight"))

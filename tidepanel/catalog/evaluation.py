"""Factor evaluation."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from tidepanel.catalog.registry import labelled, query
from tidepanel.functions.columns import day, r
from tidepanel.operators import gathered as G, rolling as R
from tidepanel.operators.cross import cs_neutralize, neutralized, with_stats
from tidepanel.operators.masked import buckets, masked_ranks, named, pair_correlations
from tidepanel.operators.staging import materialize
from tidepanel.plans import factors as FA, metrics as M

AR = lambda x, by: f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"
W = "PARTITION BY code ORDER BY pos"
WIN = ", ".join(f"w{n} AS ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 6, 12, 24))
full = lambda agg, x, n: f"CASE WHEN count({x}) OVER w{n} = {n} THEN {agg} OVER w{n} END"

DERIVED = f"""
, t1 AS (SELECT *, ret_1d - avg(ret_1d) FILTER (WHERE in_universe) OVER (PARTITION BY date) AS excess_ret_1d, abs(ret_1d) / (CASE WHEN amount > 0 THEN amount END / 1e8) AS ill, close / vwap - 1 AS vwap_dev, open / lag(close) OVER ({W}) - 1 AS overnight_ret, close / open - 1 AS intraday_ret, (high - low) / close AS rng FROM labelled),
terminals AS (SELECT *, {full('avg(ill)', 'ill', 6)} AS amihud FROM t1 WINDOW {WIN})"""

SEED_SQL = {
    "reversal_short": full("sum(ret_1d)", "ret_1d", 3), "reversal_medium": full("sum(ret_1d)", "ret_1d", 6),
    "momentum_long": f"{full('sum(ret_1d)', 'ret_1d', 24)} - {full('sum(ret_1d)', 'ret_1d', 6)}", "vol_medium": full("stddev_samp(ret_1d)", "ret_1d", 6),
    "vol_quarter": full("stddev_samp(ret_1d)", "ret_1d", 12), "max_ret": full("max(ret_1d)", "ret_1d", 6), "turnover_mean": full("avg(turnover)", "turnover", 6),
    "turnover_shock": f"{full('avg(turnover)', 'turnover', 3)} / {full('avg(turnover)', 'turnover', 12)}", "amihud_level": "amihud", "size": "ln(circ_mv)",
    "book_to_price": "1 / pb_mrq", "earnings_yield": "1 / nullif(pe_ttm, 0)", "vwap_dev_mean": full("avg(vwap_dev)", "vwap_dev", 3), "overnight_mean": full("avg(overnight_ret)", "overnight_ret", 6),
    "intraday_mean": full("avg(intraday_ret)", "intraday_ret", 6), "price_volume_corr": full("corr(close, volume)", "close", 6),
    "volume_ratio": f"{full('avg(volume)', 'volume', 3)} / {full('avg(volume)', 'volume', 6)}", "range_mean": full("avg(rng)", "rng", 6),
}
SEEDS = DERIVED + ", seeds AS (SELECT code, date, pos, grp, region, in_universe, buyable, open, close, circ_mv, label_1, label_3, " + ", ".join(f"{v} AS {k}" for k, v in SEED_SQL.items()) + f" FROM terminals WINDOW {WIN})"
# Window name reuse: one-row window used by the correlation guard.
PICK = list(SEED_SQL)
LONG = SEEDS + ", long AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT code, date, pos, grp, region, in_universe, circ_mv, label_1, label_3, '{k}' AS factor, {k} AS value FROM seeds" for k in PICK) + "))"
IC = lambda x, y, by, src, out="ic", n=20: f"""
, {out}_v AS (SELECT * FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL), {out}_r AS (SELECT *, {AR(x, by)} AS ra, {AR(y, by)} AS rb FROM {out}_v),
{out} AS (SELECT {by}, CASE WHEN count(*) >= {n} AND min(ra) < max(ra) AND min(rb) < max(rb) THEN round(corr(ra, rb), 12) END AS ic FROM {out}_r GROUP BY {by})"""  # noqa: E731
SUMMARY = "round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS icir, round(avg((ic > 0)::INT), 6) AS positive, count(ic) AS days, round(skewness(ic), 5) AS skew, round(kurtosis(ic) + 3, 5) AS kurtosis"
UNI = "(SELECT * FROM long WHERE in_universe)"


def seed_frame(s):
    d = FA.derived_terminals(s.stored, 6)
    return FA.evaluate(d, FA.seed_factors(3, 6, 12, 24))


def library_frame(s):
    """``seed_frame`` for one pass: from the bars to the factors with one exchange by code, and no table written between them."""
    return FA.evaluate(FA.own_terminals(s.labelled, 6), FA.seed_factors(3, 6, 12, 24))


def most_names(s):
    """A date has a row for each supplier at most."""
    return s.suppliers.count()


def universe(s, *more):
    """The whole library on the universe's rows, wide."""
    return seed_frame(s).where("in_universe").select("date", "code", *PICK, *more)


def library_ic(d, target="label_1"):
    """(factor, date, ic) of all factors against one target, from one ranking of the wide rows."""
    ranks = masked_ranks(d, [*PICK, target])
    return pair_correlations(ranks, [(f, target) for f in PICK], 8).withColumnRenamed("a", "factor")


BOTH = [(a, b) for a in PICK for b in PICK if a < b]


def library_corr(d):
    """(a, b, corr) of all pairs of the library: mean daily rank correlation on the names that have both."""
    return mean_corr(pair_correlations(masked_ranks(d, PICK), BOTH, 8))


def mean_corr(ic):
    return ic.groupBy("a", "b").agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("corr"))


def summary(d, *by):
    cols = [r(c).alias(c) for c in ("ic_mean", "ic_std", "icir", "positive")]
    return d.select(*by, *cols, "days", r("skew", 5).alias("skew"), r("kurtosis", 5).alias("kurtosis"))


@query("factor_ic_summary", "A1 A2 T1", labelled(f"""
, f AS (SELECT *, CASE WHEN count(close) OVER w = 5 THEN avg(close) OVER w END AS m5 FROM labelled WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), v AS (SELECT * FROM f WHERE in_universe)"""
+ IC("m5", "label_1", "date", "v", n=8) + f" SELECT {SUMMARY} FROM ic"))
def _(s):
    d = s.labelled.withColumn("m5", R.ts_mean("close", 5)).where("in_universe")
    ic = M.rank_ic(d.select("date", "code", "m5", "label_1"), "m5", "label_1", ("date",), min_names=8)
    return summary(M.summarize_ic(ic, ()))


@query("derived_terminals", "N-F1", labelled(DERIVED + """
SELECT code, strftime(date, '%Y-%m-%d') AS date, """ + ", ".join(f"round({c}, 6) AS {c}" for c in ("excess_ret_1d", "amihud", "vwap_dev", "overnight_ret", "intraday_ret")) + " FROM terminals"))
def _(s):
    d = FA.derived_terminals(s.stored, 6)
    return d.select("code", day("date").alias("date"), *[r(c).alias(c) for c in ("excess_ret_1d", "amihud", "vwap_dev", "overnight_ret", "intraday_ret")])


@query("seed_factors", "N-F2 UD1 UD2 UD3", labelled(SEEDS + " SELECT code, strftime(date, '%Y-%m-%d') AS date, " + ", ".join(f"round({k}, 6) AS {k}" for k in SEED_SQL) + " FROM seeds"))
def _(s):
    return seed_frame(s).select("code", day("date").alias("date"), *[r(k).alias(k) for k in SEED_SQL])


@query("base_factors", "N-F3 IO17", labelled(SEEDS + """ SELECT code, strftime(date, '%Y-%m-%d') AS date, round(-reversal_short, 4) AS base_reversal, round(vol_medium, 4) AS base_vol, round(size, 4) AS base_size, round(turnover_mean, 4) AS base_turnover FROM seeds"""))
def _(s):
    d = FA.evaluate(s.labelled, FA.base_factors(3, 6))
    return d.select("code", day("date").alias("date"), *[r(c, 4).alias(c) for c in ("base_reversal", "base_vol", "base_size", "base_turnover")])


@query("batch_ic_summary", "A1 A2 A58", labelled(LONG + IC("value", "label_1", "factor, date", UNI, n=8) + f" SELECT factor, {SUMMARY} FROM ic GROUP BY factor"))
def _(s):
    return summary(M.summarize_ic(library_ic(universe(s, "label_1"))), "factor")


@query("factor_store", "IO17", labelled(LONG + " SELECT factor, strftime(date, '%Y-%m-%d') AS date, code, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) AS value FROM long WHERE value IS NOT NULL"))
def _(s):
    """All factors through one store: first with other windows, then as they are, so equal definitions come from the store and changed ones are computed anew."""
    from tidepanel.operators.staging import folder
    from tidepanel.sources import factorstore as ST

    panel, root = FA.derived_terminals(s.stored, 6), f"{folder(s.spark)}/factors-{uuid.uuid4().hex}"
    sign = ST.panel_signature(s.stored, ["open", "high", "low", "close", "volume", "amount", "circ_mv", "in_universe"])
    ST.through_store(panel, FA.seed_factors(2, 6, 12, 24), root, sign)
    d = ST.through_store(panel, FA.seed_factors(3, 6, 12, 24), root, sign).where("value is not null")
    return d.select("factor", day("date").alias("date"), "code", r(F.col("value").cast("double"), 4).alias("value"))


@query("factor_coverage", "A3", labelled(LONG + """ SELECT factor, round(avg(c * 1.0 / n), 6) AS coverage FROM (SELECT factor, date, count(*) FILTER (WHERE in_universe) AS n, count(value) FILTER (WHERE in_universe) AS c FROM long GROUP BY ALL) WHERE n > 0 GROUP BY factor"""))
def _(s):
    return M.wide_coverage(seed_frame(s), PICK).select("factor", r("coverage").alias("coverage"))


@query("quantile_returns", "A4", labelled(LONG + f"""
, v AS (SELECT * FROM {UNI} WHERE value IS NOT NULL AND label_1 IS NOT NULL), p AS (SELECT *, {AR('value', 'factor, date')} / count(*) OVER (PARTITION BY factor, date) AS pct FROM v),
b AS (SELECT factor, date, least(greatest(ceil(pct * 5), 1), 5) AS bucket, avg(label_1) AS m FROM p GROUP BY ALL)
SELECT factor, """ + ", ".join(f"round(avg(m) FILTER (WHERE bucket = {i}), 6) AS q{i}" for i in range(1, 6)) + ", round(avg(m) FILTER (WHERE bucket = 5) - avg(m) FILTER (WHERE bucket = 1), 6) AS long_short FROM b GROUP BY factor"))
def _(s):
    ranks = masked_ranks(universe(s, "label_1"), [*PICK, "label_1"], carry=["label_1"])
    d = M.bucket_returns(buckets(ranks, PICK, "label_1", 5), 5)
    return d.select("factor", *[r(c).alias(c) for c in ("q1", "q2", "q3", "q4", "q5", "long_short")])


@query("turnover_proxy", "A5", labelled(LONG + f", lg AS (SELECT *, lag(value) OVER (PARTITION BY factor, code ORDER BY pos) AS prev FROM long), lv AS (SELECT * FROM lg WHERE in_universe)" + IC("value", "prev", "factor, date", "lv", n=8) + " SELECT factor, round(1 - avg(ic), 6) AS turnover FROM ic GROUP BY factor"))
def _(s):
    d = library_frame(s).withColumns({f"prev_{f}": R.ts_delay(f, 1) for f in PICK}).where("in_universe")
    ic = G.correlations(d, [(f, f"prev_{f}") for f in PICK], 8, most_names(s))
    return ic.groupBy(F.col("a").alias("factor")).agg(r(1 - F.avg("ic")).alias("turnover"))


PAIRS = SEEDS + ", pairs AS (" + " UNION ALL ".join(f"SELECT date, code, '{a}' AS a, '{b}' AS b, {a} AS xa, {b} AS xb FROM seeds WHERE in_universe" for a in PICK for b in PICK if a < b) + ")" + IC("xa", "xb", "a, b, date", "pairs", n=8)


@query("library_correlations", "A6 A66 J17 A54", labelled(PAIRS + """, c AS (SELECT a, b, coalesce(avg(ic), 0) AS corr FROM ic GROUP BY a, b), u AS (SELECT a AS factor, b AS other, corr FROM c UNION ALL SELECT b, a, corr FROM c)
SELECT factor, round(max(abs(corr)), 6) AS max_abs_corr, arg_max(other, abs(corr)) AS max_with FROM u GROUP BY factor"""))
def _(s):
    c = library_corr(universe(s))
    u = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    return u.groupBy(F.col("a").alias("factor")).agg(r(F.max(F.abs("corr"))).alias("max_abs_corr"), F.max_by("b", F.abs("corr")).alias("max_with"))


REST = [f for f in PICK if f != "size"]


def library_neutral_ic(d):
    """(factor, date, ic) of the residuals on groups and size, all factors in one aggregate for each level."""
    d = materialize(d.withColumn("lmv", F.when(F.col("circ_mv") > 0, F.ln("circ_mv"))))
    d = cs_neutralize(d, {f"r_{f}": f for f in REST}, "lmv", "region")
    # Residuals of exact fits differ by float noise only; ties stay ties.
    d = d.select("date", "label_1", *[F.round(f"r_{f}", 9).alias(f) for f in REST])
    return pair_correlations(masked_ranks(d, [*REST, "label_1"]), [(f, "label_1") for f in REST], 8).withColumnRenamed("a", "factor")


def own_and_neutral_ic(s):
    """``library_ic`` and ``library_neutral_ic`` of the universe; where a date fits one task both come from one exchange of the columns, and residuals never leave it."""
    most = most_names(s)
    if not G.fits(most, 4):  # a residual's pair reads the factor, size, region and the label
        d = universe(s, "label_1", "circ_mv", "region")
        return materialize(library_ic(d)), library_neutral_ic(d)
    need = s.suppliers.select("region").distinct().count() + 5
    pairs = [(f, "label_1") for f in PICK] + [(f"r_{f}", "label_1") for f in REST]
    reads = {f"r_{f}": (f, "size", "region") for f in REST}  # size is the logarithm of circ_mv
    derive = lambda v, wanted: {w: np.round(neutralized(v[w[2:]], v["size"], v["region"], need), 9) for w in wanted}
    sums = materialize(G.pair_sums(library_frame(s).where("in_universe"), pairs, most, "date", reads, derive))
    ic, neutral = (named(sums.where(own), pairs, "date", 8) for own in (F.col("_p") < len(PICK), F.col("_p") >= len(PICK)))
    return ic.withColumnRenamed("a", "factor"), neutral.withColumn("factor", F.substring("a", 3, 100)).drop("a")


@query("neutralized_ic", "A7 A9", labelled(LONG + """
, nv AS (SELECT *, value AS x, ln(circ_mv) AS z FROM long WHERE in_universe AND value IS NOT NULL AND circ_mv > 0), ng AS (SELECT *, x - avg(x) OVER g AS xt, z - avg(z) OVER g AS zt FROM nv WINDOW g AS (PARTITION BY factor, date, region)),
nr AS (SELECT *, CASE WHEN count(*) OVER d >= (SELECT count(DISTINCT region) FROM suppliers) + 5 THEN xt - coalesce(sum(xt * zt) OVER d / nullif(sum(zt * zt) OVER d, 0), 0) * zt END AS resid FROM ng WINDOW d AS (PARTITION BY factor, date)),
nz AS (SELECT *, round(resid, 9) AS rr FROM nr WHERE factor <> 'size')""" + IC("rr", "label_1", "factor, date", "nz", n=8) + " SELECT factor, round(avg(ic), 5) AS ic_mean, count(ic) AS days FROM ic GROUP BY factor"))
def _(s):
    ic = library_neutral_ic(universe(s, "label_1", "circ_mv", "region"))
    return ic.groupBy("factor").agg(r(F.avg("ic"), 5).alias("ic_mean"), F.count("ic").alias("days"))


@query("subwindow_ic", "A8", labelled(LONG + IC("value", "label_1", "factor, date", UNI, n=8) + """ SELECT factor, chunk::INT AS chunk, round(avg(ic), 6) AS ic FROM (SELECT *, ntile(4) OVER (PARTITION BY factor ORDER BY date) AS chunk FROM ic WHERE ic IS NOT NULL) GROUP BY ALL"""))
def _(s):
    return M.subwindow_means(library_ic(universe(s, "label_1")), 4).select("factor", "chunk", r("ic").alias("ic"))


TOP = """
, t AS (SELECT *, lead(open) OVER w AS o1, lead(open, 4) OVER w AS o4, coalesce(lead(buyable) OVER w, FALSE) AS b1 FROM seeds WINDOW w AS (PARTITION BY code ORDER BY pos)),
u AS (SELECT *, coalesce(o4 / o1 - 1, 0) AS r, in_universe AND reversal_short IS NOT NULL AS s FROM t WHERE pos % 3 = 0 AND pos + 4 <= (SELECT max(pos) FROM seeds)),
p AS (SELECT *, CASE WHEN s AND b1 THEN row_number() OVER (PARTITION BY pos, (s AND b1) ORDER BY reversal_short DESC, code) END AS place, greatest(floor(count(*) FILTER (WHERE s) OVER (PARTITION BY pos) * 0.2::DOUBLE), 1) AS n FROM u),
w AS (SELECT *, coalesce((place <= n)::INT, 0) AS h FROM p), w1 AS (SELECT *, coalesce(h * 1.0 / nullif(sum(h) OVER (PARTITION BY pos), 0), 0) AS wt FROM w), w2 AS (SELECT *, coalesce(lag(wt) OVER (PARTITION BY code ORDER BY pos), 0) AS pw FROM w1),
g AS (SELECT date, pos, sum(wt * r) AS port, coalesce(avg(r) FILTER (WHERE in_universe AND b1), 0) AS bench, sum(abs(wt - pw)) AS turnover FROM w2 GROUP BY ALL)"""


@query("top_fraction_return", "A12 T1 T2", labelled(SEEDS + TOP + " SELECT strftime(date, '%Y-%m-%d') AS date, round(port, 6) AS port, round(bench, 6) AS bench, round(turnover, 6) AS turnover, round(port - bench - turnover * 0.0015::DOUBLE, 6) AS excess_net FROM g"))
def _(s):
    fs = [f for f in FA.seed_factors(3, 6, 12, 24) if f.name == "reversal_short"]
    d = FA.evaluate(s.stored, fs)
    g = M.top_fraction(d, "reversal_short", 3, 0.2, 0.0015)
    return g.select(day("date").alias("date"), *[r(c).alias(c) for c in ("port", "bench", "turnover", "excess_net")])


DAILY = """, daily AS (SELECT date, avg(ret_1d) FILTER (WHERE code % 3 = 0) AS ret, avg(ret_1d) AS bench, 0.001 * (pos % 3)::DOUBLE AS cost FROM labelled WHERE pos > 0 GROUP BY date, pos)"""


def daily(s):
    d = s.dense.where("pos > 0").groupBy("date", "pos").agg(F.avg(F.when(F.col("code") % 3 == 0, F.col("ret_1d"))).alias("ret"), F.avg("ret_1d").alias("bench"))
    return d.withColumn("cost", 0.001 * (F.col("pos") % 3))


PERF = lambda part, grp: f"""
, c AS (SELECT *, ret - bench AS ex, product(1 + ret - bench) OVER ({part} ORDER BY date) AS curve FROM daily2), m AS (SELECT *, curve / max(curve) OVER ({part} ORDER BY date) - 1 AS dd FROM c)
SELECT {grp} count(*) AS days, round(pow(product(1 + ret), 12.0::DOUBLE / count(*)) - 1, 6) AS annual_return, round(pow(product(1 + bench), 12.0::DOUBLE / count(*)) - 1, 6) AS annual_benchmark, round(avg(ex) * 12, 6) AS annual_excess, round(stddev_samp(ex) * sqrt(12), 6) AS tracking_error,
 round(min(dd), 6) AS max_drawdown, round(sum(cost) * 12 / count(*), 6) AS annual_cost, round(avg(ex) * 12 / (stddev_samp(ex) * sqrt(12)), 6) AS information_ratio FROM m"""  # noqa: E731
PCOLS = ["annual_return", "annual_benchmark", "annual_excess", "tracking_error", "max_drawdown", "annual_cost", "information_ratio"]


@query("performance_stats", "A13 W38", labelled(DAILY + ", daily2 AS (SELECT * FROM daily)" + PERF("", "")))
def _(s):
    return M.performance(daily(s), 12).select("days", *[r(c).alias(c) for c in PCOLS])


@query("performance_by_period", "A15 A13", labelled(DAILY + ", periods AS (SELECT * FROM (VALUES ('all', 1995, 2001), ('early', 1995, 1997), ('late', 1999, 2001)) p(period, lo, hi)), daily2 AS (SELECT d.*, period FROM daily d JOIN periods ON year(date) BETWEEN lo AND hi)" + PERF("PARTITION BY period", "period, ") + " GROUP BY period"))
def _(s):
    periods = {"all": (1995, 2001), "early": (1995, 1997), "late": (1999, 2001)}
    y = F.year("date")
    hit = F.explode(F.filter(F.array(*[F.when(y.between(a, b), F.lit(k)) for k, (a, b) in periods.items()]), lambda x: x.isNotNull()))
    d = daily(s).withColumn("period", hit)
    return M.performance(d, 12, ["period"]).select("period", "days", *[r(c).alias(c) for c in PCOLS])


@query("return_stats", "A14", labelled(DAILY + """, c AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS curve FROM daily), m AS (SELECT *, curve / max(curve) OVER (ORDER BY date) - 1 AS dd FROM c)
SELECT count(*) AS days, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last, round(exp(sum(ln(1 + ret)) * 12 / count(*)) - 1, 6) AS annual_return, round(stddev_samp(ret) * sqrt(12), 6) AS annual_vol, round(min(dd), 6) AS max_drawdown, round(avg(ret) * 12 / (stddev_samp(ret) * sqrt(12)), 6) AS sharpe FROM m"""))
def _(s):
    d = M.return_stats(daily(s), 12)
    return d.select("days", day("first").alias("first"), day("last").alias("last"), *[r(c).alias(c) for c in ("annual_return", "annual_vol", "max_drawdown", "sharpe")])


@query("excess_by_year", "A13", labelled(DAILY + " SELECT coalesce(year(date)::VARCHAR, 'all') AS year, count(*) AS days, round(exp(sum(ln(1 + ret - bench))) - 1, 6) AS excess FROM daily GROUP BY ROLLUP (year(date))"))
def _(s):
    d = daily(s).withColumn("ex", F.col("ret") - F.col("bench"))
    return d.rollup(F.year("date").cast("string").alias("y")).agg(F.count("*").alias("days"), r(F.exp(F.sum(F.log1p("ex"))) - 1).alias("excess")).select(
        F.coalesce("y", F.lit("all")).alias("year"), "days", "excess")


@query("group_ic", "A16", labelled(SEEDS + ", gv AS (SELECT *, year(date) AS y, date AS dd FROM seeds WHERE in_universe)" + IC("vol_medium", "label_1", "date", "gv", n=10) + " SELECT year(date)::INT AS year, count(ic) AS groups, round(avg(ic), 6) AS mean, round(avg(ic) / nullif(stddev_pop(ic), 0), 6) AS icir FROM ic WHERE ic IS NOT NULL GROUP BY ALL"))
def _(s):
    fs = [f for f in FA.seed_factors(3, 6, 12, 24) if f.name == "vol_medium"]
    d = FA.evaluate(s.labelled, fs).where("in_universe").select("date", "code", "vol_medium", "label_1")
    ic = M.rank_ic(d, "vol_medium", "label_1", ("date",), min_names=10).where("ic is not null")
    return ic.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("groups"), r(F.avg("ic")).alias("mean"), r(F.avg("ic") / F.nullif(F.stddev_pop("ic"), F.lit(0.0))).alias("icir"))


@query("score_diagnostics", "A17", labelled(SEEDS + f""", sc AS (SELECT *, lag(vol_medium, 1) OVER w AS s1, lag(vol_medium, 3) OVER w AS s3 FROM (SELECT * FROM (SELECT *, vol_medium AS vm FROM seeds)) WINDOW w AS ({W})), su AS (SELECT * FROM sc WHERE in_universe)"""
+ IC("vol_medium", "label_1", "date", "su", "ic0", 10) + IC("s1", "label_1", "date", "su", "ic1", 10) + IC("s3", "label_1", "date", "su", "ic3", 10) + IC("vol_medium", "s1", "date", "su", "auto", 10) + """
, dq AS (SELECT date, label_1, row_number() OVER (PARTITION BY date ORDER BY vol_medium, code) AS place, count(*) OVER (PARTITION BY date) AS n FROM su WHERE vol_medium IS NOT NULL AND label_1 IS NOT NULL),
db AS (SELECT *, greatest(ceil((place - 1) * 10.0 / (n - 1)), 1) - 1 AS bin FROM dq WHERE n >= 20), ds AS (SELECT date, avg(label_1) FILTER (WHERE bin = 9) - avg(label_1) FILTER (WHERE bin = 0) AS spread FROM db GROUP BY date)
SELECT (SELECT round(avg(ic), 6) FROM ic0) AS rank_ic, (SELECT round(avg(ic) / stddev_pop(ic), 6) FROM ic0) AS icir, (SELECT round(avg((ic > 0)::INT), 6) FROM ic0 WHERE ic IS NOT NULL) AS positive, (SELECT round(avg(spread), 6) FROM ds) AS decile_spread,
 (SELECT round(avg(ic), 6) FROM ic1) AS ic_lag1, (SELECT round(avg(ic), 6) FROM ic3) AS ic_lag3, (SELECT round(avg(ic), 6) FROM auto) AS autocorr"""))
def _(s):
    from tidepanel.plans.scores import diagnostics

    fs = [f for f in FA.seed_factors(3, 6, 12, 24) if f.name == "vol_medium"]
    d = FA.evaluate(s.labelled, fs)
    out = diagnostics(d, "vol_medium", "label_1", F.col("in_universe"), lags=(1, 3), min_names=10, min_decile=20)
    return out.select(*[r(c).alias(c) for c in ("rank_ic", "icir", "positive", "decile_spread", "ic_lag1", "ic_lag3", "autocorr")])


@query("calibration_null", "A58 A59", labelled("""
, ids AS (SELECT unnest(range(12)) AS fid), nl AS (SELECT l.date, l.code, fid, label_1, ((l.code * 7919 + l.pos * 104729 + fid * 15485863 + l.code * l.pos * (fid + 3) * 31) % 100003)::DOUBLE + CASE WHEN fid >= 8 THEN label_1 * 150000 ELSE 0 END AS value FROM labelled l, ids WHERE in_universe)""" + IC("value", "label_1", "fid, date", "nl", n=8) + """
, st AS (SELECT fid, avg(ic) AS m, avg(ic) / stddev_samp(ic) AS ir FROM ic GROUP BY fid)
SELECT CASE WHEN fid >= 8 THEN 'planted' ELSE 'null' END AS kind, count(*) AS factors, round(avg((m >= 0.02::DOUBLE AND ir >= 0.25::DOUBLE)::INT), 6) AS pass_rate, round(quantile_cont(ir, 0.5), 6) AS icir_p50, round(quantile_cont(ir, 0.9), 6) AS icir_p90 FROM st GROUP BY ALL"""))
def _(s):
    from tidepanel.plans.scores import calibration

    d = s.labelled.where("in_universe").select("date", "pos", "code", "label_1")
    return calibration(d, "label_1", 12, 8, min_names=8).select("kind", "factors", *[r(c).alias(c) for c in ("pass_rate", "icir_p50", "icir_p90")])


PAIR_ROWS = ", pairs AS (" + " UNION ALL ".join(f"SELECT date, code, '{a}' AS a, '{b}' AS b, {a} AS xa, {b} AS xb FROM seeds WHERE in_universe" for a in PICK for b in PICK if a < b) + ")" + IC("xa", "xb", "a, b, date", "pairs", "pic", 8)
GATE_ONE = LONG + IC("value", "label_1", "factor, date", UNI, n=8) + PAIR_ROWS + """
, m AS (SELECT factor, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, count(ic) AS days FROM ic GROUP BY factor), cv AS (SELECT factor, avg(c * 1.0 / n) AS coverage FROM (SELECT factor, date, count(*) FILTER (WHERE in_universe) AS n, count(value) FILTER (WHERE in_universe) AS c FROM long GROUP BY ALL) WHERE n > 0 GROUP BY factor),
pc AS (SELECT a, b, coalesce(avg(ic), 0) AS corr FROM pic GROUP BY a, b), pu AS (SELECT a AS factor, b AS other, corr FROM pc UNION ALL SELECT b, a, corr FROM pc), mx AS (SELECT factor, max(abs(corr)) AS max_abs_corr, arg_max(other, abs(corr)) AS other FROM pu GROUP BY factor),
g1 AS (SELECT m.*, coverage, max_abs_corr, o.icir AS matched FROM m JOIN cv USING (factor) JOIN mx USING (factor) JOIN (SELECT factor AS other, icir FROM m) o ON o.other = mx.other),
g2 AS (SELECT *, coverage >= 0.8 AS c1, days >= 30 AS c2, ic_mean >= 0.0 AS c3, coalesce(icir >= 0.02, FALSE) AS c4, coalesce(icir >= 1.3 * abs(matched), FALSE) AS better FROM g1)"""


def library_match(c):
    """Per factor the largest absolute mean correlation with another one, and that factor."""
    u = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    return u.groupBy(F.col("a").alias("factor")).agg(F.max(F.abs("corr")).alias("max_abs_corr"), F.max_by("b", F.abs("corr")).alias("other"))


def first_gate_series(s):
    """(factor, date, ic), (factor, coverage) and (a, b, corr) of the library; where a date fits one task all come from one exchange of the columns."""
    most = most_names(s)
    if not G.fits(most):
        seeds = materialize(seed_frame(s).select("date", "code", "in_universe", "label_1", *PICK))
        inside = seeds.where("in_universe")
        return library_ic(inside), M.wide_coverage(seeds, PICK), library_corr(inside)
    own, alone = [(f, "label_1") for f in PICK], [(f, f) for f in PICK]  # a factor with itself counts its values
    pairs = [*own, *BOTH, *alone]
    sums = materialize(G.pair_sums(library_frame(s).where("in_universe"), pairs, most))
    p, last = F.col("_p"), len(own) + len(BOTH)
    ic, corr = (named(sums.where(part), pairs, "date", 8) for part in (p < len(own), (p >= len(own)) & (p < last)))
    factor = F.element_at(F.array(*[F.lit(f) for f in PICK]), p - last + 1)
    coverage = sums.where(p >= last).groupBy(factor.alias("factor")).agg(F.avg(F.col("names") / F.col("rows")).alias("coverage"))
    return ic.withColumnRenamed("a", "factor"), coverage, mean_corr(corr)


@query("gate_checks", "A60", labelled(GATE_ONE + """
SELECT factor, round(max_abs_corr, 6) AS max_abs_corr, (c1 AND c2 AND c3 AND c4 AND (max_abs_corr <= 0.6 OR better))::INT AS passed, (NOT c1)::INT + (NOT c2)::INT + (NOT c3)::INT + (NOT c4)::INT + (NOT (max_abs_corr <= 0.6 OR better))::INT AS failed FROM g2"""))
def _(s):
    ic, coverage, corr = first_gate_series(s)
    m = materialize(M.summarize_ic(ic))
    m = m.join(coverage, "factor").join(library_match(corr), "factor").join(m.select(F.col("factor").alias("other"), F.col("icir").alias("matched_icir")), "other")
    g = M.gate_first(m, {"coverage": 0.8, "days": 30, "ic_mean": 0.0, "icir": 0.02, "corr": 0.6, "replacement": 1.3})
    return g.select("factor", r("max_abs_corr").alias("max_abs_corr"), F.col("passed").cast("int").alias("passed"), F.size(F.filter("checks", lambda c: ~c["passed"])).cast("int").alias("failed"))


NEUTRAL = """
, nv AS (SELECT *, value AS x, ln(circ_mv) AS z FROM long WHERE in_universe AND value IS NOT NULL AND circ_mv > 0 AND factor <> 'size'), ng AS (SELECT *, x - avg(x) OVER g AS xt, z - avg(z) OVER g AS zt FROM nv WINDOW g AS (PARTITION BY factor, date, region)),
nr AS (SELECT *, CASE WHEN count(*) OVER d >= (SELECT count(DISTINCT region) FROM suppliers) + 5 THEN xt - coalesce(sum(xt * zt) OVER d / nullif(sum(zt * zt) OVER d, 0), 0) * zt END AS resid FROM ng WINDOW d AS (PARTITION BY factor, date)),
nz AS (SELECT *, round(resid, 9) AS rr FROM nr)""" + IC("rr", "label_1", "factor, date", "nz", "nic", 8)


@query("gate_second_level", "A60", labelled(LONG + IC("value", "label_1", "factor, date", UNI, n=8) + NEUTRAL + """
, ch AS (SELECT factor, chunk, avg(ic) AS ic FROM (SELECT *, ntile(4) OVER (PARTITION BY factor ORDER BY date) AS chunk FROM ic WHERE ic IS NOT NULL) GROUP BY ALL), sg AS (SELECT factor, count(*) FILTER (WHERE ic > 0) AS same_sign FROM ch GROUP BY factor),
md AS (SELECT factor, avg(ic) AS ic_mean FROM ic GROUP BY factor), ne AS (SELECT factor, avg(ic) AS neutral_ic FROM nic GROUP BY factor)
SELECT factor, same_sign, round(neutral_ic, 5) AS neutral_ic, (same_sign >= 3 AND coalesce(neutral_ic / nullif(ic_mean, 0) >= 0.5, FALSE))::INT AS passed FROM sg JOIN md USING (factor) JOIN ne USING (factor)"""))
def _(s):
    """Sub-window signs and the neutral share of the factors' own series; the marginal test has its own query."""
    ic, neutral = own_and_neutral_ic(s)
    sg = M.subwindow_means(ic, 4).groupBy("factor").agg(F.count(F.when(F.col("ic") > 0, 1)).alias("same_sign"))
    neutral = neutral.groupBy("factor").agg(F.avg("ic").alias("neutral_ic"))
    m = sg.join(ic.groupBy("factor").agg(F.avg("ic").alias("ic_mean")), "factor").join(neutral, "factor").withColumns({"net_excess": F.lit(None).cast("double"), "marginal_ic": F.lit(1.0)})
    g = M.gate_second(m, {"same_sign": 3, "neutral": 0.5, "net_excess": 0.0, "marginal": 0.0})
    return g.select("factor", "same_sign", r("neutral_ic", 5).alias("neutral_ic"), F.col("passed").cast("int").alias("passed"))


@query("holdout_check", "A65 S4", labelled(LONG + IC("value", "label_1", "factor, date", UNI, n=8) + f"""
, seen AS (SELECT DISTINCT [{", ".join(f"'{k}'" for k in PICK)}][o_custkey % {len(PICK)} + 1] AS factor FROM orders WHERE (o_orderkey * 7 + o_custkey) % 10 = 9 AND CAST(o_orderdate AS DATE) < DATE '1995-01-15')
, t AS (SELECT factor, date < DATE '1999-01-01' AS dev, avg(ic) AS m, avg(ic) / nullif(stddev_samp(ic), 0) AS ir FROM ic WHERE ic IS NOT NULL GROUP BY ALL)
SELECT d.factor, round(h.ir / d.ir, 4) AS ratio, (h.m > 0 AND h.ir / d.ir >= 0.5)::INT AS passed, (d.factor IN (SELECT factor FROM seen))::INT AS contaminated FROM t d JOIN t h ON d.factor = h.factor AND d.dev AND NOT h.dev"""))
def _(s):
    ic = materialize(library_ic(universe(s, "label_1")))
    cut = F.lit("1999-01-01").cast("date")
    dev, hold = M.summarize_ic(ic.where(F.col("date") < cut)), M.summarize_ic(ic.where(F.col("date") >= cut))
    # Earlier results of the candidates on the holdout span, from the dated trials of the record that reached the last level.
    names, o = F.array(*[F.lit(k) for k in PICK]), s.table("orders")
    early = ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 10 == 9) & (F.col("o_orderdate").cast("date") < F.lit("1995-01-15").cast("date"))
    seen = o.where(early).select(F.element_at(names, (F.col("o_custkey") % len(PICK) + 1).cast("int")).alias("factor")).distinct().withColumn("contaminated", F.lit(1))
    d = dev.select("factor", F.col("icir").alias("dev_icir")).join(hold, "factor").join(seen, "factor", "left")
    ratio = F.col("icir") / F.nullif("dev_icir", F.lit(0.0))
    return d.select("factor", r(ratio, 4).alias("ratio"), F.coalesce((F.col("ic_mean") > 0) & (ratio >= 0.5), F.lit(False)).cast("int").alias("passed"), F.coalesce("contaminated", F.lit(0)).alias("contaminated"))


@query("template_expansion", "N-F13 U6", labelled("""
, v AS (""" + " UNION ALL ".join(f"SELECT code, date, 'smooth_n{n}_k{k}' AS variant, (CASE WHEN count(close) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(close) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END) - lag(close, {k}) OVER (PARTITION BY code ORDER BY pos) AS value FROM labelled" for n in (3, 6) for k in (1, 2)) + """)
SELECT variant, count(value) AS n, round(avg(value), 5) AS mean FROM v GROUP BY variant"""))
def _(s):
    fs = FA.expand_template("smooth", lambda name, n, k: [{name: R.ts_mean("close", n) - R.ts_delay("close", k)}], {"n": (3, 6), "k": (1, 2)})
    long = FA.to_long(FA.evaluate(s.dense, fs), fs, ["date", "code"])
    return long.groupBy(F.col("factor").alias("variant")).agg(F.count("value").alias("n"), r(F.avg("value"), 5).alias("mean"))

"""Walk-forward models, samples and event scores."""

from pyspark.sql import functions as F

from tidepanel.catalog.evaluation import AR, IC, SEEDS, seed_frame
from tidepanel.catalog.registry import dense, labelled, query
from tidepanel.functions.columns import day, r
from tidepanel.operators import cross as X, rolling as R
from tidepanel.operators.staging import materialize
from tidepanel.plans import eventscores as E, factors as FA, models as MO

XS = ["x1", "x2"]
CENTRED = SEEDS + f"""
, cu AS (SELECT code, date, pos, in_universe, label_1, label_3, CASE WHEN in_universe THEN reversal_short END AS a, CASE WHEN in_universe THEN vol_medium END AS b, CASE WHEN in_universe THEN label_1 END AS c FROM seeds),
cr AS (SELECT code, date, pos, in_universe, label_1, label_3, CASE WHEN a IS NULL THEN 0 ELSE {AR('a', 'date, (a IS NULL)')} / count(a) OVER (PARTITION BY date) - 0.5 END AS x1, CASE WHEN b IS NULL THEN 0 ELSE {AR('b', 'date, (b IS NULL)')} / count(b) OVER (PARTITION BY date) - 0.5 END AS x2,
 CASE WHEN c IS NULL THEN 0 ELSE {AR('c', 'date, (c IS NULL)')} / count(c) OVER (PARTITION BY date) - 0.5 END AS y FROM cu),
st AS (SELECT pos, count(*)::DOUBLE AS n, sum(y) AS sy, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * y) AS t1, sum(x2 * y) AS t2, sum(x1 * x1) AS q11, sum(x1 * x2) AS q12, sum(x2 * x2) AS q22 FROM cr WHERE in_universe AND label_1 IS NOT NULL GROUP BY pos)"""
FOLD = "sum(n) AS n, sum(sy) / sum(n) AS my, sum(s1) / sum(n) AS m1, sum(s2) / sum(n) AS m2, sum(t1) - sum(s1) * sum(sy) / sum(n) AS c1, sum(t2) - sum(s2) * sum(sy) / sum(n) AS c2, sum(q11) - sum(s1) * sum(s1) / sum(n) + 10 AS a11, sum(q12) - sum(s1) * sum(s2) / sum(n) AS a12, sum(q22) - sum(s2) * sum(s2) / sum(n) + 10 AS a22, count(*) AS train_days"
RIDGE = """
, d0 AS (SELECT min(date) AS d0, max(pos) AS last FROM cal), pt AS (SELECT min(date) AS date, min(pos) AS start FROM cal, d0 WHERE date >= d0 + INTERVAL 24 MONTH GROUP BY date_trunc('quarter', date)),
p2 AS (SELECT *, coalesce(lead(start) OVER (ORDER BY start), (SELECT last + 1 FROM d0)) AS stop, (SELECT min(pos) FROM cal WHERE cal.date >= pt.date - INTERVAL 36 MONTH) AS lo FROM pt),
fs AS (SELECT start, stop, """ + FOLD + """ FROM p2 JOIN st ON st.pos >= lo AND st.pos < greatest(start - 2, lo) GROUP BY ALL HAVING sum(n) >= 200),
wt AS (SELECT start, stop, n, (c1 * a22 - c2 * a12) / (a11 * a22 - a12 * a12) AS w1, (c2 * a11 - c1 * a12) / (a11 * a22 - a12 * a12) AS w2, my, m1, m2 FROM fs)"""


def centred(s):
    fs = [f for f in FA.seed_factors(3, 6, 12, 24) if f.name in ("reversal_short", "vol_medium")]
    d = FA.evaluate(s.labelled, fs).select("code", "date", "pos", "in_universe", "label_1", "label_3", "reversal_short", "vol_medium")
    return X.centred_ranks(d, {"x1": "reversal_short", "x2": "vol_medium", "y": "label_1"}, F.col("in_universe"))


TRAIN = "in_universe and label_1 is not null"


@query("ridge_daily_stats", "A10", labelled(CENTRED + " SELECT pos, n, round(sy, 6) AS sy, round(s1, 6) AS s1, round(s2, 6) AS s2, round(t1, 6) AS t1, round(t2, 6) AS t2, round(q11, 6) AS q11, round(q12, 6) AS q12, round(q22, 6) AS q22 FROM st"))
def _(s):
    d = MO.ridge_stats(centred(s).where(TRAIN), XS, "y")
    n = {"sy": "sy", "s_0": "s1", "s_1": "s2", "t_0": "t1", "t_1": "t2", "q_0_0": "q11", "q_0_1": "q12", "q_1_1": "q22"}
    return d.select("pos", "n", *[r(a).alias(b) for a, b in n.items()])


@query("walk_forward_ridge", "M1 M3 W39", labelled(CENTRED + RIDGE + """
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(x1 * w1 + x2 * w2 + my - m1 * w1 - m2 * w2, 6) AS score FROM cr JOIN wt ON pos >= start AND pos < stop WHERE in_universe"""))
def _(s):
    d, _w = MO.walk_forward_ridge(materialize(centred(s)), s.cal, XS, "y", F.expr(TRAIN), "quarterly", 24, 36, 1, 10.0, 200)
    return d.where("in_universe").select("code", day("date").alias("date"), r("score").alias("score"))


@query("refit_or_reuse", "S8 M3", labelled(CENTRED + RIDGE + """
SELECT code, strftime(cr.date, '%Y-%m-%d') AS date, strftime(p2.date, '%Y-%m-%d') AS asof, (cr.pos = wt.start)::INT AS refit, round((x1 * w1 + x2 * w2 + my - m1 * w1 - m2 * w2) * CASE WHEN p2.date <= DATE '1999-08-01' THEN 1 ELSE 2 END, 6) AS score
FROM cr JOIN wt ON cr.pos >= wt.start AND cr.pos < wt.stop JOIN p2 ON p2.start = wt.start WHERE in_universe"""))
def _(s):
    """Two runs on one store, the second after the labels were restated to twice their size: quarters fitted in the first run keep their models, a quarter that was open then included."""
    from tidepanel.plans import refit as RF

    d, store, setting = materialize(centred(s)), RF.ModelStore(s.spark), RF.Setting(tuple(XS), "quarter", 36, 2, 10.0, 200)
    days = s.cal.join(F.broadcast(s.cal.agg(F.min("date").alias("_d0")))).where(F.col("date") >= F.add_months("_d0", 24))
    store.refit_or_reuse(d, s.cal, days.where("date <= date '1999-08-01'"), "y", F.expr(TRAIN), setting)
    w = store.refit_or_reuse(d.withColumn("y", F.col("y") * 2), s.cal, days, "y", F.expr(TRAIN), setting)
    out = RF.scores(d.where("in_universe"), w, XS)
    return out.select("code", day("date").alias("date"), day("asof").alias("asof"), F.col("refit").cast("int").alias("refit"), r("score").alias("score"))


@query("ridge_importance", "M1", labelled(CENTRED + RIDGE + ", u AS (SELECT 'x1' AS feature, sum(abs(w1)) AS a FROM wt UNION ALL SELECT 'x2', sum(abs(w2)) FROM wt) SELECT feature, round(a / sum(a) OVER (), 6) AS share FROM u"))
def _(s):
    _, w = MO.walk_forward_ridge(materialize(centred(s)), s.cal, XS, "y", F.expr(TRAIN), "quarterly", 24, 36, 1, 10.0, 200)
    return MO.importance(w, XS).select("feature", r("share").alias("share"))


@query("composite_score", "M6", labelled(CENTRED + " SELECT code, strftime(date, '%Y-%m-%d') AS date, round((x1 + x2) / 2, 6) AS composite FROM cr WHERE in_universe"))
def _(s):
    return centred(s).where("in_universe").select("code", day("date").alias("date"), r((F.col("x1") + F.col("x2")) / 2).alias("composite"))


@query("marginal_ic", "A11 A10", labelled(CENTRED + """
, yf AS (SELECT year(date) AS year, min(pos) AS start, max(pos) + 1 AS stop, row_number() OVER (ORDER BY year(date)) AS i FROM cal GROUP BY year(date)),
fs AS (SELECT start, stop, """ + FOLD + """ FROM yf JOIN st ON st.pos < greatest(start - 2, 0) WHERE i > 2 GROUP BY ALL HAVING count(*) >= 20 AND sum(n) >= 200),
pr AS (SELECT cr.date, cr.code, label_1, x1 * (c1 * a22 - c2 * a12) / (a11 * a22 - a12 * a12) + x2 * (c2 * a11 - c1 * a12) / (a11 * a22 - a12 * a12) + my - m1 * (c1 * a22 - c2 * a12) / (a11 * a22 - a12 * a12) - m2 * (c2 * a11 - c1 * a12) / (a11 * a22 - a12 * a12) AS p1, x1 * c1 / a11 + my - m1 * c1 / a11 AS p0 FROM cr JOIN fs ON pos >= start AND pos < stop WHERE in_universe),
lg AS (SELECT date, code, label_1, 'with' AS m, round(p1, 10) AS p FROM pr UNION ALL SELECT date, code, label_1, 'without', round(p0, 10) FROM pr)""" + IC("p", "label_1", "m, date", "lg", n=8) + """
SELECT round(avg(ic) FILTER (WHERE m = 'with'), 5) AS ic_with, round(avg(ic) FILTER (WHERE m = 'without'), 5) AS ic_without, round(avg(ic) FILTER (WHERE m = 'with') - avg(ic) FILTER (WHERE m = 'without'), 5) AS marginal_ic FROM ic"""))
def _(s):
    d = MO.marginal_ic(materialize(centred(s)), s.cal, ["x1"], "x2", "y", "label_1", F.expr(TRAIN), F.col("in_universe"), 1, min_days=20, min_rows=200, min_names=8)
    return d.select(*[r(c, 5).alias(c) for c in ("ic_with", "ic_without", "marginal_ic")])


@query("walk_forward_select", "M2")
def _(s):
    d = X.centred_ranks(centred(s), {"y3": "label_3"}, F.col("in_universe")).withColumn("y3", F.when(F.col("label_3").isNotNull(), F.col("y3")))
    d = d.withColumn("y1", F.when(F.col("label_1").isNotNull(), F.col("y")))
    out = MO.walk_forward_select(d, s.cal, XS, {1: "y1", 3: "y3"}, F.col("in_universe"), F.col("in_universe"), [0.1, 10.0, 1000.0], "quarterly", 24, 36, 4, 3, 200, 8)
    return out.select("code", day("date").alias("date"), "alpha_1", "alpha_3", r("score").alias("score"))


@query("frozen_refit", "M3", labelled(CENTRED + """, fs AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, sum(x1 * y) - sum(x1) * sum(y) / count(*) AS c1, sum(x2 * y) - sum(x2) * sum(y) / count(*) AS c2, sum(x1 * x1) - sum(x1) * sum(x1) / count(*) + count(*) * 0.01::DOUBLE AS a11, sum(x1 * x2) - sum(x1) * sum(x2) / count(*) AS a12, sum(x2 * x2) - sum(x2) * sum(x2) / count(*) + count(*) * 0.01::DOUBLE AS a22
 FROM cr WHERE in_universe AND label_1 IS NOT NULL AND pos >= 24 AND pos < 58 AND pos + 2 <= 60)
SELECT 60 AS fit, n, round((c1 * a22 - c2 * a12) / (a11 * a22 - a12 * a12), 6) AS w1, round((c2 * a11 - c1 * a12) / (a11 * a22 - a12 * a12), 6) AS w2 FROM fs"""))
def _(s):
    d = centred(s).where(TRAIN).withColumn("label_end", F.col("pos") + 2)
    w = MO.fit_asof(d, XS, ["x1", "x2"], "y", "label_end", 60, 24, 2, 10.0, 200)
    return w.select("fit", "n", r(F.col("w")[0]).alias("w1"), r(F.col("w")[1]).alias("w2"))


@query("sample_table", "M4 F9 D13", labelled(SEEDS + f"""
, pl AS (SELECT *, CASE WHEN in_universe OR buyable THEN reversal_short END AS a, CASE WHEN in_universe OR buyable THEN turnover_shock END AS b, CASE WHEN in_universe THEN label_1 END AS lab FROM seeds),
rk AS (SELECT *, CASE WHEN a IS NOT NULL THEN {AR('a', 'date, (a IS NULL)')} / count(a) OVER (PARTITION BY date) END AS ra, CASE WHEN b IS NOT NULL THEN {AR('b', 'date, (b IS NULL)')} / count(b) OVER (PARTITION BY date) END AS rb, quantile_cont(lab, 0.01) OVER (PARTITION BY date) AS lo, quantile_cont(lab, 0.99) OVER (PARTITION BY date) AS hi FROM pl),
zz AS (SELECT *, (ra - avg(ra) OVER d) / nullif(stddev_pop(ra) OVER d, 0) AS za, (rb - avg(rb) OVER d) / nullif(stddev_pop(rb) OVER d, 0) AS zb, CASE WHEN lab IS NOT NULL THEN least(greatest(lab, lo), hi) END AS cl FROM rk WINDOW d AS (PARTITION BY date)),
yy AS (SELECT *, CASE WHEN count(cl) OVER d >= 3 AND stddev_pop(cl) OVER d > 0 THEN (cl - avg(cl) OVER d) / stddev_pop(cl) OVER d END AS y FROM zz WINDOW d AS (PARTITION BY date))
SELECT code, strftime(date, '%Y-%m-%d') AS date, (za IS NULL)::INT AS missing_rev, round(coalesce(za, 0), 6) AS rev, (zb IS NULL)::INT AS missing_shock, round(coalesce(zb, 0), 6) AS shock, round(CASE WHEN in_universe AND pos % 2 = 0 THEN y END, 6) AS y, buyable::INT AS predict FROM yy WHERE (in_universe AND pos % 2 = 0) OR buyable"""))
def _(s):
    fs = [f for f in FA.seed_factors(3, 6, 12, 24) if f.name in ("reversal_short", "turnover_shock")]
    d = FA.evaluate(s.labelled, fs)
    t = MO.sample_table(d, {"rev": "reversal_short", "shock": "turnover_shock"}, "label_1", F.col("in_universe"), F.col("buyable"), 2, 0.1)
    return t.select("code", day("date").alias("date"), "missing_rev", r("rev").alias("rev"), "missing_shock", r("shock").alias("shock"), r("y").alias("y"), "predict")


@query("alpha_scale", "W40", labelled("""
, z AS (SELECT pos, (close - avg(close) OVER d) / nullif(stddev_pop(close) OVER d, 0) AS z, label_1 FROM labelled WHERE in_universe WINDOW d AS (PARTITION BY pos)), sl AS (SELECT pos, CASE WHEN count(*) >= 8 THEN regr_slope(label_1, z) END AS slope FROM z WHERE z IS NOT NULL AND label_1 IS NOT NULL GROUP BY pos),
w AS (SELECT cal.date, cal.pos, count(slope) OVER w AS valid_days, avg(slope) OVER w AS m FROM cal LEFT JOIN sl USING (pos) WINDOW w AS (ORDER BY cal.pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT pos, valid_days, round(CASE WHEN valid_days >= 12 THEN greatest(m, 0) ELSE 0.005 END, 6) AS alpha_scale FROM w"""))
def _(s):
    d = X.cs_zscore(s.labelled.where("in_universe"), {"z": "close"}, ("pos",), pop=True)
    return MO.alpha_scale(d, "z", "label_1", 8, 24, 12, 0.005, s.cal).select("pos", "valid_days", r("alpha_scale").alias("alpha_scale"))


EV = """, evs AS (SELECT o_orderkey AS event_id, o_custkey AS code, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_totalprice * 0.0876543::DOUBLE AS score, o_orderpriority AS type FROM orders)"""


def events(s):
    return s.table("orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("code"), F.trunc(F.col("o_orderdate").cast("date"), "week").alias("date"),
                                    (F.col("o_totalprice") * 0.0876543).alias("score"), F.col("o_orderpriority").alias("type"))


@query("event_reference_percentile", "W32", "WITH " + EV[2:] + """
, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, date_trunc('month', date) AS m FROM (SELECT DISTINCT date FROM evs)), ms AS (SELECT m, min(i) AS start FROM dd GROUP BY m),
rf AS (SELECT ms.m, e.score FROM ms JOIN dd ON dd.i < start AND dd.i >= start - 26 JOIN evs e ON e.date = dd.date), n AS (SELECT m, count(*) AS n, list_sort(list(score)) AS sc FROM rf GROUP BY m)
SELECT event_id, round(CASE WHEN n >= 200 THEN len(list_filter(sc, lambda x: x <= e.score)) * 1.0 / n END, 6) AS pct FROM evs e LEFT JOIN n ON n.m = date_trunc('month', e.date)""")
def _(s):
    return E.monthly_reference(events(s), s.cal, 26, 200).select("event_id", r("pct").alias("pct"))


@query("event_decay", "W31 X21", dense("""
, ev AS (SELECT code, pos, max(2 * (close - low) / nullif(high - low, 0) - 1) AS s FROM dense WHERE volume >= 230 AND high > low GROUP BY ALL),
j AS (SELECT d.code, d.date, d.pos, e.pos AS t, e.s FROM dense d ASOF LEFT JOIN (SELECT code, pos, pos + 1 AS at, s FROM ev) e ON d.code = e.code AND d.pos >= e.at)
SELECT code, strftime(date, '%Y-%m-%d') AS date, CASE WHEN pos - t <= 6 THEN pos - t ELSE 7 END::DOUBLE AS event_age, (NOT coalesce(pos - t <= 6, FALSE))::INT AS event_missing, round(CASE WHEN pos - t <= 6 THEN s ELSE 0 END, 6) AS event_score_last, round(CASE WHEN pos - t <= 6 THEN s * exp(-ln(2) * (pos - t) / 3) ELSE 0 END, 6) AS event_decay_3 FROM j"""))
def _(s):
    d = s.dense
    sc = 2 * (F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) - 1
    ev = d.where("volume >= 230 and high > low").select("code", "pos", sc.alias("s"))
    out = E.decay_features(d.select("code", "date", "pos"), ev, 1, 6, [3])
    return out.select("code", day("date").alias("date"), "event_age", "event_missing", r("event_score_last").alias("event_score_last"), r("event_decay_3").alias("event_decay_3"))


@query("event_entries", "W33", "WITH " + EV[2:] + """
, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM evs)), ep AS (SELECT e.*, dd.pos FROM evs e JOIN dd USING (date)),
th AS (SELECT d.pos, count(*) AS n, quantile_cont(e.score, 0.9) AS cut FROM dd d JOIN ep e ON e.pos BETWEEN d.pos - 52 AND d.pos - 1 GROUP BY d.pos) SELECT event_id, pos FROM ep JOIN th USING (pos) WHERE n >= 100 AND score >= cut""")
def _(s):
    from tidepanel.operators.grid import calendar, with_pos

    e = events(s)
    e = with_pos(e, calendar(e))
    return E.trailing_entries(e, 52, 0.9, 100).select("event_id", F.col("pos").cast("long").alias("pos"))


@query("event_features", "N-F8", "WITH " + EV[2:] + f"""
, m AS (SELECT *, date_trunc('month', date) AS month, CASE WHEN event_id % 9 = 0 THEN NULL ELSE score END AS v FROM evs), rk AS (SELECT *, CASE WHEN v IS NOT NULL THEN {AR('v', 'type, month, (v IS NULL)')} / count(v) OVER (PARTITION BY type, month) END AS rr FROM m),
z AS (SELECT *, (rr - avg(rr) OVER g) / nullif(stddev_samp(rr) OVER g, 0) AS z FROM rk WINDOW g AS (PARTITION BY type, month))
SELECT event_id, (type = '1-URGENT')::INT AS is_urgent, (z IS NULL)::INT AS missing, round(coalesce(z, 0), 6) AS value FROM z""")
def _(s):
    e = events(s).withColumns({"month": F.trunc("date", "month"), "v": F.when(F.col("event_id") % 9 != 0, F.col("score"))})
    d = E.group_rank_z(e, ["type", "month"], {"z": "v"}, ("event_id",))
    return d.select("event_id", (F.col("type") == "1-URGENT").cast("int").alias("is_urgent"), F.col("z").isNull().cast("int").alias("missing"), r(F.coalesce("z", F.lit(0.0))).alias("value"))


EVENT_TYPES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unstated": "4-NOT SPECIFIED", "low": "5-LOW"}
EVENT_FIELDS = ("amount", "pre_event_ret", "log_circ_mv")
RANK_Z = "".join(f""", r_{f} AS (SELECT event_id, type, month, {AR(f, "type, month")} / count(*) OVER (PARTITION BY type, month) AS q FROM m WHERE {f} IS NOT NULL),
z_{f} AS (SELECT event_id, (q - avg(q) OVER g) / nullif(stddev_samp(q) OVER g, 0) AS z FROM r_{f} WINDOW g AS (PARTITION BY type, month))""" for f in EVENT_FIELDS)


@query("event_feature_table", "N-F8", dense("""
, ev AS (SELECT o_orderkey AS event_id, o_orderpriority AS type, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, 1 + o_custkey % (SELECT count(*) FROM supplier) AS code, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice * 0.0876543::DOUBLE END AS amount FROM orders),
pre AS (SELECT code, date, round(ln(greatest(circ_mv, 1)), 9) AS log_circ_mv, round(CASE WHEN count(ret_1d) OVER w >= 3 THEN sum(ret_1d) OVER w END, 9) AS pre_event_ret FROM dense WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
m AS (SELECT ev.*, log_circ_mv, pre_event_ret FROM ev LEFT JOIN pre ON pre.code = ev.code AND pre.date = ev.month)""" + RANK_Z + """
SELECT event_id, """ + ", ".join(f"(type = '{v}')::INT AS is_{k}" for k, v in EVENT_TYPES.items()) + ", " + ", ".join(f"round(coalesce(z_{f}.z, 0), 5) AS {f}" for f in EVENT_FIELDS) + "".join(f", (z_{f}.z IS NULL)::INT AS missing_{f}" for f in EVENT_FIELDS[:2])
    + " FROM m " + " ".join(f"LEFT JOIN z_{f} USING (event_id)" for f in EVENT_FIELDS)))
def _(s):
    """Orders as events of supplier codes: a flag for each type; amount, return before the event and capitalisation as ranks.  The first two are missing in more than 1 % of the rows and have a flag."""
    codes = s.table("supplier").agg(F.count("*").alias("_n"))
    e = s.table("orders").join(F.broadcast(codes)).select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("type"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"),
        (1 + F.col("o_custkey") % F.col("_n")).alias("code"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") * 0.0876543).alias("amount"))
    pre = s.dense.select("code", F.col("date").alias("month"), r(F.log(F.greatest("circ_mv", F.lit(1.0))), 9).alias("log_circ_mv"), r(R.ts_sum("ret_1d", 6, 3), 9).alias("pre_event_ret"))
    d = E.event_features(e.join(pre, ["code", "month"], "left"), EVENT_TYPES, list(EVENT_FIELDS), "month", ("event_id",))
    return d.select("event_id", *[f"is_{k}" for k in EVENT_TYPES], *[r(f, 5).alias(f) for f in EVENT_FIELDS], *[f"missing_{f}" for f in EVENT_FIELDS[:2]])


DEC = "WITH " + EV[2:] + """
, c AS (SELECT *, ((event_id * 7919) % 1009) / 1009.0::DOUBLE + score / 100000 AS car, year(date) * 10 + quarter(date) AS blk FROM evs), k AS (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY score, event_id) AS p, count(*) OVER (PARTITION BY blk) AS n FROM c),
d AS (SELECT *, (greatest(ceil((p - 1) * 10.0 / nullif(n - 1, 0)), 1) - 1)::INT AS decile FROM k), g AS (SELECT decile, count(*) AS n, avg(car) AS m, var_samp(car) AS v FROM d GROUP BY decile)"""


def _decile(s):
    k = F.col("event_id")
    e = events(s).withColumns({"car": k * 7919 % 1009 / 1009.0 + F.col("score") / 100000, "blk": F.year("date") * 10 + F.quarter("date")})
    return E.decile_report(e, "score", "car", "blk", "event_id")


@query("event_deciles", "A18", DEC + " SELECT decile, n, round(m, 6) AS mean_car FROM g")
def _(s):
    return _decile(s)[0].select("decile", "n", r("mean_car").alias("mean_car"))


@query("event_decile_spread", "A18", DEC + """ SELECT sum(n)::BIGINT AS events, round(max(m) FILTER (WHERE decile = 9) - max(m) FILTER (WHERE decile = 0), 6) AS top_minus_bottom,
 round((max(m) FILTER (WHERE decile = 9) - max(m) FILTER (WHERE decile = 0)) / sqrt(max(v) FILTER (WHERE decile = 9) / max(n) FILTER (WHERE decile = 9) + max(v) FILTER (WHERE decile = 0) / max(n) FILTER (WHERE decile = 0)), 6) AS t_stat,
 (SELECT round(corr(rk, decile), 6) FROM (SELECT decile, rank() OVER (ORDER BY m) AS rk FROM g)) AS monotonicity FROM g""")
def _(s):
    d = _decile(s)[1]
    return d.select("events", *[r(c).alias(c) for c in ("top_minus_bottom", "t_stat", "monotonicity")])

"""Panel construction, sources and sinks."""

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.catalog import ctes as T
from tidepanel.catalog.registry import dense, labelled, lines, query
from tidepanel.functions.columns import corr, day, flag, r
from tidepanel.operators import joins as J
from tidepanel.operators import ordering as O
from tidepanel.operators import rolling as R
from tidepanel.operators.grid import with_pos
from tidepanel.operators.staging import folder
from tidepanel.plans import futures, panel as P, pit
from tidepanel.sources import lookalikes as L
from tidepanel.sources.adapters import with_labels

KEY = "code, strftime(date, '%Y-%m-%d') AS date"


@query("panel_tier", "IO1 IO3 IO4 IO16 F1 F6 D4", lines(f""" SELECT {KEY}, round(close, 6) AS close, year(date)::INT AS year FROM panel WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-01'"""))
def _(s):
    """Written per year, read back with the window as a partition filter and a row filter."""
    path = f"{folder(s.spark)}/tier-{uuid.uuid4().hex}"
    p = s.bars.select("code", "date", "close").withColumn("year", F.year("date"))
    p.repartition("year").write.partitionBy("year").parquet(path)
    d = s.spark.read.parquet(path)
    d = d.where(F.col("year").between(1996, 1998) & F.col("date").between("1996-01-01", "1998-12-01"))
    return d.select("code", day("date").alias("date"), r("close").alias("close"), F.col("year").cast("int").alias("year"))


@query("code_list_scan", "IO2 F11 F13 IO5", """
WITH snap AS (SELECT max(date_trunc('month', l_shipdate)) AS m FROM lineitem WHERE l_shipdate < DATE '1999-06-15'), u AS (SELECT DISTINCT l_suppkey AS code FROM lineitem, snap WHERE date_trunc('month', l_shipdate) = snap.m AND l_quantity > 40)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT code FROM u) AND l_shipdate <= DATE '1999-06-15' AND l_returnflag = 'R'""")
def _(s):
    li = s.table("lineitem")
    early = li.where(F.col("l_shipdate") < "1999-06-15")
    snap = early.agg(F.max(F.trunc(F.col("l_shipdate").cast("date"), "month")).alias("m"))
    month = li.withColumn("m", F.trunc(F.col("l_shipdate").cast("date"), "month")).where("l_quantity > 40")
    codes = month.join(F.broadcast(snap), "m", "left_semi").select("l_suppkey").distinct()
    d = li.where((F.col("l_shipdate") <= "1999-06-15") & (F.col("l_returnflag") == "R"))
    return d.join(codes, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("share_fields", "P2 IO17", dense(f"""
, t AS (SELECT *, CASE WHEN code % 3 = 0 AND pos % 4 = 1 THEN 0 ELSE turnover * 100 END AS turn FROM dense), v AS (SELECT *, CASE WHEN turn > 0 AND volume > 0 THEN volume / (turn / 100) END AS sh FROM t),
f AS (SELECT *, last_value(sh IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos) AS float_shares FROM v)
SELECT {KEY}, round(amount / nullif(volume, 0), 6) AS vwap, round(float_shares, 4) AS float_shares, round(close * float_shares, 2) AS float_cap FROM f"""))
def _(s):
    d = s.dense.withColumn("turn", F.when((F.col("code") % 3 == 0) & (F.col("pos") % 4 == 1), 0.0).otherwise(F.col("turnover") * 100))
    d = P.share_fields(d)
    return d.select("code", day("date").alias("date"), r("vwap").alias("vwap"), r("float_shares", 4).alias("float_shares"), r("float_cap", 2).alias("float_cap"))


FLAGS = """
, t AS (SELECT d.code, d.date, d.pos, CASE d.code % 5 WHEN 0 THEN 'sh.688' WHEN 1 THEN 'sz.300' WHEN 2 THEN 'bj.830' WHEN 3 THEN 'sh.600' ELSE 'sz.000' END || lpad((d.code % 1000)::VARCHAR, 3, '0') AS code_text,
  (d.code % 11 = 4 AND d.pos % 5 < 2) AS is_st, floor(lag(close) OVER (PARTITION BY code ORDER BY pos) * 100) / 100 AS preclose, open AS open_raw, volume, CASE WHEN n_lines IS NULL THEN 0 ELSE 1 END AS trading, d.pos - (d.code * 3) % 9 AS days_listed FROM dense d),
r AS (SELECT *, CASE WHEN code_text LIKE 'bj.%' THEN 0.3 WHEN code_text LIKE 'sh.688%' THEN 0.2 WHEN code_text LIKE 'sz.30%' AND date >= DATE '1998-03-01' THEN 0.2 WHEN is_st THEN 0.05 ELSE 0.1 END::DOUBLE AS ratio, (trading = 0 OR volume <= 0) AS susp FROM t),
l AS (SELECT *, floor(preclose * (1 + ratio) * 100 + 0.5) / 100 AS limit_up, floor(preclose * (1 - ratio) * 100 + 0.5) / 100 AS limit_down FROM r),
x AS (SELECT *, coalesce(days_listed >= 5 AND NOT susp AND open_raw >= limit_up - 1e-6, FALSE) AS lu, coalesce(days_listed >= 5 AND NOT susp AND open_raw <= limit_down + 1e-6, FALSE) AS ld FROM l)"""


@query("trade_flags", "P3 P4 P5 P6", dense(FLAGS + f"""
SELECT {KEY}, ratio, round(limit_up, 2) AS limit_up, round(limit_down, 2) AS limit_down, susp::INT AS suspended, lu::INT AS up_open, ld::INT AS down_open, (NOT susp AND NOT lu)::INT AS can_buy, (NOT susp AND NOT ld)::INT AS can_sell FROM x"""))
def _(s):
    k = F.col("code")
    head = F.when(k % 5 == 0, "sh.688").when(k % 5 == 1, "sz.300").when(k % 5 == 2, "bj.830").when(k % 5 == 3, "sh.600").otherwise("sz.000")
    d = s.dense.withColumns({
        "code_text": F.concat(head, F.lpad((k % 1000).cast("string"), 3, "0")), "is_st": (k % 11 == 4) & (F.col("pos") % 5 < 2),
        "preclose": F.floor(R.ts_delay("close", 1) * 100) / 100, "open_raw": F.col("open"), "trading": F.col("n_lines").isNotNull().cast("int"),
        "days_listed": F.col("pos") - k * 3 % 9})
    x = P.trade_flags(d, reform="1998-03-01")
    return x.select("code", day("date").alias("date"), F.col("limit_ratio").alias("ratio"), r("limit_up", 2).alias("limit_up"), r("limit_down", 2).alias("limit_down"),
                    flag(F.col("is_suspended")).alias("suspended"), flag(F.col("limit_up_open")).alias("up_open"), flag(F.col("limit_down_open")).alias("down_open"),
                    flag(F.col("tradable_buy")).alias("can_buy"), flag(F.col("tradable_sell")).alias("can_sell"))


@query("forward_labels", "P7 P8 F12", labelled(f"""
SELECT {KEY}, round(ret_1d, 6) AS ret_1d, """ + ", ".join(f"round(CASE WHEN pos + {1 + h} <= 70 THEN label_{h} END, 6) AS label_{h}" for h in (1, 3, 6)) + " FROM labelled"))
def _(s):
    d = P.embargo(s.labelled, (1, 3, 6), F.lit(70))
    return d.select("code", day("date").alias("date"), *[r(c).alias(c) for c in ("ret_1d", "label_1", "label_3", "label_6")])


@query("rule_universe", "F3 F8 F9 F10", dense(f"""
, m AS (SELECT *, CASE WHEN count(amount) OVER w = 6 THEN avg(amount) OVER w END AS ma FROM dense WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
e AS (SELECT *, CASE WHEN pos >= 8 AND n_lines >= 2 AND ma IS NOT NULL THEN ma END AS me FROM m),
u AS (SELECT *, (rank() OVER (PARTITION BY date, me IS NULL ORDER BY me) + (count(*) OVER (PARTITION BY date, me) - 1) / 2.0) / count(me) OVER (PARTITION BY date) AS pct FROM e)
SELECT {KEY}, (me IS NOT NULL AND pct > 0.2)::INT AS in_universe FROM u WHERE pos % 2 = 0 QUALIFY count(*) FILTER (WHERE me IS NOT NULL AND pct > 0.2) OVER (PARTITION BY date) >= 5"""))
def _(s):
    from tidepanel.operators.cross import with_stats

    d = P.rule_universe(s.dense, 6, 0.2, (F.col("pos") >= 8) & (F.col("n_lines") >= 2)).where("pos % 2 = 0")
    d = with_stats(d, "date", {"_n": F.count(F.when(F.col("in_universe"), 1))}).where("_n >= 5")
    return d.select("code", day("date").alias("date"), flag(F.col("in_universe")).alias("in_universe"))


@query("account_pools", "F4 F5", dense(f"""
, c AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY circ_mv DESC, code) AS place, quantile_cont(turnover, 0.8) OVER (PARTITION BY date) AS cut FROM dense WHERE in_universe)
SELECT {KEY}, (place <= 20)::INT AS large, (code % 4 = 0 OR turnover >= cut)::INT AS growth FROM c"""))
def _(s):
    from tidepanel.operators.staging import materialize

    d = materialize(s.dense.where("in_universe").select("code", "date", "circ_mv", "turnover"))
    q = O.quantiles(d, ["date"], {"cut": ("turnover", 0.8)}, write=False)
    d = O.position(d, ["date"], [-F.col("circ_mv"), "code"], write=False).join(F.broadcast(q), "date")
    return d.select("code", day("date").alias("date"), (F.col("place") <= 20).cast("int").alias("large"),
                    ((F.col("code") % 4 == 0) | (F.col("turnover") >= F.col("cut"))).cast("int").alias("growth"))


@query("field_sample", "F7 T4", lines(f""" SELECT {KEY}, round(close, 6) AS close, volume FROM panel WHERE date = DATE '1997-05-01' ORDER BY code LIMIT 200"""))
def _(s):
    d = s.bars.where(F.col("date") == F.lit("1997-05-01").cast("date")).orderBy("code").limit(200)
    return d.select("code", day("date").alias("date"), r("close").alias("close"), "volume")


@query("forecast_rows", "P10", """
SELECT o_orderkey AS k, round((o_totalprice / 1000 + (o_orderkey % 50)) / 2, 7) AS fc_mid, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0 WHEN o_orderpriority = '5-LOW' THEN -1.0 ELSE 0.0 END::DOUBLE AS fc_sign FROM orders""")
def _(s):
    o = s.table("orders").select(F.col("o_orderkey").alias("code"), F.col("o_orderdate").cast("date").alias("pub_date"), F.col("o_orderpriority").alias("kind"),
                                 (F.col("o_totalprice") / 1000).alias("chg_up"), (F.col("o_orderkey") % 50).cast("double").alias("chg_down"))
    d = pit.forecast_rows(o, ["1-URGENT", "2-HIGH"], ["5-LOW"])
    return d.select(F.col("code").alias("k"), r("fc_mid", 7).alias("fc_mid"), "fc_sign")


BARS5 = """b AS (SELECT user_id AS code, CAST(ts AS DATE) AS date, time_bucket(INTERVAL 30 MINUTE, ts) AS bar, arg_min(value, (ts, event_id)) + 1 AS open, arg_max(value, (ts, event_id)) + 1 AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL),"""


@query("intraday_features", "P12", f"""WITH {BARS5}
c AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY code, date) AS n, lag(close) OVER w AS prev, first(open) OVER w AS o, first(close) OVER w AS fc FROM b WINDOW w AS (PARTITION BY code, date ORDER BY bar)),
d AS (SELECT *, coalesce(close / nullif(prev, 0) - 1, fc / nullif(o, 0) - 1) AS r FROM c)
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(sqrt(sum(r * r)), 6) AS rv, round(sum(CASE WHEN i > n - 2 THEN volume ELSE 0 END) / nullif(sum(volume), 0), 6) AS tail_share,
 round(max(CASE WHEN i = least(2, n) THEN close END) / max(o) - 1, 6) AS open_ret, round(sum(CASE WHEN r > 0 THEN volume ELSE 0 END) / nullif(sum(volume), 0), 6) AS up_share FROM d GROUP BY code, date HAVING count(*) >= 2""")
def _(s):
    from tidepanel.streaming.bars import event_bars

    d = pit.intraday_features(event_bars(s.table("events"), "30 minutes"), per_day=3, edge=2)
    return d.select("code", day("date").alias("date"), *[r(c).alias(c) for c in ("rv", "tail_share", "open_ret", "up_share")])


@query("fund_proxy", "P18", lines("""
, etf AS (SELECT code, date, open, close FROM panel WHERE pos >= 20 + code % 30), idx AS (SELECT code, date, open * 1.25::DOUBLE AS open, close * 1.25::DOUBLE AS close FROM panel),
f AS (SELECT code, min(date) AS first, arg_min(close, date) AS c FROM etf GROUP BY code), sc AS (SELECT f.code, f.first, f.c / i.close AS k FROM f JOIN idx i ON i.code = f.code AND i.date = f.first)
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(open, 6) AS open, round(close, 6) AS close, 0 AS is_proxy FROM etf UNION ALL
SELECT i.code, strftime(i.date, '%Y-%m-%d'), round(i.open * k, 6), round(i.close * k, 6), 1 FROM idx i JOIN sc ON sc.code = i.code AND i.date < sc.first"""))
def _(s):
    p = s.panel.select("code", "date", "pos", "open", "close")
    etf = p.where(F.col("pos") >= 20 + F.col("code") % 30)
    idx = p.select("code", "date", (F.col("open") * 1.25).alias("open"), (F.col("close") * 1.25).alias("close"))
    d = P.with_proxy(etf, idx)
    return d.select("code", day("date").alias("date"), r("open").alias("open"), r("close").alias("close"), "is_proxy")


@query("fund_panel", "P19", dense(f"""
, a AS (SELECT *, count(close) OVER (PARTITION BY code ORDER BY pos) AS listed, CASE WHEN count(amount) FILTER (WHERE amount > 0) OVER w >= 4 THEN avg(amount) FILTER (WHERE amount > 0) OVER w END AS a20, (close IS NOT NULL AND open IS NOT NULL) AS has_bar FROM dense WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT {KEY}, listed::BIGINT AS listed, (has_bar AND listed >= 6 AND (a20 IS NULL OR a20 >= 20000))::INT AS in_universe, round(CASE WHEN lead(has_bar) OVER v THEN lead(open, 4) OVER v / lead(open, 1) OVER v - 1 END, 6) AS label_3 FROM a WINDOW v AS (PARTITION BY code ORDER BY pos)"""))
def _(s):
    d = P.fund_panel(s.dense.drop("in_universe"), (3,), 6, 20000.0, 8, 4)
    return d.select("code", day("date").alias("date"), "listed", flag(F.col("in_universe")).alias("in_universe"), r("label_3").alias("label_3"))


DAYS = """days AS (SELECT d AS date, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS pos, avg(px) AS spot FROM (SELECT CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity * 0.13876543219::DOUBLE AS px FROM lineitem WHERE isodow(l_shipdate) <= 5) GROUP BY d),
settle AS (SELECT month, date AS settle, pos AS settle_pos FROM (SELECT month, (SELECT min(date) FROM days WHERE date >= f) AS date FROM (SELECT DISTINCT date_trunc('month', date)::DATE AS month, date_trunc('month', date)::DATE + ((12 - isodow(date_trunc('month', date)::DATE)) % 7)::INT + 14 AS f FROM days)) JOIN days USING (date)),
futs AS (SELECT d.pos, s.month, CASE WHEN (d.pos + month(s.month)) % 41 = 0 AND d.pos < 300 THEN NULL ELSE d.spot * (1 + (s.settle_pos - d.pos) * 0.0002::DOUBLE + (d.pos % 7) / 1000.0) END AS close FROM days d JOIN settle s ON s.settle_pos >= d.pos AND s.settle_pos - d.pos <= 60)"""


def _days(s):
    li = s.table("lineitem").select(F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0)) * 0.13876543219).alias("px"))
    d = li.where(F.weekday("date") <= 4).groupBy("date").agg(F.avg("px").alias("spot"))
    return d.withColumn("pos", F.row_number().over(W.orderBy("date")) - 1)


def _futures(s):
    days = _days(s)
    cal = days.select("date", "pos")
    settle = futures.settlement_days(cal)
    b = days.join(F.broadcast(settle), (F.col("settle_pos") >= F.col("pos")) & (F.col("settle_pos") - F.col("pos") <= 60))
    px = F.col("spot") * (1 + (F.col("settle_pos") - F.col("pos")) * 0.0002 + F.col("pos") % 7 / 1000.0)
    hole = ((F.col("pos") + F.month("month")) % 41 == 0) & (F.col("pos") < 300)
    return days, cal, settle, b.select("pos", "month", F.when(~hole, px).alias("close"))


@query("settlement_days", "P20", f"WITH {DAYS} SELECT strftime(month, '%Y-%m-%d') AS month, strftime(settle, '%Y-%m-%d') AS settle, settle_pos FROM settle")
def _(s):
    _, _, settle, _ = _futures(s)
    return settle.select(day("month").alias("month"), day("settle").alias("settle"), "settle_pos")


@query("futures_front_leg", "P21 D21", f"""WITH {DAYS}, held AS (SELECT d.pos, arg_min(month, settle_pos) AS month, min(settle_pos) AS expiry FROM days d JOIN settle s ON s.settle_pos > d.pos GROUP BY d.pos),
h AS (SELECT held.*, f.close, d.spot FROM held LEFT JOIN futs f USING (pos, month) JOIN days d USING (pos)), g AS (SELECT *, lag(CASE WHEN close IS NOT NULL THEN month END) OVER (ORDER BY pos) AS pm, lag(close) OVER (ORDER BY pos) AS pc FROM h)
SELECT g.pos, strftime(g.month, '%Y-%m') AS contract, round(f.close / pc - 1, 6) AS fut_ret, round(g.close / spot - 1, 6) AS basis, CASE WHEN g.close IS NOT NULL THEN (expiry - g.pos)::DOUBLE END AS days_to_expiry, (g.pos IN (SELECT settle_pos FROM settle))::INT AS roll FROM g LEFT JOIN futs f ON f.pos = g.pos AND f.month = g.pm""")
def _(s):
    days, cal, settle, bars = _futures(s)
    d = futures.front_leg(bars, days.select("pos", "spot"), cal, settle)
    return d.select("pos", F.date_format("month", "yyyy-MM").alias("contract"), r("fut_ret").alias("fut_ret"), r("basis").alias("basis"), F.col("days_to_expiry").cast("double").alias("days_to_expiry"), "roll")


@query("futures_splice", "P22", f"""WITH {DAYS}, c AS (SELECT pos, spot, spot * (1 + (pos % 13 - 6) / 2000.0) AS future FROM days), x AS (SELECT c.*, future / spot - 1 AS basis, lag(future) OVER w AS pf, lag(spot) OVER w AS ps, CASE WHEN pos IN (SELECT settle_pos FROM settle) AND pos < (SELECT max(pos) FROM c) THEN abs(future / spot - 1) > 0.0012::DOUBLE END AS wide FROM c WINDOW w AS (ORDER BY pos))
SELECT pos, round(CASE WHEN wide THEN spot / pf - 1 WHEN lag(wide) OVER (ORDER BY pos) = FALSE THEN spot / ps - 1 ELSE future / pf - 1 END, 6) AS fut_ret, (wide IS NOT NULL)::INT AS roll FROM x""")
def _(s):
    days, _, settle, _ = _futures(s)
    c = days.select("pos", "spot", (F.col("spot") * (1 + (F.col("pos") % 13 - 6) / 2000.0)).alias("future"))
    return futures.splice_leg(c, settle, 0.0012).select("pos", r("fut_ret").alias("fut_ret"), "roll")


@query("futures_complete_roll", "P23", f"""WITH {DAYS}, seg AS (SELECT settle_pos AS expiry, lead(month) OVER w AS front, lead(settle_pos) OVER w AS until FROM settle WINDOW w AS (ORDER BY settle_pos)),
q AS (SELECT expiry, bool_and(f.close IS NOT NULL) AS ok FROM seg JOIN days d ON d.pos BETWEEN expiry AND until LEFT JOIN futs f ON f.pos = d.pos AND f.month = front WHERE front IS NOT NULL GROUP BY expiry)
SELECT min(expiry)::INT AS start_pos FROM (SELECT expiry, bool_and(ok) OVER (ORDER BY expiry DESC) AS a FROM q) WHERE a""")
def _(s):
    _, cal, settle, bars = _futures(s)
    return futures.complete_roll_start(bars, cal, settle)


SNAPS = """, snaps AS (SELECT pos AS snap_pos, code, amount * (1 + code % 3) AS weight FROM panel WHERE pos % 6 = 0 AND code % 2 = 0)"""


def _snaps(s):
    return s.panel.where("pos % 6 = 0 and code % 2 = 0").select(F.col("pos").alias("snap_pos"), "code", (F.col("amount") * (1 + F.col("code") % 3)).alias("weight"))


@query("index_weight_return", "P24 IO15", dense(SNAPS + """
, f AS (SELECT pos, (SELECT max(snap_pos) FROM snaps WHERE snap_pos <= cal.pos - 1) AS snap_pos FROM cal), p0 AS (SELECT s.*, weight / p.close AS shares FROM snaps s JOIN dense p ON p.code = s.code AND p.pos = s.snap_pos WHERE p.close > 0),
x AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY pos) AS prev FROM dense)
SELECT x.pos, round(sum(shares * close) / sum(shares * prev) - 1, 6) AS ret, count(*) AS names FROM x JOIN f USING (pos) JOIN p0 ON p0.snap_pos = f.snap_pos AND p0.code = x.code GROUP BY x.pos"""))
def _(s):
    return P.weight_returns(s.dense, _snaps(s), s.cal).select("pos", r("ret").alias("ret"), "names")


@query("index_drifted_weights", "P25", dense(SNAPS + """
, f AS (SELECT pos, (SELECT max(snap_pos) FROM snaps WHERE snap_pos <= cal.pos) AS snap_pos FROM cal), p0 AS (SELECT s.*, p.close AS p0 FROM snaps s JOIN dense p ON p.code = s.code AND p.pos = s.snap_pos),
j AS (SELECT x.pos, x.code, weight * (close / p0) AS w FROM dense x JOIN f USING (pos) JOIN p0 ON p0.snap_pos = f.snap_pos AND p0.code = x.code WHERE close IS NOT NULL)
SELECT pos, code, round(w / sum(w) OVER (PARTITION BY pos), 8) AS weight FROM j"""))
def _(s):
    return P.drifted_weights(s.dense, _snaps(s), s.cal).select("pos", "code", r("weight", 8).alias("weight"))


PROXY = """, pw AS (SELECT *, lag(CASE WHEN in_universe AND circ_mv > 0 THEN circ_mv ELSE 0 END) OVER (PARTITION BY code ORDER BY pos) AS w FROM dense),
proxy AS (SELECT date, pos, sum(w * coalesce(ret_1d, 0)) / nullif(sum(w), 0) AS proxy FROM pw GROUP BY date, pos),
bench AS (SELECT date, avg(close) AS px FROM dense WHERE code % 2 = 0 AND pos % 10 <> 3 GROUP BY date),
bret AS (SELECT date, px / lag(px) OVER (ORDER BY date) - 1 AS bret FROM (SELECT cal.date, last_value(px IGNORE NULLS) OVER (ORDER BY cal.date) AS px FROM cal LEFT JOIN bench USING (date)))"""


@query("proxy_tracking", "P26 P27 D7", dense(PROXY + """
SELECT count(*) AS days, round(stddev_pop(proxy - bret) * sqrt(12), 6) AS tracking_error, round(avg(proxy - bret) * 12, 6) AS annual_gap, round(corr(proxy, bret), 6) AS correlation FROM proxy JOIN bret USING (date) WHERE proxy IS NOT NULL AND bret IS NOT NULL"""))
def _(s):
    from tidepanel.plans.metrics import benchmark_returns

    proxy = P.cap_weighted(s.dense, F.col("in_universe"))
    b = s.bars.join(s.cal, "date").where("code % 2 = 0 and pos % 10 <> 3").groupBy("date").agg(F.avg("close").alias("px"))
    j = proxy.join(benchmark_returns(b, s.cal), "date").where("proxy is not null and bret is not null").withColumn("gap", F.col("proxy") - F.col("bret"))
    return j.agg(F.count("*").alias("days"), r(F.stddev_pop("gap") * F.sqrt(F.lit(12.0))).alias("tracking_error"), r(F.avg("gap") * 12).alias("annual_gap"), r(corr("proxy", "bret")).alias("correlation"))


@query("quality_report", "P28", labelled("""
, d AS (SELECT count(*) FILTER (WHERE in_universe) AS n FROM labelled GROUP BY date), a AS (SELECT count(*) FILTER (WHERE in_universe) AS n, count(close) FILTER (WHERE in_universe) AS c, count(label_1) FILTER (WHERE in_universe) AS l, count(*) FILTER (WHERE in_universe AND abs(ret_1d) > 0.5) AS w FROM labelled)
SELECT 'min_universe' AS check, min(n)::DOUBLE AS value, (min(n) >= 10)::INT AS passed FROM d UNION ALL SELECT 'close_coverage', round(c / n, 6), (c / n >= 0.95)::INT FROM a UNION ALL SELECT 'label_coverage', round(l / n, 6), (l / n >= 0.5)::INT FROM a UNION ALL SELECT 'anomaly_rate', round(w / n, 6), (w / n <= 0.01)::INT FROM a"""))
def _(s):
    return P.quality_report(s.stored, 10, "label_1").withColumn("value", F.round("value", 6))


@query("field_describe", "P29", lines("""
, u AS (UNPIVOT (SELECT close, volume, n_lines::DOUBLE AS n_lines FROM panel) ON close, volume, n_lines INTO NAME field VALUE x)
SELECT field, 1.0::DOUBLE AS coverage, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, """ + ", ".join(f"round(quantile_cont(x, {p / 100}), 4) AS q{p:02d}" for p in (1, 25, 50, 75, 99)) + " FROM u GROUP BY field"))
def _(s):
    d = P.describe(s.bars, ["close", "volume", "n_lines"])
    return d.select("field", "coverage", *[r(c, 4).alias(c) for c in ("mean", "std", "q01", "q25", "q50", "q75", "q99")])


@query("top_values", "P29 T3", "SELECT p_type, count(*) AS rows FROM part GROUP BY p_type ORDER BY rows DESC, p_type LIMIT 10")
def _(s):
    return P.top_values(s.table("part"), "p_type", 10)


@query("price_source_preference", "P35", lines(f"""
, a AS (SELECT code, date, close * 1.5::DOUBLE AS px, 1 AS p FROM panel WHERE code % 3 = 0 AND pos % 5 <> 2), b AS (SELECT code, date, close AS px, 0 AS p FROM panel)
SELECT {KEY}, round(arg_max(px, p), 6) AS px FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL"""))
def _(s):
    a = s.panel.where("code % 3 = 0 and pos % 5 <> 2").select("code", "date", (F.col("close") * 1.5).alias("px"))
    d = J.union_prefer([s.bars.select("code", "date", F.col("close").alias("px")), a], ["code", "date"])
    return d.select("code", day("date").alias("date"), r("px").alias("px"))


@query("change_detection", "W30", dense(f"""
, v AS (SELECT *, CASE WHEN n_lines IS NULL THEN NULL ELSE n_lines % 4 END AS period FROM dense), c AS (SELECT *, (period IS NOT NULL AND period IS DISTINCT FROM lag(period) OVER (PARTITION BY code ORDER BY pos)) AS new FROM v)
SELECT {KEY}, period, new::INT AS changed, (row_number() OVER (PARTITION BY code, period ORDER BY pos) = 1)::INT AS first_seen FROM c WHERE new"""))
def _(s):
    d = s.dense.withColumn("period", F.col("n_lines") % 4)
    d = P.detect_changes(d, ["period"], "changed").where("changed = 1")
    first = F.row_number().over(W.partitionBy("code", "period").orderBy("pos")) == 1
    return d.select("code", day("date").alias("date"), "period", "changed", first.cast("int").alias("first_seen"))


@query("retrain_points", "W39 T7 S8", f"""WITH {DAYS.split('settle AS')[0].rstrip().rstrip(',')}
SELECT 'monthly' AS every, strftime(min(date), '%Y-%m-%d') AS date FROM days WHERE date >= DATE '1996-03-10' GROUP BY date_trunc('month', date) UNION ALL
SELECT 'quarterly', strftime(min(date), '%Y-%m-%d') FROM days WHERE date >= DATE '1996-03-10' GROUP BY date_trunc('quarter', date) UNION ALL
SELECT 'weekly', strftime(min(date), '%Y-%m-%d') FROM days WHERE date >= DATE '1996-03-10' GROUP BY date_trunc('week', date) UNION ALL
SELECT 'week_end', strftime(max(date), '%Y-%m-%d') FROM days GROUP BY isoyear(date), weekofyear(date)""")
def _(s):
    cal = _days(s).select("date", "pos")
    first = F.lit("1996-03-10").cast("date")
    out = cal.groupBy(F.trunc("date", "week").alias("w")).agg(F.max("date").alias("date")).select(F.lit("week_end").alias("every"), "date")
    for e in ("weekly", "monthly", "quarterly"):
        out = out.unionByName(P.retrain_points(cal, e, first).select(F.lit(e).alias("every"), "date"))
    return out.select("every", day("date").alias("date"))


@query("set_operations", "U1 U2 U3 U4 U6", "WITH " + T.STATEMENTS + """
, common AS (SELECT code, stat_date FROM income INTERSECT SELECT code, stat_date FROM balance INTERSECT SELECT code, stat_date FROM cash), miss AS (SELECT code, stat_date FROM income EXCEPT SELECT code, stat_date FROM common)
SELECT 'common' AS kind, code, strftime(stat_date, '%Y-%m-%d') AS stat_date FROM common UNION ALL SELECT 'missing', code, strftime(stat_date, '%Y-%m-%d') FROM miss""")
def _(s):
    st = [d.select("code", "stat_date") for d in L.statements(s).values()]
    common = st[0].intersect(st[1]).intersect(st[2])
    miss = st[0].exceptAll(common)
    d = common.withColumn("kind", F.lit("common")).unionByName(miss.withColumn("kind", F.lit("missing")))
    return d.select("kind", "code", day("stat_date").alias("stat_date"))


@query("dense_grid", "P33 D2", dense(f" SELECT {KEY}, pos, round(close, 6) AS close FROM dense"))
def _(s):
    return s.dense.select("code", day("date").alias("date"), "pos", r("close").alias("close"))


@query("relabel_with_buyability", "P7", dense(f""" SELECT {KEY}, round(CASE WHEN lead(buyable) OVER w THEN lead(close, 3) OVER w / lead(close, 1) OVER w - 1 END, 6) AS label_2 FROM dense WINDOW w AS (PARTITION BY code ORDER BY pos)"""))
def _(s):
    return with_labels(s.dense, (2,), "close").select("code", day("date").alias("date"), r("label_2").alias("label_2"))

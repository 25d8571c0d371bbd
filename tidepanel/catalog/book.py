"""Book analytics on trades and holdings look-alikes."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.catalog.registry import dense, query
from tidepanel.functions.columns import day, div, r
from tidepanel.operators import rolling as R
from tidepanel.operators.cross import with_stats
from tidepanel.operators.grid import with_pos
from tidepanel.operators.staging import materialize
from tidepanel.plans import book as B, metrics as M

TR = """trades AS (SELECT l_partkey % 40 AS account, l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS seq,
 CASE WHEN l_tax >= 0.08::DOUBLE AND l_discount <= 0.01::DOUBLE THEN 'set' WHEN l_returnflag = 'R' AND l_linenumber > 2 THEN 'sell' WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'dividend' ELSE 'buy' END AS type, l_quantity AS quantity, l_extendedprice AS amount, l_extendedprice / l_quantity AS price, l_extendedprice * l_tax / 100 AS fee FROM lineitem)"""


def trades(s):
    li = s.table("lineitem")
    kind = (F.when((F.col("l_tax") >= 0.08) & (F.col("l_discount") <= 0.01), "set").when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 2), "sell")
            .when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), "dividend").otherwise("buy"))
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return li.select((F.col("l_partkey") % 40).alias("account"), F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("date"), seq.alias("seq"), kind.alias("type"),
                     F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"), (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("price"),
                     (F.col("l_extendedprice") * F.col("l_tax") / 100).alias("fee"))


def moves(s):
    """Trades without their money."""
    return trades(s).drop("amount", "price", "fee")


REPLAY = TR + """, sg AS (SELECT *, sum((type = 'set')::INT) OVER (PARTITION BY account, code ORDER BY date, seq) AS seg FROM trades), rp AS (SELECT *, sum(CASE type WHEN 'sell' THEN -quantity WHEN 'dividend' THEN 0 ELSE quantity END) OVER (PARTITION BY account, code, seg ORDER BY date, seq) AS held FROM sg)"""


@query("trade_replay", "A50", f"WITH {REPLAY} SELECT account, code, strftime(date, '%Y-%m-%d') AS date, arg_max(held, seq) AS held FROM rp GROUP BY ALL")
def _(s):
    return B.end_of_day(B.replay(moves(s))).select("account", "code", day("date").alias("date"), "held")


@query("trade_cash", "A50", f"WITH {TR}, c AS (SELECT account, date, CAST(sum(CAST(CASE type WHEN 'buy' THEN -(amount + fee) WHEN 'sell' THEN amount - fee WHEN 'dividend' THEN amount ELSE 0 END AS DECIMAL(24,6))) AS DECIMAL(30,6)) AS f FROM trades GROUP BY ALL) SELECT account, strftime(date, '%Y-%m-%d') AS date, round(CAST(sum(f) OVER (PARTITION BY account ORDER BY date) AS DOUBLE), 6) AS cash FROM c")
def _(s):
    return B.cash_by_day(trades(s)).select("account", day("date").alias("date"), r("cash", 6).alias("cash"))


@query("oversell_rows", "A50", f"WITH {REPLAY} SELECT account, count(*) AS oversold FROM rp WHERE held < 0 GROUP BY account")
def _(s):
    return B.replay(moves(s)).where("held < 0").groupBy("account").agg(F.count("*").alias("oversold"))


@query("anchor_check", "U4 A50", f"WITH {REPLAY}, f AS (SELECT account, code, arg_max(held, (date, seq)) AS held FROM rp GROUP BY ALL), a AS (SELECT account, code, held + CASE WHEN (account + code) % 11 = 0 THEN 5 ELSE 0 END AS quantity FROM f WHERE (account * 3 + code) % 17 <> 0) SELECT account, code, coalesce(held, 0) - coalesce(quantity, 0) AS gap FROM f FULL JOIN a USING (account, code) WHERE abs(coalesce(held, 0) - coalesce(quantity, 0)) > 1e-6")
def _(s):
    from tidepanel.operators.joins import keep_one

    f = materialize(keep_one(B.replay(moves(s)).select("account", "code", "date", "seq", "held"), ["account", "code"], ["date", "seq"]).select("account", "code", "held"))
    a = f.where((F.col("account") * 3 + F.col("code")) % 17 != 0).select("account", "code", (F.col("held") + F.when((F.col("account") + F.col("code")) % 11 == 0, 5.0).otherwise(0.0)).alias("quantity"))
    return B.anchor_gaps(f, a)


COST = "WITH RECURSIVE " + REPLAY + """, kb AS (SELECT *, row_number() OVER (PARTITION BY account, code ORDER BY date, seq) AS k, CASE type WHEN 'sell' THEN CASE WHEN held + quantity > 0 THEN held / (held + quantity) ELSE 0 END WHEN 'set' THEN 0 ELSE 1 END AS keep, CASE type WHEN 'buy' THEN amount WHEN 'set' THEN quantity * price ELSE 0 END AS add FROM rp),
bs AS (SELECT account, code, k, add AS basis FROM kb WHERE k = 1 UNION ALL SELECT n.account, n.code, n.k, b.basis * CASE WHEN n.keep > 1e-9 THEN n.keep ELSE 0 END + n.add FROM bs b JOIN kb n ON n.account = b.account AND n.code = b.code AND n.k = b.k + 1)"""


@query("average_cost", "A38", COST + " SELECT account, code, strftime(date, '%Y-%m-%d') AS date, type, held, round(basis / held * 0.987654321987::DOUBLE, 4) AS cost FROM kb JOIN bs USING (account, code, k) WHERE held > 0")
def _(s):
    """Costs in a unit that keeps decimal ties away from the rounding."""
    d = B.replay_with_cost(trades(s).drop("fee"))
    return d.where("held > 0").select("account", "code", day("date").alias("date"), "type", "held", r(F.col("cost") * 0.987654321987, 4).alias("cost"))


@query("disposition_effect", "A38", COST + """, st AS (SELECT account, code, date, arg_max({'h': held, 'c': basis / nullif(held, 0)}, seq) AS v FROM kb JOIN bs USING (account, code, k) GROUP BY ALL),
sp AS (SELECT account, code, v.h AS held, v.c AS cost, date, lead(date) OVER (PARTITION BY account, code ORDER BY date) AS nxt FROM st), sd AS (SELECT DISTINCT account, date FROM trades WHERE type = 'sell'),
sl AS (SELECT account, code, date, max(price) AS sale_px FROM trades WHERE type = 'sell' GROUP BY ALL), px AS (SELECT code, date, avg(price) AS px FROM trades GROUP BY ALL),
c AS (SELECT sp.account, sp.code, sd.date, cost FROM sp JOIN sd ON sd.account = sp.account AND sd.date > sp.date AND (nxt IS NULL OR sd.date <= nxt) WHERE held > 0 AND cost > 0),
q AS (SELECT c.*, sale_px IS NOT NULL AS sold, coalesce(sale_px, px) > cost AS gain FROM c ASOF LEFT JOIN px ON px.code = c.code AND c.date >= px.date LEFT JOIN sl ON sl.account = c.account AND sl.code = c.code AND sl.date = c.date WHERE coalesce(sale_px, px) IS NOT NULL),
g AS (SELECT account, count(*) FILTER (WHERE sold AND gain) AS realized_gain, count(*) FILTER (WHERE sold AND NOT gain) AS realized_loss, count(*) FILTER (WHERE NOT sold AND gain) AS paper_gain, count(*) FILTER (WHERE NOT sold AND NOT gain) AS paper_loss FROM q GROUP BY account)
SELECT *, round(realized_gain / nullif(realized_gain + paper_gain, 0) - realized_loss / nullif(realized_loss + paper_loss, 0), 6) AS pgr_minus_plr FROM g""")
def _(s):
    t = materialize(trades(s).drop("fee"))
    st = B.replay_with_cost(t)
    from tidepanel.operators.joins import keep_one

    eod = materialize(keep_one(st.select("account", "code", "date", "seq", "held", "cost"), ["account", "code", "date"], ["seq"]).drop("seq"))
    px = t.groupBy("code", "date").agg(F.avg("price").alias("px"))
    d = B.disposition(eod, t.where("type = 'sell'").select("account", "code", "date", F.col("price").alias("px")), px)
    return d.select("account", "realized_gain", "realized_loss", "paper_gain", "paper_loss", r("pgr_minus_plr").alias("pgr_minus_plr"))


DPOS = TR + """, dc AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM trades)), tp AS (SELECT t.*, pos FROM trades t JOIN dc USING (date))"""


@query("repurchase_rate", "A39", f"WITH {DPOS}, b AS (SELECT DISTINCT account, code, pos FROM tp WHERE type = 'buy'), s AS (SELECT account, code, pos, count(*) AS n FROM tp WHERE type = 'sell' GROUP BY ALL) SELECT account, sum(n)::BIGINT AS sells, sum(CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.account = s.account AND b.code = s.code AND b.pos > s.pos AND b.pos - s.pos <= 20) THEN n ELSE 0 END)::BIGINT AS repurchased FROM s GROUP BY account")
def _(s):
    from tidepanel.operators.grid import calendar

    t = trades(s)
    return B.repurchases(with_pos(t, calendar(t)), 20)


GRID = """, px AS (SELECT code, pos, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos) AS px FROM dense), bm AS (SELECT pos, avg(px) AS px FROM px GROUP BY pos), mt AS (SELECT t.account, t.code, t.type, t.date AS d0, cal.date, cal.pos, t.price * 0.13876543219::DOUBLE AS price FROM trades t JOIN cal ON cal.date = date_trunc('month', t.date))"""


def grid(s):
    px = s.dense.select("code", "pos", R.ffill("close").alias("px"))
    t = trades(s).withColumn("date", F.trunc("date", "month")).withColumn("price", F.col("price") * 0.13876543219)
    return px, with_pos(t, s.cal)


@query("chasing_excess", "A39", dense(", " + TR + GRID + """ SELECT b.account, round(avg(p1.px / p0.px - b1.px / b0.px), 6) AS mean_prior_excess, count(*) AS n FROM mt b JOIN px p0 ON p0.code = b.code AND p0.pos = b.pos - 4 JOIN px p1 ON p1.code = b.code AND p1.pos = b.pos - 1 JOIN bm b0 ON b0.pos = b.pos - 4 JOIN bm b1 ON b1.pos = b.pos - 1 WHERE type = 'buy' GROUP BY b.account"""))
def _(s):
    px, t = grid(s)
    px = materialize(px)
    bench = px.groupBy("pos").agg(F.avg("px").alias("px"))
    return B.chasing(t.where("type = 'buy'").select("account", "code", "pos"), px, bench, 4).select("account", r("mean_prior_excess").alias("mean_prior_excess"), "n")


SWITCH = dense(", " + TR + GRID + """, f AS (SELECT account, mt.date, mt.code, type, avg(p.px / price - 1) AS fwd FROM mt JOIN px p ON p.code = mt.code AND p.pos = mt.pos + 3 WHERE type IN ('buy', 'sell') AND p.px IS NOT NULL GROUP BY ALL),
v AS (SELECT s.account, s.date, s.code AS sold, (SELECT avg(b.fwd) FROM f b WHERE b.account = s.account AND b.date = s.date AND b.type = 'buy' AND b.code <> s.code) - s.fwd AS value FROM f s WHERE s.type = 'sell')""")


@query("switch_values", "A39", SWITCH + " SELECT account, strftime(date, '%Y-%m-%d') AS date, sold, round(value, 6) AS value FROM v WHERE value IS NOT NULL")
def _(s):
    px, t = grid(s)
    return B.switch_values(t, px, 3).select("account", day("date").alias("date"), "sold", r("value").alias("value"))


_draw = "(k * 48271 + draw * 69621 + 1) % 2147483647"
BOOT = f"""WITH o AS (SELECT o_orderkey % 2147483647 AS k, o_totalprice AS x FROM orders), h AS (SELECT draw, x, k, {_draw} AS a FROM o, range(2000) AS r(draw)), i AS (SELECT draw, x, a, (a * a + k) % 2147483647 AS b FROM h),
j AS (SELECT draw, x, (b * b + a) % 2147483647 AS c FROM i), n AS (SELECT draw, x, """ + " + ".join(f"(c > {t})::INT" for t in B.POISSON) + """ AS n FROM j), m AS (SELECT draw, sum(n * x) / sum(n) AS m FROM n GROUP BY draw)
SELECT round(quantile_cont(m, 0.025), 2) AS lo, round(quantile_cont(m, 0.975), 2) AS hi FROM m"""


@query("bootstrap_interval", "A37", BOOT)
def _(s):
    o = s.table("orders").select("o_orderkey", "o_totalprice")
    return B.bootstrap_mean(o, "o_orderkey", "o_totalprice", 2000).select(r("lo", 2).alias("lo"), r("hi", 2).alias("hi"))


@query("trading_costs", "A39", f"WITH {TR} SELECT account, round(sum(fee), 4) AS fees, round(sum(fee) / sum(CASE WHEN type IN ('buy', 'sell') THEN amount END), 8) AS fee_rate FROM trades GROUP BY account")
def _(s):
    return trades(s).groupBy("account").agg(r(F.sum("fee"), 4).alias("fees"), r(F.sum("fee") / F.sum(F.when(F.col("type").isin("buy", "sell"), F.col("amount"))), 8).alias("fee_rate"))


NAVS = """, sn AS (SELECT l_partkey % 8 AS account, l_suppkey AS code, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS as_of, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL), snp AS (SELECT account, code, pos AS snap, quantity FROM sn JOIN cal ON cal.date = as_of),
ch AS (SELECT DISTINCT account, snap, 10000 + account * 100.0 AS cash FROM snp), px AS (SELECT code, pos, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos) AS px FROM dense),
fl AS (SELECT account, pos, CAST(sum(amount) AS DOUBLE) AS amount FROM (SELECT o_custkey % 8 AS account, CAST(o_totalprice / 1000 AS DECIMAL(18,6)) AS amount, (SELECT min(pos) FROM cal WHERE cal.date >= o_orderdate) AS pos FROM orders) WHERE pos IS NOT NULL GROUP BY ALL),
dy AS (SELECT f.account, cal.pos, cal.date FROM (SELECT account, min(snap) AS f FROM ch GROUP BY account) f JOIN cal ON cal.pos >= f), ds AS (SELECT dy.*, c.snap, c.cash AS c0 FROM dy ASOF JOIN ch c ON dy.account = c.account AND dy.pos >= c.snap),
dc2 AS (SELECT ds.*, coalesce(amount, 0) AS flow, c0 + sum(CASE WHEN ds.pos > snap THEN coalesce(amount, 0) ELSE 0 END) OVER (PARTITION BY ds.account, snap ORDER BY ds.pos) AS cash FROM ds LEFT JOIN fl ON fl.account = ds.account AND fl.pos = ds.pos),
hd AS (SELECT d.account, d.pos, s.code, s.quantity, px.px FROM ds d JOIN snp s ON s.account = d.account AND s.snap = d.snap LEFT JOIN px ON px.code = s.code AND px.pos = d.pos), vl AS (SELECT account, pos, sum(quantity * px) AS v, count(*) FILTER (WHERE px IS NULL) AS miss FROM hd GROUP BY ALL),
nv0 AS (SELECT d.account, d.pos, d.date, d.flow, cash + coalesce(v, 0) AS nav FROM dc2 d LEFT JOIN vl USING (account, pos) WHERE coalesce(miss, 0) = 0), nv1 AS (SELECT *, lag(nav) OVER (PARTITION BY account ORDER BY pos) AS prev_nav FROM nv0),
nv2 AS (SELECT *, coalesce((nav - flow) / prev_nav - 1, 0) AS ret FROM nv1), nv3 AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY account ORDER BY pos)) AS unit_nav FROM nv2)"""


def nav(s):
    sn = s.table("lineitem").groupBy((F.col("l_partkey") % 8).alias("account"), F.col("l_suppkey").alias("code"), F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("date")).agg(F.sum("l_quantity").alias("quantity"))
    sn = materialize(with_pos(sn, s.cal).select("account", "code", F.col("pos").alias("as_of_pos"), "quantity"))
    cash = sn.select("account", "as_of_pos").distinct().withColumn("cash", 10000 + F.col("account") * 100.0)
    from tidepanel.operators.grid import next_trading_day

    fl = s.table("orders").select((F.col("o_custkey") % 8).alias("account"), (F.col("o_totalprice") / 1000).cast("decimal(18,6)").alias("amount"), F.col("o_orderdate").cast("date").alias("d"))
    fl = next_trading_day(fl, s.cal, "d", "_e", "pos", inclusive=True).groupBy("account", "pos").agg(F.sum("amount").cast("double").alias("amount"))
    px = materialize(s.dense.select("code", "pos", R.ffill("close").alias("px")))
    bench = M.benchmark_returns(s.bars.groupBy("date").agg(F.avg("close").alias("px")), s.cal).join(F.broadcast(s.cal), "date").select("pos", "bret")
    n, h = B.nav_history(sn, cash, px, fl, s.cal, bench)
    return materialize(n), h, px


@query("book_nav", "A40 D14", dense(NAVS + " SELECT account, pos, round(nav, 2) AS nav, round(ret, 6) AS ret, round(unit_nav, 6) AS unit_nav, round(unit_nav / greatest(max(unit_nav) OVER (PARTITION BY account ORDER BY pos), 1) - 1, 6) AS drawdown FROM nv3"))
def _(s):
    n, _, _ = nav(s)
    return n.select("account", "pos", r("nav", 2).alias("nav"), r("ret").alias("ret"), r("unit_nav").alias("unit_nav"), r("drawdown").alias("drawdown"))


@query("position_contribution", "A41", dense(NAVS + """, cb AS (SELECT h.account, h.pos + 1 AS pos, h.code, h.quantity, h.px AS p0 FROM hd h), ct AS (SELECT c.account, c.code, c.pos, quantity * (p.px - p0) / n.prev_nav AS contribution FROM cb c JOIN (SELECT DISTINCT code, pos, px FROM hd) p ON p.code = c.code AND p.pos = c.pos JOIN nv1 n ON n.account = c.account AND n.pos = c.pos)
SELECT account, grp, round(sum(contribution), 6) AS contribution FROM ct JOIN suppliers USING (code) GROUP BY ALL"""))
def _(s):
    n, h, _ = nav(s)
    c = B.contributions(materialize(h), n).join(s.suppliers, "code")
    return c.groupBy("account", "grp").agg(r(F.sum("contribution")).alias("contribution"))


SECT = """, w0 AS (SELECT code, grp, circ_mv / sum(circ_mv) OVER () AS weight FROM dense WHERE pos = 40 AND circ_mv IS NOT NULL), a AS (SELECT code, close AS px FROM dense WHERE pos = 40), b AS (SELECT code, close AS px FROM dense WHERE pos = 52),
se AS (SELECT grp, sum(weight) AS wb, CASE WHEN sum(CASE WHEN b.px / a.px IS NOT NULL THEN weight END) >= 0.99::DOUBLE * sum(weight) THEN sum(weight * (b.px / a.px - 1)) / sum(CASE WHEN b.px / a.px IS NOT NULL THEN weight END) END AS rb FROM w0 LEFT JOIN a USING (code) LEFT JOIN b USING (code) GROUP BY grp)"""


def sectors(s):
    d = materialize(s.dense.where("pos in (40, 52)").select("pos", "code", "grp", "circ_mv", F.col("close").alias("px")))
    w = d.where("pos = 40 and circ_mv is not null").withColumn("_one", F.lit(1))
    w = with_stats(w, "_one", {"_t": F.sum("circ_mv")}).select("code", "grp", div("circ_mv", "_t").alias("weight"))
    return B.sector_returns(w, d.where("pos = 40").select("code", "px"), d.where("pos = 52").select("code", "px"), "grp")


@query("sector_returns", "A43", dense(SECT + " SELECT grp, round(wb, 6) AS wb, round(rb, 6) AS rb FROM se"))
def _(s):
    return sectors(s).select("grp", r("wb").alias("wb"), r("rb").alias("rb"))


@query("allocation_selection", "A42", dense(SECT + """, pt AS (SELECT o_custkey % 5 AS account, o_orderkey % 20 AS grp, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY ALL), pw AS (SELECT account, grp, v / sum(v) OVER (PARTITION BY account) AS wp, v / sum(v) OVER (PARTITION BY account) * ((grp % 7) - 3) / 50 AS contribution FROM pt),
j AS (SELECT coalesce(p.account, x.account) AS account, coalesce(p.grp, x.grp) AS grp, coalesce(wp, 0) AS wp, coalesce(wb, 0) AS wb, coalesce(contribution, 0) AS contribution, rb FROM pw p FULL JOIN (SELECT account, se.* FROM se, (SELECT DISTINCT account FROM pw)) x ON p.account = x.account AND p.grp = x.grp)
SELECT account, grp, round(wp, 6) AS wp, round(wb, 6) AS wb, round((wp - wb) * rb, 8) AS allocation, round(CASE WHEN wp <> 0 THEN wp * (contribution / wp - rb) END, 8) AS selection FROM j"""))
def _(s):
    p = s.table("orders").groupBy((F.col("o_custkey") % 5).alias("account"), (F.col("o_orderkey") % 20).cast("int").alias("grp")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    p = with_stats(p, "account", {"_t": F.sum("v")}).select("account", "grp", div("v", "_t").alias("wp"), (div("v", "_t") * (F.col("grp") % 7 - 3) / 50).alias("contribution"))
    d = B.allocation_selection(materialize(p), sectors(s), "grp")
    return d.select("account", "grp", r("wp").alias("wp"), r("wb").alias("wb"), r("allocation", 8).alias("allocation"), r("selection", 8).alias("selection"))


HP = """hp AS (SELECT o_custkey % 200 AS account, o_orderkey % 15 AS code, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) * 0.13876543219::DOUBLE AS value FROM orders GROUP BY ALL),
hq AS (SELECT *, CASE WHEN code % 5 = 4 THEN 'unknown' ELSE 'I' || (code % 3) END AS industry, CASE WHEN code % 4 = 0 THEN 0.08::DOUBLE END AS cap, CASE WHEN code % 2 = 0 THEN 0.12::DOUBLE END AS target, CASE WHEN code % 6 = 5 THEN 'etf' ELSE 'stock' END AS kind, 0.5::DOUBLE + code / 10.0::DOUBLE AS beta, 30000.0::DOUBLE AS cash FROM hp)"""


def held(s):
    d = s.table("orders").groupBy((F.col("o_custkey") % 200).alias("account"), (F.col("o_orderkey") % 15).alias("code")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") * 0.13876543219).alias("value"))
    c = F.col("code")
    return d.select("*", F.when(c % 5 == 4, "unknown").otherwise(F.concat(F.lit("I"), (c % 3).cast("string"))).alias("industry"), F.when(c % 4 == 0, 0.08).alias("cap"), F.when(c % 2 == 0, 0.12).alias("target"),
                    F.when(c % 6 == 5, "etf").otherwise("stock").alias("kind"), (0.5 + c / 10.0).alias("beta"), F.lit(30000.0).alias("cash"))


@query("limit_check", "A44", f"""WITH {HP}, a AS (SELECT *, sum(value) OVER (PARTITION BY account) + cash AS total FROM hq), b AS (SELECT *, value / total AS weight FROM a), c AS (SELECT *, sum(weight) OVER (PARTITION BY account, industry) AS sec, least(0.1::DOUBLE, coalesce(cap, 0.1::DOUBLE)) AS lim FROM b),
d AS (SELECT *, greatest(weight - lim, 0, CASE WHEN industry <> 'unknown' AND sec > 0.3::DOUBLE THEN weight * (sec - 0.3::DOUBLE) / sec ELSE 0 END) AS x, weight > 0.1::DOUBLE OR coalesce(weight > cap, FALSE) OR (industry <> 'unknown' AND sec > 0.3::DOUBLE) AS why FROM c), e AS (SELECT *, x > 0.02::DOUBLE OR (x > 0 AND why) AS trim FROM d),
f AS (SELECT *, CASE WHEN NOT trim AND target - weight >= 0.02::DOUBLE THEN greatest(0, least(target - weight, lim - weight, CASE WHEN industry <> 'unknown' THEN 0.3::DOUBLE - sec ELSE lim - weight END)) * total ELSE 0 END AS req FROM e), g AS (SELECT *, sum(req) OVER (PARTITION BY account ORDER BY code) AS cum FROM f)
SELECT account, code, CASE WHEN trim THEN 'trim' WHEN least(cum, cash) - least(cum - req, cash) > 0 THEN 'add' ELSE 'hold' END AS action, round(CASE WHEN trim THEN x * total ELSE 0 END, 2) AS trim_value, round(least(cum, cash) - least(cum - req, cash), 2) AS add_value FROM g""")
def _(s):
    d = B.limit_check(held(s), 0.1, 0.3, 0.02)
    return d.select("account", "code", "action", r("trim_value", 2).alias("trim_value"), r("add_value", 2).alias("add_value"))


@query("book_checkup", "A45", f"WITH {HP}, w AS (SELECT *, value / sum(value) OVER (PARTITION BY account) AS w, row_number() OVER (PARTITION BY account ORDER BY value DESC, code) AS p FROM hq) SELECT account, count(*) AS names, round(sum(w * w), 6) AS hhi, round(sum(w) FILTER (WHERE p <= 5), 6) AS top_n, round(sum(CASE WHEN kind = 'stock' THEN w ELSE 0 END), 6) AS stock, round(max(w), 6) AS largest FROM w GROUP BY account")
def _(s):
    d = B.checkup(held(s), 5)
    return d.select("account", "names", *[r(c).alias(c) for c in ("hhi", "top_n", "stock", "largest")])


@query("range_position", "A45", dense("""
, w AS (SELECT code, date, pos, close, min(low) OVER v AS lo, max(high) OVER v AS hi FROM dense WINDOW v AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT code, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) END, 6) AS position FROM w"""))
def _(s):
    d = s.dense.withColumns({"lo": F.min("low").over(R.trailing(12)), "hi": F.max("high").over(R.trailing(12))})
    return d.select("code", day("date").alias("date"), r(B.range_position(F.col("lo"), F.col("hi"), F.col("close"))).alias("position"))


@query("holding_betas", "A46", dense("""
, m AS (SELECT pos, avg(ret_1d) AS mret FROM dense GROUP BY pos) SELECT code, round(CASE WHEN count(*) >= 20 THEN covar_samp(ret_1d, mret) / nullif(var_samp(mret), 0) END, 6) AS beta FROM dense JOIN m USING (pos) WHERE ret_1d IS NOT NULL AND mret IS NOT NULL GROUP BY code"""))
def _(s):
    d = materialize(s.dense.select("code", "pos", F.col("ret_1d").alias("ret")))
    return B.betas(d, d.groupBy("pos").agg(F.avg("ret").alias("mret")), 20).select("code", r("beta").alias("beta"))


@query("holding_correlations", "A46", dense("""
, mb AS (SELECT DISTINCT l_orderkey AS account, l_suppkey AS code FROM lineitem), pr AS (SELECT a.account, a.code AS a, b.code AS b FROM mb a JOIN mb b ON a.account = b.account AND a.code < b.code),
c AS (SELECT a, b, CASE WHEN count(*) >= 20 THEN corr(x.ret_1d, y.ret_1d) END AS c FROM (SELECT DISTINCT a, b FROM pr) JOIN dense x ON x.code = a JOIN dense y ON y.code = b AND y.pos = x.pos WHERE x.ret_1d IS NOT NULL AND y.ret_1d IS NOT NULL GROUP BY a, b)
SELECT account, round(avg(c), 6) AS mean_corr, round(max(c), 6) AS max_corr, count(c) AS pairs FROM pr JOIN c USING (a, b) GROUP BY account"""))
def _(s):
    mb = s.table("lineitem").select(F.col("l_orderkey").alias("account"), F.col("l_suppkey").alias("code"))
    return B.pair_correlation(mb, s.dense.select("code", "pos", F.col("ret_1d").alias("ret")), 20).select("account", r("mean_corr").alias("mean_corr"), r("max_corr").alias("max_corr"), "pairs")


@query("linear_stress", "A47", f"WITH {HP}, w AS (SELECT *, value / sum(value) OVER (PARTITION BY account) AS w FROM hq), i AS (SELECT account, max(iw) AS m FROM (SELECT account, industry, sum(w) AS iw FROM w GROUP BY ALL) GROUP BY account) SELECT account, round(-0.1::DOUBLE * sum(w * beta), 6) AS market_down_10, round(-0.3::DOUBLE * max(w), 6) AS largest_down_30, round(-0.2::DOUBLE * max(m), 6) AS industry_down_20 FROM w JOIN i USING (account) GROUP BY account")
def _(s):
    return B.stress(held(s)).select("account", *[r(c).alias(c) for c in ("market_down_10", "largest_down_30", "industry_down_20")])


@query("convertible_flags", "A48 J19", """WITH b AS (SELECT p_partkey AS bond, p_partkey % (SELECT count(*) FROM supplier) AS stock, CASE WHEN p_partkey % 4 = 0 THEN p_size * 2.0 END AS premium, p_retailprice / 10 AS price, p_retailprice / 15 AS equity_value, p_size / 5.0 AS remaining, (p_partkey % 30) / 10.0 AS term, CASE p_partkey % 4 WHEN 0 THEN 'AAA' WHEN 1 THEN 'aa' WHEN 2 THEN 'A+' END AS rating, 4000.0 + p_size AS redeem FROM part),
j AS (SELECT b.* EXCLUDE (premium), s_acctbal AS stock_price, coalesce(premium, 100 * (price / equity_value - 1)) AS prem FROM b LEFT JOIN supplier ON s_suppkey = stock)
SELECT bond, round(prem, 6) AS premium, concat_ws(',', CASE WHEN prem > 50 THEN 'high_conversion_premium' END, CASE WHEN remaining < 3 THEN 'small_remaining_size' END, CASE WHEN term < 1 THEN 'short_maturity' END, CASE WHEN upper(rating) NOT IN ('AAA', 'AA+', 'AA', 'AA-') THEN 'low_rating' END) AS flags, round(100 * (stock_price / redeem - 1), 4) AS redeem_distance FROM j""")
def _(s):
    k, z = F.col("p_partkey"), F.col("p_size")
    n = s.table("supplier").agg(F.count("*").alias("_n"))
    rating = F.when(k % 4 == 0, "AAA").when(k % 4 == 1, "aa").when(k % 4 == 2, "A+")
    b = s.table("part").join(F.broadcast(n)).select(k.alias("bond"), (k % F.col("_n")).alias("stock"), F.when(k % 4 == 0, z * 2.0).alias("premium"), (F.col("p_retailprice") / 10).alias("price"), (F.col("p_retailprice") / 15).alias("equity_value"),
                              (z / 5.0).alias("remaining"), (k % 30 / 10.0).alias("term"), rating.alias("rating"), (4000.0 + z).alias("redeem"))
    q = s.table("supplier").select(F.col("s_suppkey").alias("stock"), F.col("s_acctbal").alias("stock_price"))
    d = B.convertible_flags(b.join(q, "stock", "left"))
    return d.select("bond", r("premium").alias("premium"), F.concat_ws(",", "flags").alias("flags"), r("redeem_distance", 4).alias("redeem_distance"))


@query("style_summary", "A49", f"WITH {HP}, w AS (SELECT *, value / sum(value) OVER (PARTITION BY account) AS w, CASE WHEN code % 3 <> 1 THEN ln(value) END AS size FROM hq) SELECT account, 'size' AS style, round(sum(w * size) / nullif(sum(CASE WHEN size IS NOT NULL THEN w ELSE 0 END), 0), 6) AS value, round(sum(CASE WHEN size IS NOT NULL THEN w ELSE 0 END), 6) AS covered FROM w GROUP BY account UNION ALL SELECT account, 'beta', round(sum(w * beta) / sum(w), 6), round(sum(w), 6) FROM w GROUP BY account")
def _(s):
    d = held(s).withColumn("size", F.when(F.col("code") % 3 != 1, F.ln("value")))
    return B.style_summary(d, ["size", "beta"]).select("account", "style", r("value").alias("value"), r("covered").alias("covered"))


@query("holding_industry_link", "J18", """WITH h AS (SELECT l_suppkey AS code, make_date(year(l_shipdate), 6, 1) AS eff, 'I' || (l_suppkey + year(l_shipdate)) % 6 AS l1 FROM lineitem WHERE l_suppkey % 7 <> 3 GROUP BY ALL), a AS (SELECT code, arg_max(l1, eff) AS l1 FROM h WHERE eff <= DATE '1999-03-01' GROUP BY code)
SELECT s_suppkey AS code, coalesce(a.l1, CASE WHEN s_suppkey % 2 = 1 THEN 'S' || s_nationkey END, 'unknown') AS industry, CASE WHEN s_suppkey % 5 = 0 THEN 'T' || (s_suppkey % 3) ELSE 'core' END AS thesis FROM supplier LEFT JOIN a ON a.code = s_suppkey""")
def _(s):
    h = s.table("lineitem").where("l_suppkey % 7 <> 3").select(F.col("l_suppkey").alias("code"), F.make_date(F.year("l_shipdate"), F.lit(6), F.lit(1)).alias("eff"), F.concat(F.lit("I"), ((F.col("l_suppkey") + F.year("l_shipdate")) % 6).cast("string")).alias("l1"))
    a = h.where(F.col("eff") <= F.lit("1999-03-01").cast("date")).groupBy("code").agg(F.max_by("l1", "eff").alias("l1"))
    sup = s.table("supplier").select(F.col("s_suppkey").alias("code"), "s_nationkey")
    snap = F.when(F.col("code") % 2 == 1, F.concat(F.lit("S"), F.col("s_nationkey").cast("string")))
    links = sup.where("code % 5 = 0").select("code", F.concat(F.lit("T"), (F.col("code") % 3).cast("string")).alias("thesis"))
    d = sup.join(a, "code", "left").join(links, "code", "left")
    return d.select("code", F.coalesce("l1", snap, F.lit("unknown")).alias("industry"), F.coalesce("thesis", F.lit("core")).alias("thesis"))


OUT = "o AS (SELECT o_custkey AS account, year(o_orderdate) AS cohort, strftime(o_orderdate, '%Y-%m') AS month, 0.4::DOUBLE + o_totalprice / 400000 AS wealth, 0.4::DOUBLE + ((o_orderkey * 37) % 1000) / 1000.0::DOUBLE AS hold, ((o_orderkey * 13) % 100) / 200.0::DOUBLE AS max_drawdown FROM orders)"


def outcomes(s):
    k = F.col("o_orderkey")
    return s.table("orders").select(F.year("o_orderdate").alias("cohort"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), (0.4 + F.col("o_totalprice") / 400000).alias("wealth"), (0.4 + k * 37 % 1000 / 1000.0).alias("hold"), (k * 13 % 100 / 200.0).alias("max_drawdown"))


@query("outcome_summary", "A36", f"WITH {OUT} SELECT cohort, count(*) AS accounts, round(pow(avg(pow(greatest(wealth, 1e-6), -3)), -1.0 / 3), 6) AS ce, round(avg(wealth), 6) AS mean_wealth, round(avg((wealth < 0.7::DOUBLE)::INT), 6) AS p_loss_30, round(avg((max_drawdown > 0.3::DOUBLE)::INT), 6) AS p_mdd_30, round(avg(wealth - hold), 6) AS decision_value, round(avg((wealth > hold)::INT), 6) AS share_positive FROM o GROUP BY cohort")
def _(s):
    d = B.outcome_summary(outcomes(s), ["cohort"], 4)
    return d.select(F.col("cohort").cast("long").alias("cohort"), "accounts", *[r(c).alias(c) for c in ("ce", "mean_wealth", "p_loss_30", "p_mdd_30", "decision_value", "share_positive")])


@query("outcome_clustered_t", "A36", f"WITH {OUT}, m AS (SELECT month, avg(wealth - hold) AS m, count(*) AS n FROM o GROUP BY month) SELECT (SELECT count(*) FROM o) AS n, (SELECT round(avg(wealth - hold), 6) FROM o) AS mean, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 6) AS t FROM m")
def _(s):
    d = B.clustered_t(outcomes(s).withColumn("v", F.col("wealth") - F.col("hold")), "v", "month")
    return d.select("n", r("mean").alias("mean"), r("t").alias("t"))


@query("positions_exploded", "D15 D14", "SELECT l_orderkey AS account, l_suppkey AS code, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY ALL")
def _(s):
    li = s.table("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    snap = li.groupBy(F.col("l_orderkey").alias("account")).agg(F.collect_list(F.struct(F.col("l_suppkey").alias("code"), F.col("q").alias("quantity"))).alias("positions"))
    return snap.select("account", F.explode("positions").alias("p")).select("account", "p.code", "p.quantity")

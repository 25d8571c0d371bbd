"""As-of, bitemporal and calendar joins."""

from pyspark.sql import functions as F

from tidepanel.catalog import ctes as T
from tidepanel.catalog.registry import lines, query
from tidepanel.functions.columns import day, r
from tidepanel.operators import joins as J
from tidepanel.operators.grid import next_trading_day
from tidepanel.plans import pit
from tidepanel.sources import lookalikes as L

D = "strftime(date, '%Y-%m-%d') AS date"


@query("asof_join", "J1 IO1", lines(T.MARKS + f"""
SELECT p.code, strftime(p.date, '%Y-%m-%d') AS date, m.q::DOUBLE AS q, strftime(m.pub_date, '%Y-%m-%d') AS seen FROM panel p ASOF LEFT JOIN marks m ON p.code = m.code AND p.date >= m.pub_date"""))
def _(s):
    right = L.marks(s).withColumn("seen", F.col("pub_date"))
    d = J.asof_join(s.bars.select("code", "date"), right, fields=["q", "seen"], right_on="pub_date")
    return d.select("code", day("date").alias("date"), F.col("q").cast("double").alias("q"), day("seen").alias("seen"))


@query("asof_many_left", "J1", """WITH o AS (SELECT o_orderkey, o_custkey AS code, CAST(o_orderdate AS DATE) AS date FROM orders),
m AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS d, CAST(max(o_totalprice) AS DOUBLE) AS top FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT o.o_orderkey, m.top FROM o ASOF LEFT JOIN m ON o.code = m.code AND o.date > m.d""")
def _(s):
    o = s.table("orders").select("o_orderkey", F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("date"),
                                 "o_totalprice", "o_orderpriority")
    m = o.where("o_orderpriority = '1-URGENT'").groupBy("code", "date").agg(F.max("o_totalprice").alias("top"))
    d = J.asof_join(o.select("o_orderkey", "code", "date"), m, fields=["top"], unique_left=False, allow_equal=False)
    return d.select("o_orderkey", "top")


EVENTS = T.MARKS + """, ev AS (SELECT m.code, m.q, m.pub_date, (SELECT min(date) FROM cal WHERE cal.date > m.pub_date) AS date FROM marks m),
ev1 AS (SELECT ev.code, ev.date, cal.pos AS event_pos, arg_max(q, pub_date) AS q FROM ev JOIN cal ON ev.date = cal.date GROUP BY ALL)"""


@query("asof_carry_limit", "J2 J5 W28 P11", lines(EVENTS + """
, j AS (SELECT p.code, p.date, p.pos, e.q, p.pos - e.event_pos AS age FROM panel p ASOF LEFT JOIN ev1 e ON p.code = e.code AND p.date >= e.date)
SELECT code, strftime(date, '%Y-%m-%d') AS date, CASE WHEN age <= 2 THEN q::DOUBLE END AS q, CASE WHEN age <= 2 THEN age::DOUBLE END AS age FROM j"""))
def _(s):
    d = pit.attach_events(s.panel.select("code", "date", "pos"), L.marks(s), s.cal, ["q"], 2, "age")
    return d.select("code", day("date").alias("date"), F.col("q").cast("double").alias("q"), F.col("age").cast("double").alias("age"))


@query("next_trading_day", "J5 P6", lines("""
, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, strftime(cal.date, '%Y-%m-%d') AS entry, cal.pos FROM (SELECT o_orderkey, (SELECT min(date) FROM cal WHERE cal.date > o.d) AS date FROM o) x JOIN cal USING (date)"""))
def _(s):
    o = s.table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return next_trading_day(o, s.cal, "d").select("o_orderkey", day("eff_date").alias("entry"), F.col("eff_pos").alias("pos"))


@query("asof_shift_tolerance", "J3 P15", "WITH " + T.MARGIN[2:] + """
, prior AS (SELECT code, date + 28 AS at, fin AS fin_4w FROM margin), j AS (SELECT m.*, CASE WHEN m.date - p.at <= 7 THEN p.fin_4w END AS f4 FROM margin m ASOF LEFT JOIN prior p ON m.code = p.code AND m.date >= p.at)
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN f4 > 0 THEN fin / f4 END - 1, 6) AS chg, round(CASE WHEN fin_buy + fin_refund > 0 THEN fin_buy / (fin_buy + fin_refund) END, 6) AS buy_share,
 round(CASE WHEN fin > 0 THEN sec / fin END, 6) AS short_share FROM j""")
def _(s):
    d = pit.margin_rows(L.margin(s))
    return d.select("code", day("pub_date").alias("date"), r("fin_chg_4w").alias("chg"), r("fin_buy_share").alias("buy_share"), r("short_to_fin").alias("short_share"))


@query("attach_margin", "P15 J2", lines(T.MARGIN + """
, prior AS (SELECT code, date + 28 AS at, fin AS fin_4w FROM margin), mr AS (SELECT m.code, m.date AS pub_date, m.fin, CASE WHEN m.date - p.at <= 7 AND p.fin_4w > 0 THEN m.fin / p.fin_4w - 1 END AS chg FROM margin m ASOF LEFT JOIN prior p ON m.code = p.code AND m.date >= p.at),
e AS (SELECT code, date, arg_max(struct_pack(fin := fin, chg := chg), pub_date) AS v FROM (SELECT *, (SELECT min(date) FROM cal WHERE cal.date > mr.pub_date) AS date FROM mr) WHERE date IS NOT NULL GROUP BY ALL),
e1 AS (SELECT e.*, cal.pos AS epos FROM e JOIN cal USING (date)),
j AS (SELECT p.code, p.date, p.circ_mv, p.pos - e.epos AS age, e.v FROM panel p ASOF LEFT JOIN e1 e ON p.code = e.code AND p.date >= e.date)
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN age <= 1 THEN v.chg END, 6) AS fin_chg_4w, round(CASE WHEN age <= 1 AND circ_mv > 0 THEN v.fin / circ_mv END, 6) AS fin_to_mv FROM j"""))
def _(s):
    d = pit.attach_margin(s.panel.select("code", "date", "pos", "circ_mv"), pit.margin_rows(L.margin(s)), s.cal, 1)
    return d.select("code", day("date").alias("date"), r("fin_chg_4w").alias("fin_chg_4w"), r("fin_to_mv").alias("fin_to_mv"))


@query("attach_industry", "J4 P9 W29", lines(T.INDUSTRY + """
, g AS (SELECT *, greatest(effective_date, updated_at) AS gate FROM industry_hist), a AS (SELECT *, (SELECT min(date) FROM cal WHERE cal.date > g.gate) AS date FROM g),
b AS (SELECT * FROM a WHERE date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY effective_date DESC, updated_at DESC) = 1),
c AS (SELECT * FROM b QUALIFY effective_date >= max(effective_date) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT p.code, strftime(p.date, '%Y-%m-%d') AS date, coalesce(c.l1, 'unknown') AS l1, coalesce(c.l2, 'unknown') AS l2 FROM panel p ASOF LEFT JOIN c ON p.code = c.code AND p.date >= c.date"""))
def _(s):
    d = pit.attach_industry(s.bars.select("code", "date"), L.industry_history(s), s.cal)
    return d.select("code", day("date").alias("date"), "l1", "l2")


@query("align_statements", "J6 A63 IO14", lines(", " + T.PUBLICATIONS + """
, f AS (SELECT * FROM publications QUALIFY row_number() OVER (PARTITION BY code, stat_date ORDER BY pub_date) = 1),
e AS (SELECT *, (SELECT min(date) FROM cal WHERE cal.date > f.pub_date) AS date FROM f), e1 AS (SELECT * FROM e WHERE date IS NOT NULL
 QUALIFY stat_date >= max(stat_date) OVER (PARTITION BY code ORDER BY date, stat_date ROWS UNBOUNDED PRECEDING)),
e2 AS (SELECT * FROM e1 QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY stat_date DESC) = 1)
SELECT code, strftime(date, '%Y-%m-%d') AS date, strftime(stat_date, '%Y-%m-%d') AS stat_date, round(value, 2) AS value FROM e2"""))
def _(s):
    d = pit.align_statements(L.publications(s), s.cal)
    return d.select("code", day("date").alias("date"), day("stat_date").alias("stat_date"), r("value", 2).alias("value"))


@query("adjust_prices", "J7 P1", lines(T.SPLITS + """
, j AS (SELECT p.code, p.date, p.close, coalesce(x.factor, (SELECT arg_min(factor, ex_date) FROM splits y WHERE y.code = p.code), 1.0) AS f FROM panel p ASOF LEFT JOIN splits x ON p.code = x.code AND p.date >= x.ex_date)
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(f, 6) AS adj_factor, round(close, 6) AS close_raw, round(close * f, 6) AS close FROM j"""))
def _(s):
    d = pit.adjust_prices(s.panel.select("code", "date", "close"), L.splits(s), ("close",))
    return d.select("code", day("date").alias("date"), *[r(c).alias(c) for c in ("adj_factor", "close_raw", "close")])


@query("membership_flags", "J8 F2 IO2", lines(T.MEMBERS + """
SELECT p.code, strftime(p.date, '%Y-%m-%d') AS date, (b.code IS NOT NULL)::INT AS in_big, (m.code IS NOT NULL)::INT AS in_mid, (p.date IN (SELECT snapshot_date FROM members))::INT AS has_snapshot,
 ((b.code IS NOT NULL OR m.code IS NOT NULL) AND p.pos >= 6 AND p.n_lines >= 2)::INT AS in_universe
FROM panel p LEFT JOIN members b ON b.code = p.code AND b.snapshot_date = p.date AND b.index = 'big' LEFT JOIN members m ON m.code = p.code AND m.snapshot_date = p.date AND m.index = 'mid'"""))
def _(s):
    d = pit.membership(s.panel.select("code", "date", "pos", "n_lines"), L.members(s))
    uni = ((F.col("in_big") + F.col("in_mid") > 0) & (F.col("pos") >= 6) & (F.col("n_lines") >= 2)).cast("int")
    return d.select("code", day("date").alias("date"), "in_big", "in_mid", "has_snapshot", uni.alias("in_universe"))


@query("flow_ratios", "J9 P14", lines(T.FLOWS + """
SELECT p.code, strftime(p.date, '%Y-%m-%d') AS date, round(f.main / nullif(p.amount, 0), 6) AS main, round(f.jumbo / nullif(p.amount, 0), 6) AS jumbo, round(f.block / nullif(p.amount, 0), 6) AS block,
 round(f.mid / nullif(p.amount, 0), 6) AS mid, round(f.small / nullif(p.amount, 0), 6) AS small FROM panel p LEFT JOIN flows f ON f.code = p.code AND f.date = p.date"""))
def _(s):
    d = s.bars.select("code", "date", "amount").join(L.flows(s), ["code", "date"], "left")
    return d.select("code", day("date").alias("date"), *[r(F.when(F.col("amount") > 0, F.col(c) / F.nullif("amount", F.lit(0.0)))).alias(c) for c in ("main", "jumbo", "block", "mid", "small")])


@query("statement_ratios", "J10 J11 P13 X13 U1", "WITH " + T.STATEMENTS + """
, m AS (SELECT code, stat_date, i.* EXCLUDE (code, stat_date), b.* EXCLUDE (code, stat_date, q), c.* EXCLUDE (code, stat_date), liab + total_equity AS assets FROM income i FULL JOIN balance b USING (code, stat_date) FULL JOIN cash c USING (code, stat_date)),
p AS (SELECT code, CAST(stat_date + INTERVAL 12 MONTH AS DATE) AS stat_date, assets AS p_assets, rev AS p_rev, profit AS p_profit, equity AS p_equity FROM m),
j AS (SELECT m.*, p.p_assets, p.p_rev, p.p_profit, p.p_equity, greatest(pub_income, pub_balance, pub_cash) AS pub_date FROM m LEFT JOIN p USING (code, stat_date))
SELECT code, strftime(stat_date, '%Y-%m-%d') AS stat_date, strftime(pub_date, '%Y-%m-%d') AS pub_date, round(CASE WHEN equity > 0 THEN profit / equity END, 6) AS roe, round(CASE WHEN assets > 0 THEN profit / assets END, 6) AS roa,
 round(CASE WHEN rev > 0 THEN gross / rev END, 6) AS gross_margin, round(CASE WHEN assets > 0 THEN ocf / assets END, 6) AS cfoa, round(CASE WHEN assets > 0 THEN (profit - ocf) / assets END, 6) AS accruals,
 round(CASE WHEN assets > 0 THEN liab / assets END, 6) AS debt_to_assets, round(CASE WHEN equity > 0 THEN loan / equity END, 6) AS debt_to_equity, round(CASE WHEN equity > 0 THEN coalesce(goodwill, 0) / equity END, 6) AS goodwill_to_equity,
 round(CASE WHEN assets > 0 THEN cash / assets END, 6) AS cash_to_assets, round(CASE WHEN p_assets > 0 THEN assets / p_assets END - 1, 6) AS asset_growth, round(CASE WHEN p_rev > 0 THEN rev / p_rev END - 1, 6) AS rev_growth, round(CASE WHEN p_equity > 0 THEN equity / p_equity END - 1, 6) AS equity_growth,
 round((profit - p_profit) / nullif(abs(p_profit), 0), 6) AS profit_growth, round(CASE WHEN assets > 0 THEN (profit - p_profit) / assets END, 6) AS surprise FROM j""")
def _(s):
    d = pit.statement_ratios(**L.statements(s))
    cols = [c for c in d.columns if c not in ("code", "stat_date", "pub_date")]
    return d.select("code", day("stat_date").alias("stat_date"), day("pub_date").alias("pub_date"), *[r(c).alias(c) for c in cols])


@query("label_map_default", "J12 D5", """SELECT s_suppkey AS code, coalesce(CASE WHEN n_nationkey % 4 <> 1 THEN n_name END, 'unknown') AS industry FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def _(s):
    names = s.table("nation").where("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    d = s.table("supplier").join(names, "s_nationkey", "left")
    return d.select(F.col("s_suppkey").alias("code"), F.coalesce("n_name", F.lit("unknown")).alias("industry"))


@query("source_precedence", "J13 J14 U2 A63", """
WITH a AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
b AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag = 'N' AND (year(l_shipdate) >= 1998 + l_suppkey % 4) GROUP BY ALL),
f AS (SELECT code, min(date) AS fd FROM b GROUP BY code), a1 AS (SELECT a.* FROM a LEFT JOIN f USING (code) WHERE fd IS NULL OR date < fd),
c AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, CAST(max(l_quantity) AS DOUBLE) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL),
u AS (SELECT *, 0 AS p FROM c UNION ALL SELECT *, 1 FROM a1 UNION ALL SELECT *, 2 FROM b)
SELECT code, strftime(date, '%Y-%m-%d') AS date, arg_max(v, p) AS v FROM u GROUP BY code, date""")
def _(s):
    li = s.table("lineitem").select(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("date"), "l_quantity", "l_returnflag", "l_linenumber")
    tot = lambda d: d.groupBy("code", "date").agg(F.sum("l_quantity").alias("v"))
    a = tot(li.where("l_returnflag = 'A'"))
    b = tot(li.where((F.col("l_returnflag") == "N") & (F.year("date") >= 1998 + F.col("code") % 4)))
    c = li.where("l_linenumber = 1").groupBy("code", "date").agg(F.max("l_quantity").alias("v"))
    d = J.union_prefer([c, J.source_before(a, b), b], ["code", "date"])
    return d.select("code", day("date").alias("date"), "v")


@query("source_reconcile", "J16", lines("""
, a AS (SELECT code, date, grp, volume, amount FROM panel WHERE code % 9 <> 2), b AS (SELECT code, date, volume + (code + pos) % 3 AS volume, amount * CASE WHEN pos % 4 = 0 THEN 1.5 ELSE 1 END AS amount FROM panel WHERE (code + pos) % 5 <> 0),
j AS (SELECT grp, 'volume' AS field, abs(a.volume - b.volume) AS gap FROM a JOIN b USING (code, date) UNION ALL SELECT grp, 'amount', abs(a.amount - b.amount) FROM a JOIN b USING (code, date))
SELECT grp, field, count(*) AS rows, count(*) FILTER (WHERE gap = 0) AS exact, round(max(gap), 4) AS max_gap FROM j GROUP BY ALL"""))
def _(s):
    p = s.panel
    a = p.where("code % 9 <> 2").select("code", "date", "grp", "volume", "amount")
    b = p.where("(code + pos) % 5 <> 0").select("code", "date", (F.col("volume") + (F.col("code") + F.col("pos")) % 3).alias("b_volume"),
                                             (F.col("amount") * F.when(F.col("pos") % 4 == 0, 1.5).otherwise(1.0)).alias("b_amount"))
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.abs(F.col(f) - F.col(f"b_{f}")).alias("gap")) for f in ("volume", "amount")]))
    j = a.join(b, ["code", "date"]).select("grp", fields.alias("x")).select("grp", "x.*")
    return j.groupBy("grp", "field").agg(F.count("*").alias("rows"), F.count(F.when(F.col("gap") == 0, 1)).alias("exact"), r(F.max("gap"), 4).alias("max_gap"))


REPORTS = """, reports AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS code, o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS publish_date,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'b' || (o_orderkey % 9) END AS broker, year(o_orderdate) + o_orderkey % 3 AS fiscal_year, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice / 100000 * 0.887654321987::DOUBLE END AS eps,
  CASE o_orderstatus WHEN 'F' THEN 5.0 WHEN 'O' THEN 3.0 END AS score, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 0 END AS revision FROM orders)"""


def reports(s):
    o, k = s.table("orders"), F.col("o_orderkey")
    n = s.table("supplier").agg(F.count("*").alias("_n"))
    o = o.join(F.broadcast(n))
    return o.select((F.col("o_custkey") % F.col("_n")).alias("code"), k.alias("report_id"), F.col("o_orderdate").cast("date").alias("publish_date"),
                    F.when(k % 23 != 0, F.concat(F.lit("b"), (k % 9).cast("string"))).alias("broker"), (F.year("o_orderdate") + k % 3).alias("fiscal_year"),
                    F.when(k % 7 != 0, F.col("o_totalprice") / 100000 * 0.887654321987).alias("eps"),
                    F.when(F.col("o_orderstatus") == "F", 5.0).when(F.col("o_orderstatus") == "O", 3.0).alias("score"),
                    F.when(k % 4 == 0, 1.0).when(k % 4 == 1, -1.0).when(k % 4 == 2, 0.0).alias("revision"))


@query("consensus_features", "P16 X14", lines(REPORTS + """
, j AS (SELECT p.code, p.date, r.* EXCLUDE (code), p.date - r.publish_date AS age FROM panel p JOIN reports r ON p.code = r.code AND r.publish_date < p.date AND r.publish_date >= p.date - 180 AND broker IS NOT NULL),
b AS (SELECT code, date, broker, max((age <= 90)::INT) AS in90, arg_max(eps, (publish_date, report_id)) FILTER (WHERE eps IS NOT NULL AND fiscal_year = year(date)) AS fy1, arg_max(eps, (publish_date, report_id)) FILTER (WHERE eps IS NOT NULL AND fiscal_year = year(date) + 1) AS fy2,
 arg_max(score, (publish_date, report_id)) FILTER (WHERE score IS NOT NULL) AS score, arg_max(revision, (publish_date, report_id)) FILTER (WHERE revision IS NOT NULL AND age <= 90) AS r90, arg_max(revision, (publish_date, report_id)) FILTER (WHERE revision IS NOT NULL AND age <= 30) AS r30 FROM j GROUP BY ALL),
c AS (SELECT code, date, sum(in90) AS coverage_90, count(*) AS coverage_180, quantile_cont(fy1, 0.5) AS f1, quantile_cont(fy2, 0.5) AS f2, avg(score) AS rating, avg(r30) AS r30, avg(r90) AS r90 FROM b GROUP BY ALL),
d AS (SELECT p.code, p.date, p.close, lag(p.close) OVER (PARTITION BY p.code ORDER BY p.date) AS prev_close, coalesce(coverage_90, 0) AS c90, coalesce(coverage_180, 0) AS c180, f1, f2, rating, r30, r90 FROM panel p LEFT JOIN c USING (code, date)),
e AS (SELECT d.*, x.f1 AS f1_30, x.rating AS rt_30 FROM d ASOF LEFT JOIN (SELECT code, date + 30 AS date, f1, rating FROM d) x ON d.code = x.code AND d.date >= x.date),
g AS (SELECT e.*, x.f1 AS f1_90, x.rating AS rt_90 FROM e ASOF LEFT JOIN (SELECT code, date + 90 AS date, f1, rating FROM d) x ON e.code = x.code AND e.date >= x.date)
SELECT code, strftime(date, '%Y-%m-%d') AS date, c90::BIGINT AS coverage_90, c180::BIGINT AS coverage_180, round(f1, 6) AS eps_fy1, round(f2, 6) AS eps_fy2, round(rating, 6) AS rating, round(r30, 6) AS revision_30, round(r90, 6) AS revision_90, round(f2 / nullif(f1, 0) - 1, 6) AS eps_growth,
 round(f1 / nullif(f1_30, 0) - 1, 6) AS eps_change_30, round(f1 / nullif(f1_90, 0) - 1, 6) AS eps_change_90, round(rating - rt_30, 6) AS rating_change_30, round(rating - rt_90, 6) AS rating_change_90,
 round(CASE WHEN prev_close > 0 THEN f1 / prev_close END, 8) AS consensus_ep FROM g"""))
def _(s):
    from tidepanel.operators.staging import materialize

    p = s.bars.select("code", "date", F.col("close").alias("close_raw"))
    d = pit.consensus_changes(materialize(pit.consensus(p, reports(s))))
    cols = ["eps_fy1", "eps_fy2", "rating", "revision_30", "revision_90", "eps_growth", "eps_change_30", "eps_change_90", "rating_change_30", "rating_change_90"]
    return d.select("code", day("date").alias("date"), F.col("coverage_90").cast("long").alias("coverage_90"), "coverage_180", *[r(c).alias(c) for c in cols], r("consensus_ep", 8).alias("consensus_ep"))

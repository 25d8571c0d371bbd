"""Element-wise functions."""

from pyspark.sql import functions as F

from tidepanel.catalog.registry import lines, query
from tidepanel.functions import columns as C
from tidepanel.functions.columns import day, r


@query("scalar_arithmetic", "X1 X2 X3 X4 X5 X6 X7 X8 X9 X10 X11 X12 X13 X14", lines("""
, d AS (SELECT code, date, close - 700 AS x, CASE WHEN code % 7 = 0 THEN 0 WHEN code % 11 = 3 THEN NULL ELSE open - 690 END AS y FROM panel)
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(abs(x), 6) AS abs_x,
  round(CASE WHEN x > 0 THEN ln(x) END, 6) AS log_x, round(CASE WHEN x >= 0 THEN sqrt(x) END, 6) AS sqrt_x, sign(x)::DOUBLE AS sign_x,
  round(sign(x) * pow(abs(x), 0.5), 6) AS spow_half, round(CASE WHEN x = 0 THEN NULL ELSE sign(x) * pow(abs(x), -1) END, 8) AS spow_inv,
  round(x + y, 6) AS add_xy, round(x - y, 6) AS sub_xy, round(x * y, 2) AS mul_xy, round(x / nullif(y, 0), 6) AS div_xy, round(-x, 6) AS neg_x,
  round(CASE WHEN y IS NOT NULL THEN greatest(x, y) END, 6) AS max_xy, round(CASE WHEN y IS NOT NULL THEN least(x, y) END, 6) AS min_xy,
  (x > y)::INT::DOUBLE AS gt_xy, (x < y)::INT::DOUBLE AS lt_xy, (x >= y)::INT::DOUBLE AS ge_xy, (x <= y)::INT::DOUBLE AS le_xy,
  round(coalesce(y, 7), 6) AS fill_y, round(CASE WHEN y IS NULL THEN NULL WHEN y > 0 THEN x ELSE -1 END, 6) AS where_y,
  round(CASE WHEN y > 0 THEN x / y END, 6) AS ratio_xy, round(CASE WHEN y > 0 THEN x / y END - 1, 6) AS growth_xy, round(x / nullif(y, 0) - 1, 6) AS change_xy
FROM d"""))
def _(s):
    y = F.when(F.col("code") % 7 == 0, F.lit(0.0)).when(F.col("code") % 11 != 3, F.col("open") - 690)
    d = s.panel.select("code", "date", (F.col("close") - 700).alias("x"), y.alias("y"))
    out = {
        "abs_x": C.abs_("x"), "log_x": C.log_("x"), "sqrt_x": C.sqrt_("x"), "spow_half": C.signed_power("x", 0.5),
        "add_xy": C.add("x", "y"), "sub_xy": C.sub("x", "y"), "div_xy": C.div("x", "y"), "neg_x": C.neg("x"),
        "max_xy": C.max2("x", "y"), "min_xy": C.min2("x", "y"), "fill_y": C.fill_na("y", 7),
        "where_y": C.where("y", "x", -1.0), "ratio_xy": C.ratio_pos("x", "y"), "growth_xy": C.growth("x", "y"),
        "change_xy": C.change("x", "y"),
    }
    exact = {"sign_x": C.sign("x"), "gt_xy": C.gt("x", "y"), "lt_xy": C.lt("x", "y"), "ge_xy": C.ge("x", "y"),
             "le_xy": C.le("x", "y")}
    return d.select("code", day("date").alias("date"), *[r(c).alias(k) for k, c in out.items()],
                    *[c.alias(k) for k, c in exact.items()], r(C.signed_power("x", -1), 8).alias("spow_inv"),
                    r(C.mul("x", "y"), 2).alias("mul_xy"))


@query("scalar_strings", "X15 IO7 P34", """
WITH d AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN lpad(((s_suppkey * 7919) % 1000000)::VARCHAR, 6, '0')
    WHEN 1 THEN 'SH' || lpad(((600000 + s_suppkey * 37) % 1000000)::VARCHAR, 6, '0') WHEN 2 THEN lpad(((s_suppkey * 1009) % 1000000)::VARCHAR, 6, '0') || '.SZ'
    WHEN 3 THEN 'sh.' || lpad(((510000 + s_suppkey * 13) % 1000000)::VARCHAR, 6, '0') ELSE 'CASH' END AS raw FROM supplier),
e AS (SELECT *, regexp_extract(lower(raw), '([0-9]{6})', 1) AS digits, regexp_extract(lower(raw), '(sh|sz|bj)', 1) AS mkt FROM d),
n AS (SELECT *, CASE WHEN upper(raw) = 'CASH' THEN 'CASH' WHEN digits = '' THEN NULL WHEN mkt <> '' THEN mkt || '.' || digits
   WHEN regexp_matches(digits, '^[569]') THEN 'sh.' || digits WHEN regexp_matches(digits, '^[48]') THEN 'bj.' || digits ELSE 'sz.' || digits END AS code FROM e)
SELECT k, raw, code, CASE WHEN code = 'CASH' THEN 'cash' WHEN regexp_matches(split_part(code, '.', 2), '^(11|12)') THEN 'convertible_bond'
  WHEN regexp_matches(split_part(code, '.', 2), '^(15|16|50|51|52|56|58)') THEN 'etf'
  WHEN regexp_matches(split_part(code, '.', 2), '^(0|3|60|68|4|8|9)') THEN 'stock' ELSE 'other' END AS kind,
  starts_with(raw, 'SH')::INT AS is_prefixed, regexp_replace(raw, '[^0-9]', '', 'g') AS only_digits FROM n""")
def _(s):
    from tidepanel.sources.codes import asset_class, normalize_code

    k = F.col("s_suppkey")
    six = lambda e: F.lpad((e % 1000000).cast("string"), 6, "0")
    raw = (F.when(k % 5 == 0, six(k * 7919)).when(k % 5 == 1, F.concat(F.lit("SH"), six(600000 + k * 37)))
           .when(k % 5 == 2, F.concat(six(k * 1009), F.lit(".SZ"))).when(k % 5 == 3, F.concat(F.lit("sh."), six(510000 + k * 13)))
           .otherwise(F.lit("CASH")))
    d = s.table("supplier").select(k.alias("k"), raw.alias("raw"))
    d = d.withColumn("code", normalize_code(F.col("raw")))
    return d.select("k", "raw", "code", asset_class(F.col("code")).alias("kind"),
                    F.col("raw").startswith("SH").cast("int").alias("is_prefixed"),
                    F.regexp_replace("raw", "[^0-9]", "").alias("only_digits"))


@query("scalar_dates", "X16", """
WITH d AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k, strftime(date_trunc('month', d), '%Y-%m-%d') AS month_start, year(d)::INT AS y, quarter(d)::INT AS q, weekofyear(d)::INT AS iso_week,
  strftime(d + 28, '%Y-%m-%d') AS plus_28, strftime(d - 90, '%Y-%m-%d') AS minus_90, strftime(d + INTERVAL 3 MONTH, '%Y-%m-%d') AS plus_3m,
  strftime(date_trunc('month', d)::DATE + ((12 - isodow(date_trunc('month', d)::DATE)) % 7)::INT + 14, '%Y-%m-%d') AS third_friday FROM d""")
def _(s):
    from tidepanel.functions.dates import third_friday

    d = F.col("o_orderdate").cast("date")
    f = lambda c: F.date_format(c, "yyyy-MM-dd")
    return s.table("orders").select(
        F.col("o_orderkey").alias("k"), f(F.trunc(d, "month")).alias("month_start"), F.year(d).alias("y"),
        F.quarter(d).alias("q"), F.weekofyear(d).alias("iso_week"), f(F.date_add(d, 28)).alias("plus_28"),
        f(F.date_sub(d, 90)).alias("minus_90"), f(F.add_months(d, 3)).alias("plus_3m"), f(third_friday(d)).alias("third_friday"))


@query("condition_check", "X18", """
WITH d AS (SELECT o_orderkey AS k, o_totalprice AS x, CASE o_orderkey % 5 WHEN 0 THEN '>' WHEN 1 THEN '>=' WHEN 2 THEN '<' WHEN 3 THEN '<=' ELSE 'between' END AS op,
   50000.0 + (o_orderkey * 13) % 200000 AS lo FROM orders)
SELECT k, op, (CASE op WHEN '>' THEN x > lo WHEN '>=' THEN x >= lo WHEN '<' THEN x < lo WHEN '<=' THEN x <= lo ELSE x BETWEEN lo AND lo + 90000 END)::INT AS hit FROM d""")
def _(s):
    k = F.col("o_orderkey")
    op = F.when(k % 5 == 0, ">").when(k % 5 == 1, ">=").when(k % 5 == 2, "<").when(k % 5 == 3, "<=").otherwise("between")
    lo = 50000.0 + k * 13 % 200000
    d = s.table("orders").select(k.alias("k"), op.alias("op"), F.col("o_totalprice").alias("x"), lo.alias("lo"))
    return d.select("k", "op", C.flag(C.compare(F.col("op"), F.col("x"), F.col("lo"), F.col("lo") + 90000)).alias("hit"))


@query("json_canonical", "X19 X20", """
WITH d AS (SELECT event_id, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS kk FROM events),
j AS (SELECT event_id, kk, '{"k":' || kk || ',"type":"' || event_type || '","user":' || user_id || '}' AS canon FROM d)
SELECT event_id, kk, canon, sha256(canon) AS digest FROM j""")
def _(s):
    from tidepanel.functions.records import canonical_json

    d = s.table("events").withColumn("_k", F.from_json("props", "k bigint")["k"])
    canon = canonical_json({"user": F.col("user_id"), "type": F.col("event_type"), "k": F.col("_k")})
    return d.select("event_id", F.col("_k").alias("kk"), canon.alias("canon"), F.sha2(canon, 256).alias("digest"))


@query("array_map_values", "X20", """
WITH d AS (SELECT user_id, event_type, year(ts) * 100 + month(ts) AS ym, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS v FROM events GROUP BY ALL)
SELECT user_id, len(list_distinct(list(event_type)))::INT AS n_types, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS types,
  round(CAST(sum(v) FILTER (WHERE event_type = 'click') AS DOUBLE), 4) AS clicks FROM d GROUP BY user_id""")
def _(s):
    d = s.table("events").groupBy("user_id", "event_type").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("v"))
    d = d.groupBy("user_id").agg(
        F.array_sort(F.array_distinct(F.collect_list("event_type"))).alias("t"),
        F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return d.select("user_id", F.size("t").alias("n_types"), F.concat_ws(",", "t").alias("types"), r(F.col("m")["click"], 4).alias("clicks"))


@query("scenario_values", "X23 X24 U6", """
WITH base AS (SELECT s_suppkey AS k, s_acctbal AS revenue, 0.05 + (s_suppkey % 10) / 100.0 AS margin, 8.0 + s_suppkey % 5 AS multiple FROM supplier),
sc AS (SELECT * FROM (VALUES ('base', 1.0, 1.0), ('bear', 0.8, 0.7), ('bull', 1.2, 1.3)) v(scenario, f_margin, f_multiple)),
v AS (SELECT k, scenario, greatest(revenue, 0) * (margin * f_margin) * (multiple * f_multiple) / 2 + abs(revenue) * 0.1 AS value FROM base CROSS JOIN sc)
SELECT k, scenario, round(value, 4) AS value, round(value - max(value) FILTER (WHERE scenario = 'base') OVER (PARTITION BY k), 4) AS impact FROM v""")
def _(s):
    from tidepanel.functions.formula import scenario_values

    k = F.col("s_suppkey")
    base = s.table("supplier").select(k.alias("k"), F.col("s_acctbal").alias("revenue"),
                                      (0.05 + (k % 10) / 100.0).alias("margin"), (8.0 + k % 5).alias("multiple"))
    scenarios = {"base": {}, "bear": {"margin": 0.8, "multiple": 0.7}, "bull": {"margin": 1.2, "multiple": 1.3}}
    v = scenario_values(base, "k", "max(revenue, 0) * margin * multiple / 2 + abs(revenue) * 0.1",
                        ["revenue", "margin", "multiple"], scenarios)
    return v.select("k", "scenario", r("value", 4).alias("value"), r("impact", 4).alias("impact"))

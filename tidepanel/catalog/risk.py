"""Style exposures, factor returns, covariances and tracking error."""

from pyspark.sql import functions as F

from tidepanel.catalog.registry import dense, query
from tidepanel.functions.columns import day, r
from tidepanel.operators import cross as X, rolling as R
from tidepanel.operators.staging import materialize
from tidepanel.plans import risk as K

ZED = lambda x, size=False: f"""
, q_{x} AS (SELECT date, quantile_cont({x}, 0.01) AS lo, quantile_cont({x}, 0.99) AS hi, quantile_cont({x}, 0.5) AS med, count({x}) AS g, count(*) AS n FROM raw WHERE in_universe GROUP BY date),
f_{x} AS (SELECT raw.code, raw.date, in_universe, {x} AS x, g, n, coalesce({'CASE WHEN ' + x + ' IS NOT NULL THEN least(greatest(' + x + ', lo), hi) END' if not size else x}, med) AS f FROM raw LEFT JOIN q_{x} USING (date)),
m_{x} AS (SELECT date, avg({'x' if size else 'f'}) AS m, stddev_pop({'x' if size else 'f'}) AS s FROM f_{x} WHERE in_universe GROUP BY date),
z_{x} AS (SELECT code, date, CASE WHEN g > 0 AND s > 0 {'AND x IS NOT NULL ' if size else ''}THEN (f - m) / s ELSE 0 END AS z, coalesce(g >= 8 AND g * 1.0 / n >= 0.8 AND s > 0, FALSE)::INT AS ok FROM f_{x} LEFT JOIN m_{x} USING (date))"""  # noqa: E731
RAW = """, raw AS (SELECT code, date, in_universe, ln(circ_mv) AS size, ln(lag(close, 1) OVER w / lag(close, 12) OVER w) AS momentum FROM dense WINDOW w AS (PARTITION BY code ORDER BY pos))"""


@query("standardize_on_universe", "X17 M8", dense(RAW + ZED("size", True) + ZED("momentum") + """
SELECT a.code, strftime(a.date, '%Y-%m-%d') AS date, round(a.z, 6) AS size_z, a.ok AS size_ok, round(b.z, 6) AS momentum_z, b.ok AS momentum_ok FROM z_size a JOIN z_momentum b USING (code, date)"""))
def _(s):
    d = s.dense.withColumns({"size": F.ln("circ_mv"), "_a": R.ts_delay("close", 1), "_b": R.ts_delay("close", 12)})
    d = d.withColumn("momentum", F.ln(F.col("_a") / F.nullif("_b", F.lit(0.0)))).select("code", "date", "in_universe", "size", "momentum")
    d = X.standardize_on(d, {"size_z": "size", "momentum_z": "momentum"}, F.col("in_universe"), ("size_z",), 8, 0.8)
    return d.select("code", day("date").alias("date"), r("size_z").alias("size_z"), F.col("size_z_available").alias("size_ok"), r("momentum_z").alias("momentum_z"), F.col("momentum_z_available").alias("momentum_ok"))


def styled(s):
    d = K.style_windows(s.stored).withColumn("ret_next", R.ts_lead("ret_1d", 1))
    keep = ["code", "date", "pos", "region", "in_universe", "circ_mv", "ret_1d", "ret_next", *K.STYLES]
    return materialize(K.style_exposures(d.select(*keep), min_names=8, min_cover=0.5))


ZS = [f"{x}_z" for x in K.STYLES]


@query("style_exposures", "M8")
def _(s):
    e = K.exposures_long(styled(s), ZS, "region")
    return e.select("code", day("date").alias("date"), "factor", r("exposure").alias("exposure"))


@query("factor_returns", "M9 UD4")
def _(s):
    f = K.factor_returns(styled(s), ZS, "region", "ret_next", 1e-4, 8)
    return f.select(day("date").alias("date"), "factor", r("value").alias("value"))


@query("factor_residuals", "M9")
def _(s):
    d = styled(s)
    f = materialize(K.factor_returns(d, ZS, "region", "ret_next", 1e-4, 8))
    out = K.residual_returns(d, f, ZS, "region", "ret_next")
    return out.where("residual is not null").select("code", day("date").alias("date"), r("residual").alias("residual"))


SIMPLE = """, fr AS (SELECT pos, 'r' || region AS factor, avg(ret_1d) AS value FROM dense WHERE ret_1d IS NOT NULL GROUP BY ALL), rs AS (SELECT code, pos, region, in_universe, ret_1d - avg(ret_1d) OVER (PARTITION BY pos, region) AS residual FROM dense)"""
COV = SIMPLE + """, fa AS (SELECT d.pos, f.factor, coalesce(fr.value, 0) AS v FROM (SELECT DISTINCT pos FROM fr) d CROSS JOIN (SELECT DISTINCT factor FROM fr) f LEFT JOIN fr USING (pos, factor)),
pp AS (SELECT a.pos, a.factor AS i, b.factor AS j, a.v AS vi, b.v AS vj, pow(2, a.pos / 12.0::DOUBLE) AS q FROM fa a JOIN fa b ON a.pos = b.pos AND a.factor <= b.factor),
ss AS (SELECT pos, i, j, sum(q) OVER w AS s, sum(q * q) OVER w AS s2, sum(q * vi) OVER w AS sa, sum(q * vj) OVER w AS sb, sum(q * vi * vj) OVER w AS sab, count(*) OVER w AS days FROM pp WINDOW w AS (PARTITION BY i, j ORDER BY pos RANGE BETWEEN 35 PRECEDING AND CURRENT ROW)),
cv AS (SELECT pos, i, j, days, (sab / s - sa / s * (sb / s)) / (1 - s2 / (s * s)) * CASE WHEN i = j THEN 1 ELSE 0.9::DOUBLE END + CASE WHEN i = j THEN 1e-12 ELSE 0 END AS cov FROM ss WHERE days >= 24)"""


def simple_returns(s):
    d = s.stored.where("ret_1d is not null")
    return d.groupBy("pos", F.concat(F.lit("r"), F.col("region").cast("string")).alias("factor")).agg(F.avg("ret_1d").alias("value"))


def simple_residuals(s):
    return X.cs_demean(s.stored, {"residual": "ret_1d"}, ("pos", "region")).select("code", "pos", "region", "in_universe", "residual", "date", "circ_mv", "n_lines")


@query("ew_covariance", "W36 M10", dense(COV + " SELECT pos, i, j, days, round(cov, 9) AS cov FROM cv"))
def _(s):
    return K.ew_covariance(simple_returns(s), s.cal, 12, 36, 24).select("pos", "i", "j", "days", r("cov", 9).alias("cov"))


SPEC = """, sq AS (SELECT *, CASE WHEN residual IS NOT NULL THEN pow(2, pos / 18.0::DOUBLE) END AS q FROM rs),
sw AS (SELECT code, pos, region, in_universe, sum(q) OVER w AS s, sum(q * q) OVER w AS s2, sum(q * residual) OVER w AS s1, sum(q * residual * residual) OVER w AS sxx, count(residual) OVER w AS k FROM sq WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)),
sr AS (SELECT code, pos, region, in_universe, CASE WHEN k >= 18 AND 1 - s2 / (s * s) > 0 THEN (sxx / s - (s1 / s) * (s1 / s)) / (1 - s2 / (s * s)) END AS raw FROM sw WHERE pos >= 36),
po AS (SELECT pos, quantile_cont(raw, 0.5) AS pool FROM sr WHERE in_universe AND raw IS NOT NULL GROUP BY pos), gr AS (SELECT pos, region, quantile_cont(raw, 0.5) AS g, count(*) AS n FROM sr WHERE in_universe AND raw IS NOT NULL GROUP BY ALL),
spec AS (SELECT sr.code, sr.pos, sr.region, greatest(CASE WHEN raw IS NULL THEN pr ELSE 0.5 * raw + 0.5 * pr END, 1e-8) AS d, (raw IS NULL)::INT AS is_prior FROM (SELECT sr.*, CASE WHEN n >= 5 THEN g ELSE pool END AS pr FROM sr JOIN po USING (pos) LEFT JOIN gr USING (pos, region)) sr)"""
AT = "pos >= 36"


def spec(s):
    return K.specific_variance(simple_residuals(s), 18, 36, 18, "region", 5, F.expr(AT))


@query("specific_variance", "M11", dense(SIMPLE + SPEC + " SELECT code, pos, round(d, 8) AS d, is_prior FROM spec"))
def _(s):
    return spec(s).select("code", "pos", r("d", 8).alias("d"), "is_prior")


WEIGHTS = """, wb AS (SELECT code, date, pos, region, close / sum(close) OVER (PARTITION BY date) AS w, circ_mv / sum(circ_mv) OVER (PARTITION BY date) AS b FROM dense WHERE in_universe)"""


def weights(s):
    d = s.stored.where("in_universe")
    d = X.with_stats(d, "date", {"_n": F.sum("close"), "_c": F.sum("circ_mv")})
    return d.select("code", "date", "pos", "region", (F.col("close") / F.nullif("_n", F.lit(0.0))).alias("w"), (F.col("circ_mv") / F.nullif("_c", F.lit(0.0))).alias("b"))


TE = COV + SPEC + WEIGHTS + """, ac AS (SELECT pos, code, region, w - b AS a FROM wb WHERE pos >= 36), xf AS (SELECT pos, 'r' || region AS factor, sum(a) AS x FROM ac GROUP BY ALL),
c2 AS (SELECT pos, i, j, cov FROM cv UNION ALL SELECT pos, j, i, cov FROM cv WHERE i <> j), fx AS (SELECT c2.pos, c2.i AS factor, sum(cov * x) AS fx FROM c2 JOIN xf ON xf.pos = c2.pos AND xf.factor = c2.j GROUP BY ALL),
eu AS (SELECT xf.pos, xf.factor, x * fx AS contribution FROM xf JOIN fx USING (pos, factor))"""


def te(s):
    a = materialize(weights(s).where(AT).select("pos", "code", "region", (F.col("w") - F.col("b")).alias("a")))
    e = a.select("pos", "code", F.concat(F.lit("r"), F.col("region").cast("string")).alias("factor"), F.lit(1.0).alias("exposure"))
    cov = materialize(K.ew_covariance(simple_returns(s), s.cal, 12, 36, 24).where(AT))
    return K.tracking_error(a.drop("region"), e, cov, spec(s), 12)


@query("tracking_error", "M12", dense(TE + """, fv AS (SELECT pos, sum(contribution) AS fv FROM eu GROUP BY pos), sv AS (SELECT ac.pos, sum(d * a * a) AS sv FROM ac JOIN spec USING (pos, code) GROUP BY ac.pos)
SELECT pos, round(fv, 9) AS factor_variance, round(sv, 9) AS specific_variance, round(sqrt(12 * greatest(fv + sv, 0)), 6) AS te FROM fv JOIN sv USING (pos)"""))
def _(s):
    return te(s)[0].select("pos", r("factor_variance", 9).alias("factor_variance"), r("specific_variance", 9).alias("specific_variance"), r("te").alias("te"))


@query("tracking_error_euler", "M12", dense(TE + " SELECT pos, factor, round(contribution, 10) AS contribution FROM eu"))
def _(s):
    return te(s)[1].select("pos", "factor", r("contribution", 10).alias("contribution"))


@query("exposure_report", "M13", dense(RAW + ZED("size", True) + WEIGHTS + """, ex AS (SELECT wb.date, 'size_z' AS factor, w, b, CASE WHEN wb.code % 10 = 3 THEN NULL ELSE z END AS x FROM wb JOIN z_size USING (code, date) UNION ALL SELECT date, 'region:' || region, w, b, 1 FROM wb)
SELECT strftime(date, '%Y-%m-%d') AS date, factor, round(sum(w * coalesce(x, 0)), 6) AS portfolio, round(sum(b * coalesce(x, 0)), 6) AS benchmark, round(sum((w - b) * coalesce(x, 0)), 6) AS active, round(sum(CASE WHEN x IS NULL THEN w ELSE 0 END), 6) AS missing_portfolio FROM ex GROUP BY ALL"""))
def _(s):
    d = s.dense.withColumn("size", F.ln("circ_mv")).select("code", "date", "in_universe", "size")
    z = X.standardize_on(d, {"size_z": "size"}, F.col("in_universe"), ("size_z",), 8, 0.8)
    z = z.select("date", "code", F.lit("size_z").alias("factor"), F.when(F.col("code") % 10 != 3, F.col("size_z")).alias("exposure"))
    w = materialize(weights(s))
    e = z.unionByName(w.select("date", "code", F.concat(F.lit("region:"), F.col("region").cast("string")).alias("factor"), F.lit(1.0).alias("exposure")))
    out = K.exposure_report(w, e)
    return out.select(day("date").alias("date"), "factor", *[r(c).alias(c) for c in ("portfolio", "benchmark", "active", "missing_portfolio")])


@query("pit_quality", "M14", dense(WEIGHTS + """, q AS (SELECT date, sum(CASE WHEN code % 10 = 3 THEN w ELSE 0 END) AS sw, sum(CASE WHEN code % 10 = 3 THEN b ELSE 0 END) AS sb, sum(CASE WHEN region = 4 THEN w ELSE 0 END) AS iw, sum(CASE WHEN region = 4 THEN b ELSE 0 END) AS ib FROM wb GROUP BY date)
SELECT strftime(date, '%Y-%m-%d') AS date, round(sw, 6) AS style_w, round(iw, 6) AS industry_w, CASE WHEN greatest(sw, sb, iw, ib) > 0.25::DOUBLE THEN 'provisional' ELSE 'valid' END AS quality FROM q"""))
def _(s):
    d = K.pit_quality(weights(s), {"style": F.col("code") % 10 == 3, "industry": F.col("region") == 4}, 0.25)
    return d.select(day("date").alias("date"), r("style_w").alias("style_w"), r("industry_w").alias("industry_w"), "quality")


@query("risk_bias", "A57", dense("""
, dl AS (SELECT date, pos, pos % 4 <> 1 AS no_execution, CASE WHEN pos % 9 = 0 THEN 'provisional' ELSE 'valid' END AS quality, 0.01::DOUBLE * (1 + pos % 3) AS daily_variance, avg(ret_1d) FILTER (WHERE code % 3 = 0) - avg(ret_1d) AS excess_next FROM dense GROUP BY date, pos),
pr AS (SELECT * FROM (VALUES ('all', 1995, 2001), ('early', 1995, 1997), ('late', 1998, 2001)) p(period, lo, hi)), g AS (SELECT period, dl.*, no_execution AND quality = 'valid' AND excess_next IS NOT NULL AS good FROM dl JOIN pr ON year(date) BETWEEN lo AND hi)
SELECT period, count(*) FILTER (WHERE good) AS pairs, count(*) FILTER (WHERE no_execution) AS eligible, round(stddev_samp(excess_next / sqrt(daily_variance)) FILTER (WHERE good), 6) AS bias, round(stddev_samp(excess_next) FILTER (WHERE good) * sqrt(12), 6) AS realised_te, round(sqrt(12 * avg(daily_variance) FILTER (WHERE good)), 6) AS exante_te, round(count(*) FILTER (WHERE good) * 1.0 / count(*) FILTER (WHERE no_execution), 6) AS coverage FROM g GROUP BY period"""))
def _(s):
    d = s.dense.groupBy("date", "pos").agg((F.avg(F.when(F.col("code") % 3 == 0, F.col("ret_1d"))) - F.avg("ret_1d")).alias("excess_next"))
    d = d.withColumns({"no_execution": F.col("pos") % 4 != 1, "quality": F.when(F.col("pos") % 9 == 0, "provisional").otherwise("valid"), "daily_variance": 0.01 * (1 + F.col("pos") % 3)})
    out = K.validate_bias(d, {"all": (1995, 2001), "early": (1995, 1997), "late": (1998, 2001)}, 12)
    return out.select("period", "pairs", "eligible", *[r(c).alias(c) for c in ("bias", "realised_te", "exante_te", "coverage")])

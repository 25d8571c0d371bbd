"""Trial records, multiple testing and forward verdicts."""

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from tidepanel.catalog.evaluation import PAIRS, PICK, library_corr, seed_frame
from tidepanel.catalog.registry import labelled, query
from tidepanel.functions import normal as N
from tidepanel.functions.columns import day, r
from tidepanel.operators.staging import materialize
from tidepanel.plans import factors as FA, inference as I, metrics as M
from tidepanel.sources.trials import trials

TRIALS = """trials AS (SELECT o_orderkey AS trial, o_orderkey % 6 AS campaign, o_custkey AS candidate, CASE WHEN (o_orderkey * 7 + o_custkey) % 10 < 4 THEN 0 WHEN (o_orderkey * 7 + o_custkey) % 10 < 7 THEN 1 WHEN (o_orderkey * 7 + o_custkey) % 10 < 9 THEN 2 ELSE 3 END AS level,
 CASE WHEN o_orderkey % 17 <> 0 THEN (o_totalprice % 1000) / 1000 * 0.87654321::DOUBLE - 0.3::DOUBLE END AS icir, o_orderpriority AS domain, o_orderstatus AS form, 20 + o_orderkey % 400 AS days FROM orders)"""


def p_values(s):
    d = trials(s)
    return d.select("campaign", "trial", F.when(F.col("trial") % 11 != 0, F.abs("icir") / 2).alias("p"))


HURDLE = "CASE WHEN n_trials >= 2 AND variance > 0 THEN sqrt(variance) * ({g1} * z1 + {g} * z2) ELSE 0 END".format(g=I.EULER_GAMMA, g1=1 - I.EULER_GAMMA)
DISCOUNT = f"""WITH {TRIALS}, sd AS (SELECT campaign, count(*) AS n_trials, coalesce(var_samp(icir), 0) AS variance, avg(icir) AS m, avg(icir * icir) AS m2, avg(icir * icir * icir) AS m3, avg(icir * icir * icir * icir) AS m4 FROM trials WHERE icir IS NOT NULL GROUP BY campaign),
sq AS (SELECT *, 1 - 1.0::DOUBLE / greatest(n_trials, 2) AS q1, 1 - 1.0::DOUBLE / (greatest(n_trials, 2) * {math.e}::DOUBLE) AS q2, m2 - m * m AS v FROM sd),
sz AS (SELECT *, {N.sql_ppf('q1')} AS z1, {N.sql_ppf('q2')} AS z2, (m3 - 3 * m * m2 + 2 * m * m * m) / (v * sqrt(v)) AS skew, (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / (v * v) AS kurt FROM sq),
sh AS (SELECT *, {HURDLE} AS hurdle FROM sz)"""


@query("deflated_ratio", "A20 A25 UD5", DISCOUNT + f""", d AS (SELECT trial, n_trials, variance, hurdle, icir, days / greatest(CASE trial % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 20 ELSE 0 END, 1)::DOUBLE AS days, 1 - skew * icir + (kurt - 1) / 4 * icir * icir AS den FROM trials JOIN sh USING (campaign) WHERE icir IS NOT NULL),
z AS (SELECT *, CASE WHEN days > 1 AND den > 0 THEN (icir - hurdle) * sqrt(days - 1) / sqrt(den) END AS z FROM d), p AS (SELECT *, coalesce({N.sql_cdf('z')}, 0) AS dsr FROM z)
SELECT trial, n_trials, round(variance, 6) AS variance, round(hurdle, 6) AS hurdle, round(dsr, 6) AS dsr, round(1 - dsr, 6) AS p_value FROM p""")
def _(s):
    """Shape of the campaign's own ratios; observations are the trial's valid days over its horizon."""
    t = trials(s).where("icir is not null")
    x = F.col("icir")
    m = {f"_m{k}": F.avg(F.pow(x, F.lit(float(k)))) for k in range(1, 5)}
    shape = t.groupBy("campaign").agg(*[e.alias(k) for k, e in m.items()])
    a, b, c, e = (F.col(f"_m{k}") for k in range(1, 5))
    v = F.nullif(b - a * a, F.lit(0.0))
    shape = shape.select("campaign", ((c - 3 * a * b + 2 * a * a * a) / (v * F.sqrt(v))).alias("skew"), ((e - 4 * a * c + 6 * a * a * b - 3 * a * a * a * a) / (v * v)).alias("kurt"))
    d = t.join(F.broadcast(I.search_discount(t, ["campaign"]).join(shape, "campaign")), "campaign")
    k = F.col("trial") % 4
    horizon = F.when(k == 0, 1).when(k == 1, 5).when(k == 2, 20).otherwise(0)
    d = d.withColumn("dsr", I.deflated_probability(x, F.col("hurdle"), I.effective_observations(F.col("days"), horizon), F.col("skew"), F.col("kurt")))
    return d.select("trial", "n_trials", r("variance").alias("variance"), r("hurdle").alias("hurdle"), r("dsr").alias("dsr"), r(1 - F.col("dsr")).alias("p_value"))


@query("search_discount_counts", "A25 A20", f"WITH {TRIALS} SELECT campaign, count(*) AS n_trials, round(var_samp(icir), 6) AS variance FROM trials GROUP BY campaign")
def _(s):
    return I.search_discount(trials(s), ["campaign"]).select("campaign", "n_trials", r("variance").alias("variance"))


@query("benjamini_hochberg", "A21", f"""WITH {TRIALS}, p AS (SELECT campaign, trial, coalesce(CASE WHEN trial % 11 <> 0 THEN abs(icir) / 2 END, 1.0) AS p FROM trials),
k AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY p, trial) AS rank, count(*) OVER (PARTITION BY campaign) AS m FROM p), t AS (SELECT *, 0.1::DOUBLE * rank / m AS threshold FROM k)
SELECT campaign, trial, rank, round(threshold, 8) AS threshold, coalesce(rank <= max(rank) FILTER (WHERE p <= threshold) OVER (PARTITION BY campaign), FALSE)::INT AS passed FROM t""")
def _(s):
    d = I.benjamini_hochberg(p_values(s), ["campaign"], "p", "trial", 0.1)
    return d.select("campaign", "trial", "rank", r("threshold", 8).alias("threshold"), F.col("passed").cast("int").alias("passed"))


@query("holm_adjust", "A22", f"""WITH {TRIALS}, p AS (SELECT campaign, trial, abs(icir) / 2 / 1000 AS p FROM trials WHERE icir IS NOT NULL), k AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY campaign) AS m FROM p WINDOW w AS (PARTITION BY campaign ORDER BY p, trial))
SELECT campaign, trial, round(least(max((m - i + 1) * p) OVER (PARTITION BY campaign ORDER BY i), 1.0), 8) AS adjusted FROM k""")
def _(s):
    d = p_values(s).join(trials(s).select("trial", "icir"), "trial").where("icir is not null").select("campaign", "trial", (F.abs("icir") / 2 / 1000).alias("p"))
    return I.holm(d, ["campaign"], "p", "trial").select("campaign", "trial", r("adjusted", 8).alias("adjusted"))


HALF = NormalDist().inv_cdf(0.975)
HAC = labelled("""
, sr AS (SELECT grp AS series, pos AS ordinal, avg(ret_1d) AS value FROM labelled WHERE (pos + grp) % 9 <> 4 GROUP BY ALL HAVING avg(ret_1d) IS NOT NULL), b AS (SELECT series, count(*) AS n, avg(value) AS mean, greatest(1, ceil(4 * pow(count(*) / 100.0::DOUBLE, 2.0::DOUBLE / 9)))::INT AS lag FROM sr GROUP BY series),
e AS (SELECT series, ordinal, value - mean AS e, lag, n FROM sr JOIN b USING (series)), j AS (SELECT a.series, a.ordinal - c.ordinal AS k, a.e * c.e AS ee, a.lag FROM e a JOIN e c ON a.series = c.series AND a.ordinal - c.ordinal BETWEEN 0 AND a.lag),
l AS (SELECT series, sum(CASE WHEN k = 0 THEN ee ELSE 2 * (1 - k * 1.0::DOUBLE / (lag + 1)) * ee END) AS lr FROM j GROUP BY series)
SELECT series, n, lag, round(mean, 6) AS mean, round(sqrt(greatest(lr / n, 0) / n), 6) AS se FROM b JOIN l USING (series)""")


def _series(s):
    d = s.dense.where("(pos + grp) % 9 <> 4").groupBy(F.col("grp").alias("series"), F.col("pos").alias("ordinal")).agg(F.avg("ret_1d").alias("value"))
    return d


@query("hac_mean", "A23", HAC)
def _(s):
    return I.hac_mean(_series(s), ["series"], 2).select("series", "n", "lag", r("mean").alias("mean"), r("se").alias("se"))


@query("hac_p_values", "A23 UD5", HAC.replace("SELECT series, n, lag, round(mean, 6) AS mean, round(sqrt(greatest(lr / n, 0) / n), 6) AS se FROM b JOIN l USING (series)", f""", x AS (SELECT series, n, mean, sqrt(greatest(lr / n, 0) / n) AS se FROM b JOIN l USING (series)), y AS (SELECT *, -mean / nullif(se, 0) AS z FROM x WHERE n >= 2)
SELECT series, round(CASE WHEN se = 0 THEN CASE WHEN mean > 0 THEN 0.0 WHEN mean < 0 THEN 1.0 ELSE 0.5 END ELSE {N.sql_cdf('z')} END, 6) AS p_one_sided, round(mean - {HALF}::DOUBLE * se, 6) AS ci_low, round(mean + {HALF}::DOUBLE * se, 6) AS ci_high FROM y"""))
def _(s):
    return I.hac_mean(_series(s), ["series"], 2).select("series", *[r(c).alias(c) for c in ("p_one_sided", "ci_low", "ci_high")])


@query("search_intensity", "A24", f"""WITH {TRIALS} SELECT campaign, trial, row_number() OVER w AS n, round(max(icir) OVER w, 8) AS best FROM trials WINDOW w AS (PARTITION BY campaign ORDER BY trial ROWS UNBOUNDED PRECEDING)""")
def _(s):
    return I.intensity_curve(trials(s), ["campaign"], "trial", "trial").select("campaign", "trial", "n", r("best", 8).alias("best"))


@query("trial_funnel", "A26", f"""WITH {TRIALS}, b AS (SELECT campaign, candidate, max(level) AS level FROM trials GROUP BY ALL) SELECT campaign, count(*) AS "L0", count(*) FILTER (WHERE level >= 1) AS "L1", count(*) FILTER (WHERE level >= 2) AS "L2", count(*) FILTER (WHERE level >= 3) AS "L3" FROM b GROUP BY campaign""")
def _(s):
    return I.trial_funnel(trials(s))


@query("trial_failure_reasons", "A26 A27 D12", f"""WITH {TRIALS} SELECT campaign, 'coverage' AS reason, count(*) AS trials FROM trials WHERE trial % 3 = 0 GROUP BY campaign UNION ALL SELECT campaign, 'icir', count(*) FROM trials WHERE trial % 5 = 0 GROUP BY campaign""")
def _(s):
    return I.failure_reasons(trials(s), "checks array<struct<name:string,passed:boolean>>")


@query("ledger_statistics", "A27", f"WITH {TRIALS} SELECT campaign, form AS outcome, count(*) AS trials, count(DISTINCT candidate) AS candidates FROM trials GROUP BY ALL")
def _(s):
    return trials(s).groupBy("campaign", F.col("form").alias("outcome")).agg(F.count("*").alias("trials"), F.count_distinct("candidate").alias("candidates"))


@query("cell_memory", "A28", f"WITH {TRIALS} SELECT domain, form, count(*) AS trials, count(*) FILTER (WHERE level >= 1) AS passes, (count(*) >= 5 AND count(*) FILTER (WHERE level >= 1) = 0)::INT AS dead FROM trials GROUP BY ALL")
def _(s):
    return I.cell_memory(trials(s))


@query("trailing_streak", "A29", f"""WITH {TRIALS}, l AS (SELECT candidate, max(trial) FILTER (WHERE level >= 2) AS last FROM trials GROUP BY candidate) SELECT candidate, count(*) FILTER (WHERE last IS NULL OR trial > last) AS streak, count(*) AS used FROM trials JOIN l USING (candidate) GROUP BY candidate""")
def _(s):
    return I.trailing_streak(trials(s), "candidate", "trial", F.col("level") >= 2)


FORECASTS = "f AS (SELECT doc_id, quality AS y, toxic AS thesis, ((doc_id * 7919) % 1000) / 1000.0::DOUBLE AS p FROM labels)"


def forecasts(s):
    return s.table("labels").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("thesis"), (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("p"))


@query("brier_score", "A30 D20", f"WITH {FORECASTS} SELECT thesis, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier FROM f GROUP BY thesis")
def _(s):
    d = I.brier(forecasts(s), "p", "y", ["thesis"])
    return d.select("thesis", "n", r("brier").alias("brier"))


@query("calibration_bins", "A30", f"WITH {FORECASTS}, g AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS hr FROM f GROUP BY ALL) SELECT b.range::INT AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(hr, 6) AS hit_rate FROM range(10) b LEFT JOIN g ON g.bin = b.range")
def _(s):
    return I.calibration_bins(forecasts(s), "p", "y").select("bin", "n", r("mean_p").alias("mean_p"), r("hit_rate").alias("hit_rate"))


@query("trial_pairing", "A51", """WITH rec AS (SELECT l_orderkey AS trial, l_linenumber AS seq, CASE WHEN l_linenumber = 1 OR (l_linenumber = 2 AND l_orderkey % 13 = 0) THEN 'started' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'completed' ELSE 'void' END AS kind FROM lineitem),
gone AS (SELECT DISTINCT trial, seq - 1 AS seq FROM rec WHERE kind = 'void'), g AS (SELECT trial, count(*) FILTER (WHERE kind = 'started') AS starts,
 count(*) FILTER (WHERE kind IN ('completed', 'failed') AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.trial = rec.trial AND gone.seq = rec.seq)) AS results FROM rec GROUP BY trial HAVING count(*) FILTER (WHERE kind <> 'void') > 0)
SELECT trial, starts, results, CASE WHEN starts <> 1 THEN 'bad_start' WHEN results > 1 THEN 'many_results' WHEN results = 0 THEN 'open' ELSE 'ok' END AS state FROM g""")
def _(s):
    """Lines of an order as records of a trial: the first starts it, returned and accepted ones are results, the others void the line before."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    kind = F.when((n == 1) | ((n == 2) & (F.col("l_orderkey") % 13 == 0)), "started").when(flag == "R", "failed").when(flag == "A", "completed").otherwise("void")
    d = s.table("lineitem").select(F.col("l_orderkey").alias("trial"), n.alias("seq"), kind.alias("kind"), F.when(kind == "void", n - 1).alias("voids"))
    return I.record_pairing(d).select("trial", "starts", "results", "state")


@query("hash_chain_check", "A51 X19", f"""WITH {TRIALS} SELECT candidate, row_number() OVER (PARTITION BY candidate ORDER BY trial)::INT AS seq, (trial % 97 <> 5)::INT AS link_ok, (trial % 89 <> 7 AND trial % 97 <> 5)::INT AS hash_ok FROM trials""")
def _(s):
    """Chained with two planted faults: a broken link and a changed payload."""
    from tidepanel.sources.chains import chained

    return I.chain_check(chained(trials(s)), ["candidate", "segment"], "seq", ["trial", "level"]).drop("segment")


@query("shortlist", "A61", f"""WITH {TRIALS}, p AS (SELECT campaign, trial, icir, abs(icir) / 200 AS p FROM trials WHERE icir IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY p, trial) AS rank, count(*) OVER (PARTITION BY campaign) AS m FROM p),
b AS (SELECT *, coalesce(rank <= max(rank) FILTER (WHERE p <= 0.1::DOUBLE * rank / m) OVER (PARTITION BY campaign), FALSE) AS ok FROM k), c AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY icir DESC, trial) AS place FROM b WHERE ok AND p <= 0.0005::DOUBLE)
SELECT campaign, trial, place FROM c WHERE place <= 10""")
def _(s):
    from tidepanel.operators.ordering import position

    d = trials(s).where("icir is not null").withColumn("pv", F.abs("icir") / 200)
    d = I.benjamini_hochberg(d, ["campaign"], "pv", "trial", 0.1).where(F.col("passed") & (F.col("p") <= 0.0005))
    return position(d, ["campaign"], [-F.col("icir"), "trial"], keys=("trial",)).where("place <= 10").select("campaign", "trial", "place")


@query("forward_verdict", "A62", f"""WITH {TRIALS}, v AS (SELECT trial, CASE WHEN trial % 2 = 0 THEN 'factor' ELSE 'strategy' END AS kind, CASE WHEN trial % 13 = 0 THEN 'diagnostic_shadow' ELSE 'validation' END AS mode, days AS n, days + trial % 30 AS eligible, 60 AS required, icir AS mean, icir + 0.2::DOUBLE AS ci_high, abs(icir) / 2 AS p, trial % 3 <> 0 AS bh, trial % 29 = 0 AS violation, trial % 7 <> 0 AS endpoint,
 icir AS marginal, -0.01::DOUBLE * (trial % 10) AS dd, 0.035::DOUBLE + (trial % 30) / 1000.0::DOUBLE AS te FROM trials),
w AS (SELECT *, (n < required) OR (n * 1.0::DOUBLE / eligible < 0.95::DOUBLE) OR p IS NULL OR violation AS why, coalesce(violation OR (kind = 'strategy' AND (dd < -0.08::DOUBLE OR te NOT BETWEEN 0.04::DOUBLE AND 0.06::DOUBLE)), FALSE) AS hard FROM v)
SELECT trial, CASE WHEN NOT endpoint THEN 'observing' WHEN mode = 'diagnostic_shadow' THEN 'shadow_complete' WHEN hard OR coalesce(ci_high < 0, FALSE) THEN 'fresh_failed' WHEN why THEN 'fresh_inconclusive' WHEN coalesce(mean > 0 AND p <= 0.05::DOUBLE AND bh AND (kind = 'strategy' OR marginal > 0), FALSE) THEN 'fresh_supported' ELSE 'fresh_inconclusive' END AS verdict FROM w""")
def _(s):
    k = F.col("trial")
    d = trials(s).select(
        "trial", F.when(k % 2 == 0, "factor").otherwise("strategy").alias("kind"), F.when(k % 13 == 0, "diagnostic_shadow").otherwise("validation").alias("mode"),
        F.col("days").alias("n"), (F.col("days") + k % 30).alias("eligible"), F.lit(60).alias("required"), F.col("icir").alias("mean"), (F.col("icir") + 0.2).alias("ci_high"),
        (F.abs("icir") / 2).alias("p_one_sided"), (k % 3 != 0).alias("bh_pass"), (k % 29 == 0).alias("violation"), (k % 7 != 0).alias("endpoint"), F.col("icir").alias("marginal_ic"),
        (-0.01 * (k % 10)).alias("drawdown"), (0.035 + k % 30 / 1000.0).alias("tracking_error"))
    return I.verdict(d).select("trial", "verdict")


CORR_SQL = PAIRS + """, c0 AS (SELECT a, b, coalesce(avg(ic), 0) AS corr FROM ic GROUP BY a, b), c AS (SELECT a, b, corr FROM c0 UNION ALL SELECT b, a, corr FROM c0)"""
SCREEN = f"""
, cv AS (SELECT factor, avg(c * 1.0 / n) AS cov FROM (SELECT factor, date, count(*) AS n, count(value) AS c FROM (""" + " UNION ALL ".join(f"SELECT date, '{k}' AS factor, {k} AS value FROM seeds WHERE in_universe" for k in PICK) + f""") GROUP BY ALL) GROUP BY factor),
o AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, '{k}')" for i, k in enumerate(PICK[1:]))}) t(i, name)),
rec AS (SELECT 0 AS i, ['{PICK[0]}'] AS kept, NULL::VARCHAR AS factor, NULL::DOUBLE AS cov, NULL::VARCHAR AS max_with, NULL::DOUBLE AS top, NULL::VARCHAR AS decision
 UNION ALL SELECT i, CASE WHEN cov >= 0.6::DOUBLE AND top <= 0.7::DOUBLE THEN list_append(kept, name) ELSE kept END, name, cov, max_with, top, CASE WHEN cov < 0.6::DOUBLE THEN 'drop_coverage' WHEN top > 0.7::DOUBLE THEN 'drop_correlation' ELSE 'keep' END
 FROM (SELECT o.i, o.name, r.kept, cv.cov, max(abs(c.corr)) AS top, arg_max(c.b, abs(c.corr)) AS max_with FROM rec r JOIN o ON o.i = r.i + 1 JOIN cv ON cv.factor = o.name JOIN c ON c.a = o.name AND list_contains(r.kept, c.b) GROUP BY ALL))
SELECT factor, round(cov, 6) AS coverage, max_with, round(top, 6) AS max_abs_corr, decision FROM rec WHERE i > 0"""


@query("candidate_screen", "A19", labelled(CORR_SQL + SCREEN).replace("WITH ", "WITH RECURSIVE ", 1))
def _(s):
    d = materialize(seed_frame(s).where("in_universe"))
    corr, cov = library_corr(d), M.wide_coverage(d, PICK)
    d = I.greedy_keep(corr, cov, PICK[1:], PICK[:1], 0.6, 0.7)
    return d.select("factor", r("coverage").alias("coverage"), "max_with", r("max_abs_corr").alias("max_abs_corr"), "decision")


@query("trials_by_day", "A27 T4", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, count(*) AS trials FROM orders GROUP BY ALL ORDER BY trials DESC, date LIMIT 25""")
def _(s):
    return s.table("orders").groupBy(day("o_orderdate").alias("date")).agg(F.count("*").alias("trials")).orderBy(F.desc("trials"), "date").limit(25)


@query("elite_half", "T5", f"WITH {TRIALS}, k AS (SELECT campaign, trial, row_number() OVER (PARTITION BY campaign ORDER BY icir DESC, trial) AS place, count(*) OVER (PARTITION BY campaign) AS n FROM trials WHERE icir IS NOT NULL) SELECT campaign, trial, place FROM k WHERE place <= greatest(n // 2, 1)")
def _(s):
    """Best half of the scored candidates of each campaign."""
    from tidepanel.operators.ordering import position

    d = trials(s).where("icir is not null").select("campaign", "trial", "icir")
    d = position(d, ["campaign"], [-F.col("icir"), "trial"], "place", "_n", keys=("trial",))
    return d.where(F.col("place") <= F.greatest(F.floor(F.col("_n") / 2), F.lit(1))).select("campaign", "trial", "place")

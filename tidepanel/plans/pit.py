"""Point-in-time attachment of events, statements, labels and margin rows to a panel."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.columns import change, div, ratio_pos
from tidepanel.operators.grid import next_trading_day
from tidepanel.operators.joins import asof_join, carry, keep_one, running_period


def align_events(rows: DataFrame, cal: DataFrame, order=("pub_date",)) -> DataFrame:
    """Usable on the first trading day strictly after publication; the latest publication of a day wins."""
    d = next_trading_day(rows, cal, "pub_date", "date", "event_pos")
    return keep_one(d, ["code", "date"], list(order))


def attach_events(panel: DataFrame, rows: DataFrame, cal: DataFrame, fields, limit: int, age: str | None = None) -> DataFrame:
    """Carry the latest event for at most ``limit`` trading days."""
    right = align_events(rows, cal)
    d = asof_join(panel, right, fields=[*fields, "event_pos"])
    return carry(d, fields, F.col("pos") - F.col("event_pos"), limit, age).drop("event_pos")


def align_statements(rows: DataFrame, cal: DataFrame) -> DataFrame:
    """First publication per period, usable the next trading day, never stepping back to an older period."""
    d = rows.where(F.col("pub_date").isNotNull() & F.col("stat_date").isNotNull())
    d = keep_one(d, ["code", "stat_date"], ["pub_date"], last=False)
    d = next_trading_day(d, cal, "pub_date", "date", "eff_pos")
    d = running_period(d, "code", ["date", "stat_date"], "stat_date")
    return keep_one(d, ["code", "date"], ["stat_date"])


def attach_industry(panel: DataFrame, history: DataFrame, cal: DataFrame, levels=("l1", "l2")) -> DataFrame:
    """Label known after both its effective date and its last update.

    A late update of an older effective record does not undo a newer label.
    """
    h = history.withColumn("_gate", F.greatest("effective_date", "updated_at"))
    h = next_trading_day(h, cal, "_gate", "date", "_p").drop("_gate", "_p")
    h = keep_one(h, ["code", "date"], ["effective_date", "updated_at"])
    h = running_period(h, "code", ["date", "effective_date"], "effective_date")
    d = asof_join(panel, h, fields=list(levels))
    return d.withColumns({f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("unknown")) for f in levels})


def adjust_prices(panel: DataFrame, factors: DataFrame, prices=("open", "high", "low", "close")) -> DataFrame:
    """Last factor on or before the day; before the first factor, the first one.  Raw prices are kept."""
    first = keep_one(factors, ["code"], ["ex_date"], last=False).select("code", F.col("factor").alias("_first"))
    d = asof_join(panel, factors, fields=["factor"], right_on="ex_date").join(first, "code", "left")
    d = d.withColumn("adj_factor", F.coalesce("factor", "_first", F.lit(1.0)))
    d = d.withColumns({f"{p}_raw": F.col(p) for p in prices})
    return d.withColumns({p: F.col(p) * F.col("adj_factor") for p in prices}).drop("factor", "_first")


def membership(panel: DataFrame, members: DataFrame, indexes=("big", "mid")) -> DataFrame:
    """Index flags of the month's snapshot; two small key joins with the optimiser's own size check."""
    flags = members.groupBy(F.col("snapshot_date").alias("_m"), "code").agg(
        *[F.max((F.col("index") == i).cast("int")).alias(f"in_{i}") for i in indexes])
    months = members.select(F.col("snapshot_date").alias("_m"), F.lit(1).alias("has_snapshot")).distinct()
    d = panel.withColumn("_m", F.trunc("date", "month"))
    d = d.join(flags, ["_m", "code"], "left").join(F.broadcast(months), "_m", "left")
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in [*(f"in_{i}" for i in indexes), "has_snapshot"]}).drop("_m")


def margin_rows(m: DataFrame) -> DataFrame:
    """Balance change over four weeks (at most 7 days stale), buying share, short share."""
    prior = m.select("code", F.date_add("date", 28).alias("date"), F.col("fin").alias("fin_4w"), F.date_add("date", 28).alias("_at"))
    d = asof_join(m, prior, fields=["fin_4w", "_at"])
    d = d.withColumn("fin_4w", F.when(F.datediff("date", "_at") <= 7, F.col("fin_4w")))
    return d.select(
        "code", F.col("date").alias("pub_date"), "fin", (ratio_pos("fin", "fin_4w") - 1).alias("fin_chg_4w"),
        ratio_pos("fin_buy", F.col("fin_buy") + F.col("fin_refund")).alias("fin_buy_share"),
        ratio_pos("sec", "fin").alias("short_to_fin"))


def attach_margin(panel: DataFrame, rows: DataFrame, cal: DataFrame, limit: int = 10) -> DataFrame:
    f = ["fin", "fin_chg_4w", "fin_buy_share", "short_to_fin"]
    d = attach_events(panel, rows, cal, f, limit)
    return d.withColumn("fin_to_mv", ratio_pos("fin", "circ_mv"))


def statement_ratios(income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """One row per (code, period) of any statement: publication date and ratios with positive denominators."""
    k = ["code", "stat_date"]
    d = income.join(balance, k, "full").join(cash, k, "full")
    d = d.withColumn("assets", F.col("liab") + F.col("total_equity"))
    d = d.withColumn("pub_date", F.greatest("pub_income", "pub_balance", "pub_cash"))
    prev = d.select("code", F.add_months("stat_date", 12).alias("stat_date"), F.col("assets").alias("p_assets"),
                    F.col("rev").alias("p_rev"), F.col("profit").alias("p_profit"), F.col("equity").alias("p_equity"))
    d = d.join(prev, k, "left")
    c = F.col
    return d.select(
        *k, "pub_date", ratio_pos("profit", "equity").alias("roe"), ratio_pos("profit", "assets").alias("roa"),
        ratio_pos("gross", "rev").alias("gross_margin"), ratio_pos("ocf", "assets").alias("cfoa"),
        ratio_pos(c("profit") - c("ocf"), "assets").alias("accruals"), ratio_pos("liab", "assets").alias("debt_to_assets"),
        ratio_pos("loan", "equity").alias("debt_to_equity"), ratio_pos(F.coalesce("goodwill", F.lit(0.0)), "equity").alias("goodwill_to_equity"),
        ratio_pos("cash", "assets").alias("cash_to_assets"), (ratio_pos("assets", "p_assets") - 1).alias("asset_growth"),
        (ratio_pos("rev", "p_rev") - 1).alias("rev_growth"), (ratio_pos("equity", "p_equity") - 1).alias("equity_growth"), div(c("profit") - c("p_profit"), F.abs("p_profit")).alias("profit_growth"),
        ratio_pos(c("profit") - c("p_profit"), "assets").alias("surprise"))


def intraday_features(bars: DataFrame, per_day: int, edge: int, least: float = 0.8) -> DataFrame:
    """Daily features of one-day bars: realised vol, tail volume share, opening return, up-volume share.

    Windows run inside one (code, day): at most one trading day of bars.
    """
    w = W.partitionBy("code", "date").orderBy("bar")
    whole = W.partitionBy("code", "date")
    b = bars.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(whole),
                          "_prev": F.lag("close").over(w), "_open": F.first("open").over(w)})
    r = F.coalesce(div("close", "_prev") - 1, div(F.first("close").over(w), "_open") - 1)
    b = b.withColumn("_r", r)
    c = F.col
    total = F.nullif(F.sum("volume"), F.lit(0.0))
    first_edge = F.max(F.when(c("_i") == F.least(F.lit(edge), c("_n")), c("close")))
    g = b.groupBy("code", "date").agg(
        F.sqrt(F.sum(c("_r") * c("_r"))).alias("rv"),
        (F.sum(F.when(c("_i") > c("_n") - edge, c("volume")).otherwise(0.0)) / total).alias("tail_share"),
        F.when(F.max("_open") > 0, first_edge / F.nullif(F.max("_open"), F.lit(0.0)) - 1).alias("open_ret"),
        (F.sum(F.when(c("_r") > 0, c("volume")).otherwise(0.0)) / total).alias("up_share"), F.count("*").alias("bars"))
    return g.where(F.col("bars") >= int(least * per_day))


def forecast_rows(fc: DataFrame, positive, negative) -> DataFrame:
    """Mid of the guided change and the sign of the guidance type."""
    t = F.col("kind")
    sgn = F.when(t.isin(*positive), 1.0).when(t.isin(*negative), -1.0).otherwise(0.0)
    return fc.where(F.col("pub_date").isNotNull()).select(
        "code", "pub_date", ((F.col("chg_up") + F.col("chg_down")) / 2).alias("fc_mid"), sgn.alias("fc_sign"))


STATE = ("coverage_90", "coverage_180", "eps_fy1", "eps_fy2", "rating", "revision_30", "revision_90")
SWEEP_ROWS = 200_000  # spans swept in one task


def broker_spans(reports: DataFrame) -> DataFrame:
    """(code, broker, field, value, first, last): the days on which a broker's latest report gives a field its value.

    A report counts from the day after its publication for the field's number of days or until the broker's next
    one for the same field; an estimate counts in its fiscal year (``eps_fy1``) and the year before (``eps_fy2``).
    """
    eps, year = F.col("eps"), F.col("fiscal_year")
    entry = lambda ok, field, value, days, in_year=None: F.when(ok, F.struct(
        F.lit(STATE.index(field)).alias("field"), value.cast("double").alias("value"), F.lit(days).alias("days"), (F.lit(None) if in_year is None else in_year).cast("int").alias("year")))
    fields = [
        entry(F.lit(True), "coverage_90", F.lit(1.0), 90), entry(F.lit(True), "coverage_180", F.lit(1.0), 180),
        entry(eps.isNotNull() & year.isNotNull(), "eps_fy1", eps, 180, year), entry(eps.isNotNull() & year.isNotNull(), "eps_fy2", eps, 180, year - 1),
        entry(F.col("score").isNotNull(), "rating", F.col("score"), 180),
        entry(F.col("revision").isNotNull(), "revision_30", F.col("revision"), 30), entry(F.col("revision").isNotNull(), "revision_90", F.col("revision"), 90),
    ]
    r = reports.where(F.col("broker").isNotNull() & F.col("publish_date").isNotNull())
    r = r.select("code", "broker", "publish_date", F.struct("report_id", F.coalesce("fiscal_year", F.lit(0))).alias("_order"), F.explode(F.array(*fields)).alias("_f")).where("_f is not null")
    series = ["code", "broker", "_f.field", "_f.year", "_f.days"]
    r = r.groupBy(*series, "publish_date").agg(F.max_by("_f.value", "_order").alias("value"))
    following = F.lead("publish_date").over(W.partitionBy("code", "broker", "field", "year").orderBy("publish_date"))
    first, last = F.date_add("publish_date", 1), F.least(F.expr("date_add(publish_date, days)"), "_next")
    r = r.withColumn("_next", following).select("code", "broker", "field", "value", first.alias("first"), last.alias("last"), "year")
    first, last = F.greatest("first", F.make_date("year", F.lit(1), F.lit(1))), F.least("last", F.make_date("year", F.lit(12), F.lit(31)))
    return r.select("code", "broker", "field", "value", first.alias("first"), last.alias("last")).where("first <= last")


def _swept(codes: list, quarters: list, fields: list, values: list, first: list, last: list) -> dict[str, list]:
    """States of each (code, quarter) on the days on which one changes.  Rows come sorted by (code, quarter)."""
    out: dict[str, list] = {k: [] for k in ("code", "quarter", "date", *STATE)}
    lo = 0
    while lo < len(codes):
        hi, events = lo, {}
        while hi < len(codes) and codes[hi] == codes[lo] and quarters[hi] == quarters[lo]:
            events.setdefault(first[hi], []).append((True, fields[hi], values[hi]))
            events.setdefault(last[hi] + 1, []).append((False, fields[hi], values[hi]))
            hi += 1
        live: list[list[float]] = [[] for _ in STATE]
        for day in sorted(events):
            for begins, field, value in events[day]:
                if begins:
                    insort(live[field], value)
                else:
                    del live[field][bisect_left(live[field], value)]
            middle = lambda x: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2 if x else None
            mean = lambda x: sum(x) / len(x) if x else None
            row = (codes[lo], quarters[lo], day, len(live[0]), len(live[1]), middle(live[2]), middle(live[3]), mean(live[4]), mean(live[5]), mean(live[6]))
            for column, v in zip(out.values(), row, strict=True):
                column.append(v)
        lo = hi
    return out


def consensus_states(reports: DataFrame) -> DataFrame:
    """(code, quarter, date, consensus columns): one row for each day on which the consensus of a code changes.

    Spans are cut at quarters, a quarter's first state standing on its first day, so a code with very many reports
    is dealt over its quarters.  A sweep over the change days of a (code, quarter) adds and removes the
    values of brokers; rows grow with reports, not with days.
    """
    spans = broker_spans(reports)
    quarter = F.explode(F.sequence(F.trunc("first", "quarter"), F.trunc("last", "quarter"), F.expr("interval 3 month")))
    s = spans.select("code", "field", "value", "first", "last", quarter.alias("quarter"))
    first, last = F.greatest("first", "quarter"), F.least("last", F.date_sub(F.add_months("quarter", 3), 1))
    parts = max(int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions")), reports.count() * 8 // SWEEP_ROWS)
    s = s.select(F.pmod(F.xxhash64("code", "quarter"), F.lit(parts)).alias("_deal"), "code", "quarter", "field", "value", first.alias("first"), last.alias("last"))
    kind = reports.schema["code"].dataType.simpleString()

    def sweep(t: pa.Table) -> pa.Table:
        t = t.sort_by([("code", "ascending"), ("quarter", "ascending")])
        days = [t.column(c).cast(pa.int32()).to_pylist() for c in ("quarter", "first", "last")]
        got = _swept(t.column("code").to_pylist(), days[0], t.column("field").to_pylist(), t.column("value").to_pylist(), days[1], days[2])
        kinds = {"code": t.schema.field("code").type, "quarter": pa.int32(), "date": pa.int32(), "coverage_90": pa.int64(), "coverage_180": pa.int64()}
        out = {k: pa.array(v, kinds.get(k, pa.float64())) for k, v in got.items()}
        return pa.table(out | {k: out[k].cast(pa.date32()) for k in ("quarter", "date")})

    schema = f"code {kind}, quarter date, date date, coverage_90 long, coverage_180 long, " + ", ".join(f"{c} double" for c in STATE[2:])
    return s.groupBy("_deal").applyInArrow(sweep, schema)


def consensus(panel: DataFrame, reports: DataFrame) -> DataFrame:
    """Consensus of reports published in the 180 days before each panel day.

    ``reports``: code, report_id, publish_date, broker, fiscal_year, eps, score, revision.  Each panel day takes
    the state in force, by an as-of join inside its quarter.
    """
    d = panel.withColumn("quarter", F.trunc("date", "quarter"))
    d = asof_join(d, consensus_states(reports), by=["code", "quarter"], fields=list(STATE)).drop("quarter")
    d = d.withColumns({"coverage_90": F.coalesce("coverage_90", F.lit(0)), "coverage_180": F.coalesce("coverage_180", F.lit(0))})
    return d.withColumn("eps_growth", change("eps_fy2", "eps_fy1"))


def consensus_changes(d: DataFrame, windows=(30, 90)) -> DataFrame:
    """Changes against the calendar row in force ``n`` days earlier, and earnings yield on the prior close."""
    base = d.select("code", "date", F.col("eps_fy1").alias("_e"), F.col("rating").alias("_r"))
    for n in windows:
        right = base.withColumn("date", F.date_add("date", n))
        d = asof_join(d, right, fields=["_e", "_r"])
        d = d.withColumns({f"eps_change_{n}": change("eps_fy1", "_e"), f"rating_change_{n}": F.col("rating") - F.col("_r")}).drop("_e", "_r")
    prev = F.lag("close_raw").over(W.partitionBy("code").orderBy("date"))
    d = d.withColumn("_p", prev)
    return d.withColumn("consensus_ep", ratio_pos("eps_fy1", "_p")).drop("_p")

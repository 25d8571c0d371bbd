"""Trades, holdings, net asset value, attribution and behaviour."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.columns import div
from tidepanel.operators.cross import with_stats
from tidepanel.operators.joins import asof_join, keep_one
from tidepanel.operators.ordering import cell_starts, deal_in_order, running, split_groups, with_start
from tidepanel.operators.staging import materialize
from tidepanel.plans.metrics import compounded


STRETCH = 300.0  # in logs: products inside a stretch stay far from underflow
PAIR, IN_ORDER = ["account", "code"], ["date", "seq"]


def _cell(*more: str):
    return W.partitionBy(*PAIR, "_part", *more).orderBy(*IN_ORDER).rowsBetween(W.unboundedPreceding, 0)


def _held(d: DataFrame) -> DataFrame:
    """Quantity after each trade since the last ``set`` of its cell, and whether what the cell starts from still counts."""
    sign = F.when(F.col("type") == "sell", -F.col("quantity")).when(F.col("type").isin("buy", "set"), F.col("quantity")).otherwise(0.0)
    d = d.withColumn("_seg", F.sum((F.col("type") == "set").cast("int")).over(_cell()))
    return d.withColumns({"held": F.sum(sign).over(_cell("_seg")), "_open": (F.col("_seg") == 0).cast("double")}).drop("_seg")


def _basis(d: DataFrame) -> DataFrame:
    """Cost basis after each trade from zero at the start of its cell, and the share that is left of what the cell starts from.

    Basis B follows B_t = a_t B_(t-1) + b_t (a buy adds its amount, a sale keeps the
    unsold share, a reset or a sell-out starts again), so with P the running product
    of a, B_t = P_t * sum(b_i / P_i): running sums again.  P falls without end, so it is
    taken from the start of its stretch of ``STRETCH`` logs; what the stretch before left counts
    with its factor, and anything older is below double precision.
    """
    before = F.when(F.col("type") == "sell", F.col("held") + F.col("quantity")).when(F.col("type") == "buy", F.col("held") - F.col("quantity")).otherwise(F.col("held"))
    keep = F.when(F.col("type") == "sell", F.when(before > 0, F.col("held") / F.nullif(before, F.lit(0.0))).otherwise(0.0)).when(F.col("type") == "set", 0.0).otherwise(1.0)
    d = d.withColumn("_keep", F.when(keep > 1e-9, keep).otherwise(0.0))
    d = d.withColumn("_run", F.sum((F.col("_keep") == 0).cast("int")).over(_cell()))
    d = d.withColumn("_lp", F.sum(F.when(F.col("_keep") > 0, F.ln("_keep")).otherwise(0.0)).over(_cell("_run")))
    add = F.when(F.col("type") == "buy", F.col("amount")).when(F.col("type") == "set", F.col("quantity") * F.coalesce("price", F.lit(0.0))).otherwise(0.0)
    d = d.withColumn("_stretch", F.floor(-F.col("_lp") / STRETCH)).withColumn("_rel", F.exp(F.col("_lp") + STRETCH * F.col("_stretch")))
    d = d.withColumn("_b", add / F.col("_rel"))
    earlier = W.partitionBy(*PAIR, "_part", "_run").orderBy("_stretch").rangeBetween(-1, -1)
    d = d.withColumns({"_s": F.sum("_b").over(_cell("_run", "_stretch")), "_left": F.sum("_b").over(earlier) * F.exp(F.lit(-STRETCH))})
    d = d.withColumns({"_basis": F.col("_rel") * (F.col("_s") + F.coalesce("_left", F.lit(0.0))), "_rest": F.when(F.col("_run") == 0, F.exp("_lp")).otherwise(0.0)})
    return d.drop("_keep", "_run", "_lp", "_stretch", "_rel", "_b", "_s", "_left")


def _with_held(dealt: DataFrame, split: DataFrame):
    """A function that adds ``held`` to dealt rows."""
    starts = cell_starts(_held(dealt.join(F.broadcast(split), PAIR, "left_semi")), PAIR, IN_ORDER, "held", "_open")
    return lambda d: with_start(_held(d), starts, PAIR, "held", "_open").drop("_open")


def _with_cost(dealt: DataFrame, split: DataFrame, with_held=lambda d: d) -> DataFrame:
    starts = cell_starts(_basis(with_held(dealt.join(F.broadcast(split), PAIR, "left_semi"))), PAIR, IN_ORDER, "_basis", "_rest")
    d = with_start(_basis(with_held(dealt)), starts, PAIR, "_basis", "_rest")
    return d.withColumn("cost", div("_basis", "held")).drop("_basis", "_rest", "_part")


def replay(trades: DataFrame) -> DataFrame:
    """Quantity after every trade: running sum since the last ``set`` of the (account, code).

    ``trades``: account, code, date, seq (unique), type, quantity.  Trades are dealt once by ranges of
    (account, code, date, seq), so a busy pair never sits in one task; a pair that a border cuts gets
    what its earlier cells have reached.
    """
    dealt = deal_in_order(trades, PAIR, IN_ORDER)
    return _with_held(dealt, split_groups(dealt, PAIR))(dealt).drop("_part")


def end_of_day(replayed: DataFrame) -> DataFrame:
    return keep_one(replayed.select("account", "code", "date", "seq", "held"), ["account", "code", "date"], ["seq"]).drop("seq")


def cash_by_day(trades: DataFrame) -> DataFrame:
    """Net trade cash from zero per account and day; one row per day, so the running window is calendar sized."""
    a, fee = F.col("amount"), F.col("fee")
    flow = F.when(F.col("type") == "buy", -(a + fee)).when(F.col("type") == "sell", a - fee).when(F.col("type") == "dividend", a).otherwise(0.0)
    d = trades.groupBy("account", "date").agg(F.sum(flow.cast("decimal(24,6)")).alias("_f"))
    w = W.partitionBy("account").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return d.select("account", "date", F.sum("_f").over(w).cast("double").alias("cash"))


def anchor_gaps(final: DataFrame, anchor: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(account, code) whose replayed quantity differs from the anchor snapshot."""
    j = final.join(anchor, ["account", "code"], "full")
    gap = F.coalesce("held", F.lit(0.0)) - F.coalesce("quantity", F.lit(0.0))
    return j.withColumn("gap", gap).where(F.abs("gap") > tol).select("account", "code", "gap")


def average_cost(replayed: DataFrame) -> DataFrame:
    """Average cost after every trade of replayed rows."""
    dealt = deal_in_order(replayed, PAIR, IN_ORDER)
    return _with_cost(dealt, split_groups(dealt, PAIR))


def replay_with_cost(trades: DataFrame) -> DataFrame:
    """``average_cost(replay(trades))``, from trades that are dealt once for both."""
    dealt = deal_in_order(trades, PAIR, IN_ORDER)
    split = split_groups(dealt, PAIR)
    return _with_cost(dealt, split, _with_held(dealt, split))


def held_spans(states: DataFrame) -> DataFrame:
    """(account, code, held, cost, first, last): the days before whose trades a state of the end of ``date`` is in force."""
    following = F.lead("date").over(W.partitionBy("account", "code").orderBy("date"))
    return states.select("account", "code", "held", "cost", F.date_add("date", 1).alias("first"), F.coalesce(following, F.lit("9999-12-31").cast("date")).alias("last"))


def _half_year(day: str) -> Column:
    return F.year(day) * 2 + F.when(F.month(day) > 6, 1).otherwise(0)


def paper_days(spans: DataFrame, prices: DataFrame, days: DataFrame) -> DataFrame:
    """(account, gains, losses): held positions above and not above their cost, summed over the account's sale days.

    A position keeps its side while its cost and its price stand, so each overlap of a held span with a price's days
    is one step up on its first day and one down after its last; steps are summed for each (account, day) before they are
    shuffled and counted up over the days.  No row is made for a position on a day.
    """
    ends = days.agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    following = F.lead("date").over(W.partitionBy("code").orderBy("date"))
    steps = prices.select("code", "px", F.col("date").alias("_a"), F.coalesce(F.date_sub(following, 1), F.lit("9999-12-31").cast("date")).alias("_z"))
    clip = lambda d, a, z: d.join(F.broadcast(ends)).withColumns({a: F.greatest(a, "_from"), z: F.least(z, "_to")}).where(F.col(a) <= F.col(z)).drop("_from", "_to")
    halves = lambda d, a, z, h: d.withColumn(h, _half_year(a)).withColumn("_half", F.explode(F.sequence(h, _half_year(z))))
    steps = halves(clip(steps.where("px is not null"), "_a", "_z"), "_a", "_z", "_ha")
    held = halves(clip(spans.select("account", "code", "cost", "first", "last"), "first", "last"), "first", "last", "_hf")
    # An overlap of several half-years counts in the one where it begins.
    begins = F.greatest("first", "_a")
    d = held.join(steps, ["code", "_half"]).where((begins <= F.least("last", "_z")) & (F.greatest("_hf", "_ha") == F.col("_half")))
    up = F.struct(begins.alias("date"), F.lit(1).alias("_n"))
    down = F.struct(F.date_add(F.least("last", "_z"), 1).alias("date"), F.lit(-1).alias("_n"))
    d = d.select("account", (F.col("px") > F.col("cost")).alias("_gain"), F.explode(F.array(up, down)).alias("_e")).select("account", "_gain", "_e.*")
    one = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    d = d.groupBy("account", "date").agg(one(F.col("_gain")).alias("_g"), one(~F.col("_gain")).alias("_l"))
    d = d.join(days.withColumn("_sale", F.lit(1)), ["account", "date"], "full")
    w = W.partitionBy("account").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    d = d.select("account", "_sale", F.sum("_g").over(w).alias("_g"), F.sum("_l").over(w).alias("_l")).where("_sale = 1")
    return d.groupBy("account").agg(F.coalesce(F.sum("_g"), F.lit(0)).alias("gains"), F.coalesce(F.sum("_l"), F.lit(0)).alias("losses"))


def disposition(states: DataFrame, sales: DataFrame, prices: DataFrame) -> DataFrame:
    """Realised and paper gains and losses on sale days, and PGR - PLR, per account.

    ``states``: account, code, date, held, cost (end of day); ``sales``: account, code,
    date, px; ``prices``: code, date, px.  Positions held on sale days are counted by ``paper_days``; the ones sold on the
    day are taken out there and judged by their sale price.
    """
    spans = held_spans(states).where("held > 0 and cost > 0")
    paper = paper_days(spans, prices, sales.select("account", "date").distinct())
    s = sales.groupBy("account", "code", "date").agg(F.max("px").alias("sale_px")).where("sale_px is not null")
    s = asof_join(s, states, by=PAIR, fields=["held", "cost"], allow_equal=False).where("held > 0 and cost > 0")
    s = asof_join(s, prices, fields=["px"], unique_left=False)
    n = lambda c: F.count(F.when(c, 1))
    gain, was_gain = F.col("sale_px") > F.col("cost"), F.col("px") > F.col("cost")
    s = s.groupBy("account").agg(n(gain).alias("realized_gain"), n(~gain).alias("realized_loss"), n(was_gain).alias("_wg"), n(~was_gain).alias("_wl"))
    g = paper.join(s, "account", "left").na.fill(0, ["realized_gain", "realized_loss", "_wg", "_wl"])
    g = g.select("account", "realized_gain", "realized_loss", (F.col("gains") - F.col("_wg")).alias("paper_gain"), (F.col("losses") - F.col("_wl")).alias("paper_loss"))
    g = g.where("realized_gain + realized_loss + paper_gain + paper_loss > 0")
    pgr = div(F.col("realized_gain").cast("double"), F.col("realized_gain") + F.col("paper_gain"))
    plr = div(F.col("realized_loss").cast("double"), F.col("realized_loss") + F.col("paper_loss"))
    return g.withColumns({"pgr": pgr, "plr": plr}).withColumn("pgr_minus_plr", F.col("pgr") - F.col("plr"))


def repurchases(trades: DataFrame, horizon: int) -> DataFrame:
    """Sales followed by a purchase of the same code within the horizon, per account.

    Only the next purchase after each sale matters: one as-of style pass on (account, code).
    """
    buys = trades.where("type = 'buy'").groupBy("account", "code", "pos").agg(F.lit(1).alias("_one"))
    nxt = buys.select("account", "code", (-F.col("pos")).alias("_k"), F.col("pos").alias("next_buy"))
    sells = trades.where("type = 'sell'").groupBy("account", "code", "pos").agg(F.count("*").alias("n")).withColumn("_k", -F.col("pos"))
    j = asof_join(sells, nxt, on="_k", by=["account", "code"], fields=["next_buy"], allow_equal=False)
    hit = F.coalesce(F.col("next_buy") - F.col("pos") <= horizon, F.lit(False))
    return j.groupBy("account").agg(F.sum("n").alias("sells"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("repurchased"))


def chasing(buys: DataFrame, prices: DataFrame, bench: DataFrame, horizon: int) -> DataFrame:
    """Prior return of bought names over the benchmark's, per account.  Prices are a dense (code, pos) grid."""
    past = prices.select("code", (F.col("pos") + horizon).alias("pos"), F.col("px").alias("_p0"))
    now = prices.select("code", (F.col("pos") + 1).alias("pos"), F.col("px").alias("_p1"))
    b0 = bench.select((F.col("pos") + horizon).alias("pos"), F.col("px").alias("_b0"))
    b1 = bench.select((F.col("pos") + 1).alias("pos"), F.col("px").alias("_b1"))
    d = buys.join(past, ["code", "pos"]).join(now, ["code", "pos"]).join(F.broadcast(b0), "pos").join(F.broadcast(b1), "pos")
    return d.groupBy("account").agg(F.avg(div("_p1", "_p0") - div("_b1", "_b0")).alias("mean_prior_excess"), F.count("*").alias("n"))


def switch_values(trades: DataFrame, prices: DataFrame, horizon: int) -> DataFrame:
    """Mean forward return of what was bought on a sale day minus that of what was sold."""
    later = prices.select("code", (F.col("pos") - horizon).alias("pos"), F.col("px").alias("_later"))
    d = trades.where("type in ('buy', 'sell')").join(later, ["code", "pos"]).withColumn("fwd", div("_later", "price") - 1)
    d = d.where("fwd is not null").groupBy("account", "date", "code", "type").agg(F.avg("fwd").alias("fwd"))
    sold = d.where("type = 'sell'").select("account", "date", F.col("code").alias("sold"), F.col("fwd").alias("sold_fwd"))
    bought = d.where("type = 'buy'").groupBy("account", "date").agg(F.sum("fwd").alias("_s"), F.count("*").alias("_n"))
    own = d.where("type = 'buy'").select("account", "date", F.col("code").alias("sold"), F.col("fwd").alias("_own"))
    j = sold.join(bought, ["account", "date"]).join(own, ["account", "date", "sold"], "left")
    n = F.col("_n") - F.col("_own").isNotNull().cast("int")
    return j.where(n > 0).select("account", "date", "sold", ((F.col("_s") - F.coalesce("_own", F.lit(0.0))) / F.nullif(n, F.lit(0)) - F.col("sold_fwd")).alias("value"))


# Cumulative Poisson(1) probabilities in units of 1 / PRIME, a Mersenne prime.
PRIME = (1 << 31) - 1
POISSON = (790015083, 1580030167, 1975037709, 2106706890, 2139624185, 2146207644, 2147304887)


def poisson_counts(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Poisson(1) counts of each (key, draw), a function of integers that SQL can repeat."""
    k = (keys % PRIME)[:, None]
    a = (k * 48271 + draws * 69621 + 1) % PRIME
    b = (a * a + k) % PRIME
    c = (b * b + a) % PRIME
    return np.searchsorted(np.array(POISSON), c, side="left")


def bootstrap_mean(values: DataFrame, key: str, x: str, draws: int) -> DataFrame:
    """Percentile interval of the mean under Poisson resampling.

    A row counts Poisson(1) times in each draw, by its integer key.  A task keeps one sum and one count for each
    draw and passes on this state alone; states add up, so no resample and no (row, draw) pair is
    ever formed.  Rows without a value do not count.
    """
    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, total, weight = np.arange(draws, dtype=np.int64), np.zeros(draws), np.zeros(draws, np.int64)
        for batch in batches:
            keys, xs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo in range(0, len(keys), 256):
                n = poisson_counts(keys[lo : lo + 256], every)
                total += xs[lo : lo + 256] @ n
                weight += n.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(total), pa.array(weight)], ["draw", "total", "weight"])

    d = values.select(F.col(key).cast("long"), F.col(x).cast("double")).dropna()
    m = d.mapInArrow(state, "draw long, total double, weight long").groupBy("draw").agg(F.sum("total").alias("t"), F.sum("weight").alias("w"))
    m = m.select(div("t", F.col("w").cast("double")).alias("m"))
    return m.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def nav_history(snaps: DataFrame, cash: DataFrame, prices: DataFrame, flows: DataFrame, cal: DataFrame, bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily value, flow-adjusted return, unit value and drawdown per account; and the held positions.

    ``snaps``: account, as_of_pos, code, quantity; ``cash``: account, as_of_pos, cash;
    ``prices``: code, pos, px (carried); ``flows``: account, pos, amount on valuation days.
    """
    first = cash.groupBy("account").agg(F.min("as_of_pos").alias("_first"))
    last = cal.agg(F.max("pos").alias("_last"))
    days = first.join(F.broadcast(last)).select("account", F.explode(F.sequence("_first", "_last")).alias("pos"))
    days = days.join(F.broadcast(cal.select("pos", "date")), "pos").select("account", "pos", "date")
    days = asof_join(days, cash.withColumn("snap", F.col("as_of_pos")), on="pos", by=["account"], fields=["snap", "cash"], right_on="as_of_pos")
    days = days.join(flows, ["account", "pos"], "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))
    after = F.when(F.col("pos") > F.col("snap"), F.col("amount")).otherwise(0.0)
    w = W.partitionBy("account", "snap").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    days = days.withColumn("cash", F.col("cash") + F.sum(after).over(w))
    held = days.select("account", "pos", "snap").join(snaps.withColumnRenamed("as_of_pos", "snap"), ["account", "snap"]).join(prices, ["code", "pos"], "left")
    val = held.groupBy("account", "pos").agg(F.sum(F.col("quantity") * F.col("px")).alias("_v"), F.count(F.when(F.col("px").isNull(), 1)).alias("_miss"))
    d = days.join(val, ["account", "pos"], "left").where("coalesce(_miss, 0) = 0").withColumn("nav", F.col("cash") + F.coalesce("_v", F.lit(0.0)))
    wa = W.partitionBy("account").orderBy("pos")
    prev = F.lag("nav").over(wa)
    d = d.withColumn("ret", F.when(prev.isNotNull(), (F.col("nav") - F.col("amount")) / F.nullif(prev, F.lit(0.0)) - 1).otherwise(0.0)).withColumn("prev_nav", prev)
    run = wa.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("unit_nav", compounded("ret", run))
    d = d.withColumn("drawdown", F.col("unit_nav") / F.greatest(F.max("unit_nav").over(run), F.lit(1.0)) - 1)
    d = d.join(F.broadcast(bench), "pos", "left").withColumn("excess", F.col("ret") - F.col("bret"))
    return d.select("account", "pos", "date", "nav", "prev_nav", "ret", "unit_nav", "drawdown", "excess", F.col("amount").alias("flow")), held


def contributions(held: DataFrame, nav: DataFrame) -> DataFrame:
    """Previous quantity times price change over previous value, per (account, pos, code)."""
    prev = held.select("account", (F.col("pos") + 1).alias("pos"), "code", "quantity", F.col("px").alias("_p0"))
    now = held.select("code", "pos", F.col("px").alias("_p1")).distinct()
    d = prev.join(now, ["code", "pos"]).join(nav.select("account", "pos", "prev_nav"), ["account", "pos"])
    return d.select("account", "pos", "code", div(F.col("quantity") * (F.col("_p1") - F.col("_p0")), "prev_nav").alias("contribution"))


def sector_returns(weights: DataFrame, start: DataFrame, end: DataFrame, group: str, cover: float = 0.99) -> DataFrame:
    """Benchmark sector weight and weight-averaged return; missing where too little weight is priced."""
    d = weights.join(start.select("code", F.col("px").alias("_a")), "code", "left").join(end.select("code", F.col("px").alias("_b")), "code", "left")
    ret = div("_b", "_a") - 1
    ok = ret.isNotNull()
    g = d.groupBy(group).agg(F.sum("weight").alias("wb"), F.sum(F.when(ok, F.col("weight"))).alias("_p"), F.sum(F.when(ok, F.col("weight") * ret)).alias("_r"))
    return g.select(group, "wb", F.when(F.col("_p") >= cover * F.col("wb"), div("_r", "_p")).alias("rb"))


def allocation_selection(port: DataFrame, bench: DataFrame, group: str) -> DataFrame:
    """Allocation and selection per group; benchmark-only groups stay.  ``port``: account, group, wp, contribution."""
    # The sector table has one row per sector; it reaches every account as one packed row.
    packed = bench.agg(F.collect_list(F.struct(group, "wb", "rb")).alias("_b"))
    b = port.select("account").distinct().join(F.broadcast(packed)).select("account", F.inline("_b"))
    j = port.join(b, ["account", group], "full")
    wp, wb = F.coalesce("wp", F.lit(0.0)), F.coalesce("wb", F.lit(0.0))
    rp = F.when(wp != 0, F.col("contribution") / F.nullif(wp, F.lit(0.0)))
    return j.select("account", group, wp.alias("wp"), wb.alias("wb"), F.coalesce("contribution", F.lit(0.0)).alias("contribution"),
                    ((wp - wb) * F.col("rb")).alias("allocation"), F.when(wp != 0, wp * (rp - F.col("rb"))).alias("selection"))


def limit_check(pos: DataFrame, single: float, sector: float, drift: float) -> DataFrame:
    """Trims over name, sector and thesis limits; adds towards targets within headroom and cash in row order.

    ``pos``: account, code, value, industry, cap (thesis cap or NULL), target, and cash per account in ``cash``.
    Granted cash is the growth of min(cash, running requests), so the order is kept
    without a loop.
    """
    c = F.col
    d = with_stats(pos, "account", {"_t": F.sum("value")}).withColumn("_total", c("_t") + c("cash"))
    d = d.withColumn("weight", div("value", "_total"))
    d = with_stats(d, ["account", "industry"], {"_sec": F.sum("weight")})
    known = c("industry") != "unknown"
    cap = F.least(F.lit(single), F.coalesce(c("cap"), F.lit(single)))
    over_sec = known & (c("_sec") > sector)
    excess = F.greatest(c("weight") - cap, F.lit(0.0), F.when(over_sec, c("weight") * (c("_sec") - sector) / F.nullif("_sec", F.lit(0.0))).otherwise(0.0))
    why = (c("weight") > single) | F.coalesce(c("weight") > c("cap"), F.lit(False)) | over_sec
    d = d.withColumns({"_x": excess, "_trim": (excess > drift) | ((excess > 0) & why)})
    room = F.least(cap - c("weight"), F.when(known, sector - c("_sec")).otherwise(cap - c("weight")))
    want = (~c("_trim")) & c("target").isNotNull() & (c("target") - c("weight") >= drift)
    d = d.withColumn("_req", F.when(want, F.greatest(F.lit(0.0), F.least(c("target") - c("weight"), room)) * c("_total")).otherwise(0.0))
    d = running(d, ["account"], ["code"], {"_cum": ("sum", "_req")}, keys=("code",))
    grant = F.least(c("_cum"), c("cash")) - F.least(c("_cum") - c("_req"), c("cash"))
    return d.select("account", "code", "weight", F.when(c("_trim"), "trim").when(grant > 0, "add").otherwise("hold").alias("action"),
                    F.when(c("_trim"), c("_x") * c("_total")).otherwise(0.0).alias("trim_value"), grant.alias("add_value"))


def checkup(pos: DataFrame, top_n: int) -> DataFrame:
    """Concentration of each account: HHI, top-n share, class shares."""
    from tidepanel.operators.ordering import position

    d = with_stats(pos, "account", {"_t": F.sum("value")}).withColumn("w", div("value", "_t"))
    d = position(d, ["account"], [-F.col("value"), "code"], "_p")
    return d.groupBy("account").agg(F.count("*").alias("names"), F.sum(F.col("w") * F.col("w")).alias("hhi"), F.sum(F.when(F.col("_p") <= top_n, F.col("w"))).alias("top_n"),
                                    F.sum(F.when(F.col("kind") == "stock", F.col("w")).otherwise(0.0)).alias("stock"), F.max("w").alias("largest"))


def range_position(low: Column, high: Column, price: Column) -> Column:
    return F.when(high > low, (price - low) / F.nullif(high - low, F.lit(0.0)))


def betas(returns: DataFrame, market: DataFrame, least: int) -> DataFrame:
    """Beta per code over paired days."""
    j = returns.join(F.broadcast(market), "pos").where("ret is not null and mret is not null")
    return j.groupBy("code").agg(F.when(F.count("*") >= least, div(F.covar_samp("ret", "mret"), F.var_samp("mret"))).alias("beta"))


PAIRS = 1_000_000  # pairs that meet in one group
BLOCK = 20_000  # codes of one block at most


def _correlate(x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of two tables of returns (NaN is missing): common days, and the correlation over them, NaN with too few days or a side that does not vary."""
    both = ~(np.isnan(x) | np.isnan(y))
    n = both.sum(1)
    x, y = (np.where(both, v, 0.0) for v in (x, y))
    some = np.maximum(n, 1)[:, None]
    dx, dy = (np.where(both, v - v.sum(1, keepdims=True) / some, 0.0) for v in (x, y))
    sxx, syy, sxy = (np.einsum("ij,ij->i", u, v) for u, v in ((dx, dx), (dy, dy), (dx, dy)))
    varies = np.ones(len(n), bool)
    for v, ss in ((x, sxx), (y, syy)):
        flat = np.flatnonzero(ss <= 1e-20 * np.einsum("ij,ij->i", v, v))  # constant up to the rounding of the mean
        w, m = v[flat], both[flat]
        varies[flat] = np.where(m, w, -np.inf).max(1, initial=-np.inf) > np.where(m, w, np.inf).min(1, initial=np.inf)
    norm = np.sqrt(sxx * syy)
    good = varies & (n >= least) & (norm > 0)
    return n, np.where(good, sxy / np.where(norm > 0, norm, 1.0), np.nan)


def pair_correlation(members: DataFrame, returns: DataFrame, least: int) -> DataFrame:
    """Mean and largest pairwise return correlation of each account's names; ``returns`` has a row for each (code, pos) at most.

    A pair travels as (account, a, b) to the group of its two blocks of codes, and a code's returns, one array, to the groups of its
    block; no row is made for a pair on a day.  Blocks are as many as codes and pairs ask for, so a group stays of one size.
    In a group equal pairs are computed once.
    """
    names = members.select("account", "code").dropna().repartition("account").groupBy("account").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    names = materialize(names.where("size(codes) > 1"))
    total = int(names.agg(F.sum(F.size("codes") * (F.size("codes") - 1.0) / 2)).first()[0] or 0)
    held = returns.where("ret is not null").groupBy("code").agg(F.collect_list(F.struct("pos", "ret")).alias("r"))
    held = materialize(held.select("code", F.col("r.pos").alias("at"), F.col("r.ret").alias("ret")))
    codes = held.count()
    blocks = max(1, -(-codes // BLOCK), ceil(sqrt(2 * total / PAIRS)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    low, high = F.least(block("a"), block("b")), F.greatest(block("a"), block("b"))
    later = F.slice("codes", F.col("i") + 2, F.size("codes"))
    pairs = names.select("account", "codes", F.posexplode("codes").alias("i", "a")).select("account", "a", F.explode(later).alias("b"))
    pairs = pairs.select((low * blocks + high).alias("g"), "account", "a", "b")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    sent = held.select("code", "at", "ret", block("code").alias("q"), other)
    sent = sent.select((F.least("q", "o") * blocks + F.greatest("q", "o")).alias("g"), "code", "at", "ret")

    def meet(pair: pa.Table, known: pa.Table) -> pa.Table:
        account, a, b = (pair.column(c).to_numpy() for c in ("account", "a", "b"))
        code = known.column("code").to_numpy()
        at, ret = (known.column(c).combine_chunks() for c in ("at", "ret"))
        order = np.argsort(code)
        code = code[order]
        table = np.full((len(code), int(np.max(at.flatten().to_numpy(), initial=-1)) + 1), np.nan)
        table[np.repeat(np.argsort(order), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = ret.flatten().to_numpy()
        i, j = np.searchsorted(code, a), np.searchsorted(code, b)
        last = max(len(code) - 1, 0)
        there = (code[np.minimum(i, last)] == a) & (code[np.minimum(j, last)] == b) if len(code) else np.zeros(len(a), bool)
        account, pairs_ = account[there], i[there] * max(len(code), 1) + j[there]
        once, back = np.unique(pairs_, return_inverse=True)
        days, value = np.zeros(len(once), np.int64), np.full(len(once), np.nan)
        for lo in range(0, len(once), 4096):
            u, v = np.divmod(once[lo : lo + 4096], len(code))
            days[lo : lo + 4096], value[lo : lo + 4096] = _correlate(table[u], table[v], least)
        met = days[back] > 0
        value = value[back][met]
        return pa.table({"account": account[met], "corr": pa.array(value, mask=np.isnan(value))})

    kind = members.schema["account"].dataType.simpleString()
    found = pairs.groupBy("g").cogroup(sent.groupBy("g")).applyInArrow(meet, f"account {kind}, corr double")
    return found.repartition("account").groupBy("account").agg(F.avg("corr").alias("mean_corr"), F.max("corr").alias("max_corr"), F.count("corr").alias("pairs"))


def stress(pos: DataFrame) -> DataFrame:
    """Linear losses: market -10%, largest industry -20%, largest name -30%."""
    d = with_stats(pos, "account", {"_t": F.sum("value")}).withColumn("w", div("value", "_t"))
    ind = d.groupBy("account", "industry").agg(F.sum("w").alias("iw")).groupBy("account").agg((-0.2 * F.max("iw")).alias("industry_down_20"))
    m = d.groupBy("account").agg((-0.1 * F.sum(F.col("w") * F.col("beta"))).alias("market_down_10"), (-0.3 * F.max("w")).alias("largest_down_30"))
    return m.join(ind, "account")


def convertible_flags(df: DataFrame) -> DataFrame:
    """Premium, size, term and rating flags of a bond joined to its underlying."""
    c = F.col
    premium = F.coalesce(c("premium"), F.when(c("equity_value") > 0, 100 * (c("price") / F.nullif("equity_value", F.lit(0.0)) - 1)))
    flags = F.array_compact(F.array(
        F.when(premium > 50, "high_conversion_premium"), F.when(c("remaining") < 3, "small_remaining_size"), F.when(c("term") < 1, "short_maturity"),
        F.when(~F.upper("rating").isin("AAA", "AA+", "AA", "AA-"), "low_rating")))
    return df.withColumns({"premium": premium, "flags": flags, "redeem_distance": F.when(c("redeem") > 0, 100 * (c("stock_price") / F.nullif("redeem", F.lit(0.0)) - 1))})


def style_summary(pos: DataFrame, styles: list[str]) -> DataFrame:
    """Weighted mean of raw styles over the names that have them, with the covered weight."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("style"), F.col(s).alias("x")) for s in styles]))
    d = with_stats(pos, "account", {"_t": F.sum("value")}).withColumn("w", div("value", "_t")).select("account", "w", rows.alias("_r")).select("account", "w", "_r.*")
    ok = F.col("x").isNotNull()
    g = d.groupBy("account", "style").agg(F.sum(F.when(ok, F.col("w") * F.col("x"))).alias("_n"), F.sum(F.when(ok, F.col("w")).otherwise(0.0)).alias("covered"))
    return g.select("account", "style", div("_n", "covered").alias("value"), "covered")


def outcome_summary(df: DataFrame, by: list[str], gamma: float) -> DataFrame:
    """Certainty equivalent, tail shares and value over no action from a wealth table."""
    w = F.greatest("wealth", F.lit(1e-6))
    ce = F.exp(F.avg(F.ln(w))) if gamma == 1 else F.pow(F.avg(F.pow(w, F.lit(1 - gamma))), F.lit(1 / (1 - gamma)))
    v = F.col("wealth") - F.col("hold")
    return df.groupBy(*by).agg(F.count("*").alias("accounts"), ce.alias("ce"), F.avg("wealth").alias("mean_wealth"), F.avg((F.col("wealth") < 0.7).cast("double")).alias("p_loss_30"),
                               F.avg((F.col("max_drawdown") > 0.3).cast("double")).alias("p_mdd_30"), F.avg(v).alias("decision_value"), F.avg((v > 0).cast("double")).alias("share_positive"))


def clustered_t(df: DataFrame, x: str, cluster: str, by: list[str] | None = None, least_rows=0, least=3) -> DataFrame:
    """t of the mean over cluster means."""
    by = by or []
    m = df.where(F.col(x).isNotNull()).groupBy(*by, cluster).agg(F.avg(x).alias("m"), F.count("*").alias("n"), F.sum(x).alias("s"))
    sd = F.stddev_samp("m")
    ok = (F.count("*") >= least) & (F.sum("n") >= least_rows) & (sd > 0)
    return m.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.when(ok, F.avg("m") / F.nullif(sd / F.sqrt(F.count("*")), F.lit(0.0))).alias("t"))

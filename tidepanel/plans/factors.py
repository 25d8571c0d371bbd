"""Named factor definitions and their batch evaluation.

A definition is a list of column layers, one per nesting depth of its rolling
operators.  A batch merges the layers of all definitions by depth, so every factor
shares the one exchange by code and each inner column is computed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.columns import div, log_
from tidepanel.operators import rolling as R
from tidepanel.operators.cross import with_stats


@dataclass(frozen=True)
class Factor:
    name: str
    layers: Callable[[], Sequence[dict[str, Column]]]
    direction: int = 1
    horizon: int = 1
    tags: dict = field(default_factory=dict)


def derived_terminals(df: DataFrame, n: int = 20) -> DataFrame:
    """excess_ret_1d, amihud, vwap_dev, overnight_ret, intraday_ret on the dense grid."""
    d = with_stats(df, "date", {"_b": F.avg(F.when(F.col("in_universe"), F.col("ret_1d")))})
    return own_terminals(d.withColumn("excess_ret_1d", F.col("ret_1d") - F.col("_b")).drop("_b"), n)


def own_terminals(df: DataFrame, n: int = 20) -> DataFrame:
    """The terminals that a code's own rows give: all but excess_ret_1d, which no seed factor reads and which takes a second pass over the grid."""
    d = df.withColumns({"_ill": div(F.abs("ret_1d"), F.when(F.col("amount") > 0, F.col("amount") / 1e8)),
                        "vwap_dev": div("close", "vwap") - 1, "overnight_ret": div("open", R.ts_delay("close", 1)) - 1,
                        "intraday_ret": div("close", "open") - 1})
    return d.withColumn("amihud", R.ts_mean("_ill", n)).drop("_ill")


def seed_factors(short=5, medium=20, quarter=60, long=120) -> list[Factor]:
    """The eighteen known factors; windows default to trading days."""
    f = F.col

    def one(name, build, direction, domain, *inner):
        return Factor(name, lambda: [*(i() for i in inner), {name: build()}], direction, tags={"domain": domain})

    ret = "ret_1d"
    return [
        one("reversal_short", lambda: R.ts_sum(ret, short), -1, "price"),
        one("reversal_medium", lambda: R.ts_sum(ret, medium), -1, "price"),
        one("momentum_long", lambda: R.ts_sum(ret, long) - R.ts_sum(ret, medium), 1, "price"),
        one("vol_medium", lambda: R.ts_std(ret, medium), -1, "price"),
        one("vol_quarter", lambda: R.ts_std(ret, quarter), -1, "price"),
        one("max_ret", lambda: R.ts_max(ret, medium), -1, "price"),
        one("turnover_mean", lambda: R.ts_mean("turnover", medium), -1, "liquidity"),
        one("turnover_shock", lambda: div(R.ts_mean("turnover", short), R.ts_mean("turnover", quarter)), -1, "liquidity"),
        one("amihud_level", lambda: f("amihud"), 1, "liquidity"),
        one("size", lambda: log_("circ_mv"), -1, "value"),
        one("book_to_price", lambda: div(F.lit(1.0), "pb_mrq"), 1, "value"),
        one("earnings_yield", lambda: div(F.lit(1.0), "pe_ttm"), 1, "value"),
        one("vwap_dev_mean", lambda: R.ts_mean("vwap_dev", short), -1, "price"),
        one("overnight_mean", lambda: R.ts_mean("overnight_ret", medium), -1, "price"),
        one("intraday_mean", lambda: R.ts_mean("intraday_ret", medium), -1, "price"),
        one("price_volume_corr", lambda: R.ts_corr("close", "volume", medium), -1, "price"),
        one("volume_ratio", lambda: div(R.ts_mean("volume", short), R.ts_mean("volume", medium)), -1, "volume"),
        one("range_mean", lambda: R.ts_mean("_range", medium), -1, "price",
            lambda: {"_range": div(f("high") - f("low"), "close")}),
    ]


def base_factors(short=5, medium=20) -> list[Factor]:
    return [
        Factor("base_reversal", lambda: [{"base_reversal": -R.ts_sum("ret_1d", short)}]),
        Factor("base_vol", lambda: [{"base_vol": R.ts_std("ret_1d", medium)}]),
        Factor("base_size", lambda: [{"base_size": log_("circ_mv")}]),
        Factor("base_turnover", lambda: [{"base_turnover": R.ts_mean("turnover", medium)}]),
    ]


def candidate_factors(w20=20, w60=60, w250=250) -> list[Factor]:
    """Derived candidates over price, liquidity, value, statement and flow fields."""
    f = F.col
    h = lambda n: max(2, n // 2)
    inv = lambda x: F.when(f(x) > 0, 1 / F.nullif(f(x), F.lit(0.0)))
    delta = lambda x, n: f(x) - R.ts_delay(x, n)
    simple = {
        "mom_quarter": lambda: R.ts_return("close", w60),
        "mom_year_skip": lambda: div(R.ts_delay("close", w20), R.ts_delay("close", w250)) - 1,
        "dist_high": lambda: div("close", R.ts_max("close", w250, h(w250))) - 1,
        "ret_skew": lambda: R.ts_skew("ret_1d", w60, h(w60)),
        "downside_vol": lambda: R.ts_std(F.when(f("ret_1d").isNotNull(), F.least(f("ret_1d"), F.lit(0.0))), w60, h(w60)),
        "turnover_cv": lambda: div(R.ts_std("turnover", w20, h(w20)), R.ts_mean("turnover", w20, h(w20))),
        "limit_up_count": lambda: R.ts_sum((f("close") >= f("limit_up") * 0.9995).cast("double"), w20, h(w20)),
        "log_price": lambda: F.ln(F.when(f("close").isNotNull(), F.greatest("close", F.lit(0.01)))),
        "sales_yield": lambda: inv("ps_ttm"), "cash_yield": lambda: f("ocf") / F.when(f("circ_mv") > 0, f("circ_mv")),
        "op_margin": lambda: f("op_margin_ttm"), "cash_quality": lambda: f("cash_to_assets") - f("debt_to_assets"),
        "rd_intensity": lambda: f("rd_to_rev"), "goodwill_neg": lambda: -f("goodwill_to_equity"), "debt_neg": lambda: -f("debt_to_equity"),
        "ocf_to_profit": lambda: F.when(f("profit").isNotNull() & f("ocf").isNotNull(), F.greatest(F.lit(-10.0), F.least(F.lit(10.0), div("ocf", F.abs("profit"))))),
        "roe_change": lambda: delta("roe", w250), "margin_change": lambda: delta("gross_margin", w250),
        "equity_growth": lambda: f("yoy_equity"), "rev_accel": lambda: delta("rev_growth", w60),
        "main_flow": lambda: R.ts_mean("main_ratio", 5, 3), "block_flow": lambda: R.ts_mean("block_ratio", w20, h(w20)),
    }
    out = [Factor(n, lambda n=n, b=b: [{n: b()}]) for n, b in simple.items()]
    out.append(Factor("idio_vol", lambda: [
        {"_bm": div(R.ts_cov("ret_1d", "mkt", w60, h(w60)), F.var_samp("mkt").over(R.trailing(w60)))},
        {"_eps": f("ret_1d") - f("_bm") * f("mkt")}, {"idio_vol": R.ts_std("_eps", w60, h(w60))}]))
    return out


def value_mix(df: DataFrame, by=("date",), keys=("code",)) -> DataFrame:
    """Adds the mean of the percentile ranks of the three inverse multiples; missing if one is."""
    from tidepanel.operators.ordering import with_ranks

    inv = lambda x: F.when(F.col(x) > 0, 1 / F.nullif(F.col(x), F.lit(0.0)))
    d = with_ranks(df, list(by), {"_r_pe": inv("pe_ttm"), "_r_pb": inv("pb_mrq"), "_r_ps": inv("ps_ttm")}, keys=keys)
    return d.withColumn("value_mix", (F.col("_r_pe") + F.col("_r_pb") + F.col("_r_ps")) / 3).drop("_r_pe", "_r_pb", "_r_ps")


def fund_factors(a=20, b=60, c=120, year=250) -> list[Factor]:
    """Price features of funds."""
    part = lambda n, k: max(1, n * k // 100)
    simple = {
        "mom_a": lambda: R.ts_return("close", a), "mom_b": lambda: R.ts_return("close", b), "mom_c": lambda: R.ts_return("close", c),
        "mom_skip": lambda: div(R.ts_delay("close", a), R.ts_delay("close", c)) - 1, "rev_5": lambda: -R.ts_return("close", 5),
        "fvol_a": lambda: R.ts_std("ret_1d", a, part(a, 75)), "fvol_b": lambda: R.ts_std("ret_1d", b, part(b, 67)),
        "drawdown": lambda: div("close", R.ts_max("close", b, part(b, 67))) - 1,
        "dist_high_year": lambda: div("close", R.ts_max("close", year, part(year, 48))) - 1,
        "ma_gap": lambda: div("close", R.ts_mean("close", b, part(b, 67))) - 1,
        "amount_ratio": lambda: div(R.ts_mean(F.when(F.col("amount") > 0, F.col("amount")), 5, 3), R.ts_mean(F.when(F.col("amount") > 0, F.col("amount")), b, part(b, 50))),
    }
    return [Factor(n, lambda n=n, f=f: [{n: f()}]) for n, f in simple.items()]


def evaluate(df: DataFrame, factors: Sequence[Factor]) -> DataFrame:
    """Wide columns of all factors in one pass over the dense grid."""
    todo = [list(f.layers()) for f in factors]
    for depth in range(max(len(x) for x in todo)):
        layer: dict[str, Column] = {}
        for x in todo:
            if depth < len(x):
                layer |= x[depth]
        df = df.withColumns(layer)
    return df


def definition(factor: Factor) -> str:
    """Hash of a factor's expressions, layer by layer, its direction and horizon: the same for equal definitions in any session."""
    return hashlib.sha256(repr((list(factor.layers()), factor.direction, factor.horizon)).encode()).hexdigest()[:32]


def to_long(df: DataFrame, factors: Sequence[Factor], keep: Sequence[str], directed: bool = False) -> DataFrame:
    """One row per (date, code, factor) with the kept columns; missing values stay."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("factor"), (F.col(f.name) * (f.direction if directed else 1)).cast("double").alias("value")) for f in factors]))
    return df.select(*keep, rows.alias("_f")).select(*keep, "_f.factor", "_f.value")


def expand_template(name: str, build: Callable[..., Sequence[dict[str, Column]]], grid: dict[str, Sequence]) -> list[Factor]:
    """One factor per point of the parameter grid; the first is the default."""
    out = []
    for values in product(*grid.values()):
        args = dict(zip(grid, values, strict=True))
        label = name + "".join(f"_{k}{v}" for k, v in args.items())
        out.append(Factor(label, lambda label=label, args=args: build(label, **args), tags=args))
    return out

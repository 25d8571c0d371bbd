"""Event scores: reference percentiles, decay features, entries, decile report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.columns import corr, div, half_life_decay
from tidepanel.operators.cross import with_stats
from tidepanel.operators.joins import asof_join, keep_one
from tidepanel.operators.ordering import order_stats, position, running, with_ranks
from tidepanel.operators.ranged import numbered
from tidepanel.operators.staging import materialize
from tidepanel.plans.metrics import decile


def monthly_reference(events: DataFrame, cal: DataFrame, days: int, least: int) -> DataFrame:
    """Share of scores at or below each event's among the ``days`` event days before its month began.

    A reference event serves the few months whose look-back covers it; references and
    events of a month are counted along one score order.
    """
    ev_days = events.select("date").distinct()
    ev_days = ev_days.withColumn("_i", F.row_number().over(W.orderBy("date")) - 1).withColumn("month", F.trunc("date", "month"))
    start = ev_days.groupBy("month").agg(F.min("_i").alias("_start"))
    serves = ev_days.select(F.col("date"), "_i").join(F.broadcast(start), (F.col("_i") < F.col("_start")) & (F.col("_i") >= F.col("_start") - days))
    serves = serves.select("date", "month")
    refs = events.where(F.col("score").isNotNull()).join(F.broadcast(serves), "date").select("month", "event_id", "score", F.lit(1).alias("_ref"))
    own = events.select(F.trunc("date", "month").alias("month"), "event_id", "score", F.lit(0).alias("_ref"))
    u = refs.unionByName(own).where(F.col("score").isNotNull())
    u = running(u, ["month"], ["score", -F.col("_ref"), "event_id"], {"_le": ("sum", "_ref")}, keys=("event_id", "_ref"))
    n = refs.groupBy("month").agg(F.count("*").alias("_n"))
    d = u.where("_ref = 0").join(F.broadcast(n), "month", "left")
    d = d.select("event_id", F.when(F.col("_n") >= least, F.col("_le") / F.nullif("_n", F.lit(0))).alias("pct"))
    return events.join(d, "event_id", "left")


def decay_features(panel: DataFrame, events: DataFrame, lag: int, max_age: int, half_lives: list[int]) -> DataFrame:
    """Age, last score, missing flag and decayed scores; an event is readable ``lag`` positions after its day.

    ``events``: code, pos, s; ``panel``: dense code, date, pos.
    """
    e = keep_one(events.where(F.col("s").isNotNull()), ["code", "pos"], ["s"])
    r = e.select("code", (F.col("pos") + lag).alias("pos"), F.col("pos").alias("_t"), "s")
    d = asof_join(panel, r, on="pos", fields=["_t", "s"])
    age = F.col("pos") - F.col("_t")
    fresh = F.coalesce(age <= max_age, F.lit(False))
    out = {"event_age": F.when(fresh, age).otherwise(max_age + 1).cast("double"), "event_missing": (~fresh).cast("int"),
           "event_score_last": F.when(fresh, F.col("s")).otherwise(0.0)}
    out |= {f"event_decay_{h}": F.when(fresh, F.col("s") * half_life_decay(age, h)).otherwise(0.0) for h in half_lives}
    return d.withColumns(out).drop("_t", "s")


def trailing_quantile(events: DataFrame, lookback: int, q: float, ranges: int = 256) -> DataFrame:
    """``pos, n, cut`` for each event day: number and exact (interpolated) quantile of the scores of the ``lookback`` positions before it.

    Two levels: counts by day and score range, one row for each day and range, tell which range holds the ordinals
    a day asks for; only the scores of those ranges are then laid beside the days, and a place inside its range
    answers. A score is read by ``lookback / ranges`` days on average where ranges are asked evenly.
    """
    have = events.where(F.col("score").isNotNull())
    d = numbered(have.select("event_id", "pos", "score", F.lit(1).alias("_one")), ["_one"], ["score", "event_id"], "_place")
    total = F.broadcast(d.agg(F.count("*").alias("_all")))
    d = materialize(d.join(total).select("event_id", F.col("pos").cast("long").alias("pos"), "score", F.floor(F.col("_place") * ranges / F.col("_all")).cast("int").alias("_range")))
    count = d.groupBy("pos", "_range").agg(F.count("*").alias("_c"))
    held = F.map_from_entries(F.collect_list(F.struct("_range", "_c")))
    grid = count.groupBy("pos").agg(held.alias("_m")).select("pos", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("_range"), "_m")
    grid = grid.select("pos", "_range", F.coalesce(F.try_element_at("_m", F.col("_range")), F.lit(0)).alias("_c"))
    grid = grid.withColumn("_in", F.coalesce(F.sum("_c").over(W.partitionBy("_range").orderBy("pos").rangeBetween(-lookback, -1)), F.lit(0)))
    lower = W.partitionBy("pos").orderBy("_range")
    grid = grid.withColumns({"_upto": F.sum("_in").over(lower), "n": F.sum("_in").over(W.partitionBy("pos"))})
    place = (F.col("n") - 1) * F.lit(float(q))
    asked = F.explode(F.array(F.struct(F.lit(0).alias("_k"), F.floor(place).alias("_o")), F.struct(F.lit(1).alias("_k"), F.ceil(place).alias("_o"))))
    before = F.col("_upto") - F.col("_in")
    want = grid.where("_in > 0").withColumns({"_before": before, "_part": place - F.floor(place)}).select("pos", "n", "_range", "_before", "_in", "_part", asked.alias("_a"))
    want = want.select("pos", "n", "_range", "_part", F.col("_a._k").alias("_k"), (F.col("_a._o") - F.col("_before")).alias("_o"), "_in").where("_o >= 0 and _o < _in").drop("_in")
    # Blocks of positions make the window an equi join: a window touches at most two of them.
    block = lambda p: F.floor(p / lookback)
    near = want.withColumn("_block", F.explode(F.array_distinct(F.array(block(F.col("pos") - lookback), block(F.col("pos") - 1)))))
    near = near.withColumnRenamed("pos", "_day")
    beside = d.withColumn("_block", block(F.col("pos"))).join(near, ["_range", "_block"]).where(F.col("pos").between(F.col("_day") - lookback, F.col("_day") - 1))
    at = F.row_number().over(W.partitionBy("_day", "_k").orderBy("score", "event_id")) - 1
    hit = beside.withColumn("_p", at).where("_p = _o").groupBy(F.col("_day").alias("pos")).agg(
        F.max("n").alias("n"), F.max("_part").alias("_part"), F.max(F.when(F.col("_k") == 0, F.col("score"))).alias("_lo"), F.max(F.when(F.col("_k") == 1, F.col("score"))).alias("_hi"))
    return hit.select("pos", "n", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("cut"))


def trailing_entries(events: DataFrame, lookback: int, q: float, least: int) -> DataFrame:
    """Events at or above the trailing quantile of the scores of the previous ``lookback`` positions, of at least ``least`` scores."""
    cut = trailing_quantile(events, lookback, q).select("pos", F.col("n").alias("_n"), F.col("cut").alias("_cut"))
    d = events.where(F.col("score").isNotNull()).join(F.broadcast(cut), "pos")
    return d.where((F.col("_n") >= least) & (F.col("score") >= F.col("_cut"))).drop("_n", "_cut")


def group_rank_z(df: DataFrame, by: list[str], outs: dict[str, str], keys) -> DataFrame:
    """Percentile rank inside the group, then sample z of the ranks."""
    d = with_ranks(df, by, {f"_r_{o}": c for o, c in outs.items()}, keys=keys)
    stats = {}
    for o in outs:
        stats |= {f"_m_{o}": F.avg(f"_r_{o}"), f"_s_{o}": F.stddev_samp(f"_r_{o}")}
    d = with_stats(d, by, stats)
    return d.withColumns({o: div(F.col(f"_r_{o}") - F.col(f"_m_{o}"), F.col(f"_s_{o}")) for o in outs}).drop(*stats, *[f"_r_{o}" for o in outs])


def event_features(events: DataFrame, types: dict[str, str], fields: list[str], group: str, keys, most_missing: float = 0.01) -> DataFrame:
    """Sample rows of events: a flag ``is_<name>`` for each type, every field as the z of its rank inside (type, ``group``), 0 where it has none.

    A field that has no z in more than ``most_missing`` of all rows also gets a flag ``missing_<field>``; the shares
    are one aggregate over all rows.
    """
    z = {f"_z_{f}": f for f in fields}
    d = materialize(group_rank_z(events, ["type", group], z, keys))
    share = d.agg(*[F.avg(F.col(k).isNull().cast("int")).alias(f) for k, f in z.items()]).first()
    out = {f"is_{name}": F.coalesce(F.col("type") == value, F.lit(False)).cast("int") for name, value in types.items()}
    for k, f in z.items():
        if (share[f] or 0) > most_missing:
            out[f"missing_{f}"] = F.col(k).isNull().cast("int")
        out[f] = F.coalesce(k, F.lit(0.0))
    return d.withColumns(out).drop(*z)


def decile_report(events: DataFrame, score: str, car: str, block: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Mean outcome per within-block decile; spread, Welch t and rank monotonicity."""
    d = events.where(F.col(score).isNotNull() & F.col(car).isNotNull())
    d = position(d, [block], [score, key], "_p", "_n", keys=(key,)).withColumn("decile", decile(F.col("_p"), F.col("_n")).cast("int"))
    g = d.groupBy("decile").agg(F.count("*").alias("n"), F.avg(car).alias("mean_car"), F.var_samp(car).alias("_v"))
    top, low = F.col("decile") == 9, F.col("decile") == 0
    pick = lambda c, x: F.max(F.when(c, F.col(x)))
    spread = pick(top, "mean_car") - pick(low, "mean_car")
    se = F.sqrt(pick(top, "_v") / pick(top, "n") + pick(low, "_v") / pick(low, "n"))
    ranked = order_stats(g.withColumn("_one", F.lit(1)), ["_one"], {"_o_": "mean_car"}, keys=("decile",))
    mono = ranked.select(corr(F.col("_o_less") + (F.col("_o_ties") + 1) / 2.0, "decile").alias("monotonicity"))
    s = g.agg(F.sum("n").alias("events"), spread.alias("top_minus_bottom"), div(spread, se).alias("t_stat"))
    return g.drop("_v"), s.join(F.broadcast(mono))

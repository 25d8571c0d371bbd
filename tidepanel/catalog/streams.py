"""Daily ingest and tick streams, drained once and read back."""

import uuid

from pyspark.sql import functions as F

from tidepanel.catalog.registry import query
from tidepanel.functions.columns import day, r
from tidepanel.operators.grid import calendar
from tidepanel.operators.staging import folder
from tidepanel.streaming import bars as B, dayfeatures as DF, sealed as SE

SCHEMA = "event_date date, code long, observed_at timestamp, value double"
STAGED = """st AS (SELECT CAST(ts AS DATE) AS event_date, user_id AS code, ts + to_minutes(CAST(json_extract(props, '$.k') AS INTEGER)) + CASE WHEN event_id % 31 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END AS observed_at, value, event_id FROM events),
s2 AS (SELECT event_date, code, date_trunc('hour', observed_at) AS observed_at, value FROM st), ok AS (SELECT * FROM s2 WHERE observed_at <= event_date + INTERVAL 26 HOUR),
cf AS (SELECT DISTINCT event_date, code FROM ok GROUP BY event_date, code, observed_at HAVING count(DISTINCT value) > 1),
sealed AS (SELECT event_date, code, max(observed_at) AS observed_at, arg_max(value, observed_at) AS value FROM ok WHERE (event_date, code) NOT IN (SELECT (event_date, code) FROM cf) GROUP BY ALL)"""


def staged(s):
    e = s.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.from_json("props", "k int")["k"]
    late = F.when(F.col("event_id") % 31 == 0, F.expr("interval 3 days")).otherwise(F.expr("interval 0 days"))
    obs = F.date_trunc("hour", F.col("ts") + F.make_dt_interval(mins=k) + late)
    return e.select(F.col("ts").cast("date").alias("event_date"), F.col("user_id").alias("code"), obs.alias("observed_at"), "value")


def _cutoff():
    return F.col("event_date").cast("timestamp") + F.expr("interval 26 hours")


def _store(s) -> SE.SealedStore:
    src = f"{folder(s.spark)}/staged-{uuid.uuid4().hex}"
    staged(s).repartitionByRange(4, "event_date").write.parquet(src)
    store = SE.SealedStore(s.spark)
    store.ingest(src, SCHEMA, _cutoff())
    return store


@query("sealed_ingest", "S1 S2 U5 IO5 D19", f"WITH {STAGED} SELECT strftime(event_date, '%Y-%m-%d') AS event_date, code, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at, value FROM sealed")
def _(s):
    d = _store(s).read(SCHEMA)
    return d.select(day("event_date").alias("event_date"), "code", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("observed_at"), "value")


@query("sealed_asof_read", "S4", f"WITH {STAGED} SELECT strftime(event_date, '%Y-%m-%d') AS event_date, count(*) AS rows, round(sum(value), 4) AS total FROM sealed WHERE event_date <= DATE '2024-01-15' GROUP BY event_date")
def _(s):
    d = _store(s).read(SCHEMA, "2024-01-15")
    return d.groupBy(day("event_date").alias("event_date")).agg(F.count("*").alias("rows"), r(F.sum("value"), 4).alias("total"))


@query("late_rows_refused", "S5 U5", f"WITH {STAGED} SELECT 'late' AS reason, count(*) AS rows FROM s2 WHERE observed_at > event_date + INTERVAL 26 HOUR UNION ALL SELECT 'conflict', count(*) FROM s2 WHERE (event_date, code) IN (SELECT (event_date, code) FROM cf)")
def _(s):
    return _store(s).refused().groupBy("reason").agg(F.count("*").alias("rows"))


@query("sealed_deliveries", "S2 U5", f"""WITH {STAGED}, d AS (SELECT DISTINCT event_date, code FROM s2), h AS (SELECT max(event_date) AS last FROM s2)
SELECT 'stored' AS state, count(*) AS rows, round(sum(value), 4) AS total FROM sealed, h WHERE event_date > last - 20
UNION ALL SELECT 'changed', count(*), round(sum(CASE WHEN day(event_date) % 3 = 0 THEN value + 1 ELSE value END), 4) FROM s2, h WHERE event_date > last - 10 AND day(event_date) % 3 = 0 AND event_date IN (SELECT event_date FROM sealed)
UNION ALL SELECT 'older', count(*), round(sum(value), 4) FROM s2, h WHERE event_date <= last - 20""")
def _(s):
    """Four deliveries to one store: the last twenty days, the last ten again with every third day restated, the same ten unchanged, then the days before."""
    d, store = staged(s), SE.SealedStore(s.spark)
    last = F.broadcast(d.agg(F.max("event_date").alias("_last")))
    d = d.join(last)
    part = lambda ok: d.where(ok).drop("_last")
    recent, ten = F.col("event_date") > F.date_sub("_last", 20), F.col("event_date") > F.date_sub("_last", 10)
    restated = F.when(F.dayofmonth("event_date") % 3 == 0, F.col("value") + 1).otherwise(F.col("value"))
    again = part(ten).withColumn("value", restated)
    deliveries = [part(recent), again, part(ten), part(~recent)]
    for i, rows in enumerate(deliveries):
        store.append(rows, i, _cutoff())
    stored = store.read(SCHEMA).agg(F.lit("stored").alias("state"), F.count("*").alias("rows"), r(F.sum("value"), 4).alias("total"))
    refused = store.refused().where("reason in ('changed', 'older')").select("event_date", "code", "observed_at", "reason")
    days = refused.select("event_date", "reason").distinct()
    sent = again.withColumn("reason", F.lit("changed")).unionByName(deliveries[3].withColumn("reason", F.lit("older")))
    counted = refused.groupBy("reason").agg(F.count("*").alias("rows"))
    totals = sent.join(days, ["event_date", "reason"], "left_semi").groupBy("reason").agg(r(F.sum("value"), 4).alias("total"))
    return stored.unionByName(counted.join(totals, "reason").select(F.col("reason").alias("state"), "rows", "total"))


@query("gap_marking", "S6", """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM days), g AS (SELECT date, pos, date IN (SELECT date FROM days WHERE day(date) % 7 <> 3 AND day(date) <> 11) AS has FROM c)
SELECT strftime(date, '%Y-%m-%d') AS date, CASE WHEN NOT has THEN 'data_gap' WHEN NOT lag(has) OVER (ORDER BY date) AND pos > 0 THEN 'recovery' ELSE 'ok' END AS status FROM g""")
def _(s):
    days = s.table("events").select(F.col("ts").cast("date").alias("date"))
    present = days.where((F.dayofmonth("date") % 7 != 3) & (F.dayofmonth("date") != 11))
    return SE.gap_status(calendar(days), present).select(day("date").alias("date"), "status")


@query("stream_bars", "S3 P12", """SELECT user_id AS code, strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS bar, round(arg_min(value, (ts, event_id)) + 1, 4) AS open, round(arg_max(value, (ts, event_id)) + 1, 4) AS close, count(*)::DOUBLE AS volume FROM events
GROUP BY ALL HAVING time_bucket(INTERVAL 30 MINUTE, any_value(ts)) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def _(s):
    root = f"{folder(s.spark)}/bars-{uuid.uuid4().hex}"
    ev = s.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    ev.repartitionByRange(4, "ts").write.parquet(f"{root}/in")
    src = s.spark.readStream.schema(ev.schema).parquet(f"{root}/in")
    B.run_bars(src, "30 minutes", "1 day", f"{root}/out", f"{root}/cp")
    d = s.spark.read.schema("code long, date date, bar timestamp, open double, close double, volume double").parquet(f"{root}/out")
    return d.select("code", F.date_format("bar", "yyyy-MM-dd HH:mm:ss").alias("bar"), r("open", 4).alias("open"), r("close", 4).alias("close"), "volume")


@query("stream_alerts", "S7 N-F12", """SELECT sha256('spike|' || user_id || '|' || strftime(ts, '%Y-%m-%d')) AS alert_id FROM events WHERE value > 30 AND event_type <> 'error' GROUP BY 1""")
def _(s):
    root = f"{folder(s.spark)}/alerts-{uuid.uuid4().hex}"
    ev = s.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value", "event_type")
    ev.repartitionByRange(3, "ts").write.parquet(f"{root}/in")
    src = s.spark.readStream.schema(ev.schema).parquet(f"{root}/in").where("value > 30 and event_type <> 'error'")
    src = src.select(F.sha2(F.concat_ws("|", F.lit("spike"), F.col("user_id").cast("string"), day("ts")), 256).alias("alert_id"), "ts")
    SE.insert_alerts(src, f"{root}/out", f"{root}/cp", "ts", "2 days")
    return s.spark.read.parquet(f"{root}/out").select("alert_id")


@query("stream_day_features", "S3 P12", """WITH b AS (SELECT user_id AS code, CAST(ts AS DATE) AS date, time_bucket(INTERVAL 30 MINUTE, ts) AS bar, arg_min(value, (ts, event_id)) + 1 AS open, arg_max(value, (ts, event_id)) + 1 AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL),
c AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY code, date) AS n, lag(close) OVER w AS prev, first(open) OVER w AS o, first(close) OVER w AS fc FROM b WINDOW w AS (PARTITION BY code, date ORDER BY bar)),
d AS (SELECT *, coalesce(close / nullif(prev, 0) - 1, fc / nullif(o, 0) - 1) AS r FROM c WHERE date + 1 < (SELECT max(ts) - INTERVAL 1 DAY FROM events))
SELECT code, strftime(date, '%Y-%m-%d') AS date, round(sqrt(sum(r * r)), 6) AS rv, round(sum(CASE WHEN i > n - 2 THEN volume ELSE 0 END) / nullif(sum(volume), 0), 6) AS tail_share,
 round(max(CASE WHEN i = least(2, n) THEN close END) / max(o) - 1, 6) AS open_ret, round(sum(CASE WHEN r > 0 THEN volume ELSE 0 END) / nullif(sum(volume), 0), 6) AS up_share, count(*) AS bars FROM d GROUP BY code, date HAVING count(*) >= 2""")
def _(s):
    """The stream stops in the middle of the events and is started again on its checkpoint."""
    root = f"{folder(s.spark)}/days-{uuid.uuid4().hex}"
    ev = s.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    half = ev.agg(F.expr("timestamp_micros(cast(avg(unix_micros(ts)) as bigint))").alias("half"))
    parts = ev.join(F.broadcast(half)).withColumn("later", F.col("ts") > F.col("half")).drop("half")
    setting = {"width": "30 minutes", "delay": "1 day", "per_day": 3, "edge": 2}
    for later in (False, True):
        parts.where(F.col("later") == later).drop("later").repartitionByRange(3, "ts").write.mode("append").parquet(f"{root}/in")
        DF.run_day_features(s.spark.readStream.schema(ev.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/cp", **setting)
    d = s.spark.read.schema(DF.OUT).parquet(f"{root}/out")
    return d.select("code", day("date").alias("date"), *[r(c).alias(c) for c in ("rv", "tail_share", "open_ret", "up_share")], "bars")

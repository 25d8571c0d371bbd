"""Named queries over the sample tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidepanel.sources.adapters import Stage


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    build: Callable[[Stage], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None):
    def add(fn):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, tuple(ids.split()), fn, sql)
        return fn

    return add


def run(name: str, spark: SparkSession, path: str) -> DataFrame:
    return ENTRIES[name].build(Stage(spark, path))


LINES = """lines AS (SELECT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  CAST(floor(l_extendedprice / l_quantity * 10000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS px, day(l_shipdate) AS dom, l_quantity AS q,
  CAST(floor(l_extendedprice * (1 - l_discount) * 10000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS amt FROM lineitem),
bars AS (SELECT code, date, CAST(sum(px) FILTER (WHERE dom <= 15) AS DOUBLE) / 10000.0::DOUBLE / nullif(count(px) FILTER (WHERE dom <= 15), 0) * 0.13876543219::DOUBLE AS open,
  CAST(max(px) AS DOUBLE) / 10000.0::DOUBLE * 0.13876543219::DOUBLE AS high, CAST(min(px) AS DOUBLE) / 10000.0::DOUBLE * 0.13876543219::DOUBLE AS low,
  CAST(sum(px) AS DOUBLE) / 10000.0::DOUBLE / count(px) * 0.13876543219::DOUBLE AS close, CAST(sum(amt) AS DOUBLE) / 10000.0::DOUBLE / sum(q) * 0.13876543219::DOUBLE AS vwap,
  sum(q) AS volume, CAST(sum(amt) AS DOUBLE) / 10000.0::DOUBLE * 0.13876543219::DOUBLE AS amount, count(px) AS n_lines
  FROM lines GROUP BY code, date),
cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT date FROM lines)),
suppliers AS (SELECT s_suppkey AS code, s_nationkey AS grp, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey),
panel AS (SELECT b.*, cal.pos, s.grp, s.region, volume / sum(volume) OVER (PARTITION BY b.date) AS turnover, amount AS circ_mv,
  close / (500 + b.code * 7919 % 700) AS pb_mrq, close / nullif(CAST(b.code * 31 % 97 - 10 AS DOUBLE), 0) AS pe_ttm
  FROM bars b JOIN cal USING (date) JOIN suppliers s USING (code))"""

DENSE = LINES + """,
dense0 AS (SELECT c.code, cal.date, cal.pos, s.grp, s.region, p.open, p.high, p.low, p.close, p.vwap, p.volume, p.amount, p.n_lines,
  p.turnover, p.circ_mv, p.pb_mrq, p.pe_ttm,
  coalesce(p.n_lines >= 2 AND p.open IS NOT NULL, FALSE) AS buyable, coalesce(p.n_lines >= 3, FALSE) AS in_universe
  FROM (SELECT DISTINCT code FROM bars) c CROSS JOIN cal JOIN suppliers s ON s.code = c.code
  LEFT JOIN panel p ON p.code = c.code AND p.date = cal.date),
dense AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY pos) - 1 AS ret_1d FROM dense0)"""

LABELLED = DENSE + """,
labelled AS (SELECT *, """ + ", ".join(
    f"CASE WHEN lead(buyable) OVER w THEN lead(open, {1 + h}) OVER w / lead(open) OVER w - 1 END AS label_{h}"
    for h in (1, 3, 6)) + """ FROM dense WINDOW w AS (PARTITION BY code ORDER BY pos))"""


def lines(body: str) -> str:
    return f"WITH {LINES}{body}"


def dense(body: str) -> str:
    return f"WITH {DENSE}{body}"


def labelled(body: str) -> str:
    return f"WITH {LABELLED}{body}"

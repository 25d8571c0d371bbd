"""SQL of the look-alike tables."""

MARKS = """, marks AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS pub_date, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL)"""

MARGIN = """, margin AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(24,4))) AS DOUBLE) AS fin,
 CAST(sum(CAST(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END AS DECIMAL(24,4))) AS DOUBLE) AS fin_buy,
 CAST(sum(CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS DECIMAL(24,4))) AS DOUBLE) AS fin_refund,
 CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(24,4))) AS DOUBLE) AS sec FROM lineitem GROUP BY ALL)"""

INDUSTRY = """, ind0 AS (SELECT DISTINCT l_suppkey AS code, year(l_shipdate) AS y FROM lineitem WHERE (l_suppkey + year(l_shipdate)) % 2 = 0),
ind1 AS (SELECT code, y, make_date(y, 1, 1) + ((code * 31 + y * 17) % 300)::INT AS effective_date FROM ind0),
industry_hist AS (SELECT code, effective_date, effective_date + ((code * 7 + y * 13) % 500 - 100)::INT AS updated_at, 'I' || ((code + y) % 7) AS l1, 'J' || ((code * 3 + y) % 13) AS l2 FROM ind1)"""

SPLITS = """, splits AS (SELECT code, make_date(y, (1 + (code + y) % 12)::INT, 15) AS ex_date, (10 + (code * 3 + y) % 5 + (y - 1994) * 2) / 10.0::DOUBLE AS factor
 FROM (SELECT DISTINCT l_suppkey AS code, year(l_shipdate) AS y FROM lineitem) WHERE (code + y) % 3 = 0)"""

MEMBERS = """, members AS (SELECT date AS snapshot_date, code, CASE WHEN volume >= 200 THEN 'big' WHEN volume >= 120 THEN 'mid' END AS index FROM panel WHERE pos % 2 = 0 AND volume >= 120)"""

_net = lambda c: f"CAST(sum(CAST(CASE WHEN {c} THEN l_extendedprice ELSE -l_extendedprice END AS DECIMAL(24,4))) AS DOUBLE)"
FLOWS = f""", flows AS (SELECT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, {_net("l_returnflag = 'A'")} AS main, {_net("l_returnflag = 'N'")} AS jumbo,
 {_net("l_linestatus = 'O'")} AS block, {_net('l_quantity > 25')} AS mid, {_net('l_tax > 0.04::DOUBLE')} AS small FROM lineitem GROUP BY ALL)"""

STATEMENTS = """q0 AS (SELECT o_custkey AS code, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS qs, CAST(sum(CAST(o_totalprice AS DECIMAL(24,4))) AS DOUBLE) AS rev FROM orders GROUP BY ALL),
q1 AS (SELECT code AS k, rev, year(qs) * 4 + quarter(qs) AS q, CAST(qs + INTERVAL 3 MONTH AS DATE) - 1 AS stat_date FROM q0),
income AS (SELECT k AS code, stat_date, stat_date + (20 + (k * 13 + q * 7) % 90)::INT AS pub_income, rev, rev * ((k * 7 + q * 3) % 11 * 2 - 6) / 100 AS profit, rev * (20 + (k + q) % 30) / 100 AS gross FROM q1),
balance AS (SELECT *, total_equity * 95 / 100 AS equity, total_equity * ((code * 5 + q) % 9) / 10 AS goodwill, liab * ((code * 2 + q) % 4) / 10 AS loan FROM (
 SELECT k AS code, q, stat_date, stat_date + (25 + (k * 11 + q * 5) % 90)::INT AS pub_balance, rev * (40 + k % 7 * 10) / 100 AS liab, rev * (60 + k % 5 * 10) / 100 AS total_equity,
 rev * ((k + q) % 6) / 10 AS receivable, rev * ((k * 3 + q) % 8) / 10 AS inventory, rev * ((k + q * 2) % 5) / 10 AS cash, rev * ((k * 11 + q * 5) % 7) / 50 AS prepaid, rev * ((k * 17 + q) % 9) / 90 AS other_receivable
 FROM q1 WHERE (k + q) % 17 <> 0)),
cash AS (SELECT k AS code, stat_date, stat_date + (22 + (k * 17 + q * 3) % 90)::INT AS pub_cash, rev * ((k * 5 + q * 11) % 7 * 10 - 25) / 100 AS ocf FROM q1 WHERE (k * 3 + q) % 19 <> 0)"""

PUBLICATIONS = STATEMENTS + """, i0 AS (SELECT code, stat_date, pub_income AS pub_date, rev AS value FROM income),
publications AS (SELECT * FROM i0 WHERE (code + year(stat_date)) % 7 <> 0 UNION ALL SELECT code, stat_date, pub_date + 60, value * 2 FROM i0 WHERE (code + month(stat_date)) % 5 = 0
 UNION ALL SELECT code, stat_date, pub_date + 400, value FROM i0 WHERE (code + year(stat_date)) % 7 = 0)"""

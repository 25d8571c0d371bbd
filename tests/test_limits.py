"""Limit check against a loop over accounts and against its SQL twin; every global name that a function reads exists."""

import builtins
import dis
import importlib
import os
import pkgutil
import sys
from types import CodeType

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
import tidepanel  # noqa: E402
from compare import TABLES, compare  # noqa: E402
from tidepanel.plans import book as B  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_limit_check_matches_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = E.queries()["limit_check"](spark, DATA).toPandas()
    res = compare(got, con.execute(E.oracle_sql()["limit_check"]).df())
    assert res.startswith("ok"), res


def test_cash_is_granted_in_order_of_codes(spark):
    """Account 1 asks for 900, 900 and 400 with 1,000 in cash; the one in want of nothing between them holds.  Account 2 has no cash."""
    rows = [(1, c, 100.0, "unknown", None, t, 1000.0) for c, t in ((3, 0.5), (1, 0.5), (2, None), (4, 0.3))] + [(2, 1, 50.0, "unknown", None, 0.9, 0.0), (2, 2, 50.0, "unknown", None, None, 0.0)]
    d = spark.createDataFrame(rows, "account int, code int, value double, industry string, cap double, target double, cash double")
    got = {(r.account, r.code): (r.action, round(r.add_value, 6)) for r in B.limit_check(d, 0.9, 0.9, 0.02).collect()}
    want, total = {}, 1400.0
    left = 1000.0
    for code, target in ((1, 0.5), (2, None), (3, 0.5), (4, 0.3)):
        add = min(left, (target - 100 / total) * total) if target else 0.0
        left -= add
        want[1, code] = ("add" if add > 0 else "hold", round(add, 6))
    assert got == want | {(2, 1): ("hold", 0.0), (2, 2): ("hold", 0.0)}


def _codes(code: CodeType):
    yield code
    for c in code.co_consts:
        if isinstance(c, CodeType):
            yield from _codes(c)


def test_global_names_exist():
    """A name that is read only when its query runs is not found by importing the module."""
    missing = []
    for m in pkgutil.walk_packages(tidepanel.__path__, "tidepanel."):
        module = importlib.import_module(m.name)
        with open(module.__file__, encoding="utf-8") as f:
            code = compile(f.read(), module.__file__, "exec")
        known = {*vars(module), *vars(builtins), *(n for c in _codes(code) for n in _stored(c))}
        missing += [(m.name, i.argval) for c in _codes(code) for i in dis.get_instructions(c) if i.opname == "LOAD_GLOBAL" and i.argval not in known]
    assert not missing


def _stored(code: CodeType):
    return [i.argval for i in dis.get_instructions(code) if i.opname == "STORE_GLOBAL"]

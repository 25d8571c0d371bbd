"""Report text rule, one case at a time."""

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import reporttext as RT

CASES = {
    "公司公告。预计2010-2012年EPS分别为1.10/1.20/1.30元（原值9.99元），对应PE为15倍": [(2010, 1.1), (2011, 1.2), (2012, 1.3)],
    "预计2010、2011年每股收益0.5、0.6元": [(2010, 0.5), (2011, 0.6)],
    "预计10-12年实现1.1/1.2/1.3元EPS": [(2010, 1.1), (2011, 1.2), (2012, 1.3)],
    "上半年实现每股收益0.30元。我们预测公司2013年EPS为0.80元": [(2013, 0.8)],
    "报告期基本每股收益为0.30元，维持2013年判断": None,
    "预计公司2011-2013年营收增长。看好公司，EPS分别为1.0、1.1、1.2元": [(2011, 1.0), (2012, 1.1), (2013, 1.2)],
    "分业务预计2010年EPS为1元": None,
    "预计2010-2012年EPS分别为1.10/1.20元": None,
    "预计2010年EPS为900元": None,
    "预计2023-2025年营收增长，其中2024、2025年提速，EPS分别为1.0/1.1/1.2元": [(2023, 1.0), (2024, 1.1), (2025, 1.2)],
    "预计2023-2029年增长，2024和2025年EPS分别为1.1/1.2元": [(2024, 1.1), (2025, 1.2)],
    "预计15年EPS为2016年0.50元": [(2015, 0.5)],
    "预计EPS分别为0.50元": None,
    "给予买入评级": None,
    "": None,
}


@pytest.mark.parametrize("text", CASES)
def test_forecasts(spark, text):
    d = spark.createDataFrame([(text,)], "b string").select(RT.eps_forecasts(F.col("b")).alias("f")).first().f
    assert (d and [(x.fiscal_year, x.eps) for x in d.forecasts]) == CASES[text]


def test_codes(spark):
    rows = [("sh.600000", "【甲】某(600001)点评", None, "x", "sh.600001"), ("sh600000", "【甲】点评", None, "x", "sh.600000"), ("sh600000", "某(600001)与(600002)", None, "x", None),
            ("sh600000", "某(600001)", "某(300001)", "x", None), ("sh600000", "点评", None, "某(300001)公司", None), ("sz.000001", "点评", None, "某(000001)公司", "sz.000001"), ("hk00700", "点评", None, "x", None)]
    d = spark.createDataFrame([r[:4] for r in rows], "code string, title string, detail string, body string")
    assert [r.c for r in d.select(RT.report_code(*map(F.col, d.columns)).alias("c")).collect()] == [r[4] for r in rows]


RATINGS = {
    "目标价三十元每股，买入（首次覆盖，下同）的评级。": "买入",
    "给予公司二零一二年二十五倍市盈率并考虑其行业地位后，推荐": None,
    "给予公司明年二十五倍市盈率并考虑其行业地位后，推荐": "推荐",
    "上调至强烈推荐。此前为中性，之后再无别的说法，公司经营正常且没有变化，特此说明": "中性",
    "维持有": "持有",
    "买入一词在此只是用语": None,
    "建议回避\n的评级": "回避",
    None: None,
}


@pytest.mark.parametrize("text", RATINGS)
def test_ratings(spark, text):
    d = spark.createDataFrame([(text,)], "b string")
    assert d.select(RT.rating_phrase(F.col("b")).alias("w")).first().w == RATINGS[text]


def test_stated_rating_and_titles(spark):
    rows = [("给予买入评级", "卖出", "【甲证券】x", "买入", True), ("无", "卖出", "x", "卖出", True), ("无", "其他", "【某日报】x", None, False), (None, None, None, None, True)]
    d = spark.createDataFrame([r[:3] for r in rows], "b string, s string, t string")
    got = d.select(RT.rating(F.col("b"), F.col("s")).alias("w"), RT.accepted_title(F.col("t")).alias("ok")).collect()
    assert [(g.w, g.ok) for g in got] == [r[3:] for r in rows]


def test_a_sentence_is_read_once(spark):
    """Years and values of a sentence are named in several places of the result and computed in one."""
    plan = spark.createDataFrame([("",)], "b string").select(RT.eps_forecasts(F.col("b")).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(RT.YEAR_LIST) == 1 and plan.count(RT.VALUES_BEFORE_KEY) == 1


def test_broker_export_of_high_part_numbers(spark, tmp_path):
    """Part numbers past 99,999 give security numbers of seven hundred thousand and more; their market stays the export's."""
    from tidepanel.catalog import load, registry

    load()
    rows = [(50, 2.0, 8.0), (99_999, 1.0, 3.0), (120_001, 3.0, 6.0), (399_999, 1.0, 7.0)]
    spark.createDataFrame(rows, "l_partkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.code: r.quantity for r in registry.run("broker_export", spark, str(tmp_path)).collect()}
    assert got == {"CASH": 2.0, "sh.699999": 1.0, "sh.720001": 3.0, "sh.999999": 1.0}

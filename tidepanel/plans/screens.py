"""Statement red flags, title classes, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.columns import growth, ratio_pos
from tidepanel.operators.joins import keep_one
from tidepanel.operators.ordering import order_stats
from tidepanel.operators.staging import materialize

# Rules and the tail that is suspicious; percentile limits; peer minimum.
RULES = {"receivables_growth": "high", "inventory_growth": "high", "cash_profit": "low", "accruals": "high", "goodwill": "high",
         "other_receivables": "high", "prepayments": "high", "cash_debt": "high", "gross_margin": "high"}
AMBER, RED, MIN_PEERS = 0.90, 0.97, 15

# Title classes in order of precedence, and their importance.
TAXONOMY = {
    "convertible_redemption": "可转债.*(强赎|赎回|有条件赎回)",
    "convertible_revision": "可转债.*(下修|向下修正)|向下修正.*转股价格",
    "regulatory_penalty": "行政处罚|监管措施|纪律处分|立案调查",
    "regulatory_inquiry": "问询函|关注函|监管函|回复.*问询",
    "audit_opinion": "审计意见|非标准.*审计|保留意见|无法表示意见|否定意见",
    "auditor_change": "变更.*会计师|改聘.*会计师|续聘.*会计师",
    "earnings_guidance": "业绩预告|业绩预增|业绩预亏|业绩修正",
    "repurchase": "回购.*(股份|股票)|股份回购|股票回购",
    "shareholding_change": "增持|减持|持股变动|权益变动",
    "litigation": "诉讼|仲裁",
    "annual_report": "年度报告|年报",
    "semiannual_report": "半年度报告|半年报",
    "quarterly_report": "季度报告|一季报|三季报",
    "convertible_other": "可转债|可转换公司债",
    "material_event": "重大事项|重大合同|重大资产重组|收购|合并",
    "equity_change": "股权变动|股权转让|股权激励",
}
HIGH = ("convertible_redemption", "regulatory_penalty", "audit_opinion", "litigation")
EXTRACT = ("earnings_guidance", "repurchase", "shareholding_change", "convertible_revision", "convertible_redemption",
           "regulatory_inquiry", "regulatory_penalty", "litigation", "audit_opinion", "auditor_change")
MEDIUM = (*EXTRACT, "material_event", "annual_report", "semiannual_report")


def classify_title(title: Column) -> Column:
    """First matching class of a title without its markup."""
    clean = F.regexp_replace(title, "<[^>]+>", "")
    out = None
    for name, pattern in TAXONOMY.items():
        hit = clean.rlike("(?i)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def importance(kind: Column) -> Column:
    return F.when(kind.isin(*HIGH), "high").when(kind.isin(*MEDIUM), "medium").otherwise("low")


def keyword_events(df: DataFrame, text: str, include: str, also: str | None, exclude: str, keys: list[str], order: str) -> DataFrame:
    """Rows matching the patterns and not the exclusion, one per key."""
    hit = F.col(text).rlike(include) & ~F.col(text).rlike(exclude)
    if also:
        hit = hit & F.col(text).rlike(also)
    return keep_one(df.where(hit), keys, [order], last=False)


def red_flag_values(income: DataFrame, balance: DataFrame, cash: DataFrame, asof: str) -> DataFrame:
    """Rule values at the latest period present in all three statements, with last year's for growth.

    Only statements published before ``asof``; the latest publication of a period wins.
    """
    day = F.lit(asof).cast("date")

    def known(df, pub):
        return keep_one(df.where((F.col(pub) < day) & (F.col("stat_date") < day)), ["code", "stat_date"], [pub])

    i, b, c = known(income, "pub_income"), known(balance, "pub_balance"), known(cash, "pub_cash")
    k = ["code", "stat_date"]
    now = i.join(b, k).join(c, k)
    now = keep_one(now, ["code"], ["stat_date"])
    pi = i.select("code", F.add_months("stat_date", 12).alias("stat_date"), F.col("rev").alias("p_rev"))
    pb = b.select("code", F.add_months("stat_date", 12).alias("stat_date"), F.col("receivable").alias("p_rec"), F.col("inventory").alias("p_inv"), F.col("prepaid").alias("p_pre"))
    d = now.join(pi, k, "left").join(pb, k, "left")
    v = F.col
    assets = v("liab") + v("total_equity")
    rg = growth("rev", "p_rev")
    vals = {
        "receivables_growth": growth("receivable", "p_rec") - rg, "inventory_growth": growth("inventory", "p_inv") - rg, "cash_profit": ratio_pos("ocf", "profit"),
        "accruals": ratio_pos(v("profit") - v("ocf"), assets), "goodwill": ratio_pos("goodwill", "equity"), "other_receivables": ratio_pos("other_receivable", assets),
        "prepayments": growth("prepaid", "p_pre"), "cash_debt": F.when(assets > 0, F.least(v("loan") / assets, v("cash") / assets)), "gross_margin": ratio_pos("gross", "rev")}
    hist = i.join(c, k).select("code", "stat_date", ((v("profit") > 0) & (v("ocf") < 0)).alias("bad"))
    bad = hist.where("bad").select("code", F.col("stat_date").alias("_d"))
    years = F.array(F.col("stat_date"), F.add_months("stat_date", -12), F.add_months("stat_date", -24))
    three = now.select("code", F.explode(years).alias("_d")).join(bad, ["code", "_d"]).groupBy("code").agg(F.count("*").alias("_n")).where("_n = 3")
    d = d.join(three.select("code", F.lit(True).alias("cash_three")), "code", "left")
    out = d.withColumns({f"v_{n}": x for n, x in vals.items()})
    hard = F.coalesce(v("v_goodwill") > 0.5, F.lit(False)) | F.coalesce("cash_three", F.lit(False))
    return out.select("code", "stat_date", *[v(f"v_{n}").alias(n) for n in RULES], hard.alias("hard"))


def peer_levels(values: DataFrame, peer: str) -> DataFrame:
    """Mid-rank tail percentile per rule within the peer group, or all names when the group is thin: long rows."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(d == "low").alias("low"), F.col(n).alias("value")) for n, d in RULES.items()]))
    long = materialize(values.select("code", peer, rows.alias("_r")).select("code", peer, "_r.*").where("value is not null"))
    d = order_stats(long, ["rule"], {"_u": "value"}, write=False)
    d = order_stats(d, ["rule", peer], {"_g": "value"})
    mid = lambda p: (F.col(f"{p}less") + F.col(f"{p}ties") / 2.0) / F.col(f"{p}n")
    own = F.col("_gn") >= MIN_PEERS
    pct = F.when(own, mid("_g")).otherwise(mid("_u"))
    pct = F.when(F.col("low"), 1 - pct).otherwise(pct)
    d = d.withColumns({"percentile": pct, "peers": F.when(own, F.col("_gn")).otherwise(F.col("_un"))})
    level = F.when(F.col("percentile") >= RED, "red").when(F.col("percentile") >= AMBER, "amber").otherwise("none")
    return d.select("code", peer, "rule", "value", "percentile", "peers", level.alias("level"))


def overall_level(levels: DataFrame, values: DataFrame, skipped: Column) -> DataFrame:
    """Level per code from rule counts and hard conditions; skipped sectors stay unavailable."""
    n = levels.groupBy("code").agg(F.count(F.when(F.col("level") == "red", 1)).alias("reds"), F.count(F.when(F.col("level") == "amber", 1)).alias("ambers"))
    d = values.join(n, "code", "left").fillna(0, ["reds", "ambers"])
    red = F.col("hard") | (F.col("reds") >= 2) | ((F.col("reds") >= 1) & (F.col("ambers") >= 2))
    amber = (F.col("reds") >= 1) | (F.col("ambers") >= 2)
    return d.withColumn("level", F.when(skipped, "unavailable").when(red, "red").when(amber, "amber").otherwise("none"))


def alert_rows(df: DataFrame, kind: str, severity: Column, subject: Column, version: Column) -> DataFrame:
    """Alert rows with an id that is a function of what they say."""
    return df.select(F.sha2(F.concat_ws("|", F.lit(kind), subject.cast("string"), version.cast("string")), 256).alias("alert_id"),
                     F.lit(kind).alias("kind"), severity.alias("severity"), subject.cast("string").alias("subject"))


def new_alerts(alerts: DataFrame, stored: DataFrame) -> DataFrame:
    """Insert-if-absent: one row per id that is not stored yet."""
    return keep_one(alerts, ["alert_id"], ["kind"]).join(stored.select("alert_id"), "alert_id", "left_anti")

"""Campaign attribution and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.functions.scalars import join_reasons, touch_credits
from tempaudit.operators.opslog import one_row

UPLOAD, SUCCESS, DOWNLOAD, PURCHASE = "upload_csv", "compile_success", "download_pdf", "purchase"


def touches(actions: DataFrame) -> DataFrame:
    """First and last touch of each user, by partial aggregates."""
    rank, touch = F.struct("us", "seq"), F.struct("source", "medium", "campaign")
    return actions.groupBy("user_id").agg(
        F.min_by(touch, rank).alias("first"), F.max_by(touch, rank).alias("last"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.max_by("referral", F.when(F.col("referral").isNotNull(), rank)).alias("referral"))


def attributed_revenue(actions: DataFrame, touched: DataFrame) -> DataFrame:
    """Revenue per touch.  Revenue is summed per user before the split, so each user sends few rows."""
    revenue = actions.groupBy("user_id").agg(F.sum("revenue").alias("revenue"))
    key = lambda t: F.concat_ws("_", f"{t}.source", f"{t}.campaign")
    split = revenue.join(touched, "user_id").select(F.explode(
        touch_credits(key("first"), key("last"), F.col("referral"), F.col("revenue"))).alias("c"))
    return split.groupBy("c.touch").agg(F.sum("c.credit").alias("credit"))


def _n(action: str) -> Column:
    return F.count_if(F.col("action") == action)


def daily_campaigns(actions: DataFrame, attributed_users: DataFrame, since_us: Column) -> DataFrame:
    """Daily visitors, sessions, conversions and revenue by source, medium and campaign."""
    recent = actions.filter(F.col("us") >= since_us).join(attributed_users.select("user_id"), "user_id", "left_semi")
    visitors = F.count_distinct("user_id")
    revenue = F.sum(F.when(F.col("action") == PURCHASE, F.col("revenue")).otherwise(0.0))
    return recent.groupBy(F.to_date(F.timestamp_micros("us")).alias("day"), "source", "medium", "campaign").agg(
        visitors.alias("unique_visitors"), F.count(F.lit(1)).alias("total_sessions"), _n(UPLOAD).alias("uploads"),
        _n(SUCCESS).alias("successes"), _n(DOWNLOAD).alias("downloads"), revenue.alias("revenue"), _n(PURCHASE).alias("purchases"),
        F.round(_n(UPLOAD) * 100.0 / visitors, 2).alias("upload_cvr"),
        F.round(_n(PURCHASE) * 100.0 / F.nullif(_n(UPLOAD), F.lit(0)), 2).alias("purchase_cvr"))


def weekly_report(daily: DataFrame, spend: DataFrame, since: Column, source="google", medium="cpc") -> DataFrame:
    """Campaigns over the last days with spend, return and cost per upload."""
    mine = daily.filter((F.col("day") >= since) & (F.col("source") == source) & (F.col("medium") == medium))
    per = mine.groupBy("campaign").agg(
        F.sum("uploads").alias("uploads"), F.sum("revenue").alias("revenue"), F.avg("upload_cvr").alias("mean_cvr"))
    cost = spend.filter(F.col("day") >= since).groupBy("campaign").agg(F.sum("ad_spend").alias("spend"), F.sum("clicks").alias("clicks"))
    return per.join(cost, "campaign").withColumns({
        "roas": F.col("revenue") / F.nullif("spend", F.lit(0.0)),
        "cpa": F.when(F.col("uploads") > 0, F.col("spend") / F.col("uploads")).otherwise(0.0)})


def weekly_kpis(actions: DataFrame, spend: DataFrame, since_us: Column) -> DataFrame:
    """One row of key figures.  Actions and spend are reduced by campaign before they meet."""
    recent = actions.filter(F.col("us") >= since_us)
    cost = spend.groupBy("campaign").agg(F.sum("ad_spend").alias("spend"))
    seen = recent.join(cost.select("campaign"), "campaign", "left_semi")
    acts = seen.agg(
        F.count_distinct("user_id").alias("visitors"), _n(UPLOAD).alias("uploads"),
        F.sum(F.when(F.col("action") == PURCHASE, F.col("revenue")).otherwise(0.0)).alias("revenue"))
    money = cost.join(seen.select("campaign").distinct(), "campaign", "left_semi").agg(F.sum("spend").alias("spend"))
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return one_row(acts, money).withColumns({
        "cpa": ratio("spend", "uploads"), "roas": ratio("revenue", "spend"), "upload_cvr": ratio("uploads", "visitors") * 100})


def kpi_alerts(kpis: DataFrame, max_cpa=15.0, min_cvr=10.0, min_spend=8.0) -> DataFrame:
    """One row per alert raised."""
    alerts = join_reasons(F.when(F.col("cpa") > max_cpa, F.lit("HIGH_CPA")), F.when(F.col("upload_cvr") < min_cvr, F.lit("LOW_CVR")),
                          F.when(F.col("spend") < min_spend, F.lit("UNDER_SPEND")))
    return kpis.withColumn("alert", F.explode(alerts))


def spend_by_action(actions: DataFrame, spend: DataFrame) -> DataFrame:
    """Actions next to their campaign's spend.  The many actions of a campaign are counted first."""
    counts = actions.groupBy("campaign", "action").agg(F.count(F.lit(1)).alias("actions"))
    return counts.join(spend.groupBy("campaign").agg(F.sum("ad_spend").alias("spend")), "campaign")

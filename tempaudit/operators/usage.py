"""Users, plans, quotas, jobs and sign-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempaudit.functions.clock import month_key, next_reset
from tempaudit.operators.timeline import Timeline, keyed_join, position, prev, range_sums

DAY_US = 86_400_000_000
DEFAULT_QUOTA = 5

# fixed values: throw-away mail domains
THROWAWAY = ("tempmail.com", "guerrillamail.com", "mailinator.com", "10minutemail.com", "throwaway.email", "yopmail.com",
             "temp-mail.org", "fakeinbox.com", "trashmail.com")


# -- plans and usage ---------------------------------------------------------------------------


def current_plan(users: DataFrame, subscriptions: DataFrame, plans: DataFrame, free="free") -> DataFrame:
    """Plan of each user: the newest active subscription's, else the free one."""
    newest = subscriptions.filter(F.col("active")).groupBy("user_id").agg(
        F.max_by("plan", F.struct("created_us", "subscription_id")).alias("_plan"))
    named = users.join(newest, "user_id", "left").withColumn("plan", F.coalesce("_plan", F.lit(free))).drop("_plan")
    # the plan table is a dimension of a few rows
    base = plans.filter(F.col("plan") == free).select("quota").first()
    joined = named.join(F.broadcast(plans.select("plan", "quota")), "plan", "left")
    return joined.withColumn("quota", F.coalesce("quota", F.lit(base["quota"] if base else DEFAULT_QUOTA)))


def monthly_usage(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("user_id", month_key(F.col("created")).alias("month")).agg(F.count(F.lit(1)).alias("used"))


def usage_with_counter(users: DataFrame, usage: DataFrame, month: str) -> DataFrame:
    """A user's counter for one month, 0 without a row."""
    mine = usage.filter(F.col("month") == month)
    return users.join(mine, "user_id", "left").select(
        "user_id", F.lit(month).alias("month"), F.coalesce("used", F.lit(0).cast("long")).alias("used"))


def quota_status(df: DataFrame) -> DataFrame:
    """Remaining quota, overage and admission from ``used``, ``quota`` (-1 unlimited), ``overage_price``."""
    unlimited = F.col("quota") < 0
    over = ~unlimited & (F.col("used") >= F.col("quota"))
    paid = F.coalesce(F.col("overage_price") > 0, F.lit(False))
    return df.withColumns({
        "is_unlimited": unlimited,
        "remaining": F.when(~unlimited, F.greatest(F.col("quota") - F.col("used"), F.lit(0))),
        "overage": F.when(unlimited, 0).otherwise(F.greatest(F.col("used") - F.col("quota"), F.lit(0))),
        "allowed": ~over | paid,
        "code": F.when(~over | paid, "OK").when(F.col("plan") == "free", "FREE_TIER_EXCEEDED").otherwise("MONTHLY_QUOTA_EXCEEDED"),
    })


def dashboard(status: DataFrame, recent: DataFrame, today: Column) -> DataFrame:
    """Quota status with the number of recent jobs and the next reset."""
    counts = recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("recent_jobs"))
    return status.join(counts, "user_id", "left").withColumns({
        "recent_jobs": F.coalesce("recent_jobs", F.lit(0).cast("long")), "resets_on": next_reset(today)})


def overage_events(jobs: DataFrame, limits: DataFrame) -> DataFrame:
    """Jobs beyond the monthly limit, by their position in the user's month."""
    keyed = keyed_join(jobs, limits, "user_id", ["us", "seq"]).withColumn("month", month_key(F.timestamp_micros("us")))
    month = month_key(F.timestamp_micros("us")).alias("month")
    line = Timeline.open(keyed, key=["user_id", "month"], measure=jobs.select("user_id", month)).scan(nth=position())
    return line.rows().withColumn("is_overage", F.col("nth") > F.col("quota"))


def usage_chart(jobs: DataFrame, users: DataFrame, last_month: str, months=6) -> DataFrame:
    """Jobs per user and month for the last months, zero-filled."""
    end = F.to_date(F.lit(f"{last_month}-01"))
    axis = F.sequence(F.add_months(end, -(months - 1)), end, F.expr("interval 1 month"))
    grid = users.select("user_id", F.explode(axis).alias("_m")).select("user_id", F.date_format("_m", "yyyy-MM").alias("month"))
    return grid.join(monthly_usage(jobs), ["user_id", "month"], "left").select(
        "user_id", "month", F.coalesce("used", F.lit(0).cast("long")).alias("used"))


def plan_state(changes: DataFrame) -> DataFrame:
    """Current plan from the change log."""
    return changes.groupBy("user_id").agg(
        F.max_by("plan", F.struct("us", "seq")).alias("plan"), F.count(F.lit(1)).alias("changes"))


def monthly_extras(changes: DataFrame) -> DataFrame:
    """Purchased extras per user and month; the counter starts anew each month."""
    return changes.groupBy("user_id", month_key(F.timestamp_micros("us")).alias("month")).agg(F.sum("extras").alias("extras"))


# -- jobs ------------------------------------------------------------------------------------------


def recent_jobs(jobs: DataFrame, k: int, user="user_id") -> DataFrame:
    """Newest ``k`` jobs of each user.  The rank limit is applied before the shuffle."""
    w = Window.partitionBy(user).orderBy(F.col("us").desc(), F.col("job_id").desc())
    return jobs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def job_time(directory: Column) -> Column:
    """Creation time from a ``yyyy-MM-dd_HHmmss_id`` directory name."""
    return F.try_to_timestamp(F.regexp_extract(directory, r"^(\d{4}-\d{2}-\d{2}_\d{6})_", 1), F.lit("yyyy-MM-dd_HHmmss"))


def page_of(jobs: DataFrame, page: int, per_page=5, user="user_id") -> DataFrame:
    """One page per user, newest first, the page number clamped to the user's pages."""
    line = Timeline.open(jobs.withColumns({"_down": -F.col("us"), "_tie": -F.col("job_id")}), key=[user], order=["_down", "_tie"])
    ranked = line.scan(rank=position())
    pages = line.per_run(F.ceil(F.count(F.lit(1)) / per_page).alias("pages"))
    shown = F.greatest(F.lit(1), F.least(F.lit(page), F.col("pages")))
    out = ranked.join_run(pages).rows().withColumn("page", shown)
    return out.filter(F.col("rank").between((F.col("page") - 1) * per_page + 1, F.col("page") * per_page)).drop("_down", "_tie")


def job_by_id(jobs: DataFrame, job_id, owner=None) -> DataFrame:
    found = jobs.filter(F.col("job_id") == job_id)
    return found if owner is None else found.filter(F.col("user_id") == owner)


def creator_jobs(jobs: DataFrame, decisions: DataFrame, creators: DataFrame) -> DataFrame:
    """Jobs of the given creators, e-mails compared without case and blanks, with their decision."""
    norm = lambda c: F.lower(F.trim(c))
    wanted = creators.select(norm(F.col("email")).alias("_e")).distinct()
    return jobs.join(wanted, norm(F.col("email")) == F.col("_e"), "left_semi").join(decisions, "job_id", "left")


# -- retention and registry filters ------------------------------------------------------------------


def expired(artifacts: DataFrame, now_us: Column, days: int, tag_days=7, tag="LIVE-QA") -> DataFrame:
    """Artifacts past retention; one tag has its own shorter limit.  Report only."""
    limit = F.when(F.coalesce(F.col("tag") == tag, F.lit(False)), tag_days).otherwise(days)
    return artifacts.filter(F.col("created_us") < now_us - limit * F.lit(DAY_US))


def freed(expired_rows: DataFrame) -> DataFrame:
    return expired_rows.agg(F.count(F.lit(1)).alias("artifacts"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("freed_bytes"))


def prune(df: DataFrame, day: Column, cutoff: Column, key: str | None = None) -> DataFrame:
    """Rows at or after the cutoff, without empty keys."""
    kept = df.filter(day >= cutoff)
    return kept if key is None else kept.filter(F.trim(F.col(key)) != "")


def registry_filter(registry: DataFrame, industry=None, outcomes=None, kind=None) -> DataFrame:
    """Registry entries by industry, expected outcome and dataset type (by path)."""
    typed = registry.withColumn("dataset_type", F.when(F.col("csv_path").contains("realworld"), "realworld").otherwise("synthetic"))
    for column, wanted in (("industry", industry), ("expected_outcome", outcomes), ("dataset_type", kind)):
        if wanted:
            typed = typed.filter(F.col(column).isin(wanted if isinstance(wanted, (list, tuple)) else [wanted]))
    return typed


SAFETY = ("haccp", "autoclave", "sterile", "coldchain")


def risky(decisions: DataFrame, safety=SAFETY) -> DataFrame:
    """Safety industries that passed on a fallback, and everything undecided."""
    silent = F.col("industry").isin(*safety) & (F.col("status") == "PASS") & F.coalesce(F.col("fallback_used"), F.lit(False))
    return decisions.withColumn("risk", F.when(silent, "pass_on_fallback").when(F.col("status") == "INDETERMINATE", "undecided")).filter(
        "risk is not null")


# -- queues ----------------------------------------------------------------------------------------


def queue_status(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count(F.lit(1)).alias("size"), F.min_by("job_id", F.struct("created_us", "job_id")).alias("oldest"),
        F.max_by("job_id", F.struct("created_us", "job_id")).alias("newest"))


def retry_triage(queue: DataFrame, now_us: Column, max_age_h=24, delay_s=300, max_tries=3) -> DataFrame:
    """Expired, deferred, failed or eligible, in that order of precedence."""
    kind = (
        F.when(now_us - F.col("created_us") > max_age_h * 3_600_000_000, "expired")
        .when(F.coalesce(now_us - F.col("last_us") < delay_s * 1_000_000, F.lit(False)), "deferred")
        .when(F.col("attempts") >= max_tries, "failed").otherwise("eligible"))
    return queue.groupBy(kind.alias("triage")).agg(F.count(F.lit(1)).alias("jobs"))


def lifecycle_due(queue: DataFrame, now_us: Column, hours=(72, 120, 168)) -> DataFrame:
    """Next lifecycle message of each entry whose time has come."""
    age = now_us - F.col("created_us")
    due = F.lit(None).cast("int")
    for stage in reversed(range(len(hours))):
        due = F.when((F.col("stage") == stage) & (age >= hours[stage] * F.lit(3_600_000_000)), stage + 1).otherwise(due)
    return queue.withColumn("due_stage", due).filter("due_stage is not null")


# -- sign-ups --------------------------------------------------------------------------------------


def signup_rules(signups: DataFrame, max_per_ip=2, max_per_device=3, days=30, rapid_s=300) -> DataFrame:
    """First rule each sign-up breaks, judged against the sign-ups before it.

    Columns ``ip, fingerprint, email, us, seq``.  A shared address may carry any number of
    sign-ups: recent counts are range sums, the e-mail rule is one lookup per (ip, stem).
    """
    prefix = F.substring_index("email", "@", 1)
    stem = F.when(prefix.rlike(r"\d$"), F.regexp_replace(prefix, ".$", ""))
    signups = signups.withColumns({"_stem": stem, "_domain": F.lower(F.substring_index("email", "@", -1))})
    by_ip = Timeline.open(signups, key=["ip"])
    recent = range_sums(by_ip, days * DAY_US, 0, {"_upto": F.lit(1)}, open_start=True)
    # sign-ups of the same instant that come later in order are not "before"
    seen = by_ip.scan(_last=prev("us")).rows()
    same = by_ip.again(signups, key=["ip", "us"], order=["seq"]).scan(_nth=position())
    later = same.rows().join(same.per_run(F.count(F.lit(1)).alias("_same")), ["ip", "us"]).select(
        "ip", "us", "seq", (F.col("_same") - F.col("_nth")).alias("_later"))
    base = seen.join(recent, ["ip", "us", "seq"]).join(later, ["ip", "us", "seq"])
    base = base.withColumn("recent_ip", F.col("_upto") - 1 - F.col("_later")).drop("_upto", "_later")
    device = Timeline.open(base, key=["fingerprint"], measure=signups).scan(_dev=position()).rows()
    chain = by_ip.again(device, key=["ip", "_stem"]).scan(_twin=prev("seq")).rows()
    sequential = F.col("_stem").isNotNull() & F.col("_twin").isNotNull()
    rapid = (F.col("recent_ip") > 0) & ((F.col("us") - F.col("_last")) < rapid_s * 1_000_000)
    rule = (
        F.when(F.col("recent_ip") >= max_per_ip, "ip_limit").when(F.col("_dev") - 1 >= max_per_device, "device_limit")
        .when(F.col("_domain").isin(*THROWAWAY), "throwaway_domain").when(rapid, "rapid")
        .when(sequential, "sequential_email").otherwise("ok"))
    return chain.withColumns({"prior_device": F.col("_dev") - 1, "rule": rule}).select(
        "seq", "ip", "recent_ip", "prior_device", "rule")


def shared_keys(signups: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys with at least ``limit`` sign-ups, one row per sign-up rather than a list per key."""
    counts = signups.groupBy(key).agg(F.count(F.lit(1)).alias("signups")).filter(F.col("signups") >= limit)
    return keyed_join(signups, counts, key, ["seq"]).select(key, "signups", "email", "seq")

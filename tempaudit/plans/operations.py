"""Operations queries: bundles, logs, usage, sign-ups, campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempaudit.functions import scalars
from tempaudit.operators import bundles, campaigns, opslog, usage
from tempaudit.plans.columns import SQL_LOG, log_lines
from tempaudit.plans.common import expr, query, r, samples, table
from tempaudit.session import small_table

DAY = 86_400_000_000

# -- bundles: eight documents make one -------------------------------------------------------------

MAN = """man AS (SELECT doc_id // 8 AS bundle_id, 'part-' || lpad((doc_id % 8)::VARCHAR, 2, '0') AS path, sha256(text) AS sha256, n_chars AS size_bytes, doc_id FROM documents),
fil AS (SELECT bundle_id, path, CASE WHEN doc_id % 31 = 0 THEN 'bad' ELSE sha256 END AS sha256 FROM man WHERE doc_id % 23 <> 0
  UNION ALL SELECT bundle_id, 'stray', 'x' FROM man WHERE doc_id % 40 = 0),
fs AS (SELECT bundle_id, path, CASE WHEN fil.sha256 IS NULL THEN 'missing' WHEN man.sha256 IS NULL THEN 'extra' WHEN fil.sha256 <> man.sha256 THEN 'changed' ELSE 'ok' END AS state
  FROM man FULL JOIN fil USING (bundle_id, path))"""


def manifest(spark, sf):
    return table(spark, sf, "documents").select(
        F.expr("doc_id div 8").alias("bundle_id"), F.concat(F.lit("part-"), F.lpad((F.col("doc_id") % 8).cast("string"), 2, "0")).alias("path"),
        scalars.content_hash(F.col("text")).alias("sha256"), F.col("n_chars").alias("size_bytes"), "doc_id")


def found_files(m):
    kept = m.filter("doc_id % 23 <> 0").select("bundle_id", "path", F.when(F.col("doc_id") % 31 == 0, "bad").otherwise(F.col("sha256")).alias("sha256"))
    return kept.unionByName(m.filter("doc_id % 40 = 0").select("bundle_id", F.lit("stray").alias("path"), F.lit("x").alias("sha256")))


@query("j10_manifest_check", f"WITH {MAN} SELECT bundle_id, path, state FROM fs")
def j10(spark, sf):
    m = manifest(spark, sf)
    return bundles.integrity(m, found_files(m))


@query("s08_file_set_difference", f"WITH {MAN} SELECT bundle_id, path, state FROM fs WHERE state IN ('missing', 'extra')")
def s08(spark, sf):
    m = manifest(spark, sf)
    return bundles.integrity(m, found_files(m)).filter(F.col("state").isin("missing", "extra"))


@query("s10_root_digest", f"""WITH {MAN} SELECT bundle_id, sha256(string_agg('sha256 ' || size_bytes || ' ' || path || chr(10), '' ORDER BY path)) AS digest FROM man GROUP BY bundle_id""")
def s10(spark, sf):
    return bundles.root_digest(manifest(spark, sf))


@query("s11_content_digest", f"""WITH {MAN} SELECT bundle_id, sha256(string_agg(sha256, '' ORDER BY path)) AS digest FROM man GROUP BY bundle_id""")
def s11(spark, sf):
    return bundles.content_digest(manifest(spark, sf))


@query("s11_canonical_manifest", f"""WITH {MAN} SELECT bundle_id, sha256(string_agg('{{"path":"' || path || '","sha256":"' || sha256 || '","size_bytes":' || size_bytes || '}}', '' ORDER BY path)) AS digest
FROM man GROUP BY bundle_id""")
def s11c(spark, sf):
    return bundles.canonical_manifest(manifest(spark, sf))


@query("v19_bundle_verdict", f"""WITH {MAN}, f AS (SELECT bundle_id, count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state = 'extra') AS extra,
  count(*) FILTER (WHERE state = 'changed') AS changed FROM fs GROUP BY bundle_id)
SELECT bundle_id, missing, extra, changed, bundle_id % 9 > 0 AS root_ok, bundle_id % 9 > 0 AND missing = 0 AND extra = 0 AND changed = 0 AND bundle_id % 10 < 9 AS valid FROM f""")
def v19(spark, sf):
    m = manifest(spark, sf)
    digests = bundles.root_digest(m)
    stored = digests.select("bundle_id", F.when(F.col("bundle_id") % 9 == 0, "old").otherwise(F.col("digest")).alias("digest"))
    replay = m.select("bundle_id").distinct().withColumn("matches", F.col("bundle_id") % 10 < 9)
    return bundles.bundle_verdict(bundles.integrity(m, found_files(m)), digests, stored, replay)


@query("v19_bundle_quick", f"""WITH {MAN}, f AS (SELECT bundle_id, count(*) FILTER (WHERE state <> 'ok') AS bad FROM fs GROUP BY bundle_id)
SELECT bundle_id, bad = 0 AS valid FROM f""")
def v19q(spark, sf):
    m = manifest(spark, sf)
    digests = bundles.root_digest(m)
    return bundles.bundle_verdict(bundles.integrity(m, found_files(m)), digests, digests).select("bundle_id", "valid")


PARTS = ("raw_data", "specification", "normalized_data", "decision", "plot", "report", "note", "extra")


@query("j12_required_parts", """WITH p AS (SELECT doc_id // 8 AS bundle_id, CASE WHEN doc_id % 5 = 0 THEN 'draft' ELSE ['raw_data','specification','normalized_data','decision','plot','report','note','extra'][doc_id % 8 + 1] END AS part FROM documents), h AS (SELECT bundle_id, list(DISTINCT part) AS have FROM p GROUP BY bundle_id)
SELECT bundle_id, array_to_string(list_sort(list_filter(['raw_data','specification','normalized_data','decision','plot','report'], lambda x: NOT list_contains(have, x))), ',') AS missing_parts FROM h""")
def j12(spark, sf):
    name = F.element_at(F.array(*map(F.lit, PARTS)), (F.col("doc_id") % 8 + 1).cast("int"))
    parts = table(spark, sf, "documents").select(
        F.expr("doc_id div 8").alias("bundle_id"), F.when(F.col("doc_id") % 5 == 0, "draft").otherwise(name).alias("part"))
    return bundles.missing_parts(parts).withColumn("missing_parts", F.array_join("missing_parts", ","))


# -- logs ------------------------------------------------------------------------------------------


@query("a10_log_scan", f"""WITH {SQL_LOG} SELECT seq, us AS time_us FROM lg WHERE us >= 1705000000000000""")
def a10(spark, sf):
    events = opslog.parse_lines(log_lines(spark, sf), since=F.timestamp_seconds(F.lit(1705000000)))
    return events.select("seq", F.unix_micros("log_ts").alias("time_us"))


SQL_EV = f"""{SQL_LOG}, ev AS (SELECT us, CASE WHEN f = 0 OR f = 3 THEN ms / 1000.0 END AS c, CASE WHEN f IN (1, 2) THEN st END AS h,
  CASE WHEN f = 3 THEN sensor = 'error' END AS v FROM lg)"""
SQL_P95 = "(SELECT c FROM (SELECT c, row_number() OVER (ORDER BY c) AS rn, count(*) OVER () AS n FROM {0} WHERE c IS NOT NULL) WHERE rn = floor(0.95 * n) + 1)"


def log_events(spark, sf):
    return opslog.parse_lines(log_lines(spark, sf))


@query("g30_compile_p95", f"""WITH {SQL_EV} SELECT round(coalesce({SQL_P95.format('ev')}, 0), 2)::DOUBLE AS p95_s, round(avg(c), 2)::DOUBLE AS avg_s, count(c) AS compiles,
  coalesce({SQL_P95.format('ev')}, 0) > 5 AS slow FROM ev""")
def g30(spark, sf):
    return opslog.compile_metrics(log_events(spark, sf))


@query("g31_error_rate", f"""WITH {SQL_EV} SELECT count(h) AS requests, count(*) FILTER (WHERE h >= 500) AS errors,
  round(count(*) FILTER (WHERE h >= 500) / count(h) * 100, 2) AS error_pct, count(*) FILTER (WHERE h >= 500) / count(h) * 100 > 1 AS erring FROM ev""")
def g31(spark, sf):
    return opslog.error_metrics(log_events(spark, sf))


@query("g31_verify_rate", f"""WITH {SQL_EV} SELECT count(v) AS verifications, count(*) FILTER (WHERE v) AS verify_errors,
  round(count(*) FILTER (WHERE v) / count(v) * 100, 2) AS verify_error_pct, count(*) FILTER (WHERE v) / count(v) * 100 > 0.5 AS verify_failing FROM ev""")
def g31v(spark, sf):
    return opslog.verify_metrics(log_events(spark, sf))


@query("g32_health_summary", f"""WITH {SQL_EV}, lo AS (SELECT * FROM ev WHERE us >= 1705968000000000 - 864000000000), sh AS (SELECT * FROM ev WHERE us >= 1705968000000000 - 432000000000),
a AS (SELECT coalesce({SQL_P95.format('lo')}, 0) AS p, avg(c) AS m, count(c) AS n, count(v) AS vn, count(*) FILTER (WHERE v) AS ve FROM lo),
b AS (SELECT count(h) AS rn, count(*) FILTER (WHERE h >= 500) AS e FROM sh)
SELECT round(p, 2)::DOUBLE AS p95_s, round(m, 2)::DOUBLE AS avg_s, n AS compiles, p > 5 AS slow, rn AS requests, e AS errors, round(e / rn * 100, 2) AS error_pct, e / rn * 100 > 1 AS erring,
  vn AS verifications, ve AS verify_errors, round(ve / vn * 100, 2) AS verify_error_pct, ve / vn * 100 > 0.5 AS verify_failing,
  NOT (p > 5) AND NOT (e / rn * 100 > 1) AND NOT (ve / vn * 100 > 0.5) AS healthy FROM a CROSS JOIN b""")
def g32(spark, sf):
    return opslog.health_summary(log_events(spark, sf), F.timestamp_seconds(F.lit(1705968000)), "interval 5 days", "interval 10 days")


ART = """art AS (SELECT doc_id, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 10) || '/' || ['in.csv','decision.json','report.pdf','evidence.zip'][doc_id % 4 + 1] AS rel,
  n_chars AS size_bytes, (doc_id % 60) * 86400000000 + 1704067200000000 AS created_us, CASE WHEN doc_id % 8 = 1 THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN doc_id % 6 = 0 THEN 'LIVE-QA' ELSE '' END AS tag FROM documents)"""
ART_FILES = ("in.csv", "decision.json", "report.pdf", "evidence.zip")


def artifacts(spark, sf):
    digest = scalars.content_hash(F.col("text"))
    name = F.element_at(F.array(*map(F.lit, ART_FILES)), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("/", F.lit("/store"), F.substring(digest, 1, 2), F.substring(digest, 3, 10), name).alias("path"),
        F.col("n_chars").alias("size_bytes"), (F.col("doc_id") % 60 * F.lit(DAY) + F.lit(1704067200000000)).alias("created_us"),
        F.when(F.col("doc_id") % 8 == 1, "PASS").otherwise("FAIL").alias("status"), F.when(F.col("doc_id") % 6 == 0, "LIVE-QA").otherwise("").alias("tag"))


@query("a12_artifact_listing", f"""WITH {ART} SELECT '/store/' || rel AS path, substr(rel, 4, 10) AS job_id, size_bytes FROM art WHERE doc_id % 3 > 0""")
def a12(spark, sf):
    from tempaudit.sources.corpus import job_artifacts

    # a third of the listing lies outside the job directories
    listing = artifacts(spark, sf).withColumn("path", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/store/tmp/"), "doc_id")).otherwise(F.col("path")))
    return job_artifacts(listing).select("path", "job_id", "size_bytes")


@query("g33_daily_artifacts", f"""WITH {ART} SELECT strftime(make_timestamp(created_us), '%Y-%m-%d') AS day, count(*) FILTER (WHERE rel LIKE '%.csv') AS uploads,
  count(*) FILTER (WHERE rel LIKE '%decision.json' AND status = 'PASS') AS passes, count(*) FILTER (WHERE rel LIKE '%decision.json' AND status = 'FAIL') AS fails,
  round(coalesce(sum(size_bytes) FILTER (WHERE rel LIKE '%.pdf'), 0) / 1048576, 2)::DOUBLE AS pdf_mb, round(coalesce(sum(size_bytes) FILTER (WHERE rel LIKE '%.zip'), 0) / 1048576, 2)::DOUBLE AS zip_mb,
  count(*) AS files FROM art GROUP BY 1""")
def g33(spark, sf):
    files = artifacts(spark, sf).withColumn("day", F.date_format(F.timestamp_micros("created_us"), "yyyy-MM-dd"))
    return opslog.daily_artifacts(files)


@query("g34_daily_log_metrics", f"""WITH {SQL_LOG} SELECT strftime(make_timestamp(raw_us), '%Y-%m-%d') AS day, count(*) FILTER (WHERE f = 2) AS requests,
  count(*) FILTER (WHERE sensor = 'error' AND f IN (1, 2)) AS errors, count(*) FILTER (WHERE seq % 8 = 0) AS compile_successes, count(*) FILTER (WHERE seq % 8 = 4) AS compile_failures
FROM lg GROUP BY 1""")
def g34(spark, sf):
    # half of the compilations end well, the others fail
    ends = F.when(F.col("seq") % 8 == 0, "Compilation SUCCESS").otherwise("compilation failed")
    lines = log_lines(spark, sf).withColumn("line", F.when(F.col("seq") % 4 == 0, F.replace("line", F.lit("Compile done"), ends)).otherwise(F.col("line")))
    return opslog.daily_log_metrics(lines, F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd"))


# -- retention -------------------------------------------------------------------------------------

NOW = 1704067200000000 + 60 * DAY


@query("b21_expired_artifacts", f"""WITH {ART} SELECT doc_id, size_bytes FROM art WHERE created_us < {NOW} - CASE WHEN tag = 'LIVE-QA' THEN 7 ELSE 30 END * {DAY}""")
def b21(spark, sf):
    return usage.expired(artifacts(spark, sf), F.lit(NOW), 30).select("doc_id", "size_bytes")


@query("b21_freed_size", f"""WITH {ART} SELECT count(*) AS artifacts, sum(size_bytes)::BIGINT AS freed_bytes FROM art WHERE created_us < {NOW} - CASE WHEN tag = 'LIVE-QA' THEN 7 ELSE 30 END * {DAY}""")
def b21f(spark, sf):
    return usage.freed(usage.expired(artifacts(spark, sf), F.lit(NOW), 30))


@query("b22_prune_old_rows", """SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND trim(CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderstatus END) <> ''""")
def b22(spark, sf):
    o = table(spark, sf, "orders").withColumn("key", F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.col("o_orderstatus")))
    return usage.prune(o, F.col("o_orderdate"), F.lit("2000-01-01").cast("timestamp_ntz"), "key").select("o_orderkey")


# -- users, plans and usage --------------------------------------------------------------------------

PLANS = [("free", 2, 0.0, None), ("starter", 10, 19.0, 3.0), ("pro", 15, 79.0, 2.0), ("business", 12, 249.0, None), ("enterprise", -1, None, None)]
PLAN_SQL = "pl(plan, quota, price, overage_price) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if x is None else repr(x) for x in p) + ")" for p in PLANS) + ")"
PLAN_OF = "['starter','pro','business','enterprise','gold'][{0} % 5 + 1]"


def plans(spark):
    return small_table(spark, PLANS, "plan string, quota long, price double, overage_price double")


def users(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lower("c_name"), F.lit("@Example.com ")).alias("email"))


def jobs(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))


def subscriptions(spark, sf):
    plan = F.element_at(F.array(*map(F.lit, ("starter", "pro", "business", "enterprise", "gold"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    active = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 4 == 0)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("subscription_id"), F.col("o_custkey").alias("user_id"), plan.alias("plan"), active.alias("active"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_us"))


SQL_PLAN = f"""{PLAN_SQL}, sub AS (SELECT o_custkey AS user_id, {PLAN_OF.format('o_orderkey')} AS plan,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderkey % 4 = 0 AND o_orderstatus = 'F'),
cur AS (SELECT c_custkey AS user_id, coalesce(sub.plan, 'free') AS plan, coalesce(pl.quota, 2) AS quota, overage_price, price FROM customer
  LEFT JOIN (SELECT * FROM sub WHERE rn = 1) sub ON sub.user_id = c_custkey LEFT JOIN pl ON pl.plan = coalesce(sub.plan, 'free')),
us AS (SELECT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS used FROM orders GROUP BY ALL)"""


def current(spark, sf):
    return usage.current_plan(users(spark, sf).select("user_id"), subscriptions(spark, sf), plans(spark))


@query("j07_current_plan", f"WITH {SQL_PLAN} SELECT user_id, plan, quota::BIGINT AS quota FROM cur")
def j07(spark, sf):
    return current(spark, sf)


@query("j08_monthly_counter", f"""WITH {SQL_PLAN} SELECT c_custkey AS user_id, '2000-03' AS month, coalesce(used, 0) AS used FROM customer LEFT JOIN (SELECT * FROM us WHERE month = '2000-03') u ON u.user_id = c_custkey""")
def j08(spark, sf):
    return usage.usage_with_counter(users(spark, sf).select("user_id"), usage.monthly_usage(jobs(spark, sf)), "2000-03")


SQL_QUOTA = f"""{SQL_PLAN}, q AS (SELECT cur.user_id, plan, quota, overage_price, count(o_orderkey) AS used FROM cur LEFT JOIN orders ON o_custkey = cur.user_id GROUP BY ALL),
qs AS (SELECT *, quota < 0 AS unl, quota >= 0 AND used >= quota AS over, coalesce(overage_price > 0, false) AS paid FROM q)"""


def quota_rows(spark, sf):
    used = jobs(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    prices = plans(spark).select("plan", "overage_price")
    return current(spark, sf).join(F.broadcast(prices), "plan", "left").join(used, "user_id", "left").fillna(0, ["used"])


@query("g36_quota_status", f"""WITH {SQL_QUOTA} SELECT user_id, plan, used, unl AS is_unlimited, CASE WHEN unl THEN -1 ELSE greatest(quota - used, 0) END AS remaining,
  CASE WHEN unl THEN 0 ELSE greatest(used - quota, 0) END AS overage, NOT over OR paid AS allowed,
  CASE WHEN NOT over OR paid THEN 'OK' WHEN plan = 'free' THEN 'FREE_TIER_EXCEEDED' ELSE 'MONTHLY_QUOTA_EXCEEDED' END AS code FROM qs""")
def g36(spark, sf):
    q = usage.quota_status(quota_rows(spark, sf))
    return q.select("user_id", "plan", "used", "is_unlimited", F.coalesce("remaining", F.lit(-1)).alias("remaining"), F.col("overage").cast("long"), "allowed", "code")


@query("g36_dashboard", f"""WITH {SQL_QUOTA}, rc AS (SELECT o_custkey AS user_id, least(count(*), 3) AS recent_jobs FROM orders GROUP BY 1)
SELECT qs.user_id, plan, used, coalesce(recent_jobs, 0) AS recent_jobs, '2001-03-01' AS resets_on FROM qs LEFT JOIN rc USING (user_id)""")
def g36d(spark, sf):
    d = usage.dashboard(usage.quota_status(quota_rows(spark, sf)), usage.recent_jobs(jobs(spark, sf), 3), F.lit("2001-02-14").cast("date"))
    return d.select("user_id", "plan", "used", "recent_jobs", F.date_format("resets_on", "yyyy-MM-dd").alias("resets_on"))


@query("g35_usage_chart", f"""WITH {SQL_PLAN}, ax(month) AS (VALUES ('2000-01'), ('2000-02'), ('2000-03'), ('2000-04'), ('2000-05'), ('2000-06'))
SELECT c_custkey AS user_id, ax.month, coalesce(used, 0) AS used FROM customer CROSS JOIN ax LEFT JOIN us ON us.user_id = c_custkey AND us.month = ax.month""")
def g35(spark, sf):
    return usage.usage_chart(jobs(spark, sf), users(spark, sf), "2000-06")


@query("g37_overage_events", f"""WITH m AS (SELECT o_orderkey AS job_id, o_custkey AS user_id, strftime(o_orderdate, '%Y') AS y,
  row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey) AS nth FROM orders)
SELECT job_id, user_id, nth, nth > user_id % 3 AS is_overage FROM m""")
def g37(spark, sf):
    j = jobs(spark, sf).withColumn("seq", F.col("job_id"))
    limits = users(spark, sf).select("user_id", (F.col("user_id") % 3).alias("quota"))
    return usage.overage_events(j, limits).select("job_id", "user_id", "nth", "is_overage")


@query("g46_plan_state", f"""WITH c AS (SELECT o_custkey AS user_id, {PLAN_OF.format('o_orderkey')} AS plan, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT user_id, max(plan) FILTER (WHERE rn = 1) AS plan, count(*) AS changes FROM c GROUP BY user_id""")
def g46(spark, sf):
    plan = F.element_at(F.array(*map(F.lit, ("starter", "pro", "business", "enterprise", "gold"))), (F.col("job_id") % 5 + 1).cast("int"))
    return usage.plan_state(jobs(spark, sf).select("user_id", "us", F.col("job_id").alias("seq"), plan.alias("plan")))


@query("g46_monthly_extras", """SELECT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m') AS month, sum(o_orderkey % 4)::BIGINT AS extras FROM orders GROUP BY ALL""")
def g46x(spark, sf):
    return usage.monthly_extras(jobs(spark, sf).withColumn("extras", F.col("job_id") % 4))


@query("c19_monthly_cost", f"""WITH {SQL_QUOTA}, x AS (SELECT user_id, coalesce(price, 0) AS base, CASE WHEN coalesce(overage_price, 0) > 0 AND used > quota THEN used - quota ELSE 0 END AS n,
  coalesce(overage_price, 0) AS op FROM qs JOIN pl USING (plan)) SELECT user_id, base, n * op AS overage, base + n * op AS total, n AS overage_count FROM (SELECT user_id, base::DOUBLE AS base, n, op::DOUBLE AS op FROM x)""".replace("overage_price FROM cur LEFT JOIN orders", "overage_price FROM cur LEFT JOIN orders").replace("SELECT user_id, coalesce(price", "SELECT user_id, coalesce(pl.price").replace("coalesce(overage_price, 0) > 0", "coalesce(pl.overage_price, 0) > 0").replace("coalesce(overage_price, 0) AS op", "coalesce(pl.overage_price, 0) AS op").replace("used > quota THEN used - quota", "used > qs.quota THEN used - qs.quota"))
def c19(spark, sf):
    rows = quota_rows(spark, sf).drop("quota", "overage_price").join(F.broadcast(plans(spark)), "plan")
    return rows.select("user_id", scalars.monthly_cost(F.col("used"), F.col("quota"), F.col("price"), F.col("overage_price")).alias("c")).select("user_id", "c.*")


@query("c21_upgrade_eligibility", """WITH x AS (SELECT c_custkey AS user_id, list_position(['free','starter','pro','business','enterprise'], ['free','pro','gold','enterprise'][c_custkey % 4 + 1]) AS a,
  list_position(['free','starter','pro','business','enterprise'], ['starter','business','free'][c_custkey % 3 + 1]) AS b FROM customer)
SELECT user_id, coalesce(a > 0 AND b > 0 AND b > a, false) AS can_upgrade FROM x""")
def c21(spark, sf):
    pick = lambda names, m: F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % m + 1).cast("int"))
    return users(spark, sf).select("user_id", scalars.can_upgrade(pick(("free", "pro", "gold", "enterprise"), 4), pick(("starter", "business", "free"), 3)).alias("can_upgrade"))


@query("s02_recent_jobs", """WITH j AS (SELECT o_orderkey AS job_id, o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders)
SELECT user_id, job_id, rank FROM j WHERE rank <= 3""")
def s02(spark, sf):
    return usage.recent_jobs(jobs(spark, sf), 3).select("user_id", "job_id", F.col("rank").cast("long"))


@query("s02_job_time_from_name", """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE epoch_us(o_orderdate) END AS created_us FROM orders""")
def s02t(spark, sf):
    name = F.when(F.col("job_id") % 7 == 0, F.lit("misc")).otherwise(F.concat(F.date_format("created", "yyyy-MM-dd_HHmmss"), F.lit("_"), "job_id"))
    return jobs(spark, sf).select("job_id", F.coalesce(F.unix_micros(usage.job_time(name)), F.lit(-1).cast("long")).alias("created_us"))


@query("s03_pagination", """WITH j AS (SELECT o_orderkey AS job_id, o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank,
  ceil(count(*) OVER (PARTITION BY o_custkey) / 5.0) AS pages FROM orders)
SELECT user_id, job_id, greatest(1, least(3, pages))::BIGINT AS page FROM j WHERE rank BETWEEN (greatest(1, least(3, pages)) - 1) * 5 + 1 AND greatest(1, least(3, pages)) * 5""")
def s03(spark, sf):
    return usage.page_of(jobs(spark, sf), 3).select("user_id", "job_id", F.col("page").cast("long"))


@query("s05_latest_metrics_row", """SELECT o_orderpriority AS metric, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS job_id, strftime(max(o_orderdate), '%Y-%m-%d') AS day FROM orders GROUP BY 1""")
def s05(spark, sf):
    latest = F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("m")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(latest).select(
        "metric", F.col("m.o_orderkey").alias("job_id"), F.date_format("m.o_orderdate", "yyyy-MM-dd").alias("day"))


@query("s06_job_lookup", "SELECT o_orderkey AS job_id, o_custkey AS user_id, epoch_us(o_orderdate) AS us FROM orders WHERE o_orderkey = 77")
def s06(spark, sf):
    return usage.job_by_id(jobs(spark, sf), 77).select("job_id", "user_id", "us")


@query("j11_creator_jobs", """SELECT o_orderkey AS job_id, o_custkey AS user_id, CASE WHEN o_orderkey % 5 > 0 THEN CASE o_orderstatus WHEN 'F' THEN 'PASS' ELSE 'FAIL' END ELSE 'OPEN' END AS status
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 10 = 3""")
def j11(spark, sf):
    mails = users(spark, sf)
    mine = jobs(spark, sf).join(mails, "user_id")
    creators = mails.filter("user_id % 10 = 3").select(F.upper(F.concat(F.lit("  "), "email")).alias("email"))
    status = F.when(F.col("o_orderkey") % 5 == 0, "OPEN").when(F.col("o_orderstatus") == "F", "PASS").otherwise("FAIL")
    decisions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"))
    return usage.creator_jobs(mine, decisions, creators).select("job_id", "user_id", F.coalesce("status", F.lit("none")).alias("status"))


@query("a13_relational_scan", """SELECT c_mktsegment AS plan, count(*) AS jobs, count(DISTINCT o_custkey) AS users FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def a13(spark, sf):
    u = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("plan"))
    per_user = jobs(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.join(u, "user_id").groupBy("plan").agg(F.sum("n").alias("jobs"), F.count(F.lit(1)).alias("users"))


# -- queues ----------------------------------------------------------------------------------------

QNOW = "1262304000000000"
QUE = """q AS (SELECT o_orderkey AS job_id, epoch_us(o_orderdate) AS created_us, o_orderkey % 5 AS attempts, o_orderkey % 3 AS stage,
  CASE WHEN o_orderkey % 2 = 0 THEN epoch_us(o_orderdate) + (o_orderkey % 3600) * 1000000 END AS last_us FROM orders)"""


def queue(spark, sf):
    k = F.col("job_id")
    return jobs(spark, sf).select("job_id", F.col("us").alias("created_us"), (k % 5).alias("attempts"), (k % 3).alias("stage"),
                                  F.when(k % 2 == 0, F.col("us") + (k % 3600) * 1_000_000).alias("last_us"))


MID = "(SELECT max(created_us) + 3600000000 FROM q)"


@query("g42_queue_status", f"WITH {QUE} SELECT count(*) AS size, arg_min(job_id, (created_us, job_id)) AS oldest, arg_max(job_id, (created_us, job_id)) AS newest FROM q")
def g42(spark, sf):
    return usage.queue_status(queue(spark, sf))


RETRY_NOW = 1000000000000000


@query("g42_retry_triage", f"""WITH {QUE} SELECT CASE WHEN {RETRY_NOW} - created_us > 43800 * 3600000000 THEN 'expired' WHEN coalesce({RETRY_NOW} - last_us < 7776000 * 1000000::BIGINT, false) THEN 'deferred'
  WHEN attempts >= 3 THEN 'failed' ELSE 'eligible' END AS triage, count(*) AS jobs FROM q GROUP BY 1""")
def g42t(spark, sf):
    return usage.retry_triage(queue(spark, sf), F.lit(RETRY_NOW), 43_800, 7_776_000, 3)


@query("g43_lifecycle_due", f"""WITH {QUE} SELECT job_id, stage + 1 AS due_stage FROM q WHERE {RETRY_NOW} - created_us >= [8760, 17520, 26280][stage + 1] * 3600000000""")
def g43(spark, sf):
    return usage.lifecycle_due(queue(spark, sf), F.lit(RETRY_NOW), (8_760, 17_520, 26_280)).select("job_id", F.col("due_stage").cast("long"))


@query("a11_jsonl_queue", """SELECT o_orderkey AS job_id, o_custkey AS user_id, o_orderkey % 3 AS stage FROM orders WHERE o_orderkey % 10 > 0""")
def a11(spark, sf):
    from tempaudit.sources.corpus import parse_jsonl

    good = F.format_string('{"job_id": %d, "user_id": %d, "stage": %d}', "job_id", "user_id", F.col("job_id") % 3)
    lines = jobs(spark, sf).select(F.when(F.col("job_id") % 10 == 0, F.concat(F.lit('{"job_id": '), "job_id")).otherwise(good).alias("line"))
    return parse_jsonl(lines, "job_id long, user_id long, stage long")


# -- sign-ups: an address is shared by several users, a device by fewer --------------------------------

SIGN = """g AS (SELECT event_id AS seq, epoch_us(ts) AS us, 'ip' || (user_id % 40) AS ip, 'fp' || (user_id * 7 % 101) AS fingerprint,
  'user' || (event_id % 50) || CASE WHEN event_id % 3 = 0 THEN (event_id // 3 % 10)::VARCHAR ELSE 'x' END || '@' || CASE WHEN event_id % 11 = 0 THEN 'Mailinator.com' ELSE 'corp.example' END AS email
  FROM events WHERE event_type = 'signup'),
b AS (SELECT *, split_part(email, '@', 1) AS pre, lower(split_part(email, '@', 2)) AS dom FROM g),
w AS (SELECT *, CASE WHEN regexp_matches(pre, '[0-9]$') THEN left(pre, length(pre) - 1) END AS stem FROM b),
c AS (SELECT a.seq, count(p.seq) AS recent_ip FROM w a LEFT JOIN w p ON p.ip = a.ip AND p.us > a.us - 172800000000 AND (p.us < a.us OR (p.us = a.us AND p.seq < a.seq)) GROUP BY a.seq),
x AS (SELECT w.*, recent_ip, row_number() OVER (PARTITION BY fingerprint ORDER BY us, w.seq) - 1 AS prior_device, lag(us) OVER (PARTITION BY ip ORDER BY us, w.seq) AS last_us,
  CASE WHEN stem IS NOT NULL THEN lag(w.seq) OVER (PARTITION BY ip, stem ORDER BY us, w.seq) END AS twin FROM w JOIN c USING (seq))"""


def signups(spark, sf):
    e = samples(spark, sf).filter("sensor = 'signup'")
    tail = F.when(F.col("seq") % 3 == 0, F.expr("cast((seq div 3) % 10 as string)")).otherwise("x")
    domain = F.when(F.col("seq") % 11 == 0, "Mailinator.com").otherwise("corp.example")
    return e.select("seq", "us", F.concat(F.lit("ip"), F.col("run_id") % 40).alias("ip"), F.concat(F.lit("fp"), F.col("run_id") * 7 % 101).alias("fingerprint"),
                    F.concat(F.lit("user"), F.col("seq") % 50, tail, F.lit("@"), domain).alias("email"))


@query("d27_signup_rules", f"""WITH {SIGN} SELECT seq, ip, recent_ip, prior_device, CASE WHEN recent_ip >= 4 THEN 'ip_limit' WHEN prior_device >= 12 THEN 'device_limit'
  WHEN dom = 'mailinator.com' THEN 'throwaway_domain' WHEN recent_ip > 0 AND us - last_us < 14400000000 THEN 'rapid' WHEN twin IS NOT NULL THEN 'sequential_email' ELSE 'ok' END AS rule FROM x""")
def d27(spark, sf):
    return usage.signup_rules(signups(spark, sf), 4, 12, 2, 14_400)


@query("g38_shared_addresses", f"""WITH {SIGN}, n AS (SELECT ip, count(*) AS signups FROM g GROUP BY ip HAVING count(*) >= 50) SELECT ip, signups, email, seq FROM g JOIN n USING (ip)""")
def g38(spark, sf):
    return usage.shared_keys(signups(spark, sf), "ip", 50)


# -- campaigns -----------------------------------------------------------------------------------------

ACT = """act AS (SELECT user_id, epoch_us(ts) AS us, event_id AS seq, ['upload_csv','compile_success','download_pdf','purchase'][event_id % 4 + 1] AS action,
  CASE WHEN event_id % 4 = 3 THEN round(value, 2) ELSE 0 END AS revenue, ['google','bing'][event_id // 4 % 2 + 1] AS source, CASE WHEN event_id // 4 % 2 = 0 THEN 'cpc' ELSE 'organic' END AS medium,
  'camp' || (user_id % 7) AS campaign, CASE WHEN event_id % 9 = 0 THEN event_type END AS referral FROM events)"""
SPEND = """sp AS (SELECT 'camp' || (o_custkey % 6) AS campaign, o_totalprice / 100 AS ad_spend, o_orderkey % 50 AS clicks, DATE '2024-01-01' + (o_orderkey % 30)::INT AS day FROM orders)"""


def actions(spark, sf):
    q, half = F.col("seq"), F.expr("seq div 4 % 2")
    action = F.element_at(F.array(*map(F.lit, ("upload_csv", "compile_success", "download_pdf", "purchase"))), (q % 4 + 1).cast("int"))
    return samples(spark, sf).select(
        F.col("run_id").alias("user_id"), "us", "seq", action.alias("action"), F.when(q % 4 == 3, F.col("value")).otherwise(0.0).alias("revenue"),
        F.when(half == 0, "google").otherwise("bing").alias("source"), F.when(half == 0, "cpc").otherwise("organic").alias("medium"),
        F.concat(F.lit("camp"), F.col("run_id") % 7).alias("campaign"), F.when(q % 9 == 0, F.col("sensor")).alias("referral"))


def spend(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("camp"), F.col("o_custkey") % 6).alias("campaign"), (F.col("o_totalprice") / 100).alias("ad_spend"),
        (F.col("o_orderkey") % 50).alias("clicks"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("day"))


SQL_TOUCH = """tc AS (SELECT user_id, arg_min(source || '_' || campaign, us) AS f, arg_max(source || '_' || campaign, us) AS l, arg_min(medium, us) AS fm, arg_max(medium, us) AS lm,
  min(us) AS first_us, max(us) AS last_us, arg_max(referral, us) FILTER (WHERE referral IS NOT NULL) AS ref, sum(revenue) AS rev FROM act GROUP BY user_id)"""


@query("d26_first_last_touch", f"WITH {ACT}, {SQL_TOUCH} SELECT user_id, f AS first_touch, l AS last_touch, fm AS first_medium, lm AS last_medium, first_us, last_us, coalesce(ref, 'none') AS referral FROM tc")
def d26(spark, sf):
    t = campaigns.touches(actions(spark, sf))
    return t.select("user_id", F.concat_ws("_", "first.source", "first.campaign").alias("first_touch"), F.concat_ws("_", "last.source", "last.campaign").alias("last_touch"),
                    F.col("first.medium").alias("first_medium"), F.col("last.medium").alias("last_medium"), "first_us", "last_us", F.coalesce("referral", F.lit("none")).alias("referral"))


@query("c20_attribution_credit", f"""WITH {ACT}, {SQL_TOUCH}, cr AS (
  SELECT f AS touch, rev * CASE WHEN f = l THEN 0.8 ELSE 0.4 END * CASE WHEN ref IS NULL THEN 1 ELSE 0.8 END AS credit FROM tc
  UNION ALL SELECT l, rev * 0.4 * CASE WHEN ref IS NULL THEN 1 ELSE 0.8 END FROM tc WHERE f <> l UNION ALL SELECT 'referral_' || ref, rev * 0.2 FROM tc WHERE ref IS NOT NULL)
SELECT touch, round(sum(credit), 4)::DOUBLE AS credit FROM cr GROUP BY touch""")
def c20(spark, sf):
    a = actions(spark, sf)
    return campaigns.attributed_revenue(a, campaigns.touches(a)).select("touch", r("credit", 4))


SINCE = 1705276800000000  # 2024-01-15
SQL_DAILYC = f"""dc AS (SELECT us // {DAY} AS d, source, medium, campaign, count(DISTINCT user_id) AS unique_visitors, count(*) AS total_sessions,
  count(*) FILTER (WHERE action = 'upload_csv') AS uploads, count(*) FILTER (WHERE action = 'compile_success') AS successes, count(*) FILTER (WHERE action = 'download_pdf') AS downloads,
  sum(CASE WHEN action = 'purchase' THEN revenue ELSE 0 END) AS revenue, count(*) FILTER (WHERE action = 'purchase') AS purchases,
  round(count(*) FILTER (WHERE action = 'upload_csv') * 100.0 / count(DISTINCT user_id), 2) AS upload_cvr,
  round(count(*) FILTER (WHERE action = 'purchase') * 100.0 / nullif(count(*) FILTER (WHERE action = 'upload_csv'), 0), 2) AS purchase_cvr
  FROM act WHERE us >= {SINCE} AND user_id % 5 > 0 GROUP BY ALL)"""


def daily(spark, sf):
    a = actions(spark, sf)
    known = a.filter("user_id % 5 > 0").select("user_id").distinct()
    return campaigns.daily_campaigns(a, known, F.lit(SINCE))


@query("g39_daily_campaigns", f"""WITH {ACT}, {SQL_DAILYC} SELECT strftime(make_timestamp(d * {DAY}), '%Y-%m-%d') AS day, source, medium, campaign, unique_visitors, total_sessions, uploads, successes, downloads,
  round(revenue, 4)::DOUBLE AS revenue, purchases, upload_cvr::DOUBLE AS upload_cvr, purchase_cvr::DOUBLE AS purchase_cvr FROM dc""")
def g39(spark, sf):
    return daily(spark, sf).withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "revenue": F.round("revenue", 4)})


@query("g40_weekly_report", f"""WITH {ACT}, {SPEND}, {SQL_DAILYC}, p AS (SELECT campaign, sum(uploads)::BIGINT AS uploads, sum(revenue) AS revenue, avg(upload_cvr) AS mean_cvr FROM dc
  WHERE d >= 19737 AND source = 'google' AND medium = 'cpc' GROUP BY campaign),
c AS (SELECT campaign, sum(ad_spend) AS spend, sum(clicks)::BIGINT AS clicks FROM sp WHERE day >= DATE '2024-01-15' GROUP BY campaign)
SELECT campaign, uploads, round(revenue, 4)::DOUBLE AS revenue, round(mean_cvr, 4)::DOUBLE AS mean_cvr, round(spend, 2)::DOUBLE AS spend, clicks, round(revenue / spend, 6)::DOUBLE AS roas,
  round(CASE WHEN uploads > 0 THEN spend / uploads ELSE 0 END, 4)::DOUBLE AS cpa FROM p JOIN c USING (campaign)""")
def g40(spark, sf):
    w = campaigns.weekly_report(daily(spark, sf), spend(spark, sf), F.lit("2024-01-15").cast("date"))
    return w.select("campaign", "uploads", r("revenue", 4), r("mean_cvr", 4), r("spend", 2), "clicks", r("roas"), r("cpa", 4))


SQL_KPI = f"""cs AS (SELECT campaign, sum(ad_spend) AS spend FROM sp GROUP BY campaign), ra AS (SELECT * FROM act WHERE us >= {SINCE} AND campaign IN (SELECT campaign FROM cs)),
kp AS (SELECT count(DISTINCT user_id) AS visitors, count(*) FILTER (WHERE action = 'upload_csv') AS uploads, sum(CASE WHEN action = 'purchase' THEN revenue ELSE 0 END) AS revenue,
  (SELECT sum(spend) FROM cs WHERE campaign IN (SELECT campaign FROM ra)) AS spend FROM ra)"""


@query("g40_weekly_kpis", f"""WITH {ACT}, {SPEND}, {SQL_KPI} SELECT visitors, uploads, round(revenue, 4)::DOUBLE AS revenue, round(spend, 2)::DOUBLE AS spend, round(spend / uploads, 4)::DOUBLE AS cpa,
  round(revenue / spend, 8)::DOUBLE AS roas, round(uploads / visitors * 100, 4)::DOUBLE AS upload_cvr FROM kp""")
def g40k(spark, sf):
    k = campaigns.weekly_kpis(actions(spark, sf), spend(spark, sf), F.lit(SINCE))
    return k.select("visitors", "uploads", r("revenue", 4), r("spend", 2), r("cpa", 4), r("roas", 8), r("upload_cvr", 4))


@query("g41_kpi_alerts", f"""WITH {ACT}, {SPEND}, {SQL_DAILYC}, c AS (SELECT campaign, sum(ad_spend) AS spend FROM sp GROUP BY campaign),
k AS (SELECT campaign, sum(uploads) AS uploads, sum(unique_visitors) AS visitors, any_value(spend) AS spend FROM dc JOIN c USING (campaign) GROUP BY campaign),
x AS (SELECT campaign, spend / uploads AS cpa, uploads / visitors * 100 AS cvr, spend FROM k)
SELECT campaign, 'HIGH_CPA' AS alert FROM x WHERE cpa > 67000 UNION ALL SELECT campaign, 'LOW_CVR' FROM x WHERE cvr < 26 UNION ALL SELECT campaign, 'UNDER_SPEND' FROM x WHERE spend < 6250000""")
def g41(spark, sf):
    cost = spend(spark, sf).groupBy("campaign").agg(F.sum("ad_spend").alias("spend"))
    k = daily(spark, sf).groupBy("campaign").agg(F.sum("uploads").alias("uploads"), F.sum("unique_visitors").alias("visitors")).join(cost, "campaign")
    k = k.select("campaign", (F.col("spend") / F.col("uploads")).alias("cpa"), (F.col("uploads") / F.col("visitors") * 100).alias("upload_cvr"), "spend")
    return campaigns.kpi_alerts(k, 67_000.0, 26.0, 6_250_000.0).select("campaign", "alert")


@query("j09_actions_with_spend", f"""WITH {ACT}, {SPEND}, c AS (SELECT campaign, sum(ad_spend) AS spend FROM sp GROUP BY campaign)
SELECT campaign, action, count(*) AS actions, round(any_value(spend), 2)::DOUBLE AS spend FROM act JOIN c USING (campaign) GROUP BY campaign, action""")
def j09(spark, sf):
    return campaigns.spend_by_action(actions(spark, sf), spend(spark, sf)).select("campaign", "action", "actions", r("spend", 2))

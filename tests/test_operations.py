"""Bundles, sign-ups, statistics over skewed groups."""

import hashlib
import random

from pyspark.sql import functions as F

from tempaudit.operators import bundles, stats, usage


def test_digests_in_path_order(spark):
    rows = [(b, f"p{i:03d}", hashlib.sha256(f"{b}{i}".encode()).hexdigest(), i * 7) for b in range(5) for i in range(40 if b == 2 else 6)]
    random.Random(1).shuffle(rows)
    m = spark.createDataFrame(rows, "bundle_id long, path string, sha256 string, size_bytes long")
    want = {b: hashlib.sha256("".join(f"sha256 {s} {p}\n" for bb, p, _, s in sorted(rows) if bb == b).encode()).hexdigest() for b in range(5)}
    assert {r["bundle_id"]: r["digest"] for r in bundles.root_digest(m).collect()} == want


def test_digests_with_nulls_at_any_size(spark):
    rows = [(None, f"p{i}", None if i % 3 == 0 else f"h{i}") for i in range(7)] + [(2**60 + 1, None, "x"), (2**60 + 1, "a", "y"), (5, "only", None)]
    want = {None: "h1h2h4h5", 2**60 + 1: "xy", 5: ""}
    for n in (1, 3, 50):  # rows and partitions change nothing
        m = spark.createDataFrame(rows, "bundle_id long, path string, sha256 string").repartition(n)
        got = {r["bundle_id"]: r["digest"] for r in bundles.content_digest(m).collect()}
        assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_recent_jobs_and_directory_times(spark):
    jobs = spark.createDataFrame([(i, 1, i) for i in range(80)], "job_id long, user_id long, us long")
    assert usage.recent_jobs(jobs, 70).count() == 70
    names = spark.createDataFrame([("2024-03-05_070809_ab12",), ("20240305_070809_ab12",), ("misc",)], "d string")
    assert [r.t for r in names.select(F.unix_seconds(usage.job_time(F.col("d"))).alias("t")).collect()] == [1709622489, None, None]


def test_signup_rules_against_loop(form, spark):
    rng, rows = random.Random(3), []
    for i in range(120):
        user = f"u{rng.randint(0, 6)}{rng.choice('x123')}"
        rows.append((f"ip{rng.randint(0, 4) if i % 3 else 0}", f"fp{rng.randint(0, 9)}", f"{user}@{rng.choice(['a.com', 'yopmail.com'])}",
                     rng.randint(0, 40) * 60_000_000, i))
    df = spark.createDataFrame(rows, "ip string, fingerprint string, email string, us long, seq long")
    got = {
        r["seq"]: (r["recent_ip"], r["prior_device"], r["rule"]) for r in usage.signup_rules(df, 30, 15, 1, 120).collect()}
    ordered = sorted(rows, key=lambda r: (r[3], r[4]))
    for n, (ip, fp, email, us, seq) in enumerate(ordered):
        before = ordered[:n]
        mine = [b for b in before if b[0] == ip]
        recent = [b for b in mine if b[3] > us - 86_400_000_000]
        device = sum(b[1] == fp for b in before)
        prefix = email.split("@")[0]
        if len(recent) >= 30:
            rule = "ip_limit"
        elif device >= 15:
            rule = "device_limit"
        elif email.endswith("yopmail.com"):
            rule = "throwaway_domain"
        elif recent and us - max(b[3] for b in recent) < 120_000_000:
            rule = "rapid"
        elif any(prefix[:-1] == b[2].split("@")[0][:-1] and prefix[-1].isdigit() and b[2].split("@")[0][-1].isdigit() for b in mine):
            rule = "sequential_email"
        else:
            rule = "ok"
        assert got[seq] == (len(recent), device, rule)


def test_order_statistic(form, spark):
    rng = random.Random(5)
    values = [(g, float(rng.randint(0, 30))) for g in (1, 2) for _ in range(50 * g)]
    df = spark.createDataFrame(values, "g long, v double")
    got = {r["g"]: r["x"] for r in stats.order_statistic(df, "v", F.floor(F.col("_n") * 0.95), "x", ["g"]).collect()}
    for g in (1, 2):
        mine = sorted(v for k, v in values if k == g)
        assert got[g] == mine[int(0.95 * len(mine))]


def test_pages_are_clamped(form, spark):
    df = spark.createDataFrame([(1, i, i * 10) for i in range(12)] + [(2, 100, 5)], "user_id long, job_id long, us long")
    got = usage.page_of(df, 9).collect()
    assert sorted(r["job_id"] for r in got if r["user_id"] == 1) == [0, 1] and [r["job_id"] for r in got if r["user_id"] == 2] == [100]


def test_quota(spark):
    rows = [("free", 2, 2, None), ("pro", 3, 5, 2.0), ("pro", 3, 5, None), ("ent", -1, 99, None), ("pro", 3, 1, None)]
    df = spark.createDataFrame(rows, "plan string, quota long, used long, overage_price double")
    got = [(r["allowed"], r["code"], r["remaining"], r["overage"]) for r in usage.quota_status(df).collect()]
    assert got == [(False, "FREE_TIER_EXCEEDED", 0, 0), (True, "OK", 0, 2), (False, "MONTHLY_QUOTA_EXCEEDED", 0, 2), (True, "OK", None, 0), (True, "OK", 2, 0)]


def test_order_statistics_start_no_job_and_take_any_values(spark):
    inf = float("inf")
    groups = {"a": [-inf, -3.5, -3.5, -1e-9, 0.0, 2e-308, 7.0, 7.0000001, 1e300, inf], "b": [5.0] * 9, None: [1.0, 2.0, 3.0], "c": [None]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    for share in (0.0, 0.3, 0.5, 0.95):
        plan = stats.order_statistic(df, "v", F.floor(F.col("_n") * share), "x", ["g"])
        whole = stats.order_statistic(df, "v", F.floor(F.col("_n") * share), "x")
        assert len(tracker.getJobIdsForGroup()) == before
        want = {g: sorted(vs)[int(len(vs) * share)] for g, vs in groups.items() if g != "c"}
        every = sorted(v for vs in groups.values() for v in vs if v is not None)
        assert {r["g"]: r["x"] for r in plan.collect()} == want
        assert [r["x"] for r in whole.collect()] == [every[int(len(every) * share)]]
        before = len(tracker.getJobIdsForGroup())

"""Small row functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: plan names in rank order
PLAN_RANKS = ("free", "starter", "pro", "business", "enterprise")


def once(x: Column) -> Column:
    """Select ``x`` so that it is evaluated once per row.

    The optimizer copies an expression into every filter and projection above it; an explode of a
    single element stops that.  For costly expressions only (parsed records, built lines).
    """
    return F.explode(F.array(x))


def safe_double(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def safe_int(x: Column, default: int = 0) -> Column:
    """Integer by way of double, so ``3.9`` gives 3."""
    return F.coalesce(x.try_cast("double").cast("long"), F.lit(default).cast("long"))


def conservative_threshold(target: Column, uncertainty: Column) -> Column:
    return target + uncertainty


def tolerance_check(a: Column, b: Column, tolerance: Column, default_relative=0.05, exact_below=None) -> Column:
    """Compare two values: absolute tolerance where one is given, else relative to the larger magnitude."""
    diff = F.abs(a - b)
    rel = F.when(F.greatest(F.abs(a), F.abs(b)) > 0, diff / F.greatest(F.abs(a), F.abs(b))).otherwise(0.0)
    both_zero = (a == 0) & (b == 0)
    exact = both_zero if exact_below is None else both_zero | (diff < exact_below)
    within = F.when(a.isNull() | b.isNull(), False).when(exact, True).when(
        tolerance.isNotNull(), diff <= tolerance).otherwise(rel <= default_relative)
    kind = F.when(a.isNull() | b.isNull(), "N/A").when(exact, "exact").when(
        tolerance.isNotNull(), "absolute").otherwise("relative")
    return F.struct(diff.alias("difference"), rel.alias("relative_error"), within.alias("within_tolerance"),
                    kind.alias("tolerance_type"))


def content_hash(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def short_run_id(spec_json: Column, content: Column) -> Column:
    """First 10 hex digits over the specification and the raw content."""
    return F.substring(F.sha2(F.concat(spec_json.cast("binary"), content.cast("binary")), 256), 1, 10)


def email_hash(email: Column) -> Column:
    return F.substring(F.sha2(email.cast("binary"), 256), 1, 16)


def one_of(value: Column, aliases: dict[str, str]) -> Column:
    """Replace known aliases, leave the rest."""
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[value], value)


def status_of(df: DataFrame) -> Column:
    """Status from new or legacy fields: ``status``, else ``decision``, else the pass flag."""
    parts = [F.col(c) for c in ("status", "decision") if c in df.columns]
    flags = [F.col(c) for c in ("pass", "pass_") if c in df.columns]
    if flags:
        parts.append(F.when(F.coalesce(*flags), "PASS").when(~F.coalesce(*flags), "FAIL"))
    return F.coalesce(*parts)


def consistent_status(status: Column, passed: Column) -> Column:
    """PASS without the pass flag is FAIL and the reverse; other classes stay."""
    return F.when((status == "PASS") & ~passed, "FAIL").when((status == "FAIL") & passed, "PASS").otherwise(status)


def join_reasons(*reasons: Column) -> Column:
    return F.array_compact(F.array(*reasons))


# -- log fields ----------------------------------------------------------------------------------

LOG_SCHEMA = ("time string, level string, msg string, path string, method string, status int, duration_ms double, duration double")


def log_record(line: Column) -> Column:
    """JSON log fields, null for free text."""
    return F.from_json(F.when(F.trim(line).startswith("{"), line), LOG_SCHEMA)


def log_time(line: Column, record: Column) -> Column:
    text = F.coalesce(record["time"], F.nullif(F.regexp_extract(
        line, r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)", 1), F.lit("")))
    return F.try_to_timestamp(text)


def _number(text: Column) -> Column:
    return text.try_cast("double")


# fixed values: the patterns and words of the service's log lines
COMPILE_WORDS = "compilation|compile|processing completed"
TOOK_SECONDS = r"(?i)(?:completed|took|finished).*?(\d+\.?\d*)\s*(?:s|sec|seconds)(?![a-z])"
TOOK_MILLIS = r"(?i)(?:duration|took).*?(\d+)\s*(?:ms|milliseconds)"
ACCESS_LINE = r'"([A-Z]+)\s+([^"]+)"\s+(\d+)\s+(\d+)'
VERIFY_MESSAGES, VERIFY_LINES = "verify|verification|bundle check", "verify|verification|bundle"
BAD_MESSAGES, BAD_LINES = "error|fail", "error|fail|invalid|corrupt"


def compile_seconds(line: Column, record: Column) -> Column:
    """Compile duration in seconds from structured fields or from ``took 3.2s`` / ``took 250 ms``."""
    about = F.lower(record["msg"]).rlike(COMPILE_WORDS)
    structured = F.when(about, F.coalesce(record["duration_ms"] / 1000, record["duration"]))
    in_s = _number(F.regexp_extract(line, TOOK_SECONDS, 1))
    in_ms = _number(F.regexp_extract(line, TOOK_MILLIS, 1)) / 1000
    return F.coalesce(structured, in_s, in_ms)


def request_fields(line: Column, record: Column) -> Column:
    structured = record["status"].isNotNull() & record["method"].isNotNull()
    part = lambda i: F.nullif(F.regexp_extract(line, ACCESS_LINE, i), F.lit(""))
    return F.struct(
        F.when(structured, record["method"]).otherwise(part(1)).alias("method"),
        F.when(structured, F.coalesce(record["path"], F.lit(""))).otherwise(part(2)).alias("path"),
        F.when(structured, record["status"]).otherwise(part(3).cast("int")).alias("status"))


def verify_event(line: Column, record: Column) -> Column:
    """Null for other lines, else whether the verification failed."""
    msg, raw = F.lower(record["msg"]), F.lower(line)
    structured = F.when(msg.rlike(VERIFY_MESSAGES), msg.rlike(BAD_MESSAGES))
    free = F.when(raw.rlike(VERIFY_LINES), raw.rlike(BAD_LINES))
    return F.coalesce(structured, free)


# -- billing and attribution -----------------------------------------------------------------------


def monthly_cost(used: Column, included: Column, base: Column, overage_price: Column) -> Column:
    price = F.coalesce(overage_price, F.lit(0.0))
    extra = F.when((price > 0) & (used > included), used - included).otherwise(0)
    base = F.coalesce(base, F.lit(0.0))
    return F.struct(base.alias("base"), (extra * price).alias("overage"), (base + extra * price).alias("total"),
                    extra.cast("long").alias("overage_count"))


def can_upgrade(current: Column, target: Column) -> Column:
    ranks = F.array(*map(F.lit, PLAN_RANKS))
    a, b = F.coalesce(F.array_position(ranks, current), F.lit(0)), F.coalesce(F.array_position(ranks, target), F.lit(0))
    return (a > 0) & (b > 0) & (b > a)


def touch_credits(first: Column, last: Column, referral: Column, revenue: Column) -> Column:
    """Array of (touch, credit): 40 % first, 40 % last, 80 % when equal; a referral takes 20 % and
    leaves the others at four fifths."""
    scale = F.when(referral.isNotNull(), 0.8).otherwise(1.0)
    credit = lambda key, share: F.struct(key.alias("touch"), (revenue * share).alias("credit"))
    return F.array_compact(F.array(
        F.when(first == last, credit(first, 0.8 * scale)).otherwise(credit(first, 0.4 * scale)),
        F.when(first != last, credit(last, 0.4 * scale)),
        F.when(referral.isNotNull(), credit(F.concat(F.lit("referral_"), referral), F.lit(0.2)))))

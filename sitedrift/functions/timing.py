"""Schedules, retries and status as columns. Moments are timestamps, intervals hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS, HOUR_MS = 86_400_000, 3_600_000
#: Waits before the next attempt, by attempt.
RETRY_MS = (300_000, 900_000, 3_600_000)


def _ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def next_due_after_success(due: Column, hours: Column, now: Column) -> Column:
    """The first deadline after now in the phase of the stored one (or of now, where there is none)."""
    step = (hours.cast("double") * HOUR_MS).cast("long")
    prev = F.coalesce(_ms(due), _ms(now))
    n = F.greatest(F.lit(0), F.floor((_ms(now) - prev) / step)) + 1
    return F.timestamp_millis(prev + n * step)


def next_due_catch_up(due: Column, hours: Column, now: Column) -> Column:
    """At scheduling: whole intervals from the due moment until it lies after now."""
    step = (hours.cast("double") * HOUR_MS).cast("long")
    late = F.floor(F.greatest(F.lit(0), _ms(now) - _ms(due)) / step)
    return F.timestamp_millis(_ms(due) + (late + 1) * step)


def candidate_expiry(observed: Column, hours: Column) -> Column:
    """Three intervals, but at least 72 hours and at most 14 days."""
    stay = F.least(F.lit(14 * DAY_MS), F.greatest(F.lit(3 * DAY_MS), (hours.cast("double") * (3 * HOUR_MS)).cast("long")))
    return F.timestamp_millis(_ms(observed) + stay)


def retry_delay_ms(retryable: Column, attempt: Column, retry_after_ms: Column) -> Column:
    """null if it isn't retried: not retryable, or four attempts made."""
    wait = F.when(attempt <= 1, RETRY_MS[0]).when(attempt == 2, RETRY_MS[1]).otherwise(RETRY_MS[2])
    return F.when(retryable & (attempt < 4), F.greatest(wait.cast("long"), F.coalesce(retry_after_ms, F.lit(0))))


def retry_after_ms(header: Column, now: Column) -> Column:
    """Milliseconds of a Retry-After header: seconds, or an HTTP date less now and at least 0; null if unreadable."""
    text = F.trim(header)
    at = F.try_to_timestamp(F.regexp_extract(text, "^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(text.rlike("^[0-9]{1,15}$"), text.try_cast("long") * 1000).otherwise(
        F.when(at.isNotNull(), F.greatest(F.lit(0).cast("long"), _ms(at) - _ms(now)))
    )


def suspicious(previous: Column, missing: Column, current: Column, least: int = 100, ratio: float = 0.3) -> Column:
    """Everything gone, or both many and a large share missing."""
    share = (missing >= least) & (missing / F.greatest(previous, F.lit(1)) >= ratio)
    return (previous > 0) & ((current == 0) | share)


def website_status(
    target_id: Column, archived_at: Column, enabled: Column, active_run: Column, last_error: Column, baseline: Column
) -> Column:
    return (
        F.when(target_id.isNull(), F.lit("No monitor"))
        .when(archived_at.isNotNull(), F.lit("Archived"))
        .when(~F.coalesce(enabled, F.lit(False)), F.lit("Paused"))
        .when(active_run.isNotNull(), active_run)
        .when(F.coalesce(last_error, F.lit("")) != "", F.lit("failed"))
        .when(baseline.isNull(), F.lit("Awaiting baseline"))
        .otherwise(F.lit("active"))
    )


def parse_timestamp(text: Column) -> Column:
    """Epoch milliseconds or an ISO text; null if neither."""
    t = F.trim(text)
    return F.when(t.rlike("^[0-9]{1,15}$"), F.timestamp_millis(t.try_cast("long"))).otherwise(F.try_to_timestamp(t))

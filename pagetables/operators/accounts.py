"""Entitlement and usage accounting over event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.functions import payload as J
from pagetables.functions.text import clean_warnings, normalize_email, truthy
from pagetables.operators.ranking import top_k
from pagetables.operators.timeline import with_last, with_next, with_running_count

# --- fixed values: results depend on these exact numbers and texts -----------
FREE_REQUESTS = 3
FREE_LISTINGS = 50
SUBSCRIPTION_DAYS = 31
RECHECK_HOURS = 6
PAID_PLANS = ["category", "pro"]
PLAN_LABELS = {"free": "Free", "category": "Category", "pro": "Full Access"}
ENDED_STATUSES = ["unpaid", "incomplete_expired", "paused"]
FREE_NOTICE = "Free plan includes the first {limit} listings. Upgrade to export the complete result."
# --- end of fixed values -----------------------------------------------------


def _days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def subscription_periods(activations: DataFrame, user: str = "user", days: int = SUBSCRIPTION_DAYS) -> DataFrame:
    """[start, end) of every activation; a later one replaces the rest of an earlier one."""
    ahead = with_next(activations, user, "ts", ["ts", "event_id"], "_next")
    return ahead.withColumn("period_end", F.least(F.col("ts") + _days(days), F.col("_next"))).drop("_next")


def subscription_asof(events: DataFrame, user: str = "user") -> DataFrame:
    """Each event with the latest activation (rows with a `plan`) at or before it."""
    activation = F.when(
        F.col("plan").isNotNull(), F.struct(F.col("plan").alias("plan"), F.col("ts").alias("activated_at"))
    )
    found = with_last(events, user, "ts", ["ts", "event_id"], activation, "_active")
    return found.withColumn("active_plan", F.col("_active.plan")).withColumn(
        "activated_at", F.col("_active.activated_at")
    ).drop("_active")


def effective_plan(
    events: DataFrame, user: str = "user", days: int = SUBSCRIPTION_DAYS, lifetime: Sequence = ()
) -> DataFrame:
    """Plan in force at each event: lifetime users are pro, a running subscription counts, else free."""
    active = subscription_asof(events, user)
    running = F.col("active_plan").isin(*PAID_PLANS) & (F.col("activated_at") + _days(days) > F.col("ts"))
    granted = F.col(user).isin(*lifetime) if lifetime else F.lit(False)
    plan = F.when(granted, F.lit("pro")).when(running, F.col("active_plan")).otherwise(F.lit("free"))
    return active.withColumn("effective_plan", plan).drop("active_plan", "activated_at")


def free_quota(requests: DataFrame, user: str = "user", limit: int = FREE_REQUESTS) -> DataFrame:
    """Requests with their quota state. Free requests 1..limit count, later ones are denied and do not.

    The count runs over chunks of the time line, so a busy user never goes through one window.
    """
    is_free = F.col("effective_plan") == "free"
    counted = with_running_count(requests, user, "ts", ["ts", "event_id"], is_free, "_seen")
    used = F.least(F.col("_seen"), F.lit(limit)).cast("int")
    return (
        counted.withColumn("allowed", ~is_free | (F.col("_seen") <= limit))
        .withColumn("used", used)
        .withColumn("remaining", F.lit(limit) - used)
        .drop("_seen")
    )


def plan_gate(requests: DataFrame, plan: str = "plan", mode: str = "mode") -> DataFrame:
    """Adds `reason` for requests that their plan does not cover; NULL when it does."""
    reason = F.when(
        ~F.col(mode).isin("auto", "website", "category"), F.lit("invalid mode")
    ).when(
        (F.col(plan) == "category") & (F.col(mode) != "category"), F.lit("category plan covers single categories only")
    )
    return requests.withColumn("reason", reason)


#: Columns of an account that its updates may lack, and their first values.
ACCOUNT_DEFAULTS = {
    "free_scrapes_used": 0, "plan": "free", "plan_status": "free", "subscription_id": "",
    "subscription_expires_at": 0, "subscription_checked_at": 0,
}


def account_state(updates: DataFrame, lifetime: Sequence[str] = ()) -> DataFrame:
    """Latest account per normalised e-mail; non-blank new values win over old ones.

    Fields that no update gives have their first values; e-mails in `lifetime` have the full plan for good.
    """
    at = F.struct("ts", "update_id")

    def latest(column: str) -> Column:
        return F.max_by(column, F.when(truthy(column).isNotNull(), at))

    def newest(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), at))

    given = [c for c in ACCOUNT_DEFAULTS if c in updates.columns]
    keyed = updates.withColumn("email", normalize_email("email")).filter("email <> ''")
    state = keyed.groupBy("email").agg(
        latest("name").alias("name"),
        latest("picture").alias("picture"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        *[newest(c).alias(c) for c in given],
    )
    state = state.withColumns({
        "name": F.coalesce(truthy("name"), F.col("email")), "picture": F.coalesce(truthy("picture"), F.lit("")),
        **{c: F.coalesce(c, F.lit(v)) if c in given else F.lit(v) for c, v in ACCOUNT_DEFAULTS.items()},
        "lifetime_access": F.col("email").isin(*lifetime) if lifetime else F.lit(False),
    })
    forever = {"plan": "pro", "plan_status": "lifetime", "subscription_expires_at": 0}
    return state.withColumns({c: F.when(F.col("lifetime_access"), F.lit(v)).otherwise(F.col(c)) for c, v in forever.items()})


def account_report(accounts: DataFrame, now: Column, limit: int = FREE_REQUESTS) -> DataFrame:
    """Public view of accounts: label, status, expiry date, free requests used and left.

    Expects email, plan, plan_status, expires_at, free_used, lifetime.
    """
    running = F.col("plan").isin(*PAID_PLANS) & (F.col("expires_at") > now)
    plan = F.when(F.col("lifetime"), F.lit("pro")).when(running, F.col("plan")).otherwise(F.lit("free"))
    label = F.lit("Free")
    for name, text in PLAN_LABELS.items():
        label = F.when(F.col("effective_plan") == name, F.lit(text)).otherwise(label)
    used = F.coalesce(F.col("free_used"), F.lit(0))
    return accounts.withColumn("effective_plan", plan).select(
        "email",
        F.col("effective_plan").alias("plan"),
        label.alias("label"),
        F.when(F.col("lifetime"), F.lit("lifetime")).otherwise(F.col("plan_status")).alias("plan_status"),
        F.coalesce(F.date_format("expires_at", "yyyy-MM-dd"), F.lit("")).alias("expires_label"),
        used.alias("free_used"),
        F.lit(limit).alias("free_limit"),
        F.greatest(F.lit(0), F.lit(limit) - used).alias("free_remaining"),
        "lifetime",
    )


def period_end(subscription: Column | str) -> Column:
    """End of a subscription payload: its own field, else the latest of its items, else 0."""
    s = F.from_json(
        F.col(subscription) if isinstance(subscription, str) else subscription,
        "current_period_end bigint, items struct<data:array<struct<current_period_end:bigint>>>",
    )
    of_items = F.array_max(F.transform(s["items"]["data"], lambda i: i["current_period_end"]))
    return F.coalesce(F.nullif(s["current_period_end"], F.lit(0)), of_items, F.lit(0))


def stale_subscriptions(accounts: DataFrame, now: Column, hours: int = RECHECK_HOURS) -> DataFrame:
    """Accounts whose subscription is due for a re-check."""
    due = F.col("checked_at").isNull() | (F.col("checked_at") + F.make_dt_interval(hours=F.lit(hours)) <= now)
    return accounts.filter(
        (F.coalesce(F.col("subscription_id"), F.lit("")) != "") & ~F.coalesce(F.col("lifetime"), F.lit(False)) & due
    )


def refresh_subscriptions(accounts: DataFrame, payload: str, now: Column) -> DataFrame:
    """Applies a fetched subscription payload: status, period end, and an end at once for ended ones."""
    end = period_end(payload)
    status = J.scalar_text(J.fields(payload)["status"])
    renewed = F.when(end != 0, F.timestamp_seconds(end)).otherwise(F.col("expires_at"))
    return accounts.withColumn("_status", status).select(
        *[c for c in accounts.columns if c not in ("expires_at", "plan_status", "checked_at", payload)],
        F.when(F.col("_status").isin(*ENDED_STATUSES), F.least(renewed, now)).otherwise(renewed).alias("expires_at"),
        F.coalesce(truthy("_status"), F.col("plan_status")).alias("plan_status"),
        now.alias("checked_at"),
    )


def job_latest(updates: DataFrame, job: str = "job", fields: Sequence[str] = ("status", "message", "counts")) -> DataFrame:
    """Latest value of each field per job; an update that leaves a field out keeps the old one."""
    at = F.struct("ts", "event_id")
    return updates.groupBy(job).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields],
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


def free_plan_view(listings: DataFrame, order: Sequence[Column], limit: int = FREE_LISTINGS) -> DataFrame:
    """Listings that a free plan shows: the first ones per site."""
    return top_k(listings, ["site"], order, limit)


def free_plan_counts(kept: DataFrame, counts: DataFrame, limit: int = FREE_LISTINGS) -> DataFrame:
    """Counters of a site after the free-plan cut. `kept` comes from `free_plan_view` and has `images`."""
    per_site = kept.groupBy("site").agg(
        F.count(F.lit(1)).alias("_listings"), F.count_if(F.col("model_number") != "").alias("_models")
    )
    images = kept.select("site", F.explode("images").alias("src")).filter("src <> ''").distinct()
    per_image = images.groupBy("site").agg(F.count(F.lit(1)).alias("_images"))
    joined = counts.join(per_site, "site", "left").join(per_image, "site", "left")
    left = F.coalesce(F.col("_listings"), F.lit(0))
    notice = F.when(F.col("listings") > limit, F.lit(FREE_NOTICE.format(limit=limit)))
    return joined.select(
        "site",
        left.alias("listings"),
        F.least(F.col("detail_pages"), left).alias("detail_pages"),
        F.coalesce("_models", F.lit(0)).alias("model_numbers"),
        F.coalesce(F.col("_images"), F.col("images")).alias("images"),
        clean_warnings(notice).alias("warning"),
    )



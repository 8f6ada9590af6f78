"""Order, licence and promoter statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import LIFETIME_END, ntz, period_key, plan_days, plan_expiry
from .sequences import day_block, page_of, running

MONEY = "decimal(28,2)"
DEFAULT_PRODUCT = "default"
DEFAULT_RATE = 0.2
CHANNEL_PATTERN = "^P_[A-Z0-9_]{2,32}$"  # fixed value: accepted promoter codes


def money(column: str = "amount") -> Column:
    return F.coalesce(F.sum(F.col(column).cast(MONEY)), F.lit(0)).cast("double")


def product_or_default(default: str = DEFAULT_PRODUCT) -> Column:
    return F.when(F.coalesce("product", F.lit("")) == "", default).otherwise(F.col("product"))


def active_subscriptions(licenses: DataFrame, now: Column) -> DataFrame:
    live = licenses.where((F.col("status") == "active") & (F.col("device_id") != "") & (F.col("expires_at") > now))
    return live.rollup("plan").agg(F.count("*").alias("licenses"), F.grouping("plan").alias("is_total"))


def pending_orders(orders: DataFrame) -> DataFrame:
    return (orders.where(F.col("status") == "pending").rollup("plan")
            .agg(F.count("*").alias("orders"), money().alias("amount"), F.grouping("plan").alias("is_total")))


def pending_by_product(orders: DataFrame) -> DataFrame:
    return (orders.where(F.col("status") == "pending").groupBy(product_or_default().alias("product"))
            .agg(F.count("*").alias("orders"), money().alias("amount")))


def _paid_by(orders: DataFrame, period: str) -> DataFrame:
    return (orders.where((F.col("status") == "paid") & F.col("paid_at").isNotNull())
            .withColumn("period", period_key("paid_at", period)))


def revenue_by_period(orders: DataFrame, period: str = "month") -> DataFrame:
    return _paid_by(orders, period).groupBy("period", "plan").agg(F.count("*").alias("orders"), money().alias("revenue"))


def revenue_report(orders: DataFrame, period: str = "month") -> DataFrame:
    """Period rows with a subtotal row per period."""
    subtotal = F.grouping("plan")
    return (_paid_by(orders, period).groupingSets([("period", "plan"), ("period",)], "period", "plan")
            .agg(F.count("*").alias("orders"), money().alias("revenue"), subtotal.alias("is_subtotal")))


def revenue_totals(orders: DataFrame) -> DataFrame:
    """Overall, per plan and per product in one pass over the paid orders."""
    paid = orders.where(F.col("status") == "paid").withColumn("product", product_or_default())
    return (paid.groupingSets([(), ("plan",), ("product",)], "plan", "product")
            .agg(F.count("*").alias("orders"), money().alias("revenue"),
                 F.grouping("plan").alias("gp"), F.grouping("product").alias("gr"))
            .select(F.when(F.col("gp") == 0, "plan").when(F.col("gr") == 0, "product").otherwise("all").alias("level"),
                    F.coalesce("plan", "product", F.lit("")).alias("key"), "orders", "revenue"))


def new_licenses_by_month(licenses: DataFrame, months: int = 12) -> DataFrame:
    """Licences per month and plan in the newest `months`; ranked after the counts, a few rows per month."""
    return (licenses.where(F.col("starts_at").isNotNull())
            .groupBy(period_key("starts_at", "month").alias("month"), "plan").agg(F.count("*").alias("licenses"))
            .withColumn("nth", F.dense_rank().over(W.orderBy(F.desc("month")))).where(F.col("nth") <= months).drop("nth"))


def active_devices(licenses: DataFrame, now: Column, days: int, approximate: bool = False) -> DataFrame:
    """Distinct devices seen in the last `days`, and bound licences never seen.

    A licence table without the last-seen column gives available = 0."""
    if "last_seen_at" not in licenses.columns:
        return licenses.agg(F.lit(0).cast("bigint").alias("available"), F.lit(0).cast("bigint").alias("devices"),
                            F.lit(0).cast("bigint").alias("never_seen"))
    live = licenses.where((F.col("status") == "active") & (F.col("device_id") != ""))
    recent = F.when(F.col("last_seen_at") >= now - F.make_dt_interval(days=F.lit(days)), F.col("device_id"))
    distinct = F.approx_count_distinct(recent) if approximate else F.count_distinct(recent)
    return live.agg(F.lit(1).cast("bigint").alias("available"), distinct.alias("devices"),
                    F.count_if(F.col("last_seen_at").isNull()).alias("never_seen"))


def activation_codes_summary(codes: DataFrame) -> DataFrame:
    return codes.groupBy("plan").agg(F.count_if(F.col("used") == 0).alias("unused"),
                                     F.count_if(F.col("used") == 1).alias("used"))


def promoter_rate(channels: DataFrame, promoters: DataFrame) -> DataFrame:
    """Attach the promoter name and a commission rate clamped to 0..1; unknown codes get the default rate.

    The promoter table is a dimension; Spark broadcasts it while it stays under the size threshold."""
    dim = promoters.select(F.col("code"), F.col("name"), F.col("commission_rate").cast("double").alias("rate"))
    return channels.join(dim, "code", "left").select(
        *channels.columns, F.coalesce("name", F.lit("")).alias("name"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("rate", F.lit(DEFAULT_RATE)))).alias("commission_rate"))


def channel_summaries(orders: DataFrame, promoters: DataFrame, products: list[str],
                      product: str = "", status: str = "paid") -> DataFrame:
    """Orders, revenue and commission per channel, with a column pair per listed product."""
    rows = orders.where(F.coalesce("channel_code", F.lit("")) != "")
    if product in products:
        rows = rows.where(F.col("product") == product)
    if status in ("pending", "paid"):
        rows = rows.where(F.col("status") == status)
    per_product = []
    for name in products:
        hit = F.col("product") == name
        per_product += [F.count_if(hit).alias(f"{name}_orders"),
                        F.coalesce(F.sum(F.when(hit, F.col("amount").cast(MONEY))), F.lit(0)).cast("double")
                        .alias(f"{name}_revenue")]
    grouped = rows.groupBy(F.col("channel_code").alias("code")).agg(
        F.count("*").alias("orders"), money().alias("revenue"), *per_product)
    return promoter_rate(grouped, promoters).withColumn(
        "commission", F.round(F.col("revenue") * F.col("commission_rate"), 2))


def stats_bundle(orders: DataFrame, licenses: DataFrame, codes: DataFrame, promoters: DataFrame,
                 products: list[str], now: Column, period: str = "month", days: int = 30) -> DataFrame:
    """All statistics as one long table (metric, key1, key2, value)."""

    def long(df: DataFrame, metric: str, key1, key2, values: list[str]) -> DataFrame:
        text = lambda c: F.lit("") if c is None else F.coalesce(F.col(c).cast("string"), F.lit("total"))
        pairs = ", ".join(f"'{metric}.{v}', cast({v} as double)" for v in values)
        return df.select(text(key1).alias("key1"), text(key2).alias("key2"), *values).selectExpr(
            f"stack({len(values)}, {pairs}) as (metric, value)", "key1", "key2")

    parts = [
        long(active_subscriptions(licenses, now), "subscriptions", "plan", None, ["licenses"]),
        long(pending_orders(orders), "pending", "plan", None, ["orders", "amount"]),
        long(pending_by_product(orders), "pending_product", "product", None, ["orders", "amount"]),
        long(revenue_by_period(orders, period), "revenue", "period", "plan", ["orders", "revenue"]),
        long(revenue_totals(orders), "revenue_total", "level", "key", ["orders", "revenue"]),
        long(new_licenses_by_month(licenses), "new_licenses", "month", "plan", ["licenses"]),
        long(active_devices(licenses, now, 7), "devices_7d", None, None, ["devices", "never_seen"]),
        long(active_devices(licenses, now, days), "devices", None, None, ["devices", "never_seen"]),
        long(activation_codes_summary(codes), "codes", "plan", None, ["unused", "used"]),
        long(channel_summaries(orders, promoters, products), "channel", "code", None,
             ["orders", "revenue", "commission"]),
    ]
    return reduce(DataFrame.unionByName, parts).select("metric", "key1", "key2", "value")


def order_filter(orders: DataFrame, product: str = "", status: str = "", channel: str = "",
                 date_from: str = "", date_to: str = "", products: tuple[str, ...] = ()) -> DataFrame:
    """Apply the optional conditions; an unknown product or status is ignored, `__NONE__` means no channel."""
    product, status, channel = product.strip().lower(), status.strip().lower(), channel.strip().upper()
    rows = orders
    if product in products:
        rows = rows.where(F.col("product") == product)
    if status in ("pending", "paid", "free"):
        rows = rows.where(F.col("status") == status)
    if channel == "__NONE__":
        rows = rows.where(F.coalesce("channel_code", F.lit("")) == "")
    elif channel:
        rows = rows.where(F.col("channel_code") == channel)
    if date_from.strip():
        rows = rows.where(F.col("created_at") >= F.lit(date_from.strip()).cast("timestamp_ntz"))
    if date_to.strip():
        end = date_to.strip()
        end += " 23:59:59" if len(end) == 10 else ""
        rows = rows.where(F.col("created_at") <= F.lit(end).cast("timestamp_ntz"))
    return rows


def list_orders(orders: DataFrame, page: int = 1, size: int = 50, **conditions) -> DataFrame:
    """One page of the filtered orders, newest first, each row carrying the filtered total."""
    return page_of(order_filter(orders, **conditions), day_block("created_at"),
                   [F.desc("created_at"), F.asc("id")], page, size, max_size=500, descending=True)


def split_channels(codes: DataFrame) -> DataFrame:
    """Trimmed upper-case channel code and whether it is acceptable; blank codes are acceptable as "none"."""
    clean = codes.withColumn("channel", F.upper(F.trim(F.coalesce("code", F.lit("")))))
    return clean.withColumn("valid", (F.col("channel") == "") | F.col("channel").rlike(CHANNEL_PATTERN))


def latest_active_license(licenses: DataFrame, now: Column) -> DataFrame:
    active = licenses.where((F.col("status") == "active") & (F.col("device_id") != ""))
    best = active.groupBy("device_id").agg(
        F.max_by(F.struct("id", "plan", "expires_at"), F.struct("expires_at", "id")).alias("best"))
    return best.select("device_id", "best.*").where(F.col("expires_at") >= now)


def stack_expiry(orders: DataFrame) -> DataFrame:
    """Start and end of the licence each paid order buys, renewals continuing from the furthest expiry so far.

    With M the furthest expiry after an order, every order acts as M = max(M + d, b): d days and b = t + d for
    timed plans, d = 0 and b = the fixed end for lifetime plans. So M = D + max(b - D) with D the running sum
    of d: two running aggregates, no per-device fold."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    secs = lambda c: F.timestamp_diff("SECOND", epoch, c)
    issued = (orders.where(F.col("status").isin("paid", "free") & (F.col("device_id") != ""))
              .select("device_id", "okey", "id", "plan", "paid_at")
              .withColumn("d", F.coalesce(plan_days("plan"), F.lit(0)).cast("bigint") * 86400)
              .withColumn("t", secs(F.col("paid_at")))
              .withColumn("b", F.when(F.col("plan") == "lifetime", secs(ntz(LIFETIME_END))).otherwise(F.col("t") + F.col("d"))))
    block = F.date_trunc("YEAR", "paid_at")
    order = ["paid_at", "okey"]
    summed = running(issued, ["device_id"], block, order, sums={"cum": F.col("d")})
    prior = running(summed, ["device_id"], block, order, maxes={"lead_before": F.col("b") - F.col("cum")},
                    inclusive=False)
    before = F.col("cum") - F.col("d") + F.col("lead_before")
    start = F.greatest(F.col("t"), before)
    back = lambda c: F.timestamp_add("SECOND", c, epoch)
    return prior.select("device_id", "id", "plan", "paid_at", back(start).alias("starts_at")).withColumn(
        "expires_at", plan_expiry("plan", "starts_at"))


def unbind_quota(events: DataFrame, limit: int = 1) -> DataFrame:
    """Number the unbind requests of each licence in a calendar year and reject those past the limit."""
    keyed = events.withColumn("year", F.year("at"))
    numbered = running(keyed, ["license_id", "year"], day_block("at"), ["at", "event_id"], sums={"nth": F.lit(1)})
    return numbered.withColumn("accepted", F.col("nth") <= limit)


def license_state(rows: DataFrame, now: Column, trial_days: int = 30, grace_days: int = 7) -> DataFrame:
    """State of each installation, first matching rule wins."""
    unbound = F.col("license_id").isNull()
    left = F.greatest(F.lit(0), F.lit(trial_days) - F.datediff(now, F.col("installed_at")))
    lifetime = F.col("plan") == "lifetime"
    state = (F.when(unbound & (left > 0), "trial").when(unbound, "trial_expired")
             .when((F.col("license_device") != "") & (F.col("license_device") != F.col("device_id")), "device_mismatch")
             .when(~lifetime & (F.col("expires_at").isNull() | (F.col("expires_at") < now)), "expired")
             .when(F.col("last_online_at").isNull()
                   | (F.col("last_online_at") < now - F.make_dt_interval(days=F.lit(grace_days))),
                   "offline_grace_exceeded")
             .otherwise("ok"))
    return rows.withColumn("state", state).withColumn("trial_days_left", F.when(unbound, left).otherwise(0))

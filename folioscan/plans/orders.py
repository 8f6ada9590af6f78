"""Order, licence and promoter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import PERIODS, ntz, period_key, plan_expiry, stamp
from ..operators import revenue as R
from ..operators.sequences import day_block, page_of
from ..schemas import TABLES, with_defaults
from ..sources.tables import export_all
from .fixtures import ORDER_CLOCK
from .registry import query

PRODUCTS = ["alpha", "beta"]


def now():
    return ntz(ORDER_CLOCK)


MONTHLY = "strftime(paid_at, '%Y-%m')"
SQL_PERIOD = {
    "day": "strftime(paid_at, '%Y-%m-%d')",
    "week": "strftime(paid_at, '%Y-W%W')",
    "month": MONTHLY,
    "quarter": "strftime(paid_at, '%Y') || '-Q' || cast(quarter(paid_at) as varchar)",
    "year": "strftime(paid_at, '%Y')",
}


@query("A7 D4", "d4_revenue_totals", """
select 'all' as level, '' as key, count(*) as orders, cast(sum(amount) as double) as revenue from v_orders where status = 'paid'
union all select 'plan', plan, count(*), cast(sum(amount) as double) from v_orders where status = 'paid' group by plan
union all select 'product', coalesce(nullif(product, ''), 'default'), count(*), cast(sum(amount) as double)
from v_orders where status = 'paid' group by coalesce(nullif(product, ''), 'default')""")
def _(t):
    return R.revenue_totals(t.v_orders)


@query("A7", "a7_table_counts", " union all ".join(
    f"select '{n}' as table_name, count(*) as row_count from {n}" for n in
    ("v_orders", "v_licenses", "v_codes", "v_order_events", "v_promoters")))
def _(t):
    parts = [getattr(t, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("row_count")) for n in
             ("v_orders", "v_licenses", "v_codes", "v_order_events", "v_promoters")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("A8", "a8_with_defaults", """
select id, plan, status, cast(0 as bigint) as unbind_count, cast(0 as bigint) as unbind_year, '' as note,
  coalesce(strftime(last_seen_at, '%Y-%m-%d %H:%M:%S'), '') as last_seen_at from v_licenses""")
def _(t):
    bare = t.v_licenses.select("id", "plan", "status", stamp("last_seen_at").alias("last_seen_at"))
    full = with_defaults(bare, TABLES["license_rows"], {"unbind_count": 0, "unbind_year": 0, "note": "", "last_seen_at": ""})
    return full.select("id", "plan", "status", "unbind_count", "unbind_year", "note", "last_seen_at")


@query("A11", "a11_export_all", """
select 'activation_codes' as _table, '' as amount, code, '' as device_id, '' as event_id, '' as id, '' as kind, plan, '' as status, cast(used as varchar) as used from v_codes
union all select 'licenses', '', '', device_id, '', id, '', plan, status, '' from v_licenses
union all select 'orders', cast(amount as varchar), '', device_id, '', id, '', plan, status, '' from v_orders
union all select 'events', '', '', '', cast(event_id as varchar), '', kind, '', '', '' from v_order_events""")
def _(t):
    return export_all({
        "orders": t.v_orders.select("id", "plan", "amount", "status", "device_id"),
        "licenses": t.v_licenses.select("id", "device_id", "plan", "status"),
        "activation_codes": t.v_codes,
        "events": t.v_order_events.select("event_id", "kind"),
    })


@query("B2", "b2_list_orders", """
select id, plan, cast(amount as double) as amount, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at,
  position, total, page, pages from (
  select *, row_number() over (order by created_at desc, id) as position, count(*) over () as total, cast(2 as bigint) as page,
    cast(ceil(count(*) over () / 50.0) as bigint) as pages
  from v_orders where product = 'alpha' and status = 'paid' and created_at >= timestamp '1995-06-01' and created_at <= timestamp '2001-06-30 23:59:59') x
where position > (least(2, pages) - 1) * 50 and position <= least(2, pages) * 50""")
def _(t):
    rows = R.list_orders(t.v_orders, page=2, size=50, product="alpha", status="paid",
                         date_from="1995-06-01", date_to="2001-06-30", products=tuple(PRODUCTS))
    return rows.select("id", "plan", F.col("amount").cast("double").alias("amount"), "status",
                       stamp("created_at").alias("created_at"), "position", "total",
                       F.lit(2).cast("bigint").alias("page"), "pages")


@query("B2", "b2_orders_without_channel", """
select plan, count(*) as orders, cast(sum(amount) as double) as amount from v_orders
where coalesce(channel_code, '') = '' group by plan""")
def _(t):
    return R.order_filter(t.v_orders, channel="__NONE__").groupBy("plan").agg(
        F.count("*").alias("orders"), R.money().alias("amount"))


@query("B3", "b3_paginate_past_end", """
select id, position, total, cast(ceil(total / 37.0) as bigint) as page, cast(ceil(total / 37.0) as bigint) as pages from (
  select id, row_number() over (order by created_at, id) as position, count(*) over () as total from v_orders) x
where position > (ceil(total / 37.0) - 1) * 37""")
def _(t):
    return page_of(t.v_orders, day_block("created_at"), [F.asc("created_at"), F.asc("id")], 10 ** 9, 37).select(
        "id", "position", "total", "page", "pages")


@query("B9", "b9_valid_channel", """
select channel, valid, count(*) as orders from (
  select upper(trim(code)) as channel, regexp_matches(upper(trim(code)), '^P_[A-Z0-9_]{2,32}$') or trim(code) = '' as valid
  from (select ' ' || lower(channel_code) as code from v_orders
        union all select o_orderpriority from orders) a) b group by channel, valid""")
def _(t):
    raw = t.v_orders.select(F.concat(F.lit(" "), F.lower("channel_code")).alias("code")).union(
        t.orders.select("o_orderpriority"))
    return R.split_channels(raw).groupBy("channel", "valid").agg(F.count("*").alias("orders"))


@query("C5", "c5_channel_promoter", """
select channel_code as code, coalesce(name, '') as name,
  greatest(0.0, least(1.0, coalesce(cast(commission_rate as double), 0.2))) as commission_rate
from (select distinct channel_code from v_orders where channel_code <> '') c left join v_promoters p on p.code = c.channel_code""")
def _(t):
    codes = t.v_orders.where("channel_code <> ''").select(F.col("channel_code").alias("code")).distinct()
    return R.promoter_rate(codes, t.v_promoters)


@query("D1", "d1_active_subscriptions", """
select plan, count(*) as licenses, cast(grouping(plan) as bigint) as is_total from v_licenses
where status = 'active' and device_id <> '' and expires_at > timestamp '2001-09-01 00:00:00' group by rollup(plan)""")
def _(t):
    return R.active_subscriptions(t.v_licenses, now()).withColumn("is_total", F.col("is_total").cast("bigint"))


@query("D2", "d2_pending_orders", """
select plan, count(*) as orders, cast(coalesce(sum(amount), 0) as double) as amount, cast(grouping(plan) as bigint) as is_total
from v_orders where status = 'pending' group by rollup(plan)""")
def _(t):
    return R.pending_orders(t.v_orders).withColumn("is_total", F.col("is_total").cast("bigint"))


for _period in PERIODS:
    @query("D3 H20", f"d3_revenue_by_{_period}", f"""
    select {SQL_PERIOD[_period]} as period, plan, count(*) as orders, cast(sum(amount) as double) as revenue
    from v_orders where status = 'paid' and paid_at is not null group by 1, 2""")
    def _(t, period=_period):
        return R.revenue_by_period(t.v_orders, period)


@query("D5", "d5_pending_by_product", """
select coalesce(nullif(product, ''), 'default') as product, count(*) as orders, cast(sum(amount) as double) as amount
from v_orders where status = 'pending' group by 1""")
def _(t):
    return R.pending_by_product(t.v_orders)


@query("D6", "d6_new_licenses_by_month", """
select strftime(starts_at, '%Y-%m') as month, plan, count(*) as licenses from v_licenses where starts_at is not null
group by 1, 2 qualify dense_rank() over (order by strftime(starts_at, '%Y-%m') desc) <= 12""")
def _(t):
    return R.new_licenses_by_month(t.v_licenses)


for _days in (7, 30, 90):
    @query("D7", f"d7_active_devices_{_days}d", f"""
    select cast(1 as bigint) as available, count(distinct case when last_seen_at >= timestamp '2001-09-01' - interval '{_days}' day then device_id end) as devices,
      count(*) filter (where last_seen_at is null) as never_seen
    from v_licenses where status = 'active' and device_id <> ''""")
    def _(t, days=_days):
        return R.active_devices(t.v_licenses, now(), days)


@query("D8", "d8_activation_codes", """
select plan, count(*) filter (where used = 0) as unused, count(*) filter (where used = 1) as used from v_codes group by plan""")
def _(t):
    return R.activation_codes_summary(t.v_codes)


CHANNEL_SQL = """
select code, orders, revenue, alpha_orders, alpha_revenue, beta_orders, beta_revenue, coalesce(name, '') as name,
  greatest(0.0, least(1.0, coalesce(cast(commission_rate as double), 0.2))) as commission_rate,
  round(revenue * greatest(0.0, least(1.0, coalesce(cast(commission_rate as double), 0.2))), 2) as commission
from (select channel_code, count(*) as orders, cast(sum(amount) as double) as revenue,
        count(*) filter (where product = 'alpha') as alpha_orders,
        cast(coalesce(sum(amount) filter (where product = 'alpha'), 0) as double) as alpha_revenue,
        count(*) filter (where product = 'beta') as beta_orders,
        cast(coalesce(sum(amount) filter (where product = 'beta'), 0) as double) as beta_revenue
      from v_orders where channel_code <> '' and status = 'paid' group by channel_code) o
left join v_promoters p on p.code = o.channel_code"""


@query("D9", "d9_channel_summaries", CHANNEL_SQL.replace("select code,", "select channel_code as code,"))
def _(t):
    return R.channel_summaries(t.v_orders, t.v_promoters, PRODUCTS)


@query("D10", "d10_revenue_report", f"""
select {MONTHLY} as period, plan, count(*) as orders, cast(sum(amount) as double) as revenue, cast(grouping(plan) as bigint) as is_subtotal
from v_orders where status = 'paid' and paid_at is not null group by grouping sets (({MONTHLY}, plan), ({MONTHLY}))""")
def _(t):
    return R.revenue_report(t.v_orders).withColumn("is_subtotal", F.col("is_subtotal").cast("bigint"))


@query("D11", "d11_stats_bundle", f"""
with paid as (select *, {MONTHLY} as period, coalesce(nullif(product, ''), 'default') as prod from v_orders where status = 'paid'),
live as (select * from v_licenses where status = 'active' and device_id <> ''),
ch as (select channel_code, count(*) as orders, cast(sum(amount) as double) as revenue from paid where channel_code <> '' group by 1),
nl as (select strftime(starts_at, '%Y-%m') as m, plan, count(*) as n from v_licenses where starts_at is not null group by 1, 2 qualify dense_rank() over (order by strftime(starts_at, '%Y-%m') desc) <= 12),
pend as (select *, coalesce(nullif(product, ''), 'default') as prod from v_orders where status = 'pending')
select 'subscriptions.licenses' as metric, coalesce(plan, 'total') as key1, '' as key2, cast(count(*) as double) as value
  from live where expires_at > timestamp '2001-09-01' group by rollup(plan)
union all select 'pending.orders', coalesce(plan, 'total'), '', count(*) from pend group by rollup(plan)
union all select 'pending.amount', coalesce(plan, 'total'), '', cast(sum(amount) as double) from pend group by rollup(plan)
union all select 'pending_product.orders', prod, '', count(*) from pend group by prod
union all select 'pending_product.amount', prod, '', cast(sum(amount) as double) from pend group by prod
union all select 'revenue.orders', period, plan, count(*) from paid where paid_at is not null group by period, plan
union all select 'revenue.revenue', period, plan, cast(sum(amount) as double) from paid where paid_at is not null group by period, plan
union all select 'revenue_total.orders', 'all', '', count(*) from paid
union all select 'revenue_total.revenue', 'all', '', cast(sum(amount) as double) from paid
union all select 'revenue_total.orders', 'plan', plan, count(*) from paid group by plan
union all select 'revenue_total.revenue', 'plan', plan, cast(sum(amount) as double) from paid group by plan
union all select 'revenue_total.orders', 'product', prod, count(*) from paid group by prod
union all select 'revenue_total.revenue', 'product', prod, cast(sum(amount) as double) from paid group by prod
union all select 'new_licenses.licenses', m, plan, n from nl
union all select 'devices_7d.devices', '', '', count(distinct case when last_seen_at >= timestamp '2001-09-01' - interval '7' day then device_id end) from live
union all select 'devices_7d.never_seen', '', '', count(*) from live where last_seen_at is null
union all select 'devices.devices', '', '', count(distinct case when last_seen_at >= timestamp '2001-09-01' - interval '30' day then device_id end) from live
union all select 'devices.never_seen', '', '', count(*) from live where last_seen_at is null
union all select 'codes.unused', plan, '', count(*) filter (where used = 0) from v_codes group by plan
union all select 'codes.used', plan, '', count(*) filter (where used = 1) from v_codes group by plan
union all select 'channel.orders', channel_code, '', orders from ch
union all select 'channel.revenue', channel_code, '', revenue from ch
union all select 'channel.commission', channel_code, '', round(revenue * greatest(0.0, least(1.0, coalesce(cast(commission_rate as double), 0.2))), 2)
  from ch left join v_promoters p on p.code = ch.channel_code""")
def _(t):
    return R.stats_bundle(t.v_orders, t.v_licenses, t.v_codes, t.v_promoters, PRODUCTS, now())


@query("E4", "e4_latest_active_license", """
select device_id, id, plan, strftime(expires_at, '%Y-%m-%d %H:%M:%S') as expires_at from (
  select *, row_number() over (partition by device_id order by expires_at desc, id desc) as rn from v_licenses
  where status = 'active' and device_id <> '') x where rn = 1 and expires_at >= timestamp '2001-09-01'""")
def _(t):
    return R.latest_active_license(t.v_licenses, now()).withColumn("expires_at", stamp("expires_at"))


@query("E5", "e5_stack_expiry", """
with recursive o as (select device_id, id, plan, paid_at, row_number() over (partition by device_id order by paid_at, okey) as n
  from v_orders where status in ('paid', 'free') and device_id <> ''),
r(device_id, n, id, plan, paid_at, starts_at, expires_at, furthest) as (
  select device_id, n, id, plan, paid_at, paid_at as starts_at,
    case plan when 'month' then paid_at + interval '30' day when 'year' then paid_at + interval '365' day else timestamp '2099-12-31 23:59:59' end as expires_at,
    case plan when 'month' then paid_at + interval '30' day when 'year' then paid_at + interval '365' day else timestamp '2099-12-31 23:59:59' end as furthest
  from o where n = 1
  union all
  select o.device_id, o.n, o.id, o.plan, o.paid_at, greatest(o.paid_at, r.furthest),
    case o.plan when 'month' then greatest(o.paid_at, r.furthest) + interval '30' day when 'year' then greatest(o.paid_at, r.furthest) + interval '365' day else timestamp '2099-12-31 23:59:59' end,
    greatest(r.furthest, case o.plan when 'month' then greatest(o.paid_at, r.furthest) + interval '30' day when 'year' then greatest(o.paid_at, r.furthest) + interval '365' day else timestamp '2099-12-31 23:59:59' end)
  from r join o on o.device_id = r.device_id and o.n = r.n + 1)
select device_id, id, plan, strftime(paid_at, '%Y-%m-%d %H:%M:%S') as paid_at, strftime(starts_at, '%Y-%m-%d %H:%M:%S') as starts_at,
  strftime(expires_at, '%Y-%m-%d %H:%M:%S') as expires_at from r""")
def _(t):
    out = R.stack_expiry(t.v_orders)
    return out.select("device_id", "id", "plan", *[stamp(c).alias(c) for c in ("paid_at", "starts_at", "expires_at")])


@query("E6", "e6_unbind_quota", """
select event_id, license_id, year, nth, nth <= 5 as accepted from (
  select event_id, cast(user_id as varchar) as license_id, cast(year(ts) as bigint) as year,
    row_number() over (partition by user_id, year(ts) order by ts, event_id) as nth
  from events where event_type = 'error') x""")
def _(t):
    requests = t.events.where("event_type = 'error'").select(
        "event_id", F.col("user_id").cast("string").alias("license_id"), F.col("ts").alias("at"))
    return R.unbind_quota(requests, 5).select("event_id", "license_id", F.col("year").cast("bigint").alias("year"),
                                              F.col("nth").cast("bigint").alias("nth"), "accepted")


@query("H20", "h20_period_keys", f"""
select id, {SQL_PERIOD['day']} as day, {SQL_PERIOD['week']} as week, {SQL_PERIOD['month']} as month,
  {SQL_PERIOD['quarter']} as quarter, {SQL_PERIOD['year']} as year from v_orders where paid_at is not null""")
def _(t):
    return t.v_orders.where("paid_at is not null").select("id", *[period_key("paid_at", p).alias(p) for p in PERIODS])


@query("H21", "h21_plan_expiry", """
select id, strftime(expires_at, '%Y-%m-%d %H:%M:%S') as expires_at from v_licenses""")
def _(t):
    return t.v_orders.where("status <> 'pending'").select(
        F.concat(F.lit("L"), "id").alias("id"), stamp(plan_expiry("plan", "paid_at")).alias("expires_at"))


@query("H35", "h35_license_state", """
select device_id, state, trial_days_left from (
  select *, case when license_id is null and left_days > 0 then 'trial' when license_id is null then 'trial_expired'
    when license_device <> '' and license_device <> device_id then 'device_mismatch'
    when plan <> 'lifetime' and expires_at < timestamp '2001-09-01' then 'expired'
    when last_online_at is null or last_online_at < timestamp '2001-09-01' - interval '7' day then 'offline_grace_exceeded' else 'ok' end as state,
    case when license_id is null then left_days else 0 end as trial_days_left
  from (select cast(c.c_custkey as varchar) as device_id, l.id as license_id, case when c.c_custkey % 9 = 0 then 'other' else l.device_id end as license_device,
      l.plan, l.expires_at, l.last_seen_at as last_online_at, greatest(0, 30 - (c.c_custkey % 45)) as left_days
    from customer c left join (select * from (select *, row_number() over (partition by device_id order by expires_at desc, id desc) as rn
      from v_licenses where status = 'active' and device_id <> '' and plan <> 'lifetime') z where rn = 1) l on l.device_id = cast(c.c_custkey as varchar)) y) x""")
def _(t):
    best = R.latest_active_license(t.v_licenses.where("plan <> 'lifetime'"), ntz("1900-01-01 00:00:00"))
    seen = t.v_licenses.select("id", F.col("last_seen_at").alias("last_online_at"))
    bound = best.join(seen, "id").select(
        F.col("device_id").alias("bound_device"), F.col("id").alias("license_id"), "plan", "expires_at", "last_online_at")
    installs = t.customer.select(
        F.col("c_custkey").cast("string").alias("device_id"), F.col("c_custkey").alias("k"),
        (now() - F.make_dt_interval(days=(F.col("c_custkey") % 45).cast("int"))).alias("installed_at"))
    rows = installs.join(bound, installs.device_id == bound.bound_device, "left").withColumn(
        "license_device", F.when(F.col("k") % 9 == 0, F.lit("other")).otherwise(F.col("bound_device")))
    return R.license_state(rows, now()).select("device_id", "state", F.col("trial_days_left").cast("bigint").alias("trial_days_left"))


@query("B12", "b12_audit_since", """
select count(*) as n from v_audit where at_time >= timestamp '2024-01-24' and action like 'rule\\_create%' escape '\\'""")
def _(t):
    return t.v_audit.where((F.col("at_time") >= ntz("2024-01-24 00:00:00")) & F.col("action").startswith("rule_create")).agg(
        F.count("*").alias("n"))


@query("F4", "f4_audit_page", f"""
select id, strftime(at_time, '%Y-%m-%d %H:%M:%S') as at_time, action, position, total from (
  select *, row_number() over (order by id desc) as position, count(*) over () as total from v_audit) x
where position > 400 and position <= 600""")
def _(t):
    page = page_of(t.v_audit, F.floor(F.col("id") / 4096), [F.desc("id")], 3, 200, max_size=200, descending=True)
    return page.select("id", stamp("at_time").alias("at_time"), "action", "position", "total")


"""Order analytics on the small seeded tables, and recurrences against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from folioscan.functions.times import ntz, period_key
from folioscan.operators import incremental as N
from folioscan.operators import revenue as R
from folioscan.operators.sequences import id_block, neighbour, page_of, running

NOW = "2026-03-10 12:00:00"


def at(days):
    return dt.datetime(2026, 3, 10, 11, 0) - dt.timedelta(days=days)


def seed(spark):
    orders = spark.createDataFrame(
        [("o1", "month", 29.0, "paid", "d1", at(0)), ("o2", "year", 299.0, "paid", "d2", at(1)), ("o3", "year", 199.0, "pending", "d3", None)],
        "id string, plan string, amount double, status string, device_id string, paid_at timestamp_ntz").withColumn("product", F.lit(""))
    licenses = spark.createDataFrame(
        [("l1", "d1", "month", "active", at(-20), at(0)), ("l2", "d2", "year", "active", at(-300), at(10))],
        "id string, device_id string, plan string, status string, expires_at timestamp_ntz, last_seen_at timestamp_ntz")
    return orders, licenses


def test_seeded_statistics(spark):
    orders, licenses = seed(spark)
    total = R.revenue_totals(orders).where("level = 'all'").first()
    assert (total.orders, total.revenue) == (2, 328.0)
    assert {r.key for r in R.revenue_totals(orders).where("level = 'product'").collect()} == {"default"}
    assert R.pending_orders(orders).where("is_total = 1").first().orders == 1
    assert R.active_subscriptions(licenses, ntz(NOW)).where("is_total = 1").first().licenses == 2
    assert [R.active_devices(licenses, ntz(NOW), d).first().devices for d in (7, 30)] == [1, 2]
    assert R.active_devices(licenses.drop("last_seen_at"), ntz(NOW), 7).first().available == 0
    months = R.revenue_by_period(orders, "month").agg(F.sum("revenue").alias("r")).first()
    assert months.r == 328.0


def test_week_key_equals_strftime(spark):
    days = [dt.datetime(1999, 12, 25) + dt.timedelta(days=i) for i in range(800)]
    df = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz")
    got = [r[0] for r in df.orderBy("d").select(period_key("d", "week")).collect()]
    assert got == [d.strftime("%Y-W%W") for d in days]


def test_running_and_neighbour_with_one_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    got = {(r.k, r.i): (r.s, r.m, r.nx and r.nx.v) for r in neighbour(
        running(df, ["k"], id_block("i", 37), ["i"], {"s": F.col("v")}, {"m": F.col("v")}), ["k"], id_block("i", 37), ["i"], ["v"], "nx").collect()}
    for k in {r[0] for r in rows}:
        mine, s, m = [r for r in rows if r[0] == k], 0, -1
        for j, (_, i, v) in enumerate(mine):
            s, m = s + v, max(m, v)
            assert got[(k, i)] == (s, m, mine[j + 1][2] if j + 1 < len(mine) else None)


def test_page_of_clamps(spark):
    df = spark.range(103)
    last = page_of(df, F.floor(F.col("id") / 10), [F.asc("id")], 99, 20).orderBy("position").collect()
    assert [r.id for r in last] == [100, 101, 102] and last[0].pages == 6 and last[0].page == 6
    assert page_of(df.where("id < 0"), F.floor(F.col("id") / 10), [F.asc("id")], 1, 20).count() == 0


def test_stack_expiry_equals_loop(spark):
    rng = random.Random(7)
    base = dt.datetime(2020, 1, 1)
    rows, okey = [], 0
    for dev in range(6):
        t = base
        for _ in range(40 if dev == 0 else 8):
            t += dt.timedelta(days=rng.randrange(0, 60), seconds=rng.randrange(86400))
            okey += 1
            rows.append((f"d{dev}", okey, str(okey), rng.choice(["month", "month", "year", "lifetime"] if dev % 2 else ["month", "year"]), "paid", t))
    df = spark.createDataFrame(rows, "device_id string, okey bigint, id string, plan string, status string, paid_at timestamp_ntz")
    got = {r.id: (r.starts_at, r.expires_at) for r in R.stack_expiry(df).collect()}
    end = dt.datetime(2099, 12, 31, 23, 59, 59)
    furthest = {}
    for dev, _, i, plan, _, t in rows:
        start = max(t, furthest.get(dev, t))
        expires = end if plan == "lifetime" else start + dt.timedelta(days={"month": 30, "year": 365}[plan])
        furthest[dev] = max(expires, furthest.get(dev, expires))
        assert got[i] == (start, expires)


def test_rate_limit_equals_loop(spark):
    rng = random.Random(3)
    rows, t = [], {}
    for i in range(500):
        c = "hot" if rng.random() < 0.5 else f"c{rng.randrange(4)}"
        t[c] = t.get(c, dt.datetime(2026, 1, 1)) + dt.timedelta(minutes=rng.choice([1, 3, 10, 90]))
        rows.append((i, c, t[c]))
    df = spark.createDataFrame(rows, "event_id bigint, client string, ts timestamp_ntz")
    got = {r.event_id: r.accepted for r in N.rate_limit(df, "client", "ts", 3, 3600).collect()}
    kept = {}
    for i, c, at_ in rows:
        kept[c] = [x for x in kept.get(c, []) if (at_ - x).total_seconds() < 3600]
        ok = len(kept[c]) < 3
        if ok:
            kept[c].append(at_)
        assert got[i] == ok


def test_keyed_upsert_is_idempotent(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    changes = spark.createDataFrame([(2, "B", 20), (3, "C", 30)], "id int, name string, n int")
    once = N.keyed_upsert(table, changes, ["id"], ["name"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "B", 2), (3, "C", 30)]
    assert sorted(map(tuple, N.keyed_upsert(once, changes, ["id"], ["name"]).collect())) == sorted(map(tuple, once.collect()))

import math

import pytest
from pyspark.sql import functions as F

from shelfprice.operators import deals, policy

REQUEST = ("recommended_price double, competitor_price double, cost double, inventory double, demand_pressure double, "
           "loyalty_score double, purchase_count int, budget double")


def request(spark, **over):
    base = dict(recommended_price=25.0, competitor_price=20.0, cost=10.0, inventory=50.0, demand_pressure=0.5,
                loyalty_score=80.0, purchase_count=20, budget=None)
    return spark.createDataFrame([tuple({**base, **over}.values())], REQUEST)


def half(value, digits):
    return math.floor(value * 10 ** digits + 0.5) / 10 ** digits


def by_hand(r):
    """The rounds one after the other."""
    gap = max(-0.3, min(0.3, (r["recommended_price"] - r["competitor_price"]) / r["competitor_price"]))
    willing = 0.45 - 0.3 * r["loyalty_score"] / 100 - 0.1 * r["purchase_count"] / 50 + 0.15 * r["demand_pressure"] + 0.05 * gap + 0.15 * r["inventory"] / 150
    margin = (r["recommended_price"] - r["cost"]) / r["recommended_price"]
    most = min(max(min(min(max(willing, 0.02), 0.5), min(0.8 * margin + 0.15 * r["demand_pressure"], 0.4)), 0.02), 0.4)
    ask = 0.1 + 0.15 * (1 - r["loyalty_score"] / 100)
    agreed, rounds, discount = False, 0, 0.0
    while rounds < 3 and not agreed:
        offer = most * (0.7 + 0.15 * rounds)
        rounds += 1
        agreed = offer >= 0.8 * ask
    discount = half(offer, 3) if agreed else 0.0
    price = half(r["recommended_price"] * (1 - discount), 2)
    if r["budget"] is not None and price > r["budget"]:
        needed = 1 - r["budget"] / r["recommended_price"]
        agreed = needed <= most
        if agreed:
            discount = half(needed + 0.01, 3)
            price = half(r["recommended_price"] * (1 - discount), 2)
    return agreed, rounds, price


@pytest.mark.parametrize("over", [
    dict(), dict(budget=12.0), dict(budget=25.0), dict(budget=21.0), dict(loyalty_score=5.0, inventory=1.0), dict(loyalty_score=5.0, cost=24.5),
    dict(demand_pressure=1.0, loyalty_score=0.0, inventory=150.0, budget=16.0), dict(cost=24.0, budget=24.9),
])
def test_negotiation_equals_rounds_by_hand(spark, over):
    df = request(spark, **over)
    row = deals.negotiate(df).first()
    assert (row["agreed"], row["rounds"], row["final_price"]) == by_hand(df.first().asDict())
    assert len(row["transcript"]) == row["rounds"] + (row["note"] != "none")  # above the budget there is a last word
    last = row["transcript"][-1]
    if row["note"] == "countered_to_budget":
        assert last["accepted"] and last["agent_offer_discount"] == row["final_discount"]
    if row["note"] == "budget_below_floor":
        assert not last["accepted"] and last["agent_offer_discount"] is None


def test_deals_respect_the_budget(spark):
    low, high = deals.negotiate(request(spark, budget=12.0)).first(), deals.negotiate(request(spark, budget=25.0)).first()
    assert not low["agreed"] and low["note"] == "budget_below_floor"
    assert high["agreed"] and high["final_price"] <= 25.0


def test_rule_discount(spark):
    plain = deals.rule_discount(request(spark)).first()
    assert plain["agreed"] and plain["discount_pct"] == 17.0 and plain["final_price"] == 20.75
    met = deals.rule_discount(request(spark, budget=16.0)).first()
    assert met["agreed"] and met["final_price"] <= 16.0 and met["note"] == "countered_to_budget"
    assert not deals.rule_discount(request(spark, budget=10.0)).first()["agreed"]


@pytest.mark.parametrize("score, tier", [(80.0, "Gold"), (79.9, "Silver"), (50.0, "Silver"), (25.0, "Bronze"), (24.9, "New")])
def test_tiers(one, score, tier):
    assert one(deals.loyalty_tier(F.col("s")), s=score) == tier


def test_unknown_customer_and_product(spark):
    customers = spark.createDataFrame([(1, 90.0, 4, 10.0)], "customer_id long, loyalty_score double, purchase_count int, avg_sales double")
    rows = {r["customer_id"]: r for r in deals.with_customer(spark.createDataFrame([(1, 7), (2, 8)], "customer_id long, product_id long"), customers).collect()}
    assert rows[1]["loyalty_tier"] == "Gold" and rows[2]["loyalty_score"] == 40.0 and rows[2]["loyalty_tier"] == "New"
    asked = spark.createDataFrame([(7,), (9,), (9,)], "product_id long")
    products = spark.createDataFrame([(7,)], "product_id long")
    assert deals.known_requests(asked, products).count() == 1
    assert [tuple(r) for r in deals.unknown_requests(asked, products).collect()] == [(9, 2)]


def test_pressure_scales_the_fleet(spark):
    df = deals.with_demand_pressure(spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "product_id long, units double"))
    assert [r["demand_pressure"] for r in df.orderBy("product_id").collect()] == [0.0, 0.5, 1.0]
    same = deals.with_demand_pressure(spark.createDataFrame([(1, 10.0)], "product_id long, units double"))
    assert same.first()["demand_pressure"] == 0.0


def test_policy_equals_brute_force(spark):
    rows = [(f"P{i}", 10.0 + i, 4.0, -0.5 - i / 10, float(5 + 12 * i % 97), i / 19, -0.3 + i * 0.03) for i in range(20)]
    names = ["product_id", "base_price", "cost", "elasticity", "inventory", "demand_pressure", "competitor_gap"]
    df = spark.createDataFrame(rows, "product_id string, base_price double, cost double, elasticity double, inventory double, demand_pressure double, competitor_gap double")
    table = [dict(zip(names, r)) for r in rows]

    def bin_of(axis, value):
        values = [t[axis] for t in table]
        return min(2, int((value - min(values)) / (max(values) - min(values)) * 3))

    rewards = {}
    for t in table:
        state = tuple(bin_of(a, t[a]) for a in ("inventory", "demand_pressure", "competitor_gap"))
        for i, m in enumerate((0.85, 0.92, 1.0, 1.08, 1.15)):
            d = 40 * math.exp(t["elasticity"] * (m - 1)) * (1 + 0.5 * t["demand_pressure"])
            gain = t["base_price"] * m * min(d, t["inventory"]) - 0.2 * t["cost"] * max(t["inventory"] - d, 0)
            rewards.setdefault(state, {}).setdefault(i, []).append(gain)
    want = {s: max(range(5), key=lambda i: sum(by[i]) / len(by[i])) for s, by in rewards.items()}
    limits = policy.axis_limits(df)
    found = policy.greedy_policy(policy.action_values(policy.with_state(df, limits)))
    assert {(r["inventory_bin"], r["pressure_bin"], r["gap_bin"]): r["action"] for r in found.collect()} == want
    priced = policy.policy_prices(policy.with_state(df.withColumn("recommended_price", F.lit(10.0)), limits), found.where("inventory_bin = 0"))
    assert priced.count() == 20 and priced.where("inventory_bin > 0 and price <> 10.0").count() == 0


def test_states_without_range(spark):
    df = spark.createDataFrame([(5.0, 0.5, 0.1)], "inventory double, demand_pressure double, competitor_gap double")
    row = policy.with_state(df, policy.axis_limits(df)).first()
    assert (row["inventory_bin"], row["pressure_bin"], row["gap_bin"]) == (0, 0, 0)


def test_requests_are_not_joined_to_count_keys(spark, folder, monkeypatch):
    """Hot keys are found in tables as they are read, and the customer is attached to the order."""
    from shelfprice.operators import joins
    from shelfprice.plans import deals as plans

    seen, found = [], joins.hot_keys
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(joins, "hot_keys", lambda rows, key: seen.append(
        (key, rows._jdf.queryExecution().optimizedPlan().toString())) or found(rows, key))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = plans._requests(spark, folder)
        rows = asked.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert rows == spark.read.parquet(f"{folder}/lineitem.parquet").count()
    ours = [(key, plan) for key, plan in seen if key in ("order_id", "customer_id", "product_id")]
    assert {key for key, _ in ours} == {"order_id", "customer_id", "product_id"}
    assert not any("Join" in plan for _, plan in ours)

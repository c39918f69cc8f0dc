"""Batch deal offers: negotiated discounts, rule discounts and request lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfprice.functions import cents, clamp, round_to, safe_ratio
from shelfprice.operators.joins import lookup

# Profile of a customer that is not on file.
DEFAULT_CUSTOMER = {"loyalty_score": 40.0, "purchase_count": 3, "avg_sales": 12.0, "loyalty_tier": "New"}
# Loyalty tiers and the score they start at.
LOYALTY_TIERS = (("Gold", 80), ("Silver", 50), ("Bronze", 25), ("New", 0))

ROUNDS = 3


def loyalty_tier(score: Column) -> Column:
    name, start = LOYALTY_TIERS[0]
    tier = F.when(score >= start, name)
    for name, start in LOYALTY_TIERS[1:-1]:
        tier = tier.when(score >= start, name)
    return tier.otherwise(LOYALTY_TIERS[-1][0])


def with_customer(requests: DataFrame, customers: DataFrame) -> DataFrame:
    """Attach customer profiles; unknown customers get the default one."""
    known = customers.select("customer_id", "loyalty_score", "purchase_count", "avg_sales")
    known = known.withColumn("loyalty_tier", loyalty_tier(F.col("loyalty_score")))
    joined = lookup(requests, known, "customer_id", how="left")
    return joined.fillna(DEFAULT_CUSTOMER)


def known_requests(requests: DataFrame, products: DataFrame) -> DataFrame:
    return lookup(requests, products, "product_id")


def unknown_requests(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Requested products that are not in the catalogue, with their request counts.

    Requests are counted per product first, so a popular unknown id is one row.
    """
    asked = requests.groupBy("product_id").agg(F.count("*").alias("requests"))
    return asked.join(products.select("product_id"), "product_id", "left_anti")


def with_demand_pressure(products: DataFrame, units: str = "units") -> DataFrame:
    """Scale each product's units between the fleet's lowest (0) and highest (1)."""
    ends = products.agg(F.struct(F.min(units).alias("lo"), F.max(units).alias("hi"))).scalar()
    pressure = safe_ratio(F.col(units) - ends.getField("lo"), ends.getField("hi") - ends.getField("lo"))
    return products.withColumn("demand_pressure", F.coalesce(pressure, F.lit(0.0)))


def max_discount() -> Column:
    """Largest discount worth granting: what the customer would take, within the margin."""
    gap = (F.col("recommended_price") - F.col("competitor_price")) / F.greatest("competitor_price", F.lit(1e-6))
    willing = clamp(
        F.lit(0.45) - F.lit(0.30) * (F.col("loyalty_score") / 100.0) - F.lit(0.10) * (F.col("purchase_count") / 50.0)
        + F.lit(0.15) * F.col("demand_pressure") + F.lit(0.05) * clamp(gap, -0.3, 0.3)
        + F.lit(0.15) * (F.col("inventory") / 150.0),
        0.02, 0.5,
    )
    margin = safe_ratio(F.col("recommended_price") - F.col("cost"), F.col("recommended_price"))
    affordable = F.least(margin * 0.8 + F.col("demand_pressure") * 0.15, F.lit(0.4))
    return clamp(F.least(willing, affordable), 0.02, 0.4)


def negotiate(requests: DataFrame) -> DataFrame:
    """Outcome of up to three offers, then of one counter-offer to meet the budget.

    Needs recommended_price, competitor_price, cost, inventory, demand_pressure, the
    customer profile and a budget (NULL for none).
    """
    offers = F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.struct(
        (r + 1).alias("round"), (F.col("max_discount") * (F.lit(0.7) + F.lit(0.15) * r)).alias("offer"),
    ))
    ask = F.lit(0.10) + F.lit(0.15) * (F.lit(1.0) - F.col("loyalty_score") / 100.0)
    taken = F.filter("offers", lambda o: o["offer"] >= F.col("ask") * 0.8)
    opened = (
        requests.withColumn("max_discount", max_discount())
        .withColumns({"offers": offers, "ask": ask})
        .withColumn("deal", F.get(taken, F.lit(0)))
        .withColumns({
            "took_offer": F.col("deal").isNotNull(),
            "rounds": F.coalesce(F.col("deal.round"), F.lit(ROUNDS)),
            "offer_discount": F.coalesce(round_to(F.col("deal.offer"), 3), F.lit(0.0)),
        })
        .withColumn("offer_price", cents(F.col("recommended_price") * (F.lit(1.0) - F.col("offer_discount"))))
    )
    needed = F.lit(1.0) - F.col("budget") / F.col("recommended_price")
    over = F.coalesce(F.col("offer_price") > F.col("budget"), F.lit(False))
    countered = over & (needed <= F.col("max_discount"))
    counter = round_to(needed + 0.01, 3)
    discount = F.when(countered, counter).otherwise(F.col("offer_discount"))
    final = F.when(countered, cents(F.col("recommended_price") * (F.lit(1.0) - counter))).otherwise(F.col("offer_price"))
    transcript = F.slice(
        F.transform("offers", lambda o: F.struct(
            o["round"].alias("round"), round_to(F.col("ask"), 3).alias("customer_ask_discount"),
            round_to(o["offer"], 3).alias("agent_offer_discount"), (o["offer"] >= F.col("ask") * 0.8).alias("accepted"),
        )),
        F.lit(1), F.col("rounds"),
    )
    # above the budget there is a last word: the counter-offer, or a refusal without an offer
    last = F.struct(
        (F.col("rounds") + 1).alias("round"), round_to(needed, 3).alias("customer_ask_discount"),
        F.when(countered, counter).alias("agent_offer_discount"), countered.alias("accepted"),
    )
    transcript = F.when(over, F.concat(transcript, F.array(last))).otherwise(transcript)
    return opened.withColumns({
        "agreed": F.when(over, countered).otherwise(F.col("took_offer")),
        "final_discount": discount,
        "final_price": final,
        "discount_pct": round_to(discount * 100.0, 1),
        "savings": cents(F.col("recommended_price") - final),
        "note": F.when(countered, "countered_to_budget").when(over, "budget_below_floor").otherwise("none"),
        "transcript": transcript,
    }).drop("offers", "deal", "took_offer", "offer_discount", "offer_price")


def rule_discount(requests: DataFrame) -> DataFrame:
    """One-round discount from demand pressure and loyalty, with a counter up to 40 %."""
    price, budget = F.col("recommended_price"), F.col("budget")
    first = clamp(F.lit(0.05) + F.lit(0.12) * F.col("demand_pressure") + F.lit(0.003) * (F.lit(100.0) - F.col("loyalty_score")), 0.04, 0.35)
    offered = cents(price * (F.lit(1.0) - first))
    over = F.coalesce(offered > budget, F.lit(False))
    needed = F.lit(1.0) - budget / price
    countered = over & (needed <= 0.4)
    discount = F.when(countered, needed + 0.01).otherwise(first)
    final = cents(price * (F.lit(1.0) - discount))
    return requests.withColumns({
        "agreed": ~over | countered,
        "final_price": final,
        "discount_pct": round_to(discount * 100.0, 1),
        "savings": cents(price - final),
        "note": F.when(countered, "countered_to_budget").when(over, "budget_below_floor").otherwise("none"),
    })

"""Requests, deal offers, loyalty and the price policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfprice.functions import round_to
from shelfprice.operators import deals, features, policy
from shelfprice.operators.joins import lookup
from shelfprice.operators.staging import stage
from shelfprice.plans.pricing import recommended
from shelfprice.plans.registry import query
from shelfprice.plans.views import half_up, sql
from shelfprice.sources import retail


def _event_requests(spark, folder):
    """Events as requests for products by number, most of which are not in the catalogue."""
    return retail.table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_id").alias("product_id"), F.col("user_id").alias("customer_id")
    )


@query("""
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_suppkey AS supplier_id, l_partkey AS product_id, l_quantity AS units_sold,
       p_type AS category, p_retailprice AS list_price
FROM lineitem JOIN part ON p_partkey = l_partkey
""")
def request_lookup(spark, folder):
    asked = retail.lines(spark, folder).select("order_id", "line_no", "supplier_id", "product_id", "units_sold")
    found = deals.known_requests(asked, retail.products(spark, folder))
    return found.select("order_id", "line_no", "supplier_id", "product_id", "units_sold", "category", "list_price")


@query("""
SELECT event_id AS product_id, count(*) AS requests FROM events
WHERE event_id NOT IN (SELECT p_partkey FROM part) GROUP BY event_id
""")
def unknown_products(spark, folder):
    return deals.unknown_requests(_event_requests(spark, folder), retail.products(spark, folder))


TIER = "CASE WHEN loyalty_score >= 80 THEN 'Gold' WHEN loyalty_score >= 50 THEN 'Silver' WHEN loyalty_score >= 25 THEN 'Bronze' ELSE 'New' END"


@query(sql(f"SELECT customer_id, region, purchase_count, {half_up('avg_sales', 4)} AS avg_sales, loyalty_score, {TIER} AS loyalty_tier FROM customers", "customers"))
def loyalty_tier(spark, folder):
    return retail.customers(spark, folder).select(
        "customer_id", "region", "purchase_count", round_to(F.col("avg_sales"), 4).alias("avg_sales"), "loyalty_score",
        deals.loyalty_tier(F.col("loyalty_score")).alias("loyalty_tier"),
    )


def pressured_products(spark, folder):
    """Price and demand pressure of every product.

    A product without a recommendation keeps its current price; ``priced_by`` says why.
    """
    units = retail.lines(spark, folder).groupBy("product_id").agg(F.sum("units_sold").alias("units"))
    pressure = deals.with_demand_pressure(units).select("product_id", "demand_pressure")
    return stage(recommended(spark, folder).join(pressure, "product_id").select(
        "product_id", F.coalesce("recommended_price", "current_price").alias("recommended_price"), "competitor_price", "cost",
        "inventory", "demand_pressure", "current_price", "elasticity", F.col("outcome").alias("priced_by"),
    ))


def _requests(spark, folder):
    """Requests with their customer and product; an order's customer is looked up once, not once per line."""
    bought = deals.with_customer(retail.order_customers(spark, folder), stage(retail.customers(spark, folder)))
    asked = retail.deal_requests(spark, folder, bought.select("order_id", "customer_id", "loyalty_score", "purchase_count", "loyalty_tier"))
    return lookup(asked, pressured_products(spark, folder), "product_id", counted=retail.lines(spark, folder))


PRESSURE = """
    SELECT product_id, (units - min(units) OVER ()) / (max(units) OVER () - min(units) OVER ()) AS demand_pressure
    FROM (SELECT product_id, sum(units_sold) AS units FROM lines GROUP BY product_id)"""
REQUESTS = f"""
    SELECT order_id, line_no, supplier_id, l.product_id, l.units_sold, {half_up("price * (1.0 - discount)", 2)} AS budget, recommended_price, r.competitor_price,
           r.cost, r.inventory, demand_pressure, loyalty_score, purchase_count, {TIER} AS loyalty_tier, priced_by
    FROM lines l JOIN orders ON o_orderkey = order_id JOIN offers r ON r.product_id = l.product_id
    JOIN pressure ON pressure.product_id = l.product_id JOIN customers ON customer_id = o_custkey"""
MAX_DISCOUNT = """
    SELECT *, least(greatest(least(
        least(greatest(0.45::DOUBLE - 0.30::DOUBLE * (loyalty_score / 100.0) - 0.10::DOUBLE * (purchase_count / 50.0::DOUBLE) + 0.15::DOUBLE * demand_pressure
              + 0.05::DOUBLE * least(greatest((recommended_price - competitor_price) / greatest(competitor_price, 1e-6), -0.3), 0.3)
              + 0.15::DOUBLE * (inventory / 150.0), 0.02), 0.5),
        least((recommended_price - cost) / recommended_price * 0.8 + demand_pressure * 0.15, 0.4)), 0.02), 0.4)::DOUBLE AS max_discount,
        0.10::DOUBLE + 0.15::DOUBLE * (1.0::DOUBLE - loyalty_score / 100.0) AS ask
    FROM requests"""
OFFERED = """
    SELECT *, CASE WHEN max_discount * (0.7::DOUBLE + 0.15::DOUBLE * 0) >= ask * 0.8 THEN 0 WHEN max_discount * (0.7::DOUBLE + 0.15::DOUBLE * 1) >= ask * 0.8 THEN 1
                   WHEN max_discount * (0.7::DOUBLE + 0.15::DOUBLE * 2) >= ask * 0.8 THEN 2 END AS won FROM limits"""
FIRST = f"SELECT *, coalesce({half_up('max_discount * (0.7::DOUBLE + 0.15::DOUBLE * won)', 3)}, 0.0) AS offer FROM offered"
PRICED = f"SELECT *, {half_up('recommended_price * (1.0 - offer)', 2)} AS offer_price, 1.0 - budget / recommended_price AS needed FROM first"
CLOSED = f"""
    SELECT *, offer_price > budget AS over, offer_price > budget AND needed <= max_discount AS countered,
           CASE WHEN offer_price > budget AND needed <= max_discount THEN {half_up("needed + 0.01", 3)} ELSE offer END AS discount FROM priced"""


@query(sql(f"""
SELECT order_id, line_no, supplier_id, product_id, units_sold, budget, CASE WHEN over THEN countered ELSE won IS NOT NULL END AS agreed,
       CAST(coalesce(won + 1, 3) AS INTEGER) AS rounds, {half_up("recommended_price * (1.0 - discount)", 2)} AS final_price,
       {half_up("discount * 100.0", 1)} AS discount_pct, loyalty_tier,
       {half_up(f"recommended_price - {half_up('recommended_price * (1.0 - discount)', 2)}", 2)} AS savings,
       CASE WHEN countered THEN 'countered_to_budget' WHEN over THEN 'budget_below_floor' ELSE 'none' END AS note, priced_by,
       CAST(coalesce(won + 1, 3) + over::INTEGER AS INTEGER) AS n_turns,
       CASE WHEN over THEN CASE WHEN countered THEN discount END ELSE {half_up("max_discount * (0.7::DOUBLE + 0.15::DOUBLE * coalesce(won, 2))", 3)} END AS last_offer
FROM closed
""", "offers", "customers", pressure=PRESSURE, requests=REQUESTS, limits=MAX_DISCOUNT, offered=OFFERED, first=FIRST, priced=PRICED, closed=CLOSED))
def negotiation(spark, folder):
    return deals.negotiate(_requests(spark, folder)).select(
        "order_id", "line_no", "supplier_id", "product_id", "units_sold", "budget", "agreed", "rounds", "final_price", "discount_pct",
        "loyalty_tier", "savings", "note", "priced_by", F.size("transcript").alias("n_turns"),
        F.element_at("transcript", -1)["agent_offer_discount"].alias("last_offer"),
    )


RULED = f"""
    SELECT *, {half_up("recommended_price * (1.0 - base)", 2)} > budget AS over, 1.0 - budget / recommended_price AS needed
    FROM (SELECT *, least(greatest(0.05::DOUBLE + 0.12::DOUBLE * demand_pressure + 0.003::DOUBLE * (100.0::DOUBLE - loyalty_score), 0.04), 0.35)::DOUBLE AS base FROM requests)"""
RULE_CLOSED = "SELECT *, over AND needed <= 0.4 AS countered, CASE WHEN over AND needed <= 0.4 THEN needed + 0.01 ELSE base END AS discount FROM ruled"


@query(sql(f"""
SELECT order_id, line_no, supplier_id, product_id, units_sold, budget, NOT over OR countered AS agreed,
       {half_up("recommended_price * (1.0 - discount)", 2)} AS final_price, {half_up("discount * 100.0", 1)} AS discount_pct,
       {half_up(f"recommended_price - {half_up('recommended_price * (1.0 - discount)', 2)}", 2)} AS savings,
       CASE WHEN countered THEN 'countered_to_budget' WHEN over THEN 'budget_below_floor' ELSE 'none' END AS note, priced_by
FROM closed
""", "offers", "customers", pressure=PRESSURE, requests=REQUESTS, ruled=RULED, closed=RULE_CLOSED))
def rule_discount(spark, folder):
    return deals.rule_discount(_requests(spark, folder)).select(
        "order_id", "line_no", "supplier_id", "product_id", "units_sold", "budget", "agreed", "final_price", "discount_pct", "savings", "note",
        "priced_by",
    )


def _history(spark, folder, products):
    """Product-days as market situations: stock, demand pressure and price gap."""
    days = features.daily_cells(retail.lines(spark, folder)).select("product_id", "date", "n_rows", "units", "price_total")
    ends = days.agg(F.struct(F.min("units").alias("lo"), F.max("units").alias("hi"))).scalar()
    product = products.select("product_id", "competitor_price", "cost", "elasticity").join(
        retail.products(spark, folder).select("product_id", "stock"), "product_id")
    return stage(days.join(product, "product_id").select(
        "product_id", "date", features.mean_price().alias("base_price"), "cost", "elasticity",
        (F.col("stock") + F.col("units")).alias("inventory"),
        ((F.col("units") - ends.getField("lo")) / (ends.getField("hi") - ends.getField("lo"))).alias("demand_pressure"),
        ((features.mean_price() - F.col("competitor_price")) / F.col("competitor_price")).alias("competitor_gap"),
    ))


def _policy(history):
    limits = policy.axis_limits(history)
    return policy.greedy_policy(policy.action_values(policy.with_state(history, limits))), limits


HISTORY = """
    SELECT product_id, date, CAST(price_total AS DOUBLE) / n_rows AS base_price, r.cost, elasticity, stock + units AS inventory,
           (units - lo) / (hi - lo) AS demand_pressure, (CAST(price_total AS DOUBLE) / n_rows - competitor_price) / competitor_price AS competitor_gap
    FROM cells JOIN offers r USING (product_id) JOIN (SELECT product_id, stock FROM products) USING (product_id), (SELECT min(units) AS lo, max(units) AS hi FROM cells)"""


def _bin(column: str, low: str, high: str) -> str:
    return f"CAST(least(greatest(floor(({column} - {low}) / ({high} - {low}) * 3), 0), 2) AS INTEGER)"


LIMITS = """
    SELECT min(inventory) AS i0, max(inventory) AS i1, min(demand_pressure) AS d0, max(demand_pressure) AS d1,
           min(competitor_gap) AS g0, max(competitor_gap) AS g1 FROM history"""
VALUES = f"""
    SELECT inventory_bin, pressure_bin, gap_bin, action, multiplier, count(*) AS n_rows,
           CAST(sum(CAST(floor((base_price * multiplier * least(d, inventory) - cost * 0.2 * greatest(inventory - d, 0.0)) * 100.0 + 0.5) AS BIGINT)) AS DOUBLE)
               / count(elasticity) / 100.0 AS value
    FROM (SELECT *, 40.0::DOUBLE * exp(elasticity * (multiplier - 1.0)) * (demand_pressure * 0.5 + 1.0) AS d,
                 {_bin("inventory", "i0", "i1")} AS inventory_bin, {_bin("demand_pressure", "d0", "d1")} AS pressure_bin, {_bin("competitor_gap", "g0", "g1")} AS gap_bin
          FROM history, limits, (SELECT CAST(i - 1 AS INTEGER) AS action, [0.85::DOUBLE, 0.92, 1.0, 1.08, 1.15][i] AS multiplier FROM (SELECT range AS i FROM range(1, 6))))
    GROUP BY ALL"""
POLICY = """
    SELECT inventory_bin, pressure_bin, gap_bin, action, multiplier, value, n_rows
    FROM (SELECT *, row_number() OVER (PARTITION BY inventory_bin, pressure_bin, gap_bin ORDER BY value DESC, action) AS place FROM action_values) WHERE place = 1"""
POLICY_STEPS = {"history": HISTORY, "limits": LIMITS, "action_values": VALUES, "policy": POLICY}


@query(sql(f"SELECT inventory_bin, pressure_bin, gap_bin, action, multiplier, {half_up('value', 3)} AS value, n_rows FROM policy",
           "offers", "cells", "products", **POLICY_STEPS))
def price_policy(spark, folder):
    products = pressured_products(spark, folder)
    found, _ = _policy(_history(spark, folder, products))
    return found.withColumn("value", round_to(F.col("value"), 3))


@query(sql(f"""
SELECT product_id, inventory_bin, pressure_bin, gap_bin, coalesce(action, 2) AS action, coalesce(multiplier, 1.0::DOUBLE) AS multiplier, recommended_price,
       {half_up("recommended_price * coalesce(multiplier, 1.0::DOUBLE)", 2)} AS price
FROM (SELECT product_id, recommended_price, {_bin("inventory", "i0", "i1")} AS inventory_bin, {_bin("demand_pressure", "d0", "d1")} AS pressure_bin,
             {_bin("(recommended_price - competitor_price) / competitor_price", "g0", "g1")} AS gap_bin
      FROM offers JOIN pressure USING (product_id), limits) LEFT JOIN policy USING (inventory_bin, pressure_bin, gap_bin)
""", "offers", "cells", "products", pressure=PRESSURE, **POLICY_STEPS))
def policy_prices(spark, folder):
    products = pressured_products(spark, folder)
    found, limits = _policy(_history(spark, folder, products))
    current = products.withColumn(
        "competitor_gap", (F.col("recommended_price") - F.col("competitor_price")) / F.col("competitor_price")
    )
    return policy.policy_prices(policy.with_state(current, limits), found)


MIDDLES = [(a + b) / 2 for a, b in zip(policy.MULTIPLIERS, policy.MULTIPLIERS[1:], strict=False)]
LONG_RUN = {
    "visited": f"""
        SELECT *, {_bin("inventory", "i0", "i1")} * 9 + {_bin("demand_pressure", "d0", "d1")} * 3 + {_bin("competitor_gap", "g0", "g1")} AS state,
               base_price / avg(base_price) OVER (PARTITION BY product_id) AS ratio FROM history, limits""",
    "counted": f"""
        SELECT state, action, next_state, count(*) AS n
        FROM (SELECT state, {" + ".join(f"CAST(ratio >= {m!r}::DOUBLE AS INTEGER)" for m in MIDDLES)} AS action,
                     lead(state) OVER (PARTITION BY product_id ORDER BY date) AS next_state FROM visited)
        WHERE next_state IS NOT NULL GROUP BY ALL""",
    "rewards": "SELECT inventory_bin * 9 + pressure_bin * 3 + gap_bin AS state, action, value FROM action_values",
    "shares": """
        SELECT state, action, value, next_state, n / sum(n) OVER (PARTITION BY state, action) AS share
        FROM (SELECT state, action, value, next_state, n FROM rewards JOIN counted USING (state, action)
              UNION ALL
              SELECT state, action, value, next_state, n FROM (SELECT * FROM rewards ANTI JOIN counted USING (state, action))
                  JOIN (SELECT state, next_state, sum(n) AS n FROM counted GROUP BY ALL) USING (state)
              UNION ALL
              SELECT state, action, value, state, 1 FROM rewards ANTI JOIN counted USING (state))""",
    "valued": f"""
        SELECT 0 AS round, state, CAST(NULL AS INTEGER) AS action, 0.0::DOUBLE AS value FROM (SELECT DISTINCT state FROM rewards)
        UNION ALL
        SELECT round + 1, state, CAST(first(action ORDER BY q DESC, action) AS INTEGER), max(q)
        FROM (SELECT v.round, s.state, s.action, any_value(s.value) + 0.9::DOUBLE * sum(s.share * v.value) AS q
              FROM valued v JOIN shares s ON s.next_state = v.state WHERE v.round < {policy.ROUNDS} GROUP BY ALL)
        GROUP BY round, state""",
}


@query(sql(f"""
SELECT CAST(state // 9 AS INTEGER) AS inventory_bin, CAST(state // 3 % 3 AS INTEGER) AS pressure_bin, CAST(state % 3 AS INTEGER) AS gap_bin, action,
       [0.85::DOUBLE, 0.92, 1.0, 1.08, 1.15][action + 1] AS multiplier, {half_up("value", 3)} AS value,
       CAST(coalesce((SELECT sum(n) FROM counted c WHERE c.state = valued.state), 0) AS BIGINT) AS n_steps
FROM valued WHERE round = {policy.ROUNDS}
""", "offers", "cells", "products", recursive=True, **POLICY_STEPS, **LONG_RUN))
def price_policy_value(spark, folder):
    """The price policy that also counts what the next state is worth, from the steps between consecutive sale days."""
    history = _history(spark, folder, pressured_products(spark, folder))
    binned = stage(policy.with_state(history, policy.axis_limits(history)))
    found = policy.long_run_policy(policy.action_values(binned), policy.transitions(binned))
    return found.withColumn("value", round_to(F.col("value"), 3))

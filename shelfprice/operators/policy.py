"""Action values of price multipliers per market state, estimated from history."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfprice.functions import cents

# Price multipliers tried in every state, bins per state axis, and the
# terms of the reward.
MULTIPLIERS = (0.85, 0.92, 1.0, 1.08, 1.15)
BINS = 3
REWARD_DEMAND = 40.0
PRESSURE_WEIGHT = 0.5
HOLDING_COST = 0.2

# Worth of the next state, and rounds after which values no longer change by a thousandth.
DISCOUNT = 0.9
ROUNDS = 200

STATE = ["inventory_bin", "pressure_bin", "gap_bin"]
AXES = {"inventory_bin": "inventory", "pressure_bin": "demand_pressure", "gap_bin": "competitor_gap"}


def axis_limits(rows: DataFrame) -> DataFrame:
    """One row with the smallest and largest value of each state axis."""
    return rows.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in AXES.values()])


def with_state(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Equal-width bins of the three axes over the fleet's range."""
    ends = limits.select(F.struct(*AXES.values())).scalar()

    def bin_of(c: str) -> Column:
        low, high = ends.getField(c).getField("lo"), ends.getField(c).getField("hi")
        step = F.floor((F.col(c) - low) / F.nullif(high - low, F.lit(0.0)) * BINS)
        return F.coalesce(F.least(F.greatest(step, F.lit(0)), F.lit(BINS - 1)), F.lit(0)).cast("int")

    return rows.withColumns({name: bin_of(c) for name, c in AXES.items()})


def reward(multiplier: Column) -> Column:
    """Revenue of the units that can be sold, minus the cost of holding the rest."""
    demand = F.lit(REWARD_DEMAND) * F.exp(F.col("elasticity") * (multiplier - 1.0)) * (F.col("demand_pressure") * PRESSURE_WEIGHT + 1.0)
    sold = F.least(demand, F.col("inventory"))
    left = F.greatest(F.col("inventory") - demand, F.lit(0.0))
    return F.col("base_price") * multiplier * sold - F.col("cost") * HOLDING_COST * left


def action_values(rows: DataFrame) -> DataFrame:
    """Mean reward of every action in every state; 27 states by 5 actions at most.

    ``rows`` are historical rows with the state bins, base_price, cost, inventory,
    demand_pressure and elasticity. Rewards are summed in whole cents, so the mean does not
    depend on the order of the rows; the sums merge map-side, so a state that holds most
    rows costs nothing extra.
    """
    in_cents = F.floor(reward(F.col("multiplier")) * 100.0 + 0.5).cast("long")
    mean = F.sum(in_cents).cast("double") / F.count(in_cents) / 100.0
    actions = F.array(*[F.struct(F.lit(i).alias("action"), F.lit(m).alias("multiplier")) for i, m in enumerate(MULTIPLIERS)])
    return (
        rows.select("*", F.inline(actions))
        .groupBy(*STATE, "action", "multiplier")
        .agg(mean.alias("value"), F.count("*").alias("n_rows"))
    )


def greedy_policy(values: DataFrame) -> DataFrame:
    """Best action per state, the first one on ties."""
    return values.groupBy(*STATE).agg(
        F.min_by(F.struct("action", "multiplier", "value"), F.struct(-F.col("value"), F.col("action"))).alias("best"),
        F.max("n_rows").alias("n_rows"),
    ).select(*STATE, "best.*", "n_rows")


def _state_number() -> Column:
    return F.col(STATE[0]) * BINS * BINS + F.col(STATE[1]) * BINS + F.col(STATE[2])


def transitions(rows: DataFrame) -> DataFrame:
    """How often each action in each state was followed by which state: (state, action, next_state, n).

    ``rows`` have product_id, date, base_price and the state bins, one row per product and day. The action
    of a day is the multiplier that is nearest to its price over the product's mean price. The windows are
    per product, which has no more rows than the calendar has days; the counts merge map-side.
    """
    own = Window.partitionBy("product_id")
    ratio = F.col("base_price") / F.avg("base_price").over(own)
    middles = [(a + b) / 2 for a, b in zip(MULTIPLIERS, MULTIPLIERS[1:], strict=False)]
    action = sum(((F.col("ratio") >= m).cast("int") for m in middles), F.lit(0))
    steps = rows.withColumn("state", _state_number()).select(
        "product_id", "state", ratio.alias("ratio"), F.lead("state").over(own.orderBy("date")).alias("next_state"))
    return steps.where(F.col("next_state").isNotNull()).groupBy("state", action.alias("action"), "next_state").agg(F.count("*").alias("n"))


def long_run_policy(rewards: DataFrame, steps: DataFrame, discount: float = DISCOUNT, rounds: int = ROUNDS) -> DataFrame:
    """Best action per state when the value of the state that follows counts too.

    Value iteration on the mean rewards of :func:`action_values` and the shares of :func:`transitions`: both are
    bounded by states and actions (135 rewards, 3,645 counts), whatever the table, and come to the
    driver. An action that a state has not seen is followed by what follows that state in general, a state that
    nothing follows by itself.
    """
    states = BINS ** len(STATE)
    reward_of = np.full((states, len(MULTIPLIERS)), -np.inf)
    for r in rewards.withColumn("state", _state_number()).collect():
        reward_of[r["state"], r["action"]] = r["value"]
    counts = np.zeros((states, len(MULTIPLIERS), states))
    for r in steps.collect():
        counts[r["state"], r["action"], r["next_state"]] = r["n"]
    seen = counts.sum(axis=2)
    general = counts.sum(axis=1)
    general[general.sum(axis=1) == 0] = np.eye(states)[general.sum(axis=1) == 0]
    shares = np.where(seen[:, :, None] > 0, counts, general[:, None, :])
    shares /= shares.sum(axis=2, keepdims=True)
    known = np.isfinite(reward_of).any(axis=1)
    worth = np.zeros(states)
    values = reward_of
    for _ in range(rounds):
        values = reward_of + discount * (shares @ worth)
        worth = np.where(known, values.max(axis=1, initial=-np.inf), 0.0)
    found = []
    for state in np.flatnonzero(known):
        action = int(values[state].argmax())
        bins = [int(state) // BINS ** k % BINS for k in (2, 1, 0)]
        found.append((*bins, action, MULTIPLIERS[action], float(values[state, action]), int(seen[state].sum())))
    schema = ", ".join(f"{c} int" for c in STATE) + ", action int, multiplier double, value double, n_steps long"
    return rewards.sparkSession.createDataFrame(found, schema)


def policy_prices(products: DataFrame, policy: DataFrame) -> DataFrame:
    """Apply the policy: recommended price times the multiplier of the product's state.

    A product in a state that history never showed keeps its recommended price.
    """
    actions = F.broadcast(policy.select(*STATE, "action", "multiplier"))  # 27 rows at most
    multiplier = F.coalesce("multiplier", F.lit(1.0))
    return products.join(actions, STATE, "left").select(
        "product_id", *STATE, F.coalesce("action", F.lit(MULTIPLIERS.index(1.0))).alias("action"),
        multiplier.alias("multiplier"), "recommended_price", cents(F.col("recommended_price") * multiplier).alias("price"),
    )

"""Price recommendations from demand curves, under business rules.

The input of :func:`recommend` has one row per product: its current price, cost,
inventory and competitor price, and its curve. Candidates stay inside the row as an
array, so the sweep, the choice and the explanation need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfprice.functions import cents, round_to, safe_ratio, seasonal_factor
from shelfprice.operators.elasticity import (
    CURVE_FIELDS, curve_aggregates, demand_at, finish_curve, merged_moments, with_pooled_fallback,
)
from shelfprice.operators.staging import stage

# The sweep and the business rules.
CANDIDATES = 14
GRID_LOW = 0.6
GRID_HIGH = 1.45
NARROW_LOW = 0.9
MAX_STEP_UP = 0.2
FLOOR_WITHOUT_COST = 0.5

# Outcome codes of products without a recommendation.
NO_PRICE = "no_current_price"
NO_CURVE = "no_demand_curve"
FLOOR_ABOVE_CAP = "cost_floor_above_step_cap"


def market_state(rows: DataFrame, order: list[str], carry: list[str], group: str = "product_id", min_rows: int = 8) -> DataFrame:
    """Curve and latest row per product in one aggregation: one scan, one shuffle.

    A product without a usable curve of its own gets that of all products together,
    which is merged from the products' moments. These are staged, one row per product, as both need them.

    ``order`` ranks rows from old to new; ``carry`` names the columns of the latest
    row to keep.
    """
    state = stage(rows.groupBy(group).agg(
        *curve_aggregates(),
        F.max_by(F.struct("price", *carry), F.struct(*order)).alias("latest"),
    ))
    pooled = finish_curve(merged_moments(state.drop("latest")), min_rows)
    state = with_pooled_fallback(finish_curve(state, min_rows), pooled)
    return state.select(group, *CURVE_FIELDS, F.col("latest.price").alias("current_price"), *[f"latest.{c}" for c in carry])


def _floor_price() -> Column:
    return F.when(F.col("cost") > 0, F.col("cost")).otherwise(F.col("current_price") * FLOOR_WITHOUT_COST)


def _candidate(i: Column) -> Column:
    price = F.col("low") + i * ((F.col("high") - F.col("low")) / (CANDIDATES - 1))
    demand = demand_at(price, F.col("intercept"), F.col("elasticity"), F.col("ceiling"))
    demand = F.when(F.col("inventory") > 0, F.least(demand, F.col("inventory"))).otherwise(demand)
    return F.struct(
        i.cast("int").alias("step"),
        cents(price).alias("price"), cents(demand).alias("demand"), cents(price * demand).alias("revenue"),
        F.when(F.col("cost") > 0, cents((price - F.col("cost")) * demand)).alias("profit"),
    )


def sweep(state: DataFrame, fallback_price: Column | None = None) -> DataFrame:
    """Add outcome, bounds, applied rules and the candidate array to each product."""
    current = F.when(F.col("current_price") > 0, F.col("current_price"))
    if fallback_price is not None:
        current = F.coalesce(current, fallback_price)
    state = state.withColumn("current_price", current).withColumns({
        "floor_price": _floor_price(), "cap_price": F.col("current_price") * (1 + MAX_STEP_UP),
    })
    outcome = (
        F.when(F.col("current_price").isNull(), NO_PRICE)
        .when(~F.col("usable"), NO_CURVE)
        .when(F.col("floor_price") > F.col("cap_price"), FLOOR_ABOVE_CAP)
        .otherwise("ok")
    )
    wide_low = F.greatest(F.col("current_price") * GRID_LOW, F.col("floor_price"))
    wide_high = F.col("current_price") * GRID_HIGH
    low = F.when(wide_low < wide_high, wide_low).otherwise(F.greatest(F.col("current_price") * NARROW_LOW, F.col("floor_price")))
    rules = F.array_compact(F.array(
        F.when(F.col("cost") > 0, "price-floor-at-cost"),
        F.when(wide_high > F.col("cap_price"), "max-single-step-increase"),
    ))
    steps = F.sequence(F.lit(0), F.lit(CANDIDATES - 1))
    return (
        state.withColumns({"outcome": outcome, "supported": outcome == "ok"})
        .withColumns({"low": low, "high": F.least(wide_high, F.col("cap_price")), "rules": rules})
        .withColumn("candidates", F.when(F.col("supported"), F.transform(steps, _candidate)))
        .drop("low", "high")
    )


def choose(swept: DataFrame, objective: str = "revenue") -> DataFrame:
    """Pick the candidate with the highest score, the first and so lowest price on ties."""
    def score(c: Column) -> Column:
        if objective == "profit":
            return F.when(F.col("cost") > 0, (c["price"] - F.col("cost")) * c["demand"]).otherwise(c["revenue"])
        return c["revenue"]

    ranked = F.transform("candidates", lambda c: F.struct(score(c).alias("score"), (-c["step"]).alias("tie"), c.alias("pick")))
    best = F.array_max(ranked)["pick"]
    now = demand_at(F.col("current_price"), F.col("intercept"), F.col("elasticity"), F.col("ceiling"))
    change = (F.col("recommended_price") - F.col("current_price")) / F.col("current_price") * 100.0
    return swept.withColumn("best", best).withColumns({
        "objective": F.lit(objective),
        "recommended_price": F.col("best")["price"], "expected_demand": F.col("best")["demand"],
        "expected_revenue": F.col("best")["revenue"], "expected_profit": F.col("best")["profit"],
        "current_demand": now,
    }).withColumn("change_pct", round_to(change, 1)).drop("best")


def reliability_points() -> Column:
    history = F.when(F.col("n_obs") >= 150, 3).when(F.col("n_obs") >= 30, 2).otherwise(1)
    fit = F.when(F.col("r2") >= 0.3, 3).when(F.col("r2") >= 0.1, 2).otherwise(1)
    slope = F.when(F.col("elasticity").between(-3.0, -0.3), 2).otherwise(1)
    margin = F.when((F.col("cost") > 0) & (F.col("current_price") > F.col("cost")), 1).otherwise(0)
    return F.least(history + fit + slope + margin, F.lit(9))


def reliability_codes() -> Column:
    """What the points were given for: history, fit, slope, and margin if the cost is known."""
    history = F.when(F.col("n_obs") >= 150, "solid_history").when(F.col("n_obs") >= 30, "moderate_history").otherwise("thin_history")
    fit = F.when(F.col("r2") >= 0.3, "good_fit").when(F.col("r2") >= 0.1, "acceptable_fit").otherwise("weak_fit")
    slope = F.when(F.col("elasticity").between(-3.0, -0.3), "plausible_elasticity").otherwise("extreme_elasticity")
    margin = F.when((F.col("cost") > 0) & (F.col("current_price") > F.col("cost")), "known_margin")
    return F.array_compact(F.array(history, fit, slope, margin))


def reliability(recommended: DataFrame) -> DataFrame:
    """Add points (at most 9) and a High, Medium or Low level."""
    points = F.col("reliability_score")
    return recommended.withColumn("reliability_score", reliability_points()).withColumn(
        "reliability", F.when(points >= 7, "High").when(points >= 4, "Medium").otherwise("Low")
    )


def recommend(state: DataFrame, objective: str = "revenue", fallback_price: Column | None = None) -> DataFrame:
    """Sweep, choice and reliability for every product; unsupported ones keep their outcome."""
    return reliability(choose(sweep(state, fallback_price), objective))


def portfolio(recommended: DataFrame) -> DataFrame:
    """The supported recommendations as a flat table."""
    return recommended.where("supported").select(
        "product_id", "current_price", "recommended_price", "change_pct", "expected_demand",
        "expected_revenue", "expected_profit", "elasticity", "reliability",
    )


def portfolio_top(recommended: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest price changes, by product on ties."""
    return portfolio(recommended).orderBy(F.desc(F.abs("change_pct")), "product_id").limit(n)


def candidate_table(swept: DataFrame) -> DataFrame:
    """One row per product and candidate price."""
    return swept.where("supported").select("product_id", F.inline("candidates"))


def unsupported(recommended: DataFrame) -> DataFrame:
    return recommended.where(~F.col("supported")).select("product_id", "current_price", "n_obs", "outcome")


def _reason(code: str, tone: str, text: Column | str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(F.lit(code).alias("code"), F.lit(tone).alias("tone"), text.alias("text"))


def recommendation_reasons(recommended: DataFrame) -> DataFrame:
    """Add ``reasons``, an array of code, tone and text, to supported recommendations."""
    new, now = F.col("recommended_price"), F.col("current_price")
    demand_ratio = F.col("expected_demand") / F.greatest("current_demand", F.lit(1e-9))
    gap = safe_ratio(new - F.col("competitor_price"), F.col("competitor_price")) * 100.0
    short = F.col("inventory") < F.col("expected_demand") * 7
    stocked, rivalled = F.col("inventory") > 0, F.col("competitor_price") > 0
    profitable = (F.col("cost") > 0) & (F.col("objective") == "profit")
    reasons = F.array_compact(F.array(
        F.when(new > now, _reason("raise", "up", F.format_string("Revenue is estimated higher at %.2f than at %.2f.", new, now)))
        .when(new < now, _reason("lower", "down", F.format_string("The curve expects clearly more units at %.2f.", new)))
        .otherwise(_reason("keep", "flat", "The current price is already the best candidate.")),
        F.when(demand_ratio > 1.05, _reason("demand_up", "up", F.format_string("%.1f units a day instead of %.1f.", F.col("expected_demand"), F.col("current_demand"))))
        .when(demand_ratio < 0.95, _reason("demand_down", "down", F.format_string("Units fall to %.1f a day.", F.col("expected_demand")))),
        F.when(rivalled & (gap > 3), _reason("above_competitor", "up", F.format_string("%.0f%% above the competitor.", gap)))
        .when(rivalled & (gap < -3), _reason("below_competitor", "down", F.format_string("%.0f%% below the competitor.", F.abs(gap))))
        .when(rivalled, _reason("near_competitor", "flat", F.format_string("Within %.0f%% of the competitor.", F.abs(gap)))),
        F.when(stocked & short, _reason("stock_short", "flat", F.format_string("Stock of %.0f is less than a week of sales.", F.col("inventory"))))
        .when(stocked, _reason("stock_enough", "flat", F.format_string("Stock of %.0f covers the expected sales.", F.col("inventory")))),
        F.when(profitable, _reason("objective_profit", "up", F.format_string("Margin at the new price: %.0f%%.", (new - F.col("cost")) / new * 100.0)))
        .otherwise(F.struct(F.concat(F.lit("objective_"), F.col("objective")).alias("code"), F.lit("flat").alias("tone"), F.lit("Best candidate for the objective.").alias("text"))),
        _reason("model", "flat", F.format_string("Log-log curve on %d rows, R2 %.3f.", F.col("n_obs"), F.col("r2"))),
    ))
    rules = F.transform("rules", lambda r: F.struct(F.concat(F.lit("rule:"), r).alias("code"), F.lit("flat").alias("tone"), F.lit("Business rule applied.").alias("text")))
    return recommended.where("supported").withColumn("reasons", F.concat(reasons, rules))


def context_reasons(recommended: DataFrame) -> DataFrame:
    """Stock, competitor, season and margin arguments for a price; needs ``month``."""
    new = F.col("recommended_price")
    stock = F.col("inventory")
    gap = safe_ratio(F.col("competitor_price") - new, new)
    season = seasonal_factor(F.col("month"))
    margin = safe_ratio(new - F.col("cost"), new)
    reasons = F.array_compact(F.array(
        F.when(stock <= 20, _reason("low_stock", "up", F.format_string("Only %.0f units left.", stock)))
        .when(stock >= 200, _reason("high_stock", "down", F.format_string("%.0f units to move.", stock)))
        .otherwise(_reason("balanced_stock", "flat", "Stock is balanced.")),
        F.when(gap > 0.05, _reason("competitor_above", "up", F.format_string("Competitors are %.0f%% above.", gap * 100.0)))
        .when(gap < -0.05, _reason("competitor_below", "down", F.format_string("Competitors are %.0f%% below.", F.abs(gap) * 100.0)))
        .when(gap.isNotNull(), _reason("competitor_level", "flat", "Level with competitors.")),
        F.when(season > 1.2, _reason("peak_season", "up", "Peak season.")).when(season < 0.9, _reason("off_season", "down", "Off season.")),
        F.when(margin > 0.55, _reason("healthy_margin", "up", F.format_string("Margin of %.0f%%.", margin * 100.0)))
        .when(margin < 0.2, _reason("tight_margin", "down", F.format_string("Margin of only %.0f%%.", margin * 100.0))),
    ))
    return recommended.where("supported").withColumn("reasons", reasons)


def price_comparison(recommended: DataFrame, totals: DataFrame, months: Column) -> DataFrame:
    """Current daily revenue and profit next to the expected ones, per product."""
    days = F.greatest(F.lit(1.0), months * 30.0)
    joined = recommended.where("supported").join(totals.drop("category"), "product_id")
    joined = joined.withColumns({
        "current_revenue": round_to(F.col("revenue") / days, 0),
        "current_profit": round_to(F.col("profit") / days, 0),
        "new_revenue": round_to(F.col("expected_revenue"), 0),
        "new_profit": round_to((F.col("recommended_price") - F.col("cost")) * F.col("expected_demand"), 0),
    })
    uplift = [
        round_to(safe_ratio(F.col(f"new_{m}") - F.col(f"current_{m}"), F.abs(f"current_{m}")) * 100.0, 1).alias(f"{m}_uplift_pct")
        for m in ("revenue", "profit")
    ]
    return joined.select(
        "product_id", "current_price", "recommended_price", "current_revenue", "new_revenue",
        "current_profit", "new_profit", *uplift,
    )


def prediction_export(recommended: DataFrame, totals: DataFrame) -> DataFrame:
    """Flat table for a CSV export: catalogue facts next to the recommendation."""
    supported = recommended.where("supported").select(
        "product_id", "current_price", "cost", "recommended_price", "expected_revenue", "change_pct"
    )
    return totals.join(supported, "product_id").select(
        "product_id", "category", "current_price", "cost", "recommended_price", "expected_revenue",
        F.col("change_pct").alias("price_change_pct"),
        F.col("revenue").alias("current_revenue"), F.col("profit").alias("current_profit"),
    )


# The fixed-elasticity sweep.
BASE_DEMAND = 60.0
DEFAULT_ELASTICITY = -1.0


def fixed_elasticity_price(
    products: DataFrame, price_range: float = 0.15, n_candidates: int = 11, elasticity: float = DEFAULT_ELASTICITY
) -> DataFrame:
    """Profit-maximising price around ``current_price`` for a known elasticity."""
    now = F.col("current_price")
    low, high = now * (1 - price_range), now * (1 + price_range)

    def candidate(i: Column) -> Column:
        price = low + i * ((high - low) / (n_candidates - 1))
        demand = F.greatest(F.lit(1.0), F.floor(F.lit(BASE_DEMAND) * F.pow(price / now, F.lit(float(elasticity))) + 0.5).cast("double"))
        return F.struct(((price - F.col("cost")) * demand).alias("profit"), (-i).alias("tie"), price.alias("price"), demand.alias("demand"))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n_candidates - 1)), candidate))
    return products.where(now > 0).withColumn("best", best).select(
        "product_id", "current_price", "cost",
        cents(F.col("best.price")).alias("recommended_price"), F.col("best.demand").alias("predicted_demand"),
        cents(F.col("best.profit")).alias("expected_profit"),
    )


# Discounts of the what-if grid, and its confidence points.
DISCOUNTS = (0, 5, 10, 15, 20)


def confidence_pct() -> Column:
    """Confidence from price plausibility, margin and stock, in percent."""
    price, rival, cost, stock = (F.col(c) for c in ("current_price", "competitor_price", "cost", "inventory"))
    score = (
        F.lit(55)
        + F.when(price.between(rival * 0.7, rival * 1.3), 20).otherwise(0)
        + F.when(price <= cost * 2.5, 15).otherwise(0)
        + F.when(stock.between(10, 200), 10).otherwise(0)
    )
    return F.least(score, F.lit(97))


def discount_grid(state: DataFrame) -> DataFrame:
    """Demand, revenue and profit of each product at each discount, on its own curve."""
    price = F.col("current_price") * (F.lit(1.0) - F.col("discount_pct") / 100.0)
    demand = demand_at(price, F.col("intercept"), F.col("elasticity"), F.col("ceiling"))
    demand = round_to(F.when(F.col("inventory") > 0, F.least(demand, F.col("inventory"))).otherwise(demand), 1)
    offers = F.explode(F.array(*[F.lit(float(d)) for d in DISCOUNTS]))
    return state.where("usable").withColumn("discount_pct", offers).select(
        "product_id", "discount_pct", cents(price).alias("price"), demand.alias("demand"),
        cents(price * demand).alias("revenue"), cents((price - F.col("cost")) * demand).alias("profit"),
        confidence_pct().alias("confidence_pct"),
    )


# Units of a foreign currency per dollar.
EXCHANGE_RATES = {"USD": 1.0, "INR": 83.0, "EUR": 0.92, "GBP": 0.79}


def convert_currency(prices: DataFrame, columns: list[str], code: str = "USD", rate: float | None = None) -> DataFrame:
    """Money columns in another currency; an unknown code stays in dollars."""
    code = code.upper() if code.upper() in EXCHANGE_RATES else "USD"
    factor = float(rate) if rate is not None and rate > 0 else EXCHANGE_RATES[code]
    return prices.withColumns({c: cents(F.col(c) * factor) for c in columns}).withColumn("currency", F.lit(code))

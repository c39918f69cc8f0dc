"""Values of states in the long run, against solving for the values of fixed policies."""

import datetime
import itertools

import numpy as np
import pytest

from shelfprice.operators import policy

DAY = datetime.date(2021, 1, 1)
SCHEMA = "product_id long, date date, base_price double, inventory_bin int, pressure_bin int, gap_bin int"


def history(n_products, n_days, seed):
    draw = np.random.default_rng(seed)
    rows = []
    for p in range(n_products):
        for d in sorted(draw.choice(90, n_days, replace=False)):
            rows.append((p, DAY + datetime.timedelta(days=int(d)), float(round(draw.uniform(5, 20), 2)), int(draw.integers(3)), int(draw.integers(2)), 0))
    return rows


def counted(rows):
    """Steps by plain loops."""
    out = {}
    for _, own in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        own = list(own)
        mean = sum(r[2] for r in own) / len(own)
        for now, after in zip(own, own[1:]):
            ratio = now[2] / mean
            action = min(range(5), key=lambda a: (abs(policy.MULTIPLIERS[a] - ratio), -a))
            key = (now[3] * 9 + now[4] * 3 + now[5], action, after[3] * 9 + after[4] * 3 + after[5])
            out[key] = out.get(key, 0) + 1
    return out


def test_transitions(spark):
    rows = history(12, 30, 1)
    found = policy.transitions(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {(r["state"], r["action"], r["next_state"]): r["n"] for r in found} == counted(rows)


def rewards(spark, values):
    data = [(s // 9, s // 3 % 3, s % 3, a, policy.MULTIPLIERS[a], float(v)) for (s, a), v in values.items()]
    return spark.createDataFrame(data, "inventory_bin int, pressure_bin int, gap_bin int, action int, multiplier double, value double")


def steps(spark, counts):
    return spark.createDataFrame([(*k, n) for k, n in counts.items()], "state int, action int, next_state int, n long")


def test_long_run_values(spark):
    """The best of all fixed policies, each solved as a linear system."""
    draw = np.random.default_rng(3)
    states = [0, 4, 13]
    values = {(s, a): draw.uniform(0, 100) for s in states for a in range(5)}
    counts = {(s, a, t): int(draw.integers(1, 9)) for s in states for a in range(5) for t in states if (s, a) not in [(4, 2), (13, 0)] and draw.random() < 0.8}
    general = {s: {t: sum(n for (x, _, y), n in counts.items() if (x, y) == (s, t)) for t in states} for s in states}

    def share(s, a):
        own = np.array([counts.get((s, a, t), 0) for t in states], float)
        own = own if own.sum() else np.array([general[s][t] for t in states], float)
        return own / own.sum()

    best = np.full(3, -np.inf)
    for choice in itertools.product(range(5), repeat=3):
        p = np.array([share(s, a) for s, a in zip(states, choice)])
        r = np.array([values[s, a] for s, a in zip(states, choice)])
        best = np.maximum(best, np.linalg.solve(np.eye(3) - policy.DISCOUNT * p, r))
    got = {r["inventory_bin"] * 9 + r["pressure_bin"] * 3 + r["gap_bin"]: r for r in policy.long_run_policy(rewards(spark, values), steps(spark, counts)).collect()}
    assert [got[s]["value"] for s in states] == pytest.approx(best, rel=1e-6)
    assert all(got[s]["n_steps"] == sum(n for (x, _, _), n in counts.items() if x == s) for s in states)


def test_the_next_state_can_change_the_choice(spark):
    """A smaller reward now is chosen if it leads to a better state."""
    values = {(0, a): 10.0 - a for a in range(5)} | {(26, a): 100.0 for a in range(5)}
    counts = {(0, 0, 0): 5, (0, 1, 26): 5, (0, 2, 0): 1, (0, 3, 0): 1, (0, 4, 0): 1, (26, 0, 26): 1}
    got = {r["inventory_bin"]: r for r in policy.long_run_policy(rewards(spark, values), steps(spark, counts)).collect()}
    assert got[0]["action"] == 1 and got[2]["value"] == pytest.approx(1000, rel=1e-6)


def test_without_history(spark):
    values = {(5, a): float(a) for a in range(5)}
    (row,) = policy.long_run_policy(rewards(spark, values), steps(spark, {(1, 1, 1): 1}).limit(0)).collect()
    assert (row["action"], row["n_steps"]) == (4, 0) and row["value"] == pytest.approx(40.0, rel=1e-6)

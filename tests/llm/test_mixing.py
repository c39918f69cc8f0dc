"""Mixing by Pareto order sampling: targets, limits, repeatability."""

from collections import defaultdict

import pytest

from cases import awkward, frame, prose, words
from shelfprice.llm import mixing, queries
from shelfprice.llm.common import table


def water(sizes, most=3):
    """Targets by repeated resharing."""
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    got, open_, left = {s: 0.0 for s in sizes}, set(sizes), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        unit = left / sum(weights[s] for s in open_)
        left = 0.0
        for s in list(open_):
            got[s] += weights[s] * unit
            if got[s] >= most * sizes[s]:
                left += got[s] - most * sizes[s]
                got[s] = most * sizes[s]
                open_.remove(s)
    return got


def check(rows, docs, tolerance):
    texts = sorted((str(i), len(words(t))) for i, t, _ in docs)
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == texts
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(words(t))
    goal = water(dict(sizes))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= tolerance * goal[s] + 1


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text", "source").collect()]
    rows = queries.op3_mixing(spark, folder).collect()
    check(rows, docs, 0.05)
    again = {r["doc_id"]: r["taken"] for r in queries.op3_mixing(spark, folder).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_inclusion_follows_the_odds(spark):
    """Of documents of two lengths the longer are expected more copies, in the ratio of their levels."""
    rows = [(i, " ".join(prose(20 if i % 2 else 200, i)), "en", "abc"[i % 3], 0) for i in range(1500)]
    got = mixing.mix(frame(spark, rows)).collect()
    check(got, [(i, t, s) for i, t, _, s, _ in rows], 0.02)
    by = defaultdict(list)
    for r in got:
        by[r["source"], r["size"]].append(r["copies"])
    mean = {k: sum(v) / len(v) for k, v in by.items()}
    assert mean["a", 200] / mean["a", 20] == pytest.approx(8 / 5, rel=0.25)


def test_awkward_rows(spark):
    docs = [(i, t, s) for i, t, _, s, _ in awkward()]
    rows = mixing.mix(frame(spark)).collect()
    check(rows, docs, 10.0)  # a few long texts in a source: no near choice exists
    repeated = mixing.repeated(frame(spark))
    assert repeated.columns == frame(spark).columns
    assert repeated.count() == sum(r["copies"] for r in rows)


def test_empty_and_all_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.repeated(frame(spark, [])).count() == 0
    rows = mixing.mix(frame(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])).collect()
    assert [r["taken"] for r in rows] == [0, 0]


def test_targets_stop_at_the_limit():
    assert mixing.targets([10, 100, 0], [1, 2, 3]) == pytest.approx([30, 80, 0])
    assert mixing.targets([], []) == []


def test_texts_stay_where_they_are(spark):
    plan = mixing.repeated(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

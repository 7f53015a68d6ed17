"""Greedy admission against a plain loop; extractors by provider."""

import datetime as dt
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postflow.operators import admission, evaluation
from postflow.operators.extractors import Registry

COLUMNS = "day string, ts long, id long, cost decimal(18,6)"


def loop(rows, budgets):
    left, won = dict(budgets), set()
    for day, ts, i, cost in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if day in left and left[day] >= 0 and cost is not None and 0 <= cost <= left[day]:
            left[day] -= cost
            won.add(i)
    return won


def admitted(spark, rows, budgets):
    calls = spark.createDataFrame(rows, COLUMNS)
    limits = spark.createDataFrame(list(budgets.items()), "day string, budget decimal(18,6)")
    got = admission.greedy(calls, limits, ["day"], ["ts", "id"], F.col("cost"))
    assert got.columns[-1] == "admitted" and set(got.columns) == {*calls.columns, "admitted"}
    found = got.collect()
    assert len(found) == len(rows)
    return {r["id"] for r in found if r["admitted"]}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_a_loop(spark, seed):
    """Costs over several orders of magnitude, with ties in time; one day holds most calls."""
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.6 else r.choice("abc"), r.randrange(150), i,
             Decimal(str(round(10 ** r.uniform(-5, 2.2), 6)))) for i in range(400)]
    budgets = {"hot": Decimal("120.5"), "a": Decimal("3"), "b": Decimal("1000000"), "c": Decimal("0.000007")}
    assert admitted(spark, rows, budgets) == loop(rows, budgets)


def test_a_small_call_follows_each_big_one(spark):
    """The order in which prefixes would need a round for each call."""
    rows = [("d", k, k, Decimal(1) if k % 2 == 0 else Decimal(100 - k // 2)) for k in range(200)]
    budgets = {"d": Decimal(100)}
    assert admitted(spark, rows, budgets) == loop(rows, budgets)


def test_odd_calls(spark):
    """No cost, a negative one, free calls, exact fits, periods without or with a negative budget."""
    rows = [("a", 1, 1, None), ("a", 2, 2, Decimal(-1)), ("a", 3, 3, Decimal(0)), ("a", 4, 4, Decimal(5)), ("a", 5, 5, Decimal(0)),
            ("a", 6, 6, Decimal("0.000001")), ("b", 1, 7, Decimal(0)), ("b", 2, 8, Decimal(1)), ("c", 1, 9, Decimal(0)), (None, 1, 10, Decimal(0))]
    budgets = {"a": Decimal(5), "b": Decimal(-1)}
    assert admitted(spark, rows, budgets) == loop(rows, budgets) == {3, 4, 5}
    assert admitted(spark, rows[:0], budgets) == set()


def test_run_admits_a_later_cheaper_call(spark):
    """The daily and the monthly rest bound a run, dear calls go first, then the call limit counts admitted ones."""
    costs = [Decimal(c) for c in ("0.6", "0.9", "0.3", "0.2", "0.05", "0.04", "0.01")]
    asked = spark.createDataFrame(list(enumerate(costs)), "id long, est_cost decimal(18,6)")
    log = spark.createDataFrame([("2024-01-05T10:00:00", Decimal("0.1")), ("2024-01-01T10:00:00", Decimal("3"))], "timestamp string, cost_usd decimal(18,6)")
    limits = evaluation.Limits(max_cost_per_call=0.8, daily_budget=1.0, monthly_budget=50.0, max_calls_per_run=3)
    reasons = {r["id"]: r["budget_reason"] for r in evaluation.admit_greedy(asked, log, dt.date(2024, 1, 5), ["id"], limits).collect()}
    assert reasons[1] == "cost per call" and [i for i in sorted(reasons) if reasons[i] is None] == [0, 2]
    # 0.6 + 0.3 use up the 0.9 that are left of the day.
    limits = evaluation.Limits(max_cost_per_call=0.5, daily_budget=0.6, monthly_budget=50.0, max_calls_per_run=3)
    reasons = {r["id"]: r["budget_reason"] for r in evaluation.admit_greedy(asked, log, dt.date(2024, 1, 5), ["id"], limits).collect()}
    assert [i for i in sorted(reasons) if reasons[i] is None] == [2, 3]
    limits = evaluation.Limits(max_cost_per_call=0.25, daily_budget=0.36, monthly_budget=50.0, max_calls_per_run=2)
    reasons = {r["id"]: r["budget_reason"] for r in evaluation.admit_greedy(asked, log, dt.date(2024, 1, 5), ["id"], limits).collect()}
    assert [i for i in sorted(reasons) if reasons[i] is None] == [3, 4]


def test_registered_extractor_and_default_side_by_side(spark):
    def own(batch: pd.DataFrame) -> pd.DataFrame:
        if batch["html"].str.contains("broken").any():
            raise KeyError("broken")
        return pd.DataFrame({"title": batch["html"].str.extract(r"<b>(.*?)</b>")[0], "company": batch["provider"].str.upper(), "more": 1})

    pages = spark.createDataFrame([
        (1, "https://x.example/1", "<b>One</b>", " Own "), (2, "https://x.example/2", "broken", "own"), (3, "https://x.example/3", "<title>Three</title>", "other"),
        (4, "https://x.example/4", "<title>Four</title>", None), (5, "https://x.example/5", "<i>none</i>", "own"), (6, None, None, "x")],
        "page_id long, url string, html string, p string")
    registry = Registry(["title", "company"]).register("OWN", own)
    got = {r["page_id"]: r for r in registry.extract(pages, F.col("p")).collect()}
    assert {k: (r["title"], r["company"], r["error"]) for k, r in got.items() if k in (1, 2, 5)} == {
        1: ("One", "OWN", None), 2: (None, None, "KeyError"), 5: (None, "OWN", None)}
    assert got[3]["title"] == "Three" and got[4]["title"] == "Four" and got[6]["title"] is None and len(got) == 6
    assert registry.extract(pages.where("1 = 0"), F.col("p")).count() == 0
    with pytest.raises(ValueError):
        registry.register("own", own)
    assert Registry(["title"]).extract(pages, F.col("p")).count() == 6

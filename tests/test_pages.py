"""Nesting of page elements against a stack, and label values against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postflow.operators import pages as PG


def by_stack(markup, tag="div"):
    """Every well-nested element of the page, by a stack of open ones."""
    starts = [m.start() for m in re.finditer(rf"(?i)</?{tag}\b", markup)]
    stack, out = [], []
    for at in starts:
        if markup[at + 1] != "/":
            stack.append(at)
        elif stack:
            begin = stack.pop()
            whole = markup[begin:at]
            head = re.match(r"<[^\s>]*([^>]*)>", whole)
            out.append((begin, head[1] if head else "", re.sub(r"^<[^>]*>", "", whole)))
    return [(attrs, inner) for _, attrs, inner in sorted(out)]


def random_page(r):
    parts = []
    for k in range(r.randint(0, 60)):
        parts.append(r.choice([f"<div class='c{k % 3}'>", "<DIV>", "</div>", "</div>", "text ", "<p>x</p>", "<divider>", "<div id=a\n>"]))
    return "".join(parts)


def test_containers_equal_a_stack(spark):
    r = random.Random(6)
    markups = ["", "x", "<div>", "</div>", "</div><div>", "</div></div><div>a</div>", '<div title="<div>">a</div></div>', None] + [random_page(r) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(markups)), "k int, html string")
    got = df.select("k", PG.containers(F.col("html")).alias("all"), PG.containers(
        F.col("html"), wanted=lambda attrs: PG.classes(attrs) == "c1").alias("some")).collect()
    for row in got:
        want = None if markups[row["k"]] is None else by_stack(markups[row["k"]])
        assert (row["all"] if want is None else [tuple(e) for e in row["all"]]) == want
        if want is not None:
            assert [tuple(e) for e in row["some"]] == [e for e in want if "class='c1'" in e[0]]


@pytest.mark.parametrize("deep", [False, True])
def test_a_page_of_many_tags(spark, deep):
    n = 10_000
    open_, close = "<div class='a'>", "</div>"
    around = (open_ * n, close * n) if deep else (f"{open_}x{close}" * n, "")
    html = f"{around[0]}<div class='wanted'><p>here</p></div>{around[1]}"
    df = spark.createDataFrame([(html,)], "html string")
    found = df.select(PG.containers(F.col("html"), wanted=lambda a: PG.classes(a) == "wanted").alias("c")).first()["c"]
    assert [e["inner"] for e in found] == ["<p>here</p>"]


def test_running_sum(spark):
    rows = [[], [1], [1, -1, 0], list(range(-5, 60)), [1] * 1025]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v array<int>")
    for row in df.select("k", PG.running_sum(F.col("v")).alias("s")).collect():
        assert row["s"] == [sum(rows[row["k"]][:i + 1]) for i in range(len(rows[row["k"]]))]


def test_the_last_value_of_a_label_wins(spark):
    r = random.Random(7)
    streams = [[], ["Start:"], ["Start:", "a", "Start", "b"]] + [[r.choice(["Start:", "Ort", "Ort:", "a", "b", "c", ":"]) for _ in range(40)] for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(streams)), "k int, s array<string>")
    values = PG.label_values(F.col("s"), ["Start", "Ort"])
    for row in df.select("k", PG._label_pairs(F.col("s"), ["Start", "Ort"]).alias("pairs"), values.alias("m"), F.map_keys(values).alias("order")).collect():
        want = {}
        for p in row["pairs"]:
            want.pop(p["key"], None)
            want[p["key"]] = p["value"]
        assert row["m"] == want and row["order"] == list(want)

"""Delta log of keyed state, and the state fold as a stream over it."""

import os
import random
import tempfile

import pytest
from pyspark.sql.types import IntegerType, StructType

from postflow.model import STATES
from postflow.streaming import lifecycle as SL
from postflow.streaming.deltas import DeltaLog
from tests.test_operators import _plain_fold

SCHEMA = StructType().add("k", "string").add("v", IntegerType())


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_log_equals_a_dictionary(spark):
    log, state, r = DeltaLog(tempfile.mkdtemp(dir="/tmp"), ("k",), SCHEMA, 4), {}, random.Random(5)
    history = []
    for batch in range(8):
        keys = r.sample([f"k{i}" for i in range(30)], 9)
        change = [(k, r.randint(0, 99), r.random() < 0.3) for k in keys]
        df = spark.createDataFrame(change, "k string, v int, _gone boolean")
        log.append(df, batch)
        log.append(df, batch)  # repeated
        for k, v, gone in change:
            state.pop(k, None) if gone else state.update({k: v})
        history.append(sorted(state.items()))
        if batch in (2, 5):
            log.compact(spark)
        assert rows(log.read(spark)) == history[-1]
    assert rows(log.read(spark, before=7)) == history[6] and rows(log.read(spark, before=0)) == []
    asked = spark.createDataFrame([("k1",), ("k1",), ("none",)], "k string")
    assert rows(log.read(spark, only=asked)) == [x for x in history[-1] if x[0] == "k1"]


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_a_batch_writes_what_it_changes(spark):
    log = DeltaLog(tempfile.mkdtemp(dir="/tmp"), ("k",), SCHEMA, 4)
    log.append(spark.range(50_000).selectExpr("cast(id as string) as k", "cast(id as int) as v"), 0)
    log.append(spark.createDataFrame([("7", 1)], "k string, v int"), 1)
    assert size(f"{log.path}/delta=1") < size(f"{log.path}/delta=0") / 50
    assert log.read(spark).count() == 50_000
    # An unfinished folder does not count.
    os.remove(f"{log.path}/delta=1/_SUCCESS")
    assert not log.complete(spark, 1) and rows(log.read(spark, only=spark.createDataFrame([("7",)], "k string"))) == [("7", 7)]


@pytest.mark.parametrize("compacted", [False, True])
def test_stream_equals_a_loop_with_a_hot_posting(spark, compacted):
    base, r = tempfile.mkdtemp(dir="/tmp"), random.Random(12)
    columns = "project_id string, ts int, event_id int, to_state string, force boolean"
    events, names = [], [*STATES, "fremd"]
    write = SL.fold_writer(SL.state_log(f"{base}/log", spark.createDataFrame([], columns)), f"{base}/out", ["ts", "event_id"])
    log = SL.state_log(f"{base}/log", spark.createDataFrame([], columns))
    for batch in range(3):
        new = [("hot" if r.random() < 0.4 else f"p{r.randint(0, 20)}", 1000 * batch + r.randint(0, 99), 1000 * batch + k, r.choice(names), r.random() < 0.1) for k in range(200)]
        events += new
        df = spark.createDataFrame(new, columns)
        write(df, batch)
        write(df, batch)  # repeated: changes nothing
        if compacted:
            log.compact(spark)
    got = {x.event_id: (x.from_state, x.accepted, x.state) for x in spark.read.parquet(f"{base}/out").collect()}
    want = _plain_fold(events)
    assert got == want
    last = {e[0]: want[e[2]][2] for e in sorted(events, key=lambda e: e[1:3])}
    assert dict(rows(log.read(spark))) == last

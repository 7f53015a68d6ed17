"""States of postings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..model import STATES, TRANSITIONS
from .ordered import SLICE, previous, slices

# Stands for a state outside the domain, which only a forced change can set or leave.
OTHER = "\0"
ARROWS = [f"{a}>{b}" for a, targets in TRANSITIONS.items() for b in targets]


def transitions(spark: SparkSession) -> DataFrame:
    """The transition matrix as a dimension table."""
    return spark.createDataFrame([tuple(a.split(">")) for a in ARROWS], "from_state string, to_state string")


def is_valid(current: Column, new: Column) -> Column:
    """an empty current state allows any known or unknown target, as an update does."""
    return F.coalesce(current, F.lit("")).isin("") | F.concat(current, F.lit(">"), new).isin(ARROWS)


def valid_pairs(pairs: DataFrame) -> DataFrame:
    """F17 as a semi-join."""
    return pairs.join(F.broadcast(transitions(pairs.sparkSession)), ["from_state", "to_state"], "left_semi")


def check_timeline(events: DataFrame, key: str, order: list[str], state: str = "to_state") -> DataFrame:
    """Each change with the state before it and whether the matrix allows the step."""
    return previous(events, [key], order, state, "from_state") \
        .withColumn("valid", is_valid(F.col("from_state"), F.col(state)))


OVERRIDE = "_override"


def with_override(events: DataFrame) -> DataFrame:
    """Adds the flag of forced changes and of those made in the user interface."""
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("force", "ui_context") if c in events.columns]
    return events.withColumn(OVERRIDE, reduce(lambda a, b: a | b, flags, F.lit(False)))


def fold_states(events: DataFrame, key: str, order: list[str], starts: DataFrame | None = None) -> DataFrame:
    """T8, batch: every event with ``from_state``, ``accepted`` and the state after it.

    A refused change leaves the state as it was, so the state depends on the whole history
    of a posting.  The domain is small, though: a slice of events is summarised by the
    state it leads to from each possible start.  The summaries of a posting are chained,
    then all slices are replayed side by side from their start state.  A posting with a
    third of all events is thus spread like any other.  Within a slice changes are maps of
    states too, composed for all rows of a batch at once.  An empty state is none.  ``force`` and, where there is such
    a column, ``ui_context`` let a change through whatever the matrix says.  ``starts`` (key,
    state) are states carried from earlier; other postings start without one.
    """
    # Dealt once: both passes read the same shuffle.
    cut = slices(with_override(events), order[0]).repartition(key, SLICE)
    known = [None] + STATES + [OTHER]
    maps = cut.sortWithinPartitions(key, SLICE, *order).mapInPandas(
        _summarise(key), f"`{key}` {dict(cut.dtypes)[key]}, {SLICE} int, _map array<string>")
    # One small array per slice of a posting.
    chain = maps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(SLICE, "_map"))).alias("_chain"))

    def advance(acc: Column, s: Column) -> Column:
        index = F.when(acc["state"].isNull(), 0)
        for i, value in enumerate(known[1:-1], start=1):
            index = index.when(acc["state"] == value, i)
        reached = F.get(s["_map"], index.otherwise(len(known) - 1))
        return F.struct(
            F.when(reached == OTHER, acc["state"]).otherwise(reached).alias("state"),
            F.concat(acc["starts"], F.array(F.struct(s[SLICE].alias(SLICE), acc["state"].alias("start")))
                     ).alias("starts"))

    if starts is None:
        chain = chain.withColumn("_start", F.lit(None).cast("string"))
    else:
        chain = chain.join(starts.select(key, F.col("state").alias("_start")), key, "left")
    zero = F.struct(F.col("_start").alias("state"),
                    F.expr(f"cast(array() as array<struct<{SLICE}:int,start:string>>)").alias("starts"))
    begun = chain.select(key, F.explode(F.aggregate("_chain", zero, advance)["starts"]).alias("b")) \
        .select(key, f"b.{SLICE}", "b.start")
    joined = cut.join(begun, [key, SLICE]).sortWithinPartitions(key, SLICE, *order)
    fields = [f for f in joined.schema.fields if f.name not in (SLICE, "start", OVERRIDE)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    replay = _replay(key, [f.name for f in fields])
    return joined.mapInPandas(replay, f"{schema}, from_state string, accepted boolean, state string")


class Codes:
    """States as numbers: 0 is none (or empty), then those of the matrix, then ``ELSE``, which stands for a start
    outside the matrix, then the names outside it as they come."""

    def __init__(self):
        self.names = [None, *STATES, OTHER]
        self.at = {n: i for i, n in enumerate(self.names)}
        free = [[not a or f"{a}>{b}" in set(ARROWS) for a in self.names] for b in self.names]
        self.free = np.array(free)  # whether a target may be reached from a state

    def of(self, values: pd.Series) -> np.ndarray:
        places, distinct = pd.factorize(values)
        for name in distinct:
            if name and name not in self.at:
                self.at[name] = len(self.names)
                self.names.append(name)
        return np.append([self.at[n] if n else 0 for n in distinct], 0).astype(np.int64)[places]

    def may(self, state: np.ndarray, target: np.ndarray, force: np.ndarray) -> np.ndarray:
        """Whether each change is taken; only a forced one leads to or from a state outside the matrix."""
        return force | self.free[np.minimum(target, ELSE), np.minimum(state, ELSE)]

    def maps(self, target: np.ndarray, force: np.ndarray) -> np.ndarray:
        """One row per change: the state it leads to from each start."""
        starts = np.arange(ELSE + 1)
        return np.where(self.may(starts[None], target[:, None], force[:, None]), target[:, None], starts)


ELSE = len(STATES) + 1


def follow(state: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Where maps (one row each) lead from states (the same rows, any columns)."""
    reached = np.take_along_axis(maps, np.minimum(state, ELSE), 1)
    return np.where((state > ELSE) & (reached == ELSE), state, reached)


def scan(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Composes maps along runs: row i becomes where all rows of its run up to i lead to from each start.

    Composition is associative, so runs are combined by doubling: a row that has met its 2 ** k predecessors
    takes over what the row before these has met, as long as both are in one run.
    """
    maps, run, step = maps.copy(), np.cumsum(first), 1
    while step < len(maps):
        same = np.flatnonzero(run[step:] == run[:-step]) + step
        if not len(same):
            break
        maps[same] = follow(maps[same - step], maps[same])
        step *= 2
    return maps


def _runs(pdf: pd.DataFrame, key: str) -> np.ndarray:
    """Whether a row begins another (key, slice) than the row before."""
    k, part = pd.factorize(pdf[key], use_na_sentinel=False)[0], pdf[SLICE].to_numpy()
    return np.append(True, (k[1:] != k[:-1]) | (part[1:] != part[:-1]))


def _name(pdf: pd.DataFrame, key: str, i: int) -> tuple:
    return (None if pd.isna(pdf[key].iloc[i]) else pdf[key].iloc[i], pdf[SLICE].iloc[i])


def _summarise(key: str):
    """Per (key, slice) the state reached from each possible start; batches of sorted rows stream through."""
    def run(batches):
        codes, current, reached = Codes(), None, None

        def rows(names, maps):
            return pd.DataFrame([(*n, [codes.names[c] for c in m]) for n, m in zip(names, maps.tolist())], columns=[key, SLICE, "_map"])
        for pdf in batches:
            if not len(pdf):
                continue
            first = _runs(pdf, key)
            done = scan(codes.maps(codes.of(pdf["to_state"]), pdf[OVERRIDE].to_numpy(bool)), first)
            ends = np.append(np.flatnonzero(first)[1:] - 1, len(pdf) - 1)
            if current is not None:
                if _name(pdf, key, 0) == current:
                    done[ends[0]] = follow(reached[None], done[ends[:1]])[0]
                else:
                    yield rows([current], reached[None])
            if len(ends) > 1:
                yield rows([_name(pdf, key, e) for e in ends[:-1]], done[ends[:-1]])
            current, reached = _name(pdf, key, -1), done[-1]
        if current is not None:
            yield rows([current], reached[None])
    return run


def _replay(key: str, columns: list[str]):
    """Adds from_state, accepted and state to batches of sorted rows, of which each knows its slice's start."""
    def run(batches):
        codes, current, last = Codes(), None, None
        for pdf in batches:
            if not len(pdf):
                continue
            first, start = _runs(pdf, key), codes.of(pdf["start"])
            if _name(pdf, key, 0) == current:
                begun = np.flatnonzero(np.append(first, True))
                start[:begun[1]] = last
            target, force = codes.of(pdf["to_state"]), pdf[OVERRIDE].to_numpy(bool)
            after = follow(start[:, None], scan(codes.maps(target, force), first))[:, 0]
            before = np.where(first, start, np.append(0, after[:-1]))
            names = np.array(codes.names, object)
            out = pdf[columns].copy()
            out["from_state"], out["accepted"], out["state"] = names[before], codes.may(before, target, force), names[after]
            current, last = _name(pdf, key, -1), after[-1]
            yield out
    return run


def history_entry(from_state: Column, to_state: Column, note: Column, force: Column, ui: Column) -> Column:
    """Note and flags of an accepted change; an override without note gets one."""
    override = force | ui
    text = F.concat(F.when(force, "Manual override: ").otherwise("UI state change: "),
                    F.coalesce(from_state, F.lit("none")), F.lit(" → "), to_state)
    given = F.nullif(F.trim(F.coalesce(note, F.lit(""))), F.lit(""))
    return F.struct(to_state.alias("state"), F.coalesce(given, F.when(override, text)).alias("note"),
                    F.when(override, True).alias("override"), F.when(ui, True).alias("ui_context"))


def last_changes(events: DataFrame, key: str, order: list[str], n: int = 3) -> DataFrame:
    """The constant bound is applied before the shuffle, so a hot posting stays small."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def undo(events: DataFrame, key: str, order: list[str], state: str = "to_state") -> DataFrame:
    """The state to go back to; postings with fewer than two changes are left out."""
    two = last_changes(events, key, order, 2)
    return two.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col(state))).alias("current_state"),
        F.max(F.when(F.col("rank") == 2, F.col(state))).alias("previous_state"),
        F.count("*").alias("_n")).where("_n = 2").drop("_n") \
        .withColumn("note", F.concat(F.lit("Rückgängig: "), "current_state", F.lit(" → "), "previous_state"))


def current_states(events: DataFrame, key: str, order: list[str], state: str = "to_state") -> DataFrame:
    """The last state per posting, as an aggregate."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"))


def auto_rejections(actions: DataFrame) -> DataFrame:
    """Created postings whose suitability is a rejection become a rejected event."""
    return actions.where((F.col("action") == "created") & F.col("reject_reason").isNotNull()).select(
        "project_id", F.lit("rejected").alias("to_state"),
        F.concat(F.lit("Eignungsbewertung: "), "reject_reason").alias("note"), F.lit(False).alias("force"))


def state_summary(postings: DataFrame) -> DataFrame:
    """A1: all eight states, unknown ones dropped."""
    domain = postings.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    counts = postings.groupBy("state").agg(F.count("*").alias("n"))
    return domain.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def state_report(postings: DataFrame) -> DataFrame:
    """A2: share of each non-empty state."""
    summary = state_summary(postings)
    total = F.sum("n").over(Window.partitionBy())  # eight rows
    return summary.withColumn("share", F.when(total > 0, F.col("n") * 100.0 / total)) \
        .where("n > 0")

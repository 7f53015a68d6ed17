"""State changes as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..operators.lifecycle import fold_states
from .deltas import DeltaLog


def state_log(path: str, events: DataFrame, key: str = "project_id") -> DeltaLog:
    """The current state per posting; ``events`` gives the type of the key."""
    return DeltaLog(path, (key,), StructType([events.schema[key]]).add("state", "string"))


def fold_writer(log: DeltaLog, out: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """The body of ``foreachBatch``: folds a batch from the carried states, as the batch fold does for a table.

    A posting's events are spread over slices, and only its last state is carried on, as one row of the log.
    A repeated batch rewrites its own result and changes nothing.
    """
    key = log.keys[0]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if log.complete(spark, batch_id):
            return
        path = f"{out}/batch={batch_id}"
        starts = log.read(spark, before=batch_id, only=batch.select(key))
        fold_states(batch, key, order, starts).write.mode("overwrite").parquet(path)
        # The log comes last: a batch whose states are known has been written whole.
        log.append(spark.read.parquet(path).groupBy(key).agg(F.max_by("state", F.struct(*order)).alias("state")), batch_id)
    return write


def fold_stream(events: DataFrame, log: DeltaLog, out: str, checkpoint: str, order: list[str] = ["ts", "event_id"]):
    """Each change with the state before it and whether it was taken, written to ``out`` by batch.

    ``events`` has the key, ``order``, to_state, force and perhaps ui_context.  Within a trigger changes are
    applied in ``order``.
    """
    return events.writeStream.foreachBatch(fold_writer(log, out, order)) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Events that arrive as a stream become history of the log, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.attributes import Registry
from ..sources.log import COLUMNS, STATE, FactLog, last_events, same_fact

#: Every so many micro-batches the state is written whole; between, only what they changed.
WHOLE = 16


def follow(events: DataFrame, registry: Registry, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream of events (as FactLog.resolved takes them, later than those before) to the history at path.

    Each micro-batch is written to a folder named by its number: a batch that is run again after a failure replaces
    itself, so that every event is in the history once. What held before a batch is read from tables beside the history, the last whole state
    and the changes of at most WHOLE batches since, never from the history.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = _before(spark, path, number)
        log = FactLog(spark.createDataFrame([], batch.schema), registry, current=state)
        log.resolved(batch).select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/batch={number}")
        changed = last_events(spark.read.parquet(f"{path}/batch={number}")).select(*same_fact(), "last.*")
        changed.write.mode("overwrite").parquet(f"{path}/_changed/{number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _before(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The state (e, a, values, tx) before a micro-batch; written whole before every WHOLE-th."""
    whole, start = (number - 1) // WHOLE * WHOLE, f"{path}/_state/"
    rows = spark.createDataFrame([], STATE) if whole <= 0 else spark.read.schema(STATE).parquet(f"{start}{whole}")
    if number:
        events = spark.read.parquet(*[f"{path}/_changed/{k}" for k in range(max(whole, 0), number)])
        both = rows.withColumns({"op": F.lit(-1).cast("bigint"), "added": F.lit(True)}).unionByName(events)
        rows = last_events(both).filter("last.added").select(*same_fact(), "last.tx")
    if number and number % WHOLE == 0:
        rows.write.mode("overwrite").parquet(f"{start}{number}")
        rows = spark.read.schema(STATE).parquet(f"{start}{number}")
    return rows

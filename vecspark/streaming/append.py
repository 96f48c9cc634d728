"""Continuous ingestion: a stream of rows appended to a database directory, one segment for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType

from ..operators.dml import ORDER, conform, last_of_each
from ..plans.schema import TableSpec
from ..plans.session import drop, fresh_path
from ..sources.storage import RETENTION, ConflictError, Store


def append_stream(rows: DataFrame, spec: TableSpec, path: str, checkpoint: str, compact_at: int = 32, retention: float = RETENTION, **trigger) -> StreamingQuery:
    """Upserts each micro-batch into the table in path: tombstones for its keys, then its rows. A micro-batch that is
    retried after a failure replaces itself, so that each row counts once; of equal keys in it the last read stays, as the
    batch was read once. Tables with compact_at segments are rewritten, and states older than retention deleted."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store, held = Store(spark, path), fresh_path(spark, "batch")
        conform(spec, batch).selectExpr("*", f"monotonically_increasing_id() AS {ORDER}").write.parquet(held)
        own = last_of_each(spark.read.schema(spec.schema().add(ORDER, LongType())).parquet(held), spec.key, ORDER).drop(ORDER)
        try:
            store.append(spec, own, own.select(spec.key))
        finally:
            drop(held)
        if store.crowded(spec.name, compact_at, float("inf")):
            try:
                store.compact(spec)
            except ConflictError:
                return  # the next batch tries again
            store.vacuum(retention)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()

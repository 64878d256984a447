"""Running streams: bronze ingestion, continuous upsert, metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from smeltry.functions.ladders import MONITOR_DELAY
from smeltry.operators import rows as R
from smeltry.sources import sinks
from smeltry.sources.envelope import parse_marketplace_sales, parse_user_events
from smeltry.streaming import events as E

PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "user_activity_events": parse_user_events,
    "marketplace_sales": parse_marketplace_sales,
}
# How often each topic is written, and the event time that gives its partition day.
TRIGGERS = {"user_activity_events": "30 seconds", "marketplace_sales": "60 seconds"}
EVENT_TIMES = {"user_activity_events": "event_time", "marketplace_sales": "transaction_time"}


def bronze_rows(envelope: DataFrame, topic: str) -> DataFrame:
    """Parsed rows of a topic with their partition day."""
    return PARSERS[topic](envelope).withColumn("event_day", F.to_date(EVENT_TIMES[topic]))


def bronze_stream(
    envelope: DataFrame, topic: str, path: str, checkpoint: str, every: str | None = "default",
) -> StreamingQuery:
    """Parse a topic's envelope stream and append it to day-partitioned files.

    ``every`` is a trigger interval; None drains the source once.
    """
    interval = TRIGGERS[topic] if every == "default" else every
    return sinks.stream_append(
        bronze_rows(envelope, topic), path, checkpoint, interval, ["event_day"]
    )


def stream_upsert(
    stream: DataFrame, table: str, keys: Sequence[str], partition_by: str, checkpoint: str,
    order: Sequence[Column] | None = None, every: str | None = None,
) -> StreamingQuery:
    """Upsert each micro-batch into a partitioned table.

    Replaying a batch after a failure gives the same table, since an upsert of
    the same rows changes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        # The batch is read for its days, its keys and its rows.
        batch.persist()
        try:
            sinks.upsert_table(batch, table, keys, partition_by, order)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def _report_state(by: str, order: Sequence[tuple[str, str]], last: int):
    """(reduce, merge) of a delay report's state: counts by label, and the ``last`` newest rows, as Arrow streams.

    Plain nested functions, so that Python workers need nothing but Arrow.
    """
    names = ["counts", "newest"]

    def packed(t: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        return sink.getvalue().to_pybytes()

    def unpacked(parts) -> pa.Table:
        return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in parts])

    def summed(t: pa.Table) -> pa.Table:
        out = t.group_by([by, "delay_category"]).aggregate([("messages", "sum")])
        return out.select([by, "delay_category", "messages_sum"]).rename_columns(t.column_names)

    def top(t: pa.Table) -> pa.Table:
        # one stable sort a column, least first, as nulls stand first or last with the direction
        for name, way in reversed(order):
            at = pc.sort_indices(t.select([name]), sort_keys=[(name, way)], null_placement="at_end" if way == "descending" else "at_start")
            t = t.take(at)
        return t.slice(0, last).combine_chunks()

    def reduce(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            ones = t.select([by, "delay_category"]).append_column("messages", pa.array(np.ones(len(t), np.int64)))
            row = [pa.array([packed(x)], pa.binary()) for x in (summed(ones), top(t))]
            yield pa.RecordBatch.from_arrays(row, names)

    def merge(key, frames, state):
        held = [state.get] if state.exists else []
        parts = [*held, *(r for f in frames for r in f[names].itertuples(index=False, name=None))]
        counts, newest = (list(c) for c in zip(*parts, strict=True))
        now = packed(summed(unpacked(counts))), packed(top(unpacked(newest)))
        state.update(now)
        yield pd.DataFrame([now], columns=names)

    return reduce, merge


def delay_report_stream(
    stream: DataFrame, report: Callable[[DataFrame, DataFrame, int], None], checkpoint: str,
    event_ts: str, ingest_ts: str, order: Sequence[str], by: str = "topic",
    threshold_hours: float = E.SALES_ALERT_HOURS, last: int = 50, show: int = 5, every: str | None = None,
) -> StreamingQuery:
    """After each micro-batch with rows: percentages per ``by`` and label so far, and the newest high delays.

    ``report(totals, recent, batch_id)`` gets the frames of ``E.delay_totals`` and
    ``E.recent_high_delays`` over all rows read yet. ``order`` names columns, a leading
    ``-`` for descending order; they should make a total order. What is carried from
    batch to batch lies in the state store and is bounded: counts per label, and the
    ``last`` newest rows. Each Arrow batch is reduced to that much before the shuffle, so
    the one task that merges gets ``last`` rows for every batch of thousands. A
    replayed batch starts from the state of the batch before.
    """
    spark = stream.sparkSession
    delayed = R.with_delay(stream, event_ts, ingest_ts, MONITOR_DELAY)
    ways = [(c[1:], "descending") if c.startswith("-") else (c, "ascending") for c in order]
    newest_first = [F.col(c).desc() if way == "descending" else F.col(c).asc() for c, way in ways]
    counted = delayed.select(by, "delay_category", F.lit(0).cast("bigint").alias("messages")).schema
    held = "counts binary, newest binary"
    reduce, merge = _report_state(by, ways, last)
    merged = (
        delayed.mapInArrow(reduce, held).withColumn("all", F.lit(0)).groupBy("all")
        .applyInPandasWithState(merge, held, held, "update", "NoTimeout")
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        for counts, newest in batch.collect():  # one row of bounded size
            frame = lambda data, schema: spark.createDataFrame(pa.ipc.open_stream(data).read_all(), schema)
            recent = E.recent_high_delays(frame(newest, delayed.schema), newest_first, threshold_hours, last, show)
            report(E.delay_totals(frame(counts, counted), by), recent, batch_id)

    writer = merged.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def observed(df: DataFrame, name: str, *extra: Column) -> tuple[DataFrame, Observation]:
    """The frame with a row counter that fills in as it is consumed, and its handle."""
    handle = Observation(name)
    return df.observe(handle, F.count(F.lit(1)).alias("records_processed"), *extra), handle


def processing_metrics(records: int, seconds: float) -> dict[str, float]:
    return {
        "records_processed": records,
        "duration_seconds": seconds,
        "records_per_second": records / seconds if seconds > 0 else 0.0,
    }


class ProgressListener(StreamingQueryListener):
    """Keeps the last ``keep`` micro-batch metrics of each query."""

    def __init__(self, keep: int = 100):
        self.keep = keep
        self.batches: dict[str, list[dict]] = {}

    def onQueryStarted(self, event) -> None:
        self.batches.setdefault(str(event.id), [])

    def onQueryProgress(self, event) -> None:
        p = event.progress
        entry = processing_metrics(p.numInputRows, p.batchDuration / 1000.0) | {"batch_id": p.batchId}
        mine = self.batches.setdefault(str(p.id), [])
        mine.append(entry)
        del mine[: -self.keep]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

"""Export-triggered ledger sync.

The original service syncs when an HTTP call asks for it. Here the trigger is
a line in an inbox folder that names a complete export (``announce_export``).
A Structured Streaming text source reads the inbox one announcement file at a
time; ``foreachBatch`` reads that export by its header's names, whole, and runs
the same clean → dedupe → merge → publish as the batch sync. So an export of
many part files is one sync, all or nothing, with repeats resolved by ``_pos``.
The checkpoint lives under the shared ``spark.checkpoint.dir``: a restarted
query resumes after the last export it synced. A refused export fails its
micro-batch and nothing is published for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..plans.sync import publish_batches, utc_now
from ..session import shared_path
from ..sources.raw import read_raw_ledger
from ..sources.snapshot import SnapshotStore


def announce_export(spark: SparkSession, inbox: str, path: str) -> None:
    """Tell the stream that the export at ``path`` is complete."""
    spark.createDataFrame([(path,)], "value string").coalesce(1).write.mode("append").text(inbox)


def start_sync_stream(spark: SparkSession, ledger: str, inbox: str, store: SnapshotStore,
                      checkpoint: str | None = None, available_now: bool = False, fmt: str = "csv",
                      recurring: tuple[str, ...] = S.RECURRING_CATEGORIES) -> StreamingQuery:
    """Start syncing the exports announced in ``inbox`` into ``store``."""
    src = spark.readStream.option("maxFilesPerTrigger", 1).text(inbox)

    def each(batch: DataFrame, epoch: int) -> None:
        # One announcement file a trigger: its lines name exports, not rows of them.
        for line in batch.collect():
            now = utc_now()
            raw = read_raw_ledger(batch.sparkSession, line["value"], fmt, ledger)
            publish_batches(store, {ledger: raw}, now.isoformat(sep=" ", timespec="seconds"), now.date().isoformat(),
                            recurring)

    writer = (src.writeStream.foreachBatch(each)
              .option("checkpointLocation", checkpoint or shared_path(spark, "tally-streams", ledger)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()

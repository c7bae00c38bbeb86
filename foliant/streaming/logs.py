"""The buffered log sink: micro-batches of log rows, cut, grouped into flushes and written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from foliant.functions.text import cut
from foliant.runtime import checkpointed

TRIGGER = "5 seconds"
#: A task's rows go out as soon as there are so many; of more than MOST waiting ones, tasks give up all but their last KEPT.
FLUSH, MOST, KEPT = 50, 1000, 10


def log_rows(df: DataFrame) -> DataFrame:
    """Messages up to 500 and details up to 1,000 characters; the level defaults to info."""
    return df.withColumns({"message": cut(F.col("message"), 500), "detail": cut(F.col("detail"), 1000), "level": F.coalesce("level", F.lit("info"))})


def flushes(rows: DataFrame, task: str = "task_id", order: tuple[str, ...] = ("created_at", "id"), flush: int = FLUSH, most: int = MOST, kept: int = KEPT) -> DataFrame:
    """What a tick writes of the rows (task, order...) that came since the last one, with `flush` numbering each task's
    flushes from 0.

    Every full `flush` rows of a task went out at once; the rest waited for the tick. If more than `most` waited, tasks in
    the order of their first waiting row give up all but their last `kept`, until no more than `most` are left.
    """
    rows = checkpointed(rows.withColumn("_nth", F.row_number().over(Window.partitionBy(task).orderBy(*order)) - 1))
    sizes = rows.groupBy(task).agg(F.count(F.lit(1)).alias("_n")).withColumn("_full", F.col("_n") - F.col("_n") % flush)
    held = rows.join(sizes, task)
    waiting = held.where("_nth >= _full").groupBy(task).agg(F.count(F.lit(1)).alias("_w"), F.min(F.struct(*order, task)).alias("_first"))
    waiting = waiting.withColumn("_spare", F.greatest(F.col("_w") - kept, F.lit(0)))
    over = waiting.agg(F.sum("_w")).first()[0] or 0
    gone = waiting.select(task).limit(0).withColumn("_gone", F.lit(0))
    if over > most:  # so many rows wait that some tasks' are cut; a row per task is ordered
        running = F.coalesce(F.sum("_spare").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        gone = waiting.where("_spare > 0").withColumn("_before", running).where(F.lit(over) - F.col("_before") > most).select(task, F.col("_spare").alias("_gone"))
    out = held.join(gone, task, "left").where((F.col("_nth") < F.col("_full")) | (F.col("_nth") >= F.col("_full") + F.coalesce("_gone", F.lit(0))))
    return out.withColumn("flush", F.floor(F.col("_nth") / flush)).drop("_nth", "_n", "_full", "_gone")


def start_log_sink(stream: DataFrame, folder: str, checkpoint: str, once: bool = False, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Write what a tick flushes to folder/batch=N, every five seconds, or over what is there. A batch that is run again
    after a failure, with the same number and rows, replaces its own folder, so each row is there once. Rows without task_id,
    created_at and id are written as they come. `after` is called with N once a batch is written."""

    def write(batch: DataFrame, n: int) -> None:
        rows = log_rows(batch)
        rows = flushes(rows) if {"task_id", "created_at", "id"} <= set(rows.columns) else rows
        rows.write.mode("overwrite").parquet(f"{folder}/batch={n}")
        if after:
            after(n)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()

"""The crawl queue as table functions: rows (id, task_id, url, status, retries, max_retries, created_at, updated_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATES = ("pending", "in_progress", "completed", "failed")


def first_seen(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a given order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def enqueue(queue: DataFrame, items: DataFrame, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(queue with the new items, ids of all asked). An address waits once per task; failed ones may come again."""
    keys = ["task_id", "url"]
    held = queue.where(F.col("status") != "failed").groupBy(*keys).agg(F.min("id").alias("_held"))
    asked = first_seen(items, keys, *order).join(held, keys, "left")
    new = asked.where("_held IS NULL").drop("_held")
    ids = asked.select(*keys, F.coalesce("_held", "id").alias("id"), F.col("_held").isNull().alias("added"))
    return queue.unionByName(new.select(queue.columns)), ids


def take_batch(queue: DataFrame, now: Column, task: str | None = None, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(queue, taken): the oldest waiting rows, marked as in progress. One driver takes at a time: Spark has no row locks."""
    waiting = queue.where((F.col("status") == "pending") & (F.lit(True) if task is None else F.col("task_id") == F.lit(task)))
    taken = waiting.orderBy("created_at", "id").limit(size)
    marked = queue.join(F.broadcast(taken.select("id", F.lit(True).alias("_taken"))), "id", "left")  # at most `size` rows
    fresh = {"status": F.when(F.col("_taken"), "in_progress").otherwise(F.col("status")), "updated_at": F.when(F.col("_taken"), now).otherwise(F.col("updated_at"))}
    return marked.select([fresh[c].alias(c) if c in fresh else F.col(c) for c in queue.columns]), taken


def settle(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """After outcomes (id, ok): done, waiting again while tries are left, or failed."""
    joined = queue.join(outcomes.select("id", "ok"), "id", "left")
    again = ~F.col("ok") & (F.col("retries") < F.col("max_retries"))
    fresh = {
        "status": F.when(F.col("ok"), "completed").when(again, "pending").when(~F.col("ok"), "failed").otherwise(F.col("status")),
        "retries": F.when(again, F.col("retries") + 1).otherwise(F.col("retries")),
        "updated_at": F.when(F.col("ok").isNotNull(), now).otherwise(F.col("updated_at")),
    }
    return joined.select([fresh[c].alias(c) if c in fresh else F.col(c) for c in queue.columns])


def requeue_failed(queue: DataFrame, now: Column, task: str | None = None) -> DataFrame:
    hit = (F.col("status") == "failed") & (F.lit(True) if task is None else F.col("task_id") == F.lit(task))
    fresh = {"status": F.when(hit, "pending").otherwise(F.col("status")), "retries": F.when(hit, 0).otherwise(F.col("retries")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return queue.select([fresh[c].alias(c) if c in fresh else F.col(c) for c in queue.columns])


def clean_up(queue: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Without the settled rows older than some hours."""
    return queue.where(~(F.col("status").isin("completed", "failed") & (F.col("updated_at") < now - F.expr(f"INTERVAL {hours} HOURS"))))


def clear_task(queue: DataFrame, task: str) -> DataFrame:
    return queue.where(F.col("task_id") != F.lit(task))


def processed(queue: DataFrame, urls: DataFrame) -> DataFrame:
    """Addresses (task_id, url) that are done or under way."""
    return urls.join(queue.where(F.col("status").isin("completed", "in_progress")).select("task_id", "url"), ["task_id", "url"], "left_semi")

"""Changes as pure functions: base table and patch in, new table out. The caller writes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed table: the states a task may move to.
TRANSITIONS = (
    ("pending", "running"), ("pending", "cancelled"), ("pending", "failed"),
    ("running", "completed"), ("running", "failed"), ("running", "cancelled"),
    ("failed", "pending"), ("failed", "running"),
)
TERMINAL = ("completed", "failed", "cancelled")


def insert(base: DataFrame, new: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """base with new rows; columns that they lack get the default, or null."""
    for name, value in (defaults or {}).items():
        new = new.withColumn(name, F.coalesce(F.col(name), value) if name in new.columns else value)
    return base.unionByName(new.select([c for c in base.columns if c in new.columns]), allowMissingColumns=True)


def merge_update(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """A partial update. The patch has (key, <column>, has_<column>): a field changes where its flag is set, also to null."""
    fields = [c for c in patch.columns if c != key and not c.startswith("has_")]
    renamed = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields], *[F.col(f"has_{c}").alias(f"_has_{c}") for c in fields])
    joined = base.join(renamed, key, "left")
    return joined.select([F.when(F.coalesce(F.col(f"_has_{c}"), F.lit(False)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that `new` names are replaced by it."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").select(children.columns).unionByName(new)


def reorder(children: DataFrame, orders: DataFrame, key: str, parent: str, order: str) -> DataFrame:
    """New orders (key, parent, order) from 0 to 100,000 for rows that do belong to the parent named."""
    valid = orders.where(F.col(order).between(0, 100_000)).select(key, parent, F.col(order).alias("_order"))
    moved = children.join(valid, [key, parent], "left")
    return moved.withColumn(order, F.coalesce("_order", order)).select(children.columns)


def renumber(rows: DataFrame, parent: str, *by: Column, name: str = "position") -> DataFrame:
    """Rows numbered 1..n within their parent."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(*by)))


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, fk: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents named in gone."""
    ids = gone.select(key).distinct()
    return parents.join(ids, key, "left_anti"), children.join(ids.withColumnRenamed(key, fk), fk, "left_anti")


def delete_set_null(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, fk: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the ones named; their children stay, without the reference."""
    ids = gone.select(key).distinct()
    marked = children.join(ids.select(F.col(key).alias(fk), F.lit(True).alias("_gone")), fk, "left")
    kept = [F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == fk else F.col(c) for c in children.columns]
    return parents.join(ids, key, "left_anti"), marked.select(kept)


def deletable(parents: DataFrame, children: DataFrame, key: str, fk: str, blocking: Column | None = None) -> DataFrame:
    """Parents without (blocking) children."""
    held = children if blocking is None else children.where(blocking)
    return parents.join(held.select(F.col(fk).alias(key)), key, "left_anti")


def allowed(old: Column, new: Column) -> Column:
    """Whether a task may move from one state to another."""
    table = F.create_map(*[F.lit(x) for a, b in TRANSITIONS for x in (f"{a}>{b}", True)])
    return F.coalesce(table[F.concat(old, F.lit(">"), new)], F.lit(False))


def move_state(tasks: DataFrame, moves: DataFrame, key: str, now: Column) -> DataFrame:
    """Tasks (key, status, started_at, completed_at) after moves (key, new_status); moves that aren't allowed do nothing."""
    joined = tasks.join(moves.select(key, "new_status"), key, "left")
    goes = F.coalesce(allowed(F.col("status"), F.col("new_status")), F.lit(False))
    changed = {
        "started_at": F.when(goes & (F.col("new_status") == "running"), F.coalesce("started_at", now)).otherwise(F.col("started_at")),
        "completed_at": F.when(goes & F.col("new_status").isin(*TERMINAL), now).otherwise(F.col("completed_at")),
        "status": F.when(goes, F.col("new_status")).otherwise(F.col("status")),
    }
    return joined.select([changed[c].alias(c) if c in changed else F.col(c) for c in tasks.columns])


def stale(tasks: DataFrame, started: str, status: str, now: Column, hours: int = 2) -> DataFrame:
    return tasks.where((F.col(status) == "running") & (F.col(started) < now - F.expr(f"INTERVAL {hours} HOURS")))


def rollup(children: DataFrame, parent: str, text: str) -> DataFrame:
    """(parent, word_count, n_children): what counters kept by increments must equal."""
    return children.groupBy(parent).agg(F.sum(F.length(F.coalesce(text, F.lit("")))).alias("word_count"), F.count(F.lit(1)).alias("n_children"))


def conflicts(new: DataFrame, base: DataFrame, *unique: str) -> DataFrame:
    """New rows that an existing one's unique columns forbid."""
    return new.join(base.select(*unique), list(unique), "left_semi")


def missing(keys: DataFrame, base: DataFrame, key: str) -> DataFrame:
    return keys.join(base.select(key), key, "left_anti")

"""Queries over parents, ordered children, tags and dimensions. Every operator takes DataFrames and column names."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def find_one(df: DataFrame, **key) -> DataFrame:
    """The row of a unique key; the filter reaches the scan."""
    return df.where(reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in key.items()])).limit(1)


def find_one_or_raise(df: DataFrame, **key) -> DataFrame:
    """The same, failing when the query runs without a row for the key."""
    one = find_one(df, **key).agg(F.first(F.struct(*df.columns)).alias("row"))
    return one.select(F.when(F.col("row").isNull(), F.raise_error(F.lit(f"no row with {key}"))).otherwise(F.col("row")).alias("row")).select("row.*")


def where_equal(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; None and the empty string ask for nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in wanted.items() if v not in (None, "")), df)


def contains_any(search: str | None, *columns: str) -> Column:
    """Whether some column contains the search text (cut to 200); an empty search takes all."""
    if not search:
        return F.lit(True)
    return reduce(Column.__or__, [F.coalesce(F.contains(F.col(c), F.lit(search[:200])), F.lit(False)) for c in columns])


@dataclass(frozen=True)
class Page:
    """Clamped paging parameters."""

    number: int
    size: int

    @classmethod
    def of(cls, number: int | str | None = None, size: int | str | None = None, default: int = 20, most: int = 100) -> Page:
        def read(x, fallback: int, low: int, high: int) -> int:
            try:
                n = int(x or 0) or fallback
            except ValueError:
                n = fallback
            return max(low, min(n, high))

        return cls(read(number, 1, 1, 10_000), read(size, default, 1, most))

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.size


def page_of(df: DataFrame, page: Page, *order: Column) -> DataFrame:
    """One page in a total order, a bounded top-k with an offset."""
    return df.orderBy(*order).offset(page.offset).limit(page.size)


def page_after(df: DataFrame, size: int, order: str, key: str, last: tuple | None = None) -> DataFrame:
    """The rows after a known one in descending order: a page without the cost of its offset."""
    if last is not None:
        df = df.where((F.col(order) < F.lit(last[0])) | ((F.col(order) == F.lit(last[0])) & (F.col(key) > F.lit(last[1]))))
    return df.orderBy(F.desc(order), key).limit(size)


def page_totals(df: DataFrame, page: Page) -> DataFrame:
    """(total, total_pages) of a filtered table."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.ceil(n / page.size).cast("long").alias("total_pages"))


def with_parent(df: DataFrame, dim: DataFrame, on: str, key: str, how: str = "left", **names: str) -> DataFrame:
    """An n:1 relation; `names` gives new columns by the dimension's columns."""
    right = dim.select(F.col(key).alias(on), *[F.col(c).alias(new) for new, c in names.items()])
    return df.join(right, on, how)


def with_child_count(parents: DataFrame, children: DataFrame, key: str, fk: str, name: str = "n_children") -> DataFrame:
    """Parents with the number of their children, 0 if none; children are counted before the join."""
    counts = children.groupBy(F.col(fk).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def with_tags(parents: DataFrame, bridge: DataFrame, tags: DataFrame, key: str, fk: str, tag_fk: str, tag_key: str, tag_name: str) -> DataFrame:
    """Parents with the sorted array of their tags (empty, never null)."""
    named = bridge.select(F.col(fk).alias(key), F.col(tag_fk).alias("_t")).distinct().join(tags.select(F.col(tag_key).alias("_t"), tag_name), "_t")
    grouped = named.groupBy(key).agg(F.array_sort(F.collect_list(tag_name)).alias("tags"))
    return parents.join(grouped, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def having(parents: DataFrame, bridge: DataFrame, key: str, fk: str) -> DataFrame:
    """Parents with a row in the bridge (already filtered)."""
    return parents.join(bridge.select(F.col(fk).alias(key)), key, "left_semi")


def violations(children: DataFrame, parents: DataFrame, fk: str, key: str) -> DataFrame:
    """Rows whose reference names no parent."""
    return children.where(F.col(fk).isNotNull()).join(parents.select(F.col(key).alias(fk)), fk, "left_anti")


def all_known(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(ok): whether every id of a list names a row; an id given twice fails, as it is counted once."""
    asked = ids.agg(F.count(F.lit(1)).alias("asked"))
    found = table.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi").agg(F.count(F.lit(1)).alias("found"))
    return asked.join(F.broadcast(found), how="cross").select((F.col("asked") == F.col("found")).alias("ok"))  # one row each


def newest_per_parent(rows: DataFrame, parent: str, order: str, key: str, k: int = 50) -> DataFrame:
    """The k newest rows of each parent; Spark limits each partition's groups before the shuffle."""
    newest = Window.partitionBy(parent).orderBy(F.desc(order), F.desc(key))
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k)


def ordered_children(rows: DataFrame, parent: str, order: list[str], *columns: str) -> DataFrame:
    """(parent, children): each parent's children as an array of structs in order."""
    return rows.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias("children"))


def counts_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def state_counts(df: DataFrame, status: str, states: tuple[str, ...]) -> DataFrame:
    """One row: the total and a count per state, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in states])


def next_order(children: DataFrame, parents: DataFrame, key: str, fk: str, order: str) -> DataFrame:
    """The sort order that an appended child gets: the largest plus one, 1 for a parent without children."""
    top = children.groupBy(F.col(fk).alias(key)).agg(F.max(order).alias("_top"))
    return parents.select(key).join(top, key, "left").select(key, (F.coalesce("_top", F.lit(0)) + 1).alias("next_order"))


def append_children(new: DataFrame, existing: DataFrame, parent: str, order: str, batch_order: str) -> DataFrame:
    """New rows numbered after each parent's last one, in the order of the batch."""
    top = existing.groupBy(parent).agg(F.max(order).alias("_top"))
    at = F.row_number().over(Window.partitionBy(parent).orderBy(batch_order))
    return new.join(top, parent, "left").withColumn(order, F.coalesce("_top", F.lit(0)) + at).drop("_top")


def coverage(rows: DataFrame, parent: str, filled: Column) -> DataFrame:
    """Percent of each parent's children that are filled, rounded half up."""
    return rows.groupBy(parent).agg(F.floor(100 * F.count_if(filled) / F.count(F.lit(1)) + 0.5).cast("long").alias("pct"))


def all_of(df: DataFrame, condition: Column) -> DataFrame:
    """(every, some): quantifiers over a table; an empty one has neither."""
    return df.agg(F.coalesce(F.bool_and(condition), F.lit(False)).alias("every"), F.coalesce(F.bool_or(condition), F.lit(False)).alias("some"))


def page_strip(page: int, last: int) -> list[int | None]:
    """Page numbers to show, None for an ellipsis."""
    if last <= 7:
        return list(range(1, last + 1))
    shown = sorted({1, last, *(p for p in (page - 1, page, page + 1) if 1 <= p <= last)})
    return [x for a, b in zip(shown, [*shown[1:], None], strict=True) for x in ([a] if b is None or b == a + 1 else [a, None])]


def limited(df: DataFrame, limit: str | int | None, *order: Column, default: int = 20, most: int = 100) -> DataFrame:
    """The first rows by a limit that a user gave: a whole number from 1 to `most`, else the default."""
    try:
        n = int(limit)
    except (TypeError, ValueError):
        n = default
    return df.orderBy(*order).limit(min(max(n or default, 1), most))


def filled(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in every column."""
    return df.dropna(subset=list(columns))


def seeded(spark, seeds: list[dict], schema: str, stored: DataFrame, key: str) -> DataFrame:
    """The rows of a fixed seed list that a table lacks by key."""
    return spark.createDataFrame([tuple(s.get(f.split()[0]) for f in schema.split(", ")) for s in seeds], schema).join(stored.select(key), key, "left_anti")

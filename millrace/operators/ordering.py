"""Places in a total order, pages, natural order and truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lineage import cut


def places(df: DataFrame, order: list[Column], out: str = "place", runs: int | None = None) -> DataFrame:
    """Numbers rows from 1 in a total order without bringing them into one task.

    Rows are range-partitioned by the order into `runs` (the session's shuffle partitions, if not given) and sorted
    there, which gives each its place in its run; the counts of the runs before (a row for each) shift it. One shuffle,
    whose result is kept in the checkpoint folder: range borders are drawn from a sample, so they must not be drawn twice.
    """
    runs = runs or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(runs, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1) + 1)
    before = dealt.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn(out, F.col("_i") + F.col("_before")).drop("_m", "_p", "_i", "_before")


def class_places(df: DataFrame, kind: str, order: list[Column], out: str = "place", count: str = "of_class") -> DataFrame:
    """Places from 1 within each class, and the class's size; a class may hold any share of the rows, as places() splits it."""
    sizes = df.groupBy(F.col(kind).alias("_kind")).agg(F.count("*").alias(count))  # a row for each class
    sizes = sizes.withColumn("_before", F.coalesce(F.sum(count).over(Window.orderBy("_kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = places(df, [F.col(kind), *order], out)
    return placed.join(sizes, F.col(kind).eqNullSafe(F.col("_kind"))).withColumn(out, F.col(out) - F.col("_before")).drop("_kind", "_before")


def first_at_once(df: DataFrame, keys: list[str], order: list[str], first: int = 9) -> DataFrame:
    """Adds `later`: false for the first few rows of each key, which are written at once, true for those put in after."""
    return df.withColumn("later", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > first)


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page with the total, whether more follow, and the next offset (null at the end)."""
    total = df.agg(F.count("*").alias("total"))  # one row
    rows = df.orderBy(*order).offset(offset).limit(limit)
    size = rows.agg(F.count("*").alias("_size"))
    out = rows.join(F.broadcast(total)).join(F.broadcast(size))
    more = F.col("total") > F.lit(offset) + F.col("_size")
    return out.withColumn("has_more", more).withColumn("next_offset", F.when(more, (F.lit(offset) + F.col("_size")).cast("int"))).drop("_size")


def natural_place(df: DataFrame, name: str, out: str = "place") -> DataFrame:
    """`index` first, `overview` second, then by leading numbers of dash-separated parts, then by name."""
    rank = F.when(F.col(name) == "index", 0).when(F.col(name) == "overview", 1).otherwise(2)
    number = F.expr(f"try_cast(nullif(regexp_extract({name}, '^[0-9]+', 0), '') as bigint)")
    return places(df, [rank, number.asc_nulls_last(), F.col(name)], out)


def prefix_key(prefix: Column) -> Column:
    """Dash-separated numbers as an array that sorts by number: 2, 2-1, 10."""
    return F.transform(F.split(prefix, "-"), lambda x: F.try_to_number(x, F.lit("999999999")).cast("long"))


def half(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """All rows if they are at most `most`; else the first half (one row at least) and truncated = true."""
    n = df.count()
    keep = n if n <= most else max(1, n // 2)
    return df.orderBy(*order).limit(keep).withColumn("truncated", F.lit(keep < n))

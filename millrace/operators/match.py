"""Joins: sidecars, snapshots, numbering gaps, containment, as-of, overlap, lookups, pairing."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, compare: str) -> DataFrame:
    """Full outer join of two snapshots: each key once, NEW, DELETED, MODIFIED or UNCHANGED."""
    both = old.select(key, F.col(compare).alias("_old"), F.lit(1).alias("_o")).join(new.select(key, F.col(compare).alias("_new"), F.lit(1).alias("_n")), key, "full")
    kind = F.when(F.col("_o").isNull(), "NEW").when(F.col("_n").isNull(), "DELETED").when(F.col("_old").eqNullSafe(F.col("_new")), "UNCHANGED").otherwise("MODIFIED")
    return both.select(key, kind.alias("change"))


def relative_change(a: Column, b: Column) -> Column:
    """|b - a| / a; 0 if both are 0, 1 if only a is."""
    return F.when((a == 0) & (b == 0), 0.0).when(a == 0, 1.0).otherwise(F.abs(b - a) / F.abs(a))


def regressions(old: DataFrame, new: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """MISSING, NEW or CHANGE (beyond the tolerance) of a baseline's keys."""
    both = old.select(*key, F.col(value).alias("_a"), F.lit(1).alias("_o")).join(new.select(*key, F.col(value).alias("_b"), F.lit(1).alias("_n")), key, "full")
    moved = relative_change(F.col("_a"), F.col("_b"))
    kind = F.when(F.col("_n").isNull(), "MISSING").when(F.col("_o").isNull(), "NEW").when(moved > tolerance, "CHANGE")
    return both.select(*key, kind.alias("issue"), F.round(moved, 6).alias("moved")).where("issue is not null")


def numbering_gaps(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Numbers that are missing between the first and the last of each key."""
    ends = df.groupBy(*keys).agg(F.min(number).alias("_a"), F.max(number).alias("_b"))
    every = ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias(number))
    return every.join(df.select(*keys, number), [*keys, number], "left_anti")


def as_of(events: DataFrame, marks: DataFrame, keys: list[str], time: str, ties: list[str], value: str, default=None) -> DataFrame:
    """Each event with the value of the last mark strictly before it in its key: one union and one window, no range join.

    Events and marks share a key's partition, so a key is sorted once; of marks at the same time the last by `ties` counts.
    """
    left = events.withColumn("_mark", F.lit(0)).withColumn("_value", F.lit(None).cast(dict(marks.dtypes)[value]))
    right = marks.select(*keys, time, *ties, F.lit(1).alias("_mark"), F.col(value).alias("_value"))
    along = Window.partitionBy(*keys).orderBy(F.col(time), F.col("_mark"), *ties).rowsBetween(Window.unboundedPreceding, -1)
    found = left.unionByName(right, allowMissingColumns=True).withColumn("as_of", F.last("_value", ignorenulls=True).over(along)).where("_mark = 0").drop("_mark", "_value")
    return found if default is None else found.withColumn("as_of", F.coalesce("as_of", F.lit(default)))


def overlaps(a: DataFrame, b: DataFrame, key: str, wide: float) -> DataFrame:
    """Pairs of intervals (id, low, high) of a key that overlap (touching ends do not), by an equi-join on buckets.

    A pair is reported in the first bucket that both reach, so no distinct is needed.
    """
    cells = lambda df, x: df.select(F.col(key), F.col("id").alias(f"{x}_id"), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high")).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(f"{x}_low") / wide), F.floor(F.col(f"{x}_high") / wide))))
    first = F.greatest(F.floor(F.col("a_low") / wide), F.floor(F.col("b_low") / wide))
    return cells(a, "a").join(cells(b, "b"), [key, "_cell"]).where((F.col("a_low") < F.col("b_high")) & (F.col("b_low") < F.col("a_high")) & (F.col("_cell") == first)).drop("_cell")


def contained(texts: DataFrame, items: DataFrame, text_id: str, item_id: str, words: int = 8) -> DataFrame:
    """(text_id, item_id) where the text contains the whole item.

    An item's first `words` blank-separated words (fewer if it is shorter) are hashed, and texts are posted under the
    runs of as many words, so the pairs to test come from an equi-join; the test itself is exact. The item may start
    and end within a word of the text, so the run is taken from the item's inner words.
    """
    split = lambda c: F.split(c, " ")
    inner = items.withColumn("_w", split(F.col("text"))).withColumn("_n", F.least(F.lit(words), F.size("_w") - 2))
    short = inner.where("_n < 1").select(F.col(item_id), F.col("text").alias("_item"))
    long = inner.where("_n >= 1").select(F.col(item_id), F.col("text").alias("_item"), "_n", F.xxhash64(F.array_join(F.slice("_w", F.lit(2), F.col("_n")), " ")).alias("_key"))
    widths = [r["_n"] for r in long.select("_n").distinct().collect()]  # at most `words` values
    body = texts.select(text_id, F.col("text").alias("_text"))
    keys = F.array_distinct(F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.size("_s") - n + 1, F.lit(1))), _run(n)) for n in widths]))) if widths else F.array().cast("array<bigint>")
    posted = body.select(text_id, split(F.col("_text")).alias("_s")).select(text_id, F.explode(keys).alias("_key"))  # ids and hashes only
    few = long.count() <= 50_000
    wanted = long.select("_key", item_id)
    met = posted.join(F.broadcast(wanted) if few else wanted, "_key").select(text_id, item_id).distinct()
    out = met.join(F.broadcast(long.select(item_id, "_item")) if few else long.select(item_id, "_item"), item_id).join(body, text_id).where(F.contains("_text", "_item")).select(text_id, item_id)
    rows = short.toLocalIterator()  # items without inner words can start anywhere: the texts are read once for each block of them
    while block := [F.struct(F.lit(r[item_id]).alias("id"), F.lit(r["_item"]).alias("item")) for r in islice(rows, SHORT_ITEMS)]:
        kind = dict(items.dtypes)[item_id]
        held = body.select(text_id, F.explode(F.filter(F.array(*block), lambda x: F.contains("_text", x["item"]))).alias("x"))
        out = out.unionByName(held.select(text_id, F.col("x.id").cast(kind).alias(item_id)))
    return out.distinct()


#: Items that one pass over the texts tests one by one.
SHORT_ITEMS = 500


def _run(n: int):
    return lambda i: F.xxhash64(F.array_join(F.slice(F.col("_s"), i, F.lit(n)), " "))


def first_lookup(df: DataFrame, text: str, table: list[tuple[str, str]]) -> DataFrame:
    """Replaces the first entry (in the table's order) that a text contains; `mapped` is null if none is."""
    found = F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"))) for k, v in table])
    return df.withColumn("_hit", found).withColumn("mapped", F.when(F.col("_hit").isNotNull(), F.replace(F.col(text), F.col("_hit.k"), F.col("_hit.v")))).drop("_hit")


def zip_positions(a: DataFrame, b: DataFrame, keys: list[str], a_order: str, b_order: str, a_id: str, b_id: str) -> DataFrame:
    """Pairs rows of equal place; the longer side's rest is dropped."""
    at = lambda df, order, name, out: df.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("place"), F.col(name).alias(out))
    return at(a, a_order, a_id, "left_id").join(at(b, b_order, b_id, "right_id"), [*keys, "place"])


def references(refs: DataFrame, sizes: DataFrame, path: str = "path") -> DataFrame:
    """Verdict of citations (path, first, last) against line counts (path, lines); the first that fits."""
    found = refs.join(sizes, path, "left")
    verdict = F.when(F.col("lines").isNull(), "missing_file").when(F.col("last") > F.col("lines"), "out_of_range").when(F.col("first") > F.col("last"), "start_after_end").otherwise("ok")
    return found.withColumn("verdict", verdict)


def pair_events(events: DataFrame, start: Column, end: Column, key: str, start_id: str, end_ref: str, time: str) -> DataFrame:
    """Starts with their ends by the start's id; an open start has a null end."""
    a = events.where(start).select(key, F.col(start_id).alias("start_id"), F.col(time).alias("started"))
    b = events.where(end).select(F.col(end_ref).alias("start_id"), F.col(time).alias("ended"))
    return a.join(b, "start_id", "left")

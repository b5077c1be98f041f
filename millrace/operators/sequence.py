"""Operators that carry state along an order: dedupe, gap clusters, folds, numbering, runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, key: str, prefer: list[Column], order: list[str], place: str = "position") -> DataFrame:
    """The preferred row of each key, at the place where the key was seen first."""
    one = Window.partitionBy(key)
    ranked = df.withColumn(place, F.min(order[-1] if len(order) == 1 else F.struct(*order)).over(one)).withColumn("_n", F.row_number().over(one.orderBy(*prefer, *order)))
    return ranked.where("_n = 1").drop("_n")


def gap_clusters(df: DataFrame, keys: list[str], value: str, ties: list[str], gap: float, out: str = "cluster") -> DataFrame:
    """Numbers the clusters of values (from 0) that lie within `gap` of their predecessor."""
    along = Window.partitionBy(*keys).orderBy(value, *ties)
    opens = F.coalesce((F.col(value) - F.lag(value).over(along) > gap).cast("int"), F.lit(0))
    return df.withColumn("_open", opens).withColumn(out, F.sum("_open").over(along)).drop("_open")


def widest_clusters(df: DataFrame, keys: list[str], value: str, ties: list[str], gap: float, least: int = 2, most: int = 2) -> DataFrame:
    """(keys, part, low, high, members, gutter): clusters of at least `least` members, merged to `most` at their widest gaps.

    Keeping the most - 1 widest gaps is the same as merging the closest neighbours again and again (of equal gaps the
    earlier is merged). gutter is the middle of the gap to the next part.
    """
    parts = gap_clusters(df, keys, value, ties, gap).groupBy(*keys, "cluster").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("members")).where(F.col("members") >= least)
    along = Window.partitionBy(*keys).orderBy("cluster")
    parts = parts.withColumn("_gap", F.col("low") - F.lag("high").over(along))
    widest = Window.partitionBy(*keys).orderBy(F.col("_gap").desc_nulls_last(), F.col("cluster").desc())
    parts = parts.withColumn("_cut", (F.col("_gap").isNotNull() & (F.row_number().over(widest) < most)).cast("int"))
    parts = parts.withColumn("part", F.sum("_cut").over(along)).groupBy(*keys, "part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("members").alias("members"))
    return parts.withColumn("gutter", (F.col("high") + F.lead("low").over(Window.partitionBy(*keys).orderBy("part"))) / 2)


def largest_early_gap(df: DataFrame, keys: list[str], value: str, ties: list[str], first: int = 20, over: float = 50, least: int = 10) -> DataFrame:
    """The largest of the first differences between neighbours (the earliest of equals), where it is wide enough."""
    along = Window.partitionBy(*keys).orderBy(value, *ties)
    diffs = df.withColumn("_i", F.row_number().over(along)).withColumn("gap", F.lead(value).over(along) - F.col(value)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    diffs = diffs.where((F.col("_i") <= first) & F.col("gap").isNotNull() & (F.col("_n") >= least))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("gap"), "_i"))
    return diffs.withColumn("_best", best).where((F.col("_best") == 1) & (F.col("gap") > over)).select(*keys, F.col(value).alias("after"), "gap")


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], step: Callable, finish: Callable, schema: str) -> DataFrame:
    """A fold over each key's rows in order, as a stream: a task holds one key's state and one Arrow batch, never a whole key.

    step(state, rows) gets the state (None at first) and a pandas frame of the key's next rows and returns the state;
    finish(key, state) returns the key's result rows, as step may by appending to a list in its state. One shuffle.
    """
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        now, state = None, None
        for frame in frames:
            out: list[tuple] = []
            columns = [frame[k] for k in keys]
            change = pd.Series(True, index=frame.index)
            if len(frame) > 1:
                same = pd.concat([(c == c.shift()) | (c.isna() & c.shift().isna()) for c in columns], axis=1).all(axis=1)
                change = ~same
                change.iloc[0] = True
            starts = [*change.to_numpy().nonzero()[0].tolist(), len(frame)]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                key = tuple(None if pd.isna(c.iloc[s]) else c.iloc[s] for c in columns)
                if key != now:
                    if now is not None:
                        out += finish(now, state)
                    now, state = key, None
                state = step(state, frame.iloc[s:e])
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame(finish(now, state), columns=names)

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def last_kept(df: DataFrame, keys: list[str], order: str, value: str, drop: float) -> DataFrame:
    """(keys, order) of the items whose similarity to the last item kept is below `drop`.

    Similarity is 1 - the mean absolute difference of the vectors; the first item stays. The state is the last vector
    kept and the orders since the key began.
    """
    kinds = dict(df.dtypes)

    def step(state, rows):
        import numpy as np

        last, kept = state or (None, [])
        for at, v in zip(rows[order].tolist(), rows[value], strict=True):
            v = np.asarray(v, float)
            if last is None or 1 - np.abs(last - v).mean() < drop:
                last = v
                kept.append(at)
        return last, kept

    return fold_sorted(df.select(*keys, order, value), keys, [order], step, lambda key, state: [(*key, at) for at in state[1]], ", ".join(f"{c} {kinds[c]}" for c in [*keys, order]))


def numbering(df: DataFrame, keys: list[str], order: str, level: str, deepest: int = 6) -> DataFrame:
    """Adds `number`: counters of each level, deeper ones start anew, leading zeros are left out (2.1 under no 1 is 2.1's own)."""
    along = Window.partitionBy(*keys).orderBy(order)
    out = df
    for k in range(1, deepest + 1):  # how many of level k since the last shallower one
        out = out.withColumn(f"_s{k}", F.coalesce(F.sum((F.col(level) < k).cast("int")).over(along), F.lit(0)))
        out = out.withColumn(f"_c{k}", F.sum((F.col(level) == k).cast("int")).over(Window.partitionBy(*keys, f"_s{k}").orderBy(order)))
    counts = F.array(*[F.when(F.col(level) >= k, F.col(f"_c{k}")) for k in range(1, deepest + 1)])
    shown = F.filter(counts, lambda c: c.isNotNull())
    first = F.array_position(F.transform(shown, lambda c: (c > 0).cast("int")), 1)
    text = F.array_join(F.transform(F.slice(shown, F.greatest(first, F.lit(1)).cast("int"), F.size(shown)), lambda c: c.cast("string")), ".")
    return out.withColumn("number", text).select(*df.columns, "number")


def fences(lines: Column) -> Column:
    """Fenced blocks of an array of lines: (start, lang, lines), lines numbered from 1. Only a bare fence closes; a tagged one inside is content."""
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    kind = "struct<open:struct<start:int,lang:string,lines:array<string>>,done:array<struct<start:int,lang:string,lines:array<string>>>>"
    start = F.struct(F.lit(None).cast("struct<start:int,lang:string,lines:array<string>>").alias("open"), F.array().cast("array<struct<start:int,lang:string,lines:array<string>>>").alias("done")).cast(kind)

    def step(state: Column, item: Column) -> Column:
        mark = item["line"].rlike(r"^\s*```")
        info = F.trim(F.regexp_replace(item["line"], r"^\s*```", ""))
        none = F.lit(None).cast("struct<start:int,lang:string,lines:array<string>>")
        begun = F.struct(F.struct(item["n"].alias("start"), info.alias("lang"), F.array().cast("array<string>").alias("lines")).alias("open"), state["done"].alias("done"))
        closed = F.struct(none.alias("open"), F.concat(state["done"], F.array(state["open"])).alias("done"))
        grown = F.struct(F.struct(state["open"]["start"].alias("start"), state["open"]["lang"].alias("lang"), F.concat(state["open"]["lines"], F.array(item["line"])).alias("lines")).alias("open"), state["done"].alias("done"))
        return F.when(state["open"].isNull(), F.when(mark, begun.cast(kind)).otherwise(state)).otherwise(F.when(mark & (info == ""), closed.cast(kind)).otherwise(grown.cast(kind)))

    return F.aggregate(numbered, start, step)["done"]


def balance(marks: Column) -> tuple[Column, Column]:
    """(unmatched closers, openers left) of an array of 1 and -1; a closer too many is counted and the depth starts at 0 again."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("bad"))
    step = lambda s, m: F.struct(F.greatest(s["depth"] + m, F.lit(0)).alias("depth"), (s["bad"] + F.when(s["depth"] + m < 0, 1).otherwise(0)).alias("bad"))
    end = F.aggregate(marks, start, step)
    return end["bad"], end["depth"]


def islands(df: DataFrame, keys: list[str], order: str, inside: Column, out: str = "island") -> DataFrame:
    """Rows where `inside` holds, numbered by runs of consecutive orders."""
    along = Window.partitionBy(*keys).orderBy(order)
    return df.where(inside).withColumn(out, F.col(order) - F.row_number().over(along))


def trailing(values: Column, empty) -> Column:
    """How many elements at the end of an array fit `empty`."""
    back = F.reverse(values)
    at = F.array_position(F.transform(back, lambda x: F.coalesce(empty(x), F.lit(False)).cast("int")), 0)
    return F.when(at == 0, F.size(values)).otherwise(at - 1)


def sample_places(n: Column, most: int = 5) -> Column:
    """floor(i * n / k) for k = least(most, n) places."""
    k = F.least(F.lit(most), n)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * n / k))).otherwise(F.array().cast("array<bigint>"))


def decimate(df: DataFrame, keys: list[str], order: str, most: int = 12) -> DataFrame:
    """Every (n div most)-th row of a sequence of more than `most` rows; below twice as many that is every row."""
    one = Window.partitionBy(*keys)
    step = F.when(F.col("_n") > most, F.greatest(F.lit(1), F.expr(f"_n div {most}"))).otherwise(F.lit(1))
    out = df.withColumn("_n", F.count("*").over(one)).withColumn("_i", F.row_number().over(one.orderBy(order)) - 1)
    return out.where(F.pmod(F.col("_i"), step) == 0).select(*df.columns)


def relative_depth(df: DataFrame, keys: list[str], level: str, most: int = 5) -> DataFrame:
    return df.withColumn("depth", F.least(F.col(level) - F.min(level).over(Window.partitionBy(*keys)), F.lit(most)))


def contents(df: DataFrame, keys: list[str], order: str, level: str) -> DataFrame:
    """Levels 2 and 3; a level 3 with no level 2 before it is left out."""
    before = F.max((F.col(level) == 2).cast("int")).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_two", before).where((F.col(level) == 2) | ((F.col(level) == 3) & (F.col("_two") == 1))).drop("_two")

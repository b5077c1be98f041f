"""Group statistics, rates, verdicts, confusion metrics, modes and consensus tests."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, keys: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Mean, sample standard deviation (0 for a single row), minimum and maximum of each metric, rounded."""
    out = []
    for m in metrics:
        out += [
            F.round(F.coalesce(F.avg(m), F.lit(0.0)), digits).alias(f"{m}_mean"),
            F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), digits).alias(f"{m}_stddev"),
            F.round(F.coalesce(F.min(m).cast("double"), F.lit(0.0)), digits).alias(f"{m}_min"),
            F.round(F.coalesce(F.max(m).cast("double"), F.lit(0.0)), digits).alias(f"{m}_max"),
        ]
    return df.groupBy(*keys).agg(*out)


def mean_deltas(summary: DataFrame, config: str, first, second, metrics: list[str], digits: int = 4) -> DataFrame:
    """One row: the rounded mean of `first` minus that of `second` for each metric; a missing side counts as 0."""
    side = lambda m, value: F.coalesce(F.max(F.when(F.col(config) == value, F.col(f"{m}_mean"))), F.lit(0.0))
    return summary.agg(*[F.round(side(m, first) - side(m, second), digits).alias(f"{m}_delta") for m in metrics])


def rates(df: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """Hits, attempts and their rate for each key; an attempt whose outcome is unknown is no hit."""
    hit = F.coalesce(hit, F.lit(False)).cast("int")
    return df.groupBy(*keys).agg(F.sum(hit).alias("hits"), F.count("*").alias("attempts"), F.avg(hit).alias("rate"))


def passes(rate: Column, expected: Column, threshold: float) -> Column:
    """Expected: the rate reaches the threshold. Not expected: it stays below."""
    return F.when(expected, rate >= threshold).otherwise(rate < threshold)


def tally(df: DataFrame, passed: Column, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"), F.count("*").alias("total"))


def confusion(df: DataFrame, actual: Column, predicted: Column, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn; precision and recall are 1 where undefined, accuracy 0."""
    n = lambda a, p: F.count_if((actual if a else ~actual) & (predicted if p else ~predicted))
    out = df.groupBy(*(keys or [])).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    part = lambda top, bottom, other: F.round(F.coalesce(F.try_divide(top, bottom), F.lit(other)), 6)
    return out.withColumns(
        {
            "precision": part(F.col("tp"), F.expr("tp + fp"), 1.0),
            "recall": part(F.col("tp"), F.expr("tp + fn"), 1.0),
            "accuracy": part(F.expr("tp + tn"), F.expr("tp + fp + fn + tn"), 0.0),
        }
    )


def weighted_mode(df: DataFrame, keys: list[str], value: Column, weight: Column, first: Column, least: float = 0.0) -> DataFrame:
    """The value with the largest total weight for each key; of ties the one seen first; null below the share `least`."""
    bins = df.groupBy(*keys, value.alias("mode")).agg(F.sum(weight).alias("_w"), F.min(first).alias("_first"))
    all_ = Window.partitionBy(*keys)
    bins = bins.withColumn("_share", F.try_divide(F.col("_w"), F.sum("_w").over(all_))).withColumn("_n", F.row_number().over(all_.orderBy(F.desc("_w"), "_first")))
    return bins.where("_n = 1").select(*keys, F.when(F.col("_share") >= least, F.col("mode")).alias("mode"), F.round("_share", 6).alias("share"))


def index_percentiles(df: DataFrame, keys: list[str], value: str, ties: list[str]) -> DataFrame:
    """The elements at places n div 10 from either end; the extremes if there are at most five."""
    one = Window.partitionBy(*keys)
    ranked = df.withColumn("_n", F.count("*").over(one)).withColumn("_i", F.row_number().over(one.orderBy(value, *ties)) - 1)
    place = F.when(F.col("_n") > 5, F.expr("_n div 10")).otherwise(F.lit(0))
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("_i") == place, F.col(value))).alias("low"), F.max(F.when(F.col("_i") == F.col("_n") - 1 - place, F.col(value))).alias("high"))


def consensus(df: DataFrame, keys: list[str], value: str, target: float, least: int = 3, off: float = 60, near: float = 40, share: float = 0.5) -> DataFrame:
    """Whether at least `least` members have a median within `off` of the target and `share` of them within `near` of the median."""
    mid = df.groupBy(*keys).agg(F.median(value).alias("median"), F.count("*").alias("members"))
    close = df.join(mid, keys).groupBy(*keys).agg(F.first("median").alias("median"), F.first("members").alias("members"), F.avg((F.abs(F.col(value) - F.col("median")) <= near).cast("int")).alias("close"))
    agreed = (F.col("members") >= least) & (F.abs(F.col("median") - target) <= off) & (F.col("close") >= share)
    return close.select(*keys, F.round("median", 6).alias("median"), "members", F.round("close", 6).alias("close"), agreed.alias("agreed"))


def rubric(scores: list[Column], top: float = 5, scale: float = 10) -> Column:
    """Mean of the dimensions, scaled."""
    return F.round(reduce(add, scores) / len(scores) / top * scale, 6)


def observed(df: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation that counts the rows for which each condition holds while an action writes or reads df; no pass of its own."""
    seen = Observation()
    return df.observe(seen, *[F.count_if(c).alias(n) for n, c in counters.items()]), seen

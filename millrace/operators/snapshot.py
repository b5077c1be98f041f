"""State merges, grounding of lines, link checks and column or path filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_state(state: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """What a sync does with each key of (key, edited, hash): the cheap edit time is compared first, then the hash.

    A key without a hash in the state is updated once it was touched.
    """
    both = state.select(key, F.col("edited").alias("_t0"), F.col("hash").alias("_h0"), F.lit(1).alias("_s")).join(now.select(key, "edited", "hash", F.lit(1).alias("_n")), key, "full")
    action = F.when(F.col("_s").isNull(), "CREATE").when(F.col("_n").isNull(), "FORGET").when(F.col("_t0").eqNullSafe(F.col("edited")), "SKIP_TIME").when((F.col("_h0") != "") & (F.col("_h0") == F.col("hash")), "SKIP_HASH").otherwise("UPDATE")
    return both.select(key, "edited", "hash", action.alias("action"))


def grounded(lines: DataFrame, sources: DataFrame, keys: list[str], group: list[str], least: float) -> DataFrame:
    """Per group the lines that contain, or are contained in, a source line of the same key; no countable line passes.

    Distinct lines meet the distinct source lines: equal ones by an equi-join; what is left is compared within its key.
    """
    sources = sources.distinct()
    each = lines.select(*keys, "line").distinct()
    equal = each.join(sources.withColumnRenamed("source", "line"), [*keys, "line"], "left_semi")
    left = each.join(sources.withColumnRenamed("source", "line"), [*keys, "line"], "left_anti")
    held = left.join(sources, keys).where(F.contains("source", "line") | F.contains("line", "source")).select(*keys, "line").distinct()
    hit = equal.unionByName(held).withColumn("_hit", F.lit(1))
    out = lines.join(hit, [*keys, "line"], "left").groupBy(*keys, *group).agg(F.count("*").alias("countable"), F.count("_hit").alias("matched"))
    return out.withColumn("ok", F.coalesce(F.try_divide("matched", "countable"), F.lit(1.0)) >= least)


def broken_links(links: DataFrame, files: DataFrame, target: str, path: str) -> DataFrame:
    """Links whose target is no file, nor has a file's name in any case."""
    base = lambda c: F.lower(F.regexp_extract(c, "([^/]*)$", 1))
    return links.join(files.select(F.col(path).alias(target)).distinct(), target, "left_anti").withColumn("_base", base(F.col(target))).join(files.select(base(F.col(path)).alias("_base")).distinct(), "_base", "left_anti").select(*links.columns)


def without_prefix(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.select([c for c in df.columns if not c.startswith(prefixes)])


def excluded(path: Column, parts: list[str], root: list[str] | None = None, names: list[str] | None = None) -> Column:
    """A path with one of `parts` anywhere, one of `root` first, or one of `names` last."""
    split = F.split(path, "/")
    out = F.arrays_overlap(split, F.array(*map(F.lit, parts)))
    if root:
        out = out | F.element_at(split, 1).isin(root)
    if names:
        out = out | F.element_at(split, -1).isin(names)
    return out


def decorative(w: Column, h: Column, both: float = 80, least: float = 30) -> Column:
    return ((w < both) & (h < both)) | (F.least(w, h) < least)

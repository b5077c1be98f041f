"""Helpers that the training-data operators share: cut lineage, join behind a size check, link components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (long) ids that may be broadcast: at 16 bytes each this is under 8 MB on an executor.
BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. A local session that names none gets one; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; a lost executor loses nothing of it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch at most, unless the session sets a limit of its own: rows hold whole texts.
BATCH, _LIMIT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with batches of BATCH bytes, as the JVM and its Python worker each hold some of them."""
    if _LIMIT not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(_LIMIT, BATCH)
    return df.mapInArrow(f, schema)


def trim(spark: SparkSession) -> None:
    """Give back to the system what the driver's Python and its JVM have freed; without glibc, or without that command, nothing happens.

    glibc keeps what numpy and the JVM's compilers have freed, and a long session plans and compiles many queries.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
    with contextlib.suppress(Exception):  # a JVM before 17.0.9, or no JVM in reach
        jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
        name = jvm.java.lang.Class.forName
        kinds, args = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = name(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        name("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files of tables that nothing refers to any more, and trim() the driver.

    Spark deletes them when the driver collects its garbage, which a driver with little to do may put off for the
    whole of an iteration; on many partitions those files are what fills the disks. A whole collection also shrinks
    the driver's heap to what it holds.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def join_ids(df: DataFrame, ids: DataFrame, on: str, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join with a narrow table of distinct ids, broadcast only if its counted rows are at most `limit`."""
    rows = ids.count() if rows is None else rows
    return df.join(F.broadcast(ids) if rows <= limit else ids.hint("merge"), on)


#: Name of the column that keyed() adds.
KEY = "_row_key"


def keyed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs plus KEY, a long that tells rows apart: the id where just one row has it, else a number outside the ids.

    Rows that repeat an id, or have none, are numbered by two hashes over all their columns (128 bits; maps are left
    out), so rows share a key only if they are alike in every column and one is as good as another. Ids that are all
    distinct cost one aggregation of the ids; only the others are joined, by broadcast if they are few (counted).
    """
    key = F.col(id_col).cast("long")
    rows = docs.withColumn(KEY, key)
    ids = docs.select(key.alias(KEY))
    odd = cut(ids.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col(KEY).isNull() | (F.col("n") > 1)).select(KEY))
    n = odd.count()
    if not n:
        return rows
    low, high = ids.agg(F.min(KEY), F.max(KEY)).first()
    up = (high or 0) < 1 << 62
    if not up and low < -(1 << 62):
        raise ValueError(f"{id_col} leaves no room for the numbers of repeated rows")
    base, sign = (max(high or 0, 0) + 1, 1) if up else (min(low, 0) - 1, -1)
    odd = odd.where(F.col(KEY).isNotNull())
    odd = F.broadcast(odd) if n <= BROADCAST_ROWS else odd.hint("merge")
    alone = rows.where(F.col(KEY).isNotNull()).join(odd, KEY, "left_anti")
    told = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    again = rows.where(F.col(KEY).isNull()).unionByName(rows.join(odd, KEY, "left_semi").select(*rows.columns))
    again = again.withColumns({"_h1": F.xxhash64(*told), "_h2": F.xxhash64(F.lit("second"), *told)})
    number = cut(again.select("_h1", "_h2").distinct().withColumn("_n", F.monotonically_increasing_id()))
    again = again.join(number, ["_h1", "_h2"]).withColumn(KEY, F.lit(base) + F.lit(sign) * F.col("_n"))
    return alone.select(*rows.columns).unionByName(again.select(*rows.columns))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def _settled(edges: DataFrame) -> DataFrame:
    """components() of distinct edges of longs that fit into one task: roots hook to the least of their neighbours' roots until none is left to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
        nodes, at = np.unique(np.concatenate(ends, 1) if ends else np.zeros((2, 0), np.int64), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while len(open_ := np.flatnonzero(root[a] != root[b])):
            x, y = root[a[open_]], root[b[open_]]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root, up := root[root]):
                root = up
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])

    return cut(map_arrow(edges.select("u", "v").coalesce(1), run, "node long, component long"))


def components(edges: DataFrame, most_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, component) of every node in edges (u, v): component is the smallest node it reaches.

    Up to `few` distinct edges of longs (counted) are settled in one task, which spares the driver the rounds' plans.

    Alternating large-star and small-star rounds: each edge set is rewritten towards the smallest neighbour until
    it stops changing. Only minima are aggregated (map-side first), so a hub with very many neighbours costs one
    row per task; the joins back to a hub are of the kind that adaptive execution splits. Nulls and self-loops are
    dropped, repeated and reversed edges count once, an empty table gives an empty one. Rounds grow with the
    logarithm of the longest path; the state is cut to the shared folder after each.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    now, before = cut(now), None
    if few and now.count() <= few:
        return _settled(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).unionByName(
            low.where(F.col("m") < u).select("u", F.col("m").alias("v"))).where(u != v).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array_distinct(F.array(F.col("u"), F.col("v")))).alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        now = cut(small)
        del both, low, large, small
        tidy(edges.sparkSession)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")

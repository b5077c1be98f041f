"""Sinks: summaries, reports, snapshots, atomic state, chunked and verified writes, archives, conditional updates."""

from __future__ import annotations

import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, order: list[str]) -> DataFrame:
    """One row, one JSON array of the rows in order (for tables of report size)."""
    row = F.struct(*df.columns)
    return df.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), row.alias("r")))), lambda x: x["r"])).alias("json"))


def as_markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """One row with a Markdown table of the rows in order."""
    cell = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |"))
    head = f"| {' | '.join(df.columns)} |\n|{' --- |' * len(df.columns)}\n"
    return df.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), line.alias("t")))), lambda x: x["t"]), "\n")).alias("markdown"))


def report_cells(results: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Rows by columns; a cell that is missing is false."""
    wide = results.groupBy(row).pivot(column, columns).agg(F.first(value))
    return wide.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(False)).alias(str(c)) for c in columns])


def snapshot(df: DataFrame, path: str, order: list[str]) -> None:
    """A baseline as JSON, sorted, in one file (tables of report size)."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


def replace_state(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap by two renames of the target's own file system.

    A reader sees the old or the new state, or for the moment between the renames none; it never sees a half-written one.
    If the second rename fails the old state comes back.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    token = uuid.uuid4().hex
    fresh, old = f"{path}.new-{token}", jvm.org.apache.hadoop.fs.Path(f"{path}.old-{token}")
    df.write.parquet(fresh)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), target):
        fs.rename(old, target)
        raise OSError(f"could not replace {path}")
    fs.delete(old, True)


def write_chunks(df: DataFrame, send: Callable[[list], None], chunk: int = 10, tries: int = 3) -> DataFrame:
    """(written, skipped) of each partition: rows go out in chunks; a chunk that fails goes row by row, bad rows are skipped and counted."""
    names = df.columns

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        written = skipped = 0
        for frame in frames:
            rows = frame[names].to_dict("records")
            for at in range(0, len(rows), chunk):
                part = rows[at : at + chunk]
                try:
                    send(part)
                    written += len(part)
                except Exception:
                    for row in part:
                        try:
                            with_retry(lambda row=row: send([row]), tries, wait=0)
                            written += 1
                        except Exception:
                            skipped += 1
        yield pd.DataFrame({"written": [written], "skipped": [skipped]})

    return df.mapInPandas(run, "written long, skipped long")


def with_retry(do: Callable[[], object], tries: int = 6, wait: float = 1.0, most: float = 60.0, after: Callable[[Exception], float | None] = lambda e: None):
    """Exponential backoff up to `most` seconds; `after` may name the seconds an error asks for."""
    for k in range(tries):
        try:
            return do()
        except Exception as e:
            if k + 1 == tries:
                raise
            asked = after(e)
            time.sleep(min(most, wait * 2**k) if asked is None else asked)
    return None


def write_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: a batch's folder is overwritten, so a replay leaves one copy; an empty write of rows fails."""

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/batch={batch_id}"
        seen = batch.persist()
        try:
            n = seen.count()
            seen.write.mode("overwrite").parquet(path)
            if n and batch.sparkSession.read.parquet(path).count() != n:
                raise OSError(f"batch {batch_id} is incomplete")
        finally:
            seen.unpersist()

    return write


def archive(folder: str, to: str, excluded: Callable[[str], bool]) -> list[str]:
    """A zip of a local folder's files without the excluded ones; their names."""
    root = Path(folder)
    names = sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())
    kept = [n for n in names if not excluded(n)]
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for n in kept:
            out.write(root / n, n)
    return kept


def conditional_update(state: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new state, refused changes): a change (key, expected, hash) takes effect only if the state's hash is the expected one."""
    both = state.select(key, F.col("hash").alias("_now")).join(changes, key, "full")
    good = F.col("_now").eqNullSafe(F.col("expected"))
    after = both.withColumn("hash", F.when(F.col("hash").isNotNull() & good, F.col("hash")).otherwise(F.col("_now"))).where("hash is not null").select(key, "hash")
    return after, both.where(F.col("hash").isNotNull() & ~good).select(key, "expected", "hash")


def tree_paths(walked: DataFrame, node: str, title: str, names: DataFrame) -> DataFrame:
    """(node, path) with sanitised names from the root down, from walk() with paths of orders and (order, title) names."""
    from millrace.functions.text import file_name

    parts = walked.select(node, F.posexplode("path").alias("_i", "_o")).join(names.select(F.col("ord").cast("bigint").alias("_o"), file_name(F.col(title)).alias("_name")), "_o")
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_name")))
    return parts.groupBy(node).agg(F.array_join(F.transform(ordered, lambda x: x["_name"]), "/").alias("path"))

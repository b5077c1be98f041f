"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of each partition name the digests that may be frequent; their exact counts and winners are
aggregated map-side and broadcast (a bounded table), so no hot group is ever shuffled. All other digests take an
ordinary shuffle, where the largest group is at most 2 / (capacity + 1) of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import BROADCAST_ROWS, KEY, cut, keyed, tidy

#: Counters in each Misra-Gries summary, and rows that are broadcast.
CAPACITY = 256
BLANKS = " \t\n\x0b\f\r"


def fold(counters: dict, more: dict, capacity: int) -> dict:
    """Merge two Misra-Gries summaries: add, then take the (capacity + 1)-th largest counter off all."""
    for key, n in more.items():
        counters[key] = counters.get(key, 0) + n
    if len(counters) > capacity:
        off = sorted(counters.values(), reverse=True)[capacity]
        counters = {key: n - off for key, n in counters.items() if n > off}
    return counters


def frequent(df: DataFrame, column: str, capacity: int = CAPACITY) -> DataFrame:
    """(column, at_least): at most `capacity` values, among them each that makes up over 2 / (capacity + 1) of the rows."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict = {}
        for batch in batches:
            counts = batch.column(0).value_counts()
            counters = fold(counters, dict(zip(counts.field(0).to_pylist(), counts.field(1).to_pylist(), strict=True)), capacity)
        counters.pop(None, None)
        yield pa.RecordBatch.from_arrays([pa.array(list(counters), batch_type), pa.array(list(counters.values()), pa.int64())], [column, "at_least"])

    kind = df.schema[column].dataType.simpleString()
    batch_type = pa.binary() if kind == "binary" else pa.string()
    one = df.select(column).mapInArrow(summaries, f"{column} {kind}, at_least long")
    return one.groupBy(column).agg(F.sum("at_least").alias("at_least")).orderBy(F.desc("at_least"), column).limit(capacity)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_col: str | None = None) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, text_sha256), and key_col if it is named.

    Texts are equal if they are identical without the characters [\\x20\\x09-\\x0D]; the digest is the SHA-256 of what
    is left. Of equal texts the row with the most code points stays, then the smallest id, then any one of rows that
    agree in both. A null text is empty, and all empty texts are one group. A row without an id can stay only in a
    group without ids, and keep_id is then null. Other columns of docs are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256)).alias("digest"),
            F.length(text).alias("n_chars"),
            F.monotonically_increasing_id().alias("row"),
            *([F.col(key_col)] if key_col else []),
        )
    )
    place = F.struct("n_chars", (-F.col("doc_id")).alias("doc_id"), (-F.col("row")).alias("row"))
    named = cut(frequent(rows, "digest", capacity).select("digest"))
    winners = rows.join(F.broadcast(named), "digest").groupBy("digest").agg(F.max(place).alias("best"), F.count("*").alias("group_size"))
    winners = cut(winners.where(F.col("group_size") > 1))  # at most `capacity` rows
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    same = Window.partitionBy("digest")
    rest = rest.withColumn("best", F.max(place).over(same)).withColumn("group_size", F.count("*").over(same))
    return hot.select(*rest.columns).unionByName(rest).select(
        "doc_id",
        (-F.col("best.doc_id")).alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *([F.col(key_col)] if key_col else []),
    )


def keep_rows(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that judge drops; all columns stay.

    judge gets the rows with a column KEY that tells them apart, also where they repeat an id or have none, and
    returns (KEY, kept) for each. Of rows that are alike in every column and share a key, one stays if only some are
    kept. The dropped keys are broadcast if they are few (counted), else joined by shuffle.
    """
    rows = keyed(docs, id_col)
    per_key = judge(rows).groupBy(KEY).agg(F.max(F.col("kept").cast("int")).alias("some"), F.min(F.col("kept").cast("int")).alias("all"))
    odd = cut(per_key.where("all = 0"))
    tidy(docs.sparkSession)
    n = {r["some"]: r["count"] for r in odd.groupBy("some").count().collect()}  # two rows at most
    hinted = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")
    out = rows.join(hinted(odd.select(KEY), sum(n.values())), KEY, "left_anti").select(*rows.columns)
    if n.get(1):  # keys of which one row stays and others go
        out = out.unionByName(rows.join(hinted(odd.where("some = 1").select(KEY), n[1]), KEY, "left_semi").dropDuplicates([KEY]).select(*rows.columns))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

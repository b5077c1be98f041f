"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule is the point (i * g mod n) / n with g next to n over the golden ratio; the points are mapped
through the sources' cumulative weights, so any stretch of the schedule holds each source in its share. Slots are
ranked within their source, and rank r reads block r (modulo their number) of the source's documents, which are
shuffled by a hash and cut into blocks of equal tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import BROADCAST_ROWS, KEY, cut, keyed, tidy

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words in a block.
BLOCK = 64
#: Slots up to which a product of two of them fits a long; beyond, points are computed as decimals, with the same values.
LONG_SLOTS = 3_000_000_000
#: Slots and documents are ranked in so many runs per source, so that a hot source is never one task.
RUNS = 4096
GOLDEN = 0.6180339887498949
_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) for sizes (source, size), a row per document.

    Sources by code point, null last, take the weights in turn and share `share` of all sizes; a target above `most`
    times its source's size stops there and the excess is shared by weight again: target = least(most * size,
    level * weight), with the level found from the sources ordered by most * size / weight. One narrow row per source
    passes through a single task, which spills if it must; what grows with the documents is aggregated before.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = one.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    one = one.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    below = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    over_all = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(over_all) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    open_ = F.sum("weight").over(over_all) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    one = one.withColumn("level", left / open_)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(over_all)["level"]
    return one.select("source", "source_size", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def step(n: int) -> int:
    """The smallest number that has no factor in common with n, from n over the golden ratio on."""
    g = max(1, math.floor(n * GOLDEN))
    while math.gcd(g, n) != 1:
        g += 1
    return g


def point(slot: Column, n: int) -> Column:
    """Where slot i of n stands: i * step(n) modulo n."""
    kind = "long" if n <= LONG_SLOTS else "decimal(18,0)"
    return F.pmod(slot.cast(kind) * F.lit(step(n)).cast(kind), F.lit(n).cast(kind)).cast("long")


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """(slot, source, rank, block) from goals (source, source_size, target, blocks, low, high).

    A source owns the points [low, high); no slot reads a block a third time.
    """
    n = goals.agg(F.max("high")).first()[0] or 0
    if not n:
        return goals.sparkSession.range(0).select(F.col("id").alias("slot"), F.lit(None).cast("string").alias("source"), F.lit(0).alias("rank"), F.lit(0).alias("block"))
    wide = max(1, -(-n // 65536))
    slots = goals.sparkSession.range(n).select(F.col("id").alias("slot"), point(F.col("id"), n).alias("point"))
    cells = goals.where("high > low").withColumn("cell", F.explode(F.sequence(F.expr(f"low div {wide}"), F.expr(f"(high - 1) div {wide}"))))
    few = goals.count() <= _SOURCES  # then the cells are under 65,536 + 50,000 short rows
    slots = slots.withColumn("cell", F.expr(f"point div {wide}")).join(F.broadcast(cells) if few else cells, "cell").where("point >= low and point < high")
    slots = slots.withColumn("run", F.expr(f"slot div {max(1, -(-n // RUNS))}"))
    before = slots.groupBy("source", "run").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("source", "run", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "run").orderBy("slot")
    slots = slots.withColumn("place", F.row_number().over(within) - 1).alias("s").join(before.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.run") == F.col("b.run")))
    slots = slots.select("slot", "s.source", (F.col("place") + F.col("before")).alias("rank"), "blocks")
    return slots.where(F.col("rank") < MOST * F.col("blocks")).select("slot", "source", "rank", F.pmod("rank", "blocks").alias("block"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, block: int, key_col: str | None = None) -> DataFrame:
    """mix() with the source and key_col of each row."""
    text = F.col(text_col).cast("string")
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text).alias("size"),
            F.md5(F.concat(F.lit("mix "), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("place"),
            F.xxhash64(text).alias("tie"),
            F.monotonically_increasing_id().alias("row"),
            *([F.col(key_col)] if key_col else []),
        )
    )
    goals = cut(targets(rows, weights, share))
    so_far = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    goals = goals.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    goals = goals.withColumn("quota", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0)))
    goals = goals.withColumn("high", F.floor(F.sum("quota").over(so_far) + F.lit(0.5)))
    goals = cut(goals.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0))))
    times = schedule(goals, block).groupBy("source", "block").agg(F.count("*").alias("times"))

    run = F.substring("place", 1, 3).alias("run")
    runs = rows.groupBy("source", run).agg(F.sum("size").alias("n"))
    runs = runs.select("source", "run", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "run").orderBy("place", "tie", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.where("size > 0").withColumn("run", run).withColumn("so_far", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.alias("p").join(runs.alias("r"), F.col("p.source").eqNullSafe(F.col("r.source")) & (F.col("p.run") == F.col("r.run")))
    placed = placed.select("row", "p.source", "size", (F.col("so_far") + F.col("before")).alias("from"))
    parts = placed.withColumn("block", F.explode(F.sequence(F.expr(f"`from` div {block}"), F.expr(f"(`from` + size - 1) div {block}"))))
    words = F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("from"), F.col("block") * block)
    parts = parts.select("row", "source", "block", words.alias("words")).alias("p")
    taken = parts.join(times.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block")))
    taken = taken.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    few = goals.count() <= _SOURCES
    goals = goals.select("source", "source_size", "target")
    out = rows.join(taken, "row", "left").alias("o").join((F.broadcast(goals) if few else goals).alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")))
    return out.select("doc_id", "o.source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), *([key_col] if key_col else []))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: (doc_id, size, source_size, target, taken), size and taken in words.

    A null source is a source of its own, last in order. A null or empty text has size 0 and is never taken; a source
    of only such texts has target 0. Repeated rows are documents of their own. A very long text is cut into many
    blocks. An empty table gives no rows. Reruns agree: the order within a source is that of md5 of the id, then of a
    hash of the text; rows that agree in both are alike.
    """
    return _mixed(docs, id_col, text_col, source_col, weights, share, block).drop("source")


def copies(mixed: DataFrame, key_col: str = KEY) -> DataFrame:
    """(key_col, times): how often the mix, which takes parts of documents, takes each document as a whole.

    Per source the documents are put in order of size and their shares taken / size are added up; a document is taken
    as often as the sum passes a half on the way over it. So a share below 2 gives its floor or its ceiling, and the
    words of a source differ from those that the mix takes by the largest document of the source at most: errors of
    neighbours in size cancel out. Sums are whole numbers (shares in parts of 2^20), over runs of one size and hash,
    over sizes within classes of size, and over classes, so that no task holds a whole source.
    """
    share = F.expr(f"(taken * {1 << 20}) div size")
    wide = F.floor(F.log2("size") * 8).alias("wide")  # some hundred classes of size in a source
    rows = mixed.where("size > 0").select("source", wide, "size", key_col, share.alias("share"), F.pmod(F.xxhash64(key_col), F.lit(256)).alias("run"))
    runs = rows.groupBy("source", "wide", "size", "run").agg(F.sum("share").alias("n"))
    classes = runs.groupBy("source", "wide").agg(F.sum("n").alias("n"))
    ahead = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("source", "wide", F.coalesce(F.sum("n").over(ahead("source").orderBy("wide")), F.lit(0)).alias("smaller")).alias("c")
    runs = runs.select("source", "wide", "size", "run", F.coalesce(F.sum("n").over(ahead("source", "wide").orderBy("size", "run")), F.lit(0)).alias("before")).alias("b")
    runs = runs.join(classes, F.col("b.source").eqNullSafe(F.col("c.source")) & (F.col("b.wide") == F.col("c.wide"))).select("b.source", "b.size", "b.run", (F.col("before") + F.col("smaller")).alias("before"))
    within = ahead("source", "size", "run").orderBy(key_col)
    rows = rows.withColumn("so_far", F.coalesce(F.sum("share").over(within), F.lit(0))).alias("r")
    rows = rows.join(runs.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.size") == F.col("b.size")) & (F.col("r.run") == F.col("b.run")))
    rows = rows.select(key_col, "share", (F.col("so_far") + F.col("before")).alias("sum"))
    return rows.select(key_col, F.expr(f"(sum + share + {1 << 19}) div {1 << 20} - (sum + {1 << 19}) div {1 << 20}").cast("int").alias("times"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """The mix itself: each row of docs as often as copies() says, some not at all and some twice; all columns stay.

    Rows without words stay once. Rows may repeat an id or have none. The words of a source are those that mix() takes,
    give or take its largest document. The times that are not 1 are broadcast if they are few (counted), else joined.
    """
    rows = keyed(docs, id_col)
    mixed = _mixed(rows, id_col, text_col, source_col, weights, share, block, KEY)
    times = cut(copies(mixed).groupBy(KEY).agg(F.sum("times").cast("int").alias("_times"), F.count("*").alias("_rows")).where("_times <> _rows"))
    tidy(docs.sparkSession)
    many = F.broadcast(times) if times.count() <= BROADCAST_ROWS else times.hint("merge")
    placed = rows.join(many, KEY, "left").withColumns({"_times": F.coalesce("_times", F.lit(1)), "_rows": F.coalesce("_rows", F.lit(1))})
    alike = placed.where("_rows > 1").dropDuplicates([KEY])  # rows that share a key are alike: one of them stands for all
    placed = placed.where("_rows = 1").unionByName(alike) if times.where("_rows > 1").limit(1).count() else placed
    return placed.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])

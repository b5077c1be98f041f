"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens. Full pieces are sequences as they are; the others are dealt by
a hash into shards of bounded size. Each shard is evolved on several islands: a child takes whole well-filled bins of
one parent, drops the other's bins that hold any of the same pieces, and best-fits what that displaces. Between
epochs each island's elite moves on to the next island of the ring; in the end the best packing of a shard's islands
counts. A shard that reaches its lower bound is done early.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import cut, map_arrow

CAPACITY, END = 1024, 2
#: Pieces in a shard (about), islands of a shard, packings on an island, epochs, and children an epoch.
SHARD, ISLANDS, POPULATION, EPOCHS, CHILDREN = 8192, 3, 4, 3, 8
#: Documents that are tokenised before their pieces are handed on, and tasks that evolve islands at most.
ROWS, TASKS = 256, 30_000


def byte_ranks(told: dict) -> dict[bytes, int] | None:
    """The vocabulary of a parsed tokenizer file as bytes -> id; None unless it is byte-level BPE without options that change its ids."""
    model, before = told["model"], told.get("pre_tokenizer") or {}
    simple = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not told.get("normalizer")
    if not simple or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in told.get("added_tokens", [])):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from U+0100 on
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {x["content"] for x in told.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


@functools.lru_cache(maxsize=2)
def encoder(path: str, quick: bool) -> Callable[[str], np.ndarray]:
    """text -> ids (uint32) of the tokenizer file at `path` without special tokens added.

    quick: by tiktoken from the vocabulary in that file (byte-level BPE only), else by the tokenizers library. A
    process loads one of the two.
    """
    if not quick:
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        return lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    bpe = tiktoken.Encoding("file", pat_str=words, mergeable_ranks=byte_ranks(told), special_tokens=special)
    return lambda text: bpe.encode_to_numpy(text, allowed_special="all" if any(s in text for s in special) else set(), disallowed_special=())


#: Strings that two tokenizers of one file must split alike before the quicker one is trusted with it.
PROBES = (
    "Naïve words, 12 numbers\n  and \t'll <|marks|> größer ééé 日本 🙂", "", " ", "\n\n  x\r\n", "<|endoftext|>a <|endoftext|>", "don't DON'T we'll I'd they've y'all's", "a\u00a0b\u2003c\u3000d", "١٢٣ ½ ² Ⅳ 1,234.5e-6",
    "e\u0301 a\u030a ﬁ Å", "{\"key\": [1, null, true]}  # comment", "def f(x):\n\treturn x ** 2\n", "👩‍👩‍👧‍👦🇩🇪", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "Ünïcödé ÑANDÚ straße", "\u200b\ufeff\x00\x7f", "<|endoftext",
)


@functools.lru_cache(maxsize=2)
def quick_is_right(path: str) -> bool:
    """Whether the file is of the kind that the quicker library runs, and both libraries give the same ids for PROBES."""
    with open(path, encoding="utf-8") as f:
        if byte_ranks(json.load(f)) is None:
            return False
    slow, fast = encoder(path, False), encoder(path, True)
    encoder.cache_clear()
    return all(np.array_equal(slow(x), fast(x)) for x in PROBES)


def cut_points(n: int, capacity: int) -> list[int]:
    """Where the pieces of n ids start: the first may be shorter, all others are full."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids followed by `end`."""
    quick = quick_is_right(tokenizer)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def some(batch: pa.RecordBatch, encode: Callable[[str], np.ndarray]) -> pa.RecordBatch:
        row, piece, start, length, crc, held = [], [], [], [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
            starts = cut_points(len(ids), capacity)
            ends = [*starts[1:], len(ids)]
            row += [k] * len(starts)
            piece += range(len(starts))
            start += starts
            length += [e - s for s, e in zip(starts, ends, strict=True)]
            crc += [zlib.crc32(ids[s:e]) for s, e in zip(starts, ends, strict=True)]
            if with_ids:
                held.append(ids)
        columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), pa.array(np.concatenate(held).astype(np.int64))))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, quick)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                yield some(batch.slice(at, ROWS), encode)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)


class Packing:
    """Bins of items (their indexes), built by best fit."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def open(self, items: list[int], room: int) -> None:
        self.by_room[room].append(len(self.bins))
        self.mask |= 1 << room
        self.bins.append(items)
        self.room.append(room)

    def add(self, item: int) -> None:
        size = self.sizes[item]
        fits = self.mask >> size
        if not fits:
            self.open([item], self.capacity - size)
            return
        room = size + (fits & -fits).bit_length() - 1  # the tightest
        there = self.by_room[room]
        b = there.pop()
        if not there:
            self.mask ^= 1 << room
        self.bins[b].append(item)
        room -= size
        self.room[b] = room
        self.by_room[room].append(b)
        self.mask |= 1 << room

    def value(self) -> tuple[int, int]:
        """Fewer bins are better, then fuller ones."""
        return len(self.bins), sum(r * (r - 2 * self.capacity) for r in self.room)

    def genes(self) -> np.ndarray:
        out = np.zeros(len(self.sizes), np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out


def from_genes(genes: np.ndarray, sizes: list[int], capacity: int) -> Packing:
    out = Packing(sizes, capacity)
    order = np.argsort(genes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(genes[order])) + 1):
        items = part.tolist()
        out.open(items, capacity - sum(sizes[i] for i in items))
    return out


def best_fit(sizes: list[int], capacity: int, order: np.ndarray) -> Packing:
    out = Packing(sizes, capacity)
    for i in order.tolist():
        out.add(i)
    return out


def child(one: Packing, other: Packing, rng: np.random.Generator) -> Packing:
    """Whole well-filled bins of `other`, the bins of `one` that share no item with them, the rest by best fit."""
    slack = np.array(other.room)
    full = np.flatnonzero(slack <= np.median(slack))
    given = [other.bins[b] for b in full[rng.random(len(full)) < 0.5].tolist()]
    held = {i for items in given for i in items}
    out = Packing(one.sizes, one.capacity)
    loose: list[int] = []
    worst = np.array(one.room) > 0
    drop = worst & (rng.random(len(worst)) < 0.1 + 0.9 * (np.array(one.room) > one.capacity // 4))  # the emptiest bins give way too
    for items in given:
        out.open(list(items), one.capacity - sum(one.sizes[i] for i in items))
    for b, items in enumerate(one.bins):
        if drop[b] or not held.isdisjoint(items):
            loose += [i for i in items if i not in held]
        else:
            out.open(list(items), one.room[b])
    for i in sorted(loose, key=lambda i: -one.sizes[i]):
        out.add(i)
    return out


def evolve(sizes: np.ndarray, genes: list[np.ndarray], capacity: int, seed: int, children: int = CHILDREN, population: int = POPULATION) -> list[np.ndarray]:
    """One epoch of an island: the packings in `genes` (best-fit ones to begin with) and their children, the best first."""
    rng, plain = np.random.default_rng(seed), sizes.tolist()
    least = -(-int(sizes.sum()) // capacity)
    stock = [from_genes(g, plain, capacity) for g in genes]
    while len(stock) < population and not any(len(p.bins) <= least for p in stock):
        noise = 1.0 if not stock and seed % ISLANDS == 0 else rng.uniform(0.9, 1.0, len(sizes))
        stock.append(best_fit(plain, capacity, np.argsort(-sizes * noise, kind="stable")))
    stock.sort(key=Packing.value)
    for _ in range(children):
        if len(stock[0].bins) <= least or len(stock) < 2:
            break
        a, b = rng.choice(len(stock), 2, replace=False)
        stock.append(child(stock[a], stock[b], rng))
        stock.sort(key=Packing.value)
        del stock[population:]
    return [p.genes() for p in stock]


def _join(genes: list[np.ndarray]) -> bytes:
    return np.stack(genes).astype(np.int32).tobytes()


def shards(items: DataFrame, capacity: int, of: int, epochs: int = EPOCHS) -> DataFrame:
    """(shard, pos, bin, offset) for items (shard, pos, length) of `of` shards, pos counting from 0 within a shard.

    Each island of each shard has a task of its own, up to TASKS of them.
    """
    tasks = min(TASKS, of * ISLANDS)
    packed = items.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("pos", "length")))["length"].alias("sizes"))
    state = packed.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes", F.lit(None).cast("binary").alias("genes"), F.lit(None).cast("binary").alias("guest"))
    for epoch in range(epochs):

        def run(batches: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for r in batch.itertuples(index=False):
                    sizes = np.asarray(r.sizes, np.int64)
                    own = [] if r.genes is None else list(np.frombuffer(r.genes, np.int32).reshape(-1, len(sizes)))
                    own += [] if r.guest is None else [np.frombuffer(r.guest, np.int32)]
                    best = evolve(sizes, own, capacity, (int(r.shard) * epochs + epoch) * ISLANDS + int(r.island))
                    rows.append((r.shard, r.island, r.sizes, _join(best), best[0].tobytes(), int(best[0].max()) + 1))
                yield pd.DataFrame(rows, columns=["shard", "island", "sizes", "genes", "elite", "bins"])

        state = state.repartitionById(tasks, F.pmod(F.col("shard") * ISLANDS + F.col("island"), F.lit(tasks)).cast("int")).select("shard", "island", "sizes", "genes", "guest").mapInPandas(run, "shard long, island int, sizes array<long>, genes binary, elite binary, bins int")
        state = cut(state)
        guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))
        if epoch + 1 < epochs:
            state = state.select("shard", "island", "sizes", "genes").join(guests, ["shard", "island"])
    best = state.withColumn("n", F.row_number().over(Window.partitionBy("shard").orderBy("bins", "island"))).where("n = 1")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                sizes, genes = np.asarray(r.sizes, np.int64), np.frombuffer(r.elite, np.int32)
                order = np.argsort(genes, kind="stable")
                total = np.cumsum(sizes[order]) - sizes[order]
                first = np.flatnonzero(np.diff(genes[order], prepend=-1))
                offset = np.zeros(len(sizes), np.int64)
                offset[order] = total - np.repeat(total[first], np.diff(first, append=len(order)))
                yield pd.DataFrame({"shard": r.shard, "pos": np.arange(len(sizes)), "bin": genes.astype(np.int64), "offset": offset})

    return best.select("shard", "sizes", "elite").mapInPandas(place, "shard long, pos long, bin long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Pieces of a sequence stand at their offsets without gaps. A null text is empty and gives one piece, the end id.
    Rows that repeat an id are packed each (their pieces repeat). A text over `capacity` tokens is cut into full
    pieces after a first one that may be shorter. Other columns are not read; an empty table gives no rows.
    """
    rows = cut(pieces(docs, tokenizer, capacity, end, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    n = rows.where(F.col("length") < capacity).count()
    of = max(1, round(n / shard))
    some = rows.where(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(of)))
    some = cut(some.withColumn("pos", (F.row_number().over(Window.partitionBy("shard").orderBy("row")) - 1).cast("long")))  # shards are of bounded size
    placed = some.join(shards(some.select("shard", "pos", "length"), capacity, of), ["shard", "pos"])
    placed = placed.withColumn("sequence_id", F.col("shard") * F.lit(1 << 20) + F.col("bin"))
    whole = rows.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(columns).unionByName(whole.select(columns))

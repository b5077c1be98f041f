"""Near-duplicate documents by a signature-coordinate inverted join.

Every set of word shingles has a MinHash signature; a document is posted under each (coordinate, value) pair of it.
Pairs that share at least `matches` coordinates are candidates. Coordinates that nobody shares are left out of the
merge, and of the others only a prefix of the rarest is merged: two signatures with `matches` equal coordinates must
meet in the rarest `live - matches + 1` of each. Long postings are skipped in pair-wise merging as far as they can
be: their members are first tested against one of them, and members that are already connected are never paired
again. What is still apart after that is joined once more on the rarest shingles of the full sets, by positions that
leave no link out. Each link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import BROADCAST_ROWS, components, cut, map_arrow, tidy
from millrace.llm.words import mix, shingle_sets

#: Signature coordinates and equal ones that make a candidate: a pair at similarity 0.8 is missed once in a million.
COORDINATES, MATCHES = 32, 14
#: Rounds of tests against one member of each posting before the rest is joined pair by pair.
ROUNDS = 2
#: A key with over HOT rows, and over a HOT_KEYS-th of all, is joined by broadcast: HOT_KEYS short rows at most.
HOT, HOT_KEYS = 1000, 100_000
#: Counts of shingles by hash that order the sets in that join.
SLOTS = 1 << 18

_rng = np.random.default_rng(977)
_A = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, 256, dtype=np.uint64)


def signature_batch(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """uint32 minima, a row for each non-empty set."""
    sets = [s for s in sets if len(s)]
    out = np.zeros((len(sets), coordinates), np.uint32)
    at = 0
    while at < len(sets):  # some 100,000 shingles at a time stay in cache
        end, n = at, 0
        while end < len(sets) and (n == 0 or n + len(sets[end]) <= 100_000):
            n += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        for j in range(coordinates):
            out[at:end, j] = np.minimum.reduceat(((flat * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), starts)
        at = end
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, coordinates: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig): h1 and h2 together name the shingle set; sig is null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), width)
            n = np.array([len(s) for s in sets], np.int64)
            h1 = np.array([int(np.bitwise_xor.reduce(s)) if len(s) else 0 for s in sets], np.uint64)
            h2 = np.array([int(np.add.reduce(mix(s))) if len(s) else 0 for s in sets], np.uint64)
            sig = signature_batch(sets, coordinates).view(np.int32)
            offsets = np.zeros(len(n) + 1, np.int32)
            np.cumsum((n > 0) * coordinates, out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_shingles long, h1 long, h2 long, sig array<int>")


def by_key(rows: DataFrame, picked: DataFrame, bar: int, key: str = "key") -> DataFrame:
    """rows joined with picked (key, df, ...), a row per key with its number of rows: keys of over `bar` rows never meet in one task."""
    hot = picked.where(F.col("df") > bar)
    if not hot.limit(1).count():
        return rows.join(picked, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(picked.where(F.col("df") <= bar), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width)
            good = []
            for x, y in zip(one, other, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("one")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b")
    return map_arrow(both.select("a", "b", "one", "other"), run, "a long, b long")


def overlapping(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of texts (doc_id, comp, text) of different components whose full shingle sets can be similar enough.

    Every set is ordered by how frequent its shingles are (in a table of SLOTS counts, so that any hash has a place in
    one order for all sets). Two sets with an overlap of at least o must share a shingle among the first n - o + 1 of
    each; o follows from both sizes, so only rare shingles meet, and no link is lost.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in shingle_sets(batch.column(0), width):
                total += np.bincount((x % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS) if len(x) > SLOTS // 8 else 0
                if len(x) <= SLOTS // 8:
                    np.add.at(total, (x % np.uint64(SLOTS)).astype(np.int64), 1)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["slot", "n"])

    counts = map_arrow(texts.select("text"), count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS short rows at most
    often = np.zeros(SLOTS, np.int64)
    often[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    table = texts.sparkSession.sparkContext.broadcast(np.minimum(often, 2**31 - 1).astype(np.int32))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, places, tokens = [], [], [], []
            for i, x in enumerate(shingle_sets(batch.column(2), width)):
                n = len(x)
                seen = table.value[(x % np.uint64(SLOTS)).astype(np.int64)]
                first = np.lexsort((x, seen))[: n - -(-n * percent // 100) + 1]
                place = np.flatnonzero(seen[first] > 1)
                rows.append(np.full(len(place), i))
                sizes.append(np.full(len(place), n))
                places.append(place + 1)
                tokens.append(x[first][place].view(np.int64))
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            put = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), put(sizes), put(places), put(tokens)], ["rep", "comp", "n", "place", "token"])

    posts = cut(map_arrow(texts.select("doc_id", "comp", "text"), post, "rep long, comp long, n long, place long, token long"))
    met = posts.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    posts = cut(by_key(posts, cut(met.select("token", "df")), max(HOT, posts.count() // HOT_KEYS), "token"))
    side = lambda x: posts.select("token", F.col("rep").alias(x), F.col("comp").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"))
    least = f"(({percent} * (na + nb) + {99 + percent}) div {100 + percent})"
    return side("a").join(side("b"), "token").where(f"a > b and ca <> cb and pa <= na - {least} + 1 and pb <= nb - {least} + 1").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id, kept).

    A-Z is lower-cased, words are [^\\x20\\x09-\\x0D]+, a document's set is its distinct shingles of `width` words;
    with fewer words the whole sequence is its one shingle. Documents are linked if 100 * intersection >= percent *
    union; component_id is the smallest id reachable, and kept says that it is the row's own. A text that is null or
    has no words has an empty set and is linked with nothing. Rows that repeat an id count as one document, linked if
    any of their texts is; a row without an id is linked with nothing and its component_id is null. Other columns of
    docs are not read; an empty table gives no rows.
    """
    rows = cut(signatures(docs, id_col, text_col, width, coordinates))
    reps = rows.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    reps = cut(reps)
    bar = max(HOT, reps.count() * coordinates // HOT_KEYS)
    key = (F.col("pos").cast("long") * F.lit(1 << 32) + F.col("value").cast("long").bitwiseAND(F.lit((1 << 32) - 1))).alias("key")
    postings = reps.select("rep", F.posexplode("sig").alias("pos", "value")).select("rep", key)
    shared = cut(postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    live = by_key(postings, shared, bar).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("live"))  # `coordinates` entries at most
    live = live.where(F.size("live") >= matches).select("rep", F.slice("live", F.lit(1), F.size("live") - (matches - 1)).alias("keys"))
    dense = cut(live.join(reps.select("rep", "n", "sig"), "rep"))
    prefix = dense.select("rep", F.inline("keys"))

    count = dense.count()
    ids = dense.select(F.col("rep").alias("doc_id"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = cut(texts.join(F.broadcast(ids) if count <= BROADCAST_ROWS else ids.hint("merge"), "doc_id", "left_semi"))
    alike = f"aggregate(zip_with(sa, sb, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x) >= {round(coordinates * percent / 160)} and 100 * least(na, nb) >= {percent} * greatest(na, nb)"
    links = None

    def tested(pairs: DataFrame) -> DataFrame:
        nonlocal links
        found = cut(confirm(pairs, texts, width, percent).select(F.col("a").alias("u"), F.col("b").alias("v")))
        links = found if links is None else links.unionByName(found)
        return components(links, few=BROADCAST_ROWS)

    def near_hub(now: DataFrame) -> DataFrame:
        """Each member of a posting with its hub, if their signatures agree well."""
        pairs = now.where("comp <> hub.comp").select("rep", F.col("hub.rep").alias("other")).distinct()
        pairs = pairs.join(dense.select("rep", F.col("n").alias("na"), F.col("sig").alias("sa")), "rep").join(dense.select(F.col("rep").alias("other"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "other")
        return pairs.where(alike).select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")).distinct()

    label = None
    for k in range(ROUNDS + 1 if count else 0):
        now = prefix.withColumn("comp", F.col("rep"))
        if label is not None:
            now = prefix.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "df", "key", F.coalesce("component", "rep").alias("comp"))
            now = cut(now)
        pick = "struct(rep, comp)" if k == 0 else f"struct(xxhash64(rep, key, {k}), rep, comp)"
        open_ = now.groupBy("key").agg(F.max("df").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.expr(pick)).alias("hub")).where("low < high")
        open_ = cut(open_.select("key", "df", "hub"))
        if not open_.limit(1).count():
            break
        now = by_key(now.drop("df"), open_, bar)
        tidy(docs.sparkSession)
        if k < ROUNDS:
            label = tested(near_hub(now))
        else:
            rest = cut(now.select(F.col("rep").alias("doc_id"), "comp").distinct())
            few = rest.count() <= BROADCAST_ROWS
            label = tested(overlapping(texts.join(F.broadcast(rest) if few else rest.hint("merge"), "doc_id"), width, percent))

    named = reps.select("h1", "h2", "rep")
    if label is not None:
        named = named.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("rep"))
    out = rows.alias("r").join(named.alias("g"), (F.col("r.h1") == F.col("g.h1")) & (F.col("r.h2") == F.col("g.h2")) & (F.col("r.n_shingles") > 0) & F.col("r.doc_id").isNotNull(), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""Document fingerprints: one-permutation MinHash with optimal densification, kept as packed low-order bits.

Each shingle is hashed once; the hash's high bits choose a bin, and a bin keeps its smallest value. An empty bin
takes the value of the first non-empty one in its own random order of bins, drawn independently of the text. Of each
bin only the `bits` low-order bits are stored. Two fingerprints agree in a bin by chance with probability 2**-bits,
which likeness() takes out again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import map_arrow
from millrace.llm.words import mix, shingle_sets

BINS, BITS, WIDTH = 256, 8, 5
#: Runs of neighbouring ids that are put together in one place each, for a given number of rows.
ROWS_A_RUN, MOST_RUNS = 500, 100_000
NO_ID = -(1 << 63)
_ORDERS: dict[int, np.ndarray] = {}


def _orders(bins: int) -> np.ndarray:
    """Row i: the order in which an empty bin i asks the bins."""
    if bins not in _ORDERS:
        _ORDERS[bins] = np.argsort(np.random.default_rng(bins).random((bins, bins)), axis=1)
    return _ORDERS[bins]


def fingerprints(sets: list[np.ndarray], bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """Packed fingerprints of shingle sets (uint64 hashes); b"" for an empty set."""
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return [b""] * len(sets)
    flat = mix(np.concatenate([sets[i] for i in full]))
    row = np.repeat(np.arange(len(full)), [len(sets[i]) for i in full])
    cell = row * bins + ((flat >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)
    least = np.full(len(full) * bins, np.iinfo(np.uint32).max, np.uint32)
    value = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    order = np.lexsort((value, cell))
    first = np.flatnonzero(np.diff(cell[order], prepend=-1))
    least[cell[order[first]]] = value[order[first]]
    there = np.zeros(len(full) * bins, bool)
    there[cell] = True
    holes = np.flatnonzero(~there)
    orders = _orders(bins)
    for j in range(bins):  # every bin asks all others in the end
        if not len(holes):
            break
        asked = holes // bins * bins + orders[holes % bins, j]
        good = there[asked]
        least[holes[good]] = least[asked[good]]
        holes = holes[~good]
    low = (least & np.uint32((1 << bits) - 1)).reshape(len(full), bins)
    packed = np.packbits((low[:, :, None] >> np.arange(bits, dtype=np.uint32)[::-1] & 1).astype(np.uint8).reshape(len(full), -1), axis=1)
    out = [b""] * len(sets)
    for i, p in zip(full, packed, strict=True):
        out[i] = p.tobytes()
    return out


def likeness(one: list[bytes], other: list[bytes], bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of each pair, chance agreement taken out: (agreeing share - 2**-bits) / (1 - 2**-bits).

    Two empty fingerprints are alike (1), an empty and another are not (0).
    """
    out = np.array([float(a == b) for a, b in zip(one, other, strict=True)])
    both = [i for i, (a, b) in enumerate(zip(one, other, strict=True)) if a and b and a != b]
    if both:
        unpack = lambda x: np.unpackbits(np.frombuffer(b"".join(x[i] for i in both), np.uint8).reshape(len(both), -1), axis=1, count=bins * bits).reshape(len(both), bins, bits)
        agree = (unpack(one) == unpack(other)).all(2).mean(1)
        out[both] = np.clip((agree - 2.0**-bits) / (1 - 2.0**-bits), 0, 1)
    return out


def text_fingerprints(texts: list[str], width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    out: list[bytes] = []
    at = 0
    while at < len(texts):  # in parts of about a million characters
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= 1_000_000):
            n += len(texts[end])
            end += 1
        out += fingerprints(shingle_sets(pa.array(texts[at:end], pa.string()), width), bins, bits)
        at = end
    return out


def in_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text, run, tail) dealt into runs of neighbours, by descending id, then by descending hash of the text.

    A run's last row is its tail: the head of the next run (of the first for the last), which is only looked at. Run
    borders are quantiles of the ids; an id with many rows (or no id) is split by equal ranges of the hash. Borders hold
    no text and are as many as there are runs. One shuffle of the texts. Only rows alike in id and text stay together.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("place"))
    ids = rows.select("doc_id")
    n = ids.count()
    runs = max(1, min(MOST_RUNS, n // ROWS_A_RUN))
    size = max(ROWS_A_RUN, -(-n // MOST_RUNS))
    borders = [(int(x), NO_ID) for x in (ids.approxQuantile("doc_id", [i / runs for i in range(1, runs)], 0.2 / runs) if runs > 1 else [])]
    for r in ids.groupBy("doc_id").count().where(F.col("count") > 2 * size).collect():  # MOST_RUNS rows at most
        parts = -(-r["count"] // size)
        borders += [(r["doc_id"], NO_ID + j * 2**64 // parts) for j in range(parts)]
    borders = sorted(set(borders))
    at, of = np.array([b[0] for b in borders], np.int64), np.array([b[1] for b in borders], np.int64)

    @F.pandas_udf("int")
    def run_of(doc_id: pd.Series, place: pd.Series) -> pd.Series:
        x, y = doc_id.to_numpy(np.int64), place.to_numpy(np.int64)
        low, high = np.searchsorted(at, x, "left"), np.searchsorted(at, x, "right")
        for a in np.unique(low[high - low > 1]):
            own = (low == a) & (high - low > 1)
            high[own] = a + np.searchsorted(of[a : high[own][0]], y[own], "right")
        return pd.Series((len(at) - high).astype(np.int32))

    heads = rows.select("doc_id", "place").withColumn("run", run_of("doc_id", "place")).groupBy("run").agg(F.max(F.struct("doc_id", "place")).alias("head")).orderBy("run").collect()  # a row for each run
    before = [(*h["head"], heads[i - 1]["run"]) for i, h in enumerate(heads)]  # the last run looks at the first one's head
    before = docs.sparkSession.createDataFrame(before, "doc_id long, place long, before int")
    placed = rows.withColumn("run", run_of("doc_id", "place")).join(F.broadcast(before), ["doc_id", "place"], "left")
    own = F.struct(F.col("run").alias("run"), F.lit(False).alias("tail"))
    also = F.when(F.col("before").isNotNull(), F.array(own, F.struct(F.col("before").alias("run"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    placed = placed.select("doc_id", "place", "text", F.inline(also).alias("run", "tail"))
    placed = placed.repartition("run").sortWithinPartitions("run", "tail", F.col("doc_id").desc(), F.col("place").desc(), "text")
    return placed.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", "run", "tail")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """One row per row of docs: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is that of the next smaller id (of the largest for the smallest; of equal ids that of the next
    smaller hash of the text; rows without an id come last); the edited text has its last floor(n_chars / 3) code points replaced by
    the first as many of the next. Fingerprints are base64 of the packed bits and "" for a text without words, null
    and empty texts alike. Other columns are not read; an empty table gives no rows; a lone row is its own next.
    """
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            texts = [r[1] for r in rows]
            marks = text_fingerprints(texts, width, bins, bits)
            pick, edited, following = [], [], []
            for i, (_, text, _, tail) in enumerate(rows):
                if tail or i + 1 == len(rows):
                    continue
                after = i + 1  # of the same run: each run ends in a tail
                n = len(text) // 3
                pick.append(i)
                following.append(marks[after])
                edited.append(text[: len(text) - n] + rows[after][1][:n])
            own, changed = [marks[i] for i in pick], text_fingerprints(edited, width, bins, bits)
            write = lambda x: pa.array([base64.b64encode(b).decode() for b in x], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][0] for i in pick], pa.int64()), pa.array([len(texts[i]) for i in pick], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    write(own), write(changed), pa.array(likeness(own, changed, bins, bits), pa.float64()), pa.array(likeness(own, following, bins, bits), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            kept += list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if len(kept) > 1:
                yield from work(kept)
                kept = kept[-1:]
    return map_arrow(in_runs(docs, id_col, text_col).select("doc_id", "text", "run", "tail"), run, kinds)

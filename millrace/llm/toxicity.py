"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence's probability is a logistic function of the summed weights of its words' features (the word, affixes and
character n-grams, hashed); a document's is the noisy-or of its sentences. The weights are trained from document
labels alone, by the gradient of the bags' likelihood, and then locate the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.features import grams, letters, sums, words
from millrace.llm.shared import crc_mod, map_arrow
from millrace.llm.words import chunks

#: Hashed weights, sizes of the n-grams, labelled rows of each class to learn from at most, and steps.
BITS, SIZES = 17, (4, 6)
ROWS, MOST_CHARS = 1500, 200_000
#: Values of the hash that draws them.
SPAN = 1 << 62
STEPS = 160
RATE, SHRINK = 0.2, 0.03
#: Share of toxic texts that training assumes, whatever the sample's.
PRIOR = 0.05
#: Share of the sampled texts in which a feature must occur to get a weight.
SEEN = 0.004
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


@dataclass
class Bags:
    """Words of some texts: the sentence of each word (from 0), the text of each sentence."""

    out: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    span: np.ndarray


def bags(data: np.ndarray, offsets: np.ndarray) -> Bags:
    """Sentences end at [.!?] and line feeds; those without a word are left out."""
    out, at = letters(data, offsets)
    starts, ends = words(out)
    stops = np.cumsum(_STOP[out])
    text = np.searchsorted(at, starts, "right") - 1
    change = np.ones(len(starts), bool)
    change[1:] = (stops[starts][1:] != stops[starts][:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    span = np.stack([starts[first], ends[last]], 1) - (text[first] + 1)[:, None] if len(first) else np.zeros((0, 2), int)
    return Bags(out, starts, ends, np.cumsum(change) - 1, text[first], span)


def noisy_or(z: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """log of the chance that no sentence of each text is toxic."""
    return np.bincount(text, weights=-np.logaddexp(0, z), minlength=n)


def bag_slope(z: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The slope of each bag's negative log-likelihood in the logits of its sentences."""
    none = np.minimum(noisy_or(z, owner, len(y)), -1e-9)  # log of the chance that no sentence is toxic
    down = np.where(y == 1, -np.exp(none) / -np.expm1(none), 1.0)
    return down[owner] / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[str], toxic: list[int], steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(weights, bias) by full-batch Adam on the bags' negative log-likelihood, classes weighed by PRIOR.

    Each step shrinks the weights towards zero, so that features that only a few texts share get none.
    """
    weights, bias = np.zeros(1 << BITS), -5.0
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return weights.astype(np.float32), -5.0 if not y.sum() else 5.0
    parts = [(a, bags(d, o)) for a, _, d, o in chunks(pa.array(texts, pa.string()))]
    ids, rows, sentences, owners = [], [], [], []
    n_types = n_sentences = 0
    known: dict[bytes, int] = {}
    for a, b in parts:  # features once for each distinct word
        names = [b.out[s:e].tobytes() for s, e in zip(b.starts.tolist(), b.ends.tolist(), strict=True)]
        kind = np.fromiter((known.setdefault(x, len(known)) for x in names), np.int64, len(names))
        fresh = np.flatnonzero(kind >= n_types)
        fresh = fresh[np.unique(kind[fresh], return_index=True)[1]]
        lone = np.zeros(len(names), bool)
        lone[fresh] = True
        for f, of in grams(b.out, b.starts, b.ends, SIZES, BITS):
            keep = lone[of]
            ids.append(f[keep])
            rows.append(kind[of[keep]])
        n_types = len(known)
        sentences.append(np.stack([kind, b.sentence + n_sentences], 1))
        owners.append(b.text + a)
        n_sentences += len(b.text)
    ids, rows, owner = np.concatenate(ids), np.concatenate(rows), np.concatenate(owners)
    kind, sentence = np.concatenate(sentences).T
    seen = np.unique(rows * np.int64(1 << BITS) + ids)  # a feature once per distinct word
    held = np.unique(owner[sentence] * np.int64(n_types) + kind)  # a word once per text
    in_texts = np.bincount(held % n_types, minlength=n_types)
    common = np.bincount(seen % (1 << BITS), weights=in_texts[seen >> BITS], minlength=1 << BITS) >= max(3, SEEN * len(y))
    rows, ids = seen >> BITS, seen % (1 << BITS)
    rows, ids = rows[common[ids]], ids[common[ids]]
    used, ids = np.unique(ids, return_inverse=True)
    weigh = np.where(y == 1, PRIOR / y.sum(), (1 - PRIOR) / (len(y) - y.sum()))
    theta = np.zeros(len(used) + 1)
    theta[-1] = bias
    m = v = np.zeros_like(theta)
    for t in range(1, steps + 1):
        value = np.bincount(rows, weights=theta[ids], minlength=n_types)
        z = np.bincount(sentence, weights=value[kind], minlength=n_sentences) + theta[-1]
        slope = bag_slope(z, owner, y) * weigh[owner]
        by_type = np.bincount(kind, weights=slope[sentence], minlength=n_types)
        g = np.append(np.bincount(ids, weights=by_type[rows], minlength=len(used)), slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - RATE * min(1.0, 2 - 2 * t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - SHRINK * min(1.0, 2 - 2 * t / (steps + 1)), 0)
        theta[-1] = min(theta[-1], -1.0)
    weights[used] = theta[:-1]
    return weights.astype(np.float32), float(theta[-1])


def sample(docs: DataFrame, labels: DataFrame, fold: int, of: int, rows: int, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[int]]:
    """Texts and labels of `rows` rows of each class at most, those of the least hashes of their ids, never of the held-out fold.

    Texts of over MOST_CHARS characters are not learned from; of rows that repeat an id one is.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), of) != fold))
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # a hash of 62 bits thins a class out to about twice `rows` at any size; the least of the hashes are the sample
    drawn = F.xxhash64(F.lit("toxicity"), F.col(id_col).cast("string")).bitwiseAND(SPAN - 1)
    bound = {y: int(min(1.0, 2.0 * (rows + 8) / c) * SPAN) for y, c in n.items()}
    picked = known.withColumn("_drawn", drawn).where(F.col("_drawn") <= F.when(F.col("y") == 1, bound.get(1, 0)).otherwise(bound.get(0, 0)))
    picked = picked.withColumn("_r", F.row_number().over(Window.partitionBy("y").orderBy("_drawn", id_col))).where(F.col("_r") <= rows).select(id_col, "y")
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("_h")).where(F.length("text") <= MOST_CHARS)
    got = texts.join(F.broadcast(picked), id_col)  # 2 * rows short rows at most
    got = got.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy("_h", "text"))).where("_r = 1").select(id_col, "text", "y").toPandas()
    got = got.sort_values([id_col, "text"])
    return got["text"].tolist(), got["y"].tolist()


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, sentence, start, end): the noisy-or score, the worst sentence's own and where it stands in UTF-8 bytes."""
    table = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, worst = np.zeros(len(batch)), np.zeros(len(batch))
            place = np.full((len(batch), 2), -1)
            for a, e, data, offsets in chunks(batch.column(1)):
                b = bags(data, offsets)
                z = np.bincount(b.sentence, weights=sums(b.out, b.starts, b.ends, SIZES, table.value), minlength=len(b.text)) + bias
                scores[a:e] = -np.expm1(noisy_or(z, b.text, e - a))
                order = np.lexsort((z, b.text))  # the last of each text is its worst sentence
                last = order[np.flatnonzero(np.diff(b.text[order], append=-1))]
                worst[a + b.text[last]] = 1 / (1 + np.exp(-np.clip(z[last], -500, 500)))
                place[a + b.text[last]] = b.span[last] - offsets[b.text[last]][:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(scores, 0, 1)), pa.array(worst), pa.array(place[:, 0]), pa.array(place[:, 1])], ["doc_id", "score", "sentence", "start", "end"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, score double, sentence double, start long, end long")


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 0, of: int = 5, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of docs: (doc_id, held_out, score, predicted, sentence, start, end).

    Rows whose crc32(id as text) mod `of` is `fold` are held out of training. A text that is null or has no word has
    no sentence: score 0, start and end -1. Labels other than 0 and 1 are not used, of several for an id the largest
    counts; without labels of both classes the score says what the one class says (none: not toxic). Whole texts of
    any length are scored; repeated rows are scored each; other columns are not read; an empty table gives no rows.
    """
    weights, bias = train(*sample(docs, labels, fold, of, rows, id_col, text_col, label_col))
    held = F.coalesce(crc_mod(F.col("doc_id"), of) == fold, F.lit(False))
    return score(docs, weights, bias, id_col, text_col).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentence", "start", "end")

"""Language identification by a linear-chain conditional random field over the words of a text.

Each word has hashed features (lexicon: the word itself; affixes; character n-grams) with a weight for each language,
and transitions between the languages of neighbouring words are learned with them. Forward-backward gives each word
its probabilities, so code-switched texts are labelled word by word; a document's language is the one with the
largest share. Training needs only labelled documents: its sequences are pieced together from stretches of documents
of several languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.features import grams, letters, sums, words
from millrace.llm.shared import BROADCAST_ROWS, crc_mod, cut, map_arrow, tidy
from millrace.llm.words import chunks

#: Hashed weights, sizes of the n-grams; labelled rows to learn from (over all languages), and characters of each at most.
BITS, SIZES = 16, (3, 4)
ROWS, STRETCH = 1200, 50_000
#: Values of the hash that draws them.
SPAN = 1 << 62
#: Training sequences, their words, steps, step size and the weights' decay.
SEQUENCES, LENGTH, STEPS, RATE, DECAY = 3000, 32, 80, 0.3, 1e-5
#: Chance that a stretch of a training sequence ends after a word.
SWITCH = 0.08
#: Words in a block of the forward-backward scan.
BLOCK = 64
#: Numbers that the scan holds at once.
ROOM = 1 << 20
UNKNOWN = "und"


def _words(texts: list[str]) -> tuple[list[np.ndarray], list[bytes], np.ndarray, np.ndarray]:
    """(word types of each text, the types, feature ids, their type)."""
    known: dict[bytes, int] = {}
    out, ids, rows = [], [], []
    for a, e, data, offsets in chunks(pa.array(texts, pa.string())):
        buffer, at = letters(data, offsets)
        starts, ends = words(buffer)
        before = len(known)
        kind = np.fromiter((known.setdefault(buffer[s:t].tobytes(), len(known)) for s, t in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        fresh = np.flatnonzero(kind >= before)
        lone = np.zeros(len(starts), bool)
        lone[fresh[np.unique(kind[fresh], return_index=True)[1]]] = True
        for f, of in grams(buffer, starts, ends, SIZES, BITS):
            ids.append(f[lone[of]])
            rows.append(kind[of[lone[of]]])
        first = np.searchsorted(starts, at)
        out += [kind[first[i] : first[i + 1]] for i in range(e - a)]
    empty = np.zeros(0, np.int64)
    return out, list(known), np.concatenate(ids) if ids else empty, np.concatenate(rows) if rows else empty


def train(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, weights of the features, log transition scores with the start's in the last row)."""
    names = sorted(set(langs))
    k = len(names)
    weights, moves = np.zeros((1 << BITS, max(k, 1)), np.float32), np.zeros((k + 1, k))
    docs, types, ids, rows = _words(texts)
    of = {name: [i for i, x in enumerate(langs) if x == name and len(docs[i])] for name in names}
    names_with = [j for j, name in enumerate(names) if of[name]]
    if k < 2 or len(names_with) < 2:
        return names, weights, moves
    rng = np.random.default_rng(11)
    x, y = np.zeros((SEQUENCES, LENGTH), np.int64), np.zeros((SEQUENCES, LENGTH), np.int64)
    for s in range(SEQUENCES):
        t = 0
        while t < LENGTH:
            lang = names_with[rng.integers(len(names_with))]
            doc = docs[of[names[lang]][rng.integers(len(of[names[lang]]))]]
            at = rng.integers(len(doc))
            part = doc[at : at + min(LENGTH - t, rng.geometric(SWITCH))]
            x[s, t : t + len(part)], y[s, t : t + len(part)] = part, lang
            t += len(part)
    present = np.unique(x)
    keep = np.isin(rows, present)
    rows, ids = np.searchsorted(present, rows[keep]), ids[keep]
    x = np.searchsorted(present, x)
    used, ids = np.unique(ids, return_inverse=True)
    theta, trans = np.zeros((len(used), k)), np.zeros((k + 1, k))
    state = [np.zeros_like(theta), np.zeros_like(trans)]
    some = max(1, (1 << 20) // (LENGTH * k))  # sequences worked on at once
    gold_trans = np.zeros((k + 1, k))
    np.add.at(gold_trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    np.add.at(gold_trans, (np.full(SEQUENCES, k), y[:, 0]), 1)
    for _ in range(STEPS):  # Adagrad on the whole likelihood
        value = np.stack([np.bincount(rows, weights=theta[ids, j], minlength=len(present)) for j in range(k)], 1)
        move, start = np.exp(trans[:k]), np.exp(trans[k])
        slope, h = np.zeros((SEQUENCES * LENGTH, k)), gold_trans.copy()
        for s in range(0, SEQUENCES, some):
            score = value[x[s : s + some]]
            e = np.exp(score - score.max(2, keepdims=True))
            alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.zeros(e.shape[:2])
            alpha[:, 0] = e[:, 0] * start
            for t in range(LENGTH):
                if t:
                    alpha[:, t] = (alpha[:, t - 1] @ move) * e[:, t]
                scale[:, t] = alpha[:, t].sum(1)
                alpha[:, t] /= scale[:, t, None]
            for t in range(LENGTH - 2, -1, -1):
                beta[:, t] = ((beta[:, t + 1] * e[:, t + 1]) @ move.T) / scale[:, t + 1, None]
            chance = alpha * beta
            h[:k] -= np.einsum("nti,ntj->ij", alpha[:, :-1], beta[:, 1:] * e[:, 1:] / scale[:, 1:, None]) * move
            h[k] -= chance[:, 0].sum(0)
            slope[s * LENGTH : (s + some) * LENGTH] = -chance.reshape(-1, k)
        slope[np.arange(len(slope)), y.ravel()] += 1
        by_type = np.stack([np.bincount(x.ravel(), weights=slope[:, j], minlength=len(present)) for j in range(k)], 1)
        g = np.stack([np.bincount(ids, weights=by_type[rows, j], minlength=len(used)) for j in range(k)], 1) / SEQUENCES - DECAY * theta
        for value_, slope_, sum_ in ((theta, g, state[0]), (trans, h / SEQUENCES, state[1])):
            sum_ += slope_ * slope_
            value_ += RATE * slope_ / np.sqrt(sum_ + 1e-8)
    weights[used] = theta
    return names, weights, trans


def _norm(v: np.ndarray) -> np.ndarray:
    return v / v.sum(1, keepdims=True)


class _Part:
    """Blocks lo:hi of some sequences: their words' potentials and transfer matrices; a run is what it holds of one sequence."""

    __slots__ = ("lo", "hi", "words", "at", "e", "real", "opens", "widest", "run0", "size", "transfer")

    def __init__(self, lo: int, hi: int, score: np.ndarray, inner: np.ndarray, block: np.ndarray, block0: np.ndarray, owner: np.ndarray, move: np.ndarray, start: np.ndarray) -> None:
        k = score.shape[1]
        self.lo, self.hi = lo, hi
        self.words = slice(*np.searchsorted(block, [lo, hi]))
        self.at = (inner[self.words] % BLOCK, block[self.words] - lo)
        self.widest = int(self.at[0].max()) + 1
        self.e, self.real = np.ones((self.widest, hi - lo, k)), np.zeros((self.widest, hi - lo), bool)
        own = score[self.words]
        self.e[self.at], self.real[self.at] = np.exp(own - own.max(1, keepdims=True)), True
        self.opens = block0[owner[lo:hi]] == np.arange(lo, hi)
        self.run0 = np.flatnonzero(np.diff(owner[lo:hi], prepend=-1))
        self.size = np.diff(self.run0, append=hi - lo)
        self.transfer = np.broadcast_to(np.eye(k), (hi - lo, k, k)).copy()
        for t in range(self.widest):
            grown = (self.transfer.reshape(-1, k) @ move).reshape(hi - lo, k, k) * self.e[t][:, None, :]
            if t == 0:  # a text's first word has a start score, not a move
                grown[self.opens] = np.broadcast_to((start * self.e[0][self.opens])[:, None, :], (int(self.opens.sum()), k, k))
            grown /= grown.sum((1, 2), keepdims=True)
            self.transfer = np.where(self.real[t][:, None, None], grown, self.transfer)

    def forward(self, into: np.ndarray, goes_on: bool) -> None:
        for j in range(1, int(self.size.max())):
            b = self.run0[self.size > j] + j
            into[b + self.lo] = _norm(np.einsum("ni,nij->nj", into[b + self.lo - 1], self.transfer[b - 1]))
        if goes_on:
            into[self.hi] = _norm((into[self.hi - 1] @ self.transfer[-1])[None])[0]

    def backward(self, out_of: np.ndarray, goes_on: bool) -> None:
        last = self.run0 + self.size - 1
        for j in range(1, int(self.size.max())):
            b = last[self.size > j] - j
            out_of[b + self.lo] = _norm(np.einsum("nij,nj->ni", self.transfer[b + 1], out_of[b + self.lo + 1]))
        if goes_on:
            out_of[self.lo - 1] = _norm((self.transfer[0] @ out_of[self.lo])[None])[0]

    def within(self, into: np.ndarray, out_of: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
        alpha, now = np.zeros_like(self.e), into[self.lo : self.hi]
        for t in range(self.widest):
            v = (now @ move) * self.e[t]
            if t == 0:
                v[self.opens] = start * self.e[0][self.opens]
            alpha[t] = now = np.where(self.real[t][:, None], _norm(v), now)
        now = out_of[self.lo : self.hi]
        for t in range(self.widest - 1, -1, -1):
            alpha[t] *= now
            now = np.where(self.real[t][:, None], _norm((now * self.e[t]) @ move.T), now)
        return _norm(alpha[self.at])


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray, room: int = ROOM) -> np.ndarray:
    """Each word's probabilities: forward-backward over sequences first[i]:first[i + 1] of the words' scores.

    Sequences are cut into blocks of BLOCK words. A block's transfer matrix is made for many blocks at once, a scan
    over blocks gives the vectors at their edges, and the words within follow, again for many blocks at once: as many
    as `room` numbers hold, so that neither long texts nor many languages need more memory.
    """
    k, n = score.shape[1], len(score)
    chance = np.zeros((n, k))
    if not n:
        return chance
    lengths = np.diff(first)
    per = -(-lengths // BLOCK)
    block0 = np.concatenate([[0], np.cumsum(per)])
    nb = int(block0[-1])
    seq = np.repeat(np.arange(len(lengths)), lengths)
    inner = np.arange(n) - first[seq]
    block = block0[seq] + inner // BLOCK
    owner = np.repeat(np.arange(len(per)), per)  # the sequence of each block
    move, start = np.exp(trans[:k] - trans[:k].max()), np.exp(trans[k] - trans[k].max())
    into, out_of = np.full((nb, k), 1.0 / k), np.full((nb, k), 1.0 / k)
    make = lambda lo, hi: _Part(lo, hi, score, inner, block, block0, owner, move, start)
    step = max(1, room // (k * (2 * k + 2 * BLOCK)))
    parts = [(lo, min(nb, lo + step)) for lo in range(0, nb, step)]
    for lo, hi in parts:
        part = make(lo, hi)
        part.forward(into, hi < nb and owner[hi] == owner[hi - 1])
    for lo, hi in reversed(parts):
        part = part if part.lo == lo else make(lo, hi)
        part.backward(out_of, lo > 0 and owner[lo] == owner[lo - 1])
        chance[part.words] = part.within(into, out_of, move, start)
    return chance


def sample(docs: DataFrame, training: Column, rows: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[str]]:
    """Texts and languages of rows / languages labelled rows (4 at least) of each language: those of the least hashes of their ids.

    A hash of 62 bits first thins a language out to about twice as many, at any number of rows; the exact number is
    cut among what is left. Of a text a stretch of STRETCH characters at a place drawn by the hash is taken.
    """
    known = docs.where(training & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    n = known.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_n"))
    n = cut(n)  # a row for each language
    count = n.count()
    if not count:
        return [], []
    each = max(4, rows // count)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    drawn = F.xxhash64(F.lit("language"), F.col(id_col).cast("string")).bitwiseAND(SPAN - 1)
    place = F.pmod(F.xxhash64(F.lit("stretch"), F.col(id_col).cast("string")), F.greatest(F.lit(1).cast("long"), F.length(text) - (STRETCH - 1)))
    keep = F.col("_drawn") < F.floor(F.least(F.lit(1.0), 2.0 * (each + 8) / F.col("_n")) * F.lit(float(SPAN)))
    picked = known.select(F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"), drawn.alias("_drawn"), text.substr(place.cast("int") + 1, F.lit(STRETCH)).alias("_text"))
    picked = picked.join(F.broadcast(n) if count <= BROADCAST_ROWS else n, "_lang").where(keep)
    first = Window.partitionBy("_lang").orderBy("_drawn", "_id", "_text")
    got = picked.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= each).select("_lang", "_id", "_text").toPandas().sort_values(["_id", "_text", "_lang"])
    return got["_text"].tolist(), got["_lang"].tolist()


def learn(docs: DataFrame, fold: int = 1, of: int = 3, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """A model for label(), from rows with a language whose crc32(id as text) mod `of` is not `fold`."""
    model = train(*sample(docs, F.coalesce(crc_mod(F.col(id_col), of) != fold, F.lit(False)), rows, id_col, text_col, lang_col))
    tidy(docs.sparkSession)
    return model


def label(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_words, shares): shares is the expected share of words of each language.

    n_words counts runs of letters; it is 0 if there is no letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, trans = shared.value
        for batch in batches:
            counts, total = np.zeros(len(batch), np.int64), np.zeros((len(batch), max(1, len(names))))
            for a, e, data, offsets in chunks(batch.column(1)):
                buffer, at = letters(data, offsets)
                starts, ends = words(buffer)
                first = np.searchsorted(starts, at)
                counts[a:e] = np.diff(first)
                ascii_letters = np.concatenate([[0], np.cumsum((buffer >= 97) & (buffer <= 122))])
                for i in np.flatnonzero((np.diff(first) > 0) & (ascii_letters[at[1:]] == ascii_letters[at[:-1]])):  # non-ASCII words may be marks without a letter
                    if not any(c.isalpha() for c in set(buffer[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))):
                        counts[a + i] = 0
                if names:
                    chance = marginals(sums(buffer, starts, ends, SIZES, weights), first, trans)
                    seq = np.repeat(np.arange(e - a), np.diff(first))
                    for j in range(len(names)):
                        total[a:e, j] = np.bincount(seq, weights=chance[:, j], minlength=e - a)
            told = (counts > 0) & bool(names)
            share = np.where(told[:, None], total / np.maximum(total.sum(1, keepdims=True), 1e-12), 0.0)
            best = share.argmax(1)
            pred = [names[j] if t else UNKNOWN for j, t in zip(best.tolist(), told.tolist(), strict=True)]
            shares = pa.array([list(zip(names, r, strict=True)) if t else [] for r, t in zip(share.tolist(), told.tolist(), strict=True)], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.clip(share.max(1), 0, 1)), pa.array(counts), shares], ["doc_id", "lang_pred", "score", "n_words", "shares"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, lang_pred string, score double, n_words long, shares map<string,double>")


def identify(docs: DataFrame, fold: int = 1, of: int = 3, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: (doc_id, held_out, lang_pred, score, n_words, shares).

    The model learns from rows with a language whose crc32(id as text) mod `of` is not `fold`, and knows each language
    that they have; it takes 256 KB for a language. lang_pred is `und` with score 0 if the text is null or has no
    letters, or if nothing can be learned. Among equal shares the first language by name wins. Texts of any length are
    labelled whole; repeated rows each; other columns are not read; an empty table gives no rows.
    """
    model = learn(docs, fold, of, rows, id_col, text_col, lang_col)
    held = F.coalesce(crc_mod(F.col("doc_id"), of) == fold, F.lit(False))
    return label(docs, model, id_col, text_col).select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_words", "shares")

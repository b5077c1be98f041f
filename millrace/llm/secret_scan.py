"""Secrets in whole texts: fixed patterns, and strings that a battery of randomness tests tells from natural ones.

A candidate is a maximal run of [A-Za-z0-9+/=_-] of at least `SHORTEST` characters that mixes character classes or
has at least `LONG` characters; so is each part of a run between inner =, and, where a part mixes the symbols of two
alphabets, each part of it without the one pair, the other or both. Its encoding is inferred from the classes that
occur. For that encoding's alphabet
the battery takes the chi-squared statistic of uniformity, the runs of one class and the correlation of neighbours.
Against chance each has a z score; a candidate that is far from random in sum is left alone. Against natural text
(letters of uneven frequency, classes that rarely change, vowels and other letters that take turns) each of the three
has a p-value, which falls with the length of the candidate; they are combined by Fisher's method and held to a false-discovery rate by Benjamini and Hochberg
within bands of length, over all candidates of the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import cut, map_arrow
from millrace.llm.words import chunks, spans

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
SHORTEST_VALUE, SHORTEST_ACCESS, SHORTEST_HEX = 6, 20, 24
SHORTEST, LONG = 16, 32
#: False-discovery rate, and the least chance of the battery under randomness.
RATE, LEAST = 0.01, 1e-3
#: Of natural strings: the chance that two letters are the same, and that the class changes from one character to the next.
SAME_LETTER, CHANGE = 0.062, 0.15
#: Of natural strings: the chance that a vowel and another letter stand side by side; pairs of letters that are needed to test it.
TURN, PAIRS = 0.6, 8
#: Bands of length by powers of two, and bins of -log10 p.
BANDS, BINS, BIN = 12, 400, 0.25

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")] = True
_CLASS = np.zeros(256, np.int8)
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[list(b"+/=_-")] = 4
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouAEIOU")] = True
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token without its padding; None for digits alone or mixed symbols."""
    body = set(token.rstrip("="))
    if not body or body <= set("0123456789"):
        return None
    return next((name for name, letters in _ALPHABETS.items() if body <= set(letters)), None)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[float, float]:
    """(p under natural text, p under randomness): a secret has a small first and no small second."""
    name = encoding(token)
    if name is None:
        return 1.0, 0.0
    letters, body = _ALPHABETS[name], token.rstrip("=")
    n, a = len(body), len(_ALPHABETS[name])
    if n < 2:  # padding only: no neighbours to test
        return 1.0, 0.0
    at = np.array([letters.index(c) for c in body])
    counts = np.bincount(at, minlength=a)
    chi = float((counts.astype(float) ** 2).sum()) * a / n - n
    z_chi = (chi - (a - 1)) / math.sqrt(2 * (a - 1) * (n - 1) / n)
    away = (n - 1) * max(0.0, a * max(SAME_LETTER, 1.3 / a) - 1)
    p_chi = _upper_tail(-(chi - (a - 1 + away)) / math.sqrt(2 * (a - 1) + 4 * away))

    kinds = _CLASS[np.frombuffer(body.encode(), np.uint8)]
    share = np.bincount(_CLASS[np.frombuffer(letters.encode(), np.uint8)], minlength=5) / a
    change = 1 - float((share**2).sum())
    changes = int((kinds[1:] != kinds[:-1]).sum())
    z_runs, p_runs = 0.0, 1.0
    if change > 0:
        z_runs = (changes - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change))
        p_runs = _upper_tail((changes - 0.5 - (n - 1) * CHANGE) / math.sqrt((n - 1) * CHANGE * (1 - CHANGE)))

    spread = at - (a - 1) / 2
    serial = float((spread[1:] * spread[:-1]).sum()) / ((n - 1) * (a * a - 1) / 12)
    z_serial = serial * math.sqrt(n - 1)
    x = z_chi**2 + z_runs**2 + z_serial**2
    p_random = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)  # chi-squared, 3 degrees
    half = -math.log(max(p_chi, 1e-300)) - math.log(max(p_runs, 1e-300))
    p_natural = math.exp(-half) * (1 + half)  # chi-squared, 4 degrees
    letter = kinds < 3
    pair = letter[1:] & letter[:-1]
    if (m := int(pair.sum())) >= PAIRS:  # vowels and others take turns in words, not by chance
        vowel = _VOWEL[np.frombuffer(body.encode(), np.uint8)]
        turns = int((vowel[1:] != vowel[:-1])[pair].sum())
        p_serial = _upper_tail(-(turns + 0.5 - m * TURN) / math.sqrt(m * TURN * (1 - TURN)))
        half -= math.log(max(p_serial, 1e-300))
        p_natural = math.exp(-half) * (1 + half + half * half / 2)  # chi-squared, 6 degrees
    return p_natural, p_random


def base_spans(text: str, has_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of the fixed patterns in code points, by start, then kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= SHORTEST_ACCESS]
    if has_hex:
        out += [(m.start(), m.end(), 2) for m in re.finditer(f"[0-9a-f]{{{SHORTEST_HEX},}}", text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def parts(token: str) -> list[tuple[int, int]]:
    """(start, end) of what is tested of a run: its parts between inner =, those of mixed symbols cut at symbols.

    Only the last part keeps its padding. A mixed part is cut at +/, at -_ and at all four, as either pair may belong
    to a secret.
    """
    found = []
    for m in re.finditer(r"[^=]+(?:=+\Z)?", token):
        cuts = [m.span()]
        if set(m[0]) & set("+/") and set(m[0]) & set("-_"):
            cuts = sorted({(m.start() + x.start(), m.start() + x.end()) for inside in (r"[^+/]+", r"[^-_]+", r"[^-_+/]+") for x in re.finditer(inside, m[0])})
        found += [(s, e) for s, e in cuts if e - s >= SHORTEST]
    return [(s, e) for s, e in found if e - s >= LONG or len(set(_CLASS[np.frombuffer(token[s:e].encode(), np.uint8)].tolist())) > 1]


def _candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, _ = spans(data, offsets, _RUN)
    size = ends - starts
    starts, ends, size = starts[size >= SHORTEST], ends[size >= SHORTEST], size[size >= SHORTEST]
    kinds = _CLASS[data]
    changed = np.concatenate([[0], np.cumsum(kinds[1:] != kinds[:-1])]) if len(data) else np.zeros(0, int)
    good = (size >= LONG) | (changed[ends - 1] > changed[starts]) if len(starts) else np.zeros(0, bool)
    return starts[good], ends[good], np.searchsorted(offsets, starts[good], "right") - 1


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
_TEST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("band", pa.int32()), ("bin", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base: list[list[dict]] = [[] for _ in range(len(batch))]
        tests: list[list[dict]] = [[] for _ in range(len(batch))]
        for at, end, data, offsets in chunks(batch.column(1)):
            texts = batch.column(1).slice(at, end - at).to_pylist()
            starts, ends, _ = spans(data, offsets, _HEX)
            hexes = set((np.searchsorted(offsets, starts[ends - starts >= SHORTEST_HEX], "right") - 1).tolist())
            for i, text in enumerate(texts):
                if text:
                    base[at + i] = [{"start": s, "end": e, "kind": k} for s, e, k in base_spans(text, i in hexes)]
            for s, e, i in zip(*(x.tolist() for x in _candidates(data, offsets)), strict=True):
                token = data[s:e].tobytes().decode()
                first = len(data[offsets[i] : s].tobytes().decode("utf-8", "replace"))
                for u, v in parts(token):
                    p, chance = battery(token[u:v])
                    score = min(BINS - 1, int(-math.log10(max(p, 1e-300)) / BIN)) if chance >= LEAST else -1
                    tests[at + i].append({"start": first + u, "end": first + v, "band": min(BANDS - 1, (v - u).bit_length()), "bin": score})
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPAN), pa.array(tests, _TEST)], ["doc_id", "base", "tests"])


def discovered(tests: DataFrame, rate: float) -> dict[int, int]:
    """For each band the least bin that the Benjamini-Hochberg rule accepts; from BANDS x BINS counts at most."""
    counts = np.zeros((BANDS, BINS + 1), np.int64)
    for r in tests.select(F.explode("tests").alias("t")).groupBy("t.band", "t.bin").count().collect():
        counts[r["band"], r["bin"] + 1] = r["count"]
    out = {}
    for band in range(BANDS):
        found = counts[band, 1:][::-1].cumsum()[::-1]
        good = [b for b in range(1, BINS) if found[b] and 10 ** (-b * BIN) <= rate * found[b] / counts[band].sum()]
        if good:
            out[band] = min(good)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row of docs: (doc_id, spans), spans an array of (start, end, kind) by start, then kind as in KINDS.

    Offsets are code points, the end is exclusive. Spans of the fixed patterns always stay; a random string is added
    unless it lies within one of them or within a longer random string. A null or empty text has none; long texts are read whole; repeated rows are
    scanned each; other columns are not read; an empty table gives no rows.
    """
    kinds = "doc_id long, base array<struct<start:long,end:long,kind:int>>, tests array<struct<start:long,end:long,band:int,bin:int>>"
    seen = cut(map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), _scan, kinds))
    least = discovered(seen, rate)
    limits = F.array(*(F.lit(least.get(b, BINS + 1)) for b in range(BANDS)))
    hit = F.filter("tests", lambda t: (t["bin"] >= F.element_at(limits, t["band"] + 1)) & ~F.exists("base", lambda b: (b["start"] <= t["start"]) & (b["end"] >= t["end"])))
    hit = F.filter(hit, lambda t: ~F.exists(hit, lambda o: (o["start"] <= t["start"]) & (o["end"] >= t["end"]) & (o["end"] - o["start"] > t["end"] - t["start"])))
    more = F.transform(hit, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(3).alias("kind")))
    ordered = F.array_sort(F.transform(F.concat("base", more), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return seen.select("doc_id", F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"))).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """The columns of the op7 query from scan()."""
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(write(base).cast("binary"), 256).alias("base_sha256"), write(F.col("spans")).alias("spans"))

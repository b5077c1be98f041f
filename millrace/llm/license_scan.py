"""License scans with ordered signature rules, in DataFrame operations only.

Rules are regular expressions over the text's words joined by single blanks. A rule runs only if the words hold one
of its keywords, which are derived from its spellings so that every match has one. Detections are word intervals; one
that lies within another of higher priority (or within a longer one of the same priority) is suppressed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import cache, reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII characters and what they become: A-Z is lower-cased, all but letters and digits are blanks between words.
_PLAIN = "".join(map(chr, range(128))), "".join(c.lower() if c.isalnum() else " " for c in map(chr, range(128)))
#: Marks around a match, which no word holds.
OPEN, SHUT = "\x01", "\x02"
#: (words of a phrase, label)
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Words of everyday prose, which a rule is only gated by if it has no other.
PLAIN = frozenset(
    "all and any anyone are available basis charge code conditions copy document either everyone fee file following for forms free from has hereby hold in information is it kind law license link name "
    "new no not notice of on or original other out person place placed please program public published purpose related released right rights same share state terms the this to two three four under use used version with without work works you your".split()
)
#: Detections that are compared with each other at once; earlier ones only as far as they reach.
RUN = 256

#: Stands for what a repeated dot matches.
GAP = "\0"

# Label, name as a pattern over lower-case words, words of its identifier.
NAMES = (
    ("mit", "mit", "mit"),
    ("mit-0", "mit no attribution|mit 0", "mit 0"),
    ("x11", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("apache-1.1", "apache(?: software)? license(?: version| v)? 1 1", "apache 1 1"),
    ("apache-2.0", "apache(?: software)? license(?: version| v)? ?2(?: 0)?|apache(?: version)? 2(?: 0)?", "apache 2 0"),
    ("apache", "apache(?: software)?", "apache"),
    ("gpl-1.0", "(?:gnu )?general public license(?: version| v)? 1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "(?:gnu )?general public license(?: version| v)? 2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "(?:gnu )?general public license(?: version| v)? 3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "(?:gnu )?gpl(?: ?v?[123](?: 0)?)?", "gpl"),
    ("lgpl-2.1", "(?:gnu )?lesser general public license(?: version| v)? 2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "(?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?", "lgpl"),
    ("agpl-3.0", "(?:gnu )?affero general public license(?: version| v)? 3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "(?:gnu )?agpl(?: ?v?3(?: 0)?)?", "agpl"),
    ("gfdl", "(?:gnu )?free documentation", "gfdl 1 [123]"),
    ("bsd-2-clause", "(?:2|two|simplified|freebsd)(?: clause)? bsd|bsd 2 clause", "bsd 2 clause"),
    ("bsd-3-clause", "(?:3|three|new|modified|revised)(?: clause)? bsd|bsd 3 clause", "bsd 3 clause"),
    ("bsd-4-clause", "(?:4|four|original)(?: clause)? bsd|bsd 4 clause", "bsd 4 clause"),
    ("bsd", "bsd(?: style)?", "bsd"),
    ("0bsd", "0bsd|zero clause bsd", "0bsd"),
    ("mpl-1.1", "mozilla public license(?: version| v)? 1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla public license(?: version| v)? 2(?: 0)?", "mpl 2 0"),
    ("mpl", "mpl(?: ?v?[12](?: [01])?)?", "mpl"),
    ("epl-1.0", "eclipse public license(?: version| v)? 1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse public license(?: version| v)? 2(?: 0)?", "epl 2 0"),
    ("edl-1.0", "eclipse distribution license(?: version| v)? 1(?: 0)?", "edl 1 0"),
    ("cddl", "cddl(?: 1 [01])?|common development and distribution", "cddl 1 [01]"),
    ("cpl-1.0", "common public license(?: version| v)? 1(?: 0)?", "cpl 1 0"),
    ("eupl", "eupl(?: ?v?1 [0-2])?|european union public", "eupl 1 [0-2]"),
    ("artistic-2.0", "artistic license(?: version| v)? 2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", "artistic 1 0"),
    ("bsl-1.0", "boost software(?: license)?(?: version| v)?(?: 1 0)?", "bsl 1 0"),
    ("busl-1.1", "business source", "busl 1 1"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
    ("unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("psf-2.0", "python software foundation|python", "psf 2 0"),
    ("ofl-1.1", "(?:sil )?open font", "ofl 1 1"),
    ("odbl-1.0", "open database|open data commons", "odbl 1 0"),
    ("postgresql", "postgresql", "postgresql"),
    ("ms-pl", "microsoft public", "ms pl"),
    ("osl-3.0", "open software license(?: version| v)? 3(?: 0)?", "osl 3 0"),
    ("cc0-1.0", "cc0(?: 1 0)?", "cc0 1 0"),
    ("cc-by-4.0", "cc by 4 0|cc by", "cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa(?: 4 0)?", "cc by sa 4 0"),
    ("cc-by-nd-4.0", "cc by nd(?: 4 0)?", "cc by nd 4 0"),
    ("cc-by-nc-4.0", "cc by nc(?: 4 0)?", "cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa(?: 4 0)?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd(?: 4 0)?", "cc by nc nd 4 0"),
    ("cc-by", "creative commons attribution", "cc by [123] [05]"),
    ("cc-by-sa", "creative commons attribution share ?alike", "cc by sa [123] [05]"),
    ("cc-by-nc", "creative commons attribution non ?commercial", "cc by nc [123] [05]"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative|ative work|ative works|atives|s)", "cc by nd [123] [05]"),
)
# How a license is named; priority, confidence, pattern around the name.
FORMS = (
    (50, 1.0, "spdx license identifier {tag}"),
    (40, 0.95, "licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[sc]e)?"),
    (40, 0.95, "released under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[sc]e)?"),
    (35, 0.9, "(?:distributed|available|provided|published|covered|governed) (?:under|by) (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[sc]e)?"),
    (20, 0.7, "(?:{name}) licen[sc]e"),
)
# Label, priority, confidence, passage of the license's own text.
PASSAGES = (
    ("mit", 60, 1.0, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 60, 1.0, "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 60, 0.9, "redistributions? of source code must retain the above copyright notice"),
    ("bsd-3-clause", 62, 1.0, "neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 62, 1.0, "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", 60, 1.0, "you may not use this file except in compliance with the license"),
    ("gpl", 60, 1.0, "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 61, 1.0, "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", 61, 1.0, "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2.0", 60, 1.0, "subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("epl-2.0", 60, 0.9, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("unlicense", 60, 1.0, "free and unencumbered software released into the public domain"),
    ("public-domain", 30, 0.8, "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("zlib", 60, 0.9, "the origin of this software must not be misrepresented"),
    ("bsl-1.0", 60, 1.0, "distributed under the boost software license version 1 0"),
    ("proprietary", 30, 0.6, "proprietary and confidential"),
    ("all-rights-reserved", 10, 0.5, "copyright .{0,60}all rights reserved"),
    ("no-warranty", 5, 0.4, "without warranty of any kind express or implied"),
    ("mit", 60, 0.95, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 55, 0.8, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit-0", 61, 0.9, "permission is hereby granted free of charge to any person obtaining a copy .{1,400}to do so the software is provided as is"),
    ("x11", 62, 1.0, "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", 60, 0.9, "in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("bsd", 60, 0.9, "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("bsd", 60, 0.9, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 55, 0.8, "this software is provided by the (?:copyright holders?|authors?|regents) and contributors as is"),
    ("bsd-4-clause", 62, 1.0, "this product includes software developed by"),
    ("apache-2.0", 60, 1.0, "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", 60, 0.95, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 60, 0.95, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-1.1", 61, 0.95, "the end user documentation included with the redistribution if any must include the following acknowledgment"),
    ("gpl", 60, 0.9, "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", 60, 0.9, "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", 61, 1.0, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", 61, 1.0, "either version 2 of the license or at your option any later version"),
    ("gpl-3.0", 61, 1.0, "either version 3 of the license or at your option any later version"),
    ("lgpl", 61, 0.9, "you should have received a copy of the gnu lesser general public license"),
    ("lgpl", 61, 0.9, "this library is free software you can redistribute it and or modify it"),
    ("agpl", 61, 0.9, "you should have received a copy of the gnu affero general public license"),
    ("agpl", 61, 0.95, "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", 60, 1.0, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 60, 0.9, "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-1.1", 60, 1.0, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", 60, 0.95, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", 60, 0.9, "this source code form is incompatible with secondary licenses"),
    ("epl-1.0", 60, 1.0, "the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-2.0", 61, 0.95, "this source code may also be made available under the following secondary licenses"),
    ("cddl", 60, 0.95, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", 60, 0.95, "the accompanying program is provided under the terms of this common public license"),
    ("eupl", 60, 0.95, "licensed under the eupl version 1 [12]"),
    ("artistic", 60, 0.9, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", 60, 0.9, "this license establishes the terms under which a given free software package may be copied modified distributed"),
    ("bsl-1.0", 60, 0.95, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("busl-1.1", 60, 0.95, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("zlib", 60, 0.95, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 60, 0.9, "this notice may not be removed or altered from any source distribution"),
    ("unlicense", 60, 0.95, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 60, 0.9, "for more information please refer to https? unlicense org"),
    ("wtfpl", 60, 1.0, "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("psf-2.0", 60, 0.95, "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("ofl-1.1", 60, 0.95, "this font software is licensed under the sil open font license"),
    ("ofl-1.1", 60, 0.9, "the fonts? and derivatives however cannot be released under any other type of license"),
    ("odbl-1.0", 60, 0.95, "made available under the open database license"),
    ("odbl-1.0", 60, 0.9, "any rights in individual contents of the database are licensed under"),
    ("postgresql", 61, 0.95, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ms-pl", 60, 0.95, "this license governs use of the accompanying software if you use the software you accept this license"),
    ("osl-3.0", 60, 0.95, "licensed under the open software license version 3 0"),
    ("cc0-1.0", 60, 0.95, "to the extent possible under law .{1,120} has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 60, 0.9, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", 55, 0.8, "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", 56, 0.8, "you may not use the material for commercial purposes"),
    ("cc-by-sa", 56, 0.8, "you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", 56, 0.8, "if you remix transform or build upon the material you may not distribute the modified material"),
    ("public-domain", 30, 0.8, "this (?:work|file|code|software) is in the public domain"),
    ("public-domain", 30, 0.7, "the authors? disclaims? copyright to this source code"),
    ("proprietary", 30, 0.7, "unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|program) .{0,60}is strictly prohibited"),
    ("proprietary", 30, 0.6, "this (?:software|document|file) (?:is|contains) (?:the )?(?:confidential|proprietary) (?:and proprietary )?(?:information|property) of"),
    ("proprietary", 30, 0.6, "may not be (?:copied|reproduced|distributed|disclosed) without (?:the )?(?:prior |express )?written (?:consent|permission)"),
    ("non-commercial", 30, 0.6, "free for (?:non ?commercial|personal|academic|educational) use(?: only)?"),
    ("non-commercial", 30, 0.6, "for research (?:purposes|use) only"),
    ("all-rights-reserved", 10, 0.5, "all rights reserved"),
    ("no-warranty", 5, 0.4, "in no event shall the (?:authors?|copyright holders?|contributors?) .{0,60}be liable"),
)


def rules() -> list[tuple[str, int, float, str]]:
    """(label, priority, confidence, pattern), ordered: each name in each form, then the passages.

    A name that says "license" itself needs no such word after it. A later name in NAMES of the same priority loses to a longer match only; of equal intervals the first label by
    name stays.
    """
    whole = lambda form, name: form.replace("(?:{name}) licen[sc]e", "(?:{name})(?: licen[sc]e)?") if " license" in name else form
    named = [(label, priority, confidence, whole(form, name).format(name=name, tag=tag)) for label, name, tag in NAMES for priority, confidence, form in FORMS]
    return [*named, *PASSAGES]


def spellings(pattern: str) -> list[str]:
    """All texts that a rule's pattern matches, with GAP for a repeated dot."""

    def either(i: int) -> tuple[list[str], int]:
        out, i = row(i)
        while pattern[i : i + 1] == "|":
            more, i = row(i + 1)
            out += more
        return out, i

    def row(i: int) -> tuple[list[str], int]:
        out = [""]
        while i < len(pattern) and pattern[i] not in "|)":
            if pattern.startswith("(?:", i):
                part, i = either(i + 3)
                i += 1
            elif pattern[i] == "[":
                end = pattern.index("]", i) + 1
                part, i = re.findall(pattern[i:end], "0123456789abcdefghijklmnopqrstuvwxyz"), end
            elif pattern[i] == ".":
                part, i = [GAP], pattern.index("}", i) + 1
            else:
                part, i = [pattern[i]], i + 1
            if pattern[i : i + 1] == "?":
                part, i = ["", *part], i + 1
            out = [a + b for a in out for b in part]
        return out, i

    return list(dict.fromkeys(either(0)[0]))


@cache
def keywords() -> list[list[str]]:
    """For each rule words of which every text that it matches holds one: of each spelling the word that fewest rules have.

    A word beside a gap may be longer in a text, so it does not count.
    """
    split = [[[w for w in x.split(" ") if GAP not in w] for x in spellings(r[-1])] for r in rules()]
    common = Counter(w for rule in split for w in {w for x in rule for w in x})
    weight = lambda w: (common[w] + (1000 if len(w) < 3 or w in PLAIN else 0), -len(w), w)
    return [sorted({min(x, key=weight) for x in rule}) for rule in split]


def _barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often later lambdas read them (a projection would be inlined)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _stands(words: Column, parts: list[str]) -> Callable[[Column], Column]:
    """Whether the parts stand at place i (from 1) of the words."""
    return lambda i: reduce(and_, [F.element_at(words, i + j) == p for j, p in enumerate(parts)])


_NONE = "array<struct<label:string,start:bigint,end:bigint,priority:int,score:double>>"


def _found(words: str, norm: str) -> Column:
    """(label, priority, score, marked) of the rules that match: the text with each match between OPEN and SHUT.

    Rules of the same keywords share a gate. Patterns are literals, so each is compiled once.
    """
    groups: dict[tuple[str, ...], list[Column]] = {}
    for (label, n, c, pattern), gate in zip(rules(), keywords(), strict=True):
        marked = F.regexp_replace(norm, F.lit(f"(?<![^ ])(?:{pattern})(?![^ ])"), F.lit(f"{OPEN}$0{SHUT}"))
        groups.setdefault(tuple(gate), []).append(F.struct(F.lit(label).alias("label"), F.lit(n).alias("priority"), F.lit(c).alias("score"), marked.alias("marked")))
    kind = "array<struct<label:string,priority:int,score:double,marked:string>>"
    gates = {gate: reduce(or_, [F.array_contains(words, w) for w in gate]) for gate in groups}
    runs = F.concat(*[F.when(gates[gate], F.array(*some)).otherwise(F.array().cast(kind)) for gate, some in groups.items()])
    return F.filter(runs, lambda r: F.contains(r["marked"], F.lit(OPEN)))


def _intervals(run: Column) -> Column:
    """The word intervals of a rule's matches, in one pass over the marked text's words."""
    at = lambda test: F.transform(F.filter(F.transform(F.split(run["marked"], " "), lambda w, i: F.when(test(w), i.cast("long"))), lambda i: i.isNotNull()), lambda i: i)
    both = F.arrays_zip(at(lambda w: F.startswith(w, F.lit(OPEN))).alias("start"), at(lambda w: F.endswith(w, F.lit(SHUT))).alias("last"))
    return F.transform(both, lambda b: F.struct(run["label"].alias("label"), b["start"].alias("start"), (b["last"] + 1).alias("end"), run["priority"].alias("priority"), run["score"].alias("score")))


def _stay(seen: str) -> Column:
    """The detections that none of a higher priority (or longer ones of the same) contains.

    They are sorted by start and taken in runs of RUN. One that contains another starts no later, so it is in the same
    run, or in an earlier one and reaches into this: only those are compared.
    """
    run = F.transform(F.sequence(F.lit(0), (F.size(seen) - 1).cast("int"), F.lit(RUN)), lambda k: F.struct(F.slice(seen, k + 1, F.lit(RUN)).alias("own"), F.filter(F.slice(seen, F.lit(1), k), lambda e: e["end"] > F.element_at(seen, k + 1)["start"]).alias("before")))

    def beats(e: Column, d: Column) -> Column:
        longer = (e["end"] - e["start"]) > (d["end"] - d["start"])
        same = ((e["end"] - e["start"]) == (d["end"] - d["start"])) & (e["label"] < d["label"])
        return (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & ((e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (longer | same)))

    left = lambda r: F.filter(r["own"], lambda d: ~F.exists(r["own"], lambda e: beats(e, d)) & ~F.exists(r["before"], lambda e: beats(e, d)))
    return F.when(F.size(seen) > 0, F.flatten(F.transform(run, left))).otherwise(F.array().cast(_NONE))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """One row per row of docs: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections).

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z is lower-cased. Base places are all places where a phrase's
    words stand consecutively, counted in words from 0. detections is an array of (label, start, end, priority, score)
    of the rules that were not suppressed, in words, end exclusive, by start. labels are the base labels and theirs;
    score is the largest confidence, 0.9 for a base phrase. A null text is empty; texts of any length are read whole;
    repeated rows are scanned each; other columns are not read; an empty table gives no rows.
    """
    known = F.array(*map(F.lit, sorted({w for words in keywords() for w in words})))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    df = _barrier(df, words=F.array_remove(F.split(F.translate("text", *_PLAIN), " "), "")).drop("text")
    words = F.col("words")
    places = []
    for phrase, label in base:
        parts = phrase.split()
        starts = F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(1), F.size(words) - (len(parts) - 1)), _stands(words, parts))).otherwise(F.array().cast("array<int>"))
        places.append(F.struct(F.lit(label).alias("label"), F.when(F.array_contains(words, parts[0]), starts).otherwise(F.array().cast("array<int>")).alias("at")))
    gate = F.array_intersect(words, known)
    df = _barrier(df, base=F.array(*places).cast("array<struct<label:string,at:array<int>>>"), gate=gate, n_words=F.size(words).cast("long"))
    df = _barrier(df, norm=F.when(F.size("gate") > 0, F.array_join(words, " "))).drop("words")
    df = _barrier(df, runs=F.when(F.size("gate") > 0, _found("gate", "norm"))).drop("norm", "gate")
    df = _barrier(df, seen=F.coalesce(F.array_sort(F.flatten(F.transform("runs", _intervals)), lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((b["end"] - a["end"]).cast("int"))), F.array().cast(_NONE))).drop("runs")
    df = _barrier(df, detections=_stay("seen"), at=F.flatten(F.transform("base", lambda b: b["at"])), named=F.array_sort(F.array_distinct(F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])))).drop("seen", "base")
    n_base = F.coalesce(F.when(F.col("at").isNotNull(), F.size("at")), F.lit(0)).cast("long")
    named = F.coalesce("named", F.array().cast("array<string>"))
    return df.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        (F.array_min("at") - 1).cast("long").alias("first_word"),
        (F.array_max("at") - 1).cast("long").alias("last_word"),
        F.array_join(named, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(named, F.transform("detections", lambda d: d["label"])))), ",").alias("labels"),
        F.greatest(F.when(n_base > 0, F.lit(0.9)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0))).alias("score"),
        "detections",
    )

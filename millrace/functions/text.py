"""Text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the CJK characters that count as words.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


# Markdown marks that are taken off, in this order, and what stays of each.
MARKS = (
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),  # images
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),  # links
    (r"\*\*(.*?)\*\*|__(.*?)__", "$1$2"),  # bold
    (r"\*(.*?)\*|_(.*?)_", "$1$2"),  # italic
    (r"`([^`]*)`", "$1"),  # code
    (r"<[^>]+>", ""),  # tags
)


def plain(text: Column) -> Column:
    """Markdown without its marks: images leave their alternative text, links and emphasis theirs."""
    for pattern, left in MARKS:
        text = F.regexp_replace(text, f"(?d){pattern}", left)
    return text


def slug(text: Column) -> Column:
    """Anchor of a heading: marks off, lower case, only ASCII letters, digits, underscores and dashes stay, blanks to one dash."""
    kept = F.regexp_replace(F.lower(plain(text)), r"[^a-z0-9_\t-\r -]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"^[\t-\r ]+|[\t-\r ]+$", ""), r"[\t-\r ]+", "-")


def squeezed(text: Column) -> Column:
    """White space runs (Unicode ones too) to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def comment_only(line: Column) -> Column:
    return F.trim(line).rlike(r"^(#|//|--|;|%|\*|/\*|<!--)")


def md_words(text: Column) -> Column:
    """Tokens of over one character, the signs of Markdown being blanks, plus each CJK character."""
    bare = F.regexp_replace(text, r"[#*`|\->\[\]()]", " ")
    return (F.size(F.filter(F.split(bare, r"(?U)\s+"), lambda w: F.length(w) > 1)) + F.regexp_count(bare, F.lit(CJK))).cast("long")


def last_tag(text: Column, tag: str) -> Column:
    """The trimmed content of the last <tag>...</tag>; null if there is none."""
    found = F.try_element_at(F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), F.lit(-1))
    return F.regexp_replace(found, r"(?U)^\s+|\s+$", "")


# Characters that no file name may have, and the longest name.
NOT_IN_NAMES, LONGEST_NAME = r'[<>:"/\\|?*\x00-\x1f]', 200


def file_name(title: Column, most: int = LONGEST_NAME) -> Column:
    """A title as a file name: what names may not have becomes _, blanks and then dots at the ends go."""
    name = F.regexp_replace(F.regexp_replace(title, NOT_IN_NAMES, "_"), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(name, r"^\.+|\.+$", ""), F.lit(most)), F.lit("")), F.lit("untitled"))


def url_token(url: Column) -> Column:
    """The part after /wiki/ or /docx/, else the last path part."""
    at = F.regexp_extract(url, r"/(?:wiki|docx|docs)/([A-Za-z0-9]+)", 1)
    return F.coalesce(F.nullif(at, F.lit("")), F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def dashes(line: Column) -> Column:
    """A table row of cells that hold em or en dashes only becomes a separator row: as many hyphens, three at least; other lines stay."""
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    cells = F.transform(F.split(F.regexp_replace(bare, r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    row = F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.repeat(F.lit("-"), F.greatest(F.lit(3), F.length(c)))), "|"), F.lit("|"))
    return F.when(bare.startswith("|") & F.forall(cells, lambda c: c.rlike("^[—–]+$")), row).otherwise(line)


# Fixed value: a number that was put before a heading by hand.
MANUAL_NUMBER = r"^(\d+\.)+\d*\s*"


def unnumbered(heading: Column) -> Column:
    """A heading without its manual number."""
    return F.regexp_replace(heading, MANUAL_NUMBER, "")


def numeric_share(line: Column) -> Column:
    tokens = F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")
    hits = F.size(F.filter(tokens, lambda t: t.rlike(r"^[-+]?[\d.,]+%?$")))
    return F.round(F.coalesce(F.try_divide(hits, F.size(tokens)), F.lit(0.0)), 6)


def prose_lines(text: Column, patterns: list[str], longer: int = 20) -> Column:
    """How many lines of over `longer` characters fit any pattern."""
    any_ = "|".join(f"(?:{p})" for p in patterns)
    return F.size(F.filter(F.split(text, "\n"), lambda x: (F.length(x) > longer) & x.rlike(any_))).cast("long")


def head_share(text: Column, share: float = 0.2) -> Column:
    return F.left(text, F.greatest(F.lit(1), (F.length(text) * share).cast("int")))


def hits_per_line(text: Column, patterns: list[str]) -> Column:
    """Indicator hits over all lines; a line counts once for each pattern."""
    lines = F.split(text, "\n")
    total = F.lit(0)
    for p in patterns:
        total = total + F.size(F.filter(lines, _fits(p)))
    return total.cast("long")


def _fits(pattern: str):
    return lambda x: x.rlike(pattern)


def keywords(text: Column, prefix: str, words_: list[str], least: int = 2) -> Column:
    """Whether a text starts like pseudocode or holds at least `least` of its keywords."""
    n = F.lit(0)
    for w in words_:
        n = n + F.contains(text, F.lit(w)).cast("int")
    return text.rlike(prefix) | (n >= least)


def file_prefix_issue(name: Column) -> Column:
    """Why a file name is not <number>-<kebab-case>.md; null if it is."""
    stem = F.regexp_replace(name, r"\.md$", "")
    return F.when(~stem.rlike(r"^\d"), "no_prefix").when(stem.rlike(r"^0\d"), "zero_padded").when(~stem.rlike(r"^\d+(?:-\d+)*-[a-z0-9]+(?:-[a-z0-9]+)*$"), "not_kebab")


def skill_name_issue(name: Column, most: int = 64) -> Column:
    """The first thing wrong with a kebab-case name; null if nothing is."""
    return (
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", "missing")
        .when(~name.rlike("^[a-z0-9-]+$"), "not_kebab")
        .when(name.startswith("-") | name.endswith("-") | F.contains(name, F.lit("--")), "bad_dash")
        .when(F.length(name) > most, "too_long")
    )


def emphasis_defect(text: Column) -> Column:
    """Bold text that ends with a bracket and is followed by a CJK character: renderers do not see its end."""
    return text.rlike(r"\*\*[^*\n]*[)\]）】]\*\*" + CJK)


# Characters that stay as they are in a quoted address.
SAFE = "/:?#&=@%+"


def quoted(url: Column, safe: str = SAFE) -> Column:
    """An address in percent notation (a blank is %20): letters, digits, -._~ and `safe` stay. Whole runs, by the JVM's encoder."""
    out = F.replace(F.replace(F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for c in safe:  # % last, as it is in what the others became
        if c != "%":
            out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.replace(out, F.lit("%25"), F.lit("%")) if "%" in safe else out


def unquoted(url: Column) -> Column:
    """The text of an address in percent notation; a plus stays a plus, and what is no valid notation stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def formatted(x: Column, spec: str) -> Column:
    """A number by a format such as +.2f, .0% or ,.2f, rounded from its exact binary value with ties to even.

    The JVM's formatter rounds the shown decimal half up, so this one runs on Arrow batches.
    """

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else format(v, spec) for v in values], dtype=object)

    return run(x.cast("double"))


def first_match(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """(label, match) of the first pattern in the list that matches anywhere; the rest is not tried."""
    return F.coalesce(*[F.when(text.rlike(p), F.struct(F.lit(label).alias("label"), F.regexp_extract(text, p, 0).alias("match"))) for p, label in patterns])


def leftmost_match(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """(at, rank, label, match) of the match that starts first; of several at one place that of the earlier pattern."""
    at = lambda p: F.length(F.regexp_extract(text, f"(?s)^(.*?)(?:{p})", 1))
    found = [F.when(text.rlike(p), F.struct(at(p).alias("at"), F.lit(k).alias("rank"), F.lit(label).alias("label"), F.regexp_extract(text, p, 0).alias("match"))) for k, (p, label) in enumerate(patterns)]
    return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))


def examples(items: Column, most: int = 3, chars: int = 80) -> Column:
    """The first few items of an array, each cut to so many characters."""
    return F.transform(F.slice(items, 1, most), lambda x: F.left(x, F.lit(chars)))

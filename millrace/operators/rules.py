"""Rules over texts and records: each rule is a predicate that emits a diagnostic.

A diagnostic is (key, line, type, severity, message). Accumulating rules are gathered in one array and exploded, so
the input is read once; short-circuit rules are one coalesce.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = "struct<line:int,type:string,severity:string,message:string>"


def issue(when: Column, type_: str, message: Column | str, line: Column | int | None = None, severity: str = "error") -> Column:
    at = line if isinstance(line, Column) else F.lit(line)
    said = message if isinstance(message, Column) else F.lit(message)
    return F.when(when, F.struct(at.cast("int").alias("line"), F.lit(type_).alias("type"), F.lit(severity).alias("severity"), said.alias("message")))


def accumulate(df: DataFrame, keys: list[str], rules: list[Column]) -> DataFrame:
    """Every rule that fires, a row each."""
    found = F.filter(F.array(*[r.cast(ISSUE) for r in rules]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(found).alias("i")).select(*keys, "i.line", "i.type", "i.severity", "i.message")


def first_failure(df: DataFrame, keys: list[str], rules: list[Column]) -> DataFrame:
    """The first rule that fires for each row, if any."""
    return df.withColumn("i", F.coalesce(*[r.cast(ISSUE) for r in rules])).where("i is not null").select(*keys, "i.line", "i.type", "i.severity", "i.message")


def per_line(lines: Column, rule: Callable[[Column, Column], Column]) -> Column:
    """Issues of an array of lines by a rule of (line, number from 1)."""
    return F.filter(F.transform(lines, lambda x, i: rule(x, i + 1).cast(ISSUE)), lambda x: x.isNotNull())


def table_issues(lines: Column) -> Column:
    """Issues of the tables in an array of lines: a second row that is no separator, later rows with another count of pipes.

    A line with two pipes starts a table; a blank line, or one without a pipe, ends it. Escaped pipes count.
    """
    pipes = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    start = F.struct(F.lit(0).alias("place"), F.lit(0).alias("width"), F.array().cast(f"array<{ISSUE}>").alias("found"))

    def step(s: Column, item: Column) -> Column:
        x, i = F.trim(item["x"]), item["i"]
        n, out = pipes(x), s["place"] == 0
        begins = out & (n >= 2)
        goes_on = ~out & (n > 0)
        bad = F.when(goes_on & (s["place"] == 1) & ~x.rlike(r"^\|?[\s\-:|]+\|?$"), issue(F.lit(True), "table_format", "bad separator", i).cast(ISSUE)).when(goes_on & (s["place"] > 1) & (n != s["width"]), issue(F.lit(True), "table_format", "column count", i).cast(ISSUE))
        found = F.when(bad.isNotNull(), F.concat(s["found"], F.array(bad))).otherwise(s["found"])
        return F.struct(F.when(begins, 1).when(goes_on, s["place"] + 1).otherwise(0).alias("place"), F.when(begins, n).otherwise(s["width"]).alias("width"), found.alias("found"))

    return F.aggregate(F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), start, step)["found"]


_ENTRY = "struct<key:string,raw:string,nested:boolean>"


def front_matter_entries(block: Column) -> Column:
    """(key, raw, nested) of a block's own keys: raw is the value's text, folded lines joined by one blank; nested says that it has lines below it."""
    logical = F.split(F.regexp_replace(F.regexp_replace(block, r"\r\n?", "\n"), r"\n[ \t]+", "\x01"), "\n")
    own = F.filter(logical, lambda x: x.rlike(r"^[^\s#:\-][^:]*:(?:[ \t\x01]|$)"))

    def entry(x: Column) -> Column:
        value = F.regexp_replace(x, r"^[^:]*:", "")
        folded = F.regexp_replace(F.regexp_replace(value, r"^[ \t]*[>|][+\-]?[ \t]*\x01", "\x02"), r"\x01", " ")
        return F.struct(F.regexp_extract(x, r"^([^:]*):", 1).alias("key"), F.trim(folded).alias("raw"), value.rlike(r"^[ \t]*\x01").alias("nested"))

    return F.transform(own, entry)


def front_matter(text: Column) -> Column:
    """The front matter of a text as a map, quotes off, the first of equal keys; null if there is none."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    entries = front_matter_entries(block)
    keys = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    value = lambda e: F.regexp_replace(F.replace(e["raw"], F.lit("\x02"), F.lit("")), r"^([\"'])(.*)\1$", "$2")
    return F.when(text.rlike(r"(?s)\A---\r?\n.*?\r?\n---"), F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"], value(e)))))


def scalar_kind(entry: Column) -> Column:
    """What a value of front matter is: str, int, float, bool, date, NoneType, list or dict."""
    raw = entry["raw"]
    return (
        F.when(raw.startswith("\x02") | raw.rlike("^[\"']"), "str")
        .when(entry["nested"] & raw.startswith("- "), "list")
        .when(entry["nested"] & raw.rlike(r"^[^\s:]+:( |$)"), "dict")
        .when(raw.isin("", "~", "null", "Null", "NULL"), "NoneType")
        .when(raw.startswith("["), "list")
        .when(raw.startswith("{"), "dict")
        .when(raw.rlike(r"^[-+]?(0|[1-9][0-9_]*|0[0-7_]+|0x[0-9a-fA-F_]+)$"), "int")
        .when(raw.rlike(r"^[-+]?([0-9][0-9_]*\.[0-9_]*([eE][-+][0-9]+)?|\.[0-9_]+|\.(inf|Inf|INF))$|^\.(nan|NaN|NAN)$"), "float")
        .when(raw.rlike(r"^(?:yes|Yes|YES|no|No|NO|true|True|TRUE|false|False|FALSE|on|On|ON|off|Off|OFF)$"), "bool")
        .when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
        .otherwise("str")
    )


def scalar_fault(entry: Column) -> Column:
    """Why a value is no valid notation: an open quote or bracket, a colon and a blank in it, a sign that is reserved; null if it is valid."""
    raw = entry["raw"]
    free = ~raw.startswith("\x02") & ~raw.rlike("^[\"'\\[{]") & ~entry["nested"]
    return (
        F.when(raw.rlike("^\"") & ~raw.rlike(r'^"(?:[^"\\]|\\.)*"(?:\s+#.*)?$'), "open quote")
        .when(raw.rlike("^'") & ~raw.rlike(r"^'(?:[^']|'')*'(?:\s+#.*)?$"), "open quote")
        .when(raw.rlike(r"^\[") & ~raw.rlike(r"\]$") | raw.rlike(r"^\{") & ~raw.rlike(r"\}$"), "open bracket")
        .when(free & raw.rlike(r":(\s|$)"), "a colon in it")
        .when(free & raw.rlike(r"^[@`%&*!|>]"), "a reserved sign")
    )


#: The keys that front matter may have.
ALLOWED_KEYS = ("name", "description", "license", "allowed-tools", "metadata", "compatibility")


#: The longest name, description and note on compatibility.
MOST_NAME, MOST_SAID, MOST_COMPATIBLE = 64, 1024, 500


def front_matter_failure(df: DataFrame, key: str, text: str) -> DataFrame:
    """The first thing wrong with the front matter of each text, in the order of the checks; a null text is a missing file."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    df = df.select(*df.columns, F.inline(F.array(F.struct(front_matter_entries(block).alias("_e"), block.alias("_b")))))
    has = lambda k: F.exists("_e", lambda e: e["key"] == k)
    entry = lambda k: F.try_element_at(F.filter("_e", lambda e: e["key"] == k), F.lit(-1))
    value = lambda k: F.trim(F.regexp_replace(F.replace(F.coalesce(entry(k)["raw"], F.lit("")), F.lit("\x02"), F.lit("")), r"^([\"'])(.*)\1$", "$2"))
    kind = lambda k: F.when(has(k), scalar_kind(entry(k)))
    fault = F.try_element_at(F.filter(F.transform("_e", scalar_fault), lambda x: x.isNotNull()), F.lit(1))
    odd = F.array_except(F.transform("_e", lambda e: e["key"]), F.array(*map(F.lit, ALLOWED_KEYS)))
    name, said, fits = value("name"), value("description"), value("compatibility")
    fail = lambda when, message: issue(when, "frontmatter", message)
    rules = [
        fail(F.col(text).isNull(), "not found"),
        fail(~F.col(text).startswith("---"), "no front matter"),
        fail(~F.col(text).rlike(r"(?s)\A---\n.*?\n---"), "not closed"),
        fail(fault.isNotNull(), F.concat(F.lit("invalid: "), fault)),
        fail(F.size("_e") == 0, "not a mapping"),
        fail(F.size(odd) > 0, F.concat(F.lit("unexpected "), F.array_join(F.array_sort(odd), ", "))),
        fail(~has("name"), "no name"),
        fail(~has("description"), "no description"),
        fail(kind("name") != "str", F.concat(F.lit("name is "), kind("name"))),
        fail((name != "") & ~name.rlike("^[a-z0-9-]+$"), "not_kebab"),
        fail(name.startswith("-") | name.endswith("-") | F.contains(name, F.lit("--")), "bad_dash"),
        fail(F.length(name) > MOST_NAME, "too_long"),
        fail(kind("description") != "str", F.concat(F.lit("description is "), kind("description"))),
        fail(said.rlike("[<>]"), "angle brackets"),
        fail(F.length(said) > MOST_SAID, "description too long"),
        fail(has("compatibility") & ~kind("compatibility").isin("str", "NoneType") & ~value("compatibility").isin("0", "false"), F.concat(F.lit("compatibility is "), kind("compatibility"))),
        fail(F.length(fits) > MOST_COMPATIBLE, "compatibility too long"),
    ]
    return first_failure(df, [key], rules)


def figure_issues(figures: DataFrame) -> DataFrame:
    """Diagnostics of (paper, fig_num, width, height, page_height, suspect): shape and suspects; see figures for the others."""
    ratio = F.try_divide("width", "height")
    rules = [
        issue(ratio > 8, "aspect_ratio", "very wide", severity="MEDIUM"),
        issue(ratio < 0.25, "aspect_ratio", "very narrow", severity="MEDIUM"),
        issue(F.col("height") > 0.68 * F.col("page_height"), "aspect_ratio", "most of the page", severity="MEDIUM"),
        issue(F.coalesce("suspect", F.lit(False)), "extractor_suspect", "marked by the extractor", severity="HIGH"),
    ]
    return accumulate(figures, ["paper", "fig_num"], rules)


def animation_issues(frames: DataFrame) -> DataFrame:
    """Size rules of (id, emoji, width, height)."""
    w, h = F.col("width"), F.col("height")
    low, high = F.least(w, h), F.greatest(w, h)
    rules = [
        issue(F.col("emoji") & ((w != h) | (w < 64) | (w > 128)), "animation", "an emoji is a square of 64 to 128"),
        issue(~F.col("emoji") & (high > 2 * low), "animation", "more than twice as long as wide"),
        issue(~F.col("emoji") & ((low < 320) | (low > 640)), "animation", "the shorter side is 320 to 640"),
    ]
    return accumulate(frames, ["id"], rules)


def write_ready(expected: Column, written: Column, failures: Column) -> Column:
    return (2 * written >= expected) & (failures == 0)

"""Grounding of documents in source files: citations against line counts, quoted snippets against the lines they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import comment_only, squeezed

# How a citation, a fence and a snippet's first line look; what never quotes a source; limits.
CITATION = r"(?U)`([\w./-]+\.[A-Za-z0-9]{1,10}):(\d+)(?:-(\d+))?`"
FENCE = r"^(```+|~~~+)\s*(\S*)"
ATTRIBUTION = r"(?U)^\s*(?:#|//|--|;|%%|\*|/\*|<!--)+\s*From:\s*([\w./-]+\.[A-Za-z0-9]{1,10}):(\d+(?:-\d+)?(?:\s*,\s*:?\d+(?:-\d+)?)*)"
NO_SOURCE = ("mermaid", "text", "markdown", "md", "", "console", "diff")
LEAST_LINES, LEAST_CHARS, SHOWN, SHOWN_CHARS = 5, 4, 3, 80

_PAIR = "struct<start:int,end:int,lang:string>"


def fence_pairs(lines: Column) -> Column:
    """(first, last, lang) of the closed fences in lines numbered from 1, and of an open one, whose last is null.

    Only a fence without a language closes; one with a language inside another is content. Just the fence lines are folded.
    """
    marks = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("n"), F.trim(x).alias("x"))), lambda p: p["x"].rlike(FENCE))
    marks = F.transform(marks, lambda p: F.struct(p["n"].alias("n"), F.regexp_extract(p["x"], FENCE, 2).alias("info")))
    kind = f"struct<open:{_PAIR},done:array<{_PAIR}>>"
    none = F.lit(None).cast(_PAIR)
    start = F.struct(none.alias("open"), F.array().cast(f"array<{_PAIR}>").alias("done")).cast(kind)

    def step(s: Column, m: Column) -> Column:
        begun = F.struct(F.struct(m["n"].alias("start"), F.lit(None).cast("int").alias("end"), F.lower(m["info"]).alias("lang")).alias("open"), s["done"].alias("done")).cast(kind)
        closed = F.struct(none.alias("open"), F.concat(s["done"], F.array(F.struct(s["open"]["start"].alias("start"), m["n"].alias("end"), s["open"]["lang"].alias("lang")))).alias("done")).cast(kind)
        return F.when(s["open"].isNull(), begun).when(m["info"] == "", closed).otherwise(s)

    end = F.aggregate(marks, start, step)
    return F.transform(F.array(end), lambda e: F.when(e["open"].isNull(), e["done"]).otherwise(F.concat(e["done"], F.array(e["open"]))))[0]


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _parsed(docs: DataFrame) -> DataFrame:
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n", -1)
    return _once(_once(docs.select("file", "text"), lines=lines).drop("text"), pairs=fence_pairs(F.col("lines")))


def citations(docs: DataFrame) -> DataFrame:
    """(file, line, path, first, last) of the citations in code spans outside fences; last is first if it is not given."""
    inside = lambda n: F.exists("pairs", lambda p: (n >= p["start"]) & (n <= F.coalesce(p["end"], F.lit(2**31 - 1))))
    lines = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("line"))), lambda p: F.contains(p["x"], F.lit("`")) & ~inside(p["line"]))
    df = _parsed(docs).select("file", F.explode(lines).alias("p"))
    part = lambda g: F.regexp_extract_all(F.col("p.x"), F.lit(CITATION), F.lit(g))
    df = df.select("file", F.col("p.line").alias("line"), F.explode(F.arrays_zip(part(1).alias("path"), part(2).alias("first"), part(3).alias("last"))).alias("c"))
    return df.select("file", "line", F.regexp_replace("c.path", "^/+", "").alias("path"), F.col("c.first").cast("long").alias("first"), F.coalesce(F.nullif("c.last", F.lit("")), "c.first").cast("long").alias("last"))


def citation_issues(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations of missing files, of lines after the end, and of ranges that end before they start."""
    sizes = sources.select("path", F.size("lines").cast("long").alias("n"))
    found = citations(docs).join(sizes, "path", "left")
    at = F.concat(F.col("path"), F.lit(":"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))
    said = F.when(F.col("n").isNull(), F.concat(F.lit("no such file: "), F.col("path"))).when(F.col("last") > F.col("n"), F.concat(at, F.lit(" is out of range"))).when(F.col("first") > F.col("last"), F.concat(at, F.lit(" ends before it starts")))
    return found.withColumn("message", said).where("message is not null").select("file", "line", F.lit("source_ref").alias("type"), F.lit("error").alias("severity"), "message")


def snippets(docs: DataFrame) -> DataFrame:
    """(file, line, lang, lines, path, said, ranges) of closed fences of a source language; path is null without attribution."""
    df = _parsed(docs)
    df = df.select("file", "lines", F.explode(F.filter("pairs", lambda p: p["end"].isNotNull())).alias("p"))
    body = F.slice("lines", F.col("p.start") + 1, F.col("p.end") - F.col("p.start") - 1)
    df = df.select("file", (F.col("p.start") + 1).alias("line"), F.col("p.lang").alias("lang"), body.alias("lines")).where(~F.col("lang").isin(*NO_SOURCE))
    first = F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit(""))
    df = df.withColumn("path", F.nullif(F.regexp_replace(F.regexp_extract(first, ATTRIBUTION, 1), "^/+", ""), F.lit(""))).withColumn("said", F.regexp_extract(first, ATTRIBUTION, 2))
    part = lambda g: F.regexp_extract_all("said", F.lit(r":?(\d+)(?:-(\d+))?"), F.lit(g))
    ranges = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b")), lambda r: F.struct(r["a"].cast("int").alias("first"), F.coalesce(F.nullif(r["b"], F.lit("")), r["a"]).cast("int").alias("last")))
    return df.withColumn("ranges", ranges)


def matched(lines: Column, cited: Column) -> tuple[Column, Column]:
    """(countable lines, those that no cited line holds or is held by), white space squeezed; both arrays."""
    plain = F.filter(F.transform(lines, squeezed), lambda x: x != "")
    gap = lambda x: F.trim(F.regexp_replace(x, r"^[#/;%*<!\-]+", "")).isin("...", "…") | x.isin("...", "…")
    count = F.filter(plain, lambda x: ~gap(x) & ~comment_only(x))
    hit = lambda x, c: (x == c) | ((F.least(F.length(x), F.length(c)) >= LEAST_CHARS) & (F.contains(x, c) | F.contains(c, x)))
    return count, F.filter(count, lambda x: ~F.exists(cited, lambda c: hit(x, c)))


def snippet_issues(docs: DataFrame, sources: DataFrame, least: float = 0.7) -> DataFrame:
    """Snippets without attribution, with one to a missing file or range, and with too few lines of what they cite."""
    df = snippets(docs).alias("s").join(sources.select("path", F.col("lines").alias("source")), "path", "left")
    n = F.size("source")
    df = _once(df, bad=F.try_element_at(F.filter("ranges", lambda r: (r["first"] > r["last"]) | (r["last"] > n)), F.lit(1)))
    ok = F.col("source").isNotNull() & F.col("bad").isNull()
    cited = F.flatten(F.transform("ranges", lambda r: F.slice("source", F.greatest(r["first"], F.lit(1)), F.greatest(r["last"] - F.greatest(r["first"], F.lit(1)) + 1, F.lit(0)))))
    df = _once(df, cited=F.when(ok, F.filter(F.transform(cited, squeezed), lambda x: x != "")))
    own = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    count, lost = matched(own, F.col("cited"))
    df = _once(df, count=F.when(ok, F.size(count)), lost=F.when(ok, lost))
    share = F.coalesce(F.try_divide(F.col("count") - F.size("lost"), F.col("count")), F.lit(1.0))
    loose = F.col("path").isNull()
    real = F.size(F.filter("lines", lambda x: F.trim(x) != ""))
    shown = F.array_join(F.transform(F.slice("lost", 1, SHOWN), lambda x: F.left(x, F.lit(SHOWN_CHARS))), " | ")
    row = lambda type_, severity, said: F.struct(F.lit(type_).alias("type"), F.lit(severity).alias("severity"), said.alias("message"))
    verdict = (
        F.when(loose & (real >= LEAST_LINES), row("snippet_unattributed", "warning", F.concat(F.col("lang"), F.lit(" without attribution"))))
        .when(~loose & F.col("source").isNull(), row("snippet_attr_ref", "error", F.concat(F.lit("no such file: "), F.col("path"))))
        .when(~loose & F.col("bad").isNotNull(), row("snippet_attr_ref", "error", F.format_string("%s:%d-%d is out of range", F.col("path"), F.col("bad.first"), F.col("bad.last"))))
        .when(~loose & (share < least), row("snippet_mismatch", "error", F.concat((F.col("count") - F.size("lost")).cast("string"), F.lit("/"), F.col("count").cast("string"), F.lit(" lines match; not: "), shown)))
    )
    return df.withColumn("v", verdict).where("v is not null").select("file", "line", "v.type", "v.severity", "v.message")


def with_lines(files: DataFrame) -> DataFrame:
    """sources (path, lines) from (path, text); a file that ends with a line feed has no line after it."""
    text = F.regexp_replace(F.col("text"), r"\r\n?", "\n")
    return files.select("path", F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)).alias("lines"))

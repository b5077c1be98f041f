"""Lint of a folder of Markdown documents: each rule gives rows (file, line, type, severity, message).

Documents are rows (file, text), the other files of the folder rows (path, length). Rules of one document are column
expressions over its lines, gathered in one array and exploded, so a text is read once; rules between documents
(links, anchors, orphans, collisions) are joins of what was taken out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import CJK, md_words, plain, slug
from millrace.operators.rules import ISSUE, issue, per_line, table_issues

# Budgets of an export, suffixes of images, and what the diagram language allows at the start of a line.
LEAST_WORDS, MOST_WORDS = 1500, 6000
IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp")
MOST_IMAGE, MOST_TOTAL, MOST_FILES = 5 << 20, 10 << 20, 50
KEYWORDS = (
    "subgraph", "direction", "end", "style", "classdef", "class", "graph", "flowchart", "sequencediagram", "statediagram", "state", "participant", "actor", "note", "alt", "else", "opt", "loop", "par", "and",
    "rect", "critical", "break", "activate", "deactivate",
)
# Patterns whose matches are the rules.
NODE = r"^(\s*)([A-Za-z_][A-Za-z0-9_\s]*?)(?:\[|\(|\{|-->|-.->|==>)"
BAD_ARROW = r"(?<!-)--(?!>)(?!-)|(?<!\.)-\.(?!->)|(?<!=)==(?!>)"
LINK = r"(!?)\[([^\]]*)\]\(([^)\s]+)\)"
CODE_REF = r"`[a-zA-Z0-9_/.-]+\.(py|js|ts|go|rs|java|c|cpp|h)(?::\d+(?:-\d+)?)?`"
BROKEN_BOLD = r"\*\*[^*\n]*[)\]）】]\*\*" + CJK

_FENCE = r"(?md)^[^\S\n]*```[^\n]*(?:\n|\z)"
_DIAGRAM = r"(?md)^[^\S\n]*```mermaid[^\n]*\n"
_NO_LINES = "array<string>"


def outside(text: Column) -> Column:
    """A text's lines, blank where they are fences or stand within them, so that numbers stay.

    The text is split at its fences; every other part is inside. Each part is handled once.
    """
    parts = F.split(text, _FENCE, -1)
    last = F.size(parts) - 1

    def own(part: Column, i: Column) -> Column:
        xs = F.split(part, "\n", -1)
        xs = F.when(i < last, F.slice(xs, F.lit(1), F.size(xs) - 1)).otherwise(xs)  # a part ends with the line feed before the fence
        xs = F.when(i % 2 == 1, F.transform(xs, lambda _: F.lit(""))).otherwise(xs)
        return F.concat(F.when(i > 0, F.array(F.lit(""))).otherwise(F.array().cast(_NO_LINES)), xs)

    return F.flatten(F.transform(parts, own))


def without_code(line: Column) -> Column:
    return F.regexp_replace(line, "`[^`]*`", "")


def _name(file: Column) -> Column:
    return F.regexp_extract(file, "([^/]*)$", 1)


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def diagrams(docs: DataFrame) -> DataFrame:
    """(file, start, lines) of the closed diagram blocks; start is the number of a block's first line."""
    parts = F.split("text", _DIAGRAM, -1)
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    df = _once(docs.select("file", "text"), _parts=parts)
    df = _once(df, _breaks=F.transform("_parts", breaks))
    blocks = F.transform("_parts", lambda x, k: F.struct((k + 1 + F.aggregate(F.slice("_breaks", F.lit(1), k), F.lit(0), lambda a, b: a + b)).alias("start"), F.regexp_extract(x, r"(?ds)\A((?:.*?\n)??)(?m:^)[^\S\n]*```[^\S\n]*(?:\n|\z)", 1).alias("body"), x.rlike(r"(?md)^[^\S\n]*```[^\S\n]*$").alias("closed")))
    out = df.select("file", F.explode(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("b")).where("b.closed")
    return out.select("file", F.col("b.start").alias("start"), F.split(F.regexp_replace("b.body", r"\n\z", ""), "\n", -1).alias("lines"))


def diagram_issues(docs: DataFrame) -> DataFrame:
    """Fixed colours, blanks in node ids, wrong arrows, and subgraphs and brackets without an end."""
    df = diagrams(docs)
    lines = F.col("lines")
    real = F.filter(F.transform(lines, _trim), lambda x: (x != "") & ~x.startswith("%%"))
    kind = F.lower(F.regexp_extract(F.coalesce(F.try_element_at(real, F.lit(1)), F.lit("")), r"^(\S*)", 1))
    df = _once(df, steps=kind.startswith("sequencediagram") | kind.startswith("statediagram"))
    words = F.array(*map(F.lit, KEYWORDS))

    def parts(x: Column) -> tuple[Column, Column, Column]:
        """(is a line of a diagram at all, sets a colour, starts with a keyword)"""
        bare = _trim(x)
        first = F.lower(F.regexp_extract(bare, r"^(\S*)", 1))
        styled = bare.rlike(r"(?i)^(classDef|style|linkStyle)\b") & bare.rlike(r"(?i)\b(?:fill|stroke|color)\s*:")
        keyword = F.array_contains(words, first) | F.array_contains(words, F.regexp_replace(first, ":+$", ""))
        return (bare != "") & ~bare.startswith("%%"), styled, keyword

    def nodes(x: Column) -> Column:
        there, styled, keyword = parts(x)
        return there & ~styled & ~keyword

    at = lambda i: F.col("start") + i - 1

    def colour(x: Column, i: Column) -> Column:
        there, styled, _ = parts(x)
        return issue(there & styled, "mermaid_hardcoded_style", "a fixed colour", at(i))

    def node(x: Column, i: Column) -> Column:
        name = _trim(F.regexp_extract(x, NODE, 2))
        return issue(nodes(x) & ~F.col("steps") & F.contains(name, F.lit(" ")) & ~F.array_contains(words, F.lower(name)), "mermaid_syntax", F.concat(F.lit("blank in node id "), name), at(i))

    def arrow(x: Column, i: Column) -> Column:
        other = F.contains(x, F.lit("->>")) | F.contains(x, F.lit("-x"))
        return issue(nodes(x) & ~other & x.rlike(BAD_ARROW), "mermaid_syntax", "not an arrow", at(i))

    state = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("bad"))

    def step(s: Column, item: Column) -> Column:
        bare = F.lower(_trim(item["x"]))
        down = (bare == "end") & (s["depth"] == 0)
        depth = F.when(bare.startswith("subgraph"), s["depth"] + 1).when((bare == "end") & (s["depth"] > 0), s["depth"] - 1).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.when(down, F.concat(s["bad"], F.array(item["i"]))).otherwise(s["bad"]).alias("bad"))

    groups = F.aggregate(F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), state, step)
    df = _once(df, groups=F.when(~F.col("steps"), groups), body=F.array_join(F.filter(lines, nodes), "\n"))
    ends = F.transform(F.coalesce("groups.bad", F.array().cast("array<int>")), lambda i: issue(F.lit(True), "mermaid_syntax", "end without a subgraph", at(i)).cast(ISSUE))
    count = lambda c: F.length("body") - F.length(F.replace(F.col("body"), F.lit(c), F.lit("")))
    whole = [issue(F.col("groups.depth") > 0, "mermaid_syntax", F.concat(F.col("groups.depth").cast("string"), F.lit(" subgraphs without an end")), F.col("start"))]
    whole += [issue(count(a) > count(b), "mermaid_syntax", F.concat((count(a) - count(b)).cast("string"), F.lit(f" {a} without {b}")), F.col("start")) for a, b in ("[]", "()", "{}")]
    found = F.concat(per_line(lines, colour), per_line(lines, node), per_line(lines, arrow), ends, F.filter(F.array(*[x.cast(ISSUE) for x in whole]), lambda x: x.isNotNull()))
    return _rows(df.select("file", found.alias("found")))


def _rows(df: DataFrame) -> DataFrame:
    return df.select("file", F.explode("found").alias("i")).select("file", "i.line", "i.type", "i.severity", "i.message")


def document_issues(docs: DataFrame) -> DataFrame:
    """Rules of one document: sections, byline, words, file name, records of decisions, the index, tables, marks that do not render."""
    df = _once(docs.select("file", F.coalesce("text", F.lit("")).alias("text")), name=_name(F.col("file")), lines=outside(F.coalesce("text", F.lit(""))))
    df = _once(df, body=F.array_join("lines", "\n"), decision=F.col("name").rlike(r"^\d+(-\d+)*-adr-"), index=F.col("name") == "index.md")
    text, body, name, lines = F.col("text"), F.col("body"), F.col("name"), F.col("lines")
    section = ~F.col("decision") & ~F.col("index")
    has = lambda column, part: F.contains(column, F.lit(part))
    missing = lambda when, said: issue(when, "missing_section", said, 1)
    rules = [
        missing(section & ~has(body, "](index.md)"), "no link to the index"),
        missing(section & ~has(body, "**Generated**:") & ~has(body, "**Part of**:"), "no byline"),
        missing(section & ~text.rlike(r"(?mi)^#{1,2}\s+Introduction"), "no Introduction"),
        missing(section & ~text.rlike(r"(?mi)^#{1,2}\s+Summary"), "no Summary"),
        missing(section & ~has(text, "```mermaid") & F.lower(name).rlike("arch|system|design"), "no diagram"),
        missing(section & ~body.rlike(CODE_REF) & ~F.lower(name).rlike("overview|evolution|roadmap"), "no code reference"),
    ]
    n = md_words(body)
    rules += [issue(section & (n < LEAST_WORDS), "word_count", F.concat(F.lit("too short: "), n.cast("string")), 1), issue(section & (n > MOST_WORDS), "word_count", F.concat(F.lit("too long: "), n.cast("string")), 1)]

    numbered = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda p: _trim(p["x"]) != "")
    heads = F.transform(F.filter(numbered, lambda p: p["x"].rlike(r"^#\s+\S")), lambda p: p["i"])
    df = _once(df, real=numbered, heads=heads)
    first = F.try_element_at(F.col("heads"), F.lit(1))
    after = F.try_element_at(F.filter("real", lambda p: p["i"] > F.element_at("heads", 1)), F.lit(1))["x"]
    placed = ~F.col("index")
    rules += [
        issue(placed & (F.size("heads") == 0), "metadata_placement", "no H1", 1),
        issue(placed & (F.size("heads") > 1), "metadata_placement", "more than one H1", F.try_element_at(F.col("heads"), F.lit(2))),
        issue(placed & (F.size("heads") > 0) & F.exists("real", lambda p: p["i"] < F.element_at("heads", 1)), "metadata_placement", "content before the H1", 1),
        issue(placed & (F.size("heads") > 0) & ~F.coalesce(after, F.lit("")).rlike(r"^\**Part of\**\s*:"), "metadata_placement", "the H1 is not followed by the byline", first),
    ]

    parts = name.rlike(r"^(\d+(?:-\d+)*)-(.+)\.md$")
    named = ~name.isin("index.md", "overview.md")
    rules += [
        issue(named & parts & F.regexp_extract(name, r"^(\d+(?:-\d+)*)-(.+)\.md$", 1).rlike(r"(?:^|-)0\d"), "filename_convention", "zero-padded number", 1),
        issue(named & parts & ~F.regexp_extract(name, r"^(\d+(?:-\d+)*)-(.+)\.md$", 2).rlike(r"^[a-z][a-z0-9-]*$"), "filename_convention", "not in kebab case", 1),
        issue(named & ~parts, "filename_convention", "no number", 1, "warning"),
        issue(F.contains("file", F.lit("/")), "flat_structure", "in a subfolder", 1),
    ]

    record = F.col("decision")
    rules += [issue(record & ~name.rlike(r"^\d+(-\d+)*-adr-[a-z]"), "adr_format", "not named N-M-adr-<slug>", 1)]
    rules += [issue(record & ~has(text, f"## {x}"), "adr_format", f"no {x}", 1) for x in ("Context", "Decision", "Consequences")]
    rules += [issue(record & ~has(text, "**Status**:"), "adr_format", "no status", 1)]

    index = F.col("index")
    head = text.rlike(r"(?ds)\A---\s*\n(.*?)\n---\s*\n")
    matter = F.regexp_extract(text, r"(?ds)\A---\s*\n(.*?)\n---\s*\n", 1)
    rules += [missing(index & ~head, "no front matter")]
    for key in ("title", "slug", "description"):
        value = _trim(F.regexp_extract(matter, rf"(?md)^{key}\s*:\s*(\S.*)$", 1))
        rules += [
            missing(index & head & (value == ""), f"no {key} in the front matter"),
            issue(index & head & ~value.rlike("^[\"']") & has(value, ": "), "frontmatter", f"{key} must be quoted", 1),
        ]
    named_slug = F.regexp_replace(_trim(F.regexp_extract(matter, r"(?md)^slug\s*:\s*(\S.*)$", 1)), "^[\"']+|[\"']+$", "")
    links = F.size(F.filter(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\(([^)]+\.md[^)]*)\)"), F.lit(2)), lambda x: ~x.startswith("http")))
    rules += [
        issue(index & head & matter.rlike(r"(?md)^slug\s*:\s*\S") & ~named_slug.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), "frontmatter", "slug is not in kebab case", 1),
        missing(index & ~has(text, "## Overview"), "no Overview"),
        missing(index & (links < 3), F.concat(F.lit("links to section files: "), links.cast("string"))),
        missing(index & ~has(text, "Last indexed") & ~has(text, "Commit"), "no stamp"),
    ]

    def by_line(test, type_: str, said: str, severity: str = "error"):
        return per_line(lines, lambda x, i: issue(test(without_code(x)), type_, said, i, severity))

    more = [
        by_line(lambda x: x.rlike(r"^\s*[-*+]\s+\[[ xX]\]\s"), "unsupported_markdown", "task list"),
        by_line(lambda x: x.rlike(r"\[\^[^\]\s]+\]"), "unsupported_markdown", "footnote", "warning"),
        by_line(lambda x: F.contains(x, F.lit("$$")), "unsupported_markdown", "display math", "warning"),
        by_line(lambda x: x.rlike(BROKEN_BOLD), "cjk_emphasis", "emphasis will not render"),
        table_issues(lines),
    ]
    return _rows(df.select("file", F.concat(F.filter(F.array(*[r.cast(ISSUE) for r in rules]), lambda x: x.isNotNull()), *more).alias("found")))


def headings(text: Column) -> Column:
    """The anchors of a document's headings outside fences."""
    marked = F.filter(outside(text), lambda x: x.rlike(r"^#{1,6}\s+.+$"))
    return F.transform(marked, lambda x: slug(F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1)))


def links(docs: DataFrame) -> DataFrame:
    """(file, line, image, target) of the links outside fences and code spans; addresses of other sites are left out."""
    found = lambda x, g: F.regexp_extract_all(x, F.lit(LINK), F.lit(g))
    lines = F.filter(F.transform(outside(F.coalesce("text", F.lit(""))), lambda x, i: F.struct(without_code(x).alias("x"), (i + 1).alias("line"))), lambda p: F.contains(p["x"], F.lit("](")))
    df = docs.select("file", F.explode(lines).alias("p"))
    df = df.select("file", "p.line", F.explode(F.arrays_zip(found(F.col("p.x"), 1).alias("mark"), found(F.col("p.x"), 3).alias("target"))).alias("l"))
    return df.select("file", "line", (F.col("l.mark") == "!").alias("image"), F.col("l.target").alias("target")).where(~F.col("target").rlike("^(http://|https://|mailto:)"))


def resolved(path: Column) -> Column:
    """A relative path without . and .. parts; null if it leads out of the folder or is absolute."""

    def step(state: Column, part: Column) -> Column:
        up = F.when(F.size(state) > 0, F.slice(state, F.lit(1), F.size(state) - 1))
        return F.when(part.isin("", "."), state).when(part == "..", up).otherwise(F.concat(state, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast(_NO_LINES), step)
    return F.when(~path.startswith("/"), F.array_join(parts, "/"))


def link_issues(docs: DataFrame, assets: DataFrame) -> DataFrame:
    """Images that are not shipped, unknown anchors, anchors of other files, links into folders, missing targets.

    Targets meet the folder's paths (and the folders above them) by equi-joins; images also by base name in any case.
    """
    found = links(docs).withColumn("path", F.split("target", "#")[0])
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    found = found.withColumn("image", F.col("image") | suffix.isin(*IMAGES)).withColumn("at", resolved(F.col("path")))
    files = docs.select(F.col("file").alias("at")).unionByName(assets.select(F.col("path").alias("at")))
    above = files.select(F.split("at", "/").alias("p")).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))).alias("at"))
    there = files.unionByName(above).distinct().withColumn("there", F.lit(True))
    shipped = assets.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*IMAGES)).select(F.lower(_name(F.col("path"))).alias("base")).distinct().withColumn("shipped", F.lit(True))
    found = found.withColumn("base", F.lower(_name(F.col("path")))).join(there, "at", "left").join(shipped, "base", "left")
    own = docs.select("file", headings(F.coalesce("text", F.lit(""))).alias("anchors"))
    found = found.join(own, "file")
    there, page = F.coalesce("there", F.lit(False)) & (F.col("path") != ""), F.col("target").startswith("#") & ~F.col("image")
    other = ~F.col("image") & ~page
    said = lambda x: F.concat(F.lit(f"{x}: "), F.col("target"))
    rules = [
        issue(F.col("image") & ~there & F.col("shipped").isNull(), "broken_image", said("not shipped"), F.col("line")),
        issue(page & (F.length("target") > 1) & ~F.array_contains("anchors", F.substr("target", F.lit(2))), "broken_anchor", said("no such heading"), F.col("line")),
        issue(other & F.col("path").endswith(".md") & F.contains("target", F.lit("#")), "broken_anchor", said("anchor of another file"), F.col("line")),
        issue(other & F.col("path").endswith(".md") & F.contains("path", F.lit("/")), "flat_structure", said("link into a folder"), F.col("line")),
        issue(other & (F.col("path") != "") & ~there, "broken_link", said("no such file"), F.col("line")),
    ]
    return _rows(found.select("file", F.filter(F.array(*[r.cast(ISSUE) for r in rules]), lambda x: x.isNotNull()).alias("found")))


def asset_issues(docs: DataFrame, assets: DataFrame) -> DataFrame:
    """Images that are too large, collide by stem or are never referenced; files and bytes over the export's budget."""
    path = F.col("path")
    images = assets.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*IMAGES)).withColumn("base", F.lower(_name(path))).withColumn("stem", F.regexp_replace(F.lower(_name(path)), r"\.[^.]*$", ""))
    named = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
    used = docs.select(F.explode(named).alias("x")).select(F.lower(_name(F.split("x", "#")[0])).alias("base"))
    used = used.select(F.explode(F.array("base", F.regexp_replace("base", r"(?<=.)\.[^.]*$", ""))).alias("base")).distinct().withColumn("used", F.lit(True))
    seen = F.row_number().over(Window.partitionBy("stem").orderBy("path"))
    images = images.withColumn("seen", seen).join(used, "base", "left").join(used.select(F.col("base").alias("stem"), F.col("used").alias("by_stem")), "stem", "left")
    one = [
        issue(F.col("length") > MOST_IMAGE, "image_assets", F.concat(F.expr("length div 1024").cast("string"), F.lit(" KB")), 0),
        issue(F.col("seen") > 1, "image_assets", "base name collides", 0),
        issue(F.col("used").isNull() & F.col("by_stem").isNull(), "image_assets", "never referenced", 0, "warning"),
    ]
    rows = _rows(images.select(path.alias("file"), F.filter(F.array(*[r.cast(ISSUE) for r in one]), lambda x: x.isNotNull()).alias("found")))
    sizes = images.select("length").unionByName(docs.select(F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("length")))
    total = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    whole = [issue(F.col("n") > MOST_FILES, "image_assets", F.concat(F.col("n").cast("string"), F.lit(" files")), 0), issue(F.col("bytes") > MOST_TOTAL, "image_assets", F.concat(F.expr("bytes div 1024").cast("string"), F.lit(" KB in all")), 0)]
    return rows.unionByName(_rows(total.select(F.lit(".").alias("file"), F.filter(F.array(*[r.cast(ISSUE) for r in whole]), lambda x: x.isNotNull()).alias("found"))))


def orphan_issues(docs: DataFrame) -> DataFrame:
    """Section files that the index does not link to, if there is an index."""
    index = docs.where("file = 'index.md'")
    linked = index.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[([^\]]+)\]\(([^)]+\.md)(?:#[^)]*)?\)"), F.lit(2))).alias("file")).distinct()
    sections = docs.select("file").where((F.col("file") != "index.md") & ~F.contains("file", F.lit("/")) & F.col("file").endswith(".md"))
    lone = sections.join(linked, "file", "left_anti").join(F.broadcast(index.select(F.lit(True).alias("_"))))  # the index is one row, or none
    return lone.select(F.lit("index.md").alias("file"), F.lit(1).alias("line"), F.lit("cross_reference").alias("type"), F.lit("error").alias("severity"), F.concat(F.lit("not linked: "), F.col("file")).alias("message"))


def lint(docs: DataFrame, assets: DataFrame) -> DataFrame:
    """All diagnostics of a folder: (file, line, type, severity, message).

    docs (file, text) are the Markdown files by relative path, assets (path, length) the others. A null text is empty.
    """
    out = document_issues(docs)
    for more in (diagram_issues(docs), link_issues(docs, assets), asset_issues(docs, assets), orphan_issues(docs)):
        out = out.unionByName(more)
    return out

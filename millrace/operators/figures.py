"""Rules over figures cut from pages: tables of figures, text blocks, drawings and pages instead of page objects.

figures: paper, fig_num, page, caption, x0, y0, x1, y1 (the cut), caption_y1, width, height, suspect, suspect_reason
blocks:  paper, page, x0, y0, x1, y1, text (lines joined by blanks), n_lines, size (the most frequent font size)
pages:   paper, page, width, height, header_y1, left, right, body_size; papers: paper, title
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.rules import ISSUE, issue

# Captions of figures (strict with a delimiter, loose with a blank), panel labels, verbs of sentences that refer to a figure.
STRICT = r"(?i)^(?:Fig\.?\s*(\d+)|Figure\s+(\d+)|FIGURE\s+(\d+))\s*(?:[a-z]|\([a-z]\))?\s*[:.|]"
LOOSE = r"(?i)^(?:Fig\.?\s*(\d+)|Figure\s+(\d+)|FIGURE\s+(\d+))\s*(?:[a-z]|\([a-z]\))?\s+\S"
PANEL = r"\(([a-z])\)"
VERBS = (
    "shows?", "showing", "illustrated?s?", "illustrating", "demonstrates?", "demonstrating", "presents?", "presenting", "compares?", "comparing", "depicts?", "depicting", "displays?", "displaying", "visualizes?",
    "visualizing", "plots?", "plotting", "summarizes?", "summarizing", "indicates?", "indicating", "reveals?", "revealing", "reports?", "reporting", "describes?", "describing", "provides?", "providing", "highlights?",
    "highlighting", "outlines?", "outlining", "captures?", "capturing", "contains?", "containing", "gives?", "giving", "lists?", "listing", "details?", "detailing", "explains?", "explaining", "represents?",
    "representing", r"is\s+(?:a|an|the)", "was", "are", "were", "can", "also", "that", "where", "which", "how", r"in\s+(?:the|this|our)",
)
REFERS = r"(?i)^(?:Fig\.?\s*\d+|Figure\s+\d+)\s*(?:\([a-z]\)\s*)?((?:" + "|".join(VERBS) + r")\b)"
ALGORITHMS = ("function", "return", "for each", "for all", "while", "end for", "end while", "end if", "end function", "require:", "ensure:")
NUMBER = r"^[\d]+\.?[\d]*%?$"
HEADS = r"(?i)^(Appendices|Appendix|References|Acknowledgments?|Bibliography)\s*$"
STAMP = r"arXiv:\d{4}\.\d{4,5}"
# Shares of the body's font size, of the content's width, and of a figure's or page's height.
SMALL, TINY, LARGE, NOTE = 0.85, 0.70, 1.15, 0.92
TOP, ZONE, RULE, TALL = 0.15, 50, 0.6, 0.68


def caption_number(line: Column) -> Column:
    """(number, is_loose) of a line that is a caption; null of any other. Strict captions go first."""
    number = lambda p: F.coalesce(*[F.nullif(F.regexp_extract(line, p, g), F.lit("")).cast("int") for g in (1, 2, 3)])
    return F.when(line.rlike(STRICT), F.struct(number(STRICT).alias("number"), F.lit(False).alias("is_loose"))).when(line.rlike(LOOSE), F.struct(number(LOOSE).alias("number"), F.lit(True).alias("is_loose")))


def in_column(x0: Column, x1: Column, left: Column, right: Column, full_width: Column, slack: float = 5) -> Column:
    """Whether a block stands in a caption's column: their ranges of x meet, with some slack; any does if the caption is of full width."""
    return full_width | ~((x1 < left - slack) | (x0 > right + slack))


def figure_drawing(x0: Column, y0: Column, x1: Column, y1: Column, caption_top: Column, upper: Column, left: Column, right: Column, page_width: Column) -> Column:
    """Whether a drawing counts for a figure's extent: between the upper limit and the caption, within its range of x
    (20 more on each side), neither a dot nor a rule across the page."""
    w, h = x1 - x0, y1 - y0
    return ~((y1 > caption_top + 5) | (y0 < upper)) & ~((x1 < left - 20) | (x0 > right + 20)) & ~((w < 2) & (h < 2)) & ~((h < 2) & (w > page_width * 0.8))


def is_body(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, n_lines: Column, size: Column, content_width: Column, body_size: Column) -> Column:
    """Whether a block is body text or a heading and not part of a figure: the first rule that fits decides.

    A caption is not. If both font sizes are known, clearly smaller text is a figure's unless it is wide and long, and
    clearly larger text of up to 60 points in height is a heading. Then come width, lines, heading numbers and rows of a table.
    """
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    wide = F.when(content_width > 0, (x1 - x0) / content_width).otherwise(0.0)
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    numbers = F.filter(tokens, lambda t: t.rlike(NUMBER))
    numeric = (F.size(tokens) >= 3) & (F.size(numbers) == F.size(tokens))
    ratio = F.when(size.isNotNull() & body_size.isNotNull(), F.try_divide(size, body_size))
    n = F.length(text)
    return (
        F.when(text.rlike(STRICT), False)
        .when((ratio < SMALL) & ((n_lines < 4) | (ratio < TINY) | (wide < 0.5) | numeric), False)
        .when((ratio > LARGE) & (y1 - y0 < 60), True)
        .when((n_lines >= 2) & (wide > 0.5) & (n > 30), True)
        .when((n_lines >= 5) & (wide > 0.15) & (n > 30), True)
        .when((wide > 0.75) & (n > 40), True)
        .when(text.rlike(r"^\d+(\.\d+)*\.\s+\S") & (n >= 8) & (wide > 0.4), True)
        .when(text.rlike(r"^\d+\.\d+(\.\d+)?\s+[A-Z][a-z]") & (wide > 0.35), True)
        .when(text.rlike(r"^[A-Z]\.\s+\S") & (n >= 8) & (wide > 0.4), True)
        .when(text.rlike(HEADS) & (wide > 0.2), True)
        .when((n_lines == 1) & (wide > 0.5) & (n > 15) & (F.size(tokens) >= 4) & (F.size(numbers) >= 2), True)
        .otherwise(False)
    )


def is_algorithm(text: Column) -> Column:
    """Pseudocode: a numbered header, or two keywords of it."""
    hits = sum((F.contains(F.lower(text), F.lit(k)).cast("int") for k in ALGORITHMS), F.lit(0))
    return text.rlike(r"^(Algorithm|Procedure)\s+\d+") | (hits >= 2)


def inside(figures: DataFrame, others: DataFrame, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> DataFrame:
    """Figures (f) with what overlaps their cut on the same page (b); touching edges do not overlap. An equi-join on the page."""
    at = others.select("paper", "page", F.struct(*[c for c in others.columns if c not in ("paper", "page")]).alias("b"))
    met = figures.select("paper", "page", F.struct(*figures.columns).alias("f")).join(at, ["paper", "page"])
    return met.where((F.col("b.x1") > F.col(f"f.{x0}")) & (F.col("b.x0") < F.col(f"f.{x1}")) & (F.col("b.y1") > F.col(f"f.{y0}")) & (F.col("b.y0") < F.col(f"f.{y1}")))


def _rows(df: DataFrame) -> DataFrame:
    return df.select("paper", "fig_num", F.explode("found").alias("i")).select("paper", "fig_num", "i.type", "i.severity", "i.message")


def _found(rules: list[Column]) -> Column:
    return F.filter(F.array(*[r.cast(ISSUE) for r in rules]), lambda x: x.isNotNull()).alias("found")


def body_text_issues(figures: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Body text in the top part of a figure or below its caption: HIGH if it is long and of the body's font size."""
    met = inside(figures, blocks).join(pages.select("paper", "page", (F.col("right") - F.col("left")).alias("_wide"), "body_size"), ["paper", "page"])
    b = lambda c: F.col(f"b.{c}")
    caption = b("text").rlike(STRICT) | b("text").rlike(LOOSE)
    body = is_body(b("text"), b("x0"), b("y0"), b("x1"), b("y1"), b("n_lines"), b("size"), F.col("_wide"), F.col("body_size"))
    met = met.where(~caption & body & ~is_algorithm(b("text")))
    small = F.coalesce(F.try_divide(b("size"), F.col("body_size")) < NOTE, F.lit(False))
    high = ~small & (F.length(F.trim(b("text"))) > 40)
    top = b("y0") < F.col("f.y0") + (F.col("f.y1") - F.col("f.y0")) * TOP
    below = b("y0") > F.coalesce("f.caption_y1", "f.y1")
    rules = [issue(when & (high if level == "HIGH" else ~high), "body_text", F.concat(F.lit(f"{where}: "), F.left(b("text"), F.lit(100))), severity=level) for where, when in (("at the top", top), ("below the caption", below)) for level in ("HIGH", "MEDIUM")]
    return _rows(met.select("paper", F.col("f.fig_num").alias("fig_num"), _found(rules)))


def header_issues(figures: DataFrame, blocks: DataFrame, drawings: DataFrame, pages: DataFrame, papers: DataFrame) -> DataFrame:
    """A cut that starts above the page's header (then nothing else is said); a title or stamp near its top; a rule above all else in it."""
    at = figures.join(pages.select("paper", "page", F.col("width").alias("page_width"), "header_y1"), ["paper", "page"])
    above = F.col("y0") < F.col("header_y1") - 2
    first = _rows(at.select("paper", "fig_num", _found([issue(above, "header", "reaches into the page header", severity="HIGH")])))
    rest = at.where(~F.coalesce(above, F.lit(False)))
    met = inside(rest.withColumn("zone_y1", F.least(F.col("y0") + ZONE, F.col("y1"))), blocks, y1="zone_y1").join(papers, "paper", "left")
    title = (F.length("title") > 15) & F.contains(F.lower("b.text"), F.lower(F.left("title", F.lit(30))))
    near = _rows(met.select("paper", F.col("f.fig_num").alias("fig_num"), _found([issue(title, "header", "the paper's title at the top", severity="MEDIUM"), issue(F.col("b.text").rlike(STAMP), "header", "an identifier at the top", severity="MEDIUM")])))
    keys = ["paper", "page", "fig_num"]
    content = inside(rest, blocks).groupBy("paper", "page", F.col("f.fig_num").alias("fig_num")).agg(F.min("b.y0").alias("content_y0"))
    ruled = rest.join(content, keys, "left").withColumn("content_y0", F.coalesce("content_y0", "y1")).select(*keys, F.col("y0").alias("cut_y0"), "content_y0", "page_width")
    rule = (F.col("y0") >= F.col("cut_y0")) & (F.col("y0") < F.col("content_y0") - 5) & (F.col("y1") - F.col("y0") < 3) & (F.col("x1") - F.col("x0") > F.col("page_width") * RULE)
    lines = _rows(ruled.join(drawings.select("paper", "page", "x0", "y0", "x1", "y1"), ["paper", "page"]).select("paper", "fig_num", _found([issue(rule, "header", "a rule above the content", severity="HIGH")])))
    return first.unionByName(near).unionByName(lines)


def caption_issues(figures: DataFrame, lines: DataFrame) -> DataFrame:
    """Captions that are sentences (a verb in lower case), hardly say a thing, or are loose where a strict one (paper, line) exists."""
    caption = F.coalesce("caption", F.lit(""))
    verb = F.regexp_extract(caption, REFERS, 1)
    left = F.regexp_replace(F.trim(F.replace(caption, F.concat(F.lit("Figure "), F.col("fig_num").cast("string")), F.lit(""))), r"^(Fig\.?\s*\d+|FIGURE\s+\d+)\s*[:.|]?\s*", "")
    found = caption_number(F.trim("line"))
    strict = lines.select("paper", found.alias("c")).where("c is not null and not c.is_loose").select("paper", F.col("c.number").alias("fig_num"), F.lit(True).alias("strict")).distinct()
    loose = ~caption.rlike(STRICT) & caption.rlike(LOOSE)
    rules = [
        issue((verb != "") & ~verb.rlike(r"^\p{Lu}"), "caption_mismatch", F.concat(F.lit("a sentence: "), verb), severity="HIGH"),
        issue((F.length(left) < 5) & ~caption.startswith("Figure") & ~caption.startswith("Fig"), "caption_mismatch", "hardly any text", severity="MEDIUM"),
        issue(loose & F.coalesce("strict", F.lit(False)), "caption_mismatch", "a strict caption exists", severity="HIGH"),
    ]
    return _rows(figures.join(strict, ["paper", "fig_num"], "left").select("paper", "fig_num", _found(rules)))


def partial_issues(figures: DataFrame, blocks: DataFrame) -> DataFrame:
    """Panels (at least two labels) that the caption names and no text within the cut does."""
    labels = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(PANEL), F.lit(1)))
    all_ = F.regexp_extract_all(F.coalesce("caption", F.lit("")), F.lit(PANEL), F.lit(1))
    many = figures.where(F.size(all_) >= 2)
    seen = inside(many, blocks).groupBy("paper", "page", F.col("f.fig_num").alias("fig_num")).agg(F.array_distinct(F.flatten(F.collect_set(labels(F.col("b.text"))))).alias("seen"))
    lost = F.array_sort(F.array_except(F.array_distinct(all_), F.coalesce("seen", F.array().cast("array<string>"))))
    return _rows(many.join(seen, ["paper", "page", "fig_num"], "left").select("paper", "fig_num", _found([issue(F.size(lost) > 0, "partial", F.concat(F.lit("panels not found: "), F.array_join(lost, ",")), severity="HIGH")])))


def numbering_issues(figures: DataFrame, lines: DataFrame) -> DataFrame:
    """Numbers that are missing between the first and the last (HIGH if the text names them), and numbers that repeat."""
    from millrace.operators.match import numbering_gaps

    named = lines.select("paper", F.explode(F.regexp_extract_all("line", F.lit(r"(?:Fig\.?\s*|Figure\s+|FIGURE\s+)(\d+)"), F.lit(1))).alias("n")).select("paper", F.col("n").cast("int").alias("fig_num"), F.lit(True).alias("named")).distinct()
    gaps = numbering_gaps(figures, ["paper"], "fig_num").join(named, ["paper", "fig_num"], "left")
    named_ = F.coalesce("named", F.lit(False))
    gaps = _rows(gaps.select("paper", "fig_num", _found([issue(named_, "numbering", "missing, and the text names it", severity="HIGH"), issue(~named_, "numbering", "missing", severity="INFO")])))
    again = figures.groupBy("paper", "fig_num").agg(F.count("*").alias("n"))
    return gaps.unionByName(_rows(again.select("paper", "fig_num", _found([issue(F.col("n") > 1, "numbering", F.concat(F.col("n").cast("string"), F.lit(" times")), severity="HIGH")]))))


# What text read from an image shows to be prose, a page header, or the text below a figure.
PROSE = ("Quantitative experiments", "Qualitative results", "Ablation study", "Main results", "Experimental setup", r"^\d+\.\d+\.?\s+[A-Z]", "^(The|We|This|In|For|Abstract|Introduction|Conclusion)")
HEADERS = (
    (r"arXiv:\d{4}\.\d{4,5}(v\d+)?", "arXiv stamp"), (r"(?i)\bPreprint\b", "Preprint marker"), (r"(?i)\bUnder review\b", "Under-review marker"), (r"(?i)\bWork in progress\b", "WIP marker"), (r"(?i)\bTechnical Report\b", "Technical Report header"),
    (r"\bAccepted (at|to) ", "Acceptance notice"), (r"\bPublished as a conference paper at ", "Conference notice"), (r"\bConference on \w+", "Conference name"), (r"\bProceedings of ", "Proceedings header"), (r"(?m)^\s*\d+\s*$", "Standalone page number"),
)
BELOW = ("Figure", "The ", "We ", "This ", "In ")


def first_header(text: Column) -> Column:
    """The label of the first header pattern (in their order) that the first fifth of a text shows; null if none does."""
    head = F.left(text, F.greatest(F.lit(1), F.floor(F.length(text) * 0.2).cast("int")))
    return F.coalesce(*[F.when(head.rlike(p), F.lit(label)) for p, label in HEADERS])


def table_hits(text: Column) -> Column:
    """Lines with two bars, plus lines whose first three tokens are numbers; a line may count twice."""
    lines = F.split(text, "\n")
    tokens = lambda x: F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")
    number = lambda t: F.regexp_replace(t, r"[.\-]", "").rlike(r"^\p{Nd}+$")
    barred = F.size(F.filter(lines, lambda x: x.rlike(r"\|.*\|")))
    return barred + F.size(F.filter(lines, lambda x: (F.size(tokens(x)) >= 3) & F.forall(F.slice(tokens(x), 1, 3), number)))


def prose(text: Column) -> Column:
    """Whether two lines of over 20 characters look like prose."""
    fits = lambda x: F.exists(F.array(*map(F.lit, PROSE)), lambda p: F.regexp_like(x, p))
    return F.size(F.filter(F.split(text, "\n"), lambda x: (F.length(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")) > 20) & fits(x))) >= 2


def image_text_verdict(text: Column, bottom: Column) -> Column:
    """(category, severity, message) of the first rule that fits the text read from a figure; null for a clean one.

    text is all of it, bottom that of the lowest 15 % of the image.
    """
    row = lambda category, severity, said: F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), said.alias("message"))
    header = first_header(text)
    low = F.regexp_replace(bottom, r"(?U)^\s+|\s+$", "")
    leak = sum((F.contains(F.left(low, F.lit(100)), F.lit(w)).cast("int") for w in BELOW), F.lit(0)) > 0
    return (
        F.when(prose(text), row("BODY_TEXT_MISCLASS", "CRITICAL", F.lit("body text")))
        .when(header.isNotNull(), row("PAGE_HEADER_LEAKAGE", "HIGH", header))
        .when(table_hits(text) >= 3, row("WRONG_PANEL", "CRITICAL", F.lit("a table")))
        .when((F.length(low) > 10) & leak, row("CAPTION_LEAKAGE", "MEDIUM", F.lit("caption or body text at the bottom")))
    )

"""Lint, grounding, figures and markup: one fixture for each rule, with what the rule's description demands."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import markup, text
from millrace.operators import doclint, figures, grounding


def one(spark, expr, *values):
    frame = spark.createDataFrame([values], ", ".join(f"x{i} string" for i in range(len(values))))
    return frame.select(expr(*[F.col(f"x{i}") for i in range(len(values))])).first()[0]


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, text string")


def test_lines_outside_fences_keep_their_numbers(spark):
    for sample in ("a\n```\nb\n```\nc", "```py\nx\n```", "a\n  ```\nb", "", "\n\n", "```\n```\n```\nz\n```\ne\n", "no fence\nat all\n"):
        want, inside = [], False
        for line in sample.split("\n"):
            mark = line.strip().startswith("```")
            want.append("" if mark or inside else line)
            inside ^= mark
        got = one(spark, doclint.outside, sample)
        assert got[: len(want)] == want and not any(got[len(want) :]), sample


def found(frame):
    return sorted((r.line, r.type, r.message) for r in frame.collect())


def test_diagrams(spark):
    flow = "# T\n```mermaid\nflowchart TD\n%% note\nmy node[x] --> b\na --> b(open\na -- b\nclassDef x fill:#fff\nsubgraph s\nend\nend\nsubgraph t\n```\ntext"
    got = found(doclint.diagram_issues(docs(spark, ("1-a.md", flow))))
    assert got == [
        (3, "mermaid_syntax", "1 ( without )"), (3, "mermaid_syntax", "1 subgraphs without an end"), (5, "mermaid_syntax", "blank in node id my node"), (7, "mermaid_syntax", "not an arrow"), (8, "mermaid_hardcoded_style", "a fixed colour"),
        (11, "mermaid_syntax", "end without a subgraph"),
    ]
    steps = "```mermaid\nsequenceDiagram\nA->>B: hi [x\nloop x y\nend\nend\n```\n```mermaid\nnever closed --\n"
    assert found(doclint.diagram_issues(docs(spark, ("1-a.md", steps)))) == [(2, "mermaid_syntax", "1 [ without ]")]
    assert found(doclint.diagram_issues(docs(spark, ("x.md", None), ("y.md", "```js\nmy node[x]\n```")))) == []


def test_tables_of_a_document(spark):
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n| 1 |\nno\n| c | d |\n| x | y |\n| 1 |\n\n```\n| a | b |\n| c |\n```"
    got = [x[:1] + x[2:] for x in found(doclint.document_issues(docs(spark, ("1-a.md", table)))) if x[1] == "table_format"]
    assert got == [(4, "column count"), (7, "bad separator"), (8, "column count")]


def test_links_of_a_folder(spark):
    files = docs(spark, ("index.md", "[s](1-a.md) [t](gone.md) ![p](X.PNG) ![q](img/none.png)"), ("1-a.md", "# A b\n## Größe!\n[x](#a-b) [y](#gre) [z](#größe) [w](#)\n`[c](no.md)`\n[d](index.md#x) [e](http://a.b/c.md) [f](sub/n.md) [g](./img/)"), ("sub/n.md", "# N"))
    assets = spark.createDataFrame([("img/x.png", 5)], "path string, length long")
    got = sorted((r.file, r.line, r.type, r.message) for r in doclint.link_issues(files, assets).collect())
    assert got == [
        ("1-a.md", 3, "broken_anchor", "no such heading: #größe"), ("1-a.md", 5, "broken_anchor", "anchor of another file: index.md#x"), ("1-a.md", 5, "flat_structure", "link into a folder: sub/n.md"),
        ("index.md", 1, "broken_image", "not shipped: img/none.png"), ("index.md", 1, "broken_link", "no such file: gone.md"),
    ]
    assert [r.message for r in doclint.orphan_issues(files).collect()] == []
    assert [r.message for r in doclint.orphan_issues(docs(spark, ("index.md", "[a](1-b.md)"), ("1-a.md", ""), ("1-b.md", ""))).collect()] == ["not linked: 1-a.md"]
    assert doclint.orphan_issues(docs(spark, ("1-a.md", ""))).count() == 0  # no index


def test_assets_of_a_folder(spark):
    files = docs(spark, ("index.md", "![a](one.png) ![b](TWO.svg#x)"))
    assets = spark.createDataFrame([("one.png", 6 << 20), ("b/one.jpg", 5 << 20), ("two.svg", 1), ("three.gif", 1), ("notes.txt", 9 << 20)] + [(f"p{i}.png", 1) for i in range(50)], "path string, length long")
    got = sorted((r.file, r.severity, r.message) for r in doclint.asset_issues(files, assets).collect() if not r.file.startswith("p"))
    assert got == [(".", "error", "11264 KB in all"), (".", "error", "55 files"), ("one.png", "error", "6144 KB"), ("one.png", "error", "base name collides"), ("three.gif", "warning", "never referenced")]


def test_whole_lint_of_an_empty_folder_and_null_texts(spark):
    assets = spark.createDataFrame([], "path string, length long")
    assert doclint.lint(spark.createDataFrame([], "file string, text string"), assets).count() == 0
    kinds = {r.type for r in doclint.lint(docs(spark, ("3-x.md", None)), assets).collect()}
    assert kinds == {"missing_section", "word_count", "metadata_placement"}


def test_fences_that_only_a_bare_one_closes(spark):
    sample = ["a", "```py", "x", "~~~sh", "```", "b", "````", "c"]
    got = one(spark, lambda x: F.transform(grounding.fence_pairs(F.split(x, "\n")), lambda p: F.concat_ws(":", p["start"], F.coalesce(p["end"].cast("string"), F.lit("-")), p["lang"])), "\n".join(sample))
    assert got == ["2:5:py", "7:-:"]


def test_snippets_against_their_sources(spark):
    source = "import os\n\ndef f(x):\n    return x + 1  # plus\n\nvalue = f(3)\n"
    sources = grounding.with_lines(spark.createDataFrame([("src/a.py", source), ("empty.py", "")], "path string, text string"))
    fence = lambda lang, *lines: "\n".join([f"```{lang}", *lines, "```"])
    text_ = "\n".join(
        [
            fence("python", "# From: src/a.py:3-4, :6", "def f(x):", "    return x + 1", "# added by hand", "...", "value = f(3)"),
            fence("python", "# From: src/a.py:1-2", "def f(x):", "    return x + 1", "import os"),
            fence("js", "// From: gone.js:1", "x"),
            fence("python", "# From: src/a.py:3-9", "x"),
            fence("go", "a := 1", "b := 2", "c := 3", "d := 4", "e := 5"),
            fence("go", "a := 1", "", "b := 2"),
            fence("text", *"abcdefg"),
            fence("python", "# From: empty.py:1-1", "x"),
        ]
    )
    got = sorted((r.line, r.type, r.severity, r.message) for r in grounding.snippet_issues(docs(spark, ("w.md", text_)), sources).collect())
    assert [(g[0], g[1]) for g in got] == [(10, "snippet_mismatch"), (16, "snippet_attr_ref"), (20, "snippet_attr_ref"), (24, "snippet_unattributed"), (45, "snippet_attr_ref")]
    assert got[0][3] == "1/3 lines match; not: def f(x): | return x + 1" and got[1][3] == "no such file: gone.js" and got[2][3] == "src/a.py:3-9 is out of range" and got[3][2] == "warning"
    wrong = docs(spark, ("w.md", "`src/a.py:2-9` `src/a.py:5-2` `src/a.py:6` `no.py:1`"))
    assert sorted(r.message for r in grounding.citation_issues(wrong, sources).collect()) == ["no such file: no.py", "src/a.py:2-9 is out of range", "src/a.py:5-2 ends before it starts"]


FIGURES = "paper string, fig_num int, page int, caption string, x0 double, y0 double, x1 double, y1 double, caption_y1 double"
BLOCKS = "paper string, page int, x0 double, y0 double, x1 double, y1 double, text string, n_lines int, size double"
PAGES = "paper string, page int, width double, height double, header_y1 double, left double, right double, body_size double"


def cut(spark, *rows):
    return spark.createDataFrame([("p", n, 1, caption, 0.0, y0, 100.0, 200.0, 180.0) for n, caption, y0 in rows], FIGURES)


def messages(frame):
    return sorted((r.fig_num, r.severity, r.message) for r in frame.collect())


def test_body_text_in_a_figure(spark):
    long = "words of a paragraph that goes on and on, over the whole width"
    blocks = [
        ("p", 1, 0.0, 105.0, 95.0, 115.0, long, 3, 10.0), ("p", 1, 0.0, 185.0, 95.0, 190.0, long, 3, 9.0), ("p", 1, 0.0, 105.0, 95.0, 110.0, "Figure 1: " + long, 2, 10.0), ("p", 1, 0.0, 106.0, 95.0, 111.0, "Algorithm 1 " + long, 2, 10.0),
        ("p", 1, 0.0, 90.0, 95.0, 100.0, long, 3, 10.0), ("p", 2, 0.0, 105.0, 95.0, 115.0, long, 3, 10.0), ("p", 1, 0.0, 107.0, 50.0, 112.0, "References", 1, 10.0),
    ]
    page = spark.createDataFrame([("p", 1, 600.0, 800.0, 50.0, 0.0, 100.0, 10.0)], PAGES)
    got = messages(figures.body_text_issues(cut(spark, (1, "Figure 1: x", 100.0)), spark.createDataFrame(blocks, BLOCKS), page))
    assert [(g[1], g[2][:12]) for g in got] == [("HIGH", "at the top: "), ("MEDIUM", "at the top: "), ("MEDIUM", "below the ca")]


def test_headers_in_a_figure(spark):
    blocks = spark.createDataFrame([("p", 1, 0.0, 110.0, 90.0, 120.0, "A Rather Long Title Of The Paper, 2024", 1, 10.0), ("p", 1, 0.0, 130.0, 90.0, 135.0, "arXiv:2401.01234v1", 1, 10.0), ("p", 1, 0.0, 190.0, 90.0, 199.0, "arXiv:2401.01234v1", 1, 10.0)], BLOCKS)
    page = spark.createDataFrame([("p", 1, 150.0, 800.0, 95.0, 0.0, 100.0, 10.0)], PAGES)
    papers = spark.createDataFrame([("p", "A rather long title of the paper")], "paper string, title string")
    drawings = spark.createDataFrame([("p", 1, 0.0, 102.0, 95.0, 103.0), ("p", 1, 0.0, 150.0, 95.0, 151.0), ("p", 1, 0.0, 102.0, 50.0, 103.0)], "paper string, page int, x0 double, y0 double, x1 double, y1 double")
    got = messages(figures.header_issues(cut(spark, (1, "", 100.0), (2, "", 80.0)), blocks, drawings, page, papers))
    assert got == [(1, "HIGH", "a rule above the content"), (1, "MEDIUM", "an identifier at the top"), (1, "MEDIUM", "the paper's title at the top"), (2, "HIGH", "reaches into the page header")]


def test_captions_and_panels(spark):
    given = cut(spark, (1, "Figure 1 shows the thing", 0.0), (2, "Figure 2 Showcases of it", 0.0), (3, "Fig. 3: (a) one (b) two (c) three", 0.0), (4, "x", 0.0), (5, "Figure 5 in the main", 0.0), (6, "Figure 6: (a) only", 0.0))
    lines = spark.createDataFrame([("p", "Figure 2: a real caption"), ("p", "Figure 9. other"), ("q", "Figure 1: of another")], "paper string, line string")
    assert messages(figures.caption_issues(given, lines)) == [(1, "HIGH", "a sentence: shows"), (2, "HIGH", "a strict caption exists"), (4, "MEDIUM", "hardly any text"), (5, "HIGH", "a sentence: in the")]
    blocks = spark.createDataFrame([("p", 1, 0.0, 10.0, 50.0, 20.0, "(a) left", 1, 9.0), ("p", 1, 300.0, 10.0, 350.0, 20.0, "(b) outside", 1, 9.0)], BLOCKS)
    assert messages(figures.partial_issues(given, blocks)) == [(3, "HIGH", "panels not found: b,c")]


def test_tex_runs_of_text():
    assert markup.tex_inline(r"\textbf{a} \emph{b \texttt{c}} $x_1\times y$ 50\% \cite{k}~\href{http://a}{b} --- ``q'' % gone") == '**a** *b `c`* $x_1\\times y$ 50% [b](http://a) — "q"'
    assert markup.tex_inline(r"see（如图~\ref{f}所示）end \footnote{n} \texttt{c}\quad d\\[2pt] e") == "seeend (n) `c` d e"
    assert markup.tex_inline(r"\multicolumn{2}{c}{x} \url{u} a\,b \textbf{$\frac{1}{2}$}") == r"x <u> ab **$\frac{1}{2}$**"


def test_tex_documents():
    tex = r"""\documentclass{x}
\begin{document}
\papertitle{A \textbf{T}}
\paperdate{\today}
\section{One $\mathbf{x}$}
Some text, % comment
goes on.

\begin{itemize}
\item first
 more
\item[b] second
\begin{enumerate}
\item inner
\end{enumerate}
\end{itemize}
\begin{table}
\begin{tabular}{ll}
\toprule
a & b \\
\midrule
c \& d & e \\[4pt]
f \\
\end{tabular}
\caption{x}
\end{table}
\begin{figure}[t]
\includegraphics[width=1cm]{f/a.png}
\caption{A \emph{nice} one}
\end{figure}
\[
E = mc^2
\]
\begin{align*}
a &= b
\end{align*}
\begin{lstlisting}[language=Python]
x = 1 % kept
\end{lstlisting}
\begin{keyinsight}[TL;DR]
short
\end{keyinsight}
\paragraph{Run in} rest
\newpage
\begin{algorithm}
gone
\end{algorithm}
\end{document}
after"""
    assert markup.tex_to_markdown(tex) == """# A **T**

# One $\\mathbf{x}$

Some text, goes on.

- first more
- (b) second

  - inner

| a | b |
| --- | --- |
| c & d | e |
| f |  |

![A *nice* one](f/a.png)

$$
E = mc^2
$$

$$
\\begin{aligned}
a &= b
\\end{aligned}
$$

```python
x = 1 % kept
```

> **TL;DR**: short

**Run in**

rest

---
"""


def test_styled_runs(spark):
    got = one(spark, markup.styled_runs, "a **b *c* d** `e**` $x$ [l **m**](u v) {red:r {x}} ~~s~~")
    shown = [(r.kind, r.content, "".join(k[0] for k in ("bold", "italic", "strike", "code") if r[k]), r.colour, r.link) for r in got]
    assert shown == [
        ("text", "a ", "", None, None), ("text", "b ", "b", None, None), ("text", "c", "bi", None, None), ("text", " d", "b", None, None), ("text", " ", "", None, None), ("text", "e**", "c", None, None), ("text", " ", "", None, None), ("equation", "x", "", None, None), ("text", " ", "", None, None),
        ("text", "l ", "", None, "u%20v"), ("text", "m", "b", None, "u%20v"), ("text", " ", "", None, None), ("text", "r {x}", "", 1, None), ("text", " ", "", None, None), ("text", "s", "s", None, None),
    ]
    assert [r.content for r in one(spark, markup.styled_runs, "")] == [""] and one(spark, markup.styled_runs, None) is None


def test_blocks(spark):
    source = "## H\n\nline one\nline two\n- a\n  - b\n- c\n\n1. x\n```py\ncode\n```\n---\n> q\n> r\n\n> [!callout icon=star bg=3]\n> inside\n|> kept\n$$\ny\n$$\n| a | b |\n|---|---|\n| c |\n![alt](p.png)\n| no table\n$z$"
    rows = one(spark, markup.block_rows, source)
    got = [(r.parent, r.kind, r.level, r.text) for r in rows]
    assert got == [
        (None, "heading", 2, "H"), (None, "paragraph", None, "line one line two"), (None, "bullet", None, "a"), (2, "bullet", None, "b"), (None, "bullet", None, "c"), (None, "ordered", None, "x"), (None, "code", None, "code"), (None, "divider", None, ""),
        (None, "quote", None, "q r"), (None, "callout", None, ""), (9, "paragraph", None, "inside"), (None, "quote_container", None, ""), (11, "paragraph", None, "kept"), (None, "equation", None, "y"), (None, "table", 2, ""), (14, "cell", 0, "a"),
        (14, "cell", 0, "b"), (14, "cell", 1, "c"), (14, "cell", 1, ""), (None, "image", None, "alt"), (None, "paragraph", None, "| no table"), (None, "equation", None, "z"),
    ]
    assert rows[6].attributes == {"language": "py"} and rows[9].attributes == {"icon": "star", "behind": "3"} and one(spark, markup.block_rows, "\n\n") == []


def test_diffs_and_formats(spark):
    assert one(spark, markup.text_diff, "a\nb\nc", "a\nx\nc") == "--- old\n+++ new\n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c"
    assert one(spark, markup.text_diff, "a", "a") == ""
    frame = spark.createDataFrame([(-2.25,), (1700.5,), (2.675,), (None,)], "x double")
    assert [tuple(r) for r in frame.select(text.formatted(F.col("x"), "+.1f"), text.formatted(F.col("x"), "+.0f"), text.formatted(F.col("x"), ".2f")).collect()] == [("-2.2", "-2", "-2.25"), ("+1700.5", "+1700", "1700.50"), ("+2.7", "+3", "2.67"), (None, None, None)]
    assert one(spark, text.quoted, "http://a.b/c d?e=é~*#x%20") == "http://a.b/c%20d?e=%C3%A9~%2A#x%20"
    assert one(spark, text.unquoted, "a%20b+c%") == "a%20b+c%" and one(spark, text.unquoted, "a%20b+c") == "a b+c"


@pytest.mark.parametrize(("raw", "to"), [("  a: b/c.  ", "a_ b_c"), ("...", "untitled"), ("", "untitled"), ("x" * 300, "x" * 200), ('<>"|', "____")])
def test_file_names(spark, raw, to):
    assert one(spark, text.file_name, raw) == to


@pytest.mark.parametrize(("raw", "to"), [("Café menu", "caf-menu"), ("a  b", "a-b"), (" **B_c** `d` [e](f) ", "b_c-d-e"), ("![i](x) 汉 <b>y</b>", "i-y"), ("[](u) x", "u-x"), ("****x", "x")])
def test_slugs(spark, raw, to):
    assert one(spark, text.slug, raw) == to

"""Queries of the rule engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import doclint, figures, grounding, rules
from millrace.plans.registry import query, read


_NAMES = "case doc_id % 7 when 0 then 'index.md' when 1 then '0' || (doc_id % 10) || '-Design_x.md' when 2 then '9-1-adr-use-x.md' when 3 then 'system.md' when 4 then 'overview.md' when 5 then '3-x.md' else '3-1-topic.md' end"
_TEXTS = """case doc_id % 5 when 0 then e'# Title\\n\\n**Part of**: [x](index.md)\\n' || text when 1 then e'intro $$x$$\\n# A\\n- [ ] task [^1]\\n# B `a.py:3`\\n' || text when 2 then e'## Introduction\\n' || text || e'\\n# Summary\\n'
  when 3 then e'---\\ntitle: a: b\\nslug: Bad Slug\\n---\\n## Overview\\nCommit [a](1-a.md) [b](2-b.md) **x)**漢\\n' || text else e'```\\n# not one\\n```\\n' || text end"""


def _lint_docs(spark, sf_dir):
    """Documents as files of a folder: names and heads that make each rule fire somewhere."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id") % 7
    name = F.when(k == 0, "index.md").when(k == 1, F.concat(F.lit("0"), (F.col("doc_id") % 10).cast("string"), F.lit("-Design_x.md"))).when(k == 2, "9-1-adr-use-x.md").when(k == 3, "system.md").when(k == 4, "overview.md").when(k == 5, "3-x.md").otherwise("3-1-topic.md")
    k, said = F.col("doc_id") % 5, F.col("text")
    whole = (
        F.when(k == 0, F.concat(F.lit("# Title\n\n**Part of**: [x](index.md)\n"), said)).when(k == 1, F.concat(F.lit("intro $$x$$\n# A\n- [ ] task [^1]\n# B `a.py:3`\n"), said)).when(k == 2, F.concat(F.lit("## Introduction\n"), said, F.lit("\n# Summary\n")))
        .when(k == 3, F.concat(F.lit("---\ntitle: a: b\nslug: Bad Slug\n---\n## Overview\nCommit [a](1-a.md) [b](2-b.md) **x)**漢\n"), said)).otherwise(F.concat(F.lit("```\n# not one\n```\n"), said))
    )
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), name).alias("file"), whole.alias("text"))


def _lint_sql() -> str:
    """The rules of one document in SQL; the texts hold no fence but the one that is put before some of them."""
    one = lambda when, type_, message, line="1", severity="error": f"select file, {line} as line, '{type_}' as type, '{severity}' as severity, {message} as message from m where {when}"
    say = lambda x: f"'{x}'"
    rules = [
        one("section and not contains(body, '](index.md)')", "missing_section", say("no link to the index")),
        one("section and not contains(body, '**Generated**:') and not contains(body, '**Part of**:')", "missing_section", say("no byline")),
        one(r"section and not regexp_matches(text, '(?mi)^#{1,2}\s+Introduction')", "missing_section", say("no Introduction")),
        one(r"section and not regexp_matches(text, '(?mi)^#{1,2}\s+Summary')", "missing_section", say("no Summary")),
        one("section and not contains(text, '```mermaid') and regexp_matches(lower(name), 'arch|system|design')", "missing_section", say("no diagram")),
        one(r"section and not regexp_matches(body, '`[a-zA-Z0-9_/.-]+\.(py|js|ts|go|rs|java|c|cpp|h)(:\d+(-\d+)?)?`') and not regexp_matches(lower(name), 'overview|evolution|roadmap')", "missing_section", say("no code reference")),
        one("section and n < 1500", "word_count", "'too short: ' || n"),
        one("section and n > 6000", "word_count", "'too long: ' || n"),
        one("not idx and len(heads) = 0", "metadata_placement", say("no H1")),
        one("not idx and len(heads) > 1", "metadata_placement", say("more than one H1"), "heads[2]"),
        one("not idx and len(heads) > 0 and len(list_filter(real, lambda i: i < heads[1])) > 0", "metadata_placement", say("content before the H1")),
        one(r"not idx and len(heads) > 0 and not regexp_matches(coalesce(xs[list_filter(real, lambda i: i > heads[1])[1]], ''), '^\**Part of\**\s*:')", "metadata_placement", say("the H1 is not followed by the byline"), "heads[1]"),
        one(r"named and parts and regexp_matches(regexp_extract(name, '^(\d+(?:-\d+)*)-(.+)\.md$', 1), '(?:^|-)0\d')", "filename_convention", say("zero-padded number")),
        one(r"named and parts and not regexp_matches(regexp_extract(name, '^(\d+(?:-\d+)*)-(.+)\.md$', 2), '^[a-z][a-z0-9-]*$')", "filename_convention", say("not in kebab case")),
        one("named and not parts", "filename_convention", say("no number"), severity="warning"),
        one("true", "flat_structure", say("in a subfolder")),
        *[one(f"adr and not contains(text, '## {x}')", "adr_format", say(f"no {x}")) for x in ("Context", "Decision", "Consequences")],
        one("adr and not contains(text, '**Status**:')", "adr_format", say("no status")),
        one("idx and not head", "missing_section", say("no front matter")),
        one("idx and head", "missing_section", say("no description in the front matter")),
        one("idx and head", "frontmatter", say("title must be quoted")),
        one("idx and head", "frontmatter", say("slug is not in kebab case")),
        one("idx and not contains(text, '## Overview')", "missing_section", say("no Overview")),
        one("idx and links < 3", "missing_section", "'links to section files: ' || links"),
        one("idx and not contains(text, 'Last indexed') and not contains(text, 'Commit')", "missing_section", say("no stamp")),
    ]
    by_line = lambda pattern, type_, message, severity="error": rf"select file, i as line, '{type_}' as type, '{severity}' as severity, '{message}' as message from (select file, unnest(xs) as x, unnest(range(1, len(xs) + 1)) as i from m) where regexp_matches(regexp_replace(x, '`[^`]*`', '', 'g'), '{pattern}')"
    rules += [
        by_line(r"^\s*[-*+]\s+\[[ xX]\]\s", "unsupported_markdown", "task list"),
        by_line(r"\[\^[^\]\s]+\]", "unsupported_markdown", "footnote", "warning"),
        by_line(r"\$\$", "unsupported_markdown", "display math", "warning"),
        by_line(r"\*\*[^*\n]*[)\]）】]\*\*[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]", "cjk_emphasis", "emphasis will not render"),
    ]
    return rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
f as (select 'd' || doc_id || '/' || {_NAMES} as file, {_NAMES} as name, {_TEXTS} as text, case when doc_id % 5 = 4 then e'\n\n\n' || text else {_TEXTS} end as body from d),
l as (select *, string_split(body, chr(10)) as xs, name = 'index.md' as idx, regexp_matches(name, '^\d+(-\d+)*-adr-') as adr, starts_with(text, '---') as head from f),
m as (select *, not idx and not adr as section, list_filter(range(1, len(xs) + 1), lambda i: regexp_matches(xs[i], '^#\s+\S')) as heads, list_filter(range(1, len(xs) + 1), lambda i: regexp_matches(xs[i], '\S')) as real,
  len(list_filter(regexp_split_to_array(regexp_replace(body, '[#*`|\->\[\]()]', ' ', 'g'), '\s+'), lambda w: length(w) > 1)) + len(regexp_extract_all(body, '[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]')) as n,
  name not in ('index.md', 'overview.md') as named, regexp_matches(name, '^(\d+(?:-\d+)*)-(.+)\.md$') as parts, len(list_filter(regexp_extract_all(text, '\[([^\]]+)\]\(([^)]+\.md[^)]*)\)', 2), lambda x: not starts_with(x, 'http'))) as links from l)
{" union all ".join(rules)}"""


@query("rul_document_lint", _lint_sql())
def rul_document_lint(spark, sf_dir):
    return doclint.document_issues(_lint_docs(spark, sf_dir)).where("type <> 'table_format'")  # tables have fixtures of their own


@query(
    "rul12_links",
    r"""
with f as (select page_id, 'p' || page_id || '.md' as file, case page_id % 8 when 0 then '[a](p' || (page_id + 1) || '.md)' when 1 then '[a](x/p1.md)' when 2 then '![i](img/' || (page_id % 20) || '.PNG)' when 3 then '[a](#head-' || (page_id % 4) || ')' when 4 then '[a](p0.md#x)' when 5 then '[a](http://x.y)' when 6 then '[a](./img/../p1.md)' else '`[a](none.md)` [b](none.txt)' end as link from pages),
n as (select max(page_id) as top, min(page_id) as low from pages)
select file, 3 as line, 'broken_link' as type, 'no such file: p' || (page_id + 1) || '.md' as message from f where page_id % 8 = 0 and page_id + 1 not in (select page_id from pages)
union all select file, 3, 'flat_structure', 'link into a folder: x/p1.md' from f where page_id % 8 = 1 union all select file, 3, 'broken_link', 'no such file: x/p1.md' from f where page_id % 8 = 1
union all select file, 3, 'broken_image', 'not shipped: img/' || (page_id % 20) || '.PNG' from f where page_id % 8 = 2 and page_id % 20 > 9
union all select file, 3, 'broken_anchor', 'no such heading: #head-' || (page_id % 4) from f where page_id % 8 = 3 and page_id % 4 <> page_id % 3
union all select file, 3, 'broken_anchor', 'anchor of another file: p0.md#x' from f where page_id % 8 = 4
union all select file, 3, 'broken_link', 'no such file: p0.md#x' from f where page_id % 8 = 4 and 0 not in (select page_id from pages)
union all select file, 3, 'flat_structure', 'link into a folder: ./img/../p1.md' from f where page_id % 8 = 6 union all select file, 3, 'broken_link', 'no such file: ./img/../p1.md' from f where page_id % 8 = 6 and 1 not in (select page_id from pages)
union all select file, 3, 'broken_link', 'no such file: none.txt' from f where page_id % 8 = 7""",
)
def rul12_links(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id")
    n, k = F.col("page_id"), F.col("page_id") % 8
    s = lambda x: x.cast("string")
    link = (
        F.when(k == 0, F.concat(F.lit("[a](p"), s(n + 1), F.lit(".md)"))).when(k == 1, "[a](x/p1.md)").when(k == 2, F.concat(F.lit("![i](img/"), s(n % 20), F.lit(".PNG)"))).when(k == 3, F.concat(F.lit("[a](#head-"), s(n % 4), F.lit(")"))).when(k == 4, "[a](p0.md#x)")
        .when(k == 5, "[a](http://x.y)").when(k == 6, "[a](./img/../p1.md)").otherwise("`[a](none.md)` [b](none.txt)")
    )
    docs = pages.select(F.concat(F.lit("p"), s(n), F.lit(".md")).alias("file"), F.concat(F.lit("# T\n## Head "), s(n % 3), F.lit("\n"), link).alias("text"))
    assets = spark.range(10).select(F.concat(F.lit("pictures/"), F.col("id").cast("string"), F.lit(".png")).alias("path"), F.lit(10).cast("long").alias("length"))
    return doclint.link_issues(docs, assets).select("file", "line", "type", "message")


@query(
    "rul27_orphans",
    "select 'not linked: s' || p_partkey || '.md' as message from part where p_partkey % 3 <> 0",
)
def rul27_orphans(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey")
    file = F.concat(F.lit("s"), F.col("p_partkey").cast("string"), F.lit(".md"))
    linked = part.where("p_partkey % 3 = 0").agg(F.array_join(F.collect_list(F.concat(F.lit("[a]("), file, F.lit("#x)"))), "\n").alias("text"))
    docs = part.select(file.alias("file"), F.lit("").alias("text")).unionByName(linked.select(F.lit("index.md").alias("file"), "text"))
    return doclint.orphan_issues(docs).select("message")


@query(
    "rul28_citations",
    r"""
with c as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as line, 'src/d' || (l_partkey % 1200) || '.py' as path, l_suppkey % 9 + 1 as a, l_linenumber + l_orderkey % 6 as b from lineitem),
s as (select 'src/d' || doc_id || '.py' as path, case when coalesce(text, '') = '' then 0 else len(string_split(regexp_replace(text, '\n$', ''), chr(10))) end as n from documents),
v as (select l_orderkey || '.md' as file, line, c.path, a, b, n, case when n is null then 'no such file: ' || c.path when b > n then c.path || ':' || a || '-' || b || ' is out of range' when a > b then c.path || ':' || a || '-' || b || ' ends before it starts' end as message from c left join s on s.path = c.path)
select file, line, message from v where message is not null""",
)
def rul28_citations(spark, sf_dir):
    said = F.concat(F.lit("see `src/d"), (F.col("l_partkey") % 1200).cast("string"), F.lit(".py:"), (F.col("l_suppkey") % 9 + 1).cast("string"), F.lit("-"), (F.col("l_linenumber") + F.col("l_orderkey") % 6).cast("string"), F.lit("` here"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", said.alias("said")).alias("x"))
    docs = rows.groupBy(F.concat(F.col("l_orderkey").cast("string"), F.lit(".md")).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["said"]), "\n").alias("text"))
    sources = grounding.with_lines(read(spark, sf_dir, "documents").select(F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.coalesce("text", F.lit("")).alias("text")))
    return grounding.citation_issues(docs, sources).select("file", "line", "message")


@query(
    "rul38_numbering",
    """
with f as (select l_orderkey as paper, l_linenumber as fig_num from lineitem),
e as (select paper, min(fig_num) as a, max(fig_num) as b from f group by 1),
g as (select paper, unnest(generate_series(a, b))::int as fig_num from e)
select g.paper, g.fig_num, case when (g.fig_num = 2 and g.paper % 2 = 0) or (g.fig_num = 3 and g.paper % 2 = 1) then 'HIGH' else 'INFO' end as severity from g anti join f using (paper, fig_num)
union all select paper, fig_num, 'HIGH' from f group by 1, 2 having count(*) > 1""",
)
def rul38_numbering(spark, sf_dir):
    figs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("fig_num"))
    lines = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.when(F.col("o_orderkey") % 2 == 0, "as Fig. 2 shows").otherwise("in Figure 3").alias("line"))
    return figures.numbering_issues(figs, lines).select("paper", "fig_num", "severity")


@query(
    "rul39_first_failure",
    r"""
with t as (select doc_id, text, left(text, greatest(1, floor(length(text) * 0.2)::int)) as top, left(trim(right(text, 60), e' \t\n\r'), 100) as low, string_split(text, chr(10)) as xs from (select doc_id, case doc_id % 4 when 0 then e'| a | b |\n1 2.5 -3\n4 5 6 x\n' when 1 then e'Preprint\n' when 2 then e'The first line of a longer text here\nWe go on with a second line of it\n' else '' end || coalesce(text, '') as text from documents)),
p as (select *, len(list_filter(xs, lambda x: length(trim(x, e' \t\n\r')) > 20 and regexp_matches(x, 'Quantitative experiments|Qualitative results|Ablation study|Main results|Experimental setup|^\d+\.\d+\.?\s+[A-Z]|^(The|We|This|In|For|Abstract|Introduction|Conclusion)'))) as prose,
  len(list_filter(xs, lambda x: regexp_matches(x, '\|.*\|'))) + len(list_filter(xs, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= 3 and len(list_filter((list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''))[1:3], lambda w: not regexp_matches(regexp_replace(w, '[.\-]', '', 'g'), '^[0-9]+$'))) = 0)) as cells from t)
select doc_id, category from (select doc_id, case when prose >= 2 then 'BODY_TEXT_MISCLASS'
  when regexp_matches(top, 'arXiv:\d{4}\.\d{4,5}|(?i:\bPreprint\b|\bUnder review\b|\bWork in progress\b|\bTechnical Report\b)|\bAccepted (at|to) |\bPublished as a conference paper at |\bConference on \w+|\bProceedings of ') or regexp_matches(top, '(?m)^\s*\d+\s*$') then 'PAGE_HEADER_LEAKAGE'
  when cells >= 3 then 'WRONG_PANEL' when length(low) > 10 and regexp_matches(low, 'Figure|The |We |This |In ') then 'CAPTION_LEAKAGE' end as category from p) where category is not null""",
)
def rul39_first_failure(spark, sf_dir):
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "| a | b |\n1 2.5 -3\n4 5 6 x\n").when(k == 1, "Preprint\n").when(k == 2, "The first line of a longer text here\nWe go on with a second line of it\n").otherwise("")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    return docs.select("doc_id", figures.image_text_verdict(F.col("text"), F.right("text", F.lit(60)))["category"].alias("category")).where("category is not null")


@query(
    "rul40_front_matter",
    """
with t as (select p_partkey, p_partkey % 12 as k, p_size as n from part)
select p_partkey, case k when 0 then 'no front matter' when 1 then 'not closed' when 2 then 'unexpected other, version' when 3 then 'no name' when 4 then 'no description' when 5 then 'name is int' when 6 then 'not_kebab' when 7 then 'bad_dash' when 8 then 'angle brackets'
  when 9 then 'invalid: a colon in it' when 10 then 'compatibility is list' end as message from t where k < 11""",
)
def rul40_front_matter(spark, sf_dir):
    ok, n = "---\nname: a-b\ndescription: >\n  one\n  two\n---\n# T", F.col("p_size").cast("string")
    texts = {
        0: "# no\n" + ok, 1: "---\nname: a", 2: ok.replace("---\n#", "version: 1\nother: 2\n---\n#"), 3: "---\ndescription: x\n---", 4: "---\nname: a-b\n---", 6: ok.replace("a-b", "A b"), 7: ok.replace("a-b", "a--b"), 8: ok.replace("one", "<one>"), 9: ok.replace("a-b", "a: b"), 10: ok.replace("---\n#", "compatibility: [a]\n---\n#"),
        11: ok,
    }
    k, text = F.col("p_partkey") % 12, F.concat(F.lit("---\nname: "), n, F.lit("\ndescription: x\n---\n"))
    for key, value in texts.items():
        text = F.when(k == key, value).otherwise(text)
    part = read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return rules.front_matter_failure(part, "p_partkey", "text").select("p_partkey", "message")


@query(
    "rul36_aspect_ratio",
    """
with f as (select l_orderkey, l_linenumber, l_partkey, l_quantity as w, l_tax * 1000 as h from lineitem)
select l_orderkey, l_linenumber, l_partkey, 'very wide' as message from f where h > 0 and w / h > 8
union all select l_orderkey, l_linenumber, l_partkey, 'very narrow' from f where h > 0 and w / h < 0.25
union all select l_orderkey, l_linenumber, l_partkey, 'most of the page' from f where h > 68""",
)
def rul36_aspect_ratio(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    figures = lines.select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("paper"), F.lit(1).alias("fig_num"), F.col("l_quantity").alias("width"), (F.col("l_tax") * 1000).alias("height"), F.lit(100.0).alias("page_height"), F.lit(False).alias("suspect"))
    return rules.figure_issues(figures).select("paper.l_orderkey", "paper.l_linenumber", "paper.l_partkey", "message")


@query(
    "rul41_animation",
    """
with f as (select p_partkey as id, p_partkey % 3 = 0 as emoji, p_size * 15 as w, (p_partkey % 50 + 1) * 15 as h from part)
select id, 'an emoji is a square of 64 to 128' as message from f where emoji and (w <> h or w < 64 or w > 128)
union all select id, 'more than twice as long as wide' from f where not emoji and greatest(w, h) > 2 * least(w, h)
union all select id, 'the shorter side is 320 to 640' from f where not emoji and (least(w, h) < 320 or least(w, h) > 640)""",
)
def rul41_animation(spark, sf_dir):
    frames = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 == 0).alias("emoji"), (F.col("p_size") * 15).alias("width"), ((F.col("p_partkey") % 50 + 1) * 15).alias("height"))
    return rules.animation_issues(frames).select("id", "message")


@query("rul42_write_ready", "select o_orderkey, 2 * count(l_orderkey) >= max(l_linenumber) and count(*) filter (where l_returnflag = 'R') = 0 as ready from orders join lineitem on l_orderkey = o_orderkey group by 1")
def rul42_write_ready(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("expected"), F.count("*").alias("written"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey").select("o_orderkey", rules.write_ready(F.col("expected"), F.col("written"), F.col("failed")).alias("ready"))

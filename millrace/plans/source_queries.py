"""Queries of sinks and readers that need no files of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.registry import query, read
from millrace.sources import readers, writers


@query("snk01_summary_markdown", "select '| r_regionkey | r_name |\n| --- | --- |\n' || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', '\n' order by r_regionkey) as markdown from region")
def snk01_summary_markdown(spark, sf_dir):
    return writers.as_markdown(read(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"])


@query(
    "snk02_report_cells",
    "select user_id, coalesce(bool_or(value > 60) filter (where event_type = 'click'), false) as click, coalesce(bool_or(value > 60) filter (where event_type = 'error'), false) as error from events group by 1",
)
def snk02_report_cells(spark, sf_dir):
    cells = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") > 60).alias("ok"))
    return writers.report_cells(cells, "user_id", "event_type", "ok", ["click", "error"])


@query("snk03_embedded_json", "select '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' order by r_regionkey) || ']' as json from region")
def snk03_embedded_json(spark, sf_dir):
    return writers.as_json(read(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"])


@query(
    "snk11_conditional_update",
    """
with s as (select c_custkey, c_mktsegment as hash from customer), c as (select c_custkey, case when c_custkey % 3 = 0 then 'stale' else c_mktsegment end as expected, 'new' as hash from customer where c_custkey % 2 = 0)
select s.c_custkey, case when c.hash is not null and s.hash = c.expected then c.hash else s.hash end as hash from s left join c on s.c_custkey = c.c_custkey""",
)
def snk11_conditional_update(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    state = customer.select("c_custkey", F.col("c_mktsegment").alias("hash"))
    wanted = customer.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "stale").otherwise(F.col("c_mktsegment")).alias("expected"), F.lit("new").alias("hash"))
    return writers.conditional_update(state, wanted, "c_custkey")[0]


@query("src07_json_events", "select event_id, json_extract(props, '$.k')::bigint as k from events where event_id % 4 <> 0")
def src07_json_events(spark, sf_dir):
    lines = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("value"))
    return readers.json_events(lines).select("event_id", F.variant_get("event", "$.k", "bigint").alias("k"))


@query("src09_document_lines", "select doc_id, unnest(range(1, len(xs) + 1)) as line_no, unnest(xs) as line from (select doc_id, string_split(text, chr(10)) as xs from documents)")
def src09_document_lines(spark, sf_dir):
    return readers.document_lines(read(spark, sf_dir, "documents"), "doc_id").withColumn("line_no", F.col("line_no").cast("long"))


@query("src16_line_scan", "select doc_id, line_no, line from (select doc_id, unnest(range(1, len(xs) + 1)) as line_no, unnest(xs) as line from (select doc_id, string_split(text, chr(10)) as xs from documents)) where regexp_matches(line, '[Ll]icense') order by doc_id, line_no limit 20")
def src16_line_scan(spark, sf_dir):
    lines = readers.document_lines(read(spark, sf_dir, "documents"), "doc_id").withColumn("line_no", F.col("line_no").cast("long"))
    return readers.grep(lines, "[Ll]icense", ["doc_id", "line_no"], 20)


@query("src17_suffixes", r"select lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[^./]+)$', 1)) as suffix, count(*) as n from pages group by 1")
def src17_suffixes(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(readers.suffix_of(F.regexp_replace("url", r"[?#].*$", "")).alias("suffix")).agg(F.count("*").alias("n"))

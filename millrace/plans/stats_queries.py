"""Queries of statistics, rates, modes and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import stats
from millrace.plans.registry import query, read


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as runs of two configurations (their quality label) with three metrics."""
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("config"), "n_chars", F.col("toxic").alias("errors"), F.pmod(F.col("doc_id"), F.lit(97)).alias("calls"))


@query(
    "agg01_run_summary",
    """
select quality as config, round(avg(n_chars), 4) as n_chars_mean, round(coalesce(stddev_samp(n_chars), 0), 4) as n_chars_stddev, round(min(n_chars)::double, 4) as n_chars_min, round(max(n_chars)::double, 4) as n_chars_max
from labels join documents using (doc_id) group by quality""",
)
def agg01_run_summary(spark, sf_dir):
    return stats.moments(_runs(spark, sf_dir), ["config"], ["n_chars"])


@query(
    "agg02_metric_summary",
    """
select quality as config, round(avg(n_chars), 4) as n_chars_mean, round(coalesce(stddev_samp(n_chars), 0), 4) as n_chars_stddev, round(min(n_chars)::double, 4) as n_chars_min, round(max(n_chars)::double, 4) as n_chars_max,
  round(avg(toxic), 4) as errors_mean, round(coalesce(stddev_samp(toxic), 0), 4) as errors_stddev, round(min(toxic)::double, 4) as errors_min, round(max(toxic)::double, 4) as errors_max,
  round(avg(doc_id % 97), 4) as calls_mean, round(coalesce(stddev_samp(doc_id % 97), 0), 4) as calls_stddev, round(min(doc_id % 97)::double, 4) as calls_min, round(max(doc_id % 97)::double, 4) as calls_max
from labels join documents using (doc_id) group by quality""",
)
def agg02_metric_summary(spark, sf_dir):
    return stats.moments(_runs(spark, sf_dir), ["config"], ["n_chars", "errors", "calls"])


@query(
    "agg03_config_delta",
    """
with s as (select quality as config, round(avg(n_chars), 4) as a, round(avg(toxic), 4) as b from labels join documents using (doc_id) group by quality)
select round(max(case when config = 1 then a end) - max(case when config = 0 then a end), 4) as n_chars_delta, round(max(case when config = 1 then b end) - max(case when config = 0 then b end), 4) as errors_delta from s""",
)
def agg03_config_delta(spark, sf_dir):
    return stats.mean_deltas(stats.moments(_runs(spark, sf_dir), ["config"], ["n_chars", "errors"]), "config", 1, 0, ["n_chars", "errors"])


@query("agg04_distinct_ids", "select c_nationkey, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as segments, count(distinct c_mktsegment) as n from customer group by 1")
def agg04_distinct_ids(spark, sf_dir):
    ids = F.sort_array(F.collect_set("c_mktsegment"))
    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(ids, ",").alias("segments"), F.size(ids).cast("long").alias("n"))


_RATES = "select user_id, sum((event_type = 'purchase')::int)::bigint as hits, count(*) as attempts, avg((event_type = 'purchase')::int) as rate from events group by user_id"


def _rates(spark, sf_dir):
    return stats.rates(read(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "purchase")


@query("agg05_trigger_rate", f"select user_id, hits, attempts, round(rate, 6) as rate from ({_RATES})")
def agg05_trigger_rate(spark, sf_dir):
    return _rates(spark, sf_dir).withColumn("rate", F.round("rate", 6))


@query(
    "fil04_threshold_verdict",
    f"select user_id, user_id % 2 = 0 as expected, case when user_id % 2 = 0 then rate >= 0.2 else rate < 0.2 end as passed from ({_RATES})",
)
def fil04_threshold_verdict(spark, sf_dir):
    expected = F.col("user_id") % 2 == 0
    return _rates(spark, sf_dir).select("user_id", expected.alias("expected"), stats.passes(F.col("rate"), expected, 0.2).alias("passed"))


@query(
    "agg06_pass_summary",
    f"with v as (select case when user_id % 2 = 0 then rate >= 0.2 else rate < 0.2 end as ok from ({_RATES})) select count(*) filter (where ok) as passed, count(*) filter (where not ok) as failed, count(*) as total from v",
)
def agg06_pass_summary(spark, sf_dir):
    return stats.tally(_rates(spark, sf_dir), stats.passes(F.col("rate"), F.col("user_id") % 2 == 0, 0.2))


@query(
    "fil05_error_partition",
    f"select user_id, case when user_id % 2 = 0 then 'false_negative' else 'false_positive' end as kind from ({_RATES}) where not (case when user_id % 2 = 0 then rate >= 0.2 else rate < 0.2 end)",
)
def fil05_error_partition(spark, sf_dir):
    expected = F.col("user_id") % 2 == 0
    wrong = _rates(spark, sf_dir).where(~stats.passes(F.col("rate"), expected, 0.2))
    return wrong.select("user_id", F.when(expected, "false_negative").otherwise("false_positive").alias("kind"))


@query(
    "agg07_confusion",
    """
with c as (select count(*) filter (where quality = 1 and toxic = 1) as tp, count(*) filter (where quality = 0 and toxic = 1) as fp, count(*) filter (where quality = 1 and toxic = 0) as fn, count(*) filter (where quality = 0 and toxic = 0) as tn from labels)
select tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 1.0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 1.0), 6) as recall, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0), 6) as accuracy from c""",
)
def agg07_confusion(spark, sf_dir):
    return stats.confusion(read(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@query("agg08_correct_by_source", "select source, count(*) filter (where quality = 1) as correct, count(*) as total from labels join documents using (doc_id) group by source")
def agg08_correct_by_source(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return read(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("correct"), F.count("*").alias("total"))


@query(
    "agg09_accuracy",
    """
with t as (select user_id, max((event_type = 'purchase')::int) as ok, count(*) as calls, avg(value) as seconds from events group by user_id)
select round(100.0 * avg(ok), 4) as accuracy, round(avg(seconds), 4) as mean_seconds, round(avg(calls), 4) as mean_calls, sum(calls)::bigint as calls from t""",
)
def agg09_accuracy(spark, sf_dir):
    tasks = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("ok"), F.count("*").alias("calls"), F.avg("value").alias("seconds"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return tasks.agg(zero(100.0 * F.avg("ok")).alias("accuracy"), zero(F.avg("seconds")).alias("mean_seconds"), zero(F.avg("calls")).alias("mean_calls"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"))


@query("agg10_tool_durations", "select user_id, event_type, count(*) as n, string_agg(value::decimal(12,2)::varchar, ',' order by value) as durations from events group by all")
def agg10_tool_durations(spark, sf_dir):
    values = F.transform(F.sort_array(F.collect_list("value")), lambda v: v.cast("decimal(12,2)").cast("string"))
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.array_join(values, ",").alias("durations"))


@query("agg11_status_counts", "select o_orderstatus as status, count(*) as n from orders group by 1")
def agg11_status_counts(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).orderBy("status")


def _mode(spark, sf_dir, least):
    lines = read(spark, sf_dir, "lineitem")
    return stats.weighted_mode(lines, ["l_returnflag"], F.round(F.col("l_extendedprice") / 2000) / 2, F.col("l_quantity").cast("long"), F.struct("l_orderkey", "l_linenumber"), least)


_MODE = """
with b as (select l_returnflag, round(l_extendedprice / 2000) / 2 as mode, sum(l_quantity::bigint) as w, min({'a': l_orderkey, 'b': l_linenumber}) as f from lineitem group by all),
r as (select *, w / sum(w) over (partition by l_returnflag) as share, row_number() over (partition by l_returnflag order by w desc, f) as n from b)
select l_returnflag, case when share >= %s then mode end as mode, round(share, 6) as share from r where n = 1"""


@query("agg12_mode_with_support", _MODE % 0.2)
def agg12_mode_with_support(spark, sf_dir):
    return _mode(spark, sf_dir, 0.2)


@query("agg13_weighted_mode", _MODE % 0)
def agg13_weighted_mode(spark, sf_dir):
    return _mode(spark, sf_dir, 0.0)


@query("agg14_median", "select o_orderpriority, round(median(o_totalprice), 6) as median from orders group by 1")
def agg14_median(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 6).alias("median"))


@query(
    "agg15_consensus",
    """
with m as (select user_id, median(value) as median, count(*) as members from events group by 1),
c as (select e.user_id, any_value(m.median) as median, any_value(m.members) as members, avg((abs(e.value - m.median) <= 15)::int) as close from events e join m using (user_id) group by 1)
select user_id, round(median, 6) as median, members, round(close, 6) as close, members >= 3 and abs(median - 25) <= 12 and close >= 0.5 as agreed from c""",
)
def agg15_consensus(spark, sf_dir):
    return stats.consensus(read(spark, sf_dir, "events"), ["user_id"], "value", 25, off=12, near=15)


@query(
    "agg16_index_percentile",
    """
with r as (select l_returnflag, l_linestatus, l_extendedprice as x, count(*) over w as n, row_number() over (w order by l_extendedprice, l_orderkey, l_linenumber) - 1 as i from lineitem window w as (partition by l_returnflag, l_linestatus))
select l_returnflag, l_linestatus, max(case when i = (case when n > 5 then n // 10 else 0 end) then x end) as low, max(case when i = n - 1 - (case when n > 5 then n // 10 else 0 end) then x end) as high from r group by all""",
)
def agg16_index_percentile(spark, sf_dir):
    return stats.index_percentiles(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query("agg17_bounding_box", "select l_suppkey, min(l_quantity) as x0, min(l_extendedprice) as y0, max(l_quantity) as x1, max(l_extendedprice) as y1 from lineitem group by 1")
def agg17_bounding_box(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_quantity").alias("x0"), F.min("l_extendedprice").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_extendedprice").alias("y1"))


@query(
    "agg18_severity_groups",
    """select case when event_type = 'error' then 'HIGH' when event_type = 'purchase' then 'MEDIUM' else 'INFO' end as severity, event_type as category, count(*) as n, min(event_id) as first_event from events group by all""",
)
def agg18_severity_groups(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "purchase", "MEDIUM").otherwise("INFO")
    return read(spark, sf_dir, "events").groupBy(severity.alias("severity"), F.col("event_type").alias("category")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("agg19_duplicates", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def agg19_duplicates(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "agg20_name_collisions",
    """
with f as (select page_id, lower(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1), '\\.[^.]*$', '')) as stem, url from pages)
select page_id, stem from (select *, row_number() over (partition by stem order by url, page_id) as n from f) where n > 1""",
)
def agg20_name_collisions(spark, sf_dir):
    stem = F.lower(F.regexp_replace(F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]*)/*$", 1), r"\.[^.]*$", ""))
    pages = read(spark, sf_dir, "pages").select("page_id", stem.alias("stem"), "url")
    return pages.withColumn("n", F.row_number().over(Window.partitionBy("stem").orderBy("url", "page_id"))).where("n > 1").select("page_id", "stem")


@query(
    "agg21_budget",
    "select source, count(*) as files, sum(strlen(text))::bigint as bytes, max(strlen(text))::bigint as largest, count(*) > 50 or sum(strlen(text)) > 10485760 or max(strlen(text)) > 5242880 as over_budget from documents group by source",
)
def agg21_budget(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    sums = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))
    return sums.withColumn("over_budget", (F.col("files") > 50) | (F.col("bytes") > 10 * 1024 * 1024) | (F.col("largest") > 5 * 1024 * 1024))


@query(
    "agg23_marker_balance",
    r"""select doc_id, len(regexp_extract_all(text, '\*\*\*'))::bigint as openers, len(regexp_extract_all(text, '###'))::bigint as closers from documents where len(regexp_extract_all(text, '\*\*\*')) <> len(regexp_extract_all(text, '###'))""",
)
def agg23_marker_balance(spark, sf_dir):
    count = lambda mark: F.regexp_count("text", F.lit(mark)).cast("long")
    docs = read(spark, sf_dir, "documents").where(F.contains("text", F.lit("***")) | F.contains("text", F.lit("###")))
    return docs.select("doc_id", count(r"\*\*\*").alias("openers"), count("###").alias("closers")).where("openers <> closers")


@query(
    "agg24_top_contributors",
    "select o_custkey, count(*) as n from orders where o_orderdate >= (select max(o_orderdate) - interval 6 month from orders) group by 1 order by n desc, o_custkey limit 20",
)
def agg24_top_contributors(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate").alias("last"))  # one row
    recent = orders.join(F.broadcast(last)).where(F.col("o_orderdate") >= F.expr("last - interval 6 month"))
    return recent.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(20)


@query("agg25_language_distribution", "select lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by lang")
def agg25_language_distribution(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("agg27_rubric", "select p_partkey, round((p_size % 5 + 1 + p_partkey % 5 + 1 + length(p_name) % 5 + 1) / 3.0 / 5 * 10, 6) as overall from part")
def agg27_rubric(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", stats.rubric([F.col("p_size") % 5 + 1, F.col("p_partkey") % 5 + 1, F.length("p_name") % 5 + 1]).alias("overall"))


@query(
    "agg28_assertion_pattern",
    """
with a as (select p_brand as assertion, p_type as config, min((p_size > 3)::int) as lo, max((p_size > 3)::int) as hi from part where p_type in ('ECONOMY', 'STANDARD') group by all),
p as (select assertion, max(case when config = 'ECONOMY' then lo end) as lo1, max(case when config = 'ECONOMY' then hi end) as hi1, max(case when config = 'STANDARD' then lo end) as lo2, max(case when config = 'STANDARD' then hi end) as hi2 from a group by 1)
select assertion, case when lo1 = 1 and lo2 = 1 then 'always_pass' when hi1 = 0 and hi2 = 0 then 'always_fail' when lo1 = 1 and hi2 = 0 then 'only_with' when hi1 = 0 and lo2 = 1 then 'only_without' else 'variable' end as pattern from p""",
)
def agg28_assertion_pattern(spark, sf_dir):
    ok = (F.col("p_size") > 3).cast("int")
    parts = read(spark, sf_dir, "part").where(F.col("p_type").isin("ECONOMY", "STANDARD"))
    both = parts.groupBy(F.col("p_brand").alias("assertion")).pivot("p_type", ["ECONOMY", "STANDARD"]).agg(F.min(ok).alias("lo"), F.max(ok).alias("hi"))
    pattern = F.expr("case when ECONOMY_lo = 1 and STANDARD_lo = 1 then 'always_pass' when ECONOMY_hi = 0 and STANDARD_hi = 0 then 'always_fail' when ECONOMY_lo = 1 and STANDARD_hi = 0 then 'only_with' when ECONOMY_hi = 0 and STANDARD_lo = 1 then 'only_without' else 'variable' end")
    return both.select("assertion", pattern.alias("pattern"))


@query("agg29_issue_counts", "select event_type, count(*) as issues, count(distinct user_id) as affected from events group by 1")
def agg29_issue_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("issues"), F.countDistinct("user_id").alias("affected"))


@query("agg30_attempt_usage", "select o_orderkey, sum(l_quantity::bigint)::bigint as usage, max(o_totalprice) as top_level from orders join lineitem on o_orderkey = l_orderkey group by 1")
def agg30_attempt_usage(spark, sf_dir):
    """Usage is summed over attempts; the top-level figure is only carried, never added."""
    attempts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_quantity").cast("long")).alias("iterations"))
    nested = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(attempts, "o_orderkey")
    return nested.select("o_orderkey", "o_totalprice", F.explode("iterations").alias("q")).groupBy("o_orderkey").agg(F.sum("q").alias("usage"), F.max("o_totalprice").alias("top_level"))


@query("agg31_hits_by_folder", r"select regexp_extract(url, '://[^/]*/([^/?#]*)', 1) as folder, sum(len(regexp_extract_all(html, '<li>')))::bigint as hits from pages group by 1")
def agg31_hits_by_folder(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1).alias("folder"), F.regexp_count("html", F.lit("<li>")).alias("n"))
    return pages.groupBy("folder").agg(F.sum("n").alias("hits")).orderBy(F.desc("hits"), "folder")


@query(
    "agg32_usage_by_session",
    """select user_id, sum(json_extract(props, '$.k')::bigint)::bigint as input, sum(event_id % 7)::bigint as output, sum(event_id % 5)::bigint as written, sum(event_id % 3)::bigint as cached from events where event_type = 'purchase' group by 1""",
)
def agg32_usage_by_session(spark, sf_dir):
    ends = read(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    part = lambda n: F.sum(F.col("event_id") % n)
    return ends.groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("input"), part(7).alias("output"), part(5).alias("written"), part(3).alias("cached"))


@query("agg33_exit_status", "select user_id, bool_or(event_type in ('error')) as failed, count(*) filter (where event_type = 'error') as high from events where value is not null group by 1")
def agg33_exit_status(spark, sf_dir):
    high = F.col("event_type").isin("error")
    return read(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.bool_or(high).alias("failed"), F.count_if(high).alias("high"))


@query(
    "rl_stratified_holdout",
    """
with r as (select doc_id, quality, row_number() over (partition by quality order by md5(doc_id::varchar), doc_id) as n, count(*) over (partition by quality) as c from labels)
select doc_id, quality, case when n <= greatest(1, floor(c * 0.4)) then 'test' else 'train' end as split from r""",
)
def rl_stratified_holdout(spark, sf_dir):
    """A share of each class is held out, one row at least; the order is a hash instead of a shuffle, and a class is never one task."""
    from millrace.operators.ordering import class_places

    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    ranked = class_places(labels, "quality", [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")], "n", "c")
    return ranked.select("doc_id", "quality", F.when(F.col("n") <= F.greatest(F.lit(1), F.floor(F.col("c") * 0.4)), "test").otherwise("train").alias("split"))


@query(
    "srt03_best_iteration",
    "select user_id, event_id as iteration, value as score from (select *, row_number() over (partition by user_id order by value desc, event_id) as n from events) where n = 1",
)
def srt03_best_iteration(spark, sf_dir):
    best = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return read(spark, sf_dir, "events").withColumn("n", best).where("n = 1").select("user_id", F.col("event_id").alias("iteration"), F.col("value").alias("score"))


@query("srt04_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def srt04_top_k(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(
    "srt06_severity_order",
    """select event_id, event_type, row_number() over (partition by user_id order by case event_type when 'error' then 0 when 'purchase' then 1 when 'signup' then 2 else 3 end, event_id) as place from events""",
)
def srt06_severity_order(spark, sf_dir):
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return events.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(rank, "event_id"))).drop("user_id")


@query("srt01_path_order", "select o_orderkey, row_number() over (order by 'runs/eval-' || o_orderkey) as place from orders")
def srt01_path_order(spark, sf_dir):
    from millrace.operators.ordering import places

    paths = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("runs/eval-"), F.col("o_orderkey").cast("string")).alias("path"))
    return places(paths, [F.col("path")]).drop("path")


@query("srt02_known_first", "select event_id, row_number() over (order by case when event_type <> 'error' then user_id end nulls last, event_id) as place from events")
def srt02_known_first(spark, sf_dir):
    from millrace.operators.ordering import places

    runs = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("eval_id"))
    return places(runs, [F.asc_nulls_last("eval_id"), F.col("event_id")]).drop("eval_id")


@query("srt12_first_at_once", "select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) > 9 as later from lineitem")
def srt12_first_at_once(spark, sf_dir):
    from millrace.operators.ordering import first_at_once

    return first_at_once(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"]).drop("l_suppkey")


@query("agg26_counters", "select count(*) filter (where l_returnflag = 'R') as failed, count(*) filter (where l_returnflag <> 'R') as created from lineitem")
def agg26_counters(spark, sf_dir):
    lines, seen = stats.observed(read(spark, sf_dir, "lineitem"), failed=F.col("l_returnflag") == "R", created=F.col("l_returnflag") != "R")
    lines.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["failed"], seen.get["created"])], "failed long, created long")


@query("srt08_page", "select p_partkey, p_name, (select count(*) from part) as total, true as has_more, 30 as next_offset from part order by p_partkey limit 10 offset 20")
def srt08_page(spark, sf_dir):
    from millrace.operators.ordering import page

    return page(read(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"], 20, 10)


@query(
    "srt11_natural_order",
    """
with f as (select distinct regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1) as name from pages),
p as (select name, try_cast(regexp_extract(name, '^[0-9]+', 0) as bigint) as n from f)
select name, row_number() over (order by case when name = 'index' then 0 when name = 'overview' then 1 else 2 end, n nulls last, name) as place from p""",
)
def srt11_natural_order(spark, sf_dir):
    from millrace.operators.ordering import natural_place

    names = read(spark, sf_dir, "pages").select(F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]*)/*$", 1).alias("name")).distinct()
    return natural_place(names, "name")


@query("srt10_positives_first", "select doc_id, quality, row_number() over (order by quality desc, doc_id) as place, count(*) over (partition by quality) as of_class from labels")
def srt10_positives_first(spark, sf_dir):
    from millrace.operators.ordering import places

    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    sizes = labels.groupBy(F.col("quality").alias("_q")).agg(F.count("*").alias("of_class"))
    return places(labels, [F.desc("quality"), F.col("doc_id")]).join(sizes, F.col("quality").eqNullSafe(F.col("_q"))).drop("_q")


@query(
    "set01_union_all",
    "select c_custkey as key, c_name as name, c_acctbal as bal, 'customer' as origin from customer union all select s_suppkey, s_name, s_acctbal, 'supplier' from supplier",
)
def set01_union_all(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.lit("customer").alias("origin"))
    b = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set02_difference", "select distinct p_partkey as key from part except select distinct l_partkey from lineitem where l_quantity > 20")
def set02_difference(spark, sf_dir):
    used = read(spark, sf_dir, "lineitem").where("l_quantity > 20").select(F.col("l_partkey").alias("key"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")).distinct().join(used, "key", "left_anti")


@query("set03_accumulate", "select l_suppkey, count(distinct k)::bigint as n from (select l_suppkey, l_partkey as k from lineitem union select l_suppkey, l_orderkey from lineitem) group by 1")
def set03_accumulate(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("a"), F.collect_set("l_orderkey").alias("b"))
    return lines.select("l_suppkey", F.size(F.array_union("a", "b")).cast("long").alias("n"))


@query(
    "set04_history_then_live",
    """
with u as (select event_id, event_type, 0 as live from events where event_id % 3 < 2 union all select event_id, event_type, 1 from events where event_id % 3 > 0)
select event_id, event_type, live from (select *, row_number() over (partition by event_id order by live) as n from u) where n = 1""",
)
def set04_history_then_live(spark, sf_dir):
    from millrace.streaming.replay import merge_history

    events = read(spark, sf_dir, "events").select("event_id", "event_type")
    return merge_history(events.where("event_id % 3 < 2"), events.where("event_id % 3 > 0"), "event_id")

"""Queries of joins, snapshots and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import figures, match, snapshot
from millrace.plans.registry import query, read


@query(
    "jon01_sidecar",
    """
with t as (select l_orderkey, sum(l_quantity) as q, count(*) as tokens from lineitem group by 1)
select o_orderkey, case when o_orderkey % 3 = 0 then coalesce(t.q, 0.0) else o_totalprice end as seconds, case when o_orderkey % 3 = 0 then t.tokens end as tokens from orders left join t on l_orderkey = o_orderkey""",
)
def jon01_sidecar(spark, sf_dir):
    """The sidecar counts only where the inline time is 0."""
    side = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    runs = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("inline"))
    none = F.col("inline") == 0.0
    return runs.join(side, "o_orderkey", "left").select("o_orderkey", F.when(none, F.coalesce("q", F.lit(0.0))).otherwise(F.col("inline")).alias("seconds"), F.when(none, F.col("n")).alias("tokens"))


@query(
    "jon02_ordered_fallback",
    """
select n.n_nationkey, coalesce(nullif(min(case when s_acctbal > 9000 then s_name end), ''), nullif(min(case when c_acctbal > 9900 then c_name end), ''), n.n_name) as prompt
from nation n left join supplier on s_nationkey = n_nationkey left join customer on c_nationkey = n_nationkey group by n.n_nationkey, n.n_name""",
)
def jon02_ordered_fallback(spark, sf_dir):
    own = read(spark, sf_dir, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("a"))
    parent = read(spark, sf_dir, "customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_name").alias("b"))
    both = read(spark, sf_dir, "nation").join(own, "n_nationkey", "left").join(parent, "n_nationkey", "left")
    return both.select("n_nationkey", F.coalesce(F.nullif("a", F.lit("")), F.nullif("b", F.lit("")), "n_name").alias("prompt"))


@query(
    "jon03_previous_feedback",
    """
with p as (select doc_id, n_chars from documents where doc_id % 2 = 0), f as (select doc_id, quality from labels)
select coalesce(p.doc_id, f.doc_id) as run_id, n_chars, quality as feedback from p full join f on p.doc_id = f.doc_id""",
)
def jon03_previous_feedback(spark, sf_dir):
    before = read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("run_id"), "n_chars")
    return before.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("run_id"), F.col("quality").alias("feedback")), "run_id", "full")


@query(
    "jon04_split_back",
    "select doc_id, case when doc_id in (select doc_id from labels where quality = 1) then 'train' else 'test' end as side from documents",
)
def jon04_split_back(spark, sf_dir):
    docs, train = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return docs.join(train, "doc_id", "left_semi").withColumn("side", F.lit("train")).unionByName(docs.join(train, "doc_id", "left_anti").withColumn("side", F.lit("test")))


def _snapshots(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 10 <> 1").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("string").alias("edited"))
    moved = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") * 1.15).when(F.col("o_orderkey") % 4 == 1, F.col("o_totalprice") * 1.05).otherwise(F.col("o_totalprice"))
    edited = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.col("o_orderdate").cast("string"), F.lit("x"))).otherwise(F.col("o_orderdate").cast("string"))
    new = orders.where("o_orderkey % 10 <> 2").select("o_orderkey", moved.alias("o_totalprice"), edited.alias("edited"))
    return old, new


@query(
    "jon05_regression",
    """
with o as (select o_orderkey, o_totalprice as a from orders where o_orderkey % 10 <> 1),
n as (select o_orderkey, case o_orderkey % 4 when 0 then o_totalprice * 1.15 when 1 then o_totalprice * 1.05 else o_totalprice end as b from orders where o_orderkey % 10 <> 2),
j as (select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, a, b, o.o_orderkey is null as no_o, n.o_orderkey is null as no_n, case when a = 0 and b = 0 then 0.0 when a = 0 then 1.0 else abs(b - a) / abs(a) end as moved from o full join n on o.o_orderkey = n.o_orderkey)
select o_orderkey, case when no_n then 'MISSING' when no_o then 'NEW' when moved > 0.1 then 'CHANGE' end as issue, round(moved, 6) as moved from j where no_n or no_o or moved > 0.1""",
)
def jon05_regression(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return match.regressions(old, new, ["o_orderkey"], "o_totalprice", 0.1)


@query(
    "jon06_change_classes",
    """
with o as (select o_orderkey from orders where o_orderkey % 10 <> 1), n as (select o_orderkey from orders where o_orderkey % 10 <> 2)
select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, case when o.o_orderkey is null then 'NEW' when n.o_orderkey is null then 'DELETED' when n.o_orderkey % 4 = 0 then 'MODIFIED' else 'UNCHANGED' end as change from o full join n on o.o_orderkey = n.o_orderkey""",
)
def jon06_change_classes(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return match.changes(old, new, "o_orderkey", "edited")


@query(
    "jon07_missing_labels",
    """
with f as (select user_id, list(distinct event_type) as found from events group by 1)
select user_id, array_to_string(list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: not list_contains(found, x))), ',') as missing from f""",
)
def jon07_missing_labels(spark, sf_dir):
    found = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("found"))
    every = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    return found.select("user_id", F.array_join(F.array_except(every, "found"), ",").alias("missing"))


@query(
    "jon08_numbering_gaps",
    """
with e as (select l_orderkey, min(l_linenumber) as a, max(l_linenumber) as b from lineitem group by 1),
g as (select l_orderkey, unnest(generate_series(a, b))::int as l_linenumber from e),
m as (select * from g anti join lineitem l using (l_orderkey, l_linenumber))
select m.l_orderkey, m.l_linenumber, case when o_orderstatus = 'F' then 'HIGH' else 'INFO' end as severity from m left join orders on o_orderkey = m.l_orderkey""",
)
def jon08_numbering_gaps(spark, sf_dir):
    gaps = match.numbering_gaps(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")
    refs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return gaps.join(refs, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.when(F.col("o_orderstatus") == "F", "HIGH").otherwise("INFO").alias("severity"))


@query(
    "jon09_citation_ranges",
    """
with refs as (select l_orderkey, l_linenumber, 'doc' || (l_partkey % 1200) as path, (l_suppkey % 9) as first, (l_linenumber + l_orderkey % 6) as last from lineitem),
sizes as (select 'doc' || doc_id as path, len(regexp_split_to_array(text, '\\n'))::bigint as lines from documents)
select l_orderkey, l_linenumber, r.path, case when lines is null then 'missing_file' when last > lines then 'out_of_range' when first > last then 'start_after_end' else 'ok' end as verdict from refs r left join sizes s on s.path = r.path""".replace("\\\\", "\\"),
)
def jon09_citation_ranges(spark, sf_dir):
    refs = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("doc"), (F.col("l_partkey") % 1200).cast("string")).alias("path"), (F.col("l_suppkey") % 9).alias("first"), (F.col("l_linenumber") + F.col("l_orderkey") % 6).alias("last"))
    sizes = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.size(F.split("text", "\n")).cast("long").alias("lines"))
    return match.references(refs, sizes).select("l_orderkey", "l_linenumber", "path", "verdict")


@query(
    "jon10_snippet_lines",
    r"""
with a as (select conv_id, turn, trim(unnest(string_split(text, chr(10)))) as line from conversations where role = 'user'),
b as (select conv_id, trim(unnest(string_split(text, chr(10)))) as src from conversations where role = 'assistant'),
n as (select conv_id, turn, line, exists (select 1 from b where b.conv_id = a.conv_id and src <> '' and (contains(src, line) or contains(line, src))) as hit from a where line <> '')
select conv_id, turn, count(*) as countable, count(*) filter (where hit) as matched, count(*) filter (where hit) >= 0.7 * count(*) as ok from n group by all""",
)
def jon10_snippet_lines(spark, sf_dir):
    talks = read(spark, sf_dir, "conversations")
    lines = lambda role, out: talks.where(F.col("role") == role).select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("_x")).select("conv_id", "turn", F.trim("_x").alias(out)).where(F.col(out) != "")
    return snapshot.grounded(lines("user", "line"), lines("assistant", "source").select("conv_id", "source"), ["conv_id"], ["turn"], 0.7)


@query(
    "jon11_as_of",
    """
with e as (select * from events where event_type = 'purchase'), m as (select user_id, ts, event_id from events where event_type = 'view')
select e.event_id, coalesce(m.event_id, -1) as as_of from e asof left join (select user_id, ts, max(event_id) as event_id from m group by all) m on e.user_id = m.user_id and e.ts > m.ts""",
)
def jon11_as_of(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    marks = events.where("event_type = 'view'").select("user_id", "ts", "event_id", F.col("event_id").alias("seen"))
    return match.as_of(events.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), marks, ["user_id"], "ts", ["event_id"], "seen", -1).select("event_id", "as_of")


@query(
    "fil06_overlapping_ranges",
    """
with i as (select o_orderkey as id, o_custkey as key, epoch(o_orderdate)::bigint // 86400 as low, epoch(o_orderdate)::bigint // 86400 + 5 + o_orderkey % 40 as high from orders)
select a.key, a.id as a_id, b.id as b_id from i a join i b on a.key = b.key and a.id < b.id and a.low < b.high and b.low < a.high""",
)
def fil06_overlapping_ranges(spark, sf_dir):
    day = F.expr("unix_seconds(cast(o_orderdate as timestamp)) div 86400")
    spans = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), day.alias("low")).withColumn("high", F.col("low") + 5 + F.col("id") % 40)
    return match.overlaps(spans, spans, "key", 30).where("a_id < b_id").select("key", "a_id", "b_id")


@query(
    "jon12_first_lookup",
    """
select page_id, case when contains(url, 'example.org') then replace(url, 'example.org', 'host-a') when contains(url, 'blog.') then replace(url, 'blog.', 'host-b.') when contains(url, '/en/') then replace(url, '/en/', '/english/') end as mapped from pages""",
)
def jon12_first_lookup(spark, sf_dir):
    return match.first_lookup(read(spark, sf_dir, "pages").select("page_id", "url"), "url", [("example.org", "host-a"), ("blog.", "host-b."), ("/en/", "/english/")]).select("page_id", "mapped")


@query(
    "jon13_positional_zip",
    """
with a as (select s_nationkey as k, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) as n from supplier), b as (select c_nationkey as k, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as n from customer)
select a.k, a.n as place, s_suppkey as left_id, c_custkey as right_id from a join b on a.k = b.k and a.n = b.n""",
)
def jon13_positional_zip(spark, sf_dir):
    a, b = read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "k"), read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "k")
    return match.zip_positions(a, b, ["k"], "s_suppkey", "c_custkey", "s_suppkey", "c_custkey").withColumn("place", F.col("place").cast("long"))


@query(
    "jon14_report_cells",
    """
select u.user_id, coalesce(bool_or(event_type = 'click' and value > 60), false) as click, coalesce(bool_or(event_type = 'view' and value > 60), false) as view from (select distinct user_id from events) u left join events e on e.user_id = u.user_id group by 1""",
)
def jon14_report_cells(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    cells = events.withColumn("ok", F.col("value") > 60).groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.bool_or("ok"))
    return cells.select("user_id", F.coalesce("click", F.lit(False)).alias("click"), F.coalesce("view", F.lit(False)).alias("view"))


@query(
    "jon15_link_targets",
    r"""
with l as (select page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) as target from pages),
f as (select distinct '/' || regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) as path from pages),
b as (select distinct lower(regexp_extract(path, '([^/]*)$', 1)) as base from f)
select l.page_id, l.target from l where not exists (select 1 from f where f.path = l.target) and not exists (select 1 from b where b.base = lower(regexp_extract(l.target, '([^/]*)$', 1)))""",
)
def jon15_link_targets(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("target"))
    files = pages.select(F.concat(F.lit("/"), F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)).alias("path"))
    return snapshot.broken_links(links, files, "target", "path")


@query(
    "jon16_orphans",
    "select s_suppkey from supplier anti join (select l_suppkey as s_suppkey from lineitem where l_quantity > 49.5 and l_discount > 0.09) using (s_suppkey)",
)
def jon16_orphans(spark, sf_dir):
    linked = read(spark, sf_dir, "lineitem").where("l_quantity > 49.5 and l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return read(spark, sf_dir, "supplier").select("s_suppkey").join(linked, "s_suppkey", "left_anti")


@query(
    "jon17_two_key_anti",
    "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 40) and p_brand not in (select p_brand from part where p_size = 1)",
)
def jon17_two_key_anti(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    used = read(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    brands = part.where("p_size = 1").select("p_brand").distinct()
    return part.select("p_partkey", "p_brand").join(used, "p_partkey", "left_anti").join(brands, "p_brand", "left_anti").select("p_partkey")


@query(
    "jon18_batch_results",
    "select o_orderkey as custom_id, c_name, o_totalprice as result from orders join customer on c_custkey = o_custkey where o_orderstatus = 'F'",
)
def jon18_batch_results(spark, sf_dir):
    """Succeeded results with their requests, in the order of the id."""
    requests = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    results = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("custom_id"), F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("result"))
    return results.join(requests, "c_custkey").select("custom_id", "c_name", "result").orderBy("custom_id")


@query(
    "jon19_strict_twin",
    "select event_id from events e where event_type = 'view' and exists (select 1 from events s where s.event_type = 'purchase' and s.user_id = e.user_id and s.value = e.value)",
)
def jon19_strict_twin(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    strict = events.where("event_type = 'purchase'").select("user_id", "value")
    return events.where("event_type = 'view'").join(strict, ["user_id", "value"], "left_semi").select("event_id")


@query(
    "jon21_event_pairs",
    """
with s as (select user_id, event_id, ts from events where event_id % 4 = 0), e as (select event_id - 1 as start_id, ts from events where event_id % 4 = 1 and event_type <> 'error')
select user_id, s.event_id as start_id, epoch_us(e.ts) - epoch_us(s.ts) as micros from s left join e on e.start_id = s.event_id""",
)
def jon21_event_pairs(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("ref", F.col("event_id") - 1)
    pairs = match.pair_events(events, F.col("event_id") % 4 == 0, (F.col("event_id") % 4 == 1) & (F.col("event_type") != "error"), "user_id", "event_id", "ref", "us")
    return pairs.select("user_id", "start_id", (F.col("ended") - F.col("started")).alias("micros"))


@query(
    "jon22_request_spans",
    """
with s as (select event_id, ts from events where event_id % 2 = 0), e as (select event_id - 1 as start_id, ts, json_extract(props, '$.k')::bigint as usage from events where event_id % 2 = 1)
select s.event_id as start_id, epoch_us(e.ts) - epoch_us(s.ts) as micros, usage from s join e on e.start_id = s.event_id""",
)
def jon22_request_spans(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    start = events.where("event_id % 2 = 0").select(F.col("event_id").alias("start_id"), F.col("us").alias("a"))
    end = events.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("start_id"), F.col("us").alias("b"), F.get_json_object("props", "$.k").cast("long").alias("usage"))
    return start.join(end, "start_id").select("start_id", (F.col("b") - F.col("a")).alias("micros"), "usage")


@query("jon10_contained_items", "select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)")
def jon10_contained_items(spark, sf_dir):
    return match.contained(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"), "doc_id", "item_id")


@query(
    "stm08_state_merge",
    """
with o as (select o_orderkey, sha256(o_orderpriority || o_orderdate::date::varchar) as h from orders where o_orderkey % 10 <> 1), n as (select o_orderkey, sha256(case when o_orderkey % 8 = 0 then 'new' else o_orderpriority end || o_orderdate::date::varchar) as h, o_orderkey % 4 = 0 as touched from orders where o_orderkey % 10 <> 2)
select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, case when o.o_orderkey is null then 'CREATE' when n.o_orderkey is null then 'FORGET' when not touched then 'SKIP_TIME' when o.h = n.h then 'SKIP_HASH' else 'UPDATE' end as action from o full join n on o.o_orderkey = n.o_orderkey""",
)
def stm08_state_merge(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    digest = lambda c: F.sha2(F.concat(c, F.to_date("o_orderdate").cast("string")).cast("binary"), 256)
    time = F.col("o_orderdate").cast("string")
    state = orders.where("o_orderkey % 10 <> 1").select("o_orderkey", time.alias("edited"), digest(F.col("o_orderpriority")).alias("hash"))
    now = orders.where("o_orderkey % 10 <> 2").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.concat(time, F.lit("x"))).otherwise(time).alias("edited"), digest(F.when(F.col("o_orderkey") % 8 == 0, F.lit("new")).otherwise(F.col("o_orderpriority"))).alias("hash"))
    return snapshot.merge_state(state, now, "o_orderkey").select("o_orderkey", "action")


@query("fil01_prefix_drop", "select p_partkey, p_name, p_retailprice from part")
def fil01_prefix_drop(spark, sf_dir):
    return snapshot.without_prefix(read(spark, sf_dir, "part").withColumnsRenamed({"p_brand": "test_brand", "p_type": "test_type", "p_size": "_size"}), "test_", "_")


@query("fil07_path_exclusion", r"select page_id, url from pages where not list_has_any(string_split(regexp_replace(url, '[?#].*$', ''), '/'), ['fr', 'node_modules']) and not regexp_matches(url, '\.html?$')")
def fil07_path_exclusion(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return pages.where(~snapshot.excluded(F.regexp_replace("url", r"[?#].*$", ""), ["fr", "node_modules"])).where(~F.col("url").rlike(r"\.html?$"))


@query("fil08_non_blank", "select conv_id, turn from conversations where trim(text) <> '' and role = 'user'")
def fil08_non_blank(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("role = 'user'").where(F.trim("text") != "").select("conv_id", "turn")


@query("fil09_small_boxes", "select l_orderkey, l_linenumber from lineitem where not ((l_quantity < 8 and l_tax * 1000 < 8) or least(l_quantity, l_tax * 1000) < 3)")
def fil09_small_boxes(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where(~snapshot.decorative(F.col("l_quantity"), F.col("l_tax") * 1000, 8, 3)).select("l_orderkey", "l_linenumber")


@query(
    "fil10_drawings",
    "select l_orderkey, l_linenumber, l_partkey from lineitem where not (l_quantity + l_tax * 100 > 45 or l_quantity < 5) and not (l_discount * 500 + l_linenumber * 20 < 30 - 20 or l_discount * 500 > 40 + 20) and not (l_linenumber * 20 < 2 and l_tax * 100 < 2) and not (l_tax * 100 < 2 and l_linenumber * 20 > 100 * 0.8)",
)
def fil10_drawings(spark, sf_dir):
    x0, y0 = F.col("l_discount") * 500, F.col("l_quantity")
    kept = figures.figure_drawing(x0, y0, x0 + F.col("l_linenumber") * 20, y0 + F.col("l_tax") * 100, F.lit(40.0), F.lit(5.0), F.lit(30.0), F.lit(40.0), F.lit(100.0))
    return read(spark, sf_dir, "lineitem").where(kept).select("l_orderkey", "l_linenumber", "l_partkey")


@query("fil11_column", "select l_orderkey, l_linenumber, l_partkey, l_returnflag = 'A' or not (l_quantity + 10 < 25 - 5 or l_quantity > 30 + 5) as inside from lineitem")
def fil11_column(spark, sf_dir):
    inside = figures.in_column(F.col("l_quantity"), F.col("l_quantity") + 10, F.lit(25.0), F.lit(30.0), F.col("l_returnflag") == "A")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", inside.alias("inside"))


@query(
    "fil13_captions",
    r"""
with c as (select p_partkey, case p_partkey % 6 when 0 then 'Fig. ' || p_size || ': ' || p_name when 1 then 'figure ' || p_size || '(b) | x' when 2 then 'Figure ' || p_size || ' shows ' || p_name when 3 then 'FIGURE ' || p_size when 4 then 'As Figure ' || p_size || '. says' else 'Fig' || p_size || 'a.' end as line from part)
select p_partkey, line, regexp_extract(line, '(?i)^(?:Fig\.?\s*|Figure\s+)(\d+)', 1)::int as number, not regexp_matches(line, '(?i)^(?:Fig\.?\s*\d+|Figure\s+\d+)\s*(?:[a-z]|\([a-z]\))?\s*[:.|]') as is_loose
from c where regexp_matches(line, '(?i)^(?:Fig\.?\s*\d+|Figure\s+\d+)\s*(?:[a-z]|\([a-z]\))?\s*[:.|]') or regexp_matches(line, '(?i)^(?:Fig\.?\s*\d+|Figure\s+\d+)\s*(?:[a-z]|\([a-z]\))?\s+\S')""",
)
def fil13_captions(spark, sf_dir):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    line = (
        F.when(kind == 0, F.concat(F.lit("Fig. "), size, F.lit(": "), F.col("p_name"))).when(kind == 1, F.concat(F.lit("figure "), size, F.lit("(b) | x"))).when(kind == 2, F.concat(F.lit("Figure "), size, F.lit(" shows "), F.col("p_name")))
        .when(kind == 3, F.concat(F.lit("FIGURE "), size)).when(kind == 4, F.concat(F.lit("As Figure "), size, F.lit(". says"))).otherwise(F.concat(F.lit("Fig"), size, F.lit("a.")))
    )
    lines = read(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
    return lines.select("p_partkey", "line", figures.caption_number(F.col("line")).alias("c")).where("c is not null").select("p_partkey", "line", "c.number", "c.is_loose")


@query(
    "fil12_body_text",
    r"""
with b as (select l_orderkey, l_linenumber, l_partkey, case l_partkey % 7 when 0 then 'Figure ' || l_linenumber || ': x' when 1 then l_linenumber || '. Results of it' when 2 then l_linenumber || '.' || l_linenumber || ' Theory' when 3 then 'B. Proofs of it' when 4 then 'References' when 5 then 'Model 85.2 71.3% of 12 and more' else l_comment_like end as t,
  l_quantity * 2 as wide, (l_linenumber % 6) as n_lines, 8 + l_discount * 50 as size, l_tax * 1000 as high from (select *, 'some words of a text of order ' || l_orderkey || ' that go on' as l_comment_like from lineitem)),
m as (select *, wide / 100 as w, size / 10 as ratio, list_filter(regexp_split_to_array(trim(t), '\s+'), lambda x: x <> '') as tokens from b),
k as (select *, len(list_filter(tokens, lambda x: regexp_matches(x, '^\d+\.?\d*%?$'))) as numbers from m)
select l_orderkey, l_linenumber, l_partkey, case
  when regexp_matches(t, '(?i)^(?:Fig\.?\s*\d+|Figure\s+\d+)\s*(?:[a-z]|\([a-z]\))?\s*[:.|]') then false
  when ratio < 0.85 and (n_lines < 4 or ratio < 0.7 or w < 0.5 or (len(tokens) >= 3 and numbers = len(tokens))) then false
  when ratio > 1.15 and high < 60 then true
  when n_lines >= 2 and w > 0.5 and length(t) > 30 then true when n_lines >= 5 and w > 0.15 and length(t) > 30 then true when w > 0.75 and length(t) > 40 then true
  when regexp_matches(t, '^\d+(\.\d+)*\.\s+\S') and length(t) >= 8 and w > 0.4 then true when regexp_matches(t, '^\d+\.\d+(\.\d+)?\s+[A-Z][a-z]') and w > 0.35 then true
  when regexp_matches(t, '^[A-Z]\.\s+\S') and length(t) >= 8 and w > 0.4 then true when regexp_matches(t, '(?i)^(Appendices|Appendix|References|Acknowledgments?|Bibliography)\s*$') and w > 0.2 then true
  when n_lines = 1 and w > 0.5 and length(t) > 15 and len(tokens) >= 4 and numbers >= 2 then true else false end as body from k""",
)
def fil12_body_text(spark, sf_dir):
    n, kind = F.col("l_linenumber").cast("string"), F.col("l_partkey") % 7
    said = (
        F.when(kind == 0, F.concat(F.lit("Figure "), n, F.lit(": x"))).when(kind == 1, F.concat(n, F.lit(". Results of it"))).when(kind == 2, F.concat(n, F.lit("."), n, F.lit(" Theory"))).when(kind == 3, "B. Proofs of it").when(kind == 4, "References")
        .when(kind == 5, "Model 85.2 71.3% of 12 and more").otherwise(F.concat(F.lit("some words of a text of order "), F.col("l_orderkey").cast("string"), F.lit(" that go on")))
    )
    zero = F.lit(0.0)
    body = figures.is_body(said, zero, zero, F.col("l_quantity") * 2, F.col("l_tax") * 1000, F.col("l_linenumber") % 6, 8 + F.col("l_discount") * 50, F.lit(100.0), F.lit(10.0))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", body.alias("body"))


@query(
    "fil14_preceding_guard",
    """
select event_id from (select *, max(value) over w as before, bool_or(event_type = 'error') over w as broken from events window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding))
where coalesce(before, 0) <= 60 and not coalesce(broken, false)""",
)
def fil14_preceding_guard(spark, sf_dir):
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    guarded = read(spark, sf_dir, "events").withColumn("before", F.max("value").over(before)).withColumn("broken", F.bool_or(F.col("event_type") == "error").over(before))
    return guarded.where((F.coalesce("before", F.lit(0.0)) <= 60) & ~F.coalesce("broken", F.lit(False))).select("event_id")


@query("fil15_block_types", "select event_id, event_type from events where event_type not in ('error', 'signup')")
def fil15_block_types(spark, sf_dir):
    return read(spark, sf_dir, "events").where(~F.col("event_type").isin("error", "signup")).select("event_id", "event_type")


@query("fil16_nested_filter", "select event_id from events where json_extract(props, '$.k')::bigint >= 90")
def fil16_nested_filter(spark, sf_dir):
    return read(spark, sf_dir, "events").where(F.from_json("props", "k bigint")["k"] >= 90).select("event_id")


@query(
    "fil17_title_block",
    """
with b as (select conv_id, turn, text, role, first_value(text) over (partition by conv_id order by turn) as title from conversations)
select conv_id, turn from b where not (turn = 0 and role = 'user' and trim(text) = trim(title))""",
)
def fil17_title_block(spark, sf_dir):
    talks = read(spark, sf_dir, "conversations")
    titles = talks.groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))
    blocks = talks.join(titles, "conv_id")
    return blocks.where(~((F.col("turn") == 0) & (F.col("role") == "user") & (F.trim("text") == F.trim("title")))).select("conv_id", "turn")

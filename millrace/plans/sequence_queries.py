"""Queries of sequence operators, trees and event streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import maths, nested, text
from millrace.operators import sequence, tree
from millrace.plans.registry import query, read
from millrace.streaming import replay


@query(
    "win01_keep_one",
    """
with r as (select l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_partkey order by l_returnflag <> 'A', l_orderkey, l_linenumber, l_quantity) as n, min(l_orderkey) over (partition by l_partkey) as position from lineitem)
select l_partkey, l_orderkey, l_linenumber, position from r where n = 1""",
)
def win01_keep_one(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    kept = sequence.keep_one(lines, "l_partkey", [F.col("l_returnflag") != "A"], ["l_orderkey", "l_linenumber", "l_quantity"])
    return kept.select("l_partkey", "l_orderkey", "l_linenumber", F.col("position.l_orderkey").alias("position"))


_CLUSTERS = """
with e as (select user_id, event_id, epoch_us(ts) // 1000000 as s from events),
o as (select *, case when s - lag(s) over w > 14400 then 1 else 0 end as opens from e window w as (partition by user_id order by s, event_id)),
c as (select *, sum(opens) over (partition by user_id order by s, event_id)::bigint as cluster from o)"""


def _seconds(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("s"))


@query("win02_gap_clusters", _CLUSTERS + " select user_id, event_id, cluster from c")
def win02_gap_clusters(spark, sf_dir):
    return sequence.gap_clusters(_seconds(spark, sf_dir), ["user_id"], "s", ["event_id"], 14400).select("user_id", "event_id", F.col("cluster").cast("long").alias("cluster"))


@query(
    "win03_widest_clusters",
    _CLUSTERS
    + """,
p as (select user_id, cluster, min(s) as low, max(s) as high, count(*) as members from c group by all having count(*) >= 2),
g as (select *, low - lag(high) over (partition by user_id order by cluster) as gap from p),
r as (select *, case when gap is not null and row_number() over (partition by user_id order by gap desc nulls last, cluster desc) < 2 then 1 else 0 end as cuts from g),
q as (select *, sum(cuts) over (partition by user_id order by cluster)::bigint as part from r)
select user_id, part, min(low) as low, max(high) as high, sum(members)::bigint as members, (max(high) + lead(min(low)) over (partition by user_id order by part)) / 2 as gutter from q group by user_id, part""",
)
def win03_widest_clusters(spark, sf_dir):
    """Clusters of two or more, merged to two at their widest gap, with the gutter between them."""
    return sequence.widest_clusters(_seconds(spark, sf_dir), ["user_id"], "s", ["event_id"], 14400).withColumn("part", F.col("part").cast("long"))


@query(
    "win05_largest_early_gap",
    """
with d as (select user_id, value as after, lead(value) over w - value as gap, row_number() over w as i, count(*) over (partition by user_id) as n from events window w as (partition by user_id order by value, event_id)),
b as (select *, row_number() over (partition by user_id order by gap desc, i) as k from d where i <= 20 and gap is not null and n >= 10)
select user_id, after, round(gap, 6) as gap from b where k = 1 and gap > 1.5""",
)
def win05_largest_early_gap(spark, sf_dir):
    return sequence.largest_early_gap(read(spark, sf_dir, "events"), ["user_id"], "value", ["event_id"], over=1.5).withColumn("gap", F.round("gap", 6))


@query(
    "win06_last_kept",
    """
with recursive v as (select label, vec_id, embedding::double[] as e, row_number() over (partition by label order by vec_id) as n from embeddings),
f as (select label, n, vec_id, e, true as kept from v where n = 1
  union all
  select v.label, v.n, v.vec_id, case when s.keeps then v.e else s.e end, s.keeps from (
    select f.label, f.n, f.e, 1 - list_sum(list_transform(range(1, len(w.e) + 1), lambda i: abs(f.e[i] - w.e[i]))) / len(w.e) < 0.87 as keeps from f join v w on w.label = f.label and w.n = f.n + 1) s
  join v on v.label = s.label and v.n = s.n + 1)
select label, string_agg(vec_id::varchar, ',' order by n) as kept from f where kept group by label""",
)
def win06_last_kept(spark, sf_dir):
    kept = sequence.last_kept(read(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", 0.87)
    return kept.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")), ",").alias("kept"))


@query(
    "win07_numbering",
    """
with h as (select l_orderkey, l_linenumber, l_suppkey, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_extendedprice) as n, (l_quantity::int % 3) + 1 as level from lineitem),
a as (select *, coalesce(sum((level < 1)::int) over w, 0) as s1, coalesce(sum((level < 2)::int) over w, 0) as s2, coalesce(sum((level < 3)::int) over w, 0) as s3 from h window w as (partition by l_orderkey order by n)),
c as (select *, sum((level = 1)::int) over (partition by l_orderkey, s1 order by n) as c1, sum((level = 2)::int) over (partition by l_orderkey, s2 order by n) as c2, sum((level = 3)::int) over (partition by l_orderkey, s3 order by n) as c3 from a),
t as (select l_orderkey, n, level, list_filter([c1, case when level >= 2 then c2 end, case when level >= 3 then c3 end], lambda x: x is not null) as xs from c)
select l_orderkey, n, array_to_string(xs[list_position(list_transform(xs, lambda x: x > 0), true):], '.') as number from t""",
)
def win07_numbering(spark, sf_dir):
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    heads = read(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(along).cast("long").alias("n"), (F.col("l_quantity").cast("int") % 3 + 1).alias("level"))
    return sequence.numbering(heads, ["l_orderkey"], "n", "level", 3).select("l_orderkey", "n", "number")


@query(
    "win08_state_toggle",
    """
select event_id, sum((event_type = 'signup')::int) over (partition by user_id order by event_id) % 2 = 1 as inside from events""",
)
def win08_state_toggle(spark, sf_dir):
    marks = F.sum((F.col("event_type") == "signup").cast("int")).over(Window.partitionBy("user_id").orderBy("event_id"))
    return read(spark, sf_dir, "events").select("event_id", (marks % 2 == 1).alias("inside"))


@query(
    "win10_balance",
    """
with recursive e as (select user_id, row_number() over (partition by user_id order by event_id) as n, case event_type when 'signup' then 1 when 'error' then -1 else 0 end as m from events),
f as (select user_id, n, greatest(m, 0) as depth, (m < 0)::int as bad from e where n = 1
  union all select e.user_id, e.n, greatest(f.depth + e.m, 0), f.bad + (f.depth + e.m < 0)::int from f join e on e.user_id = f.user_id and e.n = f.n + 1)
select user_id, arg_max(bad, n) as unmatched, arg_max(depth, n) as open from f group by user_id""",
)
def win10_balance(spark, sf_dir):
    mark = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    marks = read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", mark.alias("m")))), lambda x: x["m"]).alias("marks"))
    bad, depth = sequence.balance(F.col("marks"))
    return marks.select("user_id", bad.alias("unmatched"), depth.alias("open"))


@query(
    "win11_islands",
    """
with i as (select user_id, n, value, n - row_number() over (partition by user_id order by n) as island from (select *, row_number() over (partition by user_id order by event_id) as n from events) where value > 30)
select user_id, min(n) as first, count(*) as rows, round(max(abs(value - fv)), 6) as off from (select *, first_value(value) over (partition by user_id, island order by n) as fv from i) group by user_id, island""",
)
def win11_islands(spark, sf_dir):
    """Runs of consecutive rows over a bound, and how far their values are from the run's first."""
    rows = read(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    runs = sequence.islands(rows, ["user_id"], "n", F.col("value") > 30)
    head = F.first("value").over(Window.partitionBy("user_id", "island").orderBy("n"))
    return runs.withColumn("fv", head).groupBy("user_id", "island").agg(F.min("n").alias("first"), F.count("*").alias("rows"), F.round(F.max(F.abs(F.col("value") - F.col("fv"))), 6).alias("off")).drop("island")


@query(
    "win12_trailing_run",
    """
with e as (select user_id, event_id, event_type, max(case when event_type <> 'view' then event_id end) over (partition by user_id) as last_other from events)
select user_id, count(*) filter (where last_other is null or event_id > last_other) as trailing from e group by 1""",
)
def win12_trailing_run(spark, sf_dir):
    lists = read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("kinds"))
    return lists.select("user_id", sequence.trailing(F.col("kinds"), lambda k: k == "view").cast("long").alias("trailing"))


@query(
    "win13_until_stop",
    """
with s as (select *, min(case when event_type = 'error' then event_id end) over (partition by user_id) as stop from events)
select event_id from s where stop is null or event_id < stop""",
)
def win13_until_stop(spark, sf_dir):
    stop = F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).over(Window.partitionBy("user_id"))
    return read(spark, sf_dir, "events").withColumn("stop", stop).where("stop is null or event_id < stop").select("event_id")


@query(
    "win14_sample_places",
    "select user_id, array_to_string(list_transform(range(least(5, count(*))), lambda i: (i * count(*)) // least(5, count(*))), ',') as places from events group by 1".replace("count(*)", "n").replace("from events group by 1", "from (select user_id, count(*) as n from events group by 1)"),
)
def win14_sample_places(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    return n.select("user_id", F.array_join(F.transform(sequence.sample_places(F.col("n")), lambda x: x.cast("string")), ",").alias("places"))


@query("win15_last_match", r"select page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)[-1] as last from pages")
def win15_last_match(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.last_tag(F.col("html"), "li").alias("last"))


@query(
    "win17_contents",
    """
with h as (select l_orderkey, l_linenumber, (l_linenumber * 7 + l_orderkey) % 4 as level, l_suppkey, l_partkey from lineitem),
m as (select *, max((level = 2)::int) over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey) as two from h)
select l_orderkey, l_linenumber, l_partkey, level from m where level = 2 or (level = 3 and two = 1)""",
)
def win17_contents(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", ((F.col("l_linenumber") * 7 + F.col("l_orderkey")) % 4).alias("level"), F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("at"))
    return sequence.contents(lines, ["l_orderkey"], "at", "level").select("l_orderkey", "l_linenumber", "l_partkey", "level")


@query(
    "win18_decimate",
    """
with r as (select event_id, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from events)
select event_id from r where i % (case when n > 12 then greatest(1, n // 12) else 1 end) = 0""",
)
def win18_decimate(spark, sf_dir):
    return sequence.decimate(read(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id").select("event_id")


@query("win19_relative_depth", "select l_orderkey, l_linenumber, l_partkey, least(l_linenumber - min(l_linenumber) over (partition by l_orderkey), 5) as depth from lineitem")
def win19_relative_depth(spark, sf_dir):
    return sequence.relative_depth(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], "l_linenumber")


def _nodes(spark, sf_dir):
    """Region, nation and customer as one tree."""
    region = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").alias("ord"))
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").alias("ord"))
    customer = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_custkey").alias("ord"))
    return region.unionByName(nation).unionByName(customer)


_NODES = """nodes as (
  select 'r' || r_regionkey as node, null as parent, r_regionkey::bigint as ord from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey, c_custkey from customer)"""


@query(
    "tre01_walk",
    f"""
with recursive {_NODES},
w as (select node, 0 as depth, node as root, ord::varchar as path from nodes where parent is null union all select n.node, w.depth + 1, w.root, w.path || '.' || n.ord from nodes n join w on n.parent = w.node)
select node, depth, root, path from w""",
)
def tre01_walk(spark, sf_dir):
    walked = tree.walk(_nodes(spark, sf_dir), "node", "parent", "ord")
    return walked.select("node", "depth", "root", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


@query(
    "tre02_breadth_first",
    f"""
with recursive {_NODES},
w as (select node, 0 as depth, [ord] as path from nodes where parent is null union all select n.node, w.depth + 1, list_append(w.path, n.ord) from nodes n join w on n.parent = w.node)
select depth, count(*) as nodes, min(node) as first from w group by depth""",
)
def tre02_breadth_first(spark, sf_dir):
    return tree.walk(_nodes(spark, sf_dir), "node", "parent", "ord").groupBy("depth").agg(F.count("*").alias("nodes"), F.min("node").alias("first"))


@query(
    "tre04_subtree_sizes",
    f"""
with recursive {_NODES},
up as (select node, node as root from nodes union all select u.node, n.parent from up u join nodes n on n.node = u.root where n.parent is not null)
select root as node, count(*) as pages from up group by root""",
)
def tre04_subtree_sizes(spark, sf_dir):
    return tree.subtree_sizes(tree.walk(_nodes(spark, sf_dir), "node", "parent", "ord"), "node")


@query(
    "tre05_nearest_mapped",
    f"""
with recursive {_NODES},
mapped as (select node from nodes where ord % 3 = 0),
up as (select node, node as at_node, 0 as d from nodes union all select u.node, n.parent, u.d + 1 from up u join nodes n on n.node = u.at_node where n.parent is not null)
select u.node, arg_min(m.node, u.d) as ancestor from up u left join mapped m on m.node = u.at_node group by u.node""",
)
def tre05_nearest_mapped(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return tree.nearest_mapped(nodes, nodes.where("ord % 3 = 0"), "node", "parent")


@query(
    "tre07_lineage",
    """
with recursive v as (select n_nationkey as version, case when n_nationkey > 0 then n_nationkey // 2 end as parent from nation), w as (select version, 0 as depth, version::varchar as path from v where parent is null union all select v.version, w.depth + 1, w.path || '.' || v.version from v join w on v.parent = w.version)
select version, depth, path from w""",
)
def tre07_lineage(spark, sf_dir):
    versions = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("version"), F.when(F.col("n_nationkey") > 0, F.expr("cast(n_nationkey div 2 as int)")).alias("parent"))
    return tree.walk(versions.withColumn("ord", F.col("version")), "version", "parent", "ord").select("version", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


@query(
    "stm02_state_machine",
    """
with recursive e as (select user_id, row_number() over (partition by user_id order by event_id) as n, event_type as k, value > 20 as a, length(props) as b from events),
f as (select user_id, 0::bigint as n, 'waiting' as s, 0::bigint as g from (select distinct user_id from events)
  union all select e.user_id, e.n,
    case when f.s in ('waiting', 'pending') and e.k = 'click' then (case when e.a then 'pending' else 'no' end) when f.s = 'waiting' and e.k = 'error' then 'no' when f.s = 'pending' and e.k = 'error' then 'yes' else f.s end,
    case when f.s in ('waiting', 'pending') and e.k = 'click' then (case when e.a then e.b else f.g end) when f.s = 'pending' and e.k <> 'error' then f.g + e.b else f.g end
  from f join e on e.user_id = f.user_id and e.n = f.n + 1)
select user_id, case arg_max(s, n) when 'yes' then 'accepted' when 'no' then 'rejected' else 'open' end as decision, arg_max(g, n) as gathered from f group by user_id""",
)
def stm02_state_machine(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return replay.decide(events, "user_id", "event_id", "event_type", "click", "props", F.col("value") > 20, ["error"]).withColumn("gathered", F.col("gathered").cast("long"))


@query("stm04_replay_dedupe", "select event_id, event_type from events")
def stm04_replay_dedupe(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "event_type")
    return replay.dedupe_stream(events.unionByName(events.where("event_id % 5 = 0")), "event_id", "ts")


@query(
    "stm06_last_state",
    """
with s as (select user_id, event_type, max(case when event_id % 3 > 0 then event_id end) as processed from events group by all) select user_id, event_type, processed from s""",
)
def stm06_last_state(spark, sf_dir):
    states = read(spark, sf_dir, "events").select("user_id", "event_type", F.concat_ws(":", "user_id", "event_type").alias("id"), F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("processed"))
    return replay.last_state(states, "id", "processed").drop("id")


@query("stm07_terminal_gate", """select event_id, event_type = 'error' or (event_type = 'view' and value >= 10) as terminal from events""")
def stm07_terminal_gate(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "terminated").when(F.col("event_type") == "view", "idle").otherwise("running")
    reason = F.when(F.col("value") < 10, "requires_action").otherwise("end_turn")
    return read(spark, sf_dir, "events").select("event_id", replay.terminal(kind, reason).alias("terminal"))


@query(
    "mth01_easing",
    """
with t as (select l_orderkey, l_linenumber, l_partkey, l_discount * 10 as t from lineitem)
select l_orderkey, l_linenumber, l_partkey, round(t * t, 6) as ease_in_quad, round(1 - pow(1 - t, 2), 6) as ease_out_quad, round(case when t < 0.5 then 2 * t * t else 1 - pow(2 - 2 * t, 2) / 2 end, 6) as ease_in_out_quad,
  round(pow(t, 3), 6) as ease_in_cubic, round(1 - pow(1 - t, 3), 6) as ease_out_cubic, round(case when t < 0.5 then 4 * pow(t, 3) else 1 - pow(2 - 2 * t, 3) / 2 end, 6) as ease_in_out_cubic,
  round(2.70158 * t * t * t - 1.70158 * t * t, 6) as back_in, round(1 + 2.70158 * pow(t - 1, 3) + 1.70158 * pow(t - 1, 2), 6) as back_out, round(t, 6) as unknown from t""",
)
def mth01_easing(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("t", F.col("l_discount") * 10)
    names = ["ease_in_quad", "ease_out_quad", "ease_in_out_quad", "ease_in_cubic", "ease_out_cubic", "ease_in_out_cubic", "back_in", "back_out", "unknown"]
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(maths.ease(n, F.col("t")), 6).alias(n) for n in names])


def _bounce(x: str) -> str:
    """SQL of the bounce curve at x."""
    return f"(case when {x} < 1 / 2.75 then 7.5625 * ({x}) * ({x}) when {x} < 2 / 2.75 then 7.5625 * pow(({x}) - 1.5 / 2.75, 2) + 0.75 when {x} < 2.5 / 2.75 then 7.5625 * pow(({x}) - 2.25 / 2.75, 2) + 0.9375 else 7.5625 * pow(({x}) - 2.625 / 2.75, 2) + 0.984375 end)"


@query(
    "mth01_bounce_elastic",
    f"""
with t as (select p_partkey, (p_partkey % 97) / 97.0::double as t from part),
b as (select *, {_bounce('t')} as bounce_out, 1 - {_bounce('1 - t')} as bounce_in, case when t < 0.5 then (1 - {_bounce('1 - 2 * t')}) * 0.5 else {_bounce('2 * t - 1')} * 0.5 + 0.5 end as bounce from t)
select p_partkey, round(bounce_out, 5) as bounce_out, round(bounce_in, 5) as bounce_in, round(bounce, 5) as bounce,
  round(case when t = 0 or t = 1 then t else -pow(2, 10 * (t - 1)) * sin((t - 1.1) * 5 * pi()) end, 5) as elastic_in,
  round(case when t = 0 or t = 1 then t else pow(2, -10 * t) * sin((t - 0.1) * 5 * pi()) + 1 end, 5) as elastic_out,
  round(case when t = 0 or t = 1 then t when 2 * t - 1 < 0 then -0.5 * pow(2, 10 * (2 * t - 1)) * sin((2 * t - 1 - 0.1) * 5 * pi()) else pow(2, -10 * (2 * t - 1)) * sin((2 * t - 1 - 0.1) * 5 * pi()) * 0.5 + 1 end, 5) as elastic,
  round(t * t, 5) as ease_in, round(t * (2 - t), 5) as ease_out, round(case when t < 0.5 then 2 * t * t else -1 + (4 - 2 * t) * t end, 5) as ease_in_out from b""",
)
def mth01_bounce_elastic(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("t", (F.col("p_partkey") % 97) / 97.0)
    names = ("bounce_out", "bounce_in", "bounce", "elastic_in", "elastic_out", "elastic", "ease_in", "ease_out", "ease_in_out")
    return part.select("p_partkey", *[F.round(maths.ease(n, F.col("t")), 5).alias(n) for n in names])


@query("mth02_interpolate", "select p_partkey, round(10 + (p_retailprice - 10) * (1 - pow(1 - (p_size / 50.0::double), 3)), 4) as v from part")
def mth02_interpolate(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.round(maths.interpolate(F.lit(10.0), F.col("p_retailprice"), F.col("p_size") / 50.0, "ease_out_cubic"), 4).alias("v"))


@query("mth03_arc", "select p_partkey, round(p_size * (p_size / 50.0::double), 6) as x, round(100 * (p_size / 50.0::double) - 4 * 30 * (p_size / 50.0::double) * (1 - p_size / 50.0::double), 6) as y from part")
def mth03_arc(spark, sf_dir):
    point = maths.arc_point(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.lit(100.0), 30.0, F.col("p_size") / 50.0)
    return read(spark, sf_dir, "part").withColumn("p", point).select("p_partkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("mth04_squash", "select p_partkey, round(1 - 0.3 * p_size / 50.0::double, 6) as wide, round(1 + 0.3 * p_size / 50.0::double, 6) as high from part")
def mth04_squash(spark, sf_dir):
    return read(spark, sf_dir, "part").withColumn("s", maths.squash(F.col("p_size") / 50.0, "vertical", 0.3)).select("p_partkey", F.round("s.wide", 6).alias("wide"), F.round("s.high", 6).alias("high"))


@query("mth05_relative_change", "select l_orderkey, l_linenumber, l_partkey, round(case when l_tax = 0 and l_discount = 0 then 0 when l_tax = 0 then 1 else abs(l_discount - l_tax) / abs(l_tax) end, 6) as moved from lineitem")
def mth05_relative_change(spark, sf_dir):
    from millrace.operators.match import relative_change

    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(relative_change(F.col("l_tax"), F.col("l_discount")), 6).alias("moved"))


@query("mth06_largest_move", "select l_orderkey, l_linenumber, l_partkey, round(greatest(abs(l_quantity - l_linenumber), abs(l_discount - l_tax), abs(l_extendedprice - 1000)), 4) as moved from lineitem")
def mth06_largest_move(spark, sf_dir):
    a, b = F.array("l_quantity", "l_discount", "l_extendedprice"), F.array(F.col("l_linenumber").cast("double"), "l_tax", F.lit(1000.0))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(maths.largest_move(a, b), 4).alias("moved"))


@query(
    "mth07_likeness",
    """
with p as (select a.vec_id, a.embedding::double[] as x, b.embedding::double[] as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select vec_id, round(1 - list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))) / len(x), 6) as likeness from p""",
)
def mth07_likeness(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(after, "vec_id").select("vec_id", F.round(maths.likeness(F.col("embedding"), F.col("other")), 6).alias("likeness"))


@query("mth08_ranges", "select p_partkey, round((p_size - 1) / 49.0::double * 100, 6) as mapped, ((p_partkey - 7) % 13 + 13) % 13 + 7 as wrapped, p_partkey % 5 as palette, greatest(10, least(40, p_size)) as clamped from part")
def mth08_ranges(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", F.round(maths.map_range(F.col("p_size"), 1, 50, 0, 100), 6).alias("mapped"), maths.wrap(F.col("p_partkey"), 7, 20).cast("long").alias("wrapped"), F.pmod("p_partkey", F.lit(5)).alias("palette"), maths.clamp(F.col("p_size"), 10, 40).alias("clamped"))


@query("mth11_gradient", "select n_nationkey, array_to_string(list_transform(range(5), lambda i: floor(n_nationkey * 10 + (255 - n_nationkey * 10) * i / 5.0)::bigint), ',') as rows from nation")
def mth11_gradient(spark, sf_dir):
    rows = maths.gradient(F.col("n_nationkey") * 10, F.lit(255), F.lit(5))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(rows, lambda x: x.cast("string")), ",").alias("rows"))


@query("mth12_even_width", "select l_orderkey, 800 // count(*) as width from lineitem group by 1")
def mth12_even_width(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).select("l_orderkey", F.expr("800 div n").alias("width"))


@query("jsn01_nested_default", "select event_id, coalesce(json_extract(props, '$.k')::bigint, 0) as k, coalesce(json_extract(props, '$.absent')::bigint, -1) as absent from events")
def jsn01_nested_default(spark, sf_dir):
    get = lambda path, other: F.coalesce(F.try_variant_get(F.parse_json("props"), path, "bigint"), F.lit(other).cast("long"))
    return read(spark, sf_dir, "events").select("event_id", get("$.k", 0).alias("k"), get("$.absent", -1).alias("absent"))


@query("jsn02_required_keys", "select user_id, bool_or(value > 80) as incomplete from events group by 1")
def jsn02_required_keys(spark, sf_dir):
    item = F.struct(F.when(F.col("value") <= 80, F.col("event_type")).alias("text"), F.lit(True).alias("passed"))
    lists = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(item).alias("items"))
    return lists.select("user_id", nested.incomplete(F.col("items"), "text", "passed").alias("incomplete"))


@query(
    "jsn04_content_hash",
    "select doc_id, sha256(text) as hash from documents",
)
def jsn04_content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", nested.content_hash(F.col("text")).alias("hash"))


@query("jsn04_canonical_hash", """select c_custkey, sha256('{"acctbal":' || c_nationkey || ',"name":"' || c_name || '"}') as hash from customer""")
def jsn04_canonical_hash(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("token"), F.col("c_nationkey").alias("acctbal")).alias("body"))
    return rows.select("c_custkey", nested.content_hash(nested.canonical_json(rows.schema, "body", ("token",))).alias("hash"))


@query("jsn05_state_key", "select o_orderkey, left(sha256(o_custkey || ':' || o_orderkey), 16) as key from orders")
def jsn05_state_key(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", nested.state_key(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("key"))


@query(
    "jsn06_reversed_map",
    """
with e as (select c_nationkey, c_mktsegment, min(c_custkey) as k from customer group by all) select c_nationkey, string_agg(c_mktsegment || '=' || k, ',' order by c_mktsegment) as reversed from e group by 1""",
)
def jsn06_reversed_map(spark, sf_dir):
    entries = F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))))
    maps = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(entries.alias("entries")).withColumn("m", nested.reversed_map(F.col("entries")))
    shown = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return maps.select("c_nationkey", F.array_join(shown, ",").alias("reversed"))


@query(
    "jsn07_grid",
    """
with c as (select l_orderkey, list(l_linenumber::varchar order by l_linenumber, l_partkey) as xs from lineitem group by 1) select l_orderkey, array_to_string(list_transform(range((len(xs) - 1) // 3 + 1), lambda r: array_to_string(xs[r * 3 + 1 : r * 3 + 3], ' ')), '|') as grid from c""",
)
def jsn07_grid(spark, sf_dir):
    cells = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_linenumber"].cast("string"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(cells.alias("cells"))
    return rows.select("l_orderkey", F.array_join(F.transform(nested.grid(F.col("cells"), F.lit(3)), lambda r: F.array_join(r, " ")), "|").alias("grid"))


@query("jsn08_padded_rows", "select page_id, array_to_string(list_concat(string_split(url, '/'), list_transform(range(greatest(0, 10 - len(string_split(url, '/')))), lambda i: '-')), '|') as cells from pages")
def jsn08_padded_rows(spark, sf_dir):
    wide = F.split(F.lit("0/0/0/0/0/0/0/0/0/0"), "/")
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", F.array_join(nested.padded(F.array(F.split("url", "/"), wide), "-")[0], "|").alias("cells"))


@query("jsn10_usage_total", "select event_id, json_extract(props, '$.k')::bigint + event_id % 5 + event_id % 3 as total from events")
def jsn10_usage_total(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select("event_id", (k + F.col("event_id") % 5 + F.col("event_id") % 3).alias("total"))


@query(
    "str01_plain",
    r"""
with m as (select conv_id, turn, '![' || role || '](x.png) [' || role || '](y) __' || turn || '__ **' || left(text, 9) || '** _a_ *' || turn || '* `c` <b>' || text as t from conversations)
select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '\*\*(.*?)\*\*|__(.*?)__', '\1\2', 'g'), '\*(.*?)\*|_(.*?)_', '\1\2', 'g'), '`([^`]*)`', '\1', 'g'), '<[^>]+>', '', 'g') as text from m""",
)
def str01_plain(spark, sf_dir):
    turn = F.col("turn").cast("string")
    marked = F.concat(F.lit("!["), F.col("role"), F.lit("](x.png) ["), F.col("role"), F.lit("](y) __"), turn, F.lit("__ **"), F.left("text", F.lit(9)), F.lit("** _a_ *"), turn, F.lit("* `c` <b>"), F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.plain(marked).alias("text"))


_SLUG = r"""
with h as (select page_id, lower('Café [' || page_id || '](x) **B_c**  ' || regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) || ' ¿?') as t from pages),
m as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '\*\*(.*?)\*\*|__(.*?)__', '\1\2', 'g'), '\*(.*?)\*|_(.*?)_', '\1\2', 'g'), '`([^`]*)`', '\1', 'g'), '<[^>]+>', '', 'g') as t from h)
select page_id, regexp_replace(trim(regexp_replace(t, '[^a-z0-9_\t-\r -]', '', 'g'), e' \t\n\r\f\x0b'), '[\t-\r ]+', '-', 'g') as slug from m"""


@query("str02_heading_slug", _SLUG)
def str02_heading_slug(spark, sf_dir):
    raw = F.concat(F.lit("Café ["), F.col("page_id").cast("string"), F.lit("](x) **B_c**  "), F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1), F.lit(" ¿?"))
    return read(spark, sf_dir, "pages").select("page_id", text.slug(raw).alias("slug"))


@query("str03_squeezed", r"select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from conversations")
def str03_squeezed(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.squeezed(F.col("text")).alias("text"))


@query("str06_word_count", r"select conv_id, turn, len(list_filter(regexp_split_to_array(regexp_replace(text || ' a|bc-de > (x) 汉字 é漢', '[#*`|\->\[\]()]', ' ', 'g'), '\s+'), lambda w: length(w) > 1)) + 3 as words from conversations")
def str06_word_count(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.md_words(F.concat("text", F.lit(" a|bc-de > (x) 汉字 é漢"))).alias("words"))


@query(
    "str14_dashes",
    """
with r as (select p_partkey, case p_partkey % 4 when 0 then ' |' || repeat('—', p_size % 9 + 1) || '| – |' when 1 then '|—|' || p_size || '|' when 2 then '— | —' else '||' end as line from part)
select p_partkey, case when starts_with(trim(line), '|') and p_partkey % 4 = 0 then '|' || repeat('-', greatest(3, length(regexp_replace(line, '[^—]', '', 'g')))) || '|---|' else line end as line from r""",
)
def str14_dashes(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    line = F.when(kind == 0, F.concat(F.lit(" |"), F.repeat(F.lit("—"), F.col("p_size") % 9 + 1), F.lit("| – |"))).when(kind == 1, F.concat(F.lit("|—|"), F.col("p_size").cast("string"), F.lit("|"))).when(kind == 2, "— | —").otherwise("||")
    return read(spark, sf_dir, "part").select("p_partkey", text.dashes(line).alias("line"))


@query("str15_file_name", r"""select page_id, coalesce(nullif(left(regexp_replace(trim(regexp_replace('. ' || url || ' ..', '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '^\.+|\.+$', '', 'g'), 40), ''), 'untitled') as name from pages""")
def str15_file_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.file_name(F.concat(F.lit(". "), F.col("url"), F.lit(" ..")), 40).alias("name"))


@query(
    "str17_quoted",
    """
with u as (select page_id, url_encode(url || ' é~*') as e from pages)
select page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(e, '%2F', '/'), '%3A', ':'), '%3F', '?'), '%23', '#'), '%26', '&'), '%3D', '='), '%40', '@'), '%2B', '+'), '%25', '%') as quoted, url_decode(e) as unquoted from u""",
)
def str17_quoted(spark, sf_dir):
    url = F.concat(F.col("url"), F.lit(" é~*"))
    return read(spark, sf_dir, "pages").select("page_id", text.quoted(url).alias("quoted"), text.unquoted(text.quoted(url, "")).alias("unquoted"))


@query("str16_url_token", r"select page_id, coalesce(nullif(regexp_extract(url, '/(?:wiki|docx|docs)/([A-Za-z0-9]+)', 1), ''), string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1]) as token from pages")
def str16_url_token(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.url_token(F.col("url")).alias("token"))


@query("str19_html_escape", "select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as escaped from pages")
def str19_html_escape(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.escaped(F.col("html")).alias("escaped"))


@query("str20_tag_content", r"select page_id, trim(regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1)[-1]) as title from pages")
def str20_tag_content(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.last_tag(F.col("html"), "title").alias("title"))


@query("str21_header_in_head", "select doc_id from documents where regexp_matches(left(text, greatest(1, floor(length(text) * 0.2)::int)), 'Licensed|Copyright|[Tt]he the')")
def str21_header_in_head(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(text.head_share(F.col("text")).rlike("Licensed|Copyright|[Tt]he the")).select("doc_id")


@query(
    "str22_table_hits",
    r"select doc_id, hits from (select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\|'))) + len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\d+'))) as hits from documents) where hits >= 3",
)
def str22_table_hits(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.hits_per_line(F.col("text"), [r"\|", r"[0-9]+"]).alias("hits")).where("hits >= 3")


@query("str23_prose_lines", "select doc_id from documents where len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 20 and regexp_matches(x, ' the | and '))) >= 2")
def str23_prose_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(text.prose_lines(F.col("text"), [" the ", " and "]) >= 2).select("doc_id")


@query("str25_pseudocode", "select doc_id from documents where regexp_matches(text, '^(?:The|And)') or (contains(text, 'return')::int + contains(text, 'this')::int + contains(text, 'for')::int) >= 2")
def str25_pseudocode(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(text.keywords(F.col("text"), "^(?:The|And)", ["return", "this", "for"])).select("doc_id")


@query("str26_unnumbered", r"select l_orderkey, l_linenumber, l_partkey, regexp_replace(l_linenumber || '.' || l_suppkey || ' Part ' || l_partkey, '^(\d+\.)+\d*\s*', '') as heading from lineitem")
def str26_unnumbered(spark, sf_dir):
    raw = F.concat(F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_suppkey").cast("string"), F.lit(" Part "), F.col("l_partkey").cast("string"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.unnumbered(raw).alias("heading"))


@query("jsn09_numeric_share", r"""with t as (select event_id, list_filter(regexp_split_to_array(trim(event_type || ' ' || value || ' ' || user_id), '\s+'), lambda x: x <> '') as xs from events) select event_id, round(len(list_filter(xs, lambda x: regexp_matches(x, '^[-+]?[\d.,]+%?$'))) / len(xs), 6) as share from t""")
def jsn09_numeric_share(spark, sf_dir):
    line = F.concat_ws(" ", "event_type", F.col("value").cast("string"), F.col("user_id").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", text.numeric_share(line).alias("share"))


@query(
    "win16_first_in_list",
    """
select doc_id, case when regexp_matches(text, '[Ll]icense') then 'license' when regexp_matches(text, '[0-9]{3}') then 'number' when regexp_matches(text, '^[A-Z]') then 'capital' end as label from documents""",
)
def win16_first_in_list(spark, sf_dir):
    found = text.first_match(F.col("text"), [("[Ll]icense", "license"), ("[0-9]{3}", "number"), ("^[A-Z]", "capital")])
    return read(spark, sf_dir, "documents").select("doc_id", found["label"].alias("label"))


@query(
    "srt07_leftmost",
    """
with f as (select conv_id, turn, list_sort(list_filter([
  case when regexp_matches(text, '[0-9]+') then {'at': length(regexp_extract(text, '(?s)^(.*?)[0-9]+', 1)), 'rank': 0, 'label': 'number', 'match': regexp_extract(text, '[0-9]+', 0)} end,
  case when regexp_matches(text, '[a-z]+ing') then {'at': length(regexp_extract(text, '(?s)^(.*?)[a-z]+ing', 1)), 'rank': 1, 'label': 'doing', 'match': regexp_extract(text, '[a-z]+ing', 0)} end,
  case when regexp_matches(text, '[a-z]+') then {'at': length(regexp_extract(text, '(?s)^(.*?)[a-z]+', 1)), 'rank': 2, 'label': 'word', 'match': regexp_extract(text, '[a-z]+', 0)} end], lambda x: x is not null))[1] as b from conversations)
select conv_id, turn, b['at'] as at, b.label as label, b['match'] as match from f""",
)
def srt07_leftmost(spark, sf_dir):
    best = text.leftmost_match(F.col("text"), [("[0-9]+", "number"), ("[a-z]+ing", "doing"), ("[a-z]+", "word")])
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(F.array(best))).select("conv_id", "turn", "at", "label", "match")


@query("srt05_examples", "select l_orderkey, array_to_string(list_transform((list(l_returnflag || l_linestatus || ' ' || l_partkey order by l_linenumber, l_partkey, l_returnflag || l_linestatus))[1:3], lambda x: left(x, 6)), '; ') as shown from lineitem group by 1")
def srt05_examples(spark, sf_dir):
    said = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("flags")))), lambda x: F.concat(x["flags"], F.lit(" "), x["l_partkey"].cast("string")))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(text.examples(said, 3, 6), "; ").alias("shown"))


@query(
    "stm03_first_tool_block",
    """
with c as (select l_orderkey, list({'kind': l_returnflag, 'name': l_linestatus, 'n': l_partkey} order by l_linenumber, l_partkey, l_suppkey) as xs from lineitem group by 1),
f as (select l_orderkey, list_filter(xs, lambda x: x.kind = 'R')[1] as x from c)
select l_orderkey, case when x is not null then (x.name = 'F' and contains('skill ' || x.n, '7')) or (x.name = 'O' and contains('path ' || x.n, '7')) end as triggered from f""",
)
def stm03_first_tool_block(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.col("l_returnflag"), F.col("l_linestatus")).alias("r")))), lambda x: F.struct(
        F.when(x["r"]["l_returnflag"] == "R", "tool_use").otherwise("text").alias("type"), x["r"]["l_linestatus"].alias("name"), F.create_map(F.lit("skill"), F.concat(F.lit("skill "), x["l_partkey"].cast("string")), F.lit("file_path"), F.concat(F.lit("path "), x["l_partkey"].cast("string"))).alias("input"))).alias("content"))
    return rows.select("l_orderkey", replay.first_tool_block(F.col("content"), {"F": "skill", "O": "file_path"}, "7").alias("triggered"))

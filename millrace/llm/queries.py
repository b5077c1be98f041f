"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, fingerprint, language, license_scan, minhash_join, mixing, packing, secret_scan, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file() -> str:
    """The production tokenizer, by its public package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "n_words")


def op2_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(_read(spark, sf_dir, "documents"), width=4, percent=80)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents")).drop("detections")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_file())


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(_read(spark, sf_dir, "documents")))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op9_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_minhash_join": op2_minhash_join,
    "op3_license_scan": op3_license_scan,
    "op4_fingerprint": op4_fingerprint,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_source_mix": op8_source_mix,
    "op9_redirect_rules": op9_redirect_rules,
    "op10_exact_dedup": op10_exact_dedup,
}

_OP2 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) end as s from words),
sizes as (select doc_id, len(s) as n from sets),
posts as (select doc_id, unnest(s) as g from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as both_n from posts a join posts b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * both_n >= 80 * (x.n + y.n - both_n)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as node, doc_id as root from sizes union select e.b, r.root from reach r join edges e on e.a = r.node)
select s.doc_id, s.n as n_shingles, min(r.root) as component_id, s.doc_id = min(r.root) as kept
from sizes s join reach r on r.node = s.doc_id group by s.doc_id, s.n
"""

_OP8 = r"""
with recursive docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('mix ' || coalesce(doc_id::varchar, '')) as place, row_number() over (order by doc_id) as row_no from documents),
one as (select source, sum(size)::bigint as source_size from docs group by source),
weighed as (select *, [3, 1, 2][((row_number() over (order by encode(source) nulls last) - 1) % 3) + 1] as weight from one),
caps as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio from weighed),
levels as (
  select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(cap) over below, 0)) / (sum(weight) over () - coalesce(sum(weight) over below, 0)) as level
  from caps window below as (order by ratio, encode(source) nulls last rows between unbounded preceding and 1 preceding)),
found as (select level from levels where level <= ratio order by ratio, encode(source) nulls last limit 1),
goals as (select source, source_size, least(cap, coalesce((select level from found), 'inf'::double) * weight) as target from levels),
scale as (select 64::bigint as block),
quotas as (
  select *, ((source_size + block - 1) // block) as blocks,
    case when source_size > 0 then target * ((source_size + block - 1) // block) / source_size else 0.0::double end as quota from goals, scale),
highs as (select *, floor(sum(quota) over (order by encode(source) nulls last rows unbounded preceding) + 0.5)::bigint as high from quotas),
spans as (select *, coalesce(lag(high) over (order by encode(source) nulls last), 0) as low from highs),
total as (select max(high) as n from spans),
golden as (select min(g) as g from (select unnest(range(greatest(1, floor(n * 0.6180339887498949::double)::bigint), floor(n * 0.6180339887498949::double)::bigint + 1000)) as g, n from total) where gcd(g, n) = 1),
points as (select i, (i * g) % n as point from (select unnest(range(n)) as i, n from total), golden),
slots as (
  select s.source, s.blocks, row_number() over (partition by s.source order by i) - 1 as place from points join spans s on point >= low and point < high),
times as (select source, place % blocks as block_no, count(*) as times from slots where place < 2 * blocks group by all),
placed as (select *, coalesce(sum(size) over (partition by source order by place, row_no rows between unbounded preceding and 1 preceding), 0)::bigint as start_at from docs where size > 0),
parts as (select p.*, unnest(range(start_at // block, (start_at + size - 1) // block + 1)) as block_no, block from placed p, scale),
taken as (
  select row_no, sum((least(start_at + size, (p.block_no + 1) * block) - greatest(start_at, p.block_no * block)) * times)::bigint as taken
  from parts p join times t on p.source is not distinct from t.source and p.block_no = t.block_no group by row_no)
select d.doc_id, d.size, g.source_size, g.target, coalesce(t.taken, 0) as taken
from docs d join goals g on d.source is not distinct from g.source left join taken t on t.row_no = d.row_no
"""

_OP9 = r"""
with recursive rules as (
  select * from (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(action, rule_host, rule_path)),
base as (
  select page_id, url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path, regexp_replace(trim(url), '#.*$', '', 's') as bare,
    regexp_extract(regexp_extract(coalesce(html, ''), '<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), '\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is') as link,
    regexp_extract(regexp_extract(coalesce(html, ''), '<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), '\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is') as fresh
  from pages),
targets as (
  select *, coalesce(nullif(link, ''), nullif(fresh, '')) as dest, regexp_extract(url, '^.*?://[^/?#]*', 0, 's') as root, regexp_extract(url, '^(.*?:)//', 1, 's') as scheme,
    regexp_extract(url, '^.*?://[^/?#]*(?:[^?#]*/)?', 0, 's') as folder from base),
absolute as (
  select *, case when root = '' or dest is null then null when contains(dest, '://') then dest when starts_with(dest, '//') then scheme || dest when starts_with(dest, '/') then root || dest
    when ends_with(folder, '/') then folder || dest else folder || '/' || dest end as whole from targets),
raw_nodes as (
  select page_id, host, path, bare, regexp_replace(trim(whole), '#.*$', '', 's') as whole from absolute),
heads as (select *, regexp_extract(bare, '^.*?://[^/?#]*', 0, 's') as h1, regexp_extract(whole, '^.*?://[^/?#]*', 0, 's') as h2 from raw_nodes),
named as (
  select page_id, host, path, translate(h1, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(bare, length(h1) + 1) as node,
    translate(h2, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(whole, length(h2) + 1) as dest from heads),
ruled as (
  select n.*, (select max({'n': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'action': action}) from rules
    where (n.host = rule_host or ends_with(n.host, '.' || rule_host)) and starts_with(n.path, rule_path)) as best from named n),
edges as (select node as a, dest as b from named where dest is not null and host <> '' union select dest, node from named where dest is not null and host <> ''),
reach as (select distinct a as node, a as other from edges union select r.node, e.b from reach r join edges e on e.a = r.other),
parts as (
  select distinct node, other, translate(regexp_extract(other, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(other, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from reach),
votes as (
  select node, (select max({'n': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'action': action}) from rules
    where (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path)) as best from parts p),
spread as (select node from votes group by node having bool_or(coalesce(best.action = 'block', false)) and not bool_or(coalesce(best.action = 'allow', false)))
select page_id, host, path, best.rule as rule, coalesce(best.action, case when s.node is not null then 'block' else 'allow' end) as verdict
from ruled r left join spread s on s.node = r.node
"""

_OP10 = r"""
with digests as (
  select doc_id, length(coalesce(text, '')) as n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by text_sha256) as group_size,
  row_number() over best = 1 as kept, text_sha256
from digests window best as (partition by text_sha256 order by n_chars desc, doc_id nulls last)
"""

ORACLES: dict[str, str] = {"op2_minhash_join": _OP2, "op8_source_mix": _OP8, "op9_redirect_rules": _OP9, "op10_exact_dedup": _OP10}

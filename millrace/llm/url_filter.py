"""URL filter rules whose block decisions reach every alias of a page.

A url's aliases are those that redirects and canonical links connect it to, found as connected components with
DataFrame operations only. A url that fits a rule has that rule's verdict; another url of a component is allowed if
any url of it is allowed by a rule, else blocked if any is blocked, else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import components, cut

ALLOW, BLOCK = "allow", "block"
#: (action, host, path) of the production rules
RULES = ((ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"))
#: Rules compiled into one expression at most; more are joined by host.
COMPILED = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"(?s)^.*?://"
_LINK = r"(?is)<link\b[^>]*?\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if the url is null or has no ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER + r"([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER + r"[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """The url without fragment and white space around it, scheme and host lower-cased: a node of the alias graph."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*", 0)
    return F.concat(F.translate(head, _UPPER, _LOWER), F.substr(bare, F.length(head) + 1))


def canonical(url: Column, html: Column) -> Column:
    """The addresses that a page's canonical links and refreshes name, made absolute; an empty array if there are none."""
    html = F.coalesce(html, F.lit(""))
    marked = F.lower(html).contains("canonical") | F.lower(html).contains("http-equiv")  # cheap test before the patterns
    named = lambda tag, at: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, at, 1))
    links = named(_LINK, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)")
    fresh = named(_REFRESH, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)")
    root = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(?:[^?#]*/)?", 0)

    def absolute(to: Column) -> Column:
        return (
            F.when(to.contains("://"), to)
            .when(to.startswith("//"), F.concat(scheme, to))
            .when(to.startswith("/"), F.concat(root, to))
            .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), to))
        )

    to = F.array_distinct(F.transform(F.filter(F.concat(links, fresh), lambda x: x != ""), lambda x: address(absolute(x))))
    return F.when(marked & (root != ""), to).otherwise(F.array().cast("array<string>"))


def fits(at: Column, under: Column, rule_host: str, rule_path: str) -> Column:
    return ((at == rule_host) | at.endswith(f".{rule_host}")) & under.startswith(rule_path)


def match(urls: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """urls (with host, path) plus rule and ruled: the longest rule that fits (then by code point), and its action.

    A rule fits its host and all subdomains of it if the path starts with the rule's path.
    """
    if len(rules) <= COMPILED:
        found = [F.when(fits(F.col("host"), F.col("path"), h, p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"))) for a, h, p in rules]
        kind = "struct<n:int,rule:string,action:string>"
        return urls.withColumn("_best", F.array_max(F.array(*[x.cast(kind) for x in found])) if found else F.lit(None).cast(kind)).select(*urls.columns, F.col("_best.rule").alias("rule"), F.col("_best.action").alias("ruled"))
    table = urls.sparkSession.createDataFrame([(h, p, h + p, a) for a, h, p in rules], "rule_host string, rule_path string, rule string, action string")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = cut(urls.withColumn("_row", F.monotonically_increasing_id()))
    hits = keyed.select("_row", "path", F.explode(ends).alias("rule_host")).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = hits.groupBy("_row").agg(F.max(F.struct(F.length("rule"), "rule", "action")).alias("best"))
    return keyed.join(best, "_row", "left").select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.action").alias("ruled"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per row of pages: (page_id, host, path, rule, verdict).

    Edges come from all canonical links and refreshes of the pages, and from `redirects` (from_url, to_url) if given.
    A null url, or one without ://, has empty host and path, fits no rule, has no alias and is allowed. Null or very
    long html, repeated urls and other columns do no harm; an empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), *([F.col(html_col).cast("string").alias("html")] if html_col else []))
    rows = base.select("page_id", address(F.col("url")).alias("node"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), (canonical(F.col("url"), F.col("html")) if html_col else F.array().cast("array<string>")).alias("to"))
    rows = cut(match(rows, rules))
    edges = rows.where("host <> ''").select(F.col("node").alias("u"), F.explode("to").alias("v"))
    if redirects is not None:
        edges = edges.unionByName(redirects.where(F.col("from_url").contains("://") & F.col("to_url").contains("://")).select(address(F.col("from_url")).alias("u"), address(F.col("to_url")).alias("v")))
    alias = components(edges)
    members = match(alias.withColumn("host", host(F.col("node"))).withColumn("path", path(F.col("node"))), rules)
    decided = members.groupBy("component").agg(F.max(F.when(F.col("ruled") == ALLOW, 1).otherwise(0)).alias("allowed"), F.max(F.when(F.col("ruled") == BLOCK, 1).otherwise(0)).alias("blocked"))
    spread = alias.join(decided.where("blocked = 1 and allowed = 0"), "component").select("node", F.lit(BLOCK).alias("spread"))
    judged = rows.join(spread, "node", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit(ALLOW)).alias("verdict"))

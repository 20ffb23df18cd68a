"""URL filter with redirect equivalence, in DataFrame operations only.

Each url is judged by the longest rule that fits it. Canonical links, meta
refreshes in the pages and further given redirects join urls into classes of
aliases (connected components); a page without a rule of its own is blocked if
a url of its class is blocked by a rule, and allowed otherwise. A rule that
allows a url holds for it even if an alias is blocked.

A null url, or one without ``://``, has empty host and path, fits no rule and
has no alias: it is allowed. Repeated rows each give a row; further columns
are ignored; null html has no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import table
from rowlens.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Rules that are compared in one expression; longer lists are joined, with the same answer.
INLINE_RULES = 200


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def url_key(url: Column) -> Column:
    """A url as a node: without its fragment, scheme and host in lower case."""
    bare = F.regexp_extract(url, r"^([^#]*)", 1)
    head = F.regexp_extract(bare, r"^([^:/?#]+://[^/?#]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.substr(bare, F.length(head) + 1))


def _inline(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of rules as
    long, an allowing one, then the smaller host, then the smaller path wins."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        got = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, got) if found is None else found.when(fits, got)
    return found


def judge(urls: DataFrame, rules) -> DataFrame:
    """Adds struct column ``own`` to a table of distinct rows with host, path."""
    if len(rules) <= INLINE_RULES:
        return urls.withColumn("own", _inline(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("struct<rule:string,verdict:string>"))
    given = urls.sparkSession.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, r_host string, r_path string")
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host", "path").distinct().withColumn("r_host", F.explode(tails))
    order = F.struct((-F.length("rule")).alias("n"), (F.col("verdict") != "allow").alias("later"), F.col("r_host"), F.col("r_path"), F.col("rule"), F.col("verdict"))
    best = (
        hosts.join(given, "r_host").where(F.startswith("path", F.col("r_path"))).withColumn("rule", F.concat("r_host", "r_path"))
        .groupBy("host", "path").agg(F.min(order).alias("top"))
        .select("host", "path", F.struct(F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict")).alias("own"))
    )
    return urls.join(best, ["host", "path"], "left")


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\"'\s>]+)", 1)
    return F.trim(F.regexp_replace(value, r"^[\"']|[\"']$", ""))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b) keys that a page's canonical link or meta refresh makes aliases."""
    linked = pages.where(F.col(html).rlike(r"(?i)canonical|http-equiv")).where(F.instr(F.col(url), "://") > 0)
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))
    targets = F.filter(F.transform(tags, _target), lambda to: to != "")
    keys = F.transform(F.transform(targets, lambda to: _resolved(F.col(url), to)), url_key)
    return linked.select(F.col(url).alias("base"), F.explode(keys).alias("b")).select(url_key(F.col("base")).alias("a"), "b")


def _target(tag: Column) -> Column:
    """The link of a canonical link or refresh tag; empty for other tags."""
    refresh = F.regexp_extract(_attribute(tag, "content"), r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    is_link = tag.rlike(r"(?is)^<link") & F.lower(_attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)")
    is_meta = tag.rlike(r"(?is)^<meta") & (F.lower(_attribute(tag, "http-equiv")) == "refresh")
    found = F.when(is_link, _attribute(tag, "href")).when(is_meta, F.trim(refresh)).otherwise("")
    return F.replace(found, F.lit("&amp;"), F.lit("&"))


def _resolved(base: Column, to: Column) -> Column:
    """An absolute url for a link found at base; null for a mere fragment."""
    root, scheme = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1), F.regexp_extract(base, r"^([^:/?#]+):", 1)
    folder = F.regexp_extract(base, r"^([^:/?#]+://[^?#]*/)", 1)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(root, to))
        .when(F.startswith(to, F.lit("?")), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), to))
        .when(F.startswith(to, F.lit("#")), F.lit(None))
        .otherwise(F.concat(F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/"))), to))
    )


def url_filter(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) of every page; redirects: (from_url, to_url)."""
    url = F.col("url")
    p = pages.select(F.col(id_col).alias("id"), "url", F.when(F.instr(url, "://") > 0, url_key(url)).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.where("instr(from_url, '://') > 0 and instr(to_url, '://') > 0").select(url_key(F.col("from_url")).alias("a"), url_key(F.col("to_url")).alias("b")))
    alias = components(links)
    named = judge(alias.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    blocked = named.where("own.verdict = 'block'").select("component").distinct()
    spread = alias.join(blocked, "component").select(F.col("node").alias("key"), F.lit("block").alias("alias_verdict"))
    out = judge(p, rules).join(spread, "key", "left")
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "alias_verdict", F.lit("allow")).alias("verdict"),
    )


def op9_url_filter(spark, sf_dir) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


#: The driver's pages hold no canonical link, refresh or redirect, so a page
#: without a rule is allowed; classes of aliases are tested on small fixtures.
ORACLE = r"""
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), judged as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), rules(verdict, h, p) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit as (
  select page_id, h || p as rule, verdict, row_number() over (partition by page_id order by length(h || p) desc) as n
  from judged, rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
)
select j.page_id, j.host, j.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from judged j left join fit f on j.page_id = f.page_id and f.n = 1
"""

"""URL filters that follow redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import connected_components, cut

#: (host, path, verdict); the path starts with a slash.
Rule = tuple[str, str, str]
DEFAULT_RULES: list[Rule] = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of up to this number are kept in the plan as one literal.
MAX_LITERAL_RULES = 2_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; null or
    no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(urls: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Adds ``rule`` and ``ruled`` (its verdict) to ``urls(host, path, ...)``: of the
    rules whose host is the url's or a parent domain of it and whose path starts
    the url's, the one with the longest host and path together; equal ones that
    disagree: allow. Null where none fits.

    A few rules become one literal expression. Many are joined: each url is
    spread over its parent domains and the distinct lengths of rule paths, so the
    join is by equality alone, whatever a domain's number of rules."""
    if not rules:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("ruled", F.lit(None).cast("string"))
    ranked = sorted({(h.lower(), p, v) for h, p, v in rules}, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r))
    if len(ranked) <= MAX_LITERAL_RULES:
        dotted = F.concat(F.lit("."), F.col("host"))
        fits = [(dotted.endswith("." + h) & F.col("path").startswith(p), h + p, v) for h, p, v in ranked]
        rule, ruled = F, F
        for fit, name, verdict in fits:
            rule, ruled = rule.when(fit, F.lit(name)), ruled.when(fit, F.lit(verdict))
        return urls.select("*", rule.alias("rule"), ruled.alias("ruled"))
    spark = urls.sparkSession
    table = spark.createDataFrame(ranked, "_host string, _path string, _verdict string")
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for _, p, _ in ranked})])
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = urls.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("_host"))
    spread = spread.select("*", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("_n"))
    spread = spread.select("host", "path", "_host", F.col("path").substr(F.lit(1), F.col("_n")).alias("_path"))
    allow_first = F.when(F.col("_verdict") == "allow", 1).otherwise(0)
    best = F.max(F.struct(F.length(F.concat("_host", "_path")).alias("n"), allow_first.alias("a"), F.col("_host").alias("h"), F.col("_path").alias("p"), F.col("_verdict").alias("v")))
    found = spread.join(table, ["_host", "_path"]).groupBy("host", "path").agg(best.alias("_b"))
    out = urls.join(found, ["host", "path"], "left")
    return out.select(*urls.columns, F.concat("_b.h", "_b.p").alias("rule"), F.col("_b.v").alias("ruled"))


def _attr(tag: Column, name: str) -> Column:
    form = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.concat(*[F.regexp_extract(tag, form, i) for i in (1, 2, 3)])


def link_targets(html: Column) -> Column:
    """Array of the raw targets of canonical links and refresh redirects in a whole
    page. Pages without either cost two substring searches."""
    low = F.lower(html)
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: F.lower(_attr(t, "rel")) == "canonical"), lambda t: _attr(t, "href"))
    refresh = F.filter(tags, lambda t: F.lower(_attr(t, "http-equiv")) == "refresh")
    refresh = F.transform(refresh, lambda t: F.regexp_extract(_attr(t, "content"), r"(?i)url\s*=\s*['\"]?([^'\"]*)", 1))
    some = F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("refresh"))
    return F.when(some, F.filter(F.concat(canonical, refresh), lambda x: F.trim(x) != "")).otherwise(F.array().cast("array<string>"))


def resolve(base: Column, host: Column, path: Column, target: Column) -> Column:
    """The absolute url of ``target`` on the page ``base``."""
    t = F.trim(target)
    root = F.concat(F.lit("x://"), host)
    return (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.startswith("//"), F.concat(F.lit("x:"), t))
        .when(t.startswith("/"), F.concat(root, t))
        .when(t.startswith("?"), F.concat(root, path, t))
        .when(t.startswith("#"), base)
        .otherwise(F.concat(root, F.regexp_replace(path, r"[^/]*$", ""), F.when(path == "", F.lit("/")).otherwise(F.lit("")), t))
    )


def node_of(url: Column) -> Column:
    """What stands for a url among its aliases: host, path and query, without
    scheme and fragment; null where there is no host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: Sequence[Rule] = DEFAULT_RULES, default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id,
    url, html)``.

    Where a rule fits the url, its verdict holds. Otherwise the page is blocked
    if an alias of it is blocked by a rule and none is allowed by one; else
    ``default``. Aliases are the urls joined by canonical links and refresh
    redirects in the pages, and by ``redirects(source, target)`` if given; also
    targets without a page count. Null urls have no aliases; null html has no
    links; repeated rows are judged each; of rules that fit the longest wins, and
    two of one length can't both fit; a very long url or html is matched whole by
    one expression; an empty table gives no rows. Only the three columns named are
    read, so others may have any name.

    Only urls with edges enter the components, whose decisions are aggregated to
    one row per component before they are joined."""
    page = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    targets = page.where("node is not null").select("url", "host", "path", "node", F.explode(link_targets(F.col("html"))).alias("t"))
    edges = targets.select(F.col("node").alias("a"), node_of(resolve(F.col("url"), F.col("host"), F.col("path"), F.col("t"))).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
    edges = cut(edges.where("a is not null and b is not null and a <> b").distinct())
    judged = match_rules(page.select("page_id", "host", "path", "node"), rules)
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))
    cc = cut(connected_components(edges))
    url = F.concat(F.lit("x://"), F.col("node"))
    members = match_rules(cc.select("node", "component", host_of(url).alias("host"), path_of(url).alias("path")), rules)
    decided = members.groupBy("component").agg(F.bool_or(F.col("ruled") == "block").alias("blocked"), F.bool_or(F.col("ruled") == "allow").alias("allowed"))
    blocked = decided.where("blocked and not coalesce(allowed, false)").select("component")
    alias = cc.join(blocked, "component", "left_semi").select(F.col("node").alias("_node"), F.lit("block").alias("_by_alias"))
    out = judged.join(alias, judged["node"] == alias["_node"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "_by_alias", F.lit(default)).alias("verdict"))


def op4_urls(pages: DataFrame) -> DataFrame:
    """The query's columns; odd rows as in ``judge``."""
    return judge(pages)


def op4_aliases(pages: DataFrame) -> DataFrame:
    """As ``op4_urls``, where a page also redirects to the page of smallest id that has
    the same html, so that decisions propagate to mirrors."""
    own = pages.where("html is not null and url is not null").select("page_id", "url", F.sha2(F.col("html"), 256).alias("d"))
    first = own.groupBy("d").agg(F.min_by("url", F.struct("page_id", "url")).alias("target"))
    return judge(pages, own.join(first, "d").select(F.col("url").alias("source"), "target"))


def _attr_sql(name: str) -> str:
    form = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))"""
    return " || ".join(f"regexp_extract(tag, '{form}', {i})" for i in (1, 2, 3))


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in DEFAULT_RULES)
_PARTS = rf"""coalesce(translate(regexp_extract({{u}}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS {{p}}host,
    coalesce(regexp_extract({{u}}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS {{p}}path, coalesce(regexp_extract({{u}}, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS {{p}}q"""

#: The whole method in DuckDB's SQL, with a recursive closure for the components;
#: @MORE@ stands for further edges (node, url).
_SQL = rf"""
WITH RECURSIVE rules(rh, rp, rv) AS (VALUES {_RULE_ROWS}), p AS (
  SELECT page_id, url, html, {_PARTS.format(u="url", p="")} FROM pages
), n AS (SELECT *, CASE WHEN host <> '' THEN host || path || q END AS node FROM p
), tags AS (
  SELECT url, host, path, node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM n
  WHERE node IS NOT NULL AND (contains(lower(html), 'canonical') OR contains(lower(html), 'refresh'))
), t AS (
  SELECT *, trim(CASE WHEN lower({_attr_sql("rel")}) = 'canonical' THEN {_attr_sql("href")}
    WHEN lower({_attr_sql("http-equiv")}) = 'refresh' THEN regexp_extract({_attr_sql("content")}, '(?i)url\s*=\s*[''"]?([^''"]*)', 1) END) AS t FROM tags
), r AS (
  SELECT node, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN 'x:' || t
    WHEN starts_with(t, '/') THEN 'x://' || host || t WHEN starts_with(t, '?') THEN 'x://' || host || path || t WHEN starts_with(t, '#') THEN url
    ELSE 'x://' || host || regexp_replace(path, '[^/]*$', '') || CASE WHEN path = '' THEN '/' ELSE '' END || t END AS u FROM t WHERE t <> '' @MORE@
), m AS (SELECT node, {_PARTS.format(u="u", p="t")} FROM r
), e AS (SELECT DISTINCT node AS a, thost || tpath || tq AS b FROM m WHERE thost <> '' AND node <> thost || tpath || tq
), ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), reach AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
), urls AS (SELECT DISTINCT b AS node, regexp_extract(b, '^[^/?]*') AS host, regexp_extract(b, '^[^/?]*([^?]*)', 1) AS path FROM reach
), ruled AS (
  SELECT node, arg_max(rv, length(rh || rp)) AS v FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY node
), alias AS (
  SELECT a AS node FROM reach JOIN ruled ON ruled.node = b GROUP BY a HAVING bool_or(v = 'block') AND NOT bool_or(v = 'allow')
), own AS (
  SELECT u.host, u.path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS v FROM (SELECT DISTINCT host, path FROM n) u
  JOIN rules ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp) GROUP BY u.host, u.path
)
SELECT page_id, n.host, n.path, rule, CASE WHEN v IS NOT NULL THEN v WHEN alias.node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM n LEFT JOIN own ON own.host = n.host AND own.path = n.path LEFT JOIN alias ON alias.node = n.node
"""

ORACLE = _SQL.replace("@MORE@", "")
ALIASES = _SQL.replace(
    "@MORE@",
    """UNION ALL SELECT n.node, f.url FROM n
  JOIN (SELECT html, arg_min(url, struct_pack(i := page_id, u := url)) AS url FROM pages WHERE html IS NOT NULL AND url IS NOT NULL GROUP BY html) f ON n.html = f.html
  WHERE n.node IS NOT NULL""",
)

"""Allow and block rules for URLs, carried over redirects and canonical links, in DataFrame operations only.

Pages whose addresses mean one resource (scheme, fragment, tracking parameters and a closing slash aside) are one node;
redirects and canonical links that pages declare join nodes, and connected components are the aliases of a resource.
A page that a rule fits has that rule's verdict. Any other page is blocked if an alias of it is blocked by a rule and
none is allowed by one: an explicit allow comes before a block that only an alias carries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.components import components
from gneiss.llm.shared import table, written

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What an address means: host, path without closing slash, and a query without tracking parameters; null without a host."""
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1), r"(?:^|&)(?:utm_[a-z]+|gclid|fbclid)=[^&]*", "")
    plain = F.concat(host_of(url), F.regexp_replace(path_of(url), r"/+$", ""))
    return F.when(host_of(url) != "", F.concat(plain, F.when(query != "", F.concat(F.lit("?"), F.regexp_replace(query, "^&", ""))).otherwise("")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; of rules with one text an allow comes first. Null if none fits."""
    names, verdicts = [], []
    for verdict, of, under in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(under)
        names.append(F.when(fits, F.lit(of + under)))
        verdicts.append(F.when(fits, F.lit(verdict)))
    return (F.coalesce(*names), F.coalesce(*verdicts)) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _without_dots(path: Column) -> Column:
    """A path with its segments ``.`` and ``..`` carried out."""
    closed = F.when(path.rlike(r"(?:^|/)\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)
    step = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.array_join(F.aggregate(F.split(closed, "/"), F.array().cast("array<string>"), step), "/")).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """The absolute address that ``target`` names on a page at ``url``; one that begins with a scheme stays as it is."""
    origin, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    asked = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    folder = F.concat(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.when(path.contains("/"), F.lit("")).otherwise("/"))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(origin, _without_dots(rest), asked))
        .when(rest != "", F.concat(origin, _without_dots(F.concat(folder, rest)), asked))
        .when(target.startswith("?"), F.concat(origin, path, asked))
        .otherwise(url)
    )


def _once(column: Column) -> Column:
    """The column as a generator's: what reads it takes the value, where the planner would copy the expression into each use."""
    return F.explode(F.array(column))


#: What holds no markup of its own: comments, and elements whose text is not the page's.
HIDDEN = "(?is)" + "|".join([r"<!--.*?(?:-->|\z)", *(rf"<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)" for name in ("script", "style", "template", "textarea", "title", "xmp"))])
TAG = r"""(?i)(<(?:link|meta|base)\b(?:[^>"']+|"[^"]*"|'[^']*')*>)"""
CANONICAL = r"(?i)(?:^|\s)canonical(?:$|\s)"
MOVED = r"(?i)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*[\"']?\s*([^\"'\s]+)"


def _attribute(name: str) -> str:
    return rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted in either way or bare; empty if it has none."""
    return F.trim(F.replace(F.concat(*(F.regexp_extract(tag, _attribute(name), k) for k in (1, 2, 3))), F.lit("&amp;"), F.lit("&")))


def declared_links(pages: DataFrame) -> DataFrame:
    """``u, v, host, path``: nodes of a page and of the address that its canonical link or its refresh names, and that address's parts.

    Comments, scripts, styles, templates, titles and text areas declare nothing. Relative addresses are those of the page's first base
    element with an address, or else of its url. A null html declares nothing, and a page without a host has no links.
    """
    tags = F.filter(F.regexp_extract_all(F.regexp_replace("html", HIDDEN, " "), F.lit(TAG), 1), lambda t: t.rlike(r"(?i)^<(?:link|meta|base)\s"))
    held = pages.select("url", _once(tags).alias("tags"))
    bases = F.filter("tags", lambda t: t.rlike("(?i)^<base") & (attribute(t, "href") != ""))
    held = held.where(F.size("tags") > 0).select("url", "tags", _once(F.coalesce(attribute(F.try_element_at(bases, F.lit(1)), "href"), F.lit(""))).alias("base"))
    held = held.select("url", _once(resolved(F.col("base"), F.col("url"))).alias("base"), F.explode("tags").alias("tag"))
    href = F.when(F.col("tag").rlike("(?i)^<link") & attribute(F.col("tag"), "rel").rlike(CANONICAL), attribute(F.col("tag"), "href"))
    moved = F.when(F.col("tag").rlike("(?i)^<meta") & (F.lower(attribute(F.col("tag"), "http-equiv")) == "refresh"), F.regexp_extract(attribute(F.col("tag"), "content"), MOVED, 1))
    links = held.select("url", "base", _once(F.coalesce(href, moved)).alias("to")).where("to <> ''").select("url", _once(resolved(F.col("to"), F.col("base"))).alias("to"))
    links = links.select(_once(node_of(F.col("url"))).alias("u"), "to").where("u is not null")
    return links.select("u", node_of(F.col("to")).alias("v"), host_of(F.col("to")).alias("host"), path_of(F.col("to")).alias("path")).where("v is not null and u <> v")


def judged(pages: DataFrame, links: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url, ...)``; ``links(u, v, host, path)`` join nodes of :func:`node_of`.

    ``host`` and ``path`` are those of the address behind ``v``: a rule that fits it counts for its aliases, whether or not
    it is a page of the table.

    A null url, or one without ``://``, has an empty host and path; no rule fits it, it has no alias, and it is
    allowed. Repeated rows give repeated results, no rows none.
    """
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("own", verdict)
    named = components(links)
    _, linked_verdict = rule_for(F.col("host"), F.col("path"), rules)
    linked = links.select(F.col("v").alias("node"), linked_verdict.alias("own")).where("own is not null").distinct().withColumn("open", F.lit(False))
    # One row for each node, then for each component: hot nodes are counted together before they are dealt out.
    held = base.where("node is not null").select("node", "own", F.col("own").isNull().alias("open")).unionByName(linked)
    nodes = held.groupBy("node").agg(F.max(F.col("own") == "allow").alias("allows"), F.max(F.col("own") == "block").alias("blocks"), F.max("open").alias("open"))
    nodes = nodes.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    blocked = nodes.groupBy("component").agg(F.max("allows").alias("allows"), F.max("blocks").alias("blocks")).where("blocks and not coalesce(allows, false)").select("component")
    carried = nodes.where("open").join(blocked, "component", "left_semi").select("node", F.lit("block").alias("carried"))
    return base.join(carried, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "carried", F.lit("allow")).alias("verdict"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged(pages, written(declared_links(pages), "links"))  # read twice below; the pages are searched once


_SQL_HOST = "translate(coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), ''), '" + CAPITALS + "', '" + SMALL + "')"
_SQL_PATH = "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_SQL_QUERY = "regexp_replace(regexp_extract({0}, '(?s)^[^#]*?\\?([^#]*)', 1), '(?:^|&)(?:utm_[a-z]+|gclid|fbclid)=[^&]*', '', 'g')"


def _sql_node(url: str) -> str:
    host, path, query = (x.format(url) for x in (_SQL_HOST, _SQL_PATH, _SQL_QUERY))
    return f"CASE WHEN {host} <> '' THEN {host} || regexp_replace({path}, '/+$', '') || CASE WHEN {query} <> '' THEN '?' || regexp_replace({query}, '^&', '') ELSE '' END END"


def _sql_fits(value: int) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[value]}'" for v, h, p in ordered) + " END"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_attribute(tag: str, name: str) -> str:
    groups = " || ".join(f"regexp_extract({tag}, {_q(_attribute(name))}, {k})" for k in (1, 2, 3))
    return f"trim(replace({groups}, '&amp;', '&'))"


def _sql_plain(path: str) -> str:
    step = "CASE WHEN x = '..' THEN CASE WHEN contains(kept, '/') THEN regexp_replace(kept, '/[^/]*$', '') ELSE kept END WHEN x = '.' THEN kept ELSE kept || '/' || x END"
    closed = f"CASE WHEN regexp_matches({path}, '(?:^|/)\\.\\.?$') THEN {path} || '/' ELSE {path} END"
    return f"CASE WHEN regexp_matches({path}, '(?:^|/)\\.\\.?(?:/|$)') THEN list_reduce(string_split({closed}, '/'), lambda kept, x: {step}) ELSE {path} END"


def _sql_resolved(target: str, url: str) -> str:
    """:func:`resolved` in SQL."""
    origin, path = f"regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1)", _SQL_PATH.format(url)
    asked, rest = f"regexp_extract({target}, '(?s)^[^?#]*(.*)$', 1)", f"regexp_extract({target}, '(?s)^([^?#]*)', 1)"
    folder = f"(regexp_extract({path}, '(?s)^(.*/)', 1) || CASE WHEN contains({path}, '/') THEN '' ELSE '/' END)"
    return f"""CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {target} WHEN starts_with({target}, '//') THEN regexp_extract({url}, '(?s)^(.*?:)//', 1) || {target}
  WHEN starts_with({target}, '/') THEN {origin} || {_sql_plain(rest)} || {asked} WHEN {rest} <> '' THEN {origin} || {_sql_plain(f"({folder} || {rest})")} || {asked} WHEN starts_with({target}, '?') THEN {origin} || {path} || {asked} ELSE {url} END"""


OP8_SQL = f"""
WITH RECURSIVE base AS (SELECT page_id, url, {_SQL_HOST.format("url")} AS host, {_SQL_PATH.format("url")} AS path, {_sql_node("url")} AS node FROM pages),
ruled AS (SELECT page_id, host, path, node, {_sql_fits(0)} AS rule, {_sql_fits(1)} AS own FROM base),
tags AS (SELECT url, list_filter(regexp_extract_all(regexp_replace(html, {_q(HIDDEN)}, ' ', 'g'), {_q(TAG)}, 1), lambda t: regexp_matches(t, '(?i)^<(?:link|meta|base)\\s')) AS tags FROM pages),
based AS (SELECT url, tags, coalesce({_sql_attribute("list_filter(tags, lambda t: regexp_matches(t, '(?i)^<base') AND " + _sql_attribute("t", "href") + " <> '')[1]", "href")}, '') AS base FROM tags WHERE len(tags) > 0),
spread AS (SELECT url, {_sql_resolved("base", "url")} AS base, unnest(tags) AS tag FROM based),
told AS (SELECT url, base, CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches({_sql_attribute("tag", "rel")}, {_q(CANONICAL)}) THEN {_sql_attribute("tag", "href")}
  WHEN regexp_matches(tag, '(?i)^<meta') AND lower({_sql_attribute("tag", "http-equiv")}) = 'refresh' THEN regexp_extract({_sql_attribute("tag", "content")}, {_q(MOVED)}, 1) END AS href FROM spread),
named AS (SELECT url, {_sql_resolved("href", "base")} AS href FROM told WHERE href <> ''),
links AS (SELECT {_sql_node("url")} AS u, {_sql_node("href")} AS v, {_SQL_HOST.format("href")} AS host, {_SQL_PATH.format("href")} AS path FROM named),
held AS (SELECT node, own FROM ruled UNION SELECT v, {_sql_fits(1)} FROM links WHERE u <> v),
both_ways AS (SELECT u, v FROM links WHERE u <> v UNION SELECT v, u FROM links WHERE u <> v),
reached(node, other) AS (SELECT DISTINCT node, node FROM held WHERE node IS NOT NULL UNION SELECT r.node, b.v FROM reached r JOIN both_ways b ON r.other = b.u),
decided AS (SELECT r.node, bool_or(p.own = 'allow') AS allows, bool_or(p.own = 'block') AS blocks FROM reached r JOIN held p ON p.node = r.other GROUP BY r.node)
SELECT page_id, host, path, rule, CASE WHEN own IS NOT NULL THEN own WHEN blocks AND NOT coalesce(allows, false) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN decided USING (node)
"""

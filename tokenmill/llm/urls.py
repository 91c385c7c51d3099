"""URL filter: host and path rules, and block decisions carried to redirect and canonical-link aliases.

URLs that redirect or point by a canonical link to each other are one page. Decisions of the rules spread over such
components; an explicit allow anywhere in a component takes precedence over a block elsewhere in it, and a URL's own
rule over both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import saved
from tokenmill.llm.components import connected_components

#: (verdict, host and path) of the rules that the registered query applies.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

LINK = r"""(?is)<link\b[^>]*>"""
META = r"""(?is)<meta\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"""(?is)\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'>]+)"""
#: Query parameters that only say where a visitor came from.
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid)=|^$"


def host_of(url: Column) -> Column:
    """What follows the first :// up to the next / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:.*?)://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does; of equals an allow wins.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        of_host, of_path = text.split("/", 1)
        fits = ((host == of_host) | F.endswith(host, F.lit(f".{of_host}"))) & F.startswith(path, F.lit(f"/{of_path}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def node_of(url: Column) -> Column:
    """Name of the page a URL stands for: host, path and query without scheme, fragment, tracking parameters, default
    port and final slash; null for a URL without host."""
    host = F.regexp_replace(host_of(url), r":(?:80|443)$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:.*?)://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~x.rlike(TRACKING)), "&")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def without_dots(path: Column) -> Column:
    """A path with its . and .. steps taken; .. at the root stays there."""
    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")


def absolute(target: Column, base: Column) -> Column:
    """A link target as a full URL: as it is, or with the scheme, the host, the folder or the path of the page it stands on.

    Null for an empty target, a place on the page itself (#...) and schemes without host (mailto: and the like).
    """
    t = F.regexp_replace(F.trim(target), "&amp;", "&")
    site = F.concat(F.regexp_extract(base, r"^([^:/?#]*)://", 1), F.lit("://"), host_of(base))
    own, rest = F.regexp_extract(t, r"(?s)^([^?#]*)", 1), F.regexp_extract(t, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(F.concat(F.lit("/"), F.regexp_replace(path_of(base), "^/", "")), r"(?s)^(.*/)", 1)
    return (F.when((t == "") | F.startswith(t, F.lit("#")), None).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(F.startswith(t, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^:/?#]*)://", 1), F.lit(":"), t))
            .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(own == "", F.concat(site, path_of(base), rest)).when(F.startswith(t, F.lit("/")), F.concat(site, without_dots(own), rest))
            .otherwise(F.concat(site, without_dots(F.concat(folder, own)), rest)))


def targets_of(html: Column, url: Column) -> Column:
    """Array of full URLs that a page's canonical links and refresh redirects lead to."""
    none = F.array().cast("array<string>")
    low = F.lower(html)
    first = lambda tag: F.concat(*[F.regexp_extract(tag, HREF, k) for k in (1, 2, 3)])
    links = F.filter(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), lambda x: x.rlike(r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""))
    metas = F.filter(F.regexp_extract_all(html, F.lit(META), F.lit(0)), lambda x: x.rlike(r"""(?i)http-equiv\s*=\s*["']?refresh\b"""))
    links = F.when(F.contains(low, F.lit("canonical")), F.transform(links, first)).otherwise(none)
    metas = F.when(F.contains(low, F.lit("refresh")), F.transform(metas, lambda x: F.regexp_extract(x, REFRESH, 1))).otherwise(none)
    return F.filter(F.transform(F.concat(F.coalesce(links, none), F.coalesce(metas, none)), lambda t: absolute(t, url)), lambda t: t.isNotNull())


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) URLs: canonical links and refresh redirects found in each page's html."""
    return pages.select("url", F.explode(targets_of(F.col("html"), F.col("url"))).alias("target")).select(F.col("url").alias("src"), F.col("target").alias("dst"))


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row for every row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, alias_of.

    ``redirects`` (src, dst) adds known redirects. A page that a rule fits has the rule's verdict. Any other is blocked if
    a URL of its component is blocked by a rule and none is allowed by one, else allowed. alias_of is the
    component's least member, null for a URL that is alone. A null URL or one without :// has an empty host and path and fits no
    rule. Repeated pages are judged one by one; null html has no links; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    linked = alias_edges(rows)
    if redirects is not None:
        linked = linked.union(redirects.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    linked = saved(linked)
    # Each URL is tied to the page it stands for, so that its spellings meet, too; the tie matters only where it joins two URLs.
    spelled = rows.select("url").union(linked.select("src")).union(linked.select("dst")).where("url is not null").distinct().withColumn("node", node_of(F.col("url"))).where("node is not null")
    urls = saved(spelled.withColumn("verdict", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)[1]))
    comps = connected_components(linked.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    placed = urls.join(comps, "node", "left").select("url", "node", "verdict", F.coalesce("component", "node").alias("component"))
    groups = placed.groupBy("component").agg(F.count("*").alias("size"), F.max((F.col("verdict") == "block").cast("int")).alias("blocked"), F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"))
    spread = groups.where("size > 1").select("component", ((F.col("blocked") == 1) & (F.coalesce("allowed", F.lit(0)) == 0)).alias("blocked"))
    of_url = placed.join(spread, "component").select("url", F.col("component").alias("alias_of"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("own", verdict).join(of_url, "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "alias_of")


def _host_sql(u: str) -> str:
    return f"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path_sql(u: str) -> str:
    return f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _node_sql(u: str) -> str:
    kept = f"array_to_string(list_filter(string_split(regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'), lambda x: NOT regexp_matches(x, '{TRACKING}')), '&')"
    query = f"CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END"
    return f"(CASE WHEN {_host_sql(u)} <> '' THEN regexp_replace({_host_sql(u)}, ':(?:80|443)$', '') || regexp_replace({_path_sql(u)}, '/+$', '') || {query} END)"


def _dots_sql(path: str) -> str:
    step = "CASE WHEN x[1] = '..' THEN CASE WHEN len(done) > 1 THEN done[1:len(done) - 1] ELSE done END WHEN x[1] = '.' THEN done ELSE list_concat(done, x) END"
    parts = f"list_transform(string_split({path}, '/'), lambda p: [p])"
    return f"array_to_string(list_reduce({parts}, lambda done, x: {step}), '/')"


def _rule_sql(host: str, path: str, rules, which: int) -> str:
    found = "NULL"
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        of_host, of_path = text.split("/", 1)
        found = f"CASE WHEN ({host} = '{of_host}' OR ends_with({host}, '.{of_host}')) AND starts_with({path}, '/{of_path}') THEN '{(what, text)[which]}' ELSE {found} END"
    return found


def judge_sql(rules=RULES) -> str:
    """DuckDB SQL for ``judge_urls`` of the table ``pages``, without known redirects."""
    q = lambda pattern: pattern.replace("'", "''")
    href = " || ".join(f"regexp_extract(tag, '{q(HREF)}', {k})" for k in (1, 2, 3))
    scheme = "regexp_extract(url, '^([^:/?#]*)://', 1)"
    host, path = _host_sql("url"), _path_sql("url")
    return f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(list_filter(regexp_extract_all(html, '{q(LINK)}'), lambda x: regexp_matches(x, '(?i)\\brel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b'))) AS tag, true AS link FROM pages
  UNION ALL
  SELECT url, unnest(list_filter(regexp_extract_all(html, '{q(META)}'), lambda x: regexp_matches(x, '(?i)http-equiv\\s*=\\s*["'']?refresh\\b'))), false FROM pages),
found AS (SELECT url, replace(trim(CASE WHEN link THEN {href} ELSE regexp_extract(tag, '{q(REFRESH)}', 1) END), '&amp;', '&') AS t FROM tags),
parts AS (
  SELECT url, t, {scheme} || '://' || {host} AS site, regexp_extract(t, '(?s)^([^?#]*)', 1) AS own, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) AS rest,
         regexp_extract('/' || regexp_replace({path}, '^/', ''), '(?s)^(.*/)', 1) AS folder FROM found),
links AS (
  SELECT url AS src, CASE WHEN t = '' OR starts_with(t, '#') THEN NULL WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN {scheme} || ':' || t
                          WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN own = '' THEN site || {path} || rest
                          WHEN starts_with(t, '/') THEN site || {_dots_sql("own")} || rest ELSE site || {_dots_sql("folder || own")} || rest END AS dst FROM parts),
urls AS (SELECT url, {_node_sql("url")} AS node, {_rule_sql(host, path, rules, 0)} AS verdict
         FROM (SELECT url FROM pages UNION SELECT src FROM links WHERE dst IS NOT NULL UNION SELECT dst FROM links) WHERE url IS NOT NULL AND {host} <> ''),
edges AS (SELECT {_node_sql("src")} AS x, {_node_sql("dst")} AS y FROM links WHERE dst IS NOT NULL),
pairs AS (SELECT x, y FROM edges WHERE x IS NOT NULL AND y IS NOT NULL UNION SELECT y, x FROM edges WHERE x IS NOT NULL AND y IS NOT NULL),
reach AS (SELECT DISTINCT node, node AS c FROM urls UNION SELECT b.y, r.c FROM reach r JOIN pairs b ON b.x = r.node),
comp AS (SELECT node, min(c) AS component FROM reach GROUP BY node),
groups AS (SELECT component, bool_or(coalesce(verdict = 'block', false)) AND NOT bool_or(coalesce(verdict = 'allow', false)) AS blocked
           FROM urls JOIN comp USING (node) GROUP BY component HAVING count(*) > 1),
of_url AS (SELECT url, component AS alias_of, blocked FROM urls JOIN comp USING (node) JOIN groups USING (component))
SELECT page_id, {host} AS host, {path} AS path, {_rule_sql(host, path, rules, 1)} AS rule,
       coalesce({_rule_sql(host, path, rules, 0)}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, alias_of
FROM pages LEFT JOIN of_url USING (url)"""

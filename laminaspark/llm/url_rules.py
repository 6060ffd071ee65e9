"""URL filters with redirect equivalence: block decisions spread over aliases, explicit allows come first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaspark.llm.common import LOWER, UPPER, components, join_hot, read, staged

#: (verdict, host, path); a rule fits its host and all subdomains where the url's path starts with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substr(whole, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text (host and path), and its verdict; both null if none fits. Of rules of equal length
    the one that names more of the host comes first, then by verdict (allow), then by text."""
    best = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0], r[1], r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(best):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _absolute(href: Column, host: Column, path: Column) -> Column:
    """A link target without scheme and fragment, against its page: absolute, scheme-relative, rooted, query or relative."""
    clean = F.regexp_replace(F.trim(F.replace(href, F.lit("&amp;"), F.lit("&"))), r"#.*$", "")
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    schemed = F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.\-]*://(.*)$", 1)
    return (
        F.when(clean == "", F.lit(None))
        .when(schemed != "", schemed)
        .when(clean.startswith("//"), F.substr(clean, F.lit(3)))
        .when(clean.startswith("/"), F.concat(host, clean))
        .when(clean.startswith("?"), F.concat(host, path, clean))
        .when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .otherwise(F.concat(host, folder, clean))
    )


def node_of(whole: Column) -> Column:
    """What names a resource in the graph: host (lower case), path and query. `whole` has neither scheme nor fragment."""
    host = F.regexp_extract(whole, r"^([^/?]*)", 1)
    rest = F.substr(whole, F.char_length(host) + 1)
    return F.concat(F.translate(host, UPPER, LOWER), F.when((rest == "") | rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest))


_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
_MOVED = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'>\s]+)"""


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between resources that a page declares the same: its canonical link and its meta redirect."""
    host, path = host_path(F.col("url"))
    html = F.coalesce("html", F.lit(""))
    canonical = F.coalesce(*(F.nullif(F.regexp_extract(html, _LINK, k), F.lit("")) for k in (1, 2, 3)))
    moved = F.nullif(F.regexp_extract(html, _MOVED, 1), F.lit(""))
    has = (F.locate("://", F.col("url")) > 0) & (F.locate("<link", F.lower(html)).alias("l") + F.locate("http-equiv", F.lower(html)) > 0)
    own = F.regexp_replace(F.substr(F.col("url"), F.locate("://", F.col("url")) + 3), r"#.*$", "")
    found = pages.where(has).select(node_of(own).alias("a"), F.explode(F.array(_absolute(canonical, host, path), _absolute(moved, host, path))).alias("to"))
    return found.where("to IS NOT NULL").select("a", node_of(F.col("to")).alias("b"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page. DataFrame functions only.

    A page's own rule decides. A page that no rule fits takes the decision of its aliases: the connected component over
    redirect and canonical-link edges (declared by the pages, and `redirects` with urls a, b if given) in which scheme and
    fragment don't count. A component that holds an explicitly allowed resource is allowed; else one that holds a blocked
    resource is blocked; else the page is allowed. Targets that are no pages count too. Null urls and urls without `://`
    have empty host and path and no aliases; repeated rows repeat; extra columns aren't read; an empty table gives no rows.

    html is read for the edges alone and never shuffled; components move urls of linked pages only."""
    edges = alias_edges(pages.select("url", "html"))
    if redirects is not None:
        given = [F.regexp_replace(F.substr(F.col(c), F.locate("://", F.col(c)) + 3), r"#.*$", "") for c in ("a", "b")]
        edges = edges.unionByName(redirects.where("locate('://', a) > 0 AND locate('://', b) > 0").select(node_of(given[0]).alias("a"), node_of(given[1]).alias("b")))
    edges = staged(edges.distinct())
    host, path = host_path(F.col("url"))
    own = pages.select(F.col("page_id").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if edges.isEmpty():  # no page has an alias: the rules alone decide
        return own.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.lit(DEFAULT)).alias("verdict"))
    member = staged(components(edges))
    node_host, node_path = F.regexp_extract("node", r"^([^/]*)", 1), F.regexp_extract("node", r"^[^/]*([^?]*)", 1)
    told = member.withColumn("told", rule_of(node_host, node_path, rules)[1]).groupBy("component").agg(F.max(F.col("told") == "allow").alias("allowed"), F.max(F.col("told") == "block").alias("blocked"))
    shared = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise(DEFAULT)
    spread = join_hot(member, told, "component", member.count()).select("node", shared.alias("spread"))
    clean = F.regexp_replace(F.substr(F.col("url"), F.locate("://", F.col("url")) + 3), r"#.*$", "")
    node = F.when(F.locate("://", F.col("url")) > 0, node_of(clean))
    # Only pages without a rule of their own ask for their component.
    judged = own.withColumn("rule", name).withColumn("own", verdict).withColumn("node", F.when(F.col("own").isNull(), node))
    return judged.join(spread, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "spread", F.lit(DEFAULT)).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


#: The rules, and the method where pages have aliases: a recursive closure over the edges (read with DuckDB's own regular
#: expressions, for absolute targets).
OP9_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path,
         regexp_replace(rest, '#.*$', '') AS clean FROM parts
), ruled AS (
  SELECT page_id, host, path, clean, html,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM split
), found AS (
  SELECT clean AS a, regexp_extract(html, '(?is)<link[^>]*rel="canonical"[^>]*href="[a-z]+://([^"#]*)', 1) AS b FROM ruled
  UNION SELECT clean, regexp_extract(html, '(?is)<meta[^>]*http-equiv="refresh"[^>]*content="[^"]*url=[a-z]+://([^"#]*)', 1) FROM ruled
), edges AS (
  SELECT a, b FROM found WHERE b <> '' AND a <> '' UNION SELECT b, a FROM found WHERE b <> '' AND a <> ''
), reach(a, b) AS (
  SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), spread AS (
  SELECT a, CASE WHEN bool_or(allowed) THEN 'allow' WHEN bool_or(blocked) THEN 'block' ELSE 'allow' END AS verdict
  FROM (SELECT a, (h LIKE '%example.net' AND p LIKE '/en/%') OR (h LIKE '%.org' AND p LIKE '/fr/%') AS allowed,
               (h LIKE '%.net' AND NOT (h LIKE '%example.net' AND p LIKE '/en/%')) OR (h LIKE '%example.com' AND p LIKE '/de/%') AS blocked
        FROM (SELECT a, regexp_extract(b, '^([^/?]*)', 1) AS h, regexp_extract(b, '^[^/?]*([^?]*)', 1) AS p FROM reach)) GROUP BY a
)
SELECT page_id, host, path, rule,
       coalesce(CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END, spread.verdict, 'allow') AS verdict
FROM ruled LEFT JOIN spread ON spread.a = ruled.clean
"""

"""URL block lists with redirect equivalence.

Pages name other addresses of themselves: canonical links and refresh redirects in their html, or edges given apart.
Addresses joined by such edges form a class (distributed connected components). A page with a fitting rule takes the
rule's verdict. Any other page is blocked if its class holds an address that a rule blocks and none that a rule
allows: an explicit allow takes precedence over block decisions that come from aliases. What nothing decides is
allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.components import connected_components
from ..operators.skew import hot_safe_join
from ..sources.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Up to so many rules are broadcast; more are met in a shuffled join.
FEW_RULES = 100_000
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*(?:\"[^\">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'>\s]+)"
TARGET = r"(?is)\burl\s*=\s*['\"]?([^\"'>\s;]+)"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query (with its ``?``) of an absolute address; empty where there is no ``://``."""
    has = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(rest) + 4, F.length(url))
    cut = lambda pattern: F.when(has, F.regexp_extract(rest, pattern, 1)).otherwise("")
    return F.translate(cut(r"^([^/?#]*)"), UPPER, LOWER), cut(r"^[^/?#]*([^?#]*)"), cut(r"^[^?#]*(\?[^#]*)")


def address(host: Column, path: Column, query: Column) -> Column:
    """An address without scheme and fragment; null without a host."""
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


def resolved(link: Column, host: Column, path: Column) -> Column:
    """An absolute form of a link found on a page of ``host`` and ``path``; dot segments stay as they are."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(F.lit("http://"), host, link))
        .when(link.startswith("?"), F.concat(F.lit("http://"), host, path, link))
        .when((link == "") | link.startswith("#"), None)
        .otherwise(F.concat(F.lit("http://"), host, F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", "")), link))
    )


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``src, dst`` between addresses: every canonical link and every refresh target of a page."""
    p = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).filter("html is not null")
    links = lambda tag, of: F.transform(F.regexp_extract_all("html", F.lit(tag), 0), lambda x: F.regexp_extract(x, of, 1))
    found = F.filter(F.concat(links(CANONICAL, HREF), links(REFRESH, TARGET)), lambda x: x != "")
    # parts are bound once per row and link (`let`): named again and again they would be cut again each time
    page = let(F.col("url"), lambda u: F.struct(*[c.alias(n) for c, n in zip(parts(u), ("host", "path", "query"), strict=True)]))
    e = p.select("url", F.explode(found).alias("link")).select(page.alias("p"), "link")
    goal = let(resolved(F.col("link"), F.col("p.host"), F.col("p.path")), lambda u: address(*parts(u)))
    e = e.select(address(F.col("p.host"), F.col("p.path"), F.col("p.query")).alias("src"), goal.alias("dst"))
    return e.filter("src is not null and dst is not null and src <> dst")


def ruled(places: DataFrame, rules: DataFrame, few: bool) -> DataFrame:
    """``places`` (distinct ``host, path``) that a rule fits, with ``rule, decision`` of the longest; allow wins ties."""
    labels = F.split("host", r"\.")
    longest = rules.agg(F.max(F.size(F.split("r_host", r"\.")))).first()[0] or 1
    first = F.greatest(F.lit(1), F.size(labels) - longest + 1)  # no rule fits a longer end of a host
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = places.withColumn("suffix", F.explode(suffixes)).join(F.broadcast(rules) if few else rules, F.col("suffix") == F.col("r_host"))
    met = met.filter(F.col("path").startswith(F.col("r_path")))
    rule = F.concat("r_host", "r_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("decision") == "allow").alias("allow"), rule.alias("rule")))
    return met.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", F.when(F.col("best.allow"), "allow").otherwise("block").alias("decision"))


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict``.

    ``rules`` has ``decision`` (allow or block), ``host``, ``path``; a rule fits its host and all subdomains if the
    address's path starts with the rule's, and the longest wins. ``edges`` adds ``src, dst`` urls, for example from a
    crawler's redirect log, to those in ``html_col``. A null url, or one without ``://``, has an empty host and path,
    fits no rule and joins no class; of a host with many labels as many of the last are looked up as the longest rule
    has, so a very long url costs no more than its own length. Repeated pages stay; an empty table gives an empty result; without rules all is
    allowed. Other columns are not read.
    """
    host, path, query = parts(F.col("url"))
    light = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    light = written(light.select("page_id", host.alias("host"), path.alias("path"), address(host, path, query).alias("address")), "url-light")
    links = page_edges(pages, url_col, html_col) if html_col else None
    if edges is not None:
        sides = []
        for side in ("src", "dst"):
            h, q, r = parts(F.col(side))
            sides.append(address(h, q, r).alias(side))
        extra = edges.select(*sides)
        links = extra if links is None else links.unionByName(extra)
    rules = rules.select("decision", F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).filter("r_host is not null and r_path is not null")
    few = rules.limit(FEW_RULES + 1).count() <= FEW_RULES
    total = light.count()

    where = light.groupBy("host", "path").agg(F.count("*").alias("n"))
    own = written(ruled(where.select("host", "path"), rules, few).join(where, ["host", "path"]), "url-ruled")
    out = hot_safe_join(light, own, ["host", "path"], "n", total)
    if links is not None:
        parts_of = written(connected_components(links), "url-classes")
        h, q, _ = parts(F.concat(F.lit("http://"), F.col("node")))
        members = parts_of.select("component", h.alias("host"), q.alias("path"))
        said = ruled(members.select("host", "path").distinct(), rules, few)
        said = members.join(said, ["host", "path"]).groupBy("component").agg(F.bool_or(F.col("decision") == "allow").alias("allowed"), F.bool_or(F.col("decision") == "block").alias("blocked"))
        size = parts_of.groupBy("component").agg(F.count("*").alias("n_nodes"))
        told = hot_safe_join(parts_of, written(said.filter("blocked and not allowed").join(size, "component"), "url-blocked"), ["component"], "n_nodes", parts_of.count(), "inner")
        counts = light.filter("address is not null").groupBy("address").agg(F.count("*").alias("n"))
        told = written(told.select(F.col("node").alias("address"), F.lit("block").alias("alias")).join(counts, "address"), "url-aliases")
        out = hot_safe_join(out, told, ["address"], "n", total)
    else:
        out = out.withColumn("alias", F.lit(None).cast("string"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("decision", "alias", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "decision string, host string, path string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


SQL = r"""
WITH RECURSIVE rules(decision, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (
  SELECT page_id, html, CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM p),
l AS (
  SELECT host, path, query, replace(unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*(?:"[^">]*\bcanonical\b|''[^''>]*\bcanonical\b|canonical\b)[^>]*>'), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''>\s]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*[''"]?([^"''>\s;]+)', 1)))), '&amp;', '&') AS link
  FROM q WHERE host <> ''),
m AS (
  SELECT host || CASE WHEN path = '' THEN '/' ELSE path END || query AS src,
    CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(link, instr(link, '://') + 3)
         WHEN starts_with(link, '//') THEN substr(link, 3) WHEN starts_with(link, '/') THEN host || link
         WHEN starts_with(link, '?') THEN host || path || link WHEN starts_with(link, '#') THEN NULL
         ELSE host || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || link END AS rest
  FROM l WHERE link <> ''),
e AS (
  SELECT src, h || CASE WHEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END || regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS dst
  FROM (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h FROM m) WHERE h <> ''),
s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r AS (SELECT a AS node, a AS other FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.other = s.a),
c AS (SELECT node, min(other) AS component FROM r GROUP BY node),
addr AS (
  SELECT page_id, host, path, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS address FROM q),
places AS (
  SELECT host, path FROM q UNION SELECT regexp_extract(node, '^([^/?#]*)', 1), regexp_extract(node, '^[^/?#]*([^?#]*)', 1) FROM c),
fit AS (
  SELECT host, path, rh || rp AS rule, decision,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, decision) AS k
  FROM places, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
own AS (SELECT host, path, rule, decision FROM fit WHERE k = 1),
said AS (
  SELECT component FROM c JOIN own ON own.host = regexp_extract(node, '^([^/?#]*)', 1) AND own.path = regexp_extract(node, '^[^/?#]*([^?#]*)', 1)
  GROUP BY component HAVING bool_or(decision = 'block') AND NOT bool_or(decision = 'allow'))
SELECT a.page_id, a.host, a.path, own.rule,
       coalesce(own.decision, CASE WHEN c.component IN (SELECT component FROM said) THEN 'block' END, 'allow') AS verdict
FROM addr a LEFT JOIN own ON own.host = a.host AND own.path = a.path LEFT JOIN c ON c.node = a.address AND a.host <> ''
"""

"""References between pages, and routes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators.routes import first_fitting
from lodestone.sources.tables import table


def links(spark, d) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def path_of(url):
    """Path of a URL without query, fragment, .html and last slash."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^https?://[^/]+", ""), r"[?#].*$", ""), r"(\.html|/)$", "")
    return F.when(path == "", "/").otherwise(path)


def unresolved_links(spark, d):
    """Links to paths that no page has."""
    known = table(spark, d, "pages").select(path_of(F.col("url")).alias("path")).distinct()
    kind = F.when(F.col("href").startswith("http"), "external").when(F.col("href").startswith("/"), "absolute").otherwise("relative")
    return links(spark, d).select("page_id", "href", kind.alias("kind"), path_of(F.col("href")).alias("path")).join(known, "path", "left_anti").groupBy("kind", "path").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def candidate_resolution(spark, d):
    """The first candidate form of each URL that is itself a URL of the table."""
    p = table(spark, d, "pages").select("page_id", "url")
    bare = F.regexp_replace("url", r"[?#].*$", "")
    forms = F.array(bare, F.concat(bare, F.lit(".html")), F.concat(bare, F.lit("/")), F.regexp_replace(bare, r"(\.html|/)$", ""))
    c = p.select("page_id", F.posexplode(forms).alias("ord", "form"))
    known = p.select(F.col("url").alias("form")).distinct()
    return c.join(known, "form", "left_semi").groupBy("page_id").agg(F.min_by("form", "ord").alias("target"), F.min("ord").alias("ord"))


def orphans(spark, d):
    """Parts and suppliers that no returned line at a discount names, and customers that no open order names."""
    li, out = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_discount > 0.05"), []
    for kind, key, rows, named in (("part", "p_partkey", "part", li.select("l_partkey")), ("supplier", "s_suppkey", "supplier", li.select("l_suppkey")), ("customer", "c_custkey", "customer", table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_custkey"))):
        used = named.toDF("key").distinct()
        out.append(table(spark, d, rows).select(F.lit(kind).alias("kind"), F.col(key).alias("key")).join(used, "key", "left_anti").select("kind", "key"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def phantom_refs(spark, d):
    """Labels whose document is not among the English ones."""
    defined = table(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    return table(spark, d, "labels").join(defined, "doc_id", "left_anti").select("doc_id", "quality", "toxic")


#: Method-like first segment and pattern, in order; {x} stands for one segment.
ROUTES = (("en", "/en/{id}"), ("fr", "/fr/{id}"), ("any", "/{lang}/{id}"), ("any", "/{name}"))


def dup_routes(spark, d):
    """The first route pattern that fits each page's path."""
    p = table(spark, d, "pages").select("page_id", path_of(F.col("url")).alias("path"))
    out = None
    for i, (_, pattern) in enumerate(ROUTES):
        regex = "^" + re.sub(r"\{\w+\}", "[^/]+", pattern) + "$"
        out = F.when(F.col("path").rlike(regex), i) if out is None else out.when(F.col("path").rlike(regex), i)
    return p.withColumn("route", out).filter("route is not null").groupBy("route").agg(F.count("*").alias("pages"), F.countDistinct("path").alias("paths"))


def page_routes(spark, d):
    """The route of each path: pages of plain http make /{lang}/number, those with a query /lang/{id}, those with a fragment their own path."""
    p = table(spark, d, "pages").select("url", path_of(F.col("url")).alias("path"))
    parts = F.split("path", "/")
    made = F.array(
        F.when(F.col("url").startswith("http:"), F.concat(F.lit("/{lang}/"), F.element_at(parts, -1))),
        F.when(F.col("url").contains("?"), F.concat(F.lit("/"), F.get(parts, F.lit(1)), F.lit("/{id}"))), F.when(F.col("url").contains("#"), F.col("path")),
    )
    get = F.lit("GET").alias("method")
    return first_fitting(p.select(get, "path"), p.select(get, F.explode(made).alias("route"))).select("path", "route")


def required_params(spark, d):
    """Pages whose URL lacks parameters that its language asks for."""
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://[^/]+/(\w+)/", 1).alias("lang"))
    need = F.when(F.col("lang") == "en", F.array(F.lit("page"), F.lit("ref"))).when(F.col("lang") == "fr", F.array(F.lit("page"))).otherwise(F.array().cast("array<string>"))
    have = text.query_names(F.col("url"))
    return p.select("page_id", F.array_join(F.array_sort(F.array_except(need, have)), ",").alias("missing")).filter("missing <> ''")


def dependency_sets(spark, d):
    """Hosts of the pages, and how many paths they have."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), path_of(F.col("url")).alias("path"))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.countDistinct("path").alias("paths"))


def casing_of_links(spark, d):
    name = F.regexp_extract("href", r"^/([A-Za-z_-]+)", 1)
    return links(spark, d).select(name.alias("name")).filter("name <> ''").groupBy(text.casing(F.col("name")).alias("style")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (unresolved_links, candidate_resolution, orphans, phantom_refs, dup_routes, page_routes, required_params, dependency_sets, casing_of_links)}


def _path(x: str) -> str:
    p = f"regexp_replace(regexp_replace(regexp_replace({x}, '^https?://[^/]+', ''), '[?#].*$', ''), '(\\.html|/)$', '')"
    return f"CASE WHEN {p} = '' THEN '/' ELSE {p} END"


_LINKS = "l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"
ORACLES = {
    "unresolved_links": f"""WITH {_LINKS}, x AS (SELECT page_id, CASE WHEN starts_with(href, 'http') THEN 'external' WHEN starts_with(href, '/') THEN 'absolute' ELSE 'relative' END AS kind, {_path('href')} AS path FROM l)
SELECT kind, path, count(*) AS n, count(DISTINCT page_id) AS pages FROM x WHERE path NOT IN (SELECT {_path('url')} FROM pages) GROUP BY 1, 2""",
    "candidate_resolution": """WITH b AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS b FROM pages),
c AS (SELECT page_id, 0 AS ord, b AS form FROM b UNION ALL SELECT page_id, 1, b || '.html' FROM b UNION ALL SELECT page_id, 2, b || '/' FROM b UNION ALL SELECT page_id, 3, regexp_replace(b, '(\\.html|/)$', '') FROM b)
SELECT page_id, arg_min(form, ord) AS target, min(ord) AS ord FROM c WHERE form IN (SELECT url FROM pages) GROUP BY page_id""",
    "orphans": """SELECT 'part' AS kind, p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05 AND l_partkey IS NOT NULL)
UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05 AND l_suppkey IS NOT NULL)
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IS NOT NULL)""",
    "phantom_refs": "SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "dup_routes": f"""WITH p AS (SELECT page_id, {_path('url')} AS path FROM pages), r AS (SELECT *, CASE WHEN regexp_full_match(path, '/en/[^/]+') THEN 0 WHEN regexp_full_match(path, '/fr/[^/]+') THEN 1
  WHEN regexp_full_match(path, '/[^/]+/[^/]+') THEN 2 WHEN regexp_full_match(path, '/[^/]+') THEN 3 END AS route FROM p) SELECT route, count(*) AS pages, count(DISTINCT path) AS paths FROM r WHERE route IS NOT NULL GROUP BY route""",
    "page_routes": f"""WITH p AS (SELECT DISTINCT url, {_path('url')} AS path FROM pages), r AS (
SELECT '/{{lang}}/' || string_split(path, '/')[-1] AS route FROM p WHERE starts_with(url, 'http:') UNION SELECT '/' || string_split(path, '/')[2] || '/{{id}}' FROM p WHERE contains(url, '?') UNION SELECT path FROM p WHERE contains(url, '#'))
SELECT path, arg_min(route, (CASE WHEN path = route THEN '0' ELSE '1' END) || route) AS route FROM (SELECT DISTINCT path FROM p) JOIN r
ON len(string_split(path, '/')) = len(string_split(route, '/')) AND regexp_full_match(path, regexp_replace(route, '\\{{[^}}]*\\}}', '[^/]+', 'g')) GROUP BY path""",
    "required_params": """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/(\\w+)/', 1) AS lang, regexp_extract_all(url, '[?&]([A-Za-z_]\\w*)=', 1) AS have FROM pages),
n AS (SELECT page_id, have, unnest(CASE lang WHEN 'en' THEN ['page', 'ref'] WHEN 'fr' THEN ['page'] ELSE [] END) AS need FROM p)
SELECT page_id, string_agg(need, ',' ORDER BY need) AS missing FROM n WHERE NOT list_contains(have, need) GROUP BY page_id""",
    "dependency_sets": f"SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages, count(DISTINCT {_path('url')}) AS paths FROM pages GROUP BY 1",
    "casing_of_links": f"""WITH {_LINKS}, n AS (SELECT regexp_extract(href, '^/([A-Za-z_-]+)', 1) AS name FROM l)
SELECT CASE WHEN regexp_full_match(name, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*') THEN 'SCREAMING_SNAKE_CASE' WHEN regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)+') THEN 'snake_case'
  WHEN regexp_full_match(name, '[a-z][a-z0-9]*(-[a-z0-9]+)+') THEN 'kebab-case' WHEN regexp_full_match(name, '[A-Z][a-zA-Z0-9]*') THEN 'PascalCase' WHEN regexp_full_match(name, '[a-z][a-zA-Z0-9]*') THEN 'camelCase' ELSE 'unknown' END AS style, count(*) AS n
FROM n WHERE name <> '' GROUP BY 1""",
}

r"""URL allow and block rules that hold for a page's aliases too (operator 7).

A rule names a host (with all its subdomains) and the beginning of a path; of
the rules that fit a page the longest decides. Pages without a rule take the
decision of their aliases: urls are joined where one redirects to the other
(``http-equiv=refresh``, or a given table) or names it as canonical, in any of
its tags, and where they differ only in scheme, fragment, dot segments or
``utm_`` parameters. Links are resolved against the page's url: a scheme counts
at their start only, entities of marks that urls hold are decoded. Connected
components of those edges are found by distributed star steps; a component
holding a blocked page blocks its pages without a rule, unless it also holds an
explicitly allowed one. All else is allowed.

Null urls and urls without ``://`` have empty host and path, fit no rule and
have no aliases. Repeated rows are judged alike. Native columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
_TRACKING = r"([?&])(?:utm_[^&]*(?:&|$))+"


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    rest = F.split(url, "://", 2)
    found = F.when(F.size(rest) == 2, F.regexp_extract(F.get(rest, F.lit(1)), "^[^/?#]*", 0))
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    rest = F.split(url, "://", 2)
    found = F.when(F.size(rest) == 2, F.regexp_extract(F.get(rest, F.lit(1)), "^[^/?#]*([^?#]*)", 1))
    return F.coalesce(found, F.lit(""))


#: Entities of the marks that urls hold; the ampersand comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"),
            ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#61;", "="), ("&#x3d;", "="), ("&#x3D;", "="), ("&#38;", "&"), ("&#x26;", "&"),
            ("&amp;", "&")]


def decoded(link: Column) -> Column:
    for entity, mark in ENTITIES:
        link = F.replace(link, F.lit(entity), F.lit(mark))
    return link


def without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are resolved; none climbs above the host."""
    parts = F.split(path, "/")
    walked = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(""), lambda done, x: F.when(x == ".", done).when(
        x == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x)))
    return F.when(F.contains(path, F.lit("/.")), F.concat(
        walked, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def alias_key(url: Column) -> Column:
    """What urls of one resource share; null without a host."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    plain = F.regexp_replace(F.regexp_replace(query, _TRACKING, "$1"), "[?&]+$", "")
    return F.when(host_of(url) != "", F.concat(host_of(url), without_dots(path_of(url)), plain))


def resolved(link: Column, base: Column) -> Column:
    """A link of a page as a full url; null for an empty one and for schemes without a host."""
    here = F.concat(F.lit("://"), host_of(base), F.when(path_of(base) == "", "/").otherwise(path_of(base)))
    return F.when(link == "", None).when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link) \
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None) \
        .when(link.startswith("//"), F.concat(F.lit(":"), link)) \
        .when(link.startswith("/"), F.concat(F.lit("://"), host_of(base), link)) \
        .when(link.startswith("#"), base).when(link.startswith("?"), F.concat(here, link)) \
        .otherwise(F.concat(F.regexp_replace(here, "[^/]*$", ""), link))


def links_of(html: Column) -> Column:
    """Targets of all canonical and refresh tags, as they stand."""
    found = lambda tag, target: F.transform(
        F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: decoded(F.regexp_extract(t, target, 1)))
    return F.filter(F.concat(found(_CANONICAL, _HREF), found(_REFRESH, _TARGET)), lambda link: link != "")


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the (verdict, host, path) rules that fits, as a struct of size, rule and verdict."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, name, start in rules:
        by_host.setdefault(name, []).append((verdict, name, start))
    pairs = []
    for name, some in by_host.items():
        pairs += [F.lit(name), F.array(*(F.struct(
            F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"),
            F.lit(p).alias("path")) for v, h, p in some))]
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(
        F.slice(labels, k, F.size(labels)), "."))
    fits = F.filter(
        F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(F.create_map(*pairs), s)),
                           lambda found: found.isNotNull())),
        lambda r: path.startswith(r.path))
    return F.array_max(fits)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages(page_id, url, html)``.

    ``redirects(source, target)`` holds further edges between urls.
    """
    url, html = F.col("url"), F.col("html")
    linked = pages.select(
        "page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), alias_key(url).alias("key"),
        links_of(html).alias("links"))
    edges = linked.select("key", F.explode("links").alias("link"), "url").select(
        F.col("key").alias("a"), alias_key(resolved(F.col("link"), F.col("url"))).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(
            alias_key(F.col("source")).alias("a"), alias_key(F.col("target")).alias("b")))
    parts = connected_components(edges).withColumnRenamed("node", "key")
    own = linked.select("page_id", "host", "path", "key", fitting_rule(F.col("host"), F.col("path"), rules).alias("r")) \
        .join(parts, "key", "left").withColumn("part", F.coalesce("component", "key"))
    said = own.where("part is not null").groupBy("part").agg(
        F.max(F.col("r.verdict") == "allow").alias("allowed"), F.max(F.col("r.verdict") == "block").alias("blocked"))
    spread = F.when(F.col("blocked") & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow")
    return own.join(said, "part", "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", spread).alias("verdict"))

"""URL filters with redirect equivalence (DataFrame operations only).

Pages that name each other by canonical links or redirects are aliases. Explicit rules judge every url that takes part;
connected components carry a block to all aliases, unless one of them is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import UPPER, keep

MOST_RULES = 10_000  # a rule list is held by every task, so its length is checked


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_SITE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def node_of(url: Column) -> Column:
    """The name by which urls that a server does not tell apart are one: no fragment, scheme and host in lower case, no
    default port, at least `/` as path. What has no `scheme://` only loses its fragment."""
    plain = F.split(url, "#").getItem(0)
    site = F.translate(F.regexp_extract(plain, _SITE, 1), UPPER, UPPER.lower())
    bare = F.when(F.startswith(site, F.lit("http://")), F.regexp_replace(site, ":(?:80)?$", "")).when(F.startswith(site, F.lit("https://")), F.regexp_replace(site, ":(?:443)?$", ""))
    rest = F.substr(plain, F.length(site) + 1)
    return F.when(site == "", plain).otherwise(F.concat(F.coalesce(bare, site), F.when(F.startswith(rest, F.lit("/")), "").otherwise("/"), rest))


def without_dots(path: Column) -> Column:
    """An absolute path without `.` and `..` segments."""
    segments = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")), F.lit(1)))
    up = lambda done: F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(done)
    fewer = lambda done: F.when(F.size(done) > 1, up(done)).otherwise(F.array().cast("array<string>"))
    done = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda d, x: F.when(x == ".", d).when(x == "..", fewer(d)).otherwise(F.concat(d, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(done, "/"), F.when((F.size(done) > 0) & F.element_at(segments, -1).isin(".", ".."), "/").otherwise(""))


def resolved(base: Column, target: Column) -> Column:
    """The url that a target names on page base (RFC 3986); null for an empty target, a fragment, a scheme without `//`, and a
    relative target of a base without `scheme://`."""
    scheme, site = F.regexp_extract(base, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)//", 1), F.regexp_extract(base, _SITE, 1)
    path = F.regexp_extract(base, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    full = (
        F.when((target == "") | F.startswith(target, F.lit("#")), None).when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (site == ""), None)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, target)).when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(F.startswith(target, F.lit("?")), F.concat(site, path, target)).otherwise(F.concat(site, folder, target))
    )
    own = F.regexp_extract(full, _SITE, 1)
    return F.concat(own, without_dots(F.regexp_extract(full, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)), F.regexp_extract(full, r"(?s)^[^?#]*(\?[^#]*)", 1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null. A rule `host/path` fits its host and all
    subdomains where the url's path starts with the rule's."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    items = [
        F.struct(F.lit(len(r)).alias("n"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("h"), F.lit("/" + r.partition("/")[2]).alias("p"))
        for v, r in rules
    ]
    fits = lambda x: ((host == x["h"]) | F.endswith(host, F.concat(F.lit("."), x["h"]))) & F.startswith(path, x["p"])
    return F.array_max(F.filter(F.array(*items), fits)) if items else F.lit(None).cast("struct<n:int,rule:string,verdict:string,h:string,p:string>")


#: What holds no tags: comments, scripts and styles.
_MUTE = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_TAGS = r"""(?is)<(?:link|meta|base)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_PARTS = r"""(?is)"[^"]*"|'[^']*'|([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def links_of(html: Column) -> Column:
    """array<struct<kind, target>> of a page's base, canonical links and meta refreshes, in order. Quoted values may hold any
    character, of an attribute named twice the first counts, and link types are words."""

    def read(tag: Column) -> Column:
        cut = lambda k: F.regexp_extract_all(tag, F.lit(_PARTS), F.lit(k))
        names = F.transform(cut(1), lambda n: F.lower(n))
        return F.struct(F.get(names, F.lit(0)).alias("tag"), names.alias("names"), cut(2).alias("values"))

    def value(tag: Column, name: str) -> Column:
        v = F.get(tag["values"], (F.array_position(tag["names"], name) - 1).cast("int"))
        bare = F.regexp_replace(F.coalesce(v, F.lit("")), r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2")
        return F.replace(bare, F.lit("&amp;"), F.lit("&"))

    def attributes(tag: Column) -> Column:
        return F.struct(tag["tag"].alias("tag"), *[value(tag, n).alias(a) for n, a in (("rel", "rel"), ("http-equiv", "equiv"), ("href", "href"), ("content", "content"))])

    def link(tag: Column) -> Column:
        canonical = (tag["tag"] == "link") & F.array_contains(F.split(F.lower(tag["rel"]), r"\s+"), "canonical")
        refresh = (tag["tag"] == "meta") & (F.lower(F.trim(tag["equiv"])) == "refresh")
        aim = F.regexp_extract(tag["content"], r"""(?is)^\s*[0-9.]*\s*[;,]?\s*(?:url\s*=\s*)?["']?([^"']*)""", 1)
        kind = F.when(tag["tag"] == "base", "base").when(canonical, "link").when(refresh, "refresh")
        return F.struct(kind.alias("kind"), F.trim(F.when(tag["tag"] == "meta", aim).otherwise(tag["href"])).alias("target"))

    tags = F.regexp_extract_all(F.regexp_replace(html, _MUTE, " "), F.lit(_TAGS), F.lit(0))
    return F.filter(F.transform(F.transform(F.transform(tags, read), attributes), link), lambda x: x["kind"].isNotNull() & (x["target"] != ""))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's url and those that its canonical links and meta refreshes name, resolved against the page's first base
    element or else its url. What stands in comments, scripts and styles is no link. Targets that name no url, and pages
    without url or html, give none."""
    tagged = pages.select(F.col(url).alias("u"), F.col(html).alias("x")).where("u IS NOT NULL AND x RLIKE '(?i)canonical|refresh'").select("u", links_of(F.col("x")).alias("ls")).where("size(ls) > 0")
    # The tables between are written: they are small, and an expression that is used again is not worked out again.
    tagged = keep(tagged)
    base = F.get(F.filter("ls", lambda x: x["kind"] == "base"), F.lit(0))["target"]
    aims = F.explode(F.array_distinct(F.transform(F.filter("ls", lambda x: x["kind"] != "base"), lambda x: x["target"])))
    aimed = keep(tagged.select("u", base.alias("base"), aims.alias("t")).distinct())
    placed = keep(aimed.select("u", "t", F.when(F.col("base").isNotNull(), resolved(F.col("u"), F.col("base"))).alias("from")))
    joined = keep(placed.select("u", resolved(F.coalesce("from", "u"), F.col("t")).alias("to")).where("to IS NOT NULL"))
    return joined.select(node_of(F.col("u")).alias("a"), node_of(F.col("to")).alias("b")).where("a <> b").distinct()


def url_filters(
    pages: DataFrame, rules: Sequence[tuple[str, str]], page_id: str = "page_id", url: str = "url", html: str = "html", extra_edges: DataFrame | None = None
) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    A page's own longest rule decides. Otherwise its aliases do: allow if any alias (a page or a mere link target) has an
    allow rule, else block if any has a block rule, else allow. Null urls and urls without `://` have empty host and
    path and are allowed; of rules with equal length the last in text order decides; repeated rows are judged alike; other
    columns are ignored; no rows give no rows; extra_edges(a, b) may add known redirects between urls.
    """
    edges = alias_edges(pages, url, html)
    if extra_edges is not None:
        edges = edges.union(extra_edges.select(node_of(F.col("a")), node_of(F.col("b"))).where("a IS NOT NULL AND b IS NOT NULL"))
    linked = components(edges, "a", "b")
    judged = linked.withColumn("v", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    of_root = keep(
        judged.groupBy("root").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
        .where("blocked AND NOT coalesce(allowed, false)").select(F.col("root").alias("r"))
    )
    blocked = keep(linked.join(of_root, F.col("root") == F.col("r"), "left_semi").select("node", F.lit(True).alias("alias_blocked")))
    base = pages.select(F.col(page_id).alias("page_id"), node_of(F.col(url)).alias("n"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    own = base.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    return own.join(blocked, F.col("n") == F.col("node"), "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", F.when(F.col("alias_blocked"), "block"), F.lit("allow")).alias("verdict"),
    )

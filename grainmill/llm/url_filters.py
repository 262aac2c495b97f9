"""URL allow and block rules whose block decisions follow redirects and canonical links.

Only DataFrame functions. A page's own rule (the longest that fits) decides. A page
without a rule is an alias of every page reachable over redirect and canonical-link
edges in either direction: if a rule allows one of them the page is allowed, else if a
rule blocks one of them it is blocked, else it is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, given_back, join_salted, let, set_apart
from .components import connected_components


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    allow: bool
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    rx = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return (
        F.coalesce(ascii_lower(F.regexp_extract(url, rx, 1)), F.lit("")),
        F.coalesce(F.regexp_extract(url, rx, 2), F.lit("")),
    )


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(length, rule, allow) of the longest rule that fits, else null."""
    fits = lambda host, path: [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.allow).alias("allow")),
        )
        for r in rules
    ]
    best = lambda u: F.array_max(F.array(*fits(u["host"], u["path"])))
    return let(F.struct(host.alias("host"), path.alias("path")), best) if rules else F.lit(None).cast("struct<length:int,rule:string,allow:boolean>")


def node_of(url: Column) -> Column:
    """Host, path (at least ``/``) and query: what two spellings of one address share. Null without ``://``."""

    def joined(u: Column) -> Column:
        path = F.when(u["path"] == "", F.lit("/")).otherwise(u["path"])
        return F.concat(u["host"], path, u["query"])

    def parts(u: Column) -> Column:
        host, path = split_url(u)
        return F.struct(host.alias("host"), path.alias("path"), F.regexp_extract(u, r"(?s)^[^?#]*(\?[^#]*)", 1).alias("query"))

    return F.when(url.contains("://"), let(let(url, parts), joined))


def resolve(base: Column, href: Column) -> Column:
    """An absolute url for the link ``href`` on the page ``base``."""

    def against(u: Column) -> Column:
        base, href = u["base"], u["href"]
        root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
        folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
        return (
            F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*://"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), href))
            .when(href.startswith("/"), F.concat(root, href))
            .when(href.rlike("^[?#]"), F.concat(F.regexp_extract(base, "(?s)^([^?#]*)", 1), href))
            .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))
        )

    return let(F.struct(base.alias("base"), href.alias("href")), against)


def _link_target(tag: Column) -> Column:
    """What a canonical link or meta refresh tag names; empty for other tags."""

    def attribute(name: str) -> Column:
        rx = rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
        return let(F.regexp_extract_all(tag, F.lit(f"({rx})"), 1), lambda a: F.regexp_replace(F.regexp_replace(F.get(a, 0), r"(?s)^[^=]*=\s*", ""), "^[\"']|[\"']$", ""))

    return F.when(
        tag.rlike("(?i)^<link") & F.lower(attribute("rel")).rlike(r"(^|\s)canonical(\s|$)"), attribute("href")
    ).when(
        tag.rlike("(?i)^<meta") & (F.lower(attribute("http-equiv")) == "refresh"),
        F.regexp_extract(attribute("content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1),
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes of a page and of what its canonical link or meta refresh names."""
    some = pages.where(F.col(html).rlike("(?i)canonical|refresh") & F.col(url).contains("://"))
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)
    targets = F.filter(F.transform(tags, lambda t: F.trim(_link_target(t))), lambda h: h != "")
    links = some.select(F.col(url).alias("_base"), F.explode(targets).alias("_href"))
    return links.select(node_of(F.col("_base")).alias("a"), node_of(resolve(F.col("_base"), F.col("_href"))).alias("b")).where("b is not null")


def judge(
    pages: DataFrame, rules: list[Rule], url: str = "url", html: str | None = "html", redirects: DataFrame | None = None
) -> DataFrame:
    """``pages`` with url_host, url_path, url_rule (null: none fits), url_verdict.

    ``rules`` is configuration, held in the plan. ``redirects`` (from_url, to_url) adds
    edges to those found in ``html``. A null url, or one without ``://``, has an empty
    host and path, fits no rule, has no aliases, and is allowed. An address without a path
    is an alias of its host's ``/``, so rules for that reach it, though none of its own
    fits. Repeated pages are judged alike. No pages, no rows. Other columns pass through,
    whatever their names; columns of these four names are replaced.
    """
    own = ("url_host", "url_path", "url_rule", "url_verdict")
    edges = [link_edges(pages, url, html)] if html else []
    if redirects is not None:
        edges.append(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    apart, names = set_apart(pages)
    address = F.col(names[url])
    host, path = split_url(address)
    judged = apart.select("*", host.alias("host"), path.alias("path")).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    if edges:
        all_edges = edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1])
        # pages without an address have keys of their own, so that no key gathers them
        node = F.coalesce(node_of(address), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
        judged = judged.withColumn("node", node)
        # how many pages each alias is, as one address may be a large part of all pages
        crawled = apart.select(node_of(address).alias("node")).where("node is not null").groupBy("node").agg(F.count("*").alias("n"))
        aliases = cut(_alias_verdicts(all_edges, rules).join(crawled, "node"))
        judged = join_salted(judged, aliases, ["node"], "n", "left")
    else:
        judged = judged.withColumn("alias", F.lit(None).cast("boolean"))
    allow = F.coalesce(F.col("best.allow"), F.col("alias"), F.lit(True))
    return judged.select(
        *given_back(names, own), F.col("host").alias("url_host"), F.col("path").alias("url_path"), F.col("best.rule").alias("url_rule"),
        F.when(allow, "allow").otherwise("block").alias("url_verdict"),
    )


def _alias_verdicts(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """(node, alias): true if a rule allows a member of the node's component, else false if one blocks a member."""
    nodes = connected_components(edges)
    host = F.regexp_extract("node", "(?s)^([^/?]*)", 1)
    path = F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1)
    ruled = nodes.withColumn("allow", best_rule(host, path, rules)["allow"])
    verdict = cut(ruled.groupBy("component").agg(F.max("allow").alias("alias"), F.count("*").alias("n")).where("alias is not null"))
    return join_salted(nodes, verdict, ["component"], "n").select("node", "alias")

"""Operator 6: URL filters with redirect equivalence.

Rules name a host, with its subdomains, and the start of a path; the longest that fits decides.  Pages whose addresses are equivalent form classes:
connected components of a graph whose nodes are addresses and whose edges are redirects (http-equiv refresh, or a crawl's log), canonical links, and the
redirects that sites make by themselves: from an address to the one without www., port, trailing slash, index page and parameters of campaigns.  Scheme
and fragment aren't part of an address.  A page without a rule is blocked if a page or an address of its class is blocked by a rule; a page
that a rule allows stays allowed whatever its class.

Defined cases: a null url or one without :// has an empty host and path, no rule and no class, and is allowed; a null html has no links; repeated rows
get the same verdict; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import held, join_hot, table
from roadloom.llm.graph import components

# Fixed values: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that name the campaign that a visitor comes from.
TRACKING = r"(?i)(^|&)(utm_[a-z]*|fbclid|gclid)=[^&]*"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null; the rules are a short list of settings."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def address(url: Column) -> Column:
    """What a url asks for, as it stands: host, path and parameters; null without a host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)))


def settled(url: Column) -> Column:
    """The address that a site redirects a url to by itself."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/index\\.(html?|php)$", "/"), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), TRACKING, ""), "^&", "")
    return F.when(host_of(url) != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _node(text: Column) -> Column:
    return F.xxhash64(text)


def resolved(link: Column, base: Column) -> Column:
    """A link's url, taken from the page at base."""
    scheme, host = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    link = F.trim(link)
    return (
        F.when(link == "", None).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link)).when(link.startswith("?"), F.concat(root, path_of(base), link))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_replace(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1), "^[\"']|[\"']$", "")


def links_of(html: Column) -> Column:
    """Targets of a page's canonical links and refresh redirects."""
    canonical = F.transform(F.regexp_extract_all(html, F.lit(r"""(?is)<link\s[^>]*rel\s*=\s*["']?canonical["']?[^>]*>"""), F.lit(0)), lambda t: _attribute(t, "href"))
    refresh = F.transform(
        F.regexp_extract_all(html, F.lit(r"""(?is)<meta\s[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*>"""), F.lit(0)),
        lambda t: F.regexp_replace(F.regexp_extract(_attribute(t, "content"), r"(?is)url\s*=\s*(.*)$", 1), "^[\"']|[\"']$", ""),
    )
    return F.when(html.rlike("(?i)canonical|refresh"), F.concat(canonical, refresh)).otherwise(F.array().cast("array<string>"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, blocked_alias.  redirects: more edges (source, target) between urls, of a crawl's log."""
    host, path, url = host_of(F.col("url")), path_of(F.col("url")), F.col("url")
    own = pages.select("page_id", host.alias("host"), path.alias("path"), _node(address(url)).alias("node"), address(url).isNotNull().alias("known"), "url", links_of(F.col("html")).alias("links"))
    own = held(own.withColumn("own", rule_for(F.col("host"), F.col("path"), rules)))
    targets = own.where("known").select("node", F.explode("links").alias("link"), "url").select("node", resolved(F.col("link"), url).alias("to"))
    if redirects is not None:
        targets = targets.union(redirects.select(_node(address(F.col("source"))), F.col("target")))
    targets = held(targets.where(address(F.col("to")).isNotNull()).withColumn("other", _node(address(F.col("to")))).distinct())
    # edges: links, and from every address to the one that its site settles on
    by_site = own.where("known").select("node", "url").union(targets.select("other", "to")).select(F.col("node").alias("a"), _node(settled(url)).alias("b"))
    edges = targets.select(F.col("node").alias("a"), F.col("other").alias("b")).union(by_site)
    if redirects is not None:
        edges = edges.union(redirects.where(address(F.col("source")).isNotNull()).select(_node(address(F.col("source"))), _node(settled(F.col("source")))))
    roots = held(components(edges))
    by_target = rule_for(host_of(F.col("to")), path_of(F.col("to")), rules)["verdict"] == "block"
    blocked = own.where("known and own.verdict = 'block'").select("node").union(targets.where(by_target).select(F.col("other").alias("node"))).distinct()
    blocked = blocked.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct().withColumn("blocked_alias", F.lit(True))
    classes = join_hot(own.drop("links", "url"), roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    out = join_hot(classes, blocked, ["root"], "left").withColumn("blocked_alias", F.coalesce("blocked_alias", F.lit(False)) & F.col("known"))
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("blocked_alias"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "blocked_alias")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))

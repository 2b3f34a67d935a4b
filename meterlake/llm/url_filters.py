"""URL block rules whose decisions follow redirects and canonical links.

Two pages that redirect to each other or name the same canonical address are one resource under several names. Names are
nodes, redirect and canonical links are edges, and every connected component shares one decision: allowed if any member
is allowed by a rule, else blocked if any member is blocked by a rule, else allowed. A url that a rule fits itself
keeps that rule's verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.components import connected_components

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Name of a resource: host, path and query, without scheme and fragment; null where there is no host."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null. Rules of one length: block first, then by name."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + prefix).alias("rule"))).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    bare = F.regexp_replace(value, rf"""(?is)^[\s"']{name}\s*=\s*""", "")
    return F.replace(F.trim(F.regexp_replace(bare, r"""^["']|["']$""", "")), F.lit("&amp;"), F.lit("&"))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) node names: each page to the targets of its canonical links and meta refreshes.

    Relative targets are resolved against the page: ``//host``, ``/path``, ``?query`` and ``name`` forms. Empty targets,
    pages without a host and links to the page itself give no edge.
    """
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"(?is)^<link\b") & F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)")), lambda t: _attribute(t, "href"))
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?is)^<meta\b") & (F.lower(_attribute(t, "http-equiv")) == "refresh")),
        lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)url\s*=\s*["']?([^"']*)""", 1),
    )
    linked = pages.where(F.col(html).rlike(r"(?i)canonical|refresh")).select(F.col(url).alias("_url"), F.explode(F.concat(canonical, refresh)).alias("_to"))
    at, to = F.col("_url"), F.trim("_to")
    scheme = F.regexp_extract(at, r"(?s)^(.*?://)", 1)
    base = F.concat(scheme, F.regexp_extract(at, r"(?s)^.*?://([^/?#]*)", 1))
    folder = F.regexp_extract(path_of(at), r"(?s)^(.*/)", 1)
    absolute = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), to))
        .when(to.startswith("/"), F.concat(base, to))
        .when(to.startswith("?"), F.concat(base, path_of(at), to))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), to))
    )
    return linked.where(to != "").select(node_of(at).alias("src"), node_of(absolute).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``.

    ``redirects`` adds (src, dst) url pairs, such as a crawler's redirect log, to the links found in ``html``.
    Null and malformed urls have an empty host and path and fit no rule: allow. Repeated rows are judged alike, an empty
    table gives none, other columns are ignored.
    """
    judged = pages.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), node_of(F.col(url)).alias("_node"))
    judged = judged.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    edges = link_edges(pages, url, html) if html else None
    if redirects is not None:
        logged = redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        edges = logged if edges is None else edges.unionByName(logged)
    decided = F.lit(None).cast("string")
    if edges is not None:
        members = connected_components(edges)
        own = fitting_rule(F.regexp_extract("node", r"^([^/?]*)", 1), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1), rules).getField("verdict")
        # of the two verdicts min() prefers allow
        shared = members.withColumn("_own", own).groupBy("component").agg(F.min("_own").alias("_shared")).where("_shared IS NOT NULL")
        by_node = members.join(shared, "component").select(F.col("node").alias("_node"), "_shared")
        judged, decided = judged.join(by_node, "_node", "left"), F.col("_shared")
    return judged.select(key, "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), decided, F.lit("allow")).alias("verdict"))

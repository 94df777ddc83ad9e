"""URL rules with redirect equivalence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.llm.common import components
from civicmill.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host, all its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def lower_host(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_host(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """Identity of a resource: host, path and query. Scheme and fragment name no other resource. Null without ``://``."""
    return F.when(url.contains("://"), F.concat(url_host(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits; null if none does."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, rule.name).otherwise(chosen)
    return chosen


def rule_verdict(name: Column, rules: Sequence[Rule]) -> Column:
    return F.when(name.isin([r.name for r in rules if r.verdict == "block"]), "block").when(name.isNotNull(), "allow")


def resolved(links: DataFrame) -> DataFrame:
    """(src, url): the ``href`` seen from a page with ``scheme``, ``host`` and ``path``, as an absolute URL or null."""
    href = F.col("href")
    root = F.concat(F.col("scheme"), F.lit("://"), F.col("host"))
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_replace("path", r"[^/]*$", ""), F.lit("")), F.lit("/")))
    absolute = (
        F.when(href.isNull() | (href == "") | href.startswith("#"), None)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("//"), F.concat(F.col("scheme"), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, F.col("path"), href))
        .otherwise(F.concat(folder, href))
    )
    return links.select("src", absolute.alias("url"))


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    value = F.regexp_replace(F.trim(found), rf"(?is)^{name}\s*=\s*[\"']?|[\"']$", "")
    return F.trim(F.replace(value, F.lit("&amp;"), F.lit("&")))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) resources that a page declares to be the same: its canonical link and its refresh redirect.

    Comments are not markup and are ignored; of several tags of a kind the first counts. Only links to another
    absolute or relative web address are edges.
    """
    body = F.when(F.col(html).rlike(r"(?i)canonical|http-equiv"), F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", ""))
    canonical = F.regexp_extract(body, r"(?is)<link\b[^>]*\srel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    refresh = F.regexp_extract(body, r"(?is)<meta\b[^>]*\shttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    seen = F.col(url)
    tags = pages.filter(body.isNotNull() & seen.contains("://")).select(seen.alias("seen"), canonical.alias("canonical"), refresh.alias("refresh"))
    content = tags.select("seen", _attribute(F.col("canonical"), "href").alias("canonical"), _attribute(F.col("refresh"), "content").alias("refresh"))
    target = F.regexp_replace(F.regexp_extract("refresh", r"(?is)^[\d.\s]*[;,]\s*(?:url\s*=\s*)?(.*)$", 1), r"^[\"']|[\"']$", "")
    parts = (url_node(F.col("seen")).alias("src"), F.regexp_extract("seen", r"(?s)^(.*?)://", 1).alias("scheme"), url_host(F.col("seen")).alias("host"), url_path(F.col("seen")).alias("path"))
    links = resolved(content.select(*parts, F.explode(F.array("canonical", target)).alias("href")))
    return links.select("src", url_node(F.col("url")).alias("dst")).filter("src is not null and dst is not null and src <> dst")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, url: str = "url", html: str = "html", row_id: str = "page_id") -> DataFrame:
    """Every row's host, path, longest fitting rule, verdict and the reason for it.

    A rule that fits the row's own url decides, so an explicit allow stands even among blocked aliases. Else the row
    is blocked if a url of its equivalence class is blocked by rule, else allowed. Classes are the connected
    components over canonical links, refresh redirects and the given ``redirects`` (src, dst urls), whether or not
    the other urls have rows. Only classes with a blocked member meet the rows, by resource; rows that are not
    linked take no part in any shuffle of links.

    A null url, or one without ``://``, has empty host and path, no rule and no aliases: allowed. Null html declares
    nothing. Repeated rows are judged alike and all returned; an empty table gives none. Other columns are ignored.
    """
    seen = F.col(url)
    links = alias_edges(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select(url_node(F.col("src")).alias("src"), url_node(F.col("dst")).alias("dst")).filter("src is not null and dst is not null"))
    classes = cut_lineage(components(links))
    on_host = F.regexp_extract(F.col("node"), r"(?s)^([^/?]*)", 1)
    on_path = F.regexp_extract(F.col("node"), r"(?s)^[^/?]*([^?]*)", 1)
    blocked = classes.filter(rule_verdict(matched_rule(on_host, on_path, rules), rules) == "block").select("component").distinct()
    tainted = classes.join(blocked, "component").select("node", F.lit(True).alias("_tainted"))
    judged = pages.select(F.col(row_id).alias("page_id"), url_host(seen).alias("host"), url_path(seen).alias("path"), url_node(seen).alias("node"))
    judged = judged.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    decided = judged.filter("rule is not null").withColumn("_tainted", F.lit(None).cast("boolean"))
    # a row without an alias would be allowed whatever the join says, so a null node may simply miss it
    open_rows = judged.filter("rule is null").join(tainted, "node", "left")
    rows = decided.unionByName(open_rows)
    return rows.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(F.col("rule").isNotNull(), rule_verdict(F.col("rule"), rules)).when(F.col("_tainted"), "block").otherwise("allow").alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("_tainted"), "alias").otherwise("default").alias("reason"),
    )

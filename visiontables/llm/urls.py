"""URL filters with redirect equivalence, in DataFrame operations only.

Host and path rules judge a URL by itself. Pages also name other addresses of theirs: a canonical link or a refresh to
another place. URLs tied by such edges are one site in disguise; connected components over the edges carry a block from any
of them to all, unless one of them is explicitly allowed. The scheme, a fragment and tracking parameters do not make another
address.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiontables.llm.components import components
from visiontables.operators.stages import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path); a host rule covers its subdomains, a path rule what its path begins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query without utm_ parameters, no scheme and no fragment; NULL where there is no ://."""
    asked = F.split(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*[^?#]*\?([^#]*)", 1), "&")
    query = F.array_join(F.filter(asked, lambda part: (part != "") & ~F.startswith(part, F.lit("utm_"))), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES, verdict: bool = False) -> Column:
    """The longest rule that fits (or its verdict), or NULL. The rules are configuration and stand in the plan."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return F.coalesce(*[F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.lit(v if verdict else h + p)) for v, h, p in ordered])


def _attribute(tag: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), F.lit("\"'"))


def resolved(target: Column, page: Column) -> Column:
    """The URL that a link of ``page`` leads to; NULL for the page itself and for what is no place (mailto: and the like).

    Links may leave out the scheme, the host or the folder, and may climb by dots; an absolute one is taken as it is.
    """
    origin = F.regexp_extract(page, r"(?s)\A(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(page), r"(?s)\A(.*/)", 1)
    path, rest = F.regexp_extract(target, r"\A([^?#]*)", 1), F.regexp_extract(target, r"(?s)\A[^?#]*(.*)", 1)
    whole = F.when(F.startswith(target, F.lit("/")), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    parts = F.split(whole, "/", -1)
    climbed = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), lambda at, part: F.when(part == "..", F.regexp_replace(at, r"/[^/]*\z", "")).when(part == ".", at).otherwise(F.concat(at, F.lit("/"), part)))
    full = F.concat(climbed, F.when(whole.rlike(r"(\A|/)\.\.?\z"), "/").otherwise(""))
    return (F.when((target == "") | F.startswith(target, F.lit("#")), None)
            .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(F.startswith(target, F.lit("//")), F.concat(F.lit("x:"), target))
            .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(F.startswith(target, F.lit("?")), F.concat(origin, path_of(page), target))
            .otherwise(F.concat(origin, full, rest)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): the address of each page and each address that its canonical links or refreshes lead to."""
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    named = pages.where(F.col("html").rlike(r"(?i)canonical|refresh")).select("url", address_of(F.col("url")).alias("a"), F.explode(tags).alias("tag"))
    link = F.when(F.lower(_attribute(F.col("tag"), "rel")).rlike(r"(^|\s)canonical(\s|$)"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?i)url\s*=\s*['\"]?([^'\"\s;]+)", 1))
    target = F.trim(F.regexp_replace(F.coalesce(link, refresh), "&amp;", "&"))
    return named.select("a", address_of(resolved(target, F.col("url"))).alias("b")).where("a <> '' and b <> '' and a <> b").distinct()


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, address, alias_of (smallest address of its component, if any), one row per page.

    A fitting rule decides. Otherwise a page is blocked if an address of its component, crawled or only named, fits a block
    rule and none fits an allow rule. ``redirects`` (from_url, to_url) adds edges. NULL or odd URLs have an empty host and
    path, no address and are allowed; NULL page_ids and repeated rows come back as they are; NULL html names nothing; no
    rows give no rows. Other columns are not read.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        more = redirects.select(address_of(F.col("from_url")).alias("a"), address_of(F.col("to_url")).alias("b")).where("a <> '' and b <> '' and a <> b")
        edges = edges.unionAll(more)
    members = materialize(components(edges), "aliases")
    own = F.concat(F.lit("x://"), F.col("node"))
    parts = members.select("root", host_of(own).alias("host"), path_of(own).alias("path"))
    sites = (parts.select("root", rule_of(F.col("host"), F.col("path"), rules, verdict=True).alias("_v")).groupBy("root")
             .agg(F.max(F.col("_v") == "block").alias("_blocked"), F.max(F.col("_v") == "allow").alias("_allowed")))
    decided = materialize(members.join(sites, "root").select(
        F.col("node").alias("_node"), F.col("root").alias("alias_of"), (F.coalesce("_blocked", F.lit(False)) & ~F.coalesce("_allowed", F.lit(False))).alias("_block")), "decided")
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address"))
    host, path = F.col("host"), F.col("path")
    return judged.join(decided, F.col("address") == F.col("_node"), "left").select(
        "page_id", "host", "path", rule_of(host, path, rules).alias("rule"),
        F.coalesce(rule_of(host, path, rules, verdict=True), F.when(F.col("_block"), F.lit("block")), F.lit("allow")).alias("verdict"), "address", "alias_of")

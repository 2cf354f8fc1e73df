"""URL filtering with redirect equivalence.

Explicit rules (host, path prefix) judge each URL; the longest fitting rule wins. Redirects and
canonical links make URLs aliases of each other: connected components over those edges carry a block
to every alias that no rule judges itself. Allow has precedence: a URL's own allow rule always
stands, and in a component that holds an explicitly allowed URL no block is carried on. URLs that
neither a rule nor an alias judges are allowed.

Edges come from the pages (<link rel=canonical>, <meta http-equiv=refresh>) and from an optional
table of redirects; neither a fragment nor the case of scheme and host makes another URL. Targets that are no pages count as aliases
too, and their rules are carried on as well.

Defined cases: null or scheme-less URLs have an empty host and path, fit no rule, link to nothing and
are allowed; null html has no edges; repeated pages are judged alike; empty tables give empty results.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, scratch, stage
from .graph import connected_components

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null; of equally long ones an allow.
    Rules are a driver-side parameter: their number never grows with the data."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, without quotes; empty if it has none."""
    value = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): each page's URL and the target, made absolute, of each of its canonical links and refresh
    redirects. What points into the page itself is no edge."""
    url, html, t = F.col(url_col), F.col(html_col), F.col("t")
    some = pages.where(url.contains("://") & html.rlike("(?i)canonical|refresh"))
    tags = some.select(url.alias("a"), F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("t"))
    canonical = t.rlike("(?i)^<link") & _attribute(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    refresh = t.rlike("(?i)^<meta") & _attribute(t, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")
    after = F.regexp_extract(_attribute(t, "content"), r"""(?is)\burl\s*=\s*["']?([^"'>\s]+)""", 1)
    to = F.when(canonical, _attribute(t, "href")).when(refresh, after)
    raw = tags.select("a", F.trim(F.replace(to, F.lit("&amp;"), F.lit("&"))).alias("to")).where("to != '' AND NOT startswith(to, '#')")
    a, to = F.col("a"), F.col("to")
    part = lambda pattern: F.regexp_extract(a, f"(?s)^({pattern})", 1)
    folder = part(r".*?://[^/?#]*(?:/[^?#]*/|/)?")
    target = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(part(".*?:"), to))
        .when(to.startswith("/"), F.concat(part(".*?://[^/?#]*"), to))
        .when(to.startswith("?"), F.concat(part("[^?#]*"), to))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), to))
    )
    return raw.select(node_of(a).alias("a"), node_of(target).alias("b"))


def node_of(url: Column) -> Column:
    """The URL without its fragment, scheme and host in lower case."""
    bare = F.substring_index(url, "#", 1)
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    return F.concat(_lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, propagated (the verdict came from an alias).
    redirects: (src, dst) URLs, optional."""
    edges = page_edges(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        more = redirects.where(F.col("src").contains("://") & F.col("dst").contains("://")).select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b"))
        edges = more if edges is None else edges.unionByName(more)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        "id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    base = base.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    if edges is None:
        carried = base.withColumn("blocked", F.lit(False))
    else:
        with scratch(pages.sparkSession) as keep:
            members = stage(connected_components(stage(edges, "aliases")), "members")
            verdict = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
            bad = (
                members.groupBy("component")
                .agg(F.max(verdict == "block").alias("block"), F.max(verdict == "allow").alias("allow"))
                .where(F.col("block") & ~F.coalesce("allow", F.lit(False)))
            )
            bad = stage(bad.select("component"), "components")
            bad = keep(stage(members.join(bad, "component").select("node", F.lit(True).alias("bad")), "blocked"))
        if bad.isEmpty():
            carried = base.withColumn("blocked", F.lit(False))
        else:
            # only pages with a blocked alias are shuffled, and of those no more than share its URL
            carried = attach(base.withColumn("node", node_of(F.col("url"))), bad, "node").withColumn("blocked", F.coalesce("bad", F.lit(False)))
    own = F.col("hit.verdict")
    return carried.select(
        "id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(own, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        (own.isNull() & F.col("blocked")).alias("propagated"),
    )

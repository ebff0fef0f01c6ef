"""URL filters with redirect equivalence.

Rules are (verdict, host, path): a rule fits its host and all subdomains where the url's path starts
with the rule's; the longest (host and path together, then the longer host) wins. Urls that no rule
fits take the block of any url they are equivalent to: redirect and canonical-link edges are united
by distributed connected components. An explicit allow always has precedence: a url that an allow
rule fits stays allowed whatever its aliases are; only blocks travel.

Edges: every ``<link>`` whose ``rel`` holds the word ``canonical`` and every ``<meta http-equiv=refresh>`` of
a page outside comments and scripts, and rows of an optional redirect table. Links are resolved against
the page's first ``<base href>``, itself resolved against the page's url; a link that is a query alone keeps
the path. Character references are decoded once (all numeric ones, and the named ones of ``NAMED``),
``.`` and ``..`` segments resolved. Two urls are one node if they differ in scheme, host case or fragment only.

Null urls and urls without ``://`` have an empty host and path, fit no rule and have no aliases, so
they are allowed; each is a join key of its own, so many of them never meet in one task. Repeated rows
are judged alike. No pages give no rows. Other columns are not read. DataFrame expressions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import shared
from quire.llm.components import connected_components

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The url without scheme and fragment; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), rest))


def resolve(url: Column, link: Column) -> Column:
    """A link of a page as an absolute url; null for one that leads nowhere else or has no host."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .otherwise(F.concat(site, folder, link))
    )


#: Named character references that stand for what urls are made of.
NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "sol": "/", "colon": ":", "quest": "?", "num": "#", "equals": "=", "period": ".", "comma": ",", "lowbar": "_", "percnt": "%", "plus": "+", "semi": ";", "excl": "!", "commat": "@"}
REFERENCE = rf"&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{'|'.join(NAMED)});"


def decoded(link: Column) -> Column:
    """The link with character references decoded, each once; numbers that are no character stay as they are."""
    name = lambda x: F.substring_index(F.substring_index(x, ";", 1), "&", -1)
    number = lambda x: F.when(F.lower(x).startswith("&#x"), F.conv(F.substr(name(x), F.lit(3)), 16, 10)).otherwise(F.substr(name(x), F.lit(2))).cast("long")
    valid = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    char = lambda x: F.when(valid(number(x)), F.decode(F.unhex(F.lpad(F.hex(number(x)), 8, "0")), "UTF-32")).otherwise(x)
    table = F.create_map(*[F.lit(v) for pair in NAMED.items() for v in pair])
    one = lambda x: F.when(x.startswith("&#"), char(x)).otherwise(F.try_element_at(table, name(x)))
    found = F.transform(F.regexp_extract_all(link, F.lit(REFERENCE), F.lit(0)), one)
    parts = F.split(link, REFERENCE, -1)
    joined = F.array_join(F.zip_with(parts, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(link, F.lit("&")), joined).otherwise(link)


def dotless(url: Column) -> Column:
    """An absolute url with ``.`` and ``..`` segments of its path resolved; above the top there is the top."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    tail = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1)
    parts = F.split(F.substr(path_of(url), F.lit(2)), "/")
    inner = F.slice(parts, 1, F.size(parts) - 1)
    last = F.element_at(parts, -1)
    none = F.lit(None).cast("array<string>")
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    dots = last.isin(".", "..")
    done = F.aggregate(F.concat(inner, F.when(dots, F.array(last)).otherwise(F.array())), F.coalesce(none, F.array().cast("array<string>")), step)
    path = F.array_join(F.concat(done, F.array(F.when(dots, "").otherwise(last))), "/")
    return F.when(path_of(url).rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(head, F.lit("/"), path, tail)).otherwise(url)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) nodes of all canonical links and refresh redirects in the pages' html."""
    url = F.col(url_col)
    rows = pages.where(url.isNotNull() & F.col(html_col).rlike(r"(?i)<(?:link|meta)\b")).select(url.alias("u"), F.regexp_replace(html_col, r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)", "").alias("x"))
    tags = lambda name: F.regexp_extract_all(F.col("x"), F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))
    attribute = lambda tag, name: F.concat_ws("", *[F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*{value}", 1) for value in (r'"([^"]*)', r"'([^']*)", r"([^\"'\s>][^\s>]*)")])
    canonical = F.filter(tags("link"), lambda x: F.array_contains(F.split(F.lower(attribute(x, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(tags("meta"), lambda x: F.lower(F.btrim(attribute(x, "http-equiv"))) == "refresh")
    to = lambda x: F.regexp_extract(x, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1)
    links = F.filter(F.concat(F.transform(canonical, lambda x: F.btrim(attribute(x, "href"))), F.transform(refresh, to)), lambda x: x != "")
    bases = F.filter(F.transform(tags("base"), lambda x: F.btrim(attribute(x, "href"))), lambda x: x != "")
    found = rows.select("u", F.get(bases, F.lit(0)).alias("b"), links.alias("ls")).where(F.size("ls") > 0).select("u", "b", F.explode("ls").alias("l"))
    found = found.select("u", decoded(F.col("b")).alias("b"), decoded(F.col("l")).alias("l"))
    found = found.select("u", F.coalesce(resolve(F.col("u"), F.col("b")), F.col("u")).alias("b"), "l")
    found = found.select("u", resolve(F.col("b"), F.col("l")).alias("l")).select("u", dotless(F.col("l")).alias("l"))
    # written, as a filter above would take all these expressions down into one
    return shared.cut(found.select(node_of(F.col("u")).alias("src"), node_of(F.col("l")).alias("dst")), "page-links")


def ruled(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, ruling) of those distinct (host, path) that some rule fits.

    Every suffix of a host at a dot meets the rules of that host: an equi-join for any number of rules.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = nodes.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("h"))
    fit = each.join(rules, "h").where(F.expr("startswith(path, p)"))
    best = F.max(F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("m"), F.concat("h", "p").alias("rule"), "ruling"))
    return fit.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.ruling")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, host, path, rule, verdict, component (the smallest equivalent node, null if alone).

    ``rules``: triples, or a table (ruling, h, p); ``redirects``: urls (src, dst).
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        table = F.inline(F.array(*[F.struct(F.lit(v).alias("ruling"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules]))
        rules = spark.range(1).select(table)
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst"))))
    alias = shared.cut(connected_components(edges), "aliases")
    # a url without a node gets a key that no node has, its row's own
    lone = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    rows = pages.select(id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.coalesce(node_of(F.col(url_col)), lone).alias("node"))
    # a node is a host and what follows it, so it parses as a url with an empty scheme
    known = alias.select("component", host_of(F.concat(F.lit("://"), "node")).alias("host"), path_of(F.concat(F.lit("://"), "node")).alias("path"))
    blocked = known.join(ruled(known, rules), ["host", "path"]).where("ruling = 'block'").select(F.col("component").alias("c")).distinct()
    out = rows.join(ruled(rows, rules), ["host", "path"], "left").join(alias, "node", "left")
    out = out.join(blocked, out["component"] == blocked["c"], "left")
    verdict = F.coalesce("ruling", F.when(F.col("c").isNotNull(), "block"), F.lit("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "component")

"""URL filters with redirect equivalence.

Rules allow or block a host with its subdomains and a path prefix; the longest
fitting rule decides a page's own verdict. Pages are also nodes of a graph of
redirects and canonical links; connected components are aliases of each other.
A page without a rule of its own is allowed if a rule allows one of its aliases
(an explicit allow precedes), else blocked if a rule blocks one, else gets the
default.

Targets are resolved against the page's url (or its base tag) and only absolute
ones are edges; urls that differ in the case of scheme or host, dot segments, an
empty path or a fragment are one node.

Edge cases: a null url, or one without ://, has empty host and path and no
rule, and relative targets mean nothing there; null html has no links; pages of
equal urls are one node; edges to urls that are no page still connect; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import _graph
from .positional_index import LOWER, UPPER

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, by its characters; null without one."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once and the expression not repeated."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _entities(text: Column) -> Column:
    """Character references (numbers and the five of XML) decoded once."""
    named = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}

    def one(x):
        low = F.lower(x)
        code = F.coalesce(F.conv(F.regexp_extract(low, r"^&#x([0-9a-f]{1,6});$", 1), 16, 10), F.regexp_extract(low, r"^&#([0-9]{1,7});$", 1)).cast("long")
        number = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        out = F.when(low.startswith("&#"), number)
        for k, v in named.items():
            out = out.when(low == k, F.lit(v))
        return F.coalesce(out, x)

    parts = F.regexp_extract_all(text, F.lit(r"(?is)[^&]+|&(?:#x[0-9a-f]{1,6}|#[0-9]{1,7}|amp|lt|gt|quot|apos);|&"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


_ROOT = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def _undotted(path: Column) -> Column:
    """An absolute path without its segments . and .. (RFC 3986, 5.2.4)."""
    parts = F.split(F.substr(path, F.lit(2)), "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def node_url(url: Column) -> Column:
    """The form in which equal urls meet: scheme and host lowered, no dot segments, / for an empty path, no fragment; a text without scheme:// as it is."""

    def form(u):
        place = _let(F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), lambda p: F.when(p == "", F.lit("/")).otherwise(_undotted(p)))
        whole = F.concat(F.translate(F.regexp_extract(u, _ROOT, 1), UPPER, LOWER), place, F.regexp_extract(u, r"(?s)^[^?#]*(\?[^#]*)", 1))
        return F.when(u.rlike(_ROOT), whole).otherwise(u)

    return _let(url, form)


def resolve(href: Column, base: Column) -> Column:
    """The absolute url that `href` means on a page at `base` (RFC 3986, 5.2), in the form of node_url; null where there is none."""
    bare = F.regexp_extract(F.regexp_replace(href, r"^[\s\x00-\x20]+|[\s\x00-\x20]+$|[\t\r\n]", ""), r"(?s)^([^#]*)", 1)

    def whole(ref):
        root = F.nullif(F.regexp_extract(base, _ROOT, 1), F.lit(""))
        place = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
        folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
        return (
            F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(ref.rlike(_ROOT), ref))
            .when(ref.startswith("//"), F.concat(F.regexp_extract(root, r"^([^:]*:)", 1), ref))
            .when(ref.startswith("/"), F.concat(root, ref))
            .when(ref == "", F.when(root.isNotNull(), base))
            .when(ref.startswith("?"), F.concat(root, place, ref))
            .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), ref))
        )

    return node_url(_let(bare, whole))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) absolute urls joined by a canonical link or an immediate refresh in the page's html, each of them, as its first base tag resolves it."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    value = r"""("[^">]*"|'[^'>]*'|[^"'\s>]+)"""
    links = F.regexp_extract_all(html, F.lit(r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?[\s"'/]href\s*=\s*""" + value), F.lit(1))
    refreshes = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    bare = lambda x: _entities(F.regexp_replace(x, r"""^["']|["']$""", ""))
    found = pages.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), F.array_distinct(F.concat(links, refreshes)).alias("hrefs"), bare(F.regexp_extract(html, r"(?is)<base\b[^>]*?\bhref\s*=\s*" + value, 1)).alias("base"))
    found = found.filter(F.size("hrefs") > 0).select("url", F.coalesce(resolve(F.col("base"), F.col("url")), F.col("url")).alias("base"), F.explode("hrefs").alias("href"))
    return found.select(node_url(F.col("url")).alias("a"), resolve(bare(F.col("href")), F.col("base")).alias("b")).filter("a <> b")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, and alias_verdict (what aliases say; null where a page has a rule or no alias has one).

    `redirects` has the columns from_url and to_url, beside the links in the pages.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    own = parts.withColumn("_own", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("_node", F.xxhash64(node_url(F.col("url"))))
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_url(F.col("from_url")).alias("a"), resolve(F.col("to_url"), F.col("from_url")).alias("b")).filter("a <> b"))
    edges = _graph.checkpoint(edges.distinct())
    if edges.isEmpty():
        told = own.withColumn("alias_verdict", F.lit(None).cast("string"))
    else:
        groups = _graph.components(edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
        ends = edges.select(F.explode(F.array("a", "b")).alias("u")).distinct().select(F.xxhash64("u").alias("node"), longest_rule(host(F.col("u")), path(F.col("u")), rules)["verdict"].alias("v"))
        said = groups.join(ends, "node").groupBy("component").agg(F.min("v").alias("said")).filter("said is not null")  # 'allow' < 'block'
        told = own.join(groups.join(said, "component").select(F.col("node").alias("_node"), F.col("said").alias("alias_verdict")), "_node", "left")
        told = told.withColumn("alias_verdict", F.when(F.col("_own").isNull(), F.col("alias_verdict")))
    return told.select("page_id", "host", "path", F.col("_own.rule").alias("rule"), F.coalesce("_own.verdict", "alias_verdict", F.lit(default)).alias("verdict"), "alias_verdict")

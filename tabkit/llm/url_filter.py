"""URL filtering with redirect equivalence. DataFrame operations only.

Rules allow or block a host with its subdomains below a path; the longest that fits a url decides. A url without a rule takes
the decision of its aliases: the urls reachable over redirects and canonical links, found as connected
components. A component with a blocked url is blocked, unless it also has an explicitly allowed one: allow goes before block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .line_dedup import lower_ascii
from .staging import Scratch

#: Lists of up to so many rules are broadcast.
BROADCAST_RULES = 100_000

#: Tags that declare a link, and the value of an attribute, quoted or not.
_LINK_TAG, _META_TAG = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
_VALUE = r"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_TO = r"""(?is)\burl\s*=\s*["']?\s*([^"'>\s]+)"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null or a url without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3, F.char_length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def normal_form(url: Column) -> Column:
    """Urls with the same normal form are one node: the scheme, the fragment and ``utm_`` parameters don't count."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&", "")
    known = F.concat(host_of(url), path_of(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, known).otherwise(url)


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, _VALUE.replace("{name}", name), 1)
    return F.trim(F.replace(F.regexp_replace(value, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&")))


def _without_dots(path: Column) -> Column:
    """A path that begins with /, its segments ``.`` and ``..`` taken out."""
    step = lambda done, part: (
        F.when(part == ".", done).when(part == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), part))
    )
    parts = F.split(F.substr(path, F.lit(2)), "/", -1)
    folder = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.aggregate(parts, F.lit(""), step), F.when(folder, "/").otherwise(""))


def resolved(target: Column, base: Column) -> Column:
    """The target of a link as an absolute url; null where it is none: the page itself, another kind of scheme, or a base without ``://``."""
    origin = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    folder = F.regexp_extract(F.concat(F.lit("/"), F.regexp_extract(path_of(base), "^/?(.*)$", 1)), "^.*/", 0)
    path, rest = F.regexp_extract(target, "^[^?#]*", 0), F.regexp_extract(target, "^[^?#]*(.*)$", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    relative = F.when(path == "", F.concat(origin, path_of(base), rest)).otherwise(F.concat(origin, _without_dots(whole), rest))
    return (
        F.when(target.rlike(_SCHEME + "//"), target)
        .when(target.rlike(_SCHEME) | target.startswith("#") | (target == "") | (origin == ""), None)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, "^[^:/?#]+:", 0), target))
        .otherwise(relative)
    )


def declared_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(from_url, to_url): all canonical links and refresh redirects of the pages, resolved against the page's url.

    A link is canonical if one of the words of its ``rel`` is. Attribute values may stand in quotes or not; ``&amp;`` in them is ``&``.
    """
    links = F.filter(
        F.regexp_extract_all(html_col, F.lit(_LINK_TAG), F.lit(0)), lambda tag: F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    )
    metas = F.filter(F.regexp_extract_all(html_col, F.lit(_META_TAG), F.lit(0)), lambda tag: F.lower(_attribute(tag, "http-equiv")) == "refresh")
    targets = F.concat(
        F.transform(links, lambda tag: _attribute(tag, "href")), F.transform(metas, lambda tag: F.regexp_extract(_attribute(tag, "content"), _TO, 1))
    )
    found = pages.select(F.col(url_col).alias("from_url"), F.explode(targets).alias("target")).where("target <> '' and from_url is not null")
    return found.select("from_url", resolved(F.col("target"), F.col("from_url")).alias("to_url")).where("to_url is not null")


def _matched(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(url, rule, action) of the longest rule that fits each url with one."""
    spark = urls.sparkSession
    table = [(text.split("/", 1)[0].lower(), "/" + text.split("/", 1)[1], text, action) for text, action in rules]
    listed = spark.createDataFrame(table, "rule_host string, rule_path string, rule string, action string")
    labels = F.split("host", r"\.", -1)
    most = max((t[0].count(".") + 1 for t in table), default=0)  # longer endings than any rule has can't fit
    endings = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, most)))), lambda k: F.array_join(F.slice(labels, -k, k), ".")
    )
    rows = urls.where("host <> ''").select("url", "path", F.explode(endings).alias("rule_host"))
    rows = rows.join(F.broadcast(listed) if len(table) <= BROADCAST_RULES else listed, "rule_host")
    fits = rows.where(F.col("path").startswith(F.col("rule_path")))
    allows = F.when(F.col("action") == "allow", 1).otherwise(0)
    best = fits.groupBy("url").agg(F.max(F.struct(F.char_length("rule").alias("n"), allows.alias("allows"), "rule", "action")).alias("x"))
    return best.select("url", "x.rule", "x.action")


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    default: str = "allow",
) -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row of ``pages``.

    ``rules`` are (host and path, ``allow`` or ``block``), such as ("example.com/en/", "block"). ``redirects`` holds further
    pairs (from_url, to_url). A null url, or one without ``://``, has empty host and path and no rule; it may still have aliases
    by ``redirects`` if it isn't null. Repeated rows and urls are judged alike. Null html declares no link. An empty table gives an empty result;
    without rules every verdict is ``default``. A rule listed with both actions allows. Other columns are left out.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    own = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("url"))
    links = None
    if html_col is not None:
        links = declared_links(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select("from_url", "to_url")
        links = more if links is None else links.unionByName(more)
    node = lambda url: F.unhex(F.md5(normal_form(url).cast("binary")))
    urls = own.select("url")
    if links is not None:
        links = scratch.keep(links, "links")
        urls = urls.union(links.select("from_url")).union(links.select("to_url"))
    urls = urls.where("url is not null").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = scratch.keep(urls.withColumn("node", node(F.col("url"))), "urls")
    judged = scratch.keep(urls.select("url", "node").join(_matched(urls, rules), "url", "left"), "judged")

    by_node = judged.groupBy("node").agg(F.count_if(F.col("action") == "allow").alias("allows"), F.count_if(F.col("action") == "block").alias("blocks"))
    if links is not None:
        roots = components(links.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b")), scratch)
        rooted = by_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        by_root = rooted.groupBy("root").agg(F.sum("allows").alias("allows"), F.sum("blocks").alias("blocks"))
        by_node = rooted.select("node", "root").join(by_root, "root")
    spread = F.when((F.col("blocks") > 0) & (F.col("allows") == 0), "block").otherwise(default)
    verdicts = judged.join(by_node.select("node", spread.alias("alias_verdict")), "node")
    verdicts = verdicts.select("url", "rule", F.coalesce("action", "alias_verdict").alias("verdict"))
    out = own.join(verdicts, "url", "left")
    return out.select(
        F.col("__id").alias(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )

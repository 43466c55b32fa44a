"""URL filters with redirect equivalence (operator 9), by DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velofield.llm.shared import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = "^[^/?#]*"
#: Rules whose text is smaller than this go to every task; larger rule sets are joined by shuffle.
RULE_BYTES = 8 << 20
_TAG = r"(?is)<(?:link|meta)\s(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
_IS_CANONICAL = r"(?is)^<link\s.*\srel\s*=\s*(?:\"(?:[^\"]*\s)?canonical(?:\s[^\"]*)?\"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])|^<link\srel\s*=\s*[\"']?canonical[\"'\s/>]"
_IS_REFRESH = r"(?is)^<meta\s(?:.*\s)?http-equiv\s*=\s*[\"']?\s*refresh\s*[\"'\s/>]"
_REFRESH_URL = r"(?is)(?:^|[;,\s])url\s*=\s*[\"']?([^\"']+)"
# Characters of urls that pages may write as entities; the ampersand comes last.
_ENTITIES = [("&quot;|&#0*34;", '"'), ("&apos;|&#0*39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#0*47;|&#[xX]0*2[fF];", "/"), ("&#0*58;|&#[xX]0*3[aA];", ":"), ("&amp;|&#0*38;|&#[xX]0*26;", "&")]


def rest_of(url: F.Column) -> F.Column:
    """What follows the first ``://``; empty for null and for a url without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: F.Column) -> F.Column:
    return F.translate(F.regexp_extract(rest_of(url), _AFTER, 0), _UPPER, _LOWER)


def path_of(url: F.Column) -> F.Column:
    return F.regexp_extract(rest_of(url), _AFTER + "([^?#]*)", 1)


def node_of(url: F.Column) -> F.Column:
    """What identifies a url in the graph: the lower-cased host and all up to a fragment, whatever the scheme."""
    rest = rest_of(url)
    return F.concat(host_of(url), F.regexp_extract(rest, _AFTER + "([^#]*)", 1))


def _attribute(tag: F.Column, name: str) -> F.Column:
    """The value of a tag's attribute, entities decoded, without white space around it; empty where there is none."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))
    for entity, plain in _ENTITIES:
        value = F.regexp_replace(value, entity, plain)
    return F.trim(F.regexp_replace(value, r"[\t\n\r]", ""))


def without_dots(path: F.Column) -> F.Column:
    """A path with its . and .. segments applied."""
    parts = F.split(path, "/")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step)
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise(""))).otherwise(path)


def resolved(link: F.Column, page: F.Column) -> F.Column:
    """The url that a link in a page means; null for the page itself and for schemes without an authority (mailto:)."""
    at, tail = F.concat(F.lit("x://"), host_of(page)), F.regexp_extract(link, r"^[^?#]*(.*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(page), "^(.*/)", 1), F.lit("")), F.lit("/"))
    path = F.regexp_extract(link, r"^([^?#]*)", 1)
    return (
        F.when((link == "") | link.startswith("#"), None).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link)).when(link.startswith("/"), F.concat(at, without_dots(path), tail))
        .when(link.startswith("?"), F.concat(at, path_of(page), link)).otherwise(F.concat(at, without_dots(F.concat(folder, path)), tail))
    )


def links_in(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) urls from all canonical links and refresh redirects of the pages, resolved against the page's url.

    Entities are decoded; links without a scheme, without a host, relative ones and . and .. segments mean what browsers
    take them for (a ``base`` element isn't looked at). A page without a host, and a link to the page itself, link nothing.
    """
    tags = pages.where(F.col(html).rlike("(?i)canonical|refresh")).select(F.col(url).cast("string").alias("src"), F.explode(F.regexp_extract_all(html, F.lit(_TAG), 0)).alias("tag"))
    link = F.when(F.col("tag").rlike(_IS_CANONICAL), _attribute(F.col("tag"), "href")).when(F.col("tag").rlike(_IS_REFRESH), F.trim(F.regexp_extract(_attribute(F.col("tag"), "content"), _REFRESH_URL, 1)))
    found = tags.select("src", link.alias("link")).where(F.col("link").isNotNull() & (host_of(F.col("src")) != ""))
    return found.select("src", resolved(F.col("link"), F.col("src")).alias("dst")).where("dst is not null")


def ruled(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``ruling`` (allow, block or null) to rows with ``host`` and ``path``.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule wins; of equally long ones
    that with the longer host, then allow. A host's suffixes are looked up, so the work is in the number of its labels.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    places = nodes.select("host", "path").distinct()
    spread = places.where("host <> ''").withColumn("_suffix", F.explode(suffixes))
    weight = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path")).alias("n")).first()["n"] or 0
    small = F.broadcast(rules) if weight < RULE_BYTES else rules
    small = small.select(F.col("host").alias("_suffix"), F.col("path").alias("_rule_path"), F.col("verdict").alias("_verdict"))
    fits = spread.join(small, "_suffix").where(F.col("path").startswith(F.col("_rule_path")))
    rank = F.struct(F.length("_suffix") + F.length("_rule_path"), F.length("_suffix"), (F.col("_verdict") == "allow").cast("int"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_suffix", "_rule_path").alias("rule"), F.col("_verdict").alias("ruling")), rank).alias("_best"))
    return nodes.join(best, ["host", "path"], "left").select(*nodes.columns, F.col("_best.rule").alias("rule"), F.col("_best.ruling").alias("ruling"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """Judge every page's url by rules, and by the rules of its aliases where none fits: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict (allow or block). Canonical links and refresh redirects in the pages, and
    ``redirects`` (src, dst urls), join urls into components. A page that a rule fits gets that rule's verdict. Any other
    page is allowed if an allow rule fits an alias, else blocked if a block rule fits one, else allowed.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is no alias: it is allowed. Null and
    empty html has no links. Repeated rows are judged each; an empty table gives an empty one; other columns, whatever
    their names, are not looked at.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("_url"))
    judged = ruled(source.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), node_of(F.col("_url")).alias("_node")), rules)
    edges = None
    if html is not None:
        edges = links_in(pages, url, html)
    if redirects is not None:
        given = redirects.toDF("src", "dst")
        edges = given if edges is None else edges.union(given)
    if edges is None:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.lit("allow")).alias("verdict"))
    ends = edges.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")).where("a <> '' and b <> ''")
    members = connected_components(ends)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    aliases = ruled(members.select("node", "component", host_of(as_url).alias("host"), path_of(as_url).alias("path")), rules)
    decided = aliases.groupBy("component").agg(F.max((F.col("ruling") == "allow").cast("int")).alias("allowed"), F.max((F.col("ruling") == "block").cast("int")).alias("blocked"))
    passed = members.join(decided, "component").select(F.col("node").alias("_node"), F.when(F.coalesce("allowed", F.lit(0)) == 1, "allow").when(F.coalesce("blocked", F.lit(0)) == 1, "block").otherwise("allow").alias("passed"))
    return judged.join(passed, "_node", "left").select("page_id", "host", "path", "rule", F.coalesce("ruling", "passed", F.lit("allow")).alias("verdict"))

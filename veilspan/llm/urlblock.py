"""URL filters with redirect equivalence, in DataFrame operations only.

Canonical links and meta-refresh redirects are edges between URLs without fragments, scheme and host in lower case and
dot segments resolved; a page's URL with dot segments is joined to the one without, so rules on either reach. Connected components over
them are equivalence classes. A page's own rule, if one fits, decides it: so an explicit allow holds even where an
alias is blocked. A page without a rule is blocked if any URL of its class is blocked by a rule, else allowed.

Edge cases: a null URL has empty host and path, fits no rule, has no alias and is allowed; null html has no edges;
URLs repeated over rows are one node; a cycle of redirects is one class; a link to itself is no edge; an empty table
gives an empty result. Only id, url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialize

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?i)<(?:link|meta)\s[^>]*>"
HREF = r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
CANONICAL = r"""(?i)\srel\s*=\s*["']?(?:[^"'>]*\s)?canonical[\s"'/>]"""
REFRESH = r"""(?i)\shttp-equiv\s*=\s*["']?refresh[\s"'/>]"""
CONTENT = r"""(?i)\scontent\s*=\s*(?:"[^"]*?url\s*=\s*([^"]*)"|'[^']*?url\s*=\s*([^']*)'|[^\s"'>]*?url\s*=\s*([^\s"'>]+))"""


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOW)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule (verdict, host, path) that fits, an allow first among equals."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rh, rp in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow", r[1:])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def undotted(p: Column) -> Column:
    """A path without its segments '.' and '..'."""
    none = F.array().cast("array<string>")
    step = lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    parts = F.split(p, "/", -1)
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), none, step)
    kept = F.when(p.rlike(r"/\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(p.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(p)


def node_of(url: Column, dots: bool = False) -> Column:
    """The node of a URL: no fragment, scheme and host in lower case, dot segments resolved unless dots."""
    u = F.regexp_replace(url, "#.*$", "")
    part = lambda p: F.regexp_extract(u, p, 1)
    p = part(r"^[^:/?]+://[^/?]*([^?]*)")
    low = lambda c: F.translate(c, UPPER, LOW)
    full = F.concat(low(part(r"^([^:/?]+://)")), part(r"^[^:/?]+://([^/?]*@)"), low(part(r"^[^:/?]+://(?:[^/?]*@)?([^/?]*)")), p if dots else undotted(p), part(r"^[^?]*(\?[\s\S]*)"))
    return F.when(u.rlike("^[^:/?]+://"), full).otherwise(u)


def absolute(base: Column, link: Column) -> Column:
    """link resolved against base, without fragment."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    origin = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*[^?#]*/)", 1)
    folder = F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/")))
    full = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), F.when(link.startswith("#"), F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)).otherwise(""), link))
        .otherwise(F.concat(folder, link))
    )
    return node_of(full)


def edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    tags = pages.where(F.col(url).contains("://")).select(F.col(url).alias("u"), F.explode(F.regexp_extract_all(F.col(html), F.lit(TAG), F.lit(0))).alias("tag"))
    first = lambda p, *groups: F.coalesce(*[F.nullif(F.regexp_extract("tag", p, g), F.lit("")) for g in groups])
    link = F.when(F.col("tag").rlike(CANONICAL), first(HREF, 1, 2, 3)).when(F.col("tag").rlike(REFRESH), F.trim(F.regexp_replace(first(CONTENT, 1, 2, 3), "[\"']", "")))
    links = tags.select("u", link.alias("link")).where("link is not null").select(node_of(F.col("u")).alias("a"), absolute(F.col("u"), F.col("link")).alias("b"))
    dotted = pages.where(F.col(url).rlike(r"://[^?#]*/\.\.?(?:[/?#]|$)")).select(node_of(F.col(url), dots=True).alias("a"), node_of(F.col(url)).alias("b"))
    return links.unionAll(dotted).where("a <> b").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, class_blocked) of every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    links = materialize(edges(pages, url, html), "url-edges")
    comp = components(links, "url-cc")
    own = rule_of(host(F.col("node")), path(F.col("node")), rules)["verdict"]
    bad = comp.where(own == "block").select("comp").distinct()
    # Only URLs of classes that hold a block matter to the others: a small table unless blocks are everywhere.
    blocked = materialize(comp.join(bad, "comp", "left_semi").select("node").distinct(), "url-blocked")
    discard(links, comp)
    h, p = host(F.col("url")), path(F.col("url"))
    out = rows.withColumn("host", h).withColumn("path", p).withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).withColumn("node", node_of(F.col("url")))
    out = out.join(blocked.withColumn("hit", F.lit(True)), "node", "left")
    alias = F.coalesce(F.col("hit"), F.lit(False))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.verdict"), F.when(alias, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), alias.alias("class_blocked"))

"""URL filters: host and path rules, and block decisions carried over redirects and canonical links to aliases."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderspark.llm.common import query, table
from ladderspark.llm.graph import components
from ladderspark.storage import materialize

# Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?is)<(?:link|meta|base)\b[^>]*>"
# HTML's named references (some also count without a semicolon), and pieces of an attribute: a reference, other text, a lone &.
_NAMED = "\x02".join(f"{name}\x01{value}" for name, value in html5.items())
_PIECE = r"(?s)(&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*(?:;|(?![A-Za-z0-9=;]))|[^&]+|&)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next of / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one; of equally long ones allow wins."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def address(url: Column) -> Column:
    """Host, path and query: an address without scheme and fragment. Null without a host; an empty path is /, segments . and .. are resolved."""
    host, query = host_of(url), F.regexp_extract(_after_scheme(url), r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, _without_dots(path_of(url)), query))


def _without_dots(path: Column) -> Column:
    """The path without segments . and .., each .. taking the segment before it away; / for the empty one."""
    def step(acc, part):
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(part == "..", up).when(part == ".", acc).otherwise(F.concat(acc, F.array(part)))

    parts = F.split(F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path), "/", -1)
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    return F.when(path == "", F.lit("/")).when(path.rlike(r"/\.\.?(?:/|$)"), F.array_join(kept, "/")).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """The url with a scheme that `target` stands for on the page `base`; null for schemes without //, such as mailto:."""
    site, path = F.concat(F.lit("http://"), host_of(base)), path_of(base)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^.*/", 0))
    return (
        F.when(target.rlike(_SCHEME), F.when(target.rlike(_SCHEME + "//"), target)).when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target)).when(target.startswith("?"), F.concat(site, path, target))
        .when((target == "") | target.startswith("#"), base).otherwise(F.concat(site, folder, target))
    )


def unescaped(value: Column) -> Column:
    """An attribute with its character references decoded once, without blanks around it. Unknown names stay, numbers of no character give U+FFFD."""
    names = F.str_to_map(F.lit(_NAMED), F.lit("\x02"), F.lit("\x01"))

    def char(piece):
        decimal = F.hex(F.concat(F.lit("0"), F.regexp_extract(piece, r"^&#0*([0-9]{0,7});?$", 1)).cast("long"))
        code = F.upper(F.lpad(F.when(piece.rlike("^&#[xX]"), F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]{0,6});?$", 1)).otherwise(decimal), 8, "0"))
        good = code.between("00000001", "0000D7FF") | code.between("0000E000", "0010FFFF")
        number = F.decode(F.unhex(F.when(good, code).otherwise("0000FFFD")), "UTF-32")
        return F.when(piece.startswith("&#") & (F.length(piece) > 2), number).when(piece.startswith("&"), F.coalesce(F.try_element_at(names, F.substring(piece, 2, 40)), piece)).otherwise(piece)

    pieces = F.regexp_extract_all(value, F.lit(_PIECE), F.lit(1))
    return F.regexp_replace(F.when(value.contains("&"), F.array_join(F.transform(pieces, char), "")).otherwise(value), r"^\s+|\s+$", "")


def targets(url: Column, html: Column) -> Column:
    """Addresses the page names as its own: canonical link, refresh redirect, og:url, resolved against the page's url or its <base>."""
    def attribute(tags, tag, pattern):
        return F.transform(F.filter(tags, lambda t: t.rlike(tag)), lambda t: F.regexp_extract(t, pattern, 1))

    def on_page(tags):
        href = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
        canonical = attribute(tags, r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b""", href)
        refresh = attribute(tags, r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b""", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""")
        shared = attribute(tags, r"""(?is)^<meta\b.*\bproperty\s*=\s*["']?og:url\b""", r"""(?is)\bcontent\s*=\s*["']?([^"'\s>]+)""")
        bases = F.transform(F.filter(F.transform(attribute(tags, r"(?is)^<base\b", href), unescaped), lambda t: t != ""), lambda t: resolved(url, t))
        base = F.coalesce(F.get(F.filter(F.slice(bases, 1, 1), lambda b: host_of(b) != ""), F.lit(0)), url)
        named = F.filter(F.transform(F.concat(canonical, refresh, shared), unescaped), lambda t: t != "")
        # A transform of an array of one binds its value, so that it is computed once.
        return F.transform(F.array(base), lambda b: F.transform(F.transform(named, lambda t: resolved(b, t)), address))[0]

    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(f"({_TAG})"), F.lit(1))
    return F.filter(F.transform(F.array(tags), on_page)[0], lambda t: t.isNotNull())


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, host, path, rule, verdict (allow or block).

    The rule's verdict holds where a rule fits. Other pages are blocked if a page they are equivalent to is: equivalence is the closure over
    canonical links and redirects found in the pages and over `redirects` (from_url, to_url), an address named there counting by its own
    rule even if it is no page. An explicit allow stays an allow and carries nothing on. Null urls have empty host and path and are allowed; null html names nothing. Repeated rows get the
    same verdict; other columns are ignored.
    """
    url = F.coalesce("url", F.lit(""))
    host, path = host_of(url), path_of(url)
    rule, own = rule_of(F.col("host"), F.col("path"), rules)
    named = pages.select("page_id", url.alias("url"), "html").select("page_id", host.alias("host"), path.alias("path"), address(url).alias("at"), targets(url, F.col("html")).alias("to"))
    named = materialize(named.withColumn("rule", rule).withColumn("own", own), "url-pages")
    edges = named.select(F.col("at").alias("a"), F.explode("to").alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(address(F.col("from_url")), address(resolved(F.coalesce("from_url", F.lit("")), F.col("to_url")))))
    classes = materialize(components(edges), "url-classes")
    node_url = F.concat(F.lit("http://"), F.col("node"))
    by_name = classes.withColumn("own", rule_of(host_of(node_url), path_of(node_url), rules)[1])
    bad = by_name.where("own = 'block'").select("component").distinct()
    bad_nodes = classes.join(bad, "component").select(F.col("node").alias("n"))
    out = named.join(bad_nodes, F.col("at") == F.col("n"), "left")
    verdict = F.coalesce("own", F.when(F.col("n").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


@query("op7_url_filter")
def op7_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))

"""Block and allow rules for URLs, carried over to aliases of the same page.

Aliases are URLs that lead to one page: forms of one address that servers redirect to one another
(scheme, ``www.`` and ``m.`` hosts, index and ``.html`` endings, a closing slash, tracking
parameters, fragments), and the targets of redirect and canonical links in the pages. The forms of
an address get one key without any join; links between keys are joined to connected components.
Only SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.components import components
from salesmart.llm.steps import column, settled

ALLOW, BLOCK = "allow", "block"
#: Rules are compared one by one with each page.
MOST_RULES = 1_000


@dataclass(frozen=True)
class Rule:
    """Fits URLs of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def lower_ascii(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty if there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_key(url: Column) -> Column:
    """The same for all forms of an address that redirect to one another; null without a host.

    The query stays but for tracking parameters (``utm_*`` and ``ref``), because it may name the page.
    """
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/index)?\.html?$|/$", "")
    query = F.regexp_extract(url, r"^(?s)[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&", -1), lambda q: ~q.rlike("^(utm_[^=]*|ref)(=|$)") & (q != ""))
    named = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&")))
    return F.when(host_of(url) != "", F.concat(host, path, F.coalesce(named, F.lit(""))))


_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
_BASE = r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
#: Entities in attributes; the ampersand is last, so that nothing is decoded twice.
_ENTITIES = (
    ("(?i)&quot;|&#0*34;|&#x0*22;", '"'),
    ("(?i)&apos;|&#0*39;|&#x0*27;", "'"),
    ("(?i)&lt;|&#0*60;|&#x0*3c;", "<"),
    ("(?i)&gt;|&#0*62;|&#x0*3e;", ">"),
    ("(?i)&#0*47;|&#x0*2f;", "/"),
    ("(?i)&#0*58;|&#x0*3a;", ":"),
    ("(?i)&#0*61;|&#x0*3d;", "="),
    ("(?i)&#0*63;|&#x0*3f;", "?"),
    ("(?i)&amp;|&#0*38;|&#x0*26;", "&"),
)


def unescaped(value: Column) -> Column:
    for pattern, plain in _ENTITIES:
        value = F.regexp_replace(value, pattern, plain)
    return value


def without_dots(path: Column) -> Column:
    """``path`` with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/", -1)

    def step(state: Column, part: Column) -> Column:
        # The first part is the empty one before the first slash; it stays.
        up = F.slice(state, F.lit(1), F.greatest(F.size(state) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", state).otherwise(F.concat(state, F.array(part)))

    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1), step)
    closed = F.when(path.rlike(r"/\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(closed, "/")).otherwise(path)


def resolved(found: DataFrame, target: str, base: str) -> DataFrame:
    """``found`` with its column ``target`` as a whole URL, seen from ``base``.

    It stays as it is where it has a scheme or ``base`` has no host. The steps are columns, so that
    none is computed again for each of its uses.
    """
    target_, base = target, F.col(base)
    found = found.withColumn(target_, unescaped(F.col(target_)))
    target = F.col(target_)
    origin = F.regexp_extract(base, r"^((?s).*?://[^/?#]*)", 1)
    own = path_of(base)
    query = F.regexp_extract(base, r"^(?s)[^?#]*(\?[^#]*)", 1)
    folder = F.when(own == "", F.lit("/")).otherwise(F.regexp_extract(own, r"^((?s).*/)", 1))
    joined = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (origin == ""), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^((?s).*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, own, target))
        .when(target.startswith("#"), F.concat(origin, own, query, target))
        .otherwise(F.concat(origin, folder, target))
    )
    found = found.withColumn("__whole", joined)
    whole = F.col("__whole")
    found = found.withColumn("__path", path_of(whole))
    start = F.regexp_extract(whole, r"^((?s).*?://[^/?#]*)", 1)
    rest = F.regexp_extract(whole, r"^(?s)[^?#]*([?#].*)", 1)
    clean = F.concat(start, without_dots(F.col("__path")), rest)
    return found.withColumn(target_, F.when(start == "", whole).otherwise(clean)).drop("__whole", "__path")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(url, target)`` for the canonical and redirect links of each page.

    Basic entities are decoded, and relative targets resolved against the page's ``base`` or else its
    URL. Targets that are without a host then (as ``mailto:``) are left out.
    """
    found = pages.select(
        column(url).alias("url"),
        F.coalesce(F.nullif(F.regexp_extract(column(html), _BASE, 1), F.lit("")), column(url)).alias("base"),
        F.concat(
            F.regexp_extract_all(column(html), F.lit(_CANONICAL), F.lit(1)),
            F.regexp_extract_all(column(html), F.lit(_REFRESH), F.lit(1)),
        ).alias("targets"),
    )
    found = found.where(F.size("targets") > 0)
    found = resolved(found.withColumn("url_", F.coalesce("url", F.lit(""))), "base", "url_")
    found = found.withColumn("base", F.coalesce("base", F.lit("")))
    found = resolved(found.select("url", "base", F.explode("targets").alias("target")), "target", "base")
    return found.select("url", "target").where(F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (name, verdict) of the longest fitting rule; null if none fits.

    Of rules with the same length the first by name wins, and of the same name an allow.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict))
    chosen = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in reversed(ranked):
        suffix = F.lit("." + rule.host)
        fits = ((host == rule.host) | host.endswith(suffix)) & path.startswith(F.lit(rule.path))
        pair = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, pair).otherwise(chosen)
    return chosen


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    url: str = "url",
    html: str | None = "html",
    links: DataFrame | None = None,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``component``.

    A page with a rule gets the rule's verdict: an explicit allow outweighs any block that reaches
    the page by an alias. A page without one is blocked if a page or link target of its component is
    blocked by a rule, and allowed else. ``links`` is a frame (url, target) with further redirects,
    for example those seen by a crawler; null ends are ignored. A null URL or one without ``://``
    has an empty host and path, no rule and no aliases, and is allowed. Repeated pages stay, other
    columns pass through, columns called as the new ones are replaced. An empty table stays empty.

    ``component`` is the least key of the addresses joined, null without a host.
    """
    out = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "component")]
    address = column(url)
    judged = pages.select(
        *map(column, out),
        host_of(address).alias("host"),
        path_of(address).alias("path"),
        address_key(address).alias("__key"),
    )
    judged = judged.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))

    all_links = page_links(pages, url, html) if html else None
    if links is not None:
        given = links.select("url", "target")
        all_links = given if all_links is None else all_links.unionByName(given)
    blocked = judged.where((F.col("__rule.verdict") == BLOCK) & F.col("__key").isNotNull()).select(
        F.col("__key").alias("key")
    )
    same = None
    if all_links is not None:
        ends = settled(all_links.dropDuplicates(), "links")
        edges = ends.select(
            address_key(F.col("url")).alias("a"), address_key(F.col("target")).alias("b")
        )
        same = settled(components(edges), "aliases")
        targets = ends.select(F.col("target").alias("url")).union(ends.select("url"))
        rule = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
        blocked = blocked.unionByName(
            targets.where(rule["verdict"] == BLOCK).select(address_key(F.col("url")).alias("key"))
        )
        blocked = blocked.join(same, blocked["key"] == same["node"], "left").select(
            F.coalesce("component", "key").alias("key")
        )
        judged = judged.join(same, judged["__key"] == same["node"], "left").withColumn(
            "component", F.coalesce("component", "__key")
        )
    else:
        judged = judged.withColumn("component", F.col("__key"))
    # Only pages without a rule need to know; each blocked component is one row.
    reached = blocked.distinct().withColumn("__blocked", F.lit(True))
    judged = judged.join(
        reached,
        (judged["component"] == reached["key"]) & judged["__rule"].isNull(),
        "left",
    )
    by_alias = F.when(F.col("__blocked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return judged.select(
        *map(column, out),
        "host",
        "path",
        F.col("__rule.name").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), by_alias).alias("verdict"),
        "component",
    )

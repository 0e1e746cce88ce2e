"""URL filters with redirect equivalence.

Rules name a host and a path prefix; the longest rule that fits decides. URLs
that no rule decides take the verdict of their aliases: redirect and
canonical-link edges form an undirected graph whose connected components are
computed distributedly, a blocked member blocks its component and an
explicitly allowed member takes precedence over that.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, ascii_lower, join_hot
from loomspan.llm.components import connected_components

#: (verdict, host/path prefix) of the registered query.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Rules beyond this many are matched by a join on their parts instead of one expression.
INLINE_RULES = 64
_TAGS = r"""(?is)<(?:link|meta|base)\b(?:[^>"']+|"[^"]*"|'[^']*')*>"""
_ATTR = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_REFRESH = re.compile(r"""\burl\s*=\s*["']?([^"']*)""", re.I)
_URL = re.compile(r"(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?", re.S)
_SCHEME = re.compile(r"[a-z][a-z0-9+.-]*:", re.I)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _node(url: Column) -> Column:
    """128-bit key of a URL without scheme and fragment, host lower-cased; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.unhex(F.md5(F.concat(host_of(url), F.lit("\n"), rest).cast("binary"))))


def _fits(host: Column, path: Column, rule: str) -> Column:
    name, slash, rest = rule.partition("/")
    name = name.lower()
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def with_rules(urls: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Adds ``rule`` and ``ruled`` (its verdict) to rows with ``host`` and ``path``; null where none fits.

    The longest rule wins, and allow before block where two rules are equal.
    """
    order = sorted(dict.fromkeys(rules), key=lambda r: (-len(r[1]), r[0]))
    if len(order) <= INLINE_RULES:
        pick = reduce(
            lambda rest, r: F.when(_fits(F.col("host"), F.col("path"), r[1]), F.struct(F.lit(r[1]).alias("rule"), F.lit(r[0]).alias("ruled"))).otherwise(rest),
            reversed(order),
            F.lit(None).cast("struct<rule:string,ruled:string>"),
        )
        return urls.withColumn("_pick", pick).select("*", "_pick.rule", "_pick.ruled").drop("_pick")
    spark = urls.sparkSession
    rows = [(r.partition("/")[0].lower(), "/" + r.partition("/")[2] if "/" in r else "", r, v, i) for i, (v, r) in enumerate(order)]
    listed = spark.createDataFrame(rows, "r_host string, r_path string, rule string, ruled string, place int")
    lengths = sorted({len(r[1]) for r in rows})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths]))
    pairs = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("r_host"), F.lit(1))
    pairs = pairs.select("host", "path", "r_host", F.explode(prefixes).alias("r_path"))
    best = pairs.join(listed, ["r_host", "r_path"]).groupBy("host", "path").agg(F.min_by(F.struct("rule", "ruled"), "place").alias("_pick"))
    return urls.join(best, ["host", "path"], "left").select("*", "_pick.rule", "_pick.ruled").drop("_pick")


def resolve(base: str, ref: str) -> str:
    """The target of a reference on the page ``base``, as RFC 3986 5.2 resolves it; targets with a scheme stay as they are."""
    scheme, host, path, query = _URL.match(base).groups("")
    ref = ref.partition("#")[0]
    if _SCHEME.match(ref):
        return ref
    if ref.startswith("//"):
        return f"{scheme}:{ref}"
    way, mark, asked = ref.partition("?")
    if not way:
        return f"{scheme}://{host}{path}{mark + asked if mark else query}"
    if not way.startswith("/"):
        way = (path.rpartition("/")[0] if path else "") + "/" + way
    parts: list[str] = []
    names = way.split("/")[1:]
    for name in names:
        if name == "..":
            del parts[-1:]
        elif name != ".":
            parts.append(name)
    if names[-1] in (".", ".."):
        parts.append("")
    return f"{scheme}://{host}/{'/'.join(parts)}{mark}{asked}"


def targets(url: str, tags: list[str]) -> list[str]:
    """Targets of the canonical links and meta refreshes among the link, meta and base tags of a page."""
    base, refs = None, []
    for tag in tags:
        found: dict[str, str] = {}
        for m in _ATTR.finditer(tag):
            found.setdefault(m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or "").strip())
        kind = tag[1:5].lower()
        if kind == "base" and base is None and "href" in found:
            base = resolve(url, found["href"])
        elif kind == "link" and "href" in found and "canonical" in found.get("rel", "").lower().split():
            refs.append(found["href"])
        elif kind == "meta" and found.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.search(found.get("content", ""))):
            refs.append(m[1].strip())
    base = base if base and "://" in base else url
    return [to for ref in refs if _URL.match(to := resolve(base, ref))]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(url, to) for url, tags in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for to in targets(url, tags)]
        yield pa.record_batch([pa.array([p[i] for p in pairs], pa.string()) for i in range(2)], names=["from_url", "to_url"])


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(from_url, to_url) of canonical links and meta refreshes, resolved against the page's url or base element."""
    marked = pages.where(F.col(html).rlike("(?i)canonical|refresh") & F.col(url).contains("://"))
    tags = F.regexp_extract_all(html, F.lit(_TAGS), F.lit(0))
    found = marked.select(F.col(url).alias("url"), tags.alias("tags"))
    return found.where(F.exists("tags", lambda t: t.rlike("(?i)canonical|refresh"))).mapInArrow(_edges, "from_url string, to_url string")


def judge(pages: DataFrame, scratch: Scratch, rules: tuple[tuple[str, str], ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``redirects(from_url, to_url)`` adds edges to those found in the pages. A
    page with a rule has that rule's verdict. Any other is blocked if its
    component holds a blocked page or target and none that a rule allows; else it is
    allowed. URLs that are null or lack ``://`` have empty host and path and
    no aliases. URLs that differ only in scheme, in the case of the host or behind ``#`` are one
    node, so they are aliases without an edge. Repeated rows give equal rows, of equal rules
    allow goes first; no edges or no pages are fine; other columns are ignored.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from_url", "to_url"))
    edges = scratch.save(edges, "links")
    ends = edges.select(F.explode(F.array("from_url", "to_url")).alias("url")).distinct()
    graph = edges.select(_node(F.col("from_url")).alias("u"), _node(F.col("to_url")).alias("v"))
    component = connected_components(graph, scratch)
    # A node fixes its host and path, so it is listed once, however many URLs differ in scheme or fragment only.
    nodes = ends.select(_node(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct()
    said = component.join(with_rules(nodes, rules).where("ruled is not null"), "node").groupBy("component").agg(F.max(F.col("ruled") == "allow").alias("allowed"))
    sizes = component.groupBy("component").agg(F.count("*").alias("n"))
    blocked = join_hot(component, said.where("not allowed").join(sizes, "component"), ["component"], component.count())
    blocked = blocked.select("node", F.lit(True).alias("alias_blocked"))
    own = pages.select("page_id", _node(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    verdict = F.coalesce("ruled", F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow"))
    # A null node matches nothing; a key of its own spreads such rows over the tasks of the join.
    own = own.withColumn("node", F.coalesce("node", F.concat(F.lit(b"?"), F.unhex(F.hex(F.xxhash64("page_id"))))))
    return with_rules(own, rules).join(blocked, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))

"""Main-text extraction by template deduction from equivalence classes of tokens.

Tokens are tags told apart by the containers around them, and the texts of
blocks, those of articles too. Over the pages of one host every token has an occurrence
vector, its count on each page; tokens with equal vectors form an equivalence class.
A class is valid when it is frequent, its tokens follow each other in one order on
its pages, its occurrences nest with those of other classes, and a slot
between its tokens varies from page to page (Arasu and Garcia-Molina, "Extracting
Structured Data from Web Pages"). The texts of valid classes are template; the main text is
what the slots leave open, without menus, notices, forms and the like, which are
told by the containers that hold them.

No host's pages meet in one task: each task sums a digest of the vectors of
its own pages, sums meet per (host, token), a second pass sums where the tokens of each class
stand, and a template has a bounded number of tokens, whatever the number of pages.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, row_count_at_most
from loomspan.llm.url_filter import host_of

#: A template token stands on this share of a host's distinct pages at least, so there are at most 1 / share times the mean tokens of a page.
SHARE = 0.9
#: Distinct pages of a host below which nothing tells its template from its text, and all is kept.
LEAST_PAGES = 5
#: Share of a class's pages on which a token must keep its place in the class.
SETTLED = 0.9
BROADCAST_TOKENS = 200_000
_TALLY = 100_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom merror msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option b i em strong a span h1 h2 h3 h4 h5 h6".split())
#: What HTML reads as raw text; nothing inside is markup.
_RAW = frozenset("script style iframe textarea title".split())
_OUTSIDE = frozenset("head nav header footer aside form menu button select dialog script style noscript template iframe textarea title svg fieldset".split())
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|side-?bar|cookies?|consent|notice|popup|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|related|recommended|comments?|disqus|replies|respond|widget|pagination|pager|toolbar|skip|search)(?:$|[\s_-])",
    re.I,
)
# Within an article only a name that is such a word as a whole, but for a part that says what kind of box it is.
_NOISE_WITHIN = re.compile(
    r"(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|nav|menu|breadcrumbs?|sidebar|cookies?|consent|notice|popup|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|related|recommended|comments?|disqus|replies|respond|widget|pagination|pager|toolbar|search)"
    r"(?:[_-]*(?:list|box|block|section|container|wrap(?:per)?|area|bar|thread|form|slot|unit|buttons?|links?|notice|banner|posts?|articles?|[0-9]+))*",
    re.I,
)
_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())


class Page:
    """The tokens of a page and its blocks of text, in one pass over the markup."""

    def __init__(self, source: str) -> None:
        self.order: list[tuple[str, int]] = []  # tokens as they come, with a digest of their text or 0
        self.blocks: list[tuple[str, str, bool, bool]] = []  # text, token, outside, within article or main
        self.path: list[tuple[str, str, bool, bool]] = []  # tag, label, outside, article
        self._text: list[str] = []
        at = 0
        while m := _TOKEN.search(source, at):
            if m.start() > at:
                self._text.append(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._close(tag)
            else:
                self._open(tag, m[3])
                if tag in _RAW and not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    self._close(tag)
                elif tag == "svg" and m[3].endswith("/"):
                    self._close(tag)
        self._text.append(source[at:])
        self._flush()

    def _count(self, name: str) -> None:
        self.order.append((f"{self.path[-1][1] if self.path else ''}>{name}", 0))

    def _open(self, tag: str, attrs: str) -> None:
        if tag in _INLINE:
            return
        if tag in ("br", "hr"):
            self._text.append(" ")
            return
        self._flush()
        self._count(tag)
        if tag in _VOID or tag in _LOOSE:
            return
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs.strip() else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        above = self.path[-1] if self.path else ("", "", False, False)
        article = above[3] or tag in ("article", "main") or found.get("role") in ("main", "article")
        noise = bool(names and tag not in ("html", "body", "main", "article") and (any(map(_NOISE_WITHIN.fullmatch, names.split())) if above[3] else _NOISE.search(names)))
        head = tag == "header" and above[3]  # an article's own head is part of it
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in _ROLE
        label = f"{above[1]}/{tag}" + (f".{re.sub(r'[0-9]+', '0', names)}" if names else "")
        if len(label) > 200:
            label = xxhash.xxh3_64_hexdigest(label)
        self.path.append((tag, label, above[2] or (tag in _OUTSIDE and not head) or noise or hidden, article))

    def _close(self, tag: str) -> None:
        if tag in _INLINE:
            return
        self._flush()
        if tag in _LOOSE:
            return
        for k in range(len(self.path) - 1, -1, -1):
            if self.path[k][0] == tag:
                del self.path[k:]
                self._count("/" + tag)
                return

    def _flush(self) -> None:
        if self._text:
            joined = "".join(self._text)
            self._text = []
            text = " ".join((_html.unescape(joined) if "&" in joined else joined).split())
            if text:
                _, label, outside, article = self.path[-1] if self.path else ("", "", False, False)
                token = "=" + xxhash.xxh3_64_hexdigest(f"{label}={text}")
                self.blocks.append((text, token, outside, article))
                if not outside:
                    self.order.append((token, int(token[1:], 16)))

    def tokens(self) -> dict[str, int]:
        """Counts of structural tokens and of the texts of blocks outside menus and the like."""
        return Counter(token for token, _ in self.order)

    def places(self, classes: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int, int]]:
        """By token of the given classes: its rank in its class (-1 if unsettled) and the least and largest digest of the slot after it.

        ``classes`` has each token's class and the number of tokens in that. The
        tokens of a class take turns on a page; one that has not the same place in every
        turn has no rank, nor have those of a class whose turns cross another's. Of
        two that cross the smaller one is at fault.
        """
        seen: dict[int, list[tuple[str, int, int]]] = {}  # by class: token, texts before, texts up to its end
        sums, crossed, open_turns = 0, set(), []
        for token, digest in self.order:
            before, sums = sums, sums + digest
            if token not in classes:
                continue
            kind, size = classes[token]
            turn = seen.setdefault(kind, [])
            at = len(turn) % size
            turn.append((token, before, sums))
            if size == 1:
                continue
            if at and (kind, size) in open_turns:
                while open_turns[-1][0] != kind:
                    other = open_turns.pop()
                    crossed.add(min((other[1], other[0]), (size, kind))[1])
            else:
                open_turns.append((kind, size))
            if at == size - 1:
                open_turns.pop()
        out: dict[str, tuple[int, int, int]] = {}
        for kind, turn in seen.items():
            for k, (token, _, end) in enumerate(turn):
                size = classes[token][1]
                rank = -1 if kind in crossed else k % size
                slot = (turn[k + 1][1] - end) % (1 << 63) if rank + 1 < size and k + 1 < len(turn) else 0
                known = out.get(token, (rank, slot, slot))
                out[token] = (rank if known[0] == rank else -1, min(known[1], slot), max(known[2], slot))
        return out


def main_text(page: Page, template: set[str]) -> str:
    """The open slots of a page outside menus, notices and the like, in page order.

    An article or main element holds the text if there is one with text; else
    all other blocks do. Texts that belong to the template are left out, unless
    the page has no others: then nothing tells its text from the template.
    """
    inside = [b for b in page.blocks if not b[2]]
    within = [b for b in inside if b[3]] or inside
    return " ".join([b[0] for b in within if b[1] not in template] or [b[0] for b in within])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: for each (host, token) its distinct pages, occurrences and the sums that digest its vector.

    Each of n equal pages counts as 1 / n of a page.
    """
    tally: dict[tuple[str, str], list[float]] = {}
    for batch in batches:
        for key, host, source, copies in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), batch.column(3).to_pylist()):
            seen = Page(source.as_py() or "").tokens()
            seen[""] = 1
            for token, n in seen.items():
                mark = xxhash.xxh3_64_intdigest(f"{key}:{n}".encode())
                row = tally.setdefault((host, token), [0, 0, 0, 0])
                row[0] += 1 / copies
                row[1] += n
                row[2] += mark & 0xFFFFFFFF
                row[3] += mark >> 32
        if len(tally) > _TALLY:
            yield _tallied(tally)
            tally = {}
    if tally:
        yield _tallied(tally)


def _tallied(tally: dict[tuple[str, str], list[float]]) -> pa.RecordBatch:
    cols = [pa.array([k[i] for k in tally], pa.string()) for i in range(2)]
    cols += [pa.array([v[i] for v in tally.values()], kind) for i, kind in enumerate((pa.float64(), *[pa.int64()] * 3))]
    return pa.record_batch(cols, names=["host", "token", "pages", "occurs", "low", "high"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: for each (host, token, rank) of the hosts' classes its pages, and the least and largest digest of the slot after it."""
    tally: dict[tuple[str, str, int], list[float]] = {}
    known: dict[str, dict[str, tuple[int, int]]] = {}
    for batch in batches:
        for host, source, tokens, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
            if host not in known:
                if len(known) > 10_000:
                    known.clear()
                known[host] = {t["token"]: (t["class"], t["size"]) for t in tokens.as_py()}
            for token, (rank, low, high) in Page(source.as_py() or "").places(known[host]).items():
                row = tally.setdefault((host, token, rank), [0, low, high])
                row[0] += 1 / copies
                row[1], row[2] = min(row[1], low), max(row[2], high)
        if len(tally) > _TALLY:
            yield _placed(tally)
            tally = {}
    if tally:
        yield _placed(tally)


def _placed(tally: dict[tuple[str, str, int], list[float]]) -> pa.RecordBatch:
    cols = [pa.array([k[i] for k in tally], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
    cols += [pa.array([v[i] for v in tally.values()], kind) for i, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
    return pa.record_batch(cols, names=["host", "token", "rank", "pages", "low", "high"])


def _held(found: DataFrame) -> DataFrame:
    """``found`` by host, broadcast if its tokens are few."""
    return F.broadcast(found) if row_count_at_most(found.select(F.explode("tokens")), BROADCAST_TOKENS) else found


def classes(pages: DataFrame) -> DataFrame:
    """(host, tokens): token, class, size of its class and pages of the equivalence classes that stand on ``SHARE`` of the host's distinct pages."""
    sums = (
        pages.mapInArrow(_vectors, "host string, token string, pages double, occurs long, low long, high long")
        .groupBy("host", "token")
        .agg(F.round(F.sum("pages"), 6).alias("pages"), *[F.sum(c).alias(c) for c in ("occurs", "low", "high")])
    )
    total = sums.where("token = ''").select("host", F.col("pages").alias("total")).where(F.col("total") >= LEAST_PAGES)
    frequent = sums.where((F.col("token") != "") & (F.col("pages") >= SHARE * LEAST_PAGES)).join(total, "host").where(F.col("pages") >= SHARE * F.col("total"))
    grouped = frequent.groupBy("host", "occurs", "low", "high").agg(F.collect_set("token").alias("names"), F.max("pages").alias("pages"))
    rows = grouped.select("host", F.explode("names").alias("token"), F.xxhash64("occurs", "low", "high").alias("class"), F.size("names").alias("size"), "pages")
    return rows.groupBy("host").agg(F.collect_list(F.struct("token", "class", "size", "pages")).alias("tokens"))


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, tokens): the texts of each host's valid equivalence classes.

    A token stays in its class if it has one rank there, in turns that nest, on ``SETTLED`` of
    the class's pages. A class is valid if two tokens or more stay, one of them a tag, and
    the slot after one of them varies: a text is never template by its own frequency.
    """
    found = scratch.save(classes(pages), "classes")
    placed = (
        pages.join(_held(found), "host").select("host", "html", "tokens", "copies")
        .mapInArrow(_places, "host string, token string, rank long, pages double, low long, high long")
        .where("rank >= 0")
        .groupBy("host", "token", "rank")
        .agg(F.round(F.sum("pages"), 6).alias("settled"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    tokens = found.select("host", F.explode("tokens").alias("t")).select("host", "t.*")
    stay = placed.join(tokens, ["host", "token"]).where(F.col("settled") >= SETTLED * F.col("pages"))
    return (
        stay.groupBy("host", "class")
        .agg(F.collect_set("token").alias("names"), F.max(F.col("low") < F.col("high")).alias("varies"))
        .where(F.col("varies") & (F.size("names") >= 2) & F.exists("names", lambda t: ~t.startswith("=")))
        .select("host", F.explode("names").alias("token"))
        .where(F.col("token").startswith("="))
        .groupBy("host")
        .agg(F.collect_set("token").alias("tokens"))
    )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, set[str]] = {}
    for batch in batches:
        out = []
        for host, source, tokens in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
            if host not in known:
                if len(known) > 10_000:
                    known.clear()
                known[host] = set(tokens.as_py() or ())
            out.append(main_text(Page(source.as_py() or ""), known[host]))
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (empty if none) and n_chars, its code points.

    Null and empty html give an empty text. Character references are decoded
    once, white space inside a block becomes one space, blocks are joined by one.
    Broken markup is read as far as it goes: what is not closed ends with its
    container. Null urls share the empty host; repeated rows give equal rows;
    no pages give no rows; other columns are ignored; a long page is one row in one task.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        host_of(F.col("url")).alias("host"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    keyed = own.select("host", "html", F.xxhash64("html").alias("key"))
    copied = scratch.save(keyed.groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1"), "copied")
    few = row_count_at_most(copied, BROADCAST_TOKENS)
    counted = keyed.join(F.broadcast(copied) if few else copied, ["host", "key"], "left").select("key", "host", "html", F.coalesce("n", F.lit(1)).alias("copies"))
    found = _held(scratch.save(templates(counted, scratch), "templates"))
    return own.join(found, "host", "left").select("page_id", "url", "host", "html", "tokens").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )

"""Secret scan: base patterns, and multipart credentials linked within scopes.

Access identifiers, secret-like strings and endpoints each say little alone.
A weak candidate is reported only when a complementary part stands within the
same scope: an interval join of sorted positions decides that by bisection,
never by listing pairs, so a text full of candidates costs n log n.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
BASE = ("assign", "access", "hex")

#: Code points between complementary parts; a blank line ends a scope too.
SCOPE = 400
_BLANK = re.compile(r"\n[ \t]*\n")
_ENDPOINT = re.compile(r"""(?:https?|s3|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|\b(?:endpoint|host|server|bucket)\b["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}[^\s"'<>,;]*""", re.I | re.A)
_IDENTIFIER = re.compile(r"""\b(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)\b["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
_DENSE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{32,128}={0,2}(?![A-Za-z0-9+/=_-])")
_MIXED = tuple(re.compile(c) for c in ("[0-9]", "[a-z]", "[A-Z]"))
# From six characters on; for keywords of a base pattern up to the length it takes.
_SHORT = re.compile(r"""(?:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,11}|(?:pwd|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,})(?![A-Za-z0-9+/_.=-])""", re.I | re.A)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern, by start and then by kind."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


def _near(parts: list[Span], others: list[Span], scopes: list[int]) -> list[Span]:
    """Those of ``parts`` with another of ``others`` in their scope: an interval semi-join over sorted starts.

    The two furthest ends of different spans up to each start tell, in one look, whether
    any span before a scope's end reaches into it.
    """
    spans = sorted({(s[1], s[2]) for s in others})
    starts = [a for a, _ in spans]
    furthest: list[tuple[tuple[int, int], ...]] = [()]
    for span in spans:
        furthest.append(tuple(sorted((*furthest[-1], span), key=lambda x: -x[1])[:2]))
    out = []
    for kind, start, end in parts:
        at = bisect_right(scopes, start)
        low = max(scopes[at - 1] if at else 0, start - SCOPE)
        high = min(scopes[at] if at < len(scopes) else 1 << 62, end + SCOPE)
        if any(b > low and (a, b) != (start, end) for a, b in furthest[bisect_left(starts, high)]):
            out.append((kind, start, end))
    return out


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only their company makes credible: weak secrets, identifiers and endpoints.

    A weak secret needs an access identifier or an endpoint in its scope; an
    identifier or endpoint is reported as part of a credential when a secret,
    strong or weak and itself reported, is in its scope. Spans that overlap a base
    span are left out, as are texts without any secret or access identifier.
    """
    weak = [("weak_secret", m.start(), m.end()) for m in _DENSE.finditer(text) if all(c.search(m[0]) for c in _MIXED)]
    low = text.lower()
    if any(k in low for k in ("passw", "pwd", "secret", "token", "api", "auth")):
        short = [("weak_secret", m.start(), m.end()) for m in _SHORT.finditer(text)]
        weak = short + _apart(weak, [(a, b) for _, a, b in short])
    if not weak and not base:
        return []
    taken = sorted((a, b) for _, a, b in base)
    weak = _apart(sorted(set(weak), key=lambda s: s[1]), taken)
    access = [s for s in base if s[0] == "access"]
    strong = [s for s in base if s[0] != "access"]
    names = _apart([("identifier", m.start(), m.end()) for m in _IDENTIFIER.finditer(text)], taken)
    ends = _apart([("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)], taken)
    scopes = [m.end() for m in _BLANK.finditer(text)]
    weak = _near(weak, access + names + ends, scopes)
    secrets = strong + weak
    return sorted(weak + _near(names, secrets, scopes) + _near(ends, secrets, scopes), key=lambda s: (s[1], s[0], s[2]))



def _apart(parts: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Those of ``parts`` that overlap none of the sorted intervals ``taken``."""
    starts = [a for a, _ in taken]
    reach, top = [], 0
    for _, b in taken:
        top = max(top, b)
        reach.append(top)
    return [s for s in parts if (k := bisect_left(starts, s[2])) == 0 or reach[k - 1] <= s[1]]


def scan(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, linked_spans(text, base)


def _spell(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, spelled = [], [], []
        for text in batch.column(1):
            base, more = scan(text.as_py() or "")
            counts.append([sum(s[0] == k for s in base) for k in BASE])
            digests.append(hashlib.sha256(_spell(base).encode()).hexdigest())
            order = {k: i for i, k in enumerate((*BASE, "endpoint", "identifier", "weak_secret"))}
            spelled.append(_spell(sorted(base + more, key=lambda s: (s[1], order[s[0]], s[2]))))
        cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
        yield pa.record_batch(
            [batch.column(0), *cols, pa.array(digests, pa.string()), pa.array(spelled, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and
    kind. Null and empty texts have none, the digest is then that of the empty
    string. Repeated rows give equal rows; an empty table an empty result; other
    columns are ignored. A long text full of candidates costs n log n.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(_scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

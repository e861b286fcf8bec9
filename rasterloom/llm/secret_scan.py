"""Secret scans with multipart credential linking.

Base spans come from three patterns. Linking adds spans: parts of credentials are
access identifiers, endpoints, and weak secret candidates (values that a name like
password stands before but that are no base spans, and tokens that nothing names).
Whether a candidate is a secret is told by the parts near it, not by its length. Parts are joined by interval: each part covers `reach` code points to
either side within its scope (a paragraph), and a weak candidate is reported, with every
identifier, user name and endpoint whose interval meets it, only where a user name and
an endpoint, or an access key's identifier, cover it. Intervals are sorted, and what
meets a candidate is a range of them; a sweep marks the ranges, so the work of a
document follows its parts, not their pairs. Each document is judged in its own task.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: In the order in which kinds of one start are listed.
KINDS = ["assign", "access", "hex", "link_id", "link_secret", "link_endpoint"]
_USER = re.compile(r"""\b(?:user(?:name)?|login|client_?id|account(?:_?(?:id|name))?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
_ENDPOINT = re.compile(r"\b(?:https?|ftp|sftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[^\s\"'<>]{3,}", re.ASCII)
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,}+={0,2}+(?![A-Za-z0-9+/_=-])", re.ASCII)
_SECRET_NAME = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: A name that a further name follows has no value of its own.
_NAMED_WEAK = re.compile(_SECRET_NAME + r"""\x20*["']?(?!""" + _SECRET_NAME + r""")([^\s"'<>,;&]+)""", re.IGNORECASE | re.ASCII)
_SCOPE = re.compile(r"\n[\x20\t]*\n")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAMED = ("user", "login", "client", "account", "access")
REACH = 300

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the three patterns, each kind's leftmost ones without overlap, less those that are too short."""
    out: list[Span] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _drawn(token: str) -> bool:
    """Whether an unnamed token can be a secret rather than words: letters and digits, or, from 20 characters on, one unbroken run or letters of both cases."""
    digit, lower, upper = (any(map(f, token)) for f in (str.isdigit, str.islower, str.isupper))
    return digit and (lower or upper) or len(token) >= 20 and (lower and upper or token.rstrip("=").isalnum())


class _Parts:
    """Spans of one kind, sorted and without overlap, and marks of those that meet a candidate."""

    def __init__(self, spans: list[Span]):
        self.spans, self.starts, self.ends = spans, [s[1] for s in spans], [s[2] for s in spans]
        self.steps = [0] * (len(spans) + 1)

    def meeting(self, low: int, high: int, left: int, right: int) -> tuple[int, int]:
        """The range of spans that begin in the scope low..high and overlap left..right."""
        a = max(bisect_left(self.starts, low), bisect_right(self.ends, left))
        return a, max(a, bisect_left(self.starts, min(high, right)))

    def holds_more(self, a: int, b: int) -> bool:
        """Whether one span holds a..b and more."""
        i = bisect_right(self.starts, a) - 1
        return i >= 0 and b <= self.ends[i] and (a, b) != self.spans[i][1:]

    def mark(self, a: int, b: int, by: int = 1) -> None:
        self.steps[a] += by
        self.steps[b] -= by

    def marked(self) -> list[Span]:
        return [s for s, n in zip(self.spans, accumulate(self.steps)) if n]


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Spans of weak candidates that complementary parts cover, and of those parts. Tokens inside base spans are told already."""
    maybe = "://" in text or any(k == "access" for k, _, _ in base)
    if not maybe:
        return []
    taken = sorted((a, b) for _, a, b in base)
    begins, reached = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

    def free(a: int, b: int) -> bool:
        """Whether no base span overlaps: of those that begin before b, the farthest end lies at a or before."""
        n = bisect_left(begins, b)
        return not n or reached[n - 1] <= a

    low = text.lower()
    keys = [("link_id", a, b) for k, a, b in base if k == "access"]
    users = [("link_id", *m.span(1)) for m in _USER.finditer(text)] if any(n in low for n in _NAMED) else []
    points = [("link_endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    tables = [_Parts(spans) for spans in (keys, users, points)]
    named = [("link_secret", *m.span(1)) for m in _NAMED_WEAK.finditer(text) if free(*m.span())] if any(n in low for n in _NAMES) else []
    told = [_Parts(named), tables[2]]
    tokens = [m.span() for m in _WEAK.finditer(text) if _drawn(m[0]) and free(*m.span())]
    tokens = [(a, b) for a, b in tokens if not any(y > x for x, y in (t.meeting(0, b, a, b) for t in told)) and not tables[1].holds_more(a, b)]
    weak = [s[1:] for s in named] + tokens
    if not weak:
        return []
    cuts = [0, *(m.end() for m in _SCOPE.finditer(text)), len(text) + 1]
    out: set[Span] = set()
    for a, b in weak:
        i = bisect_left(cuts, a + 1)
        met = [t.meeting(cuts[i - 1], cuts[i], a - reach, b + reach) for t in tables]
        own = tables[1].meeting(cuts[i - 1], cuts[i], a, b)  # a user name that is the candidate itself is no complement of it
        key, point = (met[k][1] > met[k][0] for k in (0, 2))
        user = met[1][1] - met[1][0] > own[1] - own[0]
        if key or user and point:
            out.add(("link_secret", a, b))
            for t, (x, y) in zip(tables, met):
                t.mark(x, y)
            tables[1].mark(*own, -1)
    out.update(s for t in tables for s in t.marked())
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def listed(spans: list[Span]) -> str:
    """kind:start:end by start, then kind, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, spans: array of kind, start, end, and whether of the base) of every row.

    Positions are code points, ends exclusive. A null text is empty and has no spans; a
    long one is read whole, in time that follows its length and parts; repeated rows give
    repeated results; further columns, also one named spans, are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                found = []
                for text in part.column("text").to_pylist():
                    base = base_spans(text or "")
                    more = linked_spans(text or "", base, reach)
                    spans = sorted([(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in more], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                    found.append([dict(zip(("kind", "start", "end", "base"), s)) for s in spans])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of each base kind, the hash of the base spans' list, and the list of all."""
    listing = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))

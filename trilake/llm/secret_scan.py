"""Secret scans: known shapes, and sliding-window Shannon entropy per character class."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from trilake.llm.common import map_texts

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: A text without any of these has no assignment; the search for them is much faster.
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Strings in which the method looks for random parts.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character classes and the bits per character from which a window of them counts as random.
CLASSES = (
    (frozenset("0123456789abcdef"), 3.4),
    (frozenset("0123456789ABCDEF"), 3.4),
    (frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"), 3.9),
)
#: Candidates, and segments of them, that match one of these are no secrets: identifiers, numbers, repeated fillers.
ALLOWED = tuple(
    map(
        re.compile,
        (
            r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
            r"[0-9+/_=-]+",
            r"(.{1,4})\1{3,}.{0,4}",
        ),
    )
)
#: The parts of paths and assignments, and the words that mark one of them as made up. A
#: longer segment is no name or filler, and a word within it says nothing about the rest.
SEGMENT = re.compile(r"[^/=]{%d,}" % WINDOW)
MADE_UP = re.compile(r"example|sample|placeholder|changeme|lorem", re.IGNORECASE)
MADE_UP_MOST = 64
#: c * log2(c) for the counts within a window.
WEIGHT = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def random_spans(text: str, members: frozenset, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """The union of the windows of `members` only with at least `least` bits per character.

    Moving a window by one changes the counts of two characters, and with them the sum of
    c * log2(c), from which the entropy follows: log2(window) - sum / window.
    """
    weight = WEIGHT if window == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = window * (math.log2(window) - least) + 1e-9
    spans: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total, run = 0.0, 0
    for i, c in enumerate(text):
        if c not in members:
            counts, total, run = {}, 0.0, 0
            continue
        if run == window:
            out = text[i - window]
            k = counts[out]
            total += weight[k - 1] - weight[k]
            counts[out] = k - 1
        else:
            run += 1
        k = counts.get(c, 0)
        total += weight[k + 1] - weight[k]
        counts[c] = k + 1
        if run == window and total <= most:
            start = i + 1 - window
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known shapes, leftmost and not overlapping within a kind."""
    spans = []
    lower = text.lower()
    if any(word in lower for word in ASSIGNED):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    return spans + [(*m.span(), "hex") for m in HEX.finditer(text)]


def _searched(text: str) -> list[tuple[int, int]]:
    """The candidate strings without their allowed segments."""
    allowed = lambda part: any(a.fullmatch(part) for a in ALLOWED)
    parts = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        if allowed(m[0]):
            continue
        for s in SEGMENT.finditer(text, m.start(), m.end()):
            if allowed(s[0]) or (len(s[0]) <= MADE_UP_MOST and MADE_UP.search(s[0])):
                parts.append((at, s.start()))
                at = s.end()
        parts.append((at, m.end()))
    return [(a, b) for a, b in parts if b - a >= WINDOW]


def entropy_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Random parts of candidate strings that no base span holds and no allow-list suppresses."""
    found: set[tuple[int, int]] = set()
    for start, end in _searched(text):
        for members, least in CLASSES:
            found |= {(start + a, start + b) for a, b in random_spans(text[start:end], members, least)}
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return [(a, b, "entropy") for a, b in merged if not any(x <= a and b <= y for x, y, _ in base)]


def in_order(spans: list[tuple[int, int, str]]) -> list[str]:
    return [f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))]


def scan(text: str) -> tuple:
    base = base_spans(text)
    kinds = [kind for _, _, kind in base]
    digest = hashlib.sha256(",".join(in_order(base)).encode()).hexdigest()
    return (*map(kinds.count, KINDS[:3]), digest, in_order(base + entropy_spans(text, base)))


FOUND = StructType(
    [StructField(f"n_{kind}", LongType()) for kind in KINDS[:3]]
    + [StructField("base_sha256", StringType()), StructField("found", ArrayType(StringType()))]
)


def secrets(docs: DataFrame) -> DataFrame:
    """What looks like a secret in each text: doc_id, n_assign, n_access, n_hex, base_sha256, found.

    found: kind:start:end of every span, by start, then kind; code points, end exclusive.
    Base kinds are always there; `entropy` spans come on top where no base span holds them.

    Null and empty texts hold none. Texts are searched whole, whatever their length.
    Repeated rows are judged alike; other columns are ignored; no rows give none.
    """
    return map_texts(docs.select("doc_id", "text"), "text", lambda texts: [scan(t.decode("utf-8", "replace")) for t in texts], FOUND)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """doc_id and the text with every span replaced by `mask`."""

    def masked(raw: bytes) -> tuple[str]:
        text = raw.decode("utf-8", "replace")
        base = base_spans(text)
        out, at = [], 0
        for a, b, _ in sorted(base + entropy_spans(text, base)):
            if b > at:
                out += [text[at : max(a, at)], mask] if a >= at else []
                at = b
        return ("".join(out) + text[at:],)

    schema = StructType([StructField("text", StringType())])
    return map_texts(docs.select("doc_id", "text").withColumnRenamed("text", "_t"), "_t", lambda texts: [masked(t) for t in texts], schema)

"""Quality rules: how much of a text repeats within it, by a suffix array over words.

Suffixes of words are sorted by prefix doubling for a block of texts at once; the ranks
of each doubling step give the longest common prefix (LCP) of neighbours. An LCP interval
is a maximal repeated run of words; the union of all of them is what repeats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trilake.llm.common import filter_texts, map_texts

MIN_WORDS = 10
#: A repeat counts from this many words on.
WINDOW = 5
#: Limits of what passes: percent of the words that lie in repeats, words of the longest repeat.
MAX_PERCENT = 20
MAX_LONGEST = 100
SYMBOLS = b"#*$%&|<>"
#: Words whose suffixes are sorted together; a longer text is a block of its own.
BLOCK_WORDS = 400_000

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]
SCHEMA = StructType([StructField(c, LongType()) for c in COLUMNS])


def longest_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run of words that starts there and
    occurs elsewhere in the same text.

    `words`: number of each word; `text`: number of its text, not decreasing.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    end = np.searchsorted(text, text, "right")
    rank, group = _ranks(text.astype(np.int64) * (int(words.max()) + 1) + words, np.zeros(n, np.int64))
    levels, width = [rank], 1
    active = np.flatnonzero(group[rank] > 1)
    while len(active):
        follower = active + width
        inside = follower < end[active]
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[follower[inside]] + 1
        first = rank[active]
        sub, size = _ranks(first * (n + 1) + second, first)
        rank = rank.copy()
        rank[active] = sub
        levels.append(rank)
        active = active[size[sub] > 1] if len(size) else active[:0]
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)  # lcp[i]: of the suffixes at places i - 1 and i
    pair = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b, common = order[pair - 1], order[pair], np.zeros(len(pair), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        left, right = a + common, b + common
        fits = np.flatnonzero((left < end[a]) & (right < end[b]))
        same = fits[levels[level][left[fits]] == levels[level][right[fits]]]
        common[same] += 1 << level
    lcp[pair] = common
    longest = np.empty(n, np.int64)
    longest[order] = np.maximum(lcp[:-1], lcp[1:])
    return longest


def _ranks(keys: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key, and how many keys have a rank, by rank.

    A rank is the place of the first of all equal keys in sorted order; where the keys
    refine classes of an earlier order, `base` is the rank of the class.
    """
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    class_base = base[order[starts]]
    # classes come in the order of their base, so a class starts where its base changes
    first = np.r_[True, class_base[1:] != class_base[:-1]]
    class_start = np.maximum.accumulate(np.where(first, starts, 0))
    ranks = class_base + starts - class_start
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(ranks, sizes)
    count = np.zeros(int(ranks.max()) + 1, np.int64)
    count[ranks] = sizes
    return out, count


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least `least` words."""
    at = np.flatnonzero(length >= least)
    depth = np.zeros(len(length) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + length[at], -1)
    return np.cumsum(depth[:-1]) > 0


def measure(texts: list[bytes]) -> list[tuple[int, ...]]:
    """The columns of ``COLUMNS`` for each text."""
    out: list[tuple[int, ...]] = []
    block: list[list[bytes]] = []
    waiting: list[tuple[int, int, int, int]] = []
    size = 0
    for raw in texts:
        words = raw.split()
        seen: set[bytes] = set()
        repeated = 0
        for line in raw.split(b"\n"):
            if line in seen:
                repeated += bool(line.strip())
            else:
                seen.add(line)
        joined = b"".join(words)
        symbols = len(joined) - len(joined.translate(None, SYMBOLS))
        waiting.append((len(words), len(joined.decode("utf-8", "replace")), symbols, repeated))
        block.append(words)
        size += len(words)
        if size >= BLOCK_WORDS:
            out += [w + r for w, r in zip(waiting, _repeats(block))]
            block, waiting, size = [], [], 0
    return out + [w + r for w, r in zip(waiting, _repeats(block))]


def _repeats(block: list[list[bytes]]) -> list[tuple[int, int]]:
    """Words in repeats and words of the longest repeat, for each list of words."""
    lengths = np.array([len(words) for words in block], np.int64)
    length = longest_repeats(*_numbered(block, lengths))
    inside = np.r_[0, np.cumsum(covered(length, WINDOW))]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    most = np.zeros(len(block), np.int64)
    full = np.flatnonzero(lengths)
    if len(full):
        most[full] = np.maximum.reduceat(length, starts[full])
    return list(zip((inside[ends] - inside[starts]).tolist(), most.tolist()))


def _numbered(block: list[list[bytes]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    numbers: dict[bytes, int] = {}
    flat = [numbers.setdefault(w, len(numbers)) for words in block for w in words]
    return np.array(flat, np.int64), np.repeat(np.arange(len(block)), lengths)


def repeated_spans(text: str, least: int = WINDOW) -> list[tuple[int, int]]:
    """The spans of a text, in code points, that repeats of at least `least` words cover."""
    import re

    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    numbers: dict[str, int] = {}
    codes = np.array([numbers.setdefault(text[a:b], len(numbers)) for a, b in words], np.int64)
    inside = covered(longest_repeats(codes, np.zeros(len(codes), np.int64)), least)
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    return [(words[a][0], words[b - 1][1]) for a, b in edges.reshape(-1, 2).tolist()]


def passes(n_words: int, n_repeat_words: int, longest_repeat: int) -> bool:
    return n_words >= MIN_WORDS and 100 * n_repeat_words <= MAX_PERCENT * n_words and longest_repeat <= MAX_LONGEST


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id, the columns of ``COLUMNS``, base_failed and kept, for each row of `docs`.

    n_repeat_words: words in runs of at least ``WINDOW`` words that occur twice or more
    in the text, overlapping ones too; longest_repeat: words of the longest run that
    occurs twice. Kept: at least ``MIN_WORDS`` words, at most ``MAX_PERCENT`` percent in
    repeats, and no repeat of more than ``MAX_LONGEST`` words.

    Null and empty texts have no words and fail. A text longer than a block is sorted
    alone. Repeated rows are judged alike; other columns are ignored; no rows give none.
    """
    measured = map_texts(docs.select("doc_id", "text"), "text", measure, SCHEMA)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("longest_repeat") <= MAX_LONGEST))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules of `repetition` keep, in all their columns."""
    return filter_texts(docs, "text", lambda texts: [passes(m[0], m[4], m[5]) for m in measure(texts)])

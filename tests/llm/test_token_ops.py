"""Packing, alignment of two tokenizers, and resampling against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trilake.llm import alignment, packing, registry, resampling, tokens

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "plain words, and  two spaces"), (1, "plain words, and  two spaces"), (2, None), (3, ""), (4, " "), (5, "\n\n x \t y"),
    (6, "x▁y"), (7, "<|endoftext|> in <|endoftext|>text"), (8, "日本 語 　 文"), (9, "naïve café’s 12345 \x00 \x85 end"),
    (None, "no id"), (None, "no id"), (10, "long words " * 6_000), (11, "=" * 5_000), (12, "a b   c's I'll"), (13, "é" * 3_000),
]
EXTRA = "doc_id long, text string, lang string, length long, chunk long, key string, score long, rank long, _cell long, copies long, bucket long"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en", 1, 2, "k", 3, 4, 5, 6, 7) for i, t in rows], EXTRA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tokenizer(special):
    made = Tokenizer.from_file(tokens.tokenizer_file(tokens.BYTE_BPE))
    made.encode_special_tokens = not special
    return made


@pytest.fixture(scope="module")
def both():
    return [(tokens.ByteBpe(special=s).load(), tokenizer(s)) for s in (True, False)]


def test_ids_of_all_plain_characters(both):
    plain = [chr(c) for c in range(0x2100) if tokens.PLAIN.fullmatch(chr(c))]
    texts = [t for c in plain for t in (f"a{c}b {c} 1{c}2", f"{c}{c} {c}  .{c}'s{c}", f" {c}\n{c}a")]
    for fast, slow in both:
        assert fast.fast is not None
        assert [fast(t).tolist() for t in texts] == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]


PARTS = ["a", "Wort", " ", "  ", "\n", "\t", "'s", "'LL", "<|endoftext|>", "\u2581", "é", "\u00a0", "\u3000", "日", "٣", "1", ".", "\x1c", "\x85", "\u200b", "😀"]


@given(st.lists(st.sampled_from(PARTS), max_size=14))
@settings(max_examples=400, deadline=None)
def test_ids_of_any_text(both, parts):
    text = "".join(parts)
    for fast, slow in both:
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_links_of_large_groups_are_counted_not_laid_out():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 300).astype(np.uint32), rng.integers(0, 4, 200).astype(np.uint32)
    ones, twos = [b"xx"] * 5, [b"xxx"] * 4  # ends meet at every sixth byte, all 600 of them
    small = alignment.Alignment(a, b, ones, twos, b"x" * 600)
    whole = alignment.Alignment(a, b, [b"x" * 600] + ones, twos, b"")
    assert small.measures() == (300, 200, 100, 600) and not len(whole.a) and not len(whole.b)
    one = alignment.Alignment(a, b[:1], ones, [b"x" * 600] * 4, b"x" * 600)
    expected = sorted(Counter(((int(x) << 32) + int(b[0])) for x in a).items())
    for most in (10, 10_000):
        alignment.LARGE_GROUP, before = most, alignment.LARGE_GROUP
        found = one.links()
        alignment.LARGE_GROUP = before
        assert list(zip(*(x.tolist() for x in found))) == expected


@given(st.lists(st.integers(1, 90), max_size=60), st.sampled_from([1, 7, 32]))
@settings(max_examples=200, deadline=None)
def test_assign_keeps_each_token_once(lengths, room):
    pieces = packing.assign(lengths, room)
    seen, used = defaultdict(list), defaultdict(list)
    for item, start, n, sequence, offset in pieces:
        seen[item] += range(start, start + n)
        used[sequence] += range(offset, offset + n)
    assert [sorted(seen[i]) for i in range(len(lengths))] == [list(range(n)) for n in lengths]
    assert all(sorted(u) == list(range(len(u))) and len(u) <= room for u in used.values())
    assert sorted(used) == list(range(-(-sum(lengths) // room)))


def test_assign_balances_cost():
    pieces = packing.assign([64] * 8 + [1] * 512, 128, 1.0, 1.0)
    cost = Counter()
    for _, _, n, sequence, _ in pieces:
        cost[sequence] += n + n * n
    assert len(cost) == 8 and len(set(cost.values())) == 1


def check_pieces(rows, texts):
    """Each id of each document in one piece; sequences without gaps; little padding."""
    plain = tokenizer(True)
    whole = Counter()
    for doc_id, text in texts:
        whole[(doc_id, tuple(plain.encode(text or "", add_special_tokens=False).ids) + (1,))] += 1
    # documents with one id and length are told apart by their pieces' ids; count pieces of each place
    have, need = Counter(), Counter()
    for r in rows:
        have[(r.doc_id, r.doc_tokens)] += r.length
    for (doc_id, ids), n in whole.items():
        need[(doc_id, len(ids))] += n * len(ids)
    assert have == need
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    sums = []
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        sums.append(sum(n for _, n in parts))
    assert max(sums) <= 2048
    return whole, sums


def test_packing_query(spark):
    rows = registry.QUERIES["op11_packing"](spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in documents(spark).collect()]
    whole, sums = check_pieces(rows, texts)
    ids = {doc_id: np.array(x, "<u4") for doc_id, x in whole}
    by_doc = defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, r.length))
    for doc_id, parts in by_doc.items():
        parts.sort()
        assert [s for s, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
    assert sum(2048 - s for s in sums) < 0.01 * sum(sums)


def test_packing_odd_rows_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_BYTES", 20_000)
    found = []
    for n in (1, 5):
        rows = packing.pack(odd(spark).repartition(n)).collect()
        whole, _ = check_pieces(rows, ODD)
        assert (2, (1,)) in whole and sum(r.length for r in rows) == sum(n * len(x) for (_, x), n in whole.items())
        found.append(sorted(rows, key=lambda r: (r.sequence_id, r.offset)))
    assert found[0] == found[1]
    assert packing.pack(odd(spark, [])).count() == 0


def test_packing_of_many_equal_rows_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_BYTES", 3_000)
    rows = packing.pack(odd(spark, [(None, "same words again")] * 4_000)).collect()
    check_pieces(rows, [(None, "same words again")] * 4_000)


# --- alignment


def by_hand(texts):
    """The contract of the alignment, text by text."""
    plain, pieces = tokenizer(False), sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_file(tokens.PIECE_BPE))
    names = {i: e for e, i in plain.get_vocab().items()}
    shown = [chr(b) for b in range(256)]
    extra = 0
    for b in range(256):
        if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b):
            shown[b] = chr(256 + extra)
            extra += 1
    byte = {c: b for b, c in enumerate(shown)}
    rows, counts = [], Counter()
    for doc_id, text in texts:
        linked, groups, a, b = [], [], [], []
        if text:
            a, b = plain.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            said_a = [bytes(byte[c] for c in names[i]) for i in a]
            said_b = [bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(said_a) == b"".join(said_b) == (" " + text).encode():
                a, b = [], []
            else:
                ends_a, ends_b = np.cumsum([len(x) for x in said_a]).tolist(), np.cumsum([len(x) for x in said_b]).tolist()
                cuts = sorted(set(ends_a) & set(ends_b))
                at_a, at_b = np.searchsorted(cuts, ends_a).tolist(), np.searchsorted(cuts, ends_b).tolist()
                inside = [([], []) for _ in cuts]
                for i, g in zip(a, at_a):
                    inside[g][0].append(i)
                for i, g in zip(b, at_b):
                    inside[g][1].append(i)
                for own, other in inside:
                    groups.append(",".join(map(str, own)) + "|" + ",".join(map(str, other)))
                    linked += [(x, y) for x in own for y in other]
        counts.update(set(linked))
        rows.append((doc_id, len(a), len(b), groups, linked))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (i, n_a, n_b, len(groups), len(linked), sum(counts[p] == best[p[0]] for p in linked), sum(counts[p] for p in linked), hexed(";".join(groups)) if n_a else "")
        for i, n_a, n_b, groups, linked in rows
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_alignment_query(spark):
    rows = registry.QUERIES["op12_alignment"](spark, SF)
    assert order(rows.select(*COLUMNS).collect()) == order(by_hand([(r.doc_id, r.text) for r in documents(spark).collect()]))


@pytest.mark.parametrize("chunk", [1, 1_000, 8 << 20])
def test_alignment_odd_rows_any_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    found = alignment.alignment(odd(spark)).select(*COLUMNS).collect()
    assert order(found) == order(by_hand(ODD))
    assert {r.doc_id for r in found if r.n_a == 0} == {2, 3, 6}


def test_alignment_of_nothing(spark):
    assert alignment.alignment(odd(spark, [])).count() == 0
    assert [tuple(r)[1:7] for r in alignment.alignment(odd(spark, [(1, None), (2, "")])).collect()] == [(0,) * 6] * 2


# --- resampling


def drawn_by_hand(texts, target, percent=5, least=20):
    def buckets(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]

    docs = [(i, *buckets(t)) for i, t in texts]
    source, goal = Counter(), Counter()
    for _, _, found in docs:
        source.update(found)
    for text in target:
        goal.update(buckets(text)[1])
    s_all, t_all = sum(source.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, found in docs:
        weight = sum(gain[b] for b in found)
        h = int(hexed(f"42:{'' if i is None else i}")[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(able[: len(able) * percent // 100], 1):
        row[4] = rank
    return [r[:5] for r in rows]


def test_resampling_query(spark):
    rows = registry.QUERIES["op13_resampling"](spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in documents(spark).collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert order(rows) == order(drawn_by_hand(texts, target))


SHOWN = ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("percent", [0, 5, 40, 100])
def test_resampling_odd_rows_and_ties(spark, percent, monkeypatch):
    monkeypatch.setattr(resampling, "CELLS", 3)
    texts = ODD + [(None, "same words " * 15)] * 40 + [(7, "same words " * 15)] * 40 + [(i, f"word {i} " * 30) for i in range(60)]
    target = ["Same words again", None, ""]
    goal = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, features long")
    found = []
    for n in (1, 4):
        rows = resampling.resample(odd(spark, texts).repartition(n), goal, percent)
        found.append(order(rows.select(*SHOWN).collect()))
    assert found[0] == found[1] == order(drawn_by_hand(texts, target, percent))


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(odd(spark, []), empty).count() == 0
    texts = [(i, f"some words {i} " * 20) for i in range(30)]
    assert order(resampling.resample(odd(spark, texts), empty).select(*SHOWN).collect()) == order(drawn_by_hand(texts, []))


@pytest.mark.parametrize("kind", ["spread", "ties", "outliers"])
def test_cutoff_by_brackets(spark, kind):
    values = {
        "spread": [(i * 7919) % 10_007 for i in range(3_000)],
        "ties": [i % 3 for i in range(3_000)],
        "outliers": [10**15, -(10**15), *range(2_000), *[1_000] * 1_000],
    }[kind]
    rows = spark.createDataFrame([(v,) for v in values], "score long")
    high = sorted(values, reverse=True)
    for place in (1, 2, 150, 1_500, len(values)):
        assert resampling.cutoff(rows, "score", place, bracket_rows=20) == high[place - 1]
    assert resampling.cutoff(rows, "score", len(values) + 1) is None


def test_cutoff_widens_a_bracket_that_misses(spark, monkeypatch):
    monkeypatch.setattr(resampling, "ACCURACY", 2)  # a sketch so coarse that brackets miss
    monkeypatch.setattr(resampling, "MARGIN", 1e-6)
    rows = spark.range(5_000).selectExpr("(id * 7919) % 5000 AS score")
    assert [resampling.cutoff(rows, "score", k, bracket_rows=50) for k in (1, 77, 2_500, 4_999)] == [4_999, 4_923, 2_500, 1]

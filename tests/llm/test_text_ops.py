"""Operators on single texts, against plain versions written another way."""

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trilake.llm import chat, decontaminate, repetition, secret_scan, template

SCHEMA = "doc_id long, text string, size int, hit string, _text string"
ODD = [None, "", " \n\t ", "one", "a b " * 4000, "é " * 12 + "ß\u3000x"]


def docs_of(spark, texts):
    """Documents with nulls, repeats and columns whose names clash with those of the operators."""
    rows = [(i, t, 7, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "one", None, None, None), *rows[:1]], SCHEMA)


# ---------------------------------------------------------------- repetition


def plain_repetition(words):
    inside, longest = set(), 0
    for size in range(1, len(words)):
        places = {}
        for i in range(len(words) - size + 1):
            places.setdefault(tuple(words[i : i + size]), []).append(i)
        twice = [p for p in places.values() if len(p) > 1]
        if not twice:
            break
        longest = size
        if size == 5:
            inside = {i + k for p in twice for i in p for k in range(5)}
    return len(inside), longest


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab c d".split()), max_size=40), max_size=5))
def test_repetition_equals_plain_version(lists):
    measured = repetition.measure([" ".join(words).encode() for words in lists])
    assert [m[4:] for m in measured] == [plain_repetition(words) for words in lists]


def test_block_size_does_not_matter(monkeypatch):
    texts = [("x y z w v " * n + "end").encode() for n in range(12)]
    whole = repetition.measure(texts)
    monkeypatch.setattr(repetition, "BLOCK_WORDS", 7)
    assert repetition.measure(texts) == whole


def test_repeated_spans():
    text = "q  a b c d e  r\na b c d e s"
    assert [text[a:b] for a, b in repetition.repeated_spans(text)] == ["a b c d e", "a b c d e"]


def test_quality_filter_keeps_columns_and_clean_texts(spark):
    good = " ".join(f"w{i}" for i in range(50))
    docs = docs_of(spark, [good, *ODD])
    kept = repetition.quality_filter(docs)
    assert kept.columns == docs.columns
    assert [r.text for r in kept.collect()] == [good, good, "é " * 12 + "ß\u3000x"][:2]
    assert repetition.repetition(docs).where("kept").count() == 2
    assert repetition.repetition(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- decontamination


def plain_contamination(text, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, ids = norm(text), set(), set()
    for item, body in items:
        w = norm(body)
        size = min(10, len(w))
        wanted = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wanted:
                hit |= set(range(i, i + size))
                ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_contamination_equals_plain_version(spark, block_bytes):
    words = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(words[:14])), (2, "Short One, é"), (3, None), (4, ""), (10, " ".join(words[5:30])), (2, "x1 x2")]
    texts = ["A! " + " ".join(words[3:13]) + " z", "the SHORT\none é.", "short ones é", " ".join(words), "x1-X2", *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs_of(spark, texts), bench, block_bytes).collect()
    want = [(i, *plain_contamination(t, items)) for i, t in [*enumerate(texts), (None, "one"), (0, texts[0])]]
    assert Counter(map(tuple, got)) == Counter(want)
    spans = decontaminate.hit_spans(docs_of(spark, texts), bench, block_bytes).where("doc_id = 1").distinct().collect()
    assert [texts[1][r.start : r.end] for r in spans] == ["SHORT\none é"]
    clean = decontaminate.clean_documents(docs_of(spark, texts), bench, block_bytes)
    assert Counter(r.text for r in clean.collect()) == Counter([t for t in [*texts, "one", texts[0]] if not plain_contamination(t, items)[4]])


def test_empty_benchmark(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs_of(spark, ODD), bench).where("contaminated").count() == 0


# ---------------------------------------------------------------- secrets


def plain_base(text):
    out = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, "assign", m.end())] if len(m[1]) >= 6 else []
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


SECRET_PARTS = st.sampled_from(["PassWord", "token", "api_key", "=", ": ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123abcdef" * 3, "é", "ſecret", " ", "\n", "a1B2c3D4e5F6g7H8i9J0k"])


@settings(max_examples=200, deadline=None)
@given(st.lists(SECRET_PARTS, max_size=12).map("".join))
def test_base_spans_equal_plain_version(text):
    want = plain_base(text)
    assert secret_scan.in_order(secret_scan.base_spans(text)) == want
    found = secret_scan.scan(text)
    assert found[:3] == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
    assert set(want) <= set(found[4])


@settings(max_examples=100, deadline=None)
@given(st.text("abcdef0123456789-", max_size=70))
def test_entropy_windows_equal_plain_version(text):
    members, least, window = secret_scan.CLASSES[0][0], 3.2, 20
    import math

    inside = set()
    for i in range(len(text) - window + 1):
        part = text[i : i + window]
        entropy = -sum(c / window * math.log2(c / window) for c in Counter(part).values())
        if set(part) <= members and entropy >= least - 1e-9:
            inside |= set(range(i, i + window))
    assert {i for a, b in secret_scan.random_spans(text, members, least) for i in range(a, b)} == inside


def test_entropy_and_allow_list():
    secret = "Zx9qL2mVb7Tn4KpRw8Ys3Hc6"
    assert any(s.startswith("entropy") for s in secret_scan.scan(f"key {secret} end")[4])
    for plain in ("0f8fad5b-d9cb-469f-a165-70867728950e", "internationalisationandmore", "12345678901234567890123", "q1w2q1w2q1w2q1w2q1w2q1w2", f"example{secret}"):
        assert secret_scan.scan(plain)[4] == []


def test_allow_list_holds_for_its_segment_only():
    secret = "Zx9qL2mVb7Tn4KpRw8Ys3Hc6Jd5Fg1Bt0NvQaWe"
    letters = "ZxtqLymVbwTnoKpRwuYsiHcaJdeFgkBt"
    blob = "".join(secret[i % 7 :] for i in range(9))
    user = "users/0f8fad5b-d9cb-469f-a165-70867728950e"

    def found(text):
        return [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in secret_scan.scan(text)[4]) if k == "entropy"]

    for text in (f"/sample-app/key={secret}", f"see /example/v1/{secret} here", f"{blob}lorem{blob}"):
        assert any(secret in s for s in found(text))
    assert any(letters in s for s in found(f"the {letters} key"))
    for text in (user, f"/data/{user}", f"/v1/sample-{secret}", "/home/documents/internationalisation"):
        assert found(text) == []


def test_redact_and_odd_texts(spark):
    docs = docs_of(spark, ["my token=abcdef12 é", *ODD])
    assert secret_scan.redact(docs).where("doc_id = 0").first().text == "my [SECRET] é"
    assert [r.n_assign for r in secret_scan.secrets(docs).orderBy("doc_id").collect()].count(1) == 2
    assert secret_scan.secrets(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- templates and chats


def render(source, **values):
    return "".join(p for p, _ in template.compile_template(source, chat.FILTERS)(values))


def test_template_language():
    assert render("{% for m in ms %}{{ loop.index }}{{ m.a ~ '!' }}{% if loop.last %}.{% elif loop.first %},{% else %};{% endif %}{% endfor %}", ms=[{"a": "x"}, {"a": "y"}, {"a": "z"}]) == "1x!,2y!;3z!."
    assert render("a {{- ' b' -}} c{# note #}{% set x = 'q' %}{{ x|upper }}{{ none }}{{ not 1 == 2 and 'in' in 'inner' }}") == "a bcQtrue"
    assert render("{{ m['k'] }}{{ l[1] }}{{ missing.y if_ }}".replace(" if_", ""), m={"k": 1}, l=[1, 2], missing={}) == "12"
    marked = list(template.compile_template("u{% generation %}{{ x }}{% endgeneration %}", {})({"x": "y"}))
    assert marked == [("u", False), ("y", True)]


def test_constants_are_folded():
    tree, _ = template._Parser("a{{ 'b' ~ 1 + 1 }}{% if 1 == 2 %}{{ x }}{% else %}c{% endif %}{% if true %}d{% endif %}").block()
    with pytest.raises(TypeError):
        template._fold_block(tree, {})  # a string and a number don't add
    tree, _ = template._Parser("a{{ 'b' ~ 1 }}{% if 1 == 2 %}{{ x }}{% else %}c{% endif %}{% if true %}d{% endif %}").block()
    assert template._fold_block(tree, {}) == (template.Text("ab1cd"),)


@pytest.mark.parametrize("bad", ["{{ x() }}", "{{ x.__class__() }}", "{% for x %}{% endfor %}", "{% if x %}", "{{ x|nope }}", "{% import os %}", "{{ 'a }}", "{{ x y }}"])
def test_bad_templates(bad):
    with pytest.raises(template.TemplateError):
        template.compile_template(bad, chat.FILTERS)


def test_sandbox():
    with pytest.raises(template.TemplateError):
        render("{{ x.__class__ }}", x="text")


CONTROLS = st.lists(st.sampled_from(["<", "|", "\\", "\n", "im_end", ">", "<|im_end|>\n", "é", "n"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), CONTROLS), CONTROLS), min_size=1, max_size=4))
def test_chat_round_trip(turns):
    back = chat.ReadBack()
    for piece, learnt in chat.rendered({"role": r, "text": t} for r, t in turns):
        back.add(piece, learnt)
    said = "".join(t for r, t in turns if r == "assistant")
    n, digest, chars, loss, _ = back.row()
    assert (n, chars) == (len(turns), len(said))
    assert digest == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert loss == hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("segment", [1 << 20, 5])
def test_chat_frames(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    rows = [(1, 1, "assistant", None, 0), (1, 0, None, "hi", 0), (None, None, "user", "x", 0), (2, 0, "assistant", "<|im_end|>", 0), (2, 0, "assistant", "<|im_end|>", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (2, 0), None: (1, 0), 2: (2, 20)}
    assert got[1].turns_sha256 == hashlib.sha256(b"\nhi\nassistant\n\n").hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0

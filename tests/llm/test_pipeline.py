"""The pipeline against brute-force versions of its filtering stages."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_corpus_ops import plain_components, plain_print  # noqa: E402
from test_text_ops import plain_contamination, plain_repetition  # noqa: E402

from trilake.llm.common import table  # noqa: E402


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}

    def good(text):
        words = text.encode().split()
        n, longest = plain_repetition(words)
        return len(words) >= 10 and 100 * n <= 20 * len(words) and longest <= 100

    quality, near, clean, mix, shards = [stage for _, stage in corpus_pipeline.STAGES]
    kept = quality(spark, docs, sf_dir)
    want = {d: t for d, t in rows.items() if good(t)}
    assert {r.doc_id for r in kept.collect()} == set(want)
    single = near(spark, kept, sf_dir)
    ids = sorted(want)
    groups = plain_components(ids, [plain_print(want[d]) for d in ids])
    want = {d: want[d] for d, c in zip(ids, groups) if d == c}
    assert sorted(r.doc_id for r in single.collect()) == sorted(want)
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    want = {d: t for d, t in want.items() if not plain_contamination(t, items)[4]}
    cleaned = clean(spark, single, sf_dir)
    assert sorted(r.doc_id for r in cleaned.collect()) == sorted(want)
    assert kept.columns == single.columns == cleaned.columns == docs.columns
    mixed = mix(spark, cleaned, sf_dir).collect()
    assert {r.doc_id for r in mixed} <= set(want)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.count() == len(mixed)
    assert sorted((r.doc_id, r.size) for r in whole.collect()) == sorted((r.doc_id, len(r.text.encode()) + 1) for r in mixed)

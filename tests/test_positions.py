import pytest

from trilake.operators.measures import latest_per_key
from trilake.sources.files import load_stats
from trilake.sources.ntriples import scan_ntriples
from trilake.sources.positions import ntriples_rejects
from trilake.sources.results import read_results_lines

GOOD = "<http://a/s> <http://a/p> <http://a/o> ."
BAD = {
    '"s" <http://a/p> <http://a/o> .': "subject",
    "<http://a/s": "subject",
    "<http://a/s> _:p <http://a/o> .": "predicate",
    '<http://a/s> <http://a/p> "open .': "object",
    r'<http://a/s> <http://a/p> "\uD800" .': "object",
    "<http://a/s> <http://a/p> <http://a/o>": "end",
    "<http://a/s> <http://a/p> <http://a/o> <http://a/g> .": "end",
}


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of a few lines, by tasks that read several of them."""
    conf = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def test_rejects_have_their_place(spark, tmp_path, small_splits):
    want = set()
    for f in range(3):
        lines = []
        for i in range(60 + 40 * f):
            lines += [GOOD, "", "# comment"][: i % 4]
            text = list(BAD)[(i + f) % len(BAD)]
            lines.append(text)
            want.add((f"{f}.nt", len(lines), BAD[text], text))
        (tmp_path / f"{f}.nt").write_text("\n".join(lines) + "\n")
    (tmp_path / "empty.nt").write_text("")
    path = str(tmp_path)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    got = ntriples_rejects(spark, path).collect()
    assert {(r.file.rsplit("/", 1)[1], r.line, r.reason, r.text) for r in got} == want
    assert len(got) == len(want) == load_stats(scan_ntriples(spark, path)).first().rejected


def test_no_rejects(spark, tmp_path):
    (tmp_path / "a.nt").write_text(GOOD + "\n\n# x\n")
    assert ntriples_rejects(spark, str(tmp_path)).count() == 0


def test_last_line_of_the_last_file_wins(spark, tmp_path, small_splits):
    for f in "ba":
        rows = [f'{{"framework":"x","scale":"{i % 3}","operation":"o","seconds":"{f}{i}"}}' for i in range(50)]
        (tmp_path / f"{f}.json").write_text("\n".join(rows) + "\n")
    log = read_results_lines(spark, str(tmp_path), positions=True)
    assert {(r.scale, r.seconds) for r in latest_per_key(log).collect()} == {("0", "b48"), ("1", "b49"), ("2", "b47")}

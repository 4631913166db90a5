import json

import pytest

from trilake.sinks.results import write_result_document
from trilake.sources.results import read_result_document

ROWS = [("http://x/a", ("literal", "say \"hi\" {,", None, "en"), 1), ("_:b0", None, None), (None, ("iri", "http://y", None, None), -5)]
COLUMNS = "node string, said struct<kind:string,value:string,dtype:string,lang:string>, n bigint"


@pytest.mark.parametrize("parts", [1, 4])
def test_document_and_back(spark, tmp_path, parts):
    rows = spark.createDataFrame(ROWS * 20, COLUMNS).repartition(parts).sortWithinPartitions("n")
    path = tmp_path / "out"
    write_result_document(rows, str(path), uris=["node"])
    text = "".join(f.read_text() for f in sorted(path.glob("part-*")))
    document = json.loads(text)
    assert document["head"] == {"vars": ["node", "said", "n"]}
    assert [b.get("n", {}).get("value") for b in document["results"]["bindings"]] == [None if r.n is None else str(r.n) for r in rows.collect()]
    one = tmp_path / "one.json"
    one.write_text(json.dumps(document, indent=2))
    for read in (read_result_document(spark, str(path), {"n": "bigint"}), read_result_document(spark, str(one), {"n": "bigint"}, by_line=False)):
        assert read.columns == rows.columns
        back = read.selectExpr("node.value node", "node.kind kind", "said", "n").collect()
        want = [(node, None if node is None else "bnode" if node[:2] == "_:" else "iri", said, n) for node, said, n in map(tuple, rows.collect())]
        assert sorted(map(str, map(tuple, back))) == sorted(map(str, want))


def test_document_without_bindings(spark, tmp_path):
    write_result_document(spark.createDataFrame([], COLUMNS), str(tmp_path / "out"))
    read = read_result_document(spark, str(tmp_path / "out"))
    assert read.columns == ["node", "said", "n"] and read.count() == 0
    (tmp_path / "other.json").write_text("[]")
    with pytest.raises(ValueError, match="no head"):
        read_result_document(spark, str(tmp_path / "other.json"))

"""Query results, and measurement logs: JSON arrays of ``{framework, scale, operation, seconds}``."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilake.sources.positions import file_order
from trilake.vocab import MEASUREMENTS


def read_results(spark: SparkSession, path: str | list[str], glob: str = "results_*.json") -> DataFrame:
    """Log rows with ``file`` (name) and ``pos`` (rising within a file).

    `seconds` is text, as it mixes numbers with sentinels. A file is one JSON array, so
    it is read by one task; the number of files is what spreads the work.
    """
    rows = (
        spark.read.schema(MEASUREMENTS)
        .option("multiLine", True)
        .option("pathGlobFilter", glob)
        .json(path)
    )
    return rows.select(
        *MEASUREMENTS.fieldNames(),
        F.col("_metadata.file_name").alias("file"),
        F.monotonically_increasing_id().alias("pos"),
    )


def read_results_lines(spark: SparkSession, path: str, positions: bool = False) -> DataFrame:
    """A log written by `write_results` (one JSON object a line, splittable).

    With `positions`, also ``file`` (its path) and ``pos``, which rises within a file, so
    that `latest_per_key` can go by the order in which rows were written. A file is read
    by as many tasks as it has splits.
    """
    rows = spark.read.schema(MEASUREMENTS).json(path)
    if not positions:
        return rows
    return rows.select(*MEASUREMENTS.fieldNames(), F.col("_metadata.file_path").alias("file"), file_order().alias("pos"))


_TERM = "struct<type:string, value:string, datatype:string, `xml:lang`:string>"


def read_result_document(spark: SparkSession, path: str, types: Mapping[str, str] | None = None, by_line: bool = True) -> DataFrame:
    """The bindings of an ``application/sparql-results+json`` document, a column for each variable of its head.

    A term is a struct (kind, value, dtype, lang) as a variable of type ``term`` is, and
    null where the variable is unbound; a variable in `types` comes as its value, cast to
    that type. `by_line`: a document of `write_result_document`, one binding a line, read
    by many tasks; any other document is read whole, one task a file.
    """
    if by_line:
        lines = spark.read.text(path)
        head = lines.where(F.col("value").startswith('{"head"')).first()
        if head is None:
            raise ValueError("the document has no head")
        names = json.loads(head.value + "]}}")["head"]["vars"]
        rows = lines.where(F.col("value").rlike(r'^(?:,|\{(?!"head"))')).select(
            F.from_json(F.ltrim("value", F.lit(",")), f"map<string, {_TERM}>").alias("b")
        )
    else:
        schema = f"head struct<vars: array<string>>, results struct<bindings: array<map<string, {_TERM}>>>"
        whole = spark.read.schema(schema).option("multiLine", True).json(path)
        names = whole.select("head.vars").first()[0]
        rows = whole.select(F.explode("results.bindings").alias("b"))

    def column(name: str):
        term = F.try_element_at("b", F.lit(name))
        if types and name in types:
            return term["value"].cast(types[name]).alias(name)
        kind = F.when(term["type"] == "uri", "iri").when(term["type"] == "typed-literal", "literal").otherwise(term["type"])
        shown = F.struct(kind.alias("kind"), term["value"].alias("value"), term["datatype"].alias("dtype"), term["xml:lang"].alias("lang"))
        return F.when(term.isNotNull(), shown).alias(name)

    return rows.select(*[column(n) for n in names])

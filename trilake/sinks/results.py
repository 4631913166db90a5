"""Writing bindings and measurement logs as JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilake.session import kept
from trilake.vocab import MEASUREMENTS, XSD, XSD_BOOLEAN, XSD_DATE, XSD_DECIMAL, XSD_DOUBLE, XSD_INTEGER

# Spark type -> datatype of the term shown in a result row.
_DATATYPES = {
    "bigint": XSD_INTEGER,
    "int": XSD_INTEGER,
    "double": XSD_DOUBLE,
    "date": XSD_DATE,
    "boolean": XSD_BOOLEAN,
    "float": XSD + "float",
    "smallint": XSD_INTEGER,
    "tinyint": XSD_INTEGER,
    "timestamp": XSD + "dateTime",
    "timestamp_ntz": XSD + "dateTime",
}


def to_sparql_json(bindings: DataFrame, uris: Sequence[str] = ()) -> DataFrame:
    """Rows of bindings as ``application/sparql-results+json`` binding objects.

    Columns in `uris` hold IRIs (or blank node labels); columns of variables bound as
    ``term`` show kind, datatype and language as stored; all others are literals. An
    unbound variable (null) is left out of its row.
    """

    def term(name: str, dtype: str) -> Column:
        if dtype.startswith("struct"):
            part = F.col(name)
            kind = F.when(part["kind"] == "iri", "uri").otherwise(part["kind"])
            lang, datatype = part["lang"].alias("xml:lang"), part["dtype"].alias("datatype")
            return F.when(part.isNotNull(), F.struct(kind.alias("type"), part["value"].alias("value"), datatype, lang)).alias(name)
        value = F.col(name).cast("string")
        if name in uris:
            kind = F.when(F.col(name).startswith("_:"), "bnode").otherwise("uri")
            shown = F.struct(kind.alias("type"), value.alias("value"))
        elif dtype == "string":
            shown = F.struct(F.lit("literal").alias("type"), value.alias("value"))
        else:
            iri = XSD_DECIMAL if dtype.startswith("decimal") else _DATATYPES.get(dtype)
            shown = F.struct(F.lit("literal").alias("type"), value.alias("value"), F.lit(iri).alias("datatype"))
        return F.when(F.col(name).isNotNull(), shown).alias(name)

    return bindings.select(F.to_json(F.struct(*[term(n, t) for n, t in bindings.dtypes])).alias("value"))


def write_result_document(bindings: DataFrame, path: str, uris: Sequence[str] = ()) -> None:
    """A query result as one ``application/sparql-results+json`` document over many text files.

    The files in the order of their names are the document: a line with the head, a line
    for each binding in the order of the rows, a last line. No task holds more than its rows.
    """
    lines = kept(to_sparql_json(bindings, uris).withColumn("at", F.monotonically_increasing_id()), "result-lines")
    first, last = lines.agg(F.min("at"), F.max("at")).first()
    comma = F.when(F.col("at") == F.lit(first), "").otherwise(",")
    shown = lines.select("at", F.concat(comma, "value").alias("value"))
    head = json.dumps({"head": {"vars": bindings.columns}})[:-1] + ', "results": {"bindings": ['
    ends = lines.sparkSession.createDataFrame([(-1, head), ((last or 0) + 1, "]}}")], "at long, value string")
    shown.unionByName(ends).orderBy("at").select("value").write.mode("overwrite").text(path)


def write_results(measurements: DataFrame, path: str) -> None:
    """The log as JSON lines, replacing what is there."""
    measurements.select(*MEASUREMENTS.fieldNames()).write.mode("overwrite").json(path)


def report_rows(wide: DataFrame, operations: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """A pivoted log as rows ``(framework, scale, json)``; a missing value is ``null``."""
    names = list(operations.values()) if isinstance(operations, Mapping) else list(operations)
    body = F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"})
    return wide.select("framework", "scale", body.alias("json"))

"""Table rows -> triples."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilake.functions import terms
from trilake.vocab import RDF_TYPE, XSD_DATE, XSD_DOUBLE, XSD_INTEGER


@dataclass(frozen=True)
class Template:
    """An IRI made of a stem and a zero-padded number: ``Template(":C", "id", 6)``."""

    stem: str
    column: str
    width: int

    def column_expr(self) -> Column:
        return terms.iri_template(terms.iri(self.stem), F.col(self.column), self.width)


@dataclass(frozen=True)
class Name:
    """An IRI made of a stem and the text of a column: ``Name(":", "country")``."""

    stem: str
    column: str

    def column_expr(self) -> Column:
        return F.concat(F.lit(terms.iri(self.stem)), F.col(self.column))


@dataclass(frozen=True)
class Literal:
    """A literal made of a column, with an optional datatype."""

    column: str
    dtype: str | None = None

    def column_expr(self) -> Column:
        return F.col(self.column).cast("string")


def double(column: str) -> Literal:
    return Literal(column, XSD_DOUBLE)


def integer(column: str) -> Literal:
    return Literal(column, XSD_INTEGER)


def date(column: str) -> Literal:
    return Literal(column, XSD_DATE)


ObjectMap = Template | Name | Literal


def _fields(predicate: str, obj: ObjectMap | None, type_iri: str | None = None) -> list[Column]:
    literal = isinstance(obj, Literal)
    value = obj.column_expr() if obj is not None else F.lit(terms.iri(type_iri or ""))
    return [
        F.lit(terms.iri(predicate)).alias("p"),
        value.alias("o"),
        F.lit("literal" if literal else "iri").alias("o_kind"),
        F.lit(obj.dtype if literal else None).cast("string").alias("o_dtype"),
    ]


def triplify(
    df: DataFrame,
    subject: Template | Name,
    type_iri: str | None,
    properties: Mapping[str, ObjectMap],
    layout: str = "rows",
) -> DataFrame:
    """One triple per row and property; a null object gives no triple.

    ``layout="rows"`` reads the table once and explodes each row: the way to write a
    graph out. ``layout="branches"`` is a union of one projection per property, each
    with a constant predicate. Catalyst folds a filter on the predicate into it and
    drops the other branches, so a pattern over this *virtual* graph becomes a scan of
    just the columns it needs.

    The result has no repeated triple if the subject is unique in `df`.
    """
    head: list[tuple[str, ObjectMap | None]] = [(RDF_TYPE, None)] if type_iri else []
    pairs = head + list(properties.items())
    tail = [F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("g")]
    if layout == "rows":
        exploded = F.explode(F.array(*[F.struct(*_fields(p, o, type_iri)) for p, o in pairs]))
        return (
            df.select(subject.column_expr().alias("s"), exploded.alias("t"))
            .select("s", "t.p", "t.o", "t.o_kind", "t.o_dtype", *tail)
            .where(F.col("o").isNotNull())
        )
    if layout != "branches":
        raise ValueError(f"unknown layout {layout!r}")
    branches = [
        (df.where(F.col(o.column).isNotNull()) if o is not None else df).select(
            subject.column_expr().alias("s"), *_fields(p, o, type_iri), *tail
        )
        for p, o in pairs
    ]
    return reduce(DataFrame.unionByName, branches)

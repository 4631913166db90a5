"""RDF terms as columns: prefixed names, literals, escapes, typed access.

Everything here is a `Column -> Column` function built from Spark's own
expressions, so it stays in the JVM. Names that are known when the plan is
built (`"rdfs:label"` in a pattern, say) are expanded on the driver by
:func:`iri`; whole columns of names go through :func:`expand`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilake.vocab import (
    PREFIXES,
    XSD,
    XSD_BOOLEAN,
    XSD_DATE,
    XSD_DECIMAL,
    XSD_DOUBLE,
    XSD_INTEGER,
    XSD_STRING,
)

_STRINGS = T.ArrayType(T.StringType())


def iri(name: str, prefixes: Mapping[str, str] = PREFIXES) -> str:
    """Full IRI of a name given in code: ``<full>``, ``pfx:local`` or already full."""
    if name.startswith("<") and name.endswith(">"):
        return name[1:-1]
    prefix, colon, local = name.partition(":")
    if colon and prefix in prefixes:
        return prefixes[prefix] + local
    return name


def _prefix_map(prefixes: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])


def expand(term: Column, prefixes: Mapping[str, str] | Column = PREFIXES) -> Column:
    """Prefixed name -> IRI; a name with an unknown prefix is returned as it is.

    The text before the first colon is looked up as a whole, so ``rdf`` can not
    capture ``rdfs:label``. `prefixes` is a dict or a map column (per-row bindings).
    """
    namespaces = prefixes if isinstance(prefixes, Column) else _prefix_map(prefixes)
    colon = F.locate(":", term)
    namespace = F.try_element_at(namespaces, F.substring_index(term, ":", 1))
    return F.when(
        (colon > 0) & namespace.isNotNull(), F.concat(namespace, term.substr(colon + 1, F.length(term)))
    ).otherwise(term)


def compact(full: Column, prefixes: Mapping[str, str] = PREFIXES) -> Column:
    """IRI -> prefixed name, longest namespace first; ``<iri>`` when no prefix fits.

    A local part holds no ``/`` or ``#``, so a namespace that ends with one of them fits
    only if it is all that comes before the local name: those are found by one lookup.
    """
    plain_local = r"^[A-Za-z0-9_][A-Za-z0-9_-]*+$"
    listed = {ns: prefix + ":" for prefix, ns in prefixes.items() if ns.endswith(("/", "#"))}
    candidates = []
    for prefix, namespace in sorted(prefixes.items(), key=lambda kv: -len(kv[1])):
        if namespace not in listed:
            local = full.substr(F.lit(len(namespace) + 1), F.length(full))
            fits = full.startswith(namespace) & local.rlike(plain_local)
            candidates.append(F.when(fits, F.concat(F.lit(prefix + ":"), local)))
    if listed:
        local = local_name(full)
        namespace = full.substr(F.lit(1), F.length(full) - F.length(local))
        shown = F.try_element_at(_prefix_map(listed), namespace)
        candidates.append(F.when(shown.isNotNull() & local.rlike(plain_local), F.concat(shown, local)))
    return F.coalesce(*candidates, F.concat(F.lit("<"), escape_iri(full), F.lit(">")))


def local_name(full: Column) -> Column:
    """Text after the last ``/`` or ``#`` (empty for an IRI that ends with one)."""
    return F.substring_index(F.substring_index(full, "/", -1), "#", -1)


def iri_template(stem: str, number: Column, width: int) -> Column:
    """`stem` + `number` padded with zeros to `width`; longer numbers keep all digits."""
    digits = number.cast("string")
    return F.concat(F.lit(stem), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def literal_split(lexeme: Column) -> Column:
    """``"12"^^xsd:integer`` -> struct(lex, dtype), split at the last ``^^xsd:``."""
    typed = lexeme.startswith('"') & lexeme.contains("^^xsd:")
    dtype = F.substring_index(lexeme, "^^xsd:", -1)
    cut = F.length(lexeme) - F.length(dtype) - F.lit(len("^^xsd:"))
    return F.struct(
        F.when(typed, lexeme.substr(F.lit(1), cut)).otherwise(lexeme).alias("lex"),
        F.when(typed, F.concat(F.lit(XSD), dtype)).alias("dtype"),
    )


# Datatype -> Spark type of its values.
VALUE_TYPES = {XSD_DOUBLE: "double", XSD_DECIMAL: "decimal(38,10)", XSD_INTEGER: "bigint", XSD_DATE: "date",
               XSD_BOOLEAN: "boolean"}


def term_value(lexical: Column, dtype: str, declared: Column | None = None) -> Column:
    """Typed value of a lexical form; a malformed form is unbound (null), not an error.

    With `declared` (the row's datatype) only terms of that datatype have a value.
    """
    value = lexical.try_cast(VALUE_TYPES.get(dtype, dtype))
    if declared is not None:
        value = F.when(declared == dtype, value)
    return value


# Which datatypes a typed variable reads: numbers as numbers of any kind, dates, booleans.
_NUMBER_TYPES = [XSD + n for n in ("integer", "decimal", "double", "float", "long", "int", "short", "byte")] + [
    XSD + n for n in ("nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger")
] + [XSD + n for n in ("unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")]
_READS = {"date": [XSD_DATE], "timestamp": [XSD + "dateTime"], "boolean": [XSD_BOOLEAN], "string": None}


def bound_value(as_type: str) -> Column:
    """The object of a triple as a value of a Spark type, or as a whole ``term``.

    Only literals of a datatype that fits have a value: text that looks like a number is
    none. A term is a struct of value, kind, dtype and lang, and terms with the same text
    stay apart.
    """
    if as_type == "term":
        return F.struct(F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_dtype").alias("dtype"), F.col("o_lang").alias("lang"))
    value = term_value(F.col("o"), as_type)
    reads = _READS.get(as_type, _NUMBER_TYPES)
    return value if reads is None else F.when(F.col("o_dtype").isin(*reads), value)


# ---------------------------------------------------------------- escapes


def escape_literal(lexical: Column) -> Column:
    """Lexical form -> the text between the quotes, backslash first."""
    out = lexical
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


# Characters that must not stand raw between < and >.
_IRI_UNSAFE = r'[\x00-\x20<>"{}|^`\\]'


def escape_iri(full: Column) -> Column:
    """Unsafe characters, all of them ASCII, as ``\\u00XX``; nearly always nothing to do."""
    escaped = F.transform(
        F.split(full, ""), lambda c: F.when(c.rlike(_IRI_UNSAFE), F.concat(F.lit("\\u00"), F.hex(c))).otherwise(c)
    )
    return F.when(full.rlike(_IRI_UNSAFE), F.array_join(escaped, "")).otherwise(full)


def unescape(text: Column) -> Column:
    r"""Decode ``\t \b \n \r \f \" \' \\ \uXXXX \UXXXXXXXX``; null when that fails.

    Text without a backslash is passed through. The rest is read as a one-string
    JSON array, which has the same escapes but for ``\U``: those are replaced by
    the character itself beforehand (or by an invalid escape if there is none).
    """
    code = r"^\\U00(?:0(?!0[Dd][89A-Fa-f])[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}$"
    long_form = F.transform(
        F.regexp_extract_all(text, F.lit(r"(\\U[0-9A-Fa-f]{8}|\\[^U]|[^\\]++)"), F.lit(1)),
        lambda part: F.when(
            part.startswith("\\U"),
            F.when(part.rlike(code), F.decode(F.unhex(part.substr(F.lit(3), F.lit(8))), "UTF-32")).otherwise("\\q"),
        ).otherwise(part),
    )
    json_text = F.when(F.locate("\\U", text) > 0, F.array_join(long_form, "")).otherwise(text)
    decoded = F.from_json(
        F.concat(F.lit('["'), json_text, F.lit('"]')), _STRINGS, {"allowUnquotedControlChars": "true"}
    ).getItem(0)
    return F.when(F.locate("\\", text) == 0, text).otherwise(decoded)


# ---------------------------------------------------------------- N-Triples tokens


def term_token(o: Column, kind: Column, dtype: Column, lang: Column, datatype_token: Column | None = None) -> Column:
    """A term as N-Triples writes it. `datatype_token` overrides how a datatype is shown."""
    shown = datatype_token if datatype_token is not None else F.concat(F.lit("<"), escape_iri(dtype), F.lit(">"))
    quoted = F.concat(F.lit('"'), escape_literal(o), F.lit('"'))
    return (
        F.when(kind == "iri", F.concat(F.lit("<"), escape_iri(o), F.lit(">")))
        .when(kind == "bnode", o)
        .when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang))
        .when(dtype.isNotNull(), F.concat(quoted, F.lit("^^"), shown))
        .otherwise(quoted)
    )


def resource_token(s: Column) -> Column:
    """A subject or predicate as N-Triples writes it."""
    return F.when(s.startswith("_:"), s).otherwise(F.concat(F.lit("<"), escape_iri(s), F.lit(">")))


def scoped_bnode(label: Column, file: Column) -> Column:
    """Blank node labels hold within one file: make them unique across files."""
    return F.concat(F.lit("_:f"), F.md5(file), F.lit("x"), F.hex(label.substr(F.lit(3), F.length(label))))


def plain_string_dtype(dtype: Column) -> Column:
    """``xsd:string`` and no datatype are the same term."""
    return F.when((dtype != "") & (dtype != XSD_STRING), dtype)

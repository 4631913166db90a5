"""Turtle as a splittable text source: one statement per record.

Records end with `` .`` and a line feed, so Spark splits a file between statements.
A record is cut into tokens by one regular expression and then split further on
separators; linear work in generated code, no UDF.

Files that can not be cut like that are found in the pass that gathers prefixes: those
with long strings, single quotes, brackets, a base, a prefix that is bound twice or not
at a line's start, a comment that ends like a statement, or lines that end otherwise than
with `` .`` and a line feed. They go through `turtle_lines`, which reads any file by many
tasks too, in more passes.

``[...]`` and ``(...)`` become blank nodes named after their place; relative IRIs need a
base. Statements that do not parse come out with ``ok = false``, and `read_turtle` raises
an error unless told to leave them out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trilake.operators.joins import lookup_join
from trilake.session import kept
from trilake.sources.ntriples import BNODE, IRI, LANG, LITERAL_BODY, accepted, decode_pieces
from trilake.sources.turtle_lines import resolve, scan_lines
from trilake.sources.turtle_text import NAME, SUFFIX, TERM
from trilake.vocab import RDF_TYPE, XSD_BOOLEAN, XSD_DECIMAL, XSD_DOUBLE, XSD_INTEGER

# A line that binds a prefix. A file with literals that span lines is read another way, so a line start is safe.
PREFIX_LINE = r"(?m)^[ \t]*(?:@prefix|(?i:PREFIX))[ \t]+([^\s:<]*):[ \t]*<([^<>\s]*)>[ \t]*\.?[ \t]*"

# What stands between tokens, then a token. Characters that start no token of the
# profile are tokens of their own, which makes their statement unsound.
TOKEN = (
    r"(?:\s|#[^\n]*+)*+"
    rf"({LITERAL_BODY}{SUFFIX}|{IRI}|[;,.]|{NAME}|\S|$)"
)
# A line that is, from somewhere on, a comment.
_IN_COMMENT = rf"^(?:{LITERAL_BODY}|{IRI}|\\.|[^#\"\\])*+#"
# Strings and comments, to look for long strings outside of them.
_STRING_OR_COMMENT = rf"{LITERAL_BODY}(?!\")|{IRI}|#[^\n]*+"
# A line that can not make its file hard if it has no word of a directive: at most one
# string, without escapes, and outside of it nothing that opens a string, bracket or comment.
_PLAIN = r"""^[^"'#\[(\\]++(?:"[^"\\]*+"[^"'#\[(\\]*+)?+\z"""
# Tokens one a line: subject, predicate, objects with "," between, more after ";".
_OBJECTS = rf"{TERM}\n(?:,\n{TERM}\n)*+"
SOUND = rf"^{TERM}\n{TERM}\n{_OBJECTS}(?:(?:;\n)++(?:{TERM}\n{_OBJECTS})?+)*+$"

_NUMBERS = (
    (r"^[+-]?\d+$", XSD_INTEGER),
    (r"^[+-]?\d*\.\d+$", XSD_DECIMAL),
    (r"^[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+$", XSD_DOUBLE),
    (r"^(?:true|false)$", XSD_BOOLEAN),
)


def scan_records(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """One row per record of text between two statement ends."""
    reader = spark.read.options(**options).option("lineSep", " .\n")
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def file_facts(lines: DataFrame) -> DataFrame:
    """Rows ``(file, prefixes map, hard, long)``, one per file, from its lines (``value``, ``file``).

    `hard`: the file can not be read record by record. Long strings may hold what looks
    like a statement end, a comment may cut a statement, and of a prefix bound to two
    namespaces it depends on the place which one holds. `long`: it may have strings that go
    on over lines. Most lines are plain, which one look tells; of the others all is computed.
    """
    lower = F.lower("value")
    ended = F.col("value").endswith(" .") | F.col("value").endswith(" ;")
    plain = ended & F.col("value").rlike(_PLAIN) & ~lower.contains("prefix") & ~lower.contains("base")
    lines = lines.select("file", F.when(~plain, F.col("value")).alias("value"))
    value = F.col("value")
    outside = F.regexp_replace(F.regexp_replace(value, PREFIX_LINE, ""), _STRING_OR_COMMENT, "")
    odd = value.rlike(r"""["'\[(]|(?i:prefix|base)""") & outside.rlike(r"""["'\[(]|(?i:(?:^|[\s@])(?:prefix|base)\s)""")
    loose = value.rlike(r"\.\s*$") & ~value.endswith(" .") & ~value.rlike(r"^\s*#")
    cut = value.endswith(" .") & value.contains("#") & value.rlike(_IN_COMMENT)
    binds = F.when(
        value.rlike(PREFIX_LINE),
        F.arrays_zip(
            F.regexp_extract_all("value", F.lit(PREFIX_LINE), F.lit(1)).alias("prefix"),
            F.regexp_extract_all("value", F.lit(PREFIX_LINE), F.lit(2)).alias("namespace"),
        ),
    )
    # Inlined as a one-row array: the flag is then computed once a line, not once a binding.
    hard, long = odd | loose | cut, value.contains('"""') | value.contains("'''")
    flags = F.struct("file", *[F.coalesce(flag, F.lit(False)).alias(name) for flag, name in ((hard, "hard"), (long, "long"))], binds.alias("binds"))
    found = lines.select(F.inline(F.array(flags))).select("file", "hard", "long", F.explode_outer("binds").alias("b"))
    # Flags first: the least and greatest of texts are found by sorting, here of few rows.
    bound = found.groupBy("file", "b.prefix", "b.namespace").agg(F.max("hard").alias("hard"), F.max("long").alias("long"))
    per_prefix = bound.groupBy("file", "prefix").agg(
        F.min("namespace").alias("low"), F.max("namespace").alias("high"), F.max("hard").alias("hard"), F.max("long").alias("long")
    )
    entry = F.when(F.col("prefix").isNotNull(), F.struct("prefix", F.col("low").alias("namespace")))
    hard = F.max(F.col("hard") | F.coalesce(F.col("low") != F.col("high"), F.lit(False)))
    return per_prefix.groupBy("file").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("prefixes"), hard.alias("hard"), F.max("long").alias("long")
    )


def _lined(records: DataFrame) -> DataFrame:
    """`records` with their tokens one a line in place of `value`."""
    value = F.col("value")
    bare = F.when(value.contains("prefix") | value.contains("PREFIX"), F.regexp_replace(value, PREFIX_LINE, ""))
    return records.withColumn("lined", F.regexp_replace(F.coalesce(bare, value), TOKEN, "$1\n")).drop("value")


def _token_rows(records: DataFrame, keep: list[str]) -> DataFrame:
    """One row ``(st, pt, ot, sound)`` per object of each statement, tokens as written.

    The tokens of a record are put one a line (none of them holds a line feed), so that
    statements, predicate lists and object lists are splits at ``.``, ``;`` and ``,``
    standing alone on a line. Plain splits and explodes, all in generated code.
    A statement with a missing or surplus token anywhere is not taken apart: it gives
    one row with ``sound = false``.
    """
    feed = F.lit("\n")

    def cut(lines: Column, separator: str, marks: str) -> Column:
        """Split at a separator line; most lines of text have none, which is cheap to see."""
        return F.when(lines.contains(f"\n{marks}\n"), F.split(lines, separator)).otherwise(F.array(lines))

    def head(lines: str) -> Column:
        return F.substring_index(lines, "\n", 1)

    def rest(lines: str) -> Column:
        return F.substr(F.col(lines), F.length(head(lines)) + 2)

    statements = (
        records.select(*keep, F.concat(feed, F.rtrim(F.col("lined"), feed), feed).alias("lined"))
        .select(*keep, F.explode(cut(F.col("lined"), r"(?<=\n)\.\n", ".")).alias("statement"))
        .select(*keep, F.ltrim(F.col("statement"), feed).alias("statement"))
        .where(F.col("statement") != "")
    )
    checked = statements.select(
        *keep,
        F.col("statement").rlike(SOUND).alias("sound"),
        head("statement").alias("st"),
        rest("statement").alias("lists"),
    )
    split_lists = F.when(F.col("sound"), cut(F.col("lists"), r"(?<=\n)(?:;\n)++", ";")).otherwise(F.array(F.lit("")))
    lists = checked.select(*keep, "sound", "st", F.explode(split_lists).alias("list")).where(
        (F.col("list") != "") | ~F.col("sound")
    )
    objects = lists.select(
        *keep, "sound", "st", head("list").alias("pt"), F.rtrim(rest("list"), feed).alias("objects")
    )
    return objects.select(*keep, "sound", "st", "pt", F.explode(cut(F.col("objects"), r"\n,\n", ",")).alias("ot"))


def parse_turtle(records: DataFrame, graph: str | None = None, bnode_scope: str = "file") -> DataFrame:
    """Records (``lined``, ``file``, ``prefixes``, maybe ``base``) -> triple columns + ``ok``."""
    based = "base" in records.columns
    rows = _token_rows(records, ["file", "prefixes", *(["base"] if based else [])])

    def full(token: Column) -> Column:
        """IRI reference or prefixed name -> absolute IRI; null if it is neither."""
        prefix = F.substring_index(token, ":", 1)
        local = F.substr(token, F.length(prefix) + 2)
        unescaped = F.when(local.contains("\\"), F.regexp_replace(local, r"\\(.)", "$1")).otherwise(local)
        inner = token.substr(F.lit(2), F.length(token) - 2)
        absolute = F.when(token.rlike("^<[A-Za-z][A-Za-z0-9+.-]*:"), inner)
        if based:
            absolute = F.coalesce(absolute, resolve(F.col("base"), inner))
        return F.when(token.startswith("<"), absolute).when(
            token.contains(":"), F.concat(F.try_element_at("prefixes", prefix), unescaped)
        )

    def resource(token: Column) -> Column:
        return F.when(token.startswith("_:"), F.when(token.rlike(rf"^{BNODE}$"), token)).otherwise(full(token))

    ot, suffix = F.col("ot"), F.col("suffix")
    quoted = ot.startswith('"')
    shorthand = F.coalesce(*[F.when(ot.rlike(shape), F.lit(dtype)) for shape, dtype in _NUMBERS])
    # One name per object: its own, or that of its datatype.
    name = F.when(suffix.startswith("^^"), suffix.substr(F.lit(3), F.length(suffix))).when(~quoted, ot)
    named = (
        rows.withColumn("suffix", F.when(quoted, F.substring_index("ot", '"', -1)))
        .withColumn("name", resource(name))
        .withColumn("shorthand", F.when(~quoted & ~ot.contains(":"), shorthand))
    )
    pieces = named.select(
        resource(F.col("st")).alias("st"),
        F.when(F.col("pt") == "a", RDF_TYPE).otherwise(full(F.col("pt"))).alias("pt"),
        F.when(quoted, ot.substr(F.lit(2), F.length("ot") - F.length(suffix) - 2))
        .when(F.col("shorthand").isNotNull(), ot)
        .otherwise(F.col("name"))
        .alias("ot"),
        F.when(quoted | F.col("shorthand").isNotNull(), "literal")
        .when(F.col("name").startswith("_:"), "bnode")
        .otherwise("iri")
        .alias("o_kind"),
        F.when(quoted, F.col("name")).otherwise(F.col("shorthand")).alias("dtype"),
        F.when(suffix.startswith("@"), suffix.substr(F.lit(2), F.length(suffix))).alias("o_lang"),
        "file",
        F.lit(graph).cast("string").alias("g"),
        (F.col("sound") & ~(suffix.startswith("^^") & F.col("name").isNull()).eqNullSafe(True)).alias("ok"),
    )
    return decode_pieces(pieces, bnode_scope)


def scan_turtle(
    spark: SparkSession,
    path: str | list[str],
    graph: str | None = None,
    prefixes: Mapping[str, str] | None = None,
    bnode_scope: str = "file",
    **options: str,
) -> DataFrame:
    """Parse without dropping anything: valid rows, repeated rows and rejected rows.

    Without `prefixes` the files are first scanned for their own bindings (as a
    schema-inferring source would) and for what makes a file hard to cut; that small
    table is written to the shared folder. The bindings that most files have are a
    constant of the plan; only other files are looked up. With `prefixes` that pass is
    saved: the given bindings hold for every file, and the caller vouches that no file is
    hard to cut.
    """
    records = scan_records(spark, path, **options)
    if prefixes is not None:
        table = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
        return parse_turtle(_lined(records.withColumn("prefixes", table)), graph, bnode_scope)
    lines = spark.read.options(**options).option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    facts = kept(file_facts(lines), "turtle-files")
    entries = F.map_entries("prefixes")
    usual = facts.where("not hard").groupBy(entries.alias("e")).count().orderBy(F.desc("count"), F.to_json("e")).first()
    if usual is None:
        easy = None
    else:
        common = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in usual.e]).cast("array<struct<key:string,value:string>>"))
        other = facts.where(F.col("hard") | (F.to_json("prefixes") != F.to_json(common)))
        joined = lookup_join(records, other.select("file", "hard", F.col("prefixes").alias("own")), ["file"])
        plain = joined.where(~F.coalesce("hard", F.lit(False))).withColumn("prefixes", F.when(F.col("hard").isNull(), common).otherwise(F.col("own")))
        easy = parse_turtle(_lined(plain.drop("hard", "own")), graph, bnode_scope)
    # names of files, as many as the driver lists anyway
    found = facts.where("hard").select("file", "long").collect()
    hard, long = [r.file for r in found], [r.file for r in found if r.long]
    if not hard:
        return easy if easy is not None else parse_turtle(_lined(records.withColumn("prefixes", F.create_map().cast("map<string,string>"))), graph, bnode_scope)
    read = parse_turtle(scan_lines(spark, path, hard, SOUND, long, **options), graph, bnode_scope)
    return read if easy is None else easy.unionByName(read)


def read_turtle(
    spark: SparkSession,
    path: str | list[str],
    graph: str | None = None,
    prefixes: Mapping[str, str] | None = None,
    distinct: bool = True,
    on_reject: str = "error",
    bnode_scope: str = "file",
    **options: str,
) -> DataFrame:
    """Turtle files -> triples.

    A statement that does not parse raises an error when it is met; with
    ``on_reject="count"`` it is left out, and `load_stats` tells how many there are.
    `bnode_scope`: labels of blank nodes hold in one ``file``, or in the whole
    ``dataset``, as for a directory that one job wrote.
    """
    return accepted(scan_turtle(spark, path, graph, prefixes, bnode_scope, **options), distinct, on_reject)

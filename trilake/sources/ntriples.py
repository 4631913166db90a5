"""N-Triples as a splittable text source.

One regular expression both validates a line and cuts it into terms: the match
is rewritten as ``subject \\n predicate \\n object`` and split again. A newline can
not occur in a line of text, so the split is exact, and the expression runs once
per line however many columns come out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trilake.functions import terms
from trilake.vocab import TRIPLE_COLUMNS

# Possessive quantifiers (*+, ++) keep the match iterative: no stack use and no
# backtracking on literals of any length.
UCHAR = (
    r"\\u(?!D[89A-F]|d[89a-f])[0-9A-Fa-f]{4}"
    r"|\\U00(?:0(?!0[Dd][89A-Fa-f])[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}"
)
IRI = r'<(?:[^<>"{}|^`\\\x00-\x20]++|' + UCHAR + r")*+>"
BNODE = r'_:[^\s<>"\\]*[^\s<>".\\]'
LITERAL_BODY = r'"(?:[^"\\\n]++|\\[tbnrf"\'\\]|' + UCHAR + r')*+"'
LANG = r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*"

STATEMENT = (
    rf"^[ \t]*({IRI}|{BNODE})[ \t]*({IRI})[ \t]*"
    rf"({IRI}|{BNODE}|{LITERAL_BODY}(?:\^\^{IRI}|{LANG})?)[ \t]*\.[ \t]*(?:#.*)?$"
)


def cut_tokens(parts: DataFrame) -> DataFrame:
    """Columns ``st pt ot`` (tokens as N-Triples writes them) -> the pieces of each term.

    Pieces are still escaped: IRIs without their brackets, labels of blank nodes, and
    for a literal its lexical form, ``dtype`` and ``o_lang``.
    """

    def inner(token: Column) -> Column:
        return token.substr(F.lit(2), F.length(token) - 2)

    ot = F.col("ot")
    literal = ot.startswith('"')
    # A literal token ends its lexical form at its last quote: no suffix has one.
    cut = parts.select("st", "pt", "ot", "file", "g", "ok", F.when(literal, F.substring_index("ot", '"', -1)).alias("suffix"))
    suffix = F.col("suffix")
    return cut.select(
        *[F.when(F.col(t).startswith("_:"), F.col(t)).otherwise(inner(F.col(t))).alias(t) for t in ("st", "pt")],
        F.when(literal, ot.substr(F.lit(2), F.length("ot") - F.length(suffix) - 2))
        .when(ot.startswith("_:"), ot)
        .otherwise(inner(ot))
        .alias("ot"),
        F.when(literal, "literal").when(ot.startswith("_:"), "bnode").otherwise("iri").alias("o_kind"),
        F.when(suffix.startswith("^^"), suffix.substr(F.lit(4), F.length(suffix) - 4)).alias("dtype"),
        F.when(suffix.startswith("@"), suffix.substr(F.lit(2), F.length(suffix))).alias("o_lang"),
        "file",
        "g",
        "ok",
    )


def decode_pieces(pieces: DataFrame, bnode_scope: str = "file") -> DataFrame:
    """Pieces of terms -> triple columns + ``ok``.

    A row whose escapes cannot be decoded ends with ``ok = false``; so does one that
    came in so. Labels of blank nodes hold in one ``file``, or in the whole ``dataset``.
    """
    scope = {"file": F.col("file"), "dataset": None}[bnode_scope]
    bnode = lambda c: F.col(c) if scope is None else terms.scoped_bnode(F.col(c), scope)
    plain = pieces.select(
        *[terms.unescape(F.col(c)).alias(c) for c in ("st", "pt", "ot", "dtype")], "o_kind", "o_lang", "file", "g", "ok"
    )
    decoded = plain.select(
        F.when(F.col("st").startswith("_:"), bnode("st"))
        .otherwise(F.col("st"))
        .alias("s"),
        F.col("pt").alias("p"),
        F.when(F.col("o_kind") == "bnode", bnode("ot"))
        .otherwise(F.col("ot"))
        .alias("o"),
        "o_kind",
        terms.plain_string_dtype(F.col("dtype")).alias("o_dtype"),
        "o_lang",
        "g",
        (F.col("ok") & F.col("st").isNotNull() & F.col("pt").isNotNull() & F.col("ot").isNotNull()).alias("ok"),
    )
    # Inlined as a one-row array: a filter on `ok` can then not be pushed down into the
    # projections, which would evaluate all these expressions twice.
    return decoded.select(F.inline(F.array(F.struct(*decoded.columns))))


def parse_ntriples(lines: DataFrame, graph: str | None = None, bnode_scope: str = "file") -> DataFrame:
    """Lines (``value``, ``file``) -> triple columns + ``ok``; comments and blank lines go."""
    content = lines.where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    fields = F.split(F.regexp_replace("value", STATEMENT, "$1\n$2\n$3"), "\n")
    matched = F.size("f") == 3
    parts = content.select(fields.alias("f"), "file").select(
        *[F.when(matched, F.get("f", F.lit(i))).alias(name) for i, name in enumerate(("st", "pt", "ot"))],
        "file",
        F.lit(graph).cast("string").alias("g"),
        matched.alias("ok"),
    )
    return decode_pieces(cut_tokens(parts), bnode_scope)


def scan_ntriples(
    spark: SparkSession, path: str | list[str], graph: str | None = None, bnode_scope: str = "file", **options: str
) -> DataFrame:
    """Parse without dropping anything: valid rows, repeated rows and rejected rows."""
    lines = spark.read.options(**options).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_ntriples(lines, graph, bnode_scope)


def accepted(parsed: DataFrame, distinct: bool = True, on_reject: str = "error") -> DataFrame:
    """The triples of a parse. A graph is a set, so repeated statements count once.

    ``on_reject="error"``: a rejected statement raises; ``"count"``: it is left out.
    """
    if on_reject not in ("error", "count"):
        raise ValueError(f"on_reject is 'error' or 'count', not {on_reject!r}")
    refused = F.raise_error(F.lit("a statement can't be read; on_reject='count' leaves such out, load_stats counts them"))
    ok = F.col("ok") if on_reject == "count" else F.when(F.col("ok"), True).otherwise(refused.cast("boolean"))
    triples = parsed.where(ok).select(*TRIPLE_COLUMNS)
    return triples.dropDuplicates() if distinct else triples


def read_ntriples(
    spark: SparkSession,
    path: str | list[str],
    graph: str | None = None,
    distinct: bool = True,
    on_reject: str = "count",
    bnode_scope: str = "file",
    **options: str,
) -> DataFrame:
    """N-Triples files -> triples; `on_reject` and `bnode_scope` as for `read_turtle`.

    A bad line can not take others with it, so by default it is left out; see `load_stats`.

    `distinct=False` saves the shuffle for input known to hold no repeated statement.
    """
    return accepted(scan_ntriples(spark, path, graph, bnode_scope, **options), distinct, on_reject)

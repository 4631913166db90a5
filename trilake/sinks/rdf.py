"""Writing graphs as N-Triples and Turtle, one file per partition."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilake.functions import terms
from trilake.session import kept
from trilake.vocab import PREFIXES, RDF_TYPE

#: Triples in one statement of a written file; a subject with more gets several.
MAX_BLOCK = 1_000


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """One column ``value``: each triple as a line of N-Triples, without the line feed."""
    obj = terms.term_token(F.col("o"), F.col("o_kind"), F.col("o_dtype"), F.col("o_lang"))
    return triples.select(
        F.concat(
            terms.resource_token(F.col("s")), F.lit(" "), terms.resource_token(F.col("p")), F.lit(" "), obj, F.lit(" .")
        ).alias("value")
    )


def write_ntriples(triples: DataFrame, path: str, mode: str = "overwrite", **options: str | int) -> None:
    """`options` are those of Spark's text writer. Compressed files are not split by readers:
    with ``compression``, ``maxRecordsPerFile`` keeps each of them short."""
    ntriples_lines(triples).write.mode(mode).options(**options).text(path)


def _short(full: Column, prefixes: Mapping[str, str]) -> Column:
    return F.when(full.startswith("_:"), full).otherwise(terms.compact(full, prefixes))


def _turtle_tokens(triples: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """Columns ``s st pt ot``: the subject, and the three terms as Turtle writes them."""
    # An object has one name at most, its own or that of its datatype: shorten it once.
    name = F.when(F.col("o_kind") == "iri", F.col("o")).otherwise(F.col("o_dtype"))
    short = triples.select(
        "s",
        _short(F.col("s"), prefixes).alias("st"),
        terms.compact(F.col("p"), prefixes).alias("pt"),
        F.when(name.isNotNull(), terms.compact(name, prefixes)).alias("name"),
        "o",
        "o_kind",
        "o_dtype",
        "o_lang",
    )
    literal = terms.term_token(F.col("o"), F.col("o_kind"), F.col("o_dtype"), F.col("o_lang"), F.col("name"))
    return short.select(
        "s", "st", "pt", F.when(F.col("o_kind") == "iri", F.col("name")).otherwise(literal).alias("ot")
    )


def turtle_lines(triples: DataFrame, prefixes: Mapping[str, str] = PREFIXES) -> DataFrame:
    """One column ``value``: each triple as a flat Turtle statement with prefixed names."""
    tokens = _turtle_tokens(triples, prefixes)
    return tokens.select(F.concat("st", F.lit(" "), "pt", F.lit(" "), "ot", F.lit(" .")).alias("value"))


def turtle_header(prefixes: Mapping[str, str] = PREFIXES) -> str:
    return "".join(f"@prefix {name}: <{namespace}> .\n" for name, namespace in prefixes.items()) + "\n"


def _write_turtle_text(statements: DataFrame, path: str, prefixes: Mapping[str, str], mode: str) -> None:
    # Prefixes hold within one file, so each file needs the header. A task writes one
    # file, and the low 33 bits of the id count the rows of a task from zero.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    text = F.when(first, F.concat(F.lit(turtle_header(prefixes)), F.col("value"))).otherwise(F.col("value"))
    statements.select(text.alias("value")).write.mode(mode).option("maxRecordsPerFile", 0).text(path)


def write_turtle(
    triples: DataFrame, path: str, prefixes: Mapping[str, str] = PREFIXES, mode: str = "overwrite"
) -> None:
    """Flat Turtle: a prefix header, then one statement a line."""
    _write_turtle_text(turtle_lines(triples, prefixes), path, prefixes, mode)


def turtle_subject_blocks(
    triples: DataFrame, prefixes: Mapping[str, str] = PREFIXES, max_block: int | None = None
) -> DataFrame:
    """Rows ``(subject, block)``: the triples of a subject as one ``s p o ;`` statement.

    There is one row for each subject, however many triples it has, so a block must fit
    into a row (2 GB). With `max_block`, a block has about that many triples at most; a
    subject with more gets several statements (Turtle allows that), so no task ever
    holds all triples of a hot subject. Which subjects those are comes from a count that
    is combined before its shuffle and written down; usually there are none, and then
    the triples are shuffled once.
    """
    entries = _turtle_tokens(triples, prefixes).select(
        F.col("st").alias("subject"),
        (F.col("pt") != terms.compact(F.lit(RDF_TYPE), prefixes)).alias("later"),
        F.col("pt").alias("p_token"),
        F.col("ot").alias("o_token"),
    )
    heavy = None
    if max_block is not None:
        sizes = triples.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_block)
        heavy = sizes.select(_short(F.col("s"), prefixes).alias("subject"), F.ceil(F.col("n") / max_block).alias("parts"))
        heavy = kept(heavy, "heavy-subjects")
    if heavy is None or heavy.isEmpty():
        keyed, keys = entries, ["subject"]
    else:
        # Uneven hashing may exceed max_block a little; twice the parts keeps blocks short.
        joined = entries.join(heavy, "subject", "left")
        part = F.pmod(F.xxhash64("p_token", "o_token"), F.coalesce(F.col("parts") * 2, F.lit(1)))
        keyed, keys = joined.withColumn("part", part).repartition("subject", "part"), ["subject", "part"]
    grouped = keyed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("later", "p_token", "o_token"))).alias("po"))
    body = F.array_join(F.transform("po", lambda x: F.concat_ws(" ", x["p_token"], x["o_token"])), " ;\n  ")
    return grouped.select("subject", F.concat(F.col("subject"), F.lit(" "), body, F.lit(" .")).alias("block"))


def write_turtle_grouped(
    triples: DataFrame, path: str, prefixes: Mapping[str, str] = PREFIXES, mode: str = "overwrite"
) -> None:
    """Turtle with the triples of a subject under one statement, types first; under several
    of about ``MAX_BLOCK`` triples where there are more, which is the same graph."""
    blocks = turtle_subject_blocks(triples, prefixes, MAX_BLOCK).select(F.col("block").alias("value"))
    _write_turtle_text(blocks, path, prefixes, mode)

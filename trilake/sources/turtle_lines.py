"""Turtle files of any shape, cut at their real statement ends by many tasks.

A file is read in chunks of lines. What a chunk means depends on whether it starts inside a
long string, which only lines with triple quotes can change. Each of those is a function
from the state before it to the state after it; composing the functions, first within
chunks of lines and then over the chunks of a file, gives every chunk its state without
reading the file in order. Files without such lines are read without that step.

A chunk is then cut into statements by one look at its text (`turtle_text`). Names bound
within it are settled there; statements cut by its ends, and names bound before it, meet
with the rest of their file in tables that have a few rows for each chunk.

Nested terms come out as statements of their own; a node is named after the file, the
statement and the place of its bracket in it.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trilake.operators.joins import lookup_join
from trilake.session import kept
from trilake.sources import turtle_text
from trilake.sources.ntriples import IRI
from trilake.sources.turtle_text import CLOSE, LONG, NAME, SCHEME

#: Lines of one chunk.
CHUNK_LINES = 1 << 14

# What may stand in a line outside of strings that go on after it, but for full stops.
_SKIP = (
    rf"(?:\s++|#[^\n]*+|{LONG}|\"(?!\"\")(?:[^\"\\]++|\\.)*+\"|'(?!'')(?:[^'\\]++|\\.)*+'"
    rf"|{IRI}|{NAME}|(?!\"\"\"|''')[^.])"
)
_OPENED = rf"^(?:{_SKIP}|\.)*+(\"\"\"|''')?"
SAME = "012"
#: Relative bases in a row that are resolved in one go.
RUN_BLOCK = 1_000
#: The places before a statement's directives and after them.
FIRST, LAST = -1, (1 << 31) - 1


def _after(text: Column) -> Column:
    """The state after a text that starts outside of strings: 0, or 1 or 2 within a long string."""
    opened = F.regexp_extract(text, _OPENED, 1)
    return F.when(opened == '"""', "1").when(opened == "'''", "2").otherwise("0")


def _function(line: Column) -> Column:
    """The states after a line that starts in state 0, 1 and 2, as three digits."""

    def closed(state: int) -> Column:
        close = "^" + CLOSE[state]
        return F.when(line.rlike(close), _after(F.regexp_replace(line, close, ""))).otherwise(str(state))

    return F.concat(_after(line), closed(1), closed(2))


def _then(first: Column, second: Column) -> Column:
    """The function that is `first` and then `second`."""
    return F.concat(*[F.substr(second, F.substr(first, F.lit(i), F.lit(1)).cast("int") + 1, F.lit(1)) for i in (1, 2, 3)])


def _running(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`rows` with `before`: all functions `f` of earlier rows of the same keys, composed.

    Composition has no inverse and does not commute, so no window function has it.
    """
    names = [c for c in rows.columns if c != "f"]
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", before string"

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        state, before = SAME, []
        for f in frame["f"]:
            before.append(state)
            state = "".join(f[int(s)] for s in state)
        return frame.assign(before=before)[[*names, "f", "before"]]

    return rows.select(*names, "f").groupBy(*keys).applyInPandas(scan, schema)


def chunk_states(lines: DataFrame) -> DataFrame:
    """Rows ``(file, block, chunk, state)``: the state that each chunk of `lines` starts in.

    `lines`: file, block, at, chunk, line, f. Only lines with triple quotes have an `f`. A
    chunk holds ``CHUNK_LINES`` lines at most, and one row stands for a chunk when those of
    a file are put in order.
    """
    chunk = ["file", "block", "chunk"]
    turning = lines.where("f is not null").select("block", "chunk", "at", "file", "f")
    turning = kept(_running(turning, chunk, ["at"]), "turtle-turns")
    whole = turning.groupBy(*chunk).agg(F.max_by(_then(F.col("before"), F.col("f")), "at").alias("f"))
    chunks = lines.select(*chunk).distinct().join(whole, chunk, "left").withColumn("f", F.coalesce("f", F.lit(SAME)))
    return _running(chunks, ["file"], ["block", "chunk"]).select(*chunk, F.substr("before", F.lit(1), F.lit(1)).cast("int").alias("state"))


def chunk_rows(spark: SparkSession, path: str | list[str], files: list[str], long: list[str], sound: str, **options: str) -> DataFrame:
    """What `turtle_text.cut_chunks` makes of some of the files of a path; `long`: those of them with triple quotes."""
    read = spark.read.options(**options).option("lineSep", "\n").text(path)
    where = F.col("_metadata.file_path")
    at = F.monotonically_increasing_id()
    chunk = ["file", "block", "chunk"]

    def placed(some: list[str]) -> DataFrame:
        rows = read.where(where.isin(some)).select(where.alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), F.col("value").alias("line"))
        return rows.withColumn("chunk", F.floor(F.col("at") / CHUNK_LINES))

    def cut(rows: DataFrame) -> DataFrame:
        rows = rows.select(*chunk, "state", F.col("line").cast("binary").alias("line"))
        return rows.mapInArrow(turtle_text.cut_chunks(sound), turtle_text.CUT_DDL)

    found = []
    if short := sorted(set(files) - set(long)):
        # a task reads a split from front to back, so chunks come in one piece
        found.append(cut(placed(short).withColumn("state", F.lit(0))))
    if long:
        line = F.col("line")
        turns = line.contains('"""') | line.contains("'''")
        lines = kept(placed(long).withColumn("f", F.when(turns, _function(line))), "turtle-lines")
        stated = lines.drop("f").join(chunk_states(lines), chunk)
        found.append(cut(stated.repartition(*chunk).sortWithinPartitions(*chunk, "at")))
    return reduce(DataFrame.unionByName, found)


def _without_dots(path: Column) -> Column:
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    folder = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.concat(F.array_join(F.aggregate(parts, none, step), "/"), folder)


def resolve(base: Column, reference: Column) -> Column:
    """An IRI reference against a base; null if it is relative and there is no base."""
    root = F.regexp_extract(base, rf"({SCHEME}(?://[^/?#]*)?)", 1)
    path = F.regexp_extract(base, rf"{SCHEME}(?://[^/?#]*)?([^?#]*)", 1)
    folder = F.when((path == "") & root.contains("//"), "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    own = F.regexp_extract(reference, "^([^?#]*)", 1)
    tail = F.substr(reference, F.length(own) + 1)
    return (
        F.when(reference.rlike(SCHEME), reference)
        .when(reference.startswith("//"), F.concat(F.regexp_extract(base, f"({SCHEME})", 1), reference))
        .when((reference == "") | reference.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), reference))
        .when(reference.startswith("?"), F.concat(root, path, reference))
        .when(reference.startswith("/"), F.concat(root, _without_dots(own), tail))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, own)), tail))
    )


def _held(rows: DataFrame, keys: list[str], more: list[str] = []) -> DataFrame:  # noqa: B006
    """`rows` (keys, n, i, iri, more) with `iri` as the last one that is not null, up to the row, by n and i.

    First within chunks of statements, then over the chunks, so no task gets all rows of a key.
    """
    chunked = rows.withColumn("chunk", F.floor(F.col("n") / CHUNK_LINES))
    chunk = [*keys, "chunk"]
    ends = chunked.groupBy(*chunk).agg(F.max(F.when(F.col("iri").isNotNull(), F.struct("n", "i", "iri")))["iri"].alias("end"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*[F.col(c).alias(f"_{c}") for c in chunk], F.last("end", True).over(earlier).alias("start"))
    inside = Window.partitionBy(*chunk).orderBy("n", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = chunked.withColumn("iri", F.last("iri", True).over(inside))
    same = [F.col(c) == F.col(f"_{c}") for c in chunk]
    return here.join(starts, same).select(*keys, "n", "i", F.coalesce("iri", "start").alias("iri"), *more)


def _bases(directives: DataFrame) -> DataFrame:
    """Rows ``(file, n, i, iri)``: the absolute IRIs that base directives set.

    `directives`: file, n, i, kind, prefix, iri. Relative bases that follow one another
    are resolved in order, in one row for each absolute base that has such after it.
    """
    bases = directives.where(F.lower("kind") == "base").select("file", "n", "i", "iri")
    absolute = F.col("iri").rlike(SCHEME)
    if bases.where(~absolute).isEmpty():
        return bases
    marks = bases.select("file", "n", "i", F.when(absolute, F.to_json(F.struct("n", "i", "iri"))).alias("iri"))
    relative = bases.where(~absolute).join(_held(marks, ["file"]).withColumnRenamed("iri", "after"), ["file", "n", "i"])
    listed = F.array_sort(F.collect_list(F.struct("n", "i", "iri")))
    runs = relative.where("after is not null").groupBy("file", "after").agg(listed.alias("run"))
    size = F.size("run")
    # Arrays that grow by one are copied at each step: blocks keep them short.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / RUN_BLOCK).cast("int")), lambda j: F.slice("run", j * RUN_BLOCK + 1, RUN_BLOCK))
    last = lambda xs: F.element_at(xs, -1)

    def fold(done: Column, block: Column) -> Column:
        start = F.array(last(last(done)))
        step = lambda xs, x: F.concat(xs, F.array(resolve(last(xs), x["iri"])))
        # the first of the result is the base before the block
        return F.concat(done, F.array(F.aggregate(block, start, step)))

    first = F.array(F.array(F.get_json_object("after", "$.iri")))
    folded = F.flatten(F.transform(F.slice(F.aggregate(blocks, first, fold), 2, size), lambda xs: F.slice(xs, 2, RUN_BLOCK)))
    resolved = runs.select("file", F.inline(F.arrays_zip(F.col("run").alias("at"), folded.alias("iri"))))
    return kept(bases.where(absolute).unionByName(resolved.select("file", "at.n", "at.i", "iri")), "turtle-bases")


def bindings(directives: DataFrame, uses: DataFrame) -> DataFrame:
    """Rows ``(file, n, i, prefixes, base)``: what holds at each place, of the names used there.

    `directives`: file, n, i, kind, prefix, iri; those of a statement come before what else
    is in it. `uses`: file, n, i, key, as `turtle_text` names it. Each use of a prefix or of
    the base is put in order with what binds it, so a file may bind as often as it likes.
    """
    each = kept(directives.select("file", "n", "i", "kind", "prefix", "iri"), "turtle-directives")
    bases = _bases(each)
    of_base = bases.select("file", F.lit("base").alias("key"), "n", "i", "iri")
    # a key of its own for the base, as null keys do not meet in a join
    named = each.where(F.lower("kind") != "base").select("file", F.concat(F.lit(":"), F.col("prefix")).alias("key"), "n", "i", "iri")
    absolute = F.col("iri").rlike(SCHEME)
    full = named.where(absolute)
    if not named.where(~absolute).isEmpty():
        asked = named.where(~absolute).select("file", "n", "i", F.lit(None).cast("string").alias("iri")).distinct()
        known = _held(bases.unionByName(asked), ["file"]).withColumnRenamed("iri", "base")
        joined = named.where(~absolute).join(known, ["file", "n", "i"])
        full = full.unionByName(joined.select("file", "key", "n", "i", resolve(F.col("base"), F.col("iri")).alias("iri")))
    asking = uses.select("file", "key", "n", "i", F.lit(None).cast("string").alias("iri"), F.lit(True).alias("asked"))
    rows = full.unionByName(of_base).withColumn("asked", F.lit(False)).unionByName(asking)
    held = _held(rows, ["file", "key"], ["asked"]).where(F.col("asked") & F.col("iri").isNotNull())
    found = held.groupBy("file", "n", "i").agg(F.collect_list(F.struct("key", "iri")).alias("found"))
    is_base = lambda x: x["key"] == "base"
    entries = F.transform(F.filter("found", lambda x: ~is_base(x)), lambda x: F.struct(F.substr(x["key"], F.lit(2)).alias("key"), x["iri"].alias("value")))
    held = found.select("file", "n", "i", F.map_from_entries(entries).alias("prefixes"), F.get(F.filter("found", is_base), F.lit(0))["iri"].alias("base"))
    return kept(held, "turtle-bindings")


def scan_lines(spark: SparkSession, path: str | list[str], files: list[str], sound: str, long: list[str] | None = None, **options: str) -> DataFrame:
    """Records ``(file, prefixes, base, lined)`` of some of the files of a path, for `parse_turtle`.

    `long`: those with triple quotes, all if it is not given.
    """
    cut = kept(chunk_rows(spark, path, files, files if long is None else long, sound, **options), "turtle-cut")
    chunk = ["file", "block", "chunk"]
    by_file = Window.partitionBy("file").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.where(F.col("kind") == turtle_text.CHUNK).select(*chunk, "k", "opens", "found")
    chunks = kept(ends.select(*chunk, F.coalesce(F.sum("k").over(by_file), F.lit(0)).alias("start"), "opens", "found"), "turtle-chunks")
    starts = chunks.select(*chunk, "start")

    def numbered(kind: int) -> DataFrame:
        return cut.where(F.col("kind") == kind).join(starts, chunk).withColumn("n", F.col("start") + F.col("k"))

    parts = F.array_sort(F.collect_list(F.struct("block", "chunk", F.get("lined", F.lit(0)).alias("piece"))))
    texts = numbered(turtle_text.PIECE).groupBy("file", "n").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "\n").alias("text"))
    whole = kept(texts.mapInArrow(turtle_text.parse_statements(sound), turtle_text.WHOLE_DDL), "turtle-statements")
    late = numbered(turtle_text.LATE).select("file", "n", "lined", "opens")

    bound_there = chunks.select("file", "start", F.inline("found")).withColumn("n", F.col("start") + F.col("k"))
    directives = bound_there.drop("start", "k").unionByName(whole.select("file", "n", F.inline("found")).drop("k"))
    each = whole.select("file", "n", "lined", "opens").unionByName(late)
    first = F.col("start") + 1  # the statement before it began before the chunk
    asked = each.select("file", "n", F.lit(LAST).alias("i"), "opens").unionByName(chunks.select("file", first.alias("n"), F.lit(FIRST).alias("i"), "opens"))
    bound = bindings(directives, asked.select("file", "n", "i", F.explode(F.split("opens", "\n")).alias("key")))

    before = chunks.join(bound.where(F.col("i") == FIRST).withColumn("start", F.col("n") - 1).drop("n", "i"), ["file", "start"], "left")
    # how labels of nodes begin on a line of their own
    node = F.concat(F.lit("\n_:anon"), F.lower(F.hex(F.xxhash64("file"))), F.lit("x"))
    before = before.select(*chunk, "start", F.col("prefixes").alias("bound"), F.col("base").alias("based"), node.alias("node"))
    plain = lookup_join(cut.where(F.col("kind") == turtle_text.STATEMENT).select(*chunk, "k", "lined", "own", "base", "opens"), before, chunk)
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce(F.str_to_map("own", F.lit("\n"), F.lit("\t")), none)
    # what is bound in the chunk holds from its place on
    more = F.map_filter(F.coalesce("bound", none), lambda k, _: ~F.map_contains_key(own, k))
    open_ = F.col("opens").isNotNull()
    plain = plain.select(
        "file",
        (F.col("start") + F.col("k")).alias("n"),
        F.when(open_, F.map_concat(own, more)).otherwise(own).alias("prefixes"),
        F.when(open_, F.coalesce("base", "based")).otherwise(F.col("base")).alias("base"),
        "lined",
        "node",
    )
    rest = each.join(bound.where(F.col("i") == LAST).drop("i"), ["file", "n"], "left")
    rest = rest.select("file", "n", F.coalesce("prefixes", none).alias("prefixes"), "base", "lined", node.alias("node"))
    every = plain.unionByName(rest).select("file", "n", "prefixes", "base", "node", F.explode("lined").alias("lined"))
    lined, place = F.concat(F.lit("\n"), F.col("lined")), F.lit(f"\n{turtle_text.PLACE}")
    named = F.substr(F.replace(lined, place, F.concat("node", F.col("n").cast("string"), F.lit("x"))), F.lit(2))
    return every.select("file", "prefixes", "base", F.when(lined.contains(place), named).otherwise(F.col("lined")).alias("lined"))

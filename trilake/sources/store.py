"""Graphs kept as Parquet, split by predicate (and, on request, by graph).

Each predicate is a directory (vertical partitioning), so a pattern with a bound
predicate reads that directory only. Within it rows are sorted by subject, which
gives the row groups narrow subject ranges.

What is written goes to a directory of its own, a version, and takes effect when a
manifest that names it is put in place: a numbered list of the directories a reader
reads. A job that dies before that leaves the graph as it was, and readers that have
opened a manifest keep their graph until `vacuum_store` deletes what it names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trilake.functions import terms
from trilake.session import kept
from trilake.vocab import TRIPLE_COLUMNS, TRIPLES

BUCKETS = 256
#: A filter on each row group tells which subjects and objects it may hold. `adaptive`
#: sizes it by the values it sees, so small files get small ones.
BLOOM = {"parquet.bloom.filter.enabled#s": "true", "parquet.bloom.filter.enabled#o": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def local_part(p: Column) -> Column:
    """Directory value of a predicate: its local name with odd characters replaced.

    Two predicates may share a directory; readers filter on the full IRI as well. The
    leading ``p_`` keeps values such as ``2020`` from being read back as numbers.
    """
    name = terms.local_name(p)
    # Replacing takes several times as long as telling that there is nothing to replace.
    plain = F.when(name.rlike(r"^[A-Za-z0-9_]*+\z"), name).otherwise(F.regexp_replace(name, r"[^A-Za-z0-9_]", "_"))
    return F.concat(F.lit("p_"), plain)


def bucket_part(p: Column) -> Column:
    """Directory value for graphs with very many predicates: a hash of the IRI."""
    return F.concat(F.lit("b_"), F.pmod(F.xxhash64(p), F.lit(BUCKETS)).cast("string"))


def graph_part(g: Column) -> Column:
    """Directory value of a graph; one per graph IRI."""
    return F.when(g.isNull(), "default").otherwise(F.concat(F.lit("g_"), F.md5(g)))


PREDICATE_PARTS = {"p_local": local_part, "p_bucket": bucket_part}


def predicate_filter(df: DataFrame, *predicates: str) -> Column:
    """Rows with one of `predicates`, also on the store's partition column if `df` has it."""
    wanted = F.col("p").isin(*predicates) if len(predicates) > 1 else F.col("p") == predicates[0]
    for column, rule in PREDICATE_PARTS.items():
        if column in df.columns:
            values = [rule(F.lit(p)) for p in predicates]
            wanted = wanted & (F.col(column).isin(*values) if len(values) > 1 else F.col(column) == values[0])
    return wanted


def local_name_filter(df: DataFrame, names: Collection[str]) -> Column:
    """Rows whose predicate has one of these local names, pruned by directory if `df` allows."""
    wanted = terms.local_name(F.col("p")).isin(*names)
    if "p_local" in df.columns:
        wanted = wanted & F.col("p_local").isin(*[local_part(F.lit(name)) for name in names])
    return wanted


def graph_filter(df: DataFrame, graph: str | None) -> Column:
    """Rows of one graph (None = the default graph)."""
    wanted = F.col("g").isNull() if graph is None else F.col("g") == graph
    if "g_part" in df.columns:
        wanted = wanted & (F.col("g_part") == graph_part(F.lit(graph).cast("string")))
    return wanted


LAYOUTS = {"predicate": "p_local", "hash": "p_bucket"}


def _write(triples: DataFrame, path: str, by_graph: bool, layout: str) -> list[str]:
    """Write a new version; its directories, relative to the store."""
    column = LAYOUTS[layout]
    keys = ["g_part", column] if by_graph else [column]
    parts = {column: PREDICATE_PARTS[column](F.col("p")), "g_part": graph_part(F.col("g"))}
    version = f"version={uuid.uuid4().hex}"
    (
        triples.select(*TRIPLE_COLUMNS, *[parts[k].alias(k) for k in keys])
        .hint("rebalance", *keys, "s")
        .sortWithinPartitions(*keys, "s")
        .write.options(**BLOOM)
        .partitionBy(*keys)
        .parquet(f"{path.rstrip('/')}/{version}")
    )
    return _directories(triples.sparkSession, path, version, len(keys))


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _directories(spark: SparkSession, path: str, version: str, depth: int) -> list[str]:
    files, _ = _files(spark, path)
    found = [version]
    for _ in range(depth):
        found = [
            f"{d}/{x.getPath().getName()}"
            for d in found
            for x in files.listStatus(_files(spark, f"{path.rstrip('/')}/{d}")[1])
            if x.isDirectory() and "=" in x.getPath().getName()
        ]
    return sorted(found)


def _manifests(spark: SparkSession, path: str) -> list[int]:
    files, folder = _files(spark, f"{path.rstrip('/')}/_manifests")
    if not files.exists(folder):
        return []
    names = [x.getPath().getName() for x in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the manifest in force."""
    numbers = _manifests(spark, path)
    if not numbers:
        raise ValueError(f"no graph is stored at {path}")
    name = f"{path.rstrip('/')}/_manifests/{numbers[-1]}.json"
    return numbers[-1], json.loads(spark.read.text(name, wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, after: int, content: dict) -> None:
    """Put manifest number `after` + 1 in place, written under another name first.

    Whoever changed the store in between has taken that number, and this change fails.
    """
    files, target = _files(spark, f"{path.rstrip('/')}/_manifests/{after + 1}.json")
    _, draft = _files(spark, f"{path.rstrip('/')}/_manifests/.{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise RuntimeError(f"{path} was changed by another job")


def persist_graph(
    triples: DataFrame,
    path: str,
    mode: str = "overwrite",
    by_graph: bool = False,
    layout: str = "predicate",
    unique: Collection[str] = (),
) -> None:
    """Write a graph as predicate-partitioned, subject-sorted Parquet.

    The rebalance hint clusters rows by (predicate, subject) and lets adaptive
    execution cut partitions to size: a predicate, or one subject, with a large share
    of all rows is written by many tasks, and small predicates do not make small files.
    `layout` "predicate" has a directory for each predicate, "hash" a fixed number of
    ``BUCKETS`` directories, for graphs with thousands of predicates.

    ``mode="append"`` adds the triples that the store does not hold yet, so loading a file
    twice changes nothing; it reads the directories of the predicates in question only,
    and keeps the layout of the store.

    `unique` names predicates whose objects have one subject each within a graph. The
    store remembers them, and every later change is held to them: one that breaks them
    raises `UniquenessError` and leaves the store as it was.
    """
    spark = triples.sparkSession
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode is 'overwrite' or 'append', not {mode!r}")
    numbers = _manifests(spark, path)
    if mode == "append" and numbers:
        if unique:
            raise ValueError("`unique` is set when a store is written anew")
        _append(triples, path)
        return
    content = {"layout": layout, "by_graph": by_graph, "unique": sorted(terms.iri(p) for p in unique), "parts": []}
    parts = _write(triples, path, by_graph, layout)
    _hold_unique(spark, path, content, parts)
    _publish(spark, path, numbers[-1] if numbers else 0, content | {"parts": parts})


class UniquenessError(ValueError):
    """A change would give two subjects the same object of a unique predicate."""


def _hold_unique(spark: SparkSession, path: str, content: dict, written: list[str]) -> None:
    """Raise, and delete what was `written`, if it breaks the store's uniqueness, alone or
    with the directories of `content`.

    Only the directories of unique predicates are read. The written rows are reduced to
    one row for each object first; what is stored is joined with those.
    """
    unique = content.get("unique") or []
    if not unique or not written:
        return
    column = LAYOUTS[content["layout"]]
    wanted = {r[0] for r in spark.createDataFrame([(p,) for p in unique], "p string").select(PREDICATE_PARTS[column](F.col("p"))).collect()}
    chosen = lambda parts: [d for d in parts if d.rsplit("=", 1)[1] in wanted]
    term = ["g", "p", "o", "o_kind", "o_dtype", "o_lang"]
    rows = lambda parts: _read(spark, path, content, chosen(parts)).where(F.col("p").isin(*unique))
    new = rows(written).groupBy(*term).agg(F.min("s").alias("s"), F.max("s").alias("other"))
    stored = rows(content["parts"]).select(F.col("s").alias("other"), *[F.col(c).alias(f"_{c}") for c in term])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in term]
    clash = new.where("s <> other").select("p", "o", "s", "other")
    if chosen(content["parts"]):
        met = new.drop("other").join(stored, [*same, F.col("s") != F.col("other")])
        clash = clash.unionByName(met.select("p", "o", "s", "other"))
    shown = clash.limit(3).collect()
    if shown:
        files, folder = _files(spark, f"{path.rstrip('/')}/{written[0].split('/')[0]}")
        files.delete(folder, True)
        raise UniquenessError("; ".join(f"{r.o!r} of <{r.p}> belongs to {r.s} and {r.other}" for r in shown))


def _append(triples: DataFrame, path: str) -> None:
    spark = triples.sparkSession
    number, content = _manifest(spark, path)
    column = LAYOUTS[content["layout"]]
    part = PREDICATE_PARTS[column]
    given = kept(triples.select(*TRIPLE_COLUMNS), "store-append")
    touched = {r[0] for r in given.select(part(F.col("p"))).distinct().collect()}  # directories, as the driver lists
    held = [d for d in content["parts"] if d.rsplit("=", 1)[1] in touched]
    old = _read(spark, path, content, held).select(*TRIPLE_COLUMNS)
    # Grouped rather than joined: nulls are equal, repeats go, and nothing is sorted.
    marked = given.withColumn("stored", F.lit(False)).unionByName(old.withColumn("stored", F.lit(True)))
    fresh = marked.groupBy(*TRIPLE_COLUMNS).agg(F.max("stored").alias("stored")).where(~F.col("stored")).drop("stored")
    parts = _write(fresh, path, content["by_graph"], content["layout"])
    _hold_unique(spark, path, content, parts)
    _publish(spark, path, number, content | {"parts": content["parts"] + parts})


def _read(spark: SparkSession, path: str, content: dict, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], TRIPLES)
    keys = (["g_part"] if content["by_graph"] else []) + [LAYOUTS[content["layout"]]]
    fields = ", ".join(f"{c} string" for c in [*TRIPLE_COLUMNS, "version", *keys])
    base = path.rstrip("/")
    return spark.read.schema(fields).option("basePath", base).parquet(*[f"{base}/{d}" for d in parts]).drop("version")


def open_graph(spark: SparkSession, path: str) -> DataFrame:
    """A graph written by `persist_graph`; its partition columns stay visible to `pattern`."""
    _, content = _manifest(spark, path)
    return _read(spark, path, content, content["parts"])


def replace_stored_graph(triples: DataFrame, path: str, graph: str | None) -> None:
    """Exchange one graph of a store written with ``by_graph=True``; the others stay.

    The layout is that of the store. Readers see the old graph or the new one.
    """
    spark = triples.sparkSession
    number, content = _manifest(spark, path)
    if not content["by_graph"]:
        raise ValueError("the store is not split by graph")
    others = [d for d in content["parts"] if f"/g_part={_graph_name(spark, graph)}/" not in d]
    moved = triples.withColumn("g", F.lit(graph).cast("string"))
    parts = _write(moved, path, True, content["layout"])
    _hold_unique(spark, path, content | {"parts": others}, parts)
    _publish(spark, path, number, content | {"parts": others + parts})


def clear_stored_graph(spark: SparkSession, path: str, graph: str | None) -> None:
    """Drop one graph of a store written with ``by_graph=True``; the others stay. Writes no data."""
    number, content = _manifest(spark, path)
    others = [d for d in content["parts"] if f"/g_part={_graph_name(spark, graph)}/" not in d]
    _publish(spark, path, number, content | {"parts": others})


def _graph_name(spark: SparkSession, graph: str | None) -> str:
    return spark.range(1).select(graph_part(F.lit(graph).cast("string"))).first()[0]


def vacuum_store(spark: SparkSession, path: str) -> None:
    """Delete all versions that the manifest in force does not name, and older manifests.

    Not while another job writes to the store or reads what an older manifest names.
    """
    number, content = _manifest(spark, path)
    files, folder = _files(spark, path)
    named = {d.split("/")[0] for d in content["parts"]}
    for x in files.listStatus(folder):
        if x.getPath().getName().startswith("version=") and x.getPath().getName() not in named:
            files.delete(x.getPath(), True)
    for old in _manifests(spark, path):
        if old < number:
            files.delete(_files(spark, f"{path.rstrip('/')}/_manifests/{old}.json")[1], False)

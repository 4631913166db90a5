"""Every operator as a named query over the driver's tables.

A query takes ``(spark, sf_dir)`` and returns a DataFrame. All of them run over whole
tables; those that read files first write them to the shared scratch folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilake.functions import terms, values
from trilake.operators import graphs, isomorphism, measures, propgraph as pg
from trilake.operators.patterns import V, bgp, pattern
from trilake.operators.validate import validate_counts
from trilake.plans import driver_tables as dt
from trilake.plans import ecommerce as ec
from trilake.session import kept, scratch_dir
from trilake.sinks import rdf, results as result_sinks
from trilake.sources import files, generate, positions, results as result_sources, store
from trilake.sources.ntriples import read_ntriples, scan_ntriples
from trilake.sources.tables import Literal, Template, triplify
from trilake.sources.turtle import read_turtle
from trilake.vocab import (
    MEASUREMENTS,
    OPERATIONS,
    PREFIXES,
    SCALES,
    TRIPLE_COLUMNS,
    XSD_DATE,
    XSD_DOUBLE,
    XSD_INTEGER,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
COUNTRY = ":NATION_4"
FRAMEWORKS = ["click", "error", "purchase", "view"]  # `signup` is left out on purpose
LOG_OPERATIONS = {raw: shown for raw, shown in OPERATIONS.items() if not raw.startswith("write_")}
WIDER_SCALES = [*SCALES, "xxlarge"]
SKIPPED = {raw: "N/A" if raw.startswith("write_") else "TIMEOUT" for raw in OPERATIONS}
FILE_ROWS = 100_000
PACKED = {"compression": "gzip", "maxRecordsPerFile": FILE_ROWS}
LOG_FILE_ROWS = 10_000
REJECT_KEYS = 10_000


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


_written: dict[tuple[str, str, str], str] = {}


def _scratch(spark: SparkSession, sf_dir: str, label: str, write: Callable[[str], None]) -> str:
    """Path of files that several queries of one application read; written once."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _written:
        path = scratch_dir(spark, label)
        write(path)
        _written[key] = path
    return _written[key]


def money_text(triples: DataFrame) -> DataFrame:
    """Doubles shown with two digits, so that their text does not depend on the engine."""
    cents = F.col("o").try_cast("decimal(18,2)").cast("string")
    return triples.withColumn("o", F.when(F.col("o_dtype") == XSD_DOUBLE, cents).otherwise(F.col("o")))


def shown(triples: DataFrame) -> DataFrame:
    return money_text(triples).select(*TRIPLE_COLUMNS)


def _text_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money_text(dt.graph(spark, sf_dir, "rows"))


def _ntriples_path(spark: SparkSession, sf_dir: str) -> str:
    return _scratch(spark, sf_dir, "nt", lambda p: rdf.write_ntriples(_text_graph(spark, sf_dir), p, **PACKED))


# ---------------------------------------------------------------- sources


@query
def read_ntriples_(spark, sf_dir):
    return shown(read_ntriples(spark, _ntriples_path(spark, sf_dir)))


@query
def read_turtle_(spark, sf_dir):
    path = _scratch(spark, sf_dir, "ttl", lambda p: rdf.write_turtle(_text_graph(spark, sf_dir), p))
    return shown(read_turtle(spark, path))


@query
def load_named_graph(spark, sf_dir):
    loaded = graphs.load_into(dt.customer_triples(spark, sf_dir), dt.CUSTOMERS_GRAPH)
    return shown(graphs.load_into(dt.product_triples(spark, sf_dir), dt.PARTS_GRAPH, into=loaded))


@query
def load_file_count(spark, sf_dir):
    """Files of one region's customers each, found by pattern and read: triples per file."""

    def write(path: str) -> None:
        rows = dt.table(spark, sf_dir, "customer").select(F.pmod("c_nationkey", F.lit(5)).alias("part"), "c_custkey").distinct()
        subject = F.concat(F.lit("<http://benchmark.example/C"), F.col("c_custkey").cast("string"), F.lit("> <http://benchmark.example/part> "))
        line = F.concat(subject, F.lit('"'), F.col("part").cast("string"), F.lit('" .'))
        rows.select("part", line.alias("value")).repartition("part").write.partitionBy("part").text(path)

    path = _scratch(spark, sf_dir, "parts", write)
    read = files.read_files(spark, path, "part-*.txt")
    return read.groupBy(F.col("o").alias("part")).agg(F.count(F.lit(1)).alias("triples"))


@query
def load_stats(spark, sf_dir):
    def write(path: str) -> None:
        lines = rdf.ntriples_lines(dt.customer_triples(spark, sf_dir, "rows"))
        key = F.col("c_custkey").cast("string")
        comments = dt.table(spark, sf_dir, "customer").select(F.concat(F.lit("# customer "), key).alias("value"))
        broken = dt.table(spark, sf_dir, "customer").select(F.concat(F.lit("<broken> "), key).alias("value"))
        lines.union(lines).union(comments).union(broken).write.text(path)

    return files.load_stats(scan_ntriples(spark, _scratch(spark, sf_dir, "stats", write)))


@query
def file_count(spark, sf_dir):
    """How many files the pattern of `load_file_count` finds: one for each region."""
    load_file_count(spark, sf_dir)
    return files.file_count(spark, _written[spark.sparkContext.applicationId, sf_dir, "parts"], "part-*.txt")


@query
def load_rejects(spark, sf_dir):
    """A comment, a good line and a bad one for each customer, in files of a range of keys: where the bad ones are."""
    kinds = ["broken {k}", "<http://benchmark.example/c{k}> name .", "<http://benchmark.example/c{k}> <http://benchmark.example/p> {k} .",
             '<http://benchmark.example/c{k}> <http://benchmark.example/p> "{k}" ;']

    def write(path: str) -> None:
        key = F.col("c_custkey")
        filled = [F.replace(F.lit(kind), F.lit("{k}"), key.cast("string")) for kind in kinds]
        good = F.concat(F.lit("<http://benchmark.example/c"), key.cast("string"), F.lit('> <http://benchmark.example/p> "x" .'))
        lines = F.array(F.concat(F.lit("# "), key.cast("string")), good, F.element_at(F.array(*filled), (F.pmod(key, F.lit(4)) + 1).cast("int")))
        rows = dt.table(spark, sf_dir, "customer").select(F.floor(key / REJECT_KEYS).alias("part"), "c_custkey", F.posexplode(lines).alias("n", "value"))
        ordered = rows.repartition("part").sortWithinPartitions("part", "c_custkey", "n")
        ordered.select("part", "value").write.partitionBy("part").text(path)

    found = positions.ntriples_rejects(spark, _scratch(spark, sf_dir, "rejects", write))
    return found.select(F.regexp_extract("file", r"part=(\d+)", 1).alias("part"), "line", "reason", "text")


@query
def open_graph(spark, sf_dir):
    path = _scratch(spark, sf_dir, "store", lambda p: store.persist_graph(dt.graph(spark, sf_dir, "rows"), p))
    return shown(store.open_graph(spark, path))


@query
def replace_stored_graph(spark, sf_dir):
    """A store with one directory per graph and hashed predicates; the parts' graph is replaced."""

    def write(path: str) -> None:
        store.persist_graph(dt.named_graphs(spark, sf_dir, "rows"), path, by_graph=True, layout="hash")
        categories = dt.product_triples(spark, sf_dir).where(F.col("p") == terms.iri(":category"))
        store.replace_stored_graph(categories, path, dt.PARTS_GRAPH)

    return shown(store.open_graph(spark, _scratch(spark, sf_dir, "store-replaced", write)))


@query
def clear_stored_graph(spark, sf_dir):
    def write(path: str) -> None:
        store.persist_graph(dt.named_graphs(spark, sf_dir, "rows"), path, by_graph=True)
        store.clear_stored_graph(spark, path, dt.PARTS_GRAPH)

    return shown(store.open_graph(spark, _scratch(spark, sf_dir, "store-cleared", write)))


@query
def append_stored_graph(spark, sf_dir):
    """Parts that overlap, added to a store one after another, one of them twice."""

    def write(path: str) -> None:
        made = (dt.customer_triples, dt.product_triples, dt.order_triples)
        customers, parts, orders = (money_text(triples(spark, sf_dir, "rows")) for triples in made)
        store.persist_graph(customers.unionByName(parts), path)
        for more in (parts.unionByName(orders), orders):
            store.persist_graph(more, path, "append")

    return shown(store.open_graph(spark, _scratch(spark, sf_dir, "store-appended", write)))


@query
def unique_stored_graph(spark, sf_dir):
    """Customers' codes, unique on load, in two parts; then each third customer's code for another subject, which is refused."""

    def codes(stem: str, rows: DataFrame) -> DataFrame:
        number = F.col("c_custkey").cast("string")
        term = {"s": F.concat(F.lit(terms.iri(":" + stem)), number), "p": F.lit(terms.iri(":code")), "o": F.concat(F.lit("code "), number), "o_kind": F.lit("literal")}
        return rows.select(*[term.get(c, F.lit(None).cast("string")).alias(c) for c in TRIPLE_COLUMNS])

    def write(path: str) -> None:
        customers = dt.table(spark, sf_dir, "customer").select("c_custkey")
        store.persist_graph(codes("C", customers.where("c_custkey % 2 = 0")), path, unique=[":code"])
        store.persist_graph(codes("C", customers.where("c_custkey % 2 <> 0")), path, "append")
        try:
            store.persist_graph(codes("D", customers.where("c_custkey % 3 = 0")), path, "append")
        except store.UniquenessError:
            return
        raise AssertionError("a code has two subjects")

    return shown(store.open_graph(spark, _scratch(spark, sf_dir, "store-unique", write)))


@query
def roundtrip_bnodes(spark, sf_dir):
    """Orders as blank nodes in several files, joined on them after reading."""
    orders = dt.order_triples(spark, sf_dir, "rows").where(F.col("p").isin(terms.iri(":placedBy"), terms.iri(":orderStatus")))
    blank = orders.withColumn("s", F.concat(F.lit("_:"), terms.local_name(F.col("s"))))
    path = _scratch(spark, sf_dir, "bnodes", lambda p: rdf.write_turtle(blank.repartition(3, "p"), p))
    read = read_turtle(spark, path, bnode_scope="dataset")
    rows = bgp(read, [(V("order"), ":placedBy", V("customer")), (V("order"), ":orderStatus", V("status"))])
    return rows.groupBy("customer", "status").agg(F.count("order").alias("orders"))


@query
def canonical_bnodes(spark, sf_dir):
    """Addresses and countries without names, written and read under other labels: triples per
    predicate, and how many of them are not the same up to the labels."""
    key = F.col("c_custkey").cast("string")
    address, country = F.concat(F.lit("_:a"), key), F.concat(F.lit("_:n"), key)
    end = lambda p, s, o, kind: F.struct(s.alias("s"), F.lit(terms.iri(p)).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    facts = F.array(
        end(":address", F.concat(F.lit(terms.iri(":C")), key), address, "bnode"),
        end(":segment", address, F.col("c_mktsegment"), "literal"),
        end(":country", address, country, "bnode"),
        end("rdfs:label", country, F.col("c_nationkey").cast("string"), "literal"),
    )
    rows = dt.table(spark, sf_dir, "customer").select(F.inline(facts))
    graph = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in TRIPLE_COLUMNS])
    blank = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:x"), F.md5(F.col(c).cast("binary")))).otherwise(F.col(c))
    renamed = graph.withColumn("s", blank("s")).withColumn("o", blank("o"))
    path = _scratch(spark, sf_dir, "bnodes-renamed", lambda p: rdf.write_ntriples(renamed, p))
    read = kept(read_ntriples(spark, path, bnode_scope="dataset", on_reject="error"), "bnodes-read")
    named = kept(isomorphism.canonical_graph(read), "bnodes-named")
    apart = isomorphism.graph_differences(graph, read, named).groupBy("p").agg(F.sum(F.abs(F.col("in_left") - F.col("in_right"))).alias("apart"))
    sizes = named.groupBy("p").agg(F.sum("n").alias("triples"), F.max("n").alias("alike"))
    return sizes.join(apart, "p", "left").select("p", "triples", "alike", F.coalesce("apart", F.lit(0)).cast("bigint").alias("apart"))


@query
def read_turtle_hard(spark, sf_dir):
    """Texts that can not be cut at line ends: comments within statements, long strings,
    Windows line ends, and one prefix bound twice in a file."""
    customer, orders = dt.table(spark, sf_dir, "customer"), dt.table(spark, sf_dir, "orders")
    name = F.concat(F.lit("x:c"), F.col("c_custkey").cast("string"))
    first = F.concat(
        F.lit("@prefix x: <http://one.example/> .\r\n# a comment with \"\"\" .\n"), name, F.lit(" x:name "), F.lit('"'), "c_name", F.lit('" ; # more to come .\n  x:note '),
        F.lit('"""A "'), "c_mktsegment", F.lit('" .\n:no :triple :here .\n""" .\n@prefix x: <http://two.example/> .\n'), name, F.lit(" x:nation "), F.col("c_nationkey").cast("string"), F.lit(" ."),
    )
    second = F.concat(F.lit("PREFIX x: <http://two.example/>\r\nx:o"), F.col("o_orderkey").cast("string"), F.lit(" x:status x:"), "o_orderstatus", F.lit("."))

    def write(path: str) -> None:
        texts = customer.select(first.alias("value")).unionByName(orders.select(second.alias("value")))
        texts.write.text(path)

    return read_turtle(spark, _scratch(spark, sf_dir, "hard", write)).select("s", "p", "o", "o_kind", "o_dtype")


@query
def read_turtle_nested(spark, sf_dir):
    """An address without a name for each customer, and a list of each order's facts; items in their order."""
    customer, orders = dt.table(spark, sf_dir, "customer"), dt.table(spark, sf_dir, "orders")
    first = F.concat(
        F.lit("@base <http://base.example/x/> . @prefix : <v#> .\n<c"), F.col("c_custkey").cast("string"), F.lit("> :address [ :nation "),
        F.col("c_nationkey").cast("string"), F.lit(" ; :segment '"), "c_mktsegment", F.lit("' , [ :of <../y> ] ] ."),
    )
    second = F.concat(
        F.lit("BASE <http://base.example/x/>\nPREFIX : <v#> <o"), F.col("o_orderkey").cast("string"), F.lit("> :facts ( <c"),
        F.col("o_custkey").cast("string"), F.lit("> '"), "o_orderstatus", F.lit("' () )."),
    )

    def write(path: str) -> None:
        customer.select(first.alias("value")).unionByName(orders.select(second.alias("value"))).write.options(**PACKED).text(path)

    read = kept(read_turtle(spark, _scratch(spark, sf_dir, "nested", write)), "nested-read", compression="zstd")
    base, v = "http://base.example/x/", "http://base.example/x/v#"
    first, rest = (f"http://www.w3.org/1999/02/22-rdf-syntax-ns#{x}" for x in ("first", "rest"))
    addresses = bgp(
        read,
        [(V("s"), v + "address", V("a")), (V("a"), v + "nation", V("one", "term")), (V("a"), v + "segment", V("b")), (V("b"), v + "of", V("two"))],
    )
    lists = bgp(
        read,
        [(V("s"), v + "facts", V("l1")), (V("l1"), first, V("one", "term")), (V("l1"), rest, V("l2")), (V("l2"), first, V("two")),
         (V("l2"), rest, V("l3")), (V("l3"), first, V("none")), (V("l3"), rest, V("none"))],
    )
    both = addresses.select("s", F.col("one.value").alias("one"), "two").unionByName(lists.select("s", F.col("one.value").alias("one"), "two"))
    return both.withColumn("s", F.replace("s", F.lit(base), F.lit("")))


@query
def generate_entities(spark, sf_dir):
    """Three tables of the sizes of customer, part and orders, under one heading."""
    sizes = [dt.table(spark, sf_dir, name).count() for name in ("customer", "part", "orders")]
    customers, products, orders = generate.generate_entities(spark, *sizes)
    none = F.lit(None)

    def row(df, entity, label, kind, group, number, amount, day):
        return df.select(
            F.lit(entity).alias("entity"),
            "id",
            label.cast("string").alias("label"),
            kind.cast("string").alias("kind"),
            group.cast("string").alias("grouping_name"),
            number.cast("bigint").alias("number"),
            amount.cast("double").alias("amount"),
            day.cast("date").alias("day"),
        )

    c = F.col
    return (
        row(customers, "customer", c("name"), c("country"), c("segment"), F.length("email"), none, c("signup_date"))
        .unionByName(row(products, "product", c("name"), c("category"), none, c("stock_level"), c("unit_price"), none))
        .unionByName(
            row(orders, "order", c("status"), c("customer"), c("product"), c("quantity"), c("amount"), c("order_date"))
        )
    )


def _generated_graph(spark, sf_dir, layout="branches"):
    """Generated facts about the customers, parts and orders of the tables: their keys
    are the ids, and an order is placed by the customer it has in its table."""

    def ids(name, **columns):
        renamed = [F.col(column).cast("bigint").alias(alias) for alias, column in columns.items()]
        return dt.table(spark, sf_dir, name).select(*renamed)

    return generate.entity_graph(
        generate.customers_of(ids("customer", id="c_custkey")),
        generate.products_of(ids("part", id="p_partkey")),
        generate.orders_of(ids("orders", id="o_orderkey", customer="o_custkey"), dt.table(spark, sf_dir, "part").count()),
        layout,
    )


@query
def generated_q1_count(spark, sf_dir):
    return ec.q1_count(_generated_graph(spark, sf_dir, "rows"))


@query
def generated_q2_customer_orders(spark, sf_dir):
    """Names are few here, so equal names are one group of many customers."""
    return ec.q2_customer_orders(_generated_graph(spark, sf_dir))


@query
def generated_q3_join_3_entities(spark, sf_dir):
    return ec.q3_join_3_entities(_generated_graph(spark, sf_dir))


@query
def generated_q4_optional_aggregation(spark, sf_dir):
    return ec.q4_optional_aggregation(_generated_graph(spark, sf_dir))


@query
def triplify_customers(spark, sf_dir):
    return shown(dt.customer_triples(spark, sf_dir, "rows"))


@query
def triplify_products(spark, sf_dir):
    return shown(dt.product_triples(spark, sf_dir, "rows"))


@query
def triplify_orders(spark, sf_dir):
    return shown(dt.order_triples(spark, sf_dir, "rows"))


@query
def triplify_all(spark, sf_dir):
    return shown(dt.graph(spark, sf_dir))


@query
def read_results(spark, sf_dir):
    def write(path: str) -> None:
        log = dt.measurement_log(spark, sf_dir)
        record = F.to_json(F.struct(*MEASUREMENTS.fieldNames()))
        # event_id is unique, so a file holds at most FILE_ROWS records.
        arrays = log.groupBy(F.floor(F.col("event_id") / FILE_ROWS)).agg(F.collect_list(record).alias("records"))
        text = F.concat(F.lit("["), F.array_join("records", ",\n "), F.lit("]"))
        arrays.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)

    path = _scratch(spark, sf_dir, "log", write)
    return result_sources.read_results(spark, path, "part-*").select(*MEASUREMENTS.fieldNames())


# ---------------------------------------------------------------- sinks


@query
def write_ntriples(spark, sf_dir):
    return rdf.ntriples_lines(_text_graph(spark, sf_dir))


@query
def roundtrip_ntriples(spark, sf_dir):
    """Named graphs are written one by one and read back into their graphs."""
    named = money_text(dt.named_graphs(spark, sf_dir, "rows"))
    read = []
    for label, graph in (("c", dt.CUSTOMERS_GRAPH), ("p", dt.PARTS_GRAPH), ("o", None)):
        part = graphs.dump_graph(named, graph)
        path = _scratch(spark, sf_dir, "nt-" + label, lambda p, part=part: rdf.write_ntriples(part, p, **PACKED))
        read.append(read_ntriples(spark, path, graph, distinct=False))
    return shown(graphs.graph_union(*read))


@query
def write_turtle(spark, sf_dir):
    return rdf.turtle_lines(_text_graph(spark, sf_dir))


@query
def roundtrip_turtle(spark, sf_dir):
    """Subject blocks this time: `;` lists with the prefixes of each file."""
    path = _scratch(spark, sf_dir, "blocks", lambda p: rdf.write_turtle_grouped(_text_graph(spark, sf_dir), p))
    return shown(read_turtle(spark, path))


@query
def turtle_subject_blocks(spark, sf_dir):
    return rdf.turtle_subject_blocks(_text_graph(spark, sf_dir))


@query
def dump_default_graph(spark, sf_dir):
    return shown(graphs.dump_graph(dt.named_graphs(spark, sf_dir)))


@query
def clear_graph(spark, sf_dir):
    return shown(graphs.clear_graph(dt.named_graphs(spark, sf_dir), dt.PARTS_GRAPH))


@query
def replace_graph(spark, sf_dir):
    categories = dt.product_triples(spark, sf_dir).where(F.col("p") == terms.iri(":category"))
    return shown(graphs.replace_graph(dt.named_graphs(spark, sf_dir), dt.PARTS_GRAPH, categories))


@query
def bindings_json(spark, sf_dir):
    """Orders with their customer, its name, the amount as stored, and the quantity where there is one."""
    rows = bgp(
        money_text(dt.graph(spark, sf_dir)),
        [
            (V("order"), ":placedBy", V("customer")),
            (V("order"), ":totalAmount", V("amount", "term")),
            (V("customer"), "rdfs:label", V("name", "term")),
        ],
        optionals=[[(V("order"), ":quantity", V("quantity", "bigint"))]],
    )
    shown = rows.select("order", "customer", "name", "amount", "quantity")
    return result_sinks.to_sparql_json(shown, uris=["order", "customer"])


@query
def result_document(spark, sf_dir):
    """The bindings of `bindings_json` as one result document, read back by the variables of its head."""

    def write(path: str) -> None:
        rows = bgp(
            money_text(dt.graph(spark, sf_dir)),
            [
                (V("order"), ":placedBy", V("customer")),
                (V("order"), ":totalAmount", V("amount", "term")),
                (V("customer"), "rdfs:label", V("name", "term")),
            ],
            optionals=[[(V("order"), ":quantity", V("quantity", "bigint"))]],
        )
        result_sinks.write_result_document(rows.select("order", "customer", "name", "amount", "quantity"), path, uris=["order", "customer"])

    read = result_sources.read_result_document(spark, _scratch(spark, sf_dir, "document", write), {"quantity": "bigint"})
    parts = [F.col("order.kind").alias("kind"), F.col("amount.dtype").alias("dtype"), F.col("name.lang").alias("lang"), "quantity"]
    return read.select(*[F.col(f"{c}.value").alias(c) for c in ("order", "customer", "name", "amount")], *parts)


@query
def roundtrip_results(spark, sf_dir):
    path = _scratch(
        spark, sf_dir, "json", lambda p: result_sinks.write_results(dt.measurement_log(spark, sf_dir), p)
    )
    return result_sources.read_results_lines(spark, path)


@query
def report_rows(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    return result_sinks.report_rows(wide, LOG_OPERATIONS)


# ---------------------------------------------------------------- terms and values


@query
def iri_expand(spark, sf_dir):
    """Each customer's segment under each of the five prefixes, and one unknown prefix."""
    names = dt.table(spark, sf_dir, "customer").select(
        "c_custkey", F.explode(F.array(*[F.lit(p) for p in [*PREFIXES, "nope"]])).alias("prefix"), "c_mktsegment"
    )
    term = F.concat("prefix", F.lit(":"), "c_mktsegment")
    return names.select("c_custkey", term.alias("term")).withColumn("iri", terms.expand(F.col("term")))


@query
def iri_compact(spark, sf_dir):
    """Each part's subject, a class under rdfs:, and an IRI outside all namespaces."""
    part = dt.table(spark, sf_dir, "part")
    subject = Template(":P", "p_partkey", 6).column_expr()
    rdfs_name = F.concat(F.lit(PREFIXES["rdfs"]), "p_type")
    outside = F.concat(F.lit("http://elsewhere.example/"), F.col("p_partkey").cast("string"))
    full = part.select("p_partkey", F.explode(F.array(subject, rdfs_name, outside)).alias("iri"))
    return full.withColumn("short", terms.compact(F.col("iri")))


@query
def literal_split(spark, sf_dir):
    """Typed, plain and misleading literals of each part."""
    size = F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"^^xsd:integer'))
    plain = F.concat(F.lit('"'), "p_name", F.lit('"'))
    nested = F.concat(F.lit('"'), "p_name", F.lit('^^xsd:date"^^xsd:'), "p_type")
    lexemes = dt.table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(size, plain, nested)).alias("lexeme"))
    return lexemes.withColumn("_s", terms.literal_split(F.col("lexeme"))).select("p_partkey", "lexeme", "_s.lex", "_s.dtype")


@query
def typed_values(spark, sf_dir):
    """Typed access by declared datatype; text read as a number has no value."""
    facts = dt.graph(spark, sf_dir, "rows").where(F.col("o_kind") == "literal")
    o, dtype = F.col("o"), F.col("o_dtype")
    return facts.select(
        "s",
        "p",
        terms.term_value(o, XSD_DOUBLE, dtype).alias("as_double"),
        terms.term_value(o, XSD_INTEGER, dtype).alias("as_integer"),
        terms.term_value(o, XSD_DATE, dtype).alias("as_date"),
        F.when(dtype.isNull(), terms.term_value(o, XSD_INTEGER)).alias("from_text"),
    )


@query
def customer_email(spark, sf_dir):
    return dt.table(spark, sf_dir, "customer").select(
        "c_custkey", values.email_address(F.col("c_name"), "#").alias("email")
    )


@query
def round_values(spark, sf_dir):
    seventh = F.col("o_totalprice") / 7.0
    rounded = [F.round(seventh, n).alias(f"round_{n}") for n in (2, 4, 5)]
    return dt.table(spark, sf_dir, "orders").select("o_orderkey", *rounded)


@query
def local_names(spark, sf_dir):
    """Local names of predicates and of IRI objects, with their number of triples."""
    graph = dt.graph(spark, sf_dir, "rows").where(F.col("o_kind") == "iri")
    named = graph.select(terms.local_name(F.col("p")).alias("predicate"), terms.local_name(F.col("o")).alias("object"))
    return named.groupBy("predicate", "object").agg(F.count(F.lit(1)).alias("triples"))


# ---------------------------------------------------------------- patterns and joins


@query
def predicate_local_names(spark, sf_dir):
    """Local names of all predicates; that of the object is null for literals."""
    g = dt.graph(spark, sf_dir, "rows")
    names = g.select(terms.local_name(F.col("p")).alias("predicate"), F.when(F.col("o_kind") == "iri", terms.local_name(F.col("o"))).alias("object"))
    return names.groupBy("predicate", "object").agg(F.count(F.lit(1)).alias("n"))


@query
def pattern_predicate(spark, sf_dir):
    return pattern(dt.graph(spark, sf_dir), V("order"), ":placedBy", V("customer"))


@query
def pattern_object(spark, sf_dir):
    return pattern(dt.graph(spark, sf_dir), V("customer"), ":country", COUNTRY)


@query
def pattern_type(spark, sf_dir):
    return pattern(dt.graph(spark, sf_dir), V("customer"), "rdf:type", ":Customer")


@query
def select_star_limit(spark, sf_dir):
    """How many rows a limit of 5 gives, and how many of them are not in the graph."""
    graph = dt.graph(spark, sf_dir, "rows")
    some = pattern(graph, V("s"), V("p"), V("o")).limit(5)
    known = graph.select("s", "p", "o", F.lit(1).alias("known")).distinct()
    return some.join(known, ["s", "p", "o"], "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("known").isNull()).alias("strangers")
    )


ORDER_STAR = [
    (V("order"), ":placedBy", V("customer")),
    (V("order"), ":totalAmount", V("amount", "double")),
    (V("order"), ":orderStatus", V("status")),
]


@query
def star_join(spark, sf_dir):
    return bgp(dt.graph(spark, sf_dir), ORDER_STAR)


@query
def star_pivot(spark, sf_dir):
    return bgp(dt.graph(spark, sf_dir), ORDER_STAR, strategy="star", single_valued=ec.ORDER_FACTS)


@query
def semi_join_constant(spark, sf_dir):
    return ec.orders_of_country(dt.graph(spark, sf_dir), COUNTRY)


@query
def optional_unmatched(spark, sf_dir):
    """Contents per order status, with the orders that have none."""
    rows = bgp(
        dt.graph(spark, sf_dir),
        [(V("order"), ":orderStatus", V("status"))],
        optionals=[[(V("order"), ":contains", V("product"))]],
        skewed=ec.SKEWED,
    )
    return rows.groupBy("status").agg(
        F.count("product").alias("products"), F.count_if(F.col("product").isNull()).alias("empty_orders")
    )


@query
def optional_filtered(spark, sf_dir):
    """q4 with a condition inside the OPTIONAL, by the general way of counting."""
    graph = dt.graph(spark, sf_dir)
    members = bgp(
        graph,
        [
            (V("customer"), "rdf:type", ":Customer"),
            (V("customer"), ":country", V("country")),
            (V("customer"), ":segment", V("segment")),
        ],
    )
    order_group = [
        (V("order"), ":placedBy", V("customer")),
        (V("order"), ":totalAmount", V("amount", ec.MONEY)),
        (V("order"), ":orderStatus", V("status")),
    ]
    large = (F.col("status") == "F") & (F.col("amount") > 400_000)
    return ec.revenue_by_group(members, graph, order_group, single_valued=(), where=large)


# ---------------------------------------------------------------- benchmark queries


@query
def q1_count(spark, sf_dir):
    return ec.q1_count(dt.graph(spark, sf_dir, "rows"))


@query
def q2_customer_orders(spark, sf_dir):
    return ec.q2_customer_orders(dt.graph(spark, sf_dir))


@query
def q3_join_3_entities(spark, sf_dir):
    return ec.q3_join_3_entities(dt.graph(spark, sf_dir), COUNTRY)


@query
def q4_optional_aggregation(spark, sf_dir):
    return ec.q4_optional_aggregation(dt.graph(spark, sf_dir))


@query
def q4_single_valued(spark, sf_dir):
    """q4 where an order is known to have one customer and one amount."""
    return ec.q4_optional_aggregation(dt.graph(spark, sf_dir), single_valued=ec.ORDER_FACTS)


@query
def group_by_label(spark, sf_dir):
    """Orders and amount per product label; products with equal labels are one group,
    labels with the same text but another language or datatype are not equal.

    Summed per product first, so that one row per product is joined with its label.
    """
    graph = dt.graph(spark, sf_dir)
    items = bgp(
        graph, [(V("order"), ":totalAmount", V("amount", ec.MONEY)), (V("order"), ":contains", V("product"))]
    )
    per_product = items.groupBy("product").agg(F.count("order").alias("n"), ec.exact_sum(F.col("amount")).alias("amount"))
    labels = pattern(graph, V("product"), "rdfs:label", V("product_name", "term"))
    grouped = (
        per_product.join(labels, "product")
        .groupBy("product_name")
        .agg(F.sum("n").alias("order_count"), ec.sum_of_sums(F.col("amount")).alias("total_amount"))
    )
    return grouped.withColumn("product_name", F.col("product_name.value"))


# ---------------------------------------------------------------- named graphs, sets


@query
def graph_sizes(spark, sf_dir):
    return graphs.graph_sizes(dt.named_graphs(spark, sf_dir, "rows"))


@query
def graph_union(spark, sf_dir):
    """Orders of status F and orders above 200,000: the overlap counts once."""

    def part(condition):
        return triplify(
            dt.table(spark, sf_dir, "orders").where(condition),
            Template(":ORD", "o_orderkey", 7),
            ":Order",
            {":placedBy": Template(":C", "o_custkey", 6), ":orderStatus": Literal("o_orderstatus")},
        )

    return shown(graphs.graph_union(part(F.col("o_orderstatus") == "F"), part(F.col("o_totalprice") > 200_000)))


@query
def validate_counts_(spark, sf_dir):
    """Expected sizes from the tables; for parts a quarter too many are expected."""

    def expected(name, graph, per_row):
        size = dt.table(spark, sf_dir, name).agg((F.count(F.lit(1)) * F.lit(per_row)).cast("bigint").alias("expected"))
        return size.select(F.lit(graph).cast("string").alias("g"), "expected")

    wanted = (
        expected("customer", dt.CUSTOMERS_GRAPH, 6)
        .unionByName(expected("part", dt.PARTS_GRAPH, 6.25))
        .unionByName(expected("orders", None, 5))
    )
    return validate_counts(dt.named_graphs(spark, sf_dir, "rows"), wanted)


# ---------------------------------------------------------------- property graph


@query
def pg_nodes(spark, sf_dir):
    nodes = pg.to_nodes(money_text(dt.graph(spark, sf_dir, "rows")))
    pairs = F.transform(F.sort_array(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return nodes.select("uri", F.array_join("labels", ",").alias("labels"), F.array_join(pairs, "|").alias("props"))


@query
def pg_edges(spark, sf_dir):
    return pg.to_edges(dt.graph(spark, sf_dir))


@query
def pg_node_count(spark, sf_dir):
    return ec.pg_q1_count(dt.graph(spark, sf_dir, "rows"))


@query
def pg_label_scan(spark, sf_dir):
    return pg.labelled(dt.graph(spark, sf_dir), "Customer")


@query
def pg_filter_not_null(spark, sf_dir):
    """Orders with an amount and a quantity: an order without lines has no quantity."""
    graph = dt.graph(spark, sf_dir)
    return pg.property_values(graph, "totalAmount").join(pg.property_values(graph, "quantity"), "uri", "left_semi").select("uri")


@query
def pg_filter_equals(spark, sf_dir):
    countries = pg.property_values(dt.graph(spark, sf_dir), "country", ec.AS_PROPS)
    return countries.where(F.col("value") == "NATION_4").select("uri")


@query
def pg_expand(spark, sf_dir):
    graph = dt.graph(spark, sf_dir)

    def ends(label: str, key: str, uri: str, value: str):
        values = pg.property_values(graph, key).select(F.col("uri"), F.col("value").alias(value))
        return pg.labelled(graph, label).join(values, "uri", "left").withColumnRenamed("uri", uri)

    orders, customers = ends("Order", "orderStatus", "src", "status"), ends("Customer", "label", "dst", "customer_name")
    return pg.expand(pg.to_edges(graph, ["placedBy"]), "placedBy", orders, customers).select(
        F.col("src").alias("order"), F.col("dst").alias("customer"), "status", "customer_name"
    )


@query
def pg_overwrite_multival(spark, sf_dir):
    """Names of the items of an order as one property: the greatest is kept."""
    part = dt.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = dt.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    items = triplify(
        lines.join(part, "p_partkey"), Template(":ORD", "l_orderkey", 7), None, {":itemName": Literal("p_name")}
    )
    return pg.overwrite_multival(items)


@query
def pg_schema(spark, sf_dir):
    lists = pg.schema_of(dt.graph(spark, sf_dir, "rows"))
    return lists.select("kind", F.array_join("names", ",").alias("names"))


@query
def pg_sample_nodes(spark, sf_dir):
    """How many nodes a sample of 3 has, and how many of them look like no node there is."""
    nodes = pg.to_nodes(dt.graph(spark, sf_dir, "rows"))
    known = nodes.select("labels", F.array_sort(F.map_keys("props")).alias("keys"), F.lit(1).alias("known")).distinct()
    return pg.sample_nodes(nodes).join(known, ["labels", "keys"], "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("known").isNull()).alias("strangers")
    )


@query
def pg_unique_uri_violations(spark, sf_dir):
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return pg.uniqueness_violations(dt.table(spark, sf_dir, "lineitem").select(key.alias("uri")), "uri")


@query
def pg_q2_customer_orders(spark, sf_dir):
    return ec.pg_q2_customer_orders(dt.graph(spark, sf_dir))


@query
def pg_q3_join_3_entities(spark, sf_dir):
    return ec.pg_q3_join_3_entities(dt.graph(spark, sf_dir), "NATION_4")


@query
def pg_q4_optional_aggregation(spark, sf_dir):
    return ec.pg_q4_optional_aggregation(dt.graph(spark, sf_dir))


# ---------------------------------------------------------------- measurement log


def _log(spark, sf_dir):
    return dt.measurement_log(spark, sf_dir)


def _latest(spark, sf_dir):
    return measures.latest_per_key(_log(spark, sf_dir), ["ts", "event_id"])


def _wide(spark, sf_dir):
    """The log as the report shows it: last write wins, cleaned, mapped, one row per scale."""
    known = measures.filter_known(_latest(spark, sf_dir), FRAMEWORKS)
    cleaned = measures.clean_sentinels(measures.map_operations(known, LOG_OPERATIONS))
    names = list(LOG_OPERATIONS.values())
    return measures.pivot_results(measures.complete_grid(cleaned, WIDER_SCALES, names), names)


@query
def clean_sentinels(spark, sf_dir):
    return measures.clean_sentinels(_log(spark, sf_dir)).select("event_id", "framework", "seconds")


@query
def map_operations(spark, sf_dir):
    return measures.map_operations(_log(spark, sf_dir), LOG_OPERATIONS).select("event_id", "operation")


@query
def filter_known(spark, sf_dir):
    return measures.filter_known(_log(spark, sf_dir), FRAMEWORKS).select("event_id", "framework")


@query
def latest_per_key(spark, sf_dir):
    return _latest(spark, sf_dir)


@query
def latest_by_position(spark, sf_dir):
    """Last write wins by file and place in it: a log without times, written backwards within each file."""

    def write(path: str) -> None:
        rows = _log(spark, sf_dir).select(F.lpad(F.floor(F.col("event_id") / LOG_FILE_ROWS).cast("string"), 12, "0").alias("f"), "*")
        ordered = rows.repartition("f").sortWithinPartitions("f", F.desc("event_id"))
        ordered.select("f", *MEASUREMENTS.fieldNames()).write.partitionBy("f").json(path)

    return measures.latest_per_key(result_sources.read_results_lines(spark, _scratch(spark, sf_dir, "log-lines", write), positions=True))


@query
def best_of_runs(spark, sf_dir):
    return measures.best_of_runs(_log(spark, sf_dir))


@query
def pivot_results(spark, sf_dir):
    return _wide(spark, sf_dir)


@query
def complete_grid(spark, sf_dir):
    return measures.complete_grid(measures.best_of_runs(_log(spark, sf_dir)), WIDER_SCALES, list(OPERATIONS))


@query
def fill_skipped(spark, sf_dir):
    return measures.fill_skipped(_latest(spark, sf_dir), SKIPPED, scales=WIDER_SCALES)


@query
def mark_failed(spark, sf_dir):
    failed = spark.createDataFrame([("error", "large"), ("click", "medium")], "framework string, scale string")
    return measures.mark_failed(_log(spark, sf_dir), failed).select("event_id", *MEASUREMENTS.fieldNames())


@query
def enumerated_order(spark, sf_dir):
    frameworks = ["view", "purchase", "click", "error"]
    ordered = measures.enumerated_order(_log(spark, sf_dir), frameworks, SCALES, list(OPERATIONS))
    return ordered.select(
        "event_id",
        measures.listed_position(F.col("framework"), frameworks).alias("framework_place"),
        measures.listed_position(F.col("scale"), SCALES).alias("scale_place"),
        measures.listed_position(F.col("operation"), list(OPERATIONS)).alias("operation_place"),
    )


def queries() -> dict[str, Query]:
    return {name.rstrip("_"): fn for name, fn in QUERIES.items()}

"""Namespaces, value domains and row types shared by the whole package."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

# The namespaces of the e-commerce graph.
NS = "http://benchmark.example/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"

PREFIXES: dict[str, str] = {"": NS, "rdf": RDF, "rdfs": RDFS, "xsd": XSD, "skos": SKOS}

RDF_TYPE = RDF + "type"
RDFS_LABEL = RDFS + "label"
XSD_STRING = XSD + "string"
XSD_DOUBLE = XSD + "double"
XSD_DECIMAL = XSD + "decimal"
XSD_INTEGER = XSD + "integer"
XSD_BOOLEAN = XSD + "boolean"
XSD_DATE = XSD + "date"

# The value domains of the synthetic e-commerce graph.
COUNTRIES = ["Norway", "Sweden", "Denmark", "Finland", "Germany", "France", "UK", "USA", "Canada", "Japan"]
SEGMENTS = ["Enterprise", "SMB", "Startup", "Consumer", "Government"]
CATEGORIES = ["Software", "Hardware", "Services", "Accessories", "Support"]
STATUSES = ["completed", "pending", "shipped", "cancelled", "returned"]
FIRST_NAMES = [
    "Alice", "Bob", "Charlie", "Diana", "Eve", "Frank", "Grace", "Hank", "Ivy", "Jack",
    "Karen", "Leo", "Mona", "Nate", "Olivia", "Paul", "Quinn", "Rosa", "Sam", "Tina",
]
LAST_NAMES = [
    "Hansen", "Berg", "Larsen", "Olsen", "Johansen", "Andersen", "Pedersen", "Nilsen",
    "Eriksen", "Kristiansen", "Dahl", "Bakke", "Moe", "Vik", "Lund",
]
PRODUCT_NAMES = [
    "Laptop Pro", "GPU Cluster", "Cloud License", "USB Hub", "Monitor 4K",
    "Keyboard MX", "Mouse Ergo", "SSD 2TB", "RAM Kit", "Server Rack",
    "VPN Service", "Support Plan", "Tablet X", "Webcam HD", "Dock Station",
]

# The measurement log. Raw operation name -> name in the report.
OPERATIONS: dict[str, str] = {
    "read_turtle": "read_turtle",
    "write_turtle": "write_turtle",
    "read_ntriples": "read_ntriples",
    "write_ntriples": "write_ntriples",
    "query_q1_count": "q1",
    "query_q2_customer_orders": "q2",
    "query_q3_join_3_entities": "q3",
    "query_q4_optional_aggregation": "q4",
}
SCALES = ["medium", "large", "xlarge"]
EXPECTED_TRIPLES = {"medium": 98_000, "large": 1_001_000, "xlarge": 9_995_000}
SENTINELS = ["N/A", "TIMEOUT", "ERROR"]

TRIPLES = StructType(
    [
        StructField("s", StringType(), False),  # full IRI, or blank node label starting with "_:"
        StructField("p", StringType(), False),  # full IRI
        StructField("o", StringType(), False),  # full IRI, blank node label, or unescaped lexical form
        StructField("o_kind", StringType(), False),  # iri | bnode | literal
        StructField("o_dtype", StringType(), True),  # full datatype IRI; null = plain (xsd:string)
        StructField("o_lang", StringType(), True),
        StructField("g", StringType(), True),  # null = default graph
    ]
)
TRIPLE_COLUMNS = TRIPLES.fieldNames()

MEASUREMENTS = StructType(
    [
        StructField("framework", StringType()),
        StructField("scale", StringType()),
        StructField("operation", StringType()),
        StructField("seconds", StringType()),  # a number or a sentinel, hence text
    ]
)

"""For each query an equivalent in plain SQL, straight from the relational tables.

None of these goes through a triples view that the Spark side shares, so a mistake in
the mapping shows. Sums run over decimals, as in the queries.
"""

from __future__ import annotations

from trilake.vocab import (
    CATEGORIES,
    COUNTRIES,
    FIRST_NAMES,
    LAST_NAMES,
    NS,
    OPERATIONS,
    PRODUCT_NAMES,
    RDF,
    RDF_TYPE,
    RDFS,
    RDFS_LABEL,
    SCALES,
    SEGMENTS,
    SKOS,
    STATUSES,
    XSD,
)

C = f"printf('{NS}C%06d', {{}})"
P = f"printf('{NS}P%06d', {{}})"
ORD = f"printf('{NS}ORD%07d', {{}})"
MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)"
EMAIL = "lower(replace(c_name, '#', '.')) || '@example.com'"
DAY = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"
NAMED = "customer JOIN nation ON c_nationkey = n_nationkey"


def _row(source: str, s: str, p: str, o: str, kind: str = "literal", dtype: str | None = None) -> str:
    dtype_sql = f"'{XSD}{dtype}'" if dtype else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT {s} AS s, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, {dtype_sql} AS o_dtype, "
        f"CAST(NULL AS VARCHAR) AS o_lang FROM {source}"
    )


CUSTOMERS = " UNION ALL ".join(
    [
        _row("customer", C.format("c_custkey"), RDF_TYPE, f"'{NS}Customer'", "iri"),
        _row("customer", C.format("c_custkey"), RDFS_LABEL, "c_name"),
        _row("customer", C.format("c_custkey"), NS + "email", EMAIL),
        _row(NAMED, C.format("c_custkey"), NS + "country", f"'{NS}' || n_name", "iri"),
        _row("customer", C.format("c_custkey"), NS + "segment", f"'{NS}' || c_mktsegment", "iri"),
        _row("customer", C.format("c_custkey"), NS + "acctBal", MONEY.format("c_acctbal"), dtype="double"),
    ]
)
PRODUCTS = " UNION ALL ".join(
    [
        _row("part", P.format("p_partkey"), RDF_TYPE, f"'{NS}Product'", "iri"),
        _row("part", P.format("p_partkey"), RDFS_LABEL, "p_name"),
        _row("part", P.format("p_partkey"), NS + "unitPrice", MONEY.format("p_retailprice"), dtype="double"),
        _row("part", P.format("p_partkey"), NS + "category", "p_type"),
        _row("part", P.format("p_partkey"), NS + "stockLevel", "CAST(p_size AS VARCHAR)", dtype="integer"),
    ]
)
PAIRS = "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"
QUANTITIES = "(SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY l_orderkey)"
ORDERS = " UNION ALL ".join(
    [
        _row("orders", ORD.format("o_orderkey"), RDF_TYPE, f"'{NS}Order'", "iri"),
        _row("orders", ORD.format("o_orderkey"), NS + "placedBy", C.format("o_custkey"), "iri"),
        _row("orders", ORD.format("o_orderkey"), NS + "totalAmount", MONEY.format("o_totalprice"), dtype="double"),
        _row("orders", ORD.format("o_orderkey"), NS + "orderDate", DAY, dtype="date"),
        _row("orders", ORD.format("o_orderkey"), NS + "orderStatus", "o_orderstatus"),
        _row(QUANTITIES, ORD.format("l_orderkey"), NS + "quantity", "CAST(quantity AS VARCHAR)", dtype="integer"),
        _row(PAIRS, ORD.format("l_orderkey"), NS + "contains", P.format("l_partkey"), "iri"),
    ]
)


def _graph(body: str, graph: str | None = None) -> str:
    g = f"'{NS}g/{graph}'" if graph else "CAST(NULL AS VARCHAR)"
    return f"SELECT *, {g} AS g FROM ({body})"


ALL = f"{CUSTOMERS} UNION ALL {PRODUCTS} UNION ALL {ORDERS}"
NAMED_ALL = " UNION ALL ".join([_graph(CUSTOMERS, "customers"), _graph(PRODUCTS, "parts"), _graph(ORDERS)])


def _nt(body: str) -> str:
    """Lines of N-Triples for a triples query (no text here needs escapes)."""
    return (
        "SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' "
        "WHEN o_dtype IS NULL THEN '\"' || o || '\"' ELSE '\"' || o || '\"^^<' || o_dtype || '>' END || ' .' AS value "
        f"FROM ({body})"
    )


def _short(column: str) -> str:
    out = column
    for prefix, namespace in (("", NS), ("rdf", RDF), ("rdfs", RDFS), ("xsd", XSD)):
        out = f"replace({out}, '{namespace}', '{prefix}:')"
    return out


_OBJECT = (
    f"CASE WHEN o_kind = 'iri' THEN {_short('o')} WHEN o_dtype IS NULL THEN '\"' || o || '\"' "
    f"ELSE '\"' || o || '\"^^' || {_short('o_dtype')} END"
)
_TURTLE = f"SELECT {_short('s')} || ' ' || {_short('p')} || ' ' || {_OBJECT} || ' .' AS value FROM ({ALL})"
_BLOCKS = f"""
WITH t AS (SELECT {_short('s')} AS subject, p <> '{RDF_TYPE}' AS later, {_short('p')} AS pt, {_OBJECT} AS ot FROM ({ALL}))
SELECT subject, subject || ' ' || string_agg(pt || ' ' || ot, chr(32) || ';' || chr(10) || '  ' ORDER BY later, pt, ot) || ' .' AS block
FROM t GROUP BY subject
"""

# ---------------------------------------------------------------- generated tables


def _hash(salt: int, seed: int = 42) -> str:
    m = 2147483647

    def spread(part: str, step: int, first: int, second: int) -> str:
        return f"(((({part}) * {first} + {salt * 40503 + seed + step}) % {m}) * {second + 2 * salt}) % {m}"

    high = spread(f"(id % {m} + (id // {m}) * 65537) % {m}", 7919, 742938285, 950706376)
    return f"(({high}) * {m} + ({spread(f'id % {m}', 0, 48271, 69621)}))"


def _pick(choices: list[str], salt: int) -> str:
    listed = ", ".join(f"'{c}'" for c in choices)
    return f"([{listed}])[CAST(({_hash(salt)}) % {len(choices)} + 1 AS BIGINT)]"


def _between(salt: int, low: int, high: int) -> str:
    return f"(({_hash(salt)}) % {high - low + 1} + {low})"


def _cents(salt: int, low: int, high: int) -> str:
    return f"CAST({_between(salt, low, high)} AS DOUBLE) / CAST(100 AS DOUBLE)"


def _day(year: int, month: int, day: int, low: int, high: int) -> str:
    return f"make_date({_between(year, low, high)}, {_between(month, 1, 12)}, {_between(day, 1, 28)})"


def _ids(table: str) -> str:
    return f"(SELECT unnest(range((SELECT count(*) FROM {table}))) AS id)"


_NAME = f"{_pick(FIRST_NAMES, 1)} || ' ' || {_pick(LAST_NAMES, 2)}"
_GENERATED = f"""
SELECT 'customer' AS entity, id, {_NAME} AS label, {_pick(COUNTRIES, 3)} AS kind,
       {_pick(SEGMENTS, 4)} AS grouping_name, CAST(length({_NAME}) + 12 AS BIGINT) AS number, CAST(NULL AS DOUBLE) AS amount,
       {_day(5, 6, 7, 2020, 2025)} AS day
FROM {_ids('customer')}
UNION ALL
SELECT 'product', id, CASE WHEN id < 15 THEN {_pick(PRODUCT_NAMES, 11)} ELSE 'Product-' || id END, {_pick(CATEGORIES, 13)},
       NULL, {_between(14, 0, 500)}, {_cents(12, 2999, 299999)}, NULL
FROM {_ids('part')}
UNION ALL
SELECT 'order', id, {_pick(STATUSES, 28)}, CAST(({_hash(21)}) % (SELECT count(*) FROM customer) AS VARCHAR),
       CAST(({_hash(22)}) % (SELECT count(*) FROM part) AS VARCHAR), {_between(23, 1, 20)}, {_cents(24, 5000, 500000)},
       {_day(25, 26, 27, 2021, 2025)}
FROM {_ids('orders')}
"""

# Generated facts about the keys of the tables.
_MADE = f"""
WITH c AS (SELECT id, {_NAME} AS name, {_pick(COUNTRIES, 3)} AS country, {_pick(SEGMENTS, 4)} AS segment
           FROM (SELECT c_custkey AS id FROM customer)),
p AS (SELECT id, CASE WHEN id < 15 THEN {_pick(PRODUCT_NAMES, 11)} ELSE 'Product-' || id END AS name
      FROM (SELECT p_partkey AS id FROM part)),
o AS (SELECT id, customer, ({_hash(22)}) % (SELECT count(*) FROM part) AS product,
             {_cents(24, 5000, 500000)} AS amount, {_pick(STATUSES, 28)} AS status
      FROM (SELECT o_orderkey AS id, o_custkey AS customer FROM orders))
"""
_MADE_Q2 = f"""{_MADE}
SELECT c.name AS customer_name, count(*) AS order_count, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_spend
FROM o JOIN c ON c.id = o.customer GROUP BY 1 ORDER BY total_spend DESC, customer_name, order_count LIMIT 20
"""
_MADE_Q3 = f"""{_MADE}
SELECT c.name AS customer_name, p.name AS product_name, amount, status
FROM o JOIN c ON c.id = o.customer JOIN p ON p.id = o.product WHERE country = 'Norway'
ORDER BY amount DESC, customer_name, product_name, status LIMIT 50
"""
_MADE_Q4 = f"""{_MADE}
SELECT country, segment, count(DISTINCT c.id) AS customers, count(DISTINCT o.id) AS orders,
       CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM c LEFT JOIN o ON o.customer = c.id GROUP BY 1, 2
"""

# ---------------------------------------------------------------- measurement log


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_RAW = list(OPERATIONS)
_MAPPED = {raw: shown for raw, shown in OPERATIONS.items() if not raw.startswith("write_")}
_WIDER = [*SCALES, "xxlarge"]
_KNOWN = "('click', 'error', 'purchase', 'view')"
LOG = f"""
log AS (
  SELECT event_type AS framework, ({_list(SCALES)})[user_id % 3 + 1] AS scale, ({_list(_RAW)})[k % 8 + 1] AS operation,
         CASE k % 10 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'N/A' WHEN 2 THEN 'FAILED' ELSE {MONEY.format('value')} END AS seconds,
         ts, event_id
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events)
),
latest AS (
  SELECT framework, scale, operation, seconds FROM (
    SELECT *, row_number() OVER (PARTITION BY framework, scale, operation ORDER BY ts DESC, event_id DESC) AS n FROM log
  ) WHERE n = 1
)
"""
_CASE_MAP = "CASE operation " + " ".join(f"WHEN '{r}' THEN '{s}'" for r, s in _MAPPED.items()) + " END"
_COLUMNS = ", ".join(f"max(CASE WHEN op = '{s}' THEN v END) AS {s}" for s in _MAPPED.values())
_WIDE = f"""
mapped AS (
  SELECT framework, scale, {_CASE_MAP} AS op, round(TRY_CAST(seconds AS DOUBLE), 5) AS v
  FROM latest WHERE framework IN {_KNOWN} AND {_CASE_MAP} IS NOT NULL
),
frames AS (
  SELECT framework, unnest({_list(_WIDER)}) AS scale FROM (SELECT DISTINCT framework FROM mapped)
),
wide AS (
  SELECT f.framework, f.scale, {_COLUMNS} FROM frames f LEFT JOIN mapped m ON f.framework = m.framework AND f.scale = m.scale
  GROUP BY f.framework, f.scale
)
"""
_CELL = "coalesce(CAST({0} AS VARCHAR), 'null')"
_REPORT = " || ',' || ".join(f"'\"{s}\":' || {_CELL.format(s)}" for s in _MAPPED.values())


def _grid(source: str) -> str:
    return f"""
    cells AS (
      SELECT framework, scale, unnest({_list(_RAW)}) AS operation FROM (
        SELECT framework, unnest({_list(_WIDER)}) AS scale FROM (SELECT DISTINCT framework FROM {source})
      )
    )"""


_SENTINEL = "CASE WHEN c.operation LIKE 'write%' THEN 'N/A' ELSE 'TIMEOUT' END"
_VIEWED = "['view', 'purchase', 'click', 'error']"

# ---------------------------------------------------------------- graph queries

_Q4 = """
SELECT n_name AS country, c_mktsegment AS segment, count(DISTINCT c_custkey) AS customers,
       count(DISTINCT o_orderkey) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN {orders} ON o_custkey = c_custkey
GROUP BY 1, 2
"""
_Q2 = """
SELECT c_name AS customer_name, count(*) AS order_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spend
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_name ORDER BY total_spend DESC, customer_name, order_count LIMIT 20
"""
_Q3 = f"""
SELECT c_name AS customer_name, p_name AS product_name, o_totalprice AS amount, o_orderstatus AS status
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN {PAIRS} ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE n_name = 'NATION_4'
ORDER BY amount DESC, customer_name, product_name, status LIMIT 50
"""
_STAR = (
    f'SELECT {ORD.format("o_orderkey")} AS "order", {C.format("o_custkey")} AS customer, o_totalprice AS amount, '
    "o_orderstatus AS status FROM orders"
)
_CUST, _PART, _ORDER = C.format("c_custkey"), P.format("p_partkey"), ORD.format("o_orderkey")
_LITERALS = [
    ("totalAmount", "orders", _ORDER, "o_totalprice", "NULL", "NULL", "NULL"),
    ("quantity", QUANTITIES, ORD.format("l_orderkey"), "NULL", "quantity", "NULL", "NULL"),
    ("orderDate", "orders", _ORDER, "NULL", "NULL", "CAST(o_orderdate AS DATE)", "NULL"),
    ("orderStatus", "orders", _ORDER, "NULL", "NULL", "NULL", "TRY_CAST(o_orderstatus AS BIGINT)"),
    ("acctBal", "customer", _CUST, "c_acctbal", "NULL", "NULL", "NULL"),
    ("email", "customer", _CUST, "NULL", "NULL", "NULL", "NULL"),
    ("unitPrice", "part", _PART, "p_retailprice", "NULL", "NULL", "NULL"),
    ("stockLevel", "part", _PART, "NULL", "p_size", "NULL", "NULL"),
    ("category", "part", _PART, "NULL", "NULL", "NULL", "TRY_CAST(p_type AS BIGINT)"),
]
_TYPED = " UNION ALL ".join(
    [
        f"SELECT {key} AS s, '{NS}{p}' AS p, CAST({d} AS DOUBLE) AS as_double, CAST({i} AS BIGINT) AS as_integer, "
        f"CAST({t} AS DATE) AS as_date, CAST({x} AS BIGINT) AS from_text FROM {source}"
        for p, source, key, d, i, t, x in _LITERALS
    ]
    + [
        f"SELECT {key}, '{RDFS_LABEL}', NULL, NULL, NULL, TRY_CAST({name} AS BIGINT) FROM {source}"
        for source, key, name in (("customer", _CUST, "c_name"), ("part", _PART, "p_name"))
    ]
)
_EXPANDED = " UNION ALL ".join(
    f"SELECT c_custkey, '{prefix}:' || c_mktsegment AS term, '{namespace}' || c_mktsegment AS iri FROM customer"
    for prefix, namespace in (("", NS), ("rdf", RDF), ("rdfs", RDFS), ("xsd", XSD), ("skos", SKOS), ("nope", "nope:"))
)
_COMPACTED = f"""
SELECT p_partkey, {P.format('p_partkey')} AS iri, printf(':P%06d', p_partkey) AS short FROM part
UNION ALL SELECT p_partkey, '{RDFS}' || p_type, 'rdfs:' || p_type FROM part
UNION ALL SELECT p_partkey, 'http://elsewhere.example/' || p_partkey, '<http://elsewhere.example/' || p_partkey || '>' FROM part
"""
_SPLIT = f"""
SELECT p_partkey, '"' || p_size || '"^^xsd:integer' AS lexeme, '"' || p_size || '"' AS lex, '{XSD}integer' AS dtype FROM part
UNION ALL SELECT p_partkey, '"' || p_name || '"', '"' || p_name || '"', NULL FROM part
UNION ALL SELECT p_partkey, '"' || p_name || '^^xsd:date"^^xsd:' || p_type, '"' || p_name || '^^xsd:date"', '{XSD}' || p_type FROM part
"""
_ROUNDED = ", ".join(f"round(o_totalprice / CAST(7 AS DOUBLE), {n}) AS round_{n}" for n in (2, 4, 5))
_JSON_URI = """'{{"type":"uri","value":"' || {0} || '"}}'"""
_JSON = f"""
SELECT '{{"order":' || {_JSON_URI.format(ORD.format('o_orderkey'))} || ',"customer":' || {_JSON_URI.format(C.format('o_custkey'))}
       || ',"name":{{"type":"literal","value":"' || c_name || '"}},"amount":{{"type":"literal","value":"' || {MONEY.format('o_totalprice')} || '","datatype":"{XSD}double"}}'
       || CASE WHEN quantity IS NULL THEN ''
          ELSE ',"quantity":{{"type":"literal","value":"' || quantity || '","datatype":"{XSD}integer"}}' END || '}}' AS value
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN {QUANTITIES} ON l_orderkey = o_orderkey
"""
_LOCAL = """
SELECT 'type' AS predicate, 'Customer' AS object, count(*) AS triples FROM customer
UNION ALL SELECT 'type', 'Product', count(*) FROM part
UNION ALL SELECT 'type', 'Order', count(*) FROM orders
UNION ALL SELECT 'country', n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'placedBy', printf('C%06d', o_custkey), count(*) FROM orders GROUP BY o_custkey
UNION ALL SELECT 'contains', printf('P%06d', l_partkey), count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_partkey
"""
_PG_NODES = f"""
SELECT {C.format('c_custkey')} AS uri, 'Customer' AS labels,
       'acctBal=' || {MONEY.format('c_acctbal')} || '|email=' || {EMAIL} || '|label=' || c_name AS props FROM customer
UNION ALL
SELECT {P.format('p_partkey')}, 'Product', 'category=' || p_type || '|label=' || p_name || '|stockLevel=' || p_size
       || '|unitPrice=' || {MONEY.format('p_retailprice')} FROM part
UNION ALL
SELECT {ORD.format('o_orderkey')}, 'Order', 'orderDate=' || {DAY} || '|orderStatus=' || o_orderstatus
       || CASE WHEN quantity IS NULL THEN '' ELSE '|quantity=' || quantity END || '|totalAmount=' || {MONEY.format('o_totalprice')}
FROM orders LEFT JOIN {QUANTITIES} ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT '{NS}' || n_name, '', '' FROM {NAMED}
UNION ALL SELECT DISTINCT '{NS}' || c_mktsegment, '', '' FROM customer
"""
_PG_EDGES = f"""
SELECT {ORD.format('o_orderkey')} AS src, 'placedBy' AS type, {C.format('o_custkey')} AS dst FROM orders
UNION ALL SELECT {ORD.format('l_orderkey')}, 'contains', {P.format('l_partkey')} FROM {PAIRS}
UNION ALL SELECT {C.format('c_custkey')}, 'country', '{NS}' || n_name FROM {NAMED}
UNION ALL SELECT {C.format('c_custkey')}, 'segment', '{NS}' || c_mktsegment FROM customer
"""
_PG_SCHEMA = """
SELECT 'label' AS kind, 'Customer,Order,Product' AS names FROM (SELECT count(*) AS n FROM customer) WHERE n > 0
UNION ALL
SELECT 'property', 'acctBal,category,email,label,orderDate,orderStatus,quantity,stockLevel,totalAmount,unitPrice'
FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0
UNION ALL
SELECT 'relationship', 'contains,country,placedBy,segment' FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0
"""
_ORDER_PART = " UNION ALL ".join(
    [
        _row("picked", ORD.format("o_orderkey"), RDF_TYPE, f"'{NS}Order'", "iri"),
        _row("picked", ORD.format("o_orderkey"), NS + "placedBy", C.format("o_custkey"), "iri"),
        _row("picked", ORD.format("o_orderkey"), NS + "orderStatus", "o_orderstatus"),
    ]
)
_SIZES = f"""
SELECT '{NS}g/customers' AS g, 6 * count(*) AS n FROM customer
UNION ALL SELECT '{NS}g/parts', 5 * count(*) FROM part
UNION ALL SELECT NULL, (SELECT 5 * count(*) FROM orders) + (SELECT count(DISTINCT l_orderkey) FROM lineitem)
                       + (SELECT count(*) FROM {PAIRS})
"""

ORACLE: dict[str, str] = {
    "read_ntriples": _graph(ALL),
    "read_turtle": _graph(ALL),
    "load_named_graph": _graph(CUSTOMERS, "customers") + " UNION ALL " + _graph(PRODUCTS, "parts"),
    "load_stats": (
        "SELECT CAST(12 * count(*) AS BIGINT) AS parsed, CAST(6 * count(*) AS BIGINT) AS loaded, count(*) AS rejected FROM customer"
    ),
    "open_graph": _graph(ALL),
    "generate_entities": _GENERATED,
    "generated_q1_count": (
        "SELECT 6 * (SELECT count(*) FROM customer) + 5 * (SELECT count(*) FROM part) + 7 * (SELECT count(*) FROM orders) AS count"
    ),
    "generated_q2_customer_orders": _MADE_Q2,
    "generated_q3_join_3_entities": _MADE_Q3,
    "generated_q4_optional_aggregation": _MADE_Q4,
    "triplify_customers": _graph(CUSTOMERS),
    "triplify_products": _graph(PRODUCTS),
    "triplify_orders": _graph(ORDERS),
    "triplify_all": _graph(ALL),
    "read_results": f"WITH {LOG} SELECT framework, scale, operation, seconds FROM log",
    "write_ntriples": _nt(ALL),
    "roundtrip_ntriples": NAMED_ALL,
    "write_turtle": _TURTLE,
    "roundtrip_turtle": _graph(ALL),
    "turtle_subject_blocks": _BLOCKS,
    "dump_default_graph": _graph(ORDERS),
    "clear_graph": _graph(CUSTOMERS, "customers") + " UNION ALL " + _graph(ORDERS),
    "replace_graph": " UNION ALL ".join(
        [
            _graph(CUSTOMERS, "customers"),
            _graph(ORDERS),
            _graph(_row("part", P.format("p_partkey"), NS + "category", "p_type"), "parts"),
        ]
    ),
    "replace_stored_graph": " UNION ALL ".join(
        [
            _graph(CUSTOMERS, "customers"),
            _graph(ORDERS),
            _graph(_row("part", P.format("p_partkey"), NS + "category", "p_type"), "parts"),
        ]
    ),
    "clear_stored_graph": _graph(CUSTOMERS, "customers") + " UNION ALL " + _graph(ORDERS),
    "roundtrip_bnodes": (
        f"SELECT {C.format('o_custkey')} AS customer, o_orderstatus AS status, count(*) AS orders FROM orders GROUP BY 1, 2"
    ),
    "read_turtle_hard": f"""
        SELECT 'http://one.example/c' || c_custkey AS s, 'http://one.example/name' AS p, c_name AS o, 'literal' AS o_kind, CAST(NULL AS VARCHAR) AS o_dtype FROM customer
        UNION ALL SELECT 'http://one.example/c' || c_custkey, 'http://one.example/note',
            'A "' || c_mktsegment || '" .' || chr(10) || ':no :triple :here .' || chr(10), 'literal', NULL FROM customer
        UNION ALL SELECT 'http://two.example/c' || c_custkey, 'http://two.example/nation', CAST(c_nationkey AS VARCHAR), 'literal', '{XSD}integer' FROM customer
        UNION ALL SELECT 'http://two.example/o' || o_orderkey, 'http://two.example/status', 'http://two.example/' || o_orderstatus, 'iri', NULL FROM orders
    """,
    "load_file_count": "SELECT CAST(c_nationkey % 5 AS VARCHAR) AS part, count(DISTINCT c_custkey) AS triples FROM customer GROUP BY 1",
    "select_star_limit": f"SELECT least(5, count(*)) AS n_rows, CAST(0 AS BIGINT) AS strangers FROM ({ALL})",
    "pg_sample_nodes": (
        "SELECT least(3, (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders)) AS n_rows, "
        "CAST(0 AS BIGINT) AS strangers"
    ),
    "q4_single_valued": _Q4.format(orders="orders"),
    "bindings_json": _JSON,
    "result_document": f"""
        SELECT {ORD.format('o_orderkey')} AS "order", {C.format('o_custkey')} AS customer, c_name AS name, {MONEY.format('o_totalprice')} AS amount,
            'iri' AS kind, '{XSD}double' AS dtype, CAST(NULL AS VARCHAR) AS lang, CAST(quantity AS BIGINT) AS quantity
        FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN {QUANTITIES} ON l_orderkey = o_orderkey
    """,
    "append_stored_graph": _graph(ALL),
    "canonical_bnodes": f"""
        SELECT unnest(['{NS}address', '{NS}segment', '{NS}country', 'http://www.w3.org/2000/01/rdf-schema#label']) AS p,
            count(DISTINCT c_custkey) AS triples, CAST(1 AS BIGINT) AS alike, CAST(0 AS BIGINT) AS apart
        FROM customer
    """,
    "file_count": "SELECT count(DISTINCT c_nationkey % 5) AS files FROM customer",
    "load_rejects": """
        SELECT CAST(c_custkey // 10000 AS VARCHAR) AS part,
            3 * row_number() OVER (PARTITION BY c_custkey // 10000 ORDER BY c_custkey) AS line,
            (['subject', 'predicate', 'object', 'end'])[c_custkey % 4 + 1] AS reason,
            CASE c_custkey % 4
                WHEN 0 THEN 'broken ' || c_custkey
                WHEN 1 THEN '<http://benchmark.example/c' || c_custkey || '> name .'
                WHEN 2 THEN '<http://benchmark.example/c' || c_custkey || '> <http://benchmark.example/p> ' || c_custkey || ' .'
                ELSE '<http://benchmark.example/c' || c_custkey || '> <http://benchmark.example/p> "' || c_custkey || '" ;'
            END AS text
        FROM customer
    """,
    "unique_stored_graph": f"""
        SELECT DISTINCT '{NS}C' || c_custkey AS s, '{NS}code' AS p, 'code ' || c_custkey AS o, 'literal' AS o_kind,
            CAST(NULL AS VARCHAR) AS o_dtype, CAST(NULL AS VARCHAR) AS o_lang, CAST(NULL AS VARCHAR) AS g
        FROM customer
    """,
    "latest_by_position": f"""
        WITH {LOG} SELECT framework, scale, operation, seconds FROM (
            SELECT *, row_number() OVER (PARTITION BY framework, scale, operation ORDER BY event_id // 10000 DESC, event_id) AS n FROM log
        ) WHERE n = 1
    """,
    "predicate_local_names": f"""
        SELECT regexp_extract(p, '[^/#]*$') AS predicate, CASE WHEN o_kind = 'iri' THEN regexp_extract(o, '[^/#]*$') END AS object, count(*) AS n
        FROM ({ALL}) GROUP BY 1, 2
    """,
    "read_turtle_nested": """
        SELECT 'c' || c_custkey AS s, CAST(c_nationkey AS VARCHAR) AS one, 'http://base.example/y' AS two FROM customer
        UNION ALL SELECT 'o' || o_orderkey, 'http://base.example/x/c' || o_custkey, o_orderstatus FROM orders
    """,
    "roundtrip_results": f"WITH {LOG} SELECT framework, scale, operation, seconds FROM log",
    "report_rows": f"WITH {LOG}, {_WIDE} SELECT framework, scale, '{{' || {_REPORT} || '}}' AS json FROM wide",
    "iri_expand": _EXPANDED,
    "iri_compact": _COMPACTED,
    "literal_split": _SPLIT,
    "typed_values": _TYPED,
    "customer_email": f"SELECT c_custkey, {EMAIL} AS email FROM customer",
    "round_values": f"SELECT o_orderkey, {_ROUNDED} FROM orders",
    "local_names": _LOCAL,
    "pattern_predicate": f'SELECT {ORD.format("o_orderkey")} AS "order", {C.format("o_custkey")} AS customer FROM orders',
    "pattern_object": f"SELECT {C.format('c_custkey')} AS customer FROM {NAMED} WHERE n_name = 'NATION_4'",
    "pattern_type": f"SELECT {C.format('c_custkey')} AS customer FROM customer",
    "star_join": _STAR,
    "star_pivot": _STAR,
    "semi_join_constant": (
        f'SELECT {ORD.format("o_orderkey")} AS "order", {C.format("o_custkey")} AS customer FROM orders '
        f"WHERE o_custkey IN (SELECT c_custkey FROM {NAMED} WHERE n_name = 'NATION_4')"
    ),
    "optional_unmatched": (
        "SELECT o_orderstatus AS status, count(l_partkey) AS products, count(*) FILTER (WHERE l_partkey IS NULL) AS empty_orders "
        f"FROM orders LEFT JOIN {PAIRS} ON l_orderkey = o_orderkey GROUP BY 1"
    ),
    "optional_filtered": _Q4.format(
        orders="(SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)"
    ),
    "q1_count": f"SELECT CAST(sum(n) AS BIGINT) AS count FROM ({_SIZES})",
    "q2_customer_orders": _Q2,
    "q3_join_3_entities": _Q3,
    "q4_optional_aggregation": _Q4.format(orders="orders"),
    "group_by_label": (
        "SELECT p_name AS product_name, count(*) AS order_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount "
        f"FROM orders JOIN {PAIRS} ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1"
    ),
    "graph_sizes": f"SELECT g, n AS triples FROM ({_SIZES})",
    "graph_union": _graph(
        "WITH picked AS (SELECT * FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000) " + _ORDER_PART
    ),
    "validate_counts": f"""
        WITH sizes AS ({_SIZES}), wanted AS (
          SELECT '{NS}g/customers' AS g, 6 * count(*) AS expected FROM customer
          UNION ALL SELECT '{NS}g/parts', CAST(floor(6.25 * count(*)) AS BIGINT) FROM part
          UNION ALL SELECT NULL, 5 * count(*) FROM orders)
        SELECT w.g, w.expected, s.n AS triples, s.n >= w.expected * 0.9 AS ok
        FROM wanted w JOIN sizes s ON w.g IS NOT DISTINCT FROM s.g""",
    "pg_nodes": _PG_NODES,
    "pg_edges": _PG_EDGES,
    "pg_node_count": f"SELECT count(*) AS count FROM ({_PG_NODES})",
    "pg_label_scan": f"SELECT {C.format('c_custkey')} AS uri FROM customer",
    "pg_filter_not_null": f"SELECT DISTINCT {ORD.format('o_orderkey')} AS uri FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "pg_filter_equals": f"SELECT {C.format('c_custkey')} AS uri FROM {NAMED} WHERE n_name = 'NATION_4'",
    "pg_expand": (
        f'SELECT {ORD.format("o_orderkey")} AS "order", {C.format("o_custkey")} AS customer, o_orderstatus AS status, '
        "c_name AS customer_name FROM orders JOIN customer ON o_custkey = c_custkey"
    ),
    "pg_overwrite_multival": (
        f"SELECT {ORD.format('l_orderkey')} AS uri, 'itemName' AS key, max(p_name) AS value "
        "FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey"
    ),
    "pg_schema": _PG_SCHEMA,
    "pg_unique_uri_violations": (
        "SELECT l_orderkey || '-' || l_linenumber AS uri, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1"
    ),
    "pg_q2_customer_orders": _Q2,
    "pg_q3_join_3_entities": _Q3,
    "pg_q4_optional_aggregation": _Q4.format(orders="orders"),
    "clean_sentinels": (
        f"WITH {LOG} SELECT event_id, framework, round(TRY_CAST(seconds AS DOUBLE), 5) AS seconds FROM log"
    ),
    "map_operations": f"WITH {LOG} SELECT event_id, {_CASE_MAP} AS operation FROM log WHERE {_CASE_MAP} IS NOT NULL",
    "filter_known": f"WITH {LOG} SELECT event_id, framework FROM log WHERE framework IN {_KNOWN}",
    "latest_per_key": f"WITH {LOG} SELECT * FROM latest",
    "best_of_runs": (
        f"WITH {LOG} SELECT framework, scale, operation, min(TRY_CAST(seconds AS DOUBLE)) AS seconds FROM log GROUP BY 1, 2, 3"
    ),
    "pivot_results": f"WITH {LOG}, {_WIDE} SELECT * FROM wide",
    "complete_grid": f"""
        WITH {LOG}, {_grid('log')}
        SELECT c.framework, c.scale, c.operation, min(TRY_CAST(seconds AS DOUBLE)) AS seconds
        FROM cells c LEFT JOIN log l ON c.framework = l.framework AND c.scale = l.scale AND c.operation = l.operation
        GROUP BY 1, 2, 3""",
    "fill_skipped": f"""
        WITH {LOG}, {_grid('latest')}
        SELECT c.framework, c.scale, c.operation, coalesce(l.seconds, {_SENTINEL}) AS seconds
        FROM cells c LEFT JOIN latest l ON c.framework = l.framework AND c.scale = l.scale AND c.operation = l.operation""",
    "mark_failed": f"""
        WITH {LOG}
        SELECT event_id, framework, scale, operation, CASE WHEN operation LIKE 'read%' AND
          ((framework = 'error' AND scale = 'large') OR (framework = 'click' AND scale = 'medium')) THEN 'FAILED' ELSE seconds END AS seconds
        FROM log""",
    "enumerated_order": f"""
        WITH {LOG}
        SELECT event_id, CAST(coalesce(list_position({_VIEWED}, framework), 0) AS BIGINT) AS framework_place,
               CAST(list_position({_list(SCALES)}, scale) AS BIGINT) AS scale_place,
               CAST(list_position({_list(_RAW)}, operation) AS BIGINT) AS operation_place
        FROM log""",
}

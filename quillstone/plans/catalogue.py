"""Queries over the driver's tables, one or more for each operator, with equivalent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.catalog import Relation, allocate, leaves
from quillstone.functions import convert
from quillstone.functions import fields as ff
from quillstone.operators import changes, layout, paging, search, validation
from quillstone.operators.conditions import parse
from quillstone.operators.filters import FilterOptions, filter_eav, filter_eav_semi, filter_hot_and_eav, filter_entities
from quillstone.operators.paging import Page, next_rows, page_facts, page_rows, page_with_total, project, sort_order
from quillstone.operators.relations import enrich, strip_computed
from quillstone.plans import entities as e
from quillstone.sources.csv import Mapper, import_rows, watch_mapper
from quillstone.sources.tables import get_entity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_ORDER_COLUMNS = ("row_id", "orderkey", "custkey", "status", "totalprice", "priority")
_ORDERS = "SELECT md5('orders:' || o_orderkey) AS row_id, o_orderkey AS orderkey, o_custkey AS custkey, o_orderstatus AS status, o_totalprice AS totalprice, o_orderpriority AS priority"
_FULL = _ORDERS + ", o_orderdate AS orderdate, o_orderpriority LIKE '1-%' AS urgent FROM orders"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _filter(name: str, condition: dict, where: str, options: FilterOptions = FilterOptions()) -> None:
    """A filter on orders, on the nested table."""

    @query(name, f"{_ORDERS} FROM orders WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filter_entities(e.orders(spark, sf_dir), e.ORDERS, parse(condition), options).select(*_ORDER_COLUMNS)


def leaf(attribute: str, value: str) -> dict:
    return {"a": attribute, "v": value}


def both(*children: dict) -> dict:
    return {"l": "and", "c": list(children)}


def either(*children: dict) -> dict:
    return {"l": "or", "c": list(children)}


_TREE = both(leaf("totalprice", "gte:200000"), either(leaf("status", "O"), leaf("priority", "starts_with:1-")))
_TREE_SQL = "o_totalprice >= 200000 AND (o_orderstatus = 'O' OR starts_with(o_orderpriority, '1-'))"

# B: predicates
_filter("filter_equals", leaf("status", "equals:F"), "o_orderstatus = 'F'")
_filter("filter_equals_by_default", leaf("status", "F"), "o_orderstatus = 'F'")
_filter("filter_not_equals", leaf("status", "not_equals:F"), "o_orderstatus <> 'F'")
_filter("filter_gt", leaf("totalprice", "gt:250000.5"), "o_totalprice > 250000.5")
_filter("filter_gte", leaf("orderkey", "gte:100"), "o_orderkey >= 100")
_filter("filter_lt", leaf("totalprice", "lt:5000"), "o_totalprice < 5000")
_filter("filter_lte", leaf("custkey", "lte:10"), "o_custkey <= 10")
_filter("filter_starts_with", leaf("priority", "starts_with:1-"), "starts_with(o_orderpriority, '1-')")
_filter("filter_contains", leaf("priority", "contains:IUM"), "contains(o_orderpriority, 'IUM')")
_filter("filter_raw_like", leaf("priority", "starts_with:_-H"), "o_orderpriority LIKE '_-H%'", FilterOptions(raw_like=True))
_filter("filter_literal_like", either(leaf("priority", "starts_with:_-H"), leaf("priority", "contains:%")), "starts_with(o_orderpriority, '_-H') OR contains(o_orderpriority, '%')")
_filter("filter_in", leaf("status", "in:F,P"), "o_orderstatus IN ('F', 'P')")
_filter("filter_not_in", leaf("status", "not_in:F,P"), "o_orderstatus NOT IN ('F', 'P')")
_filter("filter_tree_and_or", _TREE, _TREE_SQL)
_filter("filter_top_level_or", either(leaf("status", "P"), leaf("totalprice", "lt:3000")), "o_orderstatus = 'P' OR o_totalprice < 3000")
_filter("filter_match_all", both(), "true")
_filter("filter_date_iso", leaf("orderdate", "gte:1998-06-01T00:00:00Z"), "o_orderdate >= TIMESTAMP '1998-06-01'")
_filter("filter_date_epoch_ms", leaf("orderdate", "lt:880000000000"), "o_orderdate < make_timestamp(880000000000000)")
_filter("filter_date_day", both(leaf("orderdate", "gte:1996-03-01"), leaf("orderdate", "lt:1996-04")), "o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01'")
_filter("filter_bool_native", leaf("urgent", "true"), "o_orderpriority LIKE '1-%'")
_filter("filter_epsilon_equality", leaf("totalprice", "112946.2600001"), "abs(o_totalprice - 112946.2600001) <= 1e-5", FilterOptions(epsilon=1e-5))
_filter("filter_raw_slot_name", both(leaf("text_01", "F"), leaf("bigint_02", "lt:100")), "o_orderstatus = 'F' AND o_custkey < 100")


@query("filter_part_text_and_range", "SELECT md5('part:' || p_partkey) AS row_id, p_name AS name, p_size AS size FROM part WHERE contains(p_name, 'ring') AND p_size BETWEEN 5 AND 20")
def filter_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = parse(both(leaf("name", "contains:ring"), leaf("size", "gte:5"), leaf("size", "lte:20")))
    return filter_entities(e.parts(spark, sf_dir), e.PART, condition).select("row_id", "name", "size")


@query("filter_missing_attr_not_equals", "SELECT md5('document:' || doc_id) AS row_id, doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality <> 1")
def filter_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_entities(e.documents(spark, sf_dir), e.DOCUMENT, parse(leaf("quality", "not_equals:1")))
    return found.select("row_id", "doc_id", "quality")


_EAV_SQL = f"SELECT md5('orders:' || o_orderkey) AS row_id FROM orders WHERE {_TREE_SQL}"


@query("filter_eav_bool_or", _EAV_SQL)
def filter_eav_bool_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_eav(layout.to_eav(e.orders(spark, sf_dir), e.ORDERS), e.ORDERS, parse(_TREE))


@query("filter_eav_exists", _EAV_SQL)
def filter_eav_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = e.orders(spark, sf_dir)
    return filter_eav_semi(df.select("row_id"), layout.to_eav(df, e.ORDERS), e.ORDERS, parse(_TREE))


@query("filter_eav_bool", "SELECT md5('orders:' || o_orderkey) AS row_id FROM orders WHERE o_orderpriority LIKE '1-%'")
def filter_eav_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_eav(layout.to_eav(e.orders(spark, sf_dir), e.ORDERS), e.ORDERS, parse(leaf("urgent", "1")))


@query("filter_hot_from_eav", f"{_ORDERS} FROM orders WHERE o_orderstatus = 'F' AND starts_with(o_orderpriority, '2-')")
def filter_hot_from_eav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hot predicate on the hot table, an attribute-value predicate by a semi-join with its rows."""
    df = e.orders(spark, sf_dir)
    found = filter_hot_and_eav(df, layout.split_record(df, e.ORDERS)[1], e.ORDERS, parse(leaf("status", "F")), parse(leaf("priority", "starts_with:2-")))
    return found.select(*_ORDER_COLUMNS)


@query("filter_array_any", "SELECT md5('conversation:' || conv_id) AS row_id, conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system')")
def filter_array_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_entities(e.conversations(spark, sf_dir), e.CONVERSATION, parse(leaf("turns.role", "system")))
    return found.select("row_id", "conv_id")


@query("filter_array_cross_element", "SELECT md5('conversation:' || conv_id) AS row_id, conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'assistant') AND bool_or(turn >= 4)")
def filter_array_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = parse(both(leaf("turns.role", "assistant"), leaf("turns.turn", "gte:4")))
    return filter_entities(e.conversations(spark, sf_dir), e.CONVERSATION, condition).select("row_id", "conv_id")


# F: sorting and pages
@query("sort_multi_desc_nulls", f"{_ORDERS.replace('o_orderpriority AS priority', 'nullif(o_orderpriority, {q}5-LOW{q}) AS priority').format(q=chr(39))} FROM orders ORDER BY priority DESC NULLS FIRST, totalprice DESC NULLS FIRST, row_id LIMIT 40")
def sort_multi_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = e.orders(spark, sf_dir).withColumn("priority", F.nullif("priority", F.lit("5-LOW")))
    return page_rows(df, sort_order(df, e.ORDERS, ["priority", "totalprice"], "desc"), Page(1, 40)).select(*_ORDER_COLUMNS)


@query("sort_asc_nulls", "SELECT md5('document:' || doc_id) AS row_id, doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS LAST, row_id LIMIT 500")
def sort_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = e.documents(spark, sf_dir)
    return page_rows(df, sort_order(df, e.DOCUMENT, ["quality"]), Page(1, 500)).select("row_id", "doc_id", "quality")


@query("sort_eav_first_element", "SELECT md5('conversation:' || conv_id) AS row_id, arg_min(role, turn) AS key FROM conversations GROUP BY conv_id")
def sort_eav_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    eav = layout.to_eav(e.conversations(spark, sf_dir), e.CONVERSATION)
    return layout.first_element(eav, e.CONVERSATION.attribute("turns.role"))


_PAGED = f"""
WITH f AS ({_ORDERS}, o_orderdate AS d, count(*) OVER () AS total_records FROM orders WHERE {_TREE_SQL})
SELECT row_id, orderkey, custkey, status, totalprice, priority, total_records, ceil(total_records / 10)::BIGINT AS total_pages
FROM f ORDER BY d DESC NULLS FIRST, row_id LIMIT 10 OFFSET 20"""


@query("page_with_total", _PAGED)
def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = e.orders(spark, sf_dir)
    found = filter_entities(df, e.ORDERS, parse(_TREE))
    page = page_with_total(found, sort_order(found, e.ORDERS, ["orderdate"], "desc"), Page(3, 10))
    return page.select(*_ORDER_COLUMNS, "total_records", "total_pages")


@query("page_metadata", f"""
SELECT n AS total_records, ceil(n / 10)::BIGINT AS total_pages, 3 AS current_page, 10 AS items_per_page, 3 < ceil(n / 10) AS has_next, true AS has_previous
FROM (SELECT count(*) AS n FROM orders WHERE {_TREE_SQL})""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_facts(filter_entities(e.orders(spark, sf_dir), e.ORDERS, parse(_TREE)), Page(3, 10))


@query("query_whole", f"""
SELECT row_id, orderkey, status, 3 AS page, (SELECT count(*) FROM orders WHERE {_TREE_SQL}) AS total
FROM ({_ORDERS}, o_orderdate AS d FROM orders WHERE {_TREE_SQL}) ORDER BY d DESC NULLS FIRST, row_id LIMIT 20 OFFSET 40""")
def query_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry point of a user: condition, sort, page and comma-separated projection in one call."""
    found = paging.query(e.orders(spark, sf_dir), e.ORDERS, parse(_TREE), ["orderdate"], "desc", Page.of(3, 20), ["orderkey, status"])
    return found.data.withColumns({"page": F.lit(found.facts["current_page"]), "total": F.lit(found.facts["total_records"])})


@query("query_past_end", f"SELECT orderkey, (SELECT count(*) FROM orders) AS total FROM ({_ORDERS} FROM orders) WHERE false")
def query_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paging.query(e.orders(spark, sf_dir), e.ORDERS, page=Page.of(1_000_000, 1000), attrs=["orderkey"])
    return found.data.select("orderkey", F.lit(found.facts["total_records"]).alias("total"))


@query("get_enriched", """
SELECT md5('orders:' || o_orderkey) AS row_id, o_orderkey AS orderkey, c_name AS customer_name
FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)""")
def get_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity by its id, with its relation and a projection."""
    df = e.orders(spark, sf_dir)
    one = df.agg(F.min_by("row_id", "orderkey")).first()[0]
    found = paging.get(df, e.ORDERS, one, {"customer": e.customers(spark, sf_dir)}, ["orderkey,customer.name"])
    return found.select("row_id", "orderkey", F.col("customer.name").alias("customer_name"))


@query("get_hot_row", "SELECT 100 AS schema_id, md5('orders:' || o_orderkey) AS row_id, o_orderkey AS bigint_01, o_orderstatus AS text_01 FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def get_hot_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = e.orders(spark, sf_dir)
    one = df.agg(F.max_by("row_id", "orderkey")).first()[0]
    return get_entity(layout.to_hot(df, e.ORDERS), one).select("schema_id", "row_id", "bigint_01", "text_01")


@query("get_eav_rows", """
SELECT md5('conversation:' || conv_id) AS row_id, 1 + count(*) + count(*) + count(text) AS entries, max(turn)::DOUBLE AS last_turn FROM conversations
WHERE conv_id = (SELECT max(conv_id) FROM conversations) GROUP BY conv_id""")
def get_eav_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = e.conversations(spark, sf_dir)
    one = df.agg(F.max_by("row_id", "conv_id")).first()[0]
    last = F.max(F.when(F.col("attr_id") == e.CONVERSATION.attribute("turns.turn").id, F.col("value_numeric"))).alias("last_turn")
    return get_entity(layout.to_eav(df, e.CONVERSATION), one).groupBy("row_id").agg(F.count(F.lit(1)).alias("entries"), last)


@query("page_past_end_total", "SELECT count(*) AS total_records, 0::BIGINT AS page_rows FROM orders WHERE o_orderstatus = 'P'")
def page_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_entities(e.orders(spark, sf_dir), e.ORDERS, parse(leaf("status", "P")))
    rows = page_rows(found, sort_order(found, e.ORDERS, []), Page(1_000_000, 100)).agg(F.count(F.lit(1)).alias("page_rows"))
    return found.agg(F.count(F.lit(1)).alias("total_records")).crossJoin(F.broadcast(rows))


@query("page_keyset", f"{_ORDERS} FROM orders WHERE o_totalprice > 250000 ORDER BY totalprice, row_id LIMIT 25")
def page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the rows after a key."""
    return next_rows(e.orders(spark, sf_dir), e.ORDERS, "totalprice", (250000.0, "g"), 25).select(*_ORDER_COLUMNS)


# G: projection
@query("project_nested", "SELECT md5('customer:' || c_custkey) AS row_id, c_acctbal AS acctbal, c_name AS profile_name, 1 AS profile_fields FROM customer")
def project_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = project(e.customers(spark, sf_dir), [" profile.name ", "acctbal"])
    fields = len(found.schema["profile"].dataType.names)
    return found.select("row_id", "acctbal", F.col("profile.name").alias("profile_name"), F.lit(fields).alias("profile_fields"))


@query("project_missing_path", "SELECT md5('customer:' || c_custkey) AS row_id, c_custkey AS custkey FROM customer")
def project_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(e.customers(spark, sf_dir), ["custkey", "nothing", "profile.nothing"])


# C: relations
_CUSTOMER_OF = Relation("customer", "customer", "profile", "custkey", "custkey", key_required=True)


def _enriched(df: DataFrame, parents: DataFrame, attrs: tuple[str, ...] = ()) -> DataFrame:
    return enrich(df, parents, _CUSTOMER_OF, attrs)


@query("relation_enrich_orders_customer", f"{_ORDERS}, c_name AS customer_name, c_mktsegment AS customer_segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def relation_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _enriched(e.orders(spark, sf_dir), e.customers(spark, sf_dir))
    return found.select(*_ORDER_COLUMNS, F.col("customer.name").alias("customer_name"), F.col("customer.segment").alias("customer_segment"))


@query("relation_enrich_missing_parent", "SELECT md5('orders:' || o_orderkey) AS row_id, c_name AS customer_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def relation_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _enriched(e.orders(spark, sf_dir), e.customers(spark, sf_dir).where("acctbal > 0"))
    return found.select("row_id", F.col("customer.name").alias("customer_name"))


@query("relation_duplicate_parents", "SELECT md5('orders:' || o_orderkey) AS row_id, 'b ' || c_name AS customer_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def relation_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of parents that share a key the one with the largest row id counts."""
    one = e.customers(spark, sf_dir)
    tagged = [one.withColumns({"row_id": F.concat(F.lit(t), "row_id"), "profile": F.struct(F.concat(F.lit(f"{t} "), "profile.name").alias("name"))}) for t in "ab"]
    return _enriched(e.orders(spark, sf_dir), tagged[0].unionByName(tagged[1])).select("row_id", F.col("customer.name").alias("customer_name"))


@query("relation_skip_when_not_requested", "SELECT md5('orders:' || o_orderkey) AS row_id, o_orderstatus AS status FROM orders")
def relation_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(_enriched(e.orders(spark, sf_dir), e.customers(spark, sf_dir), ("status",)), ["status"])


@query("relation_strip_computed", f"{_ORDERS} FROM orders")
def relation_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _enriched(e.orders(spark, sf_dir), e.customers(spark, sf_dir))
    return strip_computed(found, [_CUSTOMER_OF]).select(*_ORDER_COLUMNS)


# I: search over types
def _sources(spark: SparkSession, sf_dir: str) -> list:
    return [(e.CUSTOMER, e.customers(spark, sf_dir)), (e.SUPPLIER, e.suppliers(spark, sf_dir))]


_BOTH_TYPES = """
SELECT 0 AS schema_ord, 'customer' AS schema_name, md5('customer:' || c_custkey) AS row_id, c_acctbal AS acctbal, c_name AS name FROM customer
UNION ALL SELECT 1, 'supplier', md5('supplier:' || s_suppkey), s_acctbal, s_name FROM supplier"""


@query("cross_schema_search", f"SELECT schema_ord, schema_name, row_id FROM ({_BOTH_TYPES}) WHERE acctbal > 5000")
def cross_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_all(_sources(spark, sf_dir), parse(leaf("acctbal", "gt:5000")))
    return found.select("schema_ord", "schema_name", "row_id")


@query("cross_schema_term", f"SELECT schema_ord, schema_name, row_id FROM ({_BOTH_TYPES}) WHERE contains(name, '#00000001')")
def cross_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_all(_sources(spark, sf_dir), term="#00000001").select("schema_ord", "schema_name", "row_id")


@query("cross_schema_totals", f"SELECT schema_name, count(*) AS total FROM ({_BOTH_TYPES}) WHERE acctbal > 5000 GROUP BY schema_name")
def cross_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_totals(search.search_all(_sources(spark, sf_dir), parse(leaf("acctbal", "gt:5000"))))


@query("cross_schema_page_boundary", f"""
WITH f AS (SELECT * FROM ({_BOTH_TYPES}) WHERE acctbal > 9000), n AS (SELECT count(*) AS n FROM f WHERE schema_ord = 0)
SELECT schema_ord, schema_name, row_id FROM (SELECT *, row_number() OVER (ORDER BY schema_ord, row_id) AS k FROM f) WHERE k > 20 AND k <= 160""")
def cross_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_all(_sources(spark, sf_dir), parse(leaf("acctbal", "gt:9000")))
    pages = [search.search_page(found, Page(k, 20)) for k in range(2, 9)]
    rows = pages[0]
    for one in pages[1:]:
        rows = rows.union(one)
    return rows.select("schema_ord", "schema_name", "row_id")


@query("cross_schema_whole", f"""
WITH f AS (SELECT * FROM ({_BOTH_TYPES}) WHERE acctbal > 5000)
SELECT schema_name, row_id, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f WHERE schema_ord = 1) AS suppliers
FROM f ORDER BY schema_ord, row_id LIMIT 30 OFFSET 30""")
def cross_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_entities(_sources(spark, sf_dir), parse(leaf("acctbal", "gt:5000")), page=Page.of(2, 30))
    counts = {"total": found.facts["total_records"], "suppliers": found.totals.get("supplier", 0)}
    return found.data.select("schema_name", "row_id", *(F.lit(n).alias(k) for k, n in counts.items()))


# J: layouts
_ORDERS_EAV = f"""
WITH o AS ({_FULL})
SELECT 100 AS schema_id, row_id, 1 AS attr_id, '' AS array_indices, NULL AS value_text, orderkey::DOUBLE AS value_numeric FROM o
UNION ALL SELECT 100, row_id, 2, '', NULL, custkey::DOUBLE FROM o UNION ALL SELECT 100, row_id, 3, '', status, NULL FROM o
UNION ALL SELECT 100, row_id, 4, '', NULL, totalprice FROM o UNION ALL SELECT 100, row_id, 5, '', NULL, (epoch_us(orderdate) // 1000)::DOUBLE FROM o
UNION ALL SELECT 100, row_id, 6, '', priority, NULL FROM o UNION ALL SELECT 100, row_id, 7, '', NULL, CASE WHEN urgent THEN 1.0 ELSE 0.0 END FROM o"""
_TURNS_EAV = """
WITH t AS (SELECT md5('conversation:' || conv_id) AS row_id, conv_id, turn, role, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::VARCHAR AS i FROM conversations)
SELECT DISTINCT 104 AS schema_id, row_id, 1 AS attr_id, '' AS array_indices, NULL AS value_text, conv_id::DOUBLE AS value_numeric FROM t
UNION ALL SELECT 104, row_id, 2, i, NULL, turn::DOUBLE FROM t UNION ALL SELECT 104, row_id, 3, i, role, NULL FROM t
UNION ALL SELECT 104, row_id, 4, i, text, NULL FROM t WHERE text IS NOT NULL"""


@query("flatten_orders_eav", _ORDERS_EAV)
def flatten_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.to_eav(e.orders(spark, sf_dir), e.ORDERS)


@query("flatten_conversations_eav", _TURNS_EAV)
def flatten_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.to_eav(e.conversations(spark, sf_dir), e.CONVERSATION)


@query("flatten_events_props", """
SELECT md5('event:' || event_id) AS row_id, 5 AS attr_id, ((props ->> '$.k')::BIGINT)::DOUBLE AS value_numeric FROM events
UNION ALL SELECT md5('event:' || event_id), 4, (epoch_us(ts) // 1000)::DOUBLE FROM events""")
def flatten_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    eav = layout.to_eav(e.events(spark, sf_dir), e.EVENT)
    return eav.where(F.col("attr_id").isin(4, 5)).select("row_id", "attr_id", "value_numeric")


@query("rebuild_from_eav", f"{_ORDERS}, o_orderdate AS orderdate, o_orderpriority LIKE '1-%' AS urgent FROM orders")
def rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = layout.from_eav(layout.to_eav(e.orders(spark, sf_dir), e.ORDERS), e.ORDERS)
    return back.select(*_ORDER_COLUMNS, F.col("orderdate").cast("timestamp_ntz").alias("orderdate"), "urgent")


@query("roundtrip_conversations", "SELECT md5('conversation:' || conv_id) AS row_id, conv_id, turn, role, text FROM conversations")
def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = layout.from_eav(layout.to_eav(e.conversations(spark, sf_dir), e.CONVERSATION), e.CONVERSATION)
    return back.select("row_id", "conv_id", F.inline("turns")).select("row_id", "conv_id", "turn", "role", "text")


@query("hot_encode_all", """
SELECT 100 AS schema_id, md5('orders:' || o_orderkey) AS row_id, o_orderkey AS bigint_01, o_custkey AS bigint_02, o_orderstatus AS text_01,
       o_totalprice AS double_01, epoch_us(o_orderdate) // 1000 AS bigint_03 FROM orders""")
def hot_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.to_hot(e.orders(spark, sf_dir), e.ORDERS)


@query("hot_encodings", """
SELECT o_orderkey AS orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso8601, (o_orderpriority LIKE '1-%')::SMALLINT AS bool_smallint,
       CASE WHEN o_orderpriority LIKE '1-%' THEN '1' ELSE '0' END AS bool_text FROM orders""")
def hot_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {k: e.Attribute("x", 1, "bool", False, "x", k) for k in ("iso8601", "bool_smallint", "bool_text")}
    value = {"iso8601": F.col("orderdate"), "bool_smallint": F.col("urgent"), "bool_text": F.col("urgent")}
    return e.orders(spark, sf_dir).select("orderkey", *(layout.encode_hot(a, value[k]).alias(k) for k, a in at.items()))


@query("hot_decode_all", f"{_ORDERS.replace(', o_orderpriority AS priority', '')}, o_orderdate AS orderdate FROM orders")
def hot_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = layout.from_hot(layout.to_hot(e.orders(spark, sf_dir), e.ORDERS), e.ORDERS)
    return back.select(*_ORDER_COLUMNS[:-1], F.col("orderdate").cast("timestamp_ntz").alias("orderdate"))


@query("hot_eav_merge", f"{_FULL}")
def hot_eav_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot, eav = layout.split_record(e.orders(spark, sf_dir), e.ORDERS)
    back = layout.merge_record(hot, eav, e.ORDERS)
    return back.select(*_ORDER_COLUMNS, F.col("orderdate").cast("timestamp_ntz").alias("orderdate"), "urgent")


@query("eav_json_agg", "SELECT md5('conversation:' || conv_id) AS row_id, 1 + 3 * count(*) AS entries, min(conv_id)::DOUBLE AS first_value FROM conversations GROUP BY conv_id")
def eav_json_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.from_json("attributes", "array<struct<attr_id:int,array_indices:string,value_text:string,value_numeric:double>>")
    rows = layout.eav_json(layout.to_eav(e.conversations(spark, sf_dir), e.CONVERSATION)).withColumn("body", body)
    return rows.select("row_id", F.size("body").cast("bigint").alias("entries"), F.col("body")[0]["value_numeric"].alias("first_value"))


@query("eav_json_text", """
SELECT md5('orders:' || o_orderkey) AS row_id, '[' || concat_ws(',', {n}, {t}, {d}) || ']' AS attributes FROM orders""".format(
    n="""'{"attr_id":1,"array_indices":"","value_text":null,"value_numeric":' || o_orderkey::DOUBLE || '}'""",
    t="""'{"attr_id":3,"array_indices":"","value_text":"' || o_orderstatus || '","value_numeric":null}'""",
    d="""'{"attr_id":6,"array_indices":"","value_text":"' || o_orderpriority || '","value_numeric":null}'"""))
def eav_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole JSON text, in order."""
    return layout.eav_json(layout.to_eav(e.orders(spark, sf_dir), e.ORDERS).where("attr_id IN (1, 3, 6)"))


# M: changes
def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer's last order: a row for each customer, in several versions."""
    return e.orders(spark, sf_dir).select(
        F.md5(F.concat(F.lit("customer:"), F.col("custkey").cast("string"))).alias("row_id"), "orderkey", "status", "totalprice", F.col("orderkey").alias("updated_at")
    )


_VERSIONS = "SELECT md5('customer:' || o_custkey) AS row_id, o_orderkey AS orderkey, o_orderstatus AS status, o_totalprice AS totalprice, o_orderkey AS updated_at FROM orders"
_LATEST = f"SELECT * FROM ({_VERSIONS}) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY updated_at DESC) = 1"


@query("snapshot_latest_wins", _LATEST)
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.latest(_versions(spark, sf_dir))


@query("snapshot_with_tombstones", f"""
WITH t AS (SELECT md5('customer:' || c_custkey) AS row_id, c_custkey * 10 AS deleted_at FROM customer WHERE c_acctbal < 0)
SELECT l.* FROM ({_LATEST}) l LEFT JOIN t USING (row_id) WHERE deleted_at IS NULL OR deleted_at < updated_at""")
def snapshot_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = e.customers(spark, sf_dir).where("acctbal < 0").select("row_id", (F.col("custkey") * 10).alias("deleted_at"))
    return changes.snapshot(_versions(spark, sf_dir), gone)


@query("change_log_latest", """
SELECT 100 AS schema_id, md5('customer:' || o_custkey) AS row_id, 0 AS flushed_at, max(o_orderkey) AS changed_at,
       CASE WHEN arg_max(o_orderstatus, o_orderkey) = 'F' THEN max(o_orderkey) END AS deleted_at FROM orders GROUP BY o_custkey""")
def change_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _versions(spark, sf_dir)
    kept = changes.log_changes(rows.where("status <> 'F'"), e.ORDERS, F.col("orderkey"))
    return changes.compact_log(kept, changes.log_changes(rows.where("status = 'F'"), e.ORDERS, F.col("orderkey"), deleted=True))


@query("apply_update_deep_merge", """
SELECT md5('customer:' || c_custkey) AS row_id, c_custkey AS custkey,
       CASE WHEN c_custkey % 3 = 0 THEN 'renamed ' || c_custkey ELSE c_name END AS name,
       CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS segment,
       CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 1.5 ELSE c_acctbal END AS acctbal FROM customer""")
def deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = e.customers(spark, sf_dir).withColumns({"created_at": F.lit(0), "updated_at": F.lit(0)})
    key = F.col("custkey").cast("string")
    one = F.concat(F.lit('{"profile": {"name": "renamed '), key, F.lit('"}}'))
    two = F.lit('{"profile": {"segment": null}, "acctbal": 1.5}')
    third = base.where("custkey % 3 = 0")
    patches = third.select("row_id", one.alias("patch"), F.lit(1).alias("changed_at"))
    patches = patches.union(third.where("custkey % 2 = 0").select("row_id", two, F.lit(2)))
    after = changes.update(base, patches, e.CUSTOMER).accepted
    return after.select("row_id", "custkey", F.col("profile.name").alias("name"), F.col("profile.segment").alias("segment"), "acctbal")


@query("apply_delete", f"{_ORDERS} FROM orders WHERE o_orderstatus <> 'P'")
def apply_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = e.orders(spark, sf_dir)
    return changes.delete(df, df.where("status = 'P'")).accepted.select(*_ORDER_COLUMNS)


@query("update_rejects", "SELECT md5('orders:-' || c_custkey) AS row_id, 'UPDATE_FAILED' AS code, 'no such row' AS message FROM customer WHERE c_custkey % 10 = 0")
def update_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = e.orders(spark, sf_dir).withColumns({"created_at": F.lit(0), "updated_at": F.lit(0)})
    absent = F.md5(F.concat(F.lit("orders:-"), F.col("custkey").cast("string"))).alias("row_id")
    patch = (F.lit('{"status": "X"}').alias("patch"), F.lit(1).alias("changed_at"))
    patches = e.customers(spark, sf_dir).where("custkey % 10 = 0").select(absent, *patch).union(base.where("status = 'P'").select("row_id", *patch))
    return changes.update(base, patches, e.ORDERS).rejected


@query("delete_rejects", "SELECT md5('orders:-' || c_custkey) AS row_id, 'DELETE_FAILED' AS code, 'no such row' AS message FROM customer WHERE c_custkey % 10 = 0")
def delete_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = e.orders(spark, sf_dir)
    absent = F.md5(F.concat(F.lit("orders:-"), F.col("custkey").cast("string"))).alias("row_id")
    ids = e.customers(spark, sf_dir).where("custkey % 10 = 0").select(absent).union(base.where("status = 'P'").select("row_id"))
    return changes.delete(base, ids).rejected


@query("batch_partial_failure", "SELECT md5('orders:' || o_orderkey) AS row_id, 'CREATE_FAILED' AS code, 'missing required: custkey' AS message FROM orders WHERE o_orderstatus = 'P'")
def batch_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = e.orders(spark, sf_dir).withColumn("custkey", F.when(F.col("status") != "P", F.col("custkey")))
    return changes.create(df, e.ORDERS, F.lit(0).cast("bigint")).rejected


@query("batch_counts", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS success, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders")
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = e.orders(spark, sf_dir).withColumn("custkey", F.when(F.col("status") != "P", F.col("custkey")))
    return changes.create(df, e.ORDERS, F.lit(0).cast("bigint")).counts()


# K, N: transformers and ingest
def _field(name: str, source: str, transformer: ff.Transformer, source_sql: str, value_sql: str, failed_sql: str = "false") -> None:
    """A transformer on a text made of an order: key, value, and whether it failed."""

    @query(f"ingest_{name}", f"SELECT o_orderkey AS orderkey, {value_sql} AS value, {failed_sql} AS failed FROM (SELECT *, {source_sql} AS s FROM orders)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = e.orders(spark, sf_dir).withColumn("s", F.expr(source))
        made = transformer(F.col("s"))
        return rows.select("orderkey", made.value.alias("value"), made.error.isNotNull().alias("failed"))



_field("to_price", "CASE orderkey % 4 WHEN 0 THEN concat('$', format_number(orderkey * 10, 0)) WHEN 1 THEN 'Price on request' WHEN 2 THEN '' ELSE 'n/a' END", ff.to_price(),
       "CASE o_orderkey % 4 WHEN 0 THEN '$' || format('{:,}', o_orderkey * 10) WHEN 1 THEN 'Price on request' WHEN 2 THEN '' ELSE 'n/a' END",
       "CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey * 10)::DOUBLE END", "o_orderkey % 4 = 3")
_field("to_year", "CASE orderkey % 4 WHEN 0 THEN concat(1900 + orderkey % 300, ' (Approximation)') WHEN 1 THEN 'Unknown' WHEN 2 THEN 'x' ELSE string(2000 + orderkey % 100) END", ff.to_year(),
       "''", "CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 300 <= 200 THEN 1900 + o_orderkey % 300 END WHEN 3 THEN 2000 + o_orderkey % 100 END", "o_orderkey % 4 = 0 AND o_orderkey % 300 > 200")
_field("approx", "CASE orderkey % 4 WHEN 0 THEN '2000 (Approximation)' WHEN 1 THEN 'Unknown' WHEN 2 THEN '~1990' ELSE '2001' END", ff.is_year_approximate(),
       "''", "CASE o_orderkey % 4 WHEN 0 THEN true WHEN 2 THEN true WHEN 3 THEN false END")
_SIZE = "CASE orderkey % 3 WHEN 0 THEN concat(orderkey % 50, ' x ', orderkey % 40, ' mm') WHEN 1 THEN concat(orderkey % 50, ' mm') ELSE 'large' END"
_field("size_width", _SIZE, ff.to_size_width(), "''", "CASE WHEN o_orderkey % 3 < 2 THEN (o_orderkey % 50)::DOUBLE END")
_field("size_height", _SIZE, ff.to_size_height(), "''", "CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 40)::DOUBLE END")
_field("enum", "concat(' ', status)", ff.enum("F", "O"), "o_orderstatus", "CASE WHEN s IN ('F', 'O') THEN s END", "s NOT IN ('F', 'O')")
_field("to_bool", "CASE status WHEN 'F' THEN 'Yes' WHEN 'O' THEN '0' ELSE 'perhaps' END", ff.to_bool(), "o_orderstatus", "CASE s WHEN 'F' THEN true WHEN 'O' THEN false END", "s NOT IN ('F', 'O')")
_field("to_int", "CASE WHEN orderkey % 5 = 0 THEN concat(orderkey, '.5') ELSE concat(' ', orderkey) END", ff.to_int64(), "''", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END", "o_orderkey % 5 = 0")
_field("to_float64", "CASE WHEN orderkey % 5 = 0 THEN 'x' ELSE concat(orderkey, '.5') END", ff.to_float64(), "''", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey + 0.5::DOUBLE END", "o_orderkey % 5 = 0")
_field("split", "concat(status, ', ,', priority)", lambda c: (lambda f: ff.Field(F.concat_ws("|", f.value), f.error))(ff.split(",")(c)), "''", "o_orderstatus || '|' || o_orderpriority")
_field("trim", "concat('  ', status, ' ')", ff.trim(), "''", "o_orderstatus")
_field("to_lower", "concat('  ', priority, ' ')", ff.to_lower(), "''", "lower(o_orderpriority)")
_field("to_upper", "concat(' ', lower(priority))", ff.to_upper(), "''", "upper(o_orderpriority)")
_field("default", "CASE WHEN status = 'P' THEN ' ' ELSE status END", ff.default("none"), "o_orderstatus", "CASE WHEN s = 'P' THEN 'none' ELSE s END")
_field("to_date", "CASE WHEN status = 'P' THEN 'soon' ELSE date_format(orderdate, 'dd/MM/yyyy') END", ff.to_date("02/01/2006"), "''", "CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END", "o_orderstatus = 'P'")
_field("to_datetime", "date_format(orderdate, 'yyyy-MM-dd HH:mm')", ff.to_datetime("2006-01-02 15:04"), "''", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')")
_field("to_datetime_iso8601", "CASE orderkey % 3 WHEN 0 THEN date_format(orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") ELSE date_format(orderdate, 'yyyy-MM-dd HH:mm:ss') END",
       ff.to_datetime_iso8601(), "''", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')")


def _imported(spark: SparkSession, sf_dir: str):
    mapper = (
        Mapper("orders").required("key", "key", ff.to_int64()).required("status", "state.code", ff.enum("F", "O")).map("price", "state.price", ff.to_price())
    )
    rows = e.orders(spark, sf_dir).select(
        F.col("orderkey").cast("string").alias("key"), "status", F.when(F.col("orderkey") % 7 == 0, "?").otherwise(F.concat(F.lit("€"), F.col("orderkey"))).alias("price")
    )
    return import_rows(rows, mapper, F.col("key").cast("bigint"))


@query("ingest_rows", "SELECT o_orderkey AS row, o_orderkey AS key, o_orderstatus AS code, o_orderkey::DOUBLE AS price FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 7 <> 0")
def ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imported(spark, sf_dir).rows.select("row", "key", F.col("state.code").alias("code"), F.col("state.price").alias("price"))


@query("ingest_error_rows", """
SELECT o_orderkey AS row, CASE WHEN o_orderstatus = 'P' THEN 'status' ELSE 'price' END AS "column", CASE WHEN o_orderstatus = 'P' THEN 'state.code' ELSE 'state.price' END AS path,
       CASE WHEN o_orderstatus = 'P' THEN 'P' ELSE '?' END AS value, CASE WHEN o_orderstatus = 'P' THEN 'invalid choice: P' ELSE 'invalid price: ?' END AS reason
FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 7 = 0""")
def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imported(spark, sf_dir).errors


@query("ingest_counts", "SELECT count(*) AS total, count(*) FILTER (NOT bad) AS success, count(*) FILTER (bad) AS failed FROM (SELECT o_orderstatus = 'P' OR o_orderkey % 7 = 0 AS bad FROM orders)")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imported(spark, sf_dir).counts()


@query("ingest_watches", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 10)::DOUBLE END AS price, 1950 + o_orderkey % 60 AS year, o_orderkey % 2 = 0 AS approximate,
       (20 + o_orderkey % 30)::DOUBLE AS width FROM orders WHERE o_orderkey % 11 <> 0""")
def ingest_watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("orderkey")
    text = k.cast("string")
    cells = {
        "id": text, "name": F.when(k % 11 != 0, F.concat(F.lit("watch "), text)), "brand": F.lit("none"),
        "price": F.when(k % 3 == 0, F.concat(F.lit("$"), F.format_number(k * 10, 0))).otherwise("Price on request"),
        "yop": F.concat((1950 + k % 60).cast("string"), F.when(k % 2 == 0, " (Approximation)").otherwise("")),
        "size": F.concat((20 + k % 30).cast("string"), F.lit(" mm")),
    }
    rows = e.orders(spark, sf_dir).select(*(c.alias(n) for n, c in cells.items()))
    year = F.col("yearOfProduction")
    return import_rows(rows, watch_mapper()).rows.select(
        "id", F.col("price.value").alias("price"), year["year"].alias("year"), year["approximate"].alias("approximate"), F.col("size.width").alias("width")
    )


# K: conversions
@query("convert_literals", """
SELECT o_orderkey AS orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS whole, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey + 0.5::DOUBLE END AS real,
       CASE WHEN o_orderkey % 3 = 2 THEN 'x' || o_orderkey END AS text, o_orderkey % 3 < 2 AND o_orderkey > 0 AS truth, o_orderkey::VARCHAR AS key_text FROM orders""")
def convert_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("orderkey").cast("string")
    shown = F.when(F.col("orderkey") % 3 == 0, key).when(F.col("orderkey") % 3 == 1, F.concat(key, F.lit(".5"))).otherwise(F.concat(F.lit("x"), key))
    return e.orders(spark, sf_dir).select(
        "orderkey", convert.parse_number(shown).alias("n"), convert.to_bool_strict(shown).alias("truth"), convert.to_text(F.col("orderkey")).alias("key_text")
    ).select("orderkey", "n.*", "truth", "key_text")


@query("uuid7_of_given", """
SELECT row_id, lower(substr(t, 1, 8) || '-' || substr(t, 9, 4) || '-7' || substr(row_id, 1, 3) || '-' || v || substr(row_id, 5, 3) || '-' || substr(row_id, 8, 12)) AS id
FROM (SELECT row_id, lpad(to_hex(epoch_ms(d)), 12, '0') AS t, substr('89ab89ab89ab89ab', ('0x' || substr(row_id, 4, 1))::INT + 1, 1) AS v
      FROM (SELECT md5('orders:' || o_orderkey) AS row_id, o_orderdate::TIMESTAMP AS d FROM orders))""")
def uuid7_of_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.orders(spark, sf_dir).select("row_id", convert.uuid7(F.unix_millis("orderdate"), F.col("row_id")).alias("id"))


@query("convert_scalars", """
SELECT o_orderkey AS orderkey, o_orderkey::DOUBLE AS number, o_orderkey % 2 = 1 AS truth, strftime(o_orderdate, '%Y-%m-%d') AS from_millis, strftime(o_orderdate, '%Y-%m-01') AS from_month,
       lower(substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)) AS uuid
FROM (SELECT *, md5('orders:' || o_orderkey) AS m FROM orders)""")
def convert_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.orders(spark, sf_dir).select(
        "orderkey", convert.to_number(F.concat(F.lit(" "), F.col("orderkey"))).alias("number"),
        convert.to_bool(F.when(F.col("orderkey") % 2 == 1, "T").otherwise("false")).alias("truth"),
        F.date_format(convert.to_time(F.unix_millis("orderdate").cast("string")), "yyyy-MM-dd").alias("from_millis"),
        F.date_format(convert.to_time(F.date_format("orderdate", "yyyy-MM")), "yyyy-MM-dd").alias("from_month"), convert.to_uuid(F.upper("row_id")).alias("uuid"),
    )


@query("base32_roundtrip", "SELECT md5('orders:' || o_orderkey) AS row_id, 26 AS letters, md5('orders:' || o_orderkey) AS back FROM orders")
def base32_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = convert.uuid_base32(F.col("row_id"))
    return e.orders(spark, sf_dir).select("row_id", F.length(short).alias("letters"), F.lower(F.hex(convert.base32_decode(short))).alias("back"))


# J: validation, L: schema tools
_PART_SCHEMA = {
    "type": "object",
    "required": ["partkey", "name"],
    "properties": {
        "partkey": {"type": "integer"},
        "name": {"type": "string", "pattern": "ring|bolt|gear", "maxLength": 12},
        "size": {"type": "integer", "minimum": 5, "maximum": 40},
        "brand": {"type": "string", "enum": ["Brand#1", "Brand#2", "Brand#3"]},
    },
}


@query("validate_keywords", """
SELECT md5('part:' || p_partkey) AS row_id, concat_ws('; ', CASE WHEN NOT regexp_matches(p_name, 'ring|bolt|gear') THEN 'name: pattern' END,
       CASE WHEN length(p_name) > 12 THEN 'name: maxLength' END, CASE WHEN p_size < 5 THEN 'size: minimum' END, CASE WHEN p_size > 40 THEN 'size: maximum' END,
       CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'brand: enum' END) AS violations FROM part""")
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = e.parts(spark, sf_dir)
    return df.select("row_id", F.concat_ws("; ", validation.violations(df, _PART_SCHEMA)).alias("violations"))


_SHOP = {
    "type": "object",
    "required": ["id", "owner"],
    "properties": {
        "id": {"type": "string"},
        "owner": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "born": {"type": "string", "format": "date"}}},
        "tags": {"type": "array", "items": {"type": "string"}},
        "items": {"type": "array", "items": {"type": "object", "required": ["price"], "properties": {"price": {"type": "number"}, "sold": {"type": "boolean"}}}},
    },
}


@query("schema_attributes_catalog", """
SELECT * FROM (VALUES ('id', 'text', true), ('items.price', 'numeric', false), ('items.sold', 'bool', false), ('owner.born', 'date', false),
('owner.name', 'text', true), ('tags', 'text', false)) t(path, value_type, required)""")
def schema_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sorted(leaves(_SHOP)), "path string, value_type string, required boolean")


@query("schema_id_allocation", """
SELECT * FROM (VALUES ('gone', 9, 'text'), ('id', 4, 'text'), ('items.price', 10, 'numeric'), ('items.sold', 11, 'bool'), ('owner.born', 12, 'date'),
('owner.name', 13, 'text'), ('tags', 14, 'text')) t(path, attr_id, value_type)""")
def schema_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"id": {"attributeID": 4, "valueType": "numeric"}, "gone": {"attributeID": 9, "valueType": "text"}}
    rows = [(k, v["attributeID"], v["valueType"]) for k, v in allocate(_SHOP, known).items()]
    return spark.createDataFrame(sorted(rows), "path string, attr_id int, value_type string")

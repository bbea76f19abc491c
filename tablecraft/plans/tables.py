"""The tables the registered queries read, declared."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.relations import belongs_to, belongs_to_many, has_many, has_many_through, has_one, has_one_through, morph_many, morph_one, morph_to, morph_to_many
from ..sources.engine import Engine
from ..sources.tables import ColumnDef, NamedScope, SoftDelete, TableDef, UniqueKey, table_of

REGION = table_of("region", {"r_regionkey": "int", "r_name": "string"}, "r_regionkey")
NATION = table_of("nation", {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, "n_nationkey")
CUSTOMER = table_of(
    "customer",
    {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "c_custkey",
    unique_keys=(UniqueKey("customer_name", ("c_name",)),),
)
SUPPLIER = table_of("supplier", {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}, "s_suppkey")
PART = table_of(
    "part",
    {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "p_partkey",
)
ORDERS = table_of(
    "orders",
    {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    },
    "o_orderkey",
    soft_delete=SoftDelete("o_orderstatus", alive_value="O", deleted_value="F"),
    scopes=(NamedScope("recent", lambda t: t["o_totalprice"].gt(1000.0)),),
)
#: The same table without implicit predicates.
ALL_ORDERS = TableDef("orders", ORDERS.columns, ORDERS.primary_key)
LINEITEM = table_of(
    "lineitem",
    {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
        "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
        "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
)
EVENTS = table_of(
    "events",
    {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
    "event_id",
)
DOCUMENTS = table_of("documents", {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}, "doc_id")
LABELS = table_of("labels", {"doc_id": "bigint", "quality": "int", "toxic": "int"}, "doc_id")
CONVERSATIONS = table_of("conversations", {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}, ("conv_id", "turn"))

CUSTOMER_ORDERS = has_many("orders", ALL_ORDERS, "c_custkey", "o_custkey")
CUSTOMER_NATION = belongs_to("nation", NATION, "c_nationkey", "n_nationkey")
NATION_REGION = belongs_to("region", REGION, "n_regionkey", "r_regionkey")
ORDER_LINES = has_many("lines", LINEITEM, "o_orderkey", "l_orderkey")
ORDER_PARTS = belongs_to_many("parts", PART, "o_orderkey", LINEITEM, "l_orderkey", "l_partkey", "p_partkey")
REGION_CUSTOMERS = has_many_through("customers", CUSTOMER, "r_regionkey", NATION, "n_regionkey", "n_nationkey", "c_nationkey")
CUSTOMER_REGION = has_one_through("region", REGION, "c_nationkey", NATION, "n_nationkey", "n_regionkey", "r_regionkey")
DOCUMENT_LABEL = has_one("label", LABELS, "doc_id", "doc_id")

#: A polymorphic table made of the others: notes that belong to a customer or a supplier.
NOTES = TableDef(
    "notes",
    (ColumnDef("note_id", "bigint", False), ColumnDef("owner_type", "string"), ColumnDef("owner_id", "bigint"), ColumnDef("body", "string")),
    ("note_id",),
)
TAGS = table_of("tags", {"tag_id": "int", "tag": "string"}, "tag_id")
TAGGED = table_of("tagged", {"tag_id": "int", "kind": "string", "owner_id": "bigint"})
NOTE_OWNER = morph_to("owner", "owner_type", "owner_id", {"customer": (CUSTOMER, "c_custkey"), "supplier": (SUPPLIER, "s_suppkey")})
CUSTOMER_NOTES = morph_many("notes", NOTES, "c_custkey", "owner_id", "owner_type", "customer")
SUPPLIER_NOTE = morph_one("note", NOTES, "s_suppkey", "owner_id", "owner_type", "supplier")
SUPPLIER_TAGS = morph_to_many("tags", TAGS, "s_suppkey", TAGGED, "owner_id", "tag_id", "tag_id", "kind", "supplier")

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def engine_for(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the Parquet tables of a folder, and the polymorphic ones derived from them."""
    engine = Engine(spark, sf_dir)
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    notes = (
        read("customer")
        .where("c_custkey % 7 = 0")
        .selectExpr("c_custkey * 2 AS note_id", "'customer' AS owner_type", "c_custkey AS owner_id", "c_mktsegment AS body")
        .unionByName(
            read("supplier").selectExpr("s_suppkey * 2 + 1 AS note_id", "'supplier' AS owner_type", "s_suppkey AS owner_id", "s_name AS body")
        )
    )
    engine.register("notes", notes)
    engine.register("tags", read("region").selectExpr("r_regionkey AS tag_id", "r_name AS tag"))
    engine.register("tagged", read("supplier").selectExpr("CAST(s_suppkey % 5 AS INT) AS tag_id", "'supplier' AS kind", "s_suppkey AS owner_id"))
    return engine

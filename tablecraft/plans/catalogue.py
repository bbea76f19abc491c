"""Registered queries: one per operator or family, each with the same result in SQL.

``QUERIES`` maps a name to a function of ``(spark, sf_dir)``; ``ORACLE_SQL``
maps it to SQL that DuckDB runs on the same tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    CURRENT_ROW,
    Bound,
    Col,
    EmptyIn,
    Frame,
    FrameUnit,
    Grain,
    IntegerAverage,
    Lit,
    Nulls,
    Operator,
    Unit,
    Window,
    and_,
    avg,
    case_when,
    coalesce,
    count,
    count_all,
    date_bucket,
    date_diff,
    dense_rank,
    exists_value,
    fn,
    in_year,
    lag,
    lead,
    max_,
    min_,
    month_start,
    not_,
    ntile,
    on_date,
    or_,
    rank,
    raw,
    row_number,
    scalar_subquery,
    sum_,
    truncated_to,
    typed,
    where_all,
    where_any,
    where_column,
    where_day,
    where_exists,
    where_month,
    where_none,
    where_not_exists,
    where_time,
    where_year,
)
from ..operators import (
    Cycles,
    Delete,
    Hierarchy,
    Insert,
    InsertSelect,
    JoinKind,
    Repository,
    TypedCte,
    Update,
    Upsert,
    after,
    entities,
    from_,
    from_parts,
    merged,
)
from .tables import (
    ALL_ORDERS,
    CUSTOMER,
    CUSTOMER_NATION,
    CUSTOMER_NOTES,
    CUSTOMER_ORDERS,
    CUSTOMER_REGION,
    DOCUMENT_LABEL,
    DOCUMENTS,
    EVENTS,
    NATION,
    NATION_REGION,
    NOTE_OWNER,
    NOTES,
    ORDER_LINES,
    ORDER_PARTS,
    ORDERS,
    PART,
    REGION,
    REGION_CUSTOMERS,
    SUPPLIER,
    SUPPLIER_NOTE,
    SUPPLIER_TAGS,
    engine_for,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str) -> Callable[[Callable[[Any], Any]], Any]:
    """Registers a function of an engine that gives a query or a frame."""

    def add(build: Callable[[Any], Any]) -> Any:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            engine = engine_for(spark, sf_dir)
            made = build(engine)
            return made if isinstance(made, DataFrame) else engine.query(made)

        QUERIES[build.__name__] = run
        ORACLE_SQL[build.__name__] = sql
        return build

    return add


def money(expr: Any) -> Any:
    return expr.cast("decimal(18,2)")


# --- The flagship: revenue by market segment.


@registered("""
SELECT c.c_mktsegment AS segment, count(DISTINCT o.o_orderkey) AS n_orders,
    CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS DECIMAL(28,4)) AS revenue
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderdate >= TIMESTAMP '1995-01-01' AND o.o_orderdate < TIMESTAMP '1997-01-01'
GROUP BY c.c_mktsegment HAVING count(DISTINCT o.o_orderkey) > 1 ORDER BY revenue DESC LIMIT 20
""")
def segment_revenue_top20(_: Any) -> Any:
    revenue = sum_(money(Col("l.l_extendedprice")) * (Lit(1) - Col("l.l_discount").cast("decimal(4,2)"))).cast("decimal(28,4)")
    n = count(Col("o.o_orderkey"), distinct=True)
    return (
        from_("customer", "c")
        .inner_join("orders", "o", Col("o.o_custkey").eq_col("c.c_custkey"))
        .inner_join("lineitem", "l", Col("l.l_orderkey").eq_col("o.o_orderkey"))
        .where(in_year("o.o_orderdate", 1995, Operator.GTE) & in_year("o.o_orderdate", 1996, Operator.LTE))
        .select(Col("c.c_mktsegment").as_("segment"), n.as_("n_orders"), revenue.as_("revenue"))
        .group_by("c.c_mktsegment")
        .having(n.gt(1))
        .order_by(Col("revenue").desc())
        .top(20)
    )


# --- Scans and sources.


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def scan_named(_: Any) -> Any:
    return from_("nation", "n").where(Col("n.n_regionkey").eq(1)).select("n.n_nationkey", "n.n_name")


@registered("SELECT r_name FROM region")
def scan_parts(_: Any) -> Any:
    return from_parts(["region"]).select("r_name")


@registered("SELECT s.k, s.n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) s WHERE s.n > 5")
def derived_table(_: Any) -> Any:
    inner = from_("customer").select(Col("c_nationkey").as_("k"), count_all().as_("n")).group_by("c_nationkey")
    return from_(inner, "s").where(Col("s.n").gt(5)).select("s.k", "s.n")


@registered("SELECT * FROM region")
def scan_all_columns(_: Any) -> Any:
    return from_("region")


# --- Projections and expressions.


@registered("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def select_distinct(_: Any) -> Any:
    return from_("customer").select_distinct("c_mktsegment", "c_nationkey")


@registered("""
SELECT p_partkey, p_size // 7 AS whole, p_size % 7 AS rest, xor(p_size, 5) AS flipped, p_name || '/' || p_brand AS label,
    CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(p_size AS VARCHAR) AS size_text, 1 AS one
FROM part
""")
def expressions(_: Any) -> Any:
    size, name = typed("p_size", "int"), typed("p_name", "string")
    return from_("part").select(
        "p_partkey",
        (size / 7).as_("whole"),
        (size % 7).as_("rest"),
        (size ^ 5).as_("flipped"),
        (name + "/" + typed("p_brand", "string")).as_("label"),
        money(Col("p_retailprice")).as_("price"),
        size.cast("nvarchar(10)").as_("size_text"),
        Lit(1).as_("one"),
    )


@registered("""
SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'middle' ELSE 'small' END AS tier
FROM orders
""")
def case_tier(_: Any) -> Any:
    price = Col("o_totalprice")
    tier = case_when((price.gte(200000), "large"), (price.gte(100000), "middle"), otherwise="small")
    return from_("orders").select("o_orderkey", tier.as_("tier"))


@registered("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def coalesce_missing(_: Any) -> Any:
    q = from_("documents", "d").left_join("labels", "l", Col("l.doc_id").eq_col("d.doc_id"))
    return q.select("d.doc_id", coalesce(Col("l.quality"), -1).as_("quality"))


@registered("SELECT p_partkey, upper(p_name) AS name, length(rtrim(p_brand)) AS n, strpos(p_name, 'a') AS at, p_size + 3 AS more FROM part")
def named_functions(_: Any) -> Any:
    return from_("part").select(
        "p_partkey",
        fn("UPPER", Col("p_name")).as_("name"),
        fn("LEN", Col("p_brand")).as_("n"),
        fn("CHARINDEX", "a", Col("p_name")).as_("at"),
        raw("p_size + :by", by=3).as_("more"),
    )


# --- Predicates.

_COMPARE = {"eq": "=", "ne": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}


def _comparison(name: str, sign: str) -> None:
    def build(_: Any) -> Any:
        return from_("part").where(getattr(typed("p_size", "int"), name)(25)).select("p_partkey", "p_size")

    build.__name__ = f"filter_{name}"
    registered(f"SELECT p_partkey, p_size FROM part WHERE p_size {sign} 25")(build)


for _name, _sign in _COMPARE.items():
    _comparison(_name, _sign)


@registered("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > l_linenumber AND l_suppkey = l_suppkey AND l_discount < l_tax")
def filter_columns(_: Any) -> Any:
    q = from_("lineitem").where(where_column("l_quantity", Operator.GT, "l_linenumber")).where(Col("l_suppkey").eq_col("l_suppkey"))
    return q.where(Col("l_discount").lt(Col("l_tax"))).select("l_orderkey", "l_linenumber", "l_quantity")


@registered("""
SELECT d.doc_id, l.quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE l.quality IS NULL OR (l.quality IS NOT NULL AND l.toxic = 1)
""")
def filter_null(_: Any) -> Any:
    q = from_("documents", "d").left_join("labels", "l", Col("l.doc_id").eq_col("d.doc_id"))
    quality = Col("l.quality")
    return q.where(quality.is_null() | (quality.is_not_null() & Col("l.toxic").eq(1))).select("d.doc_id", quality.is_null().as_("unlabelled"))


@registered("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')")
def filter_in(_: Any) -> Any:
    q = from_("orders").where(Col("o_orderpriority").in_list(["1-URGENT", "2-HIGH"])).where(Col("o_orderstatus").not_in_list(["P"]))
    return q.select("o_orderkey")


@registered("SELECT r_regionkey FROM region WHERE false")
def filter_in_empty(_: Any) -> Any:
    return from_("region").where(Col("r_name").in_list([], EmptyIn.MATCH_NONE)).select("r_regionkey")


@registered("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1200")
def filter_between(_: Any) -> Any:
    q = from_("part").where(typed("p_size", "int").between(10, 20)).where(Col("p_retailprice").not_between(1000, 1200))
    return q.select("p_partkey")


@registered("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber BETWEEN l_tax AND l_quantity AND l_quantity NOT BETWEEN l_tax AND l_linenumber")
def filter_between_columns(_: Any) -> Any:
    q = from_("lineitem").where(Col("l_linenumber").between_columns("l_tax", "l_quantity"))
    return q.where(Col("l_quantity").not_between_columns("l_tax", "l_linenumber")).select("l_orderkey", "l_partkey")


def _like(name: str, build_condition: Callable[[Any], Any], sql: str) -> None:
    def build(_: Any) -> Any:
        return from_("part").where(build_condition(Col("p_type"))).select("p_partkey", "p_type")

    build.__name__ = f"filter_like_{name}"
    registered(f"SELECT p_partkey, p_type FROM part WHERE {sql}")(build)


_like("exact", lambda c: c.like("PROMO%") | c.not_like("SMALL"), "p_type = 'PROMO%' OR p_type <> 'SMALL'")
_like("contains", lambda c: c.contains("AN"), "contains(p_type, 'AN')")
_like("not_contains", lambda c: c.not_contains("AN"), "NOT contains(p_type, 'AN')")
_like("starts", lambda c: c.starts_with("S"), "starts_with(p_type, 'S')")
_like("ends", lambda c: c.ends_with("L"), "ends_with(p_type, 'L')")
_like("raw", lambda c: c.like_raw("%A_D%"), "p_type LIKE '%A_D%'")
_like("not_raw", lambda c: c.not_like_raw("S%"), "p_type NOT LIKE 'S%'")
_like("class", lambda c: c.like_raw("[PS]%"), "regexp_matches(p_type, '^[PS]')")


@registered("""
SELECT event_id FROM events WHERE (CAST(ts AS DATE) = (SELECT CAST(min(ts) AS DATE) FROM events) AND CAST(ts AS TIME) >= TIME '06:00:00')
    OR (year(ts) = 2024 AND month(ts) = 2 AND day(ts) <> 3)
""")
def filter_date_parts(engine: Any) -> Any:
    first = from_("events").select(min_("ts").as_("m"))
    same_day = fn("to_date", Col("ts")).eq(fn("to_date", scalar_subquery(first)))
    late = where_time("ts", dt.time(6), Operator.GTE)
    other = and_([where_year("ts", 2024), where_month("ts", 2), where_day("ts", 3, Operator.NE)])
    return from_("events").where((same_day & late) | other).select("event_id")


def _calendar(name: str, op: Operator, sql: str) -> None:
    def build(_: Any) -> Any:
        return from_("orders").where(in_year("o_orderdate", 1996, op)).select("o_orderkey")

    build.__name__ = f"filter_year_{name}"
    registered(f"SELECT o_orderkey FROM orders WHERE {sql}")(build)


for _op in Operator:
    _calendar(_op.name.lower(), _op, f"year(o_orderdate) {_op.value} 1996")


@registered("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1996-06-30' AND CAST(o_orderdate AS DATE) <> DATE '1996-07-04'")
def filter_on_date(_: Any) -> Any:
    q = from_("orders").where(on_date("o_orderdate", dt.date(1996, 6, 30), Operator.GT))
    return q.where(on_date("o_orderdate", dt.date(1996, 7, 4), Operator.NE)).select("o_orderkey")


@registered("SELECT p_partkey FROM part WHERE (contains(p_name, 'a') OR contains(p_brand, '1')) AND NOT (p_size < 5 AND p_retailprice < 1000)")
def filter_junctions(_: Any) -> Any:
    either = or_([Col("p_name").contains("a"), Col("p_brand").contains("1")])
    return from_("part").where(either & not_(Col("p_size").lt(5) & Col("p_retailprice").lt(1000))).select("p_partkey")


@registered("SELECT p_partkey FROM part WHERE contains(p_name, '1') OR contains(p_brand, '1')")
def filter_where_any(_: Any) -> Any:
    return from_("part").where(where_any(["p_name", "p_brand"], lambda c: c.contains("1"))).select("p_partkey")


@registered("SELECT p_partkey FROM part WHERE contains(p_name, '1') AND contains(p_brand, '1')")
def filter_where_all(_: Any) -> Any:
    return from_("part").where(where_all(["p_name", "p_brand"], lambda c: c.contains("1"))).select("p_partkey")


@registered("SELECT p_partkey FROM part WHERE NOT (contains(p_name, '1') OR contains(p_brand, '1'))")
def filter_where_none(_: Any) -> Any:
    return from_("part").where(where_none(["p_name", "p_brand"], lambda c: c.contains("1"))).select("p_partkey")


@registered("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0")
def conditional_build(_: Any) -> Any:
    q = from_("customer").when(True, lambda q: q.where(Col("c_nationkey").eq(3))).unless(True, lambda q: q.where(Col("c_nationkey").eq(4)))
    q = q.when_not_null(None, lambda q, v: q.where(Col("c_name").eq(v))).when_not_null(0, lambda q, v: q.where(Col("c_acctbal").gt(v)))
    return q.select("c_custkey")


@registered("SELECT doc_id FROM documents WHERE contains(lang, 'r') OR contains(source, 'r')")
def entity_search(engine: Any) -> Any:
    return entities(engine, DOCUMENTS).search("r", ["lang", "source"]).search("  ", ["lang"]).select("doc_id").frame()


# --- Joins.

_NATIONS = "nation n {} JOIN (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0) s ON s.s_nationkey = n.n_nationkey AND n.n_regionkey > 0"


def _join(kind: JoinKind) -> None:
    def build(_: Any) -> Any:
        rich = from_("supplier").where(Col("s_acctbal").gt(0)).select("s_suppkey", "s_nationkey")
        on = Col("s.s_nationkey").eq_col("n.n_nationkey") & Col("n.n_regionkey").gt(0)
        return from_("nation", "n").join_sub(kind, rich, "s", on).select("n.n_name", "s.s_suppkey")

    build.__name__ = f"join_{kind.value}"
    registered(f"SELECT n.n_name, s.s_suppkey FROM {_NATIONS.format(kind.name)}")(build)


for _kind in (JoinKind.INNER, JoinKind.LEFT, JoinKind.RIGHT, JoinKind.FULL):
    _join(_kind)


@registered("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
def join_cross(_: Any) -> Any:
    return from_("region", "r").cross_join("nation", "n").select("r.r_name", "n.n_name")


@registered("SELECT a.n_name AS small, b.n_name AS large FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta_self(_: Any) -> Any:
    on = Col("a.n_regionkey").eq_col("b.n_regionkey") & Col("a.n_nationkey").lt(Col("b.n_nationkey"))
    return from_("nation", "a").inner_join("nation", "b", on).select(Col("a.n_name").as_("small"), Col("b.n_name").as_("large"))


@registered("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
def semi_exists(_: Any) -> Any:
    inner = from_("orders", "o").where(Col("o.o_custkey").eq_col("c.c_custkey") & Col("o.o_totalprice").gt(250000)).select(Lit(1).as_("x"))
    return from_("customer", "c").where(where_exists(inner)).select("c.c_custkey")


@registered("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def anti_not_exists(_: Any) -> Any:
    inner = from_("orders", "o").where(Col("o.o_custkey").eq_col("c.c_custkey") & Col("o.o_orderstatus").eq("P")).select(Lit(1).as_("x"))
    return from_("customer", "c").where(where_not_exists(inner)).select("c.c_custkey")


@registered("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def in_query(_: Any) -> Any:
    return from_("orders").where(Col("o_custkey").in_query(from_("customer").where(Col("c_nationkey").eq(7)).select("c_custkey"))).select("o_orderkey")


@registered("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT CASE WHEN toxic = 1 THEN NULL ELSE doc_id END FROM labels)")
def not_in_null_aware(_: Any) -> Any:
    inner = from_("labels").select(case_when((Col("toxic").ne(1), Col("doc_id"))).as_("x"))
    return from_("documents").where(Col("doc_id").not_in_query(inner)).select("doc_id")


@registered("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def not_in_query(_: Any) -> Any:
    return from_("orders").where(Col("o_custkey").not_in_query(from_("customer").where(Col("c_nationkey").lt(20)).select("c_custkey"))).select("o_orderkey")


# --- Aggregates.


@registered("""
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS price, min(l_shipdate) AS first_shipped,
    max(l_shipdate) AS last_shipped, count(l_tax) AS taxed
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def agg_basic(_: Any) -> Any:
    return (
        from_("lineitem")
        .select(
            "l_returnflag",
            "l_linestatus",
            count_all().as_("n"),
            sum_(Col("l_quantity").cast("bigint")).as_("quantity"),
            sum_(money(Col("l_extendedprice"))).as_("price"),
            min_("l_shipdate").as_("first_shipped"),
            max_("l_shipdate").as_("last_shipped"),
            count("l_tax").as_("taxed"),
        )
        .group_by("l_returnflag", "l_linestatus")
    )


@registered("""
SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS key_sum,
    round(avg(DISTINCT CAST(o_custkey AS DOUBLE)), 6) AS key_mean
FROM orders GROUP BY o_orderstatus
""")
def agg_distinct(_: Any) -> Any:
    key = Col("o_custkey")
    mean = avg(key.cast("float"), distinct=True)
    return (
        from_("orders")
        .select(
            "o_orderstatus",
            count(key, distinct=True).as_("customers"),
            sum_(key, distinct=True).as_("key_sum"),
            fn("ROUND", mean, 6).as_("key_mean"),
        )
        .group_by("o_orderstatus")
    )


@registered("""
SELECT p_brand, CAST(sum(p_size) // count(p_size) AS BIGINT) AS truncated,
    CAST(round(CAST(sum(p_size) AS DECIMAL(28,10)) / count(p_size), 6) AS DECIMAL(38,6)) AS exact
FROM part GROUP BY p_brand
""")
def agg_integer_average(_: Any) -> Any:
    size = typed("p_size", "int")
    return (
        from_("part")
        .select(
            "p_brand",
            avg(size, integers=IntegerAverage.TRUNCATING).as_("truncated"),
            avg(size, integers=IntegerAverage.EXACT_DECIMAL).as_("exact"),
        )
        .group_by("p_brand")
    )


@registered("SELECT count(*) AS n, max(o_totalprice) AS top FROM orders HAVING count(*) > 10")
def having_only(_: Any) -> Any:
    return from_("orders").select(count_all().as_("n"), max_("o_totalprice").as_("top")).having(count_all().gt(10))


@registered("SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING sum(o_custkey) > 100 ORDER BY n DESC, y, o_orderstatus LIMIT 9")
def group_by_expression(_: Any) -> Any:
    y = fn("YEAR", Col("o_orderdate"))
    q = from_("orders").select(y.as_("y"), "o_orderstatus", count_all().as_("n")).group_by(y, "o_orderstatus")
    return q.having(sum_("o_custkey").gt(100)).order_by(Col("n").desc(), Col("y").asc(), Col("o_orderstatus").asc()).top(9)


def _counted(name: str, build_query: Callable[[], Any], sql: str) -> None:
    def build(_: Any) -> Any:
        return build_query()

    build.__name__ = name
    registered(sql)(build)


_counted("count_rows_flat", lambda: from_("orders").where(Col("o_orderstatus").eq("F")).count_rows(), "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
_counted("count_rows_distinct", lambda: from_("orders").select_distinct("o_custkey", "o_orderstatus").count_rows(), "SELECT count(*) AS count FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)")
_counted("count_rows_grouped", lambda: from_("orders").select("o_custkey", count_all().as_("n")).group_by("o_custkey").having(count_all().gt(9)).count_rows(), "SELECT count(*) AS count FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 9)")
_counted("count_rows_paged", lambda: from_("orders").select("o_orderkey").order_by("o_orderkey").paged(10, 7).count_rows(), "SELECT count(*) AS count FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 7 OFFSET 10)")
_counted("count_distinct_one", lambda: from_("orders").count_distinct(["o_custkey"]), "SELECT count(DISTINCT o_custkey) AS count FROM orders")
_counted(
    "count_distinct_composite",
    lambda: from_("documents", "d").left_join("labels", "l", Col("l.doc_id").eq_col("d.doc_id")).select(Col("l.quality").as_("q"), Col("l.toxic").as_("t")).count_distinct(["q", "t"]),
    "SELECT count(*) AS count FROM (SELECT DISTINCT l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)",
)
_counted("aggregate_of_page", lambda: from_("orders").select("o_orderkey", "o_custkey").order_by("o_orderkey").paged(5, 20).aggregate_rows(sum_("o_custkey")), "SELECT CAST(sum(o_custkey) AS BIGINT) AS value FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 5)")


# --- Windows.


@registered("""
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER d AS r, dense_rank() OVER d AS dr, ntile(4) OVER w AS quarter
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), d AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def win_rank_family(_: Any) -> Any:
    w = Window("o_custkey", ["o_orderdate", "o_orderkey"])
    d = Window("o_custkey", ["o_orderpriority"])
    return from_("orders").select("o_orderkey", row_number(w).as_("rn"), rank(d).as_("r"), dense_rank(d).as_("dr"), ntile(4, w).as_("quarter"))


@registered("""
SELECT o_orderkey, lag(o_orderkey, 1, -1) OVER w AS before, lead(o_totalprice, 2) OVER w AS later
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def win_lag_lead(_: Any) -> Any:
    w = Window("o_custkey", ["o_orderdate", "o_orderkey"])
    return from_("orders").select("o_orderkey", lag("o_orderkey", w, 1, -1).as_("before"), lead("o_totalprice", w, 2).as_("later"))


@registered("""
SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS near,
    count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peers,
    CAST(sum(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS running
FROM orders
""")
def win_frames(_: Any) -> Any:
    near = Window("o_orderstatus", ["o_orderkey"], Frame(FrameUnit.ROWS, Bound.preceding(2), CURRENT_ROW))
    peers = Window("o_custkey", ["o_orderpriority"], Frame(FrameUnit.RANGE))
    running = Window("o_custkey", ["o_orderkey"])
    return from_("orders").select(
        "o_orderkey",
        sum_("o_custkey").over(near).as_("near"),
        count_all().over(peers).as_("peers"),
        sum_("o_custkey").over(running).as_("running"),
    )


@registered("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def topn_per_parent(_: Any) -> Any:
    ranked = from_("orders").select("o_custkey", "o_orderkey", row_number(Window("o_custkey", [Col("o_totalprice").desc(), Col("o_orderkey").asc()])).as_("rn"))
    return from_(ranked, "r").where(Col("r.rn").lte(2)).select("r.o_custkey", "r.o_orderkey")


# --- Order, pages, cursors.

_LABELLED = "documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _labelled() -> Any:
    return from_("documents", "d").left_join("labels", "l", Col("l.doc_id").eq_col("d.doc_id")).select("d.doc_id", Col("l.quality").as_("quality"))


@registered(f"SELECT d.doc_id, l.quality AS quality FROM {_LABELLED} ORDER BY l.quality ASC NULLS LAST, d.doc_id LIMIT 30")
def order_nulls_last(_: Any) -> Any:
    return _labelled().order_by(Col("quality").asc(Nulls.LAST), Col("d.doc_id").asc()).top(30)


@registered(f"SELECT d.doc_id, l.quality AS quality FROM {_LABELLED} ORDER BY l.quality DESC NULLS FIRST, d.doc_id DESC LIMIT 30")
def order_nulls_first(_: Any) -> Any:
    return _labelled().order_by(Col("quality").desc(Nulls.FIRST), Col("d.doc_id").desc()).top(30)


@registered(f"SELECT d.doc_id, l.quality AS quality FROM {_LABELLED} ORDER BY l.quality ASC NULLS FIRST, d.doc_id LIMIT 25 OFFSET 40")
def paged(_: Any) -> Any:
    return _labelled().order_by("quality", "d.doc_id").paged(40, 25)


@registered("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey > 20) OR (o_custkey = 20 AND o_orderkey > 100) ORDER BY o_custkey, o_orderkey LIMIT 40")
def keyset_after(_: Any) -> Any:
    orders = [Col("o_custkey").asc(), Col("o_orderkey").asc()]
    return from_("orders").where(after(orders, [20, 100])).select("o_orderkey", "o_custkey").order_by(*orders).top(40)


@registered(f"SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM {_LABELLED}) WHERE quality IS NOT NULL OR doc_id > 50")
def keyset_after_null(_: Any) -> Any:
    orders = [Col("x.quality").asc(), Col("x.doc_id").asc()]
    return from_(_labelled(), "x").where(after(orders, [None, 50])).select("x.doc_id", "x.quality")


# --- Sets.


@registered("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(_: Any) -> Any:
    return from_("customer").select(Col("c_nationkey").as_("k")).union(from_("supplier").select("s_nationkey"))


@registered("(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT n_regionkey FROM nation")
def union_mixed(_: Any) -> Any:
    first = from_("customer").select(Col("c_nationkey").as_("k")).union(from_("supplier").select("s_nationkey"))
    return first.union_all(from_("nation").select("n_regionkey"))


@registered("SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier ORDER BY k LIMIT 15 OFFSET 30")
def set_paged(_: Any) -> Any:
    return from_("customer").select(Col("c_custkey").as_("k")).union_all(from_("supplier").select("s_suppkey")).order_by("k").paged(30, 15)


# --- Subqueries, common tables, hierarchies.


@registered("SELECT c.c_custkey, (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c")
def scalar_subquery_max(_: Any) -> Any:
    inner = from_("orders", "o").where(Col("o.o_custkey").eq_col("c.c_custkey")).select(max_("o.o_totalprice").as_("m"))
    return from_("customer", "c").select("c.c_custkey", scalar_subquery(inner).as_("top"))


@registered("SELECT c.c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AS pending FROM customer c")
def exists_as_value(_: Any) -> Any:
    inner = from_("orders", "o").where(Col("o.o_custkey").eq_col("c.c_custkey") & Col("o.o_orderstatus").eq("P"))
    return from_("customer", "c").select("c.c_custkey", exists_value(inner).as_("pending"))


@registered("WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT k FROM a WHERE n > 10) SELECT a.k, a.n FROM a JOIN b ON a.k = b.k")
def cte_chain(_: Any) -> Any:
    a = from_("orders").select("o_custkey", count_all().as_("n")).group_by("o_custkey")
    b = from_("a").where(Col("a.n").gt(10)).select("a.k")
    q = from_("a").with_cte("a", a, ["k", "n"]).with_cte("b", b)
    return q.inner_join("b", None, Col("a.k").eq_col("b.k")).select("a.k", "a.n")


@registered("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")
def typed_cte(_: Any) -> Any:
    inner = from_("nation").where(Col("n_regionkey").eq(2)).select(typed("n_nationkey", "int"), typed("n_name", "string"))
    cte = TypedCte("chosen", (("id", "int"), ("name", "string")), inner)
    return cte.read().where(cte.column("id").gt(5)).select(cte.column("id"), cte.column("name"))


_TREE = "SELECT p_partkey AS id, CASE WHEN p_partkey < 10 THEN NULL ELSE p_partkey // 10 END AS parent FROM part"


def _tree() -> Any:
    key = typed("p_partkey", "bigint")
    parent = case_when((key.gte(10), key / 10))
    return from_("part").select(Col("p_partkey").as_("id"), parent.as_("parent"))


@registered(f"WITH RECURSIVE n AS ({_TREE}), t AS (SELECT id, 0 AS depth FROM n WHERE id = 3 UNION ALL SELECT n.id, t.depth + 1 FROM n JOIN t ON n.parent = t.id) SELECT id, depth FROM t")
def recursive_cte(_: Any) -> Any:
    anchor = from_(_tree(), "n").where(Col("n.id").eq(3)).select("n.id", Lit(0).as_("depth"))
    step = from_(_tree(), "n").inner_join("t", None, Col("n.parent").eq_col("t.id")).select("n.id", (Col("t.depth") + 1).as_("depth"))
    return from_("t").with_recursive_cte("t", anchor, step, ["id", "depth"])


@registered(f"WITH RECURSIVE n AS ({_TREE}), t AS (SELECT id, parent, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, n.parent, t.depth + 1 FROM n JOIN t ON n.parent = t.id) SELECT id AS \"Key\", parent AS \"ParentKey\", depth AS \"Depth\" FROM t")
def hierarchy_walk(engine: Any) -> Any:
    return Hierarchy(_tree(), "id", "parent").descendants(engine)


@registered(f"WITH RECURSIVE n AS ({_TREE}), t AS (SELECT id, parent, 0 AS depth FROM n WHERE id = 1 UNION ALL SELECT n.id, n.parent, t.depth + 1 FROM n JOIN t ON n.parent = t.id WHERE t.depth < 2) SELECT id AS \"Key\", parent AS \"ParentKey\", depth AS \"Depth\" FROM t WHERE depth > 0")
def hierarchy_depth(engine: Any) -> Any:
    return Hierarchy(_tree(), "id", "parent").descendants(engine, root=1, max_depth=2, include_root=False)


@registered(
    "WITH RECURSIVE n AS (SELECT n_nationkey AS id, (n_nationkey + 7) % 25 AS parent FROM nation), t AS (SELECT id, parent, 0 AS depth, '/' || id || '/' AS path FROM n WHERE id = 4 "
    "UNION ALL SELECT n.id, n.parent, t.depth + 1, t.path || n.id || '/' FROM n JOIN t ON n.parent = t.id WHERE NOT contains(t.path, '/' || n.id || '/')) "
    'SELECT id AS "Key", parent AS "ParentKey", depth AS "Depth", path AS "Path" FROM t'
)
def hierarchy_skip_visited(engine: Any) -> Any:
    key = typed("n_nationkey", "int")
    ring = from_("nation").select(Col("n_nationkey").as_("id"), ((key + 7) % 25).cast("int").as_("parent"))
    return Hierarchy(ring, "id", "parent").descendants(engine, root=4, cycles=Cycles.SKIP_VISITED)


# --- Dates.


@registered("""
SELECT o_orderkey, CAST(date_trunc('year', o_orderdate) AS DATE) AS y, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(o_orderdate AS DATE) AS d FROM orders
""")
def date_truncate(_: Any) -> Any:
    at = Col("o_orderdate")
    cols = [truncated_to(at, g).as_(a) for g, a in ((Grain.YEAR, "y"), (Grain.QUARTER, "q"))]
    return from_("orders").select("o_orderkey", *cols, month_start(at).as_("m"), truncated_to(at, Grain.DAY).as_("d"))


@registered("SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('minute', ts) AS m FROM events")
def time_truncate(_: Any) -> Any:
    return from_("events").select("event_id", truncated_to("ts", Grain.HOUR).as_("h"), truncated_to("ts", Grain.MINUTE).as_("m"))


@registered("""
SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1900-01-01') AS quarter_hour, time_bucket(INTERVAL 10 DAY, ts, TIMESTAMP '1900-01-01') AS ten_days,
    time_bucket(INTERVAL 5 MONTH, ts, TIMESTAMP '1900-01-01') AS five_months, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-03') AS own_week
FROM events
""")
def date_buckets(_: Any) -> Any:
    return from_("events").select(
        "event_id",
        date_bucket("ts", Unit.MINUTE, 15).as_("quarter_hour"),
        date_bucket("ts", Unit.DAY, 10).as_("ten_days"),
        date_bucket("ts", Unit.MONTH, 5).as_("five_months"),
        date_bucket("ts", Unit.WEEK, 1, dt.datetime(2024, 1, 3)).as_("own_week"),
    )


@registered("""
SELECT o_orderkey, CAST(date_diff('year', TIMESTAMP '1994-05-31 10:30:00', o_orderdate) AS INT) AS years,
    CAST(date_diff('quarter', TIMESTAMP '1994-05-31 10:30:00', o_orderdate) AS INT) AS quarters,
    CAST(date_diff('month', TIMESTAMP '1994-05-31 10:30:00', o_orderdate) AS INT) AS months,
    CAST(date_diff('day', date_trunc('week', TIMESTAMP '1994-06-01 10:30:00'), date_trunc('week', o_orderdate + INTERVAL 1 DAY)) // 7 AS INT) AS weeks,
    CAST(date_diff('day', TIMESTAMP '1994-05-31 10:30:00', o_orderdate) AS INT) AS days,
    CAST(date_diff('hour', TIMESTAMP '1994-05-31 10:30:00', o_orderdate) AS INT) AS hours
FROM orders
""")
def date_differences(_: Any) -> Any:
    start = dt.datetime(1994, 5, 31, 10, 30)
    units = (Unit.YEAR, Unit.QUARTER, Unit.MONTH, Unit.WEEK, Unit.DAY, Unit.HOUR)
    return from_("orders").select("o_orderkey", *[date_diff(u, start, "o_orderdate").as_(f"{u.value}s") for u in units])


# --- Scopes and entities.


@registered("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000")
def scope_soft_delete(engine: Any) -> Any:
    return entities(engine, ORDERS).select("o_orderkey").frame()


@registered("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def scope_only_trashed(engine: Any) -> Any:
    return entities(engine, ORDERS).only_trashed().without_scope("recent").select("o_orderkey").frame()


@registered("SELECT o_orderkey FROM orders")
def scope_none(engine: Any) -> Any:
    return entities(engine, ORDERS).with_trashed().without_global_scopes().select("o_orderkey").frame()


@registered("SELECT c_nationkey AS c0, c_custkey AS c1 FROM customer WHERE c_acctbal > 5000")
def entity_pairs(engine: Any) -> Any:
    return entities(engine, CUSTOMER).where(lambda t: t["c_acctbal"].gt(5000.0)).select2(lambda t: (t["c_nationkey"], t["c_custkey"])).frame()


# --- Relations. Arrays are flattened to text, in their order.


def _flat(df: DataFrame, key: str, name: str, value: str, pivot: bool = False) -> DataFrame:
    pick = (lambda x: x["row"][value].cast("string")) if pivot else (lambda x: x[value].cast("string"))
    return df.select(key, F.array_join(F.transform(name, pick), ",").alias("items"))


@registered("SELECT c_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_totalprice DESC, o_orderkey), '') AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def include_has_many(engine: Any) -> Any:
    orders = CUSTOMER_ORDERS.ordered(ALL_ORDERS["o_totalprice"].desc(), ALL_ORDERS["o_orderkey"].asc())
    return _flat(entities(engine, CUSTOMER).include(orders).frame(), "c_custkey", "orders", "o_orderkey")


@registered("""
SELECT c_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey), '') AS items FROM customer LEFT JOIN (
    SELECT * FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3) ON o_custkey = c_custkey GROUP BY 1
""")
def include_take_per_parent(engine: Any) -> Any:
    recent = CUSTOMER_ORDERS.filtered(ALL_ORDERS["o_orderstatus"].ne("P")).ordered(ALL_ORDERS["o_orderdate"].desc(), ALL_ORDERS["o_orderkey"].asc()).take_per_parent(3)
    return _flat(entities(engine, CUSTOMER).include(recent).frame(), "c_custkey", "orders", "o_orderkey")


@registered("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def include_belongs_to_nested(engine: Any) -> Any:
    df = entities(engine, CUSTOMER).include(CUSTOMER_NATION.then(NATION_REGION)).frame()
    return df.select("c_custkey", "nation.n_name", "nation.region.r_name")


@registered("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def include_has_one(engine: Any) -> Any:
    return entities(engine, DOCUMENTS).include(DOCUMENT_LABEL).frame().select("doc_id", "label.quality")


@registered("SELECT o_orderkey, coalesce(string_agg(p_partkey, ',' ORDER BY p_partkey), '') AS items FROM orders LEFT JOIN (SELECT l_orderkey, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey) ON l_orderkey = o_orderkey GROUP BY 1")
def include_pivot(engine: Any) -> Any:
    df = entities(engine, ALL_ORDERS).include(ORDER_PARTS.ordered(PART["p_partkey"].asc())).frame()
    return _flat(df, "o_orderkey", "parts", "p_partkey", pivot=True)


@registered("SELECT r_regionkey, coalesce(string_agg(c_custkey, ',' ORDER BY c_custkey), '') AS items FROM region LEFT JOIN (SELECT n_regionkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey) ON n_regionkey = r_regionkey GROUP BY 1")
def include_has_many_through(engine: Any) -> Any:
    df = entities(engine, REGION).include(REGION_CUSTOMERS.ordered(CUSTOMER["c_custkey"].asc())).frame()
    return _flat(df, "r_regionkey", "customers", "c_custkey", pivot=True)


@registered("SELECT c_custkey, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def include_has_one_through(engine: Any) -> Any:
    return entities(engine, CUSTOMER).include(CUSTOMER_REGION).frame().select("c_custkey", "region.r_name")


_NOTES_SQL = (
    "(SELECT c_custkey * 2 AS note_id, 'customer' AS owner_type, c_custkey AS owner_id, c_mktsegment AS body FROM customer WHERE c_custkey % 7 = 0 "
    "UNION ALL SELECT s_suppkey * 2 + 1, 'supplier', s_suppkey, s_name FROM supplier)"
)


@registered(f"SELECT note_id, c_name, s_name FROM {_NOTES_SQL} LEFT JOIN customer ON owner_type = 'customer' AND c_custkey = owner_id LEFT JOIN supplier ON owner_type = 'supplier' AND s_suppkey = owner_id")
def include_morph_to(engine: Any) -> Any:
    return entities(engine, NOTES).include(NOTE_OWNER).frame().select("note_id", "owner_customer.c_name", "owner_supplier.s_name")


@registered("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey * 2 AS VARCHAR) ELSE '' END AS items FROM customer")
def include_morph_many(engine: Any) -> Any:
    return _flat(entities(engine, CUSTOMER).include(CUSTOMER_NOTES).frame(), "c_custkey", "notes", "note_id")


@registered("SELECT s_suppkey, s_name AS body FROM supplier")
def include_morph_one(engine: Any) -> Any:
    return entities(engine, SUPPLIER).include(SUPPLIER_NOTE).frame().select("s_suppkey", "note.body")


@registered("SELECT s_suppkey, coalesce(r_name, '') AS items FROM supplier LEFT JOIN region ON r_regionkey = s_suppkey % 5")
def include_morph_to_many(engine: Any) -> Any:
    return _flat(entities(engine, SUPPLIER).include(SUPPLIER_TAGS).frame(), "s_suppkey", "tags", "tag", pivot=True)


@registered("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))")
def where_has(engine: Any) -> Any:
    large = CUSTOMER_ORDERS.filtered(ALL_ORDERS["o_totalprice"].gt(250000.0)).then(ORDER_LINES)
    return entities(engine, CUSTOMER).where_has(large).frame().select("c_custkey")


@registered("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey)")
def where_doesnt_have(engine: Any) -> Any:
    return entities(engine, ALL_ORDERS).where_doesnt_have(ORDER_PARTS).frame().select("o_orderkey")


@registered("""
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS orders_count,
    (SELECT CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS key_sum,
    (SELECT min(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS low, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS high,
    (SELECT CAST(sum(o_orderkey) // count(*) AS BIGINT) FROM orders WHERE o_custkey = c_custkey) AS mean,
    (SELECT CAST(round(CAST(sum(o_orderkey) AS DECIMAL(28,10)) / count(*), 6) AS DECIMAL(38,6)) FROM orders WHERE o_custkey = c_custkey) AS exact,
    EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending
FROM customer
""")
def with_aggregates(engine: Any) -> Any:
    pending = CUSTOMER_ORDERS.filtered(ALL_ORDERS["o_orderstatus"].eq("P"))
    key, price = ALL_ORDERS["o_orderkey"], ALL_ORDERS["o_totalprice"]
    q = entities(engine, CUSTOMER).with_count(pending).with_sum(pending, key, "key_sum").with_min(CUSTOMER_ORDERS, price, "low").with_max(CUSTOMER_ORDERS, price, "high")
    q = q.with_avg_truncating(CUSTOMER_ORDERS, key, "mean").with_avg_exact(CUSTOMER_ORDERS, key, "exact").with_exists(pending, "pending")
    return q.frame().select("c_custkey", "orders_count", "key_sum", "low", "high", "mean", "exact", "pending")


# --- Writes: the table as it is afterwards.


@registered("SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size - 10 ELSE p_size END AS p_size, p_brand FROM part")
def dml_update(engine: Any) -> Any:
    return Update(PART).set(p_size=Col("p_size") - 10).where(PART["p_size"].gt(40)).result(engine).select("p_partkey", "p_size", "p_brand")


@registered("SELECT p_partkey FROM part WHERE NOT (p_size > 40)")
def dml_delete(engine: Any) -> Any:
    return Delete(PART).where(PART["p_size"].gt(40)).result(engine).select("p_partkey")


@registered("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'NORTH' UNION ALL SELECT 91, 'SOUTH'")
def dml_insert(engine: Any) -> Any:
    return Insert("region").values(r_regionkey=90, r_name="NORTH").values(r_regionkey=91, r_name="SOUTH").result(engine)


@registered("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def dml_insert_select(engine: Any) -> Any:
    rows = from_("nation").where(Col("n_regionkey").eq(1)).select((Col("n_nationkey") + 100).as_("k"), "n_name")
    return InsertSelect("region", ("r_regionkey", "r_name"), rows).result(engine)


@registered("SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'CHANGED' ELSE r_name END AS r_name FROM region")
def dml_upsert_found(engine: Any) -> Any:
    return Upsert("region", {"r_regionkey": 2}, {"r_name": "NEW"}, {"r_name": "CHANGED"}).result(engine)


@registered("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'NEW'")
def dml_upsert_missing(engine: Any) -> Any:
    return Upsert("region", {"r_regionkey": 77}, {"r_name": "NEW"}, {"r_name": "CHANGED"}).result(engine)


@registered("SELECT coalesce(n.k, c_custkey) AS c_custkey, coalesce(n.name, c_name) AS c_name FROM customer FULL JOIN (SELECT s_suppkey * 20 AS k, s_name AS name FROM supplier) n ON n.k = c_custkey")
def dml_merge(engine: Any) -> Any:
    fresh = engine.table("supplier").selectExpr("s_suppkey * 20 AS c_custkey", "s_name AS c_name")
    return merged(engine.table("customer").select("c_custkey", "c_name"), fresh, ["c_custkey"])


@registered("SELECT o_orderkey, CASE WHEN o_custkey = 10 AND o_orderstatus = 'O' AND o_totalprice > 1000 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def dml_soft_delete(engine: Any) -> Any:
    Repository(engine, ORDERS).delete_where(ORDERS["o_custkey"].eq(10))
    return engine.table("orders").select("o_orderkey", "o_orderstatus")


@registered("SELECT p_partkey, CASE p_partkey WHEN 1 THEN p_size + 7 WHEN 2 THEN 99 ELSE p_size END AS p_size, CASE p_partkey WHEN 2 THEN 'none' ELSE p_brand END AS p_brand FROM part")
def dml_update_many(engine: Any) -> Any:
    repo = Repository(engine, PART)
    repo.update_many([(2, {"p_size": 99, "p_brand": "none"})])
    repo.increment(1, "p_size", 7)
    return engine.table("part").select("p_partkey", "p_size", "p_brand")


@registered("SELECT p_partkey, p_size - CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part WHERE p_size > 30) THEN 5 ELSE 0 END AS p_size FROM part")
def dml_decrement(engine: Any) -> Any:
    key = from_("part").where(Col("p_size").gt(30)).max("p_partkey", engine)
    Repository(engine, PART).decrement_quantities("p_partkey", "p_size", [(key, 2), (key, 3)])
    return engine.table("part").select("p_partkey", "p_size")


@registered("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def entity_grouped(engine: Any) -> Any:
    t = EVENTS
    return entities(engine, t).select(t["event_type"].as_("event_type"), count_all().as_("n")).group_by(t["event_type"]).frame()


@registered("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey IN (3, 4)")
def entity_by_key(engine: Any) -> Any:
    return entities(engine, NATION).where(NATION["n_nationkey"].in_list([3, 4])).frame()

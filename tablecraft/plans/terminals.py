"""Registered queries of what ends a query or writes: terminals, pages, cursors, relations, repositories, transactions.

Each gives the outcome as rows, so that SQL can state it.
"""

from __future__ import annotations

import datetime as dt
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AffectedRowsError, ConcurrencyError, RelationError, RowNotFoundError, UniqueKeyError
from ..functions import Col, IntegerAverage, Lit, avg, raw, typed
from ..functions.temporal import (
    Clock,
    now,
    where_after_today,
    where_before_today,
    where_future,
    where_now_or_future,
    where_now_or_past,
    where_past,
    where_today,
    where_today_or_after,
    where_today_or_before,
)
from ..functions.typed import Converter
from ..operators import Delete, Insert, InsertSelect, JoinKind, Repository, TypedCte, Update, entities, from_, from_parts
from ..operators.entity import Consistency, Projection, ProjectionColumn, ProjectedQuery, RelationAggregate
from ..operators.keyset import Cursor
from ..operators.query import Cte, exists_probe, from_source, source
from ..operators.relations import UnknownMorph, belongs_to, belongs_to_many, has_many, morph_to
from ..operators.repository import CycleWrite, Graph
from ..operators.writes import ABSENT, DEFAULT, Field, Output
from ..sources.observe import Recorder, observed
from ..sources.schema import SchemaSnapshot, diff_tables, fingerprint, read_tables, verify
from ..sources.tables import ColumnDef, ScopeSelection, SoftDelete, TableDef, Timestamps, Trashed, UniqueKey
from ..streaming.watch import rows_equal
from .catalogue import registered
from .tables import ALL_ORDERS, CUSTOMER, CUSTOMER_NATION, CUSTOMER_ORDERS, NATION, NATION_REGION, NOTES, ORDERS, PART, REGION, SUPPLIER

NOON = dt.datetime(2024, 5, 1, 12)
_NOON = "TIMESTAMP '2024-05-01 12:00:00'"


def rows(engine: Any, schema: str, *data: tuple) -> DataFrame:
    return engine.spark.createDataFrame(list(data), schema)


def flag(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def facts(engine: Any, **values: Any) -> DataFrame:
    """``name, value`` rows of small outcomes, as text."""
    return rows(engine, "name string, value string", *((k, None if v is None else flag(v)) for k, v in values.items()))


def refused(kind: type[Exception], act: Any) -> bool:
    try:
        act()
    except kind:
        return True
    return False


# --- Terminals of the builder.


@registered("""
SELECT 'count' AS name, CAST(count(*) AS VARCHAR) AS value FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'distinct_one', CAST(count(DISTINCT o_custkey) AS VARCHAR) FROM orders
UNION ALL SELECT 'distinct_two', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)
UNION ALL SELECT 'sum', CAST(sum(o_orderkey) AS VARCHAR) FROM orders
UNION ALL SELECT 'min', min(o_orderstatus) FROM orders
UNION ALL SELECT 'max', CAST(max(o_custkey) AS VARCHAR) FROM orders
UNION ALL SELECT 'avg', CAST(sum(p_size) // count(*) AS VARCHAR) FROM part
UNION ALL SELECT 'grouped_count', CAST(count(DISTINCT o_orderstatus) AS VARCHAR) FROM orders
""")
def terminal_aggregates(e: Any) -> Any:
    """count, countDistinctColumns, sum, avg, min, max and the aggregate runner."""
    q = from_("orders")
    mean = from_("part").aggregate_rows(avg(typed("p_size", "int"), integers=IntegerAverage.TRUNCATING)).frame(e).first()[0]
    return facts(
        e,
        count=q.where(Col("o_orderstatus").eq("F")).count(e),
        distinct_one=q.count_distinct_columns(["o_custkey"], e),
        distinct_two=q.count_distinct_columns(["o_custkey", "o_orderstatus"], e),
        sum=q.sum("o_orderkey", e, as_=int),
        min=q.min("o_orderstatus", e),
        max=q.max("o_custkey", e),
        avg=mean,
        grouped_count=q.select("o_orderstatus").group_by("o_orderstatus").count(e),
    )


@registered("""
SELECT 'first' AS name, min(n_name) AS value FROM nation
UNION ALL SELECT 'first_or_fail', max(n_name) FROM nation
UNION ALL SELECT 'failed', 'true' UNION ALL SELECT 'value', max(n_name) FROM nation
UNION ALL SELECT 'get', string_agg(n_name, '|' ORDER BY n_name) FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'get_as', string_agg(lower(n_name), '|' ORDER BY n_name) FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'pluck', string_agg(n_nationkey, '|' ORDER BY n_name) FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'exists', CAST(count(*) > 0 AS VARCHAR) FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'doesnt_exist', CAST(count(*) = 0 AS VARCHAR) FROM nation WHERE n_regionkey = 77
UNION ALL SELECT 'probe', '1'
""")
def terminal_rows(e: Any) -> Any:
    """first, firstOrFail, get, getAs, value, pluck, exists, doesntExist, the probe literal."""
    q = from_("nation").select("n_nationkey", "n_name", "n_regionkey")
    some, none = q.where(Col("n_regionkey").eq(1)).order_by("n_name"), q.where(Col("n_regionkey").eq(77))
    last = q.order_by(Col("n_name").desc())
    return facts(
        e,
        first=q.order_by("n_name").first(e)["n_name"],
        first_or_fail=last.first_or_fail(e)["n_name"],
        failed=refused(RowNotFoundError, lambda: none.first_or_fail(e)),
        value=last.value("n_name", e),
        get="|".join(r["n_name"] for r in some.get(e)),
        get_as="|".join(some.get_as(lambda r: r["n_name"].lower(), e)),
        pluck="|".join(map(str, some.pluck("n_nationkey", e))),
        exists=some.exists(e),
        doesnt_exist=none.doesnt_exist(e),
        probe=exists_probe(some).first(e)[0],
    )


@registered("SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 300 AS INT) AS chunk FROM part WHERE p_size > 10")
def builder_chunks(e: Any) -> Any:
    """chunk and lazy of the builder: one ordered pass, chunk by chunk."""
    q = from_("part").where(Col("p_size").gt(10)).select("p_partkey").order_by("p_partkey")
    made = [(r["p_partkey"], i) for i, chunk in enumerate(q.chunk(300, e)) for r in chunk]
    assert [r["p_partkey"] for r in q.lazy(7, e)] == [k for k, _ in made]
    return rows(e, "p_partkey long, chunk int", *made)


@registered("SELECT 'builder' AS kind, n_nationkey, n_name FROM nation UNION ALL SELECT 'entity', n_nationkey, n_name FROM nation UNION ALL SELECT 'projected', n_nationkey, n_name FROM nation")
def terminal_streams(e: Any) -> Any:
    """Row streams of builder, entity and projected queries."""
    made = [("builder", r["n_nationkey"], r["n_name"]) for r in from_("nation").stream(e)]
    made += [("entity", r["n_nationkey"], r["n_name"]) for r in entities(e, NATION).stream()]
    made += [("projected", *r) for r in entities(e, NATION).select2(lambda t: (t["n_nationkey"], t["n_name"])).stream()]
    return rows(e, "kind string, n_nationkey int, n_name string", *made)


# --- Terminals of entities and repositories.


@registered("""
SELECT 'get' AS name, string_agg(n_name, '|' ORDER BY n_name DESC) AS value FROM nation WHERE n_regionkey = 2
UNION ALL SELECT 'first', max(n_name) FROM nation WHERE n_regionkey = 2
UNION ALL SELECT 'first_or_fail', max(n_name) FROM nation WHERE n_regionkey = 2
UNION ALL SELECT 'single', n_name FROM nation WHERE n_nationkey = 3
UNION ALL SELECT 'single_or_none', NULL
UNION ALL SELECT 'several', 'true' UNION ALL SELECT 'none', 'true'
UNION ALL SELECT 'count', CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000
UNION ALL SELECT 'repository_count', CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000
UNION ALL SELECT 'exists', 'true' UNION ALL SELECT 'exists_where', 'false'
UNION ALL SELECT 'exists_key', CAST(count(*) > 0 AS VARCHAR) FROM nation WHERE n_nationkey = 3
""")
def entity_terminals(e: Any) -> Any:
    """get, first, firstOrFail, single, singleOrNull, count, exists and existsWhere; order by and then by."""
    t = NATION
    q = entities(e, t).where(t["n_regionkey"].eq(2)).order_by(t["n_regionkey"].asc()).then_by(t["n_name"].desc())
    one, none = entities(e, t).where(t["n_nationkey"].eq(3)), entities(e, t).where(t["n_nationkey"].eq(777))
    repo = Repository(e, ORDERS)
    return facts(
        e,
        get="|".join(r["n_name"] for r in q.get()),
        first=q.first()["n_name"],
        first_or_fail=q.first_or_fail()["n_name"],
        single=one.single()["n_name"],
        single_or_none=none.single_or_none(),
        several=refused(Exception, q.single),
        none=refused(RowNotFoundError, none.single),
        count=entities(e, ORDERS).count(),
        repository_count=repo.count(ORDERS["o_totalprice"].gt(50000.0)),
        exists=q.exists(),
        exists_where=Repository(e, t).exists_where(t["n_nationkey"].gt(500)),
        exists_key=Repository(e, t).exists(3),
    )


_PAGE = "SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_nationkey DESC, c_custkey LIMIT 7 OFFSET 14"


@registered(f"""
SELECT 'entity' AS kind, c_custkey, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total FROM ({_PAGE})
UNION ALL SELECT 'repository', c_custkey, (SELECT count(*) FROM customer WHERE c_acctbal > 0) FROM ({_PAGE})
UNION ALL SELECT 'projected', c_custkey, (SELECT count(*) FROM customer WHERE c_acctbal > 0) FROM ({_PAGE})
""")
def pages(e: Any) -> Any:
    """Offset pages of entity, repository and projected queries, their totals, the key as tie-break, one snapshot."""
    t = CUSTOMER
    rich, order = t["c_acctbal"].gt(0.0), t["c_nationkey"].desc()
    q = entities(e, t).where(rich).order_by(order)
    found = {
        "entity": q.page(7, 14, total=True, consistency=Consistency.SNAPSHOT),
        "repository": Repository(e, t).page(7, 14, order_by=[order], where=rich, total=True),
        "projected": q.then_by(t["c_custkey"].asc()).select("c_custkey").page(7, 14, total=True),
    }
    assert all(p.has_more and p.size == 7 and p.offset == 14 for p in found.values())
    return rows(e, "kind string, c_custkey long, total long", *((k, r["c_custkey"], p.total) for k, p in found.items() for r in p.rows))


_WALK = "SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) AS nth FROM customer WHERE c_acctbal > 5000"


@registered(f"""
WITH w AS ({_WALK}) SELECT 'next' AS way, c_custkey FROM w WHERE nth BETWEEN 6 AND 10 UNION ALL SELECT 'back', c_custkey FROM w WHERE nth <= 5
UNION ALL SELECT 'projected', c_custkey FROM w WHERE nth BETWEEN 6 AND 10
""")
def cursor_pages(e: Any) -> Any:
    """Keyset pages forward and back by a token; its order and filter are checked."""
    t = CUSTOMER
    q = entities(e, t).where(t["c_acctbal"].gt(5000.0)).order_by(t["c_nationkey"].desc())
    first = q.cursor_page(5)
    second = q.cursor_page(5, Cursor.parse(first.next.token()))
    back = q.cursor_page(5, before=Cursor.parse(second.previous.token()))
    assert refused(Exception, lambda: q.where(t["c_custkey"].gt(1)).cursor_page(5, first.next))
    assert refused(Exception, lambda: Cursor.parse("no cursor"))
    p = q.then_by(t["c_custkey"].asc()).select("c_nationkey", "c_custkey")
    projected = p.cursor_page(5, p.cursor_page(5).next)
    made = [("next", second), ("back", back), ("projected", projected)]
    return rows(e, "way string, c_custkey long", *((w, r["c_custkey"]) for w, page in made for r in page.rows))


@registered("""
SELECT 'chunk' AS kind, s_suppkey, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) // 6 AS INT) AS nth FROM supplier
UNION ALL SELECT 'lazy', s_suppkey, 0 FROM supplier UNION ALL SELECT 'projected', s_suppkey, 0 FROM supplier WHERE s_acctbal > 0
""")
def entity_chunks(e: Any) -> Any:
    """chunk, chunkById and lazy of entity and projected queries."""
    t = SUPPLIER
    q = entities(e, t)
    made = [("chunk", r["s_suppkey"], i) for i, chunk in enumerate(q.chunk_by_id(6)) for r in chunk]
    made += [("lazy", r["s_suppkey"], 0) for r in q.lazy(400)]
    p = q.where(t["s_acctbal"].gt(0.0)).order_by(t["s_suppkey"].asc()).select("s_suppkey")
    made += [("projected", r["s_suppkey"], 0) for r in p.lazy(400)]
    return rows(e, "kind string, s_suppkey long, nth int", *made)


@registered("""
SELECT 'by_id' AS kind, n_nationkey FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 'get_by_id', n_nationkey FROM nation WHERE n_nationkey = 5
UNION ALL SELECT 'where', n_nationkey FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 'all', n_nationkey FROM nation
UNION ALL SELECT 'first', max(n_nationkey) FROM nation WHERE n_regionkey = 3
""")
def repository_reads(e: Any) -> Any:
    """findById, getById, findWhere, findAll, firstWhere."""
    repo, t = Repository(e, NATION), NATION
    in_three = t["n_regionkey"].eq(3)
    made = [("by_id", repo.find_by_id(4)), ("get_by_id", repo.get_by_id(5)), ("first", repo.first_where(in_three, [t["n_nationkey"].desc()]))]
    made += [("where", r) for r in repo.find_where(in_three)] + [("all", r) for r in repo.find_all([t["n_name"].asc()])]
    assert repo.find_by_id(999) is None and refused(RowNotFoundError, lambda: repo.get_by_id(999))
    return rows(e, "kind string, n_nationkey int", *((k, r["n_nationkey"]) for k, r in made))


# --- Expressions, dates, sources.


@registered(f"""
SELECT 'today' AS kind, count(*) AS n FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'
UNION ALL SELECT 'before_today', count(*) FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15'
UNION ALL SELECT 'after_today', count(*) FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-15'
UNION ALL SELECT 'today_or_before', count(*) FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-15'
UNION ALL SELECT 'today_or_after', count(*) FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15'
UNION ALL SELECT 'past', count(*) FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00'
UNION ALL SELECT 'future', count(*) FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00'
UNION ALL SELECT 'now_or_past', count(*) FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'
UNION ALL SELECT 'now_or_future', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'
UNION ALL SELECT 'clock', CASE WHEN {_NOON} > TIMESTAMP '2024-01-15 12:00:00' THEN 1 ELSE 0 END
""")
def dates_of_the_clock(e: Any) -> Any:
    """whereToday and its kin, wherePast and its kin, the server clock; the engine's clock stands still."""
    e.fixed_now = dt.datetime(2024, 1, 15, 12)
    tests = {
        "today": where_today, "before_today": where_before_today, "after_today": where_after_today, "today_or_before": where_today_or_before,
        "today_or_after": where_today_or_after, "past": where_past, "future": where_future, "now_or_past": where_now_or_past,
        "now_or_future": where_now_or_future,
    }
    made = [(name, from_("events").where(test("ts")).count(e)) for name, test in tests.items()]
    clock = from_("region").select(now(Clock.LOCAL).as_("now")).first(e)["now"]
    return rows(e, "kind string, n long", *made, ("clock", 1 if clock == e.fixed_now else 0))


class Status(Enum):
    OPEN, DONE = "O", "F"


@registered("""
SELECT o_orderkey, 'enum' AS kind FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 50
UNION ALL SELECT o_orderkey, 'flag' FROM orders WHERE o_totalprice > 200000 AND o_custkey < 50
UNION ALL SELECT o_orderkey, 'not flag' FROM orders WHERE NOT o_totalprice > 200000 AND o_custkey < 50
UNION ALL SELECT o_orderkey, 'converted' FROM orders WHERE o_custkey = 21
UNION ALL SELECT o_orderkey, 'equal' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey = 22
""")
def typed_predicates(e: Any) -> Any:
    """Enum columns, isTrue and isFalse, converters, eqExpr, a column moved to another source."""
    status = typed("o_orderstatus", "string", members=Status)
    few = Col("o_custkey").lt(50)
    big = raw("o_totalprice > 200000").as_("big")
    flags = from_("orders").where(few).select("o_orderkey", big)
    is_big = typed("f.big", "boolean")
    converted = typed("o_custkey", "bigint", converter=Converter(lambda v: f"C{v}", lambda t: int(t[1:])))
    key = typed("o_custkey", "bigint")
    orders, customers = source("orders", "o"), source("customer", "c")
    equal = from_source(orders).join(JoinKind.INNER, customers, on=key.at(orders).eq_expr(typed("c_custkey", "bigint", customers)))
    kind = lambda name: Lit(name).as_("kind")
    parts = [
        from_("orders").where(status.eq(Status.DONE)).where(few).select("o_orderkey", kind("enum")),
        _sub(flags, "f").where(is_big.is_true()).select("f.o_orderkey", kind("flag")),
        _sub(flags, "f").where(is_big.is_false()).select("f.o_orderkey", kind("not flag")),
        from_("orders").where(converted.eq("C21")).select("o_orderkey", kind("converted")),
        equal.where(typed("c_custkey", "bigint", customers).eq(22)).select("o.o_orderkey", kind("equal")),
    ]
    made = parts[0].frame(e)
    for p in parts[1:]:
        made = made.unionByName(p.frame(e))
    return made


def _sub(q: Any, name: str) -> Any:
    from ..operators.query import from_sub

    return from_sub(q, name)


@registered("SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2) AND c_acctbal > 100")
def conditional_predicates(e: Any) -> Any:
    """whereIf, whereIfNotNull, whereInIfNotEmpty: what is not asked for restricts nothing."""
    q = entities(e, CUSTOMER).where_if(True, lambda t: t["c_acctbal"].gt(100.0)).where_if(False, lambda t: t["c_custkey"].eq(1))
    q = q.where_if_not_null(None, lambda t, v: t["c_custkey"].eq(v)).where_if_not_null(2, lambda t, v: t["c_nationkey"].lte(v))
    q = q.where_in_if_not_empty([], lambda t, v: t["c_custkey"].in_list(v)).where_in_if_not_empty([1, 2], lambda t, v: t["c_nationkey"].in_list(v))
    return q.frame().select("c_custkey")


@registered("SELECT n.n_name, t.n FROM nation n JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) t ON t.c_nationkey = n.n_nationkey")
def join_derived(e: Any) -> Any:
    """A join to a derived table."""
    from ..functions import count_all

    per = from_("customer").select("c_nationkey", count_all().as_("n")).group_by("c_nationkey")
    return from_("nation", "n").join_sub(JoinKind.INNER, per, "t", Col("t.c_nationkey").eq_expr(Col("n.n_nationkey"))).select("n.n_name", "t.n")


@registered("SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey < 3")
def expressions_as_tables(e: Any) -> Any:
    """withExpression of the builder, withTypedCte of entities."""
    inner = from_("nation").where(Col("n_regionkey").eq(2)).select(typed("n_nationkey", "int").as_("id"))
    one = from_("chosen").with_expression(Cte("chosen", inner)).select("id")
    cte = TypedCte("small", (("key", "int"),), from_("nation").where(Col("n_nationkey").lt(3)).select(typed("n_nationkey", "int").as_("key")))
    in_small = from_("small").select(cte.column("key"))
    two = entities(e, NATION).with_typed_cte(cte).where(lambda t: t["n_nationkey"].in_query(in_small)).frame()
    return one.frame(e).unionByName(two.select(F.col("n_nationkey").alias("id")))


@registered("WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i * 2 FROM n WHERE i < 500) SELECT CAST(i AS INT) AS i FROM n")
def typed_recursion(e: Any) -> Any:
    """A recursive common table with declared columns."""
    anchor = from_("region").where(Col("r_regionkey").eq(0)).select(Lit(1, "int").as_("i"))
    step = from_("doubled").where(Col("i").lt(500)).select((typed("i", "int") * 2).as_("i"))
    return TypedCte("doubled", (("i", "int"),), anchor, step).read().select("i")


@registered("""
SELECT n_nationkey AS c0, n_name AS c1, n_regionkey AS c2, NULL AS c3, 'three' AS kind FROM nation
UNION ALL SELECT n_nationkey, n_name, n_regionkey, n_name, 'four' FROM nation
""")
def entity_tuples(e: Any) -> Any:
    """Projections of three and four columns."""
    t3 = entities(e, NATION).select3(lambda t: (t["n_nationkey"], t["n_name"], t["n_regionkey"])).frame()
    t4 = entities(e, NATION).select4(lambda t: (t["n_nationkey"], t["n_name"], t["n_regionkey"], t["n_name"])).frame()
    three = t3.withColumns({"c3": F.lit(None).cast("string"), "kind": F.lit("three")})
    return three.unionByName(t4.withColumn("kind", F.lit("four")))


@registered("SELECT n_nationkey, upper(n_name) || '!' AS said FROM nation WHERE n_regionkey = 1")
def entity_projection(e: Any) -> Any:
    """A projection descriptor: named columns and what is made of a row."""
    shape = Projection("said", (ProjectionColumn("key", NATION["n_nationkey"], True), ProjectionColumn("name", NATION["n_name"])), lambda r: (r["key"], r["name"].upper() + "!"))
    return rows(e, "n_nationkey int, said string", *ProjectedQuery(entities(e, NATION).where(NATION["n_regionkey"].eq(1)), shape).get())


@registered("SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def scan_rebound(e: Any) -> Any:
    """A definition over another tenant's table; a built source; global scopes off."""
    e.register(["east", "region"], e.table("region").where("r_regionkey > 1"))
    moved = REGION.for_table(schema="east")
    got = entities(e, REGION).at(schema="east").without_global_scopes().scoped()
    assert from_source(moved.as_source("m")).count(e) == got.count()
    return got.select("r_regionkey", "r_name")


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 0")
def scan_with_hints(e: Any) -> Any:
    """Locks are notes, hints that Spark knows are passed on."""
    q = from_("nation").where(Col("n_regionkey").eq(0)).select("n_nationkey", "n_name")
    assert q.shared_lock().count(e) == q.lock_for_update().count(e)
    return q.with_hint("broadcast")


@registered("SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1")
def procedure(e: Any) -> Any:
    """A stored procedure is a function the engine knows."""
    e.procedure("customers_of", lambda engine, key: engine.table("nation").where(F.col("n_regionkey") == key).join(engine.table("customer"), F.expr("c_nationkey = n_nationkey")))
    return e.call("Customers_Of", 1).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


# --- The catalog, schemas, observers.


@registered("""
SELECT * FROM (VALUES ('nation', 'n_name', 'string', 'false'), ('nation', 'n_nationkey', 'int', 'true'), ('nation', 'n_regionkey', 'int', 'false'),
    ('region', 'r_name', 'string', 'false'), ('region', 'r_regionkey', 'int', 'true')) v("table", "column", type, in_key)
""")
def catalog_reader(e: Any) -> Any:
    """Definitions read from live tables, written as a snapshot and read again."""
    found = read_tables(e, ["region", "nation"], {"region": ("r_regionkey",), "nation": ("n_nationkey",)})
    again = SchemaSnapshot.from_json(found.to_json())
    assert [fingerprint(t) for t in again.tables] == [fingerprint(found.table(t.name)) for t in again.tables]
    made = [(t.name, c.name, c.type_name, flag(c.name in t.primary_key)) for t in again.tables for c in t.columns]
    return rows(e, "table string, column string, type string, in_key string", *made)


@registered("""
SELECT * FROM (VALUES ('COLUMN_ADDED', 'n_extra'), ('COLUMN_MISSING', 'n_name'), ('PRIMARY_KEY_CHANGED', ''), ('TYPE_CHANGED', 'n_regionkey'), ('live', '0'), ('unique', 'true'), ('same', 'true'))
    v(kind, subject)
""")
def schema_differences(e: Any) -> Any:
    """Differences of definitions by kind, the check against the live table, uniqueness, fingerprints."""
    other = TableDef("nation", (ColumnDef("n_nationkey", "int", False), ColumnDef("n_regionkey", "string"), ColumnDef("n_extra", "string")), ("n_regionkey",))
    same = TableDef("nation", NATION.columns, NATION.primary_key)
    made = [(f.kind.name, f.subject) for f in diff_tables(NATION, other)]
    made += [("live", str(len(verify(e, NATION)))), ("unique", flag(CUSTOMER.is_unique(("c_name", "c_acctbal")))), ("same", flag(fingerprint(same) == fingerprint(NATION)))]
    return rows(e, "kind string, subject string", *made)


@registered("SELECT * FROM (VALUES ('query', 'done', 'false'), ('write', 'done', 'false'), ('write', 'UnsafeWriteError', 'false')) v(kind, outcome, shows_value)")
def observers(e: Any) -> Any:
    """An attached recorder hears queries, writes and failures; bound values are hidden."""
    seen = Recorder()
    observed(e, seen)
    e.query(from_("region").where(Col("r_name").eq("SECRET")).select("r_name"))
    e.execute(Insert(REGION).values(r_regionkey=50, r_name="SECRET"))
    refused(Exception, lambda: e.execute(Delete(REGION)))
    assert len(seen.failures) == 1 and "failed" in seen.describe()
    return rows(
        e, "kind string, outcome string, shows_value string",
        *((x["kind"], type(x["error"]).__name__ if x["error"] else "done", flag("SECRET" in x["text"])) for x in seen.events),
    )


# --- Relations.


@registered("""
SELECT c_custkey, CAST(count(*) AS INT) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1
""")
def with_where_has(e: Any) -> Any:
    """withWhereHas: the filter of the parents is that of the loaded rows."""
    pending = CUSTOMER_ORDERS.filtered(ALL_ORDERS["o_orderstatus"].eq("P"))
    return entities(e, CUSTOMER).with_where_has(pending).frame().select("c_custkey", F.size("orders").alias("n"))


@registered("""
SELECT c_custkey, n_name, r_name, (SELECT CAST(count(*) AS INT) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('O', 'F')) AS n,
    (SELECT CAST(count(*) AS INT) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS gone
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey < 200
""")
def include_merged(e: Any) -> Any:
    """Includes of one relation merge; joined to-one includes; trashed rows of a relation; loadMissing and attachIncludes."""
    scoped = has_many("all", ORDERS, "c_custkey", "o_custkey").with_trashed().filtered(ORDERS["o_orderstatus"].in_list(["O", "F"]))
    scoped = _unscoped(scoped)
    gone = _unscoped(has_many("gone", ORDERS, "c_custkey", "o_custkey").only_trashed())
    q = entities(e, CUSTOMER).where(CUSTOMER["c_custkey"].lt(200)).include(CUSTOMER_NATION.joined(), CUSTOMER_NATION.then(NATION_REGION))
    df = q.attach_includes(q.scoped())
    df = q.load_missing(q.load_missing(df, [scoped, gone]), [CUSTOMER_NATION, gone])
    return df.select("c_custkey", "nation.n_name", "nation.region.r_name", F.size("all").alias("n"), F.size("gone").alias("gone"))


def _unscoped(relation: Any) -> Any:
    from dataclasses import replace

    return replace(relation, selection=replace(relation.selection, no_globals=True))


@registered("SELECT s_suppkey * 2 + 1 AS note_id, s_name FROM supplier UNION ALL SELECT c_custkey * 2, NULL FROM customer WHERE c_custkey % 7 = 0")
def include_unknown_morph(e: Any) -> Any:
    """Notes of a kind that the relation does not know are kept without an owner, if it says so; otherwise refused."""
    from dataclasses import replace

    owner = morph_to("owner", "owner_type", "owner_id", {"supplier": (SUPPLIER, "s_suppkey")})
    assert refused(Exception, lambda: entities(e, NOTES).include(owner).frame().collect())
    df = entities(e, NOTES).include(replace(owner, unknown=UnknownMorph.IGNORE)).frame()
    return df.select("note_id", "owner_supplier.s_name")


@registered("SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS high, count(o_orderkey) > 0 AS any FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def relation_aggregates(e: Any) -> Any:
    """Aggregates of a relation, given as a list."""
    from ..functions import count_all, max_

    specs = [RelationAggregate("n", CUSTOMER_ORDERS, count_all()), RelationAggregate("high", CUSTOMER_ORDERS, max_(ALL_ORDERS["o_totalprice"])), RelationAggregate("any", CUSTOMER_ORDERS, exists=True)]
    return entities(e, CUSTOMER).with_aggregates(*specs).frame().select("c_custkey", "n", "high", "any")


# --- Repositories: a table with an identity, defaults, stamps, a version and a soft delete.

ITEMS = TableDef(
    "items",
    (
        ColumnDef("id", "bigint", False, identity=True),
        ColumnDef("name", "string"),
        ColumnDef("qty", "int", default=Lit(5)),
        ColumnDef("state", "string", default=Lit("live")),
        ColumnDef("made", "timestamp_ntz"),
        ColumnDef("changed", "timestamp_ntz"),
        ColumnDef("version", "int", row_version=True),
        ColumnDef("owner", "bigint"),
    ),
    ("id",),
    (UniqueKey("by_name", ("name",)),),
    soft_delete=SoftDelete("state", alive_value="live", deleted_value="gone"),
    timestamps=Timestamps("made", "changed"),
)
_ITEMS = (
    "(SELECT CAST(p_partkey AS BIGINT) AS id, 'item ' || p_partkey AS name, p_size AS qty, CASE WHEN p_partkey % 5 = 0 THEN 'gone' ELSE 'live' END AS state, "
    "TIMESTAMP '2020-01-01 00:00:00' AS made, TIMESTAMP '2020-01-01 00:00:00' AS changed, CAST(1 AS INT) AS version, CAST(NULL AS BIGINT) AS owner FROM part WHERE p_partkey <= 20)"
)
_NEW = "CAST(1 AS INT) AS version, CAST(NULL AS BIGINT) AS owner"


def items(e: Any) -> Repository:
    """Items made of parts; the clock stands still."""
    e.fixed_now = NOON
    sql = _ITEMS[1:-1].replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    e.register("items", e.spark.sql(sql.replace("FROM part", "FROM {part}"), part=e.table("part")).withColumn("qty", F.col("qty").cast("int")))
    return Repository(e, ITEMS)


@registered(f"""
SELECT * FROM {_ITEMS} UNION ALL SELECT 21, 'a', 5, 'live', {_NOON}, {_NOON}, {_NEW} UNION ALL SELECT 22, 'b', 7, 'live', {_NOON}, {_NOON}, {_NEW}
UNION ALL SELECT 23, 'c', 7, 'live', {_NOON}, {_NOON}, {_NEW} UNION ALL SELECT 24, 'd', NULL, 'live', {_NOON}, {_NOON}, {_NEW}
""")
def repository_inserts(e: Any) -> Any:
    """insert, insertAll, createMany: identities, defaults, stamps; the row given back is the row stored."""
    repo = items(e)
    one = repo.insert({"name": "a"})
    assert one in repo.find_where(ITEMS["name"].eq("a")) and one["id"] == 21 and one["made"] == NOON
    repo.insert_assignments({"name": "b", "qty": 7})
    repo.insert_all([{"name": "c", "qty": 7}])
    assert repo.create_many([{"name": "d", "qty": None}], return_rows=True).rows[0]["qty"] is None
    assert refused(UniqueKeyError, lambda: repo.insert({"name": "d"}))
    return e.table("items")


@registered(f"""
SELECT id, CASE id WHEN 2 THEN 'two' ELSE name END AS name,
    CASE WHEN id = 1 THEN 100 WHEN id = 2 THEN 102 WHEN id = 3 THEN NULL WHEN id IN (6, 7) THEN 67 WHEN id = 8 THEN qty + 3 WHEN id = 9 THEN qty - 1 ELSE qty END AS qty, state,
    CASE WHEN id IN (1, 2, 3, 6, 7, 8, 9) THEN {_NOON} ELSE changed END AS changed,
    CASE WHEN id IN (1, 2, 3, 6, 7, 8, 9) THEN 2 ELSE version END AS version FROM {_ITEMS}
""")
def repository_updates(e: Any) -> Any:
    """update, updateOne, updatePatch, updateMatching, updateWhere, increments: stamps and versions move, absent fields stay, a stale version fails."""
    repo = items(e)
    t = ITEMS
    repo.update({"id": 1, "qty": 100})
    repo.update_one({"id": 2, "qty": 102, "name": "two"})
    assert refused(AffectedRowsError, lambda: repo.update_one({"id": 999, "qty": 1}))
    repo.update_patch(3, {"qty": Field(None), "name": ABSENT}, expected_version=1)
    assert refused(ConcurrencyError, lambda: repo.update_patch(3, {"qty": 1}, expected_version=1))
    repo.update_matching(t["id"].eq(6), {"qty": 67}, expect_affected=1)
    repo.update_where(t["id"].eq(7), {"qty": 67})
    repo.increment(8, "qty", 3)
    repo.decrement(9, "qty")
    assert repo.update_patch(5, {"qty": 1}).affected == 0  # deleted rows are out of scope
    return e.table("items").select("id", "name", "qty", "state", "changed", "version")


@registered(f"""
SELECT id, CASE id WHEN 1 THEN 11 WHEN 4 THEN qty - 0 ELSE qty END AS qty, CASE id WHEN 2 THEN 'two' ELSE name END AS name,
    CASE WHEN id IN (1, 2) THEN {_NOON} ELSE changed END AS changed, CASE WHEN id IN (1, 2) THEN 2 ELSE version END AS version FROM {_ITEMS}
""")
def repository_update_many(e: Any) -> Any:
    """Many patches in one pass: deleted rows are out of scope, stamps and versions move."""
    repo = items(e)
    out = repo.update_many([(1, {"qty": 11}), (2, {"name": "two"}), (5, {"qty": 0})])
    assert out.affected == 2
    assert refused(AffectedRowsError, lambda: repo.decrement_quantities("id", "qty", [(5, 1)]))
    return e.table("items").select("id", "qty", "name", "changed", "version")


@registered(f"""
SELECT id, CASE WHEN id IN (1, 2, 3) THEN 'gone' WHEN id = 5 THEN 'live' ELSE state END AS state, CASE WHEN id IN (1, 2, 3, 5) THEN 2 ELSE version END AS version
FROM {_ITEMS} WHERE id <> 10
""")
def repository_deletes(e: Any) -> Any:
    """delete, deleteWhere, forceDelete, restore, trashed."""
    repo, t = items(e), ITEMS
    repo.delete(1)
    repo.delete_where(t["id"].in_list([2, 3]))
    assert repo.trashed(5) and repo.trashed(1) and not repo.trashed(4)
    repo.restore(5)
    repo.force_delete(10)
    assert repo.delete(15).affected == 0
    return e.table("items").select("id", "state", "version")


@registered("""
SELECT * FROM (VALUES ('first_or_create', 'item 1', 1), ('first_or_create', 'x', 21), ('first_or_new', 'y', -1), ('update_or_create', 'item 2', 2), ('update_or_create', 'z', 22),
    ('create_or_first', 'item 3', 3), ('get_or_create', 'item 5', 5), ('get_or_create', 'v', 23)) v(kind, name, id)
""")
def repository_find_or_make(e: Any) -> Any:
    """firstOrCreate, firstOrNew, updateOrCreate, createOrFirst, getOrCreate with a deleted row restored."""
    repo, t = items(e), ITEMS
    named = lambda n: t["name"].eq(n)
    made = [("first_or_create", repo.first_or_create(named(n), lambda n=n: {"name": n})) for n in ("item 1", "x")]
    made.append(("first_or_new", repo.first_or_new(named("y"), lambda: {"name": "y", "id": -1})))
    made += [("update_or_create", repo.update_or_create(named(n), lambda row, n=n: {"name": n, "qty": 9})) for n in ("item 2", "z")]
    made.append(("create_or_first", repo.create_or_first(named("item 3"), lambda: {"name": "item 3"})))
    made += [("get_or_create", repo.get_or_create("by_name", {"name": n}, restore_existing=True)) for n in ("item 5", "v")]
    assert refused(UniqueKeyError, lambda: repo.get_or_create("by_name", {"name": "item 10"}))
    assert repo.get_by_id(2)["qty"] == 9 and repo.get_by_id(5)["state"] == "live"
    return rows(e, "kind string, name string, id int", *((k, r["name"], int(r["id"])) for k, r in made))


@registered("""
SELECT 'update' AS kind, p_partkey AS id, p_size AS before, p_size + 1 AS after FROM part WHERE p_size < 3
UNION ALL SELECT 'delete', p_partkey, p_size, NULL FROM part WHERE p_size = 50
UNION ALL SELECT 'all', r_regionkey, NULL, 7 FROM region
""")
def write_outputs(e: Any) -> Any:
    """OUTPUT of old and new columns, under names, into a view; allRows; run and runReturning."""
    both = Output.of(inserted=["p_partkey", "p_size"], deleted=["p_size"], into="changed_parts")
    done = Update(PART).set(p_size=Col("p_size") + 1).where(PART["p_size"].lt(3)).returning(both).run(e)
    assert e.spark.table("changed_parts").count() == done.affected == len(done.rows)
    gone = e.execute(Delete(PART).where(PART["p_size"].eq(50)).returning(Output.of(deleted=["p_partkey", "p_size"])))
    e.register("numbers", e.table("region").select("r_regionkey", F.lit(1).alias("n")))
    numbers = TableDef("numbers", (ColumnDef("r_regionkey", "int"), ColumnDef("n", "int")), ("r_regionkey",))
    every = Update(numbers).set(n=7).all_rows().returning(Output.of(inserted=["r_regionkey", "n"])).run(e)
    assert refused(Exception, lambda: Update(numbers).set(n=8).run(e))
    made = [("update", r["p_partkey"], r["deleted_p_size"], r["inserted_p_size"]) for r in done.rows]
    made += [("delete", r["p_partkey"], r["p_size"], None) for r in gone.rows] + [("all", r["r_regionkey"], None, r["n"]) for r in every.rows]
    return rows(e, "kind string, id long, before int, after int", *made)


@registered(f"SELECT name, qty, state FROM {_ITEMS} UNION ALL SELECT NULL, 5, 'live' UNION ALL SELECT 'x', 5, 'live' UNION ALL SELECT 'y', NULL, 'live'")
def write_defaults(e: Any) -> Any:
    """DEFAULT VALUES, the DEFAULT keyword, a bound null, an expected number of rows."""
    items(e)
    e.execute(Insert(ITEMS).default_values())
    e.execute(Insert(ITEMS).values(name="x", qty=DEFAULT).values(name="y", qty=None).expect(2))
    assert refused(AffectedRowsError, lambda: e.execute(Insert(ITEMS).values(name="z").expect(2)))
    return e.table("items").select("name", "qty", "state")


@registered("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation UNION ALL SELECT s_suppkey + 1000, s_name FROM supplier")
def bulk_loads(e: Any) -> Any:
    """The bulk sink and INSERT from a query through a repository."""
    repo = Repository(e, REGION)
    out = repo.bulk_load(e.table("nation").selectExpr("n_nationkey + 100 AS r_regionkey", "n_name AS r_name"))
    assert out.affected == e.table("nation").count()
    repo.insert_select(["r_regionkey", "r_name"], from_("supplier").select((Col("s_suppkey") + 1000).as_("k"), "s_name"))
    return e.table("region")


@registered("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 60, 'kept' UNION ALL SELECT 62, 'inner'")
def transactions(e: Any) -> Any:
    """All or nothing; an inner failure takes back to its savepoint; listeners hear of commits alone."""
    repo, heard = Repository(e, REGION), []
    e.hub.listen(["region"], heard.append)

    def fail(inner: bool) -> None:
        with e.transaction():
            repo.insert({"r_regionkey": 61, "r_name": "lost"})
            raise RelationError("undone")

    assert refused(RelationError, lambda: fail(False)) and not heard
    with e.transaction():
        repo.insert({"r_regionkey": 60, "r_name": "kept"})
        refused(RelationError, lambda: fail(True))
        with e.transaction():
            repo.insert({"r_regionkey": 62, "r_name": "inner"})
    assert heard == ["region"]
    return e.table("region")


# --- Writes of graphs and relations.

TEAMS = TableDef("teams", (ColumnDef("team_id", "int", False), ColumnDef("title", "string"), ColumnDef("head", "int")), ("team_id",))
PEOPLE = TableDef("people", (ColumnDef("person_id", "int", False), ColumnDef("name", "string"), ColumnDef("team_id", "int")), ("person_id",))
SKILLS = TableDef("skills", (ColumnDef("skill_id", "int", False), ColumnDef("skill", "string")), ("skill_id",))
KNOWS = TableDef("knows", (ColumnDef("person_id", "int"), ColumnDef("skill_id", "int"), ColumnDef("level", "int")))
TEAM_HEAD = belongs_to("head_person", PEOPLE, "head", "person_id")
PERSON_TEAM = belongs_to("team", TEAMS, "team_id", "team_id")
TEAM_PEOPLE = has_many("people", PEOPLE, "team_id", "team_id")
PERSON_SKILLS = belongs_to_many("skills", SKILLS, "person_id", KNOWS, "person_id", "skill_id", "skill_id")


def company(e: Any) -> Any:
    for t in (TEAMS, PEOPLE, SKILLS, KNOWS):
        e.register(t.name, e.spark.createDataFrame([], ", ".join(f"{c.name} {c.type_name}" for c in t.columns)))
    return {t.name: Repository(e, t) for t in (TEAMS, PEOPLE, SKILLS, KNOWS)}


@registered("""
SELECT * FROM (VALUES ('team', 1, 'core', 7), ('person', 7, 'ann', 1), ('person', 8, 'bob', 1), ('skill', 3, 'sql', NULL), ('knows', 8, NULL, 3)) v(kind, id, name, ref)
""")
def graph_writes(e: Any) -> Any:
    """A graph of rows: parents, children, pivots; rows that name each other are refused, or written and then linked."""
    repo = company(e)
    team = Graph(repo["teams"], {"team_id": 1, "title": "core"})
    ann = Graph(repo["people"], {"person_id": 7, "name": "ann"}, parents=((PERSON_TEAM, team),))
    bob = Graph(repo["people"], {"person_id": 8, "name": "bob"}, children=((PERSON_SKILLS, Graph(repo["skills"], {"skill_id": 3, "skill": "sql"})),))
    object.__setattr__(team, "parents", ((TEAM_HEAD, ann),))
    object.__setattr__(team, "children", ((TEAM_PEOPLE, bob),))
    assert refused(RelationError, lambda: repo["people"].create_graph(ann)) and not repo["people"].query().exists()
    repo["people"].create_graph(ann, CycleWrite.NULL_THEN_UPDATE)
    parts = [
        e.table("teams").selectExpr("'team' AS kind", "team_id AS id", "title AS name", "head AS ref"),
        e.table("people").selectExpr("'person'", "person_id", "name", "team_id"),
        e.table("skills").selectExpr("'skill'", "skill_id", "skill", "CAST(NULL AS INT)"),
        e.table("knows").selectExpr("'knows'", "person_id", "CAST(NULL AS STRING)", "skill_id"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@registered("""
SELECT * FROM (VALUES ('person', 7, 1), ('person', 8, NULL), ('person', 9, 1), ('knows', 7, 2), ('knows', 7, 3), ('knows', 9, 1)) v(kind, id, ref)
""")
def relation_writes(e: Any) -> Any:
    """Through a relation: create, associate, dissociate, attach, detach, detachAll, sync."""
    repo = company(e)
    team = repo["teams"].insert({"team_id": 1, "title": "core"})
    skills = [repo["skills"].insert({"skill_id": i, "skill": f"s{i}"}) for i in (1, 2, 3)]
    ann = repo["teams"].related(team, TEAM_PEOPLE).create({"person_id": 7, "name": "ann"})
    bob = repo["people"].insert({"person_id": 8, "name": "bob"})
    cat = repo["people"].insert({"person_id": 9, "name": "cat"})
    for person in (bob, cat):
        repo["people"].related(person, PERSON_TEAM).associate(team)
    repo["people"].related(bob, PERSON_TEAM).dissociate()
    of = {p["name"]: repo["people"].related(p, PERSON_SKILLS) for p in (ann, bob, cat)}
    of["ann"].attach(skills[0], {"level": 1})
    of["ann"].attach(skills[1])
    assert of["ann"].sync(skills[1:]) == (1, 1)
    of["bob"].attach(skills[0])
    of["bob"].detach_all()
    of["cat"].attach(skills[0])
    of["cat"].attach(skills[2])
    of["cat"].detach(skills[2])
    people = e.table("people").selectExpr("'person' AS kind", "person_id AS id", "team_id AS ref")
    return people.union(e.table("knows").selectExpr("'knows'", "person_id", "skill_id"))


# --- Watching.


@registered("""
SELECT * FROM (VALUES (0, 'entity', 5), (1, 'entity', 6), (2, 'entity', 7), (0, 'projected', 5), (1, 'projected', 6), (2, 'projected', 7)) v(nth, kind, n)
""")
def watched_results(e: Any) -> Any:
    """A watched result comes again when a commit changes it, not when it stays as it was, nor after a rollback."""
    repo = Repository(e, REGION)
    watches = {"entity": entities(e, REGION).watch(), "projected": entities(e, REGION).select("r_name").watch(["region"])}
    made = [(0, k, len(next(w))) for k, w in watches.items()]
    for nth in (1, 2):
        refused(RelationError, lambda: _undone(e, repo))
        assert not any(w.pending() for w in watches.values())
        e.put({"region": e.table("region")})  # the same rows
        repo.insert({"r_regionkey": 70 + nth, "r_name": f"new {nth}"})
        made += [(nth, k, len(next(w))) for k, w in watches.items()]
    for w in watches.values():
        w.close()
    assert rows_equal(repo.find_all(), repo.find_all())
    return rows(e, "nth int, kind string, n int", *made)


def _undone(e: Any, repo: Repository) -> None:
    with e.transaction():
        repo.insert({"r_regionkey": 99, "r_name": "lost"})
        raise RelationError("undone")


__all__ = ["ITEMS", "items"]

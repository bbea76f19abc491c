"""What is refused, without a session."""

import datetime as dt

import pytest

from tablecraft import (
    CURRENT_ROW,
    UNBOUNDED_FOLLOWING,
    Aggregate,
    ArgumentError,
    Bound,
    CapabilityError,
    Col,
    Cursor,
    CursorError,
    EmptyIn,
    Frame,
    FrameUnit,
    IntegerAverage,
    NullComparisonError,
    Projection,
    QueryShapeError,
    ReadOnlyColumnError,
    TypeRuleError,
    Window,
    and_,
    avg,
    case_when,
    cast_type,
    coalesce,
    count_all,
    fn,
    from_,
    in_year,
    lag,
    like_regex,
    min_,
    name_parts,
    ntile,
    rank,
    sql_literal,
    sum_,
    table_of,
    typed,
)
from tablecraft.operators import Cte, Insert, JoinKind, Update, belongs_to, has_many, merge_includes
from tablecraft.sources import Recorder, SchemaSnapshot, diff_schemas, fingerprint, parse_report, redact
from tablecraft.sources.tables import ColumnDef, SoftDelete, TableDef, Trashed, UniqueKey


@pytest.mark.parametrize("method", ["eq", "ne", "lt", "lte", "gt", "gte", "like_raw"])
def test_null_operands(method):
    with pytest.raises(NullComparisonError):
        getattr(Col("a"), method)(None)


def test_values_of_expressions():
    with pytest.raises(ArgumentError):
        Col("a").in_list([])
    assert Col("a").in_list([], EmptyIn.OMIT) is None
    with pytest.raises(NullComparisonError):
        Col("a").in_list([1, None])
    for bad in ("", "  "):
        with pytest.raises(ArgumentError):
            Col(bad)
    with pytest.raises(QueryShapeError):
        coalesce(Col("a"))
    with pytest.raises(QueryShapeError):
        case_when()
    with pytest.raises(QueryShapeError):
        and_([])
    with pytest.raises(ArgumentError):
        fn("drop table x; --")
    with pytest.raises(ArgumentError):
        in_year("a", 0)
    with pytest.raises(ArgumentError):
        in_year(typed("a", "timestamp"), 2020)
    with pytest.raises(ArgumentError):
        in_year(typed("a", "timestamp_ntz"), 2020, zone_offset=dt.timedelta(hours=1))


def test_types():
    with pytest.raises(TypeRuleError):
        typed("a", "int").eq("x")
    with pytest.raises(TypeRuleError):
        typed("a", "boolean").gt(True)
    with pytest.raises(TypeRuleError):
        typed("a", "int").contains("x")
    with pytest.raises(TypeRuleError):
        avg(typed("a", "int"))
    assert avg(typed("a", "int"), integers=IntegerAverage.EXACT_DECIMAL).kind == "decimal(38,6)"
    for bad in (lambda: sum_(typed("a", "string")), lambda: min_(typed("a", "boolean"))):
        with pytest.raises(TypeRuleError):
            bad()
    assert cast_type("decimal(9, 2)") == "decimal(9,2)" and cast_type("nvarchar(max)") == "string"
    for bad in ("table", "decimal(40,2)", "decimal(5,6)", "int) or (1=1"):
        with pytest.raises(ArgumentError):
            cast_type(bad)


def test_windows():
    with pytest.raises(QueryShapeError):
        Window("a", frame=Frame())
    with pytest.raises(QueryShapeError):
        Frame(FrameUnit.RANGE, Bound.preceding(1))
    with pytest.raises(QueryShapeError):
        Frame(FrameUnit.ROWS, CURRENT_ROW, Bound.preceding(1))
    with pytest.raises(QueryShapeError):
        Frame(FrameUnit.ROWS, UNBOUNDED_FOLLOWING, UNBOUNDED_FOLLOWING)
    with pytest.raises(ArgumentError):
        Bound.preceding(0)
    with pytest.raises(QueryShapeError):
        rank(Window("a"))
    with pytest.raises(QueryShapeError):
        rank(Window("a", ["b"], Frame()))
    with pytest.raises(ArgumentError):
        ntile(0, Window("a", ["b"]))
    with pytest.raises(ArgumentError):
        lag("a", Window("a", ["b"]), -1)
    with pytest.raises(QueryShapeError):
        Aggregate("count", Col("a"), distinct=True).over(Window("a"))


def test_query_shapes():
    q = from_("orders")
    with pytest.raises(QueryShapeError):
        q.paged(0, 5).validate()
    with pytest.raises(QueryShapeError):
        q.order_by("a").paged(0, 5).top(3)
    with pytest.raises(ArgumentError):
        q.top(0)
    with pytest.raises(ArgumentError):
        q.order_by("a").paged(-1, 5)
    with pytest.raises(QueryShapeError):
        q.join(JoinKind.INNER, "x")
    with pytest.raises(QueryShapeError):
        q.join(JoinKind.CROSS, "x", None, Col("a").eq(1))
    with pytest.raises(QueryShapeError):
        q.inner_join("orders", None, Col("a").eq(1)).validate()
    with pytest.raises(QueryShapeError):
        q.group_by("a").validate()
    with pytest.raises(CapabilityError):
        q.with_hint("nolock")
    with pytest.raises(QueryShapeError):
        from_(q, None)
    with pytest.raises(QueryShapeError):
        from_(q.select(count_all()), "d").source.query.require_named_columns("a derived table")
    with pytest.raises(QueryShapeError):
        q.select("a.x", "b.X").require_named_columns("a derived table")
    with pytest.raises(QueryShapeError):
        q.select("a").union(q.select("a", "b")).validate()
    with pytest.raises(QueryShapeError):
        q.select("a").order_by("a").union(q.select("a")).validate()
    with pytest.raises(QueryShapeError):
        Cte("t", q, (), q)
    with pytest.raises(QueryShapeError):
        q.with_cte("t", q).with_cte("T", q)
    with pytest.raises(ArgumentError):
        q.with_recursive_cte("t", q, q, ["a"], 40000)
    with pytest.raises(QueryShapeError):
        q.count_distinct([])
    assert q.select("a") is not q and not q.projection


def test_names():
    assert name_parts("[a.b].c") == ("a.b", "c") and name_parts("`x y`") == ("x y",)
    for bad in ("", "a..b", "a.b.c.d.e", "[a"):
        with pytest.raises(ArgumentError):
            name_parts(bad)


@pytest.mark.parametrize("text", ["'", "'; DROP TABLE x --", "\\'", "\"", "é'😀", ":p", "*/ x /*"])
def test_hostile_text_stays_a_value(text):
    literal = sql_literal(text)
    assert literal.startswith("unhex('") and set(literal[7:-10]) <= set("0123456789abcdef")
    assert sql_literal(True) == "TRUE" and sql_literal(None) == "NULL"


def test_patterns():
    import re

    for pattern, yes, no in [("[PS]%", "SMALL", "LARGE"), ("a_[^x]", "abc", "abx"), ("[]%", "[]z", "x"), ("50\\%[0-9]", "50\\x7", "50%7")]:
        regex = like_regex(pattern).replace(r"\z", r"\Z")
        assert re.search(regex, yes) and not re.search(regex, no)


def test_tables():
    t = TableDef(
        "s.item",
        (ColumnDef("id", "int", False, identity=True), ColumnDef("code", "string"), ColumnDef("total", "double", computed=True)),
        ("id",),
        (UniqueKey("u", ("code",)), UniqueKey("f", ("total",), filtered=True)),
        soft_delete=SoftDelete("code"),
    )
    assert t.is_unique(("code", "total")) and not t.is_unique(("total",)) and t.label == "item"
    assert t.for_table(schema="other").name == "other.item"
    with pytest.raises(ReadOnlyColumnError):
        Insert(t).values(id=1)
    with pytest.raises(ReadOnlyColumnError):
        Update(t).set(total=1)
    with pytest.raises(QueryShapeError):
        TableDef("x", (ColumnDef("a", "int"), ColumnDef("A", "int")))
    with pytest.raises(QueryShapeError):
        table_of("x", {"a": "int"}).read_conditions(__import__("tablecraft").ScopeSelection(Trashed.ONLY))
    with pytest.raises(QueryShapeError):
        Projection("p", ())


def test_relations():
    t = table_of("t", {"id": "int", "up": "int"}, "id")
    one, many = belongs_to("parent", t, "up", "id"), has_many("children", t, "id", "up")
    assert [r.name for r in merge_includes([one], [one.then(many)])] == ["parent"]
    for bad in (lambda: merge_includes([one], [belongs_to("parent", t, "id", "id")]), lambda: many.joined(), lambda: many.take_per_parent(2), lambda: one.select("id")):
        with pytest.raises(Exception, match="twice|to-many|order|whole"):
            bad()


def test_cursor_tokens():
    c = Cursor("o", "f", (1, "x", None, dt.datetime(2024, 1, 2, 3), True, 1.5))
    assert Cursor.parse(c.token()) == c
    with pytest.raises(CursorError):
        Cursor.parse("nonsense")


def test_schema_tools():
    a = table_of("t", {"id": "int", "n": "string"}, "id", unique_keys=(UniqueKey("u", ("n",)),))
    b = table_of("t", {"id": "bigint", "m": "string"}, "id")
    snapshot = SchemaSnapshot((a,))
    again = SchemaSnapshot.from_json(snapshot.to_json())
    assert again.to_json() == snapshot.to_json() and fingerprint(again.table("T")) == fingerprint(a) != fingerprint(b)
    kinds = {f.kind.name: f.kind.breaking for f in diff_schemas(snapshot, SchemaSnapshot((b, table_of("new", {"x": "int"}))))}
    assert kinds == {"TYPE_CHANGED": True, "COLUMN_MISSING": True, "COLUMN_ADDED": False, "UNIQUE_KEY_MISSING": True, "TABLE_ADDED": False}
    assert SchemaSnapshot((a, table_of("T", {"x": "int"}))).ambiguous_names() == ["T", "t"]


def test_observation_and_reports():
    q = from_("t").where(Col("a").eq("secret") & Col("b").eq(7))
    assert "secret" not in redact(q.text()) and "7" not in redact(q.text())
    r = Recorder()
    r({"kind": "query", "text": q.text(), "seconds": 0.1, "error": None})
    assert "secret" not in r.describe()
    report = parse_report("-- name: trend\n-- param: since date\n-- column: n int\nSELECT 1 AS n WHERE :since IS NOT NULL;")
    assert report.params == (("since", "date"),) and report.columns == (("n", "int"),)
    with pytest.raises(ArgumentError):
        parse_report("SELECT 1")

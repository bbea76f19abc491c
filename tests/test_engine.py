"""Queries, entities, relations and writes over small frames."""

import datetime as dt
import itertools

import pytest

from tablecraft import (
    ABSENT,
    DEFAULT,
    AffectedRowsError,
    CardinalityError,  # noqa: F401
    Col,
    ConcurrencyError,
    CursorError,
    Cycles,
    Engine,
    Hierarchy,
    Lit,
    MultipleRowsError,
    NamedScope,
    Nulls,
    Output,
    QueryShapeError,
    RecursionLimitError,
    Recorder,
    Repository,
    ResultTypeError,
    RowNotFoundError,
    SoftDelete,
    TableDef,
    Timestamps,
    UniqueKey,
    UniqueKeyError,
    UnknownMorphError,
    UnknownNameError,
    UnsafeWriteError,
    VersionedStore,
    after,
    belongs_to,
    belongs_to_many,
    count_all,
    entities,
    from_,
    has_many,
    has_one,
    morph_to,
    not_,
    observed,
    raw,
    read_tables,
    table_of,
    verify,
)
from tablecraft.operators import CycleWrite, Delete, Graph, Insert, Projection, ProjectionColumn, Update, Upsert
from tablecraft.sources.tables import ColumnDef
from tablecraft.streaming.watch import Watch, WatchStrategy, stream_windows, watch_folder

NOW = dt.datetime(2024, 5, 6, 7, 8, 9)
ITEM = TableDef(
    "item",
    (
        ColumnDef("id", "int", False, identity=True),
        ColumnDef("code", "string"),
        ColumnDef("owner", "int"),
        ColumnDef("stock", "int", default=Lit(5)),
        ColumnDef("version", "bigint", row_version=True),
        ColumnDef("deleted_at", "timestamp_ntz"),
        ColumnDef("updated_at", "timestamp_ntz"),
    ),
    ("id",),
    (UniqueKey("code", ("code",)),),
    soft_delete=SoftDelete("deleted_at"),
    timestamps=Timestamps(updated="updated_at"),
)
OWNER = table_of("owner", {"id": "int", "name": "string"}, "id")
TAG = table_of("tag", {"id": "int", "label": "string"}, "id")
ITEM_TAG = table_of("item_tag", {"item_id": "int", "tag_id": "int", "note": "string"})
ITEMS = has_many("items", ITEM, "id", "owner")
TAGS = belongs_to_many("tags", TAG, "id", ITEM_TAG, "item_id", "tag_id", "id")
PARENT = belongs_to("holder", OWNER, "owner", "id")


@pytest.fixture
def engine(spark):
    e = Engine(spark, fixed_now=NOW)
    rows = [(1, "a", 1, 9, 1, None, None), (2, "b", 1, 4, 1, None, None), (3, "c", None, 7, 1, NOW, None), (4, "d", 2, 0, 1, None, None)]
    e.register("item", spark.createDataFrame(rows, "id int, code string, owner int, stock int, version bigint, deleted_at timestamp_ntz, updated_at timestamp_ntz"))
    e.register("owner", spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, name string"))
    e.register("tag", spark.createDataFrame([(1, "t"), (2, "u")], "id int, label string"))
    e.register("item_tag", spark.createDataFrame([(1, 1, "n"), (1, 2, None), (2, 2, "m")], "item_id int, tag_id int, note string"))
    e.register("nulls", spark.createDataFrame([(1, None, "x"), (2, 3, None), (3, 3, "y"), (4, None, None), (5, 1, "x")], "id int, a int, b string"))
    return e


def test_nulls_and_counts(engine):
    q = from_("nulls")
    assert [r["id"] for r in q.select("id").order_by(Col("a").asc(), "id").get(engine)] == [1, 4, 5, 2, 3]
    assert [r["id"] for r in q.select("id").order_by(Col("a").asc(Nulls.LAST), "id").get(engine)] == [5, 2, 3, 1, 4]
    assert q.where(not_(Col("a").eq(3))).count(engine) == 1
    assert q.count_distinct_columns(["a"], engine) == 2 and q.count_distinct_columns(["a", "b"], engine) == 5
    assert q.sum("a", engine) == 7 and q.where(Col("id").gt(9)).sum("a", engine) is None
    assert q.max("a", engine, as_=float) == 3.0
    with pytest.raises(ResultTypeError):
        q.avg("a", engine, as_=int)
    assert q.order_by("id").value("b", engine) == "x" and q.where(Col("id").eq(9)).first(engine) is None
    with pytest.raises(RowNotFoundError):
        q.where(Col("id").eq(9)).first_or_fail(engine)
    assert q.exists(engine) and q.where(Col("id").eq(9)).doesnt_exist(engine)
    assert q.where(raw("a = :v", v=3).as_("x").expr).select("id").count(engine) == 2
    assert "Filter" in q.where(Col("a").eq(3)).compile(engine)
    with pytest.raises(UnknownNameError):
        from_("missing").get(engine)


@pytest.mark.parametrize("terms", [("a", "b", "id"), ("b", "id")])
def test_keyset_pages_are_the_ordered_rows(engine, terms):
    for ways in itertools.product((0, 1, 2, 3), repeat=len(terms) - 1):
        orders = [Col(t).desc(Nulls.LAST if w & 2 else None) if w & 1 else Col(t).asc(Nulls.LAST if w & 2 else None) for t, w in zip(terms, ways, strict=False)]
        orders.append(Col("id").asc())
        q = from_("nulls").order_by(*orders)
        want = [r["id"] for r in q.get(engine)]
        rows = {r["id"]: r for r in q.get(engine)}
        at = want[1]
        rest = q.where(after(orders, [rows[at][t] for t in terms])).get(engine)
        assert [r["id"] for r in rest] == want[2:], ways


def test_pages_and_cursors(engine):
    q = entities(engine, ITEM).with_trashed()
    page = q.order_by("owner").page(2, 1, total=True)
    assert ([r["id"] for r in page.rows], page.has_more, page.total) == ([1, 2], True, 4)
    first = q.order_by("owner").cursor_page(2)
    second = q.order_by("owner").cursor_page(2, after_=first.next)
    back = q.order_by("owner").cursor_page(2, before=second.previous)
    assert [r["id"] for r in first.rows + second.rows] == [3, 1, 2, 4] and not second.has_more
    assert [r["id"] for r in back.rows] == [3, 1]
    with pytest.raises(CursorError):
        q.order_by("code").cursor_page(2, after_=first.next)
    with pytest.raises(CursorError):
        q.where(ITEM["id"].gt(0)).order_by("owner").cursor_page(2, after_=first.next)
    assert [r["id"] for r in q.order_by("code").lazy(3)] == [1, 2, 3, 4]
    named = Projection("codes", (ProjectionColumn("code", ITEM["code"], True),), lambda r: r["code"].upper())
    p = q.select(named).order_by(ITEM["code"])
    assert p.get() == ["A", "B", "C", "D"] and p.page(3).has_more and list(p.lazy(3)) == p.get() and p.count() == 4
    with pytest.raises(QueryShapeError):
        q.select(named).page()
    with pytest.raises(MultipleRowsError):
        q.single()
    with pytest.raises(QueryShapeError):
        entities(engine, ITEM_TAG).page()


def test_scopes(engine):
    assert entities(engine, ITEM).count() == 3 and entities(engine, ITEM).only_trashed().count() == 1
    tenant = TableDef("item", ITEM.columns, ITEM.primary_key, scopes=(NamedScope("tenant", lambda t: t["owner"].eq(1)),))
    assert entities(engine, tenant).count() == 2 and entities(engine, tenant).without_scope("tenant").count() == 4
    with pytest.raises(UnknownNameError):
        entities(engine, tenant).without_scope("other").count()


def test_relations(engine, spark):
    q = entities(engine, OWNER).order_by("id")
    rows = q.include(ITEMS.ordered(ITEM["stock"].asc()).then(TAGS.ordered(TAG["id"].asc()))).get()
    assert [[i["id"] for i in r["items"]] for r in rows] == [[2, 1], [4], []]
    assert [t["row"]["label"] for t in rows[0]["items"][1]["tags"]] == ["t", "u"]
    assert [r["id"] for r in q.where_has(ITEMS).get()] == [1, 2] and [r["id"] for r in q.where_doesnt_have(ITEMS).get()] == [3]
    assert [r["id"] for r in q.where_has(ITEMS.then(TAGS)).get()] == [1]
    assert [r["items_count"] for r in q.with_count(ITEMS).get()] == [2, 1, 0]
    assert [r["low"] for r in q.with_min(ITEMS, ITEM["stock"], "low").get()] == [4, 0, None]
    cut = q.include(ITEMS.max_loaded_rows(2)).get()
    assert sum(len(r["items"]) for r in cut) == 2 and all(r["items_truncated"] for r in cut)
    with pytest.raises(Exception, match="to-one"):
        q.include(has_one("item", ITEM, "id", "owner")).get()
    assert [r["holder"] and r["holder"]["name"] for r in entities(engine, ITEM).with_trashed().include(PARENT).order_by("id").get()] == ["x", "x", None, "y"]
    note = table_of("note", {"id": "int", "kind": "string", "ref": "int"}, "id")
    engine.register("note", spark.createDataFrame([(1, "owner", 1), (2, "item", 2), (3, None, None), (4, "odd", 1)], "id int, kind string, ref int"))
    subject = morph_to("subject", "kind", "ref", {"owner": (OWNER, "id"), "item": (ITEM, "id")})
    with pytest.raises(UnknownMorphError):
        entities(engine, note).include(subject).get()
    fine = entities(engine, note).where(note["id"].lt(4)).include(subject).order_by("id").get()
    assert [(r["subject_owner"] is not None, r["subject_item"] is not None) for r in fine] == [(True, False), (False, True), (False, False)]


def test_repository(engine):
    repo = Repository(engine, ITEM)
    row = repo.insert({"code": "e", "owner": 3, "stock": DEFAULT})
    assert (row["id"], row["stock"], row["version"], row["updated_at"]) == (5, 5, 1, NOW)
    with pytest.raises(UniqueKeyError):
        repo.insert({"code": "e"})
    assert repo.create_or_first(ITEM["code"].eq("e"), lambda: {"code": "e"})["id"] == 5
    assert [r["id"] for r in repo.create_many([{"code": "f"}, {"code": "g"}], return_rows=True).rows] == [6, 7]
    assert repo.update_patch(5, {"stock": 8, "owner": ABSENT}, expected_version=1).affected == 1
    assert repo.get_by_id(5)["owner"] == 3 and repo.get_by_id(5)["version"] == 2
    with pytest.raises(ConcurrencyError):
        repo.update_patch(5, {"stock": 1}, expected_version=1)
    with pytest.raises(AffectedRowsError):
        repo.update_where(ITEM["owner"].eq(1), {"stock": 0}, expect_affected=5)
    assert repo.get_by_id(1)["stock"] == 9
    assert repo.delete(1).affected == 1 and repo.find_by_id(1) is None and repo.trashed(1)
    assert repo.restore(1).affected == 1 and repo.get_by_id(1)["stock"] == 9
    assert repo.force_delete(7).affected == 1
    with pytest.raises(AffectedRowsError):
        repo.decrement_quantities("id", "stock", [(1, 5), (1, 5)])
    assert repo.decrement_quantities("id", "stock", [(1, 5), (2, 1)]).affected == 2
    assert (repo.get_by_id(1)["stock"], repo.get_by_id(2)["stock"]) == (4, 3)
    assert repo.update_many([(1, {"stock": 1}), (2, {"code": "bb"})]).affected == 2
    assert repo.upsert({"code": "zz"}, {"owner": 1}).rows[0]["code"] == "zz" and repo.upsert({"code": "zz"}, update={"stock": 2}).rows[0]["stock"] == 2
    assert repo.get_or_create("code", {"code": "c"}, restore_existing=True)["id"] == 3
    assert repo.update_or_create(ITEM["code"].eq("bb"), lambda r: {"code": "bb", "stock": 77})["stock"] == 77
    with pytest.raises(RowNotFoundError):
        repo.get_by_id(99)


def test_relation_writes(engine):
    owners, items = Repository(engine, OWNER), Repository(engine, ITEM)
    created = owners.related({"id": 3}, ITEMS).create({"code": "n"})
    assert created["owner"] == 3
    assert items.related(items.get_by_id(4), PARENT).dissociate().affected == 1 and items.get_by_id(4)["owner"] is None
    tags = items.related(items.get_by_id(1), TAGS)
    assert tags.sync([{"id": 2}]) == (0, 1) and tags.detach({"id": 2}).affected == 1
    tags.attach({"id": 1}, {"note": "again"})
    assert engine.table("item_tag").where("item_id = 1").collect()[0]["note"] == "again"
    child = Graph(items, {"code": "kid"})
    row = owners.create_graph(Graph(owners, {"id": 9, "name": "new"}, children=((ITEMS, child),)), CycleWrite.REFUSE)
    assert items.first_where(ITEM["code"].eq("kid"))["owner"] == row["id"] == 9


def test_statements(engine):
    with pytest.raises(UnsafeWriteError):
        engine.execute(Delete("item"))
    with pytest.raises(UnsafeWriteError):
        engine.execute(Update("item").set(stock=1))
    with pytest.raises(QueryShapeError):
        engine.execute(Delete("item").all_rows().where(Col("id").eq(1)))
    out = engine.execute(Update("item").set(stock=Col("stock") + 1).where(Col("owner").eq(1)).returning(Output.of(["id", "stock"], ["stock"])))
    assert sorted((r["id"], r["deleted_stock"], r["inserted_stock"]) for r in out.rows) == [(1, 9, 10), (2, 4, 5)]
    assert engine.execute(Delete("item").where(Col("owner").gt(1))).affected == 1
    assert engine.table("item").count() == 3  # a null owner is not greater
    with pytest.raises(QueryShapeError):
        engine.execute(Upsert("item", {"code": "q"}, {"code": "other"}))
    assert engine.execute(Insert("tag").values(id=5, label="v'; --")).affected == 1
    assert engine.table("tag").where("id = 5").collect()[0]["label"] == "v'; --"


def test_store_and_transactions(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    store.commit({"owner": spark.createDataFrame([(1, "x")], "id int, name string"), "tag": spark.createDataFrame([(1, "t")], "id int, label string")})
    engine = Engine(spark, store=store)
    heard = []
    engine.hub.listen(["owner"], heard.append)
    with pytest.raises(RuntimeError), engine.transaction():
        engine.execute(Insert("owner").values(id=2, name="y"))
        assert engine.table("owner").count() == 2
        raise RuntimeError
    assert engine.table("owner").count() == 1 and not heard
    with engine.transaction():
        engine.execute(Insert("owner").values(id=2, name="y"))
        with pytest.raises(RuntimeError), engine.transaction():
            engine.execute(Delete("owner").all_rows())
            raise RuntimeError
        engine.execute(Insert("tag").values(id=2, label="u"))
    assert store.version() == 2 and engine.table("owner").count() == 2 and heard == ["owner"]
    with engine.snapshot():
        store.commit({"owner": engine.table("owner").limit(0)})
        assert engine.table("owner").count() == 2
    assert engine.table("owner").count() == 0
    with pytest.raises(ConcurrencyError):
        store.commit({"tag": engine.table("tag")}, base=1)
    assert [t.name for t in read_tables(engine, ["owner", "tag"]).tables] == ["owner", "tag"] and verify(engine, OWNER) == []


def test_watch_and_streams(engine, spark, tmp_path):
    watch = entities(engine, OWNER).order_by("id").watch()
    assert len(next(watch)) == 3
    Repository(engine, OWNER).insert({"id": 4, "name": "w"})
    assert watch.pending() and len(next(watch)) == 4
    watch.close()
    assert list(watch) == []
    polled = Watch(lambda: engine.table("tag").collect(), [], engine.hub, WatchStrategy.POLLING, 0.01)
    assert len(next(polled)) == 2
    polled.close()
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "k") for m in (1, 4, 11)], "at timestamp, key string")
    assert sorted(r["count"] for r in stream_windows(events, "at", "10 minutes", ["key"]).collect()) == [1, 2]
    events.write.parquet(f"file://{tmp_path}/events")
    seen = []
    watch_folder(spark, f"file://{tmp_path}/events", events.schema, lambda df, n: seen.append(df.count()), f"{tmp_path}/check").awaitTermination()
    assert sum(seen) == 3


def test_hierarchy(engine, spark):
    engine.register("tree", spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, None)], "id int, up int"))
    engine.register("ring", spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id int, up int"))
    tree, ring = Hierarchy("tree", "id", "up"), Hierarchy("ring", "id", "up")
    assert sorted((r["Key"], r["Depth"]) for r in tree.descendants(engine).collect()) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 0)]
    assert tree.descendants(engine, max_depth=1).count() == 4
    assert sorted(r["Key"] for r in ring.descendants(engine, root=1, cycles=Cycles.SKIP_VISITED).collect()) == [1, 2, 3]
    with pytest.raises(RecursionLimitError):
        ring.checked(engine, root=1, max_recursion=20)
    step = from_("ring", "r").inner_join("w", None, Col("r.up").eq_col("w.id")).select("r.id")
    with pytest.raises(RecursionLimitError):
        from_("w").with_recursive_cte("w", from_("ring").where(Col("id").eq(1)).select("id"), step, ["id"], 3).get(engine)


def test_hierarchy_of_more_rows_than_spark_allows(engine, spark):
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    engine.register("wide", spark.range(1, 41).selectExpr("CAST(id AS INT) AS id", "CAST(nullif(id DIV 3, 0) AS INT) AS up"))
    spark.conf.set(name, "10")
    try:
        assert Hierarchy("wide", "id", "up").descendants(engine).count() == 40
        assert spark.conf.get(name) == "10"
    finally:
        spark.conf.set(name, before)


def test_observer(engine):
    recorder = Recorder()
    observed(engine, recorder)
    engine.query(from_("item").where(Col("code").eq("hidden")).select(count_all().as_("n")))
    with pytest.raises(UnknownNameError):
        engine.query(from_("nowhere"))
    assert len(recorder.events) == 2 and len(recorder.failures) == 1 and "hidden" not in recorder.describe()
    engine.procedure("twice", lambda e, n: 2 * n)
    assert engine.call("twice", 4) == 8

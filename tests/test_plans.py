import pytest
from pyspark.sql import functions as F

from tabweave.plans import ddl
from tabweave.plans.errors import InvalidArgument, InvalidModel, NoRows, UnknownColumn, UnsafeMutation
from tabweave.plans.expr import And, Not, Or, Truth, column_for
from tabweave.plans.model import Field, Model, Registry, parse_tag
from tabweave.plans.named import Declared, Mode, NamedQueries, expand, is_query, parameters, parse_blocks
from tabweave.plans.query import Catalog
from tabweave.operators import mutate

AUDIT = (("created_at", "time", "default=current_timestamp()"), ("deleted_at", "time?"))
USERS = Model.of("app.users", ("id", "int64", "pk;auto"), ("tenant_id", "int64", "index=idx_users_tenant"), ("email", "string", "size=320;unique=uix_users_email"), ("status", "string", "size=32;default='active'"), embed=AUDIT)
T = Model.of("t", ("id", "int64", "pk"), ("name", "string"), ("n", "int32?"))


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 7)], "id long, name string, n int")


@pytest.fixture
def q(spark, table):
    return Catalog(spark, Registry(T), lambda _: table).query("t")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_model_flattens_and_maps_types():
    assert USERS.columns == ["created_at", "deleted_at", "id", "tenant_id", "email", "status"]
    assert [f.simpleString() for f in USERS.schema()][:3] == ["created_at:timestamp", "deleted_at:timestamp", "id:bigint"]
    assert USERS.schema()["deleted_at"].nullable and not USERS.schema()["id"].nullable
    assert USERS.auto.name == "id" and USERS.indexes() == {"idx_users_tenant": (False, ["tenant_id"]), "uix_users_email": (True, ["email"])}


@pytest.mark.parametrize("column", [
    ("x", "int64?", "pk"), ("x", "int64", "auto"), ("x", "uint64", "pk;auto"), ("x", "int64", "pk;default=1"), ("x", "int64", "null;notnull"), ("x", "string", "size=0"), ("x", "float64", "precision=3;scale=4"),
    ("x", "string", "on_delete=CASCADE"), ("x", "string", "references=t(id);on_delete=SET NULL"), ("x", "string", "colour=red"), ("x", "string", "pk=yes"), ("1x", "string", ""), ("x", "uuid", ""), ("x", "string", "index=a b"),
])
def test_bad_fields(column):
    with pytest.raises(InvalidModel):
        Field.parse(*column)


def test_tags():
    assert parse_tag("pk; size = 3 ;;index=a") == {"pk": "true", "size": "3", "index": "a"}
    for bad in ("pk;pk", "=x"):
        with pytest.raises(InvalidModel):
            parse_tag(bad)


def test_registry_rules():
    with pytest.raises(InvalidModel):
        Registry(T, T)
    with pytest.raises(InvalidModel):
        Registry(Model.of("a", ("id", "int64", "pk;index=i")), Model.of("b", ("id", "int64", "pk;index=i")))
    with pytest.raises(InvalidModel):
        Model.of("a", ("id", "int64"))


def test_abilities_by_kind():
    c = T.c
    assert not hasattr(c.id, "like") and hasattr(c.name, "like") and hasattr(c.id, "add") and not hasattr(c.name, "add")
    assert hasattr(c.n, "is_null") and not hasattr(c.id, "is_null") and not hasattr(column_for("t", "b", "bool"), "gt")
    with pytest.raises(InvalidArgument):
        c.id.eq(None)


def test_truth():
    c = T.c.id
    assert And().truth() is Truth.ALWAYS and Or().truth() is Truth.NEVER and c.in_().truth() is Truth.NEVER and c.not_in().truth() is Truth.ALWAYS
    assert Not(c.in_()).truth() is Truth.ALWAYS and And(c.eq(1), c.in_()).truth() is Truth.NEVER and Or(c.eq(1), c.not_in()).truth() is Truth.ALWAYS
    assert Or(c.eq(1), c.ne(1)).truth() is Truth.DEPENDS


def test_predicates(q):
    c = T.c
    assert ids(q.where(c.n.ne(5)).all()) == [3] and ids(q.where(c.n.not_in()).all()) == [1, 2, 3] and ids(q.where(c.n.in_()).all()) == []
    assert ids(q.where(Or(c.n.is_null(), c.name.like("c%"))).all()) == [2, 3] and ids(q.where(~c.id.between(2, 1)).all()) == [1, 2, 3]
    assert ids(q.where(column_for("", "id", "integer").eq(2)).all()) == [2]
    with pytest.raises(UnknownColumn):
        q.where(column_for("other", "id", "integer").eq(2)).all()


def test_terminals(q):
    c = T.c
    base = q.order(c.id.desc())
    assert base.limit(5).one()["id"] == 3 and base.offset(1).one()["id"] == 2 and ids(base.all()) == [1, 2, 3]
    assert q.limit(1).offset(9).count().first()["count"] == 3 and q.exists().first()["exists"] and not q.where(c.id.gt(9)).exists().first()["exists"]
    assert q.get(2).first()["name"] == "b" and q.reload(q.get(2).first())["name"] == "b"
    with pytest.raises(NoRows):
        q.where(c.id.eq(9)).one()
    with pytest.raises(InvalidArgument):
        q.limit(-1).all()
    assert [r["n"] for r in q.order(c.n.asc()).all().collect()] == [5, 7, None] and [r["n"] for r in q.order(c.n.desc("last")).all().collect()] == [7, 5, None]


def test_pushdown(spark, tmp_path, table):
    table.write.parquet(f"{tmp_path}/t.parquet")
    q = Catalog(spark, Registry(T), lambda _: spark.read.parquet(f"{tmp_path}/t.parquet")).query("t")
    plan = q.where(T.c.id.gt(1)).count()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,1)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_mutations(q):
    c = T.c
    with pytest.raises(UnsafeMutation):
        mutate.delete(q)
    with pytest.raises(UnsafeMutation):
        mutate.update(q.where(column_for("other", "x", "integer").not_in()), c.n.set(1))
    assert mutate.delete(q.allow_all()).table.count() == 0
    m = mutate.delete(q.where(c.n.gt(5)))
    assert ids(m.table) == [1, 2] and m.affected().first()["affected"] == 1
    m = mutate.update(q.where(c.n.gt(5)), c.n.sub(2), c.name.set("z"))
    assert sorted((r["id"], r["name"], r["n"]) for r in m.table.collect()) == [(1, "a", 5), (2, "b", None), (3, "z", 5)]
    for bad in ((), (c.n.set(1), c.n.add(1)), (column_for("o", "n", "integer").set(1),)):
        with pytest.raises(InvalidArgument):
            mutate.update(q.where(c.id.eq(1)), *bad)


def test_snapshots_and_transaction(spark, tmp_path, table):
    s = mutate.Snapshots(spark, f"{tmp_path}/s")
    s.commit(table)
    with pytest.raises(RuntimeError):
        mutate.transaction({"t": s}, lambda ts: (_ for _ in ()).throw(RuntimeError("no")))

    def silent(_):
        raise mutate.SilentRollback

    assert mutate.transaction({"t": s}, silent) is False and s.read().count() == 3
    assert mutate.transaction({"t": s}, lambda ts: {"t": ts["t"].where("id = 1")}) and s.read().count() == 1
    number = s._numbers()[0]
    with pytest.raises(Exception):  # a second writer with the same number
        s._create(s._at(f"POINTER-{number:016d}"), "other")
    assert s.read().count() == 1


def test_transaction_is_all_or_nothing(spark, tmp_path, table, monkeypatch):
    """A failure between two tables' pointers, and one before the record, leave both tables as they were; the next commit works."""
    a, b = mutate.Snapshots(spark, f"{tmp_path}/a"), mutate.Snapshots(spark, f"{tmp_path}/b")
    for s in (a, b):
        s.commit(table)
    change = lambda ts: {n: t.where("id = 1") for n, t in ts.items()}

    def fail(*_):
        raise OSError("lost")

    for victim, name in ((b, "point_to"), (a, "_create")):
        create = mutate.Snapshots._create
        with monkeypatch.context() as m:
            m.setattr(victim, name, fail if name == "point_to" else lambda at, text: fail() if "COMMIT" in at.toString() else create(a, at, text))
            with pytest.raises(OSError):
                mutate.transaction({"a": a, "b": b}, change)
        assert (a.read().count(), b.read().count()) == (3, 3)
    assert mutate.transaction({"a": a, "b": b}, change) and (a.read().count(), b.read().count()) == (1, 1)
    b.commit(table)
    assert (a.read().count(), b.read().count()) == (1, 3)


def test_upsert(spark, table):
    new = spark.createDataFrame([(3, "x", 9), (4, "y", 1)], table.schema)
    assert sorted(map(tuple, mutate.upsert(table, new, ["id"], ["n"]).table.collect()), key=str) == [(1, "a", 5), (2, "b", None), (3, "c", 9), (4, "y", 1)]


def test_named_parsing():
    sql = "SELECT ':ignored', value::text FROM t /* :ignored */ WHERE id = :id -- :ignored\n AND name = :name"
    assert parameters(sql) == ["id", "name"]
    for bad in ("SELECT 'x", "SELECT /* x"):
        with pytest.raises(InvalidModel):
            parameters(bad)
    assert parse_blocks("-- note\n\n-- name: A\nSELECT 1\n-- name: B\n SELECT 2 ") == {"A": "SELECT 1", "B": "SELECT 2"}
    for bad in ("SELECT 1", "-- name: A\n", "-- name: A\nSELECT 1\n-- name: A\nSELECT 2"):
        with pytest.raises(InvalidModel):
            parse_blocks(bad)
    assert is_query(" with x") and is_query("UPDATE t SET a = 1 RETURNING a") and not is_query("UPDATE t\nRETURNING a") and not is_query("-- c\nSELECT 1")
    assert expand("a IN (:x) AND b = :y AND ':x'", {"x": [1, 2], "y": 3}) == ("a IN (:x_0, :x_1) AND b = :y AND ':x'", {"x_0": 1, "x_1": 2, "y": 3})


def test_named_queries(spark, tmp_path):
    (tmp_path / "q.sql").write_text("-- name: Some\nSELECT id FROM range(10) WHERE id IN (:ids)\n-- name: None\nSELECT id FROM range(0)")
    declared = {"Some": Declared(Mode.MANY, ("ids",)), "None": Declared(Mode.ONE)}
    named = NamedQueries.from_file(spark, str(tmp_path / "q.sql"), declared)
    assert ids(named.run("Some", ids=[1, 4, 40])) == [1, 4]
    with pytest.raises(NoRows):
        named.one("None")
    for bad in ({"Some": declared["Some"]}, declared | {"Some": Declared(Mode.MANY, ("other",))}, declared | {"None": Declared(Mode.ROWS_AFFECTED)}):
        with pytest.raises(InvalidModel):
            NamedQueries(spark, (tmp_path / "q.sql").read_text(), bad)
    with pytest.raises(InvalidArgument):
        named.run("Some", ids=[])
    with pytest.raises(InvalidArgument):
        named.run("Some")


def test_ddl(spark, tmp_path):
    text = ddl.script(Registry(T, USERS))
    assert text == ddl.script(Registry(USERS, T)) and text.index("`app`.`users`") < text.index("`t`") and "VARCHAR(320) NOT NULL" in text
    spark.sql(ddl.create_table(Model.of("made", ("id", "int64", "pk"), ("s", "string", "size=3;default='a'"))))
    spark.sql("INSERT INTO made (id) VALUES (1)")
    assert spark.table("made").first() == (1, "a")
    spark.sql("DROP TABLE made")
    ddl.write_atomic(str(tmp_path / "x.sql"), text)
    assert (tmp_path / "x.sql").read_text() == text and len(list(tmp_path.iterdir())) == 1


def test_create_auto_and_default(spark):
    m = Model.of("a", ("id", "int32", "pk;auto"), ("s", "string", "default='d'"))
    t = spark.createDataFrame([(4, "x")], "id int, s string")
    assert mutate.create(m, t, {}, m.c.s.use_default()).touched.first() == (5, "d")
    with pytest.raises(InvalidArgument):
        mutate.create(m, t, {"s": "x"}, next_id=lambda: 1 << 40)
    assert F.lit(1) is not None

"""Storage, catalogue, references, tags, versions, reflection."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entiquery import Bool, Char, Component, Double, Entity, Float, Int8, String, Struct, TableView, UInt8, UInt32, UInt64, Union, World, anonymous
from entiquery.errors import PlanError, UnsupportedTypeModifier
from entiquery.functions.arithmetic import divide, f32, wrap
from entiquery.sources import parquet as src
from entiquery.sources import tables
from entiquery.world import block_of, owner, slot_of


class Field(Component):
    field1: UInt32
    field2: Double


class Other(Component):
    field: UInt32


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def filled(spark, n=524288):
    world = World(spark)
    world.create(Field, spark.range(n).select("id", F.col("id").alias("field1"), F.col("id").alias("field2")))
    return world


def test_table_life(spark):
    world = filled(spark)
    last = 524287
    assert world.size(Field) == 524288 and world.get(Field, last) == {"id": last, "field1": last, "field2": float(last)}
    world.disable(Field, last)
    assert not world.is_enabled(Field, last) and world.get(Field, last)["field1"] == last and world.rows(Field).count() == last and world.size(Field) == 524288
    world.enable(Field, [last, last, 10**9])
    assert world.is_enabled(Field, last) and world.size(Field) == 524288 and world.get(Field, 10**9) is None
    world.remove(Field, spark.range(0, 524288, 2))
    assert world.size(Field) == 262144 and world.get(Field, 2) is None
    world.clear_table(Field)
    assert world.size(Field) == 0


def test_slices(spark):
    world = filled(spark, 4096)
    for offset in (0, 1):
        assert ids(world.slice(Field, 1, offset, 2)) == [i for i in range(4096) if i // 256 % 2 == offset]
    assert {r["block"]: r["rows"] for r in world.blocks(Field).collect()} == dict.fromkeys(range(16), 256)


def test_create_is_upsert(spark):
    world = World(spark)
    world.create(Field)
    with pytest.raises(PlanError):
        world.create(Field)
    world.put(Field, {1: Field(field1=1, field2=1.0), 2: Field(field1=2)})
    world.disable(Field, [1])
    world.put(Field, {1: Field(field1=7, field2=7.0)})
    assert world.size(Field) == 2 and world.get(Field, 1) == {"id": 1, "field1": 7, "field2": 7.0} and world.is_enabled(Field, 1)
    rows = spark.createDataFrame([(5, 1, 0.0, 2), (5, 2, 0.0, 1), (None, 3, 0.0, 1)], "id long, field1 long, field2 double, at int")
    world.put(Field, rows.drop("at"))
    assert world.get(Field, 5)["field1"] == 2  # the largest row
    world.put(Field, rows, order="at")
    assert world.get(Field, 5)["field1"] == 1 and world.validate() == []


def test_catalogue(spark):
    world = World(spark)
    with pytest.raises(KeyError):
        world.table(Field)
    world.ensure(Field)
    world.ensure(Field)
    world.put(Other, {1: Other(field=1)})
    assert {r["name"]: r["size"] for r in world.metadata().collect()} == {"Field": 0, "Other": 1}
    world.drop(Field)
    world.drop(Field)
    assert not world.has_table(Field)
    world.clear()
    assert world.metadata().count() == 0


def test_clear_entity(spark):
    world = filled(spark, 4)
    world.put(Other, {2: Other(field=5)})
    world.add_tag("t", [2, 3])
    world.add_ref("r", [(2, 3), (1, 2), (0, 1)])
    world.clear_entity([2])
    assert ids(world.rows(Field)) == [0, 1, 3] and ids(world.rows(Other)) == [] and ids(world.tag("t")) == [2, 3] and world.has_ref("r", 2, 3)
    world.clear_entity([2], purge=True)
    assert ids(world.tag("t")) == [3] and world.get_ref("r", 2) is None and world.get_ref("r", 1) is None and world.get_ref("r", 0) == 1


def test_tags(spark):
    world = World(spark)
    assert not world.has_tag("selected", 0)
    world.add_tag("selected", [0, 2, 2])
    assert [world.has_tag("selected", i) for i in range(3)] == [True, False, True] and world.tag("selected").count() == 2
    world.remove_tag("selected", [0, 7])
    assert ids(world.tag("selected")) == [2]


def test_set_algebra(spark):
    world = World(spark)
    world.add_tag("all", spark.range(1_000_000))
    world.add_tag("even", spark.range(0, 1_000_000, 2))
    assert world.tag_union("all", "even").count() == 1_000_000
    assert world.tag_difference("all", "even").count() == 500_000
    assert world.tag_intersection("even", "all").count() == 500_000
    assert world.tag_difference("even", "all").count() == 0


def test_references(spark):
    world = World(spark)
    with pytest.raises(KeyError):
        world.ref("r")
    world.add_ref("r", [(0, 1), (1, 2)])
    assert world.has_ref("r", 0, 1)
    world.add_ref("r", [(0, 2)])
    assert world.has_ref("r", 0, 2) and not world.has_ref("r", 0, 1) and world.ref("r").count() == 2
    world.disable_ref("r", [0])
    assert world.ref_rows("r").count() == 1 and world.get_ref("r", 0) == 2
    world.remove_ref("r", [0])
    assert world.get_ref("r", 0) is None


def test_globals(spark):
    world = World(spark)
    assert world.global_(Field) is None
    assert world.ensure_global(Field) == {"field1": None, "field2": None}
    world.set_global(Field(field1=3, field2=1.5))
    assert world.ensure_global(Field) == {"field1": 3, "field2": 1.5}
    world.drop_global(Field)
    assert world.global_(Field) is None


def test_versions(spark):
    world = filled(spark, 4)
    reader = world.snapshot()
    draft = world.begin()
    draft.remove(Field, [0])
    assert world.size(Field) == 4
    world.commit(draft)
    assert world.size(Field) == 3 and reader.size(Field) == 4
    draft = world.begin()
    draft.clear()
    world.rollback()
    assert world.size(Field) == 3
    with pytest.raises(PlanError):
        world.rollback()


def test_readers_see_one_version_under_many_writers(spark):
    import threading

    world = World(spark)
    world.create(Field, spark.range(8).select("id", F.lit(0).alias("field1"), F.lit(0.0).alias("field2")))
    seen = []

    def write(n):
        draft = world.begin()
        rows = spark.range(8).select("id", F.lit(n).alias("field1"), F.lit(0.0).alias("field2"))
        draft.put(Field, rows)
        draft.replace_table(Field, draft._conform(Field, rows))
        world.commit(draft)

    def read():
        for _ in range(3):
            seen.append({r["field1"] for r in world.snapshot().rows(Field).collect()})

    threads = [threading.Thread(target=write, args=(i,)) for i in range(1, 9)] + [threading.Thread(target=read) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(len(s) == 1 for s in seen) and len({r["field1"] for r in world.rows(Field).collect()}) == 1


class Inner(Struct):
    q: Float
    t: Float


class Either(Union):
    a: Float
    b: Float


class Everything(Component):
    x: Float
    small: Int8
    flag: Bool
    letter: Char
    name: String
    byte: UInt8
    wide: UInt64
    hoisted: anonymous(Inner)
    nested: Inner
    either: Either


def test_reflection(spark):
    types = {f.name: f.dataType for f in Everything.schema()}
    assert list(types)[:9] == ["x", "small", "flag", "letter", "name", "byte", "wide", "q", "t"]
    assert types["x"] == T.FloatType() and types["small"] == T.ByteType() and types["byte"] == T.ShortType() and types["wide"] == T.DecimalType(20, 0)
    rows = {r["name"]: r for r in World(spark).describe(Everything)}
    assert rows["q"]["anonymous"] and rows["either"]["union"] and rows["nested.t"]["type"] == "float" and rows["byte"]["type"] == "uint8" and not rows["nested"]["union"]
    world = World(spark)
    world.put(Everything, {1: Everything(x=1.0, wide=2**64 - 1, q=4.0, nested=Inner(q=2.0, t=3.0), either=Either(a=6.0))})
    got = world.get(Everything, 1)
    assert got["wide"] == 2**64 - 1 and got["q"] == 4 and got["nested"] == {"q": 2.0, "t": 3.0} and got["either"] == {"a": 6.0, "b": None}


def test_bad_declarations():
    with pytest.raises(PlanError):

        class Bad(Component):
            id: Float

    class Pointer(Component):
        p: object

    with pytest.raises(UnsupportedTypeModifier):
        Pointer.schema()
    with pytest.raises(PlanError):
        Field(nothing=1)


def test_save_and_load(spark, tmp_path):
    world = filled(spark, 4)
    world.disable(Field, [3])
    world.add_tag("t", [1])
    world.add_ref("r", [(1, 2)])
    world.set_global(Other(field=1))
    src.save(world, str(tmp_path / "w"))
    again = src.load(spark, str(tmp_path / "w"), [Field], ["t"], ["r"], [Other])
    assert ids(again.rows(Field)) == [0, 1, 2] and again.size(Field) == 4 and again.has_tag("t", 1) and again.has_ref("r", 1, 2) and again.global_(Other) == {"field": 1}


def test_arithmetic(spark):
    row = spark.range(1).select(
        divide(F.lit(1.0), F.lit(0.0)).alias("a"), divide(F.lit(-1.0), F.lit(0.0)).alias("b"), divide(F.lit(0.0), F.lit(0.0)).alias("c"), divide(F.lit(1.0), F.lit(4.0)).alias("d"),
        (f32(0.1) * f32(3)).alias("e"), wrap(F.lit(300), 8).alias("f"), wrap(F.lit(-129), 8).alias("g"), wrap(F.lit(2**31), 32).alias("h"),
    )
    r = row.first()
    assert (r["a"], r["b"], r["d"], r["f"], r["g"], r["h"]) == (float("inf"), float("-inf"), 0.25, 44, 127, -(2**31)) and r["c"] != r["c"]
    assert row.schema["e"].dataType == T.FloatType()


def test_entity_handle(spark):
    world = World(spark)
    a, b = Entity(world, 1), Entity(world, 2)
    a.add(Field(field1=1, field2=2.0), Other(field=3)).add_tag("t").refer("r", b)
    assert a.get(Field)["field2"] == 2 and a.has_tag("t") and not b.has_tag("t") and a.head("r") == b and b.head("r") is None
    assert not a.disable(Field).is_enabled(Field) and a.enable(Field).is_enabled(Field)
    assert a.remove(Other).get(Other) is None and a.unrefer("r").head("r") is None and world.tag_size("t") == 1
    a.remove_tag("t").add_tag("u").destroy(purge=True)
    assert a.get(Field) is None and not a.has_tag("u")
    world.add_tag("t", [5])
    world.clear_tag("t")
    assert world.tag_size("t") == 0


def test_places_in_blocks(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 255, 256, 5000, -1, 2**60 + 1)], "id long").select("id", block_of(F.col("id")).alias("block"), slot_of(F.col("id")).alias("slot"))
    got = {r["id"]: (r["block"], r["slot"]) for r in rows.collect()}
    assert got == {i: (i // 256, i % 256) for i in got}
    assert rows.where(owner(F.col("block"), F.col("slot")) != F.col("id")).count() == 0


def test_table_view(spark):
    view = TableView(filled(spark, 1000), Field)
    view.disable(spark.range(256, 512)).remove([0, 600]).put({2000: Field(field1=1)})
    assert view.size() == 999 and view.rows().count() == 743 and view.get(0) is None and view.get(300)["field1"] == 300
    assert [b.count() for b in view.blocks()] == [255, 255, 232, 1]
    assert sorted(r["slot"] for r in view.block(7).collect()) == [2000 % 256]
    assert view.enable([300]).rows().count() == 744 and view.clear().size() == 0


def test_tag_complement_and_bitmaps(spark):
    world = filled(spark, 100)
    some = [0, 1, 7, 8, 32767, 32768, 10**7]
    world.set_tag("t", some)
    assert ids(world.tag_complement("t")) == [i for i in range(100) if i not in some]
    assert ids(world.tag_complement("t", [1, 2, 3])) == [2, 3]
    bitmaps = world.tag_bitmaps("t")
    assert sorted(r["bucket"] for r in bitmaps.collect()) == [0, 1, 10**7 // 32768]
    world.set_tag_bitmaps("u", bitmaps)
    assert ids(world.tag("u")) == some


def test_scratch_folders_are_shared_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: None), "set": staticmethod(lambda key, value: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(PlanError):
        tables.scratch_path(Elsewhere)
    for master in ("local", "local[*]", "local[4]", "local[4,2]"):
        Elsewhere.sparkContext.master = master
        assert tables.scratch_path(Elsewhere).startswith("file:///")
    Elsewhere.sparkContext.master = "local-cluster[3,2,1024]"
    with pytest.raises(PlanError):
        tables.scratch_path(Elsewhere)

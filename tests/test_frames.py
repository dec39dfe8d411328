"""End-to-end frames with hand-computed values."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from entiquery import BatchSystem, Component, Float, Global, Program, System, World, match, matched, updates
from entiquery.errors import PlanError
from entiquery.functions.arithmetic import f32


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import test modules


class Position(Component):
    x: Float
    y: Float
    z: Float


class Velocity(Component):
    x: Float
    y: Float
    z: Float


class Intensity(Component):
    value: Float


class Mesh(Component):
    x: Float
    y: Float
    z: Float


class Offset(Component):
    x: Float
    y: Float
    z: Float


AXES = "xyz"


class UpdatePosition(System):
    writes = (Position,)

    def __init__(self, speed=1.0):
        self.speed = speed

    def run(self, ctx, id, position, velocity):
        return {Position: {a: getattr(position, a) + getattr(velocity, a) * ctx.dt * f32(self.speed) for a in AXES}}


class FlipVelocity(System):
    writes = (Velocity,)

    def run(self, ctx, id, velocity):
        return {Velocity: {a: getattr(velocity, a) * -1.0 for a in AXES}}


def fill(spark, n, value):
    c = value if not isinstance(value, (int, float)) else F.lit(float(value))
    return spark.range(n).select("id", *(c.cast("float").alias(a) for a in AXES))


def moving(spark, n=1000, velocity=1.0):
    world = World(spark)
    world.create(Position, fill(spark, n, 0.0))
    world.create(Velocity, fill(spark, n, velocity))
    return world


def positions(world, kind=Position):
    return {r["id"]: np.float32(r["x"]) for r in world.rows(kind).collect()}


f = np.float32
MOVE = match(Position, Velocity).foreach(UpdatePosition(1.0))


def test_match_filter_foreach(spark):
    stmt = match(Position, Velocity).filter(lambda p, v: F.lit(True)).foreach(UpdatePosition(1.0))
    assert set(positions(Program(stmt).frame(moving(spark), dt=0.1)).values()) == {f(0.1)}


def test_dependency_order(spark):
    program = Program(MOVE, match(Velocity).foreach(FlipVelocity()))
    assert [t.index for t in program.tasks()] == [1, 0]
    assert set(positions(program.frame(moving(spark), dt=0.1)).values()) == {f(-0.1)}


def test_predicate(spark):
    world = moving(spark, velocity=F.expr("if(id % 2 = 0, 1, 2)"))
    stmt = match(Position, Velocity).filter(lambda p, v: (v.x < 2) & (v.y < 2) & (v.z < 2)).foreach(UpdatePosition())
    assert positions(Program(stmt).frame(world, 0.1)) == {i: f(0.1) if i % 2 == 0 else f(0) for i in range(1000)}


def test_tags(spark):
    world = moving(spark)
    world.add_tag("affected", spark.range(0, 1000, 2))
    world.add_tag("not_affected", spark.range(0, 1000, 6))
    stmt = match(Position, Velocity).has_tag("affected").has_not_tag("not_affected").foreach(UpdatePosition())
    expected = {i: f(0.1) if i % 2 == 0 and i % 6 else f(0) for i in range(1000)}
    assert positions(Program(stmt).frame(world, 0.1)) == expected
    assert {r["id"] for r in matched(stmt, world).collect()} == {i for i, v in expected.items() if v}


class AddGlobal(System):
    writes = (Position,)

    def run(self, ctx, id, offset, position):
        return {Position: {a: getattr(position, a) + getattr(offset, a) for a in AXES}}


class GrowGlobal(System):
    writes = (Offset,)

    def run(self, ctx, id, offset):
        return {Offset: {"x": offset.x + 1}}


def test_global(spark):
    world = moving(spark, 8)
    program = Program(match(Global(Offset), Position).foreach(AddGlobal()))
    assert set(positions(program.frame(world)).values()) == {f(0)}  # absent: no rows
    assert matched(program.statements[0], world).count() == 0
    world.set_global(Offset(x=1.0, y=1.0, z=1.0))
    assert set(positions(program.frame(world)).values()) == {f(1)}
    grown = Program(match(Global(Offset), Position).foreach(AddGlobal()), match(Global(Offset)).foreach(GrowGlobal())).frame(world)
    assert set(positions(grown).values()) == {f(2)} and grown.global_(Offset)["x"] == 2 and world.global_(Offset)["x"] == 1
    never = Program(match(Global(Offset)).filter(lambda o: o.x > 5).foreach(GrowGlobal())).frame(world)
    assert never.global_(Offset)["x"] == 1


class CopyParent(System):
    writes = (Position,)

    def run(self, ctx, id, position, parent):
        return {Position: {a: getattr(parent, a) for a in AXES}}


def test_expand(spark):
    world = World(spark)
    world.create(Position, fill(spark, 8, 0))
    world.create(Mesh, fill(spark, 8, F.col("id")))
    world.add_ref("parent", [(i, i + 1) for i in range(0, 8, 2)])
    stmt = match(Position).expand("parent", Mesh).foreach(CopyParent())
    assert positions(Program(stmt).frame(world)) == {i: f(i + 1) if i % 2 == 0 else f(0) for i in range(8)}
    assert {r["id"]: r["Position_x"] for r in updates(stmt, world).collect()} == {0: 1, 2: 3, 4: 5, 6: 7}


class Reset(System):
    writes = (Position,)

    def run(self, ctx, id, position):
        return {Position: dict.fromkeys(AXES, F.lit(1.0))}


class Cascade(System):
    writes = (Position,)

    def __init__(self, speed):
        self.speed = speed

    def run(self, ctx, id, position, velocity, parent):
        return {Position: {a: (getattr(position, a) + getattr(parent, a)) * getattr(velocity, a) * ctx.dt * f32(self.speed) for a in AXES}}


class Propagate(System):
    writes = (Mesh,)

    def run(self, ctx, id, mesh, parent, intensity):
        return {Mesh: {a: getattr(parent, a) * intensity.value for a in AXES}}


class Increment(System):
    writes = (Mesh,)

    def run(self, ctx, id, mesh):
        return {Mesh: {a: getattr(mesh, a) + 1 for a in AXES}}


class Draw(System):
    def run(self, ctx, id, mesh):
        return {}


def golden():
    return Program(
        match(Position).foreach(Reset()).named("reset"),
        match(Position, Velocity).expand("parent", Position).foreach(Cascade(1.0)).set_priority(2).named("move"),
        match(Mesh).foreach(Draw()).named("draw"),
        match(Mesh).expand("parent", Position, Intensity).foreach(Propagate()).named("propagate"),
        match(Mesh).expand("parent").has_tag("test").foreach(Increment()).set_priority(2).named("increment"),
    )


def family(spark, n, pairs):
    world = moving(spark, n)
    world.create(Mesh, fill(spark, n, 0))
    world.create(Intensity, spark.range(n).select("id", F.lit(5.0).alias("value")))
    world.add_ref("parent", pairs)
    return world


def test_golden_frame(spark):
    world = family(spark, 8, [(2, 0), (3, 0), (4, 1), (5, 1), (6, 3), (7, 3)])
    world.add_tag("test", [2, 3, 4, 5])
    program = golden()
    assert [t.statement.name for t in program.tasks()] == ["reset", "move", "propagate", "increment", "draw"]
    after = program.frame(world, 0.1)
    near = pytest.approx(0.12, abs=1e-6)
    assert positions(after) == {0: f(1), 1: f(1), **dict.fromkeys(range(2, 6), f(0.2)), 6: near, 7: near}
    assert positions(after, Mesh) == {0: f(0), 1: f(0), **dict.fromkeys(range(2, 6), f(5)), 6: f(2), 7: f(2)}
    assert {r["value"] for r in after.rows(Intensity).collect()} == {5.0}


def test_large_star(spark):
    n = 65536
    world = family(spark, n, spark.range(1, n).select("id", F.lit(0)))
    after = Program(*golden().statements[:2]).frame(world, 0.1)
    rows = after.rows(Position).groupBy("x").count().collect()
    assert {np.float32(r["x"]): r["count"] for r in rows} == {f(1): 1, f(0.2): n - 1}


def test_cycles_and_what_hangs_below_are_left_alone(spark):
    world = family(spark, 12, [(1, 0), (2, 1), (3, 4), (4, 5), (5, 3), (6, 5), (7, 6), (8, 99), (9, 9)])
    stmts = golden().statements[:2]
    after = positions(Program(*stmts).frame(world, 0.1))
    assert after[0] == f(1) and after[1] == f(0.2) and after[2] == pytest.approx(0.12, abs=1e-6)
    assert all(after[i] == f(1) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))


def test_cascade_goes_through_rows_that_do_not_match(spark):
    world = family(spark, 4, [(1, 0), (2, 1), (3, 2)])
    world.remove(Velocity, [1])  # 1 is not matched and keeps 1.0; 2 sees that, 3 sees the new value of 2
    after = positions(Program(*golden().statements[:2]).frame(world, 0.1))
    assert after == {0: f(1), 1: f(1), 2: f(0.2), 3: pytest.approx(0.12, abs=1e-6)}


def test_deep_chain(spark):
    world = family(spark, 20, [(i, i - 1) for i in range(1, 20)])
    after = positions(Program(*golden().statements[:2]).frame(world, 0.1))
    value = f(1)
    for i in range(1, 20):
        value = (f(1) + value) * f(1) * f(0.1) * f(1)
        assert after[i] == pytest.approx(value)


def test_post_frame_and_runs(spark):
    program = Program(MOVE, match(Velocity).foreach(FlipVelocity()).set_post_frame())
    assert [len(program.tasks()), len(program.post_tasks())] == [1, 1]
    world = program.frame(moving(spark, 4), 0.1)
    assert {r["x"] for r in world.rows(Velocity).collect()} == {1.0}
    world = program.run(moving(spark, 4), 3, 0.1)
    assert set(positions(world).values()) == {f(0.1)} and {r["x"] for r in world.rows(Velocity).collect()} == {-1.0}


def test_disabled_rows_are_invisible_and_stay(spark):
    world = moving(spark, 4)
    world.disable(Position, [1])
    world.disable(Velocity, [2])
    after = Program(MOVE).frame(world, 0.1)
    assert positions(after) == {0: f(0.1), 2: f(0), 3: f(0.1)}
    assert after.size(Position) == 4 and after.get(Position, 1)["x"] == 0 and not after.is_enabled(Position, 1)


class Batches(BatchSystem):
    writes = (Position,)

    def run_batch(self, ctx, frame):
        for a in AXES:
            frame[f"Position.{a}"] += frame[f"Velocity.{a}"] * np.float32(ctx.delta)
        return frame


def test_opaque_system(spark):
    world = moving(spark, 50)
    world.add_tag("t", spark.range(25))
    stmt = match(Position, Velocity).has_tag("t").foreach(Batches())
    assert positions(Program(stmt).frame(world, 0.1)) == {i: f(0.1) if i < 25 else f(0) for i in range(50)}
    assert updates(stmt, world, 0.1).count() == 25


def test_no_exchange_between_statements(spark):
    world = moving(spark, 10)
    plan = lambda n: Program(*[match(Velocity).foreach(FlipVelocity()).set_priority(i) for i in range(n)], MOVE).frame(world, 0.1).rows(Position)._jdf.queryExecution().executedPlan().toString()
    assert plan(1).count("Exchange") == plan(4).count("Exchange")


def test_explain():
    text = golden().explain()
    assert "cascading gather: parent" in text and "left filter join" in text and "tag filter: has test, on column" in text and "scan: Position (read_write)" in text


def test_a_host_runs_the_tasks(spark):
    program = golden()
    world, at_once, done = family(spark, 9, [(i, i // 2) for i in range(1, 9)]), None, set()
    at_once = positions(program.frame(world, 0.1))
    assert {t.index for t in program.roots()} == {t.index for t in program.ready(set())}
    while ready := program.ready(done):
        world = program.run_task(world, ready[-1], 0.1)
        done.add(ready[-1].index)
    assert len(done) == len(program.tasks()) and positions(world) == at_once
    with pytest.raises(PlanError):
        golden().run_task(world, program.tasks()[0])


class Sleep(System):
    """Disables what has moved far enough, at the end of the frame."""

    writes = (Position,)

    def run(self, ctx, id, position):
        return {Position: {"enabled": position.x < 1, "x": position.x + 1}}


def test_changes_asked_for_in_a_system_wait_for_the_end(spark):
    world = moving(spark, 4)
    program = Program(match(Position).foreach(Sleep()), match(Position).foreach(Sleep()).set_priority(2))
    after = program.frame(world, 0.1)
    assert {r["x"] for r in after.table(Position).collect()} == {2.0} and after.rows(Position).count() == 0
    again = program.frame(after, 0.1)
    assert {r["x"] for r in again.table(Position).collect()} == {2.0}


def test_cascades_go_down_several_levels_a_job(spark):
    n = 40
    world = family(spark, n, [(i, i - 1) for i in range(1, n)])
    after = positions(Program(*golden().statements[:2]).frame(world, 0.1))
    value = f(1)
    for i in range(1, n):
        value = (f(1) + value) * f(1) * f(0.1) * f(1)
        assert after[i] == pytest.approx(value)


def test_a_frame_reads_and_moves_each_table_once(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(50).select("id", F.col("id").cast("float").alias("x"), F.col("id").cast("float").alias("y"), F.col("id").cast("float").alias("z")).write.parquet(str(tmp_path / name))
    world = World(spark)
    world.create(Position, spark.read.parquet(str(tmp_path / "a")))
    world.create(Velocity, spark.read.parquet(str(tmp_path / "b")))
    plan = Program(MOVE).frame(world, 0.1).table(Position)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3 and plan.split("Union")[0].count("Exchange") == 1  # the third scan: disabled rows stay

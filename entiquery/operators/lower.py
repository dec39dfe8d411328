"""Operator trees to DataFrames over the separate component tables.

A lowered operator has the column ``id`` and one struct column for each of its component columns. Catalyst does
the rest: predicates are plain column expressions, so they reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import FrameContext
from ..errors import InvalidColumnType, PlanError
from ..plans import logical as L
from ..query import BatchSystem, System
from ..sources.ship import ship
from ..types import Fields, name_of, new_value
from ..world import World


def proxies(columns: tuple[L.Column, ...]) -> list[Fields]:
    """What predicates and systems see of an operator's columns."""
    if any(c.kind == "id" for c in columns):
        raise InvalidColumnType("an entity id cannot be passed to a function")
    return [Fields(c.type, F.col(c.name)) for c in columns]


def record(world: World, kind) -> DataFrame:
    """(id, struct) of a component's enabled rows."""
    rows = world.rows(kind) if world.has_table(kind) else world.ensure(kind).where("enabled")
    return rows.select("id", F.struct(*kind.schema().names).alias(name_of(kind)))


def lower(op: L.Operator, world: World, ctx: FrameContext) -> DataFrame:
    match op:
        case L.Scan():
            return record(world, op.component)
        case L.RefScan():
            return world.ref_rows(op.ref).select(F.col("tail").alias("id"), "head")
        case L.Fetch():
            return world.global_rows(op.component).select(F.struct(*op.component.schema().names).alias(op.columns[0].name))
        case L.CrossJoin():  # one side is a global: one row or none
            left, right = (lower(c, world, ctx) for c in op.children)
            return left.crossJoin(F.broadcast(right)) if isinstance(op.children[1], L.Fetch) else right.crossJoin(F.broadcast(left))
        case L.LeftFilterJoin():
            left, right = (lower(c, world, ctx) for c in op.children)
            return left.join(right.select("id"), "id", "left_semi")
        case L.TagFilter():
            return _filtered(lower(op.children[0], world, ctx), world.tag(op.tag), op.has, op.on_column)
        case L.ComponentFilter():
            ids = world.rows(op.component).select("id") if world.has_table(op.component) else world.ensure(op.component).select("id")
            return _filtered(lower(op.children[0], world, ctx), ids, op.has, op.on_column)
        case L.PredicateFilter():
            return lower(op.children[0], world, ctx).where(op.predicate(*proxies(op.columns)))
        case L.CascadingGather():
            raise PlanError("a cascading statement updates; run it in a frame")
        case L.Gather():
            head = lower(op.children[0], world, ctx)
            renamed = head.select(F.col("id").alias("head"), *(F.col(c.name).alias(f"{op.ref}__{c.name}") for c in op.children[0].columns))
            return world.ref_rows(op.ref).join(renamed, "head").select(F.col("tail").alias("id"), *(c.name for c in op.columns))
        case L.Join():
            left, right = (lower(c, world, ctx) for c in op.children)
            return left.join(right, "id")
        case L.Foreach():
            return lower(op.children[0], world, ctx)
    raise PlanError(f"unknown operator {op!r}")


def _filtered(rows: DataFrame, ids: DataFrame, has: bool, on_column: bool) -> DataFrame:
    key = "head" if on_column else "id"
    return rows.join(ids.select(F.col("id").alias(key)), key, "left_semi" if has else "left_anti")


def results(system: System, ctx: FrameContext, columns: tuple[L.Column, ...], id: Column | None = None) -> dict[str, Column]:
    """New struct columns of the written components, by component name."""
    return changes(system, ctx, columns, id)[0]


def changes(system: System, ctx: FrameContext, columns: tuple[L.Column, ...], id: Column | None = None) -> tuple[dict[str, Column], dict[str, Column]]:
    """New struct columns of the written components, and what ``enabled`` is to be after the frame where a system says so, by component name."""
    own = {name_of(c.type): c for c in columns if c.kind in ("component", "global")}
    made = system.run(ctx, F.col("id") if id is None else id, *proxies(columns)) or {}
    unknown = {name_of(k) for k in made} - {name_of(k) for k in system.writes}
    if unknown:
        raise PlanError(f"{type(system).__name__} changes {sorted(unknown)} but does not declare it")
    values = {name_of(k): new_value(own[name_of(k)].type, F.col(own[name_of(k)].name), {f: c for f, c in v.items() if f != "enabled"}) for k, v in made.items()}
    switches = {name_of(k): F.coalesce(v["enabled"] if isinstance(v["enabled"], Column) else F.lit(v["enabled"]), F.lit(True)) for k, v in made.items() if "enabled" in v}
    if wrong := sorted(n for n in switches if own[n].kind != "component"):
        raise PlanError(f"{type(system).__name__} enables or disables globals: {wrong}")
    return values, switches


def run_batches(rows: DataFrame, system: BatchSystem, ctx: FrameContext, columns: tuple[L.Column, ...], keep: list[str]) -> DataFrame:
    """``rows`` with the written struct columns replaced by what ``run_batch`` returns, in Arrow batches of pandas frames."""
    import pandas as pd

    ship(rows.sparkSession)
    flat = [(c, f.name, f"{c.ref}.{name_of(c.type)}.{f.name}" if c.ref else f"{name_of(c.type)}.{f.name}") for c in columns for f in c.type.schema()]
    written = {name_of(k) for k in system.writes}
    out = [(c, f, n) for c, f, n in flat if c.kind in ("component", "global") and name_of(c.type) in written]
    wide = rows.select("id", *keep, *(F.col(c.name).getField(f).alias(f"in{i}") for i, (c, f, _) in enumerate(flat)))
    schema = rows.select("id", *keep, *(F.col(c.name).getField(f).alias(f"out{i}") for i, (c, f, _) in enumerate(out))).schema
    plain = FrameContext(ctx.delta, ctx.user_data, ctx.double)

    def run(batches):
        for b in batches:
            frame = pd.DataFrame({"id": b["id"], **{n: b[f"in{i}"] for i, (_, _, n) in enumerate(flat)}})
            made = system.run_batch(plain, frame)
            yield pd.DataFrame({"id": b["id"], **{k: b[k] for k in keep}, **{f"out{i}": made[n] for i, (_, _, n) in enumerate(out)}})

    made = wide.mapInPandas(run, schema)
    structs = [F.struct(*(F.col(f"out{i}").cast(c.type.schema()[f].dataType).alias(f) for i, (c, f, _) in enumerate(out) if name_of(c.type) == w)).alias(w) for w in sorted(written)]
    return made.select("id", *keep, *structs)

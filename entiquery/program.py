"""Programs: statements, planned once, run as frames over a world."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .context import FrameContext
from .errors import PlanError
from .operators.lower import lower, results, run_batches
from .operators.wide import WideFrame
from .plans import logical as L
from .plans.explain import tree
from .plans.schedule import Task, order
from .query import BatchSystem, Statement
from .types import Global, name_of
from .world import World

log = logging.getLogger("entiquery")


class Program:
    """Statements in the order of writing; each ``frame`` runs them in dependency order and gives a new world."""

    def __init__(self, *statements: Statement, double: bool = False):
        for s in statements:
            L.validate(s)
        self.statements = list(statements)
        self.double = double
        self._frame = order([s for s in self.statements if not s.post_frame])
        self._post = order([s for s in self.statements if s.post_frame])

    def tasks(self) -> list[Task]:
        """The frame's statements in execution order, with what each waits for."""
        return self._frame

    def post_tasks(self) -> list[Task]:
        return self._post

    def roots(self, post: bool = False) -> list[Task]:
        """The tasks that wait for no other."""
        return [t for t in (self._post if post else self._frame) if not t.parents]

    def ready(self, done: set[int], post: bool = False) -> list[Task]:
        """The tasks not in ``done`` (indexes) whose parents all are: what a host may run next."""
        return [t for t in (self._post if post else self._frame) if t.index not in done and set(t.parents) <= done]

    def run_task(self, world: World, task: Task, dt: float = 0.0, user_data: Any = None, settle: bool = False) -> World:
        """One task alone, for a host that drives the graph itself. All tasks in an order of the graph make a frame."""
        if not any(t is task for t in (*self._frame, *self._post)):
            raise PlanError(f"task {task.index} is of another program")
        return self._run([task], world, dt, user_data, settle)

    def bind(self, world: World) -> World:
        """Make the tables, tags and references that the program names, where they are missing."""
        for m in (m for s in self.statements for m in s.matches):
            for c in (*m.components, *m.has, *m.has_not):
                if not isinstance(c, Global):
                    world.ensure(c)
            for t in (*m.tags, *m.not_tags):
                world.tag(t)
            if m.ref:
                world.ensure_ref(m.ref)
        return world

    def frame(self, world: World, dt: float = 0.0, user_data: Any = None, settle: bool = False) -> World:
        """One frame. The result is lazy but for cascades and globals; ``settle`` writes the changed tables out."""
        return self._run(self._frame, world, dt, user_data, settle)

    def post_frame(self, world: World, dt: float = 0.0, user_data: Any = None, settle: bool = False) -> World:
        return self._run(self._post, world, dt, user_data, settle)

    def run(self, world: World, frames: int, dt: float = 0.0, user_data: Any = None, after: Callable[[World, int], None] | None = None) -> World:
        """Several frames, each with its post-frame, written out one by one so that lineage does not grow."""
        for i in range(frames):
            world = self.post_frame(self.frame(world, dt, user_data, settle=True), dt, user_data, settle=True)
            if after:
                after(world, i)
        return world

    def _run(self, tasks: list[Task], world: World, dt: float, user_data: Any, settle: bool) -> World:
        if not tasks:
            return world.snapshot()
        draft = self.bind(world.snapshot())
        wide = WideFrame(draft, FrameContext(dt, user_data, self.double), [t.statement for t in tasks])
        for t in tasks:
            log.debug("statement %d", t.index)
            wide.apply(t.statement)
        return wide.commit(draft, settle)

    def explain(self) -> str:
        """Operator trees in execution order."""
        parts = []
        for title, tasks in (("frame", self._frame), ("post frame", self._post)):
            for t in tasks:
                parts.append(f"{title} {t.index}{' ' + t.statement.name if t.statement.name else ''} after {list(t.parents)}\n{tree(L.plan(t.statement), 1)}")
        return "\n".join(parts)


def matched(stmt: Statement, world: World, dt: float = 0.0, user_data: Any = None, double: bool = False) -> DataFrame:
    """(id, a struct for each component read) of the rows a statement is run for, over the separate tables."""
    return lower(L.plan(stmt), world, FrameContext(dt, user_data, double))


def updates(stmt: Statement, world: World, dt: float = 0.0, user_data: Any = None, double: bool = False) -> DataFrame:
    """(id, the new fields of the written components as Component_field) of a statement's rows; nothing is stored."""
    ctx, op = FrameContext(dt, user_data, double), L.plan(stmt)
    if L.global_only(stmt):
        raise PlanError("a statement of globals alone updates no entity; run it in a frame")
    rows = lower(op, world, ctx)
    if isinstance(stmt.system, BatchSystem):
        new = run_batches(rows, stmt.system, ctx, op.columns, [])
        kinds = {name_of(k): k for k in stmt.system.writes}
        return new.select("id", *(F.col(n).getField(f).alias(f"{n}_{f}") for n, k in sorted(kinds.items()) for f in k.schema().names))
    made = results(stmt.system, ctx, op.columns)
    kinds = {name_of(c.type): c.type for c in op.columns if c.kind == "component"}
    return rows.select("id", *(v.alias(n) for n, v in made.items())).select("id", *(F.col(n).getField(f).alias(f"{n}_{f}") for n in made for f in kinds[n].schema().names))

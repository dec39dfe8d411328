"""The wide entity frame: one row an entity, a struct column for each component, flags for tags, heads of references.

Built once a frame, by one aggregation: the union of all tables, each with its own columns, grouped by id. So each table is read and
moved once. Then a join on the entity is a test for null, a filter a predicate, an update a projection, and
statements without an expand add no exchange at all: Catalyst fuses them. Following a reference is one join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import FrameContext
from ..plans import logical as L
from ..query import BatchSystem, EntityMatch, Statement
from ..sources.tables import materialise, materialise_and_measure, scratch_path
from ..types import Component, Global, name_of
from ..world import World
from .levels import levels
from .lower import changes, proxies, results, run_batches

#: Statements after which the frame is written out, so that plans stay small.
MATERIALISE_EVERY = 6


#: Levels of a cascade that one job goes down.
LEVELS = 6


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _flag(name: str) -> Column:
    return F.coalesce(_quoted(name), F.lit(False))


class WideFrame:
    def __init__(self, world: World, ctx: FrameContext, statements: list[Statement]):
        self.world, self.ctx = world, ctx
        matches = [m for s in statements if not L.global_only(s) for m in s.matches]
        self.kinds: dict[str, type[Component]] = {name_of(c): c for m in matches for c in m.components if not isinstance(c, Global)}
        self.present = {name_of(k): k for m in matches for k in (*m.has, *m.has_not) if name_of(k) not in self.kinds}
        self.tags = list(dict.fromkeys(t for m in matches for t in (*m.tags, *m.not_tags)))
        self.refs = list(dict.fromkeys(m.ref for m in matches if m.ref))
        self.globals: dict[str, DataFrame] = {}
        self.written: set[str] = set()
        self.written_globals: set[str] = set()
        self.applied = 0
        self.df = self._build() if matches else None

    def _build(self) -> DataFrame:
        rows = lambda k: self.world.ensure(k).where("enabled")
        inside = lambda n, k: {f: f"{n}__{f}" for f in k.schema().names}
        parts = [rows(k).select("id", F.lit(True).alias(f"in__{n}"), *(F.col(f).alias(c) for f, c in inside(n, k).items())) for n, k in self.kinds.items()]
        parts += [rows(k).select("id", F.lit(True).alias(f"has__{n}")) for n, k in self.present.items()]
        parts += [self.world.tag(t).select("id", F.lit(True).alias(f"tag__{t}")) for t in self.tags]
        parts += [self.world.ref_rows(r).select(F.col("tail").alias("id"), F.col("head").alias(f"ref__{r}")) for r in self.refs]
        wide = parts[0]
        if len(parts) > 1:
            wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            wide = wide.groupBy("id").agg(*(F.first(_quoted(c), ignorenulls=True).alias(c) for c in wide.columns if c != "id"))  # at most one row a table
        structs = [F.when(_quoted(f"in__{n}"), F.struct(*(_quoted(c).alias(f) for f, c in inside(n, k).items()))).alias(n) for n, k in self.kinds.items()]
        others = [c for c in wide.columns if c.startswith(("has__", "tag__", "ref__")) and not any(c in inside(n, k).values() for n, k in self.kinds.items())]
        return wide.select("id", *structs, *(_quoted(c) for c in others))

    def _has(self, kind: type[Component]) -> Column:
        return F.col(name_of(kind)).isNotNull() if name_of(kind) in self.kinds else _flag(f"has__{name_of(kind)}")

    def _selected(self, m: EntityMatch) -> Column:
        """Whether a row has what the match asks for, without its predicates."""
        tests = [F.col(name_of(c)).isNotNull() for c in m.components if not isinstance(c, Global)]
        tests += [_flag(f"tag__{t}") for t in m.tags] + [~_flag(f"tag__{t}") for t in m.not_tags]
        tests += [self._has(k) for k in m.has] + [~self._has(k) for k in m.has_not]
        return reduce(Column.__and__, tests, F.lit(True))

    def _global(self, kind: type[Component]) -> Column | None:
        """The global as a literal struct; None if it is absent."""
        rows = self.globals.get(name_of(kind))
        found = (rows if rows is not None else self.world.global_rows(kind)).limit(1).collect()  # a singleton
        if not found:
            return None
        return F.struct(*(_literal(found[0][f.name], f.dataType).alias(f.name) for f in kind.schema()))

    def apply(self, stmt: Statement) -> None:
        bound: dict[str, Column] = {}
        for c in stmt.base.components:
            if isinstance(c, Global):
                value = self._global(c.kind)
                if value is None:
                    return  # nothing to fetch: no rows
                bound["global__" + name_of(c.kind)] = value
        columns = L.plan(stmt).columns
        if L.global_only(stmt):
            self._apply_globals(stmt, columns, bound)
            return
        if not isinstance(stmt.system, BatchSystem):
            new = {f"on__{n}": F.lit(True) for n in changes(stmt.system, self.ctx, columns)[1]}
            self.df = self.df.withColumns({n: v for n, v in new.items() if n not in self.df.columns})
        if L.cascades(stmt):
            self._cascade(stmt, columns, bound)
        else:
            joined, cond = self._matched(self.df, self.df, stmt, columns, bound)
            self.df = self._updated(joined, cond, stmt, columns, self.df.columns)
        self.written |= L.writes(stmt)
        self.applied += 1
        if self.applied % MATERIALISE_EVERY == 0:
            self.df = materialise(self.df)

    def _apply_globals(self, stmt: Statement, columns: tuple[L.Column, ...], bound: dict[str, Column]) -> None:
        row = self.world.spark.range(1).withColumns(bound)
        for p in stmt.base.predicates:
            row = row.where(p(*proxies(columns)))
        for name, value in results(stmt.system, self.ctx, columns).items():
            changed = row.select(value.alias("v")).select("v.*")
            if changed.count():
                self.globals[name] = changed
                self.written_globals.add(name)

    def _matched(self, rows: DataFrame, heads: DataFrame, stmt: Statement, columns: tuple[L.Column, ...], bound: dict[str, Column]) -> tuple[DataFrame, Column]:
        """``rows`` with what the statement reads besides, and the condition that a row is matched."""
        base = [c for c in columns if c.kind != "reference"]
        rows = rows.withColumns(bound) if bound else rows
        cond = self._selected(stmt.base)
        for p in stmt.base.predicates:
            cond = cond & p(*proxies(base))
        if (m := stmt.expansion) is None:
            return rows, cond
        ref = _quoted(f"ref__{m.ref}")
        cond = cond & ref.isNotNull()
        if m.components or m.tags or m.not_tags or m.has or m.has_not:
            found = heads.select(F.col("id").alias("__head"), self._selected(m).alias("__ok"), *(F.col(name_of(c)).alias(f"{m.ref}__{name_of(c)}") for c in m.components))
            if m.components:
                found = found.where("__ok")
            # Rows without the reference get keys of their own: null keys would all meet in one task.
            rows = rows.withColumn("__key", F.coalesce(ref, -1 - F.col("id"))).join(found, F.col("__key") == F.col("__head"), "left")
            absent = not (m.components or m.tags or m.has)  # a head without any row passes if nothing is asked of it
            cond = cond & F.coalesce(F.col("__ok"), F.lit(absent))
        for p in m.predicates:
            cond = cond & p(*proxies(columns))
        return rows, cond

    def _updated(self, rows: DataFrame, cond: Column, stmt: Statement, columns: tuple[L.Column, ...], keep: list[str]) -> DataFrame:
        if isinstance(stmt.system, BatchSystem):
            marked = rows.withColumn("__hit", F.coalesce(cond, F.lit(False)))
            changed = run_batches(marked.where("__hit"), stmt.system, self.ctx, columns, [])
            changed = changed.select("id", F.lit(True).alias("__changed"), *(F.col(w).alias(f"new__{w}") for w in changed.columns if w != "id"))
            names = [c for c in changed.columns if c.startswith("new__")]
            both = rows.select(*keep).join(changed, "id", "left")
            return both.withColumns({n[5:]: F.when(F.col("__changed"), F.col(n)).otherwise(F.col(n[5:])) for n in names}).select(*keep)
        new, on = changes(stmt.system, self.ctx, columns)
        new |= {f"on__{n}": v for n, v in on.items()}
        return rows.withColumns({n: F.when(cond, v).otherwise(F.col(n)) for n, v in new.items()}).select(*map(_quoted, keep))

    def _cascade(self, stmt: Statement, columns: tuple[L.Column, ...], bound: dict[str, Column]) -> None:
        """Level by level: rows of a level see the level before as it now is. A job goes down LEVELS levels and writes them.

        Within a job each level's exchange is made once: the next level and what is written share it.
        """
        keep = self.df.columns
        level = levels(self.world.ref_rows(stmt.expansion.ref))
        rows = self.df.join(level.select(F.col("tail").alias("id"), F.col("level").alias("__level")), "id", "left").withColumn("__level", F.coalesce("__level", F.lit(0)))
        rows, top = materialise_and_measure(rows, F.max("__level"), "__level")
        at = lambda table, k: table.where(F.col("__level") == k).select(*map(_quoted, keep))
        now = at(rows, 0)  # roots, and all that never changes here
        below = scratch_path(self.world.spark)
        schema = rows.schema
        for first in range(1, (top or 0) + 1, LEVELS):
            done = []
            for k in range(first, min(first + LEVELS, top + 1)):
                joined, cond = self._matched(at(rows, k), now, stmt, columns, bound)
                now = self._updated(joined, cond, stmt, columns, keep)
                done.append(now.withColumn("__level", F.lit(k).cast(schema["__level"].dataType)))
            folder = f"{below}/first={first}"
            reduce(DataFrame.union, done).write.option("compression", "zstd").partitionBy("__level").parquet(folder)
            now = at(self.world.spark.read.schema(schema).parquet(folder), k)
        if top:
            done = self.world.spark.read.schema(T.StructType([*schema.fields, T.StructField("first", T.LongType())])).parquet(below)
            self.df = at(rows, 0).union(done.select(*map(_quoted, keep)))

    def commit(self, world: World, settle: bool = False) -> World:
        """A new version of ``world`` with the written components; ``settle`` writes the frame out first."""
        out = world.snapshot()
        if settle and self.written:
            self.df = materialise(self.df)
        for name in sorted(self.written):
            kind = self.kinds[name]
            rows = self.df.where(F.col(name).isNotNull()).select("id", *(F.col(name).getField(f).alias(f) for f in kind.schema().names), (F.col(f"on__{name}") if f"on__{name}" in self.df.columns else F.lit(True)).alias("enabled"))
            out.replace_table(kind, rows.unionByName(world.table(kind).where("not enabled")))
        for name in sorted(self.written_globals):
            out.set_global_rows(name, self.globals[name])
        return out


def _literal(value, kind) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*(_literal(value[f.name], f.dataType).alias(f.name) for f in kind))
    return F.lit(value).cast(kind)

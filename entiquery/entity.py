"""Handles on one entity and on one table: sugar over the bulk operations of a world."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .types import Component
from .world import World


@dataclass(frozen=True)
class Entity:
    """Reads and changes go to ``world``; every change is a bulk change of one row, so keep it to setting up and looking."""

    world: World
    id: int

    def add(self, *values: Component) -> Entity:
        for v in values:
            self.world.put(type(v), {self.id: v})
        return self

    def remove(self, *kinds: type[Component]) -> Entity:
        for k in kinds:
            self.world.remove(k, [self.id])
        return self

    def get(self, kind: type[Component]) -> dict | None:
        return self.world.get(kind, self.id)

    def enable(self, kind: type[Component]) -> Entity:
        self.world.enable(kind, [self.id])
        return self

    def disable(self, kind: type[Component]) -> Entity:
        self.world.disable(kind, [self.id])
        return self

    def is_enabled(self, kind: type[Component]) -> bool:
        return self.world.is_enabled(kind, self.id)

    def add_tag(self, *names: str) -> Entity:
        for n in names:
            self.world.add_tag(n, [self.id])
        return self

    def remove_tag(self, *names: str) -> Entity:
        for n in names:
            self.world.remove_tag(n, [self.id])
        return self

    def has_tag(self, name: str) -> bool:
        return self.world.has_tag(name, self.id)

    def refer(self, ref: str, head: Entity | int) -> Entity:
        self.world.add_ref(ref, [(self.id, head.id if isinstance(head, Entity) else head)])
        return self

    def unrefer(self, ref: str) -> Entity:
        self.world.remove_ref(ref, [self.id])
        return self

    def head(self, ref: str) -> Entity | None:
        found = self.world.get_ref(ref, self.id)
        return None if found is None else Entity(self.world, found)

    def destroy(self, purge: bool = False) -> None:
        self.world.clear_entity([self.id], purge)


@dataclass(frozen=True)
class TableView:
    """The table of one component type."""

    world: World
    kind: type[Component]

    def rows(self) -> DataFrame:
        """Enabled rows."""
        return self.world.rows(self.kind)

    def size(self) -> int:
        """All rows, disabled ones too."""
        return self.world.size(self.kind)

    def get(self, id: int) -> dict | None:
        return self.world.get(self.kind, id)

    def put(self, rows: DataFrame | dict[int, Component]) -> TableView:
        self.world.put(self.kind, rows)
        return self

    def remove(self, ids) -> TableView:
        self.world.remove(self.kind, ids)
        return self

    def enable(self, ids) -> TableView:
        self.world.enable(self.kind, ids)
        return self

    def disable(self, ids) -> TableView:
        self.world.disable(self.kind, ids)
        return self

    def clear(self) -> TableView:
        self.world.clear_table(self.kind)
        return self

    def block(self, block: int) -> DataFrame:
        """(block, slot, id, fields) of one block of 256 ids."""
        return self.world.block_rows(self.kind, block)

    def blocks(self) -> Iterator[DataFrame]:
        """The blocks that have enabled rows, one after the other: for a host that goes through a small table."""
        for r in self.world.blocks(self.kind).orderBy("block").toLocalIterator():
            yield self.block(r["block"])

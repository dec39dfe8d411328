"""Frames driven by a stream: each micro-batch is stored into the world, then a frame runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..program import Program
from ..types import Component
from ..world import World


class FrameStream:
    """Holds the latest world; ``start`` attaches it to a streaming DataFrame.

    ``ingest(world, batch)`` puts a micro-batch into the world (see ``upsert`` for rows of one component). A batch that
    is delivered again after a failure is ingested once: its number is remembered.
    """

    def __init__(self, program: Program, world: World, dt: float = 0.0, user_data=None):
        self.program, self.world, self.dt, self.user_data = program, world, dt, user_data
        self.last = -1

    def step(self, batch: DataFrame, number: int, ingest: Callable[[World, DataFrame], None]) -> None:
        if number <= self.last:
            return
        draft = self.world.begin()
        try:
            ingest(draft, batch)
            after = self.program.frame(draft, self.dt, self.user_data, settle=True)
            after = self.program.post_frame(after, self.dt, self.user_data, settle=True)
        except Exception:
            self.world.rollback()
            raise
        self.world.commit(after)
        self.last = number

    def start(self, stream: DataFrame, ingest: Callable[[World, DataFrame], None], checkpoint: str | None = None, **trigger):
        writer = stream.writeStream.foreachBatch(lambda batch, number: self.step(batch, number, ingest))
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def upsert(kind: type[Component], order: str | None = None) -> Callable[[World, DataFrame], None]:
    """Ingest rows (id and fields) of a component; of rows that repeat an id the one with the largest ``order`` holds."""
    from ..sources.tables import materialise

    def ingest(world: World, batch: DataFrame) -> None:
        world.put(kind, batch, order)
        world.replace_table(kind, materialise(world.table(kind)))

    return ingest

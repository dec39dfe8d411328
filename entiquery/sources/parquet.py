"""Worlds from columnar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import Component
from ..world import World


def read(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Any source that Spark reads: parquet, orc, json, csv, text, jdbc."""
    return spark.read.format(fmt).options(**options).load(path)


def component(world: World, kind: type[Component], rows: DataFrame, id: str, **fields: str | Column) -> None:
    """Create a component table from columns of ``rows``; fields not named come from columns of their own name."""
    of = lambda c: c if isinstance(c, Column) else F.col(c)
    world.create(kind, rows.select(F.col(id).alias("id"), *(of(fields.get(f, f)).alias(f) for f in kind.schema().names)))


def tag(world: World, name: str, rows: DataFrame, id: str, where: Column | None = None) -> None:
    """Set a tag to the ids of the rows that satisfy a condition."""
    world.set_tag(name, (rows if where is None else rows.where(where)).select(id))


def reference(world: World, name: str, rows: DataFrame, tail: str | Column, head: str | Column) -> None:
    """Set a reference from two columns; rows where either is null refer to nothing."""
    of = lambda c: c if isinstance(c, Column) else F.col(c)
    world.add_ref(name, rows.select(of(tail).alias("tail"), of(head).alias("head")))


def save(world: World, path: str) -> None:
    """Write every component table, tag and reference below ``path``."""
    for part, tables in (("tables", world.state.tables), ("tags", world.state.tags), ("refs", world.state.refs), ("globals", world.state.globals)):
        for name, rows in tables.items():
            rows.write.parquet(f"{path}/{part}/{name}")


def load(spark: SparkSession, path: str, kinds: list[type[Component]], tags: list[str] = (), refs: list[str] = (), globals: list[type[Component]] = ()) -> World:
    """Read back what ``save`` wrote."""
    world = World(spark)
    for k in kinds:
        world.create(k, spark.read.parquet(f"{path}/tables/{k.__name__}"))
    for t in tags:
        world.set_tag(t, spark.read.parquet(f"{path}/tags/{t}"))
    for r in refs:
        rows = spark.read.parquet(f"{path}/refs/{r}")
        world._set("refs", r, rows)
    for g in globals:
        world.set_global_rows(g, spark.read.parquet(f"{path}/globals/{g.__name__}"))
    return world

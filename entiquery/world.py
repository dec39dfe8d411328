"""The database of entities: component tables, tags, references and globals, as immutable DataFrames.

Every change makes new DataFrames and puts them into the world's state, so whoever holds a snapshot keeps seeing
the version it took. Ids and tails are unique; changes are bulk.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import PlanError
from .types import Component, describe, name_of

REF_SCHEMA = T.StructType([T.StructField("tail", T.LongType(), False), T.StructField("head", T.LongType(), False), T.StructField("enabled", T.BooleanType(), False)])
ID_SCHEMA = T.StructType([T.StructField("id", T.LongType(), False)])
BLOCK_ROWS = 256


def block_of(id: Column) -> Column:
    """The block of 256 ids that an entity lies in."""
    return F.shiftright(id, BLOCK_ROWS.bit_length() - 1)  # 256 is a power of two


def slot_of(id: Column) -> Column:
    """An entity's place in its block."""
    return F.pmod(id, F.lit(BLOCK_ROWS)).cast("int")


def owner(block: Column, slot: Column) -> Column:
    """The entity at a place of a block."""
    return block * BLOCK_ROWS + slot


@dataclass(frozen=True)
class State:
    """One version of everything."""

    kinds: dict[str, type[Component]]
    tables: dict[str, DataFrame]
    tags: dict[str, DataFrame]
    refs: dict[str, DataFrame]
    globals: dict[str, DataFrame]


class World:
    def __init__(self, spark: SparkSession, state: State | None = None):
        self.spark = spark
        self._state = state or State({}, {}, {}, {}, {})
        self._lock = threading.RLock()
        self._saved: list[State] = []

    # versions

    @property
    def state(self) -> State:
        return self._state

    def snapshot(self) -> World:
        """A world of its own that starts from this version."""
        return World(self.spark, self._state)

    def begin(self) -> World:
        """Start a transaction; one writer at a time. Others go on reading the last committed version by ``snapshot``."""
        self._lock.acquire()
        self._saved.append(self._state)
        return World(self.spark, self._state)

    def commit(self, draft: World) -> None:
        if not self._saved:
            raise PlanError("no transaction")
        self._state = draft._state
        self._saved.pop()
        self._lock.release()

    def rollback(self) -> None:
        if not self._saved:
            raise PlanError("no transaction")
        self._state = self._saved.pop()
        self._lock.release()

    def _set(self, part: str, name: str, value) -> None:
        with self._lock:
            mapping = dict(getattr(self._state, part))
            if value is None:
                mapping.pop(name, None)
            else:
                mapping[name] = value
            self._state = replace(self._state, **{part: mapping})

    def _frame(self, data, schema: T.StructType) -> DataFrame:
        return data if isinstance(data, DataFrame) else self.spark.createDataFrame(list(data), schema)

    def _ids(self, ids: DataFrame | Iterable[int] | Column | int) -> DataFrame:
        if isinstance(ids, int):
            ids = [ids]
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(int(i),) for i in ids], ID_SCHEMA)
        return ids.select(F.col(ids.columns[0]).cast("long").alias("id")).where("id is not null").distinct()

    # component tables

    def create(self, kind: type[Component], rows: DataFrame | None = None) -> DataFrame:
        """A new table, empty or from ``rows`` (id, fields, perhaps enabled); an error if it exists."""
        if kind.__name__ in self._state.tables:
            raise PlanError(f"{kind.__name__} exists")
        empty = self.spark.createDataFrame([], kind.table_schema())
        table = empty if rows is None else self._conform(kind, rows)
        self._set("kinds", kind.__name__, kind)
        self._set("tables", kind.__name__, table)
        return table

    def _conform(self, kind: type[Component], rows: DataFrame) -> DataFrame:
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.schema()]
        enabled = F.coalesce(F.col("enabled"), F.lit(True)) if "enabled" in rows.columns else F.lit(True)
        return rows.select(F.col("id").cast("long").alias("id"), *fields, enabled.alias("enabled"))

    def has_table(self, kind: type[Component] | str) -> bool:
        return name_of(kind) in self._state.tables

    def table(self, kind: type[Component] | str) -> DataFrame:
        """All existing rows, disabled ones too."""
        try:
            return self._state.tables[name_of(kind)]
        except KeyError:
            raise KeyError(f"no table {name_of(kind)}") from None

    def ensure(self, kind: type[Component]) -> DataFrame:
        return self.table(kind) if self.has_table(kind) else self.create(kind)

    def drop(self, kind: type[Component] | str) -> None:
        self._set("tables", name_of(kind), None)

    def rows(self, kind: type[Component] | str) -> DataFrame:
        """What queries see: enabled rows, without the enabled column."""
        return self.table(kind).where("enabled").drop("enabled")

    def replace_table(self, kind: type[Component] | str, rows: DataFrame) -> None:
        self._set("tables", name_of(kind), rows)

    def put(self, kind: type[Component], rows: DataFrame | dict[int, Component], order: str | None = None) -> None:
        """Insert or replace whole rows, which become enabled. Of rows that repeat an id the one with the largest ``order`` holds, else the largest."""
        if isinstance(rows, dict):
            rows = self.spark.createDataFrame([(i, *r.values(), True) for i, r in rows.items()], kind.table_schema())
        fields = self._conform(kind, rows.drop("enabled"))
        record = F.struct(*[c for c in fields.columns if c != "id"])
        if order is None:
            new, best = fields.where("id is not null").select("id", record.alias("r")), F.max("r")
        else:
            rows = rows.withColumn("__order", F.col(order))
            typed = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.schema()], F.lit(True).alias("enabled"))
            new, best = rows.where("id is not null").select(F.col("id").cast("long").alias("id"), typed.alias("r"), "__order"), F.max_by("r", "__order")
        new = new.groupBy("id").agg(best.alias("r")).select("id", "r.*")
        old = self.ensure(kind)
        self.replace_table(kind, old.join(new, "id", "left_anti").unionByName(new.select(*old.columns)))

    def remove(self, kind: type[Component] | str, ids) -> None:
        self.replace_table(kind, self.table(kind).join(self._ids(ids), "id", "left_anti"))

    def get(self, kind: type[Component] | str, id: int) -> dict | None:
        """The row of one entity, even if disabled."""
        found = self.table(kind).where(F.col("id") == id).drop("enabled").limit(1).collect()
        return found[0].asDict(recursive=True) if found else None

    def _switch(self, kind, ids, on: bool) -> None:
        table, ids = self.table(kind), self._ids(ids).withColumn("__hit", F.lit(True))
        flag = F.when(F.col("__hit"), F.lit(on)).otherwise(F.col("enabled"))
        self.replace_table(kind, table.join(ids, "id", "left").select(*[c for c in table.columns if c != "enabled"], flag.alias("enabled")))

    def enable(self, kind: type[Component] | str, ids) -> None:
        """Make existing rows visible to queries."""
        self._switch(kind, ids, True)

    def disable(self, kind: type[Component] | str, ids) -> None:
        """Hide existing rows from queries."""
        self._switch(kind, ids, False)

    def is_enabled(self, kind: type[Component] | str, id: int) -> bool:
        return bool(self.table(kind).where((F.col("id") == id) & F.col("enabled")).limit(1).count())

    def size(self, kind: type[Component] | str) -> int:
        return self.table(kind).count()

    def clear_table(self, kind: type[Component] | str) -> None:
        self.replace_table(kind, self.table(kind).limit(0))

    def slice(self, kind: type[Component] | str, chunk: int = 1, offset: int = 0, stride: int = 1) -> DataFrame:
        """Enabled rows of every ``stride``-th chunk of blocks of 256 ids, from chunk ``offset`` on."""
        block = F.expr(f"id div {BLOCK_ROWS * chunk}")
        return self.rows(kind).where(F.pmod(block, F.lit(stride)) == offset)

    def blocks(self, kind: type[Component] | str) -> DataFrame:
        """(block, rows): how many enabled rows each block of 256 ids has."""
        return self.rows(kind).groupBy(block_of(F.col("id")).alias("block")).agg(F.count("*").alias("rows"))

    def block_rows(self, kind: type[Component] | str, block: int | None = None) -> DataFrame:
        """(block, slot, id, fields) of the enabled rows of one block, or of all; ``slot`` is a row's place in its block."""
        rows = self.rows(kind)
        if block is not None:  # a range of ids, which reaches the scan
            rows = rows.where((F.col("id") >= block * BLOCK_ROWS) & (F.col("id") < (block + 1) * BLOCK_ROWS))
        return rows.select(block_of(F.col("id")).alias("block"), slot_of(F.col("id")).alias("slot"), *rows.columns)

    def entities(self) -> DataFrame:
        """(id) of every entity that has a component, enabled or not."""
        parts = [t.select("id") for t in self._state.tables.values()]
        return reduce(DataFrame.union, parts).distinct() if parts else self.spark.createDataFrame([], ID_SCHEMA)

    # tags

    def tag(self, name: str) -> DataFrame:
        """The ids of a tag; an unknown one is empty."""
        if name not in self._state.tags:
            self._set("tags", name, self.spark.createDataFrame([], ID_SCHEMA))
        return self._state.tags[name]

    def set_tag(self, name: str, ids) -> None:
        self._set("tags", name, self._ids(ids))

    def add_tag(self, name: str, ids) -> None:
        self._set("tags", name, self.tag(name).union(self._ids(ids)).distinct())

    def remove_tag(self, name: str, ids) -> None:
        self._set("tags", name, self.tag(name).join(self._ids(ids), "id", "left_anti"))

    def has_tag(self, name: str, id: int) -> bool:
        return bool(self.tag(name).where(F.col("id") == id).limit(1).count())

    def tag_size(self, name: str) -> int:
        return self.tag(name).count()

    def clear_tag(self, name: str) -> None:
        self._set("tags", name, self.spark.createDataFrame([], ID_SCHEMA))

    def tag_union(self, a: str, b: str) -> DataFrame:
        return self.tag(a).union(self.tag(b)).distinct()

    def tag_difference(self, a: str, b: str) -> DataFrame:
        return self.tag(a).join(self.tag(b), "id", "left_anti")

    def tag_intersection(self, a: str, b: str) -> DataFrame:
        return self.tag(a).join(self.tag(b), "id", "left_semi")

    def tag_complement(self, name: str, among: DataFrame | None = None) -> DataFrame:
        """The ids ``among`` some (all entities, if not given) that do not have the tag."""
        return (self.entities() if among is None else self._ids(among)).join(self.tag(name), "id", "left_anti")

    def tag_bitmaps(self, name: str) -> DataFrame:
        """(bucket, bits): the tag as one bitmap of 4,096 bytes for each 32,768 ids, from 0 on."""
        known = self.tag(name).where("id >= 0")
        return known.groupBy(F.expr("id div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("id % 32768")).alias("bits"))

    def set_tag_bitmaps(self, name: str, bitmaps: DataFrame) -> None:
        """Set a tag from (bucket, bits) rows as ``tag_bitmaps`` makes them."""
        byte = F.conv(F.hex(F.expr("substring(bits, at + 1, 1)")), 16, 10).cast("int")
        rows = bitmaps.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.octet_length("bits") - 1)).alias("at")).withColumn("byte", byte).where("byte > 0")
        rows = rows.select("bucket", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where("shiftright(byte, bit) & 1 = 1")
        self.set_tag(name, rows.select((F.col("bucket") * 32768 + F.col("at") * 8 + F.col("bit")).alias("id")))

    # references

    def has_ref_table(self, name: str) -> bool:
        return name in self._state.refs

    def ref(self, name: str) -> DataFrame:
        """(tail, head, enabled) of a reference; an unknown one is an error."""
        try:
            return self._state.refs[name]
        except KeyError:
            raise KeyError(f"no reference {name}") from None

    def ensure_ref(self, name: str) -> DataFrame:
        if name not in self._state.refs:
            self._set("refs", name, self.spark.createDataFrame([], REF_SCHEMA))
        return self._state.refs[name]

    def ref_rows(self, name: str) -> DataFrame:
        return self.ensure_ref(name).where("enabled").select("tail", "head")

    def _pairs(self, pairs) -> DataFrame:
        if not isinstance(pairs, DataFrame):
            pairs = self.spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "tail long, head long")
        return pairs.select(F.col(pairs.columns[0]).cast("long").alias("tail"), F.col(pairs.columns[1]).cast("long").alias("head")).where("tail is not null and head is not null")

    def add_ref(self, name: str, pairs) -> None:
        """Set tail -> head, replacing what the tail referred to. Of pairs that repeat a tail the largest head holds."""
        new = self._pairs(pairs).groupBy("tail").agg(F.max("head").alias("head")).withColumn("enabled", F.lit(True))
        self._set("refs", name, self.ensure_ref(name).join(new, "tail", "left_anti").unionByName(new))

    def remove_ref(self, name: str, tails) -> None:
        gone = self._ids(tails).withColumnRenamed("id", "tail")
        self._set("refs", name, self.ref(name).join(gone, "tail", "left_anti"))

    def disable_ref(self, name: str, tails, on: bool = False) -> None:
        hit = self._ids(tails).select(F.col("id").alias("tail"), F.lit(True).alias("__hit"))
        rows = self.ref(name).join(hit, "tail", "left")
        self._set("refs", name, rows.select("tail", "head", F.when(F.col("__hit"), F.lit(on)).otherwise(F.col("enabled")).alias("enabled")))

    def get_ref(self, name: str, tail: int) -> int | None:
        found = self.ref(name).where(F.col("tail") == tail).limit(1).collect()
        return found[0]["head"] if found else None

    def has_ref(self, name: str, tail: int, head: int) -> bool:
        return self.get_ref(name, tail) == head

    # globals

    def set_global(self, value: Component) -> None:
        """Create or replace the one record of its type."""
        kind = type(value)
        self._set("kinds", kind.__name__, kind)
        self._set("globals", kind.__name__, self.spark.createDataFrame([value.values()], kind.schema()))

    def set_global_rows(self, kind: type[Component] | str, rows: DataFrame) -> None:
        self._set("globals", name_of(kind), rows)

    def drop_global(self, kind: type[Component] | str) -> None:
        self._set("globals", name_of(kind), None)

    def global_(self, kind: type[Component] | str) -> dict | None:
        rows = self._state.globals.get(name_of(kind))
        found = rows.limit(1).collect() if rows is not None else []
        return found[0].asDict(recursive=True) if found else None

    def ensure_global(self, kind: type[Component]) -> dict:
        if name_of(kind) not in self._state.globals:
            self.set_global(kind())
        return self.global_(kind)

    def global_rows(self, kind: type[Component]) -> DataFrame:
        """One row, or none if the global is absent."""
        rows = self._state.globals.get(name_of(kind))
        return rows if rows is not None else self.spark.createDataFrame([], kind.schema())

    # catalogue

    def clear(self) -> None:
        with self._lock:
            self._state = State({}, {}, {}, {}, {})

    def clear_entity(self, ids, purge: bool = False) -> None:
        """Delete entities from every component table; with ``purge`` also from tags and references."""
        ids = self._ids(ids)
        for name in self._state.tables:
            self.remove(name, ids)
        if purge:
            for name in self._state.tags:
                self.remove_tag(name, ids)
            for name, rows in self._state.refs.items():
                heads = ids.select(F.col("id").alias("head"))
                self._set("refs", name, rows.join(ids.select(F.col("id").alias("tail")), "tail", "left_anti").join(heads, "head", "left_anti").select("tail", "head", "enabled"))

    def metadata(self) -> DataFrame:
        """(name, size) of every component table; sizes are counted when the result is."""
        parts = [t.groupBy().agg(F.count("*").alias("size")).select(F.lit(n).alias("name"), "size") for n, t in sorted(self._state.tables.items())]
        if not parts:
            return self.spark.createDataFrame([], "name string, size long")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def describe(self, kind: type[Component] | str) -> list[dict]:
        return describe(self._state.kinds[kind] if isinstance(kind, str) else kind)

    def validate(self) -> list[str]:
        """Tables and references whose key repeats or is null."""
        bad = []
        for part, key in (("tables", "id"), ("refs", "tail")):
            for name, rows in getattr(self._state, part).items():
                if rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).limit(1).count():
                    bad.append(name)
        return bad

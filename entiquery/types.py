"""Component declarations: Python classes whose annotated fields become Spark columns.

    class Position(Component):
        x: Float
        y: Float

Unsigned integers are widened by one size, since Spark has signed ones only. A ``Struct`` field is nested; with
``anonymous`` its fields are hoisted into the owner. A ``Union`` field is a struct of nullable alternatives.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import PlanError, UnsupportedTypeModifier


@dataclass(frozen=True)
class FieldType:
    """A scalar type: its name in descriptions and the Spark type that holds it."""

    name: str
    spark: T.DataType


Bool = FieldType("bool", T.BooleanType())
Char = FieldType("char", T.StringType())
Int8, Int16, Int32, Int64 = (FieldType(f"int{8 << i}", t) for i, t in enumerate([T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]))
UInt8, UInt16, UInt32, UInt64 = (FieldType(f"uint{8 << i}", t) for i, t in enumerate([T.ShortType(), T.IntegerType(), T.LongType(), T.DecimalType(20, 0)]))
Float, Double, String = FieldType("float", T.FloatType()), FieldType("double", T.DoubleType()), FieldType("string", T.StringType())
EntityId = FieldType("entity", T.LongType())

RESERVED = {"id", "enabled"}


@dataclass(frozen=True)
class Anonymous:
    """Marks a Struct whose fields belong to the owner."""

    kind: type


def anonymous(kind: type) -> Anonymous:
    return Anonymous(kind)


def _annotations(cls: type) -> dict[str, object]:
    out: dict[str, object] = {}
    names = vars(sys.modules[cls.__module__]) if cls.__module__ in sys.modules else {}
    for base in reversed(cls.__mro__):
        for name, kind in getattr(base, "__annotations__", {}).items():
            if isinstance(kind, str):
                kind = eval(kind, dict(names), {**globals(), **vars(cls)})  # noqa: S307  the class's own annotation
            out[name] = kind
    return out


class Record:
    """Base of everything with fields; instances hold values by keyword."""

    def __init__(self, **values):
        known = {f.name for f in type(self).schema()}
        if extra := set(values) - known:
            raise PlanError(f"{type(self).__name__} has no field {sorted(extra)}")
        self.__dict__.update(values)

    @classmethod
    def schema(cls) -> T.StructType:
        fields: list[T.StructField] = []
        for name, kind in _annotations(cls).items():
            if isinstance(kind, Anonymous):
                fields += [T.StructField(f.name, f.dataType, f.nullable, {"anonymous": name}) for f in kind.kind.schema()]
            elif isinstance(kind, FieldType):
                fields.append(T.StructField(name, kind.spark, True, {"type": kind.name}))
            elif isinstance(kind, type) and issubclass(kind, Record):
                fields.append(T.StructField(name, kind.schema(), True, {"union": True} if issubclass(kind, Union) else {"struct": kind.__name__}))
            else:
                raise UnsupportedTypeModifier(f"{cls.__name__}.{name}: {kind!r}")
        return T.StructType(fields)

    def values(self) -> tuple:
        """In the order of the schema, as Spark takes them."""
        out = []
        for f in self.schema():
            v = self.__dict__.get(f.name)
            if isinstance(v, Record):
                v = v.values()
            elif isinstance(f.dataType, T.DecimalType) and v is not None:
                v = Decimal(v)
            out.append(v)
        return tuple(out)


class Struct(Record):
    """A nested record."""


class Union(Record):
    """Alternatives of one place; those not in use are null."""


class Component(Record):
    """A component type; its table has the columns id, the fields and enabled."""

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        if clash := RESERVED & set(_annotations(cls)):
            raise PlanError(f"{cls.__name__}: {sorted(clash)} are columns of every table")

    @classmethod
    def table_schema(cls) -> T.StructType:
        return T.StructType([T.StructField("id", T.LongType(), False), *cls.schema().fields, T.StructField("enabled", T.BooleanType(), False)])


@dataclass(frozen=True)
class Global:
    """In ``match``: the component comes from the world's globals, not from the entity."""

    kind: type[Component]


def name_of(kind: type[Component] | str) -> str:
    return kind if isinstance(kind, str) else kind.__name__


def describe(kind: type[Record], prefix: str = "") -> list[dict]:
    """Fields of a component, nested ones under dotted names: name, type, struct, union, anonymous."""
    rows = []
    for f in kind.schema():
        meta = f.metadata or {}
        nested = isinstance(f.dataType, T.StructType)
        rows.append({"name": prefix + f.name, "type": meta.get("type", "struct" if nested else f.dataType.simpleString()), "union": bool(meta.get("union")), "anonymous": "anonymous" in meta})
        if nested:
            rows += [{"name": f"{prefix}{f.name}.{g.name}", "type": (g.metadata or {}).get("type", g.dataType.simpleString()), "union": False, "anonymous": False} for g in f.dataType]
    return rows


class Fields:
    """Attribute access to the columns of a matched component."""

    def __init__(self, kind: type[Component], column: Column):
        self._kind, self._column = kind, column

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__") or name not in self._kind.schema().names:
            raise AttributeError(f"{self._kind.__name__} has no field {name}")
        return self._column.getField(name)


def new_value(kind: type[Component], old: Column, changes: dict[str, Column]) -> Column:
    """The component as a struct with some fields replaced, each cast to its declared type as a store would."""
    if extra := set(changes) - set(kind.schema().names):
        raise PlanError(f"{kind.__name__} has no field {sorted(extra)}")
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*((as_column(changes[f.name]).cast(f.dataType) if f.name in changes else old.getField(f.name)).alias(f.name) for f in kind.schema()))

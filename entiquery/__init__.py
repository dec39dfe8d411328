"""Entity-component analytics on Spark DataFrames."""

from .context import FrameContext
from .entity import Entity, TableView
from .program import Program, matched, updates
from .query import BatchSystem, Statement, System, match
from .types import (
    Bool, Char, Component, Double, EntityId, Float, Global, Int8, Int16, Int32, Int64, String, Struct, UInt8, UInt16, UInt32, UInt64, Union, anonymous, describe,
)
from .world import World

__all__ = [
    "BatchSystem", "Bool", "Char", "Component", "Double", "Entity", "EntityId", "Float", "FrameContext", "Global", "Int16", "Int32", "Int64", "Int8", "Program", "Statement", "String", "Struct",
    "System", "TableView", "UInt16", "UInt32", "UInt64", "UInt8", "Union", "World", "anonymous", "describe", "match", "matched", "updates",
]

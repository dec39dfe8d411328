"""The statement language: match(...).filters.expand(...).foreach(system). Pure data; nothing runs here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from .errors import ExpectedStringLiteral, PlanError, UnsupportedStatement
from .types import Component, Global

DEFAULT_PRIORITY = 1


class System:
    """User logic for each matched row.

    ``writes`` names the components that ``run`` changes; all others are read. ``run(ctx, id, *components)`` gets
    attribute access to columns and returns {component: {field: column}}. The field ``enabled`` asks for a component to be
    enabled or disabled; that takes effect when the frame ends.
    """

    writes: tuple[type[Component], ...] = ()

    def run(self, ctx, id, *components):
        raise NotImplementedError

    def components(self) -> int | None:
        """How many components ``run`` takes; None if it takes any number."""
        code = type(self).run.__code__
        return None if code.co_flags & 0x04 else code.co_argcount - 3


class BatchSystem(System):
    """A system of opaque Python: ``run_batch(ctx, frame)`` gets pandas batches and returns them changed.

    Columns are ``id`` and ``Component.field`` (``reference.Component.field`` for expanded ones). Rows may not be
    added or dropped. Prefer ``run``: it stays in the JVM.
    """

    def run_batch(self, ctx, frame):
        raise NotImplementedError

    def components(self) -> int | None:
        return None


@dataclass(frozen=True)
class EntityMatch:
    """What one entity (the base, or the head of a reference) has to have."""

    components: tuple[type[Component] | Global, ...] = ()
    tags: tuple[str, ...] = ()
    not_tags: tuple[str, ...] = ()
    has: tuple[type[Component], ...] = ()
    has_not: tuple[type[Component], ...] = ()
    predicates: tuple[Callable, ...] = ()
    ref: str | None = None


@dataclass(frozen=True)
class Statement:
    matches: tuple[EntityMatch, ...]
    system: System | None = None
    priority: int = DEFAULT_PRIORITY
    post_frame: bool = False
    name: str = field(default="", compare=False)

    def set_priority(self, priority: int) -> Statement:
        if not isinstance(priority, int) or priority < 0:
            raise PlanError("a priority is an integer from 0 on")
        return replace(self, priority=priority)

    def set_post_frame(self) -> Statement:
        return replace(self, post_frame=True)

    def named(self, name: str) -> Statement:
        return replace(self, name=name)

    @property
    def base(self) -> EntityMatch:
        return self.matches[0]

    @property
    def expansion(self) -> EntityMatch | None:
        return self.matches[1] if len(self.matches) > 1 else None


def _names(names: tuple) -> tuple[str, ...]:
    if not all(isinstance(n, str) for n in names):
        raise ExpectedStringLiteral(f"a name is a string: {names!r}")
    return names


@dataclass(frozen=True)
class Query:
    """A statement in the making; filters apply to the last match or expand."""

    matches: tuple[EntityMatch, ...]

    def _last(self, **changes) -> Query:
        last = self.matches[-1]
        return Query((*self.matches[:-1], replace(last, **{k: getattr(last, k) + v for k, v in changes.items()})))

    def has_tag(self, *names: str) -> Query:
        return self._last(tags=_names(names))

    def has_not_tag(self, *names: str) -> Query:
        return self._last(not_tags=_names(names))

    def has_component(self, *kinds: type[Component]) -> Query:
        return self._last(has=kinds)

    def has_not_component(self, *kinds: type[Component]) -> Query:
        return self._last(has_not=kinds)

    def filter(self, predicate: Callable) -> Query:
        """``predicate`` gets all components matched so far and returns a boolean Column."""
        if not callable(predicate):
            raise UnsupportedStatement("filter takes a function")
        return self._last(predicates=(predicate,))

    def expand(self, ref: str, *kinds: type[Component]) -> Query:
        """Follow a reference; with components they join the row, without, the reference only has to exist."""
        _names((ref,))
        return Query((*self.matches, EntityMatch(kinds, ref=ref)))

    def foreach(self, system: System) -> Statement:
        return Statement(self.matches, system)


def match(*components: type[Component] | Global) -> Query:
    return Query((EntityMatch(components),))

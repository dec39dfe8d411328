"""Errors that planning a program can raise."""


class PlanError(ValueError):
    """A statement or program that cannot be planned."""


class CyclicDependency(PlanError):
    """Statements that each have to run after another one."""


class InvalidColumnType(PlanError):
    """A column of this kind cannot be used here."""


class InvalidAccessModeOnExpand(PlanError):
    """An expanded component, or a global beside entities, is written."""


class InvalidNumberOfComponents(PlanError):
    """The system takes another number of components than the statement matches."""


class UnsupportedStatement(PlanError):
    """No match, more than one expand, or no operation."""


class ExpectedStringLiteral(PlanError):
    """Names of tags and references are strings."""


class UnsupportedTypeModifier(PlanError):
    """A field type that no Spark type can hold."""

"""Validation, operator trees, dependency rules."""

import itertools

import pytest

from entiquery import Component, Float, Global, Program, System, match
from entiquery.errors import CyclicDependency, ExpectedStringLiteral, InvalidAccessModeOnExpand, InvalidColumnType, InvalidNumberOfComponents, PlanError, UnsupportedStatement
from entiquery.plans import logical as L
from entiquery.plans.schedule import depends


class A(Component):
    x: Float


class B(Component):
    x: Float


class C(Component):
    x: Float


def system(*writes):
    class S(System):
        def run(self, ctx, id, *components):
            return {}

    S.writes = writes
    return S()


class Two(System):
    def run(self, ctx, id, a, b):
        return {}


def shape(op):
    return (type(op).__name__, *(shape(c) for c in op.children))


def test_tree_rules():
    stmt = match(A, Global(B), C).has_component(B).has_tag("t").has_not_tag("n").filter(len).foreach(system(A))
    assert shape(L.plan(stmt)) == ("Foreach", ("PredicateFilter", ("ComponentFilter", ("TagFilter", ("TagFilter", ("Join", ("CrossJoin", ("Scan",), ("Fetch",)), ("Scan",)))))))
    inner = L.plan(stmt).children[0].children[0].children[0]
    assert inner.tag == "t" and inner.has and inner.children[0].tag == "n" and not inner.children[0].has
    gather = L.plan(match(A).filter(len).expand("r", B).has_tag("t").filter(max).foreach(system(A)))
    assert shape(gather) == ("Foreach", ("PredicateFilter", ("Join", ("PredicateFilter", ("Scan",)), ("Gather", ("TagFilter", ("Scan",))))))
    assert shape(L.plan(match(A).expand("r", A).foreach(system(A)))) == ("Foreach", ("Join", ("Scan",), ("CascadingGather", ("Scan",))))
    semi = L.plan(match(A).expand("r").has_tag("t").has_not_component(C).foreach(system(A)))
    assert shape(semi) == ("Foreach", ("LeftFilterJoin", ("Scan",), ("ComponentFilter", ("TagFilter", ("RefScan",)))))
    assert semi.children[0].children[1].on_column


@pytest.mark.parametrize(
    "error,build",
    [
        (UnsupportedStatement, lambda: match().foreach(system())),
        (UnsupportedStatement, lambda: match(A).foreach(None)),
        (UnsupportedStatement, lambda: match(A).expand("r", B).expand("s", C).foreach(system())),
        (UnsupportedStatement, lambda: match(Global(A)).has_tag("t").foreach(system(A))),
        (UnsupportedStatement, lambda: match(Global(A)).expand("r", B).foreach(system())),
        (InvalidNumberOfComponents, lambda: match(A).foreach(Two())),
        (InvalidNumberOfComponents, lambda: match(A, B).expand("r", C).foreach(Two())),
        (InvalidAccessModeOnExpand, lambda: match(A).expand("r", B).foreach(system(B))),
        (InvalidAccessModeOnExpand, lambda: match(A, Global(B)).foreach(system(B))),
        (InvalidAccessModeOnExpand, lambda: match(A).expand("r", Global(B)).foreach(system())),
        (InvalidColumnType, lambda: match(int).foreach(system())),
        (PlanError, lambda: match(A, A).foreach(system())),
        (ExpectedStringLiteral, lambda: match(A).has_tag(1).foreach(system())),
        (ExpectedStringLiteral, lambda: match(A).expand(A).foreach(system())),
        (PlanError, lambda: match(A).foreach(system()).set_priority(-1)),
        (UnsupportedStatement, lambda: match(A).filter("x").foreach(system())),
    ],
)
def test_errors(error, build):
    with pytest.raises(error):
        Program(build())


def test_dependency_truth_table():
    read, write = match(A).foreach(system()), match(A).foreach(system(A))
    assert not depends(read, read)
    assert depends(read, write) and depends(read.set_priority(0), write.set_priority(9))
    assert not depends(write, read)
    for a, b in itertools.product(range(3), repeat=2):
        assert depends(write.set_priority(a), write.set_priority(b)) == (a >= b)
    other = match(B).foreach(system(B))
    assert not depends(read, other) and not depends(other, write)
    assert depends(match(B).expand("r", A).foreach(system(B)), write)  # expanded components count
    assert depends(match(Global(A), B).foreach(system(B)), match(Global(A)).foreach(system(A)))


def test_cycles():
    with pytest.raises(CyclicDependency):
        Program(match(A).foreach(system(A)), match(A).foreach(system(A)))
    with pytest.raises(CyclicDependency):
        Program(match(A, B).foreach(system(A)), match(A, B).foreach(system(B)).set_priority(5))
    Program(match(A).foreach(system(A)), match(A).foreach(system(A)).set_post_frame())  # two plans


def test_order_is_stable():
    program = Program(match(A).foreach(system()), match(B).foreach(system(B)), match(A).foreach(system(A)), match(C).foreach(system(C)), match(B).foreach(system()))
    assert [t.index for t in program.tasks()] == [1, 2, 0, 3, 4]
    assert program.tasks()[2].parents == (2,) and not program.tasks()[0].requires_sync

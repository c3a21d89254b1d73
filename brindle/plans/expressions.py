"""The expressions of stage plans, and their Spark columns."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggregates, scalar
from ..types import aggregatable, comparable, spark_type


class Expr:
    """Base of all expressions; operators build comparisons and arithmetic."""

    def __add__(self, o):
        return Arith("+", self, as_expr(o))

    def __sub__(self, o):
        return Arith("-", self, as_expr(o))

    def __mul__(self, o):
        return Arith("*", self, as_expr(o))

    def __truediv__(self, o):
        return Arith("/", self, as_expr(o))

    def __mod__(self, o):
        return Arith("%", self, as_expr(o))

    def __pow__(self, o):
        return Arith("^", self, as_expr(o))

    def __gt__(self, o):
        return Compare(">", self, as_expr(o))

    def __ge__(self, o):
        return Compare(">=", self, as_expr(o))

    def __lt__(self, o):
        return Compare("<", self, as_expr(o))

    def __le__(self, o):
        return Compare("<=", self, as_expr(o))

    def eq(self, o):
        return Compare("=", self, as_expr(o))

    def ne(self, o):
        return Compare("<>", self, as_expr(o))

    def __and__(self, o):
        return Logical("and", self, as_expr(o))

    def __or__(self, o):
        return Logical("or", self, as_expr(o))

    def __invert__(self):
        return Not(self)


@dataclass(frozen=True)
class Col(Expr):
    name: str


@dataclass(frozen=True)
class Lit(Expr):
    value: Any
    type: Any = None


@dataclass(frozen=True)
class Arith(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Like(Expr):
    value: Expr
    pattern: str
    negated: bool = False


@dataclass(frozen=True)
class In(Expr):
    value: Expr
    options: tuple
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Expr):
    value: Expr
    negated: bool = False


@dataclass(frozen=True)
class Logical(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    value: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Case(Expr):
    """Branches (condition, value) in turn; a null condition isn't taken."""

    branches: tuple
    otherwise: Expr | None = None


@dataclass(frozen=True)
class Cast(Expr):
    """A value of another type, null where it can't be converted."""

    value: Expr
    type: Any


@dataclass(frozen=True)
class Subquery(Expr):
    """The single value of a one-column DataFrame."""

    plan: DataFrame


@dataclass(frozen=True)
class Aggregate(Expr):
    fn: str
    value: Expr | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Over(Expr):
    """A window function; ``spec`` is an operators.windows.WinSpec."""

    fn: str
    args: tuple
    spec: Any


@dataclass(frozen=True)
class Array(Expr):
    items: tuple


@dataclass(frozen=True)
class Struct(Expr):
    fields: tuple  # of (name, expression)


def as_expr(value: Any) -> Expr:
    return value if isinstance(value, Expr) else Lit(value)


def children(e: Expr) -> Iterator[Expr]:
    for f in dataclasses.fields(e):
        yield from _inside(getattr(e, f.name))


def _inside(value: Any) -> Iterator[Expr]:
    if isinstance(value, Expr):
        yield value
    elif isinstance(value, tuple):
        for v in value:
            yield from _inside(v)


def walk(e: Expr) -> Iterator[Expr]:
    yield e
    for c in children(e):
        yield from walk(c)


def columns(e: Expr) -> list[str]:
    """The names of the columns an expression reads, each once, in order."""
    return list(dict.fromkeys(x.name for x in walk(e) if isinstance(x, Col)))


def depth(e: Expr) -> int:
    return 1 + max(map(depth, children(e)), default=0)


def contains_aggregate(e: Expr) -> bool:
    return any(isinstance(x, Aggregate) for x in walk(e))


def transform(e: Expr, change: Callable[[Expr], Expr]) -> Expr:
    """The expression with ``change`` applied to every node, children first."""

    def within(value: Any) -> Any:
        if isinstance(value, Expr):
            return transform(value, change)
        return tuple(map(within, value)) if isinstance(value, tuple) else value

    return change(dataclasses.replace(e, **{f.name: within(getattr(e, f.name)) for f in dataclasses.fields(e)}))


def literal(value: Any, kind: Any = None) -> Column:
    column = F.lit(value)
    if kind is not None:
        column = column.cast(spark_type(kind))
    elif value is None:
        column = F.lit(None)
    if isinstance(value, str):
        column._brindle_literal = value
    return column


def infer(e: Expr, df: DataFrame) -> T.DataType:
    """The type of an expression over ``df``; unknown columns and impossible types raise."""
    return df.select(to_column(e, df).alias("x")).schema[0].dataType


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_ARITH = {"+": "add", "-": "subtract", "*": "multiply", "/": "divide", "%": "modulo", "^": "power"}


def _call(name: str, args: Sequence[Expr], df: DataFrame) -> Column:
    built = [to_column(a, df) for a in args]
    # types matter to division alone; asking the analyzer runs no job
    kinds = [infer(a, df) for a in args] if name == "divide" else []
    return scalar.REGISTRY.call(name, built, kinds)


def to_column(e: Any, df: DataFrame) -> Column:
    """The Spark column of an expression over ``df``; Spark columns and column names pass as they are."""
    if isinstance(e, Column):
        return e
    if isinstance(e, str):
        return F.col(e)
    match e:
        case Col(name):
            return F.col(name)
        case Lit(value, kind):
            return literal(value, kind)
        case Arith(op, a, b):
            return _call(_ARITH[op], (a, b), df)
        case Compare(op, a, b):
            ka, kb = infer(a, df), infer(b, df)
            if not comparable(ka, kb) and not (isinstance(a, Lit) or isinstance(b, Lit)):
                raise TypeError(f"{ka.simpleString()} and {kb.simpleString()} can't be compared")
            return _COMPARE[op](to_column(a, df), to_column(b, df))
        case Like(value, pattern, negated):
            found = to_column(value, df).like(pattern)
            return ~found if negated else found
        case In(value, options, negated):
            found = to_column(value, df).isin(*[to_column(as_expr(o), df) for o in options])
            return ~found if negated else found
        case IsNull(value, negated):
            column = to_column(value, df)
            return column.isNotNull() if negated else column.isNull()
        case Logical(op, a, b):
            a, b = to_column(a, df), to_column(b, df)
            return a & b if op == "and" else a | b
        case Not(value):
            return ~to_column(value, df)
        case Call(name, args):
            return _call(name.lower(), [as_expr(a) for a in args], df)
        case Case(branches, otherwise):
            column = None
            for when, then in branches:
                when, then = to_column(as_expr(when), df), to_column(as_expr(then), df)
                column = F.when(when, then) if column is None else column.when(when, then)
            return column if otherwise is None else column.otherwise(to_column(as_expr(otherwise), df))
        case Cast(value, kind):
            return to_column(value, df).try_cast(spark_type(kind))
        case Subquery(plan):
            return plan.scalar()
        case Aggregate(fn, value, distinct):
            if fn.lower() in ("sum", "avg") and value is not None and not aggregatable(infer(value, df)):
                raise TypeError(f"{fn} of {infer(value, df).simpleString()}")
            return aggregates.build(aggregates.Agg(fn, distinct=distinct), None if value is None else to_column(value, df), None)
        case Over(fn, args, spec):
            from ..operators.windows import WinFn, column_over

            return column_over(df, WinFn(fn, args, "x", spec))
        case Array(items):
            return F.array(*[to_column(as_expr(i), df) for i in items])
        case Struct(fields):
            return F.struct(*[to_column(as_expr(v), df).alias(n) for n, v in fields])
    raise TypeError(f"{e!r} is no expression")

"""Scalar functions by name.

A function takes Spark columns and the types of its arguments and gives a column.
All are null when an argument is. Division and modulo by zero are null; integer
division truncates and stays an integer; overflow raises (ANSI).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import is_integer, promoted

Builder = Callable[[Sequence[Column], Sequence[T.DataType]], Column]


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int | None
    build: Builder
    about: str = ""


class FunctionRegistry:
    """Functions by lower-case name; callers can add their own."""

    def __init__(self) -> None:
        self._found: dict[str, Function] = {}

    def register(self, name: str, build: Builder, least: int, most: int | None = -1, about: str = "") -> None:
        """``most`` is the same as ``least`` unless given; None means any number."""
        self._found[name.lower()] = Function(name.lower(), least, least if most == -1 else most, build, about)

    def get(self, name: str) -> Function:
        try:
            return self._found[name.lower()]
        except KeyError:
            raise KeyError(f"there is no function {name!r}") from None

    def names(self) -> list[str]:
        return sorted(self._found)

    def call(self, name: str, args: Sequence[Column], kinds: Sequence[T.DataType]) -> Column:
        f = self.get(name)
        if len(args) < f.least or (f.most is not None and len(args) > f.most):
            raise TypeError(f"{name} takes {f.least}{'' if f.most == f.least else f' to {f.most}' if f.most else ' or more'} arguments, not {len(args)}")
        return f.build(args, kinds)


def divide(a: Column, b: Column, ka: T.DataType, kb: T.DataType) -> Column:
    if is_integer(ka) and is_integer(kb):
        # div gives a bigint and raises on 0
        safe = F.when(b != 0, b)
        return F.call_function("div", a, safe).cast(promoted(ka, kb))
    return F.try_divide(a, b)


def modulo(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def ln(x: Column) -> Column:
    """Minus infinity at 0 and NaN below, where Spark's own is null."""
    x = x.cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def substring(s: Column, start: Column, length: Column) -> Column:
    """By characters from 1; a start of 0 or less is 1; past the end is empty."""
    return F.substring(s, F.greatest(start, F.lit(1)), F.greatest(length, F.lit(0)))


def trim(s: Column) -> Column:
    """Strips all Unicode white space, not spaces alone."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def regex_match(s: Column, pattern: Column, literal: str | None = None) -> Column:
    """Whether the pattern is found anywhere; a bad literal pattern matches nothing."""
    if literal is not None:
        try:
            re.compile(literal)
        except re.error:
            return F.when(s.isNotNull(), F.lit(False))
    return F.rlike(s, pattern)


EXTRACTED = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "dow": lambda d: F.dayofweek(d) - 1,  # Sunday is 0
    "doy": F.dayofyear,
}
#: The formats that dates are written in; any other is ISO.
FORMATS = {"YYYY-MM-DD": "yyyy-MM-dd", "MM/DD/YYYY": "MM/dd/yyyy", "DD-MM-YYYY": "dd-MM-yyyy"}


def extract(part: str, day: Column) -> Column:
    if part.lower() not in EXTRACTED:
        raise ValueError(f"dates have no {part!r}; known are {', '.join(EXTRACTED)}")
    return EXTRACTED[part.lower()](day)


def format_date(form: str, day: Column) -> Column:
    return F.date_format(day, FORMATS.get(form, "yyyy-MM-dd"))


def _literal(column: Column) -> str | None:
    """The text of a string literal column, else None."""
    text = getattr(column, "_brindle_literal", None)
    return text if isinstance(text, str) else None


def _needed(column: Column, what: str) -> str:
    text = _literal(column)
    if text is None:
        raise TypeError(f"{what} must be a string literal")
    return text


def default_registry() -> FunctionRegistry:
    r = FunctionRegistry()

    def one(name: str, f: Callable[[Column], Column]) -> None:
        r.register(name, lambda a, _: f(a[0]), 1)

    def two(name: str, f: Callable[[Column, Column], Column]) -> None:
        r.register(name, lambda a, _: f(a[0], a[1]), 2)

    two("add", lambda a, b: a + b)
    two("subtract", lambda a, b: a - b)
    two("multiply", lambda a, b: a * b)
    r.register("divide", lambda a, k: divide(a[0], a[1], k[0], k[1]), 2)
    two("modulo", modulo)
    two("power", lambda a, b: F.pow(a, b))
    one("abs", F.abs)
    for name, f in (("sqrt", F.sqrt), ("sin", F.sin), ("cos", F.cos), ("exp", F.exp), ("ln", ln)):
        one(name, f)
    two("equal", lambda a, b: a == b)
    two("not_equal", lambda a, b: a != b)
    two("less_than", lambda a, b: a < b)
    two("less_than_or_equal", lambda a, b: a <= b)
    two("greater_than", lambda a, b: a > b)
    two("greater_than_or_equal", lambda a, b: a >= b)
    two("and", lambda a, b: a & b)
    two("or", lambda a, b: a | b)
    one("not", lambda a: ~a)
    r.register("concat", lambda a, _: F.concat(*a), 1, None)
    r.register("substring", lambda a, _: substring(*a), 3)
    one("length", F.octet_length)  # bytes
    one("upper", F.upper)
    one("lower", F.lower)
    one("trim", trim)
    r.register("replace", lambda a, _: F.replace(*a), 3)
    r.register("regex_match", lambda a, _: regex_match(a[0], a[1], _literal(a[1])), 2)
    r.register("current_date", lambda a, _: F.current_date(), 0)
    r.register("current_time", lambda a, _: F.current_time(), 0)
    r.register("current_timestamp", lambda a, _: F.localtimestamp(), 0)
    two("date_add", F.date_add)
    two("date_sub", F.date_sub)
    two("date_diff", lambda a, b: F.datediff(b, a))  # second less first
    r.register("extract", lambda a, _: extract(_needed(a[0], "the part"), a[1]), 2)
    r.register("format_date", lambda a, _: format_date(_needed(a[0], "the format"), a[1]), 2)
    return r


REGISTRY = default_registry()


def register_udf(name: str, udf: Callable[..., Column], args: int) -> None:
    """Adds a Spark UDF, best a pandas_udf or arrow_udf, as a function of plans."""
    REGISTRY.register(name, lambda a, _: udf(*a), args)

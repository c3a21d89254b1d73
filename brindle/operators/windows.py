"""Window functions over ROWS, RANGE and GROUPS frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.expressions import Lit, to_column
from .aggregate import unused
from .ordering import Key, sort_columns

UNBOUNDED = None
_GROUP = "_peer_group"


@dataclass(frozen=True)
class Frame:
    """From ``start`` to ``end`` rows, values or peer groups from the current one; None is unbounded."""

    kind: str = "range"
    start: int | float | None = UNBOUNDED
    end: int | float | None = 0


@dataclass(frozen=True)
class WinSpec:
    partition_by: tuple = ()
    order_by: tuple = ()
    frame: Frame | None = None


@dataclass(frozen=True)
class WinFn:
    fn: str
    args: tuple = ()
    alias: str = "w"
    spec: WinSpec = field(default_factory=WinSpec)


@dataclass(frozen=True)
class FrameFunction:
    """A caller's own function of frames: from the arguments' values (a numpy array each, nulls being NaN in numbers) and
    two arrays with the first and behind the last place of each row's frame to an array of SQL type ``result``, NaN being null.

    It gets the frames of many rows at once, so Python isn't entered for each row.
    """

    fn: Callable[..., Any]
    result: str = "double"


_CUSTOM: dict[str, Callable[..., Column] | FrameFunction] = {}


def register_window(name: str, build: Callable[..., Column] | FrameFunction) -> None:
    """Adds a function for windows: from argument columns to a column that can go over a window, or a function of frames.

    Spark enters Python once a row for a grouped-agg pandas UDF over a window; functions of frames don't have that cost.
    """
    _CUSTOM[name.lower()] = build


def fold_frames(fold: np.ufunc, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The values of each frame put together by numpy's ``fold``, NaN for an empty frame; fmax, fmin pass over nulls."""
    out, full = np.full(len(starts), np.nan), ends > starts
    # reduceat folds from each place up to the next one, and places may be up to the last
    places = np.column_stack([starts[full], ends[full]]).ravel()
    out[full] = fold.reduceat(np.append(values.astype(float), np.nan), places)[::2]
    return out


def _bound(value: int | float | None, unbounded: int) -> int | float:
    return unbounded if value is None else value


def _window(spec: WinSpec, order: Sequence[Column]):
    w = Window.partitionBy(*spec.partition_by)
    if order:
        w = w.orderBy(*order)
    if spec.frame:
        start, end = _bound(spec.frame.start, Window.unboundedPreceding), _bound(spec.frame.end, Window.unboundedFollowing)
        w = w.rowsBetween(start, end) if spec.frame.kind == "rows" else w.rangeBetween(start, end)
    return w


def column_over(df: DataFrame, f: WinFn) -> Column:
    """The column of a function over ROWS or RANGE frames; GROUPS frames need ``window``."""
    if f.spec.frame and f.spec.frame.kind == "groups":
        raise ValueError("GROUPS frames go through window()")
    if isinstance(_CUSTOM.get(f.fn.lower()), FrameFunction):
        raise ValueError("functions of frames go through window()")
    return _function(df, f).over(_window(f.spec, sort_columns(f.spec.order_by)))


def _value(arg: Any) -> Any:
    return arg.value if isinstance(arg, Lit) else arg


def _function(df: DataFrame, f: WinFn) -> Column:
    fn, args = f.fn.lower(), f.args
    x = to_column(args[0], df) if args and not isinstance(args[0], int) else None
    ranks: dict[str, Callable[[], Column]] = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}
    values: dict[str, Callable[[], Column]] = {
        "lead": lambda: F.lead(x, *map(_value, args[1:])),
        "lag": lambda: F.lag(x, *map(_value, args[1:])),
        "first_value": lambda: F.first_value(x),
        "last_value": lambda: F.last_value(x),
        "nth_value": lambda: F.nth_value(x, _value(args[1])),
        "ntile": lambda: F.ntile(_value(args[0])),
        "sum": lambda: F.sum(x),
        "avg": lambda: F.avg(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "count": lambda: F.count(F.lit(1) if x is None else x),
    }
    if fn in ranks:
        return ranks[fn]()
    if fn in values:
        return values[fn]()
    if fn in _CUSTOM:
        return _CUSTOM[fn](*[to_column(a, df) for a in args])
    raise KeyError(f"there is no window function {f.fn!r}")


def window(df: DataFrame, functions: Sequence[WinFn]) -> DataFrame:
    """All columns and one for each function.

    Spark has no GROUPS frames: peers are numbered by dense_rank, and the frame is a
    RANGE over that number. Functions over the same partition and order share a sort.
    """
    names = df.columns
    for f in functions:
        if isinstance(own := _CUSTOM.get(f.fn.lower()), FrameFunction):
            df = _over_frames(df, f, own)
        elif f.spec.frame and f.spec.frame.kind == "groups":
            peers = Window.partitionBy(*f.spec.partition_by).orderBy(*sort_columns(f.spec.order_by))
            df = df.withColumn(_GROUP, F.dense_rank().over(peers))
            spec = WinSpec(f.spec.partition_by, (), Frame("range", f.spec.frame.start, f.spec.frame.end))
            df = df.withColumn(f.alias, _function(df, f).over(_window(spec, [F.col(_GROUP).asc()]))).drop(_GROUP)
        else:
            df = df.withColumn(f.alias, column_over(df, f))
    return df.select(*names, *[f.alias for f in functions])


def _ends(df: DataFrame, spec: WinSpec, at: str) -> tuple[Column, Column]:
    """Numbers, as in ``at``, of the first and the last row of each row's frame; a frame without rows ends before it begins."""
    frame, keys = spec.frame or Frame(end=0 if spec.order_by else UNBOUNDED), sort_columns(spec.order_by)
    rows, place = F.count(F.lit(1)).over(Window.partitionBy(*spec.partition_by)), F.col(at).cast("long")
    if frame.kind == "rows":
        low = F.lit(1) if frame.start is None else F.greatest(F.lit(1), place + frame.start)
        return low, rows if frame.end is None else F.least(rows, place + frame.end) if frame.end > 0 else place + frame.end
    if frame.kind == "groups":
        keys = [F.col(_GROUP).asc()]
    over = lambda start, end: _window(WinSpec(spec.partition_by, (), Frame("range", start, end)), keys)
    # a frame open at the end is slow in Spark, and up to the current row it begins at the same row
    low = F.lit(1) if frame.start is None else F.min(at).over(over(frame.start, 0 if frame.end is None and frame.start <= 0 else frame.end))
    high = rows if frame.end is None else F.max(at).over(over(frame.start, frame.end))
    return F.coalesce(low, rows + 1 if frame.end is None else F.lit(1)), F.coalesce(high, F.lit(0))


def _over_frames(df: DataFrame, f: WinFn, own: FrameFunction) -> DataFrame:
    """The table with a function of frames as a last column.

    Spark numbers the rows of a partition and of the frames' ends; a task then goes once
    through its rows as they come and holds those that a frame may still reach.
    """
    at, low, high = (unused(c, df) for c in ("_at", "_low", "_high"))
    args = [unused(f"_arg{i}", df) for i in range(len(f.args))]
    kept = [c for c in df.schema.fields if c.name.lower() != f.alias.lower()]
    kind = T.DataType.fromDDL(own.result)
    peers = Window.partitionBy(*f.spec.partition_by).orderBy(*(sort_columns(f.spec.order_by) or [F.lit(1)]))
    rows = df.withColumns({a: to_column(x, df) for a, x in zip(args, f.args, strict=True)} | {at: F.row_number().over(peers)})
    groups = f.spec.frame is not None and f.spec.frame.kind == "groups"
    if groups:
        rows = rows.withColumn(_GROUP, F.dense_rank().over(peers))
    first, last = _ends(rows, f.spec, at)
    rows = rows.withColumns({low: first.cast("long"), high: last.cast("long")})
    if groups:
        rows = rows.sortWithinPartitions(*f.spec.partition_by, at)
    names = [c.name for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        held: list[pa.RecordBatch] = []
        size = done = wait = 0  # rows held, those of them that are out, and how many are to be held before the next look

        def look() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, done, wait
            table = pa.Table.from_batches(held)
            place, start, end = (table[c].to_numpy().astype(np.int64) for c in (at, low, high))
            if not ((place[1:] == place[:-1] + 1) | (place[1:] == 1)).all():
                raise RuntimeError("rows of a window don't come in its order")
            base = np.arange(size) - place  # the place before the partition's first row, which may be gone
            starts, ends = base + start, base + end + 1
            none = start > end
            open_ = np.flatnonzero(~none[done:] & (ends[done:] > size))
            stop = done + int(open_[0]) if len(open_) else size
            if stop > done:
                values = [table[a].to_numpy() for a in args]
                got = own.fn(*values, np.where(none, 0, starts)[done:stop], np.where(none, 0, ends)[done:stop])
                out = table.select(names).slice(done, stop - done).append_column(f.alias, pa.array(got, to_arrow_type(kind), from_pandas=True))
                yield from out.combine_chunks().to_batches()
            # frames begin later from row to row
            keep = max(0, min(stop, int(starts[stop:].min(initial=size)), int(starts[-1])))
            wait = 2 * size if stop == done else 0
            held, size, done = table.slice(keep).to_batches(), size - keep, stop - keep

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= wait:
                    yield from look()
        if size > done:
            yield from look()
        if size > done:
            raise RuntimeError("rows of a window lie in several tasks")

    return rows.select(*names, *args, at, low, high).mapInArrow(run, T.StructType([*kept, T.StructField(f.alias, kind)]))


def order(*keys: Key | str) -> tuple:
    return tuple(k if isinstance(k, Key) else Key(k) for k in keys)

"""Operators that depend on the order along a dimension: fills, ranks, shifts, moving windows, top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.axes import numbered
from gridloom.tensor import POS, Tensor, along

__all__ = ["MOVING", "cumulative_on_sort", "ffill", "map_along_axis", "multi_rank", "rank", "rolling", "rolling_overlap", "rolling_rows", "shift_on_valid", "topk_mask"]

_U = Window.unboundedPreceding


def _by(extra) -> list[Column]:
    return [F.col(c) for c in extra]


def _back(t: Tensor, df: DataFrame, out: dict[str, Column]) -> Tensor:
    return t.using(df.select(*t.dims, *[c.alias(v) for v, c in out.items()]))


def ffill(t: Tensor, dim: str, limit: int | None = None, until_last_valid: bool | Tensor = False, by=()) -> Tensor:
    """Carry valid cells forward over at most ``limit`` missing ones.

    With ``until_last_valid`` nothing is carried past the last valid label of a series; a tensor gives the
    last label of each series instead.
    """
    d = t.dense()
    df, o = d.ordered(dim)
    w = along(t, dim, *_by(by)).orderBy(o)
    whole = along(t, dim, *_by(by))
    if isinstance(until_last_valid, Tensor):
        cut = until_last_valid.rename(**{until_last_valid.value: "__cut"})
        df = df.join(cut.df, list(cut.dims), "left")
    out = {}
    for v in t.vars:
        filled = F.last(F.col(v), ignorenulls=True).over(w.rowsBetween(_U if limit is None else -limit, 0))
        if isinstance(until_last_valid, Tensor):
            filled = F.when(F.col(dim) <= F.col("__cut"), filled)
        elif until_last_valid:
            filled = F.when(o <= F.max(F.when(F.col(v).isNotNull(), o)).over(whole), filled)
        out[v] = filled
    return _back(d, df, out)


def rank(t: Tensor, dim: str, method: str = "average", ascending: bool = True, nan_policy: str = "omit", by=()) -> Tensor:
    """Rank of each valid cell in its series, as double: average, min, max, dense or ordinal.

    Missing cells stay missing; ``nan_policy='propagate'`` makes a series missing that has one, and
    ``'error'`` raises. Ordinal ties go by position, in both directions.
    """
    if method not in ("average", "min", "max", "dense", "ordinal"):
        raise ValueError(f"method {method!r}")
    source = t if nan_policy == "omit" else t.dense()
    if nan_policy == "error" and not source.df.where(" or ".join(f"{v} is null" for v in t.vars)).isEmpty():
        raise ValueError("the tensor has missing cells")
    df, o = source.ordered(dim)
    out = {}
    for v in t.vars:
        c = F.col(v)
        valid = c.isNull()
        order = c.asc() if ascending else c.desc()
        w = along(t, dim, *_by(by), valid).orderBy(order)
        ties = F.count(F.lit(1)).over(along(t, dim, *_by(by), c))
        r = {
            "min": lambda: F.rank().over(w),
            "max": lambda: F.rank().over(w) + ties - 1,
            "average": lambda: F.rank().over(w) + (ties - 1) / 2,
            "dense": lambda: F.dense_rank().over(w),
            "ordinal": lambda: F.row_number().over(along(t, dim, *_by(by), valid).orderBy(order, o)),
        }[method]()
        r = F.when(c.isNotNull(), r.cast("double"))
        if nan_policy == "propagate":
            r = F.when(F.max(valid.cast("int")).over(along(t, dim, *_by(by))) == 0, r)
        out[v] = r
    return _back(source, df, out)


def _pivoted(t: Tensor, tie_dim: str) -> tuple[DataFrame, list[str], list]:
    """Cells of the labels of ``tie_dim`` (few: they become columns) side by side."""
    labels = t.labels(tie_dim)
    keep = t.others(tie_dim)
    columns = [f"__v{i}" for i in range(len(labels))]
    picks = [F.max(F.when(F.col(tie_dim).eqNullSafe(F.lit(x)), F.col(t.value))).alias(c) for x, c in zip(labels, columns)]
    return t.df.groupBy(*keep).agg(*picks), columns, labels


def _spread(t: Tensor, df: DataFrame, tie_dim: str, labels: list, value: Column) -> Tensor:
    """The same result on every label of ``tie_dim``."""
    table = F.explode(F.array(*[F.lit(x) for x in labels]).cast(f"array<{t.df.schema[tie_dim].dataType.simpleString()}>"))
    return t.using(df.select(*t.others(tie_dim), table.alias(tie_dim), value.alias(t.value)))


def multi_rank(t: Tensor, tie_dim: str, dim: str) -> Tensor:
    """Ordinal rank along ``dim`` by the cells of ``tie_dim`` in turn, the first label first; remaining
    ties by position. Missing in the first: missing; missing in a later one: last."""
    df, columns, labels = _pivoted(t, tie_dim)
    wide = Tensor(df, tuple(t.others(tie_dim)), tuple(columns), {d: c for d, c in t.coords.items() if d != tie_dim})
    df, o = wide.ordered(dim)
    first = F.col(columns[0])
    if not wide.others(dim):  # one series: its axis is cut into ranges
        key = F.struct(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))], o)
        df = numbered(df, key, "__place").withColumn("__r", F.when(first.isNotNull(), (F.col("__place") + 1).cast("double")))
        return _spread(t, df, tie_dim, labels, F.col("__r"))
    w = Window.partitionBy(*[F.col(d) for d in wide.others(dim)], first.isNull()).orderBy(*[F.col(c).asc_nulls_last() for c in columns], o)
    r = F.when(first.isNotNull(), F.row_number().over(w).cast("double"))
    return _spread(t, df.withColumn("__r", r), tie_dim, labels, F.col("__r"))


def shift_on_valid(t: Tensor, dim: str, shift: int, by=()) -> Tensor:
    """Shift among the valid cells of a series; missing cells stay where they are. Negative: backwards."""
    df, o = t.ordered(dim)
    out = {}
    for v in t.vars:
        c = F.col(v)
        w = along(t, dim, *_by(by), c.isNull()).orderBy(o)
        out[v] = F.when(c.isNotNull(), F.lag(c, shift).over(w)) if shift else c
    return _back(t, df, out)


def _position(c: Column, w, best: Column) -> Column:
    """Cells back from the newest to the one that holds ``best``; of equal ones the newest."""
    cells = F.transform(F.reverse(F.collect_list(F.struct(c.alias("v"))).over(w)), lambda x: x["v"])
    return (F.array_position(cells, best) - 1).cast("double")


def _place(c: Column, w) -> Column:
    """Rank of the newest cell in the window, from -1 to 1; ties share their mean."""
    cells = F.collect_list(c).over(w)
    less = F.size(F.filter(cells, lambda x: x < c))
    same = F.size(F.filter(cells, lambda x: x == c))
    n = F.size(cells)
    return F.when(c.isNotNull(), F.when(n > 1, 2.0 * (less + (same - 1) / 2) / (n - 1) - 1).otherwise(F.lit(0.0)))


#: Moving functions: (column, window) -> column. Standard deviation and variance divide by n.
MOVING: dict[str, Callable] = {
    "sum": lambda c, w: F.sum(c).over(w),
    "mean": lambda c, w: F.avg(c).over(w),
    "std": lambda c, w: F.stddev_pop(c).over(w),
    "var": lambda c, w: F.var_pop(c).over(w),
    "min": lambda c, w: F.min(c).over(w),
    "max": lambda c, w: F.max(c).over(w),
    "median": lambda c, w: F.percentile(c, F.lit(0.5)).over(w),
    "argmin": lambda c, w: _position(c, w, F.min(c).over(w)),
    "argmax": lambda c, w: _position(c, w, F.max(c).over(w)),
    "rank": _place,
    "count": lambda c, w: F.count(c).over(w),
    "prod": lambda c, w: F.product(c).over(w),
}


def rolling(t: Tensor, dim: str, window: int, operator: str | Callable = "mean", min_periods: int | None = None, drop_nan: bool = True, fill_method: str | None = None, by=()) -> Tensor:
    """A moving function of the last ``window`` cells.

    ``drop_nan``: the window counts valid cells and results stand at valid cells, after which
    ``fill_method='ffill'`` may carry them on. Otherwise it counts positions, skips missing cells, and a
    result stands wherever enough are valid.
    """
    if window < 1:
        raise ValueError("window must be positive")
    if fill_method not in (None, "ffill"):
        raise ValueError(f"fill_method {fill_method!r}")
    f = MOVING[operator] if isinstance(operator, str) else operator
    least = window if min_periods is None else min_periods
    source = t if drop_nan else t.dense()
    df, o = source.ordered(dim)
    out = {}
    for v in t.vars:
        c = F.col(v).cast("double")
        if drop_nan:
            w = along(t, dim, *_by(by), c.isNull()).orderBy(o).rowsBetween(1 - window, 0)
            out[v] = F.when(c.isNotNull() & (F.count(c).over(w) >= least), f(c, w))
        else:
            w = along(t, dim, *_by(by)).orderBy(o).rowsBetween(1 - window, 0)
            out[v] = F.when((F.count(c).over(w) >= least) & (F.count(c).over(w) > 0), f(c, w))
    result = _back(source, df, out)
    return ffill(result, dim, by=by) if fill_method and drop_nan else result


def rolling_rows(t: Tensor, dim: str, window: int, operator: str = "sum") -> Tensor:
    """Moving function in formulas: a missing cell in the window makes the result missing."""
    return rolling(t, dim, window, operator, min_periods=window, drop_nan=False)


def rolling_overlap(t: Tensor, dim: str, window: int, operator: str | Callable = "mean", window_margin: int | None = None, min_periods: int | None = None, apply_ffill: bool = True) -> Tensor:
    """A moving function over valid cells, carried forward on request.

    A margin between blocks is accepted and not needed: a series is never cut, so results are exact.
    """
    if window_margin is not None and not window_margin >= window > 0:
        raise ValueError("window_margin must be at least the window")
    return rolling(t, dim, window, operator, min_periods, drop_nan=True, fill_method="ffill" if apply_ffill else None)


_CUMULATIVE = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min, "count": F.count, "mean": F.avg}


def cumulative_on_sort(t: Tensor, dim: str, func: str | Callable = "sum", ascending: bool = False, keep_nan: bool = True, by=()) -> Tensor:
    """Cumulate a series in the order of its values (ties by position), each result at its cell's place.

    ``keep_nan=False`` gives missing cells, which come last, the value cumulated so far.
    """
    name = func.removeprefix("nan").removeprefix("cum") if isinstance(func, str) else None
    f = (lambda c, w: _CUMULATIVE[name](c).over(w)) if name else func
    source = t if keep_nan else t.dense()
    df, o = source.ordered(dim)
    out = {}
    for v in t.vars:
        c = F.col(v)
        w = along(t, dim, *_by(by)).orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), o).rowsBetween(_U, 0)
        out[v] = F.when(c.isNotNull(), f(c, w)) if keep_nan else f(c, w)
    return _back(source, df, out)


def topk_mask(t: Tensor, dim: str, k: int, tie_breaker_dim: str | None = None, only_true: bool = False, by=()) -> Tensor:
    """True where a valid cell is at least the k-th largest of its series; ties may exceed k.

    With ``tie_breaker_dim`` the cells of its labels are compared in turn, and the result is the same on
    each. ``only_true`` returns the true cells alone, so that the plan can drop rows early.
    """
    if tie_breaker_dim is None:
        order = lambda v: F.col(v).desc_nulls_last()
        r = {v: (F.rank().over(along(t, dim, *_by(by)).orderBy(order(v))) <= k) & F.col(v).isNotNull() for v in t.vars}
        if only_true:
            v = t.value
            top = t.df.withColumn("__r", F.rank().over(along(t, dim, *_by(by)).orderBy(order(v)))).where(F.col("__r") <= k)
            return t.using(top.where(F.col(v).isNotNull()).select(*t.dims, F.lit(True).alias(v)))
        return _back(t, t.df, r)
    df, columns, labels = _pivoted(t, tie_breaker_dim)
    series = [F.col(d) for d in t.dims if d not in (dim, tie_breaker_dim)]
    if series:
        w = Window.partitionBy(*series).orderBy(*[F.col(c).desc_nulls_last() for c in columns])
        df = df.withColumn("__t", (F.rank().over(w) <= k) & F.col(columns[0]).isNotNull())
    else:  # one series: compared with its k-th largest, which a distributed top-k finds
        key = F.struct(*columns)  # in structs a null is below everything
        least = df.select(key.alias("__k")).orderBy(F.desc("__k")).limit(k).agg(F.min("__k").alias("__least"))
        df = df.crossJoin(F.broadcast(least)).withColumn("__t", F.coalesce(key >= F.col("__least"), F.lit(False)) & F.col(columns[0]).isNotNull())
    return _spread(t, df.where("__t") if only_true else df, tie_breaker_dim, labels, F.col("__t"))


def map_along_axis(t: Tensor, dim: str, func: Callable, dtype: str = "double") -> Tensor:
    """Any function of a whole series: it gets a pandas Series in order and returns as many values.

    The last resort for what no expression can say; each series must fit one task.
    """
    df, o = t.dense().ordered(dim)
    rows = df.select(*t.dims, *t.vars, o.alias("__o"))
    vars_, dims = t.vars, t.dims

    def run(pdf):
        pdf = pdf.sort_values("__o")
        for v in vars_:
            pdf[v] = list(func(pdf[v]))
        return pdf[[*dims, *vars_]]

    schema = ", ".join([*(f"{d} {t.df.schema[d].dataType.simpleString()}" for d in dims), *(f"{v} {dtype}" for v in vars_)])
    return t.using(rows.groupBy(*t.others(dim)).applyInPandas(run, schema))

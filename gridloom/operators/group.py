"""Operators over groups of labels: reductions, transformations within groups, duplicate merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import window as _window
from gridloom.tensor import Tensor

__all__ = ["AGGREGATES", "apply_on_groups", "merge_duplicates", "reduce_dims"]


def _end(pick: Callable):
    """first or last valid cell by position"""
    return lambda c, o: pick(c, F.when(c.isNotNull(), o))


#: Reductions (column, order) -> column; missing cells are skipped. Of nothing, a sum is 0 and a product 1.
AGGREGATES: dict[str, Callable] = {
    "sum": lambda c, o: F.coalesce(F.sum(c), F.lit(0)),
    "prod": lambda c, o: F.coalesce(F.product(c), F.lit(1.0)),
    "mean": lambda c, o: F.avg(c),
    "max": lambda c, o: F.max(c),
    "min": lambda c, o: F.min(c),
    "count": lambda c, o: F.count(c),
    "std": lambda c, o: F.stddev_pop(c),
    "var": lambda c, o: F.var_pop(c),
    "median": lambda c, o: F.percentile(c, F.lit(0.5)),
    "first": _end(F.min_by),
    "last": _end(F.max_by),
    "any": lambda c, o: F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False)),
    "all": lambda c, o: F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True)),
    "nunique": lambda c, o: F.count_distinct(c),
    "approx_nunique": lambda c, o: F.approx_count_distinct(c),
}


def _aggregate(func: str | Callable, c: Column, o: Column, kwargs: dict) -> Column:
    if func == "quantile":
        return F.percentile(c, F.lit(kwargs["q"]))
    return AGGREGATES[func](c, o) if isinstance(func, str) else func(c, **kwargs)


def reduce_dims(t: Tensor, func: str | Callable = "sum", dims=None, **kwargs) -> Tensor:
    """Reduce the given dimensions (all by default) to one cell each."""
    gone = [dims] if isinstance(dims, str) else list(dims or t.dims)
    keep = [d for d in t.dims if d not in gone]
    df, o = t.ordered(gone[0]) if len(gone) == 1 else (t.df, F.lit(0))
    out = df.groupBy(*keep).agg(*[_aggregate(func, F.col(v), o, kwargs).alias(v) for v in t.vars])
    return Tensor(out, tuple(keep), t.vars, {d: c for d, c in t.coords.items() if d in keep})


def _table(t: Tensor, groups, dim: str) -> tuple[DataFrame, list[str]]:
    """(label columns..., __group) and the columns to join on."""
    if isinstance(groups, Tensor):
        if not set(groups.dims) <= set(t.dims) or dim not in groups.dims:
            raise ValueError("the groups' dimensions must be among the tensor's")
        return groups.df.select(*groups.dims, F.col(groups.value).alias("__group")), list(groups.dims)
    if isinstance(groups, dict):
        kind = t.df.schema[dim].dataType.simpleString()
        value = "string" if any(isinstance(g, str) for g in groups.values()) else "long" if all(isinstance(g, int) for g in groups.values()) else "double"
        rows = [(k, float(v) if value == "double" else v) for k, v in groups.items()]
        return F.broadcast(t.spark.createDataFrame(rows, f"{dim} {kind}, __group {value}")), [dim]  # came from the driver: small
    label, group = groups.columns[:2]
    return groups.select(F.col(label).alias(dim), F.col(group).alias("__group")), [dim]


def apply_on_groups(t: Tensor, groups, dim: str, func: str | Callable, keep_shape: bool = False, unique_groups=None, template: str | None = None, **kwargs) -> Tensor:
    """Group labels of ``dim`` (a dict, a table of label and group, or a tensor of groups) and apply a function.

    A reduction gives one label for each group; with ``keep_shape`` every member cell gets its group's
    result. A name of an order-dependent operator (rank, ffill, rolling, ...) works within each group and
    keeps the shape. A callable gets the column (or, with ``template``, a dict of all variables' columns)
    and returns an aggregate. Groups of a tensor hold for each combination of the other labels apart; with
    ``unique_groups`` the result has a row for each of them, missing where a series lacks the group.
    """
    table, on = _table(t, groups, dim)
    ordered_ops = {"rank": _window.rank, "ffill": _window.ffill, "rolling": _window.rolling, "shift_on_valid": _window.shift_on_valid, "cumulative_on_sort": _window.cumulative_on_sort, "topk_mask": _window.topk_mask}
    if isinstance(func, str) and func in ordered_ops:
        source = t.dense() if func == "ffill" else t
        grouped = Tensor(source.df.join(table, on), t.dims, t.vars, t.coords)
        if func == "ffill":  # the grid is dense already; the group column must survive it
            return _grouped_ffill(grouped, dim, **kwargs)
        return ordered_ops[func](grouped, dim, by=["__group"], **kwargs)
    others = t.others(dim)
    source = t.dense() if keep_shape else t
    df, o = source.ordered(dim)
    df = df.join(table, on)
    if template:
        results = {template: lambda: func({v: F.col(v) for v in t.vars}, **kwargs)}
    else:
        results = {v: (lambda v=v: _aggregate(func, F.col(v), o, kwargs)) for v in t.vars}
    vars_ = tuple(results)
    if keep_shape:
        if isinstance(func, str):
            w = Window.partitionBy(*others, "__group")
            over = {v: _over(func, F.col(v), w, o, kwargs) for v in vars_}
            return t.using(df.select(*t.dims, *[c.alias(v) for v, c in over.items()]), vars=vars_)
        reduced = df.groupBy(*others, "__group").agg(*[f().alias(f"__r_{v}") for v, f in results.items()])
        # the same keys on both sides, null groups too
        on_keys = [df[k].eqNullSafe(reduced[k]) for k in [*others, "__group"]]
        joined = df.join(reduced, on_keys)
        return t.using(joined.select(*[df[d] for d in t.dims], *[reduced[f"__r_{v}"].alias(v) for v in vars_]), vars=vars_)
    out = df.groupBy(*others, "__group").agg(*[f().alias(v) for v, f in results.items()])
    if unique_groups is not None:
        wanted = unique_groups if isinstance(unique_groups, DataFrame) else table.select("__group").distinct()
        frame = wanted.select(F.col(wanted.columns[0]).alias("__group"))
        for d in others:
            frame = frame.crossJoin(t.axis(d).select(d))
        out = frame.join(out, [*others, "__group"], "left")
    out = out.withColumnRenamed("__group", dim)
    return Tensor(out.select(*t.dims, *vars_), t.dims, vars_, {d: c for d, c in t.coords.items() if d != dim})


def _over(func: str, c: Column, w, o: Column, kwargs: dict) -> Column:
    plain = {"sum": lambda: F.coalesce(F.sum(c).over(w), F.lit(0)), "prod": lambda: F.coalesce(F.product(c).over(w), F.lit(1.0)), "mean": lambda: F.avg(c).over(w), "max": lambda: F.max(c).over(w), "min": lambda: F.min(c).over(w), "count": lambda: F.count(c).over(w), "std": lambda: F.stddev_pop(c).over(w), "var": lambda: F.var_pop(c).over(w), "median": lambda: F.percentile(c, F.lit(0.5)).over(w), "first": lambda: F.min_by(c, F.when(c.isNotNull(), o)).over(w), "last": lambda: F.max_by(c, F.when(c.isNotNull(), o)).over(w), "nunique": lambda: F.size(F.collect_set(c).over(w)).cast("long"), "approx_nunique": lambda: F.approx_count_distinct(c).over(w), "any": lambda: F.coalesce(F.bool_or(c.cast("boolean")).over(w), F.lit(False)), "all": lambda: F.coalesce(F.bool_and(c.cast("boolean")).over(w), F.lit(True))}
    if func == "quantile":
        return F.percentile(c, F.lit(kwargs["q"])).over(w)
    return plain[func]()


def _grouped_ffill(t: Tensor, dim: str, limit: int | None = None) -> Tensor:
    df, o = t.ordered(dim)
    w = Window.partitionBy(*[F.col(d) for d in t.others(dim)], "__group").orderBy(o).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return t.using(df.select(*t.dims, *[F.last(F.col(v), ignorenulls=True).over(w).alias(v) for v in t.vars]))


def merge_duplicates(t: Tensor, func: str | Callable = "sum", dims=None, **kwargs) -> Tensor:
    """One cell for all that share every label. Labels may repeat in ``t.df`` until then."""
    df, o = t.ordered(dims) if isinstance(dims, str) else (t.df, F.lit(0))
    out = df.groupBy(*t.dims).agg(*[_aggregate(func, F.col(v), o, kwargs).alias(v) for v in t.vars])
    coords = {d: c.groupBy(d).agg(F.min("pos").alias("pos")) if "pos" in c.columns else c.select(d).distinct() for d, c in t.coords.items()}
    return t.using(out, coords=coords)

"""Operators that choose, map and rearrange labels and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.axes import latest, numbered
from gridloom.tensor import Tensor

__all__ = ["coordinates", "drop_labels", "drop_unmarked", "dropna", "fillna", "isel", "isin", "last_valid_label", "reindex", "replace_values", "sel", "take", "unique_values"]


def coordinates(spark, dim: str, labels: list, kind: str) -> DataFrame:
    """A coordinate table from labels in order."""
    return spark.createDataFrame([(x, i) for i, x in enumerate(labels)], f"{dim} {kind}, pos long")


def _requested(t: Tensor, dim: str, labels) -> DataFrame:
    if isinstance(labels, DataFrame):
        return labels.select(F.col(labels.columns[0]).alias(dim), F.col("pos"))
    return coordinates(t.spark, dim, list(labels), t.df.schema[dim].dataType.simpleString())


def take(t: Tensor, coords: dict, strict: bool = False) -> Tensor:
    """Labels in the requested order, repeated as often as requested, one dimension after another.

    An unknown label gives missing cells, or ``KeyError`` with ``strict``. Repeated labels are kept apart
    by position: every requested dimension also gets a column ``<dim>_pos`` among the dimensions.
    """
    df, dims, axes = t.df, list(t.dims), dict(t.coords)
    for dim, labels in coords.items():
        wanted = _requested(t, dim, labels)
        if strict and not wanted.join(t.axis(dim).select(dim), dim, "left_anti").isEmpty():
            raise KeyError(f"unknown labels of {dim}")
        df = wanted.select(dim, F.col("pos").alias(f"{dim}_pos")).join(df, dim, "left")
        dims.append(f"{dim}_pos")
        axes[dim] = wanted
    others = [d for d in t.dims if d not in coords]
    if others:  # an unknown label's row has no other labels: it stands for cells that stay missing
        df = df.where(" and ".join(f"{d} is not null" for d in others))
    return Tensor(df.select(*dims, *t.vars), tuple(dims), t.vars, {d: c for d, c in axes.items() if d not in coords})


def sel(t: Tensor, **labels) -> Tensor:
    """Cells of given labels: a value or a list for each dimension."""
    df, coords = t.df, dict(t.coords)
    for dim, wanted in labels.items():
        wanted = wanted if isinstance(wanted, (list, tuple, set)) else [wanted]
        df = df.where(F.col(dim).isin(list(wanted)))
        if dim in coords:
            coords[dim] = coords[dim].where(F.col(dim).isin(list(wanted)))
    return t.using(df, coords=coords)


def isel(t: Tensor, **positions) -> Tensor:
    """Cells by position along an axis; a negative position counts from its end."""
    out = t
    for dim, at in positions.items():
        axis = out.axis(dim)
        order = F.col("pos" if "pos" in axis.columns else dim)
        at = at if isinstance(at, (list, tuple)) else [at]
        if all(p >= 0 for p in at):  # the first few labels: no full sort of the axis
            head = axis.orderBy(order).limit(max(at) + 1).select(dim).collect()
            chosen = [head[p][0] for p in at if p < len(head)]
        elif all(p < 0 for p in at):
            tail = axis.orderBy(order.desc()).limit(-min(at)).select(dim).collect()
            chosen = [tail[-p - 1][0] for p in at if -p <= len(tail)]
        else:
            n = axis.count()
            places = [p % n for p in at if -n <= p < n]
            chosen = [r[0] for r in numbered(axis.select(dim, order.alias("__o")), "__o", "__place").where(F.col("__place").isin(places)).select(dim).collect()]
        out = sel(out, **{dim: chosen})
    return out


def isin(t: Tensor, values: list) -> Tensor:
    """True where a cell holds one of the values; missing cells are false."""
    return t.map(lambda c: F.coalesce(c.isin(list(values)), F.lit(False)))


def replace_values(t: Tensor, mapping: dict | DataFrame, default=None, dtype: str | None = None) -> Tensor:
    """Map values. Others stay, or become ``default``, missing cells too (so the grid is made dense then).

    A mapping given as a DataFrame (its first two columns) is joined; a dict becomes a literal map.
    """
    source = t.dense() if default is not None else t
    if isinstance(mapping, DataFrame):
        old, new = mapping.columns[:2]
        df = source.df
        for v in t.vars:
            table = mapping.select(F.col(old).alias(f"__k_{v}"), F.col(new).alias(f"__n_{v}"), F.lit(True).alias(f"__hit_{v}"))
            df = df.join(table, F.col(v) == F.col(f"__k_{v}"), "left")
        rest = (lambda v: F.lit(default)) if default is not None else F.col
        out = {v: F.when(F.col(f"__hit_{v}"), F.col(f"__n_{v}")).otherwise(rest(v)) for v in t.vars}
    else:
        clean = {k: v for k, v in mapping.items() if k == k and k is not None}
        table = F.create_map(*[x for k, v in clean.items() for x in (F.lit(k), F.lit(v))]) if clean else None
        df = source.df

        def new_value(v: str) -> Column:
            kind = t.df.schema[v].dataType
            rest = F.lit(default) if default is not None else F.col(v)
            if table is None:
                return rest
            key = F.col(v).cast(kind) if any(isinstance(k, (str, bool)) for k in clean) else F.col(v).cast("double")
            doubled = table if any(isinstance(k, (str, bool)) for k in clean) else F.transform_keys(table, lambda k, _: k.cast("double"))
            return F.when(F.col(v).isNotNull() & F.map_contains_key(doubled, F.coalesce(key, next_key(clean))), F.try_element_at(doubled, key)).otherwise(rest)

        out = {v: new_value(v) for v in t.vars}
    return t.using(df.select(*t.dims, *[(c.cast(dtype) if dtype else c).alias(v) for v, c in out.items()]))


def next_key(mapping: dict) -> Column:
    """Some key of a mapping, in the type that its look-ups use."""
    k = next(iter(mapping))
    return F.lit(k) if isinstance(k, (str, bool)) else F.lit(float(k))


def fillna(t: Tensor, value) -> Tensor:
    """Missing cells become ``value``, absent ones too."""
    return t.dense().map(lambda c: F.coalesce(c, F.lit(value)))


def dropna(t: Tensor, dims=None) -> Tensor:
    """Labels of the given dimensions without a valid cell go; all are judged on the tensor as it is."""
    valid = t.valid().df
    df, coords = t.df, dict(t.coords)
    for d in dims or t.dims:
        kept = valid.select(d).distinct()
        df = df.join(kept, d, "left_semi")
        if d in coords:
            coords[d] = coords[d].join(kept, d, "left_semi")
    return t.using(df, coords=coords)


def drop_unmarked(mask: Tensor, dims=None) -> Tensor:
    """The same for a boolean tensor: labels without a true cell go."""
    marked = mask.df.where(F.col(mask.value))
    df, coords = mask.df, dict(mask.coords)
    for d in dims or mask.dims:
        kept = marked.select(d).distinct()
        df = df.join(kept, d, "left_semi")
        if d in coords:
            coords[d] = coords[d].join(kept, d, "left_semi")
    return mask.using(df, coords=coords)


def drop_labels(t: Tensor, **labels) -> Tensor:
    """The cells of these labels go, and so do the labels."""
    df, coords = t.df, dict(t.coords)
    for dim, gone in labels.items():
        df = df.where(~F.col(dim).isin(list(gone)))
        if dim in coords:
            coords[dim] = coords[dim].where(~F.col(dim).isin(list(gone)))
    return t.using(df, coords=coords)


def last_valid_label(t: Tensor, dim: str) -> Tensor:
    """Of each series the last label with a valid cell."""
    return Tensor(t.df.groupBy(*t.others(dim)).agg(*[F.max(F.when(F.col(v).isNotNull(), F.col(dim))).alias(v) for v in t.vars]), tuple(t.others(dim)), t.vars)


def unique_values(t: Tensor) -> DataFrame:
    return t.df.select(t.value).where(F.col(t.value).isNotNull()).distinct()


def reindex(t: Tensor, dim: str, labels, method: str | None = None, fill_value=None) -> Tensor:
    """The tensor at the labels of a list or table, in its order.

    ``method=None`` takes equal labels; ``'ffill'`` the nearest label at or below, even if its cell is
    missing. ``fill_value`` fills cells of labels without a match only. Repeated targets repeat rows.
    """
    if method not in (None, "ffill"):
        raise NotImplementedError(f"method {method!r}")
    wanted = _requested(t, dim, labels)
    axis = t.axis(dim).select(dim)
    if method is None:
        match = wanted.select(dim).distinct().join(axis.withColumn("__at", F.col(dim)), dim, "left")
    else:  # as-of on the axes alone: the cells are joined once the label to read is known
        match = latest(axis, wanted, dim)
    others = t.others(dim)
    cells = t.df.withColumnRenamed(dim, "__at")
    targets = wanted.join(match, dim)
    if fill_value is None:
        df = targets.join(cells, "__at", "inner").select(*t.dims, *t.vars)
    else:
        frame = None
        for d in others:
            frame = t.axis(d).select(d) if frame is None else frame.crossJoin(t.axis(d).select(d))
        grid = targets.crossJoin(frame) if frame is not None else targets
        df = grid.join(cells, ["__at", *others], "left").select(*t.dims, *[F.when(F.col("__at").isNull(), F.lit(fill_value)).otherwise(F.col(v)).alias(v) for v in t.vars])
    coords = {**t.coords, dim: wanted.groupBy(dim).agg(F.min("pos").alias("pos"))}
    return Tensor(df, t.dims, t.vars, coords)

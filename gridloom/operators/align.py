"""Operators over two tensors: aligned arithmetic, outer combination, as-of lookup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.axes import numbered
from gridloom.tensor import Tensor

__all__ = ["append_previous", "binary", "combine_first", "concat", "dot", "where"]


def _pairs(a: Tensor, b: Tensor) -> list[tuple[str, str, str]]:
    """(left variable, right variable, name of the result)"""
    if len(a.vars) == len(b.vars) == 1:
        return [(a.vars[0], b.vars[0], a.vars[0])]
    if len(b.vars) == 1:
        return [(v, b.vars[0], v) for v in a.vars]
    if len(a.vars) == 1:
        return [(a.vars[0], v, v) for v in b.vars]
    return [(v, v, v) for v in a.vars if v in b.vars]


def binary(a: Tensor, b: Tensor, f: Callable[[Column, Column], Column], how: str = "inner") -> Tensor:
    """f of the cells whose shared labels are equal; a tensor without some dimension is repeated along it.

    A cell is missing where either side is. Tensors that share no dimension are combined cell by cell,
    as an outer product is by definition.
    """
    shared = [d for d in a.dims if d in b.dims]
    dims = (*a.dims, *(d for d in b.dims if d not in a.dims))
    left = a.df.select(*a.dims, *[F.col(v).alias(f"__l_{v}") for v in a.vars])
    right = b.df.select(*b.dims, *[F.col(v).alias(f"__r_{v}") for v in b.vars])
    joined = left.join(right, shared, how) if shared else left.crossJoin(right)
    pairs = _pairs(a, b)
    df = joined.select(*dims, *[f(F.col(f"__l_{x}"), F.col(f"__r_{y}")).alias(n) for x, y, n in pairs])
    coords = {d: c for d, c in {**b.coords, **a.coords}.items()}
    for d in shared:  # labels of both
        if d in a.coords and d in b.coords and a.coords[d] is not b.coords[d]:
            coords[d] = a.coords[d].join(b.coords[d].select(d), d, "left_semi")
        elif (d in a.coords) != (d in b.coords):
            coords.pop(d, None)
    return Tensor(df, dims, tuple(n for _, _, n in pairs), coords)


def where(t: Tensor, mask: Tensor, other=None) -> Tensor:
    """Cells where the mask is true; elsewhere missing, or ``other``."""
    m = mask.rename(**{mask.value: "__mask"})
    shared = list(m.dims)
    df = t.df.join(m.df, shared, "left")
    keep = F.coalesce(F.col("__mask"), F.lit(False))
    return t.using(df.select(*t.dims, *[F.when(keep, F.col(v)).otherwise(F.lit(other)).alias(v) for v in t.vars]))


def _joined_axes(a: Tensor, b: Tensor) -> dict:
    """Coordinate tables of the union of labels: the first tensor's order, then what the second adds."""
    coords = {}
    for d in a.dims:
        if d in a.coords and d in b.coords:
            new = b.coords[d].join(a.coords[d].select(d), d, "left_anti")
            top = a.coords[d].agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("__top"))
            coords[d] = a.coords[d].select(d, "pos").unionByName(new.crossJoin(top).select(d, (F.col("pos") + F.col("__top")).alias("pos")))
    return coords


def _sorted_axes(a: Tensor, b: Tensor) -> dict:
    """Coordinate tables of the union of labels in label order, where either side has a table."""
    coords = {}
    for d in a.dims:
        if d in a.coords or d in b.coords:
            labels = a.axis(d).select(d).unionByName(b.axis(d).select(d)).distinct()
            coords[d] = numbered(labels, d)
    return coords


def combine_first(new: Tensor, old: Tensor) -> Tensor:
    """Valid cells of ``new``; where it has none, those of ``old``; labels of both, in label order."""
    if set(new.dims) != set(old.dims):
        raise ValueError("dimensions differ")
    vars = (*new.vars, *(v for v in old.vars if v not in new.vars))
    left = new.df.select(*new.dims, *[F.col(v).alias(f"__n_{v}") for v in new.vars])
    right = old.df.select(*old.dims, *[F.col(v).alias(f"__o_{v}") for v in old.vars])
    df = left.join(right, list(new.dims), "full_outer")
    pick = lambda v: F.coalesce(*[F.col(f"__{s}_{v}") for s, t in (("n", new), ("o", old)) if v in t.vars]).alias(v)
    return Tensor(df.select(*new.dims, *[pick(v) for v in vars]), new.dims, vars, _sorted_axes(old, new))


def concat(parts: list[Tensor]) -> Tensor:
    """Tensors over disjoint labels as one; labels of the other dimensions are united."""
    out = parts[0]
    for p in parts[1:]:
        out = Tensor(out.to_dataframe().unionByName(p.to_dataframe(), allowMissingColumns=True), out.dims, out.vars, _joined_axes(out, p))
    return out


def append_previous(old: Tensor, new: Tensor, dim: str) -> Tensor:
    """``new`` with the slice of ``old`` before it whose label is the last one below the first of ``new``."""
    first = new.axis(dim).agg(F.min(dim).alias("__first"))
    before = old.axis(dim).select(dim).crossJoin(F.broadcast(first)).where(F.col(dim) < F.col("__first")).agg(F.max(dim).alias("__before"))
    slice_ = old.df.join(F.broadcast(before), F.col(dim) == F.col("__before"), "inner").select(*old.dims, *old.vars)
    return Tensor(slice_.unionByName(new.to_dataframe()), new.dims, new.vars, {d: c for d, c in new.coords.items() if d != dim and d not in old.coords})


def dot(a: Tensor, b: Tensor, dim: str) -> Tensor:
    """Sum of products along a shared dimension; other shared dimensions are aligned."""
    product = binary(a, b, lambda x, y: x * y)
    keep = [d for d in product.dims if d != dim]
    return Tensor(product.df.groupBy(*keep).agg(*[F.sum(v).alias(v) for v in product.vars]), tuple(keep), product.vars, {d: c for d, c in product.coords.items() if d != dim})

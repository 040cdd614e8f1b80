"""A labelled tensor as a long DataFrame: one column for each dimension, one for each variable.

Missing is NULL (NaN becomes NULL on the way in). Cells may be absent, which means missing too. An axis
is the set of labels of a dimension in an order: the labels' own order unless a coordinate table
``(label, pos)`` says otherwise. Coordinate tables also keep labels whose cells are all missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

POS = "__pos"


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    dims: tuple[str, ...]
    vars: tuple[str, ...] = ("value",)
    coords: dict[str, DataFrame] = field(default_factory=dict)  # dim -> (dim, pos)

    @classmethod
    def from_dataframe(cls, df: DataFrame, dims: Iterable[str], vars: Iterable[str] | None = None, coords: dict[str, DataFrame] | None = None) -> Tensor:
        dims = tuple(dims)
        vars = tuple(vars) if vars else tuple(c for c in df.columns if c not in dims)
        kinds = {f.name: f.dataType for f in df.schema.fields}
        clean = [F.when(~F.isnan(v), F.col(v)).alias(v) if isinstance(kinds[v], (DoubleType, FloatType)) else F.col(v) for v in vars]
        return cls(df.select(*dims, *clean), dims, vars, dict(coords or {}))

    @classmethod
    def from_matrix(cls, spark, matrix, dims=("a", "b"), labels: dict | None = None, var: str = "value") -> Tensor:
        """From nested lists, row by row along the first dimensions; for small literals."""
        import numpy as np

        a, labels = np.array(matrix, dtype=float), labels or {}
        labels = {d: list(labels.get(d, range(n))) for d, n in zip(dims, a.shape)}
        rows = [(*(labels[d][i] for d, i in zip(dims, at)), None if np.isnan(v) else float(v)) for at, v in np.ndenumerate(a)]
        kind = lambda d: "string" if isinstance(labels[d][0], str) else "long"
        coords = {d: spark.createDataFrame([(x, i) for i, x in enumerate(labels[d])], f"{d} {kind(d)}, pos long") for d in dims}
        return cls(spark.createDataFrame(rows, ", ".join([*(f"{d} {kind(d)}" for d in dims), f"{var} double"])), tuple(dims), (var,), coords)

    @property
    def value(self) -> str:
        """The only variable's name."""
        if len(self.vars) != 1:
            raise ValueError(f"several variables: {', '.join(self.vars)}")
        return self.vars[0]

    @property
    def spark(self):
        return self.df.sparkSession

    def others(self, dim: str) -> list[str]:
        if dim not in self.dims:
            raise ValueError(f"no dimension {dim!r} among {', '.join(self.dims)}")
        return [d for d in self.dims if d != dim]

    def using(self, df: DataFrame, **changes) -> Tensor:
        return replace(self, df=df, **changes)

    def axis(self, dim: str) -> DataFrame:
        """(dim, pos) with the labels of a dimension; pos only if the order is not the labels' own."""
        return self.coords[dim] if dim in self.coords else self.df.select(dim).distinct()

    def labels(self, dim: str) -> list:
        """The labels in order, on the driver: for axes known to be small."""
        axis = self.axis(dim)
        return [r[0] for r in axis.orderBy("pos" if "pos" in axis.columns else dim).select(dim).collect()]

    def grid(self) -> DataFrame:
        """Every combination of labels: what an array holds by definition."""
        out = None
        for d in self.dims:
            labels = self.axis(d).select(d)
            out = labels if out is None else out.crossJoin(labels)
        return out

    def dense(self) -> Tensor:
        """A row for every cell; missing cells are NULL. A null label is a label like others."""
        grid = self.grid().select(*[F.col(d).alias(f"__grid_{d}") for d in self.dims])
        same = [F.col(f"__grid_{d}").eqNullSafe(F.col(d)) for d in self.dims]
        met = grid.join(self.df, reduce(lambda a, b: a & b, same), "left") if same else self.df
        kept = [c for c in self.df.columns if c not in self.dims]  # operators' helper columns too
        return self.using(met.select(*[F.col(f"__grid_{d}").alias(d) for d in self.dims], *kept))

    def ordered(self, dim: str) -> tuple[DataFrame, Column]:
        """Rows and the column to order them by along ``dim``."""
        if dim in self.coords and "pos" in self.coords[dim].columns:
            return self.df.join(self.coords[dim].select(dim, F.col("pos").alias(POS)), dim), F.col(POS)
        return self.df, F.col(dim)

    def map(self, f: Callable[[Column], Column]) -> Tensor:
        """Apply a column expression to every variable."""
        return self.using(self.df.select(*self.dims, *[f(F.col(v)).alias(v) for v in self.vars]))

    def valid(self) -> Tensor:
        """Without the rows in which every variable is missing."""
        return self.using(self.df.where(F.coalesce(*[F.col(v).cast("string") for v in self.vars]).isNotNull()))

    def select(self, *vars: str) -> Tensor:
        return self.using(self.df.select(*self.dims, *vars), vars=tuple(vars))

    def rename(self, **names: str) -> Tensor:
        """Rename dimensions or variables."""
        df, coords = self.df, dict(self.coords)
        for old, new in names.items():
            df = df.withColumnRenamed(old, new)
            if old in coords:
                coords[new] = coords.pop(old).withColumnRenamed(old, new)
        swap = lambda xs: tuple(names.get(x, x) for x in xs)
        return Tensor(df, swap(self.dims), swap(self.vars), coords)

    def transpose(self, *dims: str) -> Tensor:
        """Dimensions in another order; the cells do not change."""
        if set(dims) != set(self.dims):
            raise ValueError("transpose needs all dimensions")
        return replace(self, dims=tuple(dims))

    def to_dataframe(self) -> DataFrame:
        return self.df.select(*self.dims, *self.vars)

    def to_pandas(self, var: str | None = None):
        """A matrix of a tensor with two dimensions, on the driver: for small results and tests."""
        pdf = self.dense().df.select(*self.dims, var or self.value).toPandas()
        out = pdf.pivot(index=self.dims[0], columns=self.dims[1], values=var or self.value)
        return out.reindex(index=self.labels(self.dims[0]), columns=self.labels(self.dims[1]))

    def view(self, name: str) -> None:
        """Make the tensor a table for ``spark.sql``."""
        self.to_dataframe().createOrReplaceTempView(name)

    # arithmetic and comparison align labels (see operators.align)

    def _op(self, other, f):
        from gridloom.operators.align import binary

        return binary(self, other, f) if isinstance(other, Tensor) else self.map(lambda c: f(c, F.lit(other)))

    def __add__(self, o): return self._op(o, lambda a, b: a + b)  # noqa: E704
    def __sub__(self, o): return self._op(o, lambda a, b: a - b)  # noqa: E704
    def __mul__(self, o): return self._op(o, lambda a, b: a * b)  # noqa: E704
    def __radd__(self, o): return self._op(o, lambda a, b: b + a)  # noqa: E704
    def __rsub__(self, o): return self._op(o, lambda a, b: b - a)  # noqa: E704
    def __rmul__(self, o): return self._op(o, lambda a, b: b * a)  # noqa: E704
    def __truediv__(self, o): return self._op(o, divide)  # noqa: E704
    def __rtruediv__(self, o): return self._op(o, lambda a, b: divide(b, a))  # noqa: E704
    def __mod__(self, o): return self._op(o, lambda a, b: F.pmod(a, F.nullif(b, F.lit(0))))  # noqa: E704
    def __floordiv__(self, o): return self._op(o, lambda a, b: F.floor(divide(a, b)))  # noqa: E704
    def __pow__(self, o): return self._op(o, power)  # noqa: E704
    def __rpow__(self, o): return self._op(o, lambda a, b: power(b, a))  # noqa: E704
    def __gt__(self, o): return self._op(o, lambda a, b: a > b)  # noqa: E704
    def __ge__(self, o): return self._op(o, lambda a, b: a >= b)  # noqa: E704
    def __lt__(self, o): return self._op(o, lambda a, b: a < b)  # noqa: E704
    def __le__(self, o): return self._op(o, lambda a, b: a <= b)  # noqa: E704
    def equals(self, o): return self._op(o, lambda a, b: a == b)  # noqa: E704
    def differs(self, o): return self._op(o, lambda a, b: a != b)  # noqa: E704
    def __and__(self, o): return self._op(o, lambda a, b: a & b)  # noqa: E704
    def __or__(self, o): return self._op(o, lambda a, b: a | b)  # noqa: E704
    def __neg__(self): return self.map(lambda c: -c)  # noqa: E704
    def __invert__(self): return self.map(lambda c: ~F.coalesce(c, F.lit(False)))  # noqa: E704


def divide(a: Column, b: Column) -> Column:
    """Division whose zero divisor gives a missing cell, not an error or an infinity."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def power(a: Column, b: Column) -> Column:
    """A power that is no real number gives a missing cell."""
    out = F.pow(a, b)
    return F.when(~F.isnan(out), out)


def along(t: Tensor, dim: str, *more) -> Window:
    """One series for each combination of the other labels."""
    return Window.partitionBy(*[F.col(d) for d in t.others(dim)], *more)

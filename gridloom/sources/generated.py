"""Tensors made by a function of labels, block by block, on the executors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from gridloom.operators.index import coordinates
from gridloom.tensor import Tensor


def _kind(labels: list) -> str:
    return "string" if isinstance(labels[0], str) else "long" if isinstance(labels[0], int) else "double" if isinstance(labels[0], float) else "timestamp_ntz"


def _blocks(labels: list, n: int | None) -> list[list]:
    n = n or max(1, len(labels))
    return [labels[i : i + n] for i in range(0, len(labels), n)]


def tensor_from_function(spark, func: Callable, dims: list[str], coords: dict[str, list], dtypes: list[str] | str = "double", data_names: list[str] | str = "value", chunks: dict[str, int | None] | None = None, **kwargs) -> Tensor:
    """``func(labels, **kwargs)`` is called once for each block of labels (``{dim: list}``) and returns arrays:
    one, or a list of one for each name, shaped like the block. No chunk size: the whole axis."""
    names = [data_names] if isinstance(data_names, str) else list(data_names)
    types = [dtypes] * len(names) if isinstance(dtypes, str) else list(dtypes)
    if len(names) != len(types):
        raise ValueError("as many types as names are needed")
    kinds = {d: _kind(coords[d]) for d in dims}
    df = None
    for d in dims:
        part = spark.createDataFrame([(x,) for x in _blocks(list(coords[d]), (chunks or {}).get(d))], f"{d} array<{kinds[d]}>")
        df = part if df is None else df.crossJoin(part)
    single = isinstance(data_names, str)

    def run(batches):
        import numpy as np

        for pdf in batches:
            for row in pdf[dims].itertuples(index=False):
                labels = {d: list(x) for d, x in zip(dims, row)}
                made = func(labels, **kwargs)
                made = [made] if single else list(made)
                grid = pd.MultiIndex.from_product([labels[d] for d in dims], names=dims).to_frame(index=False)
                for name, a in zip(names, made):
                    grid[name] = np.asarray(a).ravel()
                yield grid

    schema = ", ".join([*(f"{d} {kinds[d]}" for d in dims), *(f"{n} {t}" for n, t in zip(names, types))])
    blocks = df.repartition(max(1, min(200, df.count())))
    rows = blocks.mapInPandas(run, schema)
    return Tensor.from_dataframe(rows, dims, names, {d: coordinates(spark, d, list(coords[d]), kinds[d]) for d in dims})


def empty_tensor(spark, dims: list[str], coords: dict[str, list], dtype: str = "double", name: str = "value") -> Tensor:
    """All labels and no valid cell."""
    axes = {d: coordinates(spark, d, list(coords[d]), _kind(coords[d])) for d in dims}
    schema = ", ".join([*(f"{d} {_kind(coords[d])}" for d in dims), f"{name} {dtype}"])
    return Tensor(spark.createDataFrame([], schema), tuple(dims), (name,), axes)

"""A stored tensor: immutable Parquet files by chunk, published by a manifest.

``chunks`` (dim -> labels a chunk) cuts the grid into chunks; without it the tensor is one chunk. A
manifest names for each chunk the data folders that hold its cells. A change writes one new folder with the
cells of the chunks it touches and a manifest in which only those chunks point elsewhere; the files of all
others stay as they are. An append that brings new labels rewrites nothing: its cells join the chunks they
fall into. Labels keep the chunk that they were given, wherever an ordered axis places them later.

``manifest/<n>.json`` is created by the first writer to take the number, after a look whether its files are
there. Readers use the highest one, so they see a whole version or the one before; a writer that lost the
race plans again on the new version. Several verbs in one session are one version.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.axes import numbered
from gridloom.shared import age, delete, exists, list_names, publish_text, read_json
from gridloom.sources.base import Storage, TensorNotFound
from gridloom.tensor import Tensor

#: Seconds for which a folder that no version names may belong to a write in flight.
GRACE = 86_400
#: Folders of a chunk from which ``compact`` makes one.
FEW = 8


@dataclass
class Staged:
    """Changes that are written and not yet published; more verbs can be added, all are one version."""

    table: TensorTable
    base: int
    entry: dict | None
    plans: list[Callable[[dict | None], dict | None]]

    def then(self, plan: Callable[[dict | None], dict | None]) -> Staged:
        self.plans.append(plan)
        self.entry = plan(self.entry) or self.entry
        return self

    def store(self, new_data: Tensor, **_) -> Staged:
        return self.then(lambda e: self.table._stored(e, new_data))

    def append(self, new_data: Tensor, fill_value=None, **_) -> Staged:
        return self.then(lambda e: self.table._appended(e, new_data, fill_value))

    def update(self, new_data: Tensor, complete_update_dims=None, fill_value=None, **_) -> Staged:
        return self.then(lambda e: self.table._updated(e, new_data, complete_update_dims, fill_value))

    def upsert(self, new_data: Tensor, complete_update_dims=None, fill_value=None, **_) -> Staged:
        return self.then(lambda e: self.table._upserted(e, new_data, complete_update_dims, fill_value))

    def drop(self, coords: dict) -> Staged:
        return self.then(lambda e: self.table._dropped(e, coords))

    def read(self) -> Tensor:
        """The tensor as this session sees it."""
        return self.table._tensor(self.table._known(self.entry))

    def commit(self, tag: tuple[str, int] | None = None) -> int:
        """Publish; the version's number. If another writer was first, its changes are kept and these are made again on
        top. ``tag`` (name, number) is remembered with the version (see ``tag``)."""
        for _ in range(20):
            if self.entry is None or not self.plans:
                return self.table.version()
            tags = {**self.entry.get("tags", {}), **(dict([tag]) if tag else {})}
            if self.table._publish(self.base, {**self.entry, "tags": tags}):
                return self.base + 1
            again = self.table._staged(self.plans)
            self.base, self.entry = again.base, again.entry
        raise RuntimeError("too many concurrent writers")


class TensorTable(Storage):
    """One tensor below ``root``.

    Labels are not null. ``data_names``: a variable's name, or a list of them (others are dropped). ``unique_coords``: of repeated
    cells and labels the first stays (the default). ``sorted_coords``: ``{dim: ascending}`` for axes to
    be kept in label order; other axes grow at their end. ``chunks``: ``{dim: n}`` labels a chunk.
    """

    def __init__(self, spark: SparkSession, root: str, data_names: str | list[str] = "value", unique_coords: bool = True, sorted_coords: dict[str, bool] | None = None, chunks: dict[str, int] | None = None):
        self.spark, self.root, self.unique, self.sorted = spark, root.rstrip("/"), unique_coords, dict(sorted_coords or {})
        self.names, self.chunks = data_names, dict(chunks or {})

    @property
    def variables(self) -> list[str]:
        return [self.names] if isinstance(self.names, str) else list(self.names)

    # versions

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in list_names(self.spark, f"{self.root}/manifest") if (m := re.fullmatch(r"(\d+)\.json", n)))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _publish(self, base: int, entry: dict) -> bool:
        named = lambda e: {f"data/folder={f}" for folders in e["parts"].values() for f in folders} | {f"coords/{a}" for a in e["axes"].values()}
        new = named(entry) - (named(self._manifest(base)) if base in self.versions() else set())
        if gone := [name for name in sorted(new) if not exists(self.spark, f"{self.root}/{name}")]:
            raise FileNotFoundError(f"{gone[0]} is no longer there")
        return publish_text(self.spark, f"{self.root}/manifest/{base + 1:012d}.json", json.dumps({**entry, "parent": base}))

    def _manifest(self, version: int | None) -> dict:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise TensorNotFound(self.root if version is None else f"{self.root} version {version}")
        return read_json(self.spark, f"{self.root}/manifest/{version or known[-1]:012d}.json")

    def tag(self, name: str) -> int | None:
        """The number that the last commit under this name gave, so that a writer knows what it has written."""
        return self._manifest(None).get("tags", {}).get(name) if self.exist() else None

    def exist(self) -> bool:
        return bool(self.versions())

    def delete(self) -> None:
        """Remove everything below the root; nothing there is fine."""
        delete(self.spark, self.root)

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> None:
        """Remove all versions but the last ``keep`` and the files that none of them names, unless they are younger
        than ``grace`` seconds: those may belong to a write in flight."""
        known = self.versions()
        entries = [self._manifest(v) for v in known[-keep:]]
        kept = {f for e in entries for folders in e["parts"].values() for f in folders} | {a for e in entries for a in e["axes"].values()}
        for v in known[:-keep]:
            delete(self.spark, f"{self.root}/manifest/{v:012d}.json")
        for kind, prefix in (("data", "folder="), ("coords", "")):
            for name in list_names(self.spark, f"{self.root}/{kind}"):
                path = f"{self.root}/{kind}/{name}"
                if name.removeprefix(prefix) not in kept and age(self.spark, path) >= grace:
                    delete(self.spark, path)

    # reading

    def _known(self, entry: dict | None) -> dict:
        if entry is None:
            raise TensorNotFound(self.root)
        return entry

    def _path(self, chunk: str, folder: str) -> str:
        return "/".join([f"{self.root}/data/folder={folder}", *chunk.split("/")]).rstrip("/")

    def _cells(self, entry: dict, chunks: list[str] | None = None) -> DataFrame:
        """The cells of the given chunks (all by default)."""
        schema = StructType.fromJson(entry["schema"])
        paths = [self._path(c, f) for c, folders in entry["parts"].items() if chunks is None or c in chunks for f in folders]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths)

    def _axes(self, entry: dict) -> dict[str, DataFrame]:
        return {d: self.spark.read.schema(StructType.fromJson(s)).parquet(f"{self.root}/coords/{entry['axes'][d]}/{d}") for d, s in entry["coords"].items()}

    def _tensor(self, entry: dict, labels: dict | None = None) -> Tensor:
        coords, wanted_chunks = self._axes(entry), {}
        for dim, wanted in (labels or {}).items():
            wanted = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
            coords[dim] = coords[dim].where(F.col(dim).isin(wanted))
            if dim in entry["chunks"]:  # the axis tells which chunks hold the labels
                wanted_chunks[dim] = {r[0] for r in coords[dim].select("chunk").distinct().collect()}
        df = self._cells(entry, self._touched(entry, wanted_chunks))
        for dim, wanted in (labels or {}).items():
            if dim in wanted_chunks:
                df = df.where(F.col(f"chunk_{dim}").isin(sorted(wanted_chunks[dim])))
            df = df.where(F.col(dim).isin(list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]))
        return Tensor(df.select(*entry["dims"], *entry["vars"]), tuple(entry["dims"]), tuple(entry["vars"]), {d: c.select(d, "pos") for d, c in coords.items()})

    def read(self, version: int | None = None, **labels) -> Tensor:
        """The tensor, lazily. ``labels`` (dim=list) select by label; with chunks, only the files that can
        hold them are opened."""
        return self._tensor(self._manifest(version), labels)

    # writing

    def _checked(self, t: Tensor, dims: list[str] | None = None) -> Tensor:
        missing = [v for v in self.variables if v not in t.vars]
        if missing and isinstance(self.names, str) and len(t.vars) == 1:
            t, missing = t.rename(**{t.vars[0]: self.names}), []
        if missing:
            raise ValueError(f"variables {missing} are not in the data")
        if dims is not None and set(dims) != set(t.dims):
            raise ValueError(f"dimensions {sorted(t.dims)} are not those stored: {sorted(dims)}")
        t = t.select(*self.variables)
        if dims is not None:
            t = t.transpose(*dims)
        if self.unique:  # the first occurrence, as a table without repeated cells keeps its rows
            first = F.min_by(F.struct(*t.vars), "__row")
            df = t.df.withColumn("__row", F.monotonically_increasing_id()).groupBy(*t.dims).agg(first.alias("__first"))
            t = t.using(df.select(*t.dims, *[F.col(f"__first.{v}").alias(v) for v in t.vars]))
        return t

    def _axis(self, t: Tensor, dim: str) -> DataFrame:
        """(dim, pos) of a tensor, positions from 0."""
        axis = t.axis(dim)
        if dim in self.sorted or "pos" not in axis.columns:
            return numbered(axis.select(dim).distinct(), dim, descending=self.sorted.get(dim) is False)
        axis = axis.groupBy(dim).agg(F.min("pos").alias("__o"))
        return numbered(axis, F.struct("__o", dim)).select(dim, "pos")

    def _chunked(self, axis: DataFrame, dim: str, offset: int = 0) -> DataFrame:
        """The axis with the chunk of each label, from its place behind ``offset`` others."""
        return axis.withColumn("chunk", F.floor((F.col("pos") + offset) / self.chunks.get(dim, 1 << 62)).cast("long"))

    def _grown(self, old: DataFrame, new: Tensor, dim: str) -> DataFrame | None:
        """The old axis with the labels that are new: at its end, or in order on a sorted axis; None if there are none."""
        added = self._axis(new, dim).join(old.select(dim), dim, "left_anti")
        added = numbered(added.withColumnRenamed("pos", "__o"), F.struct("__o", dim)).select(dim, "pos")
        if added.isEmpty():
            return None
        size = old.count()
        added = self._chunked(added, dim, size)  # labels keep their chunk for good
        if dim in self.sorted:
            both = old.select(dim, "chunk").unionByName(added.select(dim, "chunk"))
            return numbered(both, dim, descending=not self.sorted[dim]).select(dim, "pos", "chunk")
        top = old.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("__top"))
        moved = added.crossJoin(F.broadcast(top)).select(dim, (F.col("pos") + F.col("__top")).alias("pos"), "chunk")
        return old.select(dim, "pos", "chunk").unionByName(moved)

    def _touched(self, entry: dict, wanted: dict[str, set]) -> list[str] | None:
        """The chunks that lie in the given ones of some dimensions; None if no dimension is bounded."""
        if not wanted:
            return None
        place = {d: i for i, d in enumerate(entry["chunks"])}
        inside = lambda key: all(int(key.split("/")[place[d]].split("=")[1]) in w for d, w in wanted.items())
        return [key for key in entry["parts"] if inside(key)]

    def _chunks_of(self, entry: dict, axes: dict[str, DataFrame], labels: dict[str, DataFrame]) -> list[str]:
        """The stored chunks in which cells of the cross product of the labels can lie."""
        wanted = {d: {r[0] for r in axes[d].join(labels[d], d, "left_semi").select("chunk").distinct().collect()} for d in entry["chunks"] if d in labels}
        touched = self._touched(entry, wanted)
        return list(entry["parts"]) if touched is None else touched

    def _entry(self, entry: dict | None, cells: DataFrame, dims, vars_, axes: dict[str, DataFrame], changed: set[str], replaced: list[str], note: str) -> dict:
        """Write cells and the axes that changed; the manifest's next entry. ``cells`` are all there is of the
        ``replaced`` chunks, and join what the others hold."""
        name = uuid.uuid4().hex
        if entry is not None:
            kinds = {f.name: f.dataType for f in StructType.fromJson(entry["schema"]).fields}
            if any(cells.schema[c].dataType != kinds[c] for c in [*dims, *vars_]):  # a wider type: all files get it
                cells = self._cells(entry, [c for c in entry["parts"] if c not in replaced]).select(*dims, *vars_).unionByName(cells.select(*dims, *vars_))
                replaced = list(entry["parts"])
        chunks = {d: n for d, n in self.chunks.items() if d in dims} if entry is None else entry["chunks"]
        stored, places, coords = {}, dict(entry["axes"]) if entry else {}, dict(entry["coords"]) if entry else {}
        for d in dims:
            if d in changed:
                axis = axes[d].select(d, "pos", "chunk")
                axis.write.parquet(f"{self.root}/coords/{name}/{d}")
                places[d], coords[d] = name, axis.schema.jsonValue()
            stored[d] = self.spark.read.schema(StructType.fromJson(coords[d])).parquet(f"{self.root}/coords/{places[d]}/{d}")
        df = cells.select(*dims, *vars_)
        for d in chunks:
            df = df.join(stored[d].select(d, F.col("chunk").alias(f"chunk_{d}")), d)
        columns, folder = [f"chunk_{d}" for d in chunks], f"{self.root}/data/folder={name}"
        if columns:
            df.repartition(*columns).write.partitionBy(*columns).parquet(folder)
        else:
            df.write.parquet(folder)
        parts = {c: list(f) for c, f in entry["parts"].items() if c not in replaced} if entry else {}
        for chunk in self._written(folder, len(columns)):
            parts.setdefault(chunk, []).append(name)
        return {"dims": list(dims), "vars": list(vars_), "schema": df.schema.jsonValue(), "coords": coords, "axes": places, "chunks": chunks, "parts": parts, "tags": (entry or {}).get("tags", {}), "note": note}

    def _written(self, folder: str, depth: int) -> list[str]:
        found = [""]
        for _ in range(depth):
            found = [f"{f}/{n}".lstrip("/") for f in found for n in list_names(self.spark, f"{folder}/{f}".rstrip("/")) if "=" in n]
        return found

    def _staged(self, plans: list) -> Staged:
        base = self.version()
        staged = Staged(self, base, self._manifest(base) if base else None, [])
        first = staged.entry
        for plan in plans:
            staged.then(plan)
        if staged.entry is first:
            staged.entry = None  # nothing to change
        return staged

    def _change(self, plan, commit: bool, tag=None):
        staged = self._staged([plan])
        if staged.entry is None:
            return None
        return staged.commit(tag) if commit else staged

    def session(self) -> Staged:
        """Several verbs that become one version when the session is committed."""
        base = self.version()
        return Staged(self, base, self._manifest(base) if base else None, [])

    def _stored(self, entry: dict | None, new_data: Tensor) -> dict:
        t = self._checked(new_data)
        axes = {d: self._chunked(self._axis(t, d), d) for d in t.dims}
        return {**self._entry(None, t.to_dataframe(), t.dims, t.vars, axes, set(t.dims), [], "store"), "tags": (entry or {}).get("tags", {})}

    def store(self, new_data: Tensor, commit: bool = True, tag=None, **_):
        """Replace the whole tensor."""
        return self._change(lambda e: self._stored(e, new_data), commit, tag)

    def append_plan(self, new_data: Tensor) -> dict[str, DataFrame]:
        """By dimension the labels that an append would add."""
        old = self.read()
        t = self._checked(new_data, list(old.dims))
        return {d: t.axis(d).select(d).distinct().join(old.axis(d).select(d), d, "left_anti") for d in old.dims}

    def update_plan(self, new_data: Tensor, complete_update_dims=None) -> list[str]:
        """The chunks that an update would rewrite."""
        entry = self._manifest(None)
        t, axes = self._checked(new_data, entry["dims"]), self._axes(entry)
        complete = [complete_update_dims] if isinstance(complete_update_dims, str) else complete_update_dims or []
        return self._chunks_of(entry, axes, {d: t.axis(d).select(d) for d in entry["dims"] if d not in complete})

    def _appended(self, entry: dict | None, new_data: Tensor, fill_value) -> dict | None:
        if entry is None:
            return self._stored(None, new_data)
        dims, t, axes = entry["dims"], self._checked(new_data, entry["dims"]), self._axes(entry)
        grown = {d: g for d in dims if (g := self._grown(axes[d], t, d)) is not None}
        if not grown:
            return None
        flags, known = t.df, F.lit(True)
        for d in dims:
            flags = flags.join(axes[d].select(d, F.lit(True).alias(f"__in_{d}")), d, "left")
            known = known & F.col(f"__in_{d}").isNotNull()
        added = flags.where(~known).select(*dims, *entry["vars"])  # a cell whose labels are all stored is left alone
        if fill_value is not None:
            old, new = self._grid(axes, dims), self._grid({**axes, **grown}, dims)
            holes = new.join(old, dims, "left_anti").join(t.grid(), dims, "left_anti")
            added = added.unionByName(self._filled(entry, holes, fill_value))
        return self._entry(entry, added, dims, entry["vars"], {**axes, **grown}, set(grown), [], "append")

    @staticmethod
    def _grid(axes: dict[str, DataFrame], dims: list[str]) -> DataFrame:
        """Every cell of the axes: what a fill value stands in is asked for whole."""
        out = axes[dims[0]].select(dims[0])
        for d in dims[1:]:
            out = out.crossJoin(axes[d].select(d))
        return out

    @staticmethod
    def _filled(entry: dict, cells: DataFrame, fill_value) -> DataFrame:
        kinds = StructType.fromJson(entry["schema"])
        return cells.select(*entry["dims"], *[F.lit(fill_value).cast(kinds[v].dataType).alias(v) for v in entry["vars"]])

    def append(self, new_data: Tensor, commit: bool = True, fill_value=None, tag=None, **_):
        """Add the new labels along every dimension; cells whose labels are all stored do not change.

        Cells of the grown grid that nobody gave are missing, or ``fill_value``. An absent tensor is stored. What is
        stored is not rewritten. Nothing new: no version, and None.
        """
        return self._change(lambda e: self._appended(e, new_data, fill_value), commit, tag)

    def _updated(self, entry: dict | None, new_data: Tensor, complete, fill_value) -> dict | None:
        entry = self._known(entry)
        dims, axes, complete = entry["dims"], self._axes(entry), [complete] if isinstance(complete, str) else list(complete or ())
        t = self._checked(new_data, dims)
        for d in dims:
            known = axes[d].select(d)
            t = t.using(t.df.join(known, d, "left_semi"), coords={k: (c.join(known, d, "left_semi") if k == d else c) for k, c in t.coords.items()})
        if any(t.axis(d).isEmpty() for d in dims):  # on some axis none of the labels is stored
            return None
        labels = {d: (axes[d] if d in complete else t.axis(d)).select(d).distinct() for d in dims}
        touched = self._chunks_of(entry, axes, {d: labels[d] for d in dims if d not in complete})
        rest, hit = self._cells(entry, touched).select(*dims, *entry["vars"]), F.lit(True)
        for d in dims:
            rest = rest.join(labels[d].withColumn(f"__hit_{d}", F.lit(True)), d, "left")
            hit = hit & F.col(f"__hit_{d}").isNotNull()
        rest = rest.where(~hit).select(*dims, *entry["vars"])  # all cells of the given labels are overwritten, missing ones too
        cells = rest.unionByName(t.to_dataframe().select(*dims, *entry["vars"]))
        if fill_value is not None and complete:
            given = self._grid({d: t.axis(d).select(d).distinct() for d in dims}, dims)
            cells = cells.unionByName(self._filled(entry, self._grid(labels, dims).join(given, dims, "left_anti"), fill_value))
        return self._entry(entry, cells, dims, entry["vars"], axes, set(), touched, "update")

    def update(self, new_data: Tensor, commit: bool = True, complete_update_dims=None, fill_value=None, tag=None, **_):
        """Overwrite the cells of all combinations of the given labels; unknown labels are left out.

        ``complete_update_dims`` takes every stored label of those dimensions, with ``fill_value`` where
        the new data has none. Only chunks that hold given labels are read and rewritten. Nothing to update: no
        version, and None.
        """
        return self._change(lambda e: self._updated(e, new_data, complete_update_dims, fill_value), commit, tag)

    def _upserted(self, entry: dict | None, new_data: Tensor, complete, fill_value) -> dict | None:
        if entry is None:
            return self._stored(None, new_data)
        updated = self._updated(entry, new_data, complete, fill_value)
        return self._appended(updated or entry, new_data, fill_value) or updated

    def upsert(self, new_data: Tensor, commit: bool = True, complete_update_dims=None, fill_value=None, tag=None, **_):
        """Update what is stored and append what is not, as one version."""
        return self._change(lambda e: self._upserted(e, new_data, complete_update_dims, fill_value), commit, tag)

    def _dropped(self, entry: dict | None, coords: dict) -> dict:
        entry = self._known(entry)
        axes, labels, kept = self._axes(entry), {}, {}
        for d, gone in coords.items():
            gone = list(gone) if isinstance(gone, (list, tuple, set)) else [gone]
            labels[d] = axes[d].where(F.col(d).isin(gone)).select(d)
            known = {r[0] for r in labels[d].collect()}
            if set(gone) - known:
                raise KeyError(f"labels {sorted(map(str, set(gone) - known))} are not on {d}")
            left = axes[d].where(~F.col(d).isin(gone)).withColumnRenamed("pos", "__o")
            kept[d] = numbered(left, F.struct("__o", d)).select(d, "pos", "chunk")
        touched = sorted({c for d in labels for c in self._chunks_of(entry, axes, {d: labels[d]})})
        cells = self._cells(entry, touched)
        for d in labels:
            cells = cells.join(F.broadcast(labels[d]), d, "left_anti")
        return self._entry(entry, cells, entry["dims"], entry["vars"], {**axes, **kept}, set(kept), touched, "drop")

    def drop(self, coords: dict, commit: bool = True, tag=None, **_):
        """Remove labels and their cells; an unknown label is a ``KeyError``. Chunks without them stay as they are."""
        return self._change(lambda e: self._dropped(e, coords), commit, tag)

    def _compacted(self, entry: dict | None, few: int) -> dict | None:
        entry = self._known(entry)
        touched = [c for c, folders in entry["parts"].items() if len(folders) >= few]
        if not touched:
            return None
        return self._entry(entry, self._cells(entry, touched), entry["dims"], entry["vars"], self._axes(entry), set(), touched, "compact")

    def compact(self, few: int = FEW, commit: bool = True):
        """Chunks that appends have scattered over ``few`` folders or more get one."""
        return self._change(lambda e: self._compacted(e, few), commit)


#: Storage kinds by the names that definitions use.
STORAGES: dict[str, type] = {"tensor_table": TensorTable}

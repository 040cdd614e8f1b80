"""The catalog and its verbs: definitions, storages, pipelines, formulas and refreshes in order."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import asdict

from gridloom import operators as op
from gridloom.functions.formula import CELLWISE, OPERATORS, evaluate
from gridloom.plans import dag as _dag
from gridloom.plans.definitions import TensorDefinition
from gridloom.shared import delete
from gridloom.sources.base import TensorNotFound
from gridloom.sources.buffer import BufferedTable
from gridloom.sources.documents import DocumentStore, deep_merge
from gridloom.sources.versioned import STORAGES, TensorTable
from gridloom.tensor import Tensor

DEFINITIONS = "_tensor_definitions"


def bound_parameters(func: Callable, *sources: dict) -> dict:
    """The entries of the dictionaries that the function takes, earlier ones first; all of them if it
    takes any keyword."""
    merged: dict = {}
    for s in reversed(sources):
        merged.update(s)
    takes = inspect.signature(func).parameters
    if any(p.kind is p.VAR_KEYWORD for p in takes.values()):
        return merged
    return {k: v for k, v in merged.items() if k in takes}


class Client:
    """Tensors by path below one root.

    A definition may replace a verb's method or put a pipeline before it. Steps are looked up on the
    storage, then on the client (so a subclass can add its own), then among the registered operators.
    """

    operators: dict[str, Callable] = dict(OPERATORS)

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.documents = DocumentStore(spark, f"{self.root}/{DEFINITIONS}")
        self.data = DocumentStore(spark, f"{self.root}/_data")

    @classmethod
    def operator(cls, name: str):
        """Register a function of tensors as a pipeline step and formula function."""

        def add(f):
            cls.operators = {**cls.operators, name: f}
            return f

        return add

    # catalog

    def create_tensor(self, definition: TensorDefinition | dict) -> None:
        """Write a definition in place of any before."""
        d = definition if isinstance(definition, TensorDefinition) else TensorDefinition.from_dict(definition)
        self.documents.store(d.to_dict(), d.path)

    def upsert_tensor(self, definition: TensorDefinition | dict) -> None:
        """Merge into the definition that there is."""
        new = definition.to_dict() if isinstance(definition, TensorDefinition) else dict(definition)
        old = self.documents.read(new["path"]) if self.documents.exist(new["path"]) else {}
        self.documents.store(TensorDefinition.from_dict(deep_merge(old, new)).to_dict(), new["path"])

    def get_tensor_definition(self, path: str) -> TensorDefinition:
        try:
            return TensorDefinition.from_dict(self.documents.read(path))
        except FileNotFoundError:
            raise TensorNotFound(f"there is no tensor {path!r}; create_tensor defines it") from None

    def get_all_tensors_definition(self) -> list[TensorDefinition]:
        names, todo = [], [""]
        from gridloom.shared import list_names

        while todo:
            folder = todo.pop()
            for n in list_names(self.spark, f"{self.documents.root}/{folder}".rstrip("/")):
                if n.endswith(".json"):
                    names.append(f"{folder}/{n[:-5]}".strip("/"))
                elif not n.startswith((".", "_")) and not n.endswith((".crc", ".tmp")):
                    todo.append(f"{folder}/{n}".strip("/"))
        return list(_dag.run_parallel({n: (lambda n=n: self.get_tensor_definition(n)) for n in sorted(names)}, 8).values())

    def update_tensor_metadata(self, path: str, metadata: dict) -> None:
        self.upsert_tensor({"path": path, "metadata": metadata})

    def delete_tensor(self, path: str, only_data: bool = False) -> None:
        self.get_storage(path).delete()
        if not only_data:
            self.documents.delete(path)

    def delete_tensors(self, paths: list[str], only_data: bool = False) -> None:
        """Those that do not exist are passed over."""
        for p in paths:
            try:
                self.delete_tensor(p, only_data)
            except FileNotFoundError:
                delete(self.spark, f"{self.root}/{p}")

    def add_custom_data(self, path: str, data: dict) -> None:
        self.data.store(data, path)

    def get_custom_data(self, path: str, default=None):
        return self.data.read(path) if self.data.exist(path) else default

    def get_storage(self, path: str | TensorDefinition):
        d = path if isinstance(path, TensorDefinition) else self.get_tensor_definition(path)
        options = {k: v for k, v in d.storage.items() if k != "storage_name"}
        kind = d.storage.get("storage_name", "tensor_table")
        if kind == "documents":
            return DocumentStore(self.spark, f"{self.root}/{d.path}")
        return STORAGES[kind](self.spark, f"{self.root}/{d.path}", **options)

    def get_buffered(self, path: str, dim: str, max_labels: int, **options) -> BufferedTable:
        return BufferedTable(_Verbs(self, path), dim, max_labels, **options)

    def exist(self, path: str, only_definition: bool = False) -> bool:
        if not self.documents.exist(path):
            return False
        if only_definition:
            return True
        try:
            self.read(path)
            return True
        except FileNotFoundError:
            return False

    # verbs

    def read(self, path: str | Tensor, **parameters):
        return path if isinstance(path, Tensor) else self.call(path, "read", parameters)

    def store(self, path: str, **parameters):
        return self.call(path, "store", parameters)

    def append(self, path: str, **parameters):
        return self.call(path, "append", parameters)

    def update(self, path: str, **parameters):
        return self.call(path, "update", parameters)

    def upsert(self, path: str, **parameters):
        return self.call(path, "upsert", parameters)

    def drop(self, path: str, **parameters):
        return self.call(path, "drop", parameters)

    def _method(self, name: str, storage):
        for owner in (storage, self):
            if hasattr(owner, name):
                return getattr(owner, name)
        if name in self.operators:
            return self.operators[name]
        if name in CELLWISE:
            return lambda new_data, *a, **k: new_data.map(lambda c: CELLWISE[name](c, *a, **k))
        raise AttributeError(f"no method or operator {name!r}")

    def call(self, path: str | TensorDefinition, verb: str, parameters: dict | None = None):
        """A verb of a tensor, as its definition has it. Of equal parameters those of the call win, then a
        step's, then the definition's."""
        d = path if isinstance(path, TensorDefinition) else self.get_tensor_definition(path)
        storage, given = self.get_storage(d), dict(parameters or {})
        spec = d.definition.get(verb)
        context = {"definition": d, "original_path": d.path, "storage": storage}
        base: dict = {}
        if spec:
            base = spec.parameters
            if spec.substitute_method:
                method = self._method(spec.substitute_method, storage)
                return method(**bound_parameters(method, given, context, base))
            if spec.data_transformation:
                result = self.apply_data_transformation(spec.data_transformation, storage, context, given, base)
                if verb == "read":
                    return result
                given = {**given, "new_data": result}
        method = getattr(storage, verb)
        return method(**bound_parameters(method, given, base))

    def apply_data_transformation(self, steps, storage, context: dict, given: dict, base: dict):
        """Run the steps in order; each result is the next one's new_data, and may be bound to a name."""
        names, result = dict(given), given.get("new_data")
        for step in steps:
            method = self._method(step.method_name, storage)
            first = next(iter(inspect.signature(method).parameters), None)
            chosen = bound_parameters(method, {k: v for k, v in names.items() if k != "new_data"}, step.parameters, base, {**context, "names": names})
            if "new_data" in inspect.signature(method).parameters and result is not None:
                chosen["new_data"] = result
            elif step.method_name in self.operators and first not in chosen and result is not None:
                chosen[first] = result
            result = method(**chosen)
            if isinstance(step.result_name, str):
                names[step.result_name] = result
            elif isinstance(result, dict):
                renamed = step.result_name or {k: k for k in result}
                names.update({new: result[old] for old, new in renamed.items()})
            names["new_data"] = result
        return result

    def read_from_formula(self, formula: str, original_path: str | None = None, storage=None, names: dict | None = None, use_exec: bool = False):
        """The tensor a formula stands for. A tensor that names itself reads what is stored, not its own
        definition. ``use_exec`` is accepted: assignments are part of the language, arbitrary code is not."""

        def read(path: str) -> Tensor:
            return storage.read() if path == original_path and storage is not None else self.read(path)

        return evaluate(formula, read, names, self.operators)

    # many tensors

    def exec_on_parallel(self, method: str, paths_kwargs: dict[str, dict], max_parallelization: int | None = None) -> dict:
        f = getattr(self, method)
        return _dag.run_parallel({p: (lambda p=p, k=k: f(p, **k)) for p, k in paths_kwargs.items()}, max_parallelization)

    def _selected(self, tensors_path, autofill_dependencies: bool) -> list[TensorDefinition]:
        known = {d.path: d for d in self.get_all_tensors_definition()}
        if tensors_path is None:
            return [d for d in known.values() if d.dag is not None]
        paths = _dag.with_dependencies(tensors_path, known) if autofill_dependencies else list(tensors_path)
        missing = [p for p in paths if p not in known]
        if missing:
            raise KeyError(f"unknown tensors {missing}")
        return [known[p] for p in paths]

    def exec_on_dag_order(self, method: str, kwargs_groups: dict | None = None, tensors_path=None, max_parallelization: int | None = None, max_parallelization_per_group: dict | None = None, autofill_dependencies: bool = False, only_on_groups=None, check_dependencies: bool = True, omit_first_n_levels: int = 0) -> list[list[str]]:
        """Run a verb over tensors level by level; what ran, by level."""
        chosen = self._selected(tensors_path, autofill_dependencies)
        by_path, ran = {d.path: d for d in chosen}, []
        group = lambda p: by_path[p].dag.group if by_path[p].dag else "regular"
        for level in _dag.levels(chosen, check_dependencies)[omit_first_n_levels:]:
            level = [p for p in level if method not in (by_path[p].dag.omit_on if by_path[p].dag else [])]
            if only_on_groups:
                level = [p for p in level if group(p) in set(only_on_groups)]
            for batch in _dag.grouped_chunks(level, group, max_parallelization_per_group or {}):
                self.exec_on_parallel(method, {p: dict((kwargs_groups or {}).get(group(p), {})) for p in batch}, max_parallelization)
            ran.append(level)
        return ran

    def exec_on_graph(self, method: str, kwargs_groups: dict | None = None, tensors_path=None, max_parallelization: int = 8, max_parallelization_per_group: dict | None = None, autofill_dependencies: bool = False) -> dict:
        """The same without barriers between levels: a tensor starts when what it needs is done."""
        chosen = self._selected(tensors_path, autofill_dependencies)
        by_path = {d.path: d for d in chosen}
        _dag.levels(chosen, check_dependencies=False)
        graph = {p: [x for x in (d.dag.depends if d.dag else []) if x in by_path] for p, d in by_path.items()}
        group = lambda p: by_path[p].dag.group if by_path[p].dag else "regular"

        def job(p: str):
            if method in (by_path[p].dag.omit_on if by_path[p].dag else []):
                return None
            return getattr(self, method)(p, **dict((kwargs_groups or {}).get(group(p), {})))

        return _dag.run_graph(graph, job, group, max_parallelization_per_group, max_parallelization)

    def describe(self, path: str) -> dict:
        return asdict(self.get_tensor_definition(path))


class _Verbs:
    """A path's verbs, as a buffer needs them."""

    def __init__(self, client: Client, path: str):
        self.client, self.path = client, path

    def __getattr__(self, verb: str):
        f = getattr(self.client, verb)
        return lambda new_data=None, **k: f(self.path, **({"new_data": new_data} if new_data is not None else {}), **k)


__all__ = ["Client", "TensorTable", "op"]

"""What a catalog keeps of a tensor: where it is stored, what its verbs do, what it depends on."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass
class DagNode:
    """Place in the dependency graph: tensors it needs, a group for caps and filters, verbs to leave out."""

    depends: list[str] = field(default_factory=list)
    group: str = "regular"
    omit_on: list[str] = field(default_factory=list)


@dataclass
class Step:
    """One step of a pipeline: a method of the storage, the client or a registered operator.

    ``result_name`` binds the result for later steps: a name, or ``{result key: name}``."""

    method_name: str
    parameters: dict = field(default_factory=dict)
    result_name: str | dict | None = None


@dataclass
class VerbDefinition:
    """How a verb of one tensor differs from the storage's own: another method, or a pipeline before it.
    ``parameters`` are defaults for everything the verb calls."""

    substitute_method: str | None = None
    data_transformation: list[Step] = field(default_factory=list)
    parameters: dict = field(default_factory=dict)


@dataclass
class TensorDefinition:
    path: str
    definition: dict[str, VerbDefinition] = field(default_factory=dict)
    dag: DagNode | None = None
    storage: dict = field(default_factory=lambda: {"storage_name": "tensor_table"})
    metadata: dict = field(default_factory=dict)

    def __hash__(self) -> int:
        return hash(self.path)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> TensorDefinition:
        verbs = {}
        for name, v in (d.get("definition") or {}).items():
            v = v if isinstance(v, dict) else asdict(v)
            known = {"substitute_method", "data_transformation", "parameters"}
            steps = [Step(**s) if isinstance(s, dict) else s for s in v.get("data_transformation") or []]
            verbs[name] = VerbDefinition(v.get("substitute_method"), steps, {**{k: x for k, x in v.items() if k not in known}, **(v.get("parameters") or {})})
        dag = d.get("dag")
        return cls(
            d["path"], verbs, DagNode(**dag) if isinstance(dag, dict) else dag, {"storage_name": "tensor_table", **(d.get("storage") or {})}, d.get("metadata") or {}
        )

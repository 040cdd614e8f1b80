"""JSON documents in a folder."""

from __future__ import annotations

import json

from gridloom.shared import delete, exists, list_names, read_text, write_text
from gridloom.sources.base import Storage, TensorNotFound


def deep_merge(old: dict, new: dict) -> dict:
    """``new`` over ``old``; dictionaries in both are merged in turn."""
    out = dict(old)
    for k, v in new.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _plain(x):
    return x.tolist() if hasattr(x, "tolist") else str(x)


class DocumentStore(Storage):
    """``name`` becomes ``<root>/<name>.json``; upsert merges deeply."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        name = name.strip("/")
        return f"{self.root}/{name if name.endswith('.json') else name + '.json'}"

    def store(self, new_data: dict, name: str = "data", **_) -> None:
        write_text(self.spark, self.path(name), json.dumps(new_data, default=_plain))

    def read(self, name: str = "data", **_) -> dict:
        """The document; one that cannot be parsed reads as empty."""
        if not exists(self.spark, self.path(name)):
            raise TensorNotFound(self.path(name))
        try:
            return json.loads(read_text(self.spark, self.path(name)))
        except ValueError:
            return {}

    def upsert(self, new_data: dict, name: str = "data", **_) -> None:
        self.store(deep_merge(self.read(name), new_data) if self.exist(name) else new_data, name)

    def exist(self, name: str = "data", **_) -> bool:
        return exists(self.spark, self.path(name))

    def delete(self, name: str = "data", **_) -> None:
        delete(self.spark, self.path(name))

    def names(self, folder: str = "") -> list[str]:
        return [n[:-5] for n in list_names(self.spark, f"{self.root}/{folder}".rstrip("/")) if n.endswith(".json")]

    def append(self, new_data, **_):
        raise NotImplementedError("documents cannot be appended to")

    def update(self, new_data, **_):
        raise NotImplementedError("documents have no cells to update")

    def drop(self, coords, **_):
        raise NotImplementedError("documents have no labels to drop")

"""A write buffer before a stored tensor: many small writes become one version."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators.align import combine_first, concat
from gridloom.tensor import Tensor


class BufferedTable:
    """Collects store, append and update and flushes when the labels of ``dim`` exceed ``max_labels``.

    ``merge_updates``: 'combine_first' lets new valid cells win and keeps old ones in holes; 'keep_last'
    discards what was buffered for labels that come again. With ``merge_cache``, updates of labels whose
    append is pending are folded into it. ``sort_dims`` are sorted when flushed.
    """

    def __init__(self, table, dim: str, max_labels: int, sort_dims=None, merge_cache: bool = False, update_logic: str = "combine_first"):
        if update_logic not in ("combine_first", "keep_last"):
            raise ValueError(f"update_logic {update_logic!r}")
        self.table, self.dim, self.most, self.sort_dims, self.merge, self.logic = table, dim, max_labels, list(sort_dims or []), merge_cache, update_logic
        self._clear()

    def _clear(self) -> None:
        self.pending: dict[str, list[Tensor]] = {"store": [], "append": [], "update": []}
        self.options: dict[str, dict] = {"store": {}, "append": {}, "update": {}}
        self.count = 0

    def _add(self, kind: str, t: Tensor, options: dict) -> None:
        if kind == "append" and self.pending["store"]:
            kind = "store"
        self.count += t.axis(self.dim).select(self.dim).distinct().count()
        self.pending[kind].append(t)
        self.options[kind] = {**self.options[kind], **options}
        if self.count > self.most:
            self.flush()

    def store(self, new_data: Tensor, **options) -> None:
        """Discards everything pending."""
        self._clear()
        self._add("store", new_data, options)

    def append(self, new_data: Tensor, **options) -> None:
        self._add("append", new_data, options)

    def update(self, new_data: Tensor, **options) -> None:
        self._add("update", new_data, options)

    def _merged(self, parts: list[Tensor]) -> Tensor:
        out = parts[0]
        for p in parts[1:]:
            if self.logic == "keep_last":
                labels = p.axis(self.dim).select(self.dim).distinct()
                out = out.using(out.df.join(labels, self.dim, "left_anti"))
                out = concat([out, p])
            else:
                out = combine_first(p, out)
        return out

    def flush(self) -> None:
        """Write what is pending: store, then append, then update."""
        pending = dict(self.pending)
        if self.merge and pending["update"] and (pending["append"] or pending["store"]):
            kind = "store" if pending["store"] else "append"
            base = concat(pending[kind])
            updates = self._merged(pending["update"])
            labels = base.axis(self.dim).select(self.dim).distinct()
            inside = updates.using(updates.df.join(labels, self.dim, "left_semi"), coords={})
            rest = updates.using(updates.df.join(labels, self.dim, "left_anti"), coords={})
            pending[kind] = [self._merged([base, inside])]
            pending["update"] = [] if rest.df.isEmpty() else [rest]
        for kind in ("store", "append", "update"):
            if pending[kind]:
                t = self._merged(pending[kind]) if kind == "update" else concat(pending[kind])
                if self.sort_dims:
                    t = t.using(t.df, coords={d: c for d, c in t.coords.items() if d not in self.sort_dims})
                getattr(self.table, kind)(t, **self.options[kind])
        self._clear()

    def read(self, **options) -> Tensor:
        self.flush()
        return self.table.read(**options)

    def close(self) -> None:
        self.flush()

    def __enter__(self):
        return self

    def __exit__(self, *error) -> None:
        if error[0] is None:
            self.close()

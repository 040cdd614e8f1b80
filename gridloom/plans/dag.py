"""Dependency order, levels and capped batches, on the driver."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from graphlib import CycleError, TopologicalSorter

from gridloom.plans.definitions import TensorDefinition


def with_dependencies(paths: Iterable[str], all_definitions: dict[str, TensorDefinition]) -> list[str]:
    """The paths and all they depend on, directly or not."""
    todo, seen = list(paths), []
    while todo:
        p = todo.pop()
        if p not in seen:
            seen.append(p)
            node = all_definitions[p].dag if p in all_definitions else None
            todo += node.depends if node else []
    return seen


def levels(definitions: Iterable[TensorDefinition], check_dependencies: bool = True) -> list[list[str]]:
    """Tensors by level: each depends on earlier levels only. A cycle is a ValueError, an unknown
    dependency a KeyError if checked."""
    graph = {d.path: list(d.dag.depends if d.dag else []) for d in definitions}
    unknown = {x for xs in graph.values() for x in xs} - set(graph)
    if unknown and check_dependencies:
        raise KeyError(f"unknown dependencies {sorted(unknown)}")
    sorter = TopologicalSorter({k: [x for x in xs if x in graph] for k, xs in graph.items()})
    try:
        sorter.prepare()
    except CycleError as error:
        raise ValueError(f"the dependencies have a cycle: {error.args[1]}") from None
    out = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out.append(ready)
        sorter.done(*ready)
    return out


def leaves(graph: dict[str, list[str]]) -> list[str]:
    """Nodes that nothing depends on."""
    needed = {x for xs in graph.values() for x in xs}
    return [n for n in graph if n not in needed]


def capacity_edges(names: list[str], most: int) -> dict[str, list[str]]:
    """Extra dependencies under which at most ``most`` of the names run at once: each waits for the one
    ``most`` places before it."""
    return {n: [names[i - most]] if i >= most else [] for i, n in enumerate(names)}


def grouped_chunks(items: Iterable[Hashable], group_of: Callable, most_by_group: dict, sort_key: Callable | None = None) -> list[list]:
    """Batches in which no group has more items than its cap (no cap: all at once); groups side by side, in the
    order in which they come, or in that of ``sort_key``, as the items of each group."""
    queues: dict = {}
    for item in sorted(items, key=sort_key) if sort_key else items:
        queues.setdefault(group_of(item), []).append(item)
    out = []
    while any(queues.values()):
        batch = []
        for g, q in queues.items():
            n = most_by_group.get(g) or len(q)
            batch += q[:n]
            queues[g] = q[n:]
        out.append(batch)
    return out


def run_parallel(jobs: dict[str, Callable], most: int | None = None) -> dict:
    """Run jobs in threads, at most ``most`` at once; an error names its job."""
    out = {}
    with ThreadPoolExecutor(max(1, min(most or len(jobs) or 1, len(jobs) or 1))) as pool:
        futures = {pool.submit(f): name for name, f in jobs.items()}
        for future, name in futures.items():
            try:
                out[name] = future.result()
            except Exception as error:
                raise RuntimeError(f"{name}: {error}") from error
    return out


def run_graph(graph: dict[str, list[str]], job: Callable[[str], object], group_of: Callable[[str], str] = lambda _: "", most_by_group: dict | None = None, most: int = 8) -> dict:
    """Run every node as soon as what it depends on is done, without level barriers, under the caps."""
    sorter = TopologicalSorter(graph)
    try:
        sorter.prepare()
    except CycleError as error:
        raise ValueError(f"the dependencies have a cycle: {error.args[1]}") from None
    caps, running, waiting, out, busy = most_by_group or {}, {}, [], {}, {}
    with ThreadPoolExecutor(max(1, most)) as pool:
        while sorter.is_active():
            waiting += sorted(sorter.get_ready())
            for name in list(waiting):
                g = group_of(name)
                if busy.get(g, 0) < (caps.get(g) or len(graph)) and len(running) < most:
                    waiting.remove(name)
                    busy[g] = busy.get(g, 0) + 1
                    running[pool.submit(job, name)] = name
            done, _ = wait(running, return_when=FIRST_COMPLETED)
            for future in done:
                name = running.pop(future)
                busy[group_of(name)] -= 1
                try:
                    out[name] = future.result()
                except Exception as error:
                    raise RuntimeError(f"{name}: {error}") from error
                sorter.done(name)
    return out

"""A small formula language over tensors, compiled from Python's syntax tree.

Names between backquotes are stored tensors (they may hold '/'); bare names are values of the pipeline.
Only what is listed here is understood; nothing is evaluated as code.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable

from pyspark.sql import functions as F

from gridloom import operators as op
from gridloom.tensor import Tensor, divide

_QUOTED = re.compile(r"`([^`]*)`")

_BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b,
    ast.FloorDiv: lambda a, b: a // b, ast.Mod: lambda a, b: a % b, ast.Pow: lambda a, b: a**b, ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b,
}
_COMPARE = {
    ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b,
    ast.Eq: lambda a, b: a.equals(b), ast.NotEq: lambda a, b: a.differs(b),
}

#: Functions of each cell: name(tensor, ...).
CELLWISE: dict[str, Callable] = {
    "abs": F.abs, "exp": F.exp, "sign": F.signum, "floor": F.floor, "ceil": F.ceil, "log1p": F.log1p, "expm1": F.expm1, "sin": F.sin, "cos": F.cos, "tan": F.tan, "tanh": F.tanh,
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)), "log": lambda c: F.when(c > 0, F.log(c)), "log2": lambda c: F.when(c > 0, F.log2(c)), "log10": lambda c: F.when(c > 0, F.log10(c)),
    "round": lambda c, n=0: F.round(c, n), "isnull": lambda c: c.isNull(), "isnan": lambda c: c.isNull(), "notnull": lambda c: c.isNotNull(),
    "clip": lambda c, low=None, high=None: F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low))),
    "astype": lambda c, kind: c.cast({"float": "double", "float64": "double", "int": "long", "int64": "long", "bool": "boolean", "float32": "float"}.get(kind, kind)),
}
_NULL_TESTS = {"isnull", "isnan", "notnull"}

_REDUCE = {"sum", "prod", "mean", "max", "min", "count", "std", "var", "median", "first", "last", "any", "all", "quantile"}

#: Operators as functions or methods: name(tensor, ...).
OPERATORS: dict[str, Callable] = {
    "ffill": op.ffill, "rank": op.rank, "multi_rank": op.multi_rank, "shift_on_valid": op.shift_on_valid, "rolling_along_axis": op.rolling, "rolling_overlap": op.rolling_overlap,
    "cumulative_on_sort": op.cumulative_on_sort, "bitmask_topk": op.topk_mask, "topk_mask": op.topk_mask, "replace": op.replace_values, "vindex": op.take, "reindex": op.reindex,
    "reindex_with_pad": op.reindex, "dropna": op.dropna, "drop_unmarked": op.drop_unmarked, "apply_on_groups": op.apply_on_groups, "merge_duplicates_coord": op.merge_duplicates,
    "fillna": op.fillna, "where": op.where, "isin": op.isin, "append_previous": op.append_previous, "combine_first": lambda t, o: op.combine_first(t, o), "dot": op.dot, "last_valid_dim": op.last_valid_label,
    "drop": op.drop_labels,
}


class FormulaError(ValueError):
    """The formula uses something that the language does not have."""


def paths_of(formula: str) -> set[str]:
    """Names between backquotes."""
    if formula.count("`") % 2:
        raise FormulaError("unpaired backquote")
    return set(_QUOTED.findall(formula))


class _Rolling:
    """``t.rolling({'dim': n})`` until a function is chosen."""

    def __init__(self, t: Tensor, sizes: dict, min_periods=None):
        (self.dim, self.window), self.t, self.least = *sizes.items(), t, min_periods

    def __getattr__(self, name: str):
        if name not in op.MOVING:
            raise FormulaError(f"no moving {name}")
        return lambda: op.rolling(self.t, self.dim, self.window, name, min_periods=self.window if self.least is None else self.least, drop_nan=False)


class Compiler(ast.NodeVisitor):
    """Turns one expression into a tensor; ``names`` and ``read`` give what names stand for."""

    def __init__(self, names: dict, read: Callable[[str], Tensor], extra: dict[str, Callable] | None = None):
        self.names, self.read, self.extra, self.seen = dict(names), read, dict(extra or {}), {}

    def run(self, formula: str):
        paths = sorted(paths_of(formula))
        slots = {p: f"__tensor_{i}" for i, p in enumerate(paths)}
        text = _QUOTED.sub(lambda m: slots[m[1]], formula)
        self.slots = {s: p for p, s in slots.items()}
        tree = ast.parse(text.strip().replace("\n", " ") if "=" not in re.sub(r"[=!<>]=|\([^()]*\)", "", text) else text.strip(), mode="exec")
        result, assigned = None, set()
        for node in tree.body:
            if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                self.names[node.targets[0].id] = result = self.visit(node.value)
                assigned.add(node.targets[0].id)
            elif isinstance(node, ast.Expr):
                result = self.visit(node.value)
            else:
                raise FormulaError(f"statement {type(node).__name__}")
        return self.names["new_data"] if "new_data" in assigned else result

    def generic_visit(self, node):
        raise FormulaError(f"{type(node).__name__} is not part of formulas")

    def visit_Constant(self, node):
        return node.value

    def visit_Name(self, node):
        if node.id in getattr(self, "slots", {}):
            if node.id not in self.seen:  # each tensor is read once
                self.seen[node.id] = self.read(self.slots[node.id])
            return self.seen[node.id]
        if node.id in self.names:
            return self.names[node.id]
        if node.id in ("pi", "e", "nan"):
            return {"pi": math.pi, "e": math.e, "nan": None}[node.id]
        raise FormulaError(f"unknown name {node.id!r}")

    def visit_BinOp(self, node):
        f = _BINARY.get(type(node.op))
        if f is None:
            raise FormulaError(f"operator {type(node.op).__name__}")
        a, b = self.visit(node.left), self.visit(node.right)
        if isinstance(b, Tensor) and not isinstance(a, Tensor):
            if isinstance(node.op, (ast.Pow, ast.Mod, ast.FloorDiv)):
                c = {ast.Pow: lambda x: F.pow(F.lit(a), x), ast.Mod: lambda x: F.pmod(F.lit(a), F.nullif(x, F.lit(0))), ast.FloorDiv: lambda x: F.floor(divide(F.lit(a), x))}[type(node.op)]
                return b.map(c)
            if isinstance(node.op, (ast.BitAnd, ast.BitOr)):
                return f(b, a)
        return f(a, b)

    def visit_UnaryOp(self, node):
        x = self.visit(node.operand)
        if isinstance(node.op, ast.USub):
            return -x
        if isinstance(node.op, ast.UAdd):
            return x
        return ~x if isinstance(node.op, ast.Invert) else not x

    def visit_Compare(self, node):
        if len(node.ops) != 1 or type(node.ops[0]) not in _COMPARE:
            raise FormulaError("one comparison at a time")
        a, b = self.visit(node.left), self.visit(node.comparators[0])
        if isinstance(b, Tensor) and not isinstance(a, Tensor):
            flip = {ast.Gt: ast.Lt, ast.Lt: ast.Gt, ast.GtE: ast.LtE, ast.LtE: ast.GtE}
            return _COMPARE[flip.get(type(node.ops[0]), type(node.ops[0]))](b, a)
        return _COMPARE[type(node.ops[0])](a, b)

    def visit_List(self, node):
        return [self.visit(x) for x in node.elts]

    visit_Tuple = visit_List

    def visit_Dict(self, node):
        return {self.visit(k): self.visit(v) for k, v in zip(node.keys, node.values)}

    def visit_Call(self, node):
        args = [self.visit(a) for a in node.args]
        kwargs = {k.arg: self.visit(k.value) for k in node.keywords if k.arg}
        if isinstance(node.func, ast.Attribute):
            owner = node.func.value
            if isinstance(owner, ast.Name) and owner.id in ("np", "xr", "da", "pd") and owner.id not in self.names:
                return self._call(node.func.attr, args, kwargs)  # np.log(x) is log(x)
            target = self.visit(owner)
            if isinstance(target, _Rolling):
                return getattr(target, node.func.attr)()
            return self._call(node.func.attr, [target, *args], kwargs)
        if isinstance(node.func, ast.Name):
            return self._call(node.func.id, args, kwargs)
        raise FormulaError("call of an expression")

    def _call(self, name: str, args: list, kwargs: dict):
        if name in self.extra:
            return self.extra[name](*args, **kwargs)
        if not args or not isinstance(args[0], Tensor):
            raise FormulaError(f"{name} needs a tensor first")
        t = args[0]
        if name == "rolling":
            sizes = args[1] if len(args) > 1 else {k: v for k, v in kwargs.items() if k in t.dims}
            return _Rolling(t, sizes, kwargs.get("min_periods"))
        if name in _REDUCE:
            dims = kwargs.pop("dim", args[1] if len(args) > 1 else None)
            return op.reduce_dims(t, name, dims, **kwargs)
        if name == "sel":
            return op.sel(t, **(args[1] if len(args) > 1 else kwargs))
        if name == "isel":
            return op.isel(t, **(args[1] if len(args) > 1 else kwargs))
        if name == "rename":
            return t.rename(**(args[1] if len(args) > 1 else kwargs))
        if name == "transpose":
            return t.transpose(*args[1:])
        if name in CELLWISE:
            source = t.dense() if name in _NULL_TESTS else t
            return source.map(lambda c: CELLWISE[name](c, *args[1:], **kwargs))
        if name in OPERATORS:
            return OPERATORS[name](*args, **kwargs)
        raise FormulaError(f"unknown function {name!r}")


def evaluate(formula: str, read: Callable[[str], Tensor], names: dict | None = None, extra: dict | None = None):
    """The tensor that a formula stands for; with assignments, the one named new_data."""
    return Compiler(names or {}, read, extra).run(formula)

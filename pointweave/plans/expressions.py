"""Arithmetic expressions over named variables, as numbers or as columns."""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY: dict[type, Callable] = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_UNARY: dict[type, Callable] = {ast.USub: operator.neg, ast.UAdd: operator.pos}
_NUMBERS = {"sqrt": math.sqrt, "abs": abs, "sin": math.sin, "cos": math.cos, "tan": math.tan, "exp": math.exp, "log": math.log, "min": min, "max": max}
_COLUMNS = {"sqrt": F.sqrt, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "log": F.log, "min": F.least, "max": F.greatest}


class Expression:
    """Parsed once; only arithmetic, a few functions and names are allowed."""

    def __init__(self, text: str | float):
        self.text = str(text)
        try:
            self.tree = ast.parse(self.text.strip().replace("^", "**"), mode="eval").body
        except SyntaxError as e:
            raise ValueError(f"not an expression: {self.text!r}") from e
        self._check(self.tree)

    def _check(self, node: ast.AST) -> None:
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            self._check(node.left)
            self._check(node.right)
        elif isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
            self._check(node.operand)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _NUMBERS and not node.keywords:
            for a in node.args:
                self._check(a)
        elif not (isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) or isinstance(node, ast.Name)):
            raise ValueError(f"not allowed in an expression: {self.text!r}")

    def names(self) -> set[str]:
        called = {id(n.func) for n in ast.walk(self.tree) if isinstance(n, ast.Call)}
        return {n.id for n in ast.walk(self.tree) if isinstance(n, ast.Name) and id(n) not in called}

    def _run(self, node: ast.AST, names: Callable, functions: dict, number: Callable):
        if isinstance(node, ast.Constant):
            return number(node.value)
        if isinstance(node, ast.Name):
            return names(node.id)
        if isinstance(node, ast.UnaryOp):
            return _UNARY[type(node.op)](self._run(node.operand, names, functions, number))
        if isinstance(node, ast.BinOp):
            return _BINARY[type(node.op)](self._run(node.left, names, functions, number), self._run(node.right, names, functions, number))
        return functions[node.func.id](*[self._run(a, names, functions, number) for a in node.args])

    def value(self, variables: Mapping[str, float] | None = None) -> float:
        if missing := sorted(self.names() - set(variables or {})):
            raise ValueError(f"{self.text!r} needs a value for {', '.join(missing)}")
        return float(self._run(self.tree, lambda n: (variables or {})[n], _NUMBERS, float))

    def column(self, variables: Mapping[str, float] | None = None) -> Column:
        """With names that have no value as columns, so that one query serves all keyframes."""
        known = variables or {}
        return self._run(self.tree, lambda n: F.lit(float(known[n])) if n in known else F.col(n), _COLUMNS, lambda v: F.lit(float(v)))


def realised(value, variables: Mapping[str, float] | None = None, columns: tuple[str, ...] = ()):
    """A parameter as a number where it is an expression, and lists and maps of them likewise.

    An expression with names among ``columns`` becomes a column.
    """
    if isinstance(value, Mapping):
        return {k: realised(v, variables, columns) for k, v in value.items()}
    if isinstance(value, list):
        return [realised(v, variables, columns) for v in value]
    if isinstance(value, str):
        if value.startswith("$f{") and value.endswith("}"):
            return Expression(value[3:-1]).value(variables)
        try:
            known = Expression(value)
            free = known.names() - set(variables or {})
            return known.column(variables) if free and free <= set(columns) else known.value(variables)
        except ValueError:
            return value
    return value

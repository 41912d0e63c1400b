"""Operators by name, for configuration files; modules may add their own."""

from __future__ import annotations

import importlib
from collections.abc import Callable

FILTERS: dict[str, Callable] = {}
MATCHERS: dict[str, Callable] = {}
SOLVERS: dict[str, Callable] = {}
EVALUATORS: dict[str, Callable] = {}
GENERATORS: dict[str, Callable] = {}


def registered(kind: dict[str, Callable], name: str) -> Callable[[Callable], Callable]:
    def put(f: Callable) -> Callable:
        kind[name] = f
        return f

    return put


def lookup(kind: dict[str, Callable], entry: dict) -> tuple[Callable, dict]:
    """The operator and parameters of an entry {class or class_name, params, plugin}; names may have a namespace."""
    if plugin := entry.get("plugin"):
        importlib.import_module(plugin)
    name = entry.get("class_name") or entry.get("class")
    if not name:
        raise ValueError(f"an entry without a class: {entry}")
    short = name.rpartition("::")[2]
    if short not in kind:
        raise KeyError(f"no operator named {name}; there are {', '.join(sorted(kind))}")
    return kind[short], dict(entry.get("params") or {})

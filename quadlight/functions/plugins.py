"""Sets of functions that live in modules of their own.

A module with a function ``install(register)`` is a set; ``register(iri, function)`` makes one of its functions callable
in every query. Sets are named one by one, found in a package, or announced by installed packages under the entry point
group ``quadlight.functions``.
"""

from __future__ import annotations

import importlib
import pkgutil
from importlib.metadata import entry_points
from types import ModuleType

from quadlight.functions.expressions import register

GROUP = "quadlight.functions"


def install(module: ModuleType | str) -> ModuleType:
    """Registers the functions of a module."""
    module = importlib.import_module(module) if isinstance(module, str) else module
    if not callable(getattr(module, "install", None)):
        raise TypeError(f"{module.__name__} has no function install(register)")
    module.install(register)
    return module


def discover(package: ModuleType | str) -> list[str]:
    """Registers the sets among a package's modules, in the order of their names; gives these names."""
    package = importlib.import_module(package) if isinstance(package, str) else package
    found = []
    for info in sorted(pkgutil.iter_modules(package.__path__, package.__name__ + "."), key=lambda m: m.name):
        module = importlib.import_module(info.name)
        if module.__name__ != __name__ and callable(getattr(module, "install", None)):
            install(module)
            found.append(info.name)
    return found


def announced() -> list[str]:
    """Registers the sets that installed packages announce; gives their names."""
    found = sorted(entry_points(group=GROUP), key=lambda e: e.name)
    for e in found:
        install(e.load())
    return [e.name for e in found]

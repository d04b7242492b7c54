"""All queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import pkgutil

_MODULES = [importlib.import_module(f"{__package__}.{m.name}") for m in pkgutil.iter_modules(importlib.import_module(__package__).__path__) if m.name.startswith("q") and m.name[1:3].isdigit()]


def queries() -> dict:
    return {m.NAME: m.query for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _MODULES if getattr(m, "SQL", None)}
